"""Queries over the conversions: each routes a file composed from a whole table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineferry.functions.convert import longest_digits, register_conversion
from lineferry.functions.text import trim_text
from lineferry.plans.load import external_columns, loaded, route
from lineferry.registry import fixtures as fx
from lineferry.registry.base import query, table
from lineferry.spec import DELIMITED, Field, LoadSpec

RUN = dt.datetime(2024, 2, 1, 12, 0, 0)


def delimited(fields: list[Field], delimiter: str = "|") -> LoadSpec:
    return LoadSpec("T", fields, kind=DELIMITED, delimiter=delimiter, run_ts=RUN)


def typed(lines: DataFrame, spec: LoadSpec) -> DataFrame:
    return route(lines, spec).drop("value", "_reason")


@query("null_default", f"""
WITH {fx.ORDER_SQL}
SELECT _line_no, {fx.PRIORITY_SQL} AS PRIORITY, 'HOST' AS SOURCE, 'ok' AS _status FROM texts""")
def null_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed(fx.order_lines(spark, sf_dir), fx.order_spec(fx.PRIORITY, fx.SOURCE))


@query("conv_text", """
SELECT c_custkey + 1 AS _line_no, c_mktsegment AS SEGMENT,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'Y' WHEN c_mktsegment = 'MACHINERY' THEN 'n'
       WHEN c_mktsegment = 'HOUSEHOLD' THEN 'y' END AS FLAG,
  CASE WHEN c_acctbal < 0 THEN ' c ' ELSE 'D' END AS SIDE, 'none' AS BLANK, 'ok' AS _status FROM customer""")
def conv_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = fx.customer_texts(spark, sf_dir).withColumn("blank", F.lit("  "))
    lines = fx.delimited_rows(texts, "|", "c_custkey", "c_mktsegment", "flag", "side", "blank")
    return typed(lines, delimited([
        Field("SEGMENT", 1), Field("FLAG", 2), Field("SIDE", 3, convert="string"),
        Field("BLANK", 4, convert="string", default="none"),
    ]))


@query("conv_left_trim", """
SELECT o_orderkey + 1 AS _line_no, ltrim(lpad(CAST(o_custkey AS VARCHAR), 8, '0'), '0') AS CUST, 'ok' AS _status
FROM orders""")
def conv_left_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed(fx.order_lines(spark, sf_dir), fx.order_spec(Field("CUST", 11, 18, convert="left_trim")))


@query("conv_line_break", """
SELECT doc_id + 1 AS _line_no,
  nullif(trim(replace(replace(text, chr(10), ' '), chr(13), ''),
    chr(1)||chr(2)||chr(3)||chr(4)||chr(5)||chr(6)||chr(7)||chr(8)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(14)
    ||chr(15)||chr(16)||chr(17)||chr(18)||chr(19)||chr(20)||chr(21)||chr(22)||chr(23)||chr(24)||chr(25)||chr(26)
    ||chr(27)||chr(28)||chr(29)||chr(30)||chr(31)||' '), '') AS BODY,
  'ok' AS _status FROM documents""")
def conv_line_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("_line_no"), F.col("text").alias("value"))
    # The unit separator does not occur in prose, so the whole text is one part.
    return typed(lines, delimited([Field("BODY", 1, convert="line_break_trim")], "31"))


@query("conv_integer", f"""
WITH {fx.ORDER_SQL}
SELECT _line_no, CAST({fx.ORDER_ID_SQL} AS INTEGER) AS ORDER_ID,
  CASE WHEN bad_id THEN 'unknown' ELSE 'ok' END AS _status FROM texts""")
def conv_integer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed(fx.order_lines(spark, sf_dir), fx.order_spec(Field("ORDER_ID", 1, 10, convert="integer")))


@query("conv_long", f"""
WITH {fx.ORDER_SQL}
SELECT _line_no, {fx.ORDER_ID_SQL} AS ORDER_ID, CASE WHEN bad_id THEN 'unknown' ELSE 'ok' END AS _status FROM texts""")
def conv_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed(fx.order_lines(spark, sf_dir), fx.order_spec(Field("ORDER_ID", 1, 10, convert="long")))


@query("conv_integer_div", """
SELECT c_custkey + 1 AS _line_no, CAST(trunc(CAST(round(c_acctbal * 100) AS BIGINT) / 7.0) AS INTEGER) AS PARTS,
  'ok' AS _status FROM customer""")
def conv_integer_div(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.delimited_rows(fx.customer_texts(spark, sf_dir), "|", "c_custkey", "cents")
    return typed(lines, delimited([Field("PARTS", 1, convert="integer_div", args={"by": 7})]))


@query("conv_currency", f"""
WITH {fx.ORDER_SQL} SELECT _line_no, {fx.AMOUNT_SQL} AS AMOUNT, 'ok' AS _status FROM texts""")
def conv_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = typed(fx.order_lines(spark, sf_dir), fx.order_spec(fx.AMOUNT))
    return out.withColumn("AMOUNT", F.col("AMOUNT").cast("decimal(18,2)"))


@query("conv_currency_plain", """
SELECT o_orderkey + 1 AS _line_no, CAST(CAST(c AS VARCHAR) || '.' || lpad(CAST(k AS VARCHAR), 8, '0') AS DECIMAL(28,8)) AS PLAIN,
  CAST(CAST(k AS DECIMAL(19,0)) * CAST('0.00000001' AS DECIMAL(9,8)) AS DECIMAL(28,8)) AS EIGHT, 'ok' AS _status
FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS c, o_orderkey * 7919 % 100000000 AS k FROM orders)""")
def conv_currency_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts with their own point and eight places, and with eight implied ones: nothing is rounded."""
    orders = table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey") * 7919 % 100000000)
    eight = F.lpad(F.col("k").cast("string"), 8, "0")
    text = F.concat(fx.cents("o_totalprice").cast("string"), F.lit("."), eight, F.lit("|"), eight)
    lines = fx.as_file(orders.select((F.col("o_orderkey") + 1).alias("_line_no"), text.alias("value")), "_line_no", "value")
    spec = LoadSpec("T", [
        Field("PLAIN", 1, convert="currency", args={"decimals": 0}), Field("EIGHT", 2, convert="currency", args={"decimals": 8}),
    ], kind=DELIMITED, delimiter="|")
    money = [F.col(c).cast("decimal(28,8)").alias(c) for c in ("PLAIN", "EIGHT")]
    return route(lines, spec).select("_line_no", *money, "_status")


@query("conv_currency_sum", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CAST((CAST(round(l_extendedprice * 100) AS BIGINT) + CAST(round(l_tax * 100) AS BIGINT)
    - CAST(round(l_discount * 100) AS BIGINT)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2)) AS TOTAL
FROM lineitem""")
def conv_currency_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    value = F.concat_ws(
        "|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", fx.cents("l_extendedprice").cast("string"),
        fx.cents("l_tax").cast("string"), F.concat(fx.cents("l_discount").cast("string"), F.lit("-")),
    )
    lines = fx.as_file(items, F.xxhash64(*items.columns), value)
    total = Field("TOTAL", 5, convert="currency_sum", args={"fields": ("TAX", "DISCOUNT")})
    spec = delimited([
        Field("l_orderkey", 1, convert="long"), Field("l_partkey", 2, convert="long"),
        Field("l_suppkey", 3, convert="long"), Field("l_linenumber", 4, convert="integer"), total,
        Field("TAX", 6, external=True), Field("DISCOUNT", 7, external=True),
    ])
    out = external_columns(route(lines, spec), spec).drop("value", "_line_no", "_status", "_reason")
    return out.withColumn("TOTAL", F.col("TOTAL").cast("decimal(18,2)"))


def _order_day(spark: SparkSession, sf_dir: str, convert: str, **args) -> DataFrame:
    day = Field("ORDER_DATE", 34, 41, convert=convert, args=args)
    return typed(fx.order_lines(spark, sf_dir), fx.order_spec(day))


@query("conv_timestamp", """
SELECT event_id + 1 AS _line_no, strftime(ts, '%Y-%m-%d %H:%M:%S') AS AT, 'ok' AS _status FROM events""")
def conv_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "events").select(
        (F.col("event_id") + 1).alias("_line_no"), F.date_format("ts", "yyyyMMddHHmmss").alias("value")
    )
    out = typed(lines, delimited([Field("AT", 1, convert="timestamp", args={"pattern": "yyyyMMddHHmmss"})]))
    return out.withColumn("AT", F.date_format("AT", "yyyy-MM-dd HH:mm:ss"))


@query("conv_date", f"""
WITH {fx.ORDER_SQL} SELECT _line_no, {fx.ORDER_DATE_SQL} AS ORDER_DATE, 'ok' AS _status FROM texts""")
def conv_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_day(spark, sf_dir, "date")


@query("conv_short_date", """
SELECT o_orderkey + 1 AS _line_no, CAST(date_trunc('month', o_orderdate) AS DATE) AS MONTH,
  CAST(date_trunc('year', o_orderdate) AS DATE) AS YEAR, 'ok' AS _status FROM orders""")
def conv_short_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") + 1).alias("_line_no"),
        F.concat_ws("|", F.date_format("o_orderdate", "yyyyMM"), F.date_format("o_orderdate", "yyyy")).alias("value"),
    )
    out = typed(lines, delimited([Field("MONTH", 1, convert="short_date"), Field("YEAR", 2, convert="short_date")]))
    return out.withColumns({c: F.col(c).cast("date") for c in ("MONTH", "YEAR")})


@query("conv_century_date", f"""
WITH {fx.ORDER_SQL}
SELECT _line_no,
  CAST(CASE WHEN order_day < DATE '1998-01-01' THEN order_day + INTERVAL 100 YEAR ELSE order_day END AS DATE) AS BY_MINIMUM,
  CAST(CASE WHEN order_day < DATE '1999-06-30' THEN order_day + INTERVAL 100 YEAR ELSE order_day END AS DATE) AS BY_FIELD,
  'ok' AS _status FROM texts""")
def conv_century_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyyMMdd")
    lines = table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") + 1).alias("_line_no"), F.concat_ws("|", day, F.lit("19990630")).alias("value")
    )
    out = typed(lines, delimited([
        Field("BY_MINIMUM", 1, convert="century_date", args={"minimum": "19980101"}),
        Field("BY_FIELD", 1, convert="century_date", args={"other": "FLOOR"}), Field("FLOOR", 2),
    ])).drop("FLOOR")
    return out.withColumns({c: F.col(c).cast("date") for c in ("BY_MINIMUM", "BY_FIELD")})


@query("conv_julian_date", """
SELECT o_orderkey + 1 AS _line_no,
  CASE WHEN o_orderstatus = 'O' OR o_orderpriority = '1-URGENT' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS DAY,
  CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus <> 'O' THEN 'unknown' ELSE 'ok' END AS _status FROM orders""")
def conv_julian_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero text for open orders, a day that does not exist for urgent ones."""
    text = (
        F.when(F.col("o_orderstatus") == "O", F.lit("0000000"))
        .when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("400")))
        .otherwise(F.date_format("o_orderdate", "yyyyDDD"))
    )
    lines = table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1).alias("_line_no"), text.alias("value"))
    out = typed(lines, delimited([Field("DAY", 1, convert="julian_date")]))
    return out.withColumn("DAY", F.col("DAY").cast("date"))


@query("conv_date_roll", """
SELECT p_partkey + 1 AS _line_no, DATE '2024-02-01' + p_size AS AHEAD, DATE '2024-02-01' - p_size AS BACK,
  'ok' AS _status FROM part""")
def conv_date_roll(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.delimited_rows(table(spark, sf_dir, "part"), "|", "p_partkey", "p_size")
    out = typed(lines, delimited([
        Field("AHEAD", 1, convert="date_roll", args={"direction": "FORWARD"}),
        Field("BACK", 1, convert="date_roll", args={"direction": "BACKWARD"}),
    ]))
    return out.withColumns({c: F.col(c).cast("date") for c in ("AHEAD", "BACK")})


@query("conv_time", """
SELECT event_id + 1 AS _line_no,
  CASE WHEN strftime(ts, '%H%M%S') = '000000' THEN NULL ELSE strftime(ts, '%H:%M:%S') END AS AT, 'ok' AS _status
FROM events""")
def conv_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "events").select(
        (F.col("event_id") + 1).alias("_line_no"), F.date_format("ts", "HHmmss").alias("value")
    )
    return typed(lines, delimited([Field("AT", 1, convert="time")]))


@query("conv_yn", """
SELECT c_custkey + 1 AS _line_no, c_mktsegment IN ('BUILDING', 'HOUSEHOLD') AS YES, c_mktsegment = 'MACHINERY' AS NO,
  'ok' AS _status FROM customer""")
def conv_yn(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.delimited_rows(fx.customer_texts(spark, sf_dir), "|", "c_custkey", "flag", "c_custkey")
    return typed(lines, delimited([
        Field("YES", 1, convert="yn_boolean"), Field("NO", 1, convert="yn_boolean", args={"indicator": "N"}),
    ]))


@query("conv_debit_credit", """
SELECT c_custkey + 1 AS _line_no, CASE WHEN c_acctbal < 0 THEN -1 ELSE 1 END AS SIDE, 'ok' AS _status FROM customer""")
def conv_debit_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.delimited_rows(fx.customer_texts(spark, sf_dir), "|", "c_custkey", "side")
    return typed(lines, delimited([Field("SIDE", 1, convert="debit_credit")]))


@query("conv_running_number", """
SELECT o_orderkey + 1 AS _line_no, o_orderstatus AS STATUS,
  CASE WHEN o_orderstatus IN ('F', 'O') THEN row_number() OVER (
    PARTITION BY o_orderstatus IN ('F', 'O') ORDER BY o_orderkey) END AS SEQ,
  CASE WHEN o_orderstatus IN ('F', 'O') THEN 'ok' ELSE 'filtered' END AS _status FROM orders""")
def conv_running_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = Field("STATUS", 19, 19, filter_values=("F", "O"))
    return typed(fx.order_lines(spark, sf_dir), fx.order_spec(status, Field("SEQ", convert="running_number")))


@query("conv_merge_fields", """
SELECT c_custkey + 1 AS _line_no, c_name AS NAME, c_mktsegment AS SEGMENT,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'Y' WHEN c_mktsegment = 'MACHINERY' THEN 'n'
       WHEN c_mktsegment = 'HOUSEHOLD' THEN 'y' END AS FLAG,
  c_mktsegment || '/' || c_name || '/' || CASE WHEN c_mktsegment = 'BUILDING' THEN 'Y'
    WHEN c_mktsegment = 'MACHINERY' THEN 'n' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'y' ELSE '' END AS LABEL,
  'ok' AS _status FROM customer""")
def conv_merge_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flag may be missing at the end of the line; the delimiter before it stays."""
    lines = fx.delimited_rows(fx.customer_texts(spark, sf_dir), "|", "c_custkey", "c_name", "c_mktsegment", "flag")
    label = Field("LABEL", convert="merge_fields", args={"fields": ("SEGMENT", "NAME", "FLAG"), "delimiter": "/"})
    return typed(lines, delimited([Field("NAME", 1), Field("SEGMENT", 2), Field("FLAG", 3), label]))


# Digits of +60-<9 digits> x<nation>: 60 and the number run together, the nation is a run of its own.
PHONE_SQL = "'60' || lpad(CAST(c_custkey AS VARCHAR), 9, '0')"


@query("conv_phone", f"""
SELECT c_custkey + 1 AS _line_no, substring({PHONE_SQL}, 3) AS PHONE, {PHONE_SQL} AS WHOLE, CAST(NULL AS VARCHAR) AS NONE,
  'ok' AS _status FROM customer""")
def conv_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = fx.customer_texts(spark, sf_dir)
    return typed(fx.delimited_rows(texts, "|", "c_custkey", "phone"), delimited([
        Field("PHONE", 1, convert="phone", args={"strip": ("65", "60")}), Field("WHOLE", 1, convert="phone"),
        Field("NONE", convert="phone", default="none"),
    ]))


@query("conv_phone_prefix", f"""
SELECT c_custkey + 1 AS _line_no, '+' || substring({PHONE_SQL}, 3) AS PHONE, 'ok' AS _status FROM customer""")
def conv_phone_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = fx.customer_texts(spark, sf_dir)
    return typed(fx.delimited_rows(texts, "|", "c_custkey", "phone"), delimited([
        Field("PHONE", 1, convert="phone_prefix", args={"prefix": "+", "strip": ("60",)}),
    ]))


@query("phone_in_prose", r"""
SELECT conv_id, turn, list_extract(list_filter(r, lambda x: length(x) = list_max(list_transform(r, lambda y: length(y)))), 1) AS PHONE
FROM (SELECT conv_id, turn, regexp_extract_all(regexp_replace(text, '[^a-zA-Z_0-9]', '', 'g'), '[0-9]+') AS r
      FROM conversations)""")
def phone_in_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest number in each conversation turn."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", F.nullif(longest_digits(F.col("text")), F.lit("")).alias("PHONE"))


@query("external_columns", f"""
WITH {fx.ORDER_SQL}
SELECT _line_no, o_orderkey AS ORDER_ID, order_day AS ORDER_DATE FROM texts WHERE NOT bad_id AND o_orderstatus = 'F'
  AND date_text <> '00000000'
UNION ALL
SELECT _line_no, o_orderkey, NULL FROM texts WHERE NOT bad_id AND o_orderstatus = 'F' AND date_text = '00000000'""")
def external_columns_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status only filters; it is not written."""
    status = Field("STATUS", 19, 19, filter_values=("F",), external=True)
    spec = fx.order_spec(fx.ORDER_ID, status, fx.ORDER_DATE)
    return external_columns(loaded(route(fx.order_lines(spark, sf_dir), spec), spec), spec)


register_conversion(
    "reversed_text", lambda text, ctx, upper=False: F.reverse(F.upper(trim_text(text)) if upper else trim_text(text)),
    lambda value, width, default, ctx, upper=False: F.reverse(value),
)


@query("custom_conversion", f"""
WITH {fx.ORDER_SQL}
SELECT _line_no, reverse(upper(o_orderpriority)) AS PRIORITY, 'ok' AS _status FROM texts""")
def custom_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed(fx.order_lines(spark, sf_dir), fx.order_spec(
        Field("PRIORITY", 42, 56, convert="reversed_text", args={"upper": True})
    ))
