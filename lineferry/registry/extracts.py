"""Queries over rendering and extract layouts."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineferry.plans.extract import extract_lines, extract_summary, fixed_line, render_rows, run_extract, with_header_footer
from lineferry.registry import fixtures as fx
from lineferry.registry.base import query, table
from lineferry.session import shared_folder
from lineferry.sources.lines import read_lines, with_line_no
from lineferry.spec import DELIMITED, FIXED, KEY_VALUE, XML, ExtractSpec, Field, Lookup

RUN = dt.datetime(2024, 2, 1, 12, 0, 0)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their money as decimals, negative for status P, and a day missing for some."""
    o = table(spark, sf_dir, "orders")
    amount = (fx.cents("o_totalprice").cast("decimal(19,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(18,2)")
    gone = (F.col("o_orderpriority") == "3-MEDIUM") & (F.col("o_orderstatus") == "O")
    return o.select(
        (F.col("o_orderkey") + 1).alias("_line_no"), F.col("o_orderkey").alias("ORDER_ID"), F.col("o_custkey").alias("CUST_ID"),
        F.col("o_orderstatus").alias("STATUS"), F.when(F.col("o_orderstatus") == "P", -amount).otherwise(amount).alias("AMOUNT"),
        F.when(~gone, F.col("o_orderdate").cast("date")).alias("ORDER_DATE"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("PRIORITY"),
    )


ORDERS_SQL = """
o AS (
  SELECT o_orderkey + 1 AS _line_no, o_orderkey, o_custkey, o_orderstatus,
    CASE WHEN o_orderstatus = 'P' THEN -1 ELSE 1 END * CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
    CASE WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'O' THEN NULL ELSE o_orderdate END AS day,
    CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS priority
  FROM orders
)"""


def rendered(rows: DataFrame, fields: list[Field], kind: str = FIXED, line: str = "_line_no") -> DataFrame:
    return render_rows(rows, ExtractSpec("T", fields, kind=kind, run_ts=RUN), line).drop("_reason")


@query("render_text", f"""
WITH {ORDERS_SQL}
SELECT _line_no, rpad(o_orderstatus, 3, ' ') AS STATUS, coalesce(rpad(priority, 16, ' '), 'LOW') AS PRIORITY,
  rpad(coalesce(priority, ''), 16, ' ') AS PLAIN, 'ok' AS _status FROM o""")
def render_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).withColumn("PLAIN", F.col("PRIORITY"))
    return rendered(rows, [
        Field("STATUS", 1, 3), Field("PRIORITY", 4, 19, convert="string", default="LOW"), Field("PLAIN", 20, 35),
    ])


@query("render_line_break", """
SELECT conv_id * 1000 + turn AS _line_no,
  coalesce(nullif(trim(replace(replace(text, chr(10), ' '), chr(13), ''), ' ' || chr(9)), ''), NULL) AS BODY, 'ok' AS _status
FROM conversations""")
def render_line_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole turns of any length on one line, so without a width."""
    rows = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("_line_no"), F.col("text").alias("BODY")
    )
    return rendered(rows, [Field("BODY", 1, convert="line_break_trim")], DELIMITED)


@query("render_left_pad", """
SELECT c_custkey AS _line_no, lpad(c_name, 24, '*') AS NAME, lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS NUMBER,
  '0000' AS NOTHING, c_name AS BARE, 'ok' AS _status FROM customer""")
def render_left_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("_line_no"), F.col("c_name").alias("NAME"), F.col("c_custkey").cast("string").alias("NUMBER"),
        F.lit(None).cast("string").alias("NOTHING"), F.col("c_name").alias("BARE"),
    )
    return rendered(rows, [
        Field("NAME", 1, 24, convert="left_trim", args={"char": "*"}), Field("NUMBER", 25, 33, convert="left_trim"),
        Field("NOTHING", 34, 37, convert="left_trim"), Field("BARE", convert="left_trim"),
    ])


@query("render_integer", """
SELECT c_custkey AS _line_no, CASE WHEN cents < 0 THEN '-' ELSE '+' END || lpad(CAST(abs(cents) AS VARCHAR), 9, '0') AS CENTS,
  ' ' || lpad(CAST(c_nationkey AS VARCHAR), 4, '0') AS NATION, ' 0000' AS NOTHING, CAST(cents AS VARCHAR) AS BARE,
  'ok' AS _status
FROM (SELECT *, CAST(round(c_acctbal * 100) AS BIGINT) AS cents FROM customer)""")
def render_integer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("_line_no"), fx.cents("c_acctbal").alias("CENTS"), F.col("c_nationkey").alias("NATION"),
        F.lit(None).cast("int").alias("NOTHING"), fx.cents("c_acctbal").alias("BARE"),
    )
    return rendered(rows, [
        Field("CENTS", 1, 10, convert="long", args={"positive_sign": "+"}), Field("NATION", 11, 15, convert="integer"),
        Field("NOTHING", 16, 20, convert="integer", args={"positive_sign": "space"}), Field("BARE", convert="long"),
    ])


@query("render_currency", f"""
WITH {ORDERS_SQL}
SELECT _line_no, CASE WHEN cents < 0 THEN '-' ELSE '+' END || lpad(CAST(abs(cents) AS VARCHAR), 13, '0') AS AMOUNT,
  CASE WHEN cents < 0 THEN '-' ELSE ' ' END || lpad(CAST(abs(cents) || '0' AS VARCHAR), 14, '0') AS MILLS, 'ok' AS _status
FROM o""")
def render_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).withColumn("MILLS", F.col("AMOUNT"))
    return rendered(rows, [
        Field("AMOUNT", 1, 14, convert="currency", args={"positive_sign": "+"}),
        Field("MILLS", 15, 29, convert="currency", args={"decimals": 3}),
    ])


@query("render_date", f"""
WITH {ORDERS_SQL}
SELECT _line_no, coalesce(strftime(day, '%Y%m%d'), '00000000') AS ORDER_DATE,
  coalesce(rpad(strftime(day, '%d/%m/%Y'), 12, ' '), rpad('', 12, ' ')) AS SHOWN,
  coalesce(strftime(day, '%y%m'), '    ') AS MONTH, coalesce(strftime(day, '%Y%j'), '0000000') AS JULIAN,
  coalesce(strftime(day, '%Y%m%d'), 'NONE') AS BARE, 'ok' AS _status FROM o""")
def render_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("ORDER_DATE")
    rows = _orders(spark, sf_dir).withColumns({"SHOWN": day, "MONTH": day, "JULIAN": day, "BARE": day})
    return rendered(rows, [
        Field("ORDER_DATE", 1, 8, convert="date"), Field("SHOWN", 9, 20, convert="timestamp", args={"pattern": "dd/MM/yyyy"}),
        Field("MONTH", 21, 24, convert="short_date", args={"pattern": "yyMM"}), Field("JULIAN", 25, 31, convert="julian_date"),
        Field("BARE", convert="date", default="NONE"),
    ])


@query("render_time", """
SELECT event_id AS _line_no, CASE WHEN event_type = 'error' THEN '000000' ELSE strftime(ts, '%H%M%S') END AS AT,
  strftime(ts, '%H.%M') AS SHOWN, 'ok' AS _status FROM events""")
def render_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("ts")
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("_line_no"), F.when(F.col("event_type") != "error", at).alias("AT"), at.alias("SHOWN")
    )
    return rendered(rows, [
        Field("AT", 1, 6, convert="time"), Field("SHOWN", 7, 11, convert="time", args={"pattern": "HH.mm"}),
    ])


@query("render_date_roll", f"""
WITH {ORDERS_SQL},
d AS (SELECT *, date_diff('day', DATE '2024-02-01', CAST(day AS DATE)) AS n FROM o)
SELECT _line_no, CASE WHEN n IS NULL THEN '000000' ELSE '-' || lpad(CAST(-n AS VARCHAR), 5, '0') END AS AHEAD,
  CAST(-n AS VARCHAR) AS BACK, 'ok' AS _status FROM d""")
def render_date_roll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days from the run date; every order lies before it."""
    day = F.col("ORDER_DATE")
    rows = _orders(spark, sf_dir).withColumns({"AHEAD": day, "BACK": day})
    return rendered(rows, [
        Field("AHEAD", 1, 6, convert="date_roll", args={"direction": "FORWARD"}),
        Field("BACK", convert="date_roll", args={"direction": "BACKWARD"}),
    ])


@query("render_flags", """
SELECT c_custkey AS _line_no, CASE WHEN c_mktsegment = 'BUILDING' THEN 'J' ELSE 'N' END AS YES,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN '   ' WHEN c_acctbal < 0 THEN 'D  ' ELSE 'C  ' END AS SIDE,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL WHEN c_acctbal < 0 THEN 'D' ELSE 'C' END AS BARE, 'ok' AS _status
FROM customer""")
def render_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("c_mktsegment") != "MACHINERY", F.when(F.col("c_acctbal") < 0, -1).otherwise(1))
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("_line_no"), (F.col("c_mktsegment") == "BUILDING").alias("YES"), side.alias("SIDE"),
        side.alias("BARE"),
    )
    return rendered(rows, [
        Field("YES", 1, 1, convert="yn_boolean", args={"indicator": "J"}), Field("SIDE", 2, 4, convert="debit_credit"),
        Field("BARE", convert="debit_credit"),
    ])


@query("render_running_number", """
SELECT o_orderkey AS _line_no, lpad(CAST(n AS VARCHAR), 9, '0') AS SEQ, lpad(CAST(n AS VARCHAR), 12, '0') AS LONGER,
  CAST(n AS VARCHAR) AS BARE, 'ok' AS _status
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders)""")
def render_running_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_line_no"))
    return rendered(rows, [
        Field("SEQ", 1, 9, convert="running_number"), Field("LONGER", convert="running_number", args={"length": 12}),
        Field("BARE", convert="running_number"),
    ])


@query("render_merge", f"""
WITH {ORDERS_SQL}
SELECT _line_no, rpad(o_orderstatus, 2, ' ') AS STATUS, priority AS PRIORITY,
  rpad(rpad(o_orderstatus, 2, ' ') || '+' || coalesce(priority || '+', '') || coalesce(strftime(day, '%Y%m%d'), ''), 30, ' ') AS LABEL,
  strftime(day, '%Y%m%d') AS ORDER_DATE, 'ok' AS _status FROM o""")
def render_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged from rendered texts: the padded status, a priority and a day that may be missing."""
    return rendered(_orders(spark, sf_dir), [
        Field("LABEL", 3, 32, convert="merge_fields", args={"fields": ("STATUS", "PRIORITY", "ORDER_DATE"), "delimiter": "+"}),
        Field("STATUS", 1, 2), Field("PRIORITY", convert="text", external=True),
        Field("ORDER_DATE", convert="date", external=True),
    ])


@query("render_phone", """
SELECT c_custkey AS _line_no, lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS PHONE,
  '+660' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS PREFIXED, '999' AS NOTHING, 'ok' AS _status FROM customer""")
def render_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    phone = F.concat(F.lit("+60-"), fx.digits("c_custkey", 9), F.lit(" x"), F.col("c_nationkey").cast("string"))
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("_line_no"), phone.alias("PHONE"), phone.alias("PREFIXED"), F.lit(None).cast("string").alias("NOTHING")
    )
    return rendered(rows, [
        Field("PHONE", 1, 15, convert="phone", args={"strip": ("60",)}),
        Field("PREFIXED", 16, 30, convert="phone_prefix", args={"prefix": "+6"}),
        Field("NOTHING", 31, 37, convert="phone", default="999"),
    ])


def _layout(spark: SparkSession, sf_dir: str, kind: str, **more) -> tuple[DataFrame, ExtractSpec]:
    spec = ExtractSpec("orders", [
        Field("STATUS", 12, 12), Field("ORDER_ID", 1, 10, convert="long"), Field("PRIORITY", 14, 28),
        Field("ORDER_DATE", 29, 36, convert="date"), Field("CUST_ID", 38, 49, convert="long", external=True),
    ], kind=kind, run_ts=RUN, **more)
    return _orders(spark, sf_dir), spec


@query("extract_fixed", f"""
WITH {ORDERS_SQL}
SELECT _line_no, ' ' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') || ' ' || o_orderstatus || ' ' || rpad(coalesce(priority, ''), 15, ' ')
  || coalesce(strftime(day, '%Y%m%d'), '00000000') || '             ' AS value FROM o""")
def extract_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps stay blank, an external field only makes the record longer."""
    rows, spec = _layout(spark, sf_dir, FIXED)
    return extract_lines(rows, spec, "_line_no")


@query("extract_overflow", f"""
WITH {ORDERS_SQL},
t AS (SELECT *, abs(cents) AS c, coalesce(priority, '') AS p FROM o),
w AS (SELECT _line_no, CASE WHEN length(p) > 8 THEN 'PRIORITY: does not fit' WHEN length(CAST(c AS VARCHAR)) > 7 THEN 'AMOUNT: does not fit' END AS _reason,
  rpad(p, 8, ' ') || CASE WHEN cents < 0 THEN '-' ELSE ' ' END || lpad(CAST(c AS VARCHAR), 7, '0') AS value FROM t)
SELECT _line_no, CASE WHEN _reason IS NULL THEN 'ok' ELSE 'unknown' END AS _status, _reason,
  CASE WHEN _reason IS NULL THEN value END AS value FROM w""")
def extract_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities and amounts too wide for their fields: nothing is cut, such rows are not written."""
    spec = ExtractSpec("orders", [Field("PRIORITY", 1, 8), Field("AMOUNT", 9, 16, convert="currency")], run_ts=RUN)
    rows = _orders(spark, sf_dir)
    return render_rows(rows, spec, "_line_no").select(
        "_line_no", "_status", "_reason", F.when(F.col("_status") == "ok", fixed_line(spec)).alias("value")
    )


def _delimited_spec(kind: str) -> ExtractSpec:
    return ExtractSpec("orders", [
        Field("STATUS", 3), Field("ORDER_ID", 1, convert="long"), Field("PRIORITY", 4), Field("AMOUNT", 7, convert="currency"),
        Field("ORDER_DATE", 6, convert="date"), Field("CUST_ID", 5, convert="long", external=True),
    ], kind=kind, delimiter=";", run_ts=RUN)


AMOUNT_TEXT = "CAST(CAST(cents * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2)) AS VARCHAR)"


@query("extract_delimited", f"""
WITH {ORDERS_SQL}
SELECT _line_no, o_orderkey || ';;' || o_orderstatus || ';' || coalesce(priority, '') || ';;' || coalesce(strftime(day, '%Y%m%d'), '')
  || ';' || {AMOUNT_TEXT} AS value FROM o""")
def extract_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_lines(_orders(spark, sf_dir), _delimited_spec(DELIMITED), "_line_no")


@query("extract_key_value", f"""
WITH {ORDERS_SQL}
SELECT _line_no, 'order_id=' || o_orderkey || ';;status=' || o_orderstatus || ';priority=' || coalesce(priority, '')
  || ';;order_date=' || coalesce(strftime(day, '%Y%m%d'), '') || ';amount=' || {AMOUNT_TEXT} AS value FROM o""")
def extract_key_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_lines(_orders(spark, sf_dir), _delimited_spec(KEY_VALUE), "_line_no")


@query("extract_xml", """
SELECT doc_id AS _line_no, chr(9) || '<doc><a_lang>' || lang || '</a_lang><body>'
  || replace(replace(text, '&', '&amp;'), '<', '&lt;') || '</body><nothing></nothing></doc>' AS value FROM documents""")
def extract_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("_line_no"), F.col("text").alias("BODY"), F.col("lang").alias("LANG"),
        F.lit(None).cast("string").alias("NOTHING"),
    )
    spec = ExtractSpec("docs", [
        Field("BODY", tag="body"), Field("LANG", tag="a_lang"), Field("NOTHING", tag="nothing"),
    ], kind=XML, record_tag="doc", root_tag="docs")
    return extract_lines(rows, spec, "_line_no")


@query("extract_lookup", """
SELECT o_orderkey + 1 AS _line_no, c_name AS NAME, n_name AS NATION, CAST(o_orderkey AS VARCHAR) AS ORDER_ID,
  CASE WHEN c_name IS NULL THEN 'integrity' ELSE 'ok' END AS _status
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) ON o_custkey = c_custkey
LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON c_nationkey = n_nationkey""")
def extract_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer that must exist, and its nation, which may not."""
    customers = fx.known_customers(spark, sf_dir)
    nations = table(spark, sf_dir, "nation").filter(F.col("n_regionkey") != 2)
    spec = ExtractSpec("orders", [
        Field("ORDER_ID", 1, convert="long"), Field("NAME", 2, lookup=Lookup(customers, {"CUST_ID": "c_custkey"}, "c_name")),
        Field("CUST_ID", external=True, convert="long"),
        Field("NATION_ID", external=True, convert="integer", lookup=Lookup(customers, {"CUST_ID": "c_custkey"}, "c_nationkey")),
        Field("NATION", 3, lookup=Lookup(nations, {"NATION_ID": "n_nationkey"}, "n_name", optional=True)),
    ], kind=DELIMITED)
    return render_rows(_orders(spark, sf_dir), spec, "_line_no").drop("CUST_ID", "NATION_ID", "_reason")


@query("extract_summary", """
SELECT count(*) AS records, count(*) FILTER (known AND o_orderstatus <> 'P' AND NOT bad) AS written,
  count(*) FILTER (known AND o_orderstatus = 'P') AS filtered, count(*) FILTER (NOT known) AS integrity,
  count(*) FILTER (known AND o_orderstatus <> 'P' AND bad) AS unknown
FROM (SELECT *, o_orderpriority = '2-HIGH' AS bad, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) AS known FROM orders)""")
def extract_summary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Among the rows are numbers given as text that is none."""
    spec = ExtractSpec("orders", [
        Field("CUST_ID", convert="long"), Field("STATUS", 2, filter_values=("F", "O")), Field("CODE", 4, convert="integer"),
        Field("NAME", 3, lookup=Lookup(fx.known_customers(spark, sf_dir), {"CUST_ID": "c_custkey"}, "c_name")),
    ], kind=DELIMITED)
    code = F.when(F.col("PRIORITY") == "2-HIGH", F.col("PRIORITY")).otherwise(F.lit("7"))
    return extract_summary(render_rows(_orders(spark, sf_dir).withColumn("CODE", code), spec))


@query("extract_header_footer", f"""
WITH {ORDERS_SQL}
SELECT 1 AS _part, _line_no, ' ' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') || ' ' || o_orderstatus || ' '
  || rpad(coalesce(priority, ''), 15, ' ') || coalesce(strftime(day, '%Y%m%d'), '00000000') || '             ' AS value FROM o
UNION ALL SELECT 0, NULL, 'H orders 2024-02-01 12:00:00 orders.def'
UNION ALL SELECT 2, NULL, 'T ' || count(*) FROM o""")
def extract_header_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, spec = _layout(
        spark, sf_dir, FIXED, header="H {name} {start} {definition}", footer="T {count}", definition="orders.def"
    )
    return with_header_footer(extract_lines(rows, spec, "_line_no"), spec)


@query("extract_files", f"""
WITH {ORDERS_SQL},
body AS (
  SELECT _line_no, ' ' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') || ' ' || o_orderstatus || ' '
    || rpad(coalesce(priority, ''), 15, ' ') || coalesce(strftime(day, '%Y%m%d'), '00000000') || '             ' AS value FROM o),
file AS (
  SELECT 1 AS part, _line_no AS spot, value FROM body UNION ALL SELECT 0, 0, 'H orders 2024-02-01 12:00:00 orders.def'
  UNION ALL SELECT 2, 0, 'T ' || count(*) FROM o)
SELECT row_number() OVER (ORDER BY part, spot) AS _line_no, value, (SELECT count(*) FROM o) AS written FROM file""")
def extract_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extract as files, written and counted in one pass over the orders, and read back in file order."""
    rows, spec = _layout(
        spark, sf_dir, FIXED, header="H {name} {start} {definition}", footer="T {count}", definition="orders.def"
    )
    path = f"{shared_folder(spark)}/extract-{uuid.uuid4().hex}"
    counts = run_extract(rows, spec, path)
    lines = with_line_no(read_lines(spark, [f"{path}/{p}" for p in ("0-header", "1-body", "2-footer")]))
    return lines.withColumn("written", F.lit(counts["written"]))
