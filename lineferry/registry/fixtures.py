"""Hand-off lines composed from the tables, in Spark and in SQL.

Every row of a table becomes one line. Odd cases (bad numbers, zero dates, signs, missing
dimension rows) follow from the row's own values, so both sides agree on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineferry.registry.base import table
from lineferry.spec import Field, LoadSpec, Lookup

# --- orders, fixed width --------------------------------------------------------------------------

ORDER_KEYS = [(1, 10)]
ORDER_HEADER, ORDER_TRAILER = "HDR", "TRL"

# Texts of one order; the columns of the SQL relation ``texts`` below.
ORDER_SQL = """
texts AS (
  SELECT *, id_text || cust_text || status_text || amount_text || date_text || priority_text AS value
  FROM (
    SELECT o_orderkey + 1 AS _line_no, o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_totalprice,
      CAST(o_orderdate AS DATE) AS order_day,
      CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
      o_totalprice < 5000 AS bad_id,
      CASE WHEN o_totalprice < 5000 THEN 'X' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0')
           ELSE lpad(CAST(o_orderkey AS VARCHAR), 10, '0') END AS id_text,
      lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS cust_text,
      o_orderstatus AS status_text,
      CASE WHEN o_orderstatus = 'P' THEN lpad(CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR), 13, '0') || '-'
           ELSE lpad(CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR), 14, '0') END AS amount_text,
      CASE WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'O' THEN '00000000'
           ELSE strftime(o_orderdate, '%Y%m%d') END AS date_text,
      rpad(o_orderpriority, 15, ' ') AS priority_text
    FROM orders
  )
)"""

# What the fields of an order line come out as.
ORDER_ID_SQL = "CASE WHEN bad_id THEN NULL ELSE o_orderkey END"
AMOUNT_SQL = """CAST((CASE WHEN o_orderstatus = 'P' THEN -cents ELSE cents END)
      * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2))"""
ORDER_DATE_SQL = "CASE WHEN date_text = '00000000' THEN NULL ELSE order_day END"
PRIORITY_SQL = "CASE WHEN o_orderpriority = '5-LOW' THEN 'LOW' ELSE o_orderpriority END"


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("bigint")


def digits(c: Column | str, width: int) -> Column:
    return F.lpad((F.col(c) if isinstance(c, str) else c).cast("string"), width, "0")


def order_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the text of every field and the composed line ``value``."""
    orders = table(spark, sf_dir, "orders")
    amount = cents("o_totalprice")
    texts = orders.select(
        (F.col("o_orderkey") + 1).alias("_line_no"), "*",
        F.when(F.col("o_totalprice") < 5000, F.concat(F.lit("X"), digits("o_orderkey", 9)))
        .otherwise(digits("o_orderkey", 10)).alias("id_text"),
        digits("o_custkey", 8).alias("cust_text"),
        F.when(F.col("o_orderstatus") == "P", F.concat(digits(amount, 13), F.lit("-")))
        .otherwise(digits(amount, 14)).alias("amount_text"),
        F.when((F.col("o_orderpriority") == "3-MEDIUM") & (F.col("o_orderstatus") == "O"), F.lit("00000000"))
        .otherwise(F.date_format("o_orderdate", "yyyyMMdd")).alias("date_text"),
        F.rpad("o_orderpriority", 15, " ").alias("priority_text"),
    )
    return texts.withColumn(
        "value", F.concat("id_text", "cust_text", "o_orderstatus", "amount_text", "date_text", "priority_text")
    )


def as_file(rows: DataFrame, line_no: Column | str, value: Column | str) -> DataFrame:
    """Rows as the lines of a file.

    A file's line is a column that is there, where this one is composed. It comes out of a
    one-element generator so that it is composed once, not again in every place that reads it.
    """
    pick = [F.col(c) if isinstance(c, str) else c for c in (line_no, value)]
    line = F.struct(pick[0].alias("_line_no"), pick[1].alias("value"))
    return rows.select(F.inline(F.array(line)))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_file(order_texts(spark, sf_dir), "_line_no", "value")


def order_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines between a header with the latest day and a trailer with the record count."""
    orders = table(spark, sf_dir, "orders")
    ends = orders.agg(F.max("o_orderdate").alias("day"), F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("top"))
    header = ends.select(
        F.lit(0).cast("bigint").alias("_line_no"),
        F.concat(F.lit(ORDER_HEADER), F.date_format("day", "yyyyMMdd")).alias("value"),
    )
    trailer = ends.select(
        (F.col("top") + 2).alias("_line_no"), F.concat(F.lit(ORDER_TRAILER), digits("n", 10)).alias("value")
    )
    return order_lines(spark, sf_dir).unionByName(header).unionByName(trailer)


ORDER_FILE_SQL = ORDER_SQL + """,
file AS (
  SELECT _line_no, value FROM texts
  UNION ALL SELECT 0, 'HDR' || strftime(max(o_orderdate), '%Y%m%d') FROM orders
  UNION ALL SELECT max(o_orderkey) + 2, 'TRL' || lpad(CAST(count(*) AS VARCHAR), 10, '0') FROM orders
)"""


def known_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in credit: the dimension that order lines can miss."""
    return table(spark, sf_dir, "customer").filter(F.col("c_acctbal") >= 0)


ORDER_ID = Field("ORDER_ID", 1, 10, key=True, optional=False, convert="long")
CUST_TEXT = Field("CUST_ID", 11, 18, convert="text")
STATUS = Field("STATUS", 19, 19)
AMOUNT = Field("AMOUNT", 20, 33, convert="currency")
ORDER_DATE = Field("ORDER_DATE", 34, 41, convert="date")
PRIORITY = Field("PRIORITY", 42, 56, nulls=("5-LOW",), default="LOW")
SOURCE = Field("SOURCE", default="HOST", size=4)


def order_spec(*fields: Field, **changes) -> LoadSpec:
    """The order load; without fields all of them, none looked up."""
    chosen = fields or (ORDER_ID, CUST_TEXT, STATUS, AMOUNT, ORDER_DATE, PRIORITY, SOURCE)
    return LoadSpec(
        **{"table": "ORDERS", "fields": chosen, "headers": (ORDER_HEADER,), "trailers": (ORDER_TRAILER,), **changes}
    )


def customer_lookup(spark: SparkSession, sf_dir: str, **changes) -> Lookup:
    return Lookup(
        **{"dim": known_customers(spark, sf_dir), "on": {"CUST_ID": "c_custkey"}, "value": "c_custkey", **changes}
    )


def full_order_spec(spark: SparkSession, sf_dir: str, **changes) -> LoadSpec:
    """Marks, a value filter, a mandatory customer lookup, all conversions."""
    cust = Field("CUST_ID", 11, 18, lookup=customer_lookup(spark, sf_dir))
    status = Field("STATUS", 19, 19, filter_values=("F", "O"))
    return order_spec(ORDER_ID, cust, status, AMOUNT, ORDER_DATE, PRIORITY, SOURCE, **changes)


# The status each order line gets from that spec, in the order the checks apply.
ROUTED_SQL = ORDER_SQL + """,
routed AS (
  SELECT t.*,
    CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'filtered'
         WHEN bad_id THEN 'unknown'
         WHEN c.c_custkey IS NULL THEN 'integrity'
         ELSE 'ok' END AS _status
  FROM texts t LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) c ON t.o_custkey = c.c_custkey
)"""

# --- orders, delimited ----------------------------------------------------------------------------


def order_delimited(spark: SparkSession, sf_dir: str, delimiter: str = "|") -> DataFrame:
    """key|customer|status|cents|day|priority, the last empty for medium priority."""
    orders = table(spark, sf_dir, "orders")
    parts = [
        F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.col("o_orderstatus"),
        cents("o_totalprice").cast("string"), F.date_format("o_orderdate", "yyyyMMdd"),
        F.when(F.col("o_orderpriority") == "3-MEDIUM", F.lit("")).otherwise(F.col("o_orderpriority")),
    ]
    return as_file(orders, F.col("o_orderkey") + 1, F.concat_ws(delimiter, *parts))


# --- the day before, and the target ---------------------------------------------------------------

# Known the day before: orders up to the last day but a year of the data.
BEFORE_DAY = "2000-08-01"

PREVIOUS_SQL = ORDER_SQL + f""",
previous AS (
  SELECT _line_no, o_orderkey,
    id_text || cust_text || CASE WHEN o_orderpriority = '1-URGENT' THEN 'Z' ELSE status_text END
      || amount_text || date_text || priority_text AS value
  FROM texts WHERE order_day < DATE '{BEFORE_DAY}'
  UNION ALL
  SELECT _line_no + 900000000, o_orderkey + 900000000,
    lpad(CAST(o_orderkey + 900000000 AS VARCHAR), 10, '0') || cust_text || status_text
      || amount_text || date_text || priority_text
  FROM texts WHERE o_orderpriority = '2-HIGH'
)"""


def previous_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file of the day before: no recent orders, urgent ones with another status, and high
    priority ones under old numbers that are gone today."""
    texts = order_texts(spark, sf_dir)
    rest = ["amount_text", "date_text", "priority_text"]
    status = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("Z")).otherwise(F.col("o_orderstatus"))
    kept = texts.filter(F.col("o_orderdate") < F.lit(BEFORE_DAY).cast("timestamp_ntz")).select(
        "_line_no", F.concat(F.col("id_text"), F.col("cust_text"), status, *[F.col(c) for c in rest]).alias("value")
    )
    old = texts.filter(F.col("o_orderpriority") == "2-HIGH").select(
        (F.col("_line_no") + 900000000).alias("_line_no"),
        F.concat(digits(F.col("o_orderkey") + 900000000, 10), "cust_text", "o_orderstatus", *rest).alias("value"),
    )
    return as_file(kept.unionByName(old), "_line_no", "value")


def merge_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders already in the target: those before the cut-off day, with old values."""
    orders = table(spark, sf_dir, "orders").filter(F.col("o_orderdate") < F.lit(BEFORE_DAY).cast("timestamp_ntz"))
    return orders.select(
        F.col("o_orderkey").alias("ORDER_ID"), F.col("o_custkey").alias("CUST_ID"), F.lit("?").alias("STATUS"),
        F.lit(0).cast("decimal(18,2)").alias("AMOUNT"), F.col("o_orderdate").cast("date").alias("ORDER_DATE"),
    )


def merge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good rows to merge: every order once, urgent ones again with status U and a later line."""
    orders = table(spark, sf_dir, "orders")
    rows = orders.select(
        (F.col("o_orderkey") + 1).alias("_line_no"), F.col("o_orderkey").alias("ORDER_ID"),
        F.col("o_custkey").alias("CUST_ID"), F.col("o_orderstatus").alias("STATUS"),
        (cents("o_totalprice").cast("decimal(19,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(18,2)").alias("AMOUNT"),
        F.col("o_orderdate").cast("date").alias("ORDER_DATE"), "o_orderpriority",
    )
    again = rows.filter(F.col("o_orderpriority") == "1-URGENT").withColumns(
        {"_line_no": F.col("_line_no") + 1000000000, "STATUS": F.lit("U"), "ORDER_DATE": F.lit(None).cast("date")}
    )
    return rows.unionByName(again).drop("o_orderpriority")


MERGE_SQL = f"""
target AS (
  SELECT o_orderkey AS ORDER_ID, o_custkey AS CUST_ID, '?' AS STATUS, CAST(0 AS DECIMAL(18,2)) AS AMOUNT,
    CAST(o_orderdate AS DATE) AS ORDER_DATE
  FROM orders WHERE o_orderdate < TIMESTAMP '{BEFORE_DAY}'
),
load AS (
  SELECT o_orderkey + 1 AS _line_no, o_orderkey AS ORDER_ID, o_custkey AS CUST_ID, o_orderstatus AS STATUS,
    CAST(CAST(round(o_totalprice * 100) AS BIGINT) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2)) AS AMOUNT,
    CAST(o_orderdate AS DATE) AS ORDER_DATE, o_orderpriority
  FROM orders
),
lines AS (
  SELECT _line_no, ORDER_ID, CUST_ID, STATUS, AMOUNT, ORDER_DATE FROM load
  UNION ALL
  SELECT _line_no + 1000000000, ORDER_ID, CUST_ID, 'U', AMOUNT, NULL FROM load WHERE o_orderpriority = '1-URGENT'
),
lastline AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY ORDER_ID ORDER BY _line_no DESC) AS rn FROM lines)
  WHERE rn = 1
)"""

ORDER_COLUMNS = ["ORDER_ID", "CUST_ID", "STATUS", "AMOUNT", "ORDER_DATE"]

# --- lineitem as keyed text -----------------------------------------------------------------------


def lineitem_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order key and line number as text. Files number their lines; the table has no number of its
    own, so a hash of the row stands in where one is needed."""
    items = table(spark, sf_dir, "lineitem")
    return as_file(items, F.xxhash64(*items.columns), F.concat(digits("l_orderkey", 10), digits("l_linenumber", 2)))


def customer_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with signed cents, phone-like text and flags."""
    c = table(spark, sf_dir, "customer")
    whole = F.abs(cents("c_acctbal")).cast("string")
    return c.select(
        "*", cents("c_acctbal").alias("cents"),
        F.when(F.col("c_acctbal") < 0, F.concat(whole, F.lit("-"))).otherwise(F.concat(F.lit("+"), whole)).alias("signed"),
        F.concat(F.lit("+60-"), digits("c_custkey", 9), F.lit(" x"), F.col("c_nationkey").cast("string")).alias("phone"),
        F.when(F.col("c_mktsegment") == "BUILDING", "Y").when(F.col("c_mktsegment") == "MACHINERY", "n")
        .when(F.col("c_mktsegment") == "HOUSEHOLD", "y").otherwise("").alias("flag"),
        F.when(F.col("c_acctbal") < 0, " c ").otherwise("D").alias("side"),
    )


CUSTOMER_SQL = """
cust AS (
  SELECT *, CAST(round(c_acctbal * 100) AS BIGINT) AS cents FROM customer
)"""


def delimited_rows(texts: DataFrame, delimiter: str, key: str, *cols: str) -> DataFrame:
    """Columns of a table as delimited lines numbered by a whole-number key."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]
    return as_file(texts, F.col(key) + 1, F.concat_ws(delimiter, *parts))
