"""Queries over control totals, duplicates, reconciliation, sorting, deltas and scale-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineferry.operators.checks import duplicate_keys, hash_total, multiply, reconcile, reconcile_summary
from lineferry.operators.delta import delta_classify, delta_lines, delta_numbered, sort_by_key, verify_sorted, with_sort_keys
from lineferry.operators.position import index_by_order
from lineferry.registry import fixtures as fx
from lineferry.registry.base import query, table
from lineferry.spec import Field, LoadSpec

MARKS = {"headers": (fx.ORDER_HEADER,), "trailers": (fx.ORDER_TRAILER,)}


@query("hash_total", f"""
WITH {fx.ORDER_FILE_SQL}
SELECT (SELECT count(*) FROM file) AS records,
  CAST(sum(CASE WHEN NOT bad_id THEN o_orderkey END) AS BIGINT) AS sum_ORDER_ID, count(*) FILTER (bad_id) AS bad_ORDER_ID,
  CAST(sum(o_custkey) AS BIGINT) AS sum_CUST_ID, CAST(0 AS BIGINT) AS bad_CUST_ID
FROM texts""")
def hash_total_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a whole file; header and trailer are too short for the customer, and the header is
    cut off by the length of the order number."""
    body = fx.order_file(spark, sf_dir).withColumn("value", F.rtrim("value"))
    marks = F.col("value").startswith(fx.ORDER_HEADER) | F.col("value").startswith(fx.ORDER_TRAILER)
    short = body.withColumn("value", F.when(marks, F.substring("value", 1, 9)).otherwise(F.col("value")))
    out = hash_total(short, {"ORDER_ID": (1, 10), "CUST_ID": (11, 18)})
    return out.select(*[F.col(c).cast("bigint").alias(c) for c in out.columns])


def _lineitem_spec(*ends: tuple[int, int]) -> LoadSpec:
    fields = [Field(f"K{i}", s, e, key=True) for i, (s, e) in enumerate(ends)]
    return LoadSpec("LINEITEM", fields)


@query("duplicate_keys", """
SELECT lpad(CAST(l_orderkey AS VARCHAR), 10, '0') AS K0, lpad(CAST(l_linenumber AS VARCHAR), 2, '0') AS K1, count(*) AS lines
FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def duplicate_keys_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_keys(fx.lineitem_lines(spark, sf_dir), _lineitem_spec((1, 10), (11, 12))).select("K0", "K1", "lines")


@query("duplicate_customers", f"""
WITH {fx.ORDER_SQL}
SELECT cust_text AS CUST_ID, count(*) AS lines, min(_line_no) AS first_line, max(_line_no) AS last_line
FROM texts GROUP BY cust_text HAVING count(*) > 1""")
def duplicate_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key that is looked up counts by its own text; marks do not count."""
    cust = Field("CUST_ID", 11, 18, key=True, lookup=fx.customer_lookup(spark, sf_dir))
    return duplicate_keys(fx.order_file(spark, sf_dir), fx.order_spec(cust, fx.STATUS))


RECONCILE_SQL = fx.PREVIOUS_SQL + """,
matched AS (
  SELECT t._line_no, t.value, p._line_no AS _other_no, p.value AS _other_line,
    CASE WHEN p.value IS NULL THEN 'not_found' WHEN t.value = p.value THEN 'matched' ELSE 'different' END AS _match
  FROM texts t LEFT JOIN previous p ON substring(t.value, 1, 10) = substring(p.value, 1, 10)
)"""


def _reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Today's lines against the day before's, written in lower case."""
    today = fx.order_lines(spark, sf_dir).withColumn("value", F.lower("value"))
    return reconcile(today, fx.previous_lines(spark, sf_dir), {"ORDER_ID": (1, 10)})


@query("reconcile_detail", f"""
WITH {RECONCILE_SQL} SELECT _line_no, lower(value) AS value, _match, _other_no, _other_line FROM matched""")
def reconcile_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reconciled(spark, sf_dir)


@query("reconcile_summary", f"""
WITH {RECONCILE_SQL}
SELECT count(*) AS lines, count(*) FILTER (_match = 'matched') AS matched, count(*) FILTER (_match = 'different') AS different,
  count(*) FILTER (_match = 'not_found') AS not_found, CAST(0 AS BIGINT) AS too_short,
  count(*) FILTER (_match <> 'not_found') AS found FROM matched""")
def reconcile_summary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile_summary(_reconciled(spark, sf_dir))


# The key of the sort: customer, then status.
SORT_KEYS = [(11, 18), (19, 19)]


@query("sort_by_key", f"""
WITH {fx.ORDER_FILE_SQL}
SELECT row_number() OVER (ORDER BY CASE WHEN value LIKE 'HDR%' THEN 0 WHEN value LIKE 'TRL%' THEN 2 ELSE 1 END,
  substring(value, 11, 9), _line_no) - 1 AS _pos, _line_no, value FROM file""")
def sort_by_key_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sorted file with the position of every line."""
    keyed, names = with_sort_keys(fx.order_file(spark, sf_dir), SORT_KEYS, **MARKS)
    return index_by_order(keyed, *names, "_line_no").drop(*names)


@query("sorted_file", f"WITH {fx.ORDER_FILE_SQL} SELECT _line_no, value FROM file")
def sorted_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sort_by_key(fx.order_file(spark, sf_dir), SORT_KEYS, **MARKS)


@query("sort_distinct", """
SELECT DISTINCT lpad(CAST(l_orderkey AS VARCHAR), 10, '0') || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') AS value
FROM lineitem""")
def sort_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sort_by_key(fx.lineitem_lines(spark, sf_dir).select("value"), [(11, 12), (1, 10)], distinct=True)


@query("sort_skip_header", f"WITH {fx.ORDER_SQL} SELECT _line_no, value FROM texts WHERE _line_no > 3")
def sort_skip_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sort_by_key(fx.order_lines(spark, sf_dir), SORT_KEYS, skip=3)


@query("verify_sorted", f"""
WITH {fx.ORDER_FILE_SQL}
SELECT min(_line_no) AS line_no FROM (
  SELECT _line_no, k, lag(k) OVER (ORDER BY _line_no) AS b FROM (
    SELECT _line_no, CASE WHEN value LIKE 'HDR%' THEN '0' WHEN value LIKE 'TRL%' THEN '2' ELSE '1' || substring(value, 11, 9) END AS k
    FROM file))
WHERE k < b""")
def verify_sorted_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify_sorted(fx.order_file(spark, sf_dir), SORT_KEYS, **MARKS)


@query("verify_sorted_in_order", "SELECT CAST(NULL AS BIGINT) AS line_no")
def verify_sorted_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order numbers rise with the lines, so nothing is out of order."""
    lines = table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") + 1).alias("_line_no"), fx.digits("o_orderkey", 10).alias("value")
    )
    return verify_sorted(lines, [(1, 10)])


SPARSE_SQL = "((o_orderkey * 2654435761) % 4294967291) * 2147483647"


@query("verify_sorted_sparse", f"""
SELECT min(spot) AS line_no FROM (
  SELECT spot, o_orderkey, lag(o_orderkey) OVER (ORDER BY spot) AS b FROM (SELECT {SPARSE_SQL} AS spot, o_orderkey FROM orders))
WHERE o_orderkey < b""")
def verify_sorted_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers spread over all of 63 bits: no two lines in one range, and not in the orders' order."""
    lines = table(spark, sf_dir, "orders").select(F.expr(SPARSE_SQL).alias("_line_no"), fx.digits("o_orderkey", 10).alias("value"))
    return verify_sorted(lines, [(1, 10)])


@query("delta_lines", f"WITH {fx.PREVIOUS_SQL} SELECT value FROM texts EXCEPT ALL SELECT value FROM previous")
def delta_lines_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta_lines(fx.order_lines(spark, sf_dir), fx.previous_lines(spark, sf_dir))


@query("delta_copies", """
SELECT lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || l_linestatus AS value FROM lineitem WHERE l_returnflag <> 'N'
EXCEPT ALL SELECT lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || l_linestatus FROM lineitem WHERE l_returnflag = 'N'""")
def delta_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files of very few distinct lines: what is left over of each line is a number of copies."""
    items = table(spark, sf_dir, "lineitem")
    value = F.concat(fx.digits("l_linenumber", 2), "l_linestatus").alias("value")
    return delta_lines(items.filter("l_returnflag <> 'N'").select(value), items.filter("l_returnflag = 'N'").select(value))


@query("delta_numbered", """
WITH today AS (SELECT event_id, event_type || '/' || user_id AS value FROM events WHERE value >= 5),
before AS (SELECT event_type || '/' || user_id AS value, count(*) AS n FROM events WHERE value < 5 GROUP BY 1)
SELECT event_id AS _line_no, value FROM (
  SELECT t.*, row_number() OVER (PARTITION BY t.value ORDER BY event_id) AS nth, coalesce(n, 0) AS n
  FROM today t LEFT JOIN before b ON t.value = b.value)
WHERE nth > n""")
def delta_numbered_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal lines the first cancel against the other file, the later ones are the delta."""
    lines = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("_line_no"), F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("value"),
        F.col("value").alias("amount"),
    )
    return delta_numbered(lines.filter("amount >= 5").drop("amount"), lines.filter("amount < 5").drop("amount"))


@query("delta_classify", f"""
WITH {fx.PREVIOUS_SQL}, d AS (SELECT value FROM texts EXCEPT ALL SELECT value FROM previous)
SELECT value, CASE WHEN substring(value, 1, 10) IN (SELECT substring(value, 1, 10) FROM previous)
  THEN 'changed' ELSE 'new' END AS _change FROM d""")
def delta_classify_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta_classify(fx.order_lines(spark, sf_dir), fx.previous_lines(spark, sf_dir), fx.ORDER_KEYS)


@query("scale_up", f"""
WITH {fx.ORDER_FILE_SQL}
SELECT _line_no, i AS _copy, rpad(base64(unhex(sha1(substring(value, 1, 10) || '_' || i))), 10, '0')
  || rpad(base64(unhex(sha1(substring(value, 11, 8) || '_' || i))), 8, '0') || substring(value, 19) AS value
FROM texts, (SELECT CAST(unnest([1, 2, 3]) AS INTEGER) AS i)
UNION ALL SELECT _line_no, 1, value FROM file WHERE value LIKE 'HDR%' OR value LIKE 'TRL%'""")
def scale_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line three times, its number and customer replaced by digests."""
    return multiply(
        fx.order_file(spark, sf_dir), (1, 10), 3, key=(11, 18), marks=(fx.ORDER_HEADER, fx.ORDER_TRAILER)
    )
