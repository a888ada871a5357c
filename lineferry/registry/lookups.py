"""Queries over lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineferry.operators.lookup import chained_lookups, deferred_join, lookup, lookup_or_insert
from lineferry.plans.load import route, route_with_inserts
from lineferry.registry import fixtures as fx
from lineferry.registry.base import query, table
from lineferry.registry.conversions import delimited
from lineferry.spec import Field, InsertRule, Lookup


def _customer_orders(spark: SparkSession, sf_dir: str, optional: bool) -> DataFrame:
    lk = fx.customer_lookup(spark, sf_dir, value="c_nationkey", optional=optional)
    spec = fx.order_spec(Field("CUST_ID", 11, 18, lookup=lk))
    return route(fx.order_file(spark, sf_dir), spec).select("_line_no", "CUST_ID", "_status")


@query("lookup_mandatory", f"""
WITH {fx.ORDER_FILE_SQL}
SELECT f._line_no, c_nationkey AS CUST_ID,
  CASE WHEN t._line_no IS NULL THEN 'header_trailer' WHEN c_custkey IS NULL THEN 'integrity' ELSE 'ok' END AS _status
FROM file f LEFT JOIN texts t ON f._line_no = t._line_no
LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) ON o_custkey = c_custkey""")
def lookup_mandatory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customer_orders(spark, sf_dir, optional=False)


@query("lookup_optional", f"""
WITH {fx.ORDER_FILE_SQL}
SELECT f._line_no, c_nationkey AS CUST_ID, CASE WHEN t._line_no IS NULL THEN 'header_trailer' ELSE 'ok' END AS _status
FROM file f LEFT JOIN texts t ON f._line_no = t._line_no
LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) ON o_custkey = c_custkey""")
def lookup_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customer_orders(spark, sf_dir, optional=True)


@query("lookup_multi_key", """
SELECT c_custkey + 1 AS _line_no, n.name AS NATION, CASE WHEN n.name IS NULL THEN 'integrity' ELSE 'ok' END AS _status
FROM customer LEFT JOIN (
  SELECT n_nationkey, r_name, n_name || '/' || r_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey
) n ON c_nationkey = n_nationkey AND r_name = CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'ASIA'
  WHEN c_mktsegment = 'FURNITURE' THEN 'EUROPE' ELSE 'AFRICA' END""")
def lookup_multi_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation by its number (own text) and a region name (another field)."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    dim = nations.select("n_nationkey", "r_name", F.concat_ws("/", "n_name", "r_name").alias("name"))
    region = (
        F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "ASIA").when(F.col("c_mktsegment") == "FURNITURE", "EUROPE")
        .otherwise("AFRICA")
    )
    texts = table(spark, sf_dir, "customer").withColumn("region", region)
    lines = fx.delimited_rows(texts, "|", "c_custkey", "c_nationkey", "region")
    lk = Lookup(dim, {"NATION": "n_nationkey", "REGION": "r_name"}, "name")
    out = route(lines, delimited([Field("NATION", 1, lookup=lk), Field("REGION", 2)]))
    return out.select("_line_no", "NATION", "_status")


@query("lookup_chained", f"""
WITH {fx.ORDER_SQL}
SELECT _line_no, c_custkey AS CUST_ID, n_nationkey AS NATION, r_name AS REGION,
  CASE WHEN c_custkey IS NULL THEN 'integrity' ELSE 'ok' END AS _status
FROM texts LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def lookup_chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer, then its nation, then that nation's region; listed in reverse order."""
    customers = fx.known_customers(spark, sf_dir)
    spec = fx.order_spec(
        Field("REGION", lookup=Lookup(
            table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")),
            {"NATION": "n_nationkey"}, "r_name")),
        Field("NATION", lookup=Lookup(customers, {"CUST_ID": "c_custkey"}, "c_nationkey")),
        Field("CUST_ID", 11, 18, lookup=fx.customer_lookup(spark, sf_dir, unique=True)),
    )
    return route(fx.order_lines(spark, sf_dir), spec).select("_line_no", "CUST_ID", "NATION", "REGION", "_status")


@query("lookup_steps", """
SELECT c_custkey, n_name AS NATION, r_name AS REGION, 'ok' AS _status
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def lookup_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups over a table instead of a file, the second using the first one's result."""
    nations = table(spark, sf_dir, "nation")
    regions = nations.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return chained_lookups(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), {
        "NATION": Lookup(nations, {"c_nationkey": "n_nationkey"}, "n_name"),
        "REGION": Lookup(regions, {"NATION": "n_name"}, "r_name"),
    }).drop("c_nationkey")


@query("lookup_full_cache", """
WITH last AS (SELECT l_suppkey, max(l_shipdate) AS d FROM lineitem GROUP BY l_suppkey),
dim AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS k, CAST(max(l_shipdate) AS DATE) AS v FROM lineitem GROUP BY l_suppkey
  UNION ALL SELECT NULL, DATE '1900-01-01')
SELECT e.event_id, dim.v AS LAST_DAY, CASE WHEN dim.v IS NULL THEN 'integrity' ELSE 'ok' END AS _status
FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(user_id AS VARCHAR) END AS k FROM events) e
LEFT JOIN dim ON e.k IS NOT DISTINCT FROM dim.k""")
def lookup_full_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys compared as text, null matching null; of the rows with one key the last one counts."""
    days = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("k"), F.col("l_shipdate").alias("at"), F.col("l_shipdate").cast("date").alias("v")
    )
    none = days.agg(F.lit(None).cast("string").alias("k"), F.max("at").alias("at"), F.lit("1900-01-01").cast("date").alias("v"))
    events = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_type") != "error", F.col("user_id")).alias("user_id")
    )
    lk = Lookup(days.unionByName(none), {"user_id": "k"}, "v", full_cache=True, order="at")
    return lookup(events, lk, "LAST_DAY").drop("user_id")


@query("lookup_ambiguous", f"""
WITH {fx.ORDER_SQL}, lines AS (SELECT l_orderkey, count(*) AS n, max(l_linestatus) AS v FROM lineitem GROUP BY l_orderkey)
SELECT _line_no, CASE WHEN n = 1 THEN v END AS LINE_STATUS,
  CASE WHEN n > 1 THEN 'parse' WHEN n IS NULL THEN 'integrity' ELSE 'ok' END AS _status
FROM texts LEFT JOIN lines ON l_orderkey = CASE WHEN bad_id THEN NULL ELSE o_orderkey END""")
def lookup_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of an order's only line; most orders have several."""
    lk = Lookup(table(spark, sf_dir, "lineitem"), {"LINE_STATUS": "l_orderkey"}, "l_linestatus")
    spec = fx.order_spec(Field("LINE_STATUS", 1, 10, lookup=lk))
    return route(fx.order_lines(spark, sf_dir), spec).select("_line_no", "LINE_STATUS", "_status")


@query("lookup_deferred_inner", """
SELECT o_orderkey, c_nationkey AS o_custkey, r_name AS REGION
FROM orders JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) ON o_custkey = c_custkey
LEFT JOIN (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA')
  ON c_nationkey = n_nationkey""")
def lookup_deferred_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw texts resolved set by set: an inner join for the required customer, an outer one for the
    optional region, which hangs on the first one's result."""
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("o_custkey"), F.lit(None).cast("string").alias("REGION")
    )
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    steps = {
        "o_custkey": Lookup(fx.known_customers(spark, sf_dir), {"o_custkey": "c_custkey"}, "c_nationkey"),
        "REGION": Lookup(nations.filter(F.col("r_name") != "ASIA"), {"o_custkey": "n_nationkey"}, "r_name"),
    }
    return deferred_join(rows, steps, {"o_custkey": True, "REGION": False})


NEW_CUSTOMERS_SQL = """
known AS (SELECT c_custkey + 1000000 AS id, c_custkey AS code, c_name AS name FROM customer WHERE c_acctbal >= 0),
missing AS (
  SELECT o_custkey AS code, min(o_orderkey + 1) AS first FROM orders
  WHERE o_custkey NOT IN (SELECT code FROM known) GROUP BY o_custkey),
new AS (
  SELECT (SELECT max(id) FROM known) + row_number() OVER (ORDER BY first) AS id, code, 'NEW' AS name FROM missing)"""


def _customer_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.known_customers(spark, sf_dir).select(
        (F.col("c_custkey") + 1000000).alias("id"), F.col("c_custkey").alias("code"), F.col("c_name").alias("name")
    )


def _inserting(spark: SparkSession, sf_dir: str) -> Lookup:
    return Lookup(
        _customer_dimension(spark, sf_dir), {"CUST_ID": "code"}, "id", unique=True,
        insert=InsertRule("id", {"name": "NEW"}),
    )


@query("lookup_or_insert", f"""
WITH {NEW_CUSTOMERS_SQL}
SELECT o_orderkey AS _line_no, d.id AS CUST, o_custkey AS CUST_ID, 'ok' AS _status
FROM orders JOIN (SELECT * FROM known UNION ALL SELECT * FROM new) d ON o_custkey = d.code""")
def lookup_or_insert_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_line_no"), F.col("o_custkey").alias("CUST_ID"))
    return lookup_or_insert(orders, _inserting(spark, sf_dir), "CUST")[0]


def new_customers_sql(where: str) -> str:
    """The dimension rows made for the orders that meet ``where``."""
    return f"""
known AS (SELECT c_custkey + 1000000 AS id, c_custkey AS code, c_name AS name FROM customer WHERE c_acctbal >= 0),
missing AS (
  SELECT o_custkey AS code, min(o_orderkey + 1) AS first FROM orders
  WHERE {where} AND o_custkey NOT IN (SELECT code FROM known) GROUP BY o_custkey),
new AS (
  SELECT (SELECT max(id) FROM known) + row_number() OVER (ORDER BY first) AS id, code, 'NEW' AS name FROM missing)"""


@query("lookup_inserted_rows", f"""
WITH {new_customers_sql("o_totalprice >= 5000 AND o_orderstatus <> 'P'")}
SELECT id, code, name FROM new""")
def lookup_inserted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New dimension rows of a routed file: only lines that reach the lookup ask for one."""
    spec = fx.order_spec(
        fx.ORDER_ID, Field("CUST_ID", 11, 18, lookup=_inserting(spark, sf_dir)),
        Field("STATUS", 19, 19, filter_values=("F", "O")),
    )
    return route_with_inserts(fx.order_file(spark, sf_dir), spec)[1]["CUST_ID"]


@query("lookup_insert_filtered", f"""
WITH {new_customers_sql("o_totalprice >= 5000 AND o_orderstatus = substr(o_orderpriority, 4, 1)")}
SELECT id, code, name FROM new""")
def lookup_insert_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that a cross-field filter takes out make no dimension row."""
    spec = fx.order_spec(
        fx.ORDER_ID, Field("CUST_ID", 11, 18, lookup=_inserting(spark, sf_dir)),
        Field("STATUS", 19, 19, filter_fields=("LETTER",)), Field("LETTER", 45, 45),
    )
    return route_with_inserts(fx.order_file(spark, sf_dir), spec)[1]["CUST_ID"]


@query("lookup_insert_partial_null", """
WITH asked AS (
  SELECT o_orderkey + 1 AS line, o_custkey AS code, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS kind FROM orders),
known AS (SELECT c_custkey AS id, c_custkey AS code, 'F' AS kind FROM customer WHERE c_acctbal >= 0),
missing AS (
  SELECT code, kind, min(line) AS first FROM asked
  WHERE kind IS NULL OR NOT EXISTS (SELECT 1 FROM known WHERE known.code = asked.code AND known.kind = asked.kind) GROUP BY code, kind),
every AS (
  SELECT * FROM known UNION ALL
  SELECT (SELECT max(id) FROM known) + row_number() OVER (ORDER BY first), code, kind FROM missing)
SELECT line AS _line_no, id AS CUST, 'ok' AS _status FROM asked
JOIN every ON asked.code = every.code AND asked.kind IS NOT DISTINCT FROM every.kind""")
def lookup_insert_partial_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of which one is null make a row, and the line gets its key."""
    dim = fx.known_customers(spark, sf_dir).select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("code"), F.lit("F").alias("kind"))
    kind = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    rows = table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1).alias("_line_no"), F.col("o_custkey").alias("CODE"), kind.alias("KIND"))
    lk = Lookup(dim, {"CODE": "code", "KIND": "kind"}, "id", unique=True, insert=InsertRule("id"))
    return lookup_or_insert(rows, lk, "CUST")[0].select("_line_no", "CUST", "_status")
