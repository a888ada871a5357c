"""Queries over the load's outputs: merges, side tables, staging, rejects, summaries."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineferry.operators.bucketed import BucketedTarget, merge_in_place
from lineferry.operators.merge import (
    INSERTED, UPDATED, insert_rows, merge, merge_counts, merge_plan, post_insert_rows, post_update_rows,
    refresh_delete, refresh_update, target_presence, update_rows, upsert_rows, with_generated_key,
)
from lineferry.operators.stage import stage_lines, staged_load, staged_merge, staged_rows, staged_unloaded
from lineferry.plans.load import load, load_summary, loaded, rejects, route
from lineferry.registry import fixtures as fx
from lineferry.registry.base import ORACLES, query, table
from lineferry.registry.fixtures import ORDER_COLUMNS as COLUMNS
from lineferry.session import materialize, shared_folder
from lineferry.spec import MIXED, Field, Lookup

KEYS = ["ORDER_ID"]


@query("load_summary", f"""
WITH {fx.ROUTED_SQL}
SELECT count(*) + 2 AS all_lines, CAST(2 AS BIGINT) AS header_trailer, CAST(0 AS BIGINT) AS parse,
  count(*) FILTER (_status = 'filtered') AS filtered, count(*) FILTER (_status = 'integrity') AS integrity,
  count(*) FILTER (_status = 'unknown') AS unknown, CAST(0 AS BIGINT) AS too_long, CAST(0 AS BIGINT) AS commit_failed,
  count(*) FILTER (_status = 'filtered') + 2 AS ineligible, count(*) FILTER (_status <> 'filtered') AS eligible,
  count(*) FILTER (_status = 'ok') AS loaded
FROM routed""")
def load_summary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_summary(route(fx.order_file(spark, sf_dir), fx.full_order_spec(spark, sf_dir)))


@query("reject_report", f"""
WITH {fx.ROUTED_SQL}
SELECT _line_no, _status, value,
  CASE _status WHEN 'filtered' THEN 'STATUS: value filter' WHEN 'unknown' THEN 'ORDER_ID: not a valid long'
    ELSE 'CUST_ID: lookup value missing' END AS _reason
FROM routed WHERE _status <> 'ok'""")
def reject_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects(route(fx.order_file(spark, sf_dir), fx.full_order_spec(spark, sf_dir)))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order file routed, merged into its target, and counted per status and action."""
    spec = fx.full_order_spec(spark, sf_dir)
    done = load(fx.order_file(spark, sf_dir), spec, fx.merge_target(spark, sf_dir))
    others = done.routed.filter(F.col("_status") != "ok").select(F.col("_status").alias("outcome"))
    outcomes = done.plan.select(F.col("_action").alias("outcome")).unionByName(others)
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("lines"))


@query("load_orders", f"""
WITH {fx.ROUTED_SQL},
outcome AS (
  SELECT CASE WHEN _status = 'ok' AND order_day < DATE '{fx.BEFORE_DAY}' THEN 'update'
              WHEN _status = 'ok' THEN 'insert' ELSE _status END AS outcome FROM routed
  UNION ALL SELECT 'header_trailer' UNION ALL SELECT 'header_trailer')
SELECT outcome, count(*) AS lines FROM outcome GROUP BY outcome""")
def load_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir)


@query("load_orders_merged", f"""
WITH {fx.ROUTED_SQL},
target AS (
  SELECT o_orderkey AS ORDER_ID, o_custkey AS CUST_ID, '?' AS STATUS, CAST(0 AS DECIMAL(18,2)) AS AMOUNT,
    CAST(o_orderdate AS DATE) AS ORDER_DATE FROM orders WHERE o_orderdate < TIMESTAMP '{fx.BEFORE_DAY}'),
good AS (
  SELECT o_orderkey AS ORDER_ID, o_custkey AS CUST_ID, o_orderstatus AS STATUS, {fx.AMOUNT_SQL} AS AMOUNT,
    {fx.ORDER_DATE_SQL} AS ORDER_DATE FROM routed WHERE _status = 'ok')
SELECT * FROM good UNION ALL SELECT * FROM target WHERE ORDER_ID NOT IN (SELECT ORDER_ID FROM good)""")
def load_orders_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same load as the target's next snapshot."""
    spec = fx.full_order_spec(spark, sf_dir)
    return load(fx.order_file(spark, sf_dir), spec, fx.merge_target(spark, sf_dir)).target


@query("target_presence", f"""
WITH {fx.MERGE_SQL}
SELECT l._line_no, l.ORDER_ID, CASE WHEN t.ORDER_ID IS NULL THEN 'insert' ELSE 'update' END AS _action
FROM lines l LEFT JOIN target t ON l.ORDER_ID = t.ORDER_ID""")
def target_presence_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.merge_rows(spark, sf_dir).select("_line_no", "ORDER_ID")
    return target_presence(rows, fx.merge_target(spark, sf_dir), KEYS)


@query("merge_insert_mode", f"""
WITH {fx.MERGE_SQL}
SELECT * FROM target UNION ALL SELECT ORDER_ID, CUST_ID, STATUS, AMOUNT, ORDER_DATE FROM lines""")
def merge_insert_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insert_rows(fx.merge_target(spark, sf_dir), fx.merge_rows(spark, sf_dir), COLUMNS)


@query("merge_update_mode", f"""
WITH {fx.MERGE_SQL}
SELECT t.ORDER_ID, l.CUST_ID, l.STATUS, l.AMOUNT, l.ORDER_DATE FROM target t JOIN lastline l ON t.ORDER_ID = l.ORDER_ID""")
def merge_update_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return update_rows(fx.merge_target(spark, sf_dir), fx.merge_rows(spark, sf_dir), KEYS, COLUMNS)


@query("merge_update_where", f"""
WITH {fx.MERGE_SQL}
SELECT t.ORDER_ID, CASE WHEN l.CUST_ID > 50 THEN l.CUST_ID ELSE t.CUST_ID END AS CUST_ID,
  CASE WHEN l.CUST_ID > 50 THEN l.STATUS ELSE t.STATUS END AS STATUS,
  CASE WHEN l.CUST_ID > 50 THEN l.AMOUNT ELSE t.AMOUNT END AS AMOUNT,
  CASE WHEN l.CUST_ID > 50 THEN l.ORDER_DATE ELSE t.ORDER_DATE END AS ORDER_DATE
FROM target t JOIN lastline l ON t.ORDER_ID = l.ORDER_ID""")
def merge_update_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An update with a condition of its own beside the key."""
    return update_rows(
        fx.merge_target(spark, sf_dir), fx.merge_rows(spark, sf_dir), KEYS, COLUMNS,
        condition=(F.col("CUST_ID") == F.col("_src_CUST_ID")) & (F.col("_src_CUST_ID") > 50),
    )


@query("merge_mixed_mode", f"""
WITH {fx.MERGE_SQL}
SELECT coalesce(l.ORDER_ID, t.ORDER_ID) AS ORDER_ID,
  CASE WHEN l.ORDER_ID IS NULL THEN t.CUST_ID ELSE l.CUST_ID END AS CUST_ID,
  CASE WHEN l.ORDER_ID IS NULL THEN t.STATUS ELSE l.STATUS END AS STATUS,
  CASE WHEN l.ORDER_ID IS NULL THEN t.AMOUNT ELSE l.AMOUNT END AS AMOUNT,
  CASE WHEN l.ORDER_ID IS NULL THEN t.ORDER_DATE ELSE l.ORDER_DATE END AS ORDER_DATE
FROM target t FULL JOIN lastline l ON t.ORDER_ID = l.ORDER_ID""")
def merge_mixed_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert_rows(fx.merge_target(spark, sf_dir), fx.merge_rows(spark, sf_dir), KEYS, COLUMNS)


PLAN_SQL = fx.MERGE_SQL + """,
plan AS (
  SELECT l.*, CASE WHEN t.ORDER_ID IS NOT NULL
      OR l._line_no > min(l._line_no) OVER (PARTITION BY l.ORDER_ID) THEN 'update' ELSE 'insert' END AS _action
  FROM lines l LEFT JOIN target t ON l.ORDER_ID = t.ORDER_ID
)"""


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_plan(fx.merge_rows(spark, sf_dir), fx.merge_target(spark, sf_dir), KEYS)


@query("merge_counts", f"""
WITH {PLAN_SQL}
SELECT count(*) FILTER (_action = 'insert') AS inserted, count(*) FILTER (_action = 'update') AS updated FROM plan""")
def merge_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_counts(_plan(spark, sf_dir))


@query("merge_preview", f"WITH {PLAN_SQL} SELECT * FROM plan")
def merge_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)


@query("generated_key", f"""
WITH {PLAN_SQL}
SELECT _line_no, ORDER_ID, _action, CASE WHEN _action = 'insert' THEN (SELECT max(ORDER_ID) FROM target)
    + row_number() OVER (PARTITION BY _action ORDER BY _line_no) END AS ID
FROM plan""")
def generated_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = fx.merge_target(spark, sf_dir).withColumnRenamed("ORDER_ID", "ID")
    return with_generated_key(_plan(spark, sf_dir), target, "ID").select("_line_no", "ORDER_ID", "_action", "ID")


@query("merge_generated_key", f"""
WITH {PLAN_SQL},
ids AS (
  SELECT ORDER_ID, (SELECT max(ORDER_ID) FROM target) + 7 + row_number() OVER (ORDER BY _line_no) AS ID
  FROM plan WHERE _action = 'insert')
SELECT i.ID, l.* EXCLUDE (_line_no) FROM lastline l JOIN ids i ON l.ORDER_ID = i.ORDER_ID
UNION ALL SELECT t.ORDER_ID + 7, l.* EXCLUDE (_line_no) FROM target t JOIN lastline l ON t.ORDER_ID = l.ORDER_ID""")
def merge_generated_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixed mode with a generated key: updated rows keep theirs, new ones continue after the largest."""
    target = fx.merge_target(spark, sf_dir).select((F.col("ORDER_ID") + 7).alias("ID"), "*")
    fields = [Field("ORDER_ID", 1, 1, key=True, convert="long"), *[Field(c, 1, 1) for c in COLUMNS[1:]]]
    return merge(target, fx.merge_rows(spark, sf_dir), fx.order_spec(*fields, mode=MIXED, generated_key="ID"))


@query("merge_in_place", ORACLES["merge_mixed_mode"])
def merge_in_place_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed merge into a target that lies in buckets, whose files it rewrites; then the target as it is read."""
    old = fx.merge_target(spark, sf_dir)
    target = BucketedTarget(f"{shared_folder(spark)}/target-{uuid.uuid4().hex}", old.schema, ("ORDER_ID",), 16)
    target.create(old)
    fields = [Field("ORDER_ID", 1, 1, key=True, convert="long"), *[Field(c, 1, 1) for c in COLUMNS[1:]]]
    merge_in_place(fx.merge_rows(spark, sf_dir), target, fx.order_spec(*fields, mode=MIXED))
    return target.read(spark)


@query("refresh_delete", f"WITH {fx.MERGE_SQL} SELECT * FROM target WHERE CUST_ID > 50")
def refresh_delete_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refresh_delete(fx.merge_target(spark, sf_dir), F.col("CUST_ID") <= 50)


@query("refresh_update", f"""
WITH {fx.MERGE_SQL}
SELECT ORDER_ID, CUST_ID, CASE WHEN CUST_ID <= 50 THEN 'X' ELSE STATUS END AS STATUS,
  CASE WHEN CUST_ID <= 50 THEN NULL ELSE AMOUNT END AS AMOUNT, ORDER_DATE FROM target""")
def refresh_update_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refresh_update(
        fx.merge_target(spark, sf_dir), {"STATUS": F.lit("X"), "AMOUNT": F.lit(None)}, F.col("CUST_ID") <= 50
    )


@query("post_insert_rows", f"""
WITH {PLAN_SQL}
SELECT c_custkey AS cust, 'opened' AS what, CAST(NULL AS BIGINT) AS order_id FROM customer
UNION ALL SELECT CUST_ID, 'ordered ' || STATUS, ORDER_ID FROM plan WHERE _action = 'insert'""")
def post_insert_rows_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("cust"), F.lit("opened").alias("what"), F.lit(None).cast("bigint").alias("order_id")
    )
    return post_insert_rows(side, _plan(spark, sf_dir), INSERTED, {
        "cust": F.col("CUST_ID"), "what": F.concat(F.lit("ordered "), "STATUS"), "order_id": F.col("ORDER_ID"),
    })


@query("post_update_rows", f"""
WITH {PLAN_SQL}
SELECT c_custkey, c_mktsegment, coalesce(p.ORDER_ID, -1) AS last_order
FROM customer LEFT JOIN (
  SELECT CUST_ID, arg_max(ORDER_ID, _line_no) AS ORDER_ID FROM plan WHERE _action = 'update' GROUP BY CUST_ID
) p ON c_custkey = p.CUST_ID""")
def post_update_rows_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.lit(-1).cast("bigint").alias("last_order"))
    return post_update_rows(side, _plan(spark, sf_dir), UPDATED, {"c_custkey": "CUST_ID"}, {"last_order": F.col("ORDER_ID")})


@query("stage_lines", f"""
WITH {fx.ROUTED_SQL}
SELECT _line_no, lpad(CAST(_line_no AS VARCHAR), 14, '0')
  || 'N' || lpad(CAST(o_orderkey AS VARCHAR), 20, '0') || 'N' || cust_text || 'N' || status_text
  || 'N' || lpad(regexp_replace(CAST({fx.AMOUNT_SQL} AS VARCHAR), '\\.?0+$', ''), 15, ' ')
  || CASE WHEN date_text = '00000000' THEN rpad('Y', 11, ' ') ELSE 'N' || strftime(order_day, '%Y-%m-%d') END
  || 'N' || rpad({fx.PRIORITY_SQL}, 15, ' ') || 'NHOST' AS value
FROM routed WHERE _status IN ('ok', 'integrity')""")
def stage_lines_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer lookup is deferred, so its raw text is staged and nothing misses yet."""
    spec = _staged_spec(spark, sf_dir)
    return stage_lines(loaded(route(fx.order_file(spark, sf_dir), spec, defer=True), spec), spec)


@query("stage_overflow", f"""
WITH {fx.ORDER_SQL},
t AS (SELECT *, o_orderstatus || '-' || o_orderpriority AS label FROM texts WHERE NOT bad_id)
SELECT _line_no, CASE WHEN length(label) <= 12 THEN lpad(CAST(_line_no AS VARCHAR), 14, '0') || 'N' || lpad(CAST(o_orderkey AS VARCHAR), 20, '0')
    || 'N' || o_orderstatus || 'N' || rpad(o_orderpriority, 15, ' ') || 'N' || rpad(label, 12, ' ') END AS value,
  CASE WHEN length(label) <= 12 THEN 'ok' ELSE 'unknown' END AS _status,
  CASE WHEN length(label) > 12 THEN 'LABEL: does not fit' END AS _reason
FROM t""")
def stage_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label of two fields is wider than its place for some orders, which are not staged."""
    label = Field("LABEL", convert="merge_fields", args={"fields": ("STATUS", "PRIORITY"), "delimiter": "-"}, size=12)
    spec = fx.order_spec(fx.ORDER_ID, fx.STATUS, Field("PRIORITY", 42, 56), label)
    return staged_rows(loaded(route(fx.order_file(spark, sf_dir), spec), spec), spec)


def _staged_spec(spark: SparkSession, sf_dir: str):
    whole = fx.full_order_spec(spark, sf_dir)
    lk: Lookup = replace(whole.field("CUST_ID").lookup, deferred=True)
    return replace(whole, fields=[
        replace(f, lookup=lk, optional=False) if f.name == "CUST_ID" else f for f in whole.fields
    ])


@query("staged_merge", f"""
WITH {fx.ROUTED_SQL}
SELECT _line_no, CASE WHEN _status = 'ok' THEN o_custkey END AS CUST_ID,
  CASE WHEN _status = 'integrity' THEN 'N' WHEN order_day < DATE '{fx.BEFORE_DAY}' THEN 'U' ELSE 'I' END AS _loaded
FROM routed WHERE _status IN ('ok', 'integrity')""")
def staged_merge_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = _staged_spec(spark, sf_dir)
    # Staged rows are a written table by nature.
    rows = materialize(loaded(route(fx.order_file(spark, sf_dir), spec, defer=True), spec))
    return staged_merge(rows, fx.merge_target(spark, sf_dir), spec).select("_line_no", "CUST_ID", "_loaded")


@query("staged_unloaded", f"WITH {fx.ROUTED_SQL} SELECT _line_no FROM routed WHERE _status = 'integrity'")
def staged_unloaded_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = _staged_spec(spark, sf_dir)
    rows = loaded(route(fx.order_file(spark, sf_dir), spec, defer=True), spec)
    return staged_unloaded(rows, spec)


@query("staged_load", f"""
WITH {fx.ROUTED_SQL},
n AS (SELECT _line_no, CASE WHEN _status = 'integrity' THEN 'N' WHEN order_day < DATE '{fx.BEFORE_DAY}' THEN 'U' ELSE 'I' END AS _loaded
      FROM routed WHERE _status IN ('ok', 'integrity'))
SELECT _loaded, count(*) AS lines, min(_line_no) AS first_line, max(_line_no) AS last_line FROM n GROUP BY _loaded
UNION ALL SELECT 'unloaded', count(*), min(_line_no), max(_line_no) FROM n WHERE _loaded = 'N'""")
def staged_load_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge report and unloaded list of one resolution, counted."""
    spec = _staged_spec(spark, sf_dir)
    rows = materialize(loaded(route(fx.order_file(spark, sf_dir), spec, defer=True), spec))
    done = staged_load(rows, fx.merge_target(spark, sf_dir), spec)
    counted = [F.count(F.lit(1)).alias("lines"), F.min("_line_no").alias("first_line"), F.max("_line_no").alias("last_line")]
    return done.report.groupBy("_loaded").agg(*counted).unionByName(
        done.unloaded.agg(*counted).withColumn("_loaded", F.lit("unloaded")))
