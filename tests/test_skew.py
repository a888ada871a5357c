"""One key with a third of the rows: the joins split it, the aggregates shrink it, nothing is lost."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lineferry import Field, LoadSpec, Lookup
from lineferry.operators import merge as mg
from lineferry.operators.checks import duplicate_lines, reconcile
from lineferry.operators.lookup import lookup

ROWS = 300_000
SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "60KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
}


@pytest.fixture
def small_partitions(spark):
    old = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture
def rows(spark):
    """A third on one key, a third without a key, the rest spread out."""
    n = F.col("id")
    key = F.when(n % 3 == 0, F.lit(7)).when(n % 3 == 1, n)
    return spark.range(ROWS, numPartitions=16).select((n + 1).alias("_line_no"), key.alias("k"), F.sha1(n.cast("string")).alias("s"))


def final_plan(df):
    df._jdf.queryExecution().executedPlan().execute().count()
    return df._jdf.queryExecution().executedPlan().toString()


def test_lookup_splits_a_hot_key(spark, rows, small_partitions):
    dim = spark.range(ROWS).select(F.col("id").alias("d"), (F.col("id") * 2).alias("v"))
    out = lookup(rows, Lookup(dim, {"k": "d"}, "v", unique=True), "v")
    assert "skew=true" in final_plan(out)
    total = out.agg(F.count("*").alias("n"), F.countDistinct("_line_no").alias("d"), F.count("v").alias("hit")).first()
    assert (total.n, total.d, total.hit) == (ROWS, ROWS, 2 * ROWS // 3)


def test_rows_without_a_key_are_spread(spark, rows, small_partitions):
    dim = spark.range(10).select(F.col("id").alias("d"), F.col("id").alias("v"))
    out = lookup(rows.filter("k is null"), Lookup(dim, {"k": "d"}, "v", unique=True, optional=True), "v")
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == ROWS // 3 and max(sizes) < ROWS // 12


def test_merge_plan_splits_a_hot_key(spark, rows, small_partitions):
    target = spark.range(0, ROWS, 2).select(F.col("id").alias("k"), F.lit("t").alias("s"))
    plan = mg.merge_plan(rows, target, ["k"])
    assert "skew=true" in final_plan(plan)
    counts = mg.merge_counts(plan).first()
    # Odd loaded keys insert once (7 among them, from its first line); lines without a key insert.
    fresh = len({k for k in [7, *range(1, ROWS, 3)] if k % 2})
    assert (counts.inserted, counts.updated) == (fresh + ROWS // 3, ROWS - fresh - ROWS // 3)
    merged = mg.upsert_rows(target, rows, ["k"], ["k", "s"])
    assert merged.count() == target.count() + fresh + ROWS // 3


def test_duplicate_lines_and_reconcile_split_a_hot_key(spark, small_partitions):
    n = F.col("id")
    text = F.concat(F.lpad(F.when(n % 3 == 0, F.lit(7)).otherwise(n).cast("string"), 8, "0"), F.sha1(n.cast("string")))
    lines = spark.range(ROWS, numPartitions=16).select((n + 1).alias("_line_no"), text.alias("value"))
    spec = LoadSpec("T", [Field("K", 1, 8, key=True)])
    twice = duplicate_lines(lines, spec)
    assert "skew=true" in final_plan(twice)
    # 7 itself is one of the spread-out numbers.
    assert twice.count() == ROWS // 3 + 1
    matches = reconcile(lines, lines, {"K": (1, 8)})
    assert "skew=true" in final_plan(matches)
    found = {r._match: r["count"] for r in matches.groupBy("_match").count().collect()}
    assert found == {"matched": ROWS - ROWS // 3, "different": ROWS // 3}


def test_full_cache_splits_a_hot_key(spark, rows, small_partitions):
    """Null matches null there, so rows without a key do meet, and are split like any other key."""
    dim = spark.range(ROWS).select(F.col("id").alias("d"), (F.col("id") * 2).alias("v"))
    out = lookup(rows, Lookup(dim, {"k": "d"}, "v", full_cache=True), "v")
    assert "skew=true" in final_plan(out)
    assert out.agg(F.count("v")).first()[0] == 2 * ROWS // 3
