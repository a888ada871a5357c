"""Merges that rewrite the target's own files: same rows as a snapshot, and only the files of touched buckets."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from lineferry import Field, LoadSpec
from lineferry.operators import bucketed
from lineferry.operators.bucketed import BucketedTarget, merge_in_place
from lineferry.operators.merge import merge
from lineferry.spec import DELIMITED, INSERT, MIXED, UPDATE

SCHEMA = "k bigint, s string, n int"


def spec(mode, generated_key=None):
    return LoadSpec("T", [Field("k", 1, key=True, convert="long"), Field("s", 2)], kind=DELIMITED, delimiter=",", mode=mode, generated_key=generated_key)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def old(spark):
    return spark.range(2000).select(F.col("id").alias("k"), F.concat(F.lit("s"), "id").alias("s"), F.col("id").cast("int").alias("n")).unionByName(
        spark.createDataFrame([(None, "none", 1), (None, "none", 2)], SCHEMA))


@pytest.mark.parametrize("mode", [INSERT, UPDATE, MIXED])
def test_same_rows_as_a_snapshot(spark, tmp_path, old, mode):
    target = BucketedTarget(str(tmp_path / "t"), old.schema, ("k",), 32)
    target.create(old)
    load = spark.createDataFrame([(1, "5", "a"), (2, "5", "b"), (3, "9999", "new"), (4, None, "no key"), (5, "9999", "again"), (6, None, "no key")], "_line_no bigint, k string, s string")
    assert rows_of(target.read(spark)) == rows_of(old)
    want = rows_of(merge(old, load, spec(mode)))
    done = merge_in_place(load, target, spec(mode))
    assert rows_of(target.read(spark)) == want
    assert len(done.buckets) <= 3 and min(done.buckets) < 0
    # Once more: the second load's rows without a key lie beside the first's.
    again = rows_of(merge(target.read(spark), load, spec(mode)))
    merge_in_place(load, target, spec(mode))
    assert rows_of(target.read(spark)) == again


def test_generated_keys_go_on_over_all_buckets(spark, tmp_path):
    old = spark.range(500).select((F.col("id") + 100).alias("ID"), F.col("id").alias("k"), F.lit("x").alias("s"))
    target = BucketedTarget(str(tmp_path / "t"), old.schema, ("k",), 16)
    target.create(old)
    load = spark.createDataFrame([(1, 7, "a"), (2, 9001, "b"), (3, 9002, "c")], "_line_no bigint, k bigint, s string")
    merge_in_place(load, target, spec(MIXED, "ID"))
    got = {r.k: (r.ID, r.s) for r in target.read(spark).where("k in (7, 9001, 9002)").collect()}
    assert got == {7: (107, "a"), 9001: (600, "b"), 9002: (601, "c")}


def test_a_small_load_rewrites_its_buckets_alone(spark, tmp_path, old):
    target = BucketedTarget(str(tmp_path / "t"), old.schema, ("k",), 100)
    target.create(old)
    before = files(target.path)
    done = merge_in_place(spark.createDataFrame([(1, 42, "z")], "_line_no bigint, k bigint, s string"), target, spec(MIXED))
    after = files(target.path)
    kept = {f for f in after if before.get(f) == after[f]}
    assert len(done.buckets) == 1 and len(after) - len(kept) == 1
    plan = target.read(spark, done.buckets)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and target.read(spark, done.buckets).count() < 60


def test_nothing_to_load_and_a_failed_load(spark, tmp_path, old, monkeypatch):
    target = BucketedTarget(str(tmp_path / "t"), old.schema, ("k",), 8)
    target.create(old)
    before = files(target.path)
    none = spark.createDataFrame([], "_line_no bigint, k bigint, s string")
    assert merge_in_place(none, target, spec(MIXED)).buckets == [] and files(target.path) == before
    monkeypatch.setattr(bucketed, "merge", lambda here, rows, *a: here.withColumn("k", F.col("k") + 1))
    with pytest.raises(Exception, match="not read"):
        merge_in_place(spark.createDataFrame([(1, 42, "z")], "_line_no bigint, k bigint, s string"), target, spec(MIXED))
    assert files(target.path) == before
