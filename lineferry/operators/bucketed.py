"""A target that is merged in place: files by a hash of the key, of which a load rewrites those it touches.

The target is a folder of Parquet files partitioned by ``_bucket``, the hash of a row's key. A load
names the buckets of its own keys; only their partitions are read, merged as :mod:`merge` does it, and
written over the old ones. What a load costs follows the buckets it touches, not the target. Rows with
a null in their key are never updated, so no load has to read them again: those of each load lie in a
bucket of their own below zero, written by as many tasks as their size asks for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lineferry.functions.text import any_of
from lineferry.operators.merge import merge
from lineferry.session import drop, materialize
from lineferry.spec import LoadSpec

BUCKET = "_bucket"


@dataclass(frozen=True)
class BucketedTarget:
    """Where the target is, its columns, its key, and in how many buckets it lies.

    A bucket should be some hundred MB: loads rewrite whole buckets, and every bucket is a folder.
    """

    path: str
    schema: StructType
    keys: tuple[str, ...]
    buckets: int

    def bucket(self, rows: DataFrame, without_key: int) -> Column:
        """The bucket of rows that have the key's columns, in whatever types they come."""
        kinds = {f.name: f.dataType for f in self.schema}
        keys = [F.col(k).try_cast(kinds[k]) for k in self.keys]
        number = F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")
        return F.when(any_of([k.isNull() for k in keys]), F.lit(without_key)).otherwise(number)

    def free_bucket(self, spark: SparkSession) -> int:
        """The number below zero that comes next: told by the folders, no column is read."""
        lowest = self._files(spark).where(F.col(BUCKET) < 0).agg(F.min(BUCKET)).first()[0]
        return (lowest or 0) - 1

    def _files(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(StructType([*self.schema.fields, StructField(BUCKET, IntegerType())])).parquet(self.path)

    def read(self, spark: SparkSession, buckets: list[int] | None = None) -> DataFrame:
        """The target's rows, or those of some buckets: the others' files are not opened."""
        files = self._files(spark)
        return (files if buckets is None else files.where(F.col(BUCKET).isin(buckets))).select(*self.schema.names)

    def create(self, rows: DataFrame) -> None:
        """Write the target anew from ``rows``."""
        self._write(rows, "static", -1)

    def _write(self, rows: DataFrame, mode: str, without_key: int) -> None:
        laid = rows.select(*self.schema.names, self.bucket(rows, without_key).alias(BUCKET))
        # Oversized buckets may be written by several tasks; within a file rows are in key order,
        # which makes its statistics tell ranges of keys apart.
        dealt = laid.hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, *self.keys)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(BUCKET).parquet(self.path)


@dataclass
class Touched:
    """Buckets that a merge rewrote, of how many."""

    buckets: list[int]
    of: int


def merge_in_place(rows: DataFrame, target: BucketedTarget, spec: LoadSpec, line: str = "_line_no") -> Touched:
    """Merge the good rows of a routed file into the target's own files, in the spec's mode.

    The buckets, numbers below ``target.buckets``, are all that reaches the driver. Old partitions are
    replaced when the job that writes the new ones commits; a load that fails before leaves the target
    as it was. A generated key goes on from the largest value of the whole target, of which only that
    column is read.
    """
    spark = rows.sparkSession
    own = target.free_bucket(spark)
    placed = materialize(rows.withColumn(BUCKET, target.bucket(rows, own)))
    touched = sorted(r[0] for r in placed.select(BUCKET).distinct().collect())
    if touched:
        # The load's own bucket for rows without a key is new, so nothing of it is there to be read.
        top = _top(target.read(spark), spec.generated_key) if spec.generated_key else None
        merged = materialize(merge(target.read(spark, [b for b in touched if b >= 0]), placed.drop(BUCKET), spec, line, top))
        target._write(_within(merged, target, touched, own), "dynamic", own)
        drop(merged)
    drop(placed)
    return Touched(touched, target.buckets)


def _top(target: DataFrame, key: str) -> int:
    return target.agg(F.coalesce(F.max(key), F.lit(0)).alias("top")).first().top


def _within(merged: DataFrame, target: BucketedTarget, touched: list[int], own: int) -> DataFrame:
    """The merged rows, all of which must lie in the buckets that were read."""
    bucket = target.bucket(merged, own)
    strayed = F.raise_error(F.lit("a merged row lies in a bucket that was not read"))
    return merged.where(F.when(bucket.isin(touched), F.lit(True)).otherwise(strayed.cast("boolean")))
