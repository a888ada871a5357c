"""The one join shape everything here uses: rows to a table with one row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineferry.functions.text import all_of, any_of

SPREAD = 4096


def _spread(df: DataFrame) -> Column:
    """1..SPREAD from the row's own data, so that a rerun task sends every row the same way."""
    if "_line_no" in df.columns:
        cols = ["_line_no"]
    else:
        cols = [f.name for f in df.schema if f.dataType.typeName() not in ("map", "variant")]
    return F.pmod(F.xxhash64(*cols), F.lit(SPREAD)) + 1


def _zero(cols: list[str]) -> Column:
    """Zero for every row, but not to the optimizer, which would fold a constant out of the join keys."""
    return F.xxhash64(*cols).bitwiseAND(F.lit(0).cast("bigint"))


def join_per_key(rows: DataFrame, per_key: DataFrame, keys: dict[str, str], condition: Column | None = None) -> DataFrame:
    """Left join of ``rows`` to ``per_key``; ``keys`` maps columns of the one to columns of the other.

    A null key matches nothing, so rows without one are spread over all tasks instead of meeting in
    one. The spread number is a join key on both sides: it makes Spark exchange ``per_key`` anew even
    where an aggregation already left it partitioned by key, and only a join between two exchanges
    can have its oversized partitions split at run time. ``per_key`` is by far the smaller side; when
    it is small enough Spark broadcasts it and nothing is exchanged.
    """
    no_key = any_of([F.col(k).isNull() for k in keys])
    left = rows.withColumn("_spread", F.when(no_key, _spread(rows)).otherwise(_zero(list(keys))))
    right = per_key.withColumn("_here", _zero(list(keys.values())))
    same = [F.col(k) == F.col(o) for k, o in keys.items()] + [F.col("_spread") == F.col("_here")]
    if condition is not None:
        same.append(condition)
    return left.join(right, all_of(same), "left").drop("_spread", "_here")


def rows_with_key(rows: DataFrame, per_key: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key is in ``per_key``: a semi join in the shape of :func:`join_per_key`."""
    named = {k: f"_in_{i}" for i, k in enumerate(keys)}
    known = per_key.select(*[F.col(k).alias(n) for k, n in named.items()], F.lit(True).alias("_known"))
    return join_per_key(rows, known, named).filter("_known").select(*rows.columns)
