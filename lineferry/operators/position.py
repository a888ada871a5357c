"""Ordered positions without a global window.

Three shapes, by what is known about the order:

* :func:`index_by_line` - a unique whole-number column (a line number, dense or not). Rows are
  grouped into fixed ranges of that number, so a group never holds more than ``RANGE`` rows whatever
  the data, and the result depends on the rows alone, not on how they happened to be partitioned.
  What precedes a range is summed level by level, see :func:`levels`.
* :func:`index_by_order` - any total order. One range-partitioned sort, written once with every
  row's partition and place in it, then positions from the sizes of the partitions.
* :func:`index_within` - the position inside a group that may be arbitrarily large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lineferry.functions.text import all_of
from lineferry.session import BROADCAST_BYTES, materialize

RANGE_BITS = 17
RANGE = 1 << RANGE_BITS


def line_range(line: str | Column) -> Column:
    """The range a line number falls in; at most ``RANGE`` lines share one."""
    return F.shiftright(F.col(line) if isinstance(line, str) else line, RANGE_BITS)


#: Bits by which each level above the ranges is narrower than the one below: two levels leave so few
#: numbers of 64 bits that the last one, whose window is a single task, has 128 at most.
LEVEL_BITS = (20, 20)


def levels(key: str) -> list[tuple[str, str]]:
    """Columns of the levels above ranges ``key``, each with the number it is shifted to the right from.

    Sparse numbers can have a range a row. A table of ranges is therefore never ordered in one task:
    ranges are ordered within what they share at the next level, that within the next, and only the
    last level, of a size that the width of a number bounds, is ordered as a whole.
    """
    names = [key, *[f"{key}_{i + 1}" for i in range(len(LEVEL_BITS))]]
    return list(zip(names, names[1:], strict=False))


def _offsets(counts: DataFrame, key: str) -> DataFrame:
    """Rows before each range, as the sum of those before it at each level."""
    first = lambda order: order.rowsBetween(W.unboundedPreceding, -1)
    parts, at = [], counts
    for bits, (low, high) in zip(LEVEL_BITS, levels(key), strict=True):
        at = at.withColumn(high, F.shiftright(low, bits))
        parts.append(at.select(low, high, F.coalesce(F.sum("_n").over(first(W.partitionBy(high).orderBy(low))), F.lit(0)).alias(f"_at_{low}")))
        at = at.groupBy(high).agg(F.sum("_n").alias("_n"))
    out = at.select(high, F.coalesce(F.sum("_n").over(first(W.orderBy(high))), F.lit(0)).alias("_before"))
    for part, (low, high) in reversed(list(zip(parts, levels(key), strict=True))):
        out = part.join(out, high).select(low, (F.col(f"_at_{low}") + F.col("_before")).alias("_before"))
    return out


def index_by_line(df: DataFrame, line: str = "_line_no", out: str = "_pos", where: Column | None = None) -> DataFrame:
    """0-based dense position of every row by a unique line number; null where ``where`` is not met.

    One shuffle of the rows; the offsets come from a pruned count over the same input.
    """
    keep = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    marked = df.withColumn("_keep", keep).withColumn("_range", line_range(line))
    counts = marked.groupBy("_range").agg(F.count_if("_keep").alias("_n"))
    within = F.sum(F.col("_keep").cast("bigint")).over(W.partitionBy("_range").orderBy(line))
    placed = marked.withColumn("_within", within)
    return (
        placed.join(_offsets(counts, "_range"), "_range", "left")
        .withColumn(out, F.when(F.col("_keep"), F.col("_before") + F.col("_within") - 1))
        .drop("_keep", "_range", "_within", "_before")
    )


def index_by_order(df: DataFrame, *order: str | Column, out: str = "_pos") -> DataFrame:
    """0-based dense position of every row in a total order.

    The order must be total for the positions to be repeatable. The sort splits ties too when the
    last order column is distinctive, so equal leading keys do not end up in one task. Order by
    columns rather than expressions, which would be evaluated anew for every comparison.
    """
    ranked = df.orderBy(*order)
    at = [F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_id")]
    placed = materialize(ranked.select("*", *at))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", (before - F.col("_first")).alias("_shift"))
    # One row per sorted partition, at most as many as the session makes of a shuffle.
    if _most_partitions(df) * 64 <= BROADCAST_BYTES:
        offsets = F.broadcast(offsets)
    return (
        placed.join(offsets, "_part")
        .withColumn(out, F.col("_id") + F.col("_shift"))
        .drop("_part", "_id", "_shift")
    )


def _most_partitions(df: DataFrame) -> int:
    """Upper bound of the partitions of a sort: runtime re-planning only merges them."""
    conf = df.sparkSession.conf
    most = int(conf.get("spark.sql.shuffle.partitions", "200"))
    first = conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    return max(most, int(first)) if first else most


def index_within(df: DataFrame, keys: list[str], *order: str | Column, out: str = "_nth") -> DataFrame:
    """0-based position of every row inside its key group, groups of any size.

    The rows are sorted once over (keys, order) and a group's first position is taken off, so a
    group that fills a third of the table is spread over as many tasks as its size asks for.
    """
    placed = index_by_order(df, *keys, *order, out="_at")
    first = placed.groupBy(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)]).agg(F.min("_at").alias("_from"))
    same = all_of([F.col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(keys)])
    return placed.join(first, same, "left").select(*df.columns, (F.col("_at") - F.col("_from")).alias(out))
