"""Order and change of hand-off files: key sort, order check, day-to-day delta."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lineferry.functions.text import padded_cut, starts_with_any
from lineferry.operators.joins import join_per_key
from lineferry.operators.position import LEVEL_BITS, index_within, line_range

LINE, LINE_NO = "value", "_line_no"
COPIES = 1 << 14


def mark_rank(headers=(), trailers=()) -> Column:
    """Headers before data, data before trailers."""
    return (
        F.when(starts_with_any(F.col(LINE), headers), F.lit(0))
        .when(starts_with_any(F.col(LINE), trailers), F.lit(2))
        .otherwise(F.lit(1))
    )


def line_keys(keys: list[tuple[int, int]]) -> list[Column]:
    """Key substrings of a line padded where it is short; without keys the whole line."""
    return [padded_cut(F.col(LINE), s, e) for s, e in keys if s > 0] or [F.col(LINE)]


def data_keys(keys: list[tuple[int, int]], headers=(), trailers=()) -> Column:
    """Sort key of a line: its rank, then, for data lines, its key substrings."""
    rank = mark_rank(headers, trailers)
    parts = [F.when(rank == 1, k).otherwise(F.lit("")) for k in line_keys(keys)]
    return F.struct(rank.alias("rank"), *[p.alias(f"k{i}") for i, p in enumerate(parts)])


def with_sort_keys(lines: DataFrame, keys: list[tuple[int, int]], headers=(), trailers=()) -> tuple[DataFrame, list[str]]:
    """Lines with the columns to order a file by, and their names.

    As expressions of the sort they would be evaluated anew for every comparison.
    """
    rank = mark_rank(headers, trailers)
    order = [rank, *[F.when(rank == 1, k).otherwise(F.lit("")) for k in line_keys(keys)]]
    names = [f"_o{i}" for i in range(len(order))]
    return lines.select("*", *[o.alias(n) for n, o in zip(names, order)]), names


def sort_by_key(lines: DataFrame, keys: list[tuple[int, int]], headers=(), trailers=(), distinct: bool = False,
                skip: int = 0) -> DataFrame:
    """Lines in key order, equal keys in file order (in line order where they carry no number).

    The last order column is what lets the sort spread one heavily used key over many partitions.
    ``distinct`` drops repeated lines wherever they stand; ``skip`` leaves out the first lines.
    """
    if skip:
        lines = lines.filter(F.col(LINE_NO) > skip)
    if distinct:
        lines = (
            lines.groupBy(LINE).agg(F.min(LINE_NO).alias(LINE_NO)) if LINE_NO in lines.columns
            else lines.select(LINE).distinct()
        )
    keyed, names = with_sort_keys(lines, keys, headers, trailers)
    return keyed.orderBy(*names, LINE_NO if LINE_NO in lines.columns else LINE).drop(*names)


def verify_sorted(lines: DataFrame, keys: list[tuple[int, int]], headers=(), trailers=()) -> DataFrame:
    """One row: the first line whose key is lower than the line before it, null when in order.

    Neighbours are compared inside fixed ranges of line numbers. Where one range follows another,
    its first key meets the last key before it: ranges are compared within what they share at the
    next level, that within the next, and only the last level, a bounded number of rows, as a whole.
    """
    keyed = lines.select(LINE_NO, data_keys(keys, headers, trailers).alias("_first"), line_range(LINE_NO).alias("_range"))
    at = keyed.select(F.col(LINE_NO).alias("_low"), F.col("_range").alias("_high"), "_first", F.col("_first").alias("_last"), F.col(LINE_NO).alias("_line"))
    broken = []
    for bits in (*LEVEL_BITS, None, "top"):
        within = W.orderBy("_low") if bits == "top" else W.partitionBy("_high").orderBy("_low")
        # Ranges may be missing, so "before" is the range present before, not the number before.
        seen = at.withColumn("_before", F.lag("_last").over(within))
        broken.append(seen.filter(F.col("_first") < F.col("_before")).agg(F.min("_line").alias("_line")))
        if bits == "top":
            break
        at = at.groupBy(F.col("_high").alias("_low")).agg(
            F.min_by("_first", "_low").alias("_first"), F.max_by("_last", "_low").alias("_last"), F.min_by("_line", "_low").alias("_line")
        )
        if bits is not None:
            at = at.withColumn("_high", F.shiftright("_low", bits))
    out = broken[0]
    for more in broken[1:]:
        out = out.unionByName(more)
    return out.agg(F.min("_line").alias("line_no"))


def _copies(counted: DataFrame) -> DataFrame:
    """``value`` repeated ``_n`` times. Counts become blocks of bounded size first, and the blocks
    are rebalanced, so that a line with very many copies is written by many tasks."""
    blocks = counted.select(
        LINE, F.explode(F.transform(
            F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / F.lit(COPIES))),
            lambda i: F.least(F.col("_n") - i * COPIES, F.lit(COPIES)),
        )).alias("_some"),
    )
    return blocks.hint("rebalance").select(LINE, F.explode(F.sequence(F.lit(1), F.col("_some").cast("int"))).alias("_i")).select(LINE)


def delta_lines(today: DataFrame, previous: DataFrame) -> DataFrame:
    """Today's lines that are new or changed: the multiset difference of the two files.

    Both files meet in one aggregation, so equal lines shrink to a count before the shuffle.
    Deleted lines are not part of a delta.
    """
    both = today.select(LINE, F.lit(1).alias("_c")).unionByName(previous.select(LINE, F.lit(-1).alias("_c")))
    left = both.groupBy(LINE).agg(F.sum("_c").alias("_n")).filter(F.col("_n") > 0)
    return _copies(left)


def delta_numbered(today: DataFrame, previous: DataFrame) -> DataFrame:
    """As :func:`delta_lines`, keeping line numbers: of equal lines the later ones are the new ones.

    Only lines that occur in both files, more often today, need to be told apart.
    """
    both = today.select(LINE, F.lit(1).alias("_t"), F.lit(0).alias("_p")).unionByName(
        previous.select(LINE, F.lit(0).alias("_t"), F.lit(1).alias("_p"))
    )
    more = (
        both.groupBy(F.col(LINE).alias("_text")).agg(F.sum("_t").alias("_t"), F.sum("_p").alias("_p"))
        .filter(F.col("_t") > F.col("_p")).select("_text", "_p")
    )
    kept = join_per_key(today.select(LINE_NO, LINE), more, {LINE: "_text"}).filter(F.col("_p").isNotNull()).drop("_text")
    new = kept.filter(F.col("_p") == 0).select(LINE_NO, LINE)
    again = index_within(kept.filter(F.col("_p") > 0), [LINE], LINE_NO, out="_nth")
    return new.unionByName(again.filter(F.col("_nth") >= F.col("_p")).select(LINE_NO, LINE))


def delta_classify(today: DataFrame, previous: DataFrame, keys: list[tuple[int, int]]) -> DataFrame:
    """Delta lines with ``_change``: ``changed`` when the previous file has the key, else ``new``."""
    delta = delta_lines(today, previous)
    cols = [f"_k{i}" for i in range(len(line_keys(keys)))]
    known = previous.select(*[k.alias(c) for c, k in zip(cols, line_keys(keys))]).distinct().withColumn("_known", F.lit(True))
    keyed = delta.select(LINE, *[k.alias(f"_p{i}") for i, k in enumerate(line_keys(keys))])
    change = F.when(F.col("_known"), F.lit("changed")).otherwise(F.lit("new"))
    joined = join_per_key(keyed, known, {f"_p{i}": c for i, c in enumerate(cols)})
    return joined.select(LINE, change.alias("_change"))
