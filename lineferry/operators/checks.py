"""Checks on hand-off files: control totals, duplicate keys, reconciliation, volume scale-up."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineferry.functions.text import cut, starts_with_any, trim_text
from lineferry.operators.joins import join_per_key, rows_with_key
from lineferry.sources.lines import field_texts, is_mark
from lineferry.spec import LoadSpec, is_own_text

LINE, LINE_NO = "value", "_line_no"


def hash_total(lines: DataFrame, locations: Mapping[str, tuple[int, int]]) -> DataFrame:
    """One row: number of lines, and per field the sum of its whole numbers and the count of texts
    that are none. Lines too short for a field, and blank texts, do not count for it."""
    texts = lines.select(*[
        F.when(F.length(LINE) >= end, F.nullif(trim_text(cut(F.col(LINE), start, end)), F.lit(""))).alias(name)
        for name, (start, end) in locations.items()
    ])
    totals: list[Column] = [F.count(F.lit(1)).alias("records")]
    for name in locations:
        text = F.col(name)
        number = F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("bigint"))
        # Summed as decimals: the total of many long numbers need not be a long.
        totals.append(F.coalesce(F.sum(number.cast("decimal(19,0)")), F.lit(0)).alias(f"sum_{name}"))
        totals.append(F.count_if(text.isNotNull() & number.isNull()).alias(f"bad_{name}"))
    return texts.agg(*totals)


def key_fields(spec: LoadSpec) -> list[str]:
    """Fields whose texts identify a line: keys, a lookup key being replaced by its parameters."""
    names: list[str] = []
    for f in spec.fields:
        if not f.key:
            continue
        if f.lookup is None:
            names.append(f.name)
        else:
            known = {x.name for x in spec.fields}
            names.extend(f.name if is_own_text(p, known) else p for p in f.lookup.on)
    return list(dict.fromkeys(names))


def _key_texts(lines: DataFrame, spec: LoadSpec) -> tuple[DataFrame, list[str]]:
    names = key_fields(spec)
    texts = field_texts(lines.filter(~is_mark(spec)), spec, "_t_")
    return texts.select(LINE_NO, *[F.coalesce(f"_t_{n}", F.lit("")).alias(n) for n in names]), names


def duplicate_keys(lines: DataFrame, spec: LoadSpec) -> DataFrame:
    """Keys that stand on more than one data line, with the count and the first two lines.

    Counts and line numbers are combined before the shuffle, whatever the number of lines of a key.
    """
    keyed, names = _key_texts(lines, spec)
    grouped = keyed.groupBy(*names).agg(
        F.count(F.lit(1)).alias("lines"), F.min(LINE_NO).alias("first_line"), F.max(LINE_NO).alias("last_line")
    )
    return grouped.filter(F.col("lines") > 1)


def duplicate_lines(lines: DataFrame, spec: LoadSpec) -> DataFrame:
    """Every line that shares its key with another: one row per line, so no list grows with a key."""
    keyed, names = _key_texts(lines, spec)
    twice = duplicate_keys(lines, spec).select(*names)
    return rows_with_key(keyed, twice, names)


def reconcile(left: DataFrame, right: DataFrame, keys: Mapping[str, tuple[int, int]]) -> DataFrame:
    """Every line of ``left`` with ``_match``: too_short, not_found, different or matched.

    Keys and lines are compared ignoring case; the first line of ``right`` with the key counts. That
    line is picked by an aggregate, so a key repeated in ``right`` is one row before the join.
    """
    longest = max(e for _, e in keys.values())
    cols = [f"_k{i}" for i in range(len(keys))]

    def keyed(lines: DataFrame, prefix: str) -> DataFrame:
        parts = [F.upper(cut(F.col(LINE), s, e)).alias(f"{prefix}{i}") for i, (s, e) in enumerate(keys.values())]
        return lines.select(LINE_NO, LINE, *parts)

    firsts = (
        keyed(right.filter(F.length(LINE) >= longest), "_k").groupBy(*cols)
        .agg(F.min_by(LINE, LINE_NO).alias("_other"), F.min(LINE_NO).alias("_other_no"))
    )
    # Short lines take no part in the join; they keep null keys.
    mine = keyed(left, "_p").withColumns({
        f"_p{i}": F.when(F.length(LINE) >= longest, F.col(f"_p{i}")) for i in range(len(keys))
    })
    joined = join_per_key(mine, firsts, {f"_p{i}": c for i, c in enumerate(cols)})
    match = (
        F.when(F.length(LINE) < longest, F.lit("too_short"))
        .when(F.col("_other").isNull(), F.lit("not_found"))
        .when(F.upper(LINE) == F.upper("_other"), F.lit("matched"))
        .otherwise(F.lit("different"))
    )
    return joined.select(LINE_NO, LINE, match.alias("_match"), "_other_no", F.col("_other").alias("_other_line"))


def reconcile_summary(matches: DataFrame) -> DataFrame:
    def count(kind: str) -> Column:
        return F.count_if(F.col("_match") == kind).alias(kind)

    return matches.agg(
        F.count(F.lit(1)).alias("lines"), count("matched"), count("different"), count("not_found"), count("too_short"),
        F.count_if(F.col("_match").isin("matched", "different")).alias("found"),
    )


def multiply(lines: DataFrame, field: tuple[int, int], n: int, key: tuple[int, int] | None = None, marks=()) -> DataFrame:
    """Every data line ``n`` times with the field (and key) text replaced by a digest of it and the
    copy number, cut or zero-padded to its width; marked lines once, unchanged."""

    def digested(line: Column, start: int, end: int, copy: Column) -> Column:
        width = end - start + 1
        old = F.rpad(F.substring(line, start, width), width, " ")
        text = F.base64(F.unhex(F.sha1(F.concat(old, F.lit("_"), copy.cast("string")))))
        before = F.rpad(F.substring(line, 1, start - 1), start - 1, " ") if start > 1 else F.lit("")
        return F.concat(before, F.rpad(text, width, "0"), F.substring(line, end + 1, 2**31 - 1))

    copies = F.sequence(F.lit(1), F.when(F.col("_marked"), F.lit(1)).otherwise(F.lit(n)))
    out = lines.withColumn("_marked", starts_with_any(F.col(LINE), marks)).select("*", F.explode(copies).alias("_copy"))
    for start, end in [field] if key is None or key == field else [field, key]:
        changed = digested(F.col(LINE), start, end, F.col("_copy"))
        out = out.withColumn(LINE, F.when(F.col("_marked"), F.col(LINE)).otherwise(changed))
    return out.drop("_marked")
