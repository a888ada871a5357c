"""Lookups: field values resolved by joining a dimension.

No side is broadcast by hand. Spark broadcasts a dimension its own statistics show to be small;
a larger one becomes a shuffled join whose oversized partitions are split at run time (see
:mod:`lineferry.operators.joins`).
"""

from __future__ import annotations

from collections.abc import Mapping
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineferry.functions.text import all_of, is_empty
from lineferry.operators.joins import join_per_key
from lineferry.operators.position import index_by_line
from lineferry.session import materialize
from lineferry.spec import Lookup


def as_key(c: Column, have: str, want: str) -> Column:
    """A parameter as the dimension column's type; text that is no such value never matches."""
    if have == want:
        return c
    if have == "string" and want in ("tinyint", "smallint", "int", "bigint"):
        # Casting bad text is far dearer than looking at it first.
        return F.when(c.rlike(r"^\s*[+-]?[0-9]+\s*$"), c.try_cast(want))
    return c.try_cast(want)


def dimension(lk: Lookup) -> DataFrame:
    """The dimension reduced to one row per key: ``_k0..``, ``_v`` and, unless unique, ``_n``."""
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(lk.on.values())]
    names = [f"_k{i}" for i in range(len(keys))]
    value = F.col(lk.value).alias("_v")
    if lk.full_cache:
        texts = [k.cast("string").alias(n) for k, n in zip(keys, names)]
        order = F.col(lk.order) if lk.order else F.col(lk.value)
        rows = lk.dim.select(*texts, value, order.alias("_o"))
        # Ordering (position, value) pairs keeps a null value that comes last.
        last = F.max(F.struct(F.col("_o"), F.col("_v")))["_v"]
        return rows.groupBy(*names).agg(last.alias("_v"))
    rows = lk.dim.select(*keys, value).dropna(subset=names)
    if lk.unique:
        return rows
    return rows.groupBy(*names).agg(F.max("_v").alias("_v"), F.count(F.lit(1)).alias("_n"))


def join_lookup(df: DataFrame, lk: Lookup, params: Mapping[str, str | Column], out: str) -> DataFrame:
    """``df`` plus ``out``, ``_miss_<out>`` and ``_many_<out>``.

    ``params`` gives the parameter value for each name in ``lk.on``. A null dimension value counts
    as not found, except from a full cache, which remembers it.
    """
    values = {p: F.col(c) if isinstance(c, str) else c for p, c in params.items()}
    left = df.select("*", *[values[p].alias(f"_p{i}") for i, p in enumerate(lk.on)])
    right = dimension(lk)
    names = range(len(lk.on))
    kinds = {f.name: f.dataType.simpleString() for f in left.schema}
    wanted = {f.name: f.dataType.simpleString() for f in right.schema}
    if lk.full_cache:
        left = left.withColumns({f"_p{i}": F.col(f"_p{i}").cast("string") for i in names})
        right = right.withColumn("_found", F.lit(True))
        joined = left.join(right, all_of([F.col(f"_p{i}").eqNullSafe(F.col(f"_k{i}")) for i in names]), "left")
        missing = F.col("_found").isNull()
    else:
        left = left.withColumns({f"_p{i}": as_key(F.col(f"_p{i}"), kinds[f"_p{i}"], wanted[f"_k{i}"]) for i in names})
        joined = join_per_key(left, right, {f"_p{i}": f"_k{i}" for i in names})
        missing = F.col("_v").isNull()
    many = F.coalesce(F.col("_n") > 1, F.lit(False)) if "_n" in right.columns else F.lit(False)
    return joined.select(
        *[F.col(c) for c in df.columns],
        F.when(~many, F.col("_v")).alias(out),
        (missing & ~many).alias(f"_miss_{out}"),
        many.alias(f"_many_{out}"),
    )


def join_new_rows(df: DataFrame, new: DataFrame, lk: Lookup, params: Mapping[str, str | Column], out: str) -> DataFrame:
    """A joined lookup's misses resolved by the dimension rows made for them.

    Rows that were there are found by SQL equality, rows made for a line by its very parameters: a
    null parameter made a row with null and finds it again.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    wanted = {f.name: f.dataType.simpleString() for f in new.schema}
    made = new.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(lk.on.values())], F.col(lk.value).alias("_new"))
    left = df.select("*", *[
        as_key(F.col(params[p]), kinds[params[p]], wanted[c]).alias(f"_p{i}") for i, (p, c) in enumerate(lk.on.items())
    ])
    same = all_of([F.col(f"_p{i}").eqNullSafe(F.col(f"_k{i}")) for i in range(len(lk.on))])
    value = F.when(F.col(f"_miss_{out}"), F.col("_new"))
    return left.join(made, same & F.col(f"_miss_{out}"), "left").select(*[
        F.coalesce(out, value).alias(out) if c == out
        else (F.col(c) & value.isNull()).alias(c) if c == f"_miss_{out}" else F.col(c) for c in df.columns
    ])


def lookup(df: DataFrame, lk: Lookup, out: str, params: Mapping[str, str | Column] | None = None) -> DataFrame:
    """A single lookup over a table: ``df`` plus ``out`` and ``_status``.

    Parameters are columns of ``df`` of the same name unless ``params`` says otherwise.
    """
    return _with_status(join_lookup(df, lk, params or {p: p for p in lk.on}, out), lk, out)


def _with_status(joined: DataFrame, lk: Lookup, out: str) -> DataFrame:
    status = F.when(F.col(f"_many_{out}"), F.lit("parse"))
    if not lk.optional:
        status = status.when(F.col(f"_miss_{out}"), F.lit("integrity"))
    return joined.withColumn("_status", status.otherwise(F.lit("ok"))).drop(f"_miss_{out}", f"_many_{out}")


def chained_lookups(df: DataFrame, steps: Mapping[str, Lookup]) -> DataFrame:
    """Lookups in the given order, each free to use the results before it; the first failure counts."""
    done = df
    status = None
    for out, lk in steps.items():
        done = join_lookup(done, lk, {p: p for p in lk.on}, out)
        failed = F.when(F.col(f"_many_{out}"), F.lit("parse"))
        if not lk.optional:
            failed = failed.when(F.col(f"_miss_{out}"), F.lit("integrity"))
        status = failed if status is None else F.coalesce(status, failed)
    helpers = [c for out in steps for c in (f"_miss_{out}", f"_many_{out}")]
    return done.withColumn("_status", F.coalesce(status, F.lit("ok"))).drop(*helpers)


def deferred_lookups(df: DataFrame, steps: Mapping[str, Lookup], needed: Mapping[str, bool]) -> DataFrame:
    """Staged raw texts resolved set by set, each lookup free to use the ones before it.

    Adds ``_dropped``: whether the row would fall out of the inner joins of the ``needed`` lookups.
    Outer joins with a flag keep every row in place, so no second join has to find the lost ones.
    """
    done = df.withColumn("_dropped", F.lit(False))
    for out, lk in steps.items():
        looked = join_lookup(done, lk, {p: p for p in lk.on}, f"_new_{out}")
        lost = F.col(f"_miss__new_{out}") | F.col(f"_many__new_{out}") if needed.get(out) else F.lit(False)
        done = looked.select(*[
            F.col(f"_new_{out}").alias(out) if c == out else (F.col(c) | lost).alias(c) if c == "_dropped" else F.col(c)
            for c in done.columns
        ])
    return done


def deferred_join(df: DataFrame, steps: Mapping[str, Lookup], needed: Mapping[str, bool]) -> DataFrame:
    """The rows that pass :func:`deferred_lookups`: inner joins for ``needed`` lookups, outer ones else."""
    return deferred_lookups(df, steps, needed).filter(~F.col("_dropped")).drop("_dropped")


def global_flag(
    df: DataFrame, dim: DataFrame, on: Mapping[str, str], flag: str, out: str, params: Mapping[str, str] | None = None
) -> DataFrame:
    """``df`` plus ``out``: whether the parameters hit a dimension row with a true flag."""
    hits = dim.filter(F.col(flag)).select(*on.values()).dropna().distinct().withColumn("_flag", F.lit(True))
    lk = Lookup(hits, dict(on), "_flag", optional=True, unique=True)
    joined = join_lookup(df, lk, params or {p: p for p in on}, out)
    return joined.withColumn(out, F.coalesce(out, F.lit(False))).drop(f"_miss_{out}", f"_many_{out}")


def new_dimension_rows(df: DataFrame, lk: Lookup, params: Mapping[str, str], line: str = "_line_no") -> DataFrame:
    """Dimension rows for the parameters of ``df`` that the dimension lacks.

    Keys continue after the largest one, in the order of the first line that needs them. Parameters
    that are all null or empty make no row. Repeated values shrink to one row before the shuffle.
    The rows are written once: what is joined now and what is added to the dimension later are the
    same rows, and the file is not gone through again for them.
    """
    rule = lk.insert
    cols = list(lk.on.values())
    kinds = {f.name: f.dataType.simpleString() for f in lk.dim.schema}
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    wanted = df.select(
        *[as_key(F.col(params[p]), have[params[p]], kinds[c]).alias(c) for p, c in lk.on.items()],
        F.col(line).alias("_first"),
    )
    wanted = wanted.filter(~all_of([is_empty(F.col(c).cast("string")) for c in cols]))
    distinct = wanted.groupBy(*cols).agg(F.min("_first").alias("_first"))
    # SQL equality: a null parameter matches no row, so it is always a new one.
    missing = distinct.join(lk.dim.select(*cols).dropna().distinct(), cols, "left_anti")
    top = lk.dim.agg(F.coalesce(F.max(rule.key), F.lit(0)).alias("top")).scalar()
    rows = index_by_line(missing, "_first", "_at")
    filled = {rule.key: (top + F.col("_at") + 1).cast(kinds[rule.key])}
    filled.update({c: F.lit(v).cast(kinds[c]) for c, v in rule.constants.items()})
    return materialize(rows.select(
        *[filled[c].alias(c) if c in filled
          else (F.col(c) if c in cols else F.lit(None).cast(kinds[c]).alias(c)) for c in lk.dim.columns]
    ))


def lookup_or_insert(
    df: DataFrame, lk: Lookup, out: str, params: Mapping[str, str] | None = None, line: str = "_line_no"
) -> tuple[DataFrame, DataFrame]:
    """Resolve against the dimension and the rows it is missing; returns (rows, new dimension rows)."""
    given = params or {p: p for p in lk.on}
    new = new_dimension_rows(df, lk, given, line)
    joined = join_new_rows(join_lookup(df, lk, given, out), new, lk, given, out)
    return _with_status(joined, lk, out), new
