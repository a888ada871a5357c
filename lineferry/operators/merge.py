"""Writing a load into its target: insert, update, mixed, refresh, generated keys, side tables.

Every function returns the target's next snapshot as a DataFrame. The target side is never
grouped or sorted: it is joined once to one row per key of the load, which Spark broadcasts when
the load is small. Lines of one key shrink to the last one before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineferry.functions.text import all_of, any_of
from lineferry.operators.joins import join_per_key, rows_with_key
from lineferry.operators.position import index_by_line
from lineferry.session import materialize
from lineferry.spec import INSERT, MIXED, UPDATE, Field, LoadSpec, SpecError

INSERTED, UPDATED = "insert", "update"


def target_schema(spec: LoadSpec) -> str:
    """DDL of the target: the generated key first, then the written fields."""
    from lineferry.functions.convert import conversion

    cols = [f"{spec.generated_key} bigint not null"] if spec.generated_key else []
    for f in spec.fields:
        if f.external:
            continue
        kind = "bigint" if f.lookup is not None and f.convert is None else conversion(f.conversion).spark_type(**f.args)
        if kind.startswith("decimal"):
            scale = max(6, f.args.get("decimals", 2))
            kind = f"decimal({min(_money_width(f, spec) + scale, 38)},{scale})"
        cols.append(f"{f.name} {kind}" + ("" if f.optional else " not null"))
    return ", ".join(cols)


def _money_width(f: Field, spec: LoadSpec) -> int:
    """Text width of an amount; a sum takes the width of its last field, one more for the point."""
    summed = f.args.get("fields")
    source = spec.field(summed[-1]) if f.conversion == "currency_sum" and summed else f
    if source.width <= 0:
        raise SpecError(f"amount {source.name!r} has no width: state its size")
    return source.width + 1


def _null_key(keys: list[str]) -> Column:
    return any_of([F.col(k).isNull() for k in keys])


def _keyed(rows: DataFrame, keys: list[str], line: str) -> DataFrame:
    """A null key equals no other, so such a line stands for itself: ``_own`` tells them apart."""
    return rows.withColumn("_own", F.when(_null_key(keys), F.col(line)))


def last_per_key(rows: DataFrame, keys: list[str], line: str = "_line_no", largest: list[str] | None = None) -> DataFrame:
    """The last line of every key; columns in ``largest`` take their largest value instead.

    Partial aggregation keeps one row per key and task, so a key with any number of lines costs no
    more than another.
    """
    largest = largest or []
    rest = [c for c in rows.columns if c not in keys and c != line and c not in largest]
    last = F.max_by(F.struct(*[F.col(c) for c in rest], F.lit(0).alias("_pad")), F.col(line)).alias("_last")
    grouped = _keyed(rows, keys, line).groupBy(*keys, "_own").agg(
        last, F.max(line).alias(line), *[F.max(c).alias(c) for c in largest]
    )
    return grouped.select(*[F.col(f"_last.{c}").alias(c) if c in rest else F.col(c) for c in rows.columns])


def _renamed(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.select(*[F.col(c).alias(prefix + c) for c in rows.columns])


def target_keys(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct target keys that the load touches. Filtering before the distinct means that a small
    load never shuffles the target."""
    kinds = {f.name: f.dataType for f in target.schema}
    wanted = rows.select(*[F.col(k).try_cast(kinds[k]).alias(k) for k in keys]).dropna().distinct()
    return rows_with_key(target.select(*keys), wanted, keys).distinct()


def target_presence(rows: DataFrame, target: DataFrame, keys: list[str], null_safe: bool = False) -> DataFrame:
    """``rows`` plus ``_action``: update when the target has the key, insert otherwise.

    ``null_safe`` compares keys as text with null equal to null, as a preloaded row cache does.
    """
    cols = [f"_k{i}" for i in range(len(keys))]
    if null_safe:
        here = target.select(*[F.col(k).cast("string").alias(c) for k, c in zip(keys, cols)]).distinct()
        same = all_of([F.col(k).cast("string").eqNullSafe(F.col(c)) for k, c in zip(keys, cols)])
        joined = rows.join(here.withColumn("_there", F.lit(True)), same, "left")
    else:
        here = target_keys(target, rows, keys).toDF(*cols).withColumn("_there", F.lit(True))
        joined = join_per_key(rows, here, dict(zip(keys, cols)))
    action = F.when(F.col("_there"), F.lit(UPDATED)).otherwise(F.lit(INSERTED))
    return joined.select(*rows.columns, action.alias("_action"))


def merge_plan(rows: DataFrame, target: DataFrame, keys: list[str], mode: str = MIXED, line: str = "_line_no") -> DataFrame:
    """``rows`` plus the ``_action`` each line would take, lines of one key in file order: the first
    line of a new key inserts, every later one updates what it inserted."""
    if mode != MIXED:
        return rows.withColumn("_action", F.lit(INSERTED if mode == INSERT else UPDATED))
    cols = [f"_k{i}" for i in range(len(keys))]
    firsts = (
        rows.dropna(subset=keys).groupBy(*keys).agg(F.min(line).alias("_first"))
        .join(target_keys(target, rows, keys).withColumn("_there", F.lit(True)), keys, "left")
        .select(*[F.col(k).alias(c) for k, c in zip(keys, cols)], "_first", "_there")
    )
    joined = join_per_key(rows, firsts, dict(zip(keys, cols)))
    again = F.coalesce(F.col("_there"), F.lit(False)) | F.coalesce(F.col(line) > F.col("_first"), F.lit(False))
    return joined.select(*rows.columns, F.when(again, F.lit(UPDATED)).otherwise(F.lit(INSERTED)).alias("_action"))


def merge_counts(plan: DataFrame) -> DataFrame:
    return plan.agg(
        F.count_if(F.col("_action") == INSERTED).alias("inserted"),
        F.count_if(F.col("_action") == UPDATED).alias("updated"),
    )


def with_generated_key(plan: DataFrame, target: DataFrame, column: str = "ID", line: str = "_line_no", top: int | None = None) -> DataFrame:
    """The next key values for inserting lines, in line order; updating lines get none.

    ``top`` is the largest value given so far, where ``target`` is not all there is.
    """
    top = target.agg(F.coalesce(F.max(column), F.lit(0)).alias("top")).scalar() if top is None else F.lit(top)
    placed = index_by_line(plan, line, "_at", F.col("_action") == INSERTED)
    return placed.withColumn(column, (top + F.col("_at") + 1).cast("bigint")).drop("_at")


def _as_target(source: DataFrame, target: DataFrame, columns: list[str]) -> DataFrame:
    """Source rows in the target's columns and types; columns the load does not write are null."""
    return source.select(*[
        (F.col(f.name) if f.name in columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in target.schema
    ])


def insert_rows(target: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """Target plus every row."""
    return target.unionByName(_as_target(rows, target, columns))


def update_rows(
    target: DataFrame, rows: DataFrame, keys: list[str], columns: list[str],
    line: str = "_line_no", condition: Column | None = None,
) -> DataFrame:
    """Target with non-key columns set, also to null, where a row has the key. Rows without a match
    change nothing. ``condition`` may use target columns and ``_src_`` columns."""
    changed = [c for c in columns if c not in keys and c in target.columns]
    kinds = {f.name: f.dataType for f in target.schema}
    typed = rows.select(line, *[F.col(k).try_cast(kinds[k]).alias(k) for k in keys], *changed)
    source = _renamed(last_per_key(typed.dropna(subset=keys), keys, line), "_src_").withColumn("_hit", F.lit(True))
    joined = join_per_key(target, source, {k: f"_src_{k}" for k in keys}, condition)
    return joined.select(*[
        F.when(F.col("_hit"), F.col(f"_src_{f.name}").cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name)
        if f.name in changed else F.col(f.name)
        for f in target.schema
    ])


def upsert_rows(
    target: DataFrame, rows: DataFrame, keys: list[str], columns: list[str],
    line: str = "_line_no", generated_key: str | None = None,
) -> DataFrame:
    """Update the keys the target has, insert the others; the last line of a key wins.

    With ``generated_key`` the rows carry it (see :func:`with_generated_key`); a key inserted and
    then updated in the same load keeps the value of its first line.
    """
    written = [c for c in columns if c != generated_key]
    updated = update_rows(target, rows, keys, written, line)
    made = [generated_key] if generated_key else []
    # Only the inserting line of a key carries a generated value, so the largest is the one.
    fresh = last_per_key(rows.select(line, *written, *made), keys, line, largest=made)
    fresh = fresh.join(target_keys(target, rows, keys), keys, "left_anti")
    return updated.unionByName(_as_target(fresh, target, [*written, *made]))


def merge(
    target: DataFrame, rows: DataFrame, spec: LoadSpec, line: str = "_line_no", top: int | None = None
) -> DataFrame:
    """The target after loading ``rows`` (the good rows of a routed file) in the spec's mode."""
    gen = spec.generated_key
    if spec.mode == UPDATE:
        return update_rows(target, rows, spec.keys, spec.written, line)
    if gen:
        # Written once: the steps below read these rows several times.
        rows = materialize(with_generated_key(merge_plan(rows, target, spec.keys, spec.mode, line), target, gen, line, top))
    if spec.mode == INSERT:
        return insert_rows(target, rows, [*spec.written, *([gen] if gen else [])])
    return upsert_rows(target, rows, spec.keys, spec.written, line, gen)


def refresh_delete(target: DataFrame, where: Column | None = None) -> DataFrame:
    """Target before the load with all rows, or those meeting ``where``, removed."""
    return target.filter(F.lit(False) if where is None else ~F.coalesce(where, F.lit(False)))


def refresh_update(target: DataFrame, values: Mapping[str, Column], where: Column | None = None) -> DataFrame:
    """Target before the load with columns set on all rows, or those meeting ``where``."""
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    return target.select(*[
        F.when(hit, values[f.name].cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name)
        if f.name in values else F.col(f.name)
        for f in target.schema
    ])


def post_insert_rows(side: DataFrame, plan: DataFrame, action: str, values: Mapping[str, Column]) -> DataFrame:
    """Side table plus one row per line that took ``action``, built from the line's columns."""
    made = plan.filter(F.col("_action") == action).select(*[v.alias(c) for c, v in values.items()])
    return side.unionByName(_as_target(made, side, list(values)))


def post_update_rows(
    side: DataFrame, plan: DataFrame, action: str, on: Mapping[str, str], values: Mapping[str, Column],
    line: str = "_line_no",
) -> DataFrame:
    """Side table updated from the lines that took ``action``; ``on`` maps side to line columns."""
    made = plan.filter(F.col("_action") == action).select(
        line, *[F.col(c).alias(k) for k, c in on.items()], *[v.alias(c) for c, v in values.items()]
    )
    return update_rows(side, made, list(on), list(values), line)
