"""Staged loads: fixed-width staging lines, and the set-based merge of the staged rows.

Nothing is cut to its place. Text and amounts need a width, from the field's place in the file or
stated as its ``size``; a value that does not fit rejects its row with a reason.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineferry.functions.convert import conversion
from lineferry.functions.render import pad, pad_left
from lineferry.operators.lookup import deferred_lookups
from lineferry.operators.merge import target_presence
from lineferry.session import drop, materialize
from lineferry.spec import INSERT, MIXED, Field, LoadSpec, SpecError, lookup_order

LINE_WIDTH = 14
# Widths and layouts of staged values by type; fixed values of the staging format.
STAGED_WIDTH = {"int": 14, "bigint": 20, "boolean": 1, "timestamp": 26, "date": 10}
TIMESTAMP_LAYOUT = "yyyy-MM-dd-HH.mm.ss.SSSSSS"


def _summed(f: Field, spec: LoadSpec) -> Field:
    names = f.args.get("fields")
    return spec.field(names[-1]) if f.conversion == "currency_sum" and names else f


def staged_type(f: Field) -> str:
    """Type a field is staged as; a deferred lookup is still raw text."""
    if f.lookup is not None and f.lookup.deferred:
        return "string"
    return conversion(f.conversion).spark_type(**f.args)


def staged_width(f: Field, spec: LoadSpec) -> int:
    kind = staged_type(f)
    if kind in STAGED_WIDTH:
        return STAGED_WIDTH[kind]
    width = (_summed(f, spec) if kind.startswith("decimal") else f).width
    if width <= 0:
        raise SpecError(f"field {f.name!r} has no width: state its size to stage it")
    return width + 1 if kind.startswith("decimal") else width


def _plain_decimal(value: Column) -> Column:
    """Decimal text without trailing zeros and without a zero before the point."""
    text = F.regexp_replace(value.cast("string"), r"(\.[0-9]*?)0+$", "$1")
    text = F.regexp_replace(F.regexp_replace(text, r"\.$", ""), r"^(-?)0\.", "$1.")
    return F.when(value == 0, F.lit("0")).otherwise(text)


def _staged_text(f: Field, width: int) -> Column:
    kind, value = staged_type(f), F.col(f.name)
    if kind in ("int", "bigint"):
        return pad_left(value.cast("string"), width)
    if kind == "boolean":
        return F.when(value, F.lit("1")).otherwise(F.lit("0"))
    if kind == "timestamp":
        return F.date_format(value, TIMESTAMP_LAYOUT)
    if kind == "date":
        return F.date_format(value, "yyyy-MM-dd")
    if kind.startswith("decimal"):
        return pad_left(_plain_decimal(value), width, " ")
    return pad(value.cast("string"), width)


def staged_value(text: Column, width: int) -> Column:
    """``N`` and the value's text in its fixed width, or ``Y`` and blanks for null."""
    return F.when(text.isNull(), F.lit("Y" + " " * width)).otherwise(F.concat(F.lit("N"), text))


def staged_rows(rows: DataFrame, spec: LoadSpec, line: str = "_line_no") -> DataFrame:
    """Per good row its staging line ``value``, or null with status ``unknown`` and the first reason.

    The texts leave a generator of one element, so each is made once, not again for its length and
    for the line.
    """
    widths = {f"_text_{i}": staged_width(f, spec) for i, f in enumerate(spec.fields)}
    made = [F.when(F.col(f.name).isNotNull(), _staged_text(f, w)).alias(t) for f, (t, w) in zip(spec.fields, widths.items(), strict=True)]
    number = pad_left(F.col(line).cast("string"), LINE_WIDTH).alias("_number")
    texts = rows.select(line, F.inline(F.array(F.struct(number, *made))))
    reason = F.when(F.length("_number") > LINE_WIDTH, F.lit("line number: does not fit"))
    for f, (t, w) in zip(spec.fields, widths.items(), strict=True):
        reason = reason.when(F.length(t) > w, F.lit(f"{f.name}: does not fit"))
    text = F.concat("_number", *[staged_value(F.col(t), w) for t, w in widths.items()])
    outcome = F.struct(reason.alias("_reason"), text.alias("_text"))
    status = F.when(F.col("_reason").isNull(), F.lit("ok")).otherwise(F.lit("unknown"))
    return texts.select(line, F.inline(F.array(outcome))).select(
        line, F.when(F.col("_reason").isNull(), F.col("_text")).alias("value"), status.alias("_status"), "_reason"
    )


def stage_lines(rows: DataFrame, spec: LoadSpec, line: str = "_line_no") -> DataFrame:
    """One staging line per good row that fits, in column ``value``, its line number kept beside it."""
    return staged_rows(rows, spec, line).where("_status = 'ok'").select(line, "value")


def _resolved(rows: DataFrame, spec: LoadSpec) -> DataFrame:
    steps = {f.name: f.lookup for f in lookup_order(spec.fields) if f.lookup.deferred}
    return deferred_lookups(rows, steps, {n: spec.field(n).key or not spec.field(n).optional for n in steps})


def staged_merge(rows: DataFrame, target: DataFrame, spec: LoadSpec) -> DataFrame:
    """Staged rows with their deferred lookups resolved and ``_loaded``: I, U, or N where a lookup
    of a key or required field found nothing."""
    done = _resolved(rows, spec)
    mark = F.lit("I" if spec.mode == INSERT else "U")
    if spec.mode == MIXED:
        done = target_presence(done, target, spec.keys)
        mark = F.when(F.col("_action") == "update", F.lit("U")).otherwise(F.lit("I"))
    return done.select(*rows.columns, F.when(F.col("_dropped"), F.lit("N")).otherwise(mark).alias("_loaded"))


def staged_unloaded(rows: DataFrame, spec: LoadSpec, line: str = "_line_no") -> DataFrame:
    """Numbers of the staged lines that are not loaded."""
    return _resolved(rows, spec).filter("_dropped").select(line)


@dataclass(frozen=True)
class StagedLoad:
    """A staged merge whose lookups were resolved once, into a table in the shared folder."""

    report: DataFrame
    line: str

    @property
    def unloaded(self) -> DataFrame:
        """Numbers of the staged lines that are not loaded."""
        return self.report.filter("_loaded = 'N'").select(self.line)

    def drop(self) -> None:
        """Deletes the table; ``report`` and ``unloaded`` cannot be read any more."""
        drop(self.report)


def staged_load(rows: DataFrame, target: DataFrame, spec: LoadSpec, line: str = "_line_no") -> StagedLoad:
    """:func:`staged_merge` and :func:`staged_unloaded` of one resolution, which is written once."""
    return StagedLoad(materialize(staged_merge(rows, target, spec)), line)
