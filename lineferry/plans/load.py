"""The load side: lines in, one lazy table of typed and judged rows out.

Nothing is dropped on the way. ``route`` keeps every line with its number, typed columns, status
and reason; the sinks, the reject output and the summary are filters and aggregates over it.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineferry.functions.convert import conversion, convert_field, null_default
from lineferry.functions.text import all_of
from lineferry.operators.filters import cross_field_match, value_filter
from lineferry.operators.lookup import global_flag, join_lookup, join_new_rows, new_dimension_rows
from lineferry.operators.merge import merge, merge_plan
from lineferry.operators.position import index_by_line
from lineferry.session import configure, drop, materialize, materialize_counted
from lineferry.sources.lines import LINE, LINE_NO, XML_CORRUPT, field_texts, is_mark, too_short
from lineferry.spec import XML, Field, LoadSpec, Lookup, is_own_text, lookup_order

OK, HEADER_TRAILER, FILTERED, PARSE, INTEGRITY, UNKNOWN = (
    "ok", "header_trailer", "filtered", "parse", "integrity", "unknown",
)
REJECTED = (PARSE, INTEGRITY, UNKNOWN)

_TEXT, _SELF, _BAD = "_t_", "_s_", "_bad_"


class _Verdict:
    """Checks in the order they apply; the first one met names the row's status and reason."""

    def __init__(self) -> None:
        self._checks: list[tuple[Column, str, str]] = []

    def add(self, when: Column, status: str, reason: str) -> None:
        self._checks.append((when, status, reason))

    def column(self) -> Column:
        def outcome(status: str, reason: str) -> Column:
            return F.struct(F.lit(status).alias("_status"), F.lit(reason or None).cast("string").alias("_reason"))

        case = None
        for when, status, reason in self._checks:
            case = (F.when if case is None else case.when)(when, outcome(status, reason))
        return outcome(OK, "") if case is None else case.otherwise(outcome(OK, ""))


def text_checks(spec: LoadSpec, verdict: _Verdict) -> None:
    """Marks, then per field, in field order: too short, value filter."""
    if spec.kind == XML:
        verdict.add(F.col(XML_CORRUPT).isNotNull(), PARSE, "record is not well-formed")
    verdict.add(F.col("_mark"), HEADER_TRAILER, "header or trailer")
    for f in spec.fields:
        short = too_short(spec, f)
        if short is not None:
            verdict.add(short, PARSE, f"{f.name}: line too short")
        if f.filter_values and not f.filter_fields:
            met = value_filter(F.col(_TEXT + f.name), f.filter_values, f.nulls)
            verdict.add(~met, FILTERED, f"{f.name}: value filter")


def _bad_checks(fields: list[Field], have: set[str], verdict: _Verdict) -> None:
    for f in fields:
        if _BAD + f.name in have:
            verdict.add(F.col(_BAD + f.name), UNKNOWN, f"{f.name}: not a valid {f.conversion}")


def _lookup_checks(fields: list[Field], verdict: _Verdict) -> None:
    for f in fields:
        verdict.add(F.col(f"_many_{f.name}"), PARSE, f"{f.name}: lookup is ambiguous")
        if not f.lookup.optional:
            verdict.add(F.col(f"_miss_{f.name}"), INTEGRITY, f"{f.name}: lookup value missing")


def _with_parents(f: Field, spec: LoadSpec, found: list[Field]) -> list[Field]:
    for parent in spec.fields:
        if parent.name in f.lookup.on and parent is not f and parent.lookup is not None:
            _with_parents(parent, spec, found)
    if f not in found:
        found.append(f)
    return found


def _data_only(value: Column, spec: LoadSpec) -> Column:
    """Marks hold no fields: their columns stay null and they look nothing up."""
    return F.when(~F.col("_mark"), value) if spec.headers or spec.trailers else value


def typed_rows(lines: DataFrame, spec: LoadSpec) -> DataFrame:
    """Lines with their mark, raw texts, converted direct fields and self parameters of lookups."""
    texts = field_texts(lines.withColumn("_mark", is_mark(spec)), spec, _TEXT)
    row = {f.name: F.col(_TEXT + f.name) for f in spec.fields}
    # A projection of its own: conversions look at their text several times.
    filled = texts.select("*", *[
        _data_only(null_default(row[f.name], f.nulls, f.default), spec).alias(_SELF + f.name) for f in spec.fields
    ])
    out = []
    for f in spec.fields:
        if f.lookup is None:
            done = convert_field(f, F.col(_SELF + f.name), row, spec.clock)
            out.append(_data_only(done.value, spec).alias(f.name))
            if done.bad is not None:
                out.append(F.coalesce(done.bad, F.lit(False)).alias(_BAD + f.name))
    return filled.select("*", *out)


def _params(f: Field, spec: LoadSpec) -> Mapping[str, str]:
    """Columns holding a lookup's parameters: its own text, or another field's value."""
    names = {x.name for x in spec.fields}
    return {p: _SELF + f.name if p == f.name or is_own_text(p, names) else p for p in f.lookup.on}


def _cross_checks(spec: LoadSpec, have: set[str], resolved: list[Field], kinds: Mapping, verdict: _Verdict, early: bool) -> None:
    """Per cross-field filter, in field order: what its fields need, then the filter itself.

    ``early`` leaves out filters that wait for a lookup which is still to be made.
    """
    for f in spec.fields:
        if not f.filter_fields:
            continue
        others = [spec.field(n) for n in f.filter_fields]
        if early and any(x.lookup is not None and x not in resolved for x in [f, *others]):
            continue
        _bad_checks([x for x in [f, *others] if x.lookup is None], have, verdict)
        for x in [f, *others]:
            if x in resolved:
                _lookup_checks([p for p in _with_parents(x, spec, []) if p in resolved], verdict)
        same = cross_field_match(F.col(f.name), [(F.col(o.name), kinds[o.name] == kinds[f.name]) for o in others])
        if f.filter_values:
            same = same | value_filter(F.col(_TEXT + f.name), f.filter_values, f.nulls)
        verdict.add(~same, FILTERED, f"{f.name}: matches none of {', '.join(f.filter_fields)}")


def _kinds(df: DataFrame) -> dict:
    return {c.name: c.dataType for c in df.schema}


def _early_verdict(df: DataFrame, spec: LoadSpec, have: set[str], resolved: list[Field]) -> Column:
    """What is known before a lookup; decides which rows may add dimension rows."""
    early = _Verdict()
    text_checks(spec, early)
    _cross_checks(spec, have, resolved, _kinds(df), early, early=True)
    _bad_checks([f for f in spec.fields if f.lookup is None], have, early)
    for g in spec.filters:
        early.add(F.col(f"_g_{g.name}"), FILTERED, g.name)
    _lookup_checks(resolved, early)
    return early.column()["_status"]


def _filters_first(spec: LoadSpec) -> list[Field]:
    """Lookups in dependency order, those that a cross-field filter waits for before the others."""
    first: list[Field] = []
    for f in spec.fields:
        for x in [f, *[spec.field(n) for n in f.filter_fields]] if f.filter_fields else []:
            if x.lookup is not None:
                _with_parents(x, spec, first)
    return [*first, *[f for f in lookup_order(spec.fields) if f not in first]]


def route_with_inserts(
    lines: DataFrame, spec: LoadSpec, defer: bool = False
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """``route`` plus, per inserting lookup field, the new rows of its dimension."""
    configure(lines.sparkSession)
    df = typed_rows(lines, spec)
    for g in spec.filters:
        df = global_flag(df, g.dim, g.on, g.flag, f"_g_{g.name}")
    have = set(df.columns)
    order = _filters_first(spec)
    if any(f.lookup.insert is not None and not (defer and f.lookup.deferred) for f in order):
        # What a new dimension row is made from and the rows themselves: the file is parsed once.
        df = materialize(df)
    new_rows: dict[str, DataFrame] = {}
    resolved: list[Field] = []
    for f in order:
        if defer and f.lookup.deferred:
            df = df.withColumn(f.name, F.col(_TEXT + f.name))
            continue
        lk: Lookup = f.lookup
        params = _params(f, spec)
        if lk.insert is None:
            df = join_lookup(df, lk, params, f.name)
        else:
            reach = _early_verdict(df, spec, have, resolved) == OK
            new_rows[f.name] = new_dimension_rows(df.filter(reach), lk, params, LINE_NO)
            df = join_new_rows(join_lookup(df, lk, params, f.name), new_rows[f.name], lk, params, f.name)
        resolved.append(f)

    verdict = _Verdict()
    text_checks(spec, verdict)
    _cross_checks(spec, have, resolved, _kinds(df), verdict, early=False)
    _bad_checks([f for f in spec.fields if f.lookup is None], have, verdict)
    for g in spec.filters:
        verdict.add(F.col(f"_g_{g.name}"), FILTERED, f"global filter {g.name}")
    _lookup_checks(resolved, verdict)
    for f in spec.fields:
        if not f.optional and not conversion(f.conversion).positional:
            verdict.add(F.col(f.name).isNull(), PARSE, f"{f.name}: required")

    # The verdict comes out of a one-element generator. As a plain column, a later filter on the
    # status would be pushed below it and repeat the parsing of a field for every check on it.
    routed = df.select(LINE, LINE_NO, *[f.name for f in spec.fields], F.inline(F.array(verdict.column())))
    for f in spec.fields:
        if conversion(f.conversion).positional and f.lookup is None:
            routed = index_by_line(routed.drop(f.name), LINE_NO, "_at", F.col("_status") == OK).select(
                *[(F.col("_at") + 1).alias(c) if c == f.name else F.col(c) for c in routed.columns]
            )
    return routed, new_rows


def route(lines: DataFrame, spec: LoadSpec, defer: bool = False) -> DataFrame:
    """Every line with ``_line_no``, its typed fields, ``_status`` and ``_reason``.

    ``lines`` has a text column ``value`` and a unique ``_line_no``. With ``defer`` the deferred
    lookups keep their raw text for :mod:`lineferry.operators.stage`.
    """
    return route_with_inserts(lines, spec, defer)[0]


@dataclass(frozen=True)
class LoadResult:
    """A load that has been judged: the written routed rows, and what follows from them, still lazy."""

    routed: DataFrame
    plan: DataFrame
    target: DataFrame
    summary: DataFrame
    rejects: DataFrame
    new_dimension_rows: Mapping[str, DataFrame]

    def drop(self) -> None:
        """Delete the tables that the load wrote between its steps; its results cannot be read after that."""
        for table in (self.routed, *self.new_dimension_rows.values()):
            drop(table)


def load(lines: DataFrame, spec: LoadSpec, target: DataFrame) -> LoadResult:
    """Route a file and merge it into ``target``.

    The routed rows feed the merge, the rejects and the summary, so they are written once to the
    shared folder; the file is parsed and its lookups are made a single time.
    """
    routed, new_rows = route_with_inserts(lines, spec)
    # What the load counts is counted while its rows are written.
    routed, counts = materialize_counted(routed, _counters())
    rows = loaded(routed, spec)
    counted = lines.sparkSession.range(1).select(*[F.lit(n).cast("bigint").alias(c) for c, n in counts.items()])
    return LoadResult(
        routed, merge_plan(rows, target, spec.keys, spec.mode), merge(target, rows, spec), _summary(counted),
        rejects(routed), new_rows,
    )


def loaded(routed: DataFrame, spec: LoadSpec) -> DataFrame:
    """The good rows: line number and all fields, external ones included."""
    return routed.filter(F.col("_status") == OK).select(LINE_NO, *[f.name for f in spec.fields])


def external_columns(rows: DataFrame, spec: LoadSpec) -> DataFrame:
    """Rows as they are written: external fields left out."""
    return rows.drop(*[f.name for f in spec.fields if f.external])


def rejects(routed: DataFrame, with_filtered: bool = True) -> DataFrame:
    """Lines that were not loaded, with number, status and reason."""
    wanted = [*REJECTED, FILTERED] if with_filtered else list(REJECTED)
    return routed.filter(F.col("_status").isin(wanted)).select(LINE_NO, "_status", "_reason", LINE)


def write_rejects(routed: DataFrame, path: str, with_filtered: bool = True) -> None:
    """Reject lines under ``path``, one folder per status."""
    rejects(routed, with_filtered).write.mode("overwrite").partitionBy("_status").json(path)


def _counters() -> dict[str, Column]:
    statuses = {s: F.count_if(F.col("_status") == s) for s in (HEADER_TRAILER, PARSE, FILTERED, INTEGRITY, UNKNOWN)}
    return {"all_lines": F.count(F.lit(1)), **statuses, "loaded": F.count_if(F.col("_status") == OK)}


def _summary(counted: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    ineligible = F.col(FILTERED) + F.col(HEADER_TRAILER)
    return counted.select(
        "all_lines", HEADER_TRAILER, PARSE, FILTERED, INTEGRITY, UNKNOWN,
        zero.alias("too_long"), zero.alias("commit_failed"),
        ineligible.alias("ineligible"), (F.col("all_lines") - ineligible).alias("eligible"), "loaded",
    )


def load_summary(routed: DataFrame) -> DataFrame:
    """One row of counters. Lines that fit no row-level failure of a file load count as zero."""
    return _summary(routed.agg(*[c.alias(n) for n, c in _counters().items()]))


def required_fields(rows: DataFrame, names: list[str]) -> DataFrame:
    """Status of rows against columns that must not be null."""
    return rows.withColumn(
        "_status", F.when(all_of([F.col(n).isNotNull() for n in names]), F.lit(OK)).otherwise(F.lit(PARSE))
    )
