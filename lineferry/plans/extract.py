"""The extract side: query rows in, hand-off lines out.

A row whose value is not of its field's type, or whose text is wider than its field, is counted as
``unknown`` with a reason; the others are written.

``render_rows`` judges and renders every row in place; ``extract_lines`` lays the good ones out.
Neither shuffles: lookups apart, an extract is one projection over its source.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineferry.functions.convert import Context, conversion, merged
from lineferry.functions.render import TYPED, Renderer
from lineferry.operators.filters import rendered_filter
from lineferry.operators.lookup import join_lookup
from lineferry.operators.position import index_by_line, index_by_order
from lineferry.session import drop, materialize_counted
from lineferry.sources.lines import delimiter_text
from lineferry.spec import DELIMITED, FIXED, KEY_VALUE, XML, ExtractSpec, Field, SpecError, lookup_order

OK, FILTERED, INTEGRITY, UNKNOWN = "ok", "filtered", "integrity", "unknown"
MERGE = "merge_fields"


def take_skip(df: DataFrame, *order: str | Column, fetch: int, skip: int = 0, line: str | None = None) -> DataFrame:
    """Keep ``fetch`` rows, drop ``skip``, and so on, in the given order; all rows without a skip.

    ``line`` names a unique whole-number column to order by, which needs no global sort.
    """
    if skip <= 0:
        return df
    placed = index_by_line(df, line, "_at") if line else index_by_order(df, *order, out="_at")
    return placed.filter(F.col("_at") % (fetch + skip) < fetch).drop("_at")


def render_steps(f: Field, value: Column, width: int, ctx: Context) -> list[Callable[[Column], Column]]:
    """What makes a field's text of its value, one function after the other."""
    to_text = conversion(f.conversion).to_text
    if to_text is None:
        raise SpecError(f"conversion {f.conversion!r} of field {f.name!r} cannot be reversed")
    if isinstance(to_text, Renderer):
        return to_text.steps(value, width, f.default, ctx, **f.args)
    return [lambda v: to_text(v, width, f.default, ctx, **f.args)]


def _steps(spec: ExtractSpec, f: Field, row: dict[str, Column]) -> list[Callable[[Column], Column]]:
    # A field without an explicit conversion is text, also when a lookup supplies it.
    field = f if f.convert is not None else Field(**{**f.__dict__, "convert": "text", "lookup": None})
    return render_steps(field, row[f.name], spec.width(f), Context(row, spec.clock, f.default))


def _with_texts(df: DataFrame, steps: dict[str, list[Callable[[Column], Column]]], values: dict[str, Column], prefix: str) -> DataFrame:
    """``df`` with each field's text as ``prefix + name``.

    All fields take a step together, and each step leaves a one-element generator: what it gives is
    then a column that the next may use many times, where a projection would be folded into the next
    one and be worked out again for every use.
    """
    at = dict(values)
    for k in range(max(map(len, steps.values()), default=0)):
        made = {n: s[k](at[n]).alias(f"{prefix}{k}_{n}") for n, s in steps.items() if k < len(s)}
        df = df.select("*", F.inline(F.array(F.struct(*made.values()))))
        at |= {n: F.col(f"{prefix}{k}_{n}") for n in made}
    last = {f"{prefix}{len(s) - 1}_{n}": prefix + n for n, s in steps.items()}
    return df.select(*[c for c in df.columns if not c.startswith(prefix)], *[F.col(c).alias(n) for c, n in last.items()])


def _faults(f: Field, value: Column, text: Column, width: int) -> Column:
    """Why the rendered text cannot be written; null where it can."""
    reason = F.when(F.length(text) > width, F.lit(f"{f.name}: does not fit")) if width > 0 else F.lit(None).cast("string")
    if f.convert in TYPED:
        reason = F.when(value.isNotNull() & text.isNull(), F.lit(f"{f.name}: not a valid {f.convert}")).otherwise(reason)
    return reason


def render_rows(rows: DataFrame, spec: ExtractSpec, line: str | None = None) -> DataFrame:
    """Rows with each field rendered, plus ``_status`` and ``_reason``; ``line`` (unique numbers) is
    kept and is what running numbers follow."""
    df = rows
    order = [f for f in lookup_order(spec.fields) if f.name not in rows.columns]
    for f in order:
        df = join_lookup(df, f.lookup, {p: p for p in f.lookup.on}, f.name)
    failed = F.lit(None).cast("string")
    for f in order:
        bad = F.col(f"_many_{f.name}")
        if not f.lookup.optional:
            bad = bad | F.col(f"_miss_{f.name}")
        failed = F.coalesce(failed, F.when(bad, F.lit(f"{f.name}: lookup value missing or ambiguous")))
    numbered = [f for f in spec.fields if conversion(f.conversion).positional]
    kept = [line] if line else []
    df = df.withColumn("_failed", failed)
    if numbered:
        if not line:
            raise SpecError("running numbers need the unique line column of the source")
        df = index_by_line(df, line, "_number", F.col("_failed").isNull()).withColumn("_number", F.col("_number") + 1)
    row = {c: F.col(c) for c in df.columns}
    for f in spec.fields:
        if f in numbered:
            row[f.name] = F.col("_number")
        elif f.name not in row:
            row[f.name] = F.lit(None).cast("string")

    plain = [f for f in spec.fields if f.conversion != MERGE]
    late = [f for f in spec.fields if f.conversion == MERGE]
    names = {f.name for f in spec.fields}
    parts = {n for f in late for n in f.args.get("fields", ()) if n not in names}
    done = _with_texts(df, {f.name: _steps(spec, f, row) for f in plain}, row, "_text_")
    texts = {f.name: F.col(f"_text_{f.name}") for f in plain}
    faults = [_faults(f, row[f.name], texts[f.name], spec.width(f)).alias(f"_fault_{f.name}") for f in plain]
    done = done.select(
        *kept, "_failed", *[texts[f.name].alias(f.name) for f in plain], *[F.col(n) for n in sorted(parts)], *faults,
        *[F.lit(None).cast("string").alias(f.name) for f in late],
    )
    for f in late:
        # One after the other: a merged field may be part of the next.
        text = merged([F.col(n).cast("string") for n in f.args["fields"]], f.args.get("delimiter", " "))
        done = done.drop(f.name).select("*", F.inline(F.array(F.struct(text.alias("_merged")))))
        merging = {**row, f.name: F.col("_merged")}
        done = _with_texts(done, {f.name: _steps(spec, f, merging)}, merging, "_text_").withColumnRenamed(f"_text_{f.name}", f.name).drop("_merged")
    # The first field in order that cannot be written, or is filtered, decides.
    outcome = F.struct(F.lit(OK).alias("_status"), F.lit(None).cast("string").alias("_reason"))
    for f in reversed([*plain, *late]):
        if f.filter_values:
            kept_out = ~rendered_filter(F.col(f.name), f.filter_values, f.nulls)
            outcome = F.when(kept_out, F.struct(F.lit(FILTERED).alias("_status"), F.lit(f"{f.name}: value filter").alias("_reason"))).otherwise(outcome)
        fault = F.col(f"_fault_{f.name}") if f in plain else _faults(f, F.lit(None), F.col(f.name), spec.width(f))
        outcome = F.when(fault.isNotNull(), F.struct(F.lit(UNKNOWN).alias("_status"), fault.alias("_reason"))).otherwise(outcome)
    failed = F.struct(F.lit(INTEGRITY).alias("_status"), F.col("_failed").alias("_reason"))
    outcome = F.when(F.col("_failed").isNotNull(), failed).otherwise(outcome)
    return done.select(*kept, *[f.name for f in spec.fields], F.inline(F.array(outcome)))


def fixed_line(spec: ExtractSpec) -> Column:
    """Texts laid over a blank record, each padded to its place; null prints blanks. Wider texts never get here."""
    fields = spec.layout_fields
    end = max(f.end for f in spec.fields)
    pieces: list[Column] = []
    at = 1
    overlaid = []
    for f in fields:
        if f.start < at:
            overlaid.append(f)
            continue
        if f.start > at:
            pieces.append(F.lit(" " * (f.start - at)))
        pieces.append(F.rpad(F.coalesce(F.col(f.name), F.lit("")), f.width, " "))
        at = f.end + 1
    if at <= end:
        pieces.append(F.lit(" " * (end - at + 1)))
    line = F.concat(*pieces)
    for f in overlaid:
        line = F.overlay(line, F.rpad(F.coalesce(F.col(f.name), F.lit("")), f.width, " "), f.start, f.width)
    return line


def delimited_line(spec: ExtractSpec, keyed: bool = False) -> Column:
    """Field n after n-1 delimiters; null prints nothing, there is no quoting."""
    gap = delimiter_text(spec.delimiter)
    pieces: list[Column] = []
    written = 0
    for f in spec.layout_fields:
        lead = gap * max(f.start - 1 - written, 0)
        written = max(written, f.start - 1)
        if keyed:
            lead += f.name.lower() + "="
        if lead:
            pieces.append(F.lit(lead))
        pieces.append(F.coalesce(F.col(f.name), F.lit("")))
    return F.concat(*pieces)


def xml_line(spec: ExtractSpec) -> Column:
    """One record element per line; null prints an empty element."""
    pieces: list[Column] = [F.lit(f"\t<{spec.record_tag}>")]
    for f in spec.layout_fields:
        tag = f.tag or f.name
        text = F.replace(F.replace(F.col(f.name), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
        pieces += [F.lit(f"<{tag}>"), F.coalesce(text, F.lit("")), F.lit(f"</{tag}>")]
    return F.concat(*pieces, F.lit(f"</{spec.record_tag}>"))


def layout(spec: ExtractSpec) -> Column:
    if spec.kind == FIXED:
        return fixed_line(spec)
    if spec.kind == XML:
        return xml_line(spec)
    return delimited_line(spec, keyed=spec.kind == KEY_VALUE)


def extract_lines(rows: DataFrame, spec: ExtractSpec, line: str | None = None) -> DataFrame:
    """The lines of the rows that pass, as column ``value``, beside ``line`` when given."""
    good = render_rows(rows, spec, line).filter(F.col("_status") == OK)
    return good.select(*([line] if line else []), layout(spec).alias("value"))


def _filled(template: str, spec: ExtractSpec) -> Column:
    """The template with its placeholders filled; ``{count}`` comes from the column ``_count``."""
    text = F.lit(template)
    values = {
        "{start}": F.date_format(spec.clock, "yyyy-MM-dd HH:mm:ss"),
        "{name}": F.lit(spec.name),
        "{definition}": F.lit(spec.definition),
        "{count}": F.col("_count").cast("string"),
    }
    for place, value in values.items():
        if place in template:
            text = F.replace(text, F.lit(place), value)
    return text


def _head(spec: ExtractSpec) -> str | None:
    return f"<{spec.root_tag}>" if spec.kind == XML else spec.header


def _foot(spec: ExtractSpec) -> str | None:
    return f"</{spec.root_tag}>" if spec.kind == XML else spec.footer


def with_header_footer(lines: DataFrame, spec: ExtractSpec, line: str = "_line_no") -> DataFrame:
    """Header, lines and footer in one table, ordered by ``_part`` (0, 1, 2) and ``line``.

    An XML extract has its root tag there. The footer's record count is a second, pruned pass, as
    nothing is written here; :func:`run_extract` counts while it writes.
    """
    body = lines.select(F.lit(1).alias("_part"), line, "value")
    out = body
    kind = dict(lines.dtypes)[line]
    for part, template in ((0, _head(spec)), (2, _foot(spec))):
        if template:
            counted = (
                lines.agg(F.count(F.lit(1)).alias("_count")) if "{count}" in template
                else lines.sparkSession.range(1).select(F.lit(None).cast("bigint").alias("_count"))
            )
            out = out.unionByName(counted.select(
                F.lit(part).alias("_part"), F.lit(None).cast(kind).alias(line), _filled(template, spec).alias("value")
            ))
    return out


def write_extract(lines: DataFrame, path: str, line: str = "_line_no") -> None:
    """Write header, body and footer as text in order; one file per sorted range."""
    order = [c for c in ("_part", line) if c in lines.columns]
    lines.orderBy(*order).select("value").write.mode("overwrite").text(path)


def _counters() -> dict[str, Column]:
    statuses = {"written": OK, "filtered": FILTERED, "integrity": INTEGRITY, "unknown": UNKNOWN}
    return {"records": F.count(F.lit(1)), **{n: F.count_if(F.col("_status") == s) for n, s in statuses.items()}}


def run_extract(rows: DataFrame, spec: ExtractSpec, path: str, line: str = "_line_no") -> dict[str, int]:
    """Write the extract of ``rows`` under ``path`` and return its counters (see :func:`extract_summary`).

    The rows are read, rendered and counted once, while their lines go to the shared folder; the
    footer's record count and the summary come from that. Header, body and footer are folders whose
    names are in order, so ``path`` read recursively in name order is the file.
    """
    laid = render_rows(rows, spec, line).select(line, "_status", F.when(F.col("_status") == OK, layout(spec)).alias("value"))
    body, counts = materialize_counted(laid, _counters())
    body.filter(F.col("_status") == OK).orderBy(line).select("value").write.mode("overwrite").text(f"{path}/1-body")
    drop(body)
    for folder, template in (("0-header", _head(spec)), ("2-footer", _foot(spec))):
        if template:
            counted = rows.sparkSession.range(1).select(F.lit(counts["written"]).alias("_count"))
            counted.select(_filled(template, spec).alias("value")).write.mode("overwrite").text(f"{path}/{folder}")
    return counts


def extract_summary(rendered: DataFrame) -> DataFrame:
    """One row of counters over rendered rows."""
    return rendered.agg(*[c.alias(n) for n, c in _counters().items()])
