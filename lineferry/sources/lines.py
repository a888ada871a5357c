"""Text hand-off files as lines: reading, numbering, marks and field texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lineferry.functions.text import any_of, cut, starts_with_any, trim_text
from lineferry.session import BROADCAST_BYTES
from lineferry.spec import DELIMITED, FIXED, XML, Field, LoadSpec

LINE, LINE_NO = "value", "_line_no"
XML_TEXT = "_x_"
#: Text of an XML record that is not well-formed; no tag holds a blank.
XML_CORRUPT = "_corrupt record"

_NAMED_DELIMITERS = {"SPACE": " ", "TAB": "\t"}


def read_lines(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8") -> DataFrame:
    """One row per line. Other encodings must keep the line feed a single byte of its own, so that
    the file stays splittable; their bytes are decoded line by line."""
    lines = spark.read.text(path)
    if encoding.upper().replace("-", "") == "UTF8":
        return lines
    return lines.withColumn(LINE, F.decode(F.col(LINE).cast("binary"), encoding))


def with_line_no(lines: DataFrame, out: str = LINE_NO, per_file: bool = False) -> DataFrame:
    """Number lines from 1 in file order; a folder of files is numbered through in name order
    unless ``per_file`` restarts the count.

    ``lines`` must come straight from a file scan. Each split counts its lines; what precedes a
    split is a running sum over the splits before it. Their number is known from the scan, so the
    table of offsets is broadcast only when it is small for certain.
    """
    seen = lines.select(
        *lines.columns,
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
    )
    splits = seen.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    order = W.partitionBy("_file").orderBy("_block") if per_file else W.orderBy("_file", "_block")
    before = F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, -1))
    offsets = splits.select("_file", "_block", (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    # A whole split fills a scan partition; only the last piece of a file may share one.
    most_splits = lines.rdd.getNumPartitions() + len(lines.inputFiles())
    if most_splits * 512 <= BROADCAST_BYTES:
        offsets = F.broadcast(offsets)
    return seen.join(offsets, ["_file", "_block"]).select(
        *lines.columns, (F.col("_id") + F.col("_shift")).alias(out)
    )


def is_mark(spec: LoadSpec, line: str = LINE) -> Column:
    """Whether a line is a header or trailer; XML records never are."""
    if spec.kind == XML:
        return F.lit(False)
    return starts_with_any(F.col(line), [*spec.headers, *spec.trailers])


def split_marks(lines: DataFrame, headers=(), trailers=(), line: str = LINE) -> DataFrame:
    """Tag each line ``header``, ``trailer`` or ``data`` in ``_mark``."""
    mark = (
        F.when(starts_with_any(F.col(line), headers), F.lit("header"))
        .when(starts_with_any(F.col(line), trailers), F.lit("trailer"))
        .otherwise(F.lit("data"))
    )
    return lines.withColumn("_mark", mark)


def delimiter_text(delimiter: str) -> str:
    """``SPACE``, ``TAB``, an ASCII code, or the text itself."""
    if delimiter.upper() in _NAMED_DELIMITERS:
        return _NAMED_DELIMITERS[delimiter.upper()]
    if delimiter.isdigit() and len(delimiter) > 1:
        return chr(int(delimiter))
    return delimiter


def delimited_parts(line: Column, delimiter: str) -> Column:
    """The parts of a line up to its last non-empty one; the delimiter is literal, without quoting."""
    text = delimiter_text(delimiter)
    pattern = re.escape(text)
    if len(text) == 1:
        used = F.rtrim(line, F.lit(text))
    else:
        used = F.regexp_replace(line, f"(?:{pattern})+$", "")
    return F.split(used, pattern, -1)


def field_text(spec: LoadSpec, f: Field, line: str = LINE, parts: str = "_parts") -> Column:
    """Raw text of one field: empty for a field without a location, null where the record ends early.

    A fixed-width field needs no padding of the line: cut and trimmed text is the same either way.
    """
    if spec.kind == XML:
        return F.col(XML_TEXT + f.tag) if f.tag else F.lit("")
    if f.start == 0:
        return F.lit("")
    if spec.kind == FIXED:
        return trim_text(cut(F.col(line), f.start, f.end))
    return F.get(F.col(parts), f.start - 1)


def too_short(spec: LoadSpec, f: Field, line: str = LINE) -> Column | None:
    """Without padding, a line that ends inside the field cannot be parsed."""
    if spec.kind == FIXED and not spec.pad and f.start > 0:
        return F.length(F.col(line)) < f.end
    return None


def field_texts(lines: DataFrame, spec: LoadSpec, prefix: str = "") -> DataFrame:
    """``lines`` plus one raw text column per field, all in one projection."""
    source = lines
    if spec.kind == DELIMITED:
        source = lines.withColumn("_parts", delimited_parts(F.col(LINE), spec.delimiter))
    texts = [field_text(spec, f).alias(prefix + f.name) for f in spec.fields]
    kept = [F.col(c) for c in lines.columns]
    return source.select(*kept, *texts)


def read_fixed(lines: DataFrame, spec: LoadSpec) -> DataFrame:
    """Field texts of the data lines of a fixed-width file; short lines only when padding is on."""
    short = [c for c in (too_short(spec, f) for f in spec.fields) if c is not None]
    data = lines.filter(~is_mark(spec) & ~any_of(short))
    return field_texts(data, spec).drop(LINE)


def read_delimited(lines: DataFrame, spec: LoadSpec) -> DataFrame:
    """Field texts of the data lines of a delimited file."""
    return field_texts(lines.filter(~is_mark(spec)), spec).drop(LINE)
