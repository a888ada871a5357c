"""Text helpers shared by scans, conversions and renderers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character up to and including the blank, the set that trimming strips on both ends.
TRIMMED_CHARS = "".join(map(chr, range(33)))


def trim_text(c: Column) -> Column:
    """Strip blanks and control characters on both ends.

    The plain trim takes the blanks, which are nearly all there is, at a fraction of the cost of the
    set trim; that one then has nothing left to walk over.
    """
    return F.trim(F.trim(c), F.lit(TRIMMED_CHARS))


def is_blank(c: Column) -> Column:
    """True for null, empty or only blanks."""
    return c.isNull() | (trim_text(c) == "")


def is_empty(c: Column) -> Column:
    return c.isNull() | (c == "")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def starts_with_any(c: Column, marks) -> Column:
    return any_of([c.startswith(m) for m in marks])


def cut(c: Column, start: int, end: int) -> Column:
    """Characters ``start``..``end``, 1-based and inclusive."""
    return F.substring(c, start, end - start + 1)


def padded_cut(c: Column, start: int, end: int) -> Column:
    """As :func:`cut` on a line blank-padded to ``end``."""
    return F.rpad(cut(c, start, end), end - start + 1, " ")
