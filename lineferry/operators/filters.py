"""Row filters on field texts and values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lineferry.functions.text import any_of, is_empty, trim_text

NULL, NOT_NULL = "NULL", "NOT_NULL"


def _same_text(text: Column, value: str) -> Column:
    return F.coalesce(F.upper(trim_text(text)) == value.upper(), F.lit(False))


def text_is_null(text: Column, nulls) -> Column:
    missing = is_empty(text)
    return missing | text.isin(list(nulls)) if nulls else missing


def value_filter(text: Column, values, nulls=()) -> Column:
    """Keep when the raw text is one of ``values``, blanks and case aside.

    The ``NULL`` and ``NOT_NULL`` tokens decide at once: values after them are not looked at.
    """
    met = F.lit(False)
    for v in reversed(list(values)):
        if v.upper() == NULL:
            met = text_is_null(text, nulls)
        elif v.upper() == NOT_NULL:
            met = ~text_is_null(text, nulls)
        else:
            met = _same_text(text, v) | met
    return F.coalesce(met, F.lit(False))


def rendered_filter(text: Column, values, nulls=()) -> Column:
    """As :func:`value_filter` on rendered text, except that a token that fails lets the next
    value try."""
    tests = []
    for v in values:
        if v.upper() == NULL:
            tests.append(text_is_null(text, nulls))
        elif v.upper() == NOT_NULL:
            tests.append(~text_is_null(text, nulls))
        tests.append(_same_text(text, v))
    return F.coalesce(any_of(tests), F.lit(False))


def cross_field_match(value: Column, others: list[tuple[Column, bool]]) -> Column:
    """Whether ``value`` equals any other field's value, null equal to null.

    Each other value says whether it has the same type; values of different types only agree on null.
    """
    return any_of([value.eqNullSafe(o) if same else value.isNull() & o.isNull() for o, same in others])
