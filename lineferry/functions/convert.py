"""Text to typed value: one Column expression per conversion.

A conversion takes the field's text and a :class:`Context` and returns the value and, where bad
text is an error rather than a null, a condition telling so. :func:`convert_field` adds the rules
all of them share: null text is replaced by the default, and a null result is tried again on it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from lineferry.functions.text import TRIMMED_CHARS, is_blank, is_empty, trim_text



def null_text() -> Column:
    return F.lit(None).cast("string")


@dataclass(frozen=True)
class Context:
    """What a conversion may look at beside its own text."""

    row: Mapping[str, Column]
    clock: Column
    default: str | None = None


@dataclass(frozen=True)
class Converted:
    value: Column
    bad: Column | None = None


@dataclass(frozen=True)
class Conversion:
    name: str
    to_value: Callable[..., Converted]
    spark_type: Callable[..., str]
    to_text: Callable[..., Column] | None = None
    own_default: bool = False
    positional: bool = False


_REGISTRY: dict[str, Conversion] = {}


def register_conversion(
    name: str,
    to_value: Callable[..., Column | Converted],
    to_text: Callable[..., Column] | None = None,
    spark_type: str | Callable[..., str] = "string",
    own_default: bool = False,
    positional: bool = False,
) -> Conversion:
    """Add a conversion under ``name``.

    ``to_value(text, ctx, **args)`` returns a Column or :class:`Converted`; ``to_text(value, width,
    default, ctx, **args)`` renders it for an extract. Both build expressions, so a user may call a
    pandas UDF in them. ``own_default`` keeps the default rule out of the caller's hands.
    """

    def wrapped(text: Column, ctx: Context, **args: Any) -> Converted:
        out = to_value(text, ctx, **args)
        return out if isinstance(out, Converted) else Converted(out)

    kind = spark_type if callable(spark_type) else (lambda **_: spark_type)
    _REGISTRY[name] = Conversion(name, wrapped, kind, to_text, own_default, positional)
    return _REGISTRY[name]


def conversion(name: str) -> Conversion:
    try:
        return _REGISTRY[name]
    except KeyError:
        from lineferry.spec import SpecError

        raise SpecError(f"no such conversion {name!r}; known: {', '.join(sorted(_REGISTRY))}") from None


def set_renderer(name: str, to_text: Callable[..., Column]) -> None:
    old = conversion(name)
    _REGISTRY[name] = Conversion(name, old.to_value, old.spark_type, to_text, old.own_default, old.positional)


def null_default(text: Column, nulls, default: str | None) -> Column:
    """Null, empty or exactly one of ``nulls`` becomes the default."""
    missing = is_empty(text)
    if nulls:
        missing = missing | text.isin(list(nulls))
    return F.when(missing, F.lit(default).cast("string")).otherwise(text)


def convert_field(f, text: Column, row: Mapping[str, Column], clock: Column) -> Converted:
    """Typed value of a field from its text, nulls already replaced, and the raw texts of its row."""
    conv = conversion(f.conversion)
    ctx = Context(row, clock, f.default)
    first = conv.to_value(text, ctx, **f.args)
    if f.default is None or conv.own_default:
        return first
    again = conv.to_value(F.lit(f.default), ctx, **f.args)
    value = F.coalesce(first.value, again.value)
    if first.bad is None:
        return Converted(value)
    return Converted(value, F.coalesce(first.bad, F.lit(False)) | (first.value.isNull() & F.coalesce(again.bad, F.lit(False))))


# --- text -----------------------------------------------------------------------------------------


def _text(text: Column, ctx: Context) -> Column:
    return F.nullif(text, F.lit(""))


def _string(text: Column, ctx: Context) -> Column:
    return F.when(~is_blank(text), text)


def _left_trim(text: Column, ctx: Context, char: str = "0") -> Column:
    return F.ltrim(text, F.lit((char.strip() or "0")[0]))


def _line_break_trim(text: Column, ctx: Context) -> Column:
    # translate maps the line feed to a blank and drops the carriage return, which has no partner.
    return F.when(~is_blank(text), trim_text(F.translate(text, "\n\r", " ")))


# --- numbers --------------------------------------------------------------------------------------

# Casting bad text is far dearer than looking at it first, so every cast is guarded by a pattern.
_WHOLE = "^[+-]?[0-9]+$"


def _whole(text: Column, spark_type: str, blank: Column) -> Converted:
    number = F.when(text.rlike(_WHOLE), text.try_cast(spark_type))
    return Converted(number, number.isNull() & ~blank)


def _integer(text: Column, ctx: Context, positive_sign: str = " ") -> Converted:
    return _whole(text, "int", is_blank(text))


def _long(text: Column, ctx: Context, positive_sign: str = " ") -> Converted:
    return _whole(text, "bigint", is_blank(text))


def _integer_div(text: Column, ctx: Context, by: int = 1) -> Converted:
    if by == 0:
        raise ValueError("integer_div does not accept zero")
    whole = _whole(text, "int", is_empty(text))
    n = whole.value.cast("bigint")
    # Less its remainder the number is a multiple, so the division is exact and truncates to zero.
    return Converted(((n - n % F.lit(by)) / F.lit(by)).try_cast("int"), whole.bad)


# An amount: a whole number, a minus in front or behind, plus signs counting as blanks.
_AMOUNT = r"^[\x00-\x20+]*(-?[0-9]+|[\x00-\x20+-]*[0-9]+[\x00-\x20+-]*-)[\x00-\x20+]*$"
# The same with a point and an exponent allowed, for amounts without implied decimals.
_DECIMAL_AMOUNT = _AMOUNT.replace("[0-9]+", r"(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE]-?[0-9]+)?")
_AMOUNT_FILL = "-+" + TRIMMED_CHARS


def _currency(text: Column, ctx: Context, decimals: int = 2, positive_sign: str = " ") -> Column:
    if decimals == 0:
        t = trim_text(F.translate(text, "+", " "))
        t = F.when(t.endswith("-"), F.concat(F.lit("-"), trim_text(F.translate(t, "-", " ")))).otherwise(t)
        return F.when(text.rlike(_DECIMAL_AMOUNT), t.try_cast("decimal(38,18)"))
    # In an amount a minus only stands at either end, so its presence is the sign.
    signed = F.concat(F.when(text.contains("-"), F.lit("-")).otherwise(F.lit("")), F.translate(text, _AMOUNT_FILL, ""))
    cents = F.when(text.rlike(_AMOUNT), signed.try_cast("bigint"))
    # A decimal product is exact where a division would round to the engine's result scale.
    unit = F.lit("0." + "0" * (decimals - 1) + "1").cast(f"decimal({decimals + 1},{decimals})")
    return (cents.cast("decimal(19,0)") * unit).cast(f"decimal(38,{decimals})")


def _currency_type(decimals: int = 2, **_: Any) -> str:
    return f"decimal(38,{decimals or 18})"


def _currency_sum(text: Column, ctx: Context, fields=(), decimals: int = 2) -> Column:
    if not fields:
        return _currency(text, ctx, decimals)
    parts = [ctx.row[n] for n in fields] + [text]
    kind = _currency_type(decimals)
    total = F.lit(0).cast(kind)
    empty = F.lit(True)
    for p in parts:
        total = (total + F.coalesce(_currency(p, ctx, decimals), F.lit(0).cast(kind))).cast(kind)
        empty = empty & is_empty(p)
    return F.when(~empty, total)


def _debit_credit(text: Column, ctx: Context) -> Column:
    credit = F.coalesce(F.upper(trim_text(text)) == "C", F.lit(False))
    return F.when(credit, F.lit(-1)).otherwise(F.lit(1))


def _yn(text: Column, ctx: Context, indicator: str = "Y") -> Column:
    return F.coalesce(F.upper(text) == indicator.upper(), F.lit(False))


# --- dates and times ------------------------------------------------------------------------------


def _no_date(text: Column, pattern: str) -> Column:
    """Zeros stand for no date. Blank text needs no check of its own: it is no date either way."""
    return text.contains("0" * len(pattern))


def _timestamp(text: Column, ctx: Context, pattern: str = "yyyyMMdd") -> Column:
    return (
        F.when(F.upper(text) == "CURRENT_DATE", ctx.clock)
        .when(_no_date(text, pattern), F.lit(None).cast("timestamp"))
        .otherwise(F.try_to_timestamp(text, F.lit(pattern)))
    )


def _date(text: Column, ctx: Context, pattern: str = "yyyyMMdd") -> Column:
    return _timestamp(text, ctx, pattern).cast("date")


def _short_date(text: Column, ctx: Context, pattern: str = "yyyyMMdd") -> Column:
    missing = F.greatest(F.ceil((F.lit(len(pattern)) - F.length(text)) / F.lit(2)), F.lit(0)).cast("int")
    return (
        F.when(F.upper(text) == "CURRENT_DATE", ctx.clock)
        .when(_no_date(text, pattern), F.lit(None).cast("timestamp"))
        .otherwise(F.try_to_timestamp(F.concat(text, F.repeat(F.lit("01"), missing)), F.lit(pattern)))
    )


def _century_date(
    text: Column, ctx: Context, pattern: str = "yyyyMMdd", minimum: str | None = None, other: str | None = None
) -> Column:
    day = _timestamp(text, ctx, pattern)
    if minimum is not None:
        floor = F.try_to_timestamp(F.lit(minimum), F.lit(pattern))
    elif other is not None:
        floor = _timestamp(ctx.row[other], ctx, pattern)
    else:
        return day
    return F.when(day < floor, F.timestamp_add("YEAR", F.lit(100), day)).otherwise(day)


def _julian_date(text: Column, ctx: Context) -> Converted:
    none = is_blank(text) | (text == "0000000")
    day = F.try_to_timestamp(text, F.lit("yyyyDDD"))
    return Converted(F.when(~none, day), ~none & day.isNull())


def _date_roll(text: Column, ctx: Context, direction: str) -> Converted:
    days = _whole(text, "int", is_empty(text))
    sign = -1 if direction.upper() == "BACKWARD" else 1
    return Converted(F.timestamp_add("DAY", days.value * F.lit(sign), ctx.clock), days.bad)


def _time(text: Column, ctx: Context, pattern: str = "HHmmss") -> Column:
    shown = "HH:mm:ss"
    return (
        F.when(F.upper(text) == "CURRENT_TIME", F.date_format(ctx.clock, shown))
        .when(_no_date(text, pattern), null_text())
        .otherwise(F.date_format(F.try_to_timestamp(text, F.lit(pattern)), shown))
    )


# --- several fields, phone numbers ----------------------------------------------------------------


def merged(texts: list[Column], delimiter: str) -> Column:
    """Texts joined by ``delimiter``; a null drops out together with the delimiter after it."""
    last = len(texts) - 1
    parts = [
        F.coalesce(t if i == last else F.concat(t, F.lit(delimiter)), F.lit("")) for i, t in enumerate(texts)
    ]
    return F.nullif(F.concat(*parts), F.lit(""))


def _merge_fields(text: Column, ctx: Context, fields=(), delimiter: str = " ") -> Column:
    default = F.lit(ctx.default).cast("string")
    if not fields:
        return default
    return F.coalesce(merged([ctx.row[n] for n in fields], delimiter), default)


def longest_digits(text: Column) -> Column:
    """The first longest run of digits once signs are removed.

    Null when letters but no digits remain, empty when nothing remains.
    """
    word = F.regexp_replace(text, r"\W", "")
    runs = F.regexp_extract_all(word, F.lit("([0-9]+)"), F.lit(1))
    longest = F.aggregate(runs, F.lit(""), lambda best, r: F.when(F.length(r) > F.length(best), r).otherwise(best))
    return F.when(word == "", word).otherwise(F.nullif(longest, F.lit("")))


def _phone(text: Column, ctx: Context, strip=()) -> Column:
    number = longest_digits(text)
    for p in strip:
        if p.strip():
            # A number that is nothing but the prefix ends up empty, and no later prefix can match.
            number = F.when(number.startswith(p), F.substring(number, len(p) + 1, 2**31 - 1)).otherwise(number)
    return F.when(text.isNull(), F.lit(ctx.default).cast("string")).otherwise(number)


def _phone_prefix(text: Column, ctx: Context, prefix: str = "", strip=()) -> Column:
    number = _phone(text, ctx, strip)
    return F.when(number != "", F.concat(F.lit(prefix), number)).otherwise(number)


def _running_number(text: Column, ctx: Context, length: int = 0) -> Column:
    # Numbered by the plan over the surviving rows; see operators.position.
    return F.lit(None).cast("bigint")


register_conversion("text", _text)
register_conversion("string", _string)
register_conversion("left_trim", _left_trim)
register_conversion("line_break_trim", _line_break_trim)
register_conversion("integer", _integer, spark_type="int")
register_conversion("long", _long, spark_type="bigint")
register_conversion("integer_div", _integer_div, spark_type="int")
register_conversion("currency", _currency, spark_type=_currency_type)
register_conversion("currency_sum", _currency_sum, spark_type=lambda decimals=2, **_: _currency_type(decimals))
register_conversion("debit_credit", _debit_credit, spark_type="int")
register_conversion("yn_boolean", _yn, spark_type="boolean")
register_conversion("timestamp", _timestamp, spark_type="timestamp")
register_conversion("date", _date, spark_type="date")
register_conversion("short_date", _short_date, spark_type="timestamp")
register_conversion("century_date", _century_date, spark_type="timestamp")
register_conversion("julian_date", _julian_date, spark_type="timestamp")
register_conversion("date_roll", _date_roll, spark_type="timestamp")
register_conversion("time", _time)
register_conversion("merge_fields", _merge_fields, own_default=True)
register_conversion("phone", _phone, own_default=True)
register_conversion("phone_prefix", _phone_prefix, own_default=True)
register_conversion("running_number", _running_number, spark_type="bigint", positional=True)
