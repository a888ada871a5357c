"""Typed value to text, the reverse of :mod:`lineferry.functions.convert`.

A renderer takes the value, the field's width (-1 where it has none), its default and the load's
clock. A null value gives the default as it stands, else a filler the width asks for, else null.
Nothing is cut to the width: a text that is wider stays whole, and the extract rejects its row, as
it does a value that is none of the renderer's type, which comes out as null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lineferry.functions.convert import Context, _line_break_trim, _phone, _phone_prefix, set_renderer

# A date pattern with one of these prints text, otherwise digits; the filler differs.
PATTERN_SIGNS = "-,/ :."


def _text_or_null(s: str | None) -> Column:
    return F.lit(s).cast("string")


def pad(text: Column, width: int) -> Column:
    """Blanks on the right up to the width."""
    return F.when(F.length(text) < width, F.rpad(text, width, " ")).otherwise(text) if width > 0 else text


def pad_left(text: Column, width: int, char: str = "0") -> Column:
    return F.when(F.length(text) < width, F.lpad(text, width, char)).otherwise(text)


@dataclass(frozen=True)
class Renderer:
    """A rendering in stages, each a function of what the one before it gave.

    A stage mentions its argument as often as it likes: an extract works every stage of all its
    fields out once, as columns of their own. ``filler`` gives the text for a null value without a
    default; a stage gives null where the value is not of the renderer's type.
    """

    stages: tuple[Callable[..., Column], ...]
    filler: Callable[..., str | None] = lambda width, **_: None
    absent: Callable[[Column], Column] = Column.isNull
    #: Whether the value or the last stage but one tells that there is nothing to render.
    judged_last: bool = False

    def steps(self, value: Column, width: int, default: str | None, ctx: Context, **args) -> list[Callable[[Column], Column]]:
        """One function a stage; the last one gives the finished text."""
        plain = [lambda c, s=s: s(c, width, ctx, **args) for s in self.stages]
        filler = self.filler(width, **args)

        def finish(c: Column) -> Column:
            nothing = self.absent(c if self.judged_last else value)
            return F.when(nothing, _text_or_null((None if self.judged_last else default) or filler)).otherwise(plain[-1](c))

        return [*plain[:-1], finish]

    def __call__(self, value: Column, width: int, default: str | None, ctx: Context, **args) -> Column:
        out = value
        for step in self.steps(value, width, default, ctx, **args):
            out = step(out)
        return out


def blanks(width: int, **_) -> str | None:
    return " " * width if width > 0 else None


def zeros(width: int, **_) -> str | None:
    return "0" * width if width > 0 else None


def _signed(width: int, positive_sign: str = " ", **_) -> str | None:
    return _sign(positive_sign) + "0" * (width - 1) if width > 0 else None


def _sign(positive_sign: str) -> str:
    return " " if positive_sign.strip().lower() in ("", "space") else positive_sign.strip()


def _padded(text: Column, width: int, ctx: Context, **_) -> Column:
    return pad(text, width)


def _as_text(value: Column, width: int, ctx: Context, **_) -> Column:
    return value.cast("string")


render_text = Renderer((_as_text, _padded), blanks)


def _fill_char(char: str) -> str:
    return (char.strip() or "0")[0]


render_left_trim = Renderer(
    (lambda value, width, ctx, char="0": value, lambda text, width, ctx, char="0": pad_left(text, width, _fill_char(char)) if width > 0 else text),
    lambda width, char="0": _fill_char(char) * width if width > 0 else None, lambda value: F.nullif(value, F.lit("")).isNull(),
)
render_line_break_trim = Renderer((lambda value, width, ctx: _line_break_trim(value, ctx), _padded), blanks, judged_last=True)


def _sign_and_digits(number: Column, digits: Column, positive_sign: str, width: int) -> Column:
    """Without a width there is no sign of its own."""
    if width <= 0:
        return F.struct(F.lit("").alias("sign"), digits.alias("digits"))
    return F.struct(F.when(number < 0, F.lit("-")).otherwise(F.lit(_sign(positive_sign))).alias("sign"), digits.alias("digits"))


def _signed_text(parts: Column, width: int, ctx: Context, **_) -> Column:
    return F.concat(parts["sign"], pad_left(parts["digits"], width - 1)) if width > 0 else parts["digits"]


def _whole(value: Column, width: int, ctx: Context, positive_sign: str = " ") -> Column:
    # As decimal: the smallest long has no positive counterpart.
    number = value.try_cast("decimal(20,0)")
    return number if width > 0 else F.when(number.isNotNull(), value.cast("string"))


def _whole_parts(number: Column, width: int, ctx: Context, positive_sign: str = " ") -> Column:
    return _sign_and_digits(number, F.abs(number).cast("string") if width > 0 else number, positive_sign, width)


render_whole = Renderer((_whole, _whole_parts, _signed_text), _signed)


def _rounded(value: Column, width: int, ctx: Context, decimals: int = 2, positive_sign: str = " ") -> Column:
    number = value.try_cast("decimal(38,18)")
    return F.bround(number, decimals) if width > 0 else F.when(number.isNotNull(), value.cast("string"))


def _amount_parts(rounded: Column, width: int, ctx: Context, decimals: int = 2, positive_sign: str = " ") -> Column:
    digits = F.translate(F.abs(rounded).cast(f"decimal(38,{decimals})").cast("string"), ".", "") if width > 0 else rounded
    if width > 0 and decimals > 0:
        # A number below one has no digit that counts before the point.
        digits = F.when(F.abs(rounded) < 1, F.substring(digits, 2, decimals)).otherwise(digits)
    return _sign_and_digits(rounded, digits, positive_sign, width)


#: Sign and zero-padded digits with the point left out, rounded half to even.
render_currency = Renderer((_rounded, _amount_parts, _signed_text), _signed)


def _date_text(value: Column, width: int, ctx: Context, pattern: str = "yyyyMMdd") -> Column:
    return F.date_format(value.try_cast("timestamp"), pattern)


def _prints_text(pattern: str) -> bool:
    return any(s in pattern for s in PATTERN_SIGNS)


def _date_laid(text: Column, width: int, ctx: Context, pattern: str = "yyyyMMdd") -> Column:
    if width <= 0:
        return text
    return pad(text, width) if _prints_text(pattern) else pad_left(text, width)


render_date = Renderer((_date_text, _date_laid), lambda width, pattern="yyyyMMdd": (blanks if _prints_text(pattern) else zeros)(width))
render_short_date = Renderer((_date_text,), blanks)
render_julian = Renderer((lambda value, width, ctx: _date_text(value, width, ctx, "yyyyDDD"),), zeros)


def _time_text(text: Column, width: int, ctx: Context, pattern: str = "HHmmss") -> Column:
    return F.date_format(F.coalesce(F.try_to_timestamp(text, F.lit("HH:mm:ss")), text.try_cast("timestamp")), pattern)


#: The value is a time of day as text ``HH:mm:ss``, or a timestamp.
render_time = Renderer((_as_text, _time_text), zeros)


def _days(value: Column, width: int, ctx: Context, direction: str) -> Column:
    return F.datediff(value.try_cast("date"), ctx.clock) * F.lit(-1 if direction.upper() == "BACKWARD" else 1)


def _days_parts(days: Column, width: int, ctx: Context, direction: str) -> Column:
    return _sign_and_digits(days, (F.abs(days) if width > 0 else days).cast("string"), " ", width)


#: Days from the run date to the value, counted in the direction of the roll.
render_date_roll = Renderer((_days, _days_parts, _signed_text), zeros)


def _flag(value: Column, width: int, ctx: Context, **_) -> Column:
    return value.try_cast("int")


def _yn_text(flag: Column, width: int, ctx: Context, indicator: str = "Y") -> Column:
    return F.when(flag == 1, F.lit(indicator)).when(flag.isNotNull(), F.lit("N"))


def _side_text(side: Column, width: int, ctx: Context) -> Column:
    return F.when(side == -1, F.lit("D")).when(side == 1, F.lit("C")).when(side.isNotNull(), F.lit(""))


render_yn = Renderer((_flag, _yn_text, _padded), blanks)
#: -1 is D and 1 is C; reading these back does not give the same numbers.
render_debit_credit = Renderer((_flag, _side_text, _padded), blanks)


def _numbered(text: Column, width: int, ctx: Context, length: int = 0) -> Column:
    wide = width if width > 0 else length
    return pad_left(text, wide) if wide > 0 else text


render_running_number = Renderer((_as_text, _numbered), absent=lambda value: F.lit(False))
#: The value is the merged text of already rendered fields.
render_merge = Renderer((lambda value, width, ctx, **_: value, _padded), lambda width, **_: " " + "0" * (width - 1) if width > 0 else None)


def render_phone(value: Column, width: int, default: str | None, ctx: Context, strip=()) -> Column:
    return _phone(value.cast("string"), Context(ctx.row, ctx.clock, default), strip)


def render_phone_prefix(
    value: Column, width: int, default: str | None, ctx: Context, prefix: str = "", strip=()
) -> Column:
    return _phone_prefix(value.cast("string"), Context(ctx.row, ctx.clock, default), prefix, strip)


#: Renderers of a type: no text for a value that is there means that it is no such value.
TYPED = frozenset("integer long currency date timestamp short_date julian_date time date_roll yn_boolean debit_credit".split())

for _name, _renderer in {
    "text": render_text,
    "string": render_text,
    "left_trim": render_left_trim,
    "line_break_trim": render_line_break_trim,
    "integer": render_whole,
    "long": render_whole,
    "currency": render_currency,
    "date": render_date,
    "timestamp": render_date,
    "short_date": render_short_date,
    "julian_date": render_julian,
    "time": render_time,
    "date_roll": render_date_roll,
    "yn_boolean": render_yn,
    "debit_credit": render_debit_credit,
    "running_number": render_running_number,
    "merge_fields": render_merge,
    "phone": render_phone,
    "phone_prefix": render_phone_prefix,
}.items():
    set_renderer(_name, _renderer)
