"""Fill-in-middle transformation by a counted-quantifier regular expression.

A text is a sequence of units, here lines. ``regexp_count`` gives how many there are, two cuts between
units are drawn, and a pattern made for the row matches the whole text once: a possessive ``unit{a}``
is the prefix, a possessive ``unit{b-a}`` the middle, and what follows the suffix. The replacement of
that one match writes the three groups between markers in the order asked for. Possessive quantifiers
repeat in a loop and never give back, so that a text of any number of lines takes neither stack nor
backtracking. Everything is a DataFrame function; rows never leave their task.

A null text counts as empty. An empty text, one that holds a marker, and one that is not drawn stay
``plain``: the output is the text. A null key draws as the text ``7:`` alone. Repeated rows, ties and
empty tables need no care, as every row is judged for itself. Other columns are passed through; the
columns of the result (``n, form, prefix_chars, middle_chars, output``) replace those of the input whose
names differ from theirs in upper and lower case alone, and working columns have names that no input
column has.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineferry.llm.common import named, unused

#: One line with its line feed, or the last one without.
LINE = r"[^\n]*\n|[^\n]+"
#: The most repetitions that a quantifier can state.
MOST = (1 << 31) - 1
RESULT = ("n", "form", "prefix_chars", "middle_chars", "output")


@dataclass(frozen=True)
class Infill:
    """Hundredths of texts that are transformed, and of those that start with the suffix; the draw's seed; the markers."""

    rate: int = 100
    spm: int = 50
    seed: str = "7:"
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    unit: str = LINE

    def __post_init__(self) -> None:
        markers = (self.prefix, self.suffix, self.middle)
        if any(set(m) & set("\\$") or not m for m in markers):
            raise ValueError("markers hold no backslash or dollar sign and are not empty")
        # Else a marker could come about where one meets the text beside it.
        if any(m in o for m, o in permutations(markers, 2)) or any(m[-k:] == o[:k] for m in markers for o in markers for k in range(1, min(len(m), len(o)))):
            raise ValueError("no marker holds another or ends as one begins")


def draws(key: Column, seed: str) -> list[Column]:
    """Four numbers below 2**32: the first four groups of eight hexadecimal digits of a row's SHA-256."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def fill_in_middle(docs: DataFrame, how: Infill = Infill(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``n`` (units), ``form`` (plain, psm, spm), ``prefix_chars``, ``middle_chars`` and ``output``."""
    work = unused(docs, "text", "n", "cuts", "digits", "form", "out")
    whole, n = F.col(work["text"]), F.col(work["n"])
    # Each step leaves a one-element generator: as plain columns they would be computed again wherever used.
    step = docs.select("*", F.inline(F.array(F.struct(F.coalesce(named(text), F.lit("")).alias(work["text"])))))
    h1, h2, h3, h4 = draws(named(key), how.seed)
    count = F.regexp_count(whole, F.lit(f"(?:{how.unit})")).cast("bigint")
    drawn = F.struct(count.alias(work["n"]), F.array(h1, h2, h3, h4).alias(work["digits"]))
    step = step.select("*", F.inline(F.array(drawn)))
    h = [F.col(work["digits"])[i] for i in range(4)]
    marked = F.lit(False)
    for m in (how.prefix, how.suffix, how.middle):
        marked = marked | whole.contains(m)
    plain = (whole == "") | marked | (h[2] % 100 >= how.rate) | (n > MOST)
    form = F.when(plain, "plain").when(h[3] % 100 < how.spm, "spm").otherwise("psm")
    cuts = F.array(h[0] % (n + 1), h[1] % (n + 1))
    step = step.select("*", F.inline(F.array(F.struct(form.alias(work["form"]), F.array_sort(cuts).alias(work["cuts"])))))
    form, a, b = F.col(work["form"]), F.col(work["cuts"])[0], F.col(work["cuts"])[1]
    pattern = F.concat(
        F.lit(f"(?s)\\A((?:{how.unit}){{"), a.cast("string"), F.lit(f"}}+)((?:{how.unit}){{"), (b - a).cast("string"), F.lit("}+)(.*)"),
    )
    psm, spm = f"{how.prefix}$1{how.suffix}$3{how.middle}$2", f"{how.suffix}$3{how.prefix}$1{how.middle}$2"
    output = F.when(form == "plain", whole).otherwise(F.regexp_replace(whole, pattern, F.when(form == "psm", psm).otherwise(spm)))
    step = step.select("*", F.inline(F.array(F.struct(output.alias(work["out"])))))
    out = F.col(work["out"])
    # Markers stand in the output once each, so their places give the parts' lengths.
    p, s, m = (F.instr(out, x) for x in (how.prefix, how.suffix, how.middle))
    prefix = F.when(form == "psm", s - p - len(how.prefix)).when(form == "spm", m - p - len(how.prefix)).cast("bigint")
    middle = F.when(form != "plain", F.length(out) - m - (len(how.middle) - 1)).cast("bigint")
    kept = [named(c) for c in docs.columns if c.lower() not in RESULT]
    return step.select(*kept, n.alias("n"), form.alias("form"), prefix.alias("prefix_chars"), middle.alias("middle_chars"), out.alias("output"))


def restore(output: Column, form: Column, how: Infill = Infill()) -> Column:
    """The text that an output of :func:`fill_in_middle` was made from."""
    p, s, m = (F.instr(output, x) for x in (how.prefix, how.suffix, how.middle))

    def between(start: Column, marker: str, end: Column) -> Column:
        return F.substring(output, start + len(marker), end - start - len(marker))

    end = F.length(output) + 1
    psm = F.concat(between(p, how.prefix, s), between(m, how.middle, end), between(s, how.suffix, m))
    spm = F.concat(between(p, how.prefix, m), between(m, how.middle, end), between(s, how.suffix, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
