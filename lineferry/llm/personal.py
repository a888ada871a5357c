r"""Personal data by bootstrapped contextual extraction, with DataFrame functions alone.

Four kinds of identifiers are sought: e-mail and network addresses, card and phone numbers. A strict
form of each kind, checked by its digits, gives the seeds. A wide form gives candidates: addresses
with ``[at]`` and ``dot`` spelled out, numbers parted otherwise or run into their neighbours. Each
occurrence has up to four lexical patterns: the word before it, the two words before, the word behind,
and its own shape (digits as 9, letters as a). Patterns and instances (kind and value) make a graph:

* a pattern's confidence in a kind is what its instances of the kind are believed, summed, out of all
  of its instances; patterns with too few believed instances or too little confidence say nothing;
* an instance of the strict form is believed wholly, any other as the noisy-or of its patterns.

Both are worked out in turn for some rounds, so that instances found by one pattern lend belief to
others. Candidates believed enough are added to what the strict forms found. Candidates that meet a
strict occurrence are none. An instance counts once for a pattern however many copies show it.

Every step is an aggregation or an equi-join on patterns, instances or texts, each written to the shared
folder. A hot pattern is summed in its tasks before it is exchanged; only unsure instances, not all
texts, go through the rounds, and rows of texts meet their additions in a join that can be split.

A null text counts as empty and has nothing. What is found depends on a row's text alone, so repeated
rows and rows of one or no id are each given the same. Ties of places go by the kinds' order. An empty
table gives an empty one. The result has the input's columns but for the text; ``base`` and ``added``
of the input are replaced, whatever their case.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineferry.llm.common import materialize, named, unused
from lineferry.session import drop

KINDS = ("email", "ip", "card", "phone")
#: Strict forms. Quantifiers that never have to give back are possessive, and a form that starts with a
#: run starts at its first character or behind the match before: that changes no match, but neither
#: long digits nor long words without an end are walked again from each of their characters.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
AT, DOT = r"\x20?(?:\(at\)|\[at\]|\{at\}|\x20at\x20|@)\x20?", r"(?:\.|\x20?(?:\(dot\)|\[dot\]|\{dot\}|\[\.\]|\(\.\)|\x20dot\x20)\x20?)"
#: Wide forms, whose parts are bounded.
WIDE = {
    "email": rf"(?i)(?<![A-Z0-9._%+-])[A-Z0-9._%+-]{{1,64}}+{AT}[A-Z0-9-]{{1,63}}+(?:{DOT}[A-Z0-9-]{{1,63}}+)++",
    "ip": rf"(?i)(?<![0-9])[0-9]{{1,3}}+(?:{DOT}[0-9]{{1,3}}+){{3}}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}[\x20./_-]{0,2}){3}[0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9+])\+?(?:[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?[\x20./-]{0,2}[0-9]{3}[\x20./-][0-9]{4}(?![0-9])",
}
#: What a text has to hold, cheaply told, for a form to be looked for.
HINT = {
    "strict_email": "contains({t}, '@')", "strict_ip": r"{t} rlike '[0-9]\\.[0-9]'", "strict_card": "{t} rlike '[0-9][ -]?[0-9]'", "strict_phone": "contains({t}, '+')",
    "wide_email": r"{t} rlike '(?i)@|[\\[({{ ]at[\\])}} ]'", "wide_ip": r"{t} rlike '(?i)[0-9][ \\[({{]{{1,2}}(?:dot|\\.)[\\])}} ]'", "wide_card": "{t} rlike '[0-9]{{4}}'", "wide_phone": r"{t} rlike '[0-9][ ./-][0-9]{{4}}'",
}
#: Characters of context taken on either side, and places that one running sum goes over.
CONTEXT, BLOCK = 48, 256


@dataclass(frozen=True)
class Bootstrap:
    """Rounds, least confidence of a pattern, its least believed instances, and the belief from which a candidate is added."""

    rounds: int = 3
    confidence: float = 0.8
    support: int = 5
    belief: float = 0.9


def digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def valid(kind: str, value: str, d: str) -> str:
    """SQL: whether the digits ``d`` of ``value`` suit the kind."""
    if kind == "ip":
        return f"forall(split({value}, '[.]'), p -> coalesce(try_cast(p as int), 256) <= 255)"
    if kind == "phone":
        return f"length({d}) between 9 and 15"
    if kind == "card":
        twice = "2 * int(substring({d}, -i, 1))".format(d=d)
        luhn = f"aggregate(sequence(1, length({d})), 0, (s, i) -> s + if(i % 2 = 1, int(substring({d}, -i, 1)), {twice} - if({twice} > 9, 9, 0))) % 10 = 0"
        return f"case when length({d}) between 12 and 19 then {luhn} else false end"
    return "true"


def canonical(kind: str, value: str) -> str:
    """SQL: what occurrences of one instance have in common."""
    if kind in ("card", "phone"):
        return digits(value)
    plain = rf"regexp_replace(regexp_replace(lower({value}), r'{AT}', '@'), r'{DOT}', '.')"
    return plain if kind == "email" else rf"regexp_replace(lower({value}), r'{DOT}', '.')"


def places(df: DataFrame, form: str, kind: str, wide: bool) -> Column:
    """Valid occurrences of a form from its ``_p`` (texts between the matches), ``_v`` (matches) and ``_s`` (starts)."""
    p, v, s = f"{form}_p", f"{form}_v", f"{form}_s"
    value = "m.value" if not wide else "m.canon"
    spot = f"""transform({v}, (x, i) -> named_struct('start', get({s}, i), 'end', get({s}, i) + length(x), 'canon', {canonical(kind, 'x')}, 'value', x,
        'left', right(get({p}, i), {CONTEXT}), 'right', left(get({p}, i + 1), {CONTEXT})))"""
    checked = f"filter({spot}, m -> {valid(kind, value, digits('m.value'))})"
    return F.expr(f"""transform({checked}, m -> named_struct('start', m.start, 'kind', {KINDS.index(kind)}, 'end', m.end, 'value', m.canon,
        'shape', regexp_replace(regexp_replace(m.value, '[0-9]', '9'), '\\\\p{{L}}+', 'a'), 'left', m.left, 'right', m.right))""")


def starts(form: str) -> str:
    """SQL: where the matches start, by sums over blocks, so that many matches cost no more each than few."""
    steps = f"transform({form}_v, (x, i) -> bigint(length(get({form}_p, i)) + if(i > 0, length(get({form}_v, i - 1)), 0)))"
    blocks = f"sequence(0, greatest(0, size({form}_d) - 1) div {BLOCK})"
    block = f"slice({form}_d, int(k * {BLOCK} + 1), {BLOCK})"
    before = "aggregate(slice({0}_b, 1, int(k)), 0L, (s, x) -> s + x)".format(form)
    running = f"""flatten(transform({blocks}, k -> aggregate({block}, named_struct('at', {before}, 'out', cast(array() as array<bigint>)),
        (a, x) -> named_struct('at', a.at + x, 'out', concat(a.out, array(a.at + x))), a -> a.out)))"""
    sums = f"transform({blocks}, k -> aggregate({block}, 0L, (s, x) -> s + x))"
    return steps, sums, running


def occurrences(docs: DataFrame, text: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` without the text, with two hashes of it and arrays of strict and wide occurrences."""
    work = unused(docs, "text", "t1", "t2", "strict", "wide")
    kept = [named(c) for c in docs.columns if c != text]
    t = work["text"]
    step = docs.select(*kept, F.coalesce(named(text), F.lit("")).alias(t))
    forms = {f"{w}_{k}": (k, w, (STRICT if w == "strict" else WIDE)[k]) for w in ("strict", "wide") for k in KINDS}
    keep = [*kept, F.xxhash64(t).alias(work["t1"]), F.xxhash64(F.lit(1), t).alias(work["t2"])]
    # Steps leave one-element generators: plain columns would be computed again wherever they are used.
    cuts = []
    for form, (_, _, pattern) in forms.items():
        held = F.expr(HINT[form].format(t=t))
        none = F.array().cast("array<string>")
        cuts += [F.when(held, F.split(t, pattern, -1)).otherwise(none).alias(f"{form}_p"), F.when(held, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(none).alias(f"{form}_v")]
    step = step.select(*keep, F.inline(F.array(F.struct(*cuts))).alias(*[f"{f}_{x}" for f in forms for x in "pv"]))
    head = [*kept, work["t1"], work["t2"]]
    for i, x in enumerate("dbs"):
        step = step.select("*", F.inline(F.array(F.struct(*[F.expr(starts(f)[i]).alias(f"{f}_{x}") for f in forms]))))
    found = {w: F.concat(*[places(step, f, k, w == "wide") for f, (k, g, _) in forms.items() if g == w]) for w in ("strict", "wide")}
    return step.select(*head, *[found[w].alias(work[w]) for w in found]), work


def patterns(spots: DataFrame) -> DataFrame:
    """``pattern, kind, value``, each once, of occurrences with ``left``, ``right`` and ``shape``."""
    words = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")
    with_words = spots.select("kind", "value", "shape", F.inline(F.array(F.struct(words(F.col("left")).alias("l"), words(F.col("right")).alias("r")))))
    one = F.when(F.size("l") >= 1, F.concat(F.lit("before "), F.element_at("l", -1)))
    two = F.when(F.size("l") >= 2, F.concat(F.lit("before "), F.array_join(F.slice("l", -2, 2), " ")))
    behind = F.when(F.size("r") >= 1, F.concat(F.lit("behind "), F.element_at("r", 1)))
    shape = F.concat(F.lit("shape "), "shape")
    made = with_words.select(F.explode(F.array_compact(F.array(one, two, behind, shape))).alias("pattern"), "kind", "value")
    return made.distinct()


def believed(strict: DataFrame, free: DataFrame, how: Bootstrap) -> DataFrame:
    """``kind, value`` of the candidates ``free`` that are believed, by the graph of patterns and instances."""
    seeds = strict.select("kind", "value").distinct()
    unsure = materialize(free.select("kind", "value").distinct().join(seeds.withColumn("seed", F.lit(True)), ["kind", "value"], "left").select("kind", "value", F.when(F.col("seed"), 1.0).otherwise(0.0).alias("belief")))
    edges = materialize(patterns(free))
    asked = edges.select("pattern").distinct()
    # Only patterns that candidates have are counted, over all seeds.
    sure = patterns(strict).join(asked.hint("merge"), "pattern", "left_semi").groupBy("pattern", "kind").agg(F.count("*").alias("seeds"))
    sure = materialize(sure)
    for _ in range(how.rounds):
        known = edges.join(unsure.hint("merge"), ["kind", "value"])
        # A value that is a seed has been counted among the seeds where it has the pattern there too.
        more = known.groupBy("pattern", "kind").agg(F.sum("belief").alias("more"), F.count_if(F.col("belief") >= how.belief).alias("firm"), F.count("*").alias("unsure"))
        both = more.join(sure, ["pattern", "kind"], "full").na.fill(0, ["more", "firm", "unsure", "seeds"])
        totals = both.groupBy("pattern").agg(F.collect_list(F.struct("kind", "more", "firm", "seeds")).alias("kinds"), F.sum(F.col("seeds") + F.col("unsure")).alias("n"))
        each = totals.select("pattern", "n", F.inline("kinds"))
        trusted = each.where((F.col("seeds") + F.col("firm") >= how.support) & (F.col("seeds") + F.col("more") >= how.confidence * F.col("n")))
        trusted = trusted.select("pattern", "kind", ((F.col("seeds") + F.col("more")) / F.col("n")).alias("confidence"))
        doubt = F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9))))
        said = edges.join(trusted.hint("merge"), ["pattern", "kind"]).groupBy("kind", "value").agg((1 - F.exp(doubt)).alias("said"))
        now = unsure.join(said.hint("merge"), ["kind", "value"], "left").select("kind", "value", F.greatest("belief", F.coalesce("said", F.lit(0.0))).alias("belief"))
        before, unsure = unsure, materialize(now)
        drop(before)
    return unsure.where(F.col("belief") >= how.belief).select("kind", "value")


def find_personal(docs: DataFrame, how: Bootstrap = Bootstrap(), text: str = "text") -> DataFrame:
    """``docs`` but for the text, with ``base`` and ``added``: arrays of ``start, kind, end`` in code points, the end not included.

    ``base`` has the strict forms; kinds are numbered as in :data:`KINDS`. Both are sorted.
    """
    found, work = occurrences(docs, text)
    found = materialize(found)
    t1, t2, strict, wide = (work[c] for c in ("t1", "t2", "strict", "wide"))
    texts = found.select(F.col(t1).alias("t1"), F.col(t2).alias("t2"), F.col(strict).alias("strict"), F.col(wide).alias("wide")).dropDuplicates(["t1", "t2"])
    sure = texts.select(F.inline("strict")).select("kind", "value", "shape", "left", "right")
    # A candidate is free if no strict occurrence of its text overlaps it: those before it end by its
    # start, and the next one starts at its end or later.
    spots = texts.where(F.size("wide") > 0).select("t1", "t2", F.inline(F.concat(
        F.transform("strict", lambda x: F.struct(F.lit(True).alias("sure"), *[x[c].alias(c) for c in ("start", "kind", "end", "value", "shape", "left", "right")])),
        F.transform("wide", lambda x: F.struct(F.lit(False).alias("sure"), *[x[c].alias(c) for c in ("start", "kind", "end", "value", "shape", "left", "right")])),
    )))
    within = "over (partition by t1, t2 order by start rows between unbounded preceding and current row)"
    behind = "over (partition by t1, t2 order by start desc rows between unbounded preceding and current row)"
    same = "over (partition by t1, t2, start)"
    spots = spots.withColumn("before", F.expr(f"max(if(sure, end, -1)) {within}")).withColumn("next", F.expr(f"min(if(sure, start, null)) {behind}")).withColumn("here", F.expr(f"bool_or(sure) {same}"))
    free = spots.where("not sure and not here and before <= start and (next is null or next >= end)")
    free = materialize(free.select("t1", "t2", "start", "kind", "end", "value", "shape", "left", "right"))
    good = believed(sure, free, how)
    added = free.join(good.hint("merge"), ["kind", "value"]).groupBy("t1", "t2").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end"))).alias("more"))
    added = added.select(F.col("t1").alias(t1), F.col("t2").alias(t2), F.col("more").alias(work["text"]))
    kept = [named(c) for c in docs.columns if c != text and c.lower() not in ("base", "added")]
    base = F.array_sort(F.transform(strict, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    more = F.coalesce(F.col(work["text"]), F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))
    return found.join(added.hint("merge"), [t1, t2], "left").select(*kept, base.alias("base"), more.alias("added"))
