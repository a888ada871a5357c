"""Fuzzy line dedup with DataFrame functions alone: SimHash, pigeonhole blocks, edit similarity.

A line is compared by its lower-case letters and digits with single blanks between words. Repeated
lines shrink to one each; the SimHash of its words has 64 bits in blocks, and lines are joined on each
choice of ``agree`` blocks, which finds all that differ in so few bits that as many blocks are left. An
edit in a line of few words changes more bits than that, so the words have pigeonhole blocks of their
own: the first and the second half, of which an edit in one place leaves the other as it was. Joined
lines whose lengths and, after the first round, letters allow it and whose SimHashes differ in at most
``bits`` bits, far more than an edit changes and fewer than unrelated lines do, are compared; their edit
similarity alone decides. Of each
connected group of lines, and of each repeated line, the occurrence in the smallest (id, position) is
kept.

Every line that holds a letter or digit is compared; blank lines and rules are left as they are. A
``min_chars`` above 1 leaves out shorter normalised lines altogether, repeated ones too. Null texts
stay null, an empty text stays empty, and a text whose lines all go becomes empty; the row stays. Rows
with a null id are left as they are. Rows of one id with the same text are one document; with different
texts they are two. Other columns are passed through, whatever their names but ``n_lines`` and
``n_removed`` in upper or lower case, which the result replaces.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineferry.llm.common import components, link_buckets, materialize, named, unused
from lineferry.session import drop

BITS = 64
#: Words that one sum of eight counters goes over, a byte each; the highest has the sign of the sum.
CHUNK = 127
LANES = sum(1 << 8 * i for i in range(8))
#: Characters that are counted one by one; all others are one kind.
LETTERS = "abcdefghijklmnopqrstuvwxyz "


@dataclass(frozen=True)
class Fuzzy:
    """Bits of a SimHash that may differ at all, its blocks and how many of them must agree, fewest
    words of a half to be joined on, least edit similarity, shortest line in normalised characters."""

    bits: int = 24
    blocks: int = 3
    agree: int = 2
    half: int = 3
    similarity: float = 0.9
    min_chars: int = 1

    def keys(self, simhash: Column, words: Column) -> Column:
        """A key for each choice of blocks that must agree, and for each half.

        Halves are cut at n/2 and at (n-1)/2 words, one of which stays as it is when a word comes or
        goes in the other half.
        """
        edges = [BITS * i // self.blocks for i in range(self.blocks + 1)]
        parts = [(F.shiftrightunsigned(simhash, lo)).bitwiseAND(F.lit((1 << hi - lo) - 1)) for lo, hi in zip(edges, edges[1:], strict=False)]
        keys = [F.xxhash64(F.lit(i), *c) for i, c in enumerate(combinations(parts, self.agree))]
        for less in (0, 1):
            n = F.floor((F.size(words) - less) / 2).cast("int")
            for side, part in enumerate((F.slice(words, 1, n), F.slice(words, -n, n))):
                keys.append(F.when(n >= self.half, F.xxhash64(F.lit(1000 + side), part)))
        return F.array_distinct(F.array_compact(F.array(*keys)))


def words_of(line: Column) -> Column:
    """The words of a normalised line: runs of lower-case letters and digits."""
    return F.array_remove(F.split(F.lower(line), r"[^\p{L}\p{N}]+"), "")


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def with_simhash(lines: DataFrame) -> DataFrame:
    """``lines`` with ``simhash`` from their words ``ws``, worked out in place.

    Eight bits are counted in one long, a byte each, over at most ``CHUNK`` words at a time.
    """
    step = lines.select("*", F.inline(F.expr("array(struct(transform(ws, w -> xxhash64(w)) as h))")))
    sums = ", ".join(f"'a{j}', s.a{j} + (shiftrightunsigned(x, {j}) & {LANES}L)" for j in range(8))
    zero = ", ".join(f"'a{j}', 0L" for j in range(8))
    chunks = f"transform(sequence(0, greatest(0, size(h) - 1) div {CHUNK}), k -> slice(h, k * {CHUNK} + 1, {CHUNK}))"
    lanes = f"transform({chunks}, c -> aggregate(c, named_struct({zero}), (s, x) -> named_struct({sums})))"
    step = step.select("*", F.inline(F.expr(f"array(struct({lanes} as lanes))")))
    bits = []
    for b in range(BITS):
        i, j = divmod(b, 8)
        one = f"(shiftrightunsigned(lanes[0].a{j}, {8 * i}) & 255L)"
        more = f"aggregate(lanes, 0L, (s, c) -> s + (shiftrightunsigned(c.a{j}, {8 * i}) & 255L))"
        count = F.expr(f"case when size(lanes) = 1 then {one} else {more} end")
        bits.append(F.when(2 * count > F.size("ws"), F.shiftleft(F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint")))
    simhash = reduce(lambda x, y: x.bitwiseOR(y), bits)
    return step.select(*lines.columns, simhash.alias("simhash"))


def line_table(docs: DataFrame, fuzzy: Fuzzy, key: str, text: str) -> DataFrame:
    """``doc, t, pos, k1, k2, norm`` for every line with a letter or digit and ``min_chars``."""
    whole = named(text)
    rows = docs.where(named(key).isNotNull() & whole.isNotNull()).select(named(key).alias("doc"), F.xxhash64(whole).alias("t"), whole.alias("_text"))
    lines = rows.select("doc", "t", F.posexplode(split_lines(F.col("_text"))).alias("pos", "line"))
    # A line's words come out of a one-element generator: as a plain column they would be computed
    # again for each use.
    lines = lines.select("doc", "t", "pos", F.inline(F.array(F.struct(F.array_join(words_of(F.col("line")), " ").alias("norm")))))
    return lines.where(F.length("norm") >= fuzzy.min_chars).select("doc", "t", "pos", F.xxhash64("norm").alias("k1"), F.xxhash64(F.lit(1), "norm").alias("k2"), "norm")


def with_edits(pairs: DataFrame) -> DataFrame:
    """``pairs(x, y, most)`` with ``edits``: character edits between the two lists of words joined
    by blanks, -1 if more than ``most``.

    What both begin and end with costs no edit, so only what lies between is compared. Each step is
    a projection of its own: written as one expression, every step would be computed again wherever
    it is used.
    """
    first_change = "coalesce(nullif(array_position(zip_with({}, {}, (a, b) -> a <=> b), false), 0) - 1, size(x))"
    short = F.expr("least(size(x), size(y))").cast("int")
    out = pairs.withColumn("_ahead", F.expr(first_change.format("x", "y")).cast("int"))
    out = out.withColumn("_behind", F.expr(first_change.format("reverse(x)", "reverse(y)")).cast("int"))
    out = out.withColumn("_head", F.least("_ahead", short)).withColumn("_tail", F.least(F.col("_behind"), short - F.col("_head")))
    for w in ("x", "y"):
        out = out.withColumn(f"_n{w}", F.size(w) - F.col("_head") - F.col("_tail"))
        out = out.withColumn(f"_m{w}", F.array_join(F.slice(w, F.col("_head") + 1, F.col(f"_n{w}")), " "))
    # Where one list has nothing in between, the blank beside the other's words is an edit too.
    alone = F.expr("_head + _tail > 0 and (_nx = 0) <> (_ny = 0)").cast("int")
    out = out.withColumn("_alone", alone).withColumn("_edits", F.expr("levenshtein(_mx, _my, most)"))
    within = (F.col("_edits") >= 0) & (F.col("_edits") + F.col("_alone") <= F.col("most"))
    return out.select(*pairs.columns, F.when(within, F.col("_edits") + F.col("_alone")).otherwise(-1).alias("edits"))


def letters(norm: Column) -> Column:
    """How often a normalised line has each of ``LETTERS``, and any other character."""
    counts = [F.length(norm) - F.length(F.translate(norm, c, "")) for c in LETTERS]
    return F.array(*counts, F.length(F.translate(norm, LETTERS, "")))


def links_of(distinct: DataFrame, fuzzy: Fuzzy) -> DataFrame:
    """Links between different lines ``id, norm, simhash``, enough for their groups."""
    # A line's words come out of a one-element generator: each key would split the line again.
    split = distinct.select("id", "simhash", F.inline(F.array(F.struct(F.split("norm", " ").alias("ws")))))
    keys = fuzzy.keys(F.col("simhash"), F.col("ws"))
    members = materialize(split.select(F.explode(keys).alias("key"), "id"))
    details = distinct.select("id", "simhash", F.length("norm").alias("chars"))

    def may(x: str, y: str) -> Column:
        near = F.bit_count(F.col(x + "simhash").bitwiseXOR(F.col(y + "simhash"))) <= fuzzy.bits
        return near & (F.least(x + "chars", y + "chars") >= fuzzy.similarity * F.greatest(x + "chars", y + "chars"))

    def contents(ids: DataFrame) -> DataFrame:
        return distinct.select("id", "norm").hint("merge").join(ids, "id", "left_semi").withColumn("letters", letters(F.col("norm")))

    def compare(pairs: DataFrame) -> DataFrame:
        most = F.floor((1 - fuzzy.similarity) * F.greatest(F.length("x_norm"), F.length("y_norm")) + 1e-9).cast("int")
        both = pairs.select("*", F.inline(F.array(F.struct(F.split("x_norm", " ").alias("x"), F.split("y_norm", " ").alias("y"), most.alias("most")))))
        # The similarity is no metric: it rules out no pair by what is known of two others.
        return with_edits(both.drop("x_norm", "y_norm")).withColumns({"dist": F.lit(0.0), "linked": F.col("edits") >= 0})

    def close(x: str, y: str) -> Column:
        """Each edit takes one character away at most and adds one at most."""
        kinds = [[F.get(w + "letters", F.lit(i)) for w in (x, y)] for i in range(len(LETTERS) + 1)]
        most = F.floor((1 - fuzzy.similarity) * F.greatest(x + "chars", y + "chars") + 1e-9)
        return F.greatest(*(sum((F.greatest(a - b, F.lit(0)) for a, b in way), F.lit(0)) for way in (kinds, [k[::-1] for k in kinds]))) <= most

    return link_buckets(members, details, contents, compare, 0.0, may, ("letters",), close)


def dedup_lines(docs: DataFrame, fuzzy: Fuzzy = Fuzzy(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the lines that repeat an earlier one, with ``n_lines`` (before) and ``n_removed``."""
    every = line_table(docs, fuzzy, key, text)
    # The smallest place of a line has its text with it. The other lines keep only their places.
    first = every.groupBy("k1", "k2").agg(F.min(F.struct("doc", "t", "pos", "norm")).alias("first"), F.count("*").alias("n"))
    flat = first.select("k1", "k2", "n", "first", F.split("first.norm", " ").alias("ws"))
    distinct = materialize(with_simhash(flat).select(
        F.monotonically_increasing_id().alias("id"), "k1", "k2", "n", F.struct("first.doc", "first.t", "first.pos").alias("first"),
        F.col("first.norm").alias("norm"), "simhash",
    ))
    comps = materialize(components(links_of(distinct, fuzzy)))
    grouped = distinct.select("id", "k1", "k2", "n", "first").join(comps.withColumnRenamed("node", "id"), "id", "left")
    grouped = materialize(grouped.where("n > 1 or component is not null"))
    drop(distinct)
    heads = grouped.where("component is not null").groupBy("component").agg(F.min("first").alias("head"))
    # Only lines that repeat, or are in a group, can go: what is kept of each.
    kept = materialize(grouped.join(heads, "component", "left").select("k1", "k2", F.coalesce("head", "first").alias("head")))
    gone = every.select("doc", "t", "pos", "k1", "k2").hint("merge").join(kept, ["k1", "k2"]).where("doc <> head.doc or t <> head.t or pos <> head.pos")
    drops = materialize(gone.groupBy("doc", "t").agg(F.collect_set("pos").alias("drops")))
    for table in (comps, grouped, kept):
        drop(table)
    work = unused(docs, "doc", "t", "drops")
    out, at = F.col(work["drops"]), [F.col(work[c]) for c in ("doc", "t")]
    renamed = drops.toDF(work["doc"], work["t"], work["drops"])
    joined = docs.hint("merge").join(renamed, (named(key) == at[0]) & (F.xxhash64(named(text)) == at[1]), "left")
    left = F.filter(split_lines(named(text)), lambda line, i: ~F.array_contains(out, i))
    n_lines = F.when(F.coalesce(F.length(named(text)), F.lit(0)) > 0, F.size(split_lines(named(text)))).otherwise(0)
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    shown = F.when(out.isNull(), named(text)).otherwise(F.concat_ws("\n", left))
    return joined.select(
        *[shown.alias(c) if c == text else named(c) for c in names], n_lines.alias("n_lines"),
        F.coalesce(F.size(out), F.lit(0)).alias("n_removed"),
    )
