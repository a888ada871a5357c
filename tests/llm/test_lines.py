from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from lineferry.llm import common
from lineferry.llm import lines as lines_module
from lineferry.llm.lines import Fuzzy, dedup_lines, letters, links_of, with_edits, with_simhash


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


def norm(line):
    return re.sub(r"[\W_]+", " ", line.lower()).strip(" ")


def alike(a, b, fuzzy):
    return edits(a, b) <= (1 - fuzzy.similarity) * max(len(a), len(b)) + 1e-9


def by_hand(spark, rows, fuzzy, met=lambda a, b: True):
    """Texts with only the first line of each group of lines that are alike, of those that ``met``."""
    places = [(d, i, norm(line)) for d, t in rows if t is not None and d is not None for i, line in enumerate(t.split("\n"))]
    places = sorted(p for p in places if len(p[2]) >= fuzzy.min_chars)
    different = sorted({p[2] for p in places})
    root = {x: x for x in different}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(different):
        for b in different[:i]:
            if abs(len(a) - len(b)) <= 0.3 * len(a) and met(a, b) and alike(a, b, fuzzy):
                root[find(a)] = find(b)
    seen, gone = set(), set()
    for d, i, x in places:
        if find(x) in seen:
            gone.add((d, i))
        seen.add(find(x))
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in rows if d is not None}, gone


def simhash(words, hashed):
    return sum(1 << b for b in range(64) if 2 * sum(hashed[w] >> b & 1 for w in words) > len(words))


def candidates(spark, rows, fuzzy):
    """Whether two normalised lines share a key and are near by SimHash, and every line's SimHash."""
    lines = sorted({norm(line) for d, t in rows if t is not None and d is not None for line in t.split("\n")} - {""})
    df = with_simhash(spark.createDataFrame([(x, x.split(" ")) for x in lines], "norm string, ws array<string>"))
    found = {r.norm: (set(r["keys"]), r.simhash & (2**64 - 1)) for r in df.select("norm", "simhash", fuzzy.keys(F.col("simhash"), F.col("ws")).alias("keys")).collect()}
    return lambda a, b: bool(found[a][0] & found[b][0]) and (found[a][1] ^ found[b][1]).bit_count() <= fuzzy.bits


def made(seed):
    rng = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(40)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(2, 30))] for _ in range(12)]
    rows = []
    for d in range(40):
        lines = []
        for _ in range(rng.randint(0, 5)):
            line = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                line[rng.randrange(len(line))] = rng.choice(vocabulary)
            lines.append(rng.choice([" ", "  ", ", "]).join(line).capitalize() + rng.choice(["", ".", " !"]))
        rows.append((d * 7, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("fuzzy", [Fuzzy(), Fuzzy(bits=9, blocks=11, agree=2, half=2, similarity=0.8, min_chars=10)])
def test_lines_by_hand(spark, fuzzy):
    rows = [*made(1), (1, None), (2, ""), (3, "\n\n"), (4, "a short one\na short one"), (5, "very long line of words " * 3000), (6, "x\n" + "Very long line of words " * 3000)]
    docs = spark.createDataFrame([(d, t, 5, "k") for d, t in rows], "doc_id bigint, text string, N_REMOVED int, pos string")
    got = {r.doc_id: r for r in dedup_lines(docs, fuzzy).collect()}
    want, _ = by_hand(spark, rows, fuzzy, candidates(spark, rows, fuzzy))
    assert {d: r.text for d, r in got.items()} == want
    assert sum(r.n_removed for r in got.values()) > 10 and all(r.pos == "k" for r in got.values())


@pytest.mark.parametrize("words", [6, 8, 15, 30, 60])
def test_recall_against_edit_similarity_alone(spark, words):
    """Lines with one letter changed, and lines with edits up to the similarity, where edits stand in one half."""
    rng = random.Random(words)
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(3, 9)))
    rows, n = [], 150
    for i in range(n):
        line = [word() for _ in range(words)]
        other = list(line)
        at = rng.randrange(words)
        other[at] = other[at][:-1] + "xyz"[i % 3]
        rows += [(2 * i, " ".join(line)), (2 * i + 1, " ".join(other))]
    left = dedup_lines(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    alike_ = sum(alike(rows[2 * i][1], rows[2 * i + 1][1], Fuzzy()) for i in range(n))
    assert sum(r.n_removed for r in left) >= 0.95 * alike_ > 0


def test_simhash_of_short_and_long_lines(spark):
    lines = ["a", "a b", "b a b c", "w1 " * 126 + "x", "w1 " * 127 + "x y", "w1 w2 w3 " * 85, "w1 w2 w3 " * 86 + "q", "w%d " * 5000 % tuple(i % 700 for i in range(5000))]
    ws = [x.split() for x in lines]
    hashed = {r.w: r.h & (2**64 - 1) for r in spark.createDataFrame([(w,) for w in {w for x in ws for w in x}], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    got = with_simhash(spark.createDataFrame(list(enumerate(ws)), "i int, ws array<string>")).collect()
    assert [r.simhash & (2**64 - 1) for r in sorted(got)] == [simhash(x, hashed) for x in ws]


def test_columns_of_any_name(spark):
    line = "one two three four five six seven eight"
    names = ["_drops", "_doc", "_t", "doc", "t", "head", "first", "N_Lines", "a.b", "key"]
    docs = spark.createDataFrame([(1, line, *names), (2, line, *names)], ["doc_id", "text", *names])
    got = dedup_lines(docs)
    assert got.columns == ["doc_id", "text", *[c for c in names if c != "N_Lines"], "n_lines", "n_removed"]
    assert sorted((r.doc_id, r.text, r._drops, r.key, r.n_lines) for r in got.collect()) == [(1, line, "_drops", "key", 1), (2, "", "_drops", "key", 1)]


def test_nulls_repeats_and_empty_table(spark):
    line = "one two three four five six seven eight"
    docs = spark.createDataFrame([(1, line), (1, line), (None, line), (2, line + "\nshort"), (3, line + "\n" + line), (3, "other " + line)], "doc_id int, text string")
    got = sorted(((r.doc_id or 0, r.text, r.n_lines, r.n_removed) for r in dedup_lines(docs).collect()))
    assert got == [(0, line, 1, 0), (1, line, 1, 0), (1, line, 1, 0), (2, "short", 2, 1), (3, "", 2, 2), (3, "other " + line, 1, 0)]
    assert dedup_lines(docs.limit(0)).count() == 0


def test_short_lines_are_deduplicated_too(spark):
    """Boilerplate of a few words, and whole sentences without blanks; blank lines and rules stay."""
    rows = [(1, "All rights reserved.\n\n---\n今日はとても良い天気です。\nx"), (2, "mine\nall rights RESERVED\n\n---\n今日はとても良い天気です\nX!\nall rights observed")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in dedup_lines(docs).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("mine\n\n---\nall rights observed", 3)}


def test_no_python_in_plans(spark, monkeypatch):
    plans = []
    for module in (lines_module, common):
        write = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, write=write: plans.append(df._jdf.queryExecution().toString()) or write(df))
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e f g x"), (3, "a b c d e f g xy")], "doc_id int, text string")
    plans.append(dedup_lines(docs)._jdf.queryExecution().toString())
    assert len(plans) > 8 and not any(re.search("Python|Pandas|Arrow|Cartesian", p) for p in plans)


def test_edits_without_what_is_shared(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(300):
        x = [rng.choice(["a", "bb", "abc", "dcd"]) for _ in range(rng.randint(1, 7))]
        y = list(x)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(y) + 1)
            y[at : at + rng.randint(0, 2)] = [rng.choice(["a", "bb", "abc", "dcd"])] * rng.randint(0, 2)
        rows.append((x, y or ["q"], rng.randint(0, 12)))
    df = spark.createDataFrame(rows, "x array<string>, y array<string>, most int")
    for r in with_edits(df).collect():
        n = edits(" ".join(r.x), " ".join(r.y))
        assert r.edits == (n if n <= r.most else -1), r

def test_a_line_has_its_words_split_once_and_its_keys_travel_alone(spark, monkeypatch):
    """What pairs are told apart by is joined to shared keys only, not written with every key."""
    written, real = [], lines_module.materialize
    monkeypatch.setattr(lines_module, "materialize", lambda df: written.append(df) or real(df))
    text = "one two three four five six seven eight nine ten eleven twelve"
    distinct = spark.createDataFrame([(1, text, 7), (2, text + "s", 7), (3, "another line of other words altogether", 9)], "id bigint, norm string, simhash bigint")
    links = links_of(distinct, Fuzzy())
    assert {tuple(r) for r in links.distinct().collect()} == {(1, 2)}
    assert written[0].columns == ["key", "id"]
    assert written[0]._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_lines_of_other_letters_are_not_compared_one_by_one(spark, monkeypatch):
    rng, compared, plain = random.Random(4), [], lines_module.link_buckets

    def counting(members, details, contents, compare, *more):
        def counted(pairs):
            compared.append(pairs.count())
            return compare(pairs)

        return plain(members, details, contents, counted, *more)

    monkeypatch.setattr(lines_module, "link_buckets", counting)
    head, rows = "what every line of this group begins with", []
    for i in range(150):
        few = rng.sample("bcdfghjklmnpqrstvwxyz", 5)
        tail = " ".join("".join(rng.choice(few) for _ in range(5)) for _ in range(8))
        rows.append((i, f"{head} {tail}"))
    rows += [(1000 + i, t[:-1] + "e") for i, t in rows[:20]]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id for r in got if r.n_removed} == {i for i, _ in rows if i >= 1000}
    # Those before were measured against the smallest ids of their buckets.
    assert sum(compared[1:]) < 5 * len(rows)


def test_letters_rule_out_no_line_within_the_edits(spark):
    rng, rows = random.Random(6), []
    for _ in range(300):
        a = "".join(rng.choice("abcdeé字0 ") for _ in range(rng.randint(5, 40)))
        b = list(a)
        for _ in range(rng.randint(0, 8)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "é", "7", " "])
        rows.append((a, "".join(b), edits(a, "".join(b))))
    found = spark.createDataFrame(rows, "a string, b string, edits int").select("edits", *(letters(F.col(c)).alias(c) for c in "ab")).collect()
    for r in found:
        assert max(sum(max(0, x - y) for x, y in zip(*way, strict=True)) for way in ((r.a, r.b), (r.b, r.a))) <= r.edits
