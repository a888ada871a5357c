from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from lineferry.llm import passages
from lineferry.llm.common import Hashes, shingles, word_hashes, words
from lineferry.llm.passages import Passage, agreeing, all_windows, compact_windows, repeated, resumed, verified, without_passages


def plain_windows(values, width):
    out = []
    for c in range(len(values)):
        lo = hi = c
        while lo and values[lo - 1] > values[c]:
            lo -= 1
        while hi + 1 < len(values) and values[hi + 1] >= values[c]:
            hi += 1
        if hi - lo + 1 >= width:
            out.append((lo, c, hi))
    return sorted(out)


@pytest.mark.parametrize("top", [4, 2**63])
def test_windows_by_definition(top):
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 50, 300):
        for width in (1, 4, 46):
            v = rng.integers(0, top, n).astype(np.uint64)
            assert sorted(map(tuple, compact_windows(v, width).tolist())) == plain_windows(v.tolist(), width)


def test_every_long_subsequence_is_in_one_window():
    v = np.random.default_rng(1).integers(0, 2**63, 120).astype(np.uint64)
    found = compact_windows(v, 10)
    for i in range(120):
        for j in range(i + 9, 120):
            held = [c for lo, c, hi in found if lo <= i <= c <= j <= hi]
            assert held == [i + int(v[i : j + 1].argmin())]


def test_agreement():
    found = [(0, 0, 50, 100, 150), (1, 40, 90, 140, 190), (1, 300, 360, 0, 60), (0, 300, 360, 200, 260), (1, 10, 60, 500, 560)]
    assert agreeing(found, 2) == [True, True, False, False, False]


def text(rng, n, vocabulary=2000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def plain_repeated(rows, passage):
    """Words of each text in an equal run of ``min_words`` that a smaller document has too."""
    n, seen, out = passage.min_words, {}, {}
    for i, t in sorted((i, t) for i, t in rows if i is not None and t):
        w = t.lower().split()
        for p in range(len(w) - n + 1):
            run = tuple(w[p : p + n])
            if seen.setdefault(run, i) != i:
                out.setdefault(i, set()).update(range(p, p + n))
    return out


def made(seed):
    rng = random.Random(seed)
    shared = [text(rng, n) for n in (50, 51, 60, 120, 49, 30, 25)]
    rows = []
    for i in range(90):
        parts = [text(rng, rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared), text(rng, rng.randint(1, 60))]
        rows.append((i * 3, " ".join(w for p in parts for w in p)))
    rows += [(1000 + i, rows[7][1]) for i in range(20)]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equal_passages_by_hand(spark, seed):
    rows = made(seed)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, start int, c string")
    got = {}
    for r in repeated(docs).collect():
        assert r.source < r.doc and r.words >= 50
        got.setdefault(r.doc, set()).update(range(r.start, r.start + r.words))
    want = plain_repeated(rows, Passage())
    assert set(got) == set(want)
    for i, w in want.items():
        assert w <= got[i]


def test_part_shared_with_an_earlier_document(spark):
    """Many documents share less than a passage with a first one, and more among some of themselves."""
    rng = random.Random(9)
    core = text(rng, 40)
    tails = [text(rng, 30) for _ in range(4)]
    rows = [(i, " ".join(text(rng, 60) + core + (tails[i % 5 - 1] if i % 5 else []) + text(rng, 60))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc for r in repeated(docs).collect()} == set(plain_repeated(rows, Passage()))


def test_edited_passages(spark):
    rng, rows = random.Random(4), []
    for i in range(0, 60, 2):
        passage = text(rng, 150)
        edited = list(passage)
        for p in (40, 95):
            edited[p : p + 1] = text(rng, rng.randint(0, 2))
        rows += [(i, " ".join(text(rng, 50) + passage + text(rng, 50))), (i + 1, " ".join(text(rng, 70) + edited + text(rng, 20)))]
    found = repeated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    whole = {r.doc for r in found if r.words >= 140}
    assert len(whole) >= 28 and all(r.source == r.doc - 1 and r.similarity >= 0.8 for r in found)


def test_verification_bounds():
    h = Hashes()
    x, y = (shingles(h.of(words(t)), 5) for t in ("a b c d e f g", "z a b c d e f g"))
    assert verified(x, y, [(0, 1, True)], Passage(min_words=7)) == [(0, 7, 1, 8, 1.0)]
    assert verified(x, y, [(0, 0, True), (99, 1, False)], Passage(min_words=7)) == []
    assert verified(x, y, [(0, 1, False)], Passage(min_words=8)) == []


def test_cut_texts(spark):
    rng = random.Random(6)
    p = " ".join(text(rng, 55))
    rows = [(1, f"intro {p} end"), (2, f"Before  it\n{p}\nafter it"), (3, p), (4, None), (5, ""), (None, p), (6, "É " + p.upper()), (7, f"{p} tail"), (8, "word " * 20000)]
    docs = spark.createDataFrame([(i, t, "k", 9) for i, t in rows], "doc_id bigint, text string, doc string, words_removed int")
    got = {r.doc_id: (r.text, r.words_removed, r.doc) for r in without_passages(docs, repeated(docs)).collect()}
    assert got == {1: (rows[0][1], 0, "k"), 2: ("Before  it\nafter it", 55, "k"), 3: ("", 55, "k"), 4: (None, 0, "k"), 5: ("", 0, "k"),
                   None: (p, 0, "k"), 6: ("É", 55, "k"), 7: ("tail", 55, "k"), 8: (rows[8][1], 0, "k")}


def test_repeated_ids_and_empty_table(spark):
    rng = random.Random(7)
    p = " ".join(text(rng, 60))
    docs = spark.createDataFrame([(1, p), (1, p), (2, p), (2, p), (3, "x " + p), (3, "other")], "doc_id int, text string")
    found = repeated(docs)
    assert {r.doc for r in found.collect()} <= {2, 3} and 2 in {r.doc for r in found.collect()}
    assert sorted((r.doc_id, r.text) for r in without_passages(docs, found).collect())[:4] == [(1, p), (1, p), (2, ""), (2, "")]
    none = docs.limit(0)
    assert repeated(none).count() == 0 and without_passages(none, repeated(none)).count() == 0


def test_cutting_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", "y", 7, 8), (2, "a b c", "x", "y", 7, 8)], "doc_id int, text string, _spans string, _doc string, _cut int, WORDS_REMOVED int")
    found = spark.createDataFrame([(2, 1, 0, 2)], "doc int, source int, start bigint, words bigint")
    got = without_passages(docs, found)
    assert got.columns == ["doc_id", "text", "_spans", "_doc", "_cut", "words_removed"]
    assert sorted(map(tuple, got.collect())) == [(1, "a b c", "x", "y", 7, 0), (2, "c", "x", "y", 7, 2)]


def test_agreement_by_definition():
    rng = random.Random(1)
    for _ in range(500):
        found = []
        for _ in range(rng.randrange(40)):
            a, b = rng.randrange(200), rng.randrange(200)
            found.append((rng.randrange(3), a, a + rng.randrange(40), b, b + rng.randrange(40)))
        for agree in (1, 2, 3):
            met = [{w[0] for w in found if w[1] <= v[2] and v[1] <= w[2] and w[3] <= v[4] and v[3] <= w[4]} for v in found]
            assert agreeing(found, agree) == [len(m) >= agree for m in met]


def changed(rng, p):
    return [*p[: len(p) // 2], "changed", *p[len(p) // 2 + 1 :]]


def inserted(rng, p):
    return [*p[: len(p) // 2], *text(rng, 5), *p[len(p) // 2 :]]


def test_recall_of_short_edited_passages(spark):
    """Passages at a similarity of 0.8 or a little more, edited in the middle: at least 0.95 of each kind are found whole."""
    rng, rows, kinds = random.Random(11), [], {}
    for edit, n in ((changed, 50), (changed, 60), (inserted, 60), (inserted, 80)):
        for _ in range(40):
            i, p = len(rows), text(rng, n, 20000)
            rows += [(i, " ".join(text(rng, 50) + p + text(rng, 60))), (i + 1, " ".join(text(rng, 70) + edit(rng, p) + text(rng, 40)))]
            kinds[i + 1] = edit, n
    found = repeated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    whole = {r.doc for r in found if r.source == r.doc - 1 and r.words >= kinds[r.doc][1] - 1}
    for kind in set(kinds.values()):
        of = {i for i, k in kinds.items() if k == kind}
        assert len(of & whole) >= 38, kind
    assert all(r.similarity >= 0.8 for r in found)


def test_longest_stretch_of_a_chain():
    """A bad tail does not take a good passage with it."""
    rng = random.Random(12)
    good = text(rng, 90, 20000)
    tail = text(rng, 100, 20000)
    worse = [w if i % 6 else f"z{i}" for i, w in enumerate(tail)]
    h = Hashes()
    x, y = (shingles(h.of(words(" ".join(t))), 5) for t in (changed(rng, good) + worse, good + tail))
    found = verified(x, y, [(0, 0, False)], Passage())
    assert found and found[0][0] == 0 and found[0][1] >= 90 and found[0][4] >= 0.8


def test_place_beside_the_first_in_the_source(spark):
    """The source has the passage's beginning once more, before the passage."""
    rng = random.Random(13)
    p = text(rng, 60, 20000)
    rows = [(1, " ".join(p[:30] + text(rng, 20) + p[30:45] + text(rng, 20) + p + text(rng, 9))), (2, " ".join(text(rng, 40) + p + text(rng, 40)))]
    found = repeated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r.doc, r.source, r.words) for r in found} == {(2, 1, 60)}


def test_other_texts_of_one_id_stay(spark):
    rng = random.Random(14)
    p, other = " ".join(text(rng, 60)), " ".join(text(rng, 90))
    docs = spark.createDataFrame([(1, p), (2, "a " + p), (2, other)], "doc_id int, text string")
    got = {r.text for r in without_passages(docs, repeated(docs)).collect() if r.doc_id == 2}
    assert other in got and got <= {other, "a", "a " + p}


@pytest.mark.parametrize("top", [4, 2**63])
def test_windows_of_many_stretches(top):
    rng = np.random.default_rng(2)
    for width in (1, 4, 46):
        ends = np.cumsum(rng.integers(0, 150, 30))
        starts, stops = np.r_[0, ends[:-1]], np.maximum(np.r_[0, ends[:-1]], ends - 4)
        v = rng.integers(0, top, int(ends[-1])).astype(np.uint64)
        want = [tuple(a + i for i in w) for a, b in zip(starts.tolist(), stops.tolist(), strict=True) for w in plain_windows(v[a:b].tolist(), width)]
        assert sorted(map(tuple, all_windows(v, starts, stops, width).tolist())) == sorted(want)


def test_hashes_of_many_texts():
    texts = ["left out", "  a b  C\td\n", None, "", "É x y z Ü", "\x0b\x0cq\x1cw r", "one", " "]
    hashes, ends = word_hashes(pa.array(texts).slice(1))
    assert [h.tolist() for h in np.split(hashes, ends[:-1])] == [Hashes().of(words(t)).tolist() for t in texts[1:]]


def plain_resumed(x, y, matched):
    out, i, j = [], 0, 0
    while i < len(x) and j < len(y):
        reach = passages.EDIT + matched // 4
        _, p, q = np.intersect1d(x[i : i + reach], y[j : j + reach], return_indices=True)
        for n in np.argsort(p + q, kind="stable").tolist():
            a, b = i + int(p[n]), j + int(q[n])
            long = next((k for k, (v, w) in enumerate(zip(x[a:], y[b:], strict=False)) if v != w), min(len(x) - a, len(y) - b))
            if long >= min(passages.SURE, len(x) - a, len(y) - b):
                break
        else:
            break
        out.append((a, b, long))
        i, j, matched = a + long, b + long, matched + long
    return out


def test_resuming_by_definition():
    rng = np.random.default_rng(3)
    for n in range(400):
        x, y = (rng.integers(0, (4, 40, 400)[n % 3], rng.integers(0, 300)).astype(np.uint64) for _ in range(2))
        if n % 2:
            y = np.r_[rng.integers(500, 600, rng.integers(0, 90)).astype(np.uint64), x[rng.random(len(x)) < 0.9]]
        assert resumed(x, y, 40 * (n % 20)) == plain_resumed(x, y, 40 * (n % 20))


def test_rounds_do_not_grow_with_a_bucket(spark, monkeypatch):
    """Documents that say one word more and more often, and near copies of a text: compared twice, and all that is repeated is found."""
    rng, tables = random.Random(15), []
    materialize = passages.materialize
    monkeypatch.setattr(passages, "materialize", lambda df: tables.append(df) or materialize(df))
    rows = [(i, " ".join(text(rng, 30, 20000) + ["and"] * (20 + 4 * i) + text(rng, 30, 20000))) for i in range(24)]
    base = text(rng, 200, 20000)
    rows += [(100 + i, " ".join(w if rng.random() > 0.04 else f"z{rng.randrange(9**9)}" for w in base)) for i in range(24)]
    found = repeated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(tables) <= 16
    got = {}
    for r in found:
        got.setdefault(r.doc, set()).update(range(r.start, r.start + r.words))
    for i, w in plain_repeated(rows, Passage()).items():
        assert w <= got[i]


def test_source_that_is_held_by_another(spark):
    """A passage that an edited one holds in its source is still found for a text in which none does."""
    rng = random.Random(16)
    p, ahead, behind = text(rng, 50, 20000), text(rng, 150, 20000), text(rng, 150, 20000)
    edited = [*p[:14], "e1", *p[15:32], "e2", *p[33:]]
    rows = [(1, " ".join(ahead + edited + behind)), (2, " ".join(ahead + p + behind)), (3, " ".join(text(rng, 90, 20000) + p + text(rng, 90, 20000)))]
    found = repeated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r.doc, r.source) for r in found} == {(2, 1), (3, 2)}
