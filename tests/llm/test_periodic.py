from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lineferry.llm import periodic
from lineferry.llm.periodic import Runs, periodic_runs, runs_of, stretches
from lineferry.llm.queries import QUERIES


def by_hand(seq, how=Runs()):
    """All runs by trying every period at every place."""
    n, found = len(seq), []
    for q in range(1, n // how.times + 1):
        i = q
        while i < n:
            if seq[i] != seq[i - q]:
                i += 1
                continue
            j = i
            while j < n and seq[j] == seq[j - q]:
                j += 1
            s, size = i - q, j - i + q
            if size >= max(how.least, how.times * q) and not any(all(seq[k] == seq[k - p] for k in range(s + p, s + size)) for p in range(1, q)):
                found.append((s, size, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def sequences():
    rng = random.Random(7)
    for _ in range(300):
        out = []
        while len(out) < rng.randint(0, 160):
            unit = [rng.randrange(rng.choice((2, 3, 50))) for _ in range(rng.randint(1, 14))]
            out += (unit * rng.randint(1, 9))[: rng.randint(1, 90)]
        yield out
    word = [0]
    while len(word) < 300:  # Fibonacci words are full of runs within runs
        word = [y for x in word for y in ((0, 1) if x == 0 else (0,))]
    yield word
    yield [*word, *word, *word, *word]
    yield [5] * 400
    yield ([1] * 30 + [2] * 30) * 5


@pytest.mark.parametrize("how", [Runs(), Runs(least=3), Runs(least=10, times=4)])
def test_runs_against_every_period(how):
    met = 0
    for seq in sequences():
        want = by_hand(seq, how)
        met += len(want)
        assert runs_of(np.array(seq, np.int64), how) == want
        inside = stretches(np.array(seq, np.uint64), how)
        assert all(any(lo <= s and s + n <= hi for lo, hi in inside) for s, n, _ in want)
    assert met > 300


def test_clean_words_are_not_walked():
    assert stretches(np.arange(10_000, dtype=np.uint64), Runs()) == []
    far = np.r_[np.arange(1000), np.arange(100), np.arange(5000, 9000)].astype(np.uint64)
    assert stretches(far, Runs()) == []


def test_automaton_time_is_near_linear():
    """Segments met while a long repeating sequence is read stay within n log n."""
    for unit, times in ((list(range(500)), 40), ([1], 20_000), ([1, 2, 1, 1, 2], 4000)):
        automaton, met, n = periodic.Automaton(), 0, 0
        for i, w in enumerate(unit * times):
            met += len(automaton.recolour(automaton.append(w), i))
            n += 1
        assert met < 2 * n * np.log2(n)


ROWS = [(1, "a b c " * 20), (2, None), (3, ""), (4, "x " * 30), (4, "x " * 30), (None, "no\tid\n" * 12 + "end"), (5, "A a " * 12 + "\x0bB\x0c" * 40), (6, "ä🎉 ß x " * 15 + "tail"),
        (7, "w%d " * 3000 % tuple(range(3000)) + "p q r s " * 2000)]


def test_rows(spark):
    docs = spark.createDataFrame([(*r, "kept", 1, 2) for r in ROWS], "doc_id bigint, text string, RUNS string, _found int, `a.b` int").repartition(3)
    got = periodic_runs(docs)
    assert got.columns == ["doc_id", "text", "_found", "a.b", "runs", "best", "collapsed"]
    rows = got.collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        want = by_hand(words) if len(words) < 500 else [(3000, 8000, 4)]
        assert [tuple(x) for x in r.runs] == want
        best = min(want, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        assert (r.best and tuple(r.best)) == best
        assert r.collapsed == collapsed(words, want)
    assert periodic_runs(docs.limit(0)).count() == 0


def test_query_by_hand(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op11_periodic"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        ids = {w: k for k, w in enumerate(dict.fromkeys(words))}
        want = runs_of(np.array([ids[w] for w in words], np.int64), Runs())  # the whole text, nothing left out before
        best = min(want, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
        digest = hashlib.sha256("".join(f"{s},{size},{q}\n" for s, size, q in want).encode()).hexdigest()
        assert tuple(r) == (r.doc_id, len(want), *best, best[0] is not None and 1000 * best[1] // best[2] or None, digest, hashlib.sha256(collapsed(words, want).encode()).hexdigest())
