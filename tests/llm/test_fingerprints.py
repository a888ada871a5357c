from __future__ import annotations

import hashlib

import numpy as np

from lineferry.llm.fingerprints import TERM, Terms, compare_with_next, document_frequencies, fingerprint, fingerprints, lexicon


def by_hand(rows, band):
    known, out = Terms(), []
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for n, (i, t) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = (fingerprint(x, known, band) for x in (t, edited, after))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), str(a), str(b), a.likeness(b), a.likeness(c)))
    return out


ROWS = [(5, "ä quick brown fox 🎉🎉 jumps"), (1, ""), (2, None), (9, "1234 !!"), (7, "quick brown fox jumps"), (7, "quick brown fox jumps"),
        (None, "no id here"), (30, "long text " * 9000), (31, "a"), (40, "quick brown dog")]


def test_next_documents_by_hand(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in ROWS], "doc_id bigint, text string, fingerprint string")
    band = lexicon(docs)
    for parts in (1, 3, 8):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = compare_with_next(docs).collect()
        key = lambda r: (r[0] is not None, *map(str, r))
        assert sorted(map(tuple, got), key=key) == sorted(by_hand(ROWS, band), key=key)
    spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_one_and_none(spark):
    one = spark.createDataFrame([(3, "only one here")], "doc_id bigint, text string")
    assert [r.near_next for r in compare_with_next(one).collect()] == [1.0]
    assert compare_with_next(one.limit(0)).count() == 0
    assert fingerprints(one.limit(0)).count() == 0


def test_counts_over_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    known, want = Terms(), {}
    for r in docs.collect():
        for t in set(TERM.findall((r.text or "").lower())):
            h = int(np.frombuffer(known[t], np.int64)[0])
            want[h] = want.get(h, 0) + 1
    assert {r.term: r.n for r in document_frequencies(docs, "text").collect()} == want
    n = docs.count()
    low, high = max(2, 0.002 * n), max(2, 0.2 * n)
    assert set(lexicon(docs).view(np.int64).tolist()) == {h for h, c in want.items() if low <= c <= high}


def test_equal_texts_and_likeness(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = compare_with_next(docs).collect()
    prints = {}
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        assert prints.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert np.mean([r.near_edited for r in rows]) > 3 * np.mean([r.near_next for r in rows])
