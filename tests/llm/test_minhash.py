from __future__ import annotations

import random

import numpy as np
import pytest

from lineferry.llm import common, minhash
from lineferry.llm.minhash import Near, near_duplicates, parities, superminhash


def shingle_set(text, size):
    w = (text or "").encode().lower().split()
    n = min(size, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


def by_hand(rows, size):
    """Components of all pairs with 100 * intersection >= 80 * union."""
    docs = sorted((i, shingle_set(t, size)) for i, t in rows if i is not None)
    root = {i: i for i, _ in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (a, x) in enumerate(docs):
        for b, y in docs[:k]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {i: find(i) for i, _ in docs}


def test_signature_is_the_rank_order_of_its_elements():
    def plain(elements, slots):
        from lineferry.llm.common import mix

        out = [float("inf")] * slots
        for e in elements:
            order = list(range(slots))
            for rank in range(slots):
                drawn = mix(np.array([e], np.uint64) + np.uint64((2 * rank + 1) * 0x9E3779B97F4A7C15 % 2**64))
                k = rank + int(drawn[0] % np.uint64(slots - rank))
                order[rank], order[k] = order[k], order[rank]
                out[order[rank]] = min(out[order[rank]], rank + float((mix(drawn) >> np.uint64(11))[0]) * 2.0**-53)
        return out

    rng = np.random.default_rng(0)
    for n in (1, 2, 9, 40, 300):
        e = rng.integers(0, 2**63, n).astype(np.uint64)
        assert superminhash(e, 16).tolist() == plain(e, 16)


def test_estimates_similarity():
    rng, errors = np.random.default_rng(1), []
    for _ in range(60):
        e = rng.integers(0, 2**63, 300).astype(np.uint64)
        a, b = superminhash(e[:200], 160), superminhash(e[100:], 160)
        errors.append((a == b).mean() - 1 / 3)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < np.sqrt(2 / 9 / 160)


def made(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, 9)):
            other = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 9))):
                other[rng.randrange(len(other))] = rng.choice(vocabulary)
            rows.append(" ".join(other))
    rng.shuffle(rows)
    return [(3 * i + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("size", [2, 5])
@pytest.mark.parametrize("rounds", [False, True])
def test_groups_by_hand(spark, size, rounds, monkeypatch):
    if rounds:  # a member of a bucket, then two, four and so on
        monkeypatch.setattr(common, "PIVOTS", 1)
        monkeypatch.setattr(common, "GROWTH", 2)
    rows = [*made(), (2, None), (5, ""), (8, " \n"), (11, "One"), (14, "one"), (17, "É one"), (20, "é one"), (23, "x " * 30000), (26, "X " * 29000), (None, "one")]
    docs = spark.createDataFrame([(i, t, 1, True) for i, t in rows], "doc_id bigint, text string, n_shingles int, kept boolean")
    got = near_duplicates(docs, Near(size)).collect()
    want = by_hand(rows, size)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (want[r.doc_id], r.doc_id == want[r.doc_id])
            assert r.n_shingles == len(shingle_set(dict(rows)[r.doc_id], size))


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a b c"), (2, "x y z"), (3, "x y z")], "doc_id int, text string")
    assert sorted((r.doc_id, r.component_id) for r in near_duplicates(docs).collect()) == [(1, 1), (1, 1), (2, 1), (2, 1), (3, 1)]
    assert near_duplicates(docs.limit(0)).count() == 0


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = by_hand(rows, 2)
    assert {r.doc_id: r.component_id for r in near_duplicates(docs, Near(2)).collect()} == want


def edited_copies(n, seed=7):
    """Copies of one text with up to a tenth of their words changed: about a third link with few others or none."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(n):
        other = list(base)
        for at in rng.sample(range(len(base)), rng.randint(0, 15)):
            other[at] = f"e{i}x{at}"
        rows.append((i + 1, " ".join(other)))
    return rows


def test_members_far_apart_are_not_compared_one_by_one(spark, monkeypatch):
    rows, compared, plain = edited_copies(300), [], minhash.link_buckets

    def counting(members, details, contents, compare, *more):
        def counted(pairs):
            compared.append(pairs.count())
            return compare(pairs)

        return plain(members, details, contents, counted, *more)

    monkeypatch.setattr(minhash, "link_buckets", counting)
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), Near(2)).collect()}
    want = by_hand(rows, 2)
    assert got == want and 50 < sum(i == c for i, c in want.items()) < 250
    # Those before were measured against the smallest ids of their buckets.
    assert sum(compared[1:]) < 5 * len(rows)


def test_parities_differ_in_no_more_places_than_the_sets():
    rng = np.random.default_rng(2)
    for n in (1, 30, 150, 3000):
        e = np.unique(rng.integers(0, 2**63, 3 * n).astype(np.uint64))
        for shift in (1, n // 7, n):
            x, y = e[: 2 * n], e[shift : 2 * n + shift]
            differ = sum(bin(v).count("1") for v in (parities(x) ^ parities(y)).view(np.uint64).tolist())
            most = len(np.setxor1d(x, y))
            assert differ <= most and (most - differ) % 2 == 0
            if most < 64:
                assert differ >= 0.8 * most
        assert not parities(x[:0]).any()
