from __future__ import annotations

import tracemalloc

import numpy as np

from lineferry.llm import vectors as V


def by_hand(rows, least=0.98):
    """Number of links and smallest reachable id of every usable row."""
    ids = [i for i, _, _ in rows]
    ok = [v is not None and x is not None and all(a is not None and np.isfinite(a) for a in x) and any(x) for _, x, v in rows]
    root, n = {i: i for i in ids}, {i: 0 for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for p, (i, x, a) in enumerate(rows):
        for q in range(p):
            j, y, b = rows[q]
            if ok[p] and ok[q] and a == b and len(x) == len(y) and V.cosine(np.array([x], float), np.array([y], float))[0] >= least:
                n[i], n[j] = n[i] + 1, n[j] + 1
                lo, hi = sorted((find(i), find(j)))
                root[hi] = lo
    return {i: (n[i], find(i)) for i in ids}


def clusters(seed, n, spread=0.08, size=24):
    rng, out = np.random.default_rng(seed), []
    while len(out) < n:
        base = rng.normal(size=size)
        for _ in range(rng.integers(1, 12)):
            out.append((base + spread * rng.normal(size=size)).tolist())
    return out[:n]


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, True) for r in rows], "vec_id bigint, embedding array<double>, label int, n_links int, kept boolean")
    return V.near_duplicates(df, **kw).collect()


def test_links_and_components(spark, monkeypatch):
    monkeypatch.setattr(V, "SHARD", 64)
    made = clusters(1, 500)
    rows = [(i * 2, x, i % 3 % 2) for i, x in enumerate(made)]
    rows += [(1001 + 2 * i, made[0], 0) for i in range(90)] + [(2001, [0.0] * 24, 0), (2003, None, 0), (2005, made[0], None), (2007, [None] + made[0][1:], 0),
             (2009, [float("nan")] + made[0][1:], 0), (2011, [float("inf")] + made[0][1:], 0), (2013, made[0][:5], 0), (2015, [1e200 * a for a in made[0]], 0), (2017, [-0.0] * 24, 0), (2019, [], 0)]
    got, want = run(spark, rows), by_hand(rows)
    assert len(got) == len(rows)
    there = sum(n for n, _ in want.values())
    assert sum(r.n_links for r in got) >= 0.98 * there
    assert all(r.n_links <= want[r.vec_id][0] for r in got)
    same = [(r.component_id, r.kept) == (want[r.vec_id][1], r.vec_id == want[r.vec_id][1]) for r in got]
    assert np.mean(same) > 0.97 and got[0].audited_recall > 0.95


def test_exact_where_one_shard_holds_all(spark):
    rows = [(i, x, 7) for i, x in enumerate(clusters(2, 300))]
    got = run(spark, rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == by_hand(rows)


def test_repeats_nulls_and_empty(spark):
    got = run(spark, [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (None, [1.0, 0.0], 0), (3, [1.0, 0.0], 0)])
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in got) == [(0, 0, 0), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 2, 1)]
    assert run(spark, []) == []


def test_pruning_keeps_the_nearest():
    rng = np.random.default_rng(0)
    x = V.unit(rng.normal(size=(60, 8)))
    sims = x @ x.T
    near = np.argsort(-sims[0])[1:49]
    kept = V.robust_prune(near, sims[np.ix_(np.r_[0, near], near)])
    assert kept[0] == near[0] and len(kept) <= V.DEGREE
    for j in set(near.tolist()) - set(kept):
        if len(kept) < V.DEGREE:
            assert any(V.SLACK * (1 - sims[c, j]) <= 1 - sims[0, j] for c in kept)


def test_memory_of_a_shard_of_near_copies():
    """All pairs of a shard link; what is worked on at once does not grow with them."""
    rng, n = np.random.default_rng(6), 700
    raw = rng.normal(size=64) + 0.05 * rng.normal(size=(n, 64))
    edges = np.stack([np.r_[(i + 1 + np.arange(16)) % n, rng.integers(0, n, 32)] for i in range(n)])
    tracemalloc.start()
    try:
        found = V.search(np.arange(n), raw, edges, 0.98)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(found) == n * (n - 1) // 2 and peak < 200 << 20


def test_searches_in_parts(monkeypatch):
    """The same links, however little is worked on at once."""
    rng = np.random.default_rng(7)
    raw = np.array(clusters(3, 150))
    edges = rng.integers(-1, 150, (150, 12))
    ids = rng.permutation(1000)[:150]
    want = {tuple(p) for p in np.asarray(V.search(ids, raw, edges, 0.9)).tolist()}
    monkeypatch.setattr(V, "WORK", 3000)
    got = V.search(ids, raw, edges, 0.9)
    assert want and {tuple(p) for p in np.asarray(got).tolist()} == want and len(got) == len(want)
