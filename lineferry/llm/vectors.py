"""Near-duplicate embeddings over a robust-pruned flat graph.

Vectors of one label are dealt to overlapping shards, each vector to the two nearest of the shard
centres, again and again until no shard is larger than ``SHARD``. In each shard every vector gets a
bounded list of neighbours by robust pruning, and a vector's lists from its shards are united. The
united graph is then searched in each shard: for every vector of it, greedily from the shard's
medoid towards the vector, and from what was found on through all neighbours within the range.
Found pairs are verified by their cosine in double precision, and a seeded sample of vectors is
compared with all others to audit how many links were found.

Equal vectors of one label, which may be a third of all rows, are one node with a count from the
start. Vectors that are null, zero, or hold null or non-finite components, and those without a
label, link with nothing; vectors of different length never link. Rows of one id are one node, which
holds together what its rows link with; a null id links with nothing. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineferry.llm.common import components, labelled, materialize

#: Vectors of a shard at most, and how many centres a larger one is split by, at most.
SHARD, CENTRES = 2048, 64
#: Vectors of a shard that its centres are fitted on, on average: those with the smallest hashes.
SAMPLE = 1024
#: Neighbours of a vector in one shard, candidates they are pruned from, pruning slack, beam of the search.
DEGREE, CANDIDATES, SLACK, BEAM = 16, 48, 1.2, 32
#: Bytes that one step of a search, or of verifying what it found, works on at once.
WORK = 32 << 20
#: Vectors that the audit compares with all others.
AUDIT = 256


def usable(vector: Column) -> Column:
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & good & F.exists(vector, lambda x: x != 0)


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # squares of tiny or huge components stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


# --- shards -----------------------------------------------------------------------------------


def centres(rows: pd.DataFrame) -> pd.DataFrame:
    """Spherical k-means of a shard's sample."""
    x = unit(matrix(rows["vector"]))
    k = min(CENTRES, max(4, -(-4 * int(rows["n"].iloc[0]) // SHARD)), len(x))
    c = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(8):
        near = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.where(norm > 0, norm, 1), c)
    return pd.DataFrame({"shard": rows["shard"].iloc[:1], "centres": [c.ravel().tolist()]})


def two_nearest(vectors: pd.Series, flat: pd.Series) -> pd.Series:
    out = []
    for v, c in zip(vectors, flat, strict=True):
        v = np.asarray(v, float)
        sims = np.asarray(c).reshape(-1, len(v)) @ v
        out.append(np.argsort(-sims, kind="stable")[:2].tolist())
    return pd.Series(out, dtype=object)


def shards(nodes: DataFrame) -> DataFrame:
    """``shard, id, vector`` with no shard above ``SHARD`` but where its vectors cannot be told apart."""
    placed = materialize(nodes.select(F.concat_ws("/", "label", F.size("vector")).alias("shard"), "id", "vector"))
    nearest = F.pandas_udf(two_nearest, "array<int>")
    before = None
    while True:
        sizes = placed.groupBy("shard").agg(F.count("*").alias("n"))
        large = materialize(sizes.where(F.col("n") > SHARD))
        now = large.agg(F.count("*"), F.max("n")).first()
        if not now[0] or before == tuple(now):
            return placed
        before = tuple(now)
        small = placed.join(large, "shard", "left_anti")
        rest = placed.join(large, "shard")
        drawn = rest.where(F.pmod(F.xxhash64("id", "shard"), F.lit(1 << 30)) < F.lit(SAMPLE << 30) / F.col("n"))
        fitted = materialize(drawn.groupBy("shard").applyInPandas(centres, "shard string, centres array<double>"))
        dealt = rest.join(fitted, "shard").select("shard", "id", "vector", F.explode(nearest("vector", "centres")).alias("c"))
        unfitted = rest.join(fitted, "shard", "left_anti").select(*small.columns)
        placed = materialize(small.unionByName(unfitted).unionByName(dealt.select(F.concat_ws(".", "shard", "c").alias("shard"), "id", "vector")))


# --- graph ------------------------------------------------------------------------------------


def robust_prune(near: np.ndarray, sims: np.ndarray) -> list[int]:
    """Nearest first, without those that a chosen one is nearer to, by the slack, than the vector itself."""
    chosen: list[int] = []
    own = 1 - sims[0]  # of the vector to its candidates; row i + 1: of candidate i to them
    alive = np.ones(len(near), bool)
    for i in range(len(near)):
        if alive[i]:
            chosen.append(int(near[i]))
            if len(chosen) == DEGREE:
                break
            alive &= SLACK * (1 - sims[i + 1]) > own
    return chosen


def neighbours(rows: pd.DataFrame) -> pd.DataFrame:
    """A shard's pruned graph with its reverse edges."""
    x = unit(matrix(rows["vector"]))
    ids, n = rows["id"].to_numpy(), len(rows)
    k = min(CANDIDATES, n - 1)
    lists: list[set[int]] = [set() for _ in range(n)]
    step = max(1, SHARD * SHARD // n)
    for at in range(0, n if k else 0, step):
        # Rows of similarities with all others, as many as a full shard's at once.
        sims = x[at : at + step] @ x.T
        sims[np.arange(len(sims)), np.arange(at, at + len(sims))] = -2
        near = np.argsort(-sims, axis=1, kind="stable")[:, :k]
        for i, own in enumerate(near, at):
            among = x[own] @ x[own].T
            np.fill_diagonal(among, 1)
            for j in robust_prune(own, np.vstack([sims[i - at, own], among])):
                lists[i].add(j)
                if len(lists[j]) < 2 * DEGREE:
                    lists[j].add(i)
    return pd.DataFrame({"id": ids, "out": [ids[sorted(s)].tolist() for s in lists]})


def search(ids: np.ndarray, raw: np.ndarray, edges: np.ndarray, least: float) -> pd.DataFrame:
    """Pairs ``a, b`` with cosine >= ``least`` that searches from the medoid find for every vector.

    ``edges`` holds each vector's neighbours by position, -1 behind the last. Searches take their steps
    together, as many as ``WORK`` allows; so do the vectors in range that are gone on from, and the pairs
    that are verified, of which a shard of near copies has as many as the square of its size.
    """
    x = unit(raw)
    n, (degree, size) = len(x), (edges.shape[1], x.shape[1])
    medoid = int((x @ x.mean(0)).argmax())
    found = np.zeros((n, n), bool)
    together = max(1, WORK // max(n, 8 * (BEAM + degree), 8 * degree * size))
    for at in range(0, n, together):
        _reach(x, edges, medoid, np.arange(at, min(n, at + together)), found, least)
    found |= found.T
    out, step = [], max(1, together, WORK // max(n, 32 * size))
    for at in range(0, n, rows := max(1, step // n)):
        a, b = np.nonzero(found[at : at + rows])
        a += at
        a, b = a[ids[a] < ids[b]], b[ids[a] < ids[b]]
        sure = [np.empty(0, bool), *(cosine(raw[a[i : i + step]], raw[b[i : i + step]]) >= least for i in range(0, len(a), step))]
        sure = np.concatenate(sure)
        out.append(np.stack([ids[a[sure]], ids[b[sure]]], axis=1))
    return pd.DataFrame(np.concatenate(out), columns=["a", "b"])


def _reach(x: np.ndarray, edges: np.ndarray, medoid: int, asked: np.ndarray, found: np.ndarray, least: float) -> None:
    """Marks in ``found`` what the searches for the vectors ``asked`` find."""
    n, m = len(x), len(asked)
    y, got = x[asked], found[asked[0] : asked[-1] + 1]
    seen = np.zeros((m, n), bool)
    beam = np.full((m, BEAM), -1)
    score = np.full((m, BEAM), -np.inf)
    done = np.ones((m, BEAM), bool)
    beam[:, 0], score[:, 0], done[:, 0], seen[:, medoid] = medoid, y @ x[medoid], False, True
    got[:, medoid] = score[:, 0] >= least - 1e-9
    active = np.arange(m)
    while len(active):
        open_scores = np.where(done[active], -np.inf, score[active])
        at = open_scores.argmax(1)
        active, at = active[going := np.isfinite(open_scores[np.arange(len(at)), at])], at[going]
        if not len(active):
            break
        done[active, at] = True
        next_ = edges[beam[active, at]]
        fresh = (next_ >= 0) & ~seen[active[:, None], next_]
        sims = np.where(fresh, np.einsum("qrd,qd->qr", x[next_], y[active]), -np.inf)
        q, r = np.nonzero(fresh)
        seen[active[q], next_[q, r]] = True
        hit = sims[q, r] >= least - 1e-9
        got[active[q[hit]], next_[q[hit], r[hit]]] = True
        ids_, all_, closed = (np.concatenate(p, axis=1) for p in ((beam[active], next_), (score[active], sims), (done[active], ~fresh)))
        best = np.argsort(-all_, axis=1, kind="stable")[:, :BEAM]
        rows = np.arange(len(active))[:, None]
        beam[active], score[active], done[active] = ids_[rows, best], all_[rows, best], closed[rows, best]
    # From every vector in range to its neighbours, as long as more come into range.
    step = max(1, WORK // (8 * max(edges.shape[1], 1) * 4))
    todo = [np.flatnonzero(got)]
    while todo:
        part = todo.pop()
        if len(part) > step:
            todo.append(part[step:])
            part = part[:step]
        next_ = edges[part % n]
        from_ = np.broadcast_to((part // n)[:, None], next_.shape)
        fresh = (next_ >= 0) & ~seen[from_, next_]
        new = np.unique(from_[fresh] * n + next_[fresh])
        seen.ravel()[new] = True
        near = max(1, WORK // (32 * x.shape[1]))
        for at in range(0, len(new), near):
            pairs = new[at : at + near]
            pairs = pairs[np.einsum("ij,ij->i", y[pairs // n], x[pairs % n]) >= least - 1e-9]
            if len(pairs):
                got.ravel()[pairs] = True
                todo.append(pairs)


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x, y = x / np.abs(x).max(1, keepdims=True), y / np.abs(y).max(1, keepdims=True)
    return np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))


def links_of(nodes: DataFrame, least: float) -> DataFrame:
    """Links ``a, b`` (a < b) between ``nodes(id, label, vector)`` of one label."""
    kind = nodes.schema["id"].dataType.simpleString()
    placed = shards(nodes)
    graph = placed.groupBy("shard").applyInPandas(neighbours, f"id {kind}, out array<{kind}>")
    united = graph.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("out"))).alias("out"))

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        ids = rows["id"].to_numpy()
        where = {v: i for i, v in enumerate(ids.tolist())}
        lists = [[where[v] for v in out if v in where] for out in rows["out"]]
        edges = np.full((len(ids), max(1, *map(len, lists))), -1)
        for i, near in enumerate(lists):
            edges[i, : len(near)] = near
        return search(ids, matrix(rows["vector"]), edges, least).astype(ids.dtype)

    found = placed.join(united, "id").groupBy("shard").applyInPandas(walk, f"a {kind}, b {kind}")
    return found.distinct()


def audit(nodes: DataFrame, links: DataFrame, least: float) -> tuple[int, int]:
    """Links of ``AUDIT`` vectors, drawn by hash: all there are, by brute force, and those found.

    The drawn vectors, a fixed number, go to every task and are compared with all others there.
    """
    drawn = nodes.orderBy(F.xxhash64("id"), "id").limit(AUDIT).collect()
    by_label: dict = {}
    for r in drawn:
        by_label.setdefault((r["label"], len(r["vector"])), []).append((r["id"], np.array(r["vector"], float)))

    @F.pandas_udf("bigint")
    def linked(columns: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ids, labels, vectors in columns:
            out = []
            for i, label, v in zip(ids, labels, vectors, strict=True):
                own = [(k, q) for k, q in by_label.get((label, len(v)), []) if k != i]
                v = np.asarray(v, float)[None]
                out.append(int((cosine(np.stack([q for _, q in own]), v) >= least).sum()) if own else 0)
            yield pd.Series(out, dtype="int64")

    there = nodes.select(linked("id", "label", "vector").alias("n")).agg(F.sum("n")).first()[0] or 0
    ids = [r["id"] for r in drawn]
    got = links.select(F.sum(F.col("a").isin(ids).cast("int") + F.col("b").isin(ids).cast("int"))).first()[0] or 0
    return int(there), int(got)


def near_duplicates(rows: DataFrame, least: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``key, n_links, component_id, kept`` for each row, and the audited share of links found."""
    given = rows.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    good = given.where(usable(F.col("vector")) & F.col("label").isNotNull() & F.col("id").isNotNull())
    # -0.0 and 0.0 are one value.
    good = good.withColumn("vector", F.transform("vector", lambda x: x + 0.0)).withColumn("h1", F.xxhash64("label", "vector")).withColumn("h2", F.xxhash64("vector", "label"))
    nodes = good.groupBy("label", "h1", "h2").agg(F.min(F.struct("id", "vector")).alias("first"), F.count_distinct("id").alias("copies"))
    nodes = materialize(nodes.select("label", "h1", "h2", F.col("first.id").alias("id"), F.col("first.vector").alias("vector"), "copies"))
    links = materialize(links_of(nodes, least))
    there, found = audit(nodes, links, least)
    # Copies count by their number: every copy links with all others and with all linked vectors' copies.
    counts = nodes.select("id", "copies")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    reached = both.join(counts.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.sum("copies").alias("others"))
    per_node = counts.join(reached.withColumnRenamed("a", "id"), "id", "left").select(F.col("id").alias("node"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    member = good.select("id", "label", "h1", "h2").join(nodes.select("label", "h1", "h2", F.col("id").alias("node")), ["label", "h1", "h2"]).select("id", "node").distinct()
    comps = components(links.unionByName(member.select(F.col("id").alias("a"), F.col("node").alias("b"))))
    linked = member.join(per_node, "node").groupBy("id").agg(F.max("n_links").alias("n_links"))
    out = labelled(given.select("id"), comps, "id", "component_id").join(linked, "id", "left")
    share = F.lit(found / there if there else 1.0)
    return out.select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), share.alias("audited_recall"),
    )
