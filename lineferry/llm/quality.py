"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network.

Every token class has a fixed sparse random index vector. A class's word vector is the sum of the
index vectors of its neighbours, over all tokens of all documents: whole-number sums, so they are
the same however the rows were dealt. Classes are hash buckets, so the table of vectors has one
fixed size whatever the vocabulary. Nothing but these vectors tells the network of a document; they
are pooled in four ways: the mean over its tokens, their sum and the sum over its distinct tokens (as
signed logarithms, so that length and variety show), and the mean product of neighbouring tokens'
vectors, which is how alike neighbours are in each direction. The network is trained in numpy on at
most ``SAMPLE`` labelled rows, and a temperature fitted on a part of them that training did not see
makes its output a probability. Texts are worked through ``PIECE`` tokens at a time.

Null texts count as empty; an empty text gets the score that the network gives to no tokens. Rows
are scored one by one, so repeated rows and null ids need no care. Labels that are null or belong to
no document are not learned from; with labels of fewer than two kinds the score is their smoothed
share. Other columns are passed through, whatever their names but those of the result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineferry.llm.common import arrow_map

#: Labelled rows that the network is fitted on, at most: those with the smallest hashes of their ids.
SAMPLE = 20_000
BUCKETS, WIDTH, BLOCK, NONZERO, WINDOW = 8192, 32, 128, 4, 2
POOLS = 4
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 30, 256, 3e-3, 1e-4
#: Tokens of one text whose vectors are held at a time; partial tables that are added in a first step.
PIECE, PARTS = 1 << 16, 256

TOKEN = re.compile(r"[^\W\d_]+|\d+|(?:[^\w\s]|_)+")


class Buckets(dict):
    """Bucket by token; words in capitals are other tokens than the same words in small letters."""

    most = 300_000

    def __missing__(self, token: str) -> int:
        shape = token if len(token) > 1 and token.isupper() else token.lower()
        value = xxhash.xxh3_64_intdigest(shape) % BUCKETS
        if len(self) < self.most:
            self[token] = value
        return value

    def of(self, text: str | None) -> np.ndarray:
        found = TOKEN.findall(text) if text else []
        return np.fromiter(map(self.__getitem__, found), np.int32, len(found))


def index_vectors() -> np.ndarray:
    """Sparse vectors of +1 and -1, from a fixed seed."""
    rng = np.random.default_rng(20)
    out = np.zeros((BUCKETS, WIDTH), np.int32)
    for k in range(NONZERO):
        out[np.arange(BUCKETS), rng.integers(0, WIDTH, BUCKETS)] += rng.choice([-1, 1], BUCKETS)
    return out


def neighbour_sums(docs: DataFrame, text: str = "text", piece: int = PIECE) -> np.ndarray:
    """Word vectors: the sum of the index vectors within two tokens, over all documents.

    A task adds up its own table and hands out its blocks, which are added in two steps: by block
    and one of ``PARTS`` parts, then by block, each task reading on from row to row with one table in
    memory. Only the one summed table, of a fixed two megabytes, reaches the driver.
    """

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        index, known, table = index_vectors(), Buckets(), np.zeros((BUCKETS, WIDTH), np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                ids = known.of(t)
                for at in range(0, len(ids) if len(ids) > 1 else 0, piece):
                    here = ids[at : at + piece]
                    # With the neighbours on both sides, whose own sums belong to other pieces.
                    lead = min(at, WINDOW)
                    around = ids[at - lead : at + piece + WINDOW]
                    told, near = index[around], np.zeros((len(around), WIDTH), np.int32)
                    for d in range(1, WINDOW + 1):
                        near[d:] += told[:-d]
                        near[:-d] += told[d:]
                    near = near[lead : lead + len(here)]
                    order = np.argsort(here, kind="stable")
                    kinds, first = np.unique(here[order], return_index=True)
                    table[kinds] += np.add.reduceat(near[order], first, axis=0)
        yield blocks(table)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        table = np.zeros((BUCKETS, WIDTH), np.int64)
        parts = table.reshape(-1, BLOCK, WIDTH)
        for batch in batches:
            for block, sums in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                parts[block] += np.frombuffer(sums, np.int64).reshape(BLOCK, WIDTH)
        yield blocks(table)

    schema = "block int, sums binary"
    tasks = arrow_map(docs.select(text), add_up, schema).withColumn("part", F.spark_partition_id() % PARTS)
    first = arrow_map(tasks.repartition("block", "part").select("block", "sums"), added, schema)
    out = np.zeros((BUCKETS // BLOCK, BLOCK, WIDTH))
    for row in arrow_map(first.repartition("block"), added, schema).collect():
        out[row["block"]] = np.frombuffer(row["sums"], np.int64).reshape(BLOCK, WIDTH)
    out = out.reshape(BUCKETS, WIDTH)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def blocks(table: np.ndarray) -> dict:
    """The rows of a table of vectors in blocks, without those that are all zero."""
    parts = table.reshape(-1, BLOCK, WIDTH)
    used = [i for i in range(len(parts)) if parts[i].any()]
    return {"block": pa.array(used, pa.int32()), "sums": pa.array([parts[i].tobytes() for i in used], pa.binary())}


def features(text: str | None, known: Buckets, vectors: np.ndarray) -> np.ndarray:
    """Word vectors pooled: mean, sum, sum of distinct tokens', mean product of neighbours'."""
    ids = known.of(text)
    n = len(ids)
    if not n:
        return np.zeros(POOLS * WIDTH, np.float32)
    counts = np.bincount(ids, minlength=BUCKETS)
    kinds = np.flatnonzero(counts)
    total, distinct, products = counts[kinds] @ vectors[kinds], vectors[kinds].sum(0), np.zeros(WIDTH)
    for at in range(0, n - 1, PIECE):
        v = vectors[ids[at : at + PIECE + 1]]
        products += np.einsum("ij,ij->j", v[1:], v[:-1])
    return np.concatenate([total / n, _signed_log(total), _signed_log(distinct), products / max(n - 1, 1)]).astype(np.float32)


def _signed_log(x: np.ndarray) -> np.ndarray:
    return np.sign(x) * np.log1p(np.abs(x))


class Network:
    """One hidden layer and one output, on standardised inputs, with a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        rng = np.random.default_rng(8)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        z = (x - self.mean) / self.scale
        held = rng.random(len(y)) < 0.2
        w1, w2 = rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN)
        self.layers = [w1, np.zeros(HIDDEN), w2, np.zeros(1)]
        first, second = [np.zeros_like(w) for w in self.layers], [np.zeros_like(w) for w in self.layers]
        train, step = np.flatnonzero(~held), 0
        for _ in range(EPOCHS):
            rng.shuffle(train)
            for at in range(0, len(train), BATCH):
                rows, step = train[at : at + BATCH], step + 1
                hidden = np.maximum(z[rows] @ self.layers[0] + self.layers[1], 0)
                error = (_sigmoid(hidden @ self.layers[2] + self.layers[3]) - y[rows]) / len(rows)
                back = np.outer(error, self.layers[2]) * (hidden > 0)
                slopes = [z[rows].T @ back, back.sum(0), hidden.T @ error, np.array([error.sum()])]
                for i, g in enumerate(slopes):  # Adam
                    first[i] += 0.1 * (g - first[i])
                    second[i] += 0.001 * (g * g - second[i])
                    move = first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
                    self.layers[i] = self.layers[i] - RATE * (move + DECAY * self.layers[i])
        self.temperature = 1.0
        if len(np.unique(y[held])) > 1:
            logits, tried = self.logit(x[held]), np.exp(np.linspace(np.log(0.25), np.log(8), 61))
            loss = [np.mean(np.logaddexp(0, logits / t) - y[held] * logits / t) for t in tried]
            self.temperature = float(tried[int(np.argmin(loss))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum(((x - self.mean) / self.scale) @ self.layers[0] + self.layers[1], 0)
        return hidden @ self.layers[2] + self.layers[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logit(x) / self.temperature)


class Share:
    """The score where there is nothing to tell labels apart by."""

    def __init__(self, y: np.ndarray):
        self.value = (y.sum() + 1) / (len(y) + 2)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def sampled(docs: DataFrame, labels: DataFrame, label: str, learn: Column, key: str, text: str) -> DataFrame:
    """``text`` and label of at most :data:`SAMPLE` labelled rows, in the order of their ids' hashes.

    The sample's ids are broadcast: ``SAMPLE`` rows at most.
    """
    wanted = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & learn).select(key, F.col(label).cast("int").alias("_y"))
    # Labels given more than once count once; contradictory ones go by the larger.
    wanted = wanted.groupBy(key).agg(F.max("_y").alias("_y")).orderBy(F.xxhash64(key), key).limit(SAMPLE)
    return docs.select(key, text).join(F.broadcast(wanted), key)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", learn: Column | None = None, key: str = "doc_id", text: str = "text"):
    """Word vectors over all documents, and a network on the sampled ones that ``learn`` admits."""
    vectors = neighbour_sums(docs, text)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        known = Buckets()
        for batch in batches:
            x = [features(t, known, vectors).tobytes() for t in batch.column(1).to_pylist()]
            yield {"k": batch.column(0), "x": pa.array(x, pa.binary()), "y": batch.column(2)}

    rows = sampled(docs, labels, label, F.lit(True) if learn is None else learn, key, text)
    kind = docs.schema[key].dataType.simpleString()
    found = sorted((r["k"], r["x"], r["y"]) for r in arrow_map(rows.select(key, text, "_y"), pooled, f"k {kind}, x binary, y int").collect())
    y = np.array([r[2] for r in found], float)
    if len(np.unique(y)) < 2:
        return vectors, Share(y)
    return vectors, Network(np.stack([np.frombuffer(r[1], np.float32) for r in found]).astype(float), y)


def score(docs: DataFrame, model: tuple, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1; the fitted model, of a fixed size, goes to every task."""
    vectors, network = model

    @F.pandas_udf("double")
    def judge(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Buckets()
        for texts in columns:
            x = np.array([features(t, known, vectors) for t in texts], float).reshape(len(texts), -1)
            yield pd.Series(network.score(x) if len(x) else [], dtype=float)

    return docs.withColumn(out, judge(text))
