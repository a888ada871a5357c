"""Toxicity: a factorization machine over hashed terms.

A text's score is the logistic of a bias, a weight for each of its distinct terms, and the inner
product of the factors of each two of them, so that two terms may say together what neither says
alone. It is trained in numpy by gradient steps on at most ``SAMPLE`` labelled rows: first the weights
alone, then factors and weights on what the weights leave. A pair counts alike in short and long
texts, and each factor has its own rate, which its past gradients shrink. Terms of fewer than
``LEAST`` sampled documents are left out, and what a text's terms add is compared with what the
same model says of no terms.

Null texts count as empty and get the bias alone. Rows are scored one by one, so repeated rows and
null ids need no care. Labels that are null or belong to no document are not learned from; with
labels of fewer than two kinds the score is their smoothed share. Other columns are passed through.
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
from lineferry.llm.quality import SAMPLE, Share, sampled

__all__ = ["SAMPLE", "Machine", "fit", "score"]

SLOTS, FACTORS, EPOCHS, RATE, LEAST = 1 << 19, 8, 12, 0.1, 8
DECAY = 1e-4
#: Spread of the factors at the start, their rate, and that of the weights beside them.
START, PAIR_RATE, LATE_RATE = 0.001, 0.01, 0.01
#: A word's terms are the word and its beginnings of these lengths: stems of inflected insults.
STEMS = (4, 5, 6)

TERM = re.compile(r"\w+")


class Slots(dict):
    """Slots of a lower-case word's terms, as bytes."""

    most = 300_000

    def __missing__(self, word: str) -> bytes:
        terms = [word, *(f"{word[:n]}-" for n in STEMS if len(word) > n)]
        value = np.array([xxhash.xxh3_64_intdigest(t) % SLOTS for t in terms], np.int32).tobytes()
        if len(self) < self.most:
            self[word] = value
        return value

    def of(self, text: str | None) -> np.ndarray:
        found = set(TERM.findall(text.lower())) if text else set()
        return np.unique(np.frombuffer(b"".join(map(self.__getitem__, found)), np.int32))


class Machine:
    """Weights and factors by slot."""

    def __init__(self, terms: list[np.ndarray], y: np.ndarray):
        rng = np.random.default_rng(9)
        held = np.bincount(np.concatenate(terms), minlength=SLOTS)
        self.used = held >= LEAST
        self.weights, self.factors = np.zeros(SLOTS), rng.normal(0, START, (SLOTS, FACTORS))
        self.bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        terms = [t[self.used[t]] for t in terms]
        order = np.arange(len(y))
        for epoch in range(EPOCHS):
            rng.shuffle(order)
            rate = RATE / (1 + epoch)
            for i in order.tolist():
                t = terms[i]
                w = self.weights[t]
                error = self._chance(self.bias + w.sum()) - y[i]
                # One rate for all terms: a term moves by how often it errs, so rare ones stay small.
                self.weights[t] = w - rate * (error + DECAY * w)
        steps = np.full((SLOTS, FACTORS), 1e-2)
        for _ in range(EPOCHS):
            rng.shuffle(order)
            for i in order.tolist():
                t = terms[i]
                if not len(t):
                    continue
                error = self._chance(self._raw(t)) - y[i]
                v = self.factors[t]
                slope = error * (v.sum(0) - v)
                self.weights[t] -= LATE_RATE * (error + DECAY * self.weights[t])
                steps[t] += slope * slope
                self.factors[t] = v - PAIR_RATE * slope / np.sqrt(steps[t])
        self.weights, self.factors = self.weights.astype(np.float32), self.factors.astype(np.float32)

    @staticmethod
    def _chance(raw: float) -> float:
        return 1 / (1 + np.exp(-np.clip(raw, -60, 60)))

    def _raw(self, t: np.ndarray) -> float:
        if not len(t):
            return self.bias
        v = self.factors[t]
        total = v.sum(0)
        pairs = (total @ total - np.einsum("ij,ij->", v, v)) / 2
        return float(np.clip(self.bias + self.weights[t].sum() + pairs, -60, 60))

    def score(self, terms: list[np.ndarray]) -> np.ndarray:
        return np.array([1 / (1 + np.exp(-self._raw(t[self.used[t]]))) for t in terms])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", learn: Column | None = None, key: str = "doc_id", text: str = "text"):
    """A machine fitted on the sampled rows that ``learn`` admits; their term sets reach the driver."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        known = Slots()
        for batch in batches:
            x = [known.of(t).tobytes() for t in batch.column(1).to_pylist()]
            yield {"k": batch.column(0), "x": pa.array(x, pa.binary()), "y": batch.column(2)}

    rows = sampled(docs, labels, label, F.lit(True) if learn is None else learn, key, text)
    kind = docs.schema[key].dataType.simpleString()
    found = sorted((r["k"], r["x"], r["y"]) for r in arrow_map(rows.select(key, text, "_y"), slots, f"k {kind}, x binary, y int").collect())
    y = np.array([r[2] for r in found], float)
    if len(np.unique(y)) < 2:
        return Share(y)
    return Machine([np.frombuffer(r[1], np.int32) for r in found], y)


def score(docs: DataFrame, model: Machine | Share, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1; the fitted model, of a fixed size, goes to every task."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def judge(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Slots()
        for texts in columns:
            yield pd.Series(sent.value.score([known.of(t) for t in texts]), dtype=float)

    return docs.withColumn(out, judge(text))
