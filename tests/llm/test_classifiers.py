from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineferry.llm import quality, toxicity
from lineferry.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize(("name", "label", "least"), [("op8_quality", "quality", 0.97), ("op9_toxicity", "toxic", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(F.col(label).isNotNull())
    rows = QUERIES[name](spark, SF).join(labels, "doc_id").where("held_out").select("score", "predicted", F.col(label).alias("y")).collect()
    y, p = np.array([r.y for r in rows]), np.array([r.predicted for r in rows])
    assert len(rows) > 500 and (y == p).mean() >= least
    assert p[y == 0].mean() < 0.2 and p[y == 1].mean() > 0.7
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)
    # Calibrated: what is predicted on average is what is there.
    assert abs(np.mean([r.score for r in rows]) - y.mean()) < 0.05


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_rows(spark, module):
    texts = [(i, ("good plain words here " if i % 2 else "stupid !!! junk ### ") * 5) for i in range(80)]
    rows = [*texts, (200, None), (201, ""), (202, "word " * 60000), (None, "plain words"), (1, texts[1][1]), (1, texts[1][1])]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id bigint, text string, _y string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (5, None), (999, 0), (7, 1), (7, 0)], "doc_id bigint, y int")
    out = module.score(docs, module.fit(docs, labels, label="y")).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id == 1}) == 1
    assert next(r.score for r in out if r.doc_id == 200) == next(r.score for r in out if r.doc_id == 201)
    held = [r for r in out if r.doc_id is not None and 60 <= r.doc_id < 80]
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 2 == 1) for r in held]) == 1
    assert module.score(docs.limit(0), module.fit(docs.limit(0), labels, label="y")).count() == 0
    one = module.fit(docs, labels.where("y = 1"), label="y")
    assert module.score(docs, one).select("score").distinct().count() == 1


def test_vectors_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert (quality.neighbour_sums(docs.repartition(7)) == quality.neighbour_sums(docs.coalesce(1))).all()


def test_neighbour_sums_by_hand(spark):
    docs = spark.createDataFrame([("a b c b",), (None,), ("a",)], "text string")
    known, index, want = quality.Buckets(), quality.index_vectors(), np.zeros((quality.BUCKETS, quality.WIDTH))
    ids = known.of("a b c b")
    for i, w in enumerate(ids):
        for j in range(max(0, i - 2), min(len(ids), i + 3)):
            if j != i:
                want[w] += index[ids[j]]
    norm = np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(quality.neighbour_sums(docs), want / np.where(norm > 0, norm, 1), atol=1e-6)


def test_long_texts_by_pieces(spark, monkeypatch):
    """The pieces that a text is worked through in change neither sums nor features."""
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("max_by(text, length(text)) t").first().t
    known, index = quality.Buckets(), quality.index_vectors().astype(float)
    whole = quality.features(text, known, index)
    ids = known.of(text)
    v = index[ids]
    want = [v.mean(0), v.sum(0), index[np.unique(ids)].sum(0), (v[1:] * v[:-1]).mean(0)]
    want[1:3] = [np.sign(x) * np.log1p(np.abs(x)) for x in want[1:3]]
    assert np.allclose(whole, np.concatenate(want), atol=1e-5)
    monkeypatch.setattr(quality, "PIECE", 7)
    assert len(ids) > 100 and np.allclose(quality.features(text, known, index), whole, atol=1e-5)


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_pieces_of_neighbour_sums(spark, size):
    """Whatever the piece, neighbours across its ends count."""
    docs = spark.createDataFrame([("a b c b d e a a f g h i b",), ("x y",)], "text string")
    whole = quality.neighbour_sums(docs)
    known, index, want = quality.Buckets(), quality.index_vectors(), np.zeros((quality.BUCKETS, quality.WIDTH))
    for text in ("a b c b d e a a f g h i b", "x y"):
        ids = known.of(text)
        for i, w in enumerate(ids):
            for j in range(max(0, i - 2), min(len(ids), i + 3)):
                if j != i:
                    want[w] += index[ids[j]]
    norm = np.linalg.norm(want, axis=1, keepdims=True)
    want = want / np.where(norm > 0, norm, 1)
    assert np.allclose(whole, want, atol=1e-6) and np.allclose(quality.neighbour_sums(docs, piece=size), want, atol=1e-6)


@pytest.mark.parametrize("noise", [0.1, 0.3])
def test_temperature_makes_scores_probabilities(noise):
    """Labels turned over at random, which training overfits: over new rows no other temperature does much better.

    It need not beat a temperature of 1 there: it is fitted on 600 rows.
    """
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 20))
    y = ((x[:, 0] > 0) ^ (rng.random(6000) < noise)).astype(float)
    network = quality.Network(x[:3000], y[:3000])
    logits, new = network.logit(x[3000:]), y[3000:]
    loss = lambda t: np.mean(np.logaddexp(0, logits / t) - new * logits / t)
    assert loss(network.temperature) <= 1.02 * min(loss(t) for t in np.exp(np.linspace(-1.4, 2.1, 200)))


def test_pairs_say_what_neither_term_says():
    """Terms 1 and 2 are harmless alone and harmful together, among terms that mean nothing."""
    rng = np.random.default_rng(0)
    terms, y = [], []
    for _ in range(1500):
        a, b = rng.random(2) < 0.5
        terms.append(np.unique(np.r_[[1] * int(a), [2] * int(b), rng.integers(10, 40, 3)]).astype(np.int32))
        y.append(float(a and b))
    y = np.array(y)
    machine = toxicity.Machine(terms[:1000], y[:1000])
    assert np.mean((machine.score(terms[1000:]) >= 0.5) == y[1000:]) > 0.95
    only = machine.score([np.array([1], np.int32), np.array([2], np.int32), np.array([1, 2], np.int32)])
    assert only[2] > max(only[0], only[1])


@pytest.mark.parametrize(("others", "least"), [(4, 0.95), (100, 0.95), (200, 0.85)])
def test_pairs_in_long_texts(others, least):
    """Exactly one of terms 1 and 2, which no sum of weights can say, among many that mean nothing."""
    rng = np.random.default_rng(0)
    terms, y = [], []
    for _ in range(6000):
        a, b = rng.random(2) < 0.5
        terms.append(np.unique(np.r_[[1] * int(a), [2] * int(b), rng.choice(np.arange(10, 410), others, replace=False)]).astype(np.int32))
        y.append(float(a != b))
    y = np.array(y)
    machine = toxicity.Machine(terms[:5000], y[:5000])
    assert np.mean((machine.score(terms[5000:]) >= 0.5) == y[5000:]) >= least
