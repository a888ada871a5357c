from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from lineferry.llm.lines import Fuzzy
from lineferry.llm.queries import QUERIES
from test_lines import by_hand as lines_by_hand
from test_lines import candidates
from test_minhash import by_hand as groups_by_hand
from test_passages import Passage, plain_repeated

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """What goes into each stage and, last, the result."""
    docs, out = P.read(spark, SF, "documents"), []
    for _, stage in P.STAGES:
        out.append(docs)
        docs = P.materialize(stage(spark, docs, SF))
    return [*out, docs]


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_quality_rejects_what_its_query_rejects(spark, steps):
    want = {r.doc_id for r in QUERIES["op8_quality"](spark, SF).collect() if r.predicted}
    assert set(texts(steps[1])) == want
    labels = {r.doc_id: r.quality for r in P.read(spark, SF, "labels").collect()}
    held = [i for i in texts(steps[0]) if labels.get(i) is not None and zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((i in want) == bool(labels[i]) for i in held) >= 0.9 * len(held)


def test_lines(spark, steps):
    rows = list(texts(steps[1]).items())
    want, _ = lines_by_hand(spark, rows, Fuzzy(), candidates(spark, rows, Fuzzy()))
    assert texts(steps[2]) == want


def test_near_duplicates(steps):
    rows = texts(steps[2])
    group = groups_by_hand(list(rows.items()), 5)
    assert set(texts(steps[3])) == {i for i in rows if group[i] == i}


def test_passages(steps):
    before, after = texts(steps[3]), texts(steps[4])
    repeats = plain_repeated(list(before.items()), Passage())
    assert set(after) == set(before)
    for i, t in before.items():
        kept = [w for n, w in enumerate(t.split()) if n not in repeats.get(i, ())]
        if i in repeats:
            assert len((after[i] or "").split()) <= len(kept)
    assert not plain_repeated(list(after.items()), Passage())
    touched = [i for i in before if before[i] != after[i]]
    assert len(touched) < 0.2 * len(before)


def test_columns_and_lengths(spark, steps):
    names = P.read(spark, SF, "documents").columns
    for df in steps[:-1]:
        assert df.columns == names
    assert steps[4].where(F.length("text") != F.col("n_chars")).count() == 0


def test_packs_every_document_once(steps):
    rows = steps[5].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert {r.doc_id for r in rows} == set(texts(steps[4])) and all(r.n == r.t for r in rows)


def test_odd_rows(spark):
    long = "some words of a line that is long enough " * 3
    rows = [(1, long, "en", "s", 5, "x"), (None, long, None, None, None, None), (2, None, "en", None, None, "y"), (3, "", None, "s", 0, None), (1, long, "en", "s", 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score string")
    for frame, n in ((docs, 5), (docs.limit(0), 0)):
        for name, stage in P.STAGES[1:-1]:
            out = stage(spark, frame, SF)
            assert out.columns == docs.columns and (out.count() == n or name == "quality classifier")
        assert (P.pack(spark, frame, SF).count() > 0) == (n > 0)
    assert P.quality_filter(spark, docs, SF).columns == docs.columns
    assert P.quality_filter(spark, docs.limit(0), SF).count() == 0
