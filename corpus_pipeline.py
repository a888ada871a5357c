"""A corpus pipeline over ``documents``: quality, repeated lines, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the
last return the columns of ``documents``. Nulls, repeats and empty tables are handled as the
operators' own descriptions say: a null text stays null through the filters, scores as an empty
text, and is packed as the end-of-text id; rows with a null id are never compared with others.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineferry.llm import lines, minhash, packing, passages, quality
from lineferry.llm.common import materialize, named, prepare, read, unused
from lineferry.llm.queries import THRESHOLD, remainder

#: The stages cannot be expressed in SQL; tests compare them with brute force.
ORACLE_SQL = None


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of the input, with the number of characters of the text as it is now."""
    n = F.when(F.col("text").isNotNull(), F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return docs.select(*[n.alias(c) if c == "n_chars" else c for c in columns])


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on four fifths of the labels, does not reject."""
    model = quality.fit(docs, read(spark, sf_dir, "labels"), learn=remainder(5) != 0)
    score = unused(docs, "score")["score"]
    return quality.score(docs, model, out=score).where(F.col(score) >= THRESHOLD).select(*map(named, docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat an earlier one."""
    return _measured(lines.dedup_lines(docs), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8."""
    groups = minhash.near_duplicates(docs, minhash.Near(size=5, percent=80))
    others = groups.where("not kept").select("doc_id").distinct().hint("merge")
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of fifty words or more that a smaller document has too."""
    return _measured(passages.without_passages(docs, passages.repeated(docs)), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_filter), ("line dedup", line_dedup), ("MinHash near-dedup", near_dedup),
    ("substring dedup", passage_dedup), ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each read back from what the one before it wrote."""
    docs = read(prepare(spark), sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
