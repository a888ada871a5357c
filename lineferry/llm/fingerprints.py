"""Document fingerprints: I-Match with randomised lexicon subsets.

The lexicon holds the terms whose inverse document frequency lies in a chosen band, counted over all
documents. A document keeps its distinct terms of the lexicon, sorted, and they are hashed once
whole and once for each of several random subsets of the lexicon. The subsets keep from a quarter
down to about a thousandth of the lexicon, so that two texts agree in the more of them the more of
their terms they share: likeness is the share of equal hashes among the subsets in which either
text has terms.

A text without terms of the lexicon is fingerprinted by all its terms, and one without any term by
the whole text. Null texts count as empty; all empty texts have one fingerprint, and are as like as
any equal texts. Equal texts have equal fingerprints whatever the other columns hold.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lineferry.llm.common import arrow_map, materialize, named, release
from lineferry.session import BROADCAST_BYTES

TERM = re.compile(r"[^\W\d_]+")
#: Share of the documents that a term of the lexicon is in, from and to: idf from 1.6 to 6.2.
RAREST, COMMONEST = 0.002, 0.2
#: Random subsets: four each that keep 1/4, 1/8, ... 1/1024 of the lexicon.
HALVINGS = np.repeat(np.arange(2, 11), 4)
FACTORS = np.random.default_rng(2).integers(0, 2**63, len(HALVINGS)).astype(np.uint64)[:, None] | np.uint64(1)
SHIFTS = np.uint64(64) - HALVINGS.astype(np.uint64)[:, None]


class Terms(dict):
    """Hashes of the terms in what stands between white space, as bytes; no term goes across it."""

    most = 400_000

    def __missing__(self, chunk: str) -> bytes:
        found = [xxhash.xxh3_64_intdigest(t) for t in TERM.findall(chunk.lower())]
        value = np.array(found, np.uint64).tobytes()
        if len(self) < self.most:
            self[chunk] = value
        return value

    def of(self, text: str) -> np.ndarray:
        """Sorted hashes of the distinct terms."""
        return np.unique(np.frombuffer(b"".join(map(self.__getitem__, set(text.split()))), np.uint64))


@dataclass(frozen=True)
class Fingerprint:
    whole: int
    subsets: np.ndarray  # 0 where the text has no term

    def __bytes__(self) -> bytes:
        return self.whole.to_bytes(8, "big") + self.subsets.astype(">u4").tobytes()

    def __str__(self) -> str:
        return bytes(self).hex()

    def likeness(self, other: Fingerprint) -> float:
        either = (self.subsets != 0) | (other.subsets != 0)
        if self.whole == other.whole or not either.any():
            return float(self.whole == other.whole)
        return float(((self.subsets == other.subsets) & either).sum() / either.sum())


def document_frequencies(docs: DataFrame, text: str) -> DataFrame:
    """``term`` (its hash) and in how many documents it is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        known, held, size = Terms(), [], 0
        for batch in batches:
            held += [known.of(t) for t in batch.column(0).to_pylist() if t]
            size = sum(map(len, held))
            if size > 2_000_000:
                yield _counted(held)
                held = []
        if held:
            yield _counted(held)

    counts = arrow_map(docs.select(text), count, "term bigint, n bigint")
    return counts.groupBy("term").agg(F.sum("n").alias("n"))


def _counted(held: list[np.ndarray]) -> dict:
    terms, n = np.unique(np.concatenate(held), return_counts=True)
    return {"term": terms.view(np.int64), "n": n}


def lexicon(docs: DataFrame, text: str = "text", rarest: float = RAREST, commonest: float = COMMONEST) -> np.ndarray:
    """Sorted hashes of the terms in the band, counted over all documents.

    At most (mean distinct terms of a document) / ``rarest`` terms can be in ``rarest`` of the
    documents, however many there are, so the lexicon fits a task; that is checked all the same.
    """
    total = docs.count()
    counts = document_frequencies(docs, text)
    band = counts.where(F.col("n").between(max(2, rarest * total), max(2, commonest * total)))
    most = BROADCAST_BYTES // 8
    found = band.select("term").limit(most + 1).toArrow().column("term").to_numpy()
    del counts, band
    release(docs.sparkSession)
    if len(found) > most:
        raise ValueError("the band holds more terms than a task can hold; narrow it")
    return np.sort(found.view(np.uint64))


def fingerprint(text: str, known: Terms, band: np.ndarray) -> Fingerprint:
    every = known.of(text)
    terms = every[band[np.minimum(np.searchsorted(band, every), len(band) - 1)] == every] if len(band) else every[:0]
    if not len(terms):
        terms = every if len(every) else np.array([xxhash.xxh3_64_intdigest(text)], np.uint64)
    # A subset holds the terms whose hash, times its own factor, starts with so many zeros.
    drawn = terms * FACTORS >> SHIFTS == 0
    where, which = np.nonzero(drawn)
    ends = np.searchsorted(where, np.arange(len(HALVINGS) + 1)).tolist()
    chosen = terms[which].tobytes()
    subsets = [xxhash.xxh32_intdigest(chosen[8 * i : 8 * j]) or 1 if j > i else 0 for i, j in zip(ends, ends[1:], strict=False)]
    return Fingerprint(xxhash.xxh3_64_intdigest(terms.tobytes()), np.array(subsets, np.uint32))


def fingerprints(docs: DataFrame, text: str = "text", band: np.ndarray | None = None) -> DataFrame:
    """``docs`` with ``fingerprint``; equal fingerprints, or many equal parts, mean like documents."""
    terms = lexicon(docs, text) if band is None else band

    @F.pandas_udf("string")
    def each(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Terms()
        for texts in columns:
            yield texts.map(lambda t: str(fingerprint(t if isinstance(t, str) else "", known, terms)))

    return docs.withColumn("fingerprint", each(F.coalesce(text, F.lit(""))))


SCHEMA = "part int, edge int, {key}, n_chars bigint, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, text string"
HEX = ("edited_sha256", "fingerprint", "edited_fingerprint")


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", band: np.ndarray | None = None) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document.

    The next document is the one of the next key, after the last the first; null keys come first,
    and repeated keys in the order of their texts. In the edited text the last half of the
    characters is replaced by as many, or all, of the next document's first ones. One sort by ranges
    puts next documents side by side; only the last of each range looks for the first of the next
    one, so what is left for a second step is two rows per range.
    """
    terms = lexicon(docs, text) if band is None else band
    schema = SCHEMA.format(key=f"{key} {docs.schema[key].dataType.simpleString()}")

    def row(k, own: str, after: str, prints: tuple, known: Terms, part: int = 0) -> dict:
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        mine, other = prints
        changed = fingerprint(edited, known, terms)
        return {
            "part": part, "edge": 0, key: k, "n_chars": len(own), "edited_sha256": hashlib.sha256(edited.encode()).digest(),
            "fingerprint": bytes(mine), "edited_fingerprint": bytes(changed), "near_edited": mine.likeness(changed),
            "near_next": mine.likeness(other), "text": None,
        }

    def columns(rows: list[dict]) -> dict:
        return {f.split()[0]: pa.array([r.get(f.split()[0]) for r in rows], _arrow(f.split()[1])) for f in schema.split(", ")}

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        known, last, part = Terms(), None, TaskContext.get().partitionId()
        for batch in batches:
            rows = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mine = fingerprint(t, known, terms)
                if last is None:
                    rows.append({"part": part, "edge": 1, key: k, "text": t})
                else:
                    rows.append(row(last[0], last[1], t, (last[2], mine), known))
                last = (k, t, mine)
            yield columns(rows)
        if last is not None:
            yield columns([{"part": part, "edge": 2, key: last[0], "text": last[1]}])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        known = Terms()
        for batch in batches:
            rows = []
            for k, t, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append(row(k, t, after, (fingerprint(t, known, terms), fingerprint(after, known, terms)), known))
            yield columns(rows)

    whole = docs.select(key, F.coalesce(text, F.lit("")).alias("text"))
    ranged = whole.repartitionByRange(key).sortWithinPartitions(key, "text")
    done = materialize(arrow_map(ranged, along, schema))
    # Two rows per range from here on.
    firsts = done.where("edge = 1").select("part", F.col("text").alias("_after"))
    order = firsts.select("part", F.lead("part").over(W.orderBy("part")).alias("_next"), F.min("part").over(W.partitionBy(F.lit(0))).alias("_lowest"))
    lasts = done.where("edge = 2").select("part", key, "text").join(order, "part").withColumn("part", F.coalesce("_next", "_lowest"))
    rest = arrow_map(lasts.join(firsts, "part").select(key, "text", "_after"), across, schema)
    whole = done.where("edge = 0").unionByName(rest).drop("part", "edge", "text")
    # Written as bytes, which take half of what their digits do.
    return whole.select(*[F.lower(F.hex(c)).alias(c) if c in HEX else named(c) for c in whole.columns])


def _arrow(kind: str) -> pa.DataType:
    return {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}[kind]
