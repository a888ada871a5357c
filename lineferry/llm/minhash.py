"""Near-duplicate documents: SuperMinHash signatures, bands, verification and grouping.

A document is the set of its distinct word shingles. Each shingle draws, from its own random
numbers, an order of the signature's slots, and offers its rank there plus a fraction to each slot
in turn; a slot keeps the smallest offer. Ranks of one shingle differ in all slots, which gives the
signature less variance than independent hashes, and once every slot holds less than the next rank
nothing can change any more. Documents that agree in a band of slots are candidates; candidates are
verified on their full shingle sets, and linked ones form groups.

Equal sets, which may be a third of all documents, are one node from the start. How buckets are
compared without making all of their pairs is told in :func:`common.link_buckets`.

Null and empty texts have no shingles and link with nothing. Documents with fewer words than a
shingle are one shingle of all their words. Rows of one id are one document, which holds together
what its rows link with; rows with a null id link with nothing. Other columns are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineferry.llm.common import Hashes, arrow_map, components, labelled, link_buckets, materialize, mix, shingles, words

#: Of two documents at similarity 0.8, one pair in 300,000 agrees in none of 32 bands of 5 slots.
BANDS, ROWS = 32, 5
GOLDEN = 0x9E3779B97F4A7C15
#: Bits of a set's parities, and the words that hold them.
PARITIES, LONG = 1024, 64


@dataclass(frozen=True)
class Near:
    """Shingle size in words, and the similarity from which documents link, in hundredths."""

    size: int = 5
    percent: int = 80


def superminhash(elements: np.ndarray, slots: int) -> np.ndarray:
    """Smallest offers of distinct 64-bit elements, by slot."""
    offers = np.full(slots, np.inf)
    rows, order = np.arange(len(elements)), None
    for rank in range(slots):
        drawn = mix(elements + np.uint64((2 * rank + 1) * GOLDEN % (1 << 64)))
        place = rank + (drawn % np.uint64(slots - rank)).astype(np.int64)
        value = rank + (mix(drawn) >> np.uint64(11)) * 2.0**-53
        if rank == 0:
            slot = place
        else:
            if order is None:  # needed only where one rank doesn't fill the signature
                order = np.tile(np.arange(slots, dtype=np.int16), (len(elements), 1))
                order[:, 0], order[rows, slot] = order[rows, slot], 0
            slot = order[rows, place].astype(np.int64)
            order[rows, place], order[:, rank] = order[:, rank].copy(), slot
        np.minimum.at(offers, slot, value)
        if offers.max() < rank + 1:
            break
    return offers


def band_keys(offers: np.ndarray) -> np.ndarray:
    """A key for each band: its number and slots."""
    bits = mix(offers.view(np.uint64)).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = mix(key + bits[:, j])
    return key.view(np.int64)


def signatures(docs: DataFrame, near: Near, key: str, text: str) -> DataFrame:
    """``id, n_shingles, s1, s2, bands``: the set's size, its hash and its bands' keys."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        known = Hashes()
        for batch in batches:
            sizes, digests, bands = [], [], []
            for t in batch.column(1).to_pylist():
                found = np.unique(shingles(known.of(words(t)), near.size))
                sizes.append(len(found))
                digests.append(divmod(xxhash.xxh3_128_intdigest(found.tobytes()), 1 << 64))
                bands.append(band_keys(superminhash(found, BANDS * ROWS)) if len(found) else [])
            pair = np.array(digests, np.uint64).reshape(-1, 2).view(np.int64)
            yield {
                "id": batch.column(0), "n_shingles": pa.array(sizes, pa.int64()), "s1": pair[:, 0], "s2": pair[:, 1],
                "bands": pa.array(bands, pa.list_(pa.int64())),
            }

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs.select(key, text), sign, f"id {kind}, n_shingles bigint, s1 bigint, s2 bigint, bands array<bigint>")


def parities(found: np.ndarray) -> np.ndarray:
    """Whether an odd number of distinct elements falls on each of ``PARITIES`` bits.

    An element of one set alone turns one bit, one of both sets none: the bits of two sets differ in no
    more places than the sets have elements that are not in both.
    """
    odd = np.bincount((found % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sets(docs: DataFrame, near: Near) -> DataFrame:
    """``id, grams, odd`` from ``id, text``: the set and its parities."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        known = Hashes()
        for batch in batches:
            found = [np.unique(shingles(known.of(words(t)), near.size)) for t in batch.column(1).to_pylist()]
            longs = pa.list_(pa.int64())
            yield {"id": batch.column(0), "grams": pa.array([f.view(np.int64) for f in found], longs), "odd": pa.array(map(parities, found), longs)}

    kind = docs.schema["id"].dataType.simpleString()
    return arrow_map(docs.select("id", "text"), gather, f"id {kind}, grams array<bigint>, odd array<bigint>")


def near_duplicates(docs: DataFrame, near: Near = Near(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_shingles, component_id, kept`` for each row; the smallest id of a group is kept."""
    signed = materialize(signatures(docs, near, key, text))
    full = signed.where("n_shingles > 0 and id is not null")
    nodes = full.groupBy("s1", "s2", "n_shingles").agg(F.min("id").alias("node"))
    # A bucket's members: each distinct set once. Only those of shared buckets are joined to their sizes.
    chosen = full.join(nodes.withColumnRenamed("node", "id").hint("shuffle_hash"), ["s1", "s2", "n_shingles", "id"], "left_semi")
    members = materialize(chosen.select(F.explode("bands").alias("key"), "id").distinct())
    details = full.select("id", F.col("n_shingles").alias("size")).distinct()
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))

    def contents(ids: DataFrame) -> DataFrame:
        # Joins are told to exchange both sides: what could be broadcast here grows with the input.
        return sets(texts.hint("merge").join(ids, "id", "left_semi"), near)

    def compare(pairs: DataFrame) -> DataFrame:
        both = F.size(F.array_intersect("x_grams", "y_grams")).cast("bigint")
        counted = pairs.withColumn("_both", both).withColumn("_union", F.size("x_grams") + F.size("y_grams") - F.col("_both"))
        return counted.withColumns({"dist": 1 - F.col("_both") / F.col("_union"), "linked": 100 * F.col("_both") >= near.percent * F.col("_union")})

    def may(x: str, y: str) -> Column:
        small, large = F.least(x + "size", y + "size"), F.greatest(x + "size", y + "size")
        return 100 * small >= near.percent * large

    def close(x: str, y: str) -> Column:
        differ = sum((F.bit_count(F.get(x + "odd", F.lit(i)).bitwiseXOR(F.get(y + "odd", F.lit(i)))) for i in range(PARITIES // LONG)), F.lit(0))
        # Of sets that link, (size + size - different) / 2 elements are in both, (size + size + different) / 2 in either.
        return (100 + near.percent) * differ <= (100 - near.percent) * (F.col(x + "size") + F.col(y + "size"))

    links = link_buckets(members, details, contents, compare, 1 - near.percent / 100, may, ("odd",), close)
    # Rows of one id may hold different sets: they are one document.
    same = full.join(nodes, ["s1", "s2", "n_shingles"]).select(F.col("id").alias("a"), F.col("node").alias("b")).where("a <> b")
    comps = components(links.unionByName(same))
    out = labelled(signed.select("id", "n_shingles"), comps, "id", "component_id")
    return out.select(F.col("id").alias(key), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
