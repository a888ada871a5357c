"""Packing documents into sequences of bounded length: best-fit decreasing over a segment tree.

Documents are cut into full windows and a rest. Pieces are dealt evenly over groups of bounded
size, and each group is packed by itself: longest piece first, each into the open sequence with the
least room that still holds it, which a segment tree indexed by remaining room finds.

A null or empty text is the end-of-text id alone. Documents are independent rows: repeated rows or
ids and null ids are packed like any others, and ties between pieces of one length are broken by
their ids, so that a run repeats itself. An empty table packs into nothing. Very long texts are cut
in the task that reads them. Only the key and the text are read; other columns play no part.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineferry.llm.common import arrow_map, materialize

#: Pieces of a group, on average; a group's largest share of padding is its last sequences.
GROUP_PIECES = 16_384
#: Bytes of texts that are told apart into words at once.
GATHER = 24 << 20

class Chunks(dict):
    """Token ids (little-endian 32 bits) of a text between blanks, while fewer than ``most`` are known.

    What no token crosses need not be encoded twice: a text falls apart at ASCII blanks, and a full
    stop or comma behind a letter comes apart from the word. Case makes no difference to the
    vocabularies used here; this is relied on only for Latin-1, where lowering is plain.
    """

    most, longest = 2_000_000, 64

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self[""] = b""
        words = self.tokenizer.get_vocab()
        # A tokenizer that marks the ends of words, and gives capitals and small letters the same
        # ids, allows for the short cuts below; for others each chunk is encoded by itself.
        self.ends = np.zeros(max(words.values()) + 1, bool)
        self.ends[[i for w, i in words.items() if w.endswith("</w>")]] = True
        self.plain = bool(self.ends.any()) and self._ids("Ab, AB.") == self._ids("ab , ab .")
        for mark in ".,":
            self[mark] = self._bytes([mark])[0]

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _bytes(self, chunks: list[str]) -> list[bytes]:
        return [array("I", f.ids).tobytes() for f in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, encoded as one text and told apart by the marks of their ends."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            return self._bytes(words)
        text, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [text[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]

    def _plain(self, chunk: str) -> tuple[str, str]:
        """The word of letters in a chunk, if that is what it is, and the mark behind it."""
        mark = chunk[-1] if chunk[-1] in ".," else ""
        word = chunk[: -len(mark)] if mark else chunk
        if self.plain and word.isalpha() and (word.isascii() or max(word) <= "\xff"):
            return word.lower(), mark
        return "", ""

    def of(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks; those not known yet are remembered where there is room."""
        new = {c: self._plain(c) for c in chunks if c not in self}
        words = list({w for w, _ in new.values()}.difference(self))
        added = dict(zip(words, self._words(words), strict=True)) if words else {}
        other = [c for c, (w, _) in new.items() if not w]
        added.update(zip(other, self._bytes(other), strict=True))
        self.update(added)
        for c, (w, mark) in new.items():
            if w:
                self[c] = self[w] + self[mark]
        out = list(map(self.__getitem__, chunks))
        if len(self) > self.most:
            for c in {*added, *new}:
                del self[c]
        else:
            for c in other:
                if len(c) > self.longest:
                    del self[c]
        return out


@lru_cache(1)
def worker_chunks(path: str) -> Chunks:
    """A worker's chunks, which its later tasks find filled."""
    return Chunks(path)


def token_ids(texts: pa.Array, chunks: Chunks) -> Iterator[np.ndarray]:
    """The ids of each text. A batch's distinct words are looked up once, and new ones encoded."""
    split = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    found = split.flatten().dictionary_encode()
    known = chunks.of(found.dictionary.to_numpy(zero_copy_only=False).tolist())
    pool = np.frombuffer(b"".join(known), "<u4")
    sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
    starts = np.cumsum(sizes) - sizes
    word = found.indices.to_numpy()
    length = sizes[word]
    ends = np.r_[0, np.cumsum(length)]
    ids = pool[np.repeat(starts[word] - ends[:-1], length) + np.arange(ends[-1])]
    cuts = ends[np.r_[0, np.cumsum(split.value_lengths().to_numpy())]].tolist()
    for i, j in zip(cuts, cuts[1:], strict=False):
        yield ids[i:j]


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold ``GATHER`` bytes: the larger, the fewer distinct words in each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= GATHER:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    for table in pa.Table.from_batches(held).combine_chunks().to_batches() if held else []:
        yield table


def pieces(docs: DataFrame, tokenizer: str, length: int, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``key, start, length, ids_crc32, doc_tokens``: full windows and the rest of each document."""
    end = np.array([end_id], "<u4")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        chunks = worker_chunks(tokenizer)
        for batch in gathered(batches):
            rows = []
            for k, ids in zip(batch.column(0).to_pylist(), token_ids(batch.column(1), chunks), strict=True):
                ids = np.concatenate([ids, end])
                for at in range(0, len(ids), length):
                    part = ids[at : at + length]
                    rows.append((k, at, len(part), zlib.crc32(part.tobytes()), len(ids)))
            yield dict(zip((key, "start", "length", "ids_crc32", "doc_tokens"), map(list, zip(*rows, strict=True)), strict=True))

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs.select(key, text), cut, f"{key} {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; ``lengths`` come longest first."""
    leaves = 1 << size.bit_length()
    tree = [0] * (2 * leaves)  # open sequences below each node; leaf: by remaining room
    rooms: list[list[int]] = [[] for _ in range(size + 1)]
    sequence, offset, fresh = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), count()

    def change(room: int, by: int) -> None:
        node = room + leaves
        while node:
            tree[node] += by
            node >>= 1

    for i, n in enumerate(lengths.tolist()):
        node = n + leaves
        # Up until a right neighbour holds an open sequence, then down to the leftmost one there.
        if not tree[node]:
            while node > 1 and (node & 1 or not tree[node + 1]):
                node >>= 1
            node = node + 1 if node > 1 else 0
            while 0 < node < leaves:
                node = 2 * node if tree[2 * node] else 2 * node + 1
        room = node - leaves if node else size
        if node:
            seq = rooms[room].pop()
            change(room, -1)
        else:
            seq = next(fresh)
        sequence[i], offset[i] = seq, size - room
        if room > n:
            rooms[room - n].append(seq)
            change(room - n, 1)
    return sequence, offset


def pack(cut: DataFrame, length: int, key: str = "doc_id") -> DataFrame:
    """``cut`` with ``sequence_id`` and ``offset``; ``cut`` has ``key, start, length``."""
    cut = materialize(cut)
    groups = -(-cut.count() // GROUP_PIECES) or 1
    dealt = cut.withColumn("_group", F.pmod(F.xxhash64(key, "start", "length"), F.lit(groups)))

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", key, "start"], ascending=[False, True, True], kind="stable")
        sequence, offset = best_fit_decreasing(rows["length"].to_numpy(), length)
        return rows.assign(sequence_id=(rows["_group"].to_numpy(np.int64) << 32) + sequence, offset=offset).drop(columns="_group")

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return dealt.groupBy("_group").applyInPandas(fill, f"{schema}, sequence_id bigint, offset bigint")


def pack_documents(
    docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pieces of all documents with the sequence and the offset they have there."""
    return pack(pieces(docs, tokenizer, length, end_id, key, text), length, key)
