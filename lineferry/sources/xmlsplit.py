"""Record elements of large XML files, cut by many tasks wherever the files happen to be split.

A file is read in pieces that end at ``>``. What a piece means depends on what is open before it: text,
a comment, CDATA, a processing instruction, a tag within quotes. So the first pass works out, for each
split and each such beginning, what is open at its end and how the depth of record elements changes.
The splits of a file, a row each, are then put in order and every one gets its true beginning. The
second pass cuts the records; the parts of one that goes over splits meet by the split it begins in.

Markup inside comments, CDATA and quotes is text. A record element inside another is part of it, an
end tag without its start is skipped, and a record that the file never ends is given as it stands. A
quote that a tag leaves open holds no ``<``, so the tag is taken to end before the next one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineferry.session import BROADCAST_BYTES, materialize

#: What may be open between two pieces; within quotes of a tag, whether it begins a record.
TEXT, COMMENT, CDATA, INSTRUCTION, SINGLE, DOUBLE, RECORD_SINGLE, RECORD_DOUBLE = range(8)
STATES = range(8)
ENDS = {COMMENT: "--", CDATA: "]]", INSTRUCTION: "?"}
QUOTE = {SINGLE: "'", DOUBLE: '"', RECORD_SINGLE: "'", RECORD_DOUBLE: '"'}
BEGINS = (("<!--", COMMENT), ("<![CDATA[", CDATA), ("<?", INSTRUCTION))
#: Place in its split of a record that goes on in the next one: behind all others.
LAST = 1 << 62
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")


def _left_open(tag: str) -> str | None:
    """The quote that the inside of a tag leaves open."""
    if '"' not in tag and "'" not in tag:
        return None
    found = re.search(r"[\"']", _QUOTED.sub("", tag))
    return found[0] if found else None


class Tokenizer:
    """What one piece, without the ``>`` at its end, does."""

    def __init__(self, record: str) -> None:
        self.start, self.end = f"<{record}", f"</{record}"
        # All pieces of a text that do something begin a tag such as these, or one with a quote.
        name = re.sub(r"([^\w-])", r"\\\1", record)
        self.marked = rf"\A[^<]*<(?:!--|!\[CDATA\[|\?|/?{name}(?:[ \t\r\n/]|\z)|[^'\"]*['\"])"
        self._known = lru_cache(4096)(self.step)

    def step_known(self, state: int, piece: str) -> tuple[int, bool, bool, int]:
        """:meth:`step`, which short pieces that come again need not take again."""
        return self._known(state, piece) if len(piece) <= 64 else self.step(state, piece)

    def _is(self, tag: str, mark: str) -> bool:
        return tag.startswith(mark) and (len(tag) == len(mark) or tag[len(mark)] in " \t\r\n/")

    def step(self, state: int, piece: str) -> tuple[int, bool, bool, int]:
        """The state behind the piece, whether a record element begins and whether one ends in it, and where it begins."""
        if state in ENDS:
            return (TEXT if piece.endswith(ENDS[state]) else state), False, False, -1
        if state == TEXT:
            at = piece.find("<")
            if at < 0:
                return TEXT, False, False, -1
            tag = piece[at:]
            for mark, inside in BEGINS:
                if tag.startswith(mark):
                    done = len(tag) >= len(mark) + len(ENDS[inside]) and tag.endswith(ENDS[inside])
                    return (TEXT if done else inside), False, False, at
            if self._is(tag, self.end):
                return TEXT, False, True, at
            record, begins, rest = self._is(tag, self.start), self._is(tag, self.start), tag
        else:
            at, record, begins = -1, state >= RECORD_SINGLE, False
            head, quote, rest = piece.partition(QUOTE[state])
            if "<" in head:  # in no value: the quote was never ended, and the tag ended before this piece
                return self.step(TEXT, piece)
            if not quote:
                return state, False, False, -1
        quote = _left_open(rest)
        if quote:
            return (RECORD_SINGLE if record else SINGLE) + (quote == '"'), begins, False, at
        return TEXT, begins, record and rest.endswith("/"), at


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    seen = spark.read.option("lineSep", ">").text(path)
    return seen.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), "value",
    )


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Rows of one split after the other, a batch at a time: (file, block) and the batch's rows of it."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(i) for i in (0, 1)]
        other = [pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False) for c in columns]
        edges = [0, *(np.flatnonzero(other[0] | other[1]) + 1).tolist(), n]
        for lo, hi in zip(edges, edges[1:], strict=False):
            yield (columns[0][lo].as_py(), columns[1][lo].as_py()), batch.slice(lo, hi - lo)


class Walk:
    """The pieces of one batch at which something may happen; what lies between is passed over unread."""

    def __init__(self, tokens: Tokenizer, values: pa.Array) -> None:
        values.validate(full=True)
        self.tokens, self.values, self.n, self.found = tokens, values, len(values), {}

    def _stops(self, state: int) -> tuple[list[int], list[str]]:
        """The pieces that a state doesn't pass over, in order, as places (the last one the end) and texts."""
        if state not in self.found:
            if state in ENDS:
                stops = pc.ends_with(self.values, ENDS[state])
            else:
                stops = pc.match_substring_regex(self.values, self.tokens.marked)
            places = np.flatnonzero(stops.to_numpy(zero_copy_only=False))
            self.found[state] = [*places.tolist(), self.n], self.values.take(pa.array(places)).to_pylist()
        return self.found[state]

    def run(self, state: int) -> Iterator[tuple[int, int, bool, bool, int]]:
        """From ``state`` before the batch: each stop's place, and what :meth:`Tokenizer.step` says of it."""
        at, step = 0, self.tokens.step_known
        turn = dict.fromkeys(STATES, 0)
        while at < self.n:
            if state == TEXT or state in ENDS:
                (stops, texts), i = self._stops(state), turn[state]
                while stops[i] < at:
                    i += 1
                turn[state], at = i, stops[i]
                if at == self.n:
                    return
                piece = texts[i]
            else:  # a quote ends soon: its pieces are read one by one
                piece = self.values[at].as_py()
            state, begins, ends, start = step(state, piece)
            yield at, state, begins, ends, start
            at += 1


def _changes(pieces: DataFrame, record: str) -> DataFrame:
    """For each split and each state before it: the state behind it, by how much the depth of record
    elements has changed then, and by how much it had at its lowest."""
    names = ["file", "block", "before", "behind", "by", "low"]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, key, now = Tokenizer(record), None, {}

        def shown() -> pa.RecordBatch:
            rows = [(*key, s, *now[s]) for s in STATES]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for at, rows in _splits(batches):
            if at != key:
                if key is not None:
                    yield shown()
                key, now = at, {s: (s, 0, 0) for s in STATES}
            walk, done = Walk(tokens, rows.column("value")), {}
            for first in {x[0] for x in now.values()}:
                state, by, low = first, 0, 0
                for _, state, begins, ends, _at in walk.run(first):
                    by += begins - ends
                    low = min(low, by)
                done[first] = state, by, low
            for s, (state, by, low) in now.items():
                behind, more, lowest = done[state]
                now[s] = behind, by + more, min(low, by + lowest)
        if key is not None:
            yield shown()

    return pieces.mapInArrow(run, "file string, block bigint, before int, behind int, by bigint, low bigint")


def _beginnings(changes: DataFrame) -> DataFrame:
    """What is open before each split of a file, and the split in which the record began that is open there."""

    def order(rows: pd.DataFrame) -> pd.DataFrame:
        by_block = {b: {r.before: r for r in part.itertuples()} for b, part in rows.groupby("block")}
        state, depth, opener, out = TEXT, 0, -1, []
        for block in sorted(by_block):
            out.append((rows["file"].iloc[0], block, state, depth, opener))
            r = by_block[block][state]
            # End tags without a start don't count: the depth stops at 0.
            behind = max(depth + r.by, r.by - r.low)
            through = depth > 0 and depth + r.low > 0
            state, depth, opener = r.behind, behind, (opener if through else block) if behind > 0 else -1
        return pd.DataFrame(out, columns=["file", "block", "state", "depth", "opener"])

    return changes.groupBy("file").applyInPandas(order, "file string, block bigint, state int, depth bigint, opener bigint")


def _joined(values: pa.Array, bounds: list[int]) -> list[str]:
    """The pieces from each even bound to the next odd one, with ``>`` between them."""
    lists = pa.ListArray.from_arrays(pa.array([0, *bounds, len(values)], pa.int32()), values)
    return pc.binary_join(lists, ">").take(pa.array(range(1, len(bounds), 2), pa.int32())).to_pylist()


def _cut(pieces: DataFrame, record: str) -> DataFrame:
    """Records, and parts of those that go over splits, of ``file, block, id, value, state, depth, opener``."""
    names = ["file", "block", "n", "part", "record"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, key, held, n = Tokenizer(record), None, [], 0
        state = depth = opener = 0
        out: list[tuple] = []

        def shown() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        for at, rows in _splits(batches):
            if at != key:
                if held:
                    out.append((key[0], opener, LAST, key[1], "".join(held)))
                key, held, n = at, [], 0
                state, depth, opener = (rows.column(c)[0].as_py() for c in ("state", "depth", "opener"))
            values = rows.column("value")
            # Where records begin and end in the batch, from one that is open before it to one that is open behind.
            bounds, starts = [0] if depth > 0 else [], [0] if depth > 0 else []
            openers = [opener] if depth > 0 else []
            for i, state, begins, ends, start in Walk(tokens, values).run(state):
                if begins and depth == 0:
                    opener = key[1]
                    bounds.append(i)
                    starts.append(start)
                    openers.append(opener)
                inside = begins or depth > 0
                depth = max(0, depth + begins - ends)
                if inside and depth == 0:
                    bounds.append(i + 1)
            if depth > 0:
                bounds.append(len(values))
            texts = [t[at:] + ">" for t, at in zip(_joined(values, bounds), starts, strict=True)]
            for k, (text, begun) in enumerate(zip(texts, openers, strict=True)):
                held.append(text)
                if k + 1 < len(texts) or depth == 0:
                    whole = begun == key[1]
                    out.append((key[0], begun, n if whole else LAST, -1 if whole else key[1], "".join(held)))
                    held, n = [], n + 1
            yield shown()
        if held:
            out.append((key[0], opener, LAST, key[1], "".join(held)))
            yield shown()

    return pieces.mapInArrow(run, "file string, block bigint, n bigint, part bigint, record string")


def split_records(spark: SparkSession, path: str, record: str) -> DataFrame:
    """``file, block, n, record``: the text of each record element; the first three give the order in the files.

    Beginnings are a row a split; past the size for a broadcast, pieces are sorted to meet them.
    """
    pieces = _pieces(spark, path)
    starts = materialize(_beginnings(_changes(pieces, record)))
    splits = pieces.rdd.getNumPartitions() + len(pieces.inputFiles())
    if splits * 512 <= BROADCAST_BYTES:
        met = pieces.join(F.broadcast(starts), ["file", "block"])
    else:
        met = pieces.join(starts, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "id")
    cut = materialize(_cut(met.select("file", "block", "id", "value", "state", "depth", "opener"), record))
    parts = cut.where("part >= 0").groupBy("file", "block").agg(F.array_sort(F.collect_list(F.struct("part", "record"))).alias("parts"))
    over = parts.select("file", "block", F.lit(LAST).alias("n"), F.array_join("parts.record", "").alias("record"))
    return cut.where("part < 0").select("file", "block", "n", "record").unionByName(over)
