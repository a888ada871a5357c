"""Substring dedup: passages that occur in several documents, by compact windows.

A text is a sequence of word shingles. Under one hash function, all its subsequences whose smallest
hash is the same shingle form a compact window (l, c, r): they start in l..c and end in c..r. The
windows are the nodes of the Cartesian tree over the hashes, and only those long enough for a
passage of ``min_words`` are made. Two passages that share shingles share the smallest one under
each hash with the probability of their similarity, so windows of different documents with one
hash value are joined, and documents whose windows meet on overlapping intervals under enough hash
functions are candidates. A candidate is verified word by word: equal runs are followed over small
edits, and a passage counts if it is long enough and its shingle sets are similar enough.

A window's bucket is its smallest shingle with the run of ``RUN`` words that starts or ends there:
of any passage of ``min_words`` at least one of the two lies inside. Of a bucket, which a third of
all documents may share, each document is compared with the smallest one alone. What the other documents of
a bucket share among themselves, and not with the smallest, is looked for once more, by whole runs
of words: each run of ``min_words`` around the windows that were compared, and each of half as many,
is a key, and a document is compared with the smallest one that has the same run, unless the passages
found hold the run already. Every equal passage of ``min_words`` lies in a found one then, whatever the sizes of
the buckets, and documents are compared twice, not once for each member of a bucket.
Every anchor is followed over edits, those first that enough hash functions agree on, unless all that could
be found around it has been; edited passages are found with high probability. A passage that lies in another one found for its
document need not be told again with each further source or place that has it. Documents with equal texts are compared once, by the smallest of them.

Null and empty texts have no passages. Passages within one document don't count, nor do those of
rows of one id among themselves: of such rows the text of the smallest digest is compared. Rows with a null id are
left as they are. Other columns are passed through. A text that is all repeated becomes empty; its
row stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineferry.llm.common import Hashes, arrow_map, drop, materialize, mix, named, shingles, unused, word_hashes, words

#: What separates words, as in :func:`common.words`.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Shingles that an edit may take in each text beside a quarter of what is matched, and those that must be equal behind it.
EDIT, SURE = 16, 3
#: Words of a bucket's run: one word changed in the middle of the shortest passage leaves one before or behind each other place.
RUN = 12
#: Bytes of texts whose windows are made at once.
PART = 4 << 20


@dataclass(frozen=True)
class Passage:
    """Shortest passage and shingle in words, least similarity in hundredths, hash functions, and how many must agree on an edited passage."""

    min_words: int = 50
    size: int = 5
    percent: int = 80
    hashes: int = 3
    agree: int = 2

    @property
    def width(self) -> int:
        return self.min_words - self.size + 1


def compact_windows(values: np.ndarray, width: int) -> np.ndarray:
    """Rows (l, c, r) of the Cartesian tree's nodes that span at least ``width`` positions."""
    return all_windows(values, np.array([0]), np.array([len(values)]), width)


def all_windows(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """:func:`compact_windows` of the stretches ``starts`` to ``ends`` of ``values``, which follow one another; by places in ``values``.

    A node spans ``width`` positions exactly if it is the first smallest of some run of so many, and
    the node that bounds it on either side spans more than it does. So the first minima of all such runs
    are taken first, and the trees are built over them alone.
    """
    long = ends - starts >= width
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return np.empty((0, 3), np.int64)
    # Smallest of each run: the smaller of a suffix minimum and a prefix minimum of blocks.
    n = int(ends[-1])
    values = values[:n]
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(-1, width)
    left = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    right = np.minimum.accumulate(grid, axis=1).ravel()
    low = np.minimum(left[: n - width + 1], right[width - 1 : n])
    # Where a run's first minimum is not that of the run before: it comes in behind, or the other falls out before.
    step = np.zeros(n - width + 2, np.int8)
    np.add.at(step, starts + 1, 1)
    np.add.at(step, ends - width + 1, -1)
    later = np.cumsum(step[: n - width + 1], dtype=np.int8)[1:] > 0
    fresh = np.flatnonzero(later & (low[1:] < low[:-1])) + width
    fallen = np.flatnonzero(later & (values[: n - width] == low[:-1])) + 1
    seek = np.r_[starts, fallen]
    first = seek + np.lib.stride_tricks.sliding_window_view(values, width)[seek].argmin(1)
    spot = np.zeros(n, bool)
    spot[fresh] = spot[first] = True
    spots = np.flatnonzero(spot)
    at, val, out = spots.tolist(), values[spots].tolist(), []
    bounds = zip(starts.tolist(), ends.tolist(), np.searchsorted(spots, starts).tolist(), np.searchsorted(spots, ends).tolist(), strict=True)
    for lo_end, hi_end, i, j in bounds:
        stack: list[tuple[int, int, int]] = []  # (position, value, left end), values growing
        for p, v in zip(at[i:j], val[i:j], strict=True):
            start = stack[-1][0] + 1 if stack else lo_end
            while stack and stack[-1][1] > v:
                c, _, start = stack.pop()
                if p - start >= width:
                    out += (start, c, p - 1)
            stack.append((p, v, start))
        for c, _, start in stack:
            if hi_end - start >= width:
                out += (start, c, hi_end - 1)
    return np.array(out, np.int64).reshape(-1, 3)


def runs(grams: np.ndarray, size: int, length: int) -> np.ndarray:
    """Hashes of the ``length`` words that start at each shingle of ``size``, where there are as many."""
    n = len(grams) - (length - size)
    if n <= 0:
        return grams[:0]
    out = grams[:n]
    for d in [*range(size, length - size, size), length - size]:
        out = out * np.uint64(0x9E3779B97F4A7C15) + grams[d : d + n]
    return mix(out)


def run_keys(run: np.ndarray, at: np.ndarray, ahead: np.ndarray, back: np.ndarray, far: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the runs that start at, and that end with, the shingles ``at``; 0 where the text has none there, as ``ahead`` and ``back`` tell."""
    if not len(run):
        return np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    on = np.where(ahead, run[np.minimum(at, len(run) - 1)], 0)
    off = np.where(back, ~run[np.clip(at - far, 0, len(run) - 1)], 0)
    return on.view(np.int64), off.view(np.int64)


def parts(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """The texts in pieces of about ``PART`` bytes, one text at least, each with its first row: what is made of a piece has its size."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(sizes // PART)) + 1).tolist(), len(texts)]
    for i, j in zip(cuts, cuts[1:], strict=False):
        yield i, texts.slice(i, j - i)


def windows(docs: DataFrame, passage: Passage) -> DataFrame:
    """``hash_no, ahead, back, doc, l, c, r`` of ``docs(doc, text)``."""
    length = min(RUN, passage.min_words // 2)
    far = length - passage.size

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for row, texts in parts(batch.column(1)):
                hashes, ends = word_hashes(texts)
                starts = np.r_[0, ends[:-1]]
                # Shingles of the whole piece; a text's own are those that end in it.
                grams = shingles(hashes, passage.size) if len(hashes) >= passage.min_words else hashes[:0]
                run = runs(grams, passage.size, length)
                made = []
                for h in range(passage.hashes if len(grams) else 0):
                    found = all_windows(mix(grams + np.uint64((h + 1) * 0x9E3779B97F4A7C15 % (1 << 64))), starts, ends - passage.size + 1, passage.width)
                    of = np.searchsorted(ends, found[:, 1], "right")
                    c, n = found[:, 1] - starts[of], ends[of] - starts[of]
                    ahead, back = run_keys(run, found[:, 1], c + length <= n, c >= far, far)
                    made.append(np.column_stack([of + row, np.full(len(found), h), ahead, back, found - starts[of][:, None]]))
                all_ = np.concatenate(made) if made else np.empty((0, 7), np.int64)
                yield {
                    "hash_no": pa.array(all_[:, 1], pa.int32()), "ahead": pa.array(all_[:, 2]), "back": pa.array(all_[:, 3]),
                    "doc": batch.column(0).take(pa.array(all_[:, 0])),
                    "l": pa.array(all_[:, 4], pa.int32()), "c": pa.array(all_[:, 5], pa.int32()), "r": pa.array(all_[:, 6], pa.int32()),
                }

    kind = docs.schema["doc"].dataType.simpleString()
    return arrow_map(docs.select("doc", "text"), make, f"hash_no int, ahead bigint, back bigint, doc {kind}, l int, c int, r int")


# --- verification -----------------------------------------------------------------------------


class Pair:
    """Two texts as shingles, with the equal runs between them that have been looked at."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y = x, y
        #: Places of y by shingle, when asked for.
        self.order: np.ndarray | None = None
        self.known: dict[int, list[tuple[int, int]]] = {}
        #: Where texts part for good: place in y, reach, and the shingles of x up to there.
        self.ends: set[tuple[int, int, bytes]] = set()

    def run(self, i: int, j: int) -> tuple[int, int]:
        """Start and end, in x, of the equal run around the equal shingles at i, j."""
        runs_ = self.known.setdefault(j - i, [])
        for run in runs_:
            if run[0] <= i < run[1]:
                return run
        run = i - equal(self.x[:i][::-1], self.y[:j][::-1]), i + equal(self.x[i:], self.y[j:])
        runs_.append(run)
        return run

    def places(self, i: int) -> np.ndarray:
        """Where y has the shingle i of x."""
        if self.order is None:
            self.order = np.argsort(self.y, kind="stable")
        lo, hi = (np.searchsorted(self.y, self.x[i], side, sorter=self.order) for side in ("left", "right"))
        return self.order[lo:hi]

    def chain(self, i: int, j: int) -> list[tuple[int, int, int]]:
        """Equal runs (place in x, in y, length) that follow one another over edits, around i, j."""
        lo, hi = self.run(i, j)
        shift, matched = j - i, hi - lo
        ahead = self.beyond(self.x[hi:], self.y[hi + shift :], matched, hi + shift)
        back = self.beyond(self.x[:lo][::-1], self.y[: lo + shift][::-1], matched, ~(lo + shift))
        left = [(lo - p - n, lo + shift - q - n, n) for p, q, n in back]
        return [*left[::-1], (lo, lo + shift, matched), *((hi + p, hi + shift + q, n) for p, q, n in ahead)]

    def beyond(self, x: np.ndarray, y: np.ndarray, matched: int, place: int) -> list[tuple[int, int, int]]:
        """:func:`resumed`, once for all places of x with the same shingles ahead: repeated words have many."""
        reach = EDIT + matched // 4
        told = (place, reach, x[: reach + SURE].tobytes())
        if told in self.ends:
            return []
        out = resumed(x, y, matched)
        if not out:
            self.ends.add(told)
        return out


def equal(x: np.ndarray, y: np.ndarray) -> int:
    """How many shingles are equal from the beginning on, looked at in growing pieces."""
    n, at, step = min(len(x), len(y)), 0, 64
    while at < n:
        end = min(n, at + step)
        differ = x[at:end] != y[at:end]
        if differ.any():
            return at + int(differ.argmax())
        at, step = end, step * 2
    return n


def resumed(x: np.ndarray, y: np.ndarray, matched: int) -> list[tuple[int, int, int]]:
    """Equal runs behind the edits that x and y begin with, as far as they can belong to one passage.

    An edit may be as long as a passage of what is matched so far can hold at a similarity of 0.8, and
    a few words more. Of the places where the texts are equal again the nearest is taken at which
    they stay so for ``SURE`` shingles, or to the end.
    """
    out, i, j = [], 0, 0
    while i < len(x) and j < len(y):
        reach, near, least = EDIT + matched // 4, 2 * EDIT, 0
        while True:
            # What is nearest is looked for in a small part first. By shingle its first place, which is the last one written.
            ours, theirs = (dict(zip(z[::-1].tolist(), range(len(z) - 1, -1, -1), strict=True)) for z in (x[i : i + min(near, reach)], y[j : j + min(near, reach)]))
            most = near if near < reach else 2 * reach
            for _, v in sorted((d, v) for v in ours.keys() & theirs.keys() if least <= (d := ours[v] + theirs[v]) < most):
                a, b = i + ours[v], j + theirs[v]
                long = equal(x[a:], y[b:])
                if long >= min(SURE, len(x) - a, len(y) - b):
                    break
            else:
                if near < reach:
                    near, least = 4 * near, near
                    continue
                return out
            break
        out.append((a, b, long))
        i, j, matched = a + long, b + long, matched + long
    return out


def stretches(chain: list[tuple[int, int, int]], percent: int) -> list[tuple[int, int]]:
    """First and last run of the longest stretch of a chain that is similar enough, then of what is left of it on either side.

    A stretch is similar enough if its equal shingles outweigh the others: a sum over its runs and
    edits that is not negative. The longest one is found by one pass over prefix sums.
    """
    weight = np.array([(100 - percent) * n for *_, n in chain], np.int64)
    edits = [0] + [percent * (b[0] - a[0] + b[1] - a[1] - 2 * a[2]) for a, b in zip(chain, chain[1:], strict=False)]
    ends = np.cumsum(weight - edits)
    starts = ends - weight
    out, todo = [], [(0, len(chain))]
    while todo:
        lo, hi = todo.pop()
        if lo == hi:
            continue
        lowest = [lo]
        for k in range(lo + 1, hi):
            if starts[k] < starts[lowest[-1]]:
                lowest.append(k)
        best = (0, lo, lo)
        for k in range(hi - 1, lo - 1, -1):
            while lowest and starts[lowest[-1]] <= ends[k]:
                first = lowest.pop()
                best = max(best, (chain[k][0] + chain[k][2] - chain[first][0], first, k))
        out.append(best[1:])
        todo += [(lo, best[1]), (best[2] + 1, hi)]
    return out


def verified(x: np.ndarray, y: np.ndarray, anchors: list[tuple[int, int, bool]], passage: Passage, pair: Pair | None = None) -> list[tuple]:
    """Passages (start and end in x, then in y, as words; similarity) around the anchors.

    Every anchor is followed over edits, those first that enough hash functions agree on; the shingle
    sets decide. Where an anchor is in no passage then, equal passages at other places of y that
    have its shingle are looked for. An anchor is not followed if passages found before hold every word
    that a passage of ``min_words`` around it could.
    """
    pair = pair or Pair(x, y)
    out: list[tuple] = []
    done: set[tuple[int, int]] = set()
    covered = np.zeros(len(x), bool)
    held = np.zeros(len(x) + passage.size - 1, bool)
    elsewhere = None
    before, behind = passage.width - 1, passage.min_words

    def keep(i0: int, i1: int, j0: int, j1: int) -> bool:
        if min(i1 - i0, j1 - j0) < passage.width:
            return False
        s, t = np.unique(x[i0:i1]), np.unique(y[j0:j1])
        both = len(np.intersect1d(s, t, assume_unique=True))
        union = len(s) + len(t) - both
        if 100 * both < passage.percent * union:
            return False
        covered[i0:i1] = True
        held[i0 : i1 + passage.size - 1] = True
        out.append((i0, i1 + passage.size - 1, j0, j1 + passage.size - 1, both / union))
        return True

    for i, j, _ in sorted(set(anchors), key=lambda a: (not a[2], a)):
        if i >= len(x) or j >= len(y) or x[i] != y[j] or held[max(0, i - before) : i + behind].all():
            continue
        lo, _ = pair.run(i, j)
        if (lo, j - i) not in done:
            chain = pair.chain(i, j)
            done.update((p, q - p) for p, q, _ in chain)
            for a, b in stretches(chain, passage.percent) if len(chain) > 1 else [(0, 0)]:
                first, last = chain[a], chain[b]
                if not keep(first[0], last[0] + last[2], first[1], last[1] + last[2]) and a < b:
                    # Shingles that repeat count once in a set: the runs are left.
                    for p, q, n in chain[a : b + 1]:
                        keep(p, p + n, q, q + n)
        if not covered[i] and elsewhere is None:
            mine = np.isin(runs(x, passage.size, passage.min_words), runs(y, passage.size, passage.min_words))
            elsewhere = np.r_[0, np.cumsum(mine)]
        # Only if a run of ``min_words`` that holds the anchor is in y at all.
        if not covered[i] and elsewhere[min(max(0, i - before), len(elsewhere) - 1)] < elsewhere[min(i + 1, len(elsewhere) - 1)]:
            for at in pair.places(i).tolist():
                lo, hi = pair.run(i, at)
                if hi - lo >= passage.width and keep(lo, hi, lo + at - i, hi + at - i):
                    break
    return out


def grams(x: np.ndarray, places: np.ndarray, found: list[tuple], passage: Passage) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of words around the shingles at ``places`` of x: key, length, start, and whether passages ``found`` hold all that could be in one.

    They are all runs of ``min_words`` that hold one of the places, and of half as many, which an edit in the
    middle leaves. A held run is looked for by other texts only, so one place of it is enough.
    """
    n = len(x) + passage.size - 1
    depth = np.zeros(n + 1, np.int64)
    for start, end, *_ in found:
        depth[start] += 1
        depth[end] -= 1
    bare = np.r_[0, np.cumsum(np.cumsum(depth[:-1]) == 0)]
    out = []
    for length in (passage.min_words, max(passage.size, passage.min_words // 2 - 1)):
        key = runs(x, passage.size, length).view(np.int64)
        begun, done = (np.bincount(np.clip(p, 0, len(key)), minlength=len(key) + 1) for p in (places - (length - passage.size), places + 1))
        at = np.flatnonzero(np.cumsum(begun - done)[:-1] > 0)
        around = passage.min_words - length
        held = bare[np.maximum(at - around, 0)] == bare[np.minimum(at + length + around, n)]
        first = np.zeros(len(at), bool)
        first[np.unique(key[at], return_index=True)[1]] = True
        at, held = at[first | ~held], held[first | ~held]
        out.append((key[at], np.full(len(at), length), at, held))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def agreeing(found: list[tuple], agree: int) -> list[bool]:
    """Which of the window pairs (hash_no, l, r, l2, r2) overlap, in both documents, those of enough hash functions.

    A sweep over the intervals' starts keeps the open ones, apart those that are still short of votes:
    one that has enough votes only gives them, and to a new window only until that has enough as well.
    """
    votes: list[set[int]] = [{w[0]} for w in found]
    wanting: list[int] = []
    content: list[int] = []
    purge = 64
    for n in sorted(range(len(found)), key=lambda n: found[n][1]):
        h, l, _, l2, r2 = found[n]
        mine, still = votes[n], []
        for m in wanting:
            other = found[m]
            if other[2] < l:
                continue
            if other[0] != h and other[3] <= r2 and l2 <= other[4]:
                mine.add(other[0])
                votes[m].add(h)
            (content if len(votes[m]) >= agree else still).append(m)
        wanting = still
        for m in reversed(content):
            if len(mine) >= agree:
                break
            other = found[m]
            if other[2] >= l and other[0] != h and other[3] <= r2 and l2 <= other[4]:
                mine.add(other[0])
        (content if len(mine) >= agree else wanting).append(n)
        if len(content) > purge:
            content = [m for m in content if found[m][2] >= l]
            purge = 64 + 2 * len(content)
    return [len(v) >= agree for v in votes]


def meeting(windows: DataFrame, before: DataFrame) -> DataFrame:
    """Pairs ``doc, source, anchors`` of ``windows(key, hash_no, doc, l, c, r, held)``: documents with the smallest one that has a key of theirs.

    Windows that are held already ask for nothing. The table ``before``, which the windows come from, is deleted when it has been read.
    """
    # Most keys are of one document: they are told apart by two numbers each before more is moved.
    top = F.max(F.when(~F.col("held"), F.col("doc"))).alias("top")
    shared = windows.groupBy("key").agg(F.min("doc").alias("source"), top).where("source < top").select("key", "source")
    met = materialize(windows.join(shared.hint("merge"), "key").where("doc = source or not held"))
    drop(before)
    first = met.where("doc = source").groupBy("key").agg(F.min(F.struct("c", "l", "r")).alias("first"))
    near = met.where("doc <> source").join(first.hint("merge"), "key").select("doc", "source", "hash_no", "l", "c", "r", F.col("first.l").alias("l2"), F.col("first.c").alias("c2"), F.col("first.r").alias("r2"))
    # The windows of one document that meet those of another are at most its own.
    anchors = F.collect_set(F.struct("hash_no", "l", "c", "r", "l2", "c2", "r2")).alias("anchors")
    pairs = materialize(near.groupBy("doc", "source").agg(anchors))
    drop(met)
    return pairs


def verify(pairs: DataFrame, asked: DataFrame, passage: Passage, further: bool = True) -> DataFrame:
    """What comparing ``pairs(doc, source, anchors)`` shows, given ``asked(doc, text)``: passages, and runs of words around the anchors.

    Rows of passages have ``similarity``, those of runs have ``key``. The pairs of one source come
    one after another, so a task makes a source's shingles once.
    """
    kind = asked.schema["doc"].dataType.simpleString()
    # Joins are told to exchange both sides: what could be broadcast here grows with the input.
    near = pairs.hint("merge").join(asked, "doc").hint("merge").join(asked.select(F.col("doc").alias("source"), F.col("text").alias("source_text")), "source")
    both = near.select("doc", "source", "anchors", "text", "source_text")
    fields = ["doc", "source", "start", "words", "source_start", "source_words", "similarity", "key", "length", "c", "held"]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        known, last, y = Hashes(), None, None
        for batch in batches:
            rows: list[tuple] = []
            near, of = [np.empty((0, 4), np.int64)], []
            cuts, met = batch.column(2).offsets.to_numpy(), batch.column(2).values
            columns = {f.name: met.field(f.name).to_numpy() for f in met.type}
            for n in range(batch.num_rows):
                source, text, other = (batch.column(c)[n].as_py() for c in (1, 3, 4))
                if last is None or source != last:
                    last, y = source, shingles(known.of(words(other)), passage.size)
                pair = Pair(shingles(known.of(words(text)), passage.size), y)
                a = {f: v[cuts[n] : cuts[n + 1]] for f, v in columns.items()}
                agreed = agreeing(list(zip(*(a[f].tolist() for f in ("hash_no", "l", "r", "l2", "r2")), strict=True)), passage.agree)
                found = verified(pair.x, y, list(zip(a["c"].tolist(), a["c2"].tolist(), agreed, strict=True)), passage, pair)
                rows += [(n, i, j - i, p, q - p, s) for i, j, p, q, s in found]
                if further:
                    near.append(np.column_stack(grams(pair.x, a["c"], found, passage)))
                    of.append(np.full(len(near[-1]), n))
            at, *proved = zip(*rows, strict=True) if rows else [()] * 6
            doc, source = batch.column(0), batch.column(1)
            yield dict(zip(fields, [doc.take(pa.array(at, pa.int64())), source.take(pa.array(at, pa.int64())), *map(pa.array, proved, kinds[:5]), *[pa.nulls(len(at), k) for k in kinds[5:]]], strict=True))
            key, length, start, held = np.concatenate(near).T
            at = pa.array(np.concatenate([[], *of]).astype(np.int64))
            nothing = [pa.nulls(len(at), k) for k in kinds[:5]]
            yield dict(zip(fields, [doc.take(at), pa.nulls(len(at), source.type), *nothing, *map(pa.array, (key, length.astype(np.int32), start.astype(np.int32), held.astype(bool)))], strict=True))

    kinds = [*[pa.int64()] * 4, pa.float64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
    longs = ", ".join(f"{f} bigint" for f in fields[2:6])
    return arrow_map(both, check, f"doc {kind}, source {kind}, {longs}, similarity double, key bigint, length int, c int, held boolean")


def digested(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def repeated(docs: DataFrame, passage: Passage = Passage(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Verified passages: ``doc, start, words`` and the smaller document ``source`` that has them too.

    ``digest`` is that of the text of ``doc`` that was compared. Of documents with the same text the
    smallest alone is compared with others; the rest are one passage of it.
    """
    texts = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("doc"), F.col(text).alias("text"), digested(F.col(text)).alias("digest"))
    n_words = F.expr(r"regexp_count(text, '[^\\x20\\x09-\\x0D]+')").cast("bigint")
    marks = materialize(texts.select("doc", "digest", n_words.alias("words")).distinct())
    own = materialize(marks.groupBy("doc").agg(F.min(F.struct("digest", "words")).alias("o")).select("doc", "o.*"))
    copies = own.join(own.groupBy("digest").agg(F.min("doc").alias("source")).hint("merge"), "digest").where("doc <> source")
    copies = materialize(copies.select("doc", "source", "digest", "words"))
    others = marks.select("doc", "digest").exceptAll(own.select("doc", "digest"))
    gone = materialize(others.unionByName(copies.select("doc", "digest")))
    drop(marks)
    texts = texts.join(gone, ["doc", "digest"], "left_anti").select("doc", "text")
    found = materialize(windows(texts, passage))
    whole = copies.where(F.col("words") >= passage.min_words)
    zero = F.lit(0).cast("bigint")
    out = whole.select("doc", "source", zero.alias("start"), "words", zero.alias("source_start"), F.col("words").alias("source_words"), F.lit(1.0).alias("similarity"))
    pairs = meeting(found.select(F.explode(F.array("ahead", "back")).alias("key"), "hash_no", "doc", "l", "c", "r", F.lit(False).alias("held")).where("key <> 0"), found)
    ids = pairs.select("doc").unionByName(pairs.select(F.col("source").alias("doc"))).distinct()
    asked = materialize(texts.join(ids.hint("merge"), "doc", "left_semi").groupBy("doc").agg(F.min("text").alias("text")))
    drop(gone)
    for further in (True, False):
        shown = materialize(verify(pairs, asked, passage, further))
        drop(pairs)
        out = out.unionByName(materialize(shown.where("similarity is not null").select(*out.columns)))
        if further:
            runs_ = shown.where("key is not null").select("key", F.col("length").alias("hash_no"), "doc", F.col("c").alias("l"), "c", F.expr(f"int(c + length - {passage.size})").alias("r"), "held")
            pairs = meeting(runs_, shown)
        else:
            drop(shown)
    drop(asked)
    return out.join(own.select("doc", "digest").hint("merge"), "doc")


def without_passages(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the passages ``found``, with ``words_removed``.

    Of rows of one id, those with the text that was compared are cut, which ``digest`` tells; found
    passages without that column are cut out of all of them.
    """

    @F.pandas_udf("struct<text:string,removed:bigint>")
    def cut(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spans in columns:
            out = []
            for t, s in zip(texts, spans, strict=True):
                if t is None or s is None:
                    out.append((t, 0))
                    continue
                places = [m.span() for m in WORD.finditer(t)]
                gone = np.zeros(len(places), bool)
                for p in s:
                    gone[p["start"] : p["start"] + p["words"]] = True
                parts, at = [], 0
                edges = np.flatnonzero(np.diff(np.r_[False, gone, False]))
                for i, j in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                    parts.append(t[at : places[i][0]])
                    at = places[j][0] if j < len(places) else len(t)
                out.append(("".join([*parts, t[at:]]).strip() if len(edges) else t, int(gone.sum())))
            yield pd.DataFrame(out, columns=["text", "removed"])

    work = unused(docs, "spans", "doc", "cut", "digest")
    digest = F.first("digest") if "digest" in found.columns else F.lit(None).cast("binary")
    spans = found.groupBy("doc").agg(F.collect_set(F.struct("start", "words")), digest).toDF(work["doc"], work["spans"], work["digest"])
    joined = docs.join(spans.hint("merge"), named(key) == F.col(work["doc"]), "left")
    compared = F.coalesce(digested(named(text)) == F.col(work["digest"]), F.col(work["digest"]).isNull())
    names = [c for c in docs.columns if c.lower() != "words_removed"]
    there, done = F.col(work["spans"]).isNotNull(), F.col(work["cut"])
    joined = joined.withColumn(work["spans"], F.when(compared, F.col(work["spans"])))
    cutting = joined.withColumn(work["cut"], F.when(there, cut(named(text), F.col(work["spans"]))))
    shown = F.when(there, done["text"]).otherwise(named(text))
    return cutting.select(*[shown.alias(c) if c == text else named(c) for c in names], F.coalesce(done["removed"], F.lit(0)).alias("words_removed"))
