"""Periodic runs of words by a suffix automaton with link-cut access, and texts without the repeats.

A run is a stretch of consecutive words with smallest period q (words q apart are the same) of at least
``times`` periods and ``least`` words that no neighbouring word extends. The automaton takes one word
after another. Its suffix links form a tree in which the path from the newest state to the root holds
all suffixes read so far; a link-cut tree keeps it in segments of one last end each. Appending a word
walks up the segments and recolours them with the new end. A segment whose suffixes end before at e,
now at i, and have up to L words says that the stretch of L + i - e words up to i has period i - e, and
that the word before it does not go on with it. Where L is at least the distance the stretch is a
square, and where no further word extends it, it is a run. All runs of three periods and more show
this way at their last word, each once; the segments met are n log n for n words.

Only stretches that can hold a run are given to the automaton: within a run of q and n words, every
stretch of ``window`` words recurs q words on or back, q <= n / times. So words outside of windows that
recur within that distance in a stretch of such words are in no run; this is found by hashes of windows,
where a collision costs time and loses nothing. The rest of the words is never walked.

A null text has no words. A text without runs keeps all its words. Rows are taken one by one and stay
in their task, so repeated rows, ties, null keys and empty tables need no care; memory is some hundred
bytes a word of the longest stretch. ``runs``, ``best`` and ``collapsed`` of the input are replaced,
whatever their case; other columns are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineferry.llm.common import Hashes, mix, named, unused

RESULT = ("runs", "best", "collapsed")


@dataclass(frozen=True)
class Runs:
    """Least words of a run, and least periods."""

    least: int = 24
    times: int = 3

    def __post_init__(self) -> None:
        if self.times < 3:
            raise ValueError("runs of fewer than three periods do not all show at their last word")

    @property
    def window(self) -> int:
        """Words that recur a period on or back wherever in a run they are: a run less one period."""
        return self.least - self.least // self.times


class Automaton:
    """Suffix automaton of a growing sequence, its suffix links held as a link-cut tree.

    State 0 is none and state 1 the empty word. ``left`` and ``right`` are the children in the splay
    tree of a preferred path, ordered by depth; ``up`` is the parent there or, for the root of a splay
    tree, the state that its path hangs from. All states of a path have the same last end, which is
    held at the root of its splay tree.
    """

    def __init__(self) -> None:
        self.moves: list[dict[int, int]] = [{}, {}]
        self.link, self.length = [0, 0], [0, 0]
        self.left, self.right, self.up, self.end = [0, 0], [0, 0], [0, 0], [-1, -1]
        self.last = 1

    def state(self, length: int, moves: dict[int, int]) -> int:
        self.moves.append(moves)
        self.length.append(length)
        for column in (self.link, self.left, self.right, self.up):
            column.append(0)
        self.end.append(-1)
        return len(self.length) - 1

    def splay(self, x: int) -> None:
        """Makes ``x`` the root of its splay tree; the path's last end moves with the root."""
        left, right, up, end = self.left, self.right, self.up, self.end
        while True:
            p = up[x]
            if not p or (left[p] != x and right[p] != x):
                return
            g = up[p]
            inner = g and (left[g] == p or right[g] == p)
            if not inner:
                end[x] = end[p]
                turns = (x,)
            else:
                turns = (p, x) if (left[g] == p) == (left[p] == x) else (x, x)
                top = up[g]
                if not (top and (left[top] == g or right[top] == g)):
                    end[x] = end[g]
            for c in turns:
                p = up[c]
                g = up[p]
                if left[p] == c:
                    b = left[p] = right[c]
                    right[c] = p
                else:
                    b = right[p] = left[c]
                    left[c] = p
                if b:
                    up[b] = p
                if g:
                    if left[g] == p:
                        left[g] = c
                    elif right[g] == p:
                        right[g] = c
                up[p], up[c] = c, g

    def append(self, word: int) -> int:
        """The state of the whole sequence with ``word`` at its end."""
        moves, link, length = self.moves, self.link, self.length
        cur, p = self.state(length[self.last] + 1, {}), self.last
        while p and word not in moves[p]:
            moves[p][word] = cur
            p = link[p]
        if not p:
            q = 1
        else:
            q = moves[p][word]
            if length[p] + 1 != length[q]:
                q = self.split(p, word, q)
        link[cur] = self.up[cur] = q
        self.last = cur
        return cur

    def split(self, p: int, word: int, q: int) -> int:
        """A state for the shorter suffixes of ``q``, between it and what it links to, on the same path."""
        moves, link = self.moves, self.link
        new = self.state(self.length[p] + 1, dict(moves[q]))
        while p and moves[p].get(word) == q:
            moves[p][word] = new
            p = link[p]
        link[new], link[q] = link[q], new
        self.splay(q)
        above = self.left[new] = self.left[q]
        if above:
            self.up[above] = new
        self.left[q], self.up[new] = new, q
        return new

    def recolour(self, state: int, end: int) -> list[tuple[int, int]]:
        """(last end, longest suffix) of each segment between ``state`` and the root, which then end at ``end``."""
        left, right, up, ends, length = self.left, self.right, self.up, self.end, self.length
        met, below, x = [], 0, state
        while x:
            self.splay(x)
            if ends[x] >= 0 and length[x]:
                met.append((ends[x], length[x]))
            if right[x]:
                ends[right[x]] = ends[x]
            right[x] = below
            below, x = x, up[x]
        self.splay(state)
        ends[state] = end
        return met


def runs_of(words: np.ndarray, how: Runs) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run of a sequence of numbers, by start and period."""
    found, n = [], len(words)
    automaton, seq = Automaton(), words.tolist()
    for i, word in enumerate(seq):
        for before, longest in automaton.recolour(automaton.append(word), i):
            period = i - before
            size = longest + period
            if size >= how.least and size >= how.times * period and (i + 1 == n or seq[i + 1] != seq[i + 1 - period]):
                found.append((i + 1 - size, size, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(words: np.ndarray, how: Runs) -> list[tuple[int, int]]:
    """Starts and ends of the stretches that can hold a run."""
    size, done, left = how.window, [], [(0, len(words))]
    if len(words) < how.least:
        return []
    grams = words[: len(words) - size + 1].copy()
    for j in range(1, size):
        grams = mix(grams) + words[j : len(words) - size + 1 + j]
    while left:
        lo, hi = left.pop()
        if hi - lo < how.least:
            continue
        here = grams[lo : hi - size + 1]
        order = np.argsort(here, kind="stable")
        near = np.zeros(len(here), bool)
        gap = np.diff(order)
        same = (here[order[1:]] == here[order[:-1]]) & (gap <= (hi - lo) // how.times)
        near[order[1:][same]] = near[order[:-1][same]] = True
        # Words of such windows, as the places where their cover begins and ends.
        edge = np.zeros(hi - lo + 1, np.int32)
        np.add.at(edge, np.flatnonzero(near), 1)
        np.add.at(edge, np.flatnonzero(near) + size, -1)
        cover = np.r_[False, np.cumsum(edge[:-1]) > 0, False]
        sides = np.flatnonzero(cover[1:] != cover[:-1])
        parts = [(lo + a, lo + b) for a, b in zip(sides[::2].tolist(), sides[1::2].tolist(), strict=True)]
        # Looked at once more where much fell away, so that the looks add up to a few times the text.
        if 4 * sum(b - a for a, b in parts) > 3 * (hi - lo):
            done += parts
        else:
            left += parts
    return sorted(done)


def periodic_runs(docs: DataFrame, how: Runs = Runs(), text: str = "text") -> DataFrame:
    """``docs`` with ``runs`` (by start, then period), ``best`` and ``collapsed``.

    ``best`` is the run of the greatest length in periods, the smallest start and period among equals.
    ``collapsed`` has the words that no run repeats, joined by a blank: of each run its first period stays.
    """
    run = "struct<start:bigint,length:bigint,period:bigint>"

    @F.pandas_udf(f"struct<runs:array<{run}>,best:{run},collapsed:string>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = Hashes()
        for texts in batches:
            rows = []
            for t in texts:
                words = t.encode().split() if t else []
                hashed = known.of(words)
                found = []
                for lo, hi in stretches(hashed, how):
                    # Exact numbers, not hashes, decide what equal words are.
                    number: dict[bytes, int] = {}
                    part = np.array([number.setdefault(w, len(number)) for w in words[lo:hi]])
                    found += [(lo + s, n, q) for s, n, q in runs_of(part, how)]
                gone = np.zeros(len(words) + 1, np.int64)
                for s, n, q in found:
                    gone[s + q] += 1
                    gone[s + n] -= 1
                keep = np.cumsum(gone[:-1]) == 0
                best = None
                for r in found:
                    if best is None or r[1] * best[2] > best[1] * r[2]:
                        best = r
                shown = [dict(zip(("start", "length", "period"), r, strict=True)) for r in found]
                best = best and dict(zip(("start", "length", "period"), best, strict=True))
                rows.append((shown, best, b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k).decode()))
            yield pd.DataFrame(rows, columns=["runs", "best", "collapsed"])

    found = unused(docs, "found")["found"]
    kept = [named(c) for c in docs.columns if c.lower() not in RESULT]
    return docs.withColumn(found, find(named(text))).select(*kept, *[F.col(found)[c].alias(c) for c in RESULT])
