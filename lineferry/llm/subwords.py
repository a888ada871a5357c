"""SentencePiece encoding and decoding, driven by an Aho-Corasick automaton over the pieces.

The automaton reads the text once; at each position it gives, along its output links, every piece
that ends there, and each of them may extend the best path to where it begins. Only the best path to
each position is kept, by its last piece. What is best depends on the model, as in SentencePiece
itself. The scores of a unigram model are log probabilities: the best path has the largest sum, of
equal sums the one with the longer last piece. The scores of a BPE model are the order of its merges:
the best path is the one that the merges leave. A path is that one if and only if each two of its
neighbours are what the merges leave of them alone, since a merge across two pieces would have come
up in those two as well; so a piece extends a path if it may follow its last piece, and exactly one
does. Whether a piece may follow another is worked out once, while there is room to keep it.
A character that is no piece is written as its UTF-8 bytes; in a unigram model it costs ten more
than the worst piece, in a BPE model it may stand beside anything.

Blanks are written as ``▁`` and one is put before the text, as SentencePiece does; a ``▁`` of the
text itself goes through bytes, so that decoding gives back every text exactly. Null and empty
texts have no ids; null ids decode to an empty text. Repeated rows and null keys are rows like any
others; other columns are passed through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = "▁"
#: Stands for a ``▁`` of the text; no Spark string holds a lone surrogate.
KEPT = "\udc81"
UNKNOWN_PENALTY = 10.0


class Pieces:
    """A model's pieces and the automaton over them."""

    most_pairs = 1_000_000

    def __init__(self, model: str):
        import ahocorasick
        import sentencepiece

        known = sentencepiece.SentencePieceProcessor(model_file=model)
        n = known.get_piece_size()
        names = self.names = [known.id_to_piece(i) for i in range(n)]
        self.bytes_ids = {int(names[i][3:5], 16): i for i in range(n) if known.is_byte(i)}
        if len(self.bytes_ids) != 256:
            raise ValueError("the model has no piece for each byte")
        plain = [i for i in range(n) if not (known.is_byte(i) or known.is_control(i) or known.is_unknown(i) or known.is_unused(i))]
        self.automaton = ahocorasick.Automaton()
        for i in plain:
            self.automaton.add_word(names[i], (len(names[i]), i, known.get_score(i)))
        self.automaton.make_automaton()
        self.single = {names[i] for i in plain if len(names[i]) == 1}
        self.unknown = min(known.get_score(i) for i in plain) - UNKNOWN_PENALTY
        self.unit = re.compile(self._units([names[i] for i in plain]))
        self.pairs: dict[tuple[int, int], bool] = {}
        self.spelled: list[bytes] = [b""] * n
        for i in plain:
            self.spelled[i] = names[i].replace(BLANK, " ").encode()
        for b, i in self.bytes_ids.items():
            self.spelled[i] = bytes([b])

    @staticmethod
    def _units(names: list[str]) -> str:
        """Pattern of the parts that a text falls into because no piece spans two of them.

        Blanks lead a part if no piece holds one behind something else. Then letters and digits are
        apart from the rest, but for those that some piece holds beside other characters.
        """
        if any(re.search(f"[^{BLANK}]{BLANK}", x) for x in names):
            return r"(?s).+"
        rest: set[str] = set()
        while more := {
            c for x in names for a, b in zip(x.lstrip(BLANK), x.lstrip(BLANK)[1:], strict=False)
            if (a.isalnum() and a not in rest) != (b.isalnum() and b not in rest) for c in (a, b) if c.isalnum()
        } - rest:
            rest |= more
        rest_class = re.escape("".join(sorted(rest)))
        return rf"{BLANK}*[^\W_{rest_class}]+|{BLANK}*(?:(?!{BLANK})[\W_{rest_class}])+|{BLANK}+"

    def merged(self, text: str) -> list[int]:
        """Ids after the merges of a BPE model, one after another: the rule that :meth:`follows` applies to two pieces."""
        found: dict[tuple[int, int], tuple[float, int]] = {}
        for last, (length, number, gain) in self.automaton.iter(text):
            found[last + 1 - length, last + 1] = -gain, number
        n = len(text)
        # By start, where the part ends (0: merged into another); by end, where it starts.
        ends, starts = list(range(1, n + 1)), list(range(-1, n))
        queue = [(found[i, i + 2][0], i, i + 1, i + 2) for i in range(n - 1) if (i, i + 2) in found]
        heapify(queue)
        while queue:
            _, start, middle, end = heappop(queue)
            if ends[start] != middle or ends[middle] != end:
                continue
            ends[start], ends[middle], starts[end] = end, 0, start
            if start and (starts[start], end) in found:
                heappush(queue, (found[starts[start], end][0], starts[start], start, end))
            if end < n and (start, ends[end]) in found:
                heappush(queue, (found[start, ends[end]][0], start, end, ends[end]))
        out: list[int] = []
        at = 0
        while at < n:
            known = found.get((at, ends[at]))
            out += [known[1]] if known else [self.bytes_ids[b] for b in self._bytes(text[at])]
            at = ends[at]
        return out

    def follows(self, left: int, right: int) -> bool:
        """Whether the merges of a BPE model leave two pieces side by side; ``left`` -1 for none."""
        pair = left, right
        known = self.pairs.get(pair)
        if known is None:
            before = [] if left < 0 else [left]
            known = self.merged("".join(self.names[i] for i in (*before, right))) == [*before, right]
            if len(self.pairs) < self.most_pairs:
                self.pairs[pair] = known
        return known

    def lasting(self, text: str) -> list[int]:
        """Ids that a BPE model's merges leave, in one pass over the text."""
        n, at, single, follows = len(text), 0, self.single, self.follows
        start, piece = [-1] * (n + 1), [-1] * (n + 1)
        start[0] = 0
        for last, (length, number, _) in self.automaton.iter(text):
            end = last + 1
            while at < end:  # a character that is no piece stands alone
                if text[at] not in single:
                    start[at + 1] = at
                at += 1
            if start[end] < 0 and start[end - length] >= 0 and follows(piece[end - length], number):
                start[end], piece[end] = end - length, number
        return self._back(text, start, piece)

    def best(self, text: str) -> list[int]:
        """Ids of the best segmentation, in one pass over the text."""
        n, at, single, unknown = len(text), 0, self.single, self.unknown
        score, start, piece = [0.0] + [-np.inf] * n, [0] * (n + 1), [-1] * (n + 1)
        for last, (length, number, gain) in self.automaton.iter(text):
            end = last + 1
            while at < end:  # a character that is no piece can always pass as unknown
                if text[at] not in single:
                    score[at + 1], start[at + 1] = score[at] + unknown, at
                at += 1
            total = score[end - length] + gain
            if total > score[end]:
                score[end], start[end], piece[end] = total, end - length, number
        return self._back(text, start, piece)

    def _back(self, text: str, start: list[int], piece: list[int]) -> list[int]:
        """The best path to the end, read backwards; what follows the last match is unknown too."""
        out: list[int] = []
        n = len(text)
        while n:
            at = start[n] if piece[n] >= 0 else n - 1
            out += [piece[n]] if piece[n] >= 0 else [self.bytes_ids[b] for b in reversed(self._bytes(text[at]))]
            n = at
        return out[::-1]

    @staticmethod
    def _bytes(character: str) -> bytes:
        return (BLANK if character == KEPT else character).encode()

    def text(self, ids: np.ndarray) -> str:
        return b"".join(map(self.spelled.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


class Units(dict):
    """Ids by unit of text; a unit is segmented once per worker, while fewer than ``most`` are known."""

    most = 500_000

    def __init__(self, pieces: Pieces):
        self.pieces = pieces

    def __missing__(self, unit: str) -> bytes:
        ids = np.array(self.segment(unit), "<i4").tobytes()
        if len(unit) <= 64 and len(self) < self.most:
            self[unit] = ids
        return ids

    def segment(self, unit: str) -> list[int]:
        return self.pieces.best(unit)

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        marked = BLANK + text.replace(BLANK, KEPT).replace(" ", BLANK)
        return np.frombuffer(b"".join(map(self.__getitem__, self.pieces.unit.findall(marked))), "<i4")


class MergedUnits(Units):
    """Ids of a BPE model by unit of text; no merge spans two units either."""

    def segment(self, unit: str) -> list[int]:
        return self.pieces.lasting(unit)


def units_of(model: str) -> Units:
    """Units that are segmented as the model's kind asks for."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(model, "rb") as f:
        proto.ParseFromString(f.read())
    kind = proto.trainer_spec.model_type
    if kind == proto.trainer_spec.UNIGRAM:
        return Units(Pieces(model))
    if kind != proto.trainer_spec.BPE:
        raise ValueError("the model is neither BPE nor unigram")
    if any(x.type in (x.USER_DEFINED, x.UNUSED) for x in proto.pieces):
        raise ValueError("user-defined and unused pieces of a BPE model are not merged here")
    return MergedUnits(Pieces(model))


@lru_cache(1)
def worker_units(model: str) -> Units:
    """A worker's units, which its later tasks find filled."""
    return units_of(model)


def encode(text: Column | str, model: str) -> Column:
    """The ids of each text."""

    @F.pandas_udf("array<int>")
    def ids(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        units = worker_units(model)
        for texts in columns:
            yield pd.Series([units.encode(t) for t in texts], dtype=object)

    return ids(text)


def decode(ids: Column | str, model: str) -> Column:
    """The text of each list of ids."""

    @F.pandas_udf("string")
    def text(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = worker_units(model).pieces
        for lists in columns:
            yield pd.Series([pieces.text(np.asarray(x)) if x is not None and len(x) else "" for x in lists], dtype=object)

    return text(ids)
