from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lineferry.llm.packing import best_fit_decreasing, pack_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_best_fit(lengths, size):
    rooms, out = [], []
    for n in lengths:
        fit = min((r for r in rooms if r >= n), default=None)
        if fit is None:
            rooms.append(size - n)
            out.append(0)
        else:
            rooms[rooms.index(fit)] = fit - n
            out.append(size - fit)
    return len(rooms), out


def test_best_fit_as_by_hand():
    rng = np.random.default_rng(1)
    for size in (7, 64, 100):
        for top in (3, size // 2 + 1, size + 1):
            lengths = np.sort(rng.integers(1, top, 200))[::-1]
            sequence, offset = best_fit_decreasing(lengths, size)
            used, offsets = plain_best_fit(lengths.tolist(), size)
            assert sequence.max() + 1 == used and offset.tolist() == offsets


TEXTS = [
    (1, "Hello  world,\n\tIT'S 2024!\x0b\x1cend\u00a0of\u2003line e\u0301te\u0301 ﬁ İstanbul ΣΑΣ"), (2, ""), (3, None), (4, "word " * 5000),
    (5, "x" * 30000), (6, "<|endoftext|> a<|startoftext|>b"), (7, "日本語 text 🎉🎉 don't"), (None, "no id"), (1, "again"), (1, "again"),
]


def test_ids_and_places(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in TEXTS], "doc_id bigint, text string, length string")
    rows = pack_documents(docs, PATH, length=64).collect()
    tok = Tokenizer.from_file(PATH)
    want = []
    for i, t in TEXTS:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(i, at, len(p := ids[at : at + 64]), zlib.crc32(np.array(p, "<u4").tobytes()), len(ids)) for at in range(0, len(ids), 64)]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows), key=key) == sorted(want, key=key)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 64


def test_no_documents(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id bigint, text string"), PATH).count() == 0


def test_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = pack_documents(docs, PATH).groupBy("sequence_id").sum("length").collect()
    assert sum(2048 - r[1] for r in rows) < 0.01 * 2048 * len(rows)
