from __future__ import annotations

import random

import public_tokenizers
import pytest

from lineferry.llm.subwords import BLANK, KEPT, Pieces, Units, decode, encode, units_of

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return Pieces(PATH)


def plain_best(pieces, table, text):
    """Best sum over all segmentations, position by position, trying every piece by length."""
    best = [0.0]
    for end in range(1, len(text) + 1):
        options = [best[s] + table[text[s:end]] for s in range(max(0, end - 40), end) if text[s:end] in table]
        if text[end - 1] not in pieces.single:
            options.append(best[end - 1] + pieces.unknown)
        best.append(max(options))
    return best[-1]


TEXTS = ["Hello  world, this is tokenization\n\tof   things", "日本語 über çà 🎉🎉", BLANK + " literal " + BLANK * 3, " ", "   lead and trail  ", "a" * 3000, "\x00\x1f� é", "x"]


def test_best_sum(pieces):
    table = {word: value[2] for word, value in pieces.automaton.items()}
    rng = random.Random(3)
    made = ["".join(rng.choice("the in\nandréß▁日 ") for _ in range(rng.randint(1, 60))) for _ in range(200)]
    for text in TEXTS + made:
        marked = BLANK + text.replace(BLANK, KEPT).replace(" ", BLANK)
        ids = Units(pieces).encode(text).tolist()
        total, i = 0.0, 0
        while i < len(ids):
            spelled = pieces.spelled[ids[i]]
            if ids[i] in pieces.bytes_ids.values():  # one unknown character as its bytes
                size = 1 if spelled[0] < 0x80 else 2 if spelled[0] < 0xE0 else 3 if spelled[0] < 0xF0 else 4
                total, i = total + pieces.unknown, i + size
            else:
                total, i = total + table[spelled.decode().replace(" ", BLANK)], i + 1
        assert total == pytest.approx(plain_best(pieces, table, marked))
        assert pieces.text(Units(pieces).encode(text)) == text


def test_ids_are_those_of_sentencepiece(spark):
    import sentencepiece

    known = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rng = random.Random(5)
    made = ["".join(rng.choice("the in\nandréß_-'9日ation ") for _ in range(rng.randint(1, 200))) for _ in range(500)]
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() if r.text]
    texts = [t for t in [*TEXTS, "information government", "日本語の文章です" * 500, *made, *docs] if BLANK not in t]
    units = units_of(PATH)
    assert [units.encode(t).tolist() for t in texts] == [known.encode(t) for t in texts]
    rows = spark.createDataFrame([("government",)], "text string").select(encode("text", PATH).alias("ids")).collect()
    assert rows[0].ids == known.encode("government") and len(rows[0].ids) == 1


def test_one_pass_leaves_what_the_merges_leave(pieces):
    rng = random.Random(8)
    pool = [n for n in pieces.names if n[0] != "<"]
    made = ["".join(rng.choice("aenrst" + BLANK) for _ in range(rng.randint(1, 80))) for _ in range(1500)]
    made += ["".join(rng.choice(pool) for _ in range(rng.randint(1, 8))) for _ in range(3000)]
    made += [c * k for c in "aelo-=_0 日" for k in (2, 3, 4, 5, 7, 8, 15, 16, 17, 33, 101)] + [KEPT * 3 + "a" + KEPT, "🎉x🎉🎉"]
    for text in made:
        assert pieces.lasting(text) == pieces.merged(text)
    few = Pieces(PATH)
    few.most_pairs = 10  # what is not kept is worked out again
    assert all(few.lasting(t) == pieces.merged(t) for t in made[:300]) and len(few.pairs) == 10


def test_round_trip_of_rows(spark):
    rows = [(i, t) for i, t in enumerate([*TEXTS, "", None, "same", "same", "long words " * 20000])]
    docs = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id int, text string, ids int")
    out = docs.withColumn("got", encode("text", PATH)).withColumn("back", decode("got", PATH)).orderBy("doc_id").collect()
    assert [r.back for r in out] == [t or "" for _, t in rows]
    assert out[len(TEXTS)].got == [] and out[0].ids == 0


def test_empty_table(spark):
    assert spark.createDataFrame([], "text string").select(encode("text", PATH)).count() == 0


def test_query_brings_every_text_back(spark):
    from lineferry.llm.queries import QUERIES

    rows = QUERIES["op10_subwords"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000 and all(r.same and r.n_ids > 0 for r in rows)
