from __future__ import annotations

import hashlib
import re

import pytest

from lineferry.llm.infill import Infill, fill_in_middle, restore
from lineferry.llm.queries import ORACLES, QUERIES
from pyspark.sql import functions as F
from tests_compare import check

TEXTS = [
    "", None, "one line", "one line\n", "\n", "\n\n\n", "a\nb\nc\nd\ne", "a\nb\nc\nd\ne\n", "ä🎉\nß\r\nx\u2028y\u0085z\n$1 \\2\n", "has <P> in it\nb", "<S>", "a<\nM>\nb", "<<\n>P\n<S\nx<M",
    "x" * 300_000, "many\n" * 60_000, "\n" * 60_000, "word " * 50_000 + "\n" + "z\n" * 3,
]


def by_hand(key, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(("7:" + ("" if key is None else str(key))).encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (60, 0), (100, 100)])
def test_every_case_by_hand(spark, rate, spm):
    rows = [(i, t, "kept", 1) for i in (1, 2, 3, 77, None) for t in TEXTS]
    docs = spark.createDataFrame(rows, "doc_id int, text string, FORM string, _text int").repartition(4)
    how = Infill(rate=rate, spm=spm)
    done = fill_in_middle(docs, how)
    assert done.columns == ["doc_id", "text", "_text", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = done.withColumn("back", restore(F.col("output"), F.col("form"), how)).collect()
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == by_hand(r.doc_id, r.text, rate, spm)
        assert r.back == (r.text or "")
    assert len(got) == len(rows) and {r.form for r in got} >= {"plain"}


def test_markers_that_could_come_about(spark):
    for bad in ({"prefix": ""}, {"prefix": "$1"}, {"prefix": "<S>>"}, {"prefix": "aba"}, {"prefix": "><"}):
        with pytest.raises(ValueError):
            Infill(**bad)


def test_empty_and_key_of_another_name(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert fill_in_middle(none).count() == 0
    other = spark.createDataFrame([("k.1", "a\nb\n")], "`my.key` string, `my.text` string")
    r = fill_in_middle(other, key="my.key", text="my.text").first()
    assert (r.n, r.output) == (2, by_hand("k.1", "a\nb\n")[4])


def test_sql(spark):
    check(spark, QUERIES, ORACLES, "op13_infill")
