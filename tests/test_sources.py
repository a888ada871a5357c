"""Files: numbering over many splits, encodings, fixed and delimited texts, XML."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lineferry import Field, LoadSpec, load_summary, route
from lineferry.sources.lines import read_delimited, read_fixed, read_lines, split_marks, with_line_no
from lineferry.sources.xmlsplit import Tokenizer, Walk, split_records
from lineferry.sources.records import extract_source, read_xml, read_xml_records
from lineferry.spec import DELIMITED, XML


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_line_numbers_over_many_splits(spark, tmp_path, small_splits):
    (tmp_path / "a.txt").write_text("".join(f"{'x' * (i % 50)}{i}\n" for i in range(3000)))
    (tmp_path / "b.txt").write_text("".join(f"b{i}\n" for i in range(500)))
    lines = read_lines(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() > 20
    through = with_line_no(lines).orderBy("_line_no").collect()
    assert [r._line_no for r in through] == list(range(1, 3501))
    assert [r.value.lstrip("x") for r in through[:3000]] == [str(i) for i in range(3000)]
    assert [r.value for r in through[3000:]] == [f"b{i}" for i in range(500)]
    own = with_line_no(lines, per_file=True).filter(F.col("value").startswith("b")).orderBy("_line_no").collect()
    assert [r._line_no for r in own] == list(range(1, 501))


def test_numbers_without_a_broadcast(spark, tmp_path, small_splits, monkeypatch):
    """Too many splits for a broadcast: the same numbers by a join Spark chooses."""
    monkeypatch.setattr("lineferry.sources.lines.BROADCAST_BYTES", 0)
    (tmp_path / "a.txt").write_text("".join(f"{i}\n" for i in range(2000)))
    rows = with_line_no(read_lines(spark, str(tmp_path))).collect()
    assert {r._line_no: int(r.value) for r in rows} == {i + 1: i for i in range(2000)}


def test_encoding(spark, tmp_path):
    (tmp_path / "latin.txt").write_bytes("café\nniño\n".encode("latin-1"))
    rows = with_line_no(read_lines(spark, str(tmp_path / "latin.txt"), "ISO-8859-1")).orderBy("_line_no").collect()
    assert [r.value for r in rows] == ["café", "niño"]


def test_marks(lines):
    out = split_marks(lines("H1", "T1", "D1"), ("H",), ("T", "X")).orderBy("_line_no").collect()
    assert [r._mark for r in out] == ["header", "trailer", "data"]


def test_fixed_texts(lines):
    spec = LoadSpec("T", [Field("A", 1, 3), Field("B", 4, 6), Field("Z")])
    out = read_fixed(lines("ab\t x ", "abc", "", "äöüß"), spec).orderBy("_line_no").collect()
    assert [(r.A, r.B, r.Z) for r in out] == [("ab", "x", ""), ("abc", "", ""), ("", "", ""), ("äöü", "ß", "")]


def test_short_lines_without_padding(lines):
    spec = LoadSpec("T", [Field("A", 1, 3), Field("B", 4, 6)], pad=False)
    out = route(lines("abcdef", "abcd", "abc"), spec).orderBy("_line_no").collect()
    assert [r._status for r in out] == ["ok", "parse", "parse"]
    assert out[1]._reason == "B: line too short"
    assert read_fixed(lines("abcdef", "abcd"), spec).count() == 1


@pytest.mark.parametrize("delimiter,sep", [("|", "|"), ("TAB", "\t"), ("space", " "), (".", "."), ("124", "|"), ("*", "*"), ("59", ";"), ("::", "::")])
def test_delimiters_are_literal(lines, delimiter, sep):
    spec = LoadSpec("T", [Field("A", 1), Field("B", 2), Field("C", 4)], kind=DELIMITED, delimiter=delimiter)
    out = read_delimited(lines(sep.join("abcd"), sep.join(["a", "", "c", ""]), "a"), spec).orderBy("_line_no").collect()
    assert [(r.A, r.B, r.C) for r in out] == [("a", "b", "d"), ("a", "", None), ("a", None, None)]


XML_TEXT = """<?xml version="1.0"?>
<orders>
  <order><ID>1</ID><NAME>a &amp; b</NAME></order>
  <order kind="x">
    <ID>2</ID><NAME/>
  </order>
  <order><ID>3</ID></order>
</orders>
"""


@pytest.mark.parametrize("split", [False, True])
def test_xml(spark, tmp_path, split):
    (tmp_path / "o.xml").write_text(XML_TEXT)
    rows = read_xml(spark, str(tmp_path / "o.xml"), "order", ["ID", "NAME"], split=split)
    assert sorted((r.ID, r.NAME) for r in rows.collect()) == [("1", "a & b"), ("2", None), ("3", None)]


def test_split_xml_reads_one_file_in_many_tasks(spark, tmp_path, small_splits):
    body = "\n".join(f"<order>\n  <ID>{i}</ID>\n</order>" for i in range(2000))
    (tmp_path / "o.xml").write_text(f"<orders>\n{body}\n</orders>\n")
    rows = read_xml(spark, str(tmp_path / "o.xml"), "order", ["ID"], split=True)
    assert rows.rdd.getNumPartitions() > 10
    assert sorted(int(r.ID) for r in rows.collect()) == list(range(2000))


def test_split_xml_keeps_self_closing_and_corrupt_records(spark, tmp_path):
    (tmp_path / "o.xml").write_text(
        "<orders><order_s/><order/><order a='x>y' b=\"1\"/><order><ID>5</ID></order ><order\n><ID>6</ID></order>"
        "<order><ID>7</NAME></order><order a='1><ID>8</ID></order><order c='2'><order_id>3</order_id><ID>9</ID></order><order /></orders>")
    spec = LoadSpec("T", [Field("KEY", tag="ID", convert="long")], kind=XML, row_tag="order")
    rows = route(read_xml_records(spark, str(tmp_path / "o.xml"), spec, split=True), spec).orderBy("_line_no").collect()
    assert [(r.KEY, r._status) for r in rows] == [
        (None, "ok"), (None, "ok"), (5, "ok"), (6, "ok"), (None, "parse"), (None, "parse"), (9, "ok"), (None, "ok")]
    assert "<ID>7</NAME>" in rows[4].value and "<ID>8</ID>" in rows[5].value
    (tmp_path / "dots.xml").write_text("<r><aXb><ID>1</ID></aXb><a.b><ID>2</ID></a.b></r>")
    assert [r.ID for r in read_xml(spark, str(tmp_path / "dots.xml"), "a.b", ["ID"], split=True).collect()] == ["2"]


ODD_XML = """<?xml version="1.0"?>
<!-- <order><ID>no</ID></order> -->
<orders a='x>y' b="/order>">
<order/><order note='a>b'/><order x="1 > '0'" />
<order><ID>1</ID><NAME><![CDATA[</order><order><ID>2</ID></order>]]></NAME></order>
</order>
<order
 kind="/order>"><ID>3</ID><!-- </order> --><NAME>a -- b > c</NAME></order>
<orders_x><order_s/><orderly><ID>no</ID></orderly></orders_x>
<order><?pi </order> ?><ID>4</ID></order >
<order><ID>5</ID><SUB><order><ID>6</ID></order></SUB></order>
<![CDATA[<order><ID>no</ID></order>]]>
</orders>
"""


def test_split_xml_reads_markup_as_the_whole_file_does(spark, tmp_path, small_splits):
    (tmp_path / "odd.xml").write_text(ODD_XML)
    for end in range(60, 130, 7):  # each width moves the places where tasks begin
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(end))
        got = [r.record for r in split_records(spark, str(tmp_path / "odd.xml"), "order").orderBy("file", "block", "n").collect()]
        assert got == [
            "<order/>", "<order note='a>b'/>", '<order x="1 > \'0\'" />',
            "<order><ID>1</ID><NAME><![CDATA[</order><order><ID>2</ID></order>]]></NAME></order>",
            '<order\n kind="/order>"><ID>3</ID><!-- </order> --><NAME>a -- b > c</NAME></order>',
            "<order><?pi </order> ?><ID>4</ID></order >", "<order><ID>5</ID><SUB><order><ID>6</ID></order></SUB></order>"]
    rows = read_xml(spark, str(tmp_path / "odd.xml"), "order", ["ID", "NAME"], split=True).collect()
    assert sorted((r.ID or "", r.NAME or "") for r in rows) == [
        ("", ""), ("", ""), ("", ""), ("1", "</order><order><ID>2</ID></order>"), ("3", "a -- b > c"), ("4", ""), ("5", "")]


@pytest.mark.parametrize("record", ["<order/>", "<order a='>'/>", "<order><ID>1</ID><![CDATA[<order>]]></order>", "<order><ID>1</ID></order>"])
def test_split_xml_gives_what_whole_files_give(spark, tmp_path, small_splits, record):
    (tmp_path / "o.xml").write_text("<orders>" + record * 700 + "</orders>")
    whole = read_xml(spark, str(tmp_path / "o.xml"), "order", ["ID"]).collect()
    split = read_xml(spark, str(tmp_path / "o.xml"), "order", ["ID"], split=True)
    assert split.count() == 700 and sorted(map(tuple, split.collect()), key=str) == sorted(map(tuple, whole), key=str)


def test_split_xml_of_files_that_end_early(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<orders><order><ID>1</ID></order><order><ID>2</ID>")
    (tmp_path / "b.xml").write_text("")
    (tmp_path / "c.xml").write_text("<orders><!-- <order><ID>no</ID></order>")
    spec = LoadSpec("T", [Field("KEY", tag="ID", convert="long")], kind=XML, row_tag="order")
    rows = route(read_xml_records(spark, str(tmp_path), spec, split=True), spec).orderBy("_line_no").collect()
    assert [(r.KEY, r._status) for r in rows] == [(1, "ok"), (None, "parse")]


def plain_records(text: str, record: str) -> list[str]:
    """The records of a file, piece by piece."""
    tokens, state, depth, held, out = Tokenizer(record), 0, 0, "", []
    pieces = text.split(">")
    for piece in pieces if pieces[-1] else pieces[:-1]:
        state, begins, ends, start = tokens.step(state, piece)
        if begins and depth == 0:
            held, piece = "", piece[start:]
        inside, depth = begins or depth > 0, max(0, depth + begins - ends)
        held += (piece + ">") * inside
        if inside and depth == 0:
            out, held = [*out, held], ""
    return out + [held] * (depth > 0)


@pytest.mark.parametrize("record", ["order", "a.b", "ö-r"])
def test_split_xml_steps_over_no_piece_that_matters(spark, tmp_path, small_splits, record):
    rng = random.Random(5)
    parts = [f"<{record}", f"</{record}", record, ">", ">", ">", "'", '"', "<!--", "-->", "<![CDATA[", "]]>", "<?", "?>", "/", " ", "\n", "x", "<", "é", f"<{record}>"]
    for k in range(3):
        text = "".join(rng.choices(parts, k=400))
        path = tmp_path / f"{k}.xml"
        path.write_text(text)
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(rng.choice([90, 300, 5000])))
        got = [r.record for r in split_records(spark, str(path), record).orderBy("file", "block", "n").collect()]
        assert got == plain_records(text, record)


def test_split_xml_takes_few_steps(monkeypatch):
    """Tags that are no records, and texts, are passed over unread."""
    taken, step = [], Tokenizer.step
    monkeypatch.setattr(Tokenizer, "step", lambda self, state, piece: taken.append(piece) or step(self, state, piece))
    pieces = [p for i in range(1000) for p in ("<order", "<ID", f"{i}</ID", "<!-- no --", "</order")]
    walked = [p for p, *_ in Walk(Tokenizer("order"), pa.array(pieces)).run(0)]
    assert walked == [i for i in range(5000) if i % 5 in (0, 3, 4)] and len(taken) < 10


def test_xml_load(spark, tmp_path):
    (tmp_path / "o.xml").write_text(XML_TEXT)
    spec = LoadSpec("T", [
        Field("KEY", tag="ID", convert="long", key=True), Field("NAME", tag="NAME", optional=False), Field("SRC", tag="SRC", default="X"),
    ], kind=XML, row_tag="order", headers=("{",))
    routed = route(read_xml_records(spark, str(tmp_path / "o.xml"), spec), spec)
    assert sorted((r.KEY, r.NAME, r.SRC, r._status) for r in routed.collect()) == [
        (1, "a & b", "X", "ok"), (2, None, "X", "parse"), (3, None, "X", "parse")]
    assert load_summary(routed).first().header_trailer == 0


def test_extract_source(spark):
    assert extract_source(spark, "select 1 as a, 'x' as Bc").columns == ["A", "BC"]
