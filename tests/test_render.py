"""Rendering, layouts and the way back."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql.functions import pandas_udf

from lineferry import ExtractSpec, Field, LoadSpec, Lookup, extract_lines, extract_summary, register_conversion, render_rows, route, run_extract, with_header_footer
from lineferry.plans.extract import write_extract
from lineferry.spec import DELIMITED, KEY_VALUE, XML, SpecError

RUN = dt.datetime(2024, 2, 1)


def render(spark, values, sql_type, kind, width=0, default=None, **args):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i bigint, F {sql_type}")
    spec = ExtractSpec("X", [Field("F", 1 if width else 0, width, convert=kind, default=default, args=args)], run_ts=RUN)
    return [r.F for r in render_rows(rows, spec, "i").orderBy("i").collect()]


def test_null_fillers(spark):
    cases = {
        ("string", "text"): "    ", ("string", "left_trim"): "0000", ("int", "integer"): " 000", ("bigint", "long"): " 000",
        ("decimal(9,2)", "currency"): " 000", ("date", "date"): "0000", ("timestamp", "short_date"): "    ",
        ("date", "julian_date"): "0000", ("string", "time"): "0000", ("boolean", "yn_boolean"): "    ",
        ("int", "debit_credit"): "    ", ("string", "line_break_trim"): "    ", ("string", "phone"): None,
    }
    for (kind, name), filler in cases.items():
        assert render(spark, [None], kind, name, 4) == [filler], name
        assert render(spark, [None], kind, name) == [None], name
        if name not in ("line_break_trim",):
            assert render(spark, [None], kind, name, 4, default="D") == ["D"], name
    assert render(spark, [None], "date", "date_roll", 4, direction="FORWARD") == ["0000"]
    assert render(spark, [None], "date", "date", 10, pattern="dd/MM/yyyy") == [" " * 10]


def test_numbers(spark):
    assert render(spark, [5, -5, 0], "int", "integer", 4) == [" 005", "-005", " 000"]
    assert render(spark, [-(2**63)], "bigint", "long", 21) == ["-09223372036854775808"]
    assert render(spark, [D("1.005"), D("1.015"), D("-0.05"), D("0")], "decimal(9,3)", "currency", 6, positive_sign="+") == [
        "+00100", "+00102", "-00005", "+00000"]
    assert render(spark, [D("1.50")], "decimal(9,2)", "currency") == ["1.50"]


def test_flags_and_text(spark):
    assert render(spark, [1, -1, 0], "int", "debit_credit", 2) == ["C ", "D ", "  "]
    assert render(spark, [True, False], "boolean", "yn_boolean", 2, indicator="J") == ["J ", "N "]
    assert render(spark, ["abc", ""], "string", "text", 3) == ["abc", "   "]
    assert render(spark, ["7", ""], "string", "left_trim", 3, char="*") == ["**7", "***"]
    assert render(spark, ["a\nb\r"], "string", "line_break_trim", 5) == ["a b  "]


def test_dates(spark):
    day = dt.date(2024, 2, 29)
    assert render(spark, [day], "date", "date", 10) == ["0020240229"]
    assert render(spark, [day], "date", "date", 12, pattern="dd.MM.yyyy") == ["29.02.2024  "]
    assert render(spark, [day], "date", "julian_date", 9) == ["2024060"]
    assert render(spark, [day, dt.date(2024, 1, 30)], "date", "date_roll", 4, direction="FORWARD") == [" 028", "-002"]
    assert render(spark, [day], "date", "date_roll", direction="BACKWARD") == ["-28"]
    assert render(spark, ["23:59:01"], "string", "time", 6) == ["235901"]


def faults(spark, values, sql_type, kind, width=0, **args):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i bigint, F {sql_type}")
    spec = ExtractSpec("X", [Field("F", 1 if width else 0, width, convert=kind, args=args)], run_ts=RUN)
    return [r._reason for r in render_rows(rows, spec, "i").orderBy("i").collect()]


def test_nothing_is_cut(spark):
    wide = "F: does not fit"
    assert faults(spark, [1234567, 1234, None], "bigint", "long", 5) == [wide, None, None]
    assert faults(spark, [D("98765.43"), D("987.65")], "decimal(9,2)", "currency", 6) == [wide, None]
    for kind, value, width in (("text", "abcd", 3), ("left_trim", "abcd", 3), ("line_break_trim", "a\nbc", 3), ("phone", "60123", 4)):
        assert faults(spark, [value], "string", kind, width) == [wide], kind
    assert faults(spark, [dt.date(2024, 2, 29)], "date", "date", 7) == [wide]
    assert faults(spark, [dt.date(2024, 2, 29)], "date", "julian_date", 6) == [wide]
    assert faults(spark, [dt.date(2034, 2, 28)], "date", "date_roll", 4, direction="FORWARD") == [wide]
    assert render(spark, [dt.datetime(2024, 2, 29, 10, 20, 30, 500000)], "timestamp", "time", 6) == ["102030"]


def test_bad_values_are_row_faults(spark):
    for kind in ("integer", "long", "currency", "date", "short_date", "julian_date", "time", "yn_boolean", "debit_credit"):
        assert faults(spark, ["abc"], "string", kind, 14) == [f"F: not a valid {kind}"], kind
    assert faults(spark, ["abc", "7"], "string", "long") == ["F: not a valid long", None]


def test_no_reverse(spark):
    for kind in ("currency_sum", "century_date", "integer_div"):
        with pytest.raises(SpecError):
            render(spark, ["1"], "string", kind)


few = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@few
@given(st.lists(st.tuples(
    st.integers(-(10**11), 10**11), st.decimals(-(10**9), 10**9, places=2), st.dates(dt.date(1900, 1, 1), dt.date(2999, 12, 31)),
    st.text("abcXYZ", min_size=1, max_size=6),
), min_size=1, max_size=10))
def test_round_trip(spark, rows):
    """What an extract prints, a load of the same fields reads back."""
    fields = [
        Field("N", 1, 14, convert="long"), Field("M", 15, 30, convert="currency"), Field("D", 31, 38, convert="date"),
        Field("S", 40, 48, convert="string"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_line_no bigint, N bigint, M decimal(18,2), D date, S string")
    lines = extract_lines(df, ExtractSpec("X", fields), "_line_no")
    back = route(lines, LoadSpec("T", fields)).orderBy("_line_no").collect()
    assert [(r.N, r.M, r.D, r.S, r._status) for r in back] == [(*r, "ok") for r in rows]


@pytest.fixture
def people(spark):
    return spark.createDataFrame([(1, "Ann", 7), (2, None, 8), (3, "Bo & <C>", None)], "_line_no bigint, NAME string, N int")


def layout(people, kind, *fields, **more):
    spec = ExtractSpec("people", fields, kind=kind, run_ts=RUN, **more)
    return [r.value for r in extract_lines(people, spec, "_line_no").orderBy("_line_no").collect()]


def test_layouts(people):
    name, n = Field("NAME", 3, 6), Field("N", 1, 1, convert="integer")
    assert layout(people, "fixed", Field("NAME", 4, 6), Field("N", 1, 2, convert="integer")) == [" 7 Ann", " 8    "]
    assert layout(people, DELIMITED, name, n, delimiter=";") == ["7;;Ann", "8;;", ";;Bo & <C>"]
    assert layout(people, DELIMITED, name, n, delimiter="TAB")[0] == "7\t\tAnn"
    assert layout(people, KEY_VALUE, name, n) == ["n=7||name=Ann", "n=8||name=", "n=||name=Bo & <C>"]
    xml = layout(people, XML, Field("NAME", tag="b"), Field("N", tag="a", convert="integer"), record_tag="p")
    assert xml == ["\t<p><a>7</a><b>Ann</b></p>", "\t<p><a>8</a><b></b></p>", "\t<p><a></a><b>Bo &amp; &lt;C></b></p>"]


def test_overlapping_fields_overlay(people):
    assert layout(people, "fixed", Field("NAME", 1, 5), Field("N", 2, 3, convert="integer"))[0] == "A 7  "


def test_filters_lookups_and_summary(spark, people):
    dim = spark.createDataFrame([(7, "seven"), (8, "eight")], "k int, w string")
    spec = ExtractSpec("people", [
        Field("NAME", 1, filter_values=("NOT_NULL",)), Field("W", 2, lookup=Lookup(dim, {"N": "k"}, "w")),
        Field("N", convert="integer", external=True), Field("SEQ", 3, convert="running_number", args={"length": 3}),
        Field("BOTH", 4, convert="merge_fields", args={"fields": ("W", "NAME"), "delimiter": "+"}),
    ], kind=DELIMITED)
    rendered = render_rows(people, spec, "_line_no").orderBy("_line_no")
    assert [(r.W, r.SEQ, r.BOTH, r._status) for r in rendered.collect()] == [
        ("seven", "001", "seven+Ann", "ok"), ("eight", "002", "eight+", "filtered"), (None, None, "Bo & <C>", "integrity")]
    assert extract_summary(rendered).first().asDict() == {"records": 3, "written": 1, "filtered": 1, "integrity": 1, "unknown": 0}


def test_header_footer_and_file(spark, people, tmp_path):
    spec = ExtractSpec("people", [Field("NAME", 1, 9)], header="{name} {start}", footer="{count} of {definition}", definition="p.def", run_ts=RUN)
    whole = with_header_footer(extract_lines(people, spec, "_line_no"), spec)
    write_extract(whole, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text == "people 2024-02-01 00:00:00\nAnn      \n         \nBo & <C> \n3 of p.def\n"
    bare = ExtractSpec("people", [Field("NAME", 1, 9)], footer="end")
    assert with_header_footer(extract_lines(people, bare, "_line_no"), bare).count() == 4
    xml = ExtractSpec("people", [Field("NAME", tag="n")], kind=XML, root_tag="all")
    ends = [r.value for r in with_header_footer(extract_lines(people, xml, "_line_no"), xml).orderBy("_part").collect()]
    assert (ends[0], ends[-1]) == ("<all>", "</all>")


def test_registered_conversion_may_use_pandas(spark, lines):
    @pandas_udf("int")
    def length(s: pd.Series) -> pd.Series:
        return s.str.len().astype("Int32")

    register_conversion("text_length", lambda text, ctx: length(text), spark_type="int")
    spec = LoadSpec("T", [Field("A", 1, 5, convert="text_length")])
    assert [r.A for r in route(lines("abc", "ab"), spec).orderBy("_line_no").collect()] == [3, 2]


def test_run_extract_counts_while_it_writes(spark, tmp_path):
    people = spark.createDataFrame([(3, "c", 1), (1, "a", 2), (2, "longer", 3)], "_line_no bigint, NAME string, X int")
    spec = ExtractSpec("P", [Field("NAME", 1, 3), Field("X", 4, 5, convert="integer")], header="H {name}", footer="T {count}", run_ts=RUN)
    seen = spark.sparkContext.accumulator(0)
    looked = people.rdd.map(lambda r: (seen.add(1), r)[1]).toDF(people.schema)
    assert run_extract(looked, spec, str(tmp_path / "out")) == {"records": 3, "written": 2, "filtered": 0, "integrity": 0, "unknown": 1}
    assert seen.value == 3  # every row once
    texts = [r.value for p in ("0-header", "1-body", "2-footer") for r in spark.read.text(str(tmp_path / "out" / p)).collect()]
    assert texts == ["H P", "a   2", "c   1", "T 2"]
