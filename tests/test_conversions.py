"""Conversions on literal text: nulls, blanks, signs, defaults and bad text."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lineferry import Field, LoadSpec, route
from lineferry.spec import DELIMITED

RUN = dt.datetime(2024, 2, 1, 10, 30)
TS = dt.datetime


def convert(spark, texts, kind, default=None, nulls=(), **args):
    """(value, status) of each text run through one field of a tab-delimited file."""
    rows = [(i, "#\t" + t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "_line_no bigint, value string")
    spec = LoadSpec("T", [Field("F", 2, convert=kind, default=default, nulls=nulls, args=args)], kind=DELIMITED,
                    delimiter="TAB", run_ts=RUN)
    return [(r.F, r._status) for r in route(df, spec).orderBy("_line_no").collect()]


def values(spark, texts, kind, **kw):
    out = convert(spark, texts, kind, **kw)
    assert all(s == "ok" for _, s in out), out
    return [v for v, _ in out]


def test_null_marks_are_exact_and_replaced_by_the_default(spark):
    assert values(spark, ["N/A", "n/a", "", " N/A"], "text", nulls=("N/A",), default="none") == ["none", "n/a", "none", " N/A"]


def test_text_and_string(spark):
    assert values(spark, ["a ", "  "], "text") == ["a ", "  "]
    assert values(spark, ["a ", "  "], "string") == ["a ", None]
    assert values(spark, ["  "], "string", default="D") == ["D"]


def test_left_trim(spark):
    assert values(spark, ["00120", "000", "x0"], "left_trim") == ["120", "", "x0"]
    assert values(spark, ["**a*"], "left_trim", char=" *# ") == ["a*"]


def test_line_break_trim(spark):
    assert values(spark, [" a\rb ", "\r"], "line_break_trim") == ["ab", None]


def test_whole_numbers(spark):
    texts = ["12", "-7", "+5", "2147483647"]
    assert values(spark, texts, "integer") == [12, -7, 5, 2147483647]
    bad = ["2147483648", " 12", "12 ", "1.0", "x", "1e3"]
    assert convert(spark, bad, "integer") == [(None, "unknown")] * len(bad)
    assert values(spark, ["   "], "integer", default="9") == [9]
    assert values(spark, ["9223372036854775807", "-9223372036854775808"], "long") == [2**63 - 1, -(2**63)]
    assert convert(spark, ["9223372036854775808"], "long") == [(None, "unknown")]
    # Bad text does not fall back to the default, and a bad default is an error of its own.
    assert convert(spark, ["x"], "long", default="1")[0][1] == "unknown"
    assert convert(spark, [""], "long", default="y") == [(None, "unknown")]


def test_integer_division_truncates(spark):
    assert values(spark, ["7", "-7", "0", "6"], "integer_div", by=2) == [3, -3, 0, 3]
    assert convert(spark, [" "], "integer_div", by=2) == [(None, "unknown")]
    with pytest.raises(ValueError):
        convert(spark, ["1"], "integer_div", by=0)


def test_currency(spark):
    texts = ["100", "100-", "-5", "+12", " 7 ", "5 -", "-0", "--3-", "1-2", "1.5", "x", "-", "99999999999999999999"]
    want = [D("1.00"), D("-1.00"), D("-0.05"), D("0.12"), D("0.07"), D("-0.05"), D("0.00"), D("-0.03"), None, None, None, None, None]
    assert values(spark, texts, "currency") == want
    assert values(spark, ["123456"], "currency", decimals=4) == [D("12.3456")]
    assert values(spark, ["12.5", "3.25-", "1e2", "7", ".5", "x"], "currency", decimals=0) == [
        D("12.5"), D("-3.25"), D("100"), D("7"), D("0.5"), None]
    assert values(spark, ["bad"], "currency", default="250") == [D("2.50")]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(-(2**63) + 1, 2**63 - 1), min_size=1, max_size=20))
def test_currency_is_exact(spark, numbers):
    assert values(spark, [str(n) for n in numbers], "currency") == [D(n).scaleb(-2) for n in numbers]


def test_currency_sum(spark):
    df = spark.createDataFrame(
        [(1, "100,50-,7"), (2, ",,"), (3, "x,,5"), (4, "1")], "_line_no bigint, value string"
    )
    fields = [Field("S", 1, convert="currency_sum", args={"fields": ("B", "C")}), Field("B", 2), Field("C", 3)]
    spec = LoadSpec("T", fields, kind=DELIMITED, delimiter=",")
    assert [r.S for r in route(df, spec).orderBy("_line_no").collect()] == [D("0.57"), None, D("0.05"), D("0.01")]


def test_dates(spark):
    day = TS(2024, 2, 29)
    assert values(spark, ["20240229", "20230229", "00000000", "  ", "20240230", "202402291"], "timestamp") == [
        day, None, None, None, None, None]
    assert values(spark, ["current_date"], "timestamp") == [RUN]
    assert values(spark, [""], "date", default="CURRENT_DATE") == [RUN.date()]
    assert values(spark, ["29/02/2024", "0000000000"], "date", pattern="dd/MM/yyyy") == [day.date(), None]
    assert values(spark, ["bad"], "date", default="20240101") == [dt.date(2024, 1, 1)]


def test_short_and_century_dates(spark):
    assert values(spark, ["202402", "2024", "20240215"], "short_date") == [TS(2024, 2, 1), TS(2024, 1, 1), TS(2024, 2, 15)]
    assert values(spark, ["2402"], "short_date", pattern="yyMMdd") == [TS(2024, 2, 1)]
    assert values(spark, ["19000101", "19700101"], "century_date", minimum="19500101") == [TS(2000, 1, 1), TS(1970, 1, 1)]


def test_julian_dates(spark):
    assert values(spark, ["2024032", "2024366", "0000000", " "], "julian_date") == [TS(2024, 2, 1), TS(2024, 12, 31), None, None]
    assert convert(spark, ["2023366", "x"], "julian_date") == [(None, "unknown")] * 2


def test_date_roll(spark):
    assert values(spark, ["3", "-1", ""], "date_roll", direction="FORWARD") == [
        RUN + dt.timedelta(3), RUN - dt.timedelta(1), None]
    assert values(spark, ["3"], "date_roll", direction="backward") == [RUN - dt.timedelta(3)]
    assert convert(spark, ["x"], "date_roll", direction="FORWARD") == [(None, "unknown")]


def test_time(spark):
    assert values(spark, ["235959", "000000", "246060", "CURRENT_TIME"], "time") == ["23:59:59", None, None, "10:30:00"]
    assert values(spark, ["23.15"], "time", pattern="HH.mm") == ["23:15:00"]


def test_flags(spark):
    assert values(spark, ["Y", "y", "N", "", "YES"], "yn_boolean") == [True, True, False, False, False]
    assert values(spark, ["c", " C ", "D", ""], "debit_credit") == [-1, -1, 1, 1]


def test_merge_fields(spark):
    df = spark.createDataFrame([(1, "a|b|c"), (2, "a||c"), (3, "a|b"), (4, "")], "_line_no bigint, value string")
    merged = Field("M", convert="merge_fields", default="none", args={"fields": ("A", "B", "C"), "delimiter": "-"})
    spec = LoadSpec("T", [Field("A", 1), Field("B", 2), Field("C", 3), merged], kind=DELIMITED, delimiter="|")
    # A part missing at the end leaves the delimiter before it; an empty one in the middle is text.
    assert [r.M for r in route(df, spec).orderBy("_line_no").collect()] == ["a-b-c", "a--c", "a-b-", "-"]


def test_phone(spark):
    texts = ["+60 12-345 x7", "abc", "12 ab 34", "0060", "--", "60"]
    assert values(spark, texts, "phone", strip=("00", "60", " ")) == ["12345", None, "12", "", "", ""]
    assert values(spark, ["0123", "00"], "phone_prefix", prefix="+", strip=("0",)) == ["+123", "+0"]
    assert values(spark, ["60", ""], "phone_prefix", prefix="+", strip=("60",)) == ["", None]
