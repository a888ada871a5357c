"""Specs that cannot be run are refused."""

from __future__ import annotations

import datetime as dt

import pytest

from lineferry import ExtractSpec, Field, LoadSpec, Lookup
from lineferry.operators.merge import target_schema
from lineferry.spec import DELIMITED, SpecError, dated_path, lookup_order, previous_dated_path


@pytest.mark.parametrize("changes", [
    {"kind": "cobol"}, {"mode": "replace"}, {"table": " "}, {"kind": DELIMITED}, {"kind": "xml"},
    {"fields": [Field("A", 1, 2), Field("A", 3, 4)]}, {"fields": [Field(" ", 1, 2)]},
    {"fields": [Field("A", 3, 2)]}, {"fields": [Field("A", -1, 2)]}, {"fields": [Field("A", 1, 2, convert="nope")]},
    {"fields": [Field("A", 1, 2, filter_fields=("A",))]}, {"fields": [Field("A", 1, 2, filter_fields=("B",))]},
])
def test_refused(changes):
    with pytest.raises(SpecError):
        LoadSpec(**{"table": "T", "fields": [Field("A", 1, 2)], **changes})


def test_lookup_cycles_and_unknown_parameters(spark):
    dim = spark.range(1)

    def field(name, *params):
        return Field(name, lookup=Lookup(dim, {p: "id" for p in params}, "id"))

    for fields in ([field("A", "B"), field("B", "A")], [field("A", "B"), field("B", "C"), field("C", "A")], [field("A", "X")]):
        with pytest.raises(SpecError):
            LoadSpec("T", fields)
    order = lookup_order([field("C", "B"), field("B", "A"), field("A", "A")])
    assert [f.name for f in order] == ["A", "B", "C"]


def test_extract_refused():
    with pytest.raises(SpecError):
        ExtractSpec("X", [Field("A", 1)], kind="cobol")


def test_target_schema():
    spec = LoadSpec("T", [
        Field("N", 1, 8, convert="long", optional=False), Field("S", 9, 12), Field("M", 13, 20, convert="currency"),
        Field("X", 1, 2, external=True), Field("D", 1, 8, convert="date"),
    ], generated_key="ID")
    assert target_schema(spec) == "ID bigint not null, N bigint not null, S string, M decimal(15,6), D date"


def test_dated_paths():
    day = dt.date(2024, 3, 1)
    assert dated_path("/in/", "orders", day) == "/in/orders20240301"
    assert previous_dated_path("/in", "orders", day) == "/in/orders20240229"
    assert previous_dated_path("/in", "orders", day, "%Y") is None
