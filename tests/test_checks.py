"""Totals, duplicates, reconciliation, sorting, deltas and positions against plain Python."""

from __future__ import annotations

import base64
import hashlib
import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lineferry import Field, LoadSpec, Lookup
from lineferry.operators import position
from lineferry.operators.checks import duplicate_keys, duplicate_lines, hash_total, multiply, reconcile, reconcile_summary
from lineferry.operators.delta import delta_classify, delta_lines, delta_numbered, sort_by_key, verify_sorted
from lineferry.plans.extract import take_skip

few = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def numbered(spark, texts, first=1):
    return spark.createDataFrame([(i + first, t) for i, t in enumerate(texts)], "_line_no bigint, value string")


def test_hash_total(lines):
    out = hash_total(lines("a 12", "a-05", "a  x", "a", "a   "), {"N": (2, 4)}).first()
    assert (out.records, int(out.sum_N), out.bad_N) == (5, 7, 1)


def test_hash_total_beyond_long(lines):
    out = hash_total(lines(*["9223372036854775807"] * 3), {"N": (1, 19)}).first()
    assert int(out.sum_N) == 3 * (2**63 - 1)


def test_duplicate_keys(spark, lines):
    dim = spark.range(1)
    spec = LoadSpec("T", [
        Field("A", 1, 1, key=True), Field("B", 2, 2), Field("L", 3, 3, key=True, lookup=Lookup(dim, {"L": "id", "B": "id"}, "id")),
    ], headers=("H",))
    file = lines("a1x", "Hxx", "a1y", "a1x", "b1x", "Hxx", "a1x", "a")
    assert [(r.A, r.L, r.B, r.lines, r.first_line, r.last_line) for r in duplicate_keys(file, spec).collect()] == [("a", "x", "1", 3, 1, 7)]
    assert sorted(r._line_no for r in duplicate_lines(file, spec).collect()) == [1, 4, 7]


def test_reconcile(spark, lines):
    left = lines("ab1", "AB2", "cd3", "x", "ef4")
    right = numbered(spark, ["AB1", "zz9", "ab7", "CD9", "e"])
    out = reconcile(left, right, {"K": (1, 2)}).orderBy("_line_no").collect()
    assert [(r._match, r._other_no) for r in out] == [
        ("matched", 1), ("different", 1), ("different", 4), ("too_short", None), ("not_found", None)]
    total = reconcile_summary(reconcile(left, right, {"K": (1, 2)})).first()
    assert (total.lines, total.matched, total.different, total.not_found, total.too_short, total.found) == (5, 1, 2, 1, 1, 3)
    assert [r._match for r in reconcile(left, right.limit(0), {"K": (1, 2)}).orderBy("_line_no").collect()].count("not_found") == 4


def test_sort_by_key(lines):
    file = lines("b2", "T9", "a2", "H1", "b1", "a", "a2")
    out = [r.value for r in sort_by_key(file, [(2, 2), (1, 1)], headers=("H",), trailers=("T",)).collect()]
    assert out == ["H1", "a", "b1", "a2", "a2", "b2", "T9"]
    assert [r.value for r in sort_by_key(file, [], distinct=True, skip=1).collect()] == ["H1", "T9", "a", "a2", "b1"]


@few
@given(st.lists(st.text("abc", min_size=1, max_size=2), min_size=1, max_size=30))
def test_verify_sorted(spark, texts):
    got = verify_sorted(numbered(spark, texts), [(1, 2)]).first().line_no
    keys = [t.ljust(2) for t in texts]
    assert got == next((i + 1 for i in range(1, len(keys)) if keys[i] < keys[i - 1]), None)


def test_verify_sorted_across_ranges(spark):
    """Lines in different ranges of numbers, with numbers missing in between."""
    far = position.RANGE * 3
    rows = [(1, "a"), (2, "c"), (far, "b"), (far + 1, "d")]
    df = spark.createDataFrame(rows, "_line_no bigint, value string")
    assert verify_sorted(df, [(1, 1)]).first().line_no == far
    assert verify_sorted(df.filter("_line_no <> 2"), [(1, 1)]).first().line_no is None


@few
@given(st.lists(st.sampled_from("abcde"), max_size=25), st.lists(st.sampled_from("abcdef"), max_size=25))
def test_delta(spark, today, before):
    new, old = numbered(spark, today), numbered(spark, before)
    assert Counter(r.value for r in delta_lines(new, old).collect()) == Counter(today) - Counter(before)
    left, want = Counter(before), []
    for i, t in enumerate(today):
        if left[t]:
            left[t] -= 1
        else:
            want.append((i + 1, t))
    assert sorted((r._line_no, r.value) for r in delta_numbered(new, old).collect()) == want


def test_delta_of_a_line_with_very_many_copies(spark, monkeypatch):
    monkeypatch.setattr("lineferry.operators.delta.COPIES", 100)
    today = spark.range(12345).select(F.lit("same").alias("value"))
    assert delta_lines(today, spark.range(45).select(F.lit("same").alias("value"))).count() == 12300
    assert delta_lines(today, today).count() == 0


def test_delta_classes(spark, lines):
    out = delta_classify(lines("a1", "b2", "c3", "d4"), numbered(spark, ["a1", "b1", "x4"]), [(1, 1)])
    assert {r.value: r._change for r in out.collect()} == {"b2": "changed", "c3": "new", "d4": "new"}


def test_positions_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(position, "RANGE_BITS", 3)
    rnd = random.Random(1)
    numbers = rnd.sample(range(5000), 700)
    df = spark.createDataFrame([(n, n % 3 == 0) for n in numbers], "_line_no bigint, keep boolean").repartition(5)
    want = {n: i for i, n in enumerate(sorted(n for n in numbers if n % 3 == 0))}
    got = {r._line_no: r._pos for r in position.index_by_line(df, where=F.col("keep")).collect()}
    assert got == {n: want.get(n) for n in numbers}


def test_positions_and_order_of_sparse_numbers(spark):
    rnd = random.Random(4)
    numbers = sorted({rnd.randrange(-(2**63), 2**63) for _ in range(3000)} | {rnd.randrange(2**40) for _ in range(500)} | set(range(50)))
    df = spark.createDataFrame([(n, n % 5 != 0) for n in numbers], "_line_no bigint, keep boolean").repartition(7)
    want = {n: i for i, n in enumerate(n for n in numbers if n % 5)}
    assert {r._line_no: r._pos for r in position.index_by_line(df, where=F.col("keep")).collect()} == {n: want.get(n) for n in numbers}
    tops = {n >> position.RANGE_BITS + sum(position.LEVEL_BITS) for n in numbers}
    assert len(tops) <= 128  # what one task orders
    texts = [f"{i:06d}" for i in range(len(numbers))]
    for wrong in (None, 2, 700, 2500, len(numbers) - 1):
        rows = list(zip(numbers, texts, strict=True))
        if wrong:
            rows[wrong] = (rows[wrong][0], "000000")
        lines = spark.createDataFrame(rows, "_line_no bigint, value string").repartition(5)
        assert verify_sorted(lines, [(1, 6)]).first().line_no == (numbers[wrong] if wrong else None)


def test_positions_by_any_order(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice("aab"), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, i bigint").repartition(6)
    want = {i: p for p, (_, i) in enumerate(sorted(rows, key=lambda r: (r[0], -r[1])))}
    assert {r.i: r._pos for r in position.index_by_order(df, "k", F.col("i").desc()).collect()} == want
    nth = {r.i: r._nth for r in position.index_within(df, ["k"], "i").collect()}
    seen: Counter = Counter()
    for k, i in rows:
        assert nth[i] == seen[k]
        seen[k] += 1


def test_one_hot_key_is_sorted_in_several_tasks(spark):
    """Order columns end in a distinctive one, so equal keys spread over the sort's partitions."""
    df = spark.range(40000).select(F.lit("hot").alias("k"), "id")
    placed = df.orderBy("k", "id").select(F.spark_partition_id().alias("p"), "id")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert placed.select("p").distinct().count() > 4
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


@pytest.mark.parametrize("fetch,skip", [(1, 1), (3, 2), (5, 0), (100, 1)])
def test_take_skip(spark, fetch, skip):
    df = spark.range(50).repartition(7)
    want = [i for i in range(50) if skip == 0 or i % (fetch + skip) < fetch]
    for out in (take_skip(df, "id", fetch=fetch, skip=skip), take_skip(df, fetch=fetch, skip=skip, line="id")):
        assert sorted(r.id for r in out.collect()) == want


def test_multiply(lines):
    def digest(text, width):
        return base64.b64encode(hashlib.sha1(text.encode()).digest()).decode()[:width].ljust(width, "0")

    out = multiply(lines("Hdr", "ab12xy", "c"), (1, 2), 2, key=(3, 4), marks=("H",)).orderBy("_line_no", "_copy").collect()
    assert [r.value for r in out] == ["Hdr"] + [
        digest(f"{a}_{i}", 2) + digest(f"{b}_{i}", 2) + rest for a, b, rest in (("ab", "12", "xy"), ("c ", "  ", "")) for i in (1, 2)]
    wide = multiply(lines("a" * 40), (1, 40), 1).first().value
    assert wide == digest("a" * 40 + "_1", 40)
