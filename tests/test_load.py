"""Routing, lookups and merges on small files with known outcomes."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lineferry import Field, GlobalFilter, InsertRule, LoadSpec, Lookup, load, load_summary, loaded, rejects, route, route_with_inserts, session
from lineferry.operators import merge as mg
from lineferry.operators.lookup import lookup, lookup_or_insert
from lineferry.operators.stage import stage_lines, staged_load, staged_merge, staged_rows, staged_unloaded
from lineferry.plans.load import write_rejects
from lineferry.spec import DELIMITED, INSERT, UPDATE, SpecError


def csv(*fields, **kw):
    return LoadSpec("T", fields, kind=DELIMITED, delimiter=",", **kw)


def statuses(df):
    return [(r._status, r._reason) for r in df.orderBy("_line_no").collect()]


@pytest.fixture
def dim(spark):
    return spark.createDataFrame(
        [(1, "one"), (2, "two"), (3, "three"), (3, "drei"), (4, None), (None, "null")], "id bigint, name string"
    )


def test_first_failing_check_names_the_status(spark, lines, dim):
    flags = spark.createDataFrame([(9, True), (1, False)], "k bigint, bad boolean")
    spec = csv(
        Field("A", 1, filter_values=("x", "NULL")), Field("N", 2, convert="long"),
        Field("L", 3, lookup=Lookup(dim, {"L": "id"}, "name")), Field("R", 4, optional=False),
        headers=("H",), trailers=("END",), filters=(GlobalFilter("g", flags, {"N": "k"}, "bad"),),
    )
    out = route(lines(
        "H,bad", "y,bad,7", "x,bad,7", "x,9,7", "x,1,7,r", "x,1,3,r", "x,1,1", "X ,1,1,r", ",1,4,r", "x,,,r", "END",
    ), spec)
    assert [s for s, _ in statuses(out)] == [
        "header_trailer", "filtered", "unknown", "filtered", "integrity", "parse", "parse", "ok", "integrity", "integrity",
        "header_trailer"]
    assert statuses(out)[5][1] == "L: lookup is ambiguous"
    total = load_summary(out).first().asDict()
    assert total == {
        "all_lines": 11, "header_trailer": 2, "parse": 2, "filtered": 2, "integrity": 3, "unknown": 1, "too_long": 0,
        "commit_failed": 0, "ineligible": 4, "eligible": 7, "loaded": 1}
    assert total["all_lines"] == total["ineligible"] + total["parse"] + total["integrity"] + total["unknown"] + total["loaded"]
    assert loaded(out, spec).count() == 1
    assert rejects(out).count() == 8 and rejects(out, with_filtered=False).count() == 6


def test_reject_files(spark, lines, tmp_path):
    out = route(lines("1", "x"), csv(Field("A", 1, convert="long")))
    write_rejects(out, str(tmp_path / "bad"))
    rows = spark.read.json(str(tmp_path / "bad")).collect()
    assert [(r._line_no, r.value, r._status) for r in rows] == [(2, "x", "unknown")]


def test_cross_field_filter(lines):
    a = Field("A", 1, convert="long", filter_fields=("B", "C"), filter_values=("5",))
    out = route(lines("1,1,x", "01,1,x", "1,2,x", "5,2,x", ",,x", "1,2,1"), csv(a, Field("B", 2, convert="long"), Field("C", 3)))
    # A text never equals a number, and two missing values are equal.
    assert [s for s, _ in statuses(out)] == ["ok", "ok", "filtered", "ok", "ok", "filtered"]


def test_value_filter_tokens_decide_at_once(lines):
    out = route(lines("a", "b", "-", ""), csv(Field("A", 1, filter_values=("b", "NOT_NULL", "-"), nulls=("-",))))
    assert [s for s, _ in statuses(out)] == ["ok", "ok", "filtered", "filtered"]


def test_lookup_null_semantics(spark, dim):
    rows = spark.createDataFrame([(1,), (4,), (None,), (8,)], "k bigint")
    per_row = {r.k: (r.v, r._status) for r in lookup(rows, Lookup(dim, {"k": "id"}, "name"), "v").collect()}
    assert per_row == {1: ("one", "ok"), 4: (None, "integrity"), None: (None, "integrity"), 8: (None, "integrity")}
    cached = Lookup(dim.withColumn("o", F.monotonically_increasing_id()), {"k": "id"}, "name", full_cache=True, order="o")
    full = {r.k: (r.v, r._status) for r in lookup(rows, cached, "v").collect()}
    # A full cache finds null under null, and remembers a null value.
    assert full == {1: ("one", "ok"), 4: (None, "ok"), None: ("null", "ok"), 8: (None, "integrity")}


def test_full_cache_last_row_wins(spark):
    dim = spark.createDataFrame([(1, "a", 1), (1, "b", 3), (1, "c", 2)], "id int, v string, o int")
    rows = spark.createDataFrame([("1",)], "k string")
    assert lookup(rows, Lookup(dim, {"k": "id"}, "v", full_cache=True, order="o"), "out").first().out == "b"


def test_lookup_text_that_is_no_number_misses(lines, dim):
    out = route(lines("x", "007", "1"), csv(Field("L", 1, lookup=Lookup(dim, {"L": "id"}, "name"))))
    assert [s for s, _ in statuses(out)] == ["integrity", "integrity", "ok"]


def test_lookup_default_and_code_name(lines, dim):
    out = route(lines("", "2"), csv(Field("L", 1, default="1", lookup=Lookup(dim, {"VALUE": "id"}, "name"))))
    assert [r.L for r in out.orderBy("_line_no").collect()] == ["one", "two"]


def test_hot_and_missing_keys_keep_every_row(spark):
    """A third of the rows on one key, a third without any: nothing is lost or doubled, joined with
    a shuffle."""
    rows = spark.range(30000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 3 == 1, F.col("id")).alias("k")
    )
    dim = spark.range(30000).select(F.col("id").alias("d"), (F.col("id") * 2).alias("v"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = lookup(rows, Lookup(dim, {"k": "d"}, "v", unique=True), "v").agg(
            F.count("*").alias("n"), F.countDistinct("id").alias("d"), F.count_if(F.expr("v = k * 2")).alias("hit"),
            F.count_if(F.expr("_status = 'integrity'")).alias("miss")).first()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert (out.n, out.d, out.hit, out.miss) == (30000, 30000, 20000, 10000)


def test_lookup_or_insert(spark):
    dim = spark.createDataFrame([(10, "a", "old"), (12, "b", "old")], "id bigint, code string, kind string")
    rows = spark.createDataFrame([(5, "z"), (2, "y"), (3, "z"), (4, "a"), (1, ""), (6, None)], "_line_no bigint, code string")
    lk = Lookup(dim, {"code": "code"}, "id", insert=InsertRule("id", {"kind": "new"}))
    out, new = lookup_or_insert(rows, lk, "fk")
    assert sorted((r.id, r.code, r.kind) for r in new.collect()) == [(13, "y", "new"), (14, "z", "new")]
    assert {r._line_no: r.fk for r in out.collect()} == {1: None, 2: 13, 3: 14, 4: 10, 5: 14, 6: None}


def test_inserts_into_an_empty_dimension_only_from_good_lines(spark, lines):
    dim = spark.createDataFrame([], "id bigint, code string")
    spec = csv(Field("A", 1, filter_values=("x",)), Field("C", 2, lookup=Lookup(dim, {"C": "code"}, "id", insert=InsertRule("id"))))
    routed, new = route_with_inserts(lines("x,p", "y,q", "x,r", "x,p"), spec)
    assert sorted((r.id, r.code) for r in new["C"].collect()) == [(1, "p"), (2, "r")]
    assert [(r.C, r._status) for r in routed.orderBy("_line_no").collect()] == [
        (1, "ok"), (None, "filtered"), (2, "ok"), (1, "ok")]


def test_running_number_counts_good_lines(lines):
    spec = csv(Field("A", 1, convert="long"), Field("N", convert="running_number"))
    assert [r.N for r in route(lines("1", "x", "2", "3"), spec).orderBy("_line_no").collect()] == [1, None, 2, 3]


@pytest.fixture
def target(spark):
    return spark.createDataFrame([(1, "a", 10), (2, "b", 20), (None, "n", 30)], "k bigint, s string, other int")


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(
        [(1, 1, "x"), (2, 3, "y"), (3, 3, "z"), (4, None, "p"), (5, None, "q"), (6, 1, None)], "_line_no bigint, k bigint, s string")


def triples(df):
    return sorted(((r.k, r.s, r.other) for r in df.collect()), key=str)


def test_mixed_merge(target, rows):
    out = mg.upsert_rows(target, rows, ["k"], ["k", "s"])
    # Line 6 clears what line 1 set; null keys never match, each is a row of its own.
    assert triples(out) == sorted([(1, None, 10), (2, "b", 20), (None, "n", 30), (3, "z", None), (None, "p", None), (None, "q", None)], key=str)
    plan = {r._line_no: r._action for r in mg.merge_plan(rows, target, ["k"]).collect()}
    assert plan == {1: "update", 2: "insert", 3: "update", 4: "insert", 5: "insert", 6: "update"}
    counts = mg.merge_counts(mg.merge_plan(rows, target, ["k"])).first()
    assert (counts.inserted, counts.updated) == (3, 3)


def test_presence(target, rows):
    assert {r._line_no: r._action for r in mg.target_presence(rows, target, ["k"]).collect()} == {
        1: "update", 2: "insert", 3: "insert", 4: "insert", 5: "insert", 6: "update"}
    cached = {r._line_no: r._action for r in mg.target_presence(rows, target, ["k"], null_safe=True).collect()}
    assert cached[4] == cached[5] == "update"


def test_update_and_insert_modes(target, rows):
    assert triples(mg.update_rows(target, rows, ["k"], ["k", "s"])) == sorted([(1, None, 10), (2, "b", 20), (None, "n", 30)], key=str)
    assert mg.insert_rows(target, rows, ["k", "s"]).count() == 9
    spec = csv(Field("k", 1, key=True, convert="long"), Field("s", 2), mode=UPDATE)
    assert mg.merge(target, rows, spec).count() == 3
    assert mg.merge(target, rows, csv(Field("k", 1, key=True), Field("s", 2), mode=INSERT)).count() == 9


def test_generated_keys(spark, rows):
    target = spark.createDataFrame([(100, 1, "a"), (7, 2, "b")], "ID bigint, k bigint, s string")
    spec = csv(Field("k", 1, key=True, convert="long"), Field("s", 2), generated_key="ID")
    out = {(r.ID, r.k, r.s) for r in mg.merge(target, rows, spec).collect()}
    assert out == {(100, 1, None), (7, 2, "b"), (101, 3, "z"), (102, None, "p"), (103, None, "q")}


def test_merge_against_a_replay(spark):
    """Random files with repeated keys against applying the lines one by one."""
    rnd = random.Random(5)
    for _ in range(3):
        old = {k: f"t{k}" for k in rnd.sample(range(30), 12)}
        data = [(i + 1, rnd.randrange(30), rnd.choice([None, "a", "b", f"v{i}"])) for i in range(60)]
        want = dict(old)
        for _, k, v in data:
            want[k] = v
        target = spark.createDataFrame(list(old.items()), "k bigint, s string")
        got = mg.upsert_rows(target, spark.createDataFrame(data, "_line_no bigint, k bigint, s string"), ["k"], ["k", "s"])
        assert {r.k: r.s for r in got.collect()} == want and got.count() == len(want)


def test_refresh(target):
    assert mg.refresh_delete(target).count() == 0
    assert triples(mg.refresh_delete(target, F.col("k") > 1)) == sorted([(1, "a", 10), (None, "n", 30)], key=str)
    assert triples(mg.refresh_update(target, {"s": F.lit("!")}, F.col("k") > 1)) == sorted(
        [(1, "a", 10), (2, "!", 20), (None, "n", 30)], key=str)


def test_post_actions(spark, target, rows):
    plan = mg.merge_plan(rows, target, ["k"])
    side = spark.createDataFrame([(1, "-"), (3, "-")], "k bigint, note string")
    grown = mg.post_insert_rows(side, plan, mg.INSERTED, {"k": F.col("k"), "note": F.col("s")})
    assert sorted(((r.k, r.note) for r in grown.collect()), key=str) == sorted(
        [(1, "-"), (3, "-"), (3, "y"), (None, "p"), (None, "q")], key=str)
    noted = mg.post_update_rows(side, plan, mg.UPDATED, {"k": "k"}, {"note": F.coalesce("s", F.lit("cleared"))})
    assert {r.k: r.note for r in noted.collect()} == {1: "cleared", 3: "z"}


def test_whole_load(spark, lines, target):
    spec = csv(Field("k", 1, key=True, convert="long"), Field("s", 2), Field("x", 3, external=True))
    done = load(lines("1,new,e", "bad,q", "5,five"), spec, target)
    assert triples(done.target) == sorted([(1, "new", 10), (2, "b", 20), (None, "n", 30), (5, "five", None)], key=str)
    assert done.summary.first().unknown == 1 and done.rejects.count() == 1
    assert {r._line_no: r._action for r in done.plan.collect()} == {1: "update", 3: "insert"}


def test_staging(spark, lines, dim):
    lk = Lookup(dim, {"L": "id"}, "name", unique=True, deferred=True)
    spec = LoadSpec("T", [
        Field("K", 1, 3, key=True, convert="integer"), Field("L", 4, 5, lookup=lk, optional=False),
        Field("M", 6, 10, convert="currency"), Field("B", 11, 11, convert="yn_boolean"),
        Field("D", 12, 19, convert="timestamp"),
    ])
    rows = loaded(route(lines("001 1 1250Y20240229", "x", "002 8   5-N00000000", "003 2     N20240101"), spec, defer=True), spec)
    text = [r.value for r in stage_lines(rows, spec).orderBy("_line_no").collect()]
    assert text[0] == "00000000000001" "N00000000000001" "N1 " "N  12.5" "N1" "N2024-02-29-00.00.00.000000"
    assert text[1] == "00000000000003" "N00000000000002" "N8 " "N  -.05" "N0" "Y" + " " * 26
    assert text[2] == "00000000000004" "N00000000000003" "N2 " "Y      " "N0" "N2024-01-01-00.00.00.000000"
    target = spark.createDataFrame([(1,)], "K int")
    merged = {r.K: (r.L, r._loaded) for r in staged_merge(rows, target, spec).collect()}
    assert merged == {1: ("one", "U"), 2: (None, "N"), 3: ("two", "I")}
    assert [r._line_no for r in staged_unloaded(rows, spec).collect()] == [3]
    done = staged_load(rows, target, spec)
    assert sorted(map(tuple, done.report.collect())) == sorted(map(tuple, staged_merge(rows, target, spec).collect()))
    assert [r._line_no for r in done.unloaded.collect()] == [3]
    # Both come from the written table: no lookup is made again.
    assert all("Join" not in x._jdf.queryExecution().executedPlan().toString() for x in (done.report, done.unloaded))
    done.drop()


def test_staging_cuts_nothing(spark):
    spec = LoadSpec("T", [Field("K", 1, 3, key=True, convert="integer"), Field("S", 4, 6), Field("M", 7, 9, convert="currency"), Field("C", default="HOST", size=4)])
    rows = spark.createDataFrame([(1, 1, "abc", 9.99, "HOST"), (2, 2, "abcd", 1.0, "HOST"), (3, 3, "a", 1234.5, "HOST")], "_line_no bigint, K int, S string, M double, C string")
    rows = rows.withColumn("M", rows["M"].cast("decimal(38,2)"))
    out = {r._line_no: (r.value, r._status, r._reason) for r in staged_rows(rows, spec).collect()}
    assert out[1] == ("00000000000001" "N00000000000001" "Nabc" "N9.99" "NHOST", "ok", None)
    assert out[2] == (None, "unknown", "S: does not fit") and out[3] == (None, "unknown", "M: does not fit")
    assert [r._line_no for r in stage_lines(rows, spec).collect()] == [1]
    with pytest.raises(SpecError):
        stage_lines(rows, LoadSpec("T", [Field("K", 1, 3, key=True, convert="integer"), Field("C", default="HOST")])).count()


def test_filtered_lines_make_no_dimension_rows(spark, lines):
    dim = spark.createDataFrame([(1, "a", "b")], "id int, code string, kind string")
    lk = Lookup(dim, {"C": "code", "D": "kind"}, "id", insert=InsertRule("id"))
    spec = csv(Field("A", 1, filter_fields=("B",)), Field("B", 2), Field("C", 3, lookup=lk), Field("D", 4))
    routed, new = route_with_inserts(lines("x,y,q,k", "x,x,p,", "x,x,a,b", "x,x,p,"), spec)
    assert sorted((r.id, r.code, r.kind) for r in new["C"].collect()) == [(2, "p", None)]
    assert [(r.C, r._status) for r in routed.orderBy("_line_no").collect()] == [(None, "filtered"), (2, "ok"), (1, "ok"), (2, "ok")]


def test_tables_between_steps(spark, monkeypatch):
    table = session.materialize(spark.range(3))
    assert table.count() == 3
    session.drop(table)
    with pytest.raises(Exception, match="(?i)not exist|not found"):
        table.count()
    session.drop(table)
    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda self: None)
    monkeypatch.setattr(spark.sparkContext, "master", "yarn")
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.shared_folder(spark)
