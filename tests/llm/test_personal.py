from __future__ import annotations

import hashlib
import re

import pytest

from lineferry.llm.personal import KINDS, Bootstrap, find_personal
from lineferry.llm.queries import QUERIES

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def suits(kind, value):
    d = [int(c) for c in value if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "phone":
        return 9 <= len(d) <= 15
    if kind == "card":
        return 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0
    return True


def base(text):
    """(start, kind, end) by the contract's expressions as they stand."""
    found = [(m.start(), KINDS.index(k), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if suits(k, m.group())]
    return sorted(found)


def cards(n):
    out, i = [], 4000_0000_0000_0000
    while len(out) < n:
        out += [str(i)] if suits("card", str(i)) else []
        i += 97_003
    return out


ODD = [
    None, "", "no data", "a@b.c", "@b.c a@ .x@y.z..", "a@b.co_x@y.z.w", "a@b.c.d@e.f", "ä🎉 me@x.org ß 1.2.3.4 🎉5.6.7.8.9.10.11.12", "1.2.3.256 001.002.003.004 99999999999.1.1.1 1.1.1.1.1",
    "4111 1111 1111 1111", "4111-1111-1111-1111-2", "4111111111111112", "  41111111 11111111\n+1 (826) 555-4081", "+1 2 3 4 5 6 7 8 9.", "+12345678 +123456789012345 +1234567890123456", "+4 )))(((--- 5 +4 9",
    "1." * 2_000, "a.b@c.d " * 2_000, "12 34@x.yz 1.2.3.4@q.rs +49 1234 56789@d.ef",
]
#: Texts that hold nothing, over which the expressions as they stand would take the square of the length.
LONG = ["x" * 200_000, "1" * 200_000, "1 " * 100_000, "+1" * 50_000, "+1" + " (" * 50_000, "a@b" * 30_000, "1.a" * 50_000, "[at]" * 30_000]


def test_strict_forms_by_hand(spark):
    docs = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(ODD + LONG)] + [(None, "a@b.c", "no id")] * 2, "doc_id int, text string, BASE string")
    got = find_personal(docs)
    assert got.columns == ["doc_id", "base", "added"]
    rows = got.collect()
    assert len(rows) == len(ODD) + len(LONG) + 2
    for r in rows:
        text = "a@b.c" if r.doc_id is None else ODD[r.doc_id] if r.doc_id < len(ODD) else ""
        assert [tuple(x) for x in r.base] == base(text), r.doc_id
    assert find_personal(docs.limit(0)).count() == 0


def test_whole_table_against_the_expressions(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op12_personal"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base(texts[r.doc_id])
        said = [f"{KINDS[k]}:{s}:{e}" for s, k, e in want]
        assert [r[f"n_{k}"] for k in KINDS] == [sum(x[1] == i for x in want) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(said) <= set(spans)
        for kind, s, e in (x.split(":") for x in set(spans) - set(said)):
            assert suits(kind, texts[r.doc_id][int(s) : int(e)])
            assert not any(int(s) < b and a < int(e) for a, _, b in want)
            assert kind in ("card", "phone")


def learned(spark, texts, how=Bootstrap()):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: [(KINDS[x.kind], texts[r.doc_id][x.start : x.end]) for x in r.added] for r in find_personal(docs, how).collect()}
    return [got[i] for i in range(len(texts))]


@pytest.fixture(scope="module")
def seeded():
    seeds = [f"please mail to: user{i}@host.org today" for i in range(8)] + [f"you may call {p} at noon" for p in [f"+1 (555) 010-{1000 + i}" for i in range(8)]]
    seeds += [f"paid with {c} as agreed" for c in cards(8)] + [f"seen from 10.0.0.{i} that night" for i in range(8)]
    return seeds + [f"then {w} came 12345678 of them" for w in "abcdefgh"]


def test_contexts_find_unseen_forms(spark, seeded):
    told = ["please mail to: jane [at] new-host dot org today", "you may call (555) 010-7777 at noon", "seen from 10[.]9[.]8[.]7 that night",
            "look at some.place again", "the sum (555) 010-7777 is wrong twice", "bits 10[.]9[.]8[.]300 here"]
    got = learned(spark, [*seeded, *told])
    assert all(g == [] for g in got[: len(seeded)])
    assert got[-6:] == [[("email", "jane [at] new-host dot org")], [("phone", "(555) 010-7777")], [("ip", "10[.]9[.]8[.]7")], [], [("phone", "(555) 010-7777")], []]


def test_shapes_find_numbers_run_into_others(spark, seeded):
    got = learned(spark, [*seeded, "write +1 (555) 010-2222 10.1.1.1 now", f"x {cards(20)[9]} {cards(20)[11]} y", "x 4000000000000001 4000000000000003 y"])
    assert got[-3] == [("phone", "+1 (555) 010-2222")]
    assert got[-2] == [("card", cards(20)[9]), ("card", cards(20)[11])]
    assert got[-1] == []


def test_rounds_lend_belief(spark):
    """A pattern that no seed has is trusted once candidates of it are believed."""
    first = [f"kindly dial +1 (555) 010-{1000 + i} for help" for i in range(20)]
    both = [f"kindly dial (555) 010-{2000 + i} extension open" for i in range(20)]
    third = ["unknown (555) 010-3000 extension open"]
    assert learned(spark, first + both + third, Bootstrap(rounds=1, confidence=0.5))[-1] == []
    assert learned(spark, first + both + third, Bootstrap(rounds=3, confidence=0.5, belief=0.5))[-1] == [("phone", "(555) 010-3000")]


def test_mixed_contexts_are_not_trusted(spark, seeded):
    mixed = [f"of {x} of" for x in ["me@a.bc", "you@d.ef", "1.2.3.4", "5.6.7.8", "+1 (555) 010-5555", "+1 (555) 010-6666", *cards(30)[-3:]]] * 3
    assert learned(spark, [*seeded, *mixed, "of jane (at) host.org of", "of (555) 010-9999 of"])[-2:] == [[], []]


def test_no_python_on_any_plan(spark, monkeypatch):
    from lineferry.llm import personal

    plans = []
    write = personal.materialize
    monkeypatch.setattr(personal, "materialize", lambda df: plans.append(df._jdf.queryExecution().toString()) or write(df))
    docs = spark.createDataFrame([(1, "a@b.c"), (2, "x (at) y.z")], "doc_id int, text string")
    plans.append(find_personal(docs)._jdf.queryExecution().toString())
    assert len(plans) > 5 and not any(re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", p) for p in plans)
