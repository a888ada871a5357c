from __future__ import annotations

import re

from lineferry.llm.queries import ORACLES, QUERIES, SITE_RULES
from lineferry.llm.urls import Rule, judge, site_rule, word_rule
from tests_compare import check

RULES = [site_rule(*r) for r in SITE_RULES] + [word_rule("block", "casino"), site_rule("block", "org", "/ab"), Rule("any", r".*\d{5}", (), "block", -1)]
URLS = [
    (1, "https://WWW.Example.COM/en/x?y#z"), (2, "http://example.com/en/"), (3, "http://example.com/EN/"), (4, "http://com"), (5, "http://com/"),
    (6, "x.net/es/1"), (7, None), (8, ""), (9, "ftp://a.net/fr/1"), (10, "http://net/es/"), (11, "http://big-casino.io/p"),
    (12, "http://casinos.io/"), (13, "http://x.org/abc"), (14, "http://x.org/a/b"), (15, "http://x.io/12345"), (16, "http://notexample.com/en/"),
    (17, "a://b://c.com/d"), (18, "http://x.com?u=http://y.net/es/"), (19, "http://x.net:80/es/"), (20, "http://x\ny.net/es/\n1"), (1, "http://q.net/fr/"),
    (None, "http://q.net/fr/"),
]


def by_hand(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].lower(), m[2]) if m else ("", "")
    fits = [r for r in RULES if re.match(r.pattern, host + path)]
    best = max(fits, key=lambda r: (r.rank, r.name), default=None)
    return host, path, best and best.name, best.verdict if best else "allow"


def test_every_case_by_hand(spark):
    got = judge(spark.createDataFrame([(*u, 7) for u in URLS], "page_id bigint, url string, tried int").drop("tried"), RULES).collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [by_hand(u) for _, u in URLS]


def test_site_rules_are_hosts_and_subdomains(spark):
    for host, path, rule, verdict in map(by_hand, [u for _, u in URLS]):
        fits = [(h + p, v) for v, h, p in SITE_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        if fits:
            assert (rule, verdict) == max(fits, key=lambda x: len(x[0]))


def test_few_expressions_run(spark):
    many = [site_rule("block", f"host{i}.com", "/") for i in range(500)]
    got = judge(spark.createDataFrame([(1, "http://host7.com/a"), (2, "http://other.com/")], "page_id int, url string"), many).collect()
    assert [(r.rule, r.tried) for r in got] == [("host7.com/", 1), (None, 0)]


def test_empty(spark):
    none = spark.createDataFrame([], "page_id bigint, url string, extra string")
    assert judge(none, RULES).count() == 0 and judge(none, []).count() == 0


def test_sql(spark):
    check(spark, QUERIES, ORACLES, "op6_url_filters")
