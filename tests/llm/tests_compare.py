"""Registered queries against their SQL."""

from compare import differences, duck


def check(spark, queries, oracles, name, sf_dir="/root/testdata/sf0.01"):
    diff, rows, _ = differences(spark, duck(sf_dir), sf_dir, queries[name], oracles[name])
    assert diff is None and rows
