"""Run registered queries against their SQL and compare the rows, columns sorted by name."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from decimal import Decimal

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, Decimal):
        return format(v, "f")
    if isinstance(v, dt.datetime):
        return v.isoformat(sep=" ")
    return str(v)


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cols = [names[i] for i in order]
    data = sorted(([plain(r[i]) for i in order] for r in rows), key=lambda r: [("", "") if x is None else ("1", x) for x in r])
    return cols, data


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def differences(spark, con, sf_dir, fn, sql):
    df = fn(spark, sf_dir)
    cols, got = normal(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None, len(got), cols
    res = con.execute(sql)
    want_cols, want = normal([d[0] for d in res.description], res.fetchall())
    if cols != want_cols:
        return f"columns {cols} != {want_cols}", len(got), cols
    if len(got) != len(want):
        extra = [r for r in got if r not in want][:2] if len(got) < 20000 else ""
        return f"rows {len(got)} != {len(want)}; e.g. {extra}", len(got), cols
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} rows differ, e.g. got {bad[0][0]} want {bad[0][1]}", len(got), cols
    return None, len(got), cols


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry

    sf_dir = "/root/testdata/" + sys.argv[1]
    only = sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if only and not any(o in name for o in only):
            continue
        t = time.time()
        try:
            problem, n, _ = differences(spark, con, sf_dir, fn, oracles.get(name))
        except Exception as e:  # noqa: BLE001
            problem, n = f"{type(e).__name__}: {str(e)[:700]}", -1
        bad += problem is not None
        mark = "FAIL" if problem else ("ok  " if name in oracles else "rows")
        print(f"{mark} {name:28s} {n:8d} rows {time.time() - t:6.2f}s {problem or ''}", flush=True)
    print("failures:", bad)
