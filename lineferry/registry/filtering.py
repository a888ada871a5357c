"""Queries over filters and required fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineferry.plans.extract import render_rows
from lineferry.plans.load import route
from lineferry.registry import fixtures as fx
from lineferry.registry.base import query, table
from lineferry.registry.conversions import delimited
from lineferry.spec import ExtractSpec, Field, GlobalFilter, Lookup


def judged(lines: DataFrame, spec) -> DataFrame:
    return route(lines, spec).select("_line_no", "_status", "_reason")


@query("filter_value", f"""
WITH {fx.ORDER_SQL}
SELECT _line_no, CASE WHEN o_orderstatus IN ('F', 'O') THEN 'ok' ELSE 'filtered' END AS _status,
  CASE WHEN o_orderstatus IN ('F', 'O') THEN NULL ELSE 'STATUS: value filter' END AS _reason FROM texts""")
def filter_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = fx.order_spec(fx.ORDER_DATE, Field("STATUS", 19, 19, filter_values=("f", "O")))
    return judged(fx.order_lines(spark, sf_dir), spec)


@query("filter_null_tokens", """
SELECT o_orderkey + 1 AS _line_no,
  CASE WHEN o_orderpriority IN ('3-MEDIUM', '5-LOW') THEN 'filtered'
       WHEN o_orderstatus IN ('F', 'P') THEN 'ok' ELSE 'filtered' END AS _status,
  CASE WHEN o_orderpriority IN ('3-MEDIUM', '5-LOW') THEN 'PRIORITY: value filter'
       WHEN o_orderstatus IN ('F', 'P') THEN NULL ELSE 'STATUS: value filter' END AS _reason FROM orders""")
def filter_null_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A present priority that is not the null mark, and a status of F or (as null mark) P."""
    spec = delimited([
        Field("PRIORITY", 6, filter_values=("NOT_NULL", "3-MEDIUM"), nulls=("5-LOW",)),
        Field("STATUS", 3, filter_values=("F", "NULL"), nulls=("P",)),
    ])
    return judged(fx.order_delimited(spark, sf_dir), spec)


@query("filter_cross_field", """
SELECT c_custkey + 1 AS _line_no,
  CASE WHEN s_suppkey IS NULL THEN 'integrity'
       WHEN c_nationkey = s_nationkey OR c_nationkey IN (3, 4, 5) THEN 'ok' ELSE 'filtered' END AS _status,
  CASE WHEN s_suppkey IS NULL THEN 'SUPPLIER: lookup value missing'
       WHEN c_nationkey = s_nationkey OR c_nationkey IN (3, 4, 5) THEN NULL
       ELSE 'NATION: matches none of SUPPLIER' END AS _reason
FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""")
def filter_cross_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of the nation of the supplier with their number, or of three nations whatever it is."""
    lines = fx.delimited_rows(table(spark, sf_dir, "customer"), "|", "c_custkey", "c_custkey", "c_nationkey")
    nation_of = Lookup(table(spark, sf_dir, "supplier"), {"SUPPLIER": "s_suppkey"}, "s_nationkey", unique=True)
    spec = delimited([
        Field("NATION", 2, convert="integer", filter_fields=("SUPPLIER",), filter_values=("3", "4", "5")),
        Field("SUPPLIER", 1, lookup=nation_of),
    ])
    return judged(lines, spec)


@query("filter_global_lookup", f"""
WITH {fx.ORDER_SQL}
SELECT _line_no, CASE WHEN bad_id THEN 'unknown' WHEN c_acctbal < 0 THEN 'filtered' ELSE 'ok' END AS _status,
  CASE WHEN bad_id THEN 'ORDER_ID: not a valid long' WHEN c_acctbal < 0 THEN 'global filter in_debt' END AS _reason
FROM texts LEFT JOIN customer ON o_custkey = c_custkey""")
def filter_global_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of customers in debt are rejected before any lookup."""
    debt = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") < 0).alias("in_debt"))
    spec = fx.order_spec(
        fx.ORDER_ID, Field("CUST_ID", 11, 18, convert="long"),
        filters=(GlobalFilter("in_debt", debt, {"CUST_ID": "c_custkey"}, "in_debt"),),
    )
    return judged(fx.order_lines(spark, sf_dir), spec)


@query("required_fields", f"""
WITH {fx.ORDER_SQL}
SELECT _line_no, CASE WHEN date_text = '00000000' THEN 'parse' ELSE 'ok' END AS _status,
  CASE WHEN date_text = '00000000' THEN 'ORDER_DATE: required' END AS _reason FROM texts""")
def required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = Field("ORDER_DATE", 34, 41, convert="date", optional=False)
    return judged(fx.order_lines(spark, sf_dir), fx.order_spec(day))


@query("extract_filter", """
SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'P') AND o_orderpriority <> '5-LOW' THEN 'ok' ELSE 'filtered' END AS _status
FROM orders""")
def extract_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A failed token lets the next value try: P is the null mark, F is listed after the token."""
    spec = ExtractSpec("ORDERS", [
        Field("o_orderstatus", 1, 1, filter_values=("NULL", "F"), nulls=("P",)),
        Field("o_orderpriority", 2, 16, filter_values=("1-urgent", "2-high", "3-medium", "4-not specified")),
    ])
    return render_rows(table(spark, sf_dir, "orders"), spec, line="o_orderkey").select("o_orderkey", "_status")
