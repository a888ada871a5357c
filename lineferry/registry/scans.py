"""Queries over the scans and sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineferry.plans.extract import take_skip
from lineferry.registry import fixtures as fx
from lineferry.registry.base import query, table
from lineferry.session import shared_folder
from lineferry.sources.lines import read_delimited, read_fixed, read_lines, split_marks, with_line_no
from lineferry.sources.records import extract_source, read_xml
from lineferry.spec import DELIMITED, Field, LoadSpec


@query("scan_fixed_width", f"""
WITH {fx.ORDER_SQL}
SELECT _line_no, id_text AS ORDER_ID, cust_text AS CUST_ID, status_text AS STATUS, amount_text AS AMOUNT,
  date_text AS ORDER_DATE, o_orderpriority AS PRIORITY, '' AS SOURCE
FROM texts""")
def scan_fixed_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_fixed(fx.order_file(spark, sf_dir), fx.order_spec())


@query("scan_delimited", """
SELECT o_orderkey + 1 AS _line_no, CAST(o_orderkey AS VARCHAR) AS ORDER_ID, o_orderstatus AS STATUS,
  CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS AMOUNT,
  CASE WHEN o_orderpriority = '3-MEDIUM' THEN NULL ELSE o_orderpriority END AS PRIORITY, '' AS SOURCE
FROM orders""")
def scan_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [Field("ORDER_ID", 1), Field("STATUS", 3), Field("AMOUNT", 4), Field("PRIORITY", 6), Field("SOURCE")]
    spec = LoadSpec("ORDERS", fields, kind=DELIMITED, delimiter="|")
    return read_delimited(fx.order_delimited(spark, sf_dir), spec)


@query("scan_xml", """
SELECT CAST(o_orderkey AS VARCHAR) AS ORDER_ID, o_orderstatus AS STATUS,
  CASE WHEN o_orderpriority = '3-MEDIUM' THEN NULL ELSE o_orderpriority END AS PRIORITY
FROM orders""")
def scan_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    record = F.concat(
        F.lit("<order note='a>b'/><order><ORDER_ID>"), F.col("o_orderkey").cast("string"), F.lit("</ORDER_ID><STATUS>"),
        F.col("o_orderstatus"), F.lit("</STATUS><PRIORITY>"),
        F.when(F.col("o_orderpriority") == "3-MEDIUM", "").otherwise(F.col("o_orderpriority")),
        F.lit("</PRIORITY></order>"),
    )
    path = f"{shared_folder(spark)}/xml-{uuid.uuid4().hex}"
    orders.select(record.alias("value")).write.text(path)
    # The self-closing record before each order is a row without an id.
    return read_xml(spark, path, "order", ["ORDER_ID", "STATUS", "PRIORITY"], split=True).where("ORDER_ID is not null")


@query("line_numbers", """
SELECT row_number() OVER (ORDER BY o_orderkey) AS _line_no, CAST(o_orderkey AS VARCHAR) AS value FROM orders""")
def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the order keys as a sorted folder of text files and number its lines."""
    path = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    orders.orderBy("o_orderkey").select(F.col("o_orderkey").cast("string").alias("value")).write.text(path)
    return with_line_no(read_lines(spark, path))


@query("header_trailer_split", f"""
WITH {fx.ORDER_FILE_SQL}
SELECT _line_no, value,
  CASE WHEN value LIKE 'HDR%' THEN 'header' WHEN value LIKE 'TRL%' THEN 'trailer' ELSE 'data' END AS _mark
FROM file""")
def header_trailer_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_marks(fx.order_file(spark, sf_dir), (fx.ORDER_HEADER,), (fx.ORDER_TRAILER,))


@query("extract_source_query", """
SELECT n_name AS NAME, count(*) AS CUSTOMERS, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS CENTS
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def extract_source_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "customer").createOrReplaceTempView("source_customer")
    table(spark, sf_dir, "nation").createOrReplaceTempView("source_nation")
    return extract_source(spark, """
        select n_name as name, count(*) as customers, sum(cast(round(c_acctbal * 100) as bigint)) as cents
        from source_customer join source_nation on c_nationkey = n_nationkey group by n_name""")


@query("take_skip_sample", """
SELECT o_orderkey, o_custkey, o_orderstatus FROM (
  SELECT *, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS p FROM orders) WHERE p % 5 < 2""")
def take_skip_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return take_skip(orders, "o_custkey", "o_orderkey", fetch=2, skip=3)


@query("take_skip_by_line", """
SELECT event_id, event_type FROM (
  SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS p FROM events) WHERE p % 7 < 4""")
def take_skip_by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return take_skip(events, fetch=4, skip=3, line="event_id")


@query("take_skip_sparse", """
SELECT event_id, event_type FROM (
  SELECT *, row_number() OVER (ORDER BY ((event_id * 2654435761) % 4294967291) * 2147483647) - 1 AS p FROM events) WHERE p % 7 < 4""")
def take_skip_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample by line numbers that are spread over all of 63 bits."""
    at = F.expr("((event_id * 2654435761) % 4294967291) * 2147483647").alias("at")
    events = table(spark, sf_dir, "events").select("event_id", "event_type", at)
    return take_skip(events, fetch=4, skip=3, line="at").drop("at")
