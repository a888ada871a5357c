"""Sources that are not line files: XML records and query results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineferry.sources.lines import XML_CORRUPT, XML_TEXT
from lineferry.sources.xmlsplit import split_records
from lineferry.spec import LoadSpec


def read_xml(spark: SparkSession, path: str, row_tag: str, tags: list[str], split: bool = False, corrupt: str | None = None) -> DataFrame:
    """One row per record element, one text column per child tag; missing and empty tags are null.

    A record that is not well-formed is a row of nulls; ``corrupt`` names a column for its text.
    Spark's XML source takes a file per task. With ``split`` records are cut from a single large file
    by many tasks (:mod:`xmlsplit`), whatever comments, CDATA and quotes hold, and parsed one by one.
    """
    if not split:
        schema, options = _columns(tags, corrupt)
        return spark.read.format("xml").option("rowTag", row_tag).options(**options).schema(schema).load(path)
    return _parsed(split_records(spark, path, row_tag), tags, corrupt)


def _columns(tags: list[str], corrupt: str | None) -> tuple[str, dict[str, str]]:
    schema = ", ".join([f"`{t}` string" for t in tags] + ([f"`{corrupt}` string"] if corrupt else []))
    return schema, {"nullValue": ""} | ({"columnNameOfCorruptRecord": corrupt} if corrupt else {})


def _parsed(records: DataFrame, tags: list[str], corrupt: str | None) -> DataFrame:
    schema, options = _columns(tags, corrupt)
    return records.select(F.from_xml("record", schema, options).alias("_r")).select("_r.*")


def read_xml_records(spark: SparkSession, path: str, spec: LoadSpec, split: bool = False) -> DataFrame:
    """XML records ready for :func:`lineferry.plans.load.route`, with the record as JSON for rejects.

    Fields name their tag; one without is not in the file. Records have no lines, so their numbers
    rise in file order with gaps. A record that is not well-formed keeps its text instead of JSON.
    """
    tags = list(dict.fromkeys(f.tag for f in spec.fields if f.tag))
    if split:
        ordered = split_records(spark, path, spec.row_tag).orderBy("file", "block", "n")
        rows = _parsed(ordered, tags, XML_CORRUPT)
    else:
        rows = read_xml(spark, path, spec.row_tag, tags, corrupt=XML_CORRUPT)
    return rows.select(
        F.coalesce(XML_CORRUPT, F.to_json(F.struct(*tags))).alias("value"), F.monotonically_increasing_id().alias("_line_no"),
        F.col(XML_CORRUPT), *[F.col(t).alias(XML_TEXT + t) for t in tags],
    )


def extract_source(spark: SparkSession, query: str) -> DataFrame:
    """Rows of a user query, its columns in upper case."""
    rows = spark.sql(query)
    return rows.toDF(*[c.upper() for c in rows.columns])


def extract_jdbc(spark: SparkSession, url: str, table: str, partition: str, lower: int, upper: int, parts: int,
                 **options: str) -> DataFrame:
    """Rows of a database table or subquery, read in ``parts`` ranges of a numeric column."""
    rows = (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=partition, lowerBound=lower, upperBound=upper,
                 numPartitions=parts, **options)
        .load()
    )
    return rows.toDF(*[c.upper() for c in rows.columns])
