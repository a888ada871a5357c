"""Session settings and shared-storage helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
import warnings
import weakref
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession

# Runtime settings the plans rely on. Skew-join splitting is forced because a lookup is usually
# followed by work on other keys, where Spark would otherwise rather keep one oversized task than
# add an exchange.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}

# A broadcast side must be proven smaller than this many bytes; anything else is left to a join
# whose strategy Spark picks from its own statistics.
BROADCAST_BYTES = 256 << 20


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, for tables written between two steps.

    It is the one that ``spark.checkpoint.dir`` names, or that the context was given. A local
    master, whose one machine reads its own files, gets a temporary one; any other must name it.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="ckpt-")
        warnings.warn(f"spark.checkpoint.dir is not set; this local session writes tables to {folder}", stacklevel=2)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir().rstrip("/")


def materialize_counted(df: DataFrame, counters: Mapping[str, Column]) -> tuple[DataFrame, dict[str, int]]:
    """:func:`materialize`, with aggregates of the rows taken while they are written.

    They come from the tasks that write, each counted once however often it was tried, so no second
    pass over the rows or the table is made for them.
    """
    seen = Observation()
    table = materialize(df.observe(seen, *[c.alias(n) for n, c in counters.items()]))
    return table, seen.get


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    What follows sees one fixed set of rows however often it reads them, survives lost executors
    without going back to the source, and reads only the columns and row groups it needs. The folder
    belongs to the cluster, which also clears it; :func:`drop` deletes a table before that.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table


#: Where written tables are, as long as their DataFrames are held.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def drop(table: DataFrame) -> None:
    """Delete a table that :func:`materialize` wrote; it cannot be read any more. Others are left alone."""
    path = _PATHS.pop(table, None)
    if path is not None:
        spark = table.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
