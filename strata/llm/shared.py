"""Shared storage for intermediate tables.

Long lineage is cut by writing a table into the folder the cluster names in
``spark.checkpoint.dir``; every executor reads it back from there, so a lost
executor costs no result. Only where that setting is absent (tests on one
machine) a folder is chosen here.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as a URI without a trailing slash."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/strata/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key that holds over one part in HOT of a table's rows is hot: there are at most HOT of them.
HOT = 1000


def join_skewed(left: DataFrame, right: DataFrame, key: str, rows: str) -> DataFrame:
    """Inner join of ``left`` with ``right``, a table of one row for each key that also says how many rows of the left
    table the key has (at least about). Hot keys, HOT rows at most, are broadcast, so that they need no task of their
    own; all others are shuffled. The column ``rows`` is dropped. ``right`` should be a written table: it is read three times."""
    total = right.agg(F.sum(rows)).first()[0] or 0
    is_hot = F.col(rows) * HOT > total
    hot, cold = right.where(is_hot).drop(rows), right.where(~is_hot).drop(rows)
    usual = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return left.join(F.broadcast(hot), key).unionByName(usual)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch at most: with texts of a few kilobytes, megabytes instead of tens of them on either side.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches held to BATCH_ROWS rows."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name, "10000")) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def give_back() -> None:
    """Return a Python worker's freed memory to the system: workers live on from task to task, beside the JVM."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass


def parts(spark: SparkSession) -> int:
    """The session's shuffle width, for explicit range partitionings."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
