"""State that outlives a run: high-water marks and logs, as versions of a small table in a folder.

A version is written under a name of its own and then claimed by creating the file of its number, which only one writer
can do; readers take the highest number. So a run that fails before its claim leaves nothing visible, and of two
concurrent runs the second finds its number taken and starts again from what the first has published.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Versions:
    """The versions under ``path``. ``schema`` is that of the table; the first version follows an empty table."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def number(self) -> int:
        """The highest claimed number, 0 without any."""
        folder = self._path(f"{self.path}/claimed")
        if not self._fs.exists(folder):
            return 0
        return max((int(f.getPath().getName()) for f in self._fs.listStatus(folder) if f.getPath().getName().isdigit()), default=0)

    def read(self, number: int | None = None) -> DataFrame:
        number = self.number() if number is None else number
        if not number:
            return self.spark.createDataFrame([], self.schema)
        stream = self._fs.open(self._path(f"{self.path}/claimed/{number}"))
        try:
            name = stream.readUTF()
        finally:
            stream.close()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{name}")

    def claim(self, number: int, name: str) -> bool:
        """Whether this writer is the one to publish ``name`` as ``number``."""
        try:
            stream = self._fs.create(self._path(f"{self.path}/claimed/{number}"), False)
        except Py4JJavaError:
            if self._fs.exists(self._path(f"{self.path}/claimed/{number}")):
                return False
            raise
        try:
            stream.writeUTF(name)
        finally:
            stream.close()
        return True

    def publish(self, change: Callable[[DataFrame], DataFrame | None], attempts: int = 10) -> int:
        """Publish ``change`` of the newest version, again from a newer one where another run was faster; None changes
        nothing. Returns the number that holds the change."""
        for _ in range(attempts):
            number = self.number()
            out = change(self.read(number))
            if out is None:
                return number
            name = uuid.uuid4().hex
            out.write.parquet(f"{self.path}/data/{name}")
            if self.claim(number + 1, name):
                return number + 1
        raise RuntimeError(f"{attempts} other versions of {self.path} came first")


MARKS = "source string, mark timestamp, run_id string"


def marks(spark: SparkSession, path: str) -> Versions:
    return Versions(spark, path, MARKS)


def advance(state: Versions, seen: DataFrame, run_id: str) -> int:
    """Raise each source's mark to the newest time in ``seen`` (source, mark). No mark moves back, whatever the order in
    which runs end; a run that was recorded for all its sources changes nothing. Sources that are not in ``seen`` stay."""

    def change(now: DataFrame) -> DataFrame | None:
        new = seen.groupBy("source").agg(F.max("mark").alias("mark")).where("mark is not null").select("source", F.col("mark").cast("timestamp").alias("mark"), F.lit(run_id).alias("run_id"))
        both = now.withColumnsRenamed({"mark": "_mark", "run_id": "_run"}).join(new, "source", "full_outer")
        later = F.col("mark").isNotNull() & (F.col("_mark").isNull() | (F.col("mark") > F.col("_mark")))
        if both.where(later).isEmpty():
            return None
        return both.select("source", F.when(later, F.col("mark")).otherwise(F.col("_mark")).alias("mark"), F.when(later, F.col("run_id")).otherwise(F.col("_run")).alias("run_id"))

    return state.publish(change)


def unread(df: DataFrame, state: Versions, source: str, ts: str) -> DataFrame:
    """Rows newer than the source's mark (all without one); the mark is one value, known before the plan, so the filter
    reaches the scan."""
    found = state.read().where(F.col("source") == source).first()
    return df if found is None else df.where(F.col(ts) > F.lit(found["mark"]).cast(df.schema[ts].dataType))


def append_once(state: Versions, log: str, rows: DataFrame, run_id: str) -> bool:
    """Append ``rows`` to the log at ``log`` under ``run_id``; a repeated run finds its id recorded and appends nothing,
    a failed one left a folder that no reader takes. ``state`` holds (run_id, folder); read with ``read_log``."""
    if not state.read().where(F.col("run_id") == run_id).isEmpty():
        return False
    folder = f"{log.rstrip('/')}/{uuid.uuid4().hex}"
    rows.write.parquet(folder)
    taken = []

    def change(now: DataFrame) -> DataFrame | None:
        if not now.where(F.col("run_id") == run_id).isEmpty():
            taken.append(False)
            return None
        return now.unionByName(now.sparkSession.createDataFrame([(run_id, folder)], "run_id string, folder string")).coalesce(1)

    state.publish(change)
    return not taken


def read_log(state: Versions, schema: str) -> DataFrame:
    """All rows of a log's recorded runs, once each."""
    folders = [r["folder"] for r in state.read().collect()]  # a row a run
    if not folders:
        return state.spark.createDataFrame([], schema)
    return state.spark.read.schema(schema).parquet(*folders)
