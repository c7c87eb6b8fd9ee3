"""Sinks. Targets are parquet directories; upserts are computed as DataFrames and published to another path or slice."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.quality import check_evolution
from ..operators.relational import merged


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = (), baseline: StructType | None = None, keys: Sequence[str] = (), newer: str | None = None) -> None:
    """Overwrite, append, or merge by keys (into slices of ``partition_by``, or the whole table), after the schema gate."""
    faults = check_evolution(baseline, df.schema) if baseline is not None else []
    if faults:
        raise ValueError("; ".join(faults))
    if mode != "merge":
        df.write.mode(mode).partitionBy(*partition_by).parquet(path)
    elif not exists(df.sparkSession, path):
        write_table(df, path, "errorifexists", partition_by)
    elif partition_by:
        merge_slices(df, path, keys, partition_by, newer)
    else:
        staging = work_path(df.sparkSession, "merge")
        merge_table(df.sparkSession, df, path, staging, keys, newer=newer)
        df.sparkSession.read.parquet(staging).write.mode("overwrite").parquet(path)


def write_slices(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replace only the partitions that ``df`` has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def write_slice(df: DataFrame, path: str, column: str, value: object) -> None:
    """Replace exactly one partition; rows of any other are refused."""
    if not df.where(~F.col(column).eqNullSafe(F.lit(value))).isEmpty():
        raise ValueError(f"rows outside {column} = {value}")
    write_slices(df, path, [column])


def merge_table(spark: SparkSession, source: DataFrame, target: str, out: str, keys: Sequence[str], update: Sequence[str] | None = None, newer: str | None = None) -> DataFrame:
    """Upsert the table at ``target`` into ``out`` (another path: a lazy read must not be overwritten)."""
    if out == target:
        raise ValueError("write the merge to another path")
    merged(spark.read.parquet(target), source, keys, update, newer).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


@dataclass(frozen=True)
class Bounds:
    """What a load may do at most: rows to keep at least, the share of input rows to drop at most, NULL keys at most."""

    least_rows: int = 0
    most_dropped: float = 1.0
    most_null_keys: int = 0

    def faults(self, seen: Mapping[str, int]) -> list[str]:
        out = [] if seen["rows_out"] >= self.least_rows else [f"{seen['rows_out']} rows are left; at least {self.least_rows} must be"]
        dropped = seen["rows_in"] - seen["rows_out"]
        if seen["rows_in"] and dropped / seen["rows_in"] > self.most_dropped:
            out.append(f"{dropped} of {seen['rows_in']} rows were dropped; at most a share of {self.most_dropped} may be")
        if seen["null_keys"] > self.most_null_keys:
            out.append(f"{seen['null_keys']} rows have no key")
        return out


def staged_observed(source: DataFrame, transform: Callable[[DataFrame], DataFrame], keys: Sequence[str], partition_by: Sequence[str] = ()) -> tuple[str, dict[str, int]]:
    """Write ``transform(source)`` to a staging path; rows in, rows out and NULL keys are observed by the job that writes
    it, so no count reads anything again. ``transform`` must read its input once."""
    spark, before, after = source.sparkSession, Observation(), Observation()
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    staging = work_path(spark, "observed")
    counted = source.observe(before, F.count(F.lit(1)).alias("rows_in"), F.count_if(null_key).alias("null_keys"))
    out = transform(counted).observe(after, F.count(F.lit(1)).alias("rows_out"))
    out.write.partitionBy(*partition_by).parquet(staging)
    return staging, {name: int(v or 0) for name, v in (before.get | after.get).items()}


def load_observed(source: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, keys: Sequence[str], bounds: Bounds = Bounds(), mode: str = "overwrite", partition_by: Sequence[str] = ()) -> dict[str, int]:
    """Load a table through a staging path; a count out of ``bounds`` raises before the target is touched.
    Returns rows_in, rows_out and null_keys, as the writing job saw them."""
    spark = source.sparkSession
    staging, seen = staged_observed(source, transform, keys)
    faults = bounds.faults(seen)
    if faults:
        raise ValueError("; ".join(faults))
    staged = spark.read.parquet(staging)  # its own schema, so that an empty load keeps its columns
    staged.write.mode(mode).partitionBy(*partition_by).parquet(path)
    return seen


def append_checked(spark: SparkSession, df: DataFrame, path: str, keys: Sequence[str], partition_by: Sequence[str] = ()) -> int:
    """Append a batch without repeated keys. The batch is staged and counted by the job that stages it; its keys are
    checked there, and rows that the append then writes are observed, too. Returns the rows added."""
    staging, seen = staged_observed(df, lambda x: x, keys)
    staged = spark.read.schema(df.schema).parquet(staging)
    if not staged.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"keys {list(keys)} repeat in the batch")
    added = Observation()
    staged.observe(added, F.count(F.lit(1)).alias("n")).write.mode("append").partitionBy(*partition_by).parquet(path)
    if added.get["n"] != seen["rows_out"]:
        raise ValueError("rows staged and rows appended do not add up")
    return seen["rows_out"]


def touched_slices(target: DataFrame, source: DataFrame, keys: Sequence[str], partition_by: Sequence[str]) -> DataFrame:
    """Slices that an upsert changes: those the source has rows for, and those where its keys are now."""
    found = target.select(*keys, *partition_by)
    wanted = source.select(*[F.col(k).alias(f"_s_{k}") for k in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys]
    return source.select(*partition_by).union(found.join(wanted, on, "left_semi").select(*partition_by)).distinct()


def merge_slices(source: DataFrame, path: str, keys: Sequence[str], partition_by: Sequence[str], newer: str | None = None, most: int = 10_000) -> list[tuple]:
    """Upsert into a table sliced by ``partition_by``, rewriting only the slices it changes; all others keep their files.

    Keys and slices of the target are read to find them, then whole rows of those slices alone. The rewritten slices are
    staged before any is replaced. A row whose slice changes leaves its old one; a slice left without rows is removed.
    Returns the slices rewritten. More than ``most`` of them raise: then a rewrite of the whole table is due."""
    spark = source.sparkSession
    kept = spark.read.schema(StructType([f for f in spark.read.parquet(path).schema if f.name not in partition_by] + [source.schema[c] for c in partition_by])).parquet(path)
    columns = [*[c for c in kept.columns if c not in partition_by], *partition_by]
    slices = [tuple(r) for r in touched_slices(kept, source, keys, partition_by).limit(most + 1).collect()]
    if len(slices) > most:
        raise ValueError(f"more than {most} slices change; write the whole table")
    inside = F.lit(False)
    for values in slices:
        test = F.lit(True)
        for c, v in zip(partition_by, values, strict=True):
            test = test & (F.col(c).isNull() if v is None else F.col(c) == F.lit(v))
        inside = inside | test
    staging = work_path(spark, "merge-slices")
    merged(kept.where(inside).select(*columns), source, keys, newer=newer).write.partitionBy(*partition_by).parquet(staging)
    if exists(spark, staging):
        staged = spark.read.schema(kept.schema).parquet(staging)
        left = {tuple(r) for r in staged.select(*partition_by).distinct().collect()}  # at most ``most``
        write_slices(staged.select(*columns), path, partition_by)
        for values in slices:
            if values not in left:
                remove(spark, "/".join([path.rstrip("/"), *[slice_folder(spark, c, v) for c, v in zip(partition_by, values, strict=True)]]))
    return slices


def slice_folder(spark: SparkSession, column: str, value: object) -> str:
    """The name of a slice's folder, escaped as Spark's writer does."""
    catalog = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    text = "__HIVE_DEFAULT_PARTITION__" if value is None else catalog.escapePathName(str(value).lower() if isinstance(value, bool) else str(value))
    return f"{catalog.escapePathName(column)}={text}"


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def work_path(spark: SparkSession, name: str) -> str:
    """A path of this run alone in the folder that the cluster names in spark.checkpoint.dir."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/strata/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def write_run(df: DataFrame, path: str, run_id: str, partition_by: Sequence[str] = ()) -> None:
    """Idempotent load: rows carry the run's id, and a repeated run replaces its own slice."""
    write_slices(df.withColumn("_run_id", F.lit(run_id)), path, ["_run_id", *partition_by])


def staged_publish(spark: SparkSession, df: DataFrame, staging: str, publish: str, run_id: str, validate) -> DataFrame:  # noqa: ANN001
    """Stage, validate what was staged, publish."""
    write_run(df, staging, run_id)
    staged = spark.read.parquet(staging).where(F.col("_run_id") == run_id).drop("_run_id")
    validate(staged).write.mode("overwrite").parquet(publish)
    return spark.read.parquet(publish)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", batch: int = 10_000, connections: int = 8, **options: str) -> None:
    df.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", batch).option("numPartitions", connections).options(**options).mode(mode).save()


def warehouse_names(df: DataFrame) -> DataFrame:
    """Upper-case names of letters, digits and underscores."""
    return df.toDF(*[re.sub(r"[^A-Z0-9_]", "_", c.upper()) for c in df.columns])


def publish_jdbc(spark: SparkSession, df: DataFrame, url: str, table: str, keys: Sequence[str], run_id: str = "", **options: str) -> bool:
    """Upsert into a database table by keys: rows are staged in the database in parallel, then one transaction there
    deletes what they replace and inserts them. A failure on the way leaves the table as it was.

    ``run_id`` makes the load idempotent: it is recorded by the same transaction, and a run that was recorded before does
    nothing. Staged keys must not repeat nor be NULL. Returns whether the table was changed."""
    clean = warehouse_names(df)
    names, on, stage, runs = clean.columns, [k.upper() for k in keys], f"{table}_STAGE", f"{table}_RUNS"
    with transaction(spark, url, **options) as db:
        db.ensure(runs, "RUN_ID VARCHAR(200) NOT NULL PRIMARY KEY")
        db.ensure(table, None)
        if run_id and db.value(f"SELECT COUNT(*) FROM {runs} WHERE RUN_ID = ?", run_id):
            return False
    write_jdbc(clean, url, stage, "overwrite", **options)
    columns = ", ".join(f'"{c}"' for c in names)
    same = " AND ".join(f'{table}."{k}" = {stage}."{k}"' for k in on)
    with transaction(spark, url, **options) as db:
        missing = " OR ".join(f'"{k}" IS NULL' for k in on)
        if db.value(f"SELECT COUNT(*) FROM {stage} WHERE {missing}"):
            raise ValueError(f"staged rows have no {on}")
        if db.value(f"SELECT COUNT(*) FROM (SELECT 1 AS X FROM {stage} GROUP BY {', '.join(f'"{k}"' for k in on)} HAVING COUNT(*) > 1) R"):
            raise ValueError(f"keys {on} repeat in the batch")
        if run_id:
            db.run(f"INSERT INTO {runs} VALUES (?)", run_id)  # a concurrent run of the same id fails here
        db.run(f"DELETE FROM {table} WHERE EXISTS (SELECT 1 FROM {stage} WHERE {same})")
        db.run(f"INSERT INTO {table} ({columns}) SELECT {columns} FROM {stage}")
    return True


class transaction:  # noqa: N801  used as ``with transaction(...)``
    """Statements on one connection of the driver, committed together or not at all. No rows pass through it."""

    def __init__(self, spark: SparkSession, url: str, **options: str):
        jvm = spark._jvm
        if "driver" in options:
            jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(options["driver"])
        given = jvm.java.util.Properties()
        for k, v in options.items():
            given.setProperty(k, v)
        self.connection = jvm.java.sql.DriverManager.getConnection(url, given)
        self.connection.setAutoCommit(False)

    def __enter__(self) -> transaction:
        return self

    def __exit__(self, kind: type | None, *_: object) -> None:
        try:
            self.connection.commit() if kind is None else self.connection.rollback()
        finally:
            self.connection.close()

    def _prepared(self, text: str, values: Sequence[str]):  # noqa: ANN202
        statement = self.connection.prepareStatement(text)
        for k, v in enumerate(values):
            statement.setString(k + 1, v)
        return statement

    def run(self, text: str, *values: str) -> int:
        statement = self._prepared(text, values)
        try:
            return statement.executeUpdate()
        finally:
            statement.close()

    def value(self, text: str, *values: str) -> int:
        statement = self._prepared(text, values)
        try:
            found = statement.executeQuery()
            return found.getLong(1) if found.next() else 0
        finally:
            statement.close()

    def ensure(self, table: str, columns: str | None) -> None:
        """The table, created with ``columns`` where it is absent (an error where none are given)."""
        there = self.connection.getMetaData().getTables(None, None, table.upper(), None)
        absent = not there.next()
        there.close()
        if absent and columns is None:
            raise ValueError(f"the table {table} does not exist")
        if absent:
            self.run(f"CREATE TABLE {table} ({columns})")


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object a line; NULL fields stay as nulls, so that every row has every field."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def assert_written(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    if df.isEmpty():
        raise ValueError(f"{path} is empty")
    return df


def write_sample(df: DataFrame, path: str, key: str, n: int) -> None:
    """A small CSV in one file: the first rows by key."""
    df.orderBy(key).limit(n).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def compact(df: DataFrame, out: str, cluster_by: Sequence[str], files: int, max_rows: int = 5_000_000) -> None:
    """Few, clustered files: ranges of the columns, sorted within."""
    df.repartitionByRange(files, *cluster_by).sortWithinPartitions(*cluster_by).write.mode("overwrite").option("maxRecordsPerFile", max_rows).parquet(out)


def capped(df: DataFrame, files: int) -> DataFrame:
    return df.coalesce(files)


def retained(df: DataFrame, date: str, as_of: Column, days: int) -> DataFrame:
    """Rows of the last days; those without a date stay. The raw column is compared, so the scan can prune (a text in
    ISO form, whose order is that of its dates, as such)."""
    cutoff = F.date_sub(as_of, days)
    c = F.col(f"`{date}`")
    return df.where(c.isNull() | (c >= (cutoff.cast("string") if df.schema[date].dataType.simpleString() == "string" else cutoff)))


def rewrite_by_date(df: DataFrame, out: str, date: str, most_partitions: int = 1000) -> bool:
    """Cluster by date, and partition by it unless there are too many dates. Returns whether it was partitioned."""
    few = df.select(date).distinct().limit(most_partitions + 1).count() <= most_partitions
    writer = df.repartition(F.col(date)).sortWithinPartitions(date).write.mode("overwrite")
    (writer.partitionBy(date) if few else writer).parquet(out)
    return few
