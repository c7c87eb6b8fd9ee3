"""Scans: schemas are explicit, layouts may be mixed, and marks tell what was read before."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException, SparkRuntimeException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.expr import coalesced, parsed_date


def read_parquet(spark: SparkSession, path: str, schema: StructType | None = None, skip_corrupt: bool = False) -> DataFrame:
    """All parquet files under a path; where partition directories conflict, every file whatever the layout.

    ``skip_corrupt`` leaves unreadable files out; without any valid row it raises."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    every = lambda: reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").option("ignoreCorruptFiles", skip_corrupt).parquet(path)
    if skip_corrupt:
        found = every()
        if found.isEmpty():
            raise ValueError(f"no valid parquet rows under {path}")
        return found
    try:
        return reader.parquet(path)
    except (AnalysisException, SparkRuntimeException):  # conflicting partition directories
        return every()


def read_any(spark: SparkSession, path: str, schema: StructType, formats: Sequence[str] = ("parquet", "orc", "csv", "json")) -> DataFrame:
    """The first format that reads and has rows; else an empty frame of the schema."""
    for kind in formats:
        try:
            reader = spark.read.format(kind).schema(schema)
            df = (reader.option("header", True) if kind == "csv" else reader).load(path)
            if not df.isEmpty():
                return df
        except Exception as e:  # noqa: BLE001  a reader on another format's files fails in its own way; an outage is raised
            if "PATH_NOT_FOUND" in str(e):
                break
            if not any(k in str(e) for k in ("FAILED_READ_FILE", "CANNOT_READ_FILE", "UNABLE_TO_INFER_SCHEMA", "MALFORMED", "Malformed", "not a Parquet file")):
                raise
    return spark.createDataFrame([], schema)


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType, header: bool = True) -> DataFrame:
    """Delimited text; quotes inside quotes are doubled, so JSON may stand in a field. Bad fields are NULL."""
    return spark.read.schema(schema).option("header", header).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").csv(path)


def read_csv_incremental(spark: SparkSession, schema: StructType, snapshot: str, incremental: str) -> DataFrame:
    """A snapshot file and a tree of later files as one table; the tree may be absent."""
    reader = spark.read.schema(schema).option("header", True).option("ignoreMissingFiles", True)
    base = reader.csv(snapshot)
    try:
        return base.unionByName(reader.option("recursiveFileLookup", True).csv(incremental))
    except AnalysisException:
        return base


def read_json(spark: SparkSession, path: str, schema: StructType, multi_line: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


FX_COLUMNS = {"rate_date": ("date", "rate_date", "trade_date", "as_of_date"), "base_ccy": ("base_ccy", "base_currency", "base"), "quote_ccy": ("quote_ccy", "counter_ccy", "quote_currency", "ccy", "target_currency"), "rate": ("rate", "exchange_rate", "mid_rate", "rate_to_base"), "source": ("source", "provider")}


def canonical_fx(df: DataFrame) -> DataFrame:
    """Rates under canonical names from any of their synonyms; two date formats; only positive rates."""
    got = {name: coalesced(df, options, "string") for name, options in FX_COLUMNS.items()}
    out = df.select(
        F.coalesce(got["rate_date"].try_cast("date"), parsed_date(got["rate_date"].cast("string"))).alias("rate_date"), F.upper(F.trim(got["base_ccy"])).alias("base_ccy"),
        F.upper(F.trim(got["quote_ccy"])).alias("quote_ccy"), got["rate"].try_cast("double").alias("rate"), got["source"].cast("string").alias("source"),
    )
    return out.where("rate > 0")


def read_fx(spark: SparkSession, paths: Sequence[tuple[str, str]], schema: StructType) -> DataFrame:
    """The first (format, path) that has rates, in canonical form."""
    for kind, path in paths:
        df = read_any(spark, path, schema, (kind,))
        if not df.isEmpty():
            return canonical_fx(df)
    return canonical_fx(spark.createDataFrame([], schema))


def read_jdbc(spark: SparkSession, url: str, query: str, names: Mapping[str, str] | None = None, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A query pushed to a database; ``partition`` (column, low, high, number) reads in parallel. Renamed if asked."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if partition:
        column, low, high, number = partition
        reader = reader.option("dbtable", f"({query}) q").option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", number)
    else:
        reader = reader.option("query", query)
    df = reader.load()
    return df.select(*[F.col(a).alias(b) for a, b in names.items()]) if names else df


def measured_bounds(spark: SparkSession, url: str, query: str, column: str, parts: int, **options: str) -> list[int]:
    """Values of an integer key that cut a query's rows into ``parts`` of like size, measured in the database: it sorts and
    numbers the keys and returns every n-th; ``parts`` - 1 numbers at most cross the connection."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    total = reader.option("query", f"SELECT COUNT({column}) AS N FROM ({query}) q").load().first()[0]
    step = max(1, -(-total // parts))
    numbered = f"SELECT ROW_NUMBER() OVER () AS RN, {column} AS K FROM (SELECT {column} FROM ({query}) q WHERE {column} IS NOT NULL ORDER BY {column}) s"
    found = reader.option("query", f"SELECT K FROM ({numbered}) n WHERE MOD(RN, {step}) = 0 AND RN < {max(total, 1)}").load()
    return sorted({int(r[0]) for r in found.collect()})


def read_jdbc_even(spark: SparkSession, url: str, query: str, column: str, parts: int, **options: str) -> DataFrame:
    """A query read in parallel by ranges of ``column`` that hold like numbers of rows, however its values are spread;
    rows without a key are a part of their own. Each range is a predicate that the database evaluates."""
    bounds = measured_bounds(spark, url, query, column, parts, **options)
    tests = [f"{column} IS NULL"]
    for k in range(len(bounds) + 1):
        low = [f"{column} > {bounds[k - 1]}"] if k else []
        high = [f"{column} <= {bounds[k]}"] if k < len(bounds) else []
        tests.append(" AND ".join([*low, *high]) or f"{column} IS NOT NULL")
    return spark.read.jdbc(url, f"({query}) q", predicates=tests, properties=dict(options))


def with_ingestion(df: DataFrame, batch_id: str, source: str, table: str, run_date: Column, at: Column) -> DataFrame:
    """Ingestion columns; those already there stay."""
    new = {"_ingested_at": at, "_batch_id": F.lit(batch_id), "_source": F.lit(source), "_table": F.lit(table), "_run_date": run_date}
    return df.withColumns({c: v for c, v in new.items() if c not in df.columns})


def newest_value(df: DataFrame, ts: str) -> DataFrame:
    return df.agg(F.max(ts).alias("newest"))
