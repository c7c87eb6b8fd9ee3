"""Where rows lie in a table's files: clustering by several columns at once, and what a predicate then has to read."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a column's rank in the clustering key: 2**BITS - 1 cut points are known to the driver for each column.
BITS = 8


def sortable(df: DataFrame, column: str) -> Column:
    """A number in the column's order: numbers, dates and times as they are, texts by their first six bytes."""
    kind, c = df.schema[column].dataType.simpleString(), F.col(f"`{column}`")
    if kind == "string":
        return F.conv(F.rpad(F.hex(F.substring(c.cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    if kind == "date":
        return F.unix_date(c).cast("double")
    if kind.startswith("timestamp"):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    return c.cast("double")


def cut_points(df: DataFrame, columns: Sequence[str], bits: int = BITS) -> dict[str, list[float]]:
    """Values that split each column's rows into 2**bits ranges of like size; one aggregate for all columns."""
    n = 1 << bits
    shares = [k / n for k in range(1, n)]
    found = df.agg(*[F.percentile_approx(sortable(df, c), shares, 100 * n).alias(f"q{k}") for k, c in enumerate(columns)]).first()
    return {c: list(found[f"q{k}"] or []) for k, c in enumerate(columns)}


def rank(value: Column, cuts: Sequence[float], bits: int = BITS) -> Column:
    """How many cut points lie at or below a value, by bisection of a literal array; NULL ranks first."""
    if not cuts:
        return F.lit(0).cast("long")
    points = F.array(*[F.lit(float(x)) for x in cuts])
    steps = F.array(*[F.lit(1 << b).cast("long") for b in reversed(range(bits))])
    return F.when(value.isNull(), F.lit(0).cast("long")).otherwise(F.aggregate(steps, F.lit(0).cast("long"), lambda at, step: F.when(F.get(points, (at + step - 1).cast("int")) <= value, at + step).otherwise(at)))


def interleaved(ranks: Sequence[Column], bits: int = BITS) -> Column:
    """Bits of several ranks in turn, the highest first: near keys are near in every column."""
    if len(ranks) * bits > 62:
        raise ValueError(f"{len(ranks)} columns of {bits} bits do not fit into a 64-bit key")
    out = F.lit(0).cast("long")
    for k, r in enumerate(ranks):
        for b in range(bits):
            bit = F.shiftright(r, b).bitwiseAND(F.lit(1).cast("long"))
            out = out.bitwiseOR(F.shiftleft(bit, b * len(ranks) + len(ranks) - 1 - k))
    return out


def z_ordered(df: DataFrame, out: str, columns: Sequence[str], files: int, bits: int = BITS, max_rows: int = 5_000_000) -> None:
    """``df`` as about so many files, each holding a block of all ``columns`` rather than a stripe of the first.

    Columns are ranked by quantiles (one aggregate, cut points of fixed number), ranks are interleaved into one key, and
    rows are dealt over ranges of that key, so files stay even where values are skewed."""
    cuts = cut_points(df, columns, bits)
    ranked = df.withColumns({f"_rank{k}": rank(sortable(df, c), cuts[c], bits) for k, c in enumerate(columns)})
    keyed = ranked.withColumn("_z", interleaved([F.col(f"_rank{k}") for k in range(len(columns))], bits))
    # rows of one key may be many: the columns themselves break ties, so that a range can be cut inside a key
    order = ["_z", *[F.col(f"`{c}`") for c in columns]]
    spread = keyed.repartitionByRange(files, *order).sortWithinPartitions(*order)
    spread.select(*[F.col(f"`{c}`") for c in df.columns]).write.mode("overwrite").option("maxRecordsPerFile", max_rows).parquet(out)


def file_ranges(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """(file, row_count, low_<column>, high_<column>): least and greatest value of each file."""
    df = spark.read.parquet(path)
    cells = [f(F.col(f"`{c}`")).alias(f"{n}_{c}") for c in columns for n, f in (("low", F.min), ("high", F.max))]
    return df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("row_count"), *cells)


def files_touched(ranges: DataFrame, wanted: Mapping[str, tuple[object, object]]) -> DataFrame:
    """One row: the files, and of each range in ``wanted`` (column -> low, high) how many files may hold a row of it."""
    test = lambda c, low, high: (F.col(f"low_{c}") <= F.lit(high)) & (F.col(f"high_{c}") >= F.lit(low))
    return ranges.agg(F.count("*").alias("files"), *[F.count_if(test(c, low, high)).alias(f"touched_{c}") for c, (low, high) in wanted.items()])
