"""Profiles, drift, outliers and fitness reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if f.dataType.simpleString() in _NUMERIC or f.dataType.simpleString().startswith("decimal")]


def profile(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = True) -> DataFrame:
    """(column_name, row_count, nulls, distinct, min, max, mean): one aggregate for all columns. Exact distinct counts come
    from a second one over (column, hash of the value) pairs, which combine before their shuffle."""
    columns, numbers = list(columns or df.columns), set(numeric_columns(df))
    cells = []
    for k, c in enumerate(columns):
        x = F.col(c)
        cells += [F.count_if(x.isNull()).alias(f"nulls{k}"), (F.approx_count_distinct(x) if approximate else F.lit(0).cast("long")).alias(f"distinct{k}"), F.min(x).cast("string").alias(f"min{k}"), F.max(x).cast("string").alias(f"max{k}"), (F.avg(x) if c in numbers else F.lit(None).cast("double")).alias(f"mean{k}")]
    one = df.agg(F.count("*").alias("row_count"), *cells)
    rows = [F.struct(F.lit(c).alias("column_name"), *[F.col(f"{n}{k}").alias(n) for n in ("nulls", "distinct", "min", "max", "mean")]) for k, c in enumerate(columns)]
    out = one.select("row_count", F.explode(F.array(*rows)).alias("r")).select("r.column_name", "row_count", "r.nulls", "r.distinct", "r.min", "r.max", "r.mean")
    if approximate:
        return out
    text = lambda c: F.col(c).cast("string")
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.when(F.col(c).isNotNull(), F.xxhash64(text(c))).alias("a"), F.xxhash64(F.lit(17), text(c)).alias("b")) for k, c in enumerate(columns)]))
    values = df.select(pairs.alias("p")).select("p.*").where("a is not null").groupBy("k", "a", "b").agg(F.lit(1).alias("_one")).groupBy("k").agg(F.count("*").alias("_distinct"))
    names = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("k") + 1)
    return out.join(F.broadcast(values.select(names.alias("column_name"), "_distinct")), "column_name", "left").withColumn("distinct", F.coalesce("_distinct", F.lit(0))).drop("_distinct")  # a row a column


def statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, n, mean, stddev, min, max, q1, median, q3) of numeric columns in one pass."""
    cells = []
    for k, c in enumerate(columns):
        x = F.col(c).cast("double")
        cells += [F.count(x).alias(f"n{k}"), F.avg(x).alias(f"mean{k}"), F.stddev(x).alias(f"stddev{k}"), F.min(x).alias(f"min{k}"), F.max(x).alias(f"max{k}"), F.percentile_approx(x, [0.25, 0.5, 0.75], 10000).alias(f"q{k}")]
    one = df.agg(*cells)
    rows = [F.struct(F.lit(c).alias("column_name"), *[F.col(f"{n}{k}").alias(n) for n in ("n", "mean", "stddev", "min", "max")], *[F.col(f"q{k}")[i].alias(q) for i, q in enumerate(("q1", "median", "q3"))]) for k, c in enumerate(columns)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, corr) of each pair, in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[F.corr(a, b).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("corr")) for k, (a, b) in enumerate(pairs)])).alias("p")).select("p.*")


def top_values(df: DataFrame, columns: Sequence[str], n: int = 5) -> DataFrame:
    """(column_name, value, count): the n commonest values of each column, from one stacked grouping."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns]))
    counts = df.select(pairs.alias("p")).groupBy("p.column_name", "p.value").agg(F.count("*").alias("count"))
    w = Window.partitionBy("column_name").orderBy(F.desc("count"), F.col("value").asc_nulls_last())
    return counts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


#: Bins of a pass of ``quantiles``, and rows so few that their values are read at once.
BINS, FEW = 1024, 10_000


def quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float | None]:
    """Exact quantiles, linear between neighbours; None without values. NULL, NaN and infinite values do not count.

    Ranks are narrowed by histograms: a pass counts the rows of BINS equal bins between two
    values, the next one looks into the bin that holds the rank. So no task, nor the driver,
    holds the distinct values of the column; a pass gives BINS rows.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where((F.col("v") > float("-inf")) & (F.col("v") < float("inf")))
    whole = values.agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()
    passes: dict[tuple[float, float], list] = {}

    def inside(low: float, high: float, n: int) -> list:
        """(rows, least, greatest) of each bin in order; of each value where there are few."""
        if (low, high) not in passes:
            part, half = values.where(F.col("v").between(low, high)), (high / 2 - low / 2) / BINS
            if n <= FEW:
                passes[low, high] = [(1, r["v"], r["v"]) for r in part.orderBy("v").collect()]
            else:
                bin_ = F.least(F.floor((F.col("v") / 2 - low / 2) / half), F.lit(BINS - 1)) if half else F.col("v")
                found = part.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
                passes[low, high] = [(r["n"], r["low"], r["high"]) for r in found.orderBy("low").collect()]
        return passes[low, high]

    def at(rank: int) -> float:
        n, low, high, before = whole["n"], whole["low"], whole["high"], 0
        while low != high:
            for n, low, high in inside(low, high, n):
                if before + n > rank:
                    break
                before += n
        return low

    def one(share: float) -> float | None:
        if not whole["n"]:
            return None
        place = share * (whole["n"] - 1)
        low, high = at(int(place)), at(min(int(place) + 1, whole["n"] - 1))
        return low + (place - int(place)) * (high - low)

    return [one(share) for share in shares]


def outliers(df: DataFrame, column: str, method: str = "iqr", width: float = 1.5) -> DataFrame:
    """``df`` with is_outlier by exact quartiles' distance (known before the plan) or by z-score (bounds join in as one row)."""
    x = F.col(column).cast("double")
    if method == "iqr":
        a, b = quantiles(df, column, [0.25, 0.75])
        far = (x < a - width * (b - a)) | (x > b + width * (b - a)) if a is not None else F.lit(False)
        return df.withColumn("is_outlier", F.coalesce(far, F.lit(False)))
    bounds = df.agg(F.avg(x).alias("m"), F.stddev(x).alias("s")).select((F.col("m") - width * F.col("s")).alias("_low"), (F.col("m") + width * F.col("s")).alias("_high"))
    return df.join(F.broadcast(bounds)).withColumn("is_outlier", F.coalesce((x < F.col("_low")) | (x > F.col("_high")), F.lit(False))).drop("_low", "_high")


def drift(baseline: DataFrame, current: DataFrame, null_delta: float = 0.05, distinct_delta: float = 0.2, mean_delta: float = 0.2) -> DataFrame:
    """Columns whose profile moved: NULL share by points, distinct count and mean relatively."""
    a = baseline.select("column_name", F.try_divide("nulls", "row_count").alias("n0"), F.col("distinct").alias("d0"), F.col("mean").alias("m0"))
    b = current.select("column_name", F.try_divide("nulls", "row_count").alias("n1"), F.col("distinct").alias("d1"), F.col("mean").alias("m1"))
    rel = lambda x, y: F.coalesce(F.abs(F.try_divide(F.col(y) - F.col(x), F.abs(F.col(x)))), F.lit(0.0))
    out = a.join(b, "column_name", "full_outer").withColumns({"null_change": F.coalesce(F.col("n1") - F.col("n0"), F.lit(0.0)), "distinct_change": rel("d0", "d1"), "mean_change": rel("m0", "m1")})
    moved = (F.abs("null_change") > null_delta) | (F.col("distinct_change") > distinct_delta) | (F.col("mean_change") > mean_delta) | F.col("d0").isNull() | F.col("d1").isNull()
    return out.select("column_name", "null_change", "distinct_change", "mean_change", moved.alias("drifted"))


def skew(df: DataFrame, key: str, limit: float = 10.0) -> DataFrame:
    """One row: keys, most and mean rows of a key, their ratio, and whether it is above the limit."""
    per = df.groupBy(key).count()
    out = per.agg(F.count("*").alias("keys"), F.max("count").alias("most"), F.avg("count").alias("mean"))
    return out.withColumn("ratio", F.try_divide("most", "mean")).withColumn("skewed", F.coalesce(F.col("ratio") > limit, F.lit(False)))


def quality_score(df: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row: completeness, uniqueness of the key, and their weighted score."""
    whole = df.agg(F.count("*").alias("n"), sum((F.count(c) for c in columns[1:]), F.count(columns[0])).alias("present"))
    unique = df.groupBy(*key).count().agg(F.count("*").alias("u"))
    out = whole.join(F.broadcast(unique)).select("n", F.coalesce(F.try_divide("present", F.col("n") * len(columns)), F.lit(1.0)).alias("completeness"), F.coalesce(F.try_divide("u", "n"), F.lit(1.0)).alias("uniqueness"))
    return out.withColumn("score", F.round(0.6 * F.col("completeness") + 0.4 * F.col("uniqueness"), 6))


def stream_fitness(df: DataFrame, key: str, ts: str, kind: str, session: str, late_hours: float = 1.0, gap_minutes: float = 30.0) -> DataFrame:
    """One row about an events table: kinds, sessions, long gaps, rows far behind the newest arrival, rows out of order."""
    w = Window.partitionBy(session)
    t = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    marked = df.withColumns({"_t": t, "_gap": t - F.lag(t).over(w.orderBy(ts, key)), "_before": F.lag(t).over(w.orderBy(key)), "_seen": F.max(t).over(w.orderBy(key))})
    return marked.agg(
        F.count("*").alias("events"), F.count_distinct(kind).alias("kinds"), F.count_distinct(session).alias("sessions"), F.count_if(F.col("_gap") > gap_minutes * 60).alias("long_gaps"),
        F.count_if(F.col("_t") < F.col("_seen") - late_hours * 3600).alias("late"), F.count_if(F.col("_t") < F.col("_before")).alias("out_of_order"),
    )
