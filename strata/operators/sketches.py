"""Profiles that are stored by slice and merged: statistics of any set of slices without reading their data again.

A slice's profile is one row a column: counts, sums of powers, extremes, a HyperLogLog sketch of distinct values and
a KLL sketch of quantiles. All of it is an aggregate of Spark's own, and all of it merges, so profiles are written
once by whatever loads a slice and any report, drift check or outlier bound is made from the stored rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profiling import numeric_columns

#: Size parameters: distinct counts within about 1.6 %, ranks within about 0.7 % (both for any number of rows).
HLL_BITS, KLL_K = 12, 400
_SUMS = ("row_count", "nulls", "nans", "total", "squares")


def slice_profiles(df: DataFrame, columns: Sequence[str], slice_by: Sequence[str] = ()) -> DataFrame:
    """(slice columns, column_name, data_type, row_count, nulls, nans, total, squares, low, high, text_low, text_high, hll,
    kll): one aggregate, one row for each slice and column. Texts have no sums, numeric extremes or quantiles."""
    numbers, cells = set(numeric_columns(df)), []
    for k, c in enumerate(columns):
        x, number = F.col(f"`{c}`"), c in numbers
        v = x.cast("double") if number else F.lit(None).cast("double")
        fine = F.when(~F.isnan(v), v)
        cells += [
            F.count(F.lit(1)).alias(f"row_count{k}"), F.count_if(x.isNull()).alias(f"nulls{k}"), F.count_if(F.isnan(v)).alias(f"nans{k}"), F.sum(fine).alias(f"total{k}"), F.sum(fine * fine).alias(f"squares{k}"),
            F.min(fine).alias(f"low{k}"), F.max(fine).alias(f"high{k}"), F.min(x.cast("string")).alias(f"text_low{k}"), F.max(x.cast("string")).alias(f"text_high{k}"),
            F.hll_sketch_agg(F.when(x.isNotNull(), F.xxhash64(x.cast("string"))), HLL_BITS).alias(f"hll{k}"),
            (F.kll_sketch_agg_double(fine, KLL_K) if number else F.lit(None).cast("binary")).alias(f"kll{k}"),
        ]
    one = df.groupBy(*slice_by).agg(*cells)
    names = [*_SUMS, "low", "high", "text_low", "text_high", "hll", "kll"]
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(df.schema[c].dataType.simpleString()).alias("data_type"), *[F.col(f"{n}{k}").alias(n) for n in names]) for k, c in enumerate(columns)]
    return one.select(*slice_by, F.explode(F.array(*rows)).alias("_r")).select(*slice_by, "_r.*")


def merged_slices(stored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Stored profiles of several slices as one profile a column (and value of ``by``), still mergeable."""
    return stored.groupBy(*by, "column_name", "data_type").agg(
        *[F.sum(c).alias(c) for c in _SUMS], F.min("low").alias("low"), F.max("high").alias("high"), F.min("text_low").alias("text_low"), F.max("text_high").alias("text_high"),
        F.hll_union_agg("hll").alias("hll"), F.kll_merge_agg_double("kll").alias("kll"),
    )


def _quantile(share: float) -> Column:
    # without a number there is no least one either, and an empty sketch has no quantiles
    return F.when(F.col("low").isNotNull(), F.kll_sketch_get_quantile_double("kll", F.lit(share)))


def report(profiles: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(column_name, data_type, row_count, nulls, distinct, low, high, mean, stddev, q1, median, q3) of merged profiles."""
    n = F.col("row_count") - F.col("nulls") - F.col("nans")
    mean = F.try_divide("total", n)
    spread = F.when(n > 1, F.when(F.col("low").isNotNull(), F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("squares") - F.col("total") * mean, n - 1)))))
    return profiles.select(
        *by, "column_name", "data_type", "row_count", "nulls", F.hll_sketch_estimate("hll").alias("distinct"), "low", "high", mean.alias("mean"), spread.alias("stddev"),
        *[_quantile(s).alias(q) for q, s in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))],
    )


#: Shares at which two stored distributions are compared.
COMPARED = [k / 100 for k in range(1, 100)]


def drift_of(baseline: DataFrame, current: DataFrame, null_delta: float = 0.05, distinct_delta: float = 0.2, mean_delta: float = 0.2, rank_delta: float = 0.1) -> DataFrame:
    """(column_name, null_change, distinct_change, mean_change, rank_change, drifted) of two merged profiles.

    ``rank_change`` is the largest difference between the two distributions at the current one's hundredths (as in a
    Kolmogorov-Smirnov test), so a shape that moves under an equal mean is seen, too. Columns on one side alone drift."""
    a, b = (p.select("column_name", F.struct(F.try_divide("nulls", "row_count").alias("nulls"), F.hll_sketch_estimate("hll").alias("distinct"), F.try_divide("total", F.col("row_count") - F.col("nulls") - F.col("nans")).alias("mean"), "kll", "low").alias(side)) for p, side in ((baseline, "_a"), (current, "_b")))
    met = a.join(b, "column_name", "full_outer")
    moved = lambda c: F.coalesce(F.abs(F.try_divide(F.col(f"_b.{c}") - F.col(f"_a.{c}"), F.abs(F.col(f"_a.{c}")))), F.lit(0.0))
    both = F.col("_a.low").isNotNull() & F.col("_b.low").isNotNull()
    shares = F.array(*[F.lit(x) for x in COMPARED])
    before, now = (F.kll_sketch_get_quantile_double(f"{side}.kll", shares) for side in ("_a", "_b"))
    share = lambda test: F.size(F.filter("_before", test)) / float(len(COMPARED) + 1)
    # a value's rank lies between the shares below it and up to it: ties are no difference
    gap = lambda v, k: F.greatest(F.lit(0.0), share(lambda x: x < v) - (k + 1) / float(len(COMPARED) + 1), (k + 1) / float(len(COMPARED) + 1) - share(lambda x: x <= v) - 1 / float(len(COMPARED) + 1))
    met = met.withColumns({"_before": F.when(both, before), "_now": F.when(both, now)})
    gaps = F.transform("_now", gap)
    out = met.withColumns({
        "null_change": F.coalesce(F.col("_b.nulls") - F.col("_a.nulls"), F.lit(0.0)), "distinct_change": moved("distinct"), "mean_change": moved("mean"), "rank_change": F.coalesce(F.when(both, F.array_max(gaps)), F.lit(0.0)),
    })
    drifted = (F.abs("null_change") > null_delta) | (F.col("distinct_change") > distinct_delta) | (F.col("mean_change") > mean_delta) | (F.col("rank_change") > rank_delta) | F.col("_a").isNull() | F.col("_b").isNull()
    return out.select("column_name", "null_change", "distinct_change", "mean_change", "rank_change", drifted.alias("drifted"))


def dataset_profile(df: DataFrame, columns: Sequence[str], width: float = 1.5) -> DataFrame:
    """(section, name, value) of a whole table: rows, the mix of types, completeness, and for each numeric column its
    outliers (beyond quartiles by ``width`` times their distance) and for each pair the correlation. Two passes: sketches
    and co-moments first, then outliers against the bounds they give."""
    numbers = [c for c in columns if c in set(numeric_columns(df))]
    pairs = [(a, b) for i, a in enumerate(numbers) for b in numbers[i + 1 :]]
    kinds: dict[str, int] = {}
    for c in columns:
        kind = df.schema[c].dataType.simpleString()
        kinds[kind] = kinds.get(kind, 0) + 1
    told = report(merged_slices(slice_profiles(df, columns)))
    bounds = {r["column_name"]: (r["q1"], r["q3"]) for r in told.where(F.col("q1").isNotNull()).select("column_name", "q1", "q3").collect()}  # a row a column
    far = lambda c: (F.col(f"`{c}`") < bounds[c][0] - width * (bounds[c][1] - bounds[c][0])) | (F.col(f"`{c}`") > bounds[c][1] + width * (bounds[c][1] - bounds[c][0]))
    cells = [F.struct(F.lit("rows").alias("section"), F.lit("all").alias("name"), F.count(F.lit(1)).cast("double").alias("value"))]
    cells += [F.struct(F.lit("type").alias("section"), F.lit(k).alias("name"), F.lit(float(n)).alias("value")) for k, n in sorted(kinds.items())]
    cells += [F.struct(F.lit("completeness").alias("section"), F.lit(c).alias("name"), F.coalesce(F.try_divide(F.count(F.col(f"`{c}`")), F.count(F.lit(1))), F.lit(1.0)).cast("double").alias("value")) for c in columns]
    cells += [F.struct(F.lit("outliers").alias("section"), F.lit(c).alias("name"), (F.count_if(far(c)) if c in bounds else F.lit(0)).cast("double").alias("value")) for c in numbers]
    cells += [F.struct(F.lit("correlation").alias("section"), F.lit(f"{a}~{b}").alias("name"), F.corr(F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")).alias("value")) for a, b in pairs]
    return df.agg(F.array(*cells).alias("_c")).select(F.explode("_c").alias("_r")).select("_r.*")
