"""Mixing sources to target weights by Poisson replication (DataFrame functions only).

Every source gets a mean repetition rate ``weight * total / size``. A document's
number of copies inverts the Poisson distribution of that mean at a uniform
number derived from a hash of its id and the seed, so the draw is reproducible
whatever the partitioning. Copies are exploded and the result is shuffled
globally by a second hash of (id, copy).

Means above ``PART`` are a sum of equal smaller Poisson parts, each with its own
hash, because ``exp(-mean)`` would underflow.

Skew: the sizes are a map-side aggregate, the per-source table joins by
broadcast only while its measured row count is at most ``BROADCAST_SOURCES``,
and copies of a heavily repeated document leave its row one at a time into a
range partitioning on the hash, so a source holding a third of all rows is
spread like any other.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

PART = 400.0
BROADCAST_SOURCES = 10_000
#: Target share of a source without a stated weight: its size to this power, normalised.
ALPHA = 0.5


def uniform(*values: Column) -> Column:
    """A number in [0, 1) from the first 13 hex digits (52 bits) of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *values)), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def poisson_table(mean: Column) -> Column:
    """Array of P(X <= k) for k = 0, 1, ... until the tail is below 1e-15 (the mean is at most PART)."""
    last = (mean + F.lit(10.0) * F.sqrt(mean) + F.lit(25.0)).cast("int")
    state = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k.cast("double")
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), last), state, step, lambda acc: acc["cdf"])


def source_rates(docs: DataFrame, by: str, size: Column, weights: Mapping[str, float] | None, alpha: float, total: float | None) -> DataFrame:
    """One row per source: size, target weight, mean repetition rate, the parts it is drawn in and their table."""
    # a row for each source, written once: the input is read for it a single time
    sizes = materialize(docs.groupBy(F.col(by).alias("_source")).agg(F.sum(size).cast("double").alias("_size")), "source-sizes")
    if weights:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
        sizes = sizes.withColumn("_raw", F.coalesce(F.try_element_at(given, F.col("_source")), F.lit(0.0)))
    else:
        sizes = sizes.withColumn("_raw", F.pow("_size", F.lit(float(alpha))))
    whole = sizes.agg(F.coalesce(F.sum("_raw"), F.lit(0.0)).alias("raw"), F.coalesce(F.sum("_size"), F.lit(0.0)).alias("size")).first()
    target = F.lit(whole["size"] if total is None else float(total))
    return (
        sizes.withColumn("_weight", F.try_divide("_raw", F.lit(whole["raw"])))
        .withColumn("_rate", F.coalesce(F.try_divide(F.col("_weight") * target, F.col("_size")), F.lit(0.0)))
        .withColumn("_parts", F.greatest(F.lit(1), F.ceil(F.col("_rate") / PART)).cast("int"))
        .withColumn("_cdf", poisson_table(F.col("_rate") / F.col("_parts")))
        .select("_source", "_weight", "_rate", "_parts", "_cdf")
    )


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    *,
    by: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
    alpha: float = ALPHA,
    total: float | None = None,
    seed: int = 17,
    shuffle: bool = True,
) -> DataFrame:
    """Replicate ``docs`` so that sources hold ``weights`` of the ``total`` characters (by default the input's).

    Returns the input's columns and ``_copy`` (from 0), ``_rate`` and ``_place``,
    the hash the rows are globally ordered by. Sizes are code points of the text
    (a null text counts as empty). A null source is a source of its own. A source
    of size 0 or without a stated weight has rate 0: its documents leave. Repeated
    rows are drawn alike (the draw depends on the id alone); a null id draws as
    the text ''. An empty table gives an empty table. Columns called like the
    three added ones are replaced, other names never clash.
    """
    names = docs.drop("_copy", "_rate", "_place").columns
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    # the row travels as one struct, so that no name of its columns can clash with those added here
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(by).alias("_by"), ident.alias("_ident"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("_chars"))
    rates = source_rates(rows, "_by", F.col("_chars"), weights, alpha, total)
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    draw = F.aggregate(
        F.sequence(F.lit(1), F.col("_parts")),
        F.lit(0),
        lambda n, part: n + F.size(F.filter("_cdf", lambda x: x <= uniform(F.lit(str(seed)), F.col("_ident"), part.cast("string")))),
    )
    drawn = rows.join(rates, rows["_by"].eqNullSafe(rates["_source"]), "left").withColumn("_n", draw)
    copies = drawn.where("_n > 0").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    placed = copies.withColumn("_place", F.md5(F.concat_ws("|", F.lit(f"place{seed}"), "_ident", F.col("_copy").cast("string"))))
    placed = placed.select("_row", "_copy", "_rate", "_place")
    placed = placed.orderBy("_place") if shuffle else placed
    return placed.select(*[F.col(f"_row.`{c}`").alias(c) for c in names], "_copy", "_rate", "_place")
