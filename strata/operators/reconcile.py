"""Comparing tables: keys, totals, aggregates, content."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import both_sides


def keys_reconciled(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: keys in both, only left, only right; one full outer join on distinct keys."""
    a = left.select(*keys).distinct().withColumn("_l", F.lit(1))
    b = right.select(*keys).distinct().withColumn("_r", F.lit(1))
    both = a.join(b, list(keys), "full_outer")
    return both.agg(F.count_if(F.expr("_l is not null and _r is not null")).alias("matched"), F.count_if(F.expr("_r is null")).alias("only_left"), F.count_if(F.expr("_l is null")).alias("only_right"))


def reconciled(left: DataFrame, right: DataFrame, grain: Sequence[str], measure: str, tolerance: float = 0.01, worst: int | None = None) -> DataFrame:
    """Sums of a measure by grain side by side, with whether they agree; optionally the worst groups only."""
    total = lambda df: df.groupBy(*grain).agg(F.sum(measure).alias(measure))
    out = both_sides(total(left), total(right), grain, [measure]).withColumn("within", F.abs(f"diff_{measure}") <= tolerance)
    return out if worst is None else out.orderBy(F.abs(f"diff_{measure}").desc(), *grain).limit(worst)


def control_total(df: DataFrame, column: str, expected: float, tolerance_pct: float) -> DataFrame:
    """One row: the sum, what was expected, the difference in percent, and whether it is tolerable."""
    out = df.agg(F.coalesce(F.sum(column), F.lit(0.0)).alias("actual")).withColumn("expected", F.lit(float(expected)))
    pct = F.coalesce(F.try_divide(F.abs(F.col("actual") - F.col("expected")) * 100, F.abs("expected")), F.abs("actual"))
    return out.withColumn("diff_pct", pct).withColumn("passed", F.col("diff_pct") <= tolerance_pct)


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row that does not depend on order or partitioning: count, xor and sum of row hashes; NULL and '' differ."""
    columns = list(columns or df.columns)
    row = F.xxhash64(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    return df.select(row.alias("h")).agg(F.count("*").alias("row_count"), F.bit_xor("h").alias("hash_xor"), F.sum(F.col("h").cast("decimal(38,0)")).alias("hash_sum"))


#: Children of a node of a fingerprint tree.
FAN_OUT = 256


def row_hash(df: DataFrame, columns: Sequence[str]) -> Column:
    """64 bits of a row's values; NULL and '' differ."""
    return F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"}))


def leaf_of(key: str, low: int, high: int, levels: int) -> Column:
    """The leaf range of an integer key: the key space from ``low`` to ``high`` is cut into FAN_OUT**levels ranges of one
    width; keys outside lie in the first and last, NULL in none."""
    width = -(-(high - low + 1) // FAN_OUT**levels)
    last = FAN_OUT**levels - 1
    leaf = F.greatest(F.lit(0), F.least(F.lit(last), F.expr(f"cast(floor((`{key}` - {low}L) / {width}L) as bigint)"))).cast("long")
    return F.when(F.col(f"`{key}`").isNotNull(), leaf)


def fingerprint_tree(df: DataFrame, key: str, low: int, high: int, levels: int = 2) -> DataFrame:
    """(level, node, row_count, hash_sum, hash_xor): fingerprints of key ranges, from the root (level 0) to the leaves.

    One aggregate gives the leaves, of which there are at most FAN_OUT**levels; the levels above sum them. A stored tree
    stands for its table in later comparisons. Rows whose key is NULL lie in node -1 of every level but the root."""
    h = row_hash(df, [c for c in df.columns])
    leaves = df.select(F.coalesce(leaf_of(key, low, high, levels), F.lit(-1)).alias("node"), h.cast("decimal(20,0)").alias("s"), h.alias("x"))
    leaves = leaves.groupBy("node").agg(F.count("*").alias("row_count"), F.sum("s").cast("decimal(38,0)").alias("hash_sum"), F.bit_xor("x").alias("hash_xor"))
    above = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), (F.lit(0) if k == 0 else F.when(F.col("node") < 0, -1).otherwise(F.floor(F.col("node") / FAN_OUT ** (levels - k)))).cast("long").alias("up")) for k in range(levels + 1)]))
    return leaves.select("*", above.alias("a")).groupBy("a.level", F.col("a.up").alias("node")).agg(
        F.sum("row_count").alias("row_count"), F.sum("hash_sum").cast("decimal(38,0)").alias("hash_sum"), F.bit_xor("hash_xor").alias("hash_xor")
    )


def differing_nodes(left: DataFrame, right: DataFrame, levels: int = 2) -> DataFrame:
    """Leaves that differ between two trees, reached from the root through differing nodes only."""
    mark = lambda df, side: df.select("level", "node", F.struct("row_count", "hash_sum", "hash_xor").alias(side))
    unlike = mark(left, "_l").join(mark(right, "_r"), ["level", "node"], "full_outer").where(~F.col("_l").eqNullSafe(F.col("_r"))).select("level", "node")
    found = unlike.where("level = 1").select("node") if levels else unlike.select("node")
    for k in range(2, levels + 1):
        parent = found.withColumnRenamed("node", "_up")
        found = unlike.where(F.col("level") == k).select("node").join(parent, F.when(F.col("node") < 0, F.col("node")).otherwise(F.floor(F.col("node") / FAN_OUT)) == F.col("_up"), "left_semi")
    return found


def rows_of_nodes(df: DataFrame, nodes: Sequence[int], key: str, low: int, high: int, levels: int) -> DataFrame:
    """Rows of some leaves. Neighbouring leaves are one range of keys, and the ranges reach the scan."""
    width, last = -(-(high - low + 1) // FAN_OUT**levels), FAN_OUT**levels - 1
    runs: list[list[int]] = []
    for n in sorted(nodes):
        if runs and n == runs[-1][1] + 1 and n > 0:
            runs[-1][1] = n
        else:
            runs.append([n, n])
    test, c = F.lit(False), F.col(f"`{key}`")
    for a, b in runs:
        if b < 0:
            test = test | c.isNull()
            continue
        first, end = low + a * width, low + (b + 1) * width - 1
        test = test | ((c >= first if a > 0 else c.isNotNull()) & (c <= end if b < last else c.isNotNull()))
    return df.where(test)


def differing_keys(left: DataFrame, right: DataFrame, key: str, levels: int = 2, trees: tuple[DataFrame, DataFrame] | None = None, bounds: tuple[int, int] | None = None, most_ranges: int = 1000) -> DataFrame:
    """(key, difference): keys whose rows are missing on one side, extra, or changed, found by descending two trees.

    Both tables are read once for their trees (not at all where stored ``trees`` of these ``bounds`` are given), then only
    the key ranges of differing leaves are read again: by pushed ranges up to ``most_ranges`` leaves, beyond by joining
    the leaves. Keys that repeat are compared as bags of rows."""
    if bounds is None:
        both = left.select(key).unionByName(right.select(key)).agg(F.min(key), F.max(key)).first()
        bounds = (int(both[0] or 0), int(both[1] or 0))
    low, high = bounds
    t = trees or tuple(fingerprint_tree(df, key, low, high, levels) for df in (left, right))
    nodes = differing_nodes(*t, levels)
    few = [r["node"] for r in nodes.limit(most_ranges + 1).collect()]
    if len(few) <= most_ranges:
        part = lambda df: rows_of_nodes(df, few, key, low, high, levels)
    else:
        part = lambda df: df.withColumn("_node", F.coalesce(leaf_of(key, low, high, levels), F.lit(-1))).join(nodes.withColumnRenamed("node", "_node"), "_node", "left_semi").drop("_node")
    cells = lambda df, side: part(df).select(F.col(f"`{key}`"), row_hash(df, df.columns).alias("h")).groupBy(key).agg(F.struct(F.count("*"), F.bit_xor("h"), F.sum(F.col("h").cast("decimal(20,0)"))).alias(side))
    a, b = cells(left, "_l"), cells(right, "_r").withColumnRenamed(key, "_key")
    met = a.join(b, F.col(key).eqNullSafe(F.col("_key")), "full_outer").where(~F.col("_l").eqNullSafe(F.col("_r")))
    kind = F.when(F.col("_r").isNull(), "only_left").when(F.col("_l").isNull(), "only_right").otherwise("changed")
    return met.select(F.when(F.col("_l").isNull(), F.col("_key")).otherwise(F.col(key)).alias(key), kind.alias("difference"))


def join_integrity(fact: DataFrame, dim: DataFrame, key: str, dim_key: str, unknown: int = -1) -> DataFrame:
    """One row: facts, those without a dimension row, the unknown member's, and the share that joins."""
    d = dim.select(F.col(dim_key).alias("_k")).distinct().withColumn("_hit", F.lit(1))
    both = fact.join(d, fact[key] == F.col("_k"), "left")
    out = both.agg(F.count("*").alias("facts"), F.count_if((F.col("_hit").isNull()) & F.coalesce(F.col(key) != unknown, F.lit(True))).alias("unmatched"), F.count_if(F.col(key) == unknown).alias("unknown"))
    return out.withColumn("joined_share", F.coalesce(1 - F.try_divide(F.col("unmatched") + F.col("unknown"), F.col("facts")), F.lit(1.0)))


def whole_duplicates(df: DataFrame) -> DataFrame:
    """One row: rows, distinct rows, repeated rows. Rows are told apart by two 64-bit hashes, so no text crosses the shuffle."""
    json = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    keys = df.select(F.xxhash64(json).alias("a"), F.xxhash64(F.lit(17), json).alias("b"))
    return keys.groupBy("a", "b").count().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("row_count"), F.count("*").alias("distinct_rows")).withColumn("duplicates", F.col("row_count") - F.col("distinct_rows"))
