"""Joins, aggregates, windows, top-k and set operations that the table models share."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes up to which a table is broadcast on request, by the planner's own statistics; beyond it the planner decides.
BROADCAST_BYTES = 64 << 20

# --- joins ------------------------------------------------------------------------------------------------------


def size_in_bytes(df: DataFrame) -> int:
    """The planner's estimate of a frame's size; nothing is run. Where it knows too little the estimate is large."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint only if its estimated size is small. No job is run to find out: a table whose size
    cannot be told in advance is joined as adaptive execution then decides."""
    return F.broadcast(df) if size_in_bytes(df) <= most else df


def join_dimension(fact: DataFrame, dim: DataFrame, on: Sequence[str] | Column, how: str = "left") -> DataFrame:
    """A fact's left join to a dimension; broadcast is left to the planner's own size statistics."""
    return fact.join(dim, on, how)


def assert_unique(dim: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``dim``, or an error where its keys repeat: then a left join to it cannot add rows, and no join need be counted."""
    if not dim.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"keys {list(keys)} repeat; a join would multiply rows")
    return dim


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, columns: Sequence[str], order: Sequence[str] = (), split: str | None = None) -> DataFrame:
    """``left`` with ``columns`` of the last ``right`` row of its keys at or before its time, NULL where there is none.

    Both sides are stacked and sorted once by keys and time; the last row of the right side is carried along, so no pair of
    rows is formed (a join on a time inequality would form all earlier ones). Right rows of one time are told apart by
    ``order``, the greatest wins. Rows without a time, or with a NULL key, find nothing.

    ``split`` (a unit of date_trunc: year, month, day ...) deals the rows of a key over its periods: the last right row of
    every period is carried over the periods first, one row each, so a key that a third of all rows share has no task of
    its own. The answer is the same."""
    names, t = left.columns, "_time"
    value = F.struct(*[F.col(f"`{c}`") for c in columns])
    rank = F.struct(*[F.col(f"`{c}`") for c in order]) if order else F.struct(F.lit(0))
    key = [F.col(f"`{k}`") for k in keys]
    kind = (left.schema[left_time].dataType, right.schema[right_time].dataType)
    as_time = "timestamp" if any(k.simpleString().startswith(("timestamp", "date")) for k in kind) else kind[0]
    a = left.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)], F.col(f"`{left_time}`").cast(as_time).alias(t), F.lit(1).alias("_side"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    b = right.where(F.col(f"`{right_time}`").isNotNull()).select(*[k.alias(f"_k{i}") for i, k in enumerate(key)], F.col(f"`{right_time}`").cast(as_time).alias(t), F.lit(0).alias("_side"), value.alias("_value"), rank.alias("_order"))
    for i in range(len(keys)):
        b = b.where(F.col(f"_k{i}").isNotNull())
    both, by = a.unionByName(b, allowMissingColumns=True), [f"_k{i}" for i in range(len(keys))]
    carry = None
    if split:
        both, by = both.withColumn("_period", F.date_trunc(split, t)), [*by, "_period"]
        last = F.max_by(F.col("_value"), F.when(F.col("_side") == 0, F.struct(t, "_order")))
        per = both.where(F.col(t).isNotNull()).groupBy(*by).agg(last.alias("_last"))
        earlier = Window.partitionBy(*by[:-1]).orderBy("_period").rowsBetween(Window.unboundedPreceding, -1)
        carry = per.select(*[F.col(c).alias(f"_c{c}") for c in by], F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    until = Window.partitionBy(*by).orderBy(F.col(t).asc_nulls_first(), "_side", F.col("_order").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_found", F.last("_value", ignorenulls=True).over(until)).where("_side = 1")
    if carry is not None:
        on = [F.col(c).eqNullSafe(F.col(f"_c{c}")) for c in by]
        found = found.join(carry, on, "left").withColumn("_found", F.coalesce("_found", "_carried"))
    return found.select(*[F.col(f"_row.`{c}`").alias(c) for c in names], *[F.col(f"_found.`{c}`").alias(c) for c in columns])


#: A key is hot when it holds over one part in HOT of the rows: there are at most HOT of them.
HOT = 1000


def join_spread(fact: DataFrame, dim: DataFrame, key: str, how: str = "left", salts: int = 64) -> DataFrame:
    """inner, left, right or full outer join on ``key`` in which hot keys of ``fact`` are dealt over ``salts`` tasks each.

    Hot keys are counted first, by an aggregate that combines before its shuffle. Their fact rows get a salt by a
    hash of their values (so a repeated task deals them alike) and their dimension rows, HOT keys' at most, are repeated
    for each salt; all other rows are joined as usual. The result is the same: a hot key has facts, so none of its
    dimension rows is without a match, and repeated dimension rows meet disjoint facts. Rows equal in every column share a
    salt."""
    if how not in ("inner", "left", "right", "full"):
        raise ValueError(f"{how} joins are not spread")
    counts = fact.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))
    hot = [r[0] for r in counts.join(F.broadcast(total)).where(F.col("_n") * HOT > F.col("_all")).where(F.col("_n") >= HOT).select(key).limit(HOT).collect()]
    if not hot:
        return fact.join(dim, key, how)
    is_hot = F.col(key).isin(hot)
    cold = lambda df: df.where(~is_hot | F.col(key).isNull())
    values = [F.col(f"`{f.name}`") for f in fact.schema if "map<" not in f.dataType.simpleString()]
    salted = fact.where(is_hot).withColumn("_salt", F.pmod(F.xxhash64(*values), F.lit(salts)).cast("int"))
    repeated = dim.where(is_hot).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    inner = "left" if how in ("left", "full") else "inner"
    spread = salted.join(repeated, [key, "_salt"], inner).drop("_salt")
    return cold(fact).join(cold(dim), key, how).unionByName(spread)


def with_parent(child: DataFrame, parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    return child.join(parent.select(*keys), list(keys), "left_semi")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows without a parent; a NULL key has none."""
    p = parent.select(F.col(parent_key).alias("_parent_key"))
    return child.join(p, child[child_key] == F.col("_parent_key"), "left_anti")


def split_by_keys(df: DataFrame, bad: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(clean, rejected): rows by whether their keys are among the bad ones; NULL keys match NULL."""
    marks = bad.select(*[F.col(k).alias(f"_bad_{k}") for k in keys]).distinct()
    on = [df[k].eqNullSafe(F.col(f"_bad_{k}")) for k in keys]
    return df.join(marks, on, "left_anti"), df.join(marks, on, "left_semi")


def flagged(df: DataFrame, marks: DataFrame, key: str, name: str) -> DataFrame:
    """A column telling whether the key is among ``marks``."""
    found = marks.select(key).distinct().withColumn(name, F.lit(True))
    return df.join(found, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def both_sides(left: DataFrame, right: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Full outer join of two aggregates, absent measures 0, with their differences."""
    a = left.select(*keys, *[F.col(m).alias(f"left_{m}") for m in measures])
    b = right.select(*keys, *[F.col(m).alias(f"right_{m}") for m in measures])
    out = a.join(b, list(keys), "full_outer").fillna(0, [f"{s}_{m}" for s in ("left", "right") for m in measures])
    return out.withColumns({f"diff_{m}": F.col(f"left_{m}") - F.col(f"right_{m}") for m in measures})


def key_or(column: str, default: int = -1) -> Column:
    """A dimension key, or the unknown member's."""
    return F.coalesce(F.col(column), F.lit(default)).alias(column)


# --- windows ----------------------------------------------------------------------------------------------------


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key, the first by ``order``. The filter sits on the window, so ranks are cut before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def newest(*columns: str) -> list[Column]:
    return [F.col(c).desc_nulls_last() for c in columns]


def with_next(df: DataFrame, keys: Sequence[str], start: str, name: str = "effective_to") -> DataFrame:
    return df.withColumn(name, F.lead(start).over(Window.partitionBy(*keys).orderBy(start)))


def running_total(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str = "running_total") -> DataFrame:
    """Sum up to each row by order; rows that tie share a value."""
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(*keys).orderBy(order)))


def gaps(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], name: str = "gap_seconds") -> DataFrame:
    """Seconds since the previous row of the key."""
    t = F.col(ts).cast("timestamp")
    before = F.lag(t).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, (F.unix_micros(t) - F.unix_micros(before)) / 1e6)


def out_of_order(df: DataFrame, keys: Sequence[str], ts: str, arrival: str, name: str = "out_of_order") -> DataFrame:
    """Rows whose time lies before that of the row that arrived just before."""
    before = F.lag(ts).over(Window.partitionBy(*keys).orderBy(arrival))
    return df.withColumn(name, F.coalesce(F.col(ts) < before, F.lit(False)))


def with_share(df: DataFrame, value: str, name: str = "pct") -> DataFrame:
    """Percentage of the grand total of an aggregate's column (the total joins in as one row)."""
    total = df.agg(F.sum(value).alias("_total"))
    return df.join(F.broadcast(total)).withColumn(name, F.round(F.try_divide(F.col(value) * 100.0, F.col("_total")), 4)).drop("_total")


# --- top-k, sets, change sets -----------------------------------------------------------------------------------


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def frequent(df: DataFrame, column: str, n: int) -> DataFrame:
    return top(df.groupBy(column).agg(F.count("*").alias("n")), n, F.desc("n"), F.asc(column))


def sampled(df: DataFrame, fraction: float, seed: int, key: str, most: int | None = None) -> DataFrame:
    """A reproducible sample: by a hash of the key, whatever the partitioning."""
    part = df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)) < int(fraction * 1_000_000))
    return part.orderBy(key).limit(most) if most is not None else part


def changes(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that turn ``target`` into ``source``, with ``change`` insert, update or delete; one full outer join.

    Values are compared NULL-safely. Deleted rows carry the target's values."""
    values = [c for c in source.columns if c not in keys]
    s = source.select(*keys, F.struct(*values).alias("_s"), F.lit(1).alias("_in_s"))
    t = target.select(*keys, F.struct(*values).alias("_t"), F.lit(1).alias("_in_t"))
    both = s.join(t, list(keys), "full_outer")
    kind = F.when(F.col("_in_t").isNull(), "insert").when(F.col("_in_s").isNull(), "delete").when(~F.col("_s").eqNullSafe(F.col("_t")), "update")
    return both.withColumn("change", kind).where("change is not null").select(*keys, F.coalesce("_s", "_t").alias("_v"), "change").select(*keys, *[f"_v.{v}" for v in values], "change")


def applied(target: DataFrame, change_set: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``target`` after a change set of ``changes``."""
    gone = change_set.select(*keys)
    return target.join(gone, list(keys), "left_anti").unionByName(change_set.where("change <> 'delete'").drop("change"))


def merged(target: DataFrame, source: DataFrame, keys: Sequence[str], update: Sequence[str] | None = None, newer: str | None = None) -> DataFrame:
    """Upsert: matched rows take the source's columns (all or ``update``), if newer where asked; the rest is inserted."""
    columns = [c for c in target.columns if c not in keys]
    t = target.select(*[F.col(k).alias(f"_t_{k}") for k in keys], F.struct(*columns).alias("_t"), F.lit(1).alias("_in_t"))
    s = source.select(*keys, F.struct(*[F.col(c) if c in source.columns else F.lit(None).cast(target.schema[c].dataType).alias(c) for c in columns]).alias("_s"), F.lit(1).alias("_in_s"))
    on = [F.col(k).eqNullSafe(F.col(f"_t_{k}")) for k in keys]
    both = t.join(s, on, "full_outer")
    use = F.col("_in_s").isNotNull()
    if newer:
        use = use & (F.col("_in_t").isNull() | F.coalesce(F.col(f"_s.{newer}") > F.col(f"_t.{newer}"), F.col(f"_t.{newer}").isNull()))
    value = lambda c: F.when(use & (F.col("_in_t").isNull() | F.lit(update is None or c in update)), F.col(f"_s.{c}")).otherwise(F.col(f"_t.{c}")).alias(c)
    return both.select(*[F.when(F.col("_in_s").isNotNull(), F.col(k)).otherwise(F.col(f"_t_{k}")).alias(k) for k in keys], *[value(c) for c in columns]).select(*target.columns)


def counted(tables: Mapping[str, DataFrame], *aggregates: Column) -> DataFrame:
    """One row for each table: its name and the aggregates."""
    frames = [df.agg(F.count("*").alias("row_count"), *aggregates).select(F.lit(name).alias("table_name"), "*") for name, df in tables.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, nulls): one pass for all columns."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in columns])
    return one.select(F.explode(pairs).alias("p")).select("p.*")
