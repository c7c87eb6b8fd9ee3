"""Change capture, rolling upserts, and type-2 history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import change_hash, existing, lookback_split
from .relational import latest, newest

OPEN_END = "9999-12-31 00:00:00"


def apply_changes(df: DataFrame, keys: Sequence[str], ts: Sequence[str] = ("updated_at",), op: Sequence[str] = ("op",), deleted: Sequence[str] = ("is_deleted",)) -> DataFrame:
    """The latest row of each key, without deleted ones. Without an op column rows count as upserts."""
    order, ops, flags = existing(df, ts), existing(df, op), existing(df, deleted)
    kind = F.upper(F.trim(F.col(ops[0]))) if ops else F.lit(None).cast("string")
    if flags:
        kind = F.coalesce(kind, F.when(F.coalesce(F.col(flags[0]).try_cast("boolean"), F.lit(False)), "D"))
    df = df.withColumn("_op", F.coalesce(kind, F.lit("UPSERT")))
    last = latest(df, keys, newest(*order) if order else [F.lit(1)])
    return last.where(~F.col("_op").isin("D", "DELETE")).drop("_op")


def rolling_upsert(existing_rows: DataFrame, incoming: DataFrame, keys: Sequence[str], date: str, order: Sequence[str], cutoff: Column) -> DataFrame:
    """Rows before the cutoff (or without a date) stay; inside the window the latest of existing and incoming wins.

    Incoming rows before the cutoff are too late and change nothing (``too_late`` lists them); on ties the incoming row wins.
    """
    history, window = lookback_split(existing_rows, date, cutoff)
    _, recent = lookback_split(incoming, date, cutoff)
    both = window.withColumn("_new", F.lit(0)).unionByName(recent.withColumn("_new", F.lit(1)))
    return history.unionByName(latest(both, keys, [*newest(*order), F.col("_new").desc()]).drop("_new"))


def too_late(incoming: DataFrame, date: str, cutoff: Column) -> DataFrame:
    return lookback_split(incoming, date, cutoff)[0]


def versions(rows: DataFrame, keys: Sequence[str], attributes: Sequence[str], start: str, keep_unchanged: bool = False, end: Column | None = None) -> DataFrame:
    """Type-2 history from all versions ever seen (late ones included) in one shuffle.

    Of rows with one key and start the last by content counts; a version equal to
    the one before it is dropped unless kept. Adds effective_from, effective_to
    (NULL, or ``end``, for the open one), is_current and version.
    """
    w = Window.partitionBy(*keys).orderBy(start)
    hashed = rows.withColumn("_hash", change_hash(*[F.col(a) for a in attributes]))
    once = latest(hashed, [*keys, start], [F.col("_hash").desc()])
    if not keep_unchanged:
        once = once.withColumn("_before", F.lag("_hash").over(w)).where("_before is null or _before <> _hash").drop("_before")
    until = F.lead(start).over(w)
    done = once.withColumns({"effective_from": F.col(start), "effective_to": until if end is None else F.coalesce(until, end), "is_current": until.isNull(), "version": F.row_number().over(w)})
    return done.drop("_hash")


def apply_scd2(target: DataFrame | None, source: DataFrame, keys: Sequence[str], attributes: Sequence[str], start: str, keep_unchanged: bool = False) -> DataFrame:
    """A history table after new rows: new keys, changed keys, late arrivals and several versions in a batch alike.

    Running the same source again adds nothing.
    """
    columns = [*keys, *attributes]
    new = source.select(*columns, F.col(start).alias("effective_from")).dropna(subset=list(keys))
    rows = new if target is None else target.select(*columns, "effective_from").unionByName(new)
    return versions(rows, keys, attributes, "effective_from", keep_unchanged)


def history_faults(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row of counts: keys without exactly one current version, closed current ones, overlaps, inverted intervals, NULL keys."""
    w = Window.partitionBy(*keys).orderBy("effective_from", F.col("effective_to").asc_nulls_last())
    far = F.lit(OPEN_END).cast("timestamp")
    end = F.coalesce(F.col("effective_to").cast("timestamp"), far)
    marked = df.withColumns({"_overlap": F.coalesce(F.lead(F.col("effective_from").cast("timestamp")).over(w) < end, F.lit(False)), "_inverted": end < F.col("effective_from").cast("timestamp")})
    per_key = marked.groupBy(*keys).agg(
        F.count_if("is_current").alias("current"), F.count_if("_overlap").alias("overlaps"), F.count_if("_inverted").alias("inverted"),
        F.count_if(F.col("is_current") & (end < far)).alias("closed_current"),
    )
    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | F.col(k).isNull()
    return per_key.agg(
        F.count_if(F.expr("current <> 1")).alias("keys_without_one_current"), F.coalesce(F.sum("closed_current"), F.lit(0)).alias("closed_current"), F.coalesce(F.sum("overlaps"), F.lit(0)).alias("overlaps"),
        F.coalesce(F.sum("inverted"), F.lit(0)).alias("inverted"), F.count_if(no_key).alias("null_keys"),
    )


def history_of(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.where(F.col(key) == F.lit(value)).orderBy("effective_from")


def current_view(rows: DataFrame, changed: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Type 1: changed values replace the old ones."""
    new = changed.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = rows.join(new, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in columns}).drop(*[f"_new_{c}" for c in columns])


def changes_since(log: DataFrame, since: Column, kinds: Sequence[str] | None = None) -> DataFrame:
    """Change records from a moment on, of some kinds, in time order."""
    out = log.where(F.col("changed_at") >= since)
    return (out.where(F.col("change").isin(*kinds)) if kinds else out).orderBy("changed_at", "change_id")


def change_analysis(history: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys by their number of versions."""
    return history.groupBy(*keys).agg(F.count("*").alias("versions")).groupBy("versions").agg(F.count("*").alias("keys"))


# --- incremental extracts -----------------------------------------------------------------------------------------


def above_mark(df: DataFrame, ts: str, mark: Column | None) -> DataFrame:
    return df if mark is None else df.where(F.col(ts) > mark)


def marks_after(marks: DataFrame, source: str, extracted: DataFrame, ts: str) -> DataFrame:
    """High-water marks after an extract; a mark never moves back."""
    new = extracted.agg(F.max(ts).alias("mark")).where("mark is not null").select(F.lit(source).alias("source"), F.col("mark").cast(marks.schema["mark"].dataType))
    return marks.unionByName(new).groupBy("source").agg(F.max("mark").alias("mark"))


# --- overlaps, versions, sources ----------------------------------------------------------------------------------


def overlapping(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Versions that begin before the one before them ends; an open end lies in the far future. One window, no self join."""
    w = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    far = F.lit(OPEN_END).cast(df.schema[end].dataType)
    return df.withColumn("_seen", F.max(F.coalesce(F.col(end), far)).over(w)).where(F.col(start) < F.col("_seen")).drop("_seen")


def version_numbers(df: DataFrame, keys: Sequence[str], start: str) -> DataFrame:
    return df.withColumn("version", F.row_number().over(Window.partitionBy(*keys).orderBy(start)))


def compared(source: DataFrame, current: DataFrame, key: str, attributes: Sequence[str]) -> DataFrame:
    """Each source row as new, changed or unchanged against the current versions."""
    old = current.select(F.col(key), change_hash(*[F.col(a) for a in attributes]).alias("_old"))
    new = source.withColumn("_new", change_hash(*[F.col(a) for a in attributes])).join(old, key, "left")
    return new.withColumn("state", F.when(F.col("_old").isNull(), "new").when(F.col("_old") != F.col("_new"), "changed").otherwise("unchanged")).drop("_old", "_new")


def one_per_key(sources: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Several sources as one table, absent columns NULL: the latest row of each key, earlier sources first on ties."""
    both = None
    for k, df in enumerate(sources):
        df = df.withColumn("_source_rank", F.lit(k))
        both = df if both is None else both.unionByName(df, allowMissingColumns=True)
    return latest(both, keys, [*newest(*order), F.col("_source_rank")]).drop("_source_rank")
