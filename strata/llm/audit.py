"""Filter interaction audit: what five document filters remove in every order of application.

Documents are judged once into small facts (text digest, failed filters, labels),
written as files that a stream takes in available-now micro-batches. Filters A to
D look at one text; E asks whether a smaller id has the same text anywhere, which
an arriving file can change for rows already counted. So the stream keeps, for
each text (in state keyed by buckets of their digests), the smallest id seen and the rows that hold it; when a smaller id
arrives the earlier rows' masks are retracted from the counters of their parts and
counted again as failing E. Each micro-batch writes its changes under its own
number, so a repeated batch replaces itself; their sum is the audit's input.

Rows of one text are combined inside each map task before they meet in the text's
state, so a text that a third of all rows share costs its state a few rows a task.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import permutations

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .shared import fresh_path, parts

FILTERS = "ABCDE"
#: The bit of E in a mask; A to D hold 1, 2, 4 and 8.
TWIN = 16
#: Words, as bytes between ASCII spaces.
SPACES = r"[\x20\x09-\x0D]+"
MIN_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT, MARKS = 50, 65, 5, "[#$%&*|]"


def failed(text: Column) -> Column:
    """The mask of filters A to D that a text fails: few words, few distinct words, many capitals, odd marks."""
    words = F.array_remove(F.split(text, SPACES), "")
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    tests = [n < MIN_WORDS, 100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * n, 100 * capitals > CAPITALS_PERCENT * F.length(text), text.rlike(MARKS)]
    return sum((F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)), F.lit(0))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, doc_id, part, mask, good, toxic, n): documents reduced to what the audit needs; repeated rows are counted.

    Null texts are empty, null sources the empty string. Of several labels for an id the highest counts. Rows without an
    id have no labels and never fail E, nor make another row fail it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.unhex(F.sha2(text, 256)).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), failed(text).alias("mask"))
    rows = rows.groupBy("key", "doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    # rows without an id meet no label: they are dealt by their text, so that nulls never share a task
    rows = rows.withColumns({"_known": F.col("doc_id").isNotNull(), "_id": F.coalesce("doc_id", F.xxhash64("key"))})
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    joined = rows.join(marks.withColumn("_known", F.lit(True)), ["_known", "_id"], "left")
    return joined.select("key", "doc_id", "part", "mask", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")], "n")


COMBINED = "key binary, part string, mask int, good int, toxic int, known boolean, low long, at_low long, n long"


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows of one text, part and labels as one row: its smallest id, the rows that hold it, and all rows."""
    by = ["key", "part", "mask", "good", "toxic", "known"]
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows.append_column("known", pc.is_valid(rows["doc_id"])).set_column(1, "doc_id", pc.fill_null(rows["doc_id"], 0))
        ids = rows.group_by([*by, "doc_id"]).aggregate([("n", "sum")])
        order = ids.sort_by("doc_id")  # the first row of a group holds its smallest id
        least = order.group_by(by, use_threads=False).aggregate([("doc_id", "first"), ("n_sum", "first"), ("n_sum", "sum")])
        yield from least.rename_columns([*by, "low", "at_low", "n"]).select([f.split()[0] for f in COMBINED.split(", ")]).cast(_arrow_schema()).to_batches()


def _arrow_schema() -> pa.Schema:
    kinds = {"binary": pa.binary(), "string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in COMBINED.split(", ")])


#: What a bucket's state holds: for each text the smallest id seen, and how many rows of each part and label hold it.
HELD = ["key", "part", "mask", "good", "toxic", "low", "at_low"]


def _packed(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _counted(holders: pd.DataFrame, sign: int) -> list[pd.DataFrame]:
    """Rows that hold their text's smallest id do not fail E."""
    rows = holders[["part", "mask", "good", "toxic"]].assign(n=sign * holders["at_low"])
    return [rows, rows.assign(mask=rows["mask"] | TWIN, n=-rows["n"])]


def update(bucket: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Changes of the counters (part, mask, good, toxic, n) that new rows of a bucket's texts make: new rows count as
    copies, the rows that hold a text's smallest id now are counted as first, and those that held it before retracted."""
    new = pd.concat(list(frames), ignore_index=True)
    known = new["known"].to_numpy(dtype=bool)
    held = pa.ipc.open_stream(state.get[0]).read_pandas() if state.exists else new.loc[[], HELD]
    both = pd.concat([held, new.loc[known, HELD]], ignore_index=True)
    first = both[both["low"] == both.groupby("key")["low"].transform("min")]
    now = first.groupby(HELD[:-1], as_index=False, sort=False)["at_low"].sum()
    if known.any():
        state.update((_packed(now),))
    arrived = new[["part", "mask", "good", "toxic", "n"]].copy()
    arrived.loc[known, "mask"] |= TWIN
    changes = pd.concat([arrived, *_counted(now, 1), *_counted(held, -1)], ignore_index=True)
    summed = changes.groupby(["part", "mask", "good", "toxic"], as_index=False, sort=False)["n"].sum()
    yield summed[summed["n"] != 0]


#: Texts of a state bucket, on average: a call of ``update`` costs milliseconds, so a text has no state of its own.
BUCKET = 2000


def counters(facts: DataFrame, batches: int = 4) -> DataFrame:
    """(part, mask, good, toxic, n) of all ``facts``, streamed from files in about ``batches`` micro-batches.

    The session's state store provider keeps the texts' state, about BUCKET texts to a value; progress, state and
    changes lie in the shared folder.
    """
    spark = facts.sparkSession
    source, progress, changes = (fresh_path(spark, f"audit-{x}") for x in ("facts", "progress", "changes"))
    facts.repartition(max(batches, parts(spark) // batches * batches)).write.parquet(source)
    written = spark.read.schema(facts.schema).parquet(source)
    files, buckets = max(1, len(written.inputFiles())), 1 + written.count() // BUCKET
    arriving = spark.readStream.schema(facts.schema).option("maxFilesPerTrigger", -(-files // batches)).parquet(source)
    kept = arriving.mapInArrow(_combined, COMBINED).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).groupBy("bucket").applyInPandasWithState(
        update, "part string, mask int, good int, toxic int, n long", "held binary", "append", GroupStateTimeout.NoTimeout
    )

    def take(batch: DataFrame, number: int) -> None:
        batch.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{changes}/batch={number}")

    query = kept.writeStream.outputMode("append").option("checkpointLocation", progress).trigger(availableNow=True).foreachBatch(take).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    schema = "part string, mask int, good int, toxic int, n long"
    if not query.lastProgress:  # no rows, no batch
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{changes}/*").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def orders() -> list[dict]:
    """Every step of every order: its filter's bit and the bits of the filters before it."""
    return [{"o": "".join(p), "s": s + 1, "f": 1 << FILTERS.index(p[s]), "b": sum(1 << FILTERS.index(x) for x in p[:s])} for p in permutations(FILTERS) for s in range(len(p))]


def interactions(counts: DataFrame) -> DataFrame:
    """The audit's rows from counters: for each part, order and step what the step keeps, removes and would remove."""
    per = counts.groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col(c)).alias(c) for c in ("good", "toxic")])
    steps = F.from_json(F.lit(json.dumps(orders())), "array<struct<o string, s int, f int, b int>>")
    rows = per.select("*", F.inline(steps))
    fails, before = (F.col("mask").bitwiseAND(F.col("f")) != 0), (F.col("mask").bitwiseAND(F.col("b")) != 0)
    total = lambda test, c="n": F.sum(F.when(test, F.col(c)).otherwise(F.lit(0))).cast("long")
    share = F.col("n") * F.expr("120 div greatest(bit_count(mask), 1)")  # of 120 orders, those in which one failing filter comes first
    return rows.groupBy("part", F.col("o").alias("filter_order"), F.col("s").alias("step")).agg(
        total(~fails & ~before).alias("kept"), total(fails & ~before).alias("removed"), total(fails & before).alias("redundant"), total(F.col("mask") == F.col("f")).alias("unique_fails"),
        total(fails & ~before, "good").alias("good_lost"), total(fails & ~before, "toxic").alias("toxic_lost"), F.sum(F.when(fails, share).otherwise(F.lit(0))).cast("long").alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, batches: int = 4) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all ``docs``.

    One row for each source, order of the five filters and step, zeros included; no rows for an empty table. Repeated
    rows count as often as they come; rows of one id and text are no copies of each other.
    """
    return interactions(counters(judged(docs, labels), batches))
