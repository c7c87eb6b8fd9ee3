"""Structured Streaming over records of Kafka's shape: parse, split, de-duplicate within a watermark, write both lanes."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

RECORD = "key string, value string, topic string, partition int, offset long, timestamp timestamp"


def kafka_stream(spark: SparkSession, servers: str, topic: str, starting: str = "latest", rate: int | None = None, **options: str) -> DataFrame:
    """Records of a topic (needs Spark's Kafka module on the class path)."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting).option("failOnDataLoss", "false").options(**options)
    return (reader.option("maxOffsetsPerTrigger", rate) if rate else reader).load()


def file_stream(spark: SparkSession, path: str, schema: str = RECORD, files_per_trigger: int | None = None) -> DataFrame:
    """JSON files of records, as they arrive."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).json(path)


def parsed(records: DataFrame, schema: StructType | str) -> DataFrame:
    """The value's fields beside key, topic, partition, offset and timestamp; ``_undecodable`` marks values that are no JSON."""
    text = F.col("value").cast("string")
    typed = records.withColumns({"_value": F.from_json(text, schema, {"mode": "PERMISSIVE"}), "_raw": text})
    decoded = typed.withColumn("_undecodable", F.try_parse_json("_raw").isNull())
    return decoded.select(F.col("key").cast("string").alias("key"), "topic", "partition", "offset", "timestamp", "_raw", "_undecodable", "_value.*")


def invalid(required: Sequence[str]) -> Column:
    """NULL-safe predicate of records that go to the dead-letter lane."""
    out = F.coalesce(F.col("_undecodable"), F.lit(True))
    for c in required:
        out = out | F.col(c).isNull()
    return out


def reason(required: Sequence[str]) -> Column:
    out = F.when(F.col("_undecodable"), "undecodable")
    for c in required:
        out = out.when(F.col(c).isNull(), f"missing {c}")
    return out


def deduplicated(df: DataFrame, keys: Sequence[str], event_time: str, delay: str = "1 hour") -> DataFrame:
    """First record of each key within the watermark; state is dropped as the watermark passes."""
    timed = df.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, delay)
    return timed.dropDuplicatesWithinWatermark(list(keys))


def write_lanes(df: DataFrame, required: Sequence[str], valid_path: str, dead_path: str, checkpoint: str, processing_date: Column, interval: str | None = None) -> StreamingQuery:
    """Both lanes from one read. Each batch overwrites its own slice, so a replayed batch adds nothing. Dead letters carry the
    reason and the time at which their batch found them."""

    def both(batch: DataFrame, number: int) -> None:
        batch = batch.withColumns({"_batch": F.lit(number), "_proc_date": processing_date}).persist()
        bad = invalid(required)
        lanes = ((batch.where(~bad).drop("_raw", "_undecodable"), valid_path), (batch.where(bad).withColumns({"_reason": reason(required), "_failed_at": F.current_timestamp()}).select("key", "topic", "partition", "offset", "timestamp", "_raw", "_reason", "_failed_at", "_batch", "_proc_date"), dead_path))
        for rows, path in lanes:
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_proc_date", "_batch").parquet(path)
        batch.unpersist()

    writer = df.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def append_stream(df: DataFrame, path: str, checkpoint: str, processing_date: Column, interval: str | None = None) -> StreamingQuery:
    """Append partitioned by processing date (a date, never a raw timestamp)."""
    writer = df.withColumn("_proc_date", processing_date).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("_proc_date").outputMode("append")
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def config_faults(config: Mapping[str, object]) -> list[str]:
    """What is wrong with a stream's settings."""
    out = []
    if not re.fullmatch(r"\d+ (second|minute|hour|day)s?", str(config.get("watermark", ""))):
        out.append("watermark needs a number and a unit")
    out += [f"{k} is missing" for k in ("dead_letter_path", "checkpoint_path", "output_path") if not config.get(k)]
    if config.get("dead_letter_path") and config.get("dead_letter_path") == config.get("output_path"):
        out.append("both lanes have one path")
    return out
