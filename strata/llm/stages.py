"""The stages of ``corpus_pipeline``: each takes (spark, docs, sf_dir) and returns a DataFrame.

All but the last return the columns they were given; each works on all rows its
predecessor kept, and keeps every document it has no reason to reject.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard, lines, mixing, packing, toxicity
from .shared import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go; rows without an id are judged like any other."""
    names = docs.columns
    model = toxicity.fit(docs, toxicity.training_rows(table(spark, sf_dir, "labels")))
    scored = model.judge(docs)
    return scored.where(F.col("_score") < toxicity.THRESHOLD).select(*[F.col(f"`{c}`") for c in names])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-repeated lines go; n_chars is counted again."""
    done = lines.dedup_lines(docs, min_chars=1)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by shingle similarity the one with the smallest id stays. Of rows that repeat an id and its
    text one stays (the least by a hash of all columns); rows of one id with different texts all stay."""
    names = docs.columns
    found = jaccard.jaccard_components(docs)
    keep = found.where("doc_id = component_id").select("doc_id").distinct()
    known = docs.where("doc_id is not null").join(keep, "doc_id", "left_semi")
    repeated = known.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not repeated.isEmpty():
        columns = [F.col(f"`{c}`") for c in names]
        again = known.join(repeated, "doc_id", "left_semi").select(F.struct(*columns).alias("_all"), F.xxhash64("text").alias("_text"), F.xxhash64(*columns).alias("_row"))
        one = again.groupBy("_all.doc_id", "_text").agg(F.min_by("_all", "_row").alias("_all")).select("_all.*")
        known = known.join(repeated, "doc_id", "left_anti").select(*columns).unionByName(one)
    return known.select(*[F.col(f"`{c}`") for c in names]).unionByName(docs.where("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources hold their target weights."""
    names = docs.columns
    return mixing.mix_sources(docs).select(*[F.col(f"`{c}`") for c in names])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 1024 ids."""
    from .queries import tokenizer_path

    packed = packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
