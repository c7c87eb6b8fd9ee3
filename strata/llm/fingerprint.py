"""Canonical exact fingerprints: Unicode normalisation, case and whitespace folding, wide xxhash.

Texts with equal digests form a bucket, and inside a bucket the canonical bytes
are compared, those of edited texts too. Where they differ (a collision of 128
bits) the fingerprint of every text in that bucket is widened by a second digest,
so equal fingerprints always mean equal canonical texts.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import join_skewed, materialize, parts, small_batches


def canonical(text: str | None) -> bytes:
    """NFKC, full case folding, NFKC again, white space runs to one space, none at the ends."""
    text = text or ""
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def digests(text: str | None) -> tuple[str, str]:
    """The wide digest and the one that separates a collided bucket."""
    data = canonical(text)
    return xxhash.xxh3_128_hexdigest(data), hashlib.sha256(data).hexdigest()[:32]


def raw_hash(text_col: str) -> Column:
    """A hash that names a raw text when it is fetched again."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, second, raw) of every row; a null text is the empty text. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [digests(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string()), batch.column(2)], ["id", "fingerprint", "second", "raw"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return small_batches(docs.select(F.col(id_col), F.col(text_col), raw_hash(text_col))).mapInArrow(run, f"id {kind}, fingerprint string, second string, raw long")


def _canonical(texts: DataFrame) -> DataFrame:
    """(fingerprint, bytes) of (text, following): of the text, or where there is a following one of the edited text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [canonical(t if f is None else _edited(t or "", f)) for t, f in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_hexdigest(d) for d in data], pa.string()), pa.array(data, pa.binary())], ["fingerprint", "bytes"])

    return small_batches(texts.select("text", "following")).mapInArrow(run, "fingerprint string, bytes binary")


def collided(docs: DataFrame, found: DataFrame, text_col: str = "text", edited: DataFrame | None = None) -> DataFrame:
    """Digests whose bucket holds different canonical bytes, by comparing those bytes.

    found: (fingerprint, raw) of every text; edited: (fingerprint, raw, next_raw) of
    edited ones. Only texts in buckets of several members are fetched again (by
    ``join_skewed``: a text with many copies is no hot key), copies collapse before
    the shuffle, and what is left per digest are its distinct byte strings: usually one.
    """
    every = found.select("fingerprint")
    if edited is not None:
        every = every.unionByName(edited.select("fingerprint"))
    several = materialize(every.groupBy("fingerprint").count().where("count > 1").select("fingerprint"), "shared-digests")
    needed = found.join(several, "fingerprint", "left_semi").select("raw")
    texts = docs.select(raw_hash(text_col).alias("raw"), F.col(text_col).alias("text"))
    if edited is None:
        pairs = None
    else:
        pairs = materialize(edited.join(several, "fingerprint", "left_semi").select("raw", "next_raw").distinct(), "shared-edited")
        needed = needed.union(pairs.select("raw")).union(pairs.select("next_raw"))
    wanted = materialize(needed.groupBy("raw").agg(F.count("*").alias("n")), "wanted-texts")
    members = _canonical(join_skewed(texts, wanted, "raw", "n").select("text", F.lit(None).cast("string").alias("following")))
    if pairs is not None:
        # each raw text once: few texts are edited into what others are
        fetched = pairs.select("raw").union(pairs.select(F.col("next_raw").alias("raw"))).groupBy("raw").agg(F.count("*").alias("n"))
        once = materialize(join_skewed(texts, materialize(fetched, "edited-wanted"), "raw", "n").groupBy("raw").agg(F.max("text").alias("text")), "edited-texts")
        after = once.select(F.col("raw").alias("next_raw"), F.coalesce("text", F.lit("")).alias("following"))
        members = members.unionByName(_canonical(pairs.join(once, "raw").join(after, "next_raw")))
    return members.distinct().groupBy("fingerprint").count().where("count > 1").select("fingerprint")


def settled(found: DataFrame, clash: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Widen the fingerprints in collided buckets. pairs: (fingerprint column, second digest's column)."""
    for k, (name, second) in enumerate(pairs):
        bad = clash.select(F.col("fingerprint").alias(f"_clash{k}"))
        found = found.join(bad, F.col(name) == F.col(f"_clash{k}"), "left")
        found = found.withColumn(name, F.when(F.col(f"_clash{k}").isNotNull(), F.concat_ws("-", name, second)).otherwise(F.col(name))).drop(f"_clash{k}")
    return found


def fingerprint_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, group_id): group_id is the smallest id with the same canonical text.

    Null texts are empty texts; rows without an id are left out of the choice of
    group_id but keep their fingerprint. Repeated rows stay. Empty table: empty.
    """
    found = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    clash = collided(docs, found, text_col)
    found = settled(found, clash, [("fingerprint", "second")]).drop("second", "raw")
    groups = materialize(found.groupBy("fingerprint").agg(F.min("id").alias("group_id"), F.count("*").alias("n")), "fingerprint-groups")
    return join_skewed(found, groups, "fingerprint", "n").select(F.col("id").alias(id_col), "fingerprint", "group_id")


# --- the half-replaced text of a document and its neighbour -----------------------------------------------------

_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, second string, edited_fingerprint string, edited_second string, next_fingerprint string, next_second string, raw long, next_raw long, part long, first boolean, pending boolean, edge_text string"


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: A document on its way: id, text, digests, raw hash, and whether it is its range's first.
_Doc = tuple[int | None, str, tuple[str, str], int, bool]


def _row(own: _Doc, other: _Doc | None, part: int) -> tuple:
    doc_id, text, pair, raw, first = own
    if other is None:
        return (doc_id, len(text), None, *pair, None, None, None, None, raw, None, part, first, True, text)
    edited = _edited(text, other[1])
    found = (hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), *pair, *digests(edited), *other[2])
    return (doc_id, len(text), *found, raw, other[3], part, first, False, text if first else None)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 7, *[pa.int64()] * 3, pa.bool_(), pa.bool_(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [x.split()[0] for x in _OUT.split(", ")])


def half_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its text with the second half taken from the next document.

    The next document is the one with the next smaller doc_id, after the last the
    first. One range partitioning by doc_id puts neighbours side by side, and
    each partition streams its rows holding one row back; only the last row of
    every partition needs a row of another, and those (two per partition, which
    keep their texts) meet in a small join.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next (1.0 for equal fingerprints, else 0.0: an exact digest
    knows no other likeness). Null texts are empty. Every row comes out: rows that
    share a doc_id follow each other in the order of a hash of their texts, rows
    without one come last. Empty table: empty.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("raw", raw_hash("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("raw")]
    ordered = small_batches(docs).repartitionByRange(max(8, parts(spark)), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, first = TaskContext.get().partitionId(), None, True
        for batch in batches:
            rows = []
            for i, t, raw in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = t.as_py()
                new = (i, text, digests(text), raw, first)
                first = False
                if held:
                    rows.append(_row(held, new, part))
                held = new
            if rows:
                yield _batch(rows)
        if held:
            yield _batch([_row(held, None, part)])

    found = materialize(ordered.mapInArrow(run, _OUT), "half-edited")
    used = [r["part"] for r in found.where("pending").select("part").orderBy("part").collect()]  # one row for each partition
    pairs = spark.createDataFrame([(p, used[(k + 1) % len(used)]) for k, p in enumerate(used)], "part long, next_part long")
    last = found.where("pending").select("part", "doc_id", F.col("edge_text").alias("text"), "raw", "first")
    heads = found.where("first").select(F.col("part").alias("next_part"), F.col("edge_text").alias("next_text"), F.col("raw").alias("next_raw"))
    joined = last.join(pairs, "part").join(heads, "next_part")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([_row((i, a, digests(a), x, f), (None, b, digests(b), y, False), p) for i, a, x, f, b, y, p in zip(*(c.to_pylist() for c in batch.columns), strict=True)])

    rest = joined.select("doc_id", "text", "raw", "first", "next_text", "next_raw", "part").mapInArrow(finish, _OUT)
    done = found.where("not pending").unionByName(rest).drop("edge_text")
    edited = done.select(F.col("edited_fingerprint").alias("fingerprint"), "raw", "next_raw")
    clash = materialize(collided(docs, found.select("fingerprint", "raw"), "text", edited), "half-edited-clash")
    done = settled(done, clash, [("fingerprint", "second"), ("edited_fingerprint", "edited_second"), ("next_fingerprint", "next_second")])
    same = lambda a, b: F.when(F.col(a) == F.col(b), 1.0).otherwise(0.0)
    return done.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        same("fingerprint", "edited_fingerprint").alias("near_edited"), same("fingerprint", "next_fingerprint").alias("near_next"),
    )
