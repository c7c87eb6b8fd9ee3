"""N-gram Jaccard join: exact links between documents whose word-shingle sets are similar.

1. One corpus-wide lookup gives the document frequency of every shingle. A
   document can only link if shingles that others have too make up the
   threshold's share of its set: all others are settled at once.
2. Documents with equal sets become one class; a class stands for its copies.
3. Classes meet in clusters: those sharing a shingle of their prefix in the
   order of rising frequency (two similar sets always do).
4. Inside clusters, signature trees find the links (``settree``).
5. Components of the links, carried back to every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Bucket, Chunk, answered, bucket_count, corpus_bytes, keyed, make_chunks, rejoin, spread, way_count
from .components import connected_components
from .settree import cluster_links
from .shared import join_skewed, materialize
from .textkit import Words, mix

SHINGLE, NUM, DEN = 5, 75, 100
_OUT = "id long, n long, set_a long, set_b long, prefix int, tokens binary"


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of the distinct shingles of each text, sorted by hash then text."""
    hashed, inside = words.windows(size)
    at = np.flatnonzero(inside)
    keys, docs = hashed[at], words.document_of()[at]
    n = words.counts()
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        keys = np.concatenate((keys, np.array([words.whole(k) for k in short], np.uint64)))
        docs = np.concatenate((docs, short))
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
    return keys[new], docs[new]


def _frequency(bucket: Bucket) -> tuple[np.ndarray, list[np.ndarray]]:
    df = bucket.per_key(np.add, 0)[bucket.group()]
    return df > 1, [df]


def _groups(keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return new


def shared_sets(docs: DataFrame, size: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, set_a, set_b, prefix, tokens): sets that may link carry a 128-bit digest, and their common tokens in
    rising frequency once per chunk; for all others these are null."""
    chunks = make_chunks(docs, id_col, text_col)
    buckets = bucket_count(corpus_bytes(chunks) / 5)
    ways = way_count(buckets)

    def emit(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        keys, _ = shingles(Words(chunk.data, chunk.offsets, lower=True), size)
        starts = np.flatnonzero(_groups(keys))
        return keys[starts], np.diff(np.append(starts, len(keys)))

    def gather(chunk: Chunk, got: dict) -> pa.Table:
        keys, owner = shingles(Words(chunk.data, chunk.offsets, lower=True), size)
        starts = np.flatnonzero(_groups(keys))
        places, (df,) = spread(keys[starts], got, ways, [np.zeros(0, np.int64)])
        per_key = np.ones(len(starts), np.int64)
        per_key[places] = df
        per_entry = np.repeat(per_key, np.diff(np.append(starts, len(keys))))
        n = np.bincount(owner, minlength=len(chunk)).astype(np.int64)
        common = np.bincount(owner[per_entry > 1], minlength=len(chunk))
        fits = (n > 0) & (den * common >= num * n)
        a, b = np.zeros(len(chunk), np.uint64), np.zeros(len(chunk), np.uint64)
        np.add.at(a, owner, mix(keys))
        np.bitwise_xor.at(b, owner, mix(keys ^ np.uint64(0x9E3779B97F4A7C15)))
        use = np.flatnonzero((per_entry > 1) & fits[owner])
        use = use[np.lexsort((keys[use], per_entry[use], owner[use]))]
        edges = np.searchsorted(owner[use], np.arange(len(chunk) + 1))
        sent: dict[tuple[int, int], int] = {}
        for k in np.flatnonzero(fits):
            key = (int(a[k]), int(b[k]))
            if key not in sent or chunk.ids[k] < chunk.ids[sent[key]]:
                sent[key] = int(k)
        first = set(sent.values())
        prefix = common - (-(-num * n // den)) + 1
        tokens = [keys[use[edges[k] : edges[k + 1]]].tobytes() if k in first else None for k in range(len(chunk))]
        hide = ~fits
        return pa.table(
            [
                pa.array(chunk.ids), pa.array(n), pa.array(a.view(np.int64), mask=hide), pa.array(b.view(np.int64), mask=hide),
                pa.array(prefix.astype(np.int32), mask=hide), pa.array(tokens, pa.binary()),
            ],
            [x.split()[0] for x in _OUT.split(", ")],
        )

    answers = answered(keyed(chunks, ways, emit), chunks, buckets, ways, _frequency)
    return materialize(rejoin(chunks, answers, gather, _OUT), "shingle-sets")


def prefix_clusters(sets: DataFrame) -> DataFrame:
    """(id, cluster): classes connected by shared prefix tokens. sets: (id, prefix, tokens)."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = batch.column(1).to_numpy()
            tokens = [np.frombuffer(t.as_py(), np.int64)[:p] for t, p in zip(batch.column(2), prefix, strict=True)]
            ids = np.repeat(batch.column(0).to_numpy(), [len(t) for t in tokens])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate([*tokens, np.zeros(0, np.int64)]), pa.int64())], ["id", "token"])

    entries = sets.select("id", "prefix", "tokens").mapInArrow(explode, "id long, token long")
    entries = materialize(entries, "prefix-tokens")
    hubs = materialize(entries.groupBy("token").agg(F.min("id").alias("hub"), F.max("id").alias("most"), F.count("*").alias("size")).where("hub < most").drop("most"), "prefix-hubs")
    edges = join_skewed(entries, hubs, "token", "size").where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    return connected_components(edges).select(F.col("node").alias("id"), F.col("component").alias("cluster"))


def jaccard_components(docs: DataFrame, size: int = SHINGLE, num: int = NUM, den: int = DEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document with an id.

    Links: den * |intersection| >= num * |union| of the sets of distinct ``size``-word
    shingles (A-Z lower-cased); a text with fewer words is one shingle, and one
    without words, or null, has an empty set and links with nothing.
    component_id is the smallest id reachable by links, itself included. Repeated
    rows come out once each. Empty table: empty.
    """
    found = shared_sets(docs, size, num, den, id_col, text_col)
    members = found.where("set_a is not null")
    reps = materialize(members.groupBy("set_a", "set_b").agg(F.min("id").alias("rep"), F.count("*").alias("size")), "shingle-classes")
    full = found.where("tokens is not null").withColumnRenamed("id", "rep").join(reps, ["set_a", "set_b", "rep"]).select(F.col("rep").alias("id"), "n", "prefix", "tokens").dropDuplicates(["id"])
    full = materialize(full, "shingle-reps")
    clusters = materialize(prefix_clusters(full), "clusters")
    sizes = materialize(clusters.groupBy("cluster").agg(F.count("*").alias("m"), F.count("*").alias("size")), "cluster-sizes")
    seen = sizes.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("rows"), F.max("m").alias("most")).first()
    held = full.join(join_skewed(clusters, sizes, "cluster", "size"), "id").select("id", "n", "tokens", "cluster", "m")
    links = cluster_links(held, seen["rows"], seen["most"], num, den)
    labels = connected_components(materialize(links, "links"))
    reps = reps.join(labels, reps["rep"] == labels["node"], "left").select("set_a", "set_b", F.coalesce("component", "rep").alias("component"), "size")
    # documents that cannot link need no lookup; a hot class is met by broadcast
    reps = materialize(reps.select(F.struct("set_a", "set_b").alias("set"), "component", "size"), "class-components")
    linked = join_skewed(members.select("id", "n", F.struct("set_a", "set_b").alias("set")), reps, "set", "size").select("id", "n", "component")
    alone = found.where("set_a is null").select("id", "n", F.col("id").alias("component"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
