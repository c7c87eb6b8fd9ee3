"""Substring de-duplication over word windows by level-wise doubling.

Lengths double up to the window: 7 then 13 for a window of 13 words. At the first
level every window of the second length sends one of its short windows, the one
of smallest hash (equal windows pick equal short windows, so nothing is lost and
a quarter of the positions is enough). Only where a short window starts in
several documents are windows of twice the length built and looked up, and so on
until the wanted length or until no candidate survives.

Windows are compared by 64-bit hashes; lookups go through ``chunks`` (a passage
shared by a third of all documents is one entry per chunk).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .chunks import _KEYED, Bucket, Chunk, answered, bucket_count, corpus_bytes, key_rows, keyed, make_chunks, packed_rows, rejoin, way_count
from .shared import materialize
from .textkit import Words

SHORTEST = 7
_OUT = "doc_id long, n_words long, n_removed long, kept_text string"


def lengths(window: int, shortest: int = SHORTEST) -> list[int]:
    """Window lengths by halving upwards: 13 -> [7, 13]; 50 -> [7, 13, 25, 50]."""
    out = [window]
    while out[0] > shortest:
        out.insert(0, (out[0] + 1) // 2)
    return out


def anchors(words: Words, short: int, long: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of ``long`` words the position of its smallest window of ``short`` words (first on ties), else -1."""
    hashed, _ = words.windows(short)
    _, inside = words.windows(long)
    n = len(hashed)
    at = np.full(n, -1, np.int64)
    starts = np.flatnonzero(inside)
    best, where = hashed[starts], starts.copy()
    for step in range(1, long - short + 1):
        other = hashed[starts + step]
        less = other < best
        best[less], where[less] = other[less], starts[less] + step
    at[starts] = where
    return hashed, at


def _entries(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct sorted keys with the smallest id and its distance to the largest."""
    order = np.argsort(keys, kind="stable")
    keys, docs = keys[order], docs[order]
    if not len(keys):
        return keys, docs, docs.astype(np.uint64)
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    low, high = np.minimum.reduceat(docs, starts), np.maximum.reduceat(docs, starts)
    return keys[starts], low, (high - low).view(np.uint64)


def _counted(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys, and 1 or 2 for one or several documents: all that a level before the last needs."""
    keys, low, more = _entries(keys, docs)
    return keys, (1 + (more > 0)).astype(np.uint8)


def _repeated(bucket: Bucket) -> tuple[np.ndarray, list[np.ndarray]]:
    """Tell about keys that several documents have, or one in several chunks."""
    several = np.add.reduceat(bucket.values[0].astype(np.int64), bucket.starts) > 1
    group = bucket.group()
    return several[group], [bucket.keys[group]]


def _in_several(bucket: Bucket) -> tuple[np.ndarray, list[np.ndarray]]:
    """Tell about keys of several documents: the key and its smallest id."""
    low = bucket.per_key(np.minimum, 0)
    high = (bucket.values[0] + bucket.values[1].view(np.int64))
    high = np.maximum.reduceat(high, bucket.starts)
    group = bucket.group()
    return (low < high)[group], [bucket.keys[group], low[group]]


def _told(answers: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
    """The keys that were told about in order, and what was told."""
    got = list(answers.values()) or [[np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]]
    columns = [np.concatenate([a[k] for a in got]) for k in range(1, len(got[0]))]
    order = np.argsort(columns[0])
    return [c[order] for c in columns]


def _find(keys: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are in the sorted ``told``, and where."""
    if not len(told):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(told, keys), len(told) - 1)
    return told[at] == keys, at


def remove_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_removed and kept_text (the kept words joined by one space).

    A word goes if some window of ``window`` consecutive words of its document covers it
    whose word sequence also starts in a document with a smaller id. Null and
    empty texts have no words; texts shorter than the window lose none. Rows with
    the same id never remove each other's words; rows without an id are left out.
    An empty table gives an empty table.
    """
    chunks = make_chunks(docs, id_col, text_col)
    buckets = bucket_count(corpus_bytes(chunks) / 5)
    ways = way_count(buckets)
    sizes = lengths(window)

    def words_of(chunk: Chunk) -> Words:
        return Words(chunk.data, chunk.offsets)

    def first(chunk: Chunk) -> tuple[np.ndarray, ...]:
        words = words_of(chunk)
        if len(sizes) == 1:
            hashed, inside = words.windows(window)
            at = np.flatnonzero(inside)
        else:
            hashed, where = anchors(words, sizes[0], sizes[1])
            at = np.unique(where[where >= 0])
        local = _entries if len(sizes) == 1 else _counted
        return local(hashed[at], chunk.ids[words.document_of()[at]])

    rows = keyed(chunks, ways, first)
    for level in range(1, len(sizes)):
        answers = answered(rows, chunks, buckets, ways, _repeated)
        short, long = sizes[level - 1], sizes[level]

        def extend(chunk: Chunk, got: dict, level: int = level, short: int = short, long: int = long) -> pa.Table:
            words = words_of(chunk)
            told = _told(got)[0]
            if level == 1:
                hashed, where = anchors(words, short, long)
                known, _ = _find(hashed, told)
                starts = np.flatnonzero(where >= 0)
                starts = starts[known[where[starts]]]
            else:
                hashed, inside = words.windows(short)
                known = _find(hashed, told)[0] & inside
                _, fits = words.windows(long)
                starts = np.flatnonzero(fits)
                starts = starts[known[starts] & known[starts + long - short]]
            longer, _ = words.windows(long)
            local = _entries if long == window else _counted
            keys, *values = local(longer[starts], chunk.ids[words.document_of()[starts]])
            return pa.Table.from_batches([packed_rows(key_rows(chunk.number, ways, keys, values))])

        rows = rejoin(chunks, answers, extend, _KEYED)
    final = materialize(answered(rows, chunks, buckets, ways, _in_several), "repeated-windows")

    def finish(chunk: Chunk, got: dict) -> pa.Table:
        words = words_of(chunk)
        told, low = _told(got)
        hashed, inside = words.windows(window)
        known, at = _find(hashed, told)
        owner = words.document_of()
        known &= inside
        if len(low):
            known &= low[at] < chunk.ids[owner]
        marks = np.zeros(len(hashed) + window + 1, np.int64)
        hits = np.flatnonzero(known)
        np.add.at(marks, hits, 1)
        np.add.at(marks, hits + window, -1)
        gone = np.cumsum(marks)[: len(hashed)] > 0
        n = words.counts()
        removed = np.bincount(owner[gone], minlength=len(n))
        return pa.table([pa.array(chunk.ids), pa.array(n.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(list(kept_texts(words, gone)), pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return rejoin(chunks, final, finish, _OUT)


def kept_texts(words: Words, gone: np.ndarray) -> Iterator[str]:
    """The words of each text that stay, joined by one space."""
    keep = np.flatnonzero(~gone)
    lengths_ = words.end[keep] - words.start[keep]
    total = int(lengths_.sum()) + len(keep)
    out = np.full(total, 0x20, np.uint8)
    begins = np.concatenate(([0], np.cumsum(lengths_ + 1)))
    source = np.repeat(words.start[keep] - begins[:-1], lengths_)
    target = np.arange(int(lengths_.sum())) + np.repeat(np.arange(len(keep)), lengths_)
    out[target] = words.data[target + source]
    edges = begins[np.searchsorted(keep, words.first)]
    data = out.tobytes()
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield data[a : max(a, b - 1)].decode("utf-8", "replace")
