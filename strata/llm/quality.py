"""Quality scores: histogram gradient-boosted trees over document statistics.

A document's statistics (lengths, byte classes, repetition of words and lines,
shapes of words) are computed for a batch of texts at once with NumPy. Training
bins each statistic at quantiles of a bounded labelled sample; every level of every
tree is one Spark job in which tasks sum gradients and curvatures by node,
statistic and bin, so the driver only sees histograms of a fixed size. A finished
model is three arrays for all trees, which a batch descends together, level by level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .shared import give_back, materialize, small_batches
from .textkit import U, Words, mix, slices, span_hashes, string_buffers

#: Labelled rows that may teach the model (chosen by a hash of the id), and the blocks they are held in.
MAX_LABELLED, BLOCKS = 50_000, 8
TREES, DEPTH, BINS, RATE = 24, 4, 64, 0.2
#: Curvature a leaf needs at least, ridge on its value, and the gain a split needs.
MIN_CURVATURE, RIDGE, MIN_GAIN = 2.0, 1.0, 1e-3
THRESHOLD = 0.5
#: Bytes of text whose statistics are computed together.
SPAN = 4 << 20

#: Byte classes: each character set is one class, by its place here; other ASCII is class 0, the rest of UTF-8 the last two.
CLASSES = ["", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".", ",", "!", "?", "#$%&*|", ":;\"'-", "()[]{}<>/\\=_", " \t", "\n"]
_CLASS = np.zeros(256, np.uint8)
for _k, _set in enumerate(CLASSES):
    _CLASS[[ord(c) for c in _set]] = _k
_LEAD, _REST = len(CLASSES), len(CLASSES) + 1  # first and further bytes of a character beyond ASCII
_CLASS[0xC0:] = _LEAD
_CLASS[0x80:0xC0] = _REST

NAMES = [
    "log_chars", "log_words", "word_length", "longest_word", "capitals", "digits", "stops", "commas", "exclamations", "questions", "marks", "quotes", "brackets", "spaces", "newlines", "beyond_ascii",
    "distinct_words", "repeated_next", "short_words", "capitalised", "marked_words", "log_lines", "distinct_lines", "line_length", "stop_lines",
]


def _per_text(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` over each range first[i]..first[i + 1]."""
    total = np.zeros(len(flags) + 1)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[first])


def _distinct(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Number of different hashes in each range."""
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    _, index = np.unique(mix(hashes ^ mix(of.astype(U) + U(1))), return_index=True)
    return np.bincount(of[index], minlength=len(first) - 1).astype(float)


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of NAMES for each whole text; nulls and empty texts give zeros."""
    data, offsets = string_buffers(texts)
    n = len(offsets) - 1
    of = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    counts = np.bincount(of * (_REST + 1) + _CLASS[data], minlength=n * (_REST + 1)).reshape(n, _REST + 1).astype(float)
    del of
    size = np.diff(offsets).astype(float)
    chars = size - counts[:, _REST]
    words = Words(data, offsets)
    n_words, lengths = words.counts().astype(float), (words.end - words.start).astype(float)
    longest = np.zeros(n)
    np.maximum.at(longest, words.document_of(), lengths)
    follows = np.zeros(len(lengths), bool)
    follows[1:] = words.hash[1:] == words.hash[:-1]
    follows[words.first[:-1][n_words > 0]] = False  # a text's first word follows none
    # a line ends before a line feed or at its text's end; nothing follows a line feed that ends its text
    feeds, bounds = np.flatnonzero(data == 10), offsets[1:][size > 0]
    ends = np.sort(np.concatenate([feeds, bounds[data[bounds - 1] != 10]]))
    starts = np.union1d(np.setdiff1d(feeds + 1, bounds), offsets[:-1][size > 0])
    line_first = np.searchsorted(starts, offsets)
    n_lines = np.diff(line_first).astype(float)
    last = np.where(ends > starts, data[ends - 1], 0)
    per_char, per_word, per_line = 1 / np.maximum(chars, 1), 1 / np.maximum(n_words, 1), 1 / np.maximum(n_lines, 1)
    capital, mark = _CLASS == 1, np.isin(_CLASS, (5, 7))
    columns = [
        np.log1p(chars), np.log1p(n_words), _per_text(lengths, words.first) * per_word, np.log1p(longest),
        *[counts[:, k] * per_char for k in range(1, _REST)],
        _distinct(words.hash, words.first) * per_word, _per_text(follows, words.first) * per_word, _per_text(lengths <= 3, words.first) * per_word,
        _per_text(capital[data[words.start]], words.first) * per_word, _per_text(mark[data[words.end - 1]], words.first) * per_word,
        np.log1p(n_lines), _distinct(span_hashes(data, starts, ends), line_first) * per_line, chars * per_line, _per_text(np.isin(last, (33, 46, 63)), line_first) * per_line,
    ]
    return np.where((size > 0)[:, None], np.column_stack(columns), 0.0)


@dataclass
class Trees:
    """Complete trees of one depth: node k's children are 2k+1 and 2k+2, its rows go right above ``cut``."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    bias: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row of ``x``."""
        rows, total = np.arange(len(x)), np.full(len(x), self.bias)
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            total += leaf[descend(x, rows, feature, cut, DEPTH)]
        return total


def descend(x: np.ndarray, rows: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """The node of its level, from 0, that each row reaches after so many levels."""
    node = np.zeros(len(x), np.int64)
    for _ in range(levels):
        node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
    return node - ((1 << levels) - 1)


def odds(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def histograms(bins: np.ndarray, labels: np.ndarray, done: Trees, feature: np.ndarray, cut: np.ndarray, level: int) -> np.ndarray:
    """Gradients and curvatures by (node of the level, statistic, bin), given the finished trees and the growing one."""
    p = odds(done.margins(bins))
    node = descend(bins, np.arange(len(bins)), feature, cut, level)
    width = bins.shape[1]
    at = (node[:, None] * width + np.arange(width)) * BINS + bins
    size = (1 << level) * width * BINS
    sums = [np.bincount(at.ravel(), np.repeat(v, width), size) for v in (p - labels, p * (1 - p))]
    return np.stack(sums).reshape(2, 1 << level, width, BINS)


def best_splits(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each node its statistic, the bin up to which rows go left, and the values of both sides (no gain: all go left)."""
    (g, h), total = sums, sums.sum(-1)[:, :, :1]
    left_g, left_h = g.cumsum(-1), h.cumsum(-1)
    right_g, right_h = total[0][..., None] - left_g, total[1][..., None] - left_h
    part = lambda a, b: a * a / (b + RIDGE)
    gain = part(left_g, left_h) + part(right_g, right_h) - part(total[0], total[1])[..., None]
    gain[(left_h < MIN_CURVATURE) | (right_h < MIN_CURVATURE)] = -1
    flat = gain.reshape(len(gain), -1)
    at = flat.argmax(-1)
    feature, cut = at // BINS, (at % BINS).astype(float)
    none = flat.max(-1) < MIN_GAIN
    cut[none] = BINS
    k = np.arange(len(gain))
    sides = np.stack([-left_g / (left_h + RIDGE), -right_g / (right_h + RIDGE)], -1)[k, feature, at % BINS]
    whole = (-total[0] / (total[1] + RIDGE))[:, 0]
    sides[none] = whole[none, None]
    return feature, cut, sides


def boosted(blocks: DataFrame, positive: float) -> Trees:
    """Trees over binned rows in ``blocks`` (block, rows of bins, labels), one Spark job for each level."""
    width, nodes = len(NAMES), (1 << DEPTH) - 1
    trees = Trees(np.zeros((0, nodes), np.int64), np.zeros((0, nodes)), np.zeros((0, nodes + 1)), float(np.log(positive / (1 - positive))))
    for _ in range(TREES):
        feature, cut = np.zeros(nodes, np.int64), np.full(nodes, float(BINS))
        for level in range(DEPTH):

            def run(batches: Iterator[pa.RecordBatch], level: int = level, now: tuple = (trees, feature.copy(), cut.copy())) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for block, raw, labels in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                        found = histograms(np.frombuffer(raw, np.uint8).reshape(-1, width).astype(np.int64), np.frombuffer(labels, np.uint8).astype(float), now[0], now[1], now[2], level)
                        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([found.tobytes()], pa.binary())], ["block", "sums"])

            rows = sorted(blocks.mapInArrow(run, "block long, sums binary").collect())  # BLOCKS histograms of fixed size
            sums = sum(np.frombuffer(r["sums"]).reshape(2, 1 << level, width, BINS) for r in rows)
            first = (1 << level) - 1
            feature[first : 2 * first + 1], cut[first : 2 * first + 1], sides = best_splits(sums)
        leaf = RATE * sides.reshape(-1)
        trees = Trees(np.vstack([trees.feature, feature]), np.vstack([trees.cut, cut]), np.vstack([trees.leaf, leaf]), trees.bias)
    return trees


@dataclass
class QualityModel:
    trees: Trees | None
    prior: float

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, score) of every row in one pass; texts are read whole, null as empty, null ids stay."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for some in slices(batch, 1, SPAN):
                    scores = odds(self.trees.margins(statistics(some.column(1))))
                    yield pa.RecordBatch.from_arrays([some.column(0), pa.array(scores)], ["doc_id", "score"])
            give_back()

        chosen = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
        if self.trees is None:
            return chosen.select("doc_id", F.lit(self.prior).alias("score"))
        return small_batches(chosen).mapInArrow(run, "doc_id long, score double")


def training_rows(labels: DataFrame) -> DataFrame:
    """Labels that may be learned from: crc32 of the id's text modulo 3 is not 1."""
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> QualityModel:
    """Learn from ``labels`` (doc_id, quality), of which at most ``max_labelled`` ids are used, by a hash of the id.

    Labels without an id or class are ignored; of several for one id the highest counts. Without both classes the score
    is their rate (0.5 without any). Labels of ids that no document has teach nothing.
    """
    chosen = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("label"))
    chosen = chosen.withColumn("deal", F.xxhash64(F.col("doc_id").cast("string"))).orderBy("deal", "doc_id").limit(max_labelled).select("doc_id", "label")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # one row for each labelled id, so that repeated rows stay within the bound
    once = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    kinds = StructType([StructField("doc_id", LongType()), StructField("label", LongType()), *[StructField(c, DoubleType()) for c in NAMES]])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 2, SPAN):
                found = statistics(some.column(2))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1).cast(pa.int64()), *[pa.array(found[:, k]) for k in range(len(NAMES))]], ["doc_id", "label", *NAMES])

    sample = materialize(small_batches(once.select("doc_id", "label", "text")).mapInArrow(measured, kinds), "quality-sample")
    totals = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")).first()
    prior = (totals["p"] / totals["n"]) if totals["n"] else 0.5
    if not totals["n"] or not 0 < prior < 1:
        return QualityModel(None, float(prior))
    edges = [np.unique(e) for e in sample.approxQuantile(NAMES, [k / BINS for k in range(1, BINS)], 0.001)]

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.column_stack([np.searchsorted(e, batch.column(k + 2).to_numpy(zero_copy_only=False)) for k, e in enumerate(edges)]).astype(np.uint8)
            labels = batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(0, 1), pa.array([bins.tobytes()], pa.binary()), pa.array([labels.tobytes()], pa.binary())], ["block", "bins", "labels"])

    blocks = materialize(sample.repartition(BLOCKS, "doc_id").sortWithinPartitions("doc_id").mapInArrow(binned, "block long, bins binary, labels binary"), "quality-bins")
    trees = boosted(blocks.coalesce(BLOCKS), prior)
    # bins become values again: a row goes right above the edge of its bin
    padded = [np.append(e, np.full(BINS + 1 - len(e), np.inf)) for e in edges]
    cut = np.array([[padded[f][int(c)] for f, c in zip(fs, cs, strict=True)] for fs, cs in zip(trees.feature, trees.cut, strict=True)])
    return QualityModel(Trees(trees.feature, cut, trees.leaf, trees.bias), prior)
