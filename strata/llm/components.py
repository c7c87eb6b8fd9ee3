"""Connected components of an edge table: alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import join_skewed, materialize

#: Edges a task thins at a time (16 MB), and so few (0.8 MB) that rounds would only be a handful of trivial jobs.
HELD, SMALL = 1_000_000, 50_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) that connect what the given edges connect."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def _thinned(edges: DataFrame) -> DataFrame:
    """The edges of each partition replaced by spanning forests of HELD of them at a time: fewer rows, the same components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, held = [], [], 0
        for batch in batches:
            a.append(batch.column(0).to_numpy(zero_copy_only=False))
            b.append(batch.column(1).to_numpy(zero_copy_only=False))
            held += len(a[-1])
            if held >= HELD:
                x, y = forest(np.concatenate(a), np.concatenate(b))
                a, b, held = [x], [y], len(x)
                if held >= HELD // 2:  # little to gain: send them on
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])
                    a, b, held = [], [], 0
        if held:
            x, y = forest(np.concatenate(a), np.concatenate(b))
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null").mapInArrow(run, "a long, b long")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node reachable.

    Spanning forests of the partitions come first. Rounds follow: nodes point their
    larger neighbours at their smallest (large star), then their smaller ones (small
    star); a round is written to the shared folder and the last is the one that
    changes nothing, or leaves at most SMALL edges, which one forest settles. A node
    with many neighbours is no hot key: its smallest neighbour travels to them by
    broadcast (``join_skewed``). Self edges only name a node.
    """
    named = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).where("node is not null").distinct()
    current = materialize(_thinned(edges.where("a <> b")).distinct(), "edges")
    mark = None
    while True:
        seen = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if seen["n"] <= SMALL:
            labels = _thinned(current.coalesce(1)).select("a", F.col("b").alias("component"))
            break
        if mark == tuple(seen):
            labels = current.groupBy("a").agg(F.min("b").alias("component"))
            break
        mark = tuple(seen)
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = join_skewed(both.where("b > a"), materialize(low, "least"), "a", "n").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # a node has few smaller neighbours left: each kept only its least ones
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        current = materialize(_thinned(small.where("a <> b")).distinct(), "edges")
    return named.join(labels, named["node"] == labels["a"], "left").select("node", F.coalesce("component", "node").alias("component"))
