"""Similarity links inside clusters of token sets, by dual traversal of signature trees.

A tree's leaves hold some sets of similar size; every node holds the OR of its
sets' token bitmaps, their size range and the most tokens any of them lost to
bitmap collisions. Starting from (root, root), a pair of nodes is dropped when
its size ranges cannot reach the threshold, when the largest possible overlap
(common bits plus collisions) is too small, or when everything below already is
one component; pairs that remain are split, and at the leaves sets are compared
by bitmap, then exactly. Only the links that join components are returned:
enough for components, never all pairs of a group. Clusters of two to LEAF sets
are trees of one leaf, and the leaves of many clusters are compared at once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import give_back, join_skewed, materialize

LEAF, FANOUT = 16, 8
#: Sets that one task compares with each other; larger clusters are dealt over blocks of this size.
BLOCK = 1500
#: Rough number of sets that share a task when clusters are small.
BUNDLE = 1500
#: Words of bitmap that one comparison of leaves holds at a time.
AT_ONCE = 1 << 18
_LINKS = "a long, b long"
U = np.uint64


class Sets:
    """Some token sets: sizes (those of the whole sets, where shared tokens alone are kept), bitmaps, and the tokens lost in them to collisions."""

    def __init__(self, sizes: np.ndarray, tokens: list[np.ndarray]):
        self.size, self.tokens = sizes, tokens
        count = np.array([len(t) for t in tokens], np.int64)
        # wide enough for most sets; a far larger one loses tokens to collisions, which the bound counts
        usual = np.percentile(count, 90) if len(count) else 1
        width = 1 << int(np.clip(np.ceil(np.log2(max(64, 4 * usual))), 8, 16))
        at = np.concatenate([*tokens, np.zeros(0, U)]) & U(width - 1)
        bits = np.zeros((len(tokens), width // 64), U)
        np.bitwise_or.at(bits.reshape(-1), np.repeat(np.arange(len(tokens)) * (width // 64), count) + (at >> U(6)).astype(np.int64), U(1) << (at & U(63)))
        self.bits, self.lost = bits, count - np.bitwise_count(bits).sum(1).astype(np.int64)

    def possible(self, x: np.ndarray, y: np.ndarray, num: int, den: int) -> np.ndarray:
        """Of pairs of positions, those whose sizes and bitmaps allow the threshold."""
        out = np.zeros(len(x), bool)
        step = max(1, AT_ONCE // self.bits.shape[1])
        fit = np.flatnonzero(den * np.minimum(self.size[x], self.size[y]) >= num * np.maximum(self.size[x], self.size[y]))
        for i in range(0, len(fit), step):
            k = fit[i : i + step]
            most = np.bitwise_count(self.bits[x[k]] & self.bits[y[k]]).sum(1).astype(np.int64) + np.minimum(self.lost[x[k]], self.lost[y[k]])
            out[k] = most >= _enough(self.size[x[k]], self.size[y[k]], num, den)
        return out

    def linked(self, x: int, y: int, num: int, den: int) -> bool:
        common = len(np.intersect1d(self.tokens[x], self.tokens[y], assume_unique=True))
        return den * common >= num * (self.size[x] + self.size[y] - common)


def _enough(small, large, num: int, den: int):  # noqa: ANN001, ANN202
    """Least overlap of sets of these sizes at a Jaccard of num / den."""
    return -(-num * (small + large) // (num + den))


def _levels(sets: Sets, order: np.ndarray) -> list[tuple]:
    """Of (first row, OR of bitmaps, smallest and largest size, most collisions) of a tree's nodes, from the leaves up."""
    out, edges = [], np.arange(0, len(order), LEAF)
    base = (sets.bits[order], sets.size[order], sets.size[order], sets.lost[order])
    while True:
        base = (np.bitwise_or.reduceat(base[0], edges, 0), np.minimum.reduceat(base[1], edges), np.maximum.reduceat(base[2], edges), np.maximum.reduceat(base[3], edges))
        out.append((np.append(np.arange(0, len(order), LEAF * FANOUT ** len(out)), len(order)), *base))
        if len(edges) == 1:
            return out
        edges = np.arange(0, len(edges), FANOUT)


def tree_links(sets: Sets, rows: np.ndarray, num: int, den: int, label: np.ndarray | None = None, split: int | None = None) -> list[tuple[int, int]]:
    """Pairs of positions among ``rows`` that link and connect all that the full set of links connects.

    label: components of all sets known before. split: compare only positions below it with those from it on.
    """
    n = len(rows)
    label = np.arange(len(sets.size)) if label is None else label
    lowest = np.array([sets.tokens[k][0] if len(sets.tokens[k]) else 0 for k in rows], U)
    side = np.zeros(n, np.int64) if split is None else (rows >= split).astype(np.int64)
    order = np.lexsort((lowest, sets.size[rows], side))
    order, side = rows[order], side[order]
    label = label[order].copy()
    levels = _levels(sets, order)
    out: list[tuple[int, int]] = []
    top = len(levels) - 1
    stack = [(top, 0, top, 0)]
    while stack:
        la, a, lb, b = stack.pop()
        first, second = levels[la], levels[lb]
        a0, a1, b0, b1 = first[0][a], first[0][a + 1], second[0][b], second[0][b + 1]
        own = label[a0:a1]
        if (own == own[0]).all() and (label[b0:b1] == own[0]).all():
            continue
        if split is not None and side[a0] == side[a1 - 1] == side[b0] == side[b1 - 1]:
            continue
        if a != b or la != lb:
            if den * min(first[3][a], second[3][b]) < num * max(first[2][a], second[2][b]):
                continue
            most = int(np.bitwise_count(first[1][a] & second[1][b]).sum()) + min(first[4][a], second[4][b])
            if most < _enough(int(first[2][a]), int(second[2][b]), num, den):
                continue
        if la == 0:
            x, y = (v.ravel() for v in np.meshgrid(np.arange(a0, a1), np.arange(b0, b1), indexing="ij"))
            keep = (x < y) & (label[x] != label[y])
            if split is not None:
                keep &= side[x] != side[y]
            x, y = x[keep], y[keep]
            ok = sets.possible(order[x], order[y], num, den)
            for i, j in zip(x[ok].tolist(), y[ok].tolist(), strict=True):
                if label[i] != label[j] and sets.linked(order[i], order[j], num, den):
                    out.append((int(order[i]), int(order[j])))
                    label[label == label[j]] = label[i]
            continue
        kids = range(a * FANOUT, min((a + 1) * FANOUT, len(levels[la - 1][0]) - 1))
        others = range(b * FANOUT, min((b + 1) * FANOUT, len(levels[la - 1][0]) - 1))
        pairs = [(x, y) for x in kids for y in others if x <= y]
        pairs.sort(key=lambda p: p[0] - p[1])  # nodes paired with themselves come off the stack first
        stack += [(la - 1, x, la - 1, y) for x, y in pairs]
    return out


def leaf_links(sets: Sets, groups: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links inside many groups of at most LEAF sets; a pair already connected through others is not looked at again."""
    out: list[tuple[int, int]] = []
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    sizes = np.array([len(g) for g in groups])
    for m in np.unique(sizes):
        held = np.stack([groups[k] for k in np.flatnonzero(sizes == m)])
        i, j = np.triu_indices(m, 1)
        a, b = held[:, i].ravel(), held[:, j].ravel()
        a, b = np.divmod(np.unique(np.minimum(a, b) * len(sets.size) + np.maximum(a, b)), len(sets.size))
        ok = sets.possible(a, b, num, den)
        for x, y in zip(a[ok].tolist(), b[ok].tolist(), strict=True):
            if root(x) != root(y) and sets.linked(x, y, num, den):
                out.append((x, y))
                parent[root(y)] = root(x)
    return out


def stored_tokens(bodies: list[bytes]) -> list[np.ndarray]:
    return [np.sort(np.frombuffer(b, U)) for b in bodies]


Decode = Callable[[list[bytes]], list[np.ndarray]]


def _sets(table: pa.Table, decode: Decode) -> tuple[np.ndarray, Sets, np.ndarray]:
    """Ids of a task's distinct sets, the sets, and which of them each row is."""
    every = table.column("id").to_numpy()
    held = np.flatnonzero(table.column("tokens").is_valid().to_numpy())
    ids, first = np.unique(every[held], return_index=True)
    table = table.take(pa.array(held[first]))
    tokens = decode(table.column("tokens").to_pylist())
    return ids, Sets(np.maximum(table.column("n").to_numpy(), np.array([len(t) for t in tokens], np.int64)), tokens), np.searchsorted(ids, every)


def _links(ids: np.ndarray, found: list[tuple[int, int]]) -> pa.Table:
    give_back()
    return pa.table({"a": pa.array([int(ids[x]) for x, _ in found], pa.int64()), "b": pa.array([int(ids[y]) for _, y in found], pa.int64())})


def cluster_links(held: DataFrame, rows: int, most: int | None, num: int = 75, den: int = 100, decode: Decode = stored_tokens, bundle: int = BUNDLE, together: Column | None = None) -> DataFrame:
    """Links (a, b) that connect similar sets of one cluster.

    held: (id, n, tokens, cluster, m), a row for every set and cluster it is in, each
    once; m is the cluster's number of sets, or more; rows: about how many rows;
    most: the largest m. ``decode`` gives sets' sorted
    distinct 64-bit tokens, and n a set's size where that is larger (tokens no other
    set has may be left out). Small clusters share tasks, those of one value of
    ``together`` always, and of their rows of a set one needs its tokens. A cluster of more than
    BLOCK sets is dealt over blocks of similar size of set: each is linked within,
    then one set per component found is linked across blocks, and lastly the sets
    outside the cluster's largest component, dealt over blocks of their own, meet
    all blocks whose sizes fit. That covers every pair of different components,
    while the sets of one large component are never paired.
    """
    small = held.where((F.col("m") > 1) & (F.col("m") <= BLOCK))
    large = None
    if (most or 0) > BLOCK:
        large = materialize(held.where(F.col("m") > BLOCK), "clustered-sets")
        counts = materialize(large.groupBy("cluster").agg(F.count("*").alias("size")), "large-clusters")
        large = materialize(join_skewed(large.drop("m"), counts.withColumn("m", F.col("size")), "cluster", "size"), "large-sets")
        small = small.unionByName(large.where(F.col("m") <= BLOCK))
        large = large.where(F.col("m") > BLOCK)
    small = small.withColumn("part", F.col("cluster")).withColumn("task", F.pmod(F.xxhash64(F.col("cluster") if together is None else together), F.lit(max(1, rows // bundle))))

    def within(table: pa.Table) -> pa.Table:
        ids, sets, which = _sets(table, decode)
        key = table.column("part").to_numpy()
        order = np.argsort(key, kind="stable")
        groups = [g for g in (np.unique(which[rows]) for rows in np.split(order, np.flatnonzero(np.diff(key[order])) + 1)) if len(g) > 1]
        out = leaf_links(sets, [g for g in groups if len(g) <= LEAF], num, den) if groups else []
        for rows in groups:
            if len(rows) > LEAF:
                out += tree_links(sets, rows, num, den)
        return _links(ids, out)

    links = small.groupBy("task").applyInArrow(within, _LINKS)
    if large is None or large.isEmpty():
        return links
    # sets of linked size lie in the same class of sizes or in neighbouring ones
    band = F.floor(F.log(F.greatest("n", F.octet_length("tokens") / 8 if decode is stored_tokens else F.col("n"), F.lit(1))) / F.log(F.lit(den / num))).cast("int")
    large = large.withColumn("band", band).withColumn("block", F.pmod(F.xxhash64(F.col("id"), F.lit(7)), F.ceil(F.col("m") / BLOCK)).cast("int"))
    inner = materialize(large.withColumn("part", F.lit(0)).groupBy("cluster", "band", "block").applyInArrow(within, _LINKS), "block-links")
    known = _labelled(large, inner)
    # one set per block's component, compared across blocks
    heads = known.dropDuplicates(["cluster", "component"]).select("id", "n", "tokens", "cluster")
    across = materialize(_across(heads, within), "head-links")
    known = materialize(_labelled(large, inner.union(across)), "block-components")
    sizes = materialize(known.groupBy("cluster", "component").count(), "block-component-sizes")
    main = sizes.groupBy("cluster").agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.sum("count").alias("size"))
    tagged = materialize(join_skewed(known, materialize(main, "main-components"), "cluster", "size"), "tagged-sets")
    outer = tagged.where("component <> main")
    # a cluster's outer sets in blocks of their own, whose number follows from theirs
    outside = materialize(outer.groupBy("cluster").agg(F.count("*").alias("r")), "outer-counts")
    tagged, outer = (materialize(join_skewed(t, outside.withColumn("size", F.col("r")), "cluster", "size"), "meeting-sets") for t in (tagged, outer))
    own = F.pmod(F.xxhash64(F.col("id"), F.lit(8)), F.ceil(F.col("r") / BLOCK)).cast("int")
    every = lambda most: F.explode(F.sequence(F.lit(0), F.ceil(most).cast("int") - 1))
    fields = ["id", "n", "tokens", "component", "cluster"]
    side_in = tagged.select(*fields, F.lit(False).alias("outer"), "band", "block", every(F.col("r") / BLOCK).alias("rest"))
    side_out = outer.select(*fields, F.lit(True).alias("outer"), F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)])).alias("band"), own.alias("rest"), "m")
    side_out = side_out.select(*fields, "outer", "band", every(F.col("m") / BLOCK).alias("block"), "rest")

    def meeting(table: pa.Table) -> pa.Table:
        outer = table.column("outer").to_numpy(zero_copy_only=False)
        if outer.all() or not outer.any():
            return _links(np.zeros(0, np.int64), [])
        table = table.take(pa.array(np.argsort(outer, kind="stable")))
        tokens = decode(table.column("tokens").to_pylist())
        sets = Sets(np.maximum(table.column("n").to_numpy(), np.array([len(t) for t in tokens], np.int64)), tokens)
        _, label = np.unique(table.column("component").to_numpy(), return_inverse=True)
        return _links(table.column("id").to_numpy(), tree_links(sets, np.arange(len(tokens)), num, den, label, int((~outer).sum())))

    last = side_in.unionByName(side_out).groupBy("cluster", "band", "block", "rest").applyInArrow(meeting, _LINKS)
    return links.union(inner).union(across).union(last)


def _labelled(large: DataFrame, links: DataFrame) -> DataFrame:
    labels = connected_components(links)
    return large.join(labels, large["id"] == labels["node"], "left").drop("node").withColumn("component", F.coalesce("component", "id"))


def _across(heads: DataFrame, within) -> DataFrame:  # noqa: ANN001
    """Heads linked in groups of a block's size; what stays apart is left to the last step."""
    heads = materialize(heads, "heads")
    n = max(1, heads.count() // BLOCK)
    return heads.withColumn("part", F.col("cluster")).withColumn("task", F.pmod(F.xxhash64("id"), F.lit(n))).groupBy("task").applyInArrow(within, _LINKS)
