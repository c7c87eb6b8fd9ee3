"""Near-duplicate vectors by randomised-rotation binary codes with stored correction factors.

A unit vector o is rotated and kept as the signs of its coordinates (the code x)
with the factor <x, o>. For another rotated vector q, <x, q> / <x, o> estimates
<o, q> without bias, with a confidence bound that only depends on the factor and
the dimension. Vectors meet in buckets of leading bits of further rotations; of a
bucket's pairs, those whose upper bounds (both ways) reach the threshold are
recomputed exactly in double precision, in the same task.

No pair leaves its task. Two vectors that share several buckets are compared in
the one of the first table they share, which their keys tell, so a task can count
links by vector and thin them to a forest: a bucket gives at most one row for
each of its vectors, however many of them link. Equal vectors are one class and
stand in no pair with each other. The number of bits of a bucket key grows with
the logarithm of the number of classes, so buckets keep their size; the number of
tables follows from the wanted recall at the threshold itself. Buckets above
``BLOCK`` are dealt over pairs of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, forest
from .shared import join_skewed, materialize, parts

THRESHOLD, RECALL = 0.9, 0.98
#: Width of the confidence bound, in standard deviations of the estimate's error.
EPSILON = 4.5
#: Vectors of a bucket that one task compares; members a bucket has on average: comparing them is cheap beside sending a
#: vector to another table, and larger buckets need fewer tables.
BLOCK, OCCUPANCY = 1024, 256
#: Rows a task holds on average; buckets above BLOCK that are told to all tasks (beyond that: a join).
TASK_ROWS, TOLD = 1 << 16, 100_000
SEED = 11


def rotations(dim: int, count: int, seed: int = SEED) -> list[np.ndarray]:
    """Random orthogonal matrices, the same on every worker."""
    out = []
    for k in range(count):
        q, r = np.linalg.qr(np.random.default_rng([seed, dim, k]).standard_normal((dim, dim)))
        out.append(q * np.sign(np.diag(r)))
    return out


def tables_for(classes: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a key, tables): two vectors at the threshold share some key with probability ``recall``."""
    bits = int(np.clip(round(math.log2(max(2, classes) / OCCUPANCY)), 6, 60))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(4, math.ceil(math.log(1 - recall) / math.log1p(-same)))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, dim, digest, vector): finite, non-zero vectors as float64 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            start, size = lists.offsets.to_numpy()[:-1], np.diff(lists.offsets.to_numpy())
            values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # a null component becomes NaN
            there = np.array(ids.is_valid()) & np.array(lists.is_valid()) & (size > 0)
            for dim in np.unique(size[there]):
                rows = np.flatnonzero(there & (size == dim))
                x = values[start[rows][:, None] + np.arange(dim)]
                good = np.isfinite(x).all(1) & x.any(1)
                rows, data = rows[good], [v.tobytes() for v in x[good]]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows)), pa.array(np.full(len(rows), dim, np.int32)), pa.array([xxhash.xxh3_128_digest(v) for v in data], pa.binary()), pa.array(data, pa.binary())],
                    ["vec_id", "dim", "digest", "vector"],
                )

    return vectors.select(F.col(id_col).cast("long"), F.col(vector_col)).mapInArrow(run, "vec_id long, dim int, digest binary, vector binary")


def unit(vectors: np.ndarray) -> np.ndarray:
    top = np.abs(vectors).max(1, keepdims=True)
    scaled = vectors / top
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def narrow(vector: np.ndarray) -> bytes:
    """The vector as float32 where that loses nothing, else as float64."""
    with np.errstate(over="ignore"):
        small = vector.astype(np.float32)
    return small.tobytes() if (small == vector).all() else vector.tobytes()


def widened(data: list[bytes], dim: int) -> np.ndarray:
    """Rows of float64, from what ``narrow`` gave."""
    return np.stack([np.frombuffer(v, np.float32 if len(v) == 4 * dim else np.float64).astype(np.float64) for v in data])


def coded(reps: DataFrame, bits: int, tables: int) -> DataFrame:
    """A row for every class: vector, code, correction factor, its bucket in each table, and all these keys as packed bits."""
    schema = "rep long, dim int, members long, vector binary, code binary, factor float, keys array<long>, signature binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turned: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                full = np.stack([np.frombuffer(batch.column(3)[int(k)].as_py(), np.float64) for k in at])
                x = unit(full)
                if dim not in turned:
                    turned[dim] = rotations(int(dim), 1 + -(-bits * tables // int(dim)))
                first, *others = turned[dim]
                r = x @ first
                factor = np.abs(r).sum(1) / math.sqrt(dim)
                signs = np.concatenate([x @ o > 0 for o in others], 1)[:, : bits * tables]
                keys = signs.reshape(len(at), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at)), pa.array(np.full(len(at), dim, np.int32)), batch.column(2).take(pa.array(at)), pa.array([narrow(v) for v in full], pa.binary()),
                        pa.array([c.tobytes() for c in np.packbits(r > 0, axis=1)], pa.binary()), pa.array(factor.astype(np.float32)),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * tables), pa.array(keys.reshape(-1))),
                        pa.array([c.tobytes() for c in np.packbits(signs, axis=1)], pa.binary()),
                    ],
                    [c.split()[0] for c in schema.split(", ")],
                )

    return reps.select("rep", "dim", "members", "vector").mapInArrow(run, schema)


def promising(code: np.ndarray, factor: np.ndarray, query: np.ndarray, threshold: float) -> np.ndarray:
    """Matrix of pairs whose confidence intervals, each way, reach the threshold.

    The error of an estimate scales with the sine between the vectors; of pairs
    that count it is at most the sine at the threshold. 0.001 covers single precision.
    """
    dim = query.shape[1]
    estimate = (code @ query.T) / math.sqrt(dim) / factor[:, None]
    sine = math.sqrt(max(0.0, 1 - threshold**2))
    bound = EPSILON * sine * np.sqrt((1 - factor**2).clip(0) / factor**2) / math.sqrt(max(1, dim - 1)) + 0.001
    return (estimate + bound[:, None] >= threshold) & (estimate.T + bound[None, :] >= threshold)


def cosines(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines in double precision of rows a and b of x, 100,000 pairs at a time. Powers of two keep squares in range."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    out = [np.einsum("ij,ij->i", x[a[k : k + 100_000]], x[b[k : k + 100_000]]) for k in range(0, len(a), 100_000)]
    return np.concatenate([np.zeros(0), *out]) / (norm[a] * norm[b])


def linked(codes: DataFrame, bits: int, tables: int, rows: int, threshold: float) -> DataFrame:
    """(rep, root, others) for every bucket a class has links in: the smallest class these reach, and the vectors behind
    its links. A link of two classes counts in one bucket only. ``rows`` is the number of classes."""
    spark, key = codes.sparkSession, ["table", "dim", "key"]
    sent = codes.select("rep", "dim", "members", "vector", "code", "factor", "signature", F.posexplode("keys").alias("table", "key"))
    big = materialize(codes.select("dim", F.posexplode("keys").alias("table", "key")).groupBy(*key).agg(F.count("*").alias("m")).where(F.col("m") > BLOCK), "vector-buckets")
    held = sent.join(F.broadcast(big) if big.count() <= TOLD else big, key, "left").withColumn("blocks", F.ceil(F.coalesce("m", F.lit(1)) / BLOCK).cast("int"))
    held = held.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    held = held.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    held = held.withColumn("group", F.xxhash64(*key, "low", "high"))
    width = max(parts(spark), -(-rows * tables // TASK_ROWS))
    held = held.select("group", "table", "dim", "own", "low", "high", "rep", "members", "vector", "code", "factor", "signature", F.when(F.col("blocks") > 1, F.col("group")).otherwise(F.pmod("group", F.lit(width))).alias("task"))
    weights = 1 << np.arange(bits, dtype=np.int64)

    def run(table: pa.Table) -> pa.Table:
        group, number, dims, own, low, high, rep, members, factor = (table.column(c).to_numpy() for c in ("group", "table", "dim", "own", "low", "high", "rep", "members", "factor"))
        vector, code, signature = (table.column(c).to_pylist() for c in ("vector", "code", "signature"))
        order = np.lexsort((dims, number, group))
        new = (np.diff(group[order]) != 0) | (np.diff(number[order]) != 0) | (np.diff(dims[order]) != 0)
        turned: dict[int, np.ndarray] = {}
        found = [(np.zeros(0, np.int64),) * 3]
        for at in np.split(order, np.flatnonzero(new) + 1):
            if len(at) < 2:
                continue
            dim, t = int(dims[at[0]]), int(number[at[0]])
            if dim not in turned:
                turned[dim] = rotations(dim, 1)[0]
            x = widened([vector[k] for k in at], dim)
            query = (unit(x) @ turned[dim]).astype(np.float32)
            signs = np.unpackbits(np.stack([np.frombuffer(code[k], np.uint8) for k in at]), axis=1)[:, :dim].astype(np.float32) * 2 - 1
            fits = np.triu(promising(signs, factor[at].astype(np.float32), query, threshold), 1)
            if low[at[0]] != high[at[0]]:
                fits &= own[at][:, None] != own[at][None, :]
            a, b = np.nonzero(fits)
            packed = np.stack([np.frombuffer(signature[k], np.uint8) for k in at])
            keys = np.unpackbits(packed, axis=1)[:, : bits * tables].reshape(len(at), tables, bits) @ weights
            for k in range(t + 1):  # this is the first table the two share
                meet = (keys[a, k] == keys[b, k]) == (k == t)
                a, b = a[meet], b[meet]
            near = cosines(x, a, b) >= threshold
            a, b = a[near], b[near]
            if not len(a):
                continue
            own_rep, weight = rep[at], members[at]
            others = np.bincount(a, weight[b], len(at)).astype(np.int64) + np.bincount(b, weight[a], len(at)).astype(np.int64)
            nodes = np.sort(own_rep[others > 0])
            root = nodes.copy()
            far, least = forest(own_rep[a], own_rep[b])
            root[np.searchsorted(nodes, far)] = least
            by = np.argsort(own_rep)
            found.append((nodes, root, others[by][others[by] > 0]))
        return pa.table({c: pa.array(np.concatenate(v)) for c, v in zip(("rep", "root", "others"), zip(*found, strict=True), strict=True)})

    return held.groupBy("task").applyInArrow(run, "rep long, root long, others long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row with an id.

    Links: cosine of at least ``threshold``. A vector that is null, empty, zero, or
    holds null or non-finite components links with nothing; vectors of different
    dimensions do not link. Equal vectors link with each other and share their
    links. Rows repeating an id count as vectors of their own. Empty table: empty.
    """
    found = materialize(usable(vectors, id_col, vector_col), "vectors")
    reps = found.groupBy("digest", "dim").agg(F.min("vec_id").alias("least"), F.count("*").alias("members"), F.max("vector").alias("vector"))
    reps = materialize(reps.withColumn("rep", F.monotonically_increasing_id()), "vector-classes")  # ids may repeat, class numbers do not
    rows = reps.count()
    bits, tables = tables_for(rows, threshold)
    codes = materialize(coded(reps, bits, tables), "vector-codes")
    links = materialize(linked(codes, bits, tables, rows, threshold), "vector-links")
    others = links.groupBy("rep").agg(F.sum("others").alias("others"))
    labels = connected_components(links.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    labels = materialize(labels.join(reps.select("rep", "least"), "rep"), "vector-labels")
    heads = materialize(labels.groupBy("component").agg(F.min("least").alias("head"), F.count("*").alias("n")), "vector-heads")
    headed = join_skewed(labels.select("rep", "component"), heads, "component", "n").select("rep", "head")
    classes = reps.join(others, "rep", "left").join(headed, "rep", "left")
    classes = classes.select("digest", "dim", "members", (F.col("members") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("head", "least").alias("component"))
    told = join_skewed(found.select("vec_id", F.struct("digest", "dim").alias("class")), materialize(classes.select(F.struct("digest", "dim").alias("class"), "members", "n_links", "component"), "vector-answers"), "class", "members")
    told = told.select("vec_id", "n_links", "component")
    rest = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"))
    rest = rest.join(told.select("vec_id").distinct(), "vec_id", "left_anti").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component"))
    return told.unionByName(rest).select(F.col("vec_id").alias(id_col), "n_links", F.col("component").alias("component_id"), (F.col("vec_id") == F.col("component")).alias("kept"))
