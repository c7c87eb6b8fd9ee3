"""Fuzzy line de-duplication across documents: one line stays of every component of near-equal lines.

Lines are compared by their sets of character shingles. A one-permutation MinHash
over 64 bins gives each distinct line its signature, bands of the signature are
looked up corpus-wide (``chunks``), and only lines that share a band with a
different line, or occur again word for word, leave their chunk (the text of a line
that many chunks hold only that of the smallest number). Lines that share
a band are compared by exact Jaccard (bands of the same lines once; large groups
by ``settree``), union-find joins the links, and of each component the first line
in the order of (doc_id, line number) stays. A band that many lines of a chunk
share is one entry of its bucket. Two lines meet if their 32-bit marks differ or a
third line shares the band: one pair of near lines in 2**32 may be missed.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .chunks import OWN, Bucket, Chunk, answered, bucket_count, chunk_from, corpus_bytes, keyed, make_chunks, rejoin, way_count
from .components import connected_components
from .settree import BLOCK, cluster_links
from .shared import give_back, join_skewed, materialize
from .textkit import LOWER, SPACE, Sequences, mix, span_hashes

#: Characters of a shingle; characters of a line that takes part, if nothing else is said.
SHINGLE, MIN_CHARS = 5, 24
NUM, DEN = 75, 100
#: Bins of the signature, bands and rows: a pair at the threshold shares a band with probability 0.96, at 0.8 with 0.99.
BINS, BANDS, ROWS = 64, 12, 5
#: Lines sketched at a time: their arrays stay in a core's cache.
GROUP = 1024
#: Rows that share a task of comparisons when the groups of lines are small.
BUNDLE = 8000
U = np.uint64
#: What an answer is about: a band, a line that this chunk sends on for all, or one that another chunk sends.
BAND, LEADS, FOLLOWS = range(3)
_FOUND = "chunk long, line long, body binary, clusters binary, sizes binary, most long, again boolean, first_doc long, first_no long, first_at long"


def _inside(places: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many of the sorted places lie in each span."""
    return np.searchsorted(places, end) - np.searchsorted(places, start)


class Lines:
    """The lines of a chunk: byte ranges, document, number, hash of the lower-cased bytes; ``eligible`` marks those that take part."""

    def __init__(self, chunk: Chunk, min_chars: int = MIN_CHARS):
        self.data = LOWER[chunk.data]
        n = len(self.data)
        breaks = np.flatnonzero(self.data == 0x0A)
        doc_starts, doc_ends = chunk.offsets[:-1], chunk.offsets[1:]
        self.start = np.concatenate((doc_starts, breaks + 1))
        # a line break at a document's end opens a last, empty line of that document
        owner = np.concatenate((np.arange(len(doc_starts)), np.searchsorted(doc_ends, breaks, "right")))
        order = np.lexsort((self.start, owner))
        self.start, self.doc = self.start[order], owner[order]
        following = np.append(self.start[1:] - 1, n)
        last = np.append(self.doc[1:] != self.doc[:-1], True)
        self.end = np.where(last, doc_ends[self.doc] if len(doc_ends) else following, following)
        self.number = np.arange(len(self.start)) - np.searchsorted(self.doc, self.doc)
        self.hash = span_hashes(self.data, self.start, np.maximum(self.start, self.end)) if len(self.start) else np.zeros(0, U)
        self.chars = self.end - self.start - _inside(np.flatnonzero((self.data & 0xC0) == 0x80), self.start, self.end)
        # a line of nothing but white space never takes part: only lines with such an end on either side can be one
        self.eligible = (self.chars >= min_chars) & (self.end > self.start)
        maybe = np.flatnonzero(self.eligible)
        maybe = maybe[SPACE[self.data[self.start[maybe]]] & SPACE[self.data[self.end[maybe] - 1]]]
        start, end = self.start[maybe], self.end[maybe]
        self.eligible[maybe] = _inside(np.flatnonzero(SPACE[self.data]), start, end) < end - start if len(maybe) else False
        self.rows = np.flatnonzero(self.eligible)

    @cached_property
    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the distinct eligible lines, the first row of each, and which of them each eligible row is."""
        unique, first, inverse = np.unique(self.hash[self.rows], return_index=True, return_inverse=True)
        return unique, self.rows[first], inverse

    def text(self, k: int) -> bytes:
        return self.data[self.start[k] : self.end[k]].tobytes()


def code_points(data: bytes) -> np.ndarray:
    try:
        return np.frombuffer(data.decode().encode("utf-32-le", "surrogatepass"), np.uint32)
    except UnicodeDecodeError:
        return np.frombuffer(data, np.uint8).astype(np.uint32)


def shingle_hashes(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all character shingles of some lines, and the index of each one's line."""
    points = code_points(b"\n".join(lines)) if lines else np.zeros(0, np.uint32)
    breaks = np.flatnonzero(points == 0x0A)
    keep = np.ones(len(points), bool)
    keep[breaks] = False
    first = np.concatenate(([0], breaks - np.arange(len(breaks)), [len(points) - len(breaks)])).astype(np.int64) if lines else np.zeros(1, np.int64)
    seq = Sequences((points[keep].astype(U) + U(1)) * U(0x9E3779B97F4A7C15), first)
    hashed, inside = seq.windows(SHINGLE)
    at = np.flatnonzero(inside)
    return hashed[at], seq.document_of()[at]


def line_tokens(bodies: list[bytes]) -> list[np.ndarray]:
    """The sorted set of each line's shingles, by 48 bits of their hashes."""
    out = []
    for a in range(0, len(bodies), GROUP):
        part = bodies[a : a + GROUP]
        hashed, owner = shingle_hashes(part)
        keys = np.sort(owner.astype(U) << U(48) | hashed >> U(16))
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        keys = keys[new]
        edges = np.searchsorted(keys, np.arange(1, len(part), dtype=U) << U(48))
        out += np.split(keys & U((1 << 48) - 1), edges)
    return out


def filled_bins(signature: np.ndarray) -> np.ndarray:
    """Empty bins take the next full one's value (around the end), moved by a constant for each step."""
    full = signature != np.iinfo(np.uint64).max
    at = np.where(full, np.arange(BINS), 4 * BINS)
    at = np.minimum.accumulate(np.concatenate((at, at + BINS), 1)[:, ::-1], 1)[:, ::-1][:, :BINS]
    steps = at - np.arange(BINS)
    moved = np.take_along_axis(signature, at % BINS, 1) + steps.astype(U) * U(0xD1B54A32D192ED03)
    return np.where(full.any(1, keepdims=True), moved, signature)


def with_shingles(lines: Lines) -> np.ndarray:
    return np.flatnonzero(lines.chars[lines.distinct[1]] >= SHINGLE)


def band_keys(lines: Lines) -> np.ndarray:
    """A key for every band of the distinct lines that have shingles."""
    first = lines.distinct[1][with_shingles(lines)]
    n = len(first)
    out = np.zeros((n, BANDS), U)
    for a in range(0, n, GROUP):
        part = [lines.text(k) for k in first[a : a + GROUP]]
        hashed, owner = shingle_hashes(part)
        signature = np.full(len(part) * BINS, np.iinfo(np.uint64).max, U)
        np.minimum.at(signature, owner * BINS + (hashed >> U(58)).astype(np.int64), hashed)
        signature = signature.reshape(len(part), BINS)
        signature = filled_bins(signature)
        with np.errstate(over="ignore"):
            bands = signature[:, : BANDS * ROWS].reshape(len(part), BANDS, ROWS)
            key = np.tile(np.arange(1, BANDS + 1, dtype=U), (len(part), 1))
            for r in range(ROWS):
                key = mix(key ^ bands[:, :, r])
            out[a : a + GROUP] = key
    return out


def _exact(hashes: np.ndarray) -> np.ndarray:
    return mix(hashes ^ U(0xA0761D6478BD642F))


def _marks(hashes: np.ndarray) -> np.ndarray:
    return mix(hashes) & U(0xFFFFFFFF)


def _keys(chunk: Chunk, min_chars: int) -> tuple[np.ndarray, ...]:
    """A chunk's sorted distinct keys: the bands of its distinct lines, and the lines themselves. For each the least
    32-bit mark of its lines and the span of marks, how many lines it has (a line's own key: occurrences), whether it is
    a line's own, and the sum of the weights of its marks but the least. What stays here: the keys that several lines
    share (one entry in their bucket), and those lines' indexes among the distinct ones."""
    lines = Lines(chunk, min_chars)
    unique, _, inverse = lines.distinct
    near = with_shingles(lines)
    marks = _marks(unique)
    keys, line = band_keys(lines).ravel(), np.repeat(near, BANDS)
    order = np.argsort(keys, kind="stable")
    keys, line = keys[order], line[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    starts = np.flatnonzero(new)
    size = np.diff(np.append(starts, len(keys)))
    if len(starts):
        mark = marks[line]
        low, high = np.minimum.reduceat(mark, starts), np.maximum.reduceat(mark, starts)
        weight = np.add.reduceat(mix(mark), starts) - mix(low)
    else:
        low = high = weight = np.zeros(0, U)
    several = np.repeat(size > 1, size)
    own = _exact(unique)
    times = np.bincount(inverse, minlength=len(unique))
    none = np.zeros(len(own), U)
    every = np.concatenate((keys[starts], own))
    order = np.argsort(every, kind="stable")
    values = [
        np.concatenate((low, none)).astype(np.uint32), np.concatenate((high - low, none)).astype(np.uint32), np.minimum(np.concatenate((size, times)), 65535).astype(np.uint16),
        np.concatenate((np.zeros(len(starts), np.uint8), np.ones(len(own), np.uint8))), np.concatenate((weight, none)),
    ]
    return every[order], *(v[order] for v in values), keys[several], line[several].astype(np.uint32)


def _wanted(bucket: Bucket) -> tuple[np.ndarray, list[np.ndarray]]:
    """Tell about bands of different lines and lines that occur again: the key, the mark of its line here, which of both
    it is (BAND, or for lines LEADS in the chunk of the smallest number and FOLLOWS in others), a number that bands of the
    same lines share, and how many lines (at most) they have."""
    mark, span, count, own, weight = bucket.values
    starts = bucket.starts
    if not len(starts):
        return np.zeros(0, bool), [np.zeros(0, t) for t in (U, np.uint32, np.uint8, U, np.int64)]
    differ = np.minimum.reduceat(mark, starts) != np.maximum.reduceat(mark + span, starts)
    total = np.add.reduceat(count.astype(np.int64), starts)
    # the least mark leads the number, so that clusters that share their first line can share a task
    lines = mix(np.add.reduceat(mix(mark.astype(U)) + weight, starts))
    cluster = np.minimum.reduceat(mark, starts).astype(U) << U(32) | lines >> U(32)
    group = bucket.group()
    home = np.array(bucket.chunks, np.int64)[bucket.owner]
    role = np.where(own == 0, BAND, np.where(home == np.minimum.reduceat(home, starts)[group], LEADS, FOLLOWS)).astype(np.uint8)
    return np.where(own[starts].astype(bool), total > 1, differ)[group], [bucket.keys[group], mark, role, cluster[group], total[group]]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with near-repeated lines taken out of the texts, and columns ``_n_lines`` and ``_n_removed``.

    Lines are what line feeds separate. Lines of at least min_chars characters that are
    not all white space link when they are equal (A-Z lower-cased) or NUM/DEN or more of
    their character shingles agree; of each component the first in (doc_id, line number)
    stays. Blank lines stay, however long. Kept lines are joined by line feeds, so a
    document without removals is unchanged. Empty texts stay; a null text becomes empty.
    A row without an id keeps its text and takes no part. Of rows that repeat an id, the
    first by chunk and place there goes before the others, so that one copy of a line
    stays. Empty table: empty.
    """
    rest = [c for c in docs.columns if c not in (id_col, text_col, "_n_lines", "_n_removed")]
    renamed = docs.select(F.col(id_col), F.col(text_col), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(rest)])
    chunks = make_chunks(renamed, id_col, text_col, carry=tuple(f"c{k}" for k in range(len(rest))), level=3)
    buckets = bucket_count(corpus_bytes(chunks) / 12)
    ways = way_count(buckets)

    def gather(chunk: Chunk, got: dict) -> pa.Table:
        lines = Lines(chunk, min_chars)
        unique, first, inverse = lines.distinct
        shared_key, shared_line = got.pop(OWN, [np.zeros(0, U), np.zeros(0, np.uint32)])
        key, mark, role, cluster, size = (np.concatenate([g[k] for g in got.values()] or [np.zeros(0, t)]).astype(t) for k, t in ((1, U), (2, U), (3, np.uint8), (4, U), (5, np.int64)))
        exact = _exact(unique)
        order = np.argsort(exact)
        again, elsewhere = (order[np.searchsorted(exact[order], key[at])] for at in (role != BAND, role == FOLLOWS))
        # (line, cluster, size) of bands: of one line here, by its mark, or of several, which the chunk kept
        key, mark, cluster, size = (x[role == BAND] for x in (key, mark, cluster, size))
        many = np.isin(key, shared_key)
        marks = _marks(unique)
        by_mark = np.argsort(marks)
        near = [(by_mark[x], cluster[~many][y], size[~many][y]) for x, y in [_matches(marks[by_mark], mark[~many])]]
        near += [(shared_line[x], cluster[many][y], size[many][y]) for x, y in [_matches(shared_key, key[many])]]
        line, cluster, size = (np.concatenate([n[k] for n in near]) for k in range(3))
        # a line of several chunks has the same bands in each: one of them sends it on
        mine = ~np.isin(line, elsewhere)
        line, cluster, size = line[mine], cluster[mine], size[mine]
        order = np.lexsort((cluster, line))
        line, cluster, size = line[order], cluster[order], size[order]
        new = np.ones(len(line), bool)
        new[1:] = (line[1:] != line[:-1]) | (cluster[1:] != cluster[:-1])
        line, cluster, size = line[new], cluster[new], size[new]
        out = np.unique(np.concatenate((again, line)))
        edges = np.append(np.searchsorted(line, out), len(line))
        ends = np.searchsorted(line, out, "right")
        # the first occurrence here, by (doc_id, line number)
        where = np.lexsort((lines.number[lines.rows], chunk.ids[lines.doc[lines.rows]], inverse))
        rows = lines.rows[where[np.searchsorted(inverse[where], out)]]
        spans = [slice(edges[k], ends[k]) for k in range(len(out))]
        return pa.table(
            [
                pa.array(np.full(len(out), chunk.number, np.int64)), pa.array(unique[out].view(np.int64)),
                pa.array([lines.text(first[k]) if x.start < x.stop else None for k, x in zip(out, spans, strict=True)], pa.binary()),
                pa.array([cluster[x].tobytes() for x in spans], pa.binary()), pa.array([size[x].tobytes() for x in spans], pa.binary()),
                pa.array([int(size[x].max(initial=0)) for x in spans], pa.int64()), pa.array(np.isin(out, again)), pa.array(chunk.ids[lines.doc[rows]]), pa.array(lines.number[rows].astype(np.int64)),
                pa.array(lines.doc[rows].astype(np.int64)),
            ],
            [x.split()[0] for x in _FOUND.split(", ")],
        )

    answers = answered(keyed(chunks, ways, lambda c: _keys(c, min_chars), own=2), chunks, buckets, ways, _wanted)
    found = materialize(rejoin(chunks, answers, gather, _FOUND), "repeated-lines")
    near = found.where("body is not null")
    seen = near.agg(F.coalesce(F.sum(F.octet_length("clusters") / 8), F.lit(0)).cast("long").alias("rows"), F.max("most").alias("most")).first()
    links = materialize(cluster_links(_clustered(near), seen["rows"], seen["most"], NUM, DEN, line_tokens, BUNDLE, F.shiftrightunsigned("cluster", 32)), "line-links")
    labels = materialize(connected_components(links), "line-labels")
    # the first of each line, then of each component, wherever there are several; hot components are met by broadcast
    first = found.groupBy("line").agg(F.min(F.struct("first_doc", "first_no", "chunk", "first_at")).alias("first"), F.count("*").alias("n"), F.bool_or("again").alias("again"))
    first = first.join(labels, first["line"] == labels["node"], "left").where("again or n > 1 or component is not null")
    first = materialize(first.select("line", "first", "n", F.coalesce("component", "line").alias("component")), "first-lines")
    keepers = materialize(first.groupBy("component").agg(F.min("first").alias("keep"), F.count("*").alias("size")), "line-keepers")
    kept_of = materialize(join_skewed(first.select("line", "n", "component"), keepers, "component", "size"), "kept-lines")
    decided = join_skewed(found.select("chunk", "line"), kept_of.select("line", "n", F.col("keep.first_no").alias("keep_no"), F.col("keep.chunk").alias("keep_chunk"), F.col("keep.first_at").alias("keep_at")), "line", "n")
    kinds = [docs.schema[c] for c in rest]
    schema = StructType([StructField("id", LongType()), docs.schema[text_col], *[StructField(f"c{k}", f.dataType) for k, f in enumerate(kinds)], StructField("_n_lines", LongType()), StructField("_n_removed", LongType())])

    def rebuild(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = [_rebuilt(chunk_from(row), right) for row in left.to_pylist()]
        give_back()
        return pa.concat_tables(out) if out else empty

    def _rebuilt(chunk: Chunk, told: pa.Table) -> pa.Table:
        lines = Lines(chunk, min_chars)
        hashes = told.column("line").to_numpy().view(U)
        order = np.argsort(hashes)
        hashes = hashes[order]
        number, home, place = (told.column(c).to_numpy()[order] for c in ("keep_no", "keep_chunk", "keep_at"))
        gone = np.zeros(len(lines.start), bool)
        if len(hashes):
            at = np.minimum(np.searchsorted(hashes, lines.hash), len(hashes) - 1)
            hit = lines.eligible & (hashes[at] == lines.hash)
            gone = hit & ((home[at] != chunk.number) | (lines.doc != place[at]) | (lines.number != number[at]))
        total = np.bincount(lines.doc, minlength=len(chunk))
        removed = np.bincount(lines.doc[gone], minlength=len(chunk))
        edges = np.searchsorted(lines.doc, np.arange(len(chunk) + 1))
        texts = []
        for k in range(len(chunk)):
            if not removed[k]:
                texts.append(chunk.text(k).decode("utf-8", "replace"))
            else:
                span = range(edges[k], edges[k + 1])
                texts.append(b"\n".join(chunk.data[lines.start[j] : lines.end[j]].tobytes() for j in span if not gone[j]).decode("utf-8", "replace"))
        carried = [] if chunk.rest is None else chunk.rest.columns
        return pa.table([pa.array(chunk.ids), pa.array(texts, pa.string()), *carried, pa.array(total.astype(np.int64)), pa.array(removed.astype(np.int64))], names=schema.names)

    from pyspark.sql.pandas.types import to_arrow_schema

    empty = to_arrow_schema(schema).empty_table()
    kept = chunks.select("chunk", "ids", "sizes", "body", "rest").groupBy("chunk").cogroup(decided.groupBy("chunk")).applyInArrow(rebuild, schema)
    back = {f"c{k}": c for k, c in enumerate(rest)}
    original = docs.drop("_n_lines", "_n_removed").columns
    names = {id_col: F.col("id").cast(docs.schema[id_col].dataType), text_col: F.col(text_col)} | {c: F.col(k) for k, c in back.items()}
    done = kept.select(*[names[c].alias(c) for c in original], "_n_lines", "_n_removed")
    alone = docs.where(F.col(id_col).isNull()).select(*[F.col(f"`{c}`") for c in original], (F.length(F.col(text_col)) - F.length(F.translate(F.col(text_col), "\n", "")) + 1).cast("long").alias("_n_lines"), F.lit(0).cast("long").alias("_n_removed"))
    return done.unionByName(alone)


def _matches(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions (in sorted keys, in asked) that are equal."""
    low, high = np.searchsorted(keys, asked), np.searchsorted(keys, asked, "right")
    n = high - low
    y = np.repeat(np.arange(len(asked)), n)
    return np.arange(len(y)) - np.repeat(np.cumsum(n) - n - low, n), y


def _clustered(near: DataFrame) -> DataFrame:
    """(id, n, tokens, cluster, m): each distinct line once for every group of lines that share a band. A line has one row
    in ``near``, from the chunk that sends it on. Clusters of one least mark share a task: the first of them has the text."""
    sets = near.select("line", "body", "clusters", "sizes")

    def explode(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            clusters = [np.frombuffer(b, np.int64) for b in batch.column(2).to_pylist()]
            sizes = [np.frombuffer(b, np.int64) for b in batch.column(3).to_pylist()]
            row = np.repeat(np.arange(batch.num_rows), [len(c) for c in clusters])
            none = np.zeros(0, np.int64)
            cluster, size = np.concatenate([*clusters, none]), np.concatenate([*sizes, none])
            few = np.flatnonzero((size > 1) & (size <= BLOCK))
            home = cluster.view(U) >> U(32)
            few = few[np.lexsort((home[few], row[few]))]
            same = np.zeros(len(few), bool)
            same[1:] = (row[few[1:]] == row[few[:-1]]) & (home[few[1:]] == home[few[:-1]])
            spared = np.zeros(len(row), bool)
            spared[few[same]] = True
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(np.zeros(len(row), np.int64)), batch.column(1).take(pa.array(row, mask=spared)), pa.array(cluster), pa.array(size)],
                ["id", "n", "tokens", "cluster", "m"],
            )

    return sets.mapInArrow(explode, "id long, n long, tokens binary, cluster long, m long")
