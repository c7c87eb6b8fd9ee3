"""Exact corpus-wide lookups for bulky keys (word windows, n-grams, sketches).

A *chunk* is a bundle of documents of a few megabytes, written once to the shared
folder; its number is stable from then on. To learn something about every key of
the corpus:

1. each chunk sends its distinct keys with local values, one packed row for each
   bucket of the key space (keys sorted and delta-coded: a few bytes each);
2. each bucket merges the rows of all chunks and answers every chunk about those
   of its keys that some other chunk or document has too;
3. each chunk meets its answers and goes on with its documents at hand.

A key has one entry per chunk however often it occurs, so a key that a third of
all rows share is spread over the chunks and costs its bucket one entry per chunk.
The number of buckets follows the measured size of the corpus, never a constant.

Chunks times buckets grows with the square of the corpus. Above DIRECT buckets keys
therefore take two hops: a chunk parts its keys by as many *ways* as the root of the
number of buckets, each way of a bundle of chunks (as many as ways) is merged and
dealt on to its buckets, and answers go back the same two hops. A chunk then costs
rows in proportion to that root, each hop's task holds about as many keys as a chunk,
and a lookup gives the same answers either way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .shared import give_back, materialize, small_batches

#: Text bytes of a chunk (one longer document makes a chunk of its own) and keys of a bucket.
CHUNK_BYTES, BUCKET_KEYS = 6 << 20, 1_500_000
#: Buckets up to which a chunk writes to each of them itself.
DIRECT = 4096
CHUNK_SCHEMA = "chunk long, n_docs int, n_bytes long, ids binary, sizes binary, body binary, rest binary"
_KEYED = "bucket int, chunk long, body binary"
_ANSWER = "chunk long, bucket int, body binary"
U = np.uint64


# --- packing of arrays -----------------------------------------------------------------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed byte planes."""
    head, planes = [len(arrays)], []
    for a in arrays:
        head += [len(a), "?bBhHiIqQd".index(a.dtype.char if a.dtype.char not in "lL" else {"l": "q", "L": "Q"}[a.dtype.char])]
        planes.append(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b"")
    return zstandard.ZstdCompressor(level=1).compress(np.array(head, np.int64).tobytes() + b"".join(planes))


def unpack(body: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(body)
    k = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * k, 8)
    at, out = 8 + 16 * k, []
    for n, kind in head.reshape(k, 2):
        dtype = np.dtype("?bBhHiIqQd"[kind])
        size = int(n) * dtype.itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, size, at).reshape(dtype.itemsize, int(n)).T).view(dtype).reshape(int(n)))
        at += size
    return out


def pack_keys(keys: np.ndarray, *values: np.ndarray) -> bytes:
    """Sorted keys as differences, and a value of each."""
    return pack(np.diff(keys, prepend=U(0)), *values)


def unpack_keys(body: bytes) -> list[np.ndarray]:
    gaps, *values = unpack(body)
    return [np.cumsum(gaps, dtype=U), *values]


# --- chunks ----------------------------------------------------------------------------------------------------


@dataclass
class Chunk:
    """Some documents: ids (position of a missing one: see ``known``), and their bytes one after another."""

    number: int
    ids: np.ndarray
    data: np.ndarray
    offsets: np.ndarray
    rest: pa.Table | None = None

    def text(self, k: int) -> bytes:
        return self.data[self.offsets[k] : self.offsets[k + 1]].tobytes()

    def __len__(self) -> int:
        return len(self.ids)


def _chunk_row(number: int, ids: list[np.ndarray], texts: list[bytes], sizes: list[np.ndarray], rest: list[pa.RecordBatch], level: int) -> pa.RecordBatch:
    i, z, body = np.concatenate(ids), np.concatenate(sizes), b"".join(texts)
    cells = [number, len(i), len(body), i.astype(np.int64).tobytes(), z.astype(np.int64).tobytes(), zstandard.ZstdCompressor(level=level).compress(body), _stored(rest)]
    kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], [x.split()[0] for x in CHUNK_SCHEMA.split(", ")])


def _stored(rest: list[pa.RecordBatch]) -> bytes | None:
    if not rest or not rest[0].num_columns:
        return None
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rest[0].schema) as out:
        for batch in rest:
            out.write_batch(batch)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes())


def make_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, carry: tuple[str, ...] = (), level: int = 5) -> DataFrame:
    """Bundle (id, text) and the columns to carry into chunk rows, written to the shared folder. Null texts are empty;
    rows without an id are left out."""
    from .textkit import string_buffers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        texts: list[bytes] = []
        sizes: list[np.ndarray] = []
        rest: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = string_buffers(batch.column(1))
            i = 0
            while i < len(own):
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + chunk_bytes - held, "right")) - 1)
                ids.append(own[i:j])
                sizes.append(np.diff(offsets[i : j + 1]))
                texts.append(data[offsets[i] : offsets[j]].tobytes())
                rest.append(pa.RecordBatch.from_arrays([c.slice(i, j - i) for c in batch.columns[2:]], batch.schema.names[2:]))
                held += len(texts[-1])
                i = j
                if held >= 0.9 * chunk_bytes:
                    yield _chunk_row(part << 32 | seq, ids, texts, sizes, rest, level)
                    ids, texts, sizes, rest, held, seq = [], [], [], [], 0, seq + 1
        if ids:
            yield _chunk_row(part << 32 | seq, ids, texts, sizes, rest, level)
        ids, texts, sizes, rest = [], [], [], []
        give_back()

    chosen = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), *[F.col(c) for c in carry])
    return materialize(small_batches(chosen).mapInArrow(run, CHUNK_SCHEMA), "chunks")


def chunks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    for batch in batches:
        for row in batch.select(["chunk", "ids", "sizes", "body"]).to_pylist():
            yield chunk_from(row)


def chunk_from(row: dict) -> Chunk:
    sizes = np.frombuffer(row["sizes"], np.int64)
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["body"]), np.uint8) if len(row["body"]) else np.zeros(0, np.uint8)
    rest = row.get("rest")
    table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(rest)).read_all() if rest else None
    return Chunk(row["chunk"], np.frombuffer(row["ids"], np.int64), data, np.concatenate(([0], np.cumsum(sizes))).astype(np.int64), table)


def corpus_bytes(chunks: DataFrame) -> int:
    return chunks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n")).first()["n"]


def bucket_count(expected_keys: float) -> int:
    """A power of two, so that a bucket is a prefix of the key's bits; each holds about BUCKET_KEYS keys."""
    return 1 << max(3, int(np.ceil(np.log2(max(1.0, expected_keys / BUCKET_KEYS)))))


def way_count(buckets: int) -> int:
    """By how many leading values a chunk parts its keys: the buckets, or above DIRECT of them the root of their number."""
    return buckets if buckets <= DIRECT else 1 << (buckets.bit_length() // 2)


def by_bucket(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """The slices of sorted keys for each bucket (the leading bits) that has any."""
    if not len(keys):
        return
    shift = 64 - int(buckets).bit_length() + 1
    low, high = (int(keys[k]) >> shift for k in (0, -1))
    edges = np.searchsorted(keys, np.arange(low + 1, high + 1, dtype=U) << U(shift)) if high > low else np.zeros(0, np.int64)
    edges = np.concatenate(([0], edges, [len(keys)]))
    for b in range(high - low + 1):
        if edges[b] < edges[b + 1]:
            yield low + b, slice(int(edges[b]), int(edges[b + 1]))


def key_rows(number: int, ways: int, keys: np.ndarray, values: list[np.ndarray]) -> list[tuple[int, int, bytes]]:
    """What a chunk (or bundle) of this number sends: a row for each way that has any of its sorted keys."""
    return [(b, number, pack_keys(keys[s], *(v[s] for v in values))) for b, s in by_bucket(keys, ways)]


def keyed(chunks: DataFrame, ways: int, emit: Callable[[Chunk], tuple[np.ndarray, ...]], own: int = 0) -> DataFrame:
    """Rows (bucket, chunk, body): ``emit`` gives a chunk's sorted distinct keys and their local values.

    With ``own``, its last so many arrays are no values: the chunk sends them to itself,
    past the buckets (answers of bucket OWN), and spares computing them again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks_of(batches):
            keys, *values = emit(chunk)
            values, kept = values[: len(values) - own], values[len(values) - own :]
            rows = [(OWN - chunk.number % ways, chunk.number, pack(*kept))] if own else []
            yield packed_rows(rows + key_rows(chunk.number, ways, keys, values))
        give_back()

    return chunks.select("chunk", "ids", "sizes", "body").mapInArrow(run, _KEYED)


def packed_rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "chunk", "body"])


@dataclass
class Bucket:
    """All entries of a bucket, sorted by key: which group (equal keys) and which chunk row each belongs to."""

    number: int
    chunks: list[int]
    keys: np.ndarray  # distinct
    starts: np.ndarray  # of each distinct key's entries
    owner: np.ndarray  # index into chunks
    place: np.ndarray  # index in the owner's list
    values: list[np.ndarray]

    def per_key(self, how: np.ufunc, k: int) -> np.ndarray:
        return how.reduceat(self.values[k], self.starts) if len(self.starts) else self.values[k][:0]

    def group(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts)), np.diff(np.append(self.starts, len(self.owner))))


def merged(number: int, chunk_numbers: list[int], bodies: list[bytes]) -> Bucket:
    lists = [unpack_keys(b) for b in bodies]
    keys = np.concatenate([x[0] for x in lists])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    owner = np.repeat(np.arange(len(lists)), [len(x[0]) for x in lists])[order]
    place = np.concatenate([np.arange(len(x[0])) for x in lists])[order]
    values = [np.concatenate([x[1 + k] for x in lists])[order] for k in range(len(lists[0]) - 1)]
    return Bucket(number, list(chunk_numbers), keys[starts], starts, owner, place, values)


#: The chunk number of rows that tell about a bucket as a whole; buckets of this number and below carry what chunks send to themselves.
SUMMARY, OWN = -1, -1


def answered(
    rows: DataFrame, chunks: DataFrame, buckets: int, ways: int, answer: Callable[[Bucket], tuple[np.ndarray, list[np.ndarray]]], summary: Callable[[Bucket], list[np.ndarray]] | None = None
) -> DataFrame:
    """(chunk, bucket, body): ``answer`` gives a mask of a bucket's entries to tell about and per-entry values; they come
    back by the way (column bucket) their keys took. ``summary`` adds a row about the whole bucket, its chunk number SUMMARY."""

    def run(table: pa.Table) -> pa.Table:
        number = table.column("bucket")[0].as_py()
        if number <= OWN:
            return pa.table({"chunk": table.column("chunk"), "bucket": pa.array([OWN] * table.num_rows, pa.int32()), "body": table.column("body")})
        got = merged(number, table.column("chunk").to_pylist(), table.column("body").to_pylist())
        senders, sender, back = got.chunks, got.owner, [got.place.astype(np.int64)]
        if ways < buckets:  # the senders are bundles: their entries tell chunk and place
            chunk, place, *got.values = got.values
            numbers, got.owner = np.unique(chunk, return_inverse=True)
            got.chunks, got.place, back = numbers.tolist(), place, [chunk, place]
        told, values = answer(got)
        at = np.flatnonzero(told)
        at = at[np.argsort(sender[at], kind="stable")]  # entries are in the order of their keys, so places rise
        edges = np.searchsorted(sender[at], np.arange(len(senders) + 1))
        out = [(SUMMARY, got.number, pack(*summary(got)))] if summary else []
        for c, sent_by in enumerate(senders):
            mine = at[edges[c] : edges[c + 1]]
            if len(mine):
                out.append((sent_by, got.number * ways // buckets, pack(*(v[mine] for v in back), *(v[mine] for v in values))))
        del got, told, values, at, back
        give_back()
        return _answers(out)

    if ways == buckets:
        return rows.groupBy("bucket").applyInArrow(run, _ANSWER)
    return _handed_back(_dealt(rows, chunks.count(), buckets, ways).groupBy("bucket").applyInArrow(run, _ANSWER))


def _answers(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table({"chunk": pa.array([r[0] for r in rows], pa.int64()), "bucket": pa.array([r[1] for r in rows], pa.int32()), "body": pa.array([r[2] for r in rows], pa.binary())})


def _dealt(rows: DataFrame, n_chunks: int, buckets: int, ways: int) -> DataFrame:
    """The second hop: of each way, the rows of a bundle of chunks go on as one row for each bucket, its entries with chunk and place."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        way, bundle = (k.as_py() for k in key)
        if way <= OWN:
            return table.select(["bucket", "chunk", "body"])
        got = merged(way, table.column("chunk").to_pylist(), table.column("body").to_pylist())
        chunk = np.array(got.chunks, np.int64)[got.owner]
        out = key_rows(bundle, buckets, got.keys[got.group()], [chunk, got.place.astype(np.int64), *got.values])
        del got
        give_back()
        return pa.Table.from_batches([packed_rows(out)])

    bundles = max(1, -(-n_chunks // ways))
    return rows.withColumn("bundle", F.pmod(F.xxhash64("chunk"), F.lit(bundles))).groupBy("bucket", "bundle").applyInArrow(run, _KEYED)


def _handed_back(answers: DataFrame) -> DataFrame:
    """The first hop back: what the buckets of a way told a bundle, one row for each of its chunks."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        way, bundle = (k.as_py() for k in key)
        if way <= OWN or bundle == SUMMARY:
            return table.select(["chunk", "bucket", "body"])
        chunk, place, *values = (np.concatenate(v) for v in zip(*(unpack(b) for b in table.column("body").to_pylist()), strict=True))
        order = np.lexsort((place, chunk))
        edges = np.flatnonzero(np.diff(chunk[order], prepend=-1, append=-1))
        out = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            mine = order[a:b]
            out.append((int(chunk[mine[0]]), way, pack(place[mine], *(v[mine] for v in values))))
        give_back()
        return _answers(out)

    return answers.groupBy("bucket", "chunk").applyInArrow(run, _ANSWER)


def rejoin(chunks: DataFrame, answers: DataFrame, run: Callable[..., pa.Table], schema: str | StructType, carried: bool = False) -> DataFrame:
    """Bring every chunk together with its answers.

    ``run(chunk, answers)`` gets the answers as a dict from way to its arrays
    (places in the chunk's key list of that way, then the values).
    """

    def go(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        got = {b: unpack(body) for b, body in zip(right.column("bucket").to_pylist(), right.column("body").to_pylist(), strict=True)}
        tables = [run(chunk_from(row), got) for row in left.to_pylist()]
        give_back()
        return pa.concat_tables(tables) if tables else empty

    columns = ["chunk", "ids", "sizes", "body", *["rest"] * carried]
    empty = to_arrow_schema(schema if isinstance(schema, StructType) else StructType.fromDDL(schema)).empty_table()
    left = chunks.select(*columns).groupBy("chunk")
    return left.cogroup(answers.groupBy("chunk")).applyInArrow(go, schema)


def spread(keys: np.ndarray, got: dict[int, list[np.ndarray]], ways: int, empty: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions in the chunk's sorted keys that were answered, and the answers."""
    places, values = [np.zeros(0, np.int64)], [[e] for e in empty]
    for b, s in by_bucket(keys, ways):
        if b in got:
            places.append(got[b][0] + s.start)
            for k, v in enumerate(got[b][1:]):
                values[k].append(v)
    return np.concatenate(places), [np.concatenate(v) for v in values]
