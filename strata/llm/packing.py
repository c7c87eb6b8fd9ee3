"""Tokenising documents and packing them into sequences by bulk-synchronous best fit.

Tokenising. Texts are cut where a pre-token of a byte-level BPE surely ends (before
a space after a visible character, say), each distinct segment is encoded once
per worker, and ids are gathered per document.

Packing. Pieces are range-sorted by falling length and ranked within their length
class by a distributed scan. From then on the state is two written tables: runs of
unplaced pieces (length, ranks) and runs of sequences with equal gaps (gap, first
sequence, number). A round range-sorts both together by size and sweeps the ranges
side by side: walking up the sizes, every gap takes the longest piece below it that
no smaller gap has taken (as often as that length fits), so each piece gets its
successor gap and the ranks settle which piece goes to which sequence of a run.
What a range leaves open meets in a sweep over the ranges' leftovers, the gaps
shrink, and rounds go on until no piece is open. Pieces come in slabs of falling
length, so that long ones choose first; as many sequences as all ids need are open
from the start, and more are opened where a round places nothing. Runs are bounded
by the sequence length, never by the data.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import give_back, materialize, parts, small_batches
from .textkit import slices, span_hashes, string_buffers

LENGTH, END_ID = 1024, 2
#: Text bytes tokenised at a time; distinct segments a worker remembers.
SLICE, REMEMBER = 1 << 20, 1_500_000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


#: The pre-token pattern of this family of byte-level vocabularies (a fixed value of the format).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def quick_encoder(path: str):  # noqa: ANN201
    """A faster encoder over the same vocabulary and merges, or None where the file splits texts in another way or ids do
    not follow the order of merges."""
    import tiktoken

    file = json.loads(Path(path).read_text())
    model, split = file["model"], file.get("pre_tokenizer") or {}
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or file.get("normalizer"):
        return None
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
    made = [model["vocab"].get("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in model["merges"]]
    if None in made or made != sorted(made):
        return None
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if all(c in byte_of for c in token) and not token.startswith("<|")}
    return tiktoken.Encoding("same-vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class SegmentTokenizer:
    """Token ids of whole texts, encoding each distinct segment once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.quick = quick_encoder(path)
        self._clear()

    @property
    def newline(self) -> int:
        return self.quick.encode_ordinary("\n")[0]

    def _clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)
        self.start = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        # clean segments are encoded together, a line feed between them
        together = clean(data, start, end) if self.quick is not None else np.zeros(len(start), bool)
        order = np.concatenate((np.flatnonzero(together), np.flatnonzero(~together)))
        n, raw = int(together.sum()), data.tobytes()
        ids, sizes = [self.ids], [np.zeros(0, np.int64)]
        if n:
            coded = np.array(self.quick.encode_ordinary(b"\n".join([raw[start[k] : end[k]] for k in order[:n]]).decode()), np.uint32)
            breaks = np.flatnonzero(coded == self.newline)
            assert len(breaks) == n - 1
            sizes.append(np.diff(np.concatenate(([-1], breaks, [len(coded)]))) - 1)
            ids.append(coded[coded != self.newline])
        rest = [e.ids for e in self.encoder.encode_batch_fast([raw[start[k] : end[k]].decode("utf-8", "replace") for k in order[n:]], add_special_tokens=False)]
        sizes.append(np.array([len(c) for c in rest], np.int64))
        ids.append(np.fromiter((i for c in rest for i in c), np.uint32, int(sizes[-1].sum())))
        place = len(self.start) - 1 + np.arange(len(hashes))
        self.start = np.concatenate((self.start, self.start[-1] + np.cumsum(np.concatenate(sizes))))
        self.ids = np.concatenate(ids)
        known = np.concatenate((self.known, hashes[order]))
        order = np.argsort(known, kind="stable")
        self.known, self.place = known[order], np.concatenate((self.place, place))[order]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, and where each text's begin."""
        data, offsets = string_buffers(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        start, end = cuts(data, offsets)
        hashed = span_hashes(data, start, end)
        uniq, first, inverse = np.unique(hashed, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, uniq), max(0, len(self.known) - 1))
        new = self.known[at] != uniq if len(self.known) else np.ones(len(uniq), bool)
        if new.any():
            if len(self.known) + int(new.sum()) > REMEMBER:
                self._clear()
                new[:] = True
            self._learn(uniq[new], data, start[first[new]], end[first[new]])
            at = np.searchsorted(self.known, uniq)
        place = self.place[at][inverse]
        sizes = self.start[place + 1] - self.start[place]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        ids = self.ids[np.arange(ends[-1]) + np.repeat(self.start[place] - ends[:-1], sizes)]
        return ids, ends[np.searchsorted(start, offsets)]


@functools.lru_cache(maxsize=1)
def worker_tokenizer(path: str) -> SegmentTokenizer:
    """One tokenizer, and what it has learned, for all tasks of a worker."""
    return SegmentTokenizer(path)


#: Byte classes: characters after which white space surely starts a pre-token, ASCII letters, and marks that end a word
#: (all but "|", which special tokens hold).
PLAIN = np.zeros(256, bool)
PLAIN[0x21:0x7F] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
MARK = PLAIN & ~LETTER
MARK[[*range(0x30, 0x3A), ord("|")]] = False


def after_wide(data: np.ndarray) -> np.ndarray:
    """Second bytes of two-byte characters that start with 0xC3: none of them is white space, all but two are letters."""
    out = np.zeros(len(data), bool)
    out[1:] = data[:-1] == 0xC3
    return out


def cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments between places where a pre-token surely ends: before a space or line feed that follows a visible character,
    after a single line feed, and between a letter and a mark (a mark always starts its own pre-token). Characters of unsure class never make a place."""
    n = len(data)
    wide = after_wide(data)
    visible = PLAIN[data] | wide
    letter = LETTER[data] | (wide & (data != 0x97) & (data != 0xB7))
    feed = data == 0x0A
    cut = np.zeros(n, bool)
    cut[1:] = ((data[1:] == 0x20) | feed[1:]) & visible[:-1] | MARK[data[1:]] & letter[:-1]
    cut[2:] |= feed[1:-1] & visible[:-2] & (PLAIN[data[2:]] | (data[2:] == 0xC3))
    cut[offsets[:-1][offsets[:-1] < n]] = True
    start = np.flatnonzero(cut)
    return start, np.append(start[1:], n)


def clean(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Segments of visible characters after at most one space, and without the beginning of a special token."""
    unsure = ~(PLAIN[data] | after_wide(data) | (data == 0xC3))
    unsure[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
    bad = np.concatenate(([0], np.cumsum(unsure)))
    space = data[start] == 0x20
    return (bad[end] - bad[start] == space) & (end - start > space)


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids): each document's ids and ``end_id``, cut only where longer than
    ``length``: the remainder first, then full pieces. ids are little-endian unsigned 32-bit, or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenize = worker_tokenizer(tokenizer_path)
        for whole in batches:
            for batch in slices(whole, 1, SLICE):
                ids, starts = tokenize(batch.column(1))
                rows = []
                for k, doc in enumerate(batch.column(0).to_pylist()):
                    own = np.append(ids[starts[k] : starts[k + 1]], end_id).astype("<u4").tobytes()
                    n, at, piece = len(own) // 4, 0, 0
                    while at < n:
                        size = ((n - at - 1) % length) + 1
                        part = own[4 * at : 4 * (at + size)]
                        rows.append((doc, piece, at, size, zlib.crc32(part), part if with_ids else None))
                        at, piece = at + size, piece + 1
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [x.split()[0] for x in _PIECES.split(", ")])
        give_back()

    return small_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col))).mapInArrow(run, _PIECES)


def ranked(pieces: DataFrame) -> DataFrame:
    """Pieces with ``rank``, from 0 within their length: a range sort, a scan of each range, and offsets of the ranges."""
    spark = pieces.sparkSession
    order = [F.col("length").desc(), F.col("doc_id"), F.col("piece")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), -1, 0
        for batch in batches:
            size = batch.column("length").to_numpy()
            if not len(size):
                continue
            new = np.flatnonzero(np.concatenate(([size[0] != last], size[1:] != size[:-1])))
            local = np.arange(len(size))
            begin = np.zeros(len(size), np.int64)
            begin[new] = new
            begin = np.maximum.accumulate(begin)
            local = local - begin
            head = len(size) if not len(new) else new[0]
            local[:head] += seen
            last, seen = size[-1], int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(size), part, np.int64)), pa.array(local.astype(np.int64))], [*batch.schema.names, "range", "local"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", range long, local long"
    scanned = materialize(pieces.repartitionByRange(max(8, parts(spark)), *order).sortWithinPartitions(*order).mapInArrow(run, schema), "ranked-pieces")
    counts = scanned.groupBy("length", "range").count()
    # a sorted table has at most (ranges + lengths) such rows
    before = counts.withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return scanned.join(F.broadcast(before.drop("count")), ["length", "range"]).withColumn("rank", F.col("local") + F.col("before")).drop("range", "local", "before")


#: Runs of pieces (kind PIECES: ``low`` to ``high`` are ranks), of sequences (GAPS, or SHRUNK in this round), and placements
#: (PLACED): ranks low to high go to sequences from ``first`` on, ``per`` to each, from ``offset`` on.
_RUNS = "kind int, size long, low long, high long, per long, first long, number long, offset long"
PIECES, GAPS, SHRUNK, PLACED = range(4)
#: Ranges of a sweep, and the most rows of a plan that are broadcast.
RANGES, PLAN_ROWS = 8, 1_000_000


def sweep(rows: list[dict], length: int) -> list[dict]:
    """One range of runs, sizes rising and pieces before gaps of their size: a gap takes the longest open piece, as often
    as it fits. Returns placements, shrunk gaps, and what stays open."""
    out: list[dict] = []
    waiting: list[dict] = []
    for row in rows:
        if row["kind"] == PIECES:
            waiting.append(dict(row))
            continue
        gap, first, number = row["size"], row["first"], row["number"]
        while number and waiting:
            top = waiting[-1]
            count = top["high"] - top["low"]
            per = min(gap // top["size"], count)
            use = min(number, count // per)
            out.append({"kind": PLACED, "size": top["size"], "low": top["low"], "high": top["low"] + per * use, "per": per, "first": first, "number": use, "offset": length - gap})
            if gap > per * top["size"]:
                out.append({"kind": SHRUNK, "size": gap - per * top["size"], "first": first, "number": use})
            first, number, top["low"] = first + use, number - use, top["low"] + per * use
            if top["low"] == top["high"]:
                waiting.pop()
        if number:
            out.append({"kind": GAPS, "size": gap, "first": first, "number": number})
    return out + waiting


def one_round(runs: DataFrame, length: int) -> DataFrame:
    """Sweeps of all ranges, then one over what they leave; written, as the next round starts from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        done = [r for r in rows if r["kind"] in (SHRUNK, PLACED)]
        found = done + sweep([r for r in rows if r["kind"] in (PIECES, GAPS)], length)
        names, kinds = [x.split()[0] for x in _RUNS.split(", ")], [pa.int32(), *[pa.int64()] * 7]
        yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in found], k) for n, k in zip(names, kinds, strict=True)], names)

    order = ["size", "kind", "low", "first"]
    local = runs.repartitionByRange(RANGES, *order).sortWithinPartitions(*order).mapInArrow(run, _RUNS)
    return materialize(local.repartition(1).sortWithinPartitions(*order).mapInArrow(run, _RUNS), "packing-round")


def best_fit(counts: DataFrame, length: int = LENGTH) -> DataFrame:
    """The placements of pieces, given (length, count): rows (length, low, high, per, first, offset)."""
    spark = counts.sparkSession
    none = F.lit(None).cast("long")
    row = lambda **known: [F.lit(known["kind"]).cast("int").alias("kind"), *[known.get(n, none).cast("long").alias(n) for n in ("size", "low", "high", "per", "first", "number", "offset")]]
    sequences = lambda first, number: spark.range(1).select(*row(kind=GAPS, size=F.lit(length), first=F.lit(first), number=F.lit(number)))
    open_ = materialize(counts.select(*row(kind=PIECES, size=F.col("length"), low=F.lit(0), high=F.col("count"))), "packing-pieces")
    ids = open_.agg(F.sum(F.col("size") * F.col("high"))).first()[0] or 0
    opened = -(-ids // length)
    gaps, placed = sequences(0, opened), []
    slabs = [length, length // 2, length // 4, length // 8, 0]
    for longest, shortest in zip(slabs, slabs[1:], strict=False):
        runs = gaps.unionByName(open_.where((F.col("size") > shortest) & (F.col("size") <= longest)))
        while True:
            runs = one_round(runs, length)
            placed.append(runs.where(F.col("kind") == PLACED))
            left = F.col("kind") == PIECES
            seen = runs.agg(F.count_if(F.col("kind") == PLACED).alias("placed"), F.sum(F.when(left, F.col("size") * (F.col("high") - F.col("low")))).alias("ids")).first()
            gaps = runs.where(F.col("kind").isin(GAPS, SHRUNK)).withColumn("kind", F.lit(GAPS))
            if not seen["ids"]:
                break
            runs = gaps.unionByName(runs.where(left))
            if not seen["placed"]:
                more = -(-seen["ids"] // length)
                runs, opened = runs.unionByName(sequences(opened, more)), opened + more
    plan = placed[0]
    for more in placed[1:]:
        plan = plan.unionByName(more)
    return plan.select(F.col("size").alias("length"), "low", "high", "per", "first", "offset")


def pack(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with sequence_id and offset; the input must be cheap to read twice."""
    placed = materialize(ranked(pieces), "ranks")
    plan = materialize(best_fit(placed.groupBy("length").count(), length).coalesce(1), "packing-plan")
    if plan.count() <= PLAN_ROWS:
        plan = F.broadcast(plan)
    rank = F.col("rank") - F.col("low")
    joined = placed.join(plan, "length").where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return joined.select(*[placed[c] for c in placed.columns if c != "rank"], (F.col("first") + F.expr("(rank - low) div per")).alias("sequence_id"), (F.col("offset") + rank % F.col("per") * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """All documents tokenised and packed: (doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset).

    Null and empty texts are the single id ``end_id``. Only documents longer than
    ``length`` are cut. Sequences are filled from offset 0 without gaps. Repeated
    rows and rows without an id are packed like any other. Empty table: empty.
    """
    return pack(materialize(tokenized_pieces(docs, tokenizer_path, length, end_id, with_ids), "pieces"), length)
