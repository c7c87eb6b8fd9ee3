"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Counting covers all training documents. Words get exact counts by a corpus-wide
lookup. Two- and three-word grams are summed in their buckets of the key space and
quantised downwards (1, 2, 3, then four steps for each doubling). Grams seen at
least twice go into their bucket's segment of a Bloom filter: one of level q is
inserted q times, as (gram, 1) ... (gram, q). A count is read back by probing
levels 1, 2, 4, ... until one fails, then by halves. A gram seen once needs no place
there: its own chunk knows it, and other chunks that have it (held-out texts) are
told by its bucket.

The filter is broadcast, so its size has a bound (``MAX_BITS``): within each
segment the least count kept rises until the segment fits its share. What that
leaves out is not lost: a bucket knows what a chunk would read from the filter,
and tells it the right level of every gram for which that is wrong (left out of
the segment, or a false positive). So scores do not depend on the bound.

Probabilities are interpolated: with weight s a gram's count over its context's,
with 1 - s the shorter gram's probability, down to smoothed word frequencies. s is
one number for each class of context frequency, measured over all data: what
absolute discounting leaves to seen grams. As counts are rounded down, and contexts
of two words up, the counts of a context's grams never sum to more than the
context's, so the probabilities after any context sum to 1 at most.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import _KEYED, SUMMARY, Bucket, Chunk, answered, bucket_count, corpus_bytes, key_rows, keyed, make_chunks, packed_rows, rejoin, spread, unpack, way_count
from .shared import materialize
from .textkit import Sequences, Words, mix

#: Bits of the whole filter at most (64 MiB), bits for an inserted entry, probes for one.
MAX_BITS, ENTRY_BITS, PROBES = 1 << 29, 8, 4
#: Keys probed at a time: their arrays stay in a core's cache.
AT_ONCE = 1 << 14
#: Classes of word frequency.
CLASSES = 32
#: Bits of a gram's hash that are kept beyond those that name its bucket.
GRAM_BITS = 32
ALPHA = 0.1
#: Text bytes of a chunk: smaller than elsewhere, as a worker also holds the filter.
LM_CHUNK = 4 << 20
END = np.uint64(0x5EAF00D5EAF00D01)
U = np.uint64
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def tenth(doc_id: int) -> bool:
    """Whether a document is held out: crc32 of the id's text modulo 10 is 0."""
    return zlib.crc32(str(doc_id).encode()) % 10 == 0


def tokens_of(chunk: Chunk) -> Sequences:
    """Hashed lower-cased words of each text, then an end."""
    words = Words(chunk.data, chunk.offsets, lower=True)
    n = len(chunk)
    first = words.first + np.arange(n + 1)
    hashes = np.empty(len(words.hash) + n, U)
    ends = first[1:] - 1
    inner = np.ones(len(hashes), bool)
    inner[ends] = False
    hashes[inner], hashes[ends] = words.hash, END
    return Sequences(hashes, first)


def training(chunk: Chunk, held_out: Callable[[int], bool]) -> np.ndarray:
    return np.array([not held_out(int(i)) for i in chunk.ids], bool)


def level(count: np.ndarray) -> np.ndarray:
    """Quantised log count: 0 below 2, then 2, 3, and four steps for each doubling (4, 5, 6, 7, 8, 10, 12, ...)."""
    count = np.asarray(count, np.int64)
    octave = np.frexp(np.maximum(count, 4).astype(np.float64))[1].astype(np.int64) - 1
    return np.where(count < 4, np.maximum(count - 1, 0), 3 + 4 * (octave - 2) + ((count - (1 << octave)) >> (octave - 2)))


def count_of(q: np.ndarray) -> np.ndarray:
    """The count that stands for a level (the least of it)."""
    q = np.asarray(q, np.int64)
    octave, step = np.divmod(np.maximum(q, 3) - 3, 4)
    return np.where(q < 3, np.where(q > 0, q + 1, 0), (4 + step) << octave).astype(np.float64)


def ceiling(count: np.ndarray) -> np.ndarray:
    """The largest count that is quantised to the given one."""
    values, which = np.unique(count, return_inverse=True)
    return np.where(values < 2, values, count_of(level(values) + 1) - 1)[which]


_SMALL = np.arange(1 << 12)
_SMALL = np.where(_SMALL == 1, 1.0, count_of(level(_SMALL)))


def quantised(count: np.ndarray) -> np.ndarray:
    """Counts as the model holds them: 1, then those of the filter's levels."""
    count = np.asarray(count, np.int64)
    out = _SMALL[np.minimum(count, len(_SMALL) - 1)]
    large = np.flatnonzero(count >= len(_SMALL))
    out[large] = count_of(level(count[large]))
    return out


def read(probed: np.ndarray, local: np.ndarray) -> np.ndarray:
    """What a chunk takes a gram's count for if nothing else is told: the filter's, or its own where the filter has none."""
    return np.where(probed > 0, probed, quantised(local))


def cut(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Leading bits of gram hashes."""
    drop = max(0, 64 - (int(buckets).bit_length() - 1) - GRAM_BITS)
    return keys >> U(drop) << U(drop)


def hashed(keys: np.ndarray, q: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Of (key, level): a start and a step for its probes."""
    h = mix(keys + np.asarray(q).astype(U) * U(0x9E3779B97F4A7C15))
    return h, h * U(0xC2B2AE3D27D4EB4F) | U(1)


def place(h: np.ndarray, step: np.ndarray, k: int, bits: np.ndarray) -> np.ndarray:
    """The bit of probe k in a segment of so many bits."""
    at = h + U(k) * step
    at >>= U(32)
    at *= bits
    at >>= U(32)
    return at


def segment(keys: np.ndarray, counts: np.ndarray, most_bits: int) -> tuple[np.ndarray, int]:
    """The segment's bytes and the least count in it."""
    q, least = level(counts), 2
    total = int(q.sum())
    while total * ENTRY_BITS > most_bits and total:
        least = int(count_of(np.array([level(np.array([least]))[0] + 1]))[0])
        total = int(q[counts >= least].sum())
    keep = counts >= least
    keys, q = keys[keep], q[keep]
    bits = total * ENTRY_BITS
    out = np.zeros(bits, bool)
    for j in range(1, int(q.max(initial=0)) + 1):
        own = keys[q >= j]
        h, step = hashed(own, j)
        for k in range(PROBES):
            out[place(h, step, k, U(bits))] = True
    return np.packbits(out, bitorder="little"), least


class Filter:
    """Segments of some buckets in one array; what it holds in memory follows the segments, not the number of buckets."""

    def __init__(self, buckets: int, segments: dict[int, bytes]):
        self.shift = U(64 - buckets.bit_length() + 1)
        self.dense = 2 * len(segments) >= buckets
        self.numbers = np.arange(buckets) if self.dense else np.array(sorted(segments), np.int64)
        held = [segments.get(b, b"") for b in self.numbers.tolist()]
        sizes = np.array([*map(len, held), 0], np.int64)  # one more, without bits, for buckets that are not here
        self.bits = (sizes * 8).astype(U)
        self.start = np.concatenate(([0], np.cumsum(sizes)))[:-1].astype(U)
        self.all = self.dense and bool((sizes[:-1] > 0).all())
        self.data = np.frombuffer(b"".join(held), np.uint8)

    def segment_of(self, keys: np.ndarray) -> np.ndarray:
        """Where each key's segment stands in the arrays."""
        bucket = (keys >> self.shift).astype(np.int64)
        if self.dense:
            return bucket
        if len(self.numbers) == 1:
            return (bucket != self.numbers[0]).astype(np.int64)
        at = np.searchsorted(self.numbers, bucket)
        here = at < len(self.numbers)
        here[here] = self.numbers[at[here]] == bucket[here]
        return np.where(here, at, len(self.numbers))

    def holds(self, keys: np.ndarray, bucket: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether each (key, level) seems to be a member of its segment."""
        alive = np.arange(len(keys)) if self.all else np.flatnonzero(self.bits[bucket] > 0)
        h, step = hashed(keys[alive], q[alive])
        bits, start = self.bits[bucket[alive]], self.start[bucket[alive]]
        for k in range(PROBES):
            at = place(h, step, k, bits)
            hit = np.flatnonzero(self.data[start + (at >> U(3))] >> (at & U(7)).astype(np.uint8) & 1)
            alive = alive[hit]
            if k + 1 < PROBES:
                h, step, bits, start = h[hit], step[hit], bits[hit], start[hit]
        out = np.zeros(len(keys), bool)
        out[alive] = True
        return out

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of gram keys by repeated membership probes."""
        return np.concatenate([np.zeros(0), *(self._counts(keys[i : i + AT_ONCE]) for i in range(0, len(keys), AT_ONCE))])

    def _counts(self, keys: np.ndarray) -> np.ndarray:
        """Levels 1, 2, 4, ... until one fails, then by halves."""
        low, high = np.zeros(len(keys), np.int64), np.ones(len(keys), np.int64)
        bucket = self.segment_of(keys)
        alive = np.arange(len(keys))
        while len(alive):
            alive = alive[self.holds(keys[alive], bucket[alive], high[alive])]
            low[alive] = high[alive]
            high[alive] *= 2
        alive = np.flatnonzero(high - low > 1)
        while len(alive):
            middle = (low[alive] + high[alive]) // 2
            there = self.holds(keys[alive], bucket[alive], middle)
            low[alive[there]], high[alive[~there]] = middle[there], middle[~there]
            alive = alive[high[alive] - low[alive] > 1]
        return count_of(low)


#: Bits of a segment at least: where the bound leaves less for each bucket, one bucket in several has a segment.
LEAST_SEGMENT = 1 << 10


def segment_bits(number: int, buckets: int, max_bits: int) -> int:
    """Bits that the bound leaves for a bucket's segment: of at most max_bits / LEAST_SEGMENT buckets it is not 0."""
    least = min(LEAST_SEGMENT, max_bits)
    every = 1
    while max_bits * every < least * buckets:
        every *= 2
    return max_bits * every // buckets if number % every == 0 else 0


def summed(summaries: DataFrame, which: int, size: int) -> np.ndarray:
    """The sum over all buckets of one array of their summaries: tasks add their own, an aggregate the rest, and ``size``
    rows reach the driver however many buckets there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for body in batch.column(0):
                total += unpack(body.as_py())[which]
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])

    rows = summaries.select("body").mapInArrow(run, "sums array<double>").select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("total"))
    out = np.zeros(size)
    for r in rows.collect():
        out[r["pos"]] = r["total"]
    return out


def segments_of(summaries: DataFrame) -> dict[int, bytes]:
    """The segments that hold something: max_bits in all, at most max_bits / LEAST_SEGMENT of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(b, unpack(body)[0].tobytes()) for b, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            kept = [(b, bits) for b, bits in found if bits]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in kept], pa.int64()), pa.array([x for _, x in kept], pa.binary())], ["bucket", "bits"])

    return {r["bucket"]: bytes(r["bits"]) for r in summaries.select(F.col("bucket").cast("long"), "body").mapInArrow(run, "bucket long, bits binary").collect()}


def _word_counts(bucket: Bucket) -> tuple[np.ndarray, list[np.ndarray]]:
    total = bucket.per_key(np.add, 0)[bucket.group()]
    return total != bucket.values[0], [total]


def classes(count: np.ndarray) -> np.ndarray:
    """Classes of context frequency: half-powers of two, 1 and up."""
    return np.clip((2 * np.log2(np.maximum(count, 1))).astype(np.int64) + 1, 1, CLASSES - 1)


def score_documents(docs: DataFrame, held_out: Callable[[int], bool] = tenth, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """Learn from the documents ``held_out`` is false for and score all.

    Returns doc_id, held_out, n_tokens (words and one end), n_known (tokens seen in
    training), train_tokens, base_score (smoothed word frequencies) and score (the
    n-gram model), both log10 of the text's probability. Null and empty texts are
    the end alone. Repeated rows count as often as they occur; rows without an id
    are left out. Without training tokens every token has the base probability 1.
    Empty table: empty.
    """
    spark = docs.sparkSession
    chunks = make_chunks(docs, id_col, text_col, LM_CHUNK)
    size = corpus_bytes(chunks)
    word_buckets, gram_buckets = bucket_count(size / 20), bucket_count(size / 3)
    word_ways, gram_ways = way_count(word_buckets), way_count(gram_buckets)

    def local_words(chunk: Chunk, seq: Sequences) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, inverse = np.unique(seq.hash, return_inverse=True)
        train = np.repeat(training(chunk, held_out), seq.counts())
        return keys, np.bincount(inverse[train], minlength=len(keys)).astype(np.int64), inverse

    def word_summary(bucket: Bucket) -> list[np.ndarray]:
        total = bucket.per_key(np.add, 0)
        return [np.array([(total > 0).sum(), total.sum()], np.int64)]

    words = materialize(answered(keyed(chunks, word_ways, lambda c: local_words(c, tokens_of(c))[:2]), chunks, word_buckets, word_ways, _word_counts, word_summary), "word-counts")
    distinct, total = (int(x) for x in summed(words.where(F.col("chunk") == SUMMARY), 0, 2))
    word_answers = words.where(F.col("chunk") != SUMMARY)

    def token_counts(chunk: Chunk, seq: Sequences, got: dict) -> np.ndarray:
        """The training count of each token."""
        keys, counts, inverse = local_words(chunk, seq)
        places, (told_counts,) = spread(keys, got, word_ways, [np.zeros(0, np.int64)])
        counts[places] = told_counts
        return counts[inverse]

    def gram_windows(chunk: Chunk, seq: Sequences) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Starts of pairs and triples; their sorted distinct keys, local training counts, and which key each window has."""
        train = np.repeat(training(chunk, held_out), seq.counts())
        starts, keys = [], []
        for n in (2, 3):
            hashed, inside = seq.windows(n)
            starts.append(np.flatnonzero(inside))
            keys.append(cut(hashed[starts[-1]], gram_buckets))
        unique, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        own = np.bincount(inverse[train[np.concatenate(starts)]], minlength=len(unique)).astype(np.int32)
        return starts, unique, own, inverse

    def grams(chunk: Chunk, got: dict) -> pa.Table:
        seq = tokens_of(chunk)
        kind = classes(token_counts(chunk, seq, got)).astype(np.uint8)
        (pairs, triples), keys, own, inverse = gram_windows(chunk, seq)
        tags, triple = np.zeros(len(keys), np.uint8), np.zeros(len(keys), np.uint8)
        # the class of the context's last word
        tags[inverse[: len(pairs)]] = kind[pairs]
        tags[inverse[len(pairs) :]], triple[inverse[len(pairs) :]] = kind[triples + 1], 1
        return pa.Table.from_batches([packed_rows(key_rows(chunk.number, gram_ways, keys, [own, tags, triple]))])

    def settled(bucket: Bucket) -> tuple[np.ndarray, np.ndarray]:
        """Training counts of a bucket's grams, and its segment."""
        if not hasattr(bucket, "settled"):
            counts = np.add.reduceat(bucket.values[0].astype(np.int64), bucket.starts)
            bucket.settled = counts, segment(bucket.keys, counts, segment_bits(bucket.number, gram_buckets, max_bits))[0]
        return bucket.settled

    def corrections(bucket: Bucket) -> tuple[np.ndarray, list[np.ndarray]]:
        counts, bits = settled(bucket)
        probed = Filter(gram_buckets, {bucket.number: bits.tobytes()}).counts(bucket.keys)
        group = bucket.group()
        right = quantised(counts)[group]
        return read(probed[group], bucket.values[0]) != right, [right.astype(np.int64)]

    def build(bucket: Bucket) -> list[np.ndarray]:
        counts, bits = settled(bucket)
        tags, triple = bucket.values[1][bucket.starts], bucket.values[2][bucket.starts].astype(bool)
        kept = quantised(counts)
        rare = [np.array([(counts[own] == k).sum() for k in (1, 2)], np.float64) for own in (~triple, triple)]
        sums = [np.bincount(tags[own], weights=w[own], minlength=CLASSES) for own in (~triple, triple) for w in (kept, kept > 0)]
        return [bits, np.concatenate([*rare, *sums])]

    built = materialize(answered(rejoin(chunks, word_answers, grams, _KEYED), chunks, gram_buckets, gram_ways, corrections, build), "gram-filter")
    gram_answers = built.where(F.col("chunk") != SUMMARY).withColumn("bucket", F.col("bucket") + word_buckets)
    summaries = materialize(built.where(F.col("chunk") == SUMMARY).select("bucket", "body"), "gram-summaries")  # small, read twice
    sums = summed(summaries, 1, 4 + 4 * CLASSES)
    off2, off3 = (float(once / (once + 2 * twice)) if once else 0.0 for once, twice in (sums[:2], sums[2:4]))
    sums = sums[4:].reshape(4, CLASSES)
    # weight of seen grams: what the discounts leave of their counts, by class of the context's last word
    seen2, seen3 = (np.clip(1 - np.divide(off * number, mass, out=np.ones(CLASSES), where=mass > 0), 0, 0.999) for off, mass, number in ((off2, sums[0], sums[1]), (off3, sums[2], sums[3])))
    shared = spark.sparkContext.broadcast((gram_buckets, segments_of(summaries)))
    floor = ALPHA / (total + ALPHA * (distinct + 1)) if total else 1.0

    def finish(chunk: Chunk, got: dict) -> pa.Table:
        seq = tokens_of(chunk)
        c = token_counts(chunk, seq, {b: x for b, x in got.items() if b < word_buckets})
        kind = classes(c)
        c = c.astype(np.float64)
        p1 = (c / ALPHA + 1) * floor if total else np.ones(len(c))
        (pairs, triples), keys, own, inverse = gram_windows(chunk, seq)
        held = read(_filter(shared).counts(keys), own)
        places, (right,) = spread(keys, {b - word_buckets: x for b, x in got.items() if b >= word_buckets}, gram_ways, [np.zeros(0, np.int64)])
        held[places] = right
        held = held[inverse]
        p = p1.copy()
        two = np.zeros(len(c))
        two[pairs] = np.minimum(held[: len(pairs)], c[pairs])
        at = pairs[c[pairs] > 0]
        p[at + 1] = seen2[kind[at]] * two[at] / c[at] + (1 - seen2[kind[at]]) * p1[at + 1]
        ok = two[triples] > 0
        at = triples[ok]
        context = ceiling(two[at])
        p[at + 2] = seen3[kind[at + 1]] * np.minimum(held[len(pairs) :][ok], context) / context + (1 - seen3[kind[at + 1]]) * p[at + 2]
        owner = seq.document_of()
        n = len(chunk)
        add = lambda w: np.bincount(owner, weights=w, minlength=n)
        return pa.table(
            [pa.array(chunk.ids), pa.array(~training(chunk, held_out)), pa.array(seq.counts().astype(np.int64)), pa.array(add(c > 0).astype(np.int64)), pa.array(add(np.log10(p1))), pa.array(add(np.log10(np.maximum(p, 1e-300))))],
            [x.split()[0] for x in _SCORES.split(", ")],
        )

    scored = rejoin(chunks, word_answers.unionByName(gram_answers), finish, _SCORES)
    return scored.withColumn("train_tokens", F.lit(total).cast("long"))


_held: list = [None, None]


def _filter(shared) -> Filter:  # noqa: ANN001
    """The worker's filter, built once for each broadcast."""
    if _held[0] is not shared.value:
        _held[0], _held[1] = shared.value, Filter(*shared.value)
    return _held[1]
