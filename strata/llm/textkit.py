"""Words of whole texts and 64-bit hashes of words and word windows, vectorised with NumPy.

A word is a run of bytes outside 0x20 and 0x09-0x0D. The bytes of many texts are
handled at once; a word's hash is a polynomial over a table of random byte
values, a window's hash one over the mixed hashes of its words, both followed by
a mixing step. All constants come from a fixed seed, so every worker agrees.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_WORD_BASE, _WINDOW_BASE = (int(x) | 1 for x in _rng.integers(2**60, 2**63, 2, dtype=np.uint64))
#: Bytes hashed at a time: bounds the temporaries whatever the length of a text.
SPAN = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    held = _powers.get(base)
    if held is None or len(held[0]) < n:
        size = max(1024, 1 << int(n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, U)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        held = _powers[base] = (out[0], out[1])
    return held


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def string_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their offsets; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()) if texts.type != pa.large_string() else texts
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if offsets is not None and len(texts) else np.zeros(len(texts) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range (ranges in rising order)."""
    out = np.empty(len(start), U)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + SPAN, "right")))
        a, b = start[i], end[j - 1]
        up, down = powers(_WORD_BASE, int(b - a) + 1)
        total = np.zeros(b - a + 1, U)
        np.cumsum(_BYTE[data[a:b]] * up[: b - a], out=total[1:])
        s, e = start[i:j] - a, end[i:j] - a
        out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(U))
        i = j
    return out


def slices(batch: pa.RecordBatch, column: int, most: int) -> list[pa.RecordBatch]:
    """Consecutive parts of a batch with at most so many bytes of text each (a longer text is a part of its own)."""
    _, offsets = string_buffers(batch.column(column))
    out, i = [], 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        out.append(batch.slice(i, j - i))
        i = j
    return out


class Sequences:
    """Hashed tokens of some texts, and each text's range of tokens."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray):
        self.hash, self.first = hashes, first

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the window starting at each word, and whether it lies inside the word's text."""
        n = len(self.hash)
        if n < size:
            return np.zeros(n, U), np.zeros(n, bool)
        hashed = np.zeros(n, U)
        inside = np.arange(n) + size <= np.repeat(self.first[1:], self.counts())
        i, last = 0, n - size + 1
        while i < last:
            j = min(last, i + SPAN)
            up, down = powers(_WINDOW_BASE, j - i + size)
            total = np.zeros(j - i + size, U)
            np.cumsum(self.hash[i : j + size - 1] * up[: j - i + size - 1], out=total[1:])
            span = total[size:] - total[: j - i]
            span *= down[: j - i]
            span += U(size)
            hashed[i:j] = mix(span)
            i = j
        return hashed, inside

    def document_of(self) -> np.ndarray:
        """Index of each word's text."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def whole(self, k: int) -> np.uint64:
        """Hash of the whole word sequence of text k (for texts shorter than a window)."""
        h = self.hash[self.first[k] : self.first[k + 1]]
        up, _ = powers(_WINDOW_BASE, len(h))
        with np.errstate(over="ignore"):
            return mix(np.array([(h * up[: len(h)]).sum(dtype=U) + U(len(h))], U))[0]


class Words(Sequences):
    """The words of some texts: byte ranges, hashes, and each text's range of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = LOWER[data] if lower else data
        n = len(data)
        space = SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.ones(n, bool)
        before[1:] = space[:-1]
        before |= edge[:n]
        self.start = np.flatnonzero(~space & before)
        after = np.ones(n, bool)
        after[:-1] = space[1:]
        after |= edge[1:]
        self.end = np.flatnonzero(~space & after) + 1
        self.first = np.searchsorted(self.start, offsets)  # of each text; one more at the end
        self.hash = span_hashes(self.data, self.start, self.end)

    def __getitem__(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()
