"""Whole Arrow text batches as flat byte arrays, for vectorised scans inside tasks.

Words are maximal runs of bytes other than blank and tab..carriage return; all separators
are ASCII, so UTF-8 text can be cut on its bytes.  Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one vectorised step takes at most (a longer text is a step of its own).
STEP_BYTES = 1 << 20

SEP = np.zeros(256, bool)
SEP[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


#: One random number a byte value, and the odd base of the polynomial with its inverse.
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_BASE = np.uint64(0x9FB21C651E98DF25)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_ODD = mix(np.arange(101, 165, dtype=np.uint64)) | np.uint64(1)
_powers: list[np.ndarray] = []


def _power(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, STEP_BYTES + 1)
        _powers[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b)])) for b in (_BASE, _INVERSE)]
    return _powers


def flat(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values after each other, and the n + 1 offsets between them."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches into runs of rows whose texts hold at most `most` bytes, one row at least."""
    for batch in batches:
        _, off = flat(batch.column(column))
        at, n = 0, batch.num_rows
        while at < n:
            end = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def words(data: np.ndarray, off: np.ndarray, sep: np.ndarray = SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the n + 1 bounds of each text's words among them."""
    n = len(data)
    inside = ~sep[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[off[:-1][off[:-1] < n]] = False
    after[off[1:][off[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


#: Bytes of a range that one polynomial covers; longer ranges are hashed by pieces.  Modulo a
#: power of two, known pairs of different long strings have equal values for every base.
PIECE = 64


class Hasher:
    """64-bit hashes of any byte ranges of one flat array, in constant time for short ones."""

    def __init__(self, data: np.ndarray):
        self.ahead, self.back = _power(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * self.ahead[: len(data)], out=self.sums[1:])

    def _piece(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.back[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * _ODD[63])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = self._piece(starts, ends)
        long = np.flatnonzero(ends - starts > PIECE)
        if len(long):
            lo, hi = starts[long].astype(np.int64), ends[long].astype(np.int64)
            n = -(-(hi - lo) // PIECE)
            first = np.cumsum(n) - n
            number = np.arange(n.sum()) - np.repeat(first, n)
            at = np.repeat(lo, n) + number * PIECE
            pieces = self._piece(at, np.minimum(at + PIECE, np.repeat(hi, n)))
            # Mixed with their numbers before they are summed, so that their order tells.
            pieces = mix(pieces ^ (number.astype(np.uint64) * _ODD[62])) * _ODD[61]
            out[long] = mix(np.add.reduceat(pieces, first) + (hi - lo).astype(np.uint64))
        return out


def grams(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-word windows, each window's first word, and the bounds of each text's windows."""
    total = len(hashes) - n + 1
    if total <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    out = np.zeros(total, np.uint64)
    for k in range(n):
        out += hashes[k : k + total] * _ODD[k]
    owner_end = np.repeat(bounds[1:], np.diff(bounds))
    at = np.flatnonzero(np.arange(total) + n <= owner_end[:total])
    return mix(out[at]), at, np.searchsorted(at, bounds)


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of runs of values, one run for each text."""
    sums = np.concatenate([np.zeros(1, np.float64 if values.dtype.kind == "f" else np.int64), np.cumsum(values, dtype=None if values.dtype.kind == "f" else np.int64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def owned(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Hashes that also tell texts apart, so that one sort serves a whole batch."""
    owner = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(bounds))
    return mix(hashes + owner * _ODD[40])
