"""Word positions and 64-bit word hashes of whole Arrow batches, without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that end a word of ``[^\x20\x09-\x0D]+``.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
IS_WORD = np.ones(256, bool)
IS_WORD[list(SPACES)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CHUNK_BYTES = 1 << 20

def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Chunk:
    """Some rows' UTF-8 bytes back to back, and where each row and word lies in them."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, first_row: int) -> None:
        self.data, self.bounds, self.first_row, self.n_rows = data, bounds, first_row, len(bounds) - 1

    def words(self, is_word: np.ndarray = IS_WORD) -> None:
        """Set starts, ends and row (of each word) and first (the first word of each row, and the end)."""
        inside = is_word[self.data]
        fresh = np.zeros(len(self.data) + 1, bool)
        fresh[self.bounds] = True
        before = np.concatenate(([False], inside[:-1])) if len(inside) else inside
        after = np.concatenate((inside[1:], [False])) if len(inside) else inside
        self.starts = np.flatnonzero(inside & (~before | fresh[:-1]))
        self.ends = np.flatnonzero(inside & (~after | fresh[1:])) + 1
        self.first = np.searchsorted(self.starts, self.bounds)
        self.n_words = np.diff(self.first)
        self.row = np.repeat(np.arange(self.n_rows), self.n_words)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """A hash of each span of bytes; equal spans have equal ones.

        Every eight bytes of a span are spread by a bijection that depends on their place in it, then added
        up with the span's length. Spans of up to eight bytes and one length never share a hash; others only by chance.
        """
        data = np.zeros(len(self.data) + 8, np.uint8)
        data[: len(self.data)] = LOWER[self.data] if lower else self.data
        lanes = (ends - starts + 7) >> 3
        first = np.cumsum(lanes) - lanes
        place = np.arange(int(lanes.sum())) - np.repeat(first, lanes)
        at = np.repeat(starts, lanes) + 8 * place
        bytes8 = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))[at]
        spare = np.maximum(at + 8 - np.repeat(ends, lanes), 0).astype(np.uint64) << np.uint64(3)
        bytes8 &= np.uint64(0xFFFFFFFFFFFFFFFF) >> spare
        sums = np.zeros(len(place) + 1, np.uint64)
        np.cumsum(mix(bytes8 + (place + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), out=sums[1:])
        return mix(sums[first + lanes] - sums[first] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def windows(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every window of ``size`` words that lies in one row."""
        n = len(hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        total = np.zeros(n, np.uint64)
        for i in range(size):
            total = mix(total * np.uint64(3) + hashes[i : i + n])
        at = np.flatnonzero(self.row[:n] == self.row[size - 1 :])
        return at, total[at]

    def text(self, start: int, end: int) -> str:
        return self.data[start:end].tobytes().decode("utf-8", "replace")


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The rows of a string column in order, in runs of up to ``most`` bytes; a longer row is a run. Null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    if not len(column):
        return
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield Chunk(data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row], row)
        row = stop


def per_row(row: np.ndarray, weights: np.ndarray | None, n: int) -> np.ndarray:
    return np.bincount(row, weights, minlength=n)
