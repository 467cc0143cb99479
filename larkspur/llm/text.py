"""Words of whole Arrow text columns, as numpy arrays.

A word's hash sums a random value of each byte at its place in the word, read
off prefix sums, so a column costs a few vector passes and no Python object per
word. Another seed draws other values: hashes of two seeds are independent.
Long rows are summed in fixed pieces: memory follows the number of words, never
a row's square.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

PIECE = 1 << 15
_PLACES = np.arange(PIECE)
#: Places in a word whose byte values are tabulated; those of later places are computed.
NEAR = 64


@lru_cache
def _byte_values(seed: int) -> tuple[np.ndarray, np.uint64, np.ndarray]:
    """A random value of each byte, a random odd step from place to place, and the values of all bytes at the first NEAR places."""
    draw = np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, 257, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    values, step = draw[:256], draw[256]
    return values, step, mix((values[None, :] + np.arange(NEAR, dtype=np.uint64)[:, None] * step).ravel())


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True

#: Bytes between words: ASCII white space, or every ASCII character but letters and digits.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of a text column: row ``i`` has the words ``bounds[i]:bounds[i + 1]``."""

    def __init__(self, column, lower: bool = False, between: np.ndarray = WHITE, seed: int = 1, hashed: bool = True, split: bytes = b""):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
        column = column.cast(pa.large_binary()).fill_null(b"")
        at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.data, self.at = data[at[0] : at[-1]], at - at[0]
        n = len(self.data)
        inside = np.zeros(n + 1, bool)
        np.logical_not(between[self.data], out=inside[:n])
        first = np.zeros(n + 1, bool)
        first[self.at] = True
        before = np.zeros(n + 1, bool)
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | first))
        self.end = np.flatnonzero(before & (~inside | first))
        if split:  # one such byte after a last ASCII letter is a word of its own
            last = np.flatnonzero(self.end - self.start > 1)
            e = self.end[last]
            last = last[np.isin(self.data[e - 1], np.frombuffer(split, np.uint8)) & _LETTER[self.data[e - 2]]]
            self.start, self.end = np.insert(self.start, last + 1, self.end[last] - 1), np.insert(self.end, last, self.end[last] - 1)
        self.bounds = np.searchsorted(self.start, self.at)
        self.counts = np.diff(self.bounds)
        self.n = len(self.start)
        self.hash = self.hashes(lower, seed) if hashed else None

    def hashes(self, lower: bool, seed: int) -> np.ndarray:
        values, step, near = _byte_values(seed)
        low, high = np.zeros(self.n, np.uint64), np.zeros(self.n, np.uint64)
        carry = np.uint64(0)
        for p in range(0, len(self.data) if self.n else 0, PIECE):
            piece = self.data[p : p + PIECE]
            piece = _LOWER[piece] if lower else piece
            end = p + len(piece)
            a, b = max(0, int(np.searchsorted(self.start, p, "right")) - 1), int(np.searchsorted(self.start, end))
            place = _PLACES[: len(piece)]
            if b > a:  # a word's number of bytes before each byte; of no use, and any number, between words
                begin = self.start[a:b] - p
                edge = np.append(np.maximum(begin, 0), len(piece))
                place = place.copy()
                place[edge[0] :] -= np.repeat(begin, np.diff(edge))
            far = np.flatnonzero(place >= NEAR)
            at = place << 8
            at |= piece
            if len(far):
                at[far] = 0
            value = near[at]
            if len(far):
                value[far] = mix(values[piece[far]] + place[far].astype(np.uint64) * step)
            sums = np.empty(len(piece) + 1, np.uint64)
            sums[0] = carry
            np.cumsum(value, out=sums[1:])
            sums[1:] += carry
            carry = sums[-1]
            a, b = np.searchsorted(self.start, (p, end))
            low[a:b] = sums[self.start[a:b] - p]
            a, b = np.searchsorted(self.end, (p + 1, end + 1))
            high[a:b] = sums[self.end[a:b] - p]
        return mix(high - low)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def bytes_of(self, word: int) -> bytes:
        return self.data[self.start[word] : self.end[word]].tobytes()

    def text(self, row: int) -> bytes:
        return self.data[self.at[row] : self.at[row + 1]].tobytes()


def grams(ids: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """A hash of ids[i:i+k] for each i that has k ids from it on, by doubling; every doubling is mixed. Done in fixed pieces."""
    if k < 1 or len(ids) < k:
        return np.zeros(0, np.uint64)
    step, out = _byte_values(seed)[1], np.empty(len(ids) - k + 1, np.uint64)
    for p in range(0, len(out), PIECE):
        part = ids[p : p + PIECE + k - 1]
        known = {1: part}

        def of(width: int) -> np.ndarray:
            if width not in known:
                a = width // 2
                left, right = of(a), of(width - a)
                n = len(part) - width + 1
                known[width] = mix(left[:n] * step + right[a : a + n])
            return known[width]

        out[p : p + PIECE] = mix(of(k) + np.uint64(k))
    return out


def whole(words: Words, k: int) -> np.ndarray:
    """Whether the k words from each start on are all of its row; as long as grams(words.hash, k)."""
    n = max(0, words.n - k + 1)
    return np.arange(n) + k <= np.repeat(words.bounds[1:], words.counts)[:n]


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values; sorting is several times faster than hashing for 64-bit integers."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return x[new]


def release() -> None:
    """Gives freed memory back to the system: a worker that waits for its next task then holds little."""
    import ctypes

    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


_ZSTD = pa.Codec("zstd", 1)


def pack(x: np.ndarray, ordered: bool = False) -> bytes:
    """An integer array as bytes; ordered arrays as differences."""
    if ordered and len(x):
        x = np.diff(x, prepend=x.dtype.type(0))
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T
    return len(x).to_bytes(8, "little") + (_ZSTD.compress(np.ascontiguousarray(planes).tobytes(), asbytes=True) if len(x) else b"")


def unpack(b: bytes, dtype, ordered: bool = False) -> np.ndarray:
    n, size = int.from_bytes(b[:8], "little"), np.dtype(dtype).itemsize
    if not n:
        return np.zeros(0, dtype)
    planes = np.frombuffer(_ZSTD.decompress(b[8:], n * size, asbytes=True), np.uint8)
    x = np.ascontiguousarray(planes.reshape(size, n).T).view(dtype).reshape(n)
    return np.cumsum(x, dtype=dtype) if ordered else x


def cuts(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where sorted 64-bit keys pass from one of `shards` equal ranges to the next."""
    edges = np.arange(1, shards, dtype=np.uint64) * np.uint64(((1 << 64) - 1) // shards)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]).astype(np.int64)
