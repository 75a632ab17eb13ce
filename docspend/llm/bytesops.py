"""Vectorised work on the UTF-8 bytes of Arrow string columns.

The Python stages of this package never build one Python string per word: they look at the
bytes of a whole batch at once with numpy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes handled at a time, so that the 8-byte helper arrays stay near 100 MB.
CHUNK_BYTES = 1_000_000

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes of words of letters (ASCII, and all beyond), and of letters and digits.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
ALNUM = LETTERS.copy()
ALNUM[0x30:0x3A] = True


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, at, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunked(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `most` bytes; one long document is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every bit of the result depends on every bit of x."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: Bytes of a lane; spans of more than LONG bytes are hashed and compared one by one.
LANE, LONG = 8, 512
#: Masks that leave the first k bytes of a lane.
FIRST = np.array([(1 << 8 * k) - 1 for k in range(LANE + 1)], U64)


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of data on, as little-endian numbers (zeros follow its end)."""
    padded = np.concatenate([data, np.zeros(LANE, np.uint8)])
    return np.ndarray(len(data) + 1, np.dtype("<u8"), padded, strides=(1,))


class SpanHash:
    """64-bit hashes of many byte spans, eight bytes at a time, each followed by a bijective finaliser.

    Different spans of the same length up to eight bytes never agree; others only by chance, so
    whoever must not mistake two spans compares them too (`span_ids`, `same_spans`).
    """

    def __init__(self, seed: int = 0x9E3779B97F4A7C15):
        self.seed = seed

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        out = mixed(size.astype(U64) + U64(self.seed))
        rows = np.flatnonzero((size > 0) & (size <= LONG))
        at, left, eight = starts[rows], size[rows], lanes(data)
        while len(rows):
            out[rows] = mixed((out[rows] ^ (eight[at] & FIRST[np.minimum(left, LANE)])) * U64(0xD6E8FEB86659FD93))
            more = left > LANE
            rows, at, left = rows[more], at[more] + LANE, left[more] - LANE
        key = self.seed.to_bytes(8, "little")
        for i in np.flatnonzero(size > LONG).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, key=key).digest(), "little")
        return out


def same_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, other: np.ndarray | None = None) -> np.ndarray:
    """Whether the size bytes of data from a on are those of other (data itself if None) from b on."""
    other = data if other is None else other
    same = np.ones(len(a), bool)
    rows = np.flatnonzero((size > 0) & (size <= LONG) & ((a != b) | (other is not data)))
    x, y, left, mine, theirs = a[rows], b[rows], size[rows], lanes(data), lanes(other)
    while len(rows):
        same[rows] &= ((mine[x] ^ theirs[y]) & FIRST[np.minimum(left, LANE)]) == 0
        more = left > LANE
        rows, x, y, left = rows[more], x[more] + LANE, y[more] + LANE, left[more] - LANE
    for i in np.flatnonzero(size > LONG).tolist():
        same[i] = np.array_equal(data[a[i] : a[i] + size[i]], other[b[i] : b[i] + size[i]])
    return same


def span_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, span: SpanHash) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dense ids that are equal for equal spans only, for each id one of its spans, and its hash."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    hashes, first, ids = np.unique(span(data, starts, ends), return_index=True, return_inverse=True)
    size = ends - starts
    agree = size == size[first[ids]]
    agree[agree] = same_spans(data, starts[agree], starts[first[ids[agree]]], size[agree])
    if not agree.all():  # different spans under one hash
        names, extra = {}, []
        for i in np.flatnonzero(~agree).tolist():
            name = data[starts[i] : ends[i]].tobytes()
            if name not in names:
                names[name] = len(first) + len(extra)
                extra.append(i)
            ids[i] = names[name]
        first = np.concatenate([first, extra])
        hashes = span(data, starts[first], ends[first])
    return ids, first, hashes


def words(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray = ~SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of these bytes; without more, of all but ASCII white space), and n+1 bounds of each document's words."""
    word = letters[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    starts = word.copy()
    starts[1:] &= ~word[:-1] | first[1 : len(data)]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | first[1 : len(data)]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def code_points(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Code points in each span of UTF-8 bytes."""
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=total[1:])
    return total[ends] - total[starts]


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the values between consecutive bounds."""
    total = np.zeros(len(values) + 1, np.result_type(values.dtype, np.int64))
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
