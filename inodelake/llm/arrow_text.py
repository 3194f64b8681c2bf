"""Vectorised text primitives over Arrow string buffers (numpy only, no per-document Python).

Words are runs of bytes other than space and TAB..CR, that is ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULT, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(_MULT))


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as floats in (0, 1]."""
    return ((x >> U64(11)).astype(np.float64) + 1.0) * (1.0 / (1 << 53))


class _Powers:
    """Powers of the multiplier and of its inverse modulo 2^64, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 20)
            both = []
            for m in (_MULT, _INVERSE):
                steps = np.full(n, m, U64)
                steps[0] = 1
                both.append(np.cumprod(steps, dtype=U64))
            self.up, self.down = both
        return self.up, self.down


_POWERS = _Powers()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's offsets into them; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of ``column``; a longer row comes alone, whole."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        offsets = utf8(batch.column(column))[1]
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            to = min(to, n)
            yield batch.slice(at, to - at)
            at = to


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of bytes that ``between`` does not mark, in order."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = ~between[data]
    bounds = offsets[:-1][offsets[:-1] < offsets[1:]]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[bounds] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[bounds[1:] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


class Hasher:
    """64-bit hashes of any substrings of one symbol array, after one pass over it."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.up, self.down = _POWERS.get(len(symbols) + 1)
        coded = _BYTE[symbols] if symbols.dtype == np.uint8 else mix(symbols.astype(U64) * U64(_MULT) + U64(7))
        self.sums = np.zeros(len(symbols) + 1, U64)
        np.cumsum(coded * self.up[: len(symbols)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


def shingles(word_hashes: np.ndarray, rows: np.ndarray, n_rows: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``size`` words and their rows; a row of fewer words has one shingle of all of them."""
    n = len(word_hashes)
    counts = np.bincount(rows, minlength=n_rows)
    short = np.flatnonzero((counts > 0) & (counts < size))
    out_h, out_r = [], []
    if n >= size:
        acc = np.zeros(n - size + 1, U64)
        for k in range(size):
            acc = acc * U64(_MULT) + word_hashes[k : n - size + 1 + k]
        whole = rows[: n - size + 1] == rows[size - 1 :]
        out_h.append(mix(acc[whole]))
        out_r.append(rows[: n - size + 1][whole])
    if len(short):
        first = np.cumsum(counts) - counts
        for r in short:
            acc = U64(counts[r])
            with np.errstate(over="ignore"):
                for h in word_hashes[first[r] : first[r] + counts[r]]:
                    acc = acc * U64(_MULT) + h
            out_h.append(mix(np.array([acc])))
            out_r.append(np.array([r]))
    if not out_h:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return np.concatenate(out_h), np.concatenate(out_r)
