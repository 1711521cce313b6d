"""Whole texts as flat byte arrays: word bounds, word and n-gram hashes, minimiser anchors.

Everything here is a helper that runs inside one Spark task on one bounded block of rows. A block holds at most
``limit`` bytes of text, or one text if that alone is longer. Nulls count as empty texts. Words are maximal runs of
bytes outside ``[\\x20\\x09-\\x0D]``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base & (2**64 - 1), U)
        have[0] = 1
        have = np.cumprod(have, dtype=U)
        if n <= 1 << 22:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class PrefixHash:
    """Hashes of any slices of one sequence from its prefix sums (polynomial modulo 2**64)."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(values.astype(U, copy=False) * powers(BASE, n), dtype=U, out=self.sums[1:])
        self.inverse = powers(INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = (end - start).astype(U)
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + size * U(0xD6E8FEB86659FD93))


@dataclass
class Block:
    """Rows lo..hi of a batch: their bytes and, per row, offsets into them."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def blocks(column: pa.Array, limit: int = 1 << 20) -> Iterator[Block]:
    """The texts of a string column in blocks of bounded size."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield Block(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


@dataclass
class Words:
    """Words of a block: byte bounds, and per row the range ``first[i]..first[i+1]`` of its words."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(block: Block) -> Words:
    data, offsets = block.data, block.offsets
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(SPACE[data], out=inside[1:-1])
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return Words(start, end, np.searchsorted(start, offsets))


def word_hashes(block: Block, w: Words, lower: bool = False) -> np.ndarray:
    data = LOWER[block.data] if lower else block.data
    return PrefixHash(data.astype(U) + U(1)).of(w.start, w.end)


def ngram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive values; rows are not regarded."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    total = np.zeros(n, U)
    for j in range(k):
        total += h[j : j + n] * U(pow(BASE, j + 1, 1 << 64))
    return mix(total)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    span, out = 1, x
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


@dataclass
class Anchors:
    """Minimiser anchors: each stands for the windows that start at words lo..hi (numbered in the block)."""

    row: np.ndarray
    at: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    key: np.ndarray
    context: np.ndarray


def anchors(h: np.ndarray, first: np.ndarray, window: int, k: int) -> Anchors:
    """For every window of ``window`` words the place of its least k-gram hash (leftmost of equals).

    The choice looks at nothing but the window's words, so equal windows have the same anchor; consecutive windows
    with one anchor form one row.
    """
    grams = ngram_hashes(h, k)
    wide = window - k + 1
    if len(grams) < wide:
        none = np.zeros(0, np.int64)
        return Anchors(none, none, none, none, none.astype(U), none.astype(U))
    bits = max(20, int(len(grams)).bit_length())
    low = U((1 << bits) - 1)
    chosen = (sliding_min((grams & ~low) | np.arange(len(grams), dtype=U), wide) & low).astype(np.int64)
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(chosen)]
    valid = np.arange(len(chosen)) + window <= first[rows + 1]
    new = np.ones(len(chosen), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (rows[1:] != rows[:-1]) | ~valid[:-1]
    lo = np.flatnonzero(new & valid)
    after = np.flatnonzero(new | ~valid)
    nxt = np.searchsorted(after, lo, "right")
    hi = np.where(nxt < len(after), after[np.minimum(nxt, len(after) - 1)], len(chosen)) - 1
    at = chosen[lo]
    context = PrefixHash(h).of(lo, hi + window) + mix(((at - lo).astype(U) << U(32)) + (hi - lo).astype(U))
    return Anchors(rows[lo], at, lo, hi, grams[at], context)


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(U, copy=False).view(np.int64)
