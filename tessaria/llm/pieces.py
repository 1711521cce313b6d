"""SentencePiece encoding by forward-filtering backward-sampling over the piece lattice, and decoding.

A unit is a space with what follows it up to the next space (or the start of a text up to its first space); pieces do
not cross units. Within a unit every segmentation into vocabulary pieces has a weight, the product of its pieces'
weights 1 / (1 + rank) to the power ``sharpness``; a character that is no piece itself is written as its UTF-8 bytes.
The forward pass sums weights up to every position, once per distinct unit of a block; the backward pass draws, for each
occurrence, the last piece, then the one before it, and so on, in proportion to the sums. Draws come from a counter-based
generator over (seed, row key, position in the text), so a row's segmentation depends on nothing else: not on the
partitioning, the batch or a repeated task.

Decoding joins the pieces and bytes; it gives back every text exactly, white space and the space mark included. Nulls
and empty texts have no pieces. Repeated rows with one key are segmented alike; rows without a key share one. Empty tables
give no rows. Columns other than doc_id and text are not read. A unit (text without a space) is sampled in strips.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaria.llm.blocks import Block, PrefixHash, U, blocks, mix
from tessaria.llm.tokens import distinct, spread

SPACE_MARK = "▁"
SEED, SHARPNESS = 17, 1.0
#: Code points of units that are sampled together, and the key of rows without one.
SLICE, STRIP, NO_KEY = 1_000_000, 1 << 18, -(1 << 63)
TINY, LIFT = 2.0**-400, 2.0**400


class Lattice:
    """The pieces of a SentencePiece model as hash tables over code points."""

    def __init__(self, path: str, sharpness: float = SHARPNESS):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.byte_ids = np.zeros(256, np.int32)
        self.text: list[bytes] = [b""] * n
        self.single = np.zeros(n, bool)
        usable: dict[str, tuple[int, float]] = {}
        ranked = sorted((i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))), key=lambda i: (-model.get_score(i), i))
        for i in range(n):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:5], 16)
                self.byte_ids[value], self.text[i], self.single[i] = i, bytes([value]), True
        for rank, i in enumerate(ranked):
            piece = model.id_to_piece(i)
            self.text[i] = piece.replace(SPACE_MARK, " ").encode()
            plain = piece.replace(SPACE_MARK, " ")
            if plain and " " not in plain[1:]:
                usable[plain] = (i, (1.0 + rank) ** -sharpness)
        self.usable = usable
        self.byte_weight = (1.0 + len(ranked)) ** -sharpness
        self.longest = max(map(len, usable))
        points = [np.frombuffer(p.encode("utf-32-le"), np.uint32) for p in usable]
        size = np.array([len(p) for p in points])
        end = np.cumsum(size)
        keys = PrefixHash(np.concatenate(points).astype(U) + U(1)).of(end - size, end)
        ids = np.array([i for i, _ in usable.values()], np.int32)
        weights = np.array([w for _, w in usable.values()])
        order = np.argsort(keys)
        self.keys, self.ids, self.weights = keys[order], ids[order], weights[order]
        # two levels: the first key of each leading-bits slot, then a short walk
        self.slots = np.searchsorted(self.keys >> U(46), np.arange((1 << 18) + 1, dtype=U))
        self.depth = int(np.diff(self.slots).max())
        lengths = np.array([len(t) for t in self.text])
        self.text_at = np.concatenate(([0], np.cumsum(lengths)))
        self.text_bytes = np.frombuffer(b"".join(self.text), np.uint8)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index into ids and weights, or -1."""
        slot = (keys >> U(46)).astype(np.intp)
        at, stop = self.slots[slot], self.slots[slot + 1]
        out = np.full(len(keys), -1, np.int64)
        for j in range(self.depth):
            look = np.flatnonzero(at + j < stop)
            if not len(look):
                break
            hit = look[self.keys[at[look] + j] == keys[look]]
            out[hit] = at[hit] + j
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return self.text_bytes[spread(self.text_at[ids], self.text_at[ids + 1] - self.text_at[ids])].tobytes()


@lru_cache(maxsize=2)
def lattice(path: str, sharpness: float = SHARPNESS) -> Lattice:
    return Lattice(path, sharpness)


def uniform(row_seed: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Draws in [0, 1) that depend on the row's seed and a position alone."""
    return (mix(row_seed + position.astype(U) * U(0x9E3779B97F4A7C15)) >> U(11)).astype(float) * 2.0**-53


def row_seeds(keys: np.ndarray, seed: int) -> np.ndarray:
    return mix(mix(keys.astype(np.int64).view(U)) + U(seed))


def sample(block: Block, keys: np.ndarray, model: Lattice, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all rows of a block, and per row the place of its first. Units are taken ``SLICE`` code points at a time,
    those longer than ``STRIP`` alone and in strips of that length, so memory grows with a text by its ids alone."""
    points = np.frombuffer(block.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((block.data & 0xC0) != 0x80)
    if len(lead) != len(points):
        raise ValueError("texts must be valid UTF-8")
    byte_at = np.concatenate((lead, [len(block.data)]))
    rows_at = np.searchsorted(lead, block.offsets)
    start = np.unique(np.concatenate((np.flatnonzero(points == 32), rows_at[:-1])))
    start = start[start < len(points)]
    if not len(start):
        return np.zeros(0, np.int32), np.zeros(len(keys) + 1, np.int64)
    stop = np.concatenate((start[1:], [len(points)]))
    row = np.searchsorted(rows_at, start, "right") - 1
    seeds, origin = row_seeds(keys, seed)[row], start - rows_at[row]
    long = np.append(np.flatnonzero(stop - start > STRIP), len(start))
    found, lo = [], 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(stop, start[lo] + SLICE, "right")))
        hi = min(hi, int(long[np.searchsorted(long, lo, "right")]))
        if stop[lo] - start[lo] > STRIP:
            hi = lo + 1
            found.append(sample_long(points, int(start[lo]), int(stop[lo]), seeds[lo], int(origin[lo]), model))
        else:
            found.append(sample_units(points, start[lo:hi], stop[lo:hi], seeds[lo:hi], origin[lo:hi], model))
        lo = hi
    where, ids = (np.concatenate(x) for x in zip(*found, strict=True))
    count = np.where(ids >= 0, 1, byte_at[where + 1] - byte_at[where])
    out = np.repeat(ids, count)
    lost = np.repeat(ids < 0, count)
    out[lost] = model.byte_ids[block.data[spread(byte_at[where[ids < 0]], count[ids < 0])]]
    sums = np.concatenate(([0], np.cumsum(count)))
    return out, sums[np.searchsorted(where, rows_at)]


def sample_units(points: np.ndarray, start: np.ndarray, stop: np.ndarray, seeds: np.ndarray, origin: np.ndarray, model: Lattice) -> tuple[np.ndarray, np.ndarray]:
    """Places and ids (-1: as bytes) of the pieces drawn for consecutive units, in order."""
    size, base_at = stop - start, start[0]
    index, place = distinct(PrefixHash(points[base_at : stop[-1]].astype(U) + U(1)).of(start - base_at, stop - base_at))
    # distinct units, longest first, laid out one after another
    index_order = np.argsort(-size[index], kind="stable")
    rank = np.empty(len(index), np.int64)
    rank[index_order] = np.arange(len(index))
    index, place = index[index_order], rank[place]
    own = size[index]
    first = np.cumsum(own) - own
    flat = points[spread(start[index], own)].astype(U) + U(1)
    prefix, depth = PrefixHash(flat), np.arange(len(flat)) - np.repeat(first, own)
    total, longest = len(flat), model.longest
    weight, piece = np.zeros((total, longest)), np.full((total, longest), -1, np.int32)
    for size_ in range(1, longest + 1):
        end = np.flatnonzero(depth >= size_ - 1)
        found = model.find(prefix.of(end - size_ + 1, end + 1))
        some = found >= 0
        weight[end[some], size_ - 1] = model.weights[found[some]]
        piece[end[some], size_ - 1] = model.ids[found[some]]
    alone = piece[:, 0] < 0
    code = flat[alone] - U(1)
    n_bytes = 1 + (code >= U(0x80)).astype(np.int64) + (code >= U(0x800)) + (code >= U(0x10000))
    weight[alone, 0] = np.array([1.0, *np.cumprod(np.full(4, model.byte_weight))])[n_bytes]
    chance = np.empty((total, longest))
    before = np.zeros((len(own), longest))
    before[:, 0] = 1.0
    for t in range(int(own[0])):
        active = int(np.searchsorted(-own, -t, "left"))
        at = first[:active] + t
        terms = np.cumsum(before[:active] * weight[at], axis=1)
        now = terms[:, -1:]
        chance[at] = terms / now
        before = np.concatenate((now, before[:active, :-1]), axis=1)
        small = now[:, 0] < TINY
        if small.any():
            before[small] *= LIFT
    # backward: every occurrence from its end to its start
    left, base = size.copy(), first[place]
    live = np.arange(len(start))
    where, ids = [], []
    while len(live):
        at = base[live] + left[live] - 1
        draw = uniform(seeds[live], origin[live] + left[live])
        took = np.minimum((chance[at] <= draw[:, None]).sum(axis=1), longest - 1)
        left[live] -= took + 1
        where.append(start[live] + left[live])
        ids.append(piece[at, took])
        live = live[left[live] > 0]
    where, ids = np.concatenate(where), np.concatenate(ids)
    order = np.argsort(where)
    return where[order], ids[order]


def strip(unit: np.ndarray, lo: int, hi: int, before: np.ndarray, model: Lattice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the ends lo .. hi - 1 in a unit: chances of the pieces that end there, their ids, and the forward sums after them;
    ``before`` are those before lo. The same steps as in ``sample_units``."""
    longest, a = model.longest, max(0, lo - model.longest + 1)
    flat = unit[a:hi].astype(U) + U(1)
    prefix, ends = PrefixHash(flat), np.arange(lo, hi)
    weight, piece = np.zeros((hi - lo, longest)), np.full((hi - lo, longest), -1, np.int32)
    for size in range(1, longest + 1):
        end = ends[ends >= size - 1]
        found = model.find(prefix.of(end - size + 1 - a, end + 1 - a))
        some = found >= 0
        weight[end[some] - lo, size - 1] = model.weights[found[some]]
        piece[end[some] - lo, size - 1] = model.ids[found[some]]
    alone = piece[:, 0] < 0
    code = unit[lo:hi][alone]
    n_bytes = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
    weight[alone, 0] = np.array([1.0, *np.cumprod(np.full(4, model.byte_weight))])[n_bytes]
    chance = np.empty((hi - lo, longest))
    for t in range(hi - lo):
        terms = np.cumsum(before * weight[t])
        now = terms[-1]
        chance[t] = terms / now
        before = np.concatenate(([now], before[:-1]))
        if now < TINY:
            before *= LIFT
    return chance, piece, before


def sample_long(points: np.ndarray, start: int, stop: int, seed: np.uint64, origin: int, model: Lattice) -> tuple[np.ndarray, np.ndarray]:
    """``sample_units`` for one unit of any length: forward once, keeping the sums at the strips' bounds alone, then backward
    strip by strip, each made again from its bound."""
    unit, n = points[start:stop], stop - start
    bounds = [*range(0, n, STRIP), n]
    before = np.zeros(model.longest)
    before[0] = 1.0
    held = [before]
    for lo, hi in zip(bounds[:-2], bounds[1:-1], strict=True):
        held.append(strip(unit, lo, hi, held[-1], model)[2])
    where, ids, left = [], [], n
    for lo, hi, before in zip(bounds[-2::-1], bounds[:0:-1], held[::-1], strict=True):
        chance, piece, _ = strip(unit, lo, hi, before, model)
        draws = uniform(np.full(hi - lo, seed), origin + np.arange(lo, hi) + 1)
        while left > lo:
            at = left - 1 - lo
            took = min(int((chance[at] <= draws[at]).sum()), model.longest - 1)
            left -= took + 1
            where.append(start + left)
            ids.append(piece[at, took])
    return np.asarray(where[::-1], np.int64), np.asarray(ids[::-1], np.int32)


def encode(docs: DataFrame, path: str, seed: int = SEED, sharpness: float = SHARPNESS, with_ids: bool = True) -> DataFrame:
    """doc_id, n_pieces, n_bytes (pieces that are single bytes), ids_crc32 (unsigned, little-endian 32-bit ids),
    lossless (decoding gives the text back), and the ids (array<int>) on demand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(path, sharpness)
        for batch in batches:
            for block in blocks(batch.column(1), 2 << 20):
                n = block.hi - block.lo
                own = batch.column(0).slice(block.lo, n)
                ids, at = sample(block, np.asarray(own.fill_null(NO_KEY)), model, seed)
                raw = memoryview(ids.astype("<u4").tobytes())
                bounds = at.tolist()
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                same = [model.decode(ids[a:b]) == block.text(i) for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))]
                single = np.concatenate(([0], np.cumsum(model.single[ids])))
                made = [own, pa.array(np.diff(at)), pa.array(single[at[1:]] - single[at[:-1]]), pa.array(crc, pa.int64()), pa.array(same)]
                names = ["doc_id", "n_pieces", "n_bytes", "ids_crc32", "lossless"]
                if with_ids:
                    made.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(made, names)

    schema = "doc_id long, n_pieces long, n_bytes long, ids_crc32 long, lossless boolean" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) to (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(path)
        for batch in batches:
            texts = [None if x is None else model.decode(np.asarray(x, np.int64)).decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), vocabulary(), with_ids=False)
