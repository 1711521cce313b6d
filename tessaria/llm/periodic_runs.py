"""Periodic runs in word sequences, by longest previous factors.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends keeping that period, of
``max(LEAST, 2 * q)`` words or more. Per block of texts:

1. ``Factors`` ranks all stretches of 1, 2, 4 ... words of each text until no stretch repeats. The last ranks are the
   suffix array; common lengths to both sides of any two places (and so the LCP array) are read from the ranks, exactly.
2. Suffix array and LCP give the longest previous factor of each place by one pass with a stack, and these the LZ blocks.
3. A run that touches or crosses the bound of two LZ blocks has a period shorter than both together (Main): every such
   period is extended from the bound to both sides. Twice a text's words are tried at most.
4. A run inside one LZ block is a copy of a run inside that block's earlier occurrence: runs in buckets by their start are
   copied, block by block from the left.

A run of 12 words or more makes some six words repeat in the text, so texts without such a repeat leave after a count of
six-word hashes. Word identity is a 64-bit hash. Memory: about 4 bytes a word and level (levels: binary logarithm of the
longest repeat) and 150 bytes a word besides, in blocks of ``BLOCK`` bytes or one longer text.

Nulls and empty texts: no words, no runs, digests of the empty string. Rows are judged one by one, so repeated rows give
equal results; the longest run is the first of equals, then that of the smallest period. An empty table gives no rows. Of
other columns only ``keep`` is carried, and a name there that SCHEMA has too is refused. A missing doc_id stays null, and its text gets no planted repetition.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaria.llm.blocks import blocks, mix, ngram_hashes, word_hashes, words
from tessaria.llm.tokens import spread

LEAST = 12
BLOCK, CANDIDATES = 1 << 20, 1 << 20
SCHEMA = "n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class Factors:
    """Ranks of the stretches of 2**j items from every place; items beyond a text's end sort before all others.

    ``levels[j][i] == levels[j][k]`` exactly where the stretches at i and k are equal and in one text. A rank is the place of
    the first equal stretch in sorted order (texts first), so unequal ones keep their rank on later levels.
    """

    def __init__(self, items: np.ndarray, text: np.ndarray, first: np.ndarray):
        n = len(items)
        self.first, self.text = first, text
        stop = first[1:][text]
        rank = np.full(n + 1, -1, np.int32)
        key = (text << 32) | items
        rank[:n], again = self._ranked(key, np.zeros(n, np.int64), np.arange(n))
        self.levels = [rank]
        step = 1
        while len(again):
            head = rank[again].astype(np.int64)
            ahead = np.where(again + step < stop[again], rank[np.minimum(again + step, n)], -1).astype(np.int64)
            rank = rank.copy()
            rank[again], left = self._ranked((head << 32) | (ahead + 1), head, again)
            again, step = again[left], step * 2
            self.levels.append(rank)
        self.order = np.empty(n, np.int32)
        self.order[rank[:n]] = np.arange(n, dtype=np.int32)

    @staticmethod
    def _ranked(key: np.ndarray, head: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """New ranks of places that shared the ranks ``head``, and which places (by index) still share theirs."""
        n = len(key)
        order = np.argsort(key, kind="stable")
        key, head, t = key[order], head[order], np.arange(n)
        new = np.ones(n, bool)
        new[1:] = key[1:] != key[:-1]
        group = np.ones(n, bool)
        group[1:] = head[1:] != head[:-1]
        at = head + t - np.maximum.accumulate(np.where(group, t, 0))
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, at, 0))
        alone = new & np.append(new[1:], True)
        return rank, np.sort(order[~alone])

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many items from a and from b on are equal (a and b differ and are in one text)."""
        a, b, start = a.copy(), b.copy(), a
        for j in range(len(self.levels) - 2, -1, -1):
            step = (self.levels[j][a] == self.levels[j][b]).astype(np.int64) << j
            a += step
            b += step
        return a - start

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many items before a and before b are equal (a < b, in the text that has the item b - 1)."""
        least = self.first[self.text[b - 1]]
        a, b, start = a.copy(), b.copy(), a
        for j in range(len(self.levels) - 2, -1, -1):
            there = a - (1 << j) >= least
            step = (there & (self.levels[j][np.maximum(a - (1 << j), 0)] == self.levels[j][np.maximum(b - (1 << j), 0)])).astype(np.int64) << j
            a -= step
            b -= step
        return start - a


def previous_factors(factors: Factors) -> tuple[np.ndarray, np.ndarray]:
    """Per place the length of the longest stretch from there that also starts at an earlier place of its text, and that place."""
    order = factors.order
    n = len(order)
    common = np.zeros(n, np.int32)
    same = np.flatnonzero(factors.text[order[1:]] == factors.text[order[:-1]]) + 1
    common[same] = factors.ahead(order[same - 1].astype(np.int64), order[same].astype(np.int64))
    length, source = np.zeros(n, np.int32), np.zeros(n, np.int32)
    put, origin = memoryview(length), memoryview(source)
    places: list[int] = []
    shared: list[int] = []
    for place, low in zip(memoryview(order), memoryview(common)):
        while places and places[-1] > place:
            top, best = places.pop(), shared.pop()
            if best >= low:
                put[top] = best
                origin[top] = places[-1] if places else 0
                if best > low:
                    continue
            else:
                put[top] = low
                origin[top] = place
                low = min(low, best)
        places.append(place)
        shared.append(low)
    while places:
        top, best = places.pop(), shared.pop()
        put[top] = best
        origin[top] = places[-1] if places else 0
    return length, source


def lz_blocks(length: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all LZ blocks, and the number of blocks of each text."""
    starts, counts, sizes = [], [], memoryview(length)
    for i, stop in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        before = len(starts)
        while i < stop:
            starts.append(i)
            i += sizes[i] or 1
        counts.append(len(starts) - before)
    return np.asarray(starts, np.int64), np.asarray(counts, np.int64)


def crossing_runs(factors: Factors, starts: np.ndarray, counts: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, end, period) of all runs that touch or cross the bound of two blocks, or a text's end."""
    first = factors.first
    text = np.repeat(np.arange(len(counts)), counts)
    size = np.diff(np.append(starts, first[-1]))
    head = np.zeros(len(starts), bool)
    head[np.cumsum(counts) - counts] = True
    own = np.flatnonzero(~head)
    last = np.cumsum(counts) - 1
    bound = np.concatenate((starts[own], first[1:]))
    most = np.concatenate((size[own - 1] + size[own] - 1, size[last]))
    lo, hi = first[:-1][np.concatenate((text[own], text[last]))], first[1:][np.concatenate((text[own], text[last]))]
    # a run has least / 2 matches side by side, so from 6 words on two or more on one side of the bound
    level = int(least >= 6 and len(factors.levels) > 1)
    near_by, width = factors.levels[level], 1 << level
    found = []
    cuts = np.searchsorted(np.cumsum(most), np.arange(CANDIDATES, int(most.sum()) + CANDIDATES, CANDIDATES), "left") + 1
    for a, b in zip(np.concatenate(([0], cuts[:-1])).tolist(), cuts.tolist(), strict=True):
        every = np.repeat(np.arange(a, min(b, len(most))), most[a:b])
        every_period = spread(np.ones(min(b, len(most)) - a, np.int64), most[a:b])
        for c in range(0, len(every), CANDIDATES):
            which, period = every[c : c + CANDIDATES], every_period[c : c + CANDIDATES]
            for right in (True, False):
                x = bound[which] - (0 if right else period)
                y = x + period
                inside = (x >= lo[which]) & (y <= hi[which])
                x, y, q, w = x[inside], y[inside], period[inside], which[inside]
                near = (y < hi[w]) & (near_by[x] == near_by[y])
                near |= (x - width >= lo[w]) & (near_by[np.maximum(x - width, 0)] == near_by[np.maximum(y - width, 0)])
                x, y, q = x[near], y[near], q[near]
                before, after = factors.behind(x, y), factors.ahead(x, y)
                long = (before + after >= q) & (before + after + q >= least)
                found.append(np.stack((x[long] - before[long], y[long] + after[long], q[long]), axis=1))
    runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[new]


def copied_runs(runs: np.ndarray, starts: np.ndarray, total: int, source: np.ndarray, least: int = LEAST) -> np.ndarray:
    """``runs`` and the runs strictly inside one block, copied from the block's earlier occurrence."""
    buckets: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for s, e, q in runs.tolist():
        buckets[s].append((e, q))
    size = np.diff(np.append(starts, total))
    more = []
    for i in np.flatnonzero(size >= least + 2).tolist():
        start, n = int(starts[i]), int(size[i])
        origin = int(source[start])
        shift, stop = start - origin, origin + n
        for s in range(origin + 1, stop - least):
            if s in buckets:
                for e, q in buckets[s]:
                    if e < stop:
                        buckets[s + shift].append((e + shift, q))
                        more.append((s + shift, e + shift, q))
    return np.concatenate((runs, np.asarray(more, np.int64).reshape(-1, 3))) if more else runs


def runs_of(codes: np.ndarray, first: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, end, period), by start and period, of all runs of all texts: ``codes`` are their items one text after
    another, ``first[t]`` a text's first place."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    grams = ngram_hashes(codes, max(1, least // 2))
    inside = np.flatnonzero(text[: len(grams)] == text[len(text) - len(grams) :])
    key = grams[inside] + mix(text[inside])
    order = np.argsort(key)
    again = key[order][1:] == key[order][:-1]
    some = np.unique(text[inside][order[1:][again]])
    if not len(some):
        return np.zeros((0, 3), np.int64)
    sizes = np.diff(first)[some]
    place = spread(first[some], sizes)
    own = np.zeros(len(some) + 1, np.int64)
    np.cumsum(sizes, out=own[1:])
    _, items = np.unique(codes[place], return_inverse=True)
    factors = Factors(items.astype(np.int64), np.repeat(np.arange(len(some)), sizes), own)
    length, source = previous_factors(factors)
    starts, counts = lz_blocks(length, own)
    runs = copied_runs(crossing_runs(factors, starts, counts, least), starts, int(own[-1]), source, least)
    shift = (first[some] - own[:-1])[factors.text[runs[:, 0]]]
    runs = runs + np.stack((shift, shift, np.zeros_like(shift)), axis=1)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Places that the words of a text are taken from, where its number says that they repeat."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    place = np.arange(n)
    place[a:] = a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return place


def detect(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), reorder: Callable[[object, int], np.ndarray | None] | None = None, least: int = LEAST) -> DataFrame:
    """The ``keep`` columns, then SCHEMA. ``reorder(first keep column's value, number of words)`` may give the places that a
    text's words are taken from."""
    others = [c for c in keep if c != "text"]
    made_here = [x.split()[0] for x in SCHEMA.split(", ")]
    if clash := set(keep) & set(made_here):
        raise ValueError(f"columns {sorted(clash)} are made here: rename them first")
    names = [*keep, *made_here]
    runs_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0), BLOCK):
                own = [batch.column(0 if c == "text" else 1 + others.index(c)).slice(block.lo, block.hi - block.lo) for c in keep]
                w = words(block)
                place, moved = np.arange(len(w.start)), set()
                for i, value in enumerate(own[0].to_pylist() if reorder else ()):
                    a, b = int(w.first[i]), int(w.first[i + 1])
                    new = reorder(value, b - a)
                    if new is not None:
                        place[a:b] = a + new
                        moved.add(i)
                runs = runs_of(word_hashes(block, w)[place], w.first, least)
                edge = np.searchsorted(runs[:, 0], w.first)
                depth = np.zeros(len(w.start) + 1, np.int64)
                np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
                np.add.at(depth, runs[:, 1], -1)
                kept = np.cumsum(depth[:-1]) == 0
                out: list[list] = [[] for _ in range(9)]
                for i in range(block.hi - block.lo):
                    a, b = int(w.first[i]), int(w.first[i + 1])
                    mine = [(s - a, e - s, q) for s, e, q in runs[edge[i] : edge[i + 1]].tolist()]
                    cut, text = int(block.offsets[i]), block.text(i)
                    if mine or i in moved:
                        at = place[a:b][kept[a:b]]
                        pieces = [text[s:e] for s, e in zip((w.start[at] - cut).tolist(), (w.end[at] - cut).tolist(), strict=True)]
                    else:
                        pieces = text.split()
                    collapsed = b" ".join(pieces)
                    best = max(mine, key=lambda r: (r[1], -r[0], -r[2]), default=None)
                    listed = "".join(f"{s},{n},{q}\n" for s, n, q in mine)
                    row = (len(mine), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest(), [dict(zip(("start", "length", "period"), r, strict=True)) for r in mine], collapsed)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                made = [pa.array(np.diff(w.first).astype(np.int64)), *(pa.array(x, pa.int64()) for x in out[:5]), *(pa.array(x, pa.string()) for x in out[5:7]), pa.array(out[7], runs_type), pa.array(out[8], pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*own, *made], names)

    kinds = ", ".join(f"`{c}` {'string' if c == 'text' else docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(F.col("text").cast("string"), *others).mapInArrow(run, f"{kinds}, {SCHEMA}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return detect(docs, reorder=planted).drop("n_words", "runs", "collapsed")


#: Every two equal words of a text and their distance; islands of consecutive places with one distance are the runs.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda c, x: xor(xor(c, x) >> 1, (xor(c, x) & 1) * 3988292384)), 4294967295::BIGINT) AS h FROM documents),
p AS (SELECT doc_id, w, len(w)::BIGINT AS n, h % 10 = 0 AND len(w) > 0 AS planted, h // 10 AS g FROM d),
m AS (SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i >= g % n THEN g % n + (i - g % n) % (1 + (n - g % n) // (3 + g % 8)) ELSE i END]) ELSE w END AS w FROM p),
t AS (SELECT doc_id, unnest(w) AS x, unnest(range(n)) AS i FROM m),
same AS (SELECT a.doc_id, b.i - a.i AS q, a.i FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.x = b.x AND a.i < b.i),
island AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM same) GROUP BY doc_id, q, k
  HAVING count(*) >= q AND count(*) + q >= 12),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM island GROUP BY doc_id, start, length),
agg AS (SELECT doc_id, count(*) AS n_runs, max_by({'s': start, 'n': length, 'q': period}, {'a': length, 'b': -start, 'c': -period}) AS best,
  string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
left_ AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM t ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.n::BIGINT AS length, best.q::BIGINT AS period, (1000 * best.n // best.q)::BIGINT AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM m LEFT JOIN agg USING (doc_id) LEFT JOIN left_ USING (doc_id)
"""
