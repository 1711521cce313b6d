"""Suffix-array dedup with sparse suffix arrays.

Of all suffixes of all texts (in words) only those at minimiser positions are retained: every 50-word window has one,
chosen from its own words. Equal windows therefore meet in two retained suffixes that share their first 8 words.

1. Suffixes whose 8 words no other document has go. Those that agree in all words of their windows are one suffix of the
   array, held by its least document; later holders lose those windows.
2. The array: each remaining suffix with its next 50 and its previous 42 words, as codes of 32 bits. It is
   range-partitioned and sorted by the suffix, so one common passage spreads over many tasks.
3. Each suffix is compared with its ``NEAR`` neighbours on both sides. The match of two is extended word by word to the
   right and to the left; where both together make 50 words or more, the larger doc_id loses the windows of the match.
4. A suffix's longest match to the right is with a neighbour, which bounds the windows that a suffix farther away could
   still repeat. Where a bound leaves windows open that step 3 has not removed (and beside the edges of tasks), these
   windows alone are checked exactly, by hashes of their words.

A word is removed if a window of 50 words around it also starts in a document with a smaller doc_id. Nulls and empty
texts: no words, nothing removed. Repeated texts of 50 words or more lose all words but in the least doc_id. Rows of one
doc_id are one document, which takes nothing from itself; each is judged by its own text. Rows without doc_id are left out.
Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaria.llm.blocks import U, blocks, word_hashes, words
from tessaria.llm.spans import K, WINDOW, anchor_rows, by_document, listed, remove, texts_of, window_rows, within
from tessaria.operators.workspace import Workspace

#: Neighbours on each side that a suffix is compared with.
NEAR = 4
SUFFIX = "doc_id long, version long, at int, lo int, hi int, suffix binary, before binary"


def fixed(rows: np.ndarray) -> pa.Array:
    """Rows of codes as a binary column that sorts like them."""
    n, width = len(rows), rows.shape[1] * 4
    raw = np.ascontiguousarray(rows.astype(">u4")).view(np.uint8)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(raw)])


def codes(column: pa.Array, width: int) -> np.ndarray:
    data = np.frombuffer(column.buffers()[2], np.uint8)
    offset = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return data[offset : offset + len(column) * width * 4].reshape(-1, width * 4).view(">u4").astype(np.uint32)


def suffixes(texts: DataFrame, retained: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """The array's rows for retained places (doc_id, version, at, lo, hi); code 0 stands for no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, fields = listed(batch, 3)
            for block in blocks(batch.column(2)):
                row, (at, lo, hi) = within(block, rows, fields)
                w = words(block)
                code = np.maximum(word_hashes(block, w) >> U(32), U(1)).astype(np.uint32)
                code = np.append(code, np.uint32(0))
                first, last = w.first[row][:, None], w.first[row + 1][:, None]

                def around(steps: np.ndarray) -> np.ndarray:
                    place = first + at[:, None] + steps
                    return code[np.where((place >= first) & (place < last), place, len(code) - 1)]

                own = [batch.column(i).slice(block.lo, block.hi - block.lo).take(pa.array(row)) for i in (0, 1)]
                made = [pa.array(x.astype(np.int32)) for x in (at, lo, hi)]
                yield pa.RecordBatch.from_arrays([*own, *made, fixed(around(np.arange(window))), fixed(around(-1 - np.arange(window - k)))], [x.split()[0] for x in SUFFIX.split(", ")])

    rows = texts.join(by_document(retained.distinct(), "at", "lo", "hi"), "doc_id").select("doc_id", "version", "text", "ranges")
    return rows.mapInArrow(run, SUFFIX)


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each two rows of codes."""
    return np.logical_and.accumulate((a == b) & (a > 0), axis=1).sum(axis=1)


def neighbours(array: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """Ranges of windows from the sorted array: ``gone`` ones, and those that are open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        limit: np.ndarray | None = None
        sure: np.ndarray | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            old = 0 if held is None else held.num_rows
            table = new if held is None else pa.concat_tables([held, new]).combine_chunks()
            right, left = (codes(table[c].combine_chunks() if isinstance(table[c], pa.ChunkedArray) else table[c], n) for c, n in (("suffix", window), ("before", window - k)))
            doc, version, at, lo, hi = (table[c].to_numpy().astype(np.int64) for c in ("doc_id", "version", "at", "lo", "hi"))
            n = len(doc)
            # the longest match to the right; unknown (as long as can be) before a task's first row
            reach = np.zeros(n, np.int64) if held is None else np.concatenate((limit, np.zeros(n - old, np.int64)))
            covered = np.zeros(n, bool) if held is None else np.concatenate((sure, np.zeros(n - old, bool)))
            if held is None:
                reach[0] = window
            found = []
            for step in range(1, min(NEAR, n - 1) + 1):
                b = np.arange(max(old, step), n)
                a = b - step
                ahead = agreement(right[a], right[b])
                if step == 1:
                    reach[a] = np.maximum(reach[a], ahead)
                    reach[b] = np.maximum(reach[b], ahead)
                some = np.flatnonzero((ahead >= k) & (doc[a] != doc[b]))
                behind = agreement(left[a[some]], left[b[some]])
                long = ahead[some] + behind >= window
                a, b, ahead, behind = a[some][long], b[some][long], ahead[some][long], behind[long]
                loser = np.where(doc[a] > doc[b], a, b)
                start, stop = at[loser] - behind, at[loser] + ahead - window
                found.append((loser, start, stop))
                np.logical_or.at(covered, loser, (start <= lo[loser]) & (stop >= hi[loser]))
            loser, start, stop = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 3
            ready = slice(max(old - 1, 0), n - 1)
            yield ranges(doc, version, loser, start, stop, True)
            yield pending(doc, version, at, lo, hi, reach, covered, np.arange(n)[ready])
            tail = max(n - NEAR, 0)
            held, limit, sure = table.slice(tail), reach[tail:], covered[tail:]
        if held is not None:
            doc, version, at, lo, hi = (held[c].to_numpy().astype(np.int64) for c in ("doc_id", "version", "at", "lo", "hi"))
            limit[-1] = window
            yield pending(doc, version, at, lo, hi, limit, sure, np.array([len(doc) - 1]))

    def ranges(doc, version, row, start, stop, gone: bool) -> pa.RecordBatch:
        made = [pa.array(x) for x in (doc[row], version[row], start.astype(np.int32), stop.astype(np.int32), np.full(len(row), gone))]
        return pa.RecordBatch.from_arrays(made, ["doc_id", "version", "lo", "hi", "gone"])

    def pending(doc, version, at, lo, hi, reach, covered, row) -> pa.RecordBatch:
        """Windows that some suffix may repeat and no neighbour has removed."""
        stop = np.minimum(hi[row], at[row] + reach[row] - window)
        open_ = (stop >= lo[row]) & ~covered[row]
        return ranges(doc, version, row[open_], lo[row][open_], stop[open_], False)

    return array.select(*(x.split()[0] for x in SUFFIX.split(", "))).mapInArrow(run, "doc_id long, version long, lo int, hi int, gone boolean")


def repeats(space: Workspace, texts: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """Ranges (doc_id, version, lo, hi) of windows that also start in a smaller document; they may overlap."""
    rows = space.write(anchor_rows(texts, window, k), "anchors")
    keys = rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), (F.min("context") != F.max("context")).alias("multi"))
    keys = space.write(keys.filter("first < last").drop("last"), "keys")
    found = space.write(rows.join(keys, "key"), "found")
    plain = found.filter(~F.col("multi") & (F.col("doc_id") > F.col("first"))).select("doc_id", "version", "lo", "hi")
    several = found.filter("multi").select("doc_id", "version", "key", "context", "at", "lo", "hi")
    least = space.write(several.groupBy("key", "context").agg(F.min("doc_id").alias("own")), "contexts")
    held = space.write(several.join(least, ["key", "context"]).select("doc_id", "version", "at", "lo", "hi", (F.col("doc_id") > F.col("own")).alias("late")), "held")
    array = space.write(suffixes(texts, held.filter(~F.col("late")).drop("late"), window, k), "array")
    judged = space.write(neighbours(array.repartitionByRange("suffix", "doc_id").sortWithinPartitions("suffix", "doc_id"), window, k), "judged")
    space.drop("array")
    left = space.write(window_rows(texts, judged.filter(~F.col("gone")).drop("gone"), window), "windows")
    firsts = space.write(left.groupBy("hash").agg(F.min("doc_id").alias("own"), F.max("doc_id").alias("last")).filter("own < last").select("hash", "own"), "firsts")
    checked = left.join(firsts, "hash").filter(F.col("doc_id") > F.col("own")).select("doc_id", "version", F.col("start").alias("lo"), F.col("start").alias("hi"))
    return plain.unionByName(held.filter("late").select("doc_id", "version", "lo", "hi")).unionByName(judged.filter("gone").drop("gone")).unionByName(checked)


def dedup(docs: DataFrame, window: int = WINDOW, k: int = K, keep: tuple[str, ...] = ()) -> DataFrame:
    """The rows of ``spans.remove``."""
    texts = texts_of(docs, keep)
    return remove(texts, repeats(Workspace(docs.sparkSession, "suffixes"), texts.select("doc_id", "version", "text"), window, k), window, keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_words", "n_removed", "spans", F.sha2("kept", 256).alias("kept_sha256"))
