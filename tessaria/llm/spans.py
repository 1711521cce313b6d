"""Passages that repeat across documents: rows and steps that both substring operators use.

A window is ``window`` consecutive words of one document; it is removed if its word sequence also starts in a document
with a smaller id. Each window has one anchor, the place of its least k-gram hash, found from its own words alone, so
equal windows have equal anchor keys. Rows between the steps:

* text: doc_id, version (hash of the text, which tells rows of one doc_id apart), text;
* anchor: doc_id, version, key (k-gram hash), context (hash of all words of its windows and their place), at (the k-gram's
  place), lo, hi (its windows' first words);
* range: doc_id, version, lo, hi (first words of windows).

Hashes have 64 bits. Rows of one doc_id are one document: they take nothing from each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaria.llm.blocks import Block, PrefixHash, Words, anchors, blocks, signed, word_hashes, words
from tessaria.llm.tokens import spread

WINDOW, K = 50, 8
#: Bytes of text that a task works on at a time (or one longer text).
BLOCK = 1 << 18
ANCHOR = "doc_id long, version long, key long, context long, at int, lo int, hi int"


def texts_of(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Text rows (and the ``keep`` columns) of documents that have a doc_id."""
    text = F.col("text").cast("string")
    return docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("version"), text.alias("text"), *keep)


def anchor_rows(texts: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """All anchors of all whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2), BLOCK):
                w = words(block)
                a = anchors(word_hashes(block, w), w.first, window, k)
                base, row = w.first[a.row], pa.array(a.row)
                own = [batch.column(i).slice(block.lo, block.hi - block.lo).take(row) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(signed(a.key)), pa.array(signed(a.context)), *(pa.array((x - base).astype(np.int32)) for x in (a.at, a.lo, a.hi))], [x.split()[0] for x in ANCHOR.split(", ")])

    return texts.select("doc_id", "version", "text").mapInArrow(run, ANCHOR)


def by_document(ranges: DataFrame, *fields: str, buckets: int | None = None) -> DataFrame:
    """doc_id and its list of structs of version and ``fields`` (lo and hi); for texts in a table of so many ``buckets`` by
    doc_id, dealt like them, so that their join does not shuffle the texts."""
    dealt = ranges.repartition(buckets, "doc_id") if buckets else ranges
    return dealt.groupBy("doc_id").agg(F.collect_list(F.struct("version", *(fields or ("lo", "hi")))).alias("ranges"))


def listed(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row numbers and fields of a column of lists of structs whose first field is the version of the text that they are
    meant for (column 1 has the row's own); null rows are empty."""
    column = batch.column(at)
    row = np.repeat(np.arange(batch.num_rows), np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0)))
    flat = column.flatten()
    version, *fields = (np.asarray(flat.field(i)) for i in range(flat.type.num_fields))
    meant = version == np.asarray(batch.column(1))[row]
    return row[meant], [x[meant].astype(np.int64) for x in fields]


def within(block: Block, row: np.ndarray, fields: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Those of a block (rows ascend), with rows numbered in it."""
    own = slice(*np.searchsorted(row, (block.lo, block.hi)))
    return row[own] - block.lo, [x[own] for x in fields]


def windows_between(block: Block, w: Words, row: np.ndarray, lo: np.ndarray, hi: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and hash of every window that starts in lo..hi of its row."""
    start, row = spread(lo, hi - lo + 1), np.repeat(row, hi - lo + 1)
    at = start + w.first[row]
    there = at + window <= w.first[row + 1]
    return row[there], start[there], PrefixHash(word_hashes(block, w)).of(at[there], at[there] + window)


def window_rows(texts: DataFrame, ranges: DataFrame, window: int = WINDOW, buckets: int | None = None) -> DataFrame:
    """One row per window in the ranges: doc_id, version, start, hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, fields = listed(batch, 3)
            for block in blocks(batch.column(2), BLOCK):
                row, (lo, hi) = within(block, rows, fields)
                row, start, h = windows_between(block, words(block), row, lo, hi, window)
                own = [batch.column(i).slice(block.lo, block.hi - block.lo).take(pa.array(row)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(start.astype(np.int32)), pa.array(signed(h))], ["doc_id", "version", "start", "hash"])

    rows = texts.join(by_document(ranges.distinct(), buckets=buckets), "doc_id").select("doc_id", "version", "text", "ranges")
    return rows.mapInArrow(run, "doc_id long, version long, start int, hash long")


def remove(texts: DataFrame, ranges: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = (), buckets: int | None = None) -> DataFrame:
    """Per document: the ``keep`` columns, doc_id, n_words, n_removed, spans (removed word ranges, start:end, comma-joined), kept (kept
    words joined by one space), cleaned (the text itself where nothing goes; else the kept stretches of it, layout
    included, joined by one space; null for a null text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, fields = listed(batch, 3)
            for block in blocks(batch.column(2), BLOCK):
                w = words(block)
                row, (lows, highs) = within(block, rows, fields)
                base = w.first[row]
                depth = np.zeros(len(w.start) + 1, np.int64)
                stop = w.first[row + 1]
                np.add.at(depth, np.minimum(base + lows, stop), 1)
                np.add.at(depth, np.minimum(base + highs + window, stop), -1)
                gone = np.cumsum(depth[:-1]) > 0
                removed = np.zeros(len(gone) + 1, np.int64)
                np.cumsum(gone, out=removed[1:])
                kept, cleaned, spans = [], [], []
                for i in range(block.hi - block.lo):
                    a, b = int(w.first[i]), int(w.first[i + 1])
                    text = block.text(i)
                    if removed[a] == removed[b]:
                        kept.append(b" ".join(text.split()))
                        cleaned.append(text)
                        spans.append("")
                        continue
                    edge = np.flatnonzero(np.diff(gone[a:b].astype(np.int8), prepend=0, append=0))
                    spans.append(",".join(f"{s}:{e}" for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)))
                    edge = np.flatnonzero(np.diff((~gone[a:b]).astype(np.int8), prepend=0, append=0))
                    cut = int(block.offsets[i])
                    parts = [text[w.start[a + s] - cut : w.end[a + e - 1] - cut] for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
                    cleaned.append(b" ".join(parts))
                    kept.append(b" ".join(cleaned[-1].split()))
                counts = np.diff(w.first)
                less = removed[w.first[1:]] - removed[w.first[:-1]]
                part = batch.slice(block.lo, block.hi - block.lo)
                clean = pa.array(cleaned, pa.binary(), mask=np.asarray(part.column(2).is_null()))
                made = [pa.array(counts.astype(np.int64)), pa.array(less), pa.array(spans, pa.string()), pa.array(kept, pa.binary()).cast(pa.string()), clean.cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns[4:], part.column(0), *made], [*keep, "doc_id", "n_words", "n_removed", "spans", "kept", "cleaned"])

    joined = texts.join(by_document(ranges, buckets=buckets), "doc_id", "left").select("doc_id", "version", "text", "ranges", *keep)
    carried = "".join(f"`{c}` {texts.schema[c].dataType.simpleString()}, " for c in keep)
    return joined.mapInArrow(run, f"{carried}doc_id long, n_words long, n_removed long, spans string, kept string, cleaned string")


#: The same by window words themselves, for the query columns of both operators.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
late AS (SELECT doc_id, i FROM win JOIN (SELECT h, min(doc_id) AS own FROM win GROUP BY h) USING (h) WHERE doc_id > own),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM late),
islands AS (SELECT doc_id, min(p) - 1 AS s, max(p) AS e FROM (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS island FROM gone) GROUP BY doc_id, island),
lost AS (SELECT doc_id, sum(e - s)::BIGINT AS n_removed, string_agg(s || ':' || e, ',' ORDER BY s) AS spans FROM islands GROUP BY doc_id),
left_ AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS kept FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(spans, '') AS spans, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id) LEFT JOIN left_ USING (doc_id)
"""
