"""MinHash near-dedup: circulant signatures, banding, exact Jaccard verification, connected components.

Shingles are ``k`` consecutive words with A-Z lower-cased (a shorter text is one shingle; a text without words has
none and is linked with nothing). Signature coordinates come from two permutations of a universe of 2**18: the first
places a shingle, the second, shifted circularly by one more for each coordinate, ranks it. Bands of ``ROWS``
coordinates put documents into buckets; at similarity 0.8 a pair misses all 45 bands with a chance of 1e-6, while one at 0.4 meets in one of six.

Documents with equal shingle sets form one class, and only its least document goes on. Within a bucket documents are
linked in two passes, neither of which writes out all pairs of a large bucket:

1. in the first bands each member with the one before it, in an order that differs from band to band; verified links
   are closed to components;
2. buckets that still hold several components: pairs of different components, in buckets of up to ``SMALL`` members
   as pairs, in larger ones block by block inside a task that gives only the links found.

So every pair of a bucket is either in one component or has been compared on its full sets. A link holds if
100 * |A and B| >= 80 * |A or B|.

Nulls count as empty texts. Rows without doc_id are left out; repeated rows of one doc_id share its result. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaria.llm.blocks import Block, U, blocks, mix, ngram_hashes, signed, word_hashes, words
from tessaria.operators.components import components
from tessaria.operators.workspace import Workspace

K, PERCENT, BANDS, ROWS = 4, 80, 45, 6
UNIVERSE_BITS = 18
#: Bands whose neighbours the first pass compares; 99 % of links at 0.8 meet there, the second pass finds the rest.
FIRST_BANDS = 15
SMALL, BLOCK = 16, 256
#: Shingles of one block of a large bucket, and bytes of text that are compared at once.
BLOCK_SHINGLES, PORTION = 2_000_000, 4 << 20
SKETCH = "doc_id long, n_shingles long, set1 long, set2 long, bands array<long>"


def shingles(block: Block, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """All shingles (with repeats) in order of rows, and per row the range of its shingles."""
    w = words(block)
    h = word_hashes(block, w, lower=True)
    size = np.diff(w.first)
    grams = ngram_hashes(h, k)
    rows = w.rows[: len(grams)]
    full = np.arange(len(grams)) + k <= w.first[rows + 1]
    short = np.flatnonzero((size > 0) & (size < k))
    own = np.zeros(len(short), U)
    for j in range(k - 1):
        there = size[short] > j
        own[there] = mix(own[there] * U(31) + h[w.first[short[there]] + j] + U(j + 1))
    values = np.concatenate((grams[full], own))
    at = np.concatenate((rows[full], short))
    order = np.argsort(at, kind="stable")
    return values[order], np.searchsorted(at[order], np.arange(len(size) + 1))


def distinct_shingles(block: Block, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Rows and values of the distinct shingles of each row, in order of rows."""
    values, first = shingles(block, k)
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.argsort(values, kind="stable")
    order = order[np.argsort(rows[order], kind="stable")]
    rows, values = rows[order], values[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    return rows[keep], values[keep]


def ranks(bits: int = UNIVERSE_BITS, more: int = BANDS * ROWS) -> np.ndarray:
    """The second permutation, continued by its own start so that shifts are slices."""
    order = np.argsort(mix(np.arange(1 << bits, dtype=U) + U(0x5851F42D4C957F2D)), kind="stable").astype(np.uint32)
    return np.concatenate((order, order[:more]))


def band_keys(values: np.ndarray, first: np.ndarray, table: np.ndarray, bits: int = UNIVERSE_BITS) -> np.ndarray:
    """Bucket keys of every row that has shingles: rows by bands."""
    place = (mix(values ^ U(0x2545F4914F6CDD1D)) >> U(64 - bits)).astype(np.intp)
    out = np.empty((len(first), BANDS), U)
    size = 1 << bits
    for band in range(BANDS):
        key = np.full(len(first), band + 1, U)
        for j in range(ROWS):
            shift = band * ROWS + j
            key = mix(key * U(0x9E3779B97F4A7C15) + np.minimum.reduceat(table[shift : shift + size].take(place), first).astype(U))
        out[:, band] = key
    return out


def sketches(docs: DataFrame, k: int = K) -> DataFrame:
    """Per document its number of distinct shingles, two hashes of the set, and its bucket keys (null without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks()
        for batch in batches:
            for block in blocks(batch.column(1)):
                n = block.hi - block.lo
                rows, values = distinct_shingles(block, k)
                first = np.searchsorted(rows, np.arange(n + 1))
                count = np.diff(first)
                sums = []
                for salt in (1, 2):
                    total = np.zeros(len(values) + 1, U)
                    np.cumsum(mix(values + U(salt * 0xD6E8FEB86659FD93 % 2**64)), dtype=U, out=total[1:])
                    sums.append(total[first[1:]] - total[first[:-1]])
                some = np.flatnonzero(count)
                keys = band_keys(values, first[:-1][some], table) if len(some) else np.zeros((0, BANDS), U)
                offsets = np.concatenate(([0], np.cumsum(np.where(count > 0, BANDS, 0)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(keys.ravel())))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.lo, n), pa.array(count.astype(np.int64)), *(pa.array(signed(x)) for x in sums), lists], [x.split()[0] for x in SKETCH.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SKETCH)


def bucket_rows(reps: DataFrame) -> DataFrame:
    """Members of buckets with company: key, doc_id, n_shingles, prev, prev_n (null for a first member and beyond the
    first bands).

    Rows are range-partitioned by key and an order within it, so a large bucket spreads over tasks. A bucket cut by an
    edge between tasks misses one neighbour there; the second pass looks at such buckets again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, doc, n, band = (np.asarray(batch.column(i)) for i in (0, 2, 3, 4))
            last = held or (~key[0], 0, 0)
            prev_key, prev, prev_n = (np.concatenate(([x], y[:-1])) for x, y in zip(last, (key, doc, n), strict=True))
            held = (key[-1], doc[-1], n[-1])
            same = prev_key == key
            company = same.copy()
            company[:-1] |= same[1:]
            company[[0, -1]] = True
            made = [pa.array(key[company]), pa.array(doc[company]), pa.array(n[company]), *(pa.array(x[company], mask=~(same & (band < FIRST_BANDS))[company]) for x in (prev, prev_n))]
            yield pa.RecordBatch.from_arrays(made, ["key", "doc_id", "n_shingles", "prev", "prev_n"])

    rows = reps.select(F.posexplode("bands").alias("band", "key"), "doc_id", "n_shingles").select("key", F.xxhash64("doc_id", "key").alias("turn"), "doc_id", "n_shingles", "band")
    return rows.repartitionByRange("key", "turn").sortWithinPartitions("key", "turn").mapInArrow(run, "key long, doc_id long, n_shingles long, prev long, prev_n long")


def near(a: str, b: str):
    """Sizes that allow the similarity."""
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Stretches of a batch of pairs with PORTION bytes of text at most, or one pair if that alone is longer."""
    size = sum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(c)), 0)).astype(np.int64) for c in (2, 3))
    ends, lo = np.cumsum(size), 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PORTION, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def verified(pairs: DataFrame, texts: DataFrame, k: int = K) -> DataFrame:
    """Those pairs (a, b) whose full shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch):
                n, found, sizes = part.num_rows, [], np.zeros(part.num_rows, np.int64)
                for column in (2, 3):
                    own = []
                    for block in blocks(part.column(column)):
                        rows, values = distinct_shingles(block, k)
                        own.append((rows + block.lo, values))
                    rows = np.concatenate([x for x, _ in own])
                    found.append((rows, np.concatenate([x for _, x in own])))
                    sizes += np.bincount(rows, minlength=n)
                rows, values = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.argsort(values, kind="stable")
                order = order[np.argsort(rows[order], kind="stable")]
                rows, values = rows[order], values[order]
                both = np.bincount(rows[1:][(rows[1:] == rows[:-1]) & (values[1:] == values[:-1])], minlength=n)
                yield part.filter(pa.array(100 * both >= PERCENT * (sizes - both))).select([0, 1])

    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def block_links(rows: DataFrame, texts: DataFrame, k: int = K) -> DataFrame:
    """Links between different components within large buckets: rows (key, doc_id, label, size, shingles), compared block
    by block; a group holds at most about two blocks, which have a bounded number of documents and of shingles."""

    def run(group: pa.Table) -> pa.Table:
        doc, label, block = (group[c].to_numpy() for c in ("doc_id", "label", "block"))
        rows_, values = [], []
        for part in blocks(group["text"]):
            own = distinct_shingles(part, k)
            rows_.append(own[0] + part.lo)
            values.append(own[1])
        at, column = np.concatenate(rows_), np.unique(np.concatenate(values), return_inverse=True)[1]
        both = np.zeros((len(doc), len(doc)), np.float32)
        order = np.argsort(column, kind="stable")
        at, column = at[order], column[order]
        for base in range(0, int(column[-1]) + 1 if len(column) else 0, 1 << 15):
            own = slice(*np.searchsorted(column, (base, base + (1 << 15))))
            table = np.zeros((len(doc), 1 << 15), np.float32)
            table[at[own], column[own] - base] = 1
            both += table @ table.T
        size = np.diagonal(both)
        low, high = group["low"][0].as_py(), group["high"][0].as_py()
        asked = (block == low)[:, None] & (block == high)[None, :] & (label[:, None] != label[None, :])
        i, j = np.nonzero(asked & (100 * both >= PERCENT * (size[:, None] + size[None, :] - both)))
        return pa.table({"a": np.minimum(doc[i], doc[j]), "b": np.maximum(doc[i], doc[j])})

    count = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    dealt = rows.withColumn("count", count).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("count")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("count") - 1))
    dealt = dealt.withColumn("other", other).select("key", "doc_id", "label", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    return dealt.join(texts, "doc_id").groupBy("key", "low", "high").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = K) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (least document reachable by links), kept (it is that one)."""
    space = Workspace(docs.sparkSession, "minhash")
    docs = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sketch = space.write(sketches(docs, k), "sketches")
    classes = space.write(sketch.groupBy("set1", "set2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    alone = F.col("n_shingles") == 0
    members = space.write(sketch.join(classes, ["set1", "set2", "n_shingles"]).select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("rep")).alias("rep"), "bands"), "members")
    space.drop("sketches")
    buckets = space.write(bucket_rows(members.filter((F.col("doc_id") == F.col("rep")) & ~alone)), "buckets")
    texts = space.write(docs.join(buckets.select("doc_id").distinct(), "doc_id"), "texts")

    tried = buckets.filter(F.col("prev").isNotNull() & near("n_shingles", "prev_n")).select(F.least("doc_id", "prev").alias("a"), F.greatest("doc_id", "prev").alias("b")).distinct()
    tried = space.write(tried, "tried")
    links = space.write(verified(tried, texts, k), "links")
    labels = components(space, links, "first")

    rows = buckets.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("label"))
    rows = space.write(rows, "labelled")
    open_ = rows.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("size"), F.sum("n_shingles").alias("shingles")).filter("least < most")
    rows = space.write(rows.join(space.write(open_, "open").select("key", "size", "shingles"), "key"), "residual")
    small = rows.filter(F.col("size") <= SMALL)
    x, y = small.alias("x"), small.alias("y")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.label") < F.col("y.label")) & near("x.n_shingles", "y.n_shingles"))
    pairs = pairs.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()
    more = verified(space.write(pairs, "pairs").join(tried, ["a", "b"], "left_anti"), texts, k)
    large = rows.filter(F.col("size") > SMALL)
    more = space.write(more.union(block_links(large, texts, k)), "more")
    if more.take(1):
        labels = components(space, links.union(more), "last")
    found = members.select("doc_id", "n_shingles", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("label", "rep")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: The same on whole sets of shingles, all pairs that share one.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n i ON i.doc_id = a JOIN n j ON j.doc_id = b WHERE 100 * c >= 80 * (i.n + j.n - c)), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(node, label) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.node WHERE r.label < e.b),
m AS (SELECT node AS doc_id, min(label) AS component_id FROM r GROUP BY node)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""
