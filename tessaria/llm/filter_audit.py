"""Filter interaction audit by direct relational replay.

``flags`` measures every whole text once: one row per document with its failures as bits. ``replay`` crosses these rows with
all orders of the filters (120 rows for five, broadcast), explodes the steps, finds each document's first failure in the
order, and counts by part, order and step; partial sums are made before the shuffle, so a part of a third of all rows
costs no more than any other.

Filters: A under 200 words; B fewer distinct words than half of all; C more than 2 % capital letters A-Z; D holds any of
``#$%&*|``; E has the text of a smaller doc_id. Words are maximal runs outside ``[\\x20\\x09-\\x0D]``, told apart by 64-bit
hashes; equal texts by 128-bit hashes.

A null text is empty (it fails A, and E where a smaller document is empty too); a null source is the part ''. Rows without
doc_id have no smaller one and are nobody's smaller one: they pass E. Repeated rows of one doc_id count as often as they
come and do not fail E by each other. Labels of one doc_id count once, as good or toxic where any of them is; labels without doc_id are nobody's. An empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessaria.llm.blocks import blocks, word_hashes, words
from tessaria.llm.quality import per_row
from tessaria.operators.workspace import Workspace

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 2
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#$%&*|")] = True
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def own_flags(docs: DataFrame, part: str = "source") -> DataFrame:
    """doc_id, part, text_hash, and as bits of ``fails`` the filters that look at one text alone (A to D)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2)):
                w, data, offsets = words(block), block.data, block.offsets
                count, rows = np.diff(w.first), w.rows
                h = word_hashes(block, w)
                order = np.lexsort((h, rows))
                h, r = h[order], rows[order]
                new = np.ones(len(r), bool)
                new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
                distinct = np.bincount(r[new], minlength=len(count))
                letters = per_row((data & 0xC0) != 0x80, offsets)
                capitals = per_row((data >= 65) & (data <= 90), offsets)
                fails = (count < MIN_WORDS) | ((100 * distinct < DISTINCT_PERCENT * count).astype(np.int64) << 1)
                fails = fails | ((100 * capitals > CAPITAL_PERCENT * letters).astype(np.int64) << 2) | ((per_row(SYMBOL[data], offsets) > 0).astype(np.int64) << 3)
                digest = [hashlib.blake2b(block.text(i), digest_size=16).digest() for i in range(len(count))]
                own = [batch.column(i).slice(block.lo, block.hi - block.lo) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(digest, pa.binary()), pa.array(fails.astype(np.int32))], ["doc_id", "part", "text_hash", "fails"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, part string, text_hash binary, fails int")


def flags(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """doc_id, part, fails (bit k for filter k of ``FILTERS``), good, toxic: one row per row of ``docs``."""
    space = Workspace(docs.sparkSession, "audit")
    own = space.write(own_flags(docs, part), "own")
    # only texts that several doc_ids have; at most half as many rows as documents, each of 24 bytes
    firsts = space.write(own.groupBy("text_hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").drop("last"), "firsts")
    marked = own.join(firsts, "text_hash", "left").select("doc_id", "part", F.col("fails").bitwiseOR(F.when(F.col("doc_id") > F.col("first"), 16).otherwise(0)).alias("fails"))
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.max((F.col(c) == 1).cast("int")).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))))
    return space.write(marked, "marked").join(known, "doc_id", "left").select("doc_id", "part", "fails", *(F.coalesce(n, F.lit(0)).alias(n) for n in ("good", "toxic")))


def orders(spark: SparkSession, filters: str = FILTERS) -> DataFrame:
    """All orders: filter_order, and the bits of its filters from the first step to the last."""
    rows = [("".join(o), [1 << filters.index(x) for x in o]) for o in permutations(filters)]
    return spark.createDataFrame(rows, "filter_order string, bits array<int>").coalesce(1)


def replay(flagged: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order and step with the counts and ``shapley``."""
    n = len(filters)
    crossed = flagged.crossJoin(F.broadcast(orders(flagged.sparkSession, filters)))
    bit = lambda i: F.col("bits")[i]
    first = F.coalesce(*(F.when(F.col("fails").bitwiseAND(bit(i)) != 0, i + 1) for i in range(n)), F.lit(n + 1))
    steps = crossed.select("part", "filter_order", "fails", "good", "toxic", first.alias("first"), F.posexplode("bits").alias("pos", "bit"))
    step, failing = F.col("pos") + 1, F.col("fails").bitwiseAND(F.col("bit")) != 0
    gone = F.col("first") == step
    conditions = {
        "kept": F.col("first") > step,
        "removed": gone,
        "redundant": failing & (F.col("first") < step),
        "unique_fails": F.col("fails") == F.col("bit"),
        "good_lost": gone & (F.col("good") == 1),
        "toxic_lost": gone & (F.col("toxic") == 1),
    }
    counted = steps.groupBy("part", "filter_order", step.alias("step")).agg(*(F.sum(conditions[c].cast("long")).alias(c) for c in COUNTS))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    share = F.sum("removed").over(Window.partitionBy("part", letter))  # one row per order
    return counted.select("part", "filter_order", "step", *COUNTS, share.alias("shapley"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return replay(flags(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


SQL = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::INT
  + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS fails FROM w),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
a AS (SELECT part, fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM f LEFT JOIN l USING (doc_id)),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT p.c || q.c || r.c || s.c || t.c AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bits FROM x p, x q, x r, x s, x t WHERE p.b + q.b + r.b + s.b + t.b = 31 AND len(list_distinct([p.b, q.b, r.b, s.b, t.b])) = 5),
e AS (SELECT part, filter_order, fails, good, toxic, step, bits[step] AS bit, coalesce(list_position(list_transform(bits, lambda b: fails & b <> 0), true), 6) AS first
  FROM a, o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
g AS (SELECT part, filter_order, step::INT AS step, count(*) FILTER (first > step) AS kept, count(*) FILTER (first = step) AS removed, count(*) FILTER (fails & bit <> 0 AND first < step) AS redundant,
  count(*) FILTER (fails = bit) AS unique_fails, count(*) FILTER (first = step AND good) AS good_lost, count(*) FILTER (first = step AND toxic) AS toxic_lost FROM e GROUP BY ALL)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley FROM g
"""
