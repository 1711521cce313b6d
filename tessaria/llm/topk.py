"""Exact top-k search: tiled integer matrix products, partial selection per tile, tree merging.

Queries are packed into blocks and candidates into shards of bounded size; every (block, shard) tile is one group: a
matrix product and the ``k`` best of each query. Tiles of a query are merged ``FAN`` at a time until one list is left,
so no task holds more than ``FAN * k`` entries of a query. Work grows as queries times candidates, which exactness asks
for; each row is shipped once per opposite block, not once per opposite row.

A component x becomes floor(64 * x). Vectors that are null or hold a null or non-finite component take no part, neither
as query nor as candidate. Shorter vectors count as continued by zeros. Ties go to the smaller vec_id; a query's own
row (by vec_id) is left out. Fewer candidates than k: all of them. Repeated rows are candidates as often as they come.
Vectors ship as integers of the fewest bytes that hold every component. Products are exact: in doubles where no sum can exceed 2**53, else in 64-bit integers. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOP, SCALE = 20, 64.0
BLOCK, SHARD, FAN = 8192, 8192, 8


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<long>) of the vectors that take part."""
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    sound = F.col("embedding").isNotNull() & ~F.coalesce(F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))), F.lit(True))
    return vectors.filter(sound & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), v.alias("v"))


def packed(rows: DataFrame, kind: str) -> DataFrame:
    """vec_id and v as bytes of one integer type, which ship in an eighth of the room where components fit in a byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.dtype(kind).itemsize
        for batch in batches:
            lists = batch.column(1)
            raw = lists.flatten().to_numpy(zero_copy_only=False).astype(kind).tobytes()
            offsets = np.concatenate(([0], np.cumsum(np.asarray(pa.compute.list_value_length(lists))))).astype(np.int32) * width
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])], ["vec_id", "v"])

    return rows.mapInArrow(run, "vec_id long, v binary")


def matrix(column: pa.ChunkedArray, width: int, kind: str) -> np.ndarray:
    """Packed vectors as rows of ``width`` integers, shorter ones continued by zeros."""
    size = np.asarray(pa.compute.binary_length(column)) // np.dtype(kind).itemsize
    flat = np.frombuffer(b"".join(column.to_pylist()), kind)
    out = np.zeros((len(size), width), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and candidate of the k highest scores of every row, ties to smaller ids, without the row's own id. ``ids``
    ascend, so among equal scores the first columns win."""
    scores = np.where(ids[None, :] == own[:, None], np.iinfo(np.int64).min, scores)
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k][:, None]
        sure = scores > least
        tied = scores == least
        sure |= tied & (np.cumsum(tied, axis=1) <= k - sure.sum(axis=1, keepdims=True))
    else:
        sure = np.ones(scores.shape, bool)
    return np.nonzero(sure & (scores > np.iinfo(np.int64).min))


def search(vectors: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of ``vectors`` for each of ``queries`` (vec_id, embedding)."""
    rows, asked = quantised(vectors), quantised(queries)
    size = F.greatest(F.coalesce(F.array_max("v"), F.lit(0)), -F.coalesce(F.array_min("v"), F.lit(0)) - 1)
    n, largest = rows.agg(F.count("*"), F.max(size)).first()
    m, other = asked.agg(F.count("*"), F.max(size)).first()
    n_blocks, n_shards = max(1, ceil(m / BLOCK)), max(1, ceil(n / SHARD))
    kind = next(k for k in ("i1", "i2", "i4", "i8") if max(largest or 0, other or 0) <= np.iinfo(k).max)
    rows, asked = packed(rows, kind), packed(asked, kind)
    wide = np.dtype(kind).itemsize

    def tile(queries: pa.Table, shard: pa.Table) -> pa.Table:
        queries, shard = queries.sort_by("vec_id"), shard.sort_by("vec_id")
        ids, own = shard["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
        found = []
        if len(ids) and len(own):
            width = max(1, *(pa.compute.max(pa.compute.binary_length(t["v"])).as_py() // wide for t in (queries, shard)))
            q, c = matrix(queries["v"], width, kind), matrix(shard["v"], width, kind)
            exact = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * width < 2**53
            if exact:
                q, c = q.astype(float), c.astype(float)
            for lo in range(0, len(own), 256):
                scores = (q[lo : lo + 256] @ c.T).astype(np.int64)
                row, col = best(scores, ids, own[lo : lo + 256], k)
                found.append((own[lo + row], ids[col], scores[row, col]))
        made = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
        part = shard["shard"][0].as_py() if len(ids) else 0
        return pa.table({"query_id": made[0], "shard": np.full(len(made[0]), part, np.int64), "vec_id": made[1], "score": made[2]})

    def spread(df: DataFrame, mine: str, n: int, other: str, m: int) -> DataFrame:
        return df.withColumn(mine, F.pmod(F.xxhash64("vec_id", F.lit(mine)), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))))

    left = spread(asked, "block", n_blocks, "shard", n_shards).groupBy("block", "shard")
    right = spread(rows, "shard", n_shards, "block", n_blocks).groupBy("block", "shard")
    tops = left.cogroup(right).applyInArrow(tile, "query_id long, shard long, vec_id long, score long")
    entry = F.struct((-F.col("score")).alias("less"), "vec_id")
    lists = tops.groupBy("query_id", "shard").agg(F.slice(F.sort_array(F.collect_list(entry)), 1, k).alias("top"))
    while n_shards > 1:
        n_shards = ceil(n_shards / FAN)
        lists = lists.groupBy("query_id", F.floor(F.col("shard") / FAN).alias("shard")).agg(F.slice(F.sort_array(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
    ranked = lists.select("query_id", F.posexplode("top").alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.less")).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
q AS (SELECT vec_id AS query_id, v AS qv FROM v WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id, list_inner_product(qv::DOUBLE[], v::DOUBLE[])::BIGINT AS score FROM q JOIN v ON query_id <> vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
