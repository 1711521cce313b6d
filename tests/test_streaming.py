"""Streaming jobs against the same work done in one batch."""

import datetime

from pyspark.sql import functions as F

from tessaria.streaming import jobs, stateful


def parts(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "k long, at string, v double").withColumn("at", F.col("at").cast("timestamp"))
    for i in range(3):
        df.filter(F.lit(i) == F.pmod(F.xxhash64("at"), F.lit(3))).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    return df, spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 9).parquet(str(tmp_path / "in"))


ROWS = [(1, "2024-01-01 10:00:00", 100.0), (1, "2024-01-01 10:10:00", 100.5), (1, "2024-01-01 12:00:00", 90.0), (2, "2024-01-01 10:00:00", 5.0), (2, "2024-01-02 10:00:00", 50.0), (1, "2024-01-08 10:00:00", 80.0)]


def test_price_state(spark, tmp_path):
    _, stream = parts(spark, tmp_path, ROWS)
    out = jobs.run_to_table(jobs.price_state(stream, "k", "v", "v"), "update", str(tmp_path / "out"))
    assert {r.k: (r.price, r.changes) for r in out.collect()} == {1: (80.0, 2), 2: (5.0, 0)}


def test_windows(spark, tmp_path):
    _, stream = parts(spark, tmp_path, ROWS)
    out = jobs.run_to_table(jobs.trailing_counts(stream, "k"), "complete", str(tmp_path / "out"))
    assert {(r.k, r.n) for r in out.filter(F.col("until") == datetime.datetime(2024, 1, 8)).collect()} == {(1, 3), (2, 2)}


def test_queue_worker_claims_once(spark, tmp_path):
    _, stream = parts(spark, tmp_path, ROWS)
    seen = []
    for _ in range(2):
        jobs.queue_worker(stream, lambda df, i: seen.extend(r.k for r in df.collect()), str(tmp_path / "ck")).awaitTermination()
    assert len(seen) == len(ROWS)


def test_queue_worker_handles_every_row(spark, tmp_path):
    """A batch smaller than the micro-batch: ten rows, four a claim, over restarts, each once and oldest first."""
    rows = [(i, f"2024-01-01 10:{59 - i:02d}:00", float(i)) for i in range(10)]
    _, stream = parts(spark, tmp_path, rows)
    claims = []
    for _ in range(3):
        jobs.queue_worker(stream, lambda df, name: claims.append((name, sorted(r.k for r in df.collect()))), str(tmp_path / "ck"), batch=4).awaitTermination()
    assert [k for _, k in claims] == [[6, 7, 8, 9], [2, 3, 4, 5], [0, 1]] and len({n for n, _ in claims}) == 3


def test_failures_end_with_time(spark, tmp_path):
    stateful.use_rocksdb(spark)
    rows = [(1, "2024-01-01 10:00:00", 1.0), (1, "2024-01-01 11:00:00", 1.0), (2, "2024-01-20 10:00:00", 0.0), (3, "2024-02-20 10:00:00", 1.0)]
    df = spark.createDataFrame(rows, "k long, at string, v double").select("k", F.col("at").cast("timestamp").alias("at"), (F.col("v") > 0).alias("bad"))
    for i, day in enumerate(("2024-01-01", "2024-01-20", "2024-02-20")):
        df.filter(F.to_date("at") == day).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = jobs.run_to_table(stateful.failures(stream, "k", "bad", "at", 14), "update", str(tmp_path / "out")).collect()
    assert {(r.k, r.failures, r.gone) for r in out} >= {(1, 2, False), (1, 2, True), (2, 0, False), (3, 1, False)}


def test_first_arrivals(spark, tmp_path):
    _, stream = parts(spark, tmp_path, [ROWS[0], ROWS[0], ROWS[3]])
    out = jobs.run_to_table(jobs.first_arrivals(stream, ["k", "at"]), "append", str(tmp_path / "out"))
    assert out.count() == 2
