"""Structured Streaming forms of the incremental steps.

Each job takes a streaming DataFrame and gives one back (or runs a query to the end of what is there), with a watermark
where state has to end. Replaying the same input gives the batch operators' results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessaria.operators.keyed import numbered

GAP, LATE = "30 minutes", "1 hour"
LEAST_MOVE, MOST_MOVE, MISSES = 0.01, 0.60, 3


def event_source(spark: SparkSession, path: str, files_per_trigger: int = 1, at: str | None = "ts") -> DataFrame:
    """Files of a table as a stream, with a zoned timestamp ``at`` made of the column of that name (None: without)."""
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files_per_trigger)
    folder, _, name = path.rpartition("/")
    if table.inputFiles()[0].endswith(f"/{name}"):  # one file: a stream reads folders
        reader, path = reader.option("pathGlobFilter", name), folder
    return reader.parquet(path).withColumn("at", F.col(at).cast("timestamp")) if at else reader.parquet(path)


def day_counts(stream: DataFrame, key: str) -> DataFrame:
    """Tumbling days."""
    return stream.withWatermark("at", LATE).groupBy(key, F.window("at", "1 day").alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("day"), "n")


def trailing_counts(stream: DataFrame, key: str, length: str = "7 days", step: str = "1 day") -> DataFrame:
    """Sliding windows."""
    return stream.withWatermark("at", LATE).groupBy(key, F.window("at", length, step).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.end").alias("until"), "n")


def sessions(stream: DataFrame, key: str, zone: str = "Europe/Madrid") -> DataFrame:
    """Sessions that end after a gap or with the local day; ``ended`` is the last event, not the end of the window."""
    day = F.to_date(F.from_utc_timestamp("at", zone)).alias("day")
    grouped = stream.withWatermark("at", LATE).groupBy(key, day, F.session_window("at", GAP).alias("w"))
    return grouped.agg(F.count("*").alias("n"), F.min("at").alias("started"), F.max("at").alias("ended")).select(key, "day", "n", "started", "ended")


def first_arrivals(stream: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key among those that arrive within the watermark."""
    return stream.withWatermark("at", LATE).dropDuplicatesWithinWatermark(keys)


def last_seen(stream: DataFrame, key: str) -> DataFrame:
    """Newest sight per key; a maximum, so late and repeated rows do no harm. One state row per key stays for good, as
    each key's last sight is asked for."""
    return stream.groupBy(key).agg(F.max("at").alias("last_seen"))


def price_state(stream: DataFrame, key: str, value: str, tie: str) -> DataFrame:
    """Adopted price per key (keyed state): first price, then moves of 1 % to 60 %, in order of time and ``tie``; emits key,
    price, changes at every trigger in which the key had rows."""

    def step(group: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        price, changes = state.get if state.exists else (None, 0)
        frame = pd.concat(list(rows)).sort_values(["at", tie])
        for now in frame[value]:
            if price is None or price <= 0 or LEAST_MOVE <= abs(now - price) / price <= MOST_MOVE:
                changes += price is not None
                price = float(now)
        state.update((price, changes))
        yield pd.DataFrame({key: [group[0]], "price": [price], "changes": [changes]})

    return stream.select(*dict.fromkeys((key, "at", tie, value))).groupBy(key).applyInPandasWithState(step, f"{key} long, price double, changes long", "price double, changes long", "update", GroupStateTimeout.NoTimeout)


def queue_worker(stream: DataFrame, handle: Callable[[DataFrame, str], None], checkpoint: str, batch: int | None = None):
    """A queue poll as ``foreachBatch``: all rows of a micro-batch are claimed, ``batch`` at a time, oldest first. ``handle``
    gets the rows of a claim and its name, which a replay repeats with the same rows; the checkpoint makes claims exactly-once
    for handlers that are idempotent by that name. Runs what is there, then ends."""

    def work(df: DataFrame, i: int) -> None:
        if not batch:
            handle(df, f"{i}")
            return
        names = df.columns
        turns = numbered(df.withColumn("_row", F.xxhash64(*names)), (F.asc("at"), F.asc("_row")), "_turn")
        n = turns.count()
        for slice_ in range(-(-n // batch)):
            handle(turns.filter(F.col("_turn").between(slice_ * batch + 1, (slice_ + 1) * batch)).select(*names), f"{i}-{slice_}")

    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def claims_worker(stream: DataFrame, handle: Callable[[DataFrame], None], checkpoint: str, batch: int):
    """``queue_worker`` for handlers that can take all claims of a micro-batch in one job: ``handle`` gets its rows with their
    ``claim``, the name that ``queue_worker`` gives the same rows, each claim in one task. So a job is paid for once a
    micro-batch, not once a claim, and no claim reads the others' rows."""

    def work(df: DataFrame, i: int) -> None:
        names = df.columns
        turns = numbered(df.withColumn("_row", F.xxhash64(*names)), (F.asc("at"), F.asc("_row")), "_turn")
        claim = F.concat_ws("-", F.lit(f"{i}"), F.floor((F.col("_turn") - 1) / batch).cast("string"))
        handle(turns.select(*names, claim.alias("claim")).repartition("claim"))

    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """Runs a stream to the end of its input and gives its results, which each trigger writes to a part of ``folder`` (a
    replayed trigger writes its part again). ``complete``: those of the last trigger; else those of all."""
    schema, spark = stream.schema, stream.sparkSession
    seen: list[int] = []

    def write(df: DataFrame, i: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/parts/trigger={i}")
        seen.append(i)

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if not seen:
        return spark.createDataFrame([], schema)
    parts = [f"{folder}/parts/trigger={i}" for i in (seen[-1:] if mode == "complete" else sorted(set(seen)))]
    return spark.read.schema(schema).parquet(*parts)
