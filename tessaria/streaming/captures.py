"""Captured pages as a queue: claimed in batches, each page with one of five outcomes.

done: a listing's page, normalised; listing: a result page, whose links are sights of other listings; blocked: the portal's
challenge; withdrawn: the listing's page says that it is gone; failed: no connector knows the address, or the page has no
payload. A claim writes its outcomes under its own name, so a claim that is repeated writes the same again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaria.functions import text
from tessaria.sources import connectors
from tessaria.streaming.jobs import claims_worker, queue_worker

#: A claim's rows. (Fixed value.)
BATCH = 10


def outcomes(captures: DataFrame, result_page: Column, gone: Column, *more: str) -> DataFrame:
    """capture_id, status, source, external_id, reason, raw, sighted (external_ids) of captures (capture_id, url, html, at).
    ``result_page`` tells result pages by address, ``gone`` a listing's page that is a notice; the first rule that holds
    decides, in the order unknown or result page, challenge, notice, no payload, done. ``more`` columns go along."""
    rows = connectors.parse_pages(captures).withColumns({"portal": connectors.portal_of(F.col("url")), "results": F.coalesce(result_page, F.lit(False))})
    detail = F.col("external_id").isNotNull() & ~F.col("results")
    status = (
        F.when(~detail & F.col("portal").isNotNull(), "listing")
        .when(~detail, "failed")
        .when(text.phrase_hits(text.visible_text(F.coalesce("html", F.lit(""))), text.CHALLENGE) >= text.CHALLENGE_HITS, "blocked")
        .when(F.coalesce(gone, F.lit(False)), "withdrawn")
        .when(F.col("raw").isNull(), "failed")
        .otherwise("done")
    )
    reason = F.when(F.col("status") == "failed", F.when(F.col("portal").isNull(), "unknown address").otherwise("no payload"))
    sighted = F.when(F.col("status") == "listing", connectors.linked_ids(F.col("url"), F.coalesce("html", F.lit("")))).otherwise(F.array().cast("array<string>"))
    own = F.when(F.col("status") == "listing", F.lit(None)).otherwise(F.col("external_id"))
    done = F.when(F.col("status") == "done", F.col("raw"))
    return rows.withColumn("status", status).select("capture_id", "at", "url", "status", F.coalesce("source", "portal").alias("source"), own.alias("external_id"), reason.alias("reason"), done.alias("raw"), sighted.alias("sighted"), *more)


def sightings(found: DataFrame) -> DataFrame:
    """source, external_id, last_seen: the newest sight by result pages and by pages of the listing itself."""
    own = found.filter("status = 'done'").select("source", "external_id", "at")
    linked = found.select("source", F.explode("sighted").alias("external_id"), "at")
    return own.union(linked).groupBy("source", "external_id").agg(F.max("at").alias("last_seen"))


def work(spark: SparkSession, queue: DataFrame, folder: str, result_page: Column, gone: Column, batch: int | None = BATCH) -> DataFrame:
    """Runs a stream of captures (capture_id, url, html, at) to the end of what is there, in claims of ``batch`` rows (None: a
    whole trigger at a time), and gives the outcomes of all claims so far."""

    def handle(rows: DataFrame, claim: str) -> None:
        outcomes(rows, result_page, gone).write.mode("overwrite").parquet(f"{folder}/outcomes/claim={claim}")

    def handle_all(rows: DataFrame) -> None:
        # whole claims: overwriting them writes the same again
        outcomes(rows, result_page, gone, "claim").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("claim").parquet(f"{folder}/outcomes")

    checkpoint = f"{folder}/checkpoint"
    (claims_worker(queue, handle_all, checkpoint, batch) if batch else queue_worker(queue, handle, checkpoint)).awaitTermination()
    return spark.read.parquet(f"{folder}/outcomes").drop("claim")
