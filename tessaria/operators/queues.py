"""Work queues, retention, digests and review groupings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A failing item is parked after so many failures in so many days. (Fixed values.)
PARK_FAILS, PARK_DAYS = 3, 14


def missing_work(entities: DataFrame, kinds: Sequence[str], done: DataFrame, failures: DataFrame, key: str, kind: str, ts: str, as_of: str) -> DataFrame:
    """(key, kind) of a small list of kinds without a current verdict and not parked: three or more failures in the last
    fourteen days."""
    wanted = entities.select(key).withColumn(kind, F.explode(F.array(*map(F.lit, kinds))))
    recent = failures.filter(F.col(ts) >= F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL {PARK_DAYS} DAYS"))
    parked = recent.groupBy(key, kind).agg(F.count("*").alias("_n")).filter(F.col("_n") >= PARK_FAILS)
    return wanted.join(done.select(key, kind).distinct(), [key, kind], "left_anti").join(parked.select(key, kind), [key, kind], "left_anti")


def claim(queue: DataFrame, status: str, order: Sequence[Column], size: int, attempts: str, most: int) -> DataFrame:
    """The oldest ``size`` pending rows with one attempt more; rows at the limit become unreachable."""
    rows = queue.filter(F.col(status) == "pending").orderBy(*order).limit(size)
    tries = F.coalesce(attempts, F.lit(0)) + 1
    return rows.withColumn(attempts, tries).withColumn(status, F.when(F.col(attempts) >= most, "unreachable").otherwise("processing"))


def retained(df: DataFrame, ts: str, days: int, as_of: str, active: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """Rows that a purge leaves: young ones, and those whose key is still active."""
    young = F.col(ts) >= F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL {days} DAYS")
    if active is None:
        return df.filter(young)
    return df.join(active.select(key, F.lit(True).alias("_active")).distinct(), key, "left").filter(young | F.col("_active")).drop("_active")


def reconcile_running(runs: DataFrame, status: str, started: str, hours: int, as_of: str) -> DataFrame:
    """Runs that have been running for too long become failed."""
    dead = (F.col(status) == "running") & (F.col(started) < F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL {hours} HOURS"))
    return runs.withColumn(status, F.when(dead, "failed").otherwise(F.col(status)))


def visit_anchor(visits: DataFrame, key: str, ts: str, minutes: int) -> DataFrame:
    """key, current and previous anchor: starts of the last two visits, where rows within ``minutes`` of the one before
    belong to the same visit."""
    w = Window.partitionBy(key).orderBy(ts)
    before = F.lag(ts).over(w)
    new = before.isNull() | (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(before.cast("timestamp")) > minutes * 60_000_000)
    starts = visits.withColumn("_new", new).filter("_new")
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ts)))
    last = starts.withColumn("_back", back).filter("_back <= 2")
    return last.groupBy(key).agg(F.max(F.when(F.col("_back") == 1, F.col(ts))).alias("current"), F.max(F.when(F.col("_back") == 2, F.col(ts))).alias("previous"))


def rounded_scopes(scopes: DataFrame, lat: str, lon: str) -> DataFrame:
    """One scope per centre rounded to four places: the widest."""
    rows = scopes.withColumns({"_lat": F.round(lat, 4), "_lon": F.round(lon, 4)})
    return rows.groupBy("_lat", "_lon").agg(F.max("radius").alias("radius")).withColumnsRenamed({"_lat": lat, "_lon": lon})


def review_groups(suggestions: DataFrame, lo: str, hi: str, basis: str, confidence: str) -> DataFrame:
    """Per pair: suggestions, top basis and confidence, evidence in order of confidence."""
    entry = F.struct((-F.col(confidence)).alias("c"), F.col(basis).alias("b"))
    evidence = F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["b"]), ",")
    return suggestions.groupBy(lo, hi).agg(F.count("*").alias("n"), F.min_by(basis, entry).alias("top"), F.max(confidence).alias("confidence"), evidence.alias("evidence"))


def basis_sets(suggestions: DataFrame, keys: Sequence[str], basis: str) -> DataFrame:
    """How many groups have each basis among their distinct ones."""
    return suggestions.select(*keys, basis).distinct().groupBy(basis).agg(F.count("*").alias("groups"))


def cost(usage: DataFrame, model: str, tokens_in: str, tokens_out: str, rates: Mapping[str, tuple[float, float]]) -> Column:
    """Cost at rates per million tokens; unknown models cost nothing."""
    pick = lambda i: F.coalesce(F.create_map(*[F.lit(x) for m, r in rates.items() for x in (m, float(r[i]))])[F.col(model)], F.lit(0.0))
    return (F.col(tokens_in) * pick(0) + F.col(tokens_out) * pick(1)) / 1_000_000
