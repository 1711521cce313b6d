"""Counts over time windows, queue and source health, anomalies and rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Source states, best first.
STATES = ("fresh", "due", "stuck", "failing")
Z_LIMIT, Z_HISTORY = 2, 4


def _ago(as_of: str, amount: str) -> Column:
    return F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL {amount}")


#: Days since a listing was last seen up to which it is fresh, and ageing; least points of each score band. (Fixed values.)
FRESH_DAYS, AGEING_DAYS = 7, 21
SCORE_BANDS = ((70, "A"), (50, "B"), (30, "C"))


def staleness_days(seen: Column, now: Column) -> Column:
    """Whole days since ``seen``, never negative; null if never seen."""
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(seen.cast("timestamp"))
    return F.when(seen.isNotNull(), F.greatest(F.floor(micros / 86_400_000_000), F.lit(0)))


def staleness_band(days: Column) -> Column:
    return F.when(days <= FRESH_DAYS, "fresh").when(days <= AGEING_DAYS, "aging").when(days.isNotNull(), "stale")


def score_band(points: Column) -> Column:
    """Letter of a score of 0 to 100 (clamped); null without one."""
    held = F.least(F.greatest(points.cast("double"), F.lit(0.0)), F.lit(100.0))
    out = F.when(points.isNotNull(), "D")
    for least, name in reversed(SCORE_BANDS):
        out = F.when(held >= least, name).otherwise(out)
    return F.when(points.isNotNull(), out)


def pairs_of_group(df: DataFrame, group: str, member: str) -> DataFrame:
    """Unordered pairs (lo, hi) of the distinct members of a group. For groups of bounded size."""
    a, b = df.alias("a"), df.alias("b")
    pairs = a.join(b, (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col(f"a.{member}") < F.col(f"b.{member}")))
    return pairs.select(F.least(f"a.{member}", f"b.{member}").alias("lo"), F.greatest(f"a.{member}", f"b.{member}").alias("hi"), f"a.{group}")


def pair_counts(df: DataFrame, group: str, member: str, least: int) -> DataFrame:
    """lo, hi, n, top: members that share ``least`` groups or more, how many, and the greatest of these. Each group is one row: a
    member goes on with all greater ones beside it in one array, dealt by the member, so pairs are made where they are counted
    and none is shuffled as a row of its own."""
    own = df.filter(F.col(group).isNotNull() & F.col(member).isNotNull()).groupBy(group).agg(F.array_sort(F.collect_set(member)).alias("_all"))
    beside = own.select(group, "_all", F.posexplode("_all").alias("_at", "lo")).filter(F.col("_at") + 1 < F.size("_all"))
    dealt = beside.select("lo", group, F.slice("_all", F.col("_at") + 2, F.size("_all")).alias("_more")).repartition("lo")
    pairs = dealt.select("lo", F.explode("_more").alias("hi"), group)
    return pairs.groupBy("lo", "hi").agg(F.count("*").alias("n"), F.max(group).alias("top")).filter(F.col("n") >= least)


def day_buckets(df: DataFrame, key: str, ts: str, as_of: str, value: Column, days: int = 7) -> DataFrame:
    """Counts d0 .. d6 of the days before ``as_of`` and the sum of 30 days, in one pass."""
    t = F.col(ts)
    counts = [F.count_if((t >= _ago(as_of, f"{i + 1} DAYS")) & (t < _ago(as_of, f"{i} DAYS"))).alias(f"d{i}") for i in range(days)]
    month = F.round(F.coalesce(F.sum(F.when(t >= _ago(as_of, "30 DAYS"), value)), F.lit(0)), 4).alias("month")
    return df.groupBy(key).agg(*counts, month)


def queue_flow(df: DataFrame, key: str, ts: str, pending: Column, done: Column, as_of: str) -> DataFrame:
    """depth, inflow and outflow of a week, oldest pending, trend."""
    week = F.col(ts) >= _ago(as_of, "7 DAYS")
    rows = df.groupBy(key).agg(F.count_if(pending).alias("depth"), F.count_if(pending & week).alias("inflow"), F.count_if(done & week).alias("outflow"), F.min(F.when(pending, F.col(ts))).alias("oldest"))
    trend = F.when(F.col("inflow") > F.col("outflow"), "growing").when(F.col("inflow") < F.col("outflow"), "draining").otherwise("steady")
    return rows.withColumn("trend", trend)


def source_status(df: DataFrame, key: str, ts: str, failed: Column, as_of: str) -> DataFrame:
    rows = df.groupBy(key).agg(F.max(ts).alias("last"), F.count_if(failed).alias("errors"), F.count("*").alias("n"))
    status = F.when(F.col("errors") * 4 > F.col("n"), "failing").when(F.col("last") < _ago(as_of, "48 HOURS"), "stuck").when(F.col("last") < _ago(as_of, "24 HOURS"), "due").otherwise("fresh")
    return rows.withColumn("status", status)


def worst_of(df: DataFrame, key: str) -> DataFrame:
    """sources and the worst state per group."""
    order = F.array(*map(F.lit, STATES))
    return df.groupBy(key).agg(F.count("*").alias("sources"), F.element_at(order, F.max(F.array_position(order, F.col("status"))).cast("int")).alias("worst"))


def z_anomaly(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Newest value against the population deviation of those before it (four or more, not all equal). The deviation is summed
    up in one fixed order, newest first, so a z of exactly the limit comes out alike in every run; a key has one value a
    period (days), so its history is short."""
    line = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v"))), asc=False)
    rows = df.filter(F.col(order).isNotNull()).groupBy(key).agg(F.max_by(value, order).alias("current"), F.max(order).alias("_last"), line.alias("_line"))
    history = F.transform(F.filter("_line", lambda x: x["o"] < F.col("_last")), lambda x: x["v"])
    known = F.filter("_past", lambda v: v.isNotNull())
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def step(s: Column, v: Column) -> Column:
        mean = s["mean"] + (v - s["mean"]) / (s["n"] + 1)
        return F.struct((s["n"] + 1).alias("n"), mean.alias("mean"), (s["m2"] + (v - mean) * (v - s["mean"])).alias("m2"))

    total = F.aggregate(known, F.lit(0.0), lambda s, v: s + v)
    rows = rows.withColumn("_past", history).withColumns({"_s": F.aggregate(known, start, step), "mean": F.try_divide(total, F.size(known)), "h": F.size("_past")})
    rows = rows.withColumn("sd", F.sqrt(F.try_divide(F.col("_s.m2"), F.col("_s.n"))))
    z = (F.col("current") - F.col("mean")) / F.col("sd")
    return rows.filter((F.col("h") >= Z_HISTORY) & (F.col("sd") > 0)).select(key, F.round(z, 5).alias("z"), (F.abs(z) > Z_LIMIT).alias("anomaly"))


def distribute(df: DataFrame, group: str, term: str, weight: str, total: int) -> DataFrame:
    """Whole points per term that sum to ``total``: largest remainders first, ties by term."""
    whole = Window.partitionBy(group)
    exact = F.lit(total) * F.col(weight) / F.sum(weight).over(whole)
    rows = df.withColumn("_exact", exact).withColumn("_base", F.floor("_exact")).withColumn("_rest", total - F.sum("_base").over(whole))
    rank = F.row_number().over(whole.orderBy(F.round(F.col("_exact") - F.col("_base"), 9).desc(), term))
    return rows.withColumn("_rank", rank).select(group, term, (F.col("_base") + F.when(F.col("_rank") <= F.col("_rest"), 1).otherwise(0)).alias("points"))
