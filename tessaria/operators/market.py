"""Market signals and comparables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tessaria.operators.joins import band_join, interval_join, near_percentiles

LEAST_DROP, MOST_DROP = 0.01, 0.60


def price_drops(moved: DataFrame, value: str) -> DataFrame:
    """Rows of ``keyed.moves`` whose value fell by 1 % to 60 %: adds ``pct``."""
    return moved.withColumn("pct", F.try_divide(F.col("previous") - F.col(value), F.col("previous"))).filter(F.col("pct").between(LEAST_DROP, MOST_DROP))


def first_last_drop(df: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """key, drop_pct from the first to the last value: two aggregates, no window."""
    at = F.struct(*order)
    ends = df.groupBy(key).agg(F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last"))
    return ends.select(key, F.try_divide(F.col("first") - F.col("last"), F.col("first")).alias("drop_pct"))


def days_on_market(df: DataFrame, key: str, ts: str, terminal: Column, as_of: str) -> DataFrame:
    """Whole days from first sight to the first terminal event, or to ``as_of``."""
    ends = df.groupBy(key).agg(F.min(ts).alias("first"), F.min(F.when(terminal, F.col(ts))).alias("end"))
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1_000_000
    end = F.coalesce(F.col("end").cast("timestamp"), F.lit(as_of).cast("timestamp"))
    return ends.select(key, F.floor((seconds(end) - seconds(F.col("first"))) / 86400).alias("dom"))


def area_price(df: DataFrame, km: float, least: int = 5, max_lat: float = 50.0) -> DataFrame:
    """id, n_comps, median_m2 and pct_vs_average of rows (id, kind, size, price, lat, lon): comparables are other rows
    of the same kind within ``km``; the figures are null under ``least`` of them."""
    sized = df.filter("size > 0").select("id", "kind", "lat", "lon", (F.col("price") / F.col("size")).alias("m2"))
    comps = near_percentiles(sized, km, "m2", (0.5,), max_lat).select("id", "n", F.col("p")[0].alias("median"))
    enough = F.coalesce("n", F.lit(0)) >= least
    joined = sized.join(comps, "id", "left")
    return joined.select("id", F.coalesce("n", F.lit(0)).alias("n_comps"), F.when(enough, F.round(F.col("median") * 1e6) / 1e6).alias("median_m2"), F.when(enough, F.round(F.try_divide(F.col("m2") - F.col("median"), F.col("median")) * 100, 4)).alias("pct_vs_average"))


def rent_estimate(df: DataFrame, km: float, max_lat: float = 50.0) -> DataFrame:
    """id, n, p25, p50, p75, confidence: comparables within ``km`` whose size is within 35 %."""
    sized = df.filter("size > 0").select("id", "kind", "size", "price", "lat", "lon")
    found = near_percentiles(sized, km, "price", (0.25, 0.5, 0.75), max_lat, ("size", 0.65, 1.35))
    spread = F.try_divide(F.col("p")[2] - F.col("p")[0], F.col("p")[1])
    label = F.when((F.col("n") >= 8) & (spread <= 0.6), "high").when((F.col("n") >= 3) & ((F.col("n") >= 8) | (spread <= 0.6)), "low").otherwise("insufficient")
    return found.select("id", "n", *(F.round(F.col("p")[i], 6).alias(name) for i, name in enumerate(("p25", "p50", "p75"))), label.alias("confidence"))


def like_for_like(df: DataFrame, pool: Sequence[str], least: int = 3) -> DataFrame:
    """id, basis (segment, pool or null), reference, below: how far a row's price per size is under the median of its
    segment (rooms within 1, size within 25 %, same ground flag), else of its pool. The row itself counts in both.

    Rows that share pool, ground, rooms and size have one segment: it is asked for once, and its equal values are counted
    before they meet it. So the work is segments times values near them, not rows times rows."""
    rows = df.withColumn("m2", F.try_divide(F.col("price"), F.col("size")))
    same = [*pool, "ground", "rooms", "size"]
    held = rows.groupBy(*same, "m2").agg(F.count("*").alias("_n"))
    pairs = band_join(rows.select(*same).distinct(), held, (*pool, "ground"), "rooms", 1, F.col("r.size").between(F.col("l.size") * 0.75, F.col("l.size") * 1.25))
    segment = pairs.groupBy(*(F.col(f"l.{c}").alias(c) for c in same)).agg(F.sum("r._n").alias("n_segment"), F.percentile("r.m2", 0.5, F.col("r._n")).alias("segment"))
    whole = rows.groupBy(*pool).agg(F.count("*").alias("n_pool"), F.percentile("m2", 0.5).alias("pool_median"))
    joined = rows.join(segment, same, "left").join(whole, list(pool))
    basis = F.when(F.col("n_segment") >= least, "segment").when(F.col("n_pool") >= least, "pool")
    reference = F.when(basis == "segment", F.col("segment")).when(basis == "pool", F.col("pool_median"))
    return joined.select("id", basis.alias("basis"), F.round(reference, 6).alias("reference"), F.round(1 - F.try_divide(F.col("m2"), reference), 6).alias("below"))


def cheapest_fresh(listings: DataFrame, key: str, now, days: int = 30) -> DataFrame:
    """key, price, last_seen of the cheapest active rental listing of each property that was seen within ``days`` and has a
    price; both from the same row (ties: the later sight, then the smaller id)."""
    fresh = listings.filter((F.col("status") == "active") & (F.col("operation") == "rent") & (F.col("price") > 0) & (F.col("last_seen") >= now - F.expr(f"INTERVAL {days} DAYS")))
    order = F.struct("price", (-F.unix_micros(F.col("last_seen").cast("timestamp"))).alias("age"), "id")
    return fresh.groupBy(key).agg(F.min_by(F.struct("price", "last_seen"), order).alias("b")).select(key, "b.price", "b.last_seen")


def rent_decision(m2: Column, located: Column, assumption: Column, market: Column, confidence: Column) -> tuple[Column, Column, Column]:
    """Monthly rent, method and how far a profile's assumption (per square metre) is from the market: the assumption goes
    first where there is one, else the market's estimate if it is not ``insufficient``."""
    assumed = F.when(m2 > 0, assumption * m2)
    usable = F.coalesce(confidence.isin("high", "low"), F.lit(False))
    found = F.when(located & usable & (m2 > 0), market)
    method = (
        F.when(F.coalesce(m2 <= 0, F.lit(True)), "no_property_size").when(assumed.isNotNull(), "profile_assumption").when(~located, "no_property_location").when(~usable, "insufficient_data")
        .when(confidence == "high", "market_comparable_high").otherwise("market_comparable_low")
    )
    return F.coalesce(assumed, found), method, F.try_divide(assumed - found, found)


#: Days within which a return counts, and the least drop. (Fixed values.)
RELIST_DAYS, RELIST_DROP = 90, 0.05


#: Kinds of facts in the order in which they meet at one time: a return sees the price of its time ahead, a withdrawal has it behind.
BACK, PRICE, GONE, LISTED = 0, 1, 2, 3


def relisted_lower(listings: DataFrame, status: DataFrame, history: DataFrame, keys: Sequence[str], entity: str, gone: Sequence[str], back: Sequence[str]) -> DataFrame:
    """entity, fall (the greatest drop), n (pairs), and the pair of the greatest drop (withdrawn_at, relisted_at; of equal drops
    the earliest): a listing of the entity withdrawn, and one active again after it within RELIST_DAYS at RELIST_DROP less.

    listings: keys, first_seen, current_price; status events: keys, at, status; history: keys, at, price (one a time). The price
    at a withdrawal is the last one up to it, at an activation (first seen or back) the first one from it on; without one the
    current price.
    """
    none = F.lit(None)
    fact = lambda rows, at, kind, price, current: rows.select(*keys, at.alias("at"), kind.alias("_kind"), price.cast("double").alias("price"), current.alias("_current"))
    facts = (
        fact(history, F.col("at"), F.lit(PRICE), F.col("price"), none.cast("double"))
        .union(fact(status.filter(F.col("status").isin(*gone)), F.col("at"), F.lit(GONE), none, none.cast("double")))
        .union(fact(status.filter(F.col("status").isin(*back)), F.col("at"), F.lit(BACK), none, none.cast("double")))
        .union(fact(listings, F.col("first_seen"), F.lit(LISTED), none, F.col("current_price").cast("double")))
    )
    whole = Window.partitionBy(*keys)
    known = facts.withColumns({"_known": F.max(F.col("_kind") == LISTED).over(whole), "_current": F.max("_current").over(whole)}).filter("_known")
    return relisted_facts(known.withColumn("_kind", F.when(F.col("_kind") == LISTED, BACK).otherwise(F.col("_kind"))), keys, entity)


def relisted_facts(facts: DataFrame, keys: Sequence[str], entity: str) -> DataFrame:
    """``relisted_lower`` over one line of facts: keys, at, _kind (PRICE, GONE, BACK), price (of PRICE), _current (the listing's).

    Facts dealt by their keys stay where they are: prices are carried along the line forwards and backwards by two sorts, and only
    what is withdrawn and what comes back is dealt anew, by entity.
    """
    along = lambda *order: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    events = facts.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))

    def priced(kind: int, window: WindowSpec) -> DataFrame:
        line = events.filter(F.col("_kind").isin(PRICE, kind)).withColumn("_carried", F.last("price", ignorenulls=True).over(window))
        rows = line.filter((F.col("_kind") == kind) & F.col("at").isNotNull())
        return rows.select(*keys, "at", F.coalesce("_carried", "_current").alias("price")).filter("price > 0")

    left = priced(GONE, along(F.asc("at"), F.asc("_kind"), F.asc("price"))).select(entity, "at", "price")
    right = priced(BACK, along(F.desc("at"), F.desc("_kind"), F.desc("price"))).dropDuplicates([*keys, "at"]).select(entity, "at", "price")
    pairs = interval_join(left, right, (entity,), F.col("l.at"), F.col("l.at") + F.make_dt_interval(F.lit(RELIST_DAYS)), "at")
    fall = (F.col("l.price") - F.col("r.price")) / F.col("l.price")
    rows = pairs.select(F.col(f"l.{entity}").alias(entity), fall.alias("fall"), F.col("l.at").alias("withdrawn_at"), F.col("r.at").alias("relisted_at")).filter(F.col("fall") >= RELIST_DROP)
    best = F.min_by(F.struct("withdrawn_at", "relisted_at"), F.struct(-F.col("fall"), "withdrawn_at", "relisted_at"))
    return rows.groupBy(entity).agg(F.max("fall").alias("fall"), F.count("*").alias("n"), best.alias("_b")).select(entity, "fall", "n", "_b.withdrawn_at", "_b.relisted_at")
