"""The ranked candidate feed: boosts, novelty, cold start."""

from __future__ import annotations

import base64
import datetime
import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the boosts over the base score. (Fixed values.)
MARKET_CAP, MARKET_WEIGHT = 0.5, 0.5
DISTRESS_CAP, DISTRESS_WEIGHT = 3, 0.05
BEACH_WEIGHT, TOURIST_WEIGHT = 0.03, 0.04
DAYS_FULL, DAYS_WEIGHT, DROP_FULL, DROP_WEIGHT, TIMING_CAP = 180, 0.04, 0.2, 0.07, 0.11
FRESH_SHARE = 0.6
#: Stands for a missing score in a cursor.
NO_SCORE = -1.0


def effective_score(score: Column, below_market: Column, distress: Column, beach: Column, tourist: Column, days: Column, drop: Column) -> Column:
    """Base score (−1 without one) plus bounded boosts; a missing input adds nothing."""
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    market = F.least(F.greatest(zero(below_market), F.lit(0.0)), F.lit(MARKET_CAP)) * MARKET_WEIGHT
    signs = F.least(zero(distress), F.lit(float(DISTRESS_CAP))) * DISTRESS_WEIGHT
    timing = F.least(zero(days) / DAYS_FULL * DAYS_WEIGHT + zero(drop) / DROP_FULL * DROP_WEIGHT, F.lit(TIMING_CAP))
    return F.coalesce(score.cast("double"), F.lit(-1.0)) + market + signs + zero(beach) * BEACH_WEIGHT + F.when(tourist, TOURIST_WEIGHT).otherwise(0.0) + timing


def novelty_tier(rows: DataFrame, first_seen: str, anchor: str, profile: str) -> DataFrame:
    """Adds ``tier``: 1 for rows first seen after the profile's anchor, else 0; all 0 for a profile without anchor or
    with more than 60 % fresh rows. One aggregate per profile joined back."""
    fresh = F.coalesce(F.col(first_seen) > F.col(anchor), F.lit(False))
    share = rows.groupBy(profile).agg((F.count_if(fresh) / F.count("*")).alias("_share"))
    return rows.join(share, profile).withColumn("tier", F.when(fresh & F.col(anchor).isNotNull() & (F.col("_share") <= FRESH_SHARE), 1).otherwise(0)).drop("_share")


def visible_pool(listings: DataFrame, disabled: DataFrame) -> DataFrame:
    """id, visible, first_seen, sources of listings (id, source, active_sale, first_seen). A property is visible if none of its
    listings is an active sale or one from an enabled source is; first_seen is the earliest among enabled sources, sources
    are the enabled ones with an active sale. ``disabled``: source, one row each."""
    rows = listings.join(disabled.select("source", F.lit(True).alias("_off")).distinct(), "source", "left")
    on = F.col("_off").isNull()
    active = F.coalesce("active_sale", F.lit(False))
    return rows.groupBy("id").agg(
        ((F.count_if(active) == 0) | (F.count_if(active & on) > 0)).alias("visible"),
        F.min(F.when(on, F.col("first_seen"))).alias("first_seen"),
        F.array_sort(F.collect_set(F.when(active & on, F.col("source")))).alias("sources"),
    )


def profile_anchors(profiles: DataFrame) -> DataFrame:
    """profile, anchor, never of profiles (profile, previous: start of the visit before the last one, created): who was never
    there looks back from a day before the profile was made."""
    return profiles.select("profile", F.coalesce("previous", F.col("created") - F.expr("INTERVAL 1 DAY")).alias("anchor"), F.col("previous").isNull().alias("never"))


def with_novelty(pool: DataFrame, anchors: DataFrame) -> DataFrame:
    """Adds anchor, is_new, cold_start and tier to a pool (profile, first_seen, ...): a candidate is new if it was first seen
    after its profile's anchor; the tier of new ones is 1 unless the profile was never visited or more than 60 % of its
    pool are new. Counts per profile are partial sums, joined back."""
    rows = pool.join(anchors, "profile").withColumn("is_new", F.coalesce(F.col("first_seen") > F.col("anchor"), F.lit(False)))
    share = rows.groupBy("profile").agg((F.count_if("is_new") / F.count("*")).alias("_share"))
    cold = F.col("never") | (F.col("_share") > FRESH_SHARE)
    return rows.join(share, "profile").withColumn("cold_start", cold).withColumn("tier", F.when(F.col("is_new") & ~F.col("cold_start"), 1).otherwise(0)).drop("_share", "never")


def changes_since(moves: DataFrame, pool: DataFrame) -> DataFrame:
    """profile, id, change of the latest price move of each property where it came after the profile's anchor. ``moves``: id,
    at, price, previous (the latest of each property)."""
    usable = (F.col("previous") > 0) & (F.col("price") != F.col("previous"))
    rows = pool.select("profile", "id", "anchor").join(moves.filter(usable), "id").filter(F.col("at") > F.col("anchor"))
    return rows.select("profile", "id", ((F.col("price") - F.col("previous")) / F.col("previous")).alias("change"))


def encode_cursor(tier: int, score: float | None, number: int, anchor: str, cold_start: bool) -> str:
    """The last row of a page, with the anchor and the decision that later pages keep, as one opaque text."""
    return base64.urlsafe_b64encode(json.dumps([tier, NO_SCORE if score is None else score, number, anchor, cold_start], separators=(",", ":")).encode()).decode().rstrip("=")


def decode_cursor(text: str) -> tuple[int, float, int, str, bool] | None:
    """None for anything that is no such text."""
    try:
        tier, score, number, anchor, cold = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
        datetime.datetime.fromisoformat(anchor)
    except (ValueError, TypeError):
        return None
    whole = lambda x: type(x) is int
    if not (whole(tier) and whole(number) and number > 0 and type(score) in (int, float) and math.isfinite(score) and type(cold) is bool):
        return None
    return tier, float(score), number, anchor, cold


def page(ranked: DataFrame, size: int, cursor: tuple[int, float, int, str, bool] | None = None) -> DataFrame:
    """The next ``size`` + 1 rows (one more than is shown tells that there are more) by falling tier, score and id."""
    if cursor:
        tier, score, number = cursor[:3]
        s = F.coalesce("score", F.lit(NO_SCORE))
        ranked = ranked.filter((F.col("tier") < tier) | ((F.col("tier") == tier) & ((s < score) | ((s == score) & (F.col("id") < number)))))
    return ranked.orderBy(F.desc("tier"), F.coalesce("score", F.lit(NO_SCORE)).desc(), F.desc("id")).limit(size + 1)
