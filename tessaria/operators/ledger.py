"""Observations and failures that accumulate: price observations, retired notices, photo outcomes, verdict failures, and
what becomes of pending suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaria.functions.text import token_sort_ratio
from tessaria.operators.linkage import HASH_DISTANCE, hash_distance

#: Price moves below the first share are noise, above the second suspect. (Fixed values.)
NOISE_FLOOR, SUSPECT_CEILING = 0.01, 0.60
#: Tolerance of a notice's size: square metres, and share of the larger size. (Fixed values.)
NOTICE_M2, NOTICE_SHARE = 1, 0.05
#: Days after which a failed photo is tried again, and after which a verdict's failures are forgotten; failures that park a
#: verdict; characters of an error that are kept. (Fixed values.)
RETRY_DAYS, DECAY_DAYS, PARK_FAILS, ERROR_CHARS = 7, 14, 3, 500
RESCUE_SIMILARITY = 0.90


def _share(new: Column, old: Column) -> Column:
    return F.try_divide(F.abs(new - old), old)


def price_observations(listings: DataFrame, history: DataFrame, incoming: DataFrame, keys: list[str], started: Column | None = None) -> DataFrame:
    """What a discovery's prices do: keys, price, ``recorded`` (a history row is written, unless the move from the latest
    one is noise) and ``adopted`` (the listing's price becomes it, unless the move is noise or suspect, or the listing was
    fetched since ``started``). listings: keys, current_price, fetched; history: keys, price, at, id; incoming: keys, price.
    Only known listings count, and prices that are not null."""
    latest = history.groupBy(*keys).agg(F.max_by("price", F.struct("at", "id")).alias("latest"))
    rows = incoming.filter("price IS NOT NULL").join(listings.select(*keys, "current_price", "fetched"), keys).join(latest, keys, "left")
    price, old, current = F.col("price"), F.col("latest"), F.col("current_price")
    recorded = ~price.eqNullSafe(old) & (old.isNull() | (old <= 0) | (_share(price, old) >= NOISE_FLOOR))
    late = F.lit(True) if started is None else F.col("fetched").isNull() | (F.col("fetched") < started)
    adopted = ~price.eqNullSafe(current) & late & (current.isNull() | (current <= 0) | _share(price, current).between(NOISE_FLOOR, SUSPECT_CEILING))
    return rows.select(*keys, "price", F.coalesce(recorded, F.lit(False)).alias("recorded"), F.coalesce(adopted, F.lit(False)).alias("adopted"))


def notice_contradiction(stated_m2: Column, stored_m2: Column, stated_rooms: Column, stored_rooms: Column) -> Column:
    """``size``, ``rooms`` or null: whether a retired notice is about another property. What one side lacks is no
    contradiction."""
    tolerance = F.greatest(F.lit(float(NOTICE_M2)), F.greatest(stated_m2, stored_m2) * NOTICE_SHARE)
    size = stated_m2.isNotNull() & stored_m2.isNotNull() & (F.abs(stored_m2 - stated_m2) > tolerance)
    rooms = stated_rooms.isNotNull() & stored_rooms.isNotNull() & (stated_rooms != stored_rooms)
    return F.when(size, "size").when(rooms, "rooms")


def clamped_delisting(stated: Column, last_seen: Column) -> Column:
    """A stated delisting date, or null if the listing was seen on a later day."""
    return F.when(last_seen.isNull() | (stated >= F.to_date(last_seen)), stated)


def save_outcomes(store: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The photo store after a run. store: url, hash, attempts, last_attempt; outcomes: url, hash (null: it failed), at. The
    last outcome of a url replaces what is stored, and every outcome is an attempt."""
    last = outcomes.groupBy("url").agg(F.max_by(F.struct("hash"), F.struct("at", "hash")).alias("o"), F.max("at").alias("at"), F.count("*").alias("n"))
    both = store.join(last, "url", "full")
    new = F.col("at").isNotNull()
    return both.select("url", F.when(new, F.col("o.hash")).otherwise(F.col("hash")).alias("hash"), (F.coalesce("attempts", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("attempts"), F.coalesce("at", "last_attempt").alias("last_attempt"))


def known_outcomes(store: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """Of the wanted urls those that need no fetch: hashed at any time, or failed within the last RETRY_DAYS."""
    fresh = F.col("last_attempt") > now - F.expr(f"INTERVAL {RETRY_DAYS} DAYS")
    return store.filter(F.col("hash").isNotNull() | fresh).join(wanted.select("url").distinct(), "url", "left_semi").select("url", "hash")


def record_failures(ledger: DataFrame, failures: DataFrame, keys: list[str]) -> DataFrame:
    """The ledger (keys, fail_count, last_error, last_failed) after more failures (keys, error, at)."""
    more = failures.groupBy(*keys).agg(F.count("*").alias("_n"), F.max_by("error", F.struct("at", "error")).alias("_error"), F.max("at").alias("_at"))
    both = ledger.join(more, keys, "full")
    error = F.when(F.col("_n").isNotNull(), F.substring("_error", 1, ERROR_CHARS)).otherwise(F.col("last_error"))
    return both.select(*keys, (F.coalesce("fail_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("fail_count"), error.alias("last_error"), F.coalesce("_at", "last_failed").alias("last_failed"))


def clear_failures(ledger: DataFrame, successes: DataFrame, keys: list[str]) -> DataFrame:
    return ledger.join(successes.select(*keys).distinct(), keys, "left_anti")


def parked(ledger: DataFrame, now: Column) -> DataFrame:
    """Verdicts that are left alone: PARK_FAILS failures or more, the last within DECAY_DAYS."""
    return ledger.filter((F.col("fail_count") >= PARK_FAILS) & (F.col("last_failed") > now - F.expr(f"INTERVAL {DECAY_DAYS} DAYS")))


def zero_success(attempts: DataFrame, source: str, live: Column, ok: Column) -> DataFrame:
    """Sources with live attempts of which none succeeded, and how many there were."""
    per = attempts.groupBy(source).agg(F.count_if(live).alias("attempted"), F.count_if(live & ok).alias("_ok"))
    return per.filter("attempted > 0 AND _ok = 0").drop("_ok")


def rescued(pairs: DataFrame) -> DataFrame:
    """Pending weak suggestions worth keeping: equal price and size, and a shared photo or nearly the same description.
    pairs: a_ and b_ price, m2, description, hashes. Descriptions are compared only where price and size agree."""
    same = F.coalesce((F.col("a_price") == F.col("b_price")) & (F.col("a_m2") == F.col("b_m2")), F.lit(False))
    photo = F.exists("a_hashes", lambda p: F.exists("b_hashes", lambda q: hash_distance(p, q) <= HASH_DISTANCE))
    rows = pairs.filter(same)
    empty = lambda c: F.nullif(F.col(c), F.lit(""))
    rows = rows.withColumn("_alike", token_sort_ratio(empty("a_description"), empty("b_description")))
    return rows.filter(F.coalesce(photo, F.lit(False)) | F.coalesce(F.col("_alike") >= RESCUE_SIMILARITY, F.lit(False))).drop("_alike")


def reevaluated(pending: DataFrame, fresh: DataFrame) -> DataFrame:
    """Pending suggestions (a, b, basis, confidence) held against fresh verdicts (a, b, basis, decision, confidence): a, b,
    ``action`` (merge, reject, delete, update or keep), basis, confidence. No verdict any more deletes the suggestion."""
    f = fresh.select("a", "b", F.col("basis").alias("_basis"), "decision", F.col("confidence").alias("_confidence"))
    rows = pending.join(f, ["a", "b"], "left")
    none = F.coalesce(F.col("decision") == "none", F.lit(True))
    same = F.col("basis").eqNullSafe(F.col("_basis")) & F.col("confidence").eqNullSafe(F.col("_confidence"))
    action = F.when(none, "delete").when(F.col("decision") == "merge", "merge").when(F.col("decision") == "reject", "reject").when(same, "keep").otherwise("update")
    return rows.select("a", "b", action.alias("action"), F.when(none, F.col("basis")).otherwise(F.col("_basis")).alias("basis"), F.when(none, F.col("confidence")).otherwise(F.col("_confidence")).alias("confidence"))


def vetoes_after(vetoes: DataFrame, rejected: DataFrame, lifted: DataFrame) -> DataFrame:
    """Vetoed pairs (lo, hi) after pairs (a, b) were rejected and others lifted; a pair's order does not matter."""
    pair = lambda df: df.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).filter("lo < hi").distinct()
    return vetoes.select("lo", "hi").union(pair(rejected)).distinct().join(pair(lifted), ["lo", "hi"], "left_anti")


def reverted(current: DataFrame, snapshot: DataFrame, merge_id: int) -> DataFrame:
    """Listings (listing_id, property_id) with those of one merge back at the property that the snapshot (merge_id,
    listing_id, before, after) has; listings that have since been moved on stay where they are."""
    own = snapshot.filter(F.col("merge_id") == merge_id).select("listing_id", "before", "after")
    rows = current.join(own, "listing_id", "left")
    return rows.select("listing_id", F.when(F.col("property_id") == F.col("after"), F.col("before")).otherwise(F.col("property_id")).alias("property_id"))
