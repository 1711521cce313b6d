"""Ledger queries: order lines as price observations, events as attempts and failures, customers' rows as photos."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessaria.operators import ledger
from tessaria.plans.registry import AS_OF, query
from tessaria.session import table

KEYS = ["l_partkey", "l_suppkey"]
def now():
    return F.expr(f"TIMESTAMP_NTZ '{AS_OF}'")



@query(
    "price_observations",
    """WITH u AS (SELECT *, l_extendedprice / l_quantity AS price, l_orderkey * 10 + l_linenumber AS id FROM lineitem), old AS (SELECT * FROM u WHERE l_shipdate < DATE '1995-06-01'),
l AS (SELECT l_partkey, l_suppkey, CASE WHEN l_partkey % 9 = 0 THEN NULL WHEN l_partkey % 10 = 0 THEN 0 ELSE min(price) END AS current, CASE WHEN l_suppkey % 3 > 0 THEN max(l_shipdate) END AS fetched,
  arg_max(price, {'a': l_shipdate, 'b': id, 'c': price}) AS latest FROM old GROUP BY l_partkey, l_suppkey),
n AS (SELECT l_partkey, l_suppkey, CASE WHEN l_partkey % 13 > 0 THEN max(price) END AS price FROM u WHERE l_shipdate >= DATE '1995-06-01' GROUP BY l_partkey, l_suppkey)
SELECT l_partkey, l_suppkey, price, price <> latest AND (latest <= 0 OR abs(price - latest) / latest >= 0.01::DOUBLE) AS recorded,
  price IS DISTINCT FROM current AND (fetched IS NULL OR fetched < TIMESTAMP '1995-01-01') AND (current IS NULL OR current <= 0 OR abs(price - current) / current BETWEEN 0.01::DOUBLE AND 0.6::DOUBLE) AS adopted
FROM n JOIN l USING (l_partkey, l_suppkey) WHERE price IS NOT NULL""",
)
def price_observations(spark, d):
    u = table(spark, d, "lineitem").withColumns({"price": F.col("l_extendedprice") / F.col("l_quantity"), "id": F.col("l_orderkey") * 10 + F.col("l_linenumber"), "at": F.col("l_shipdate")})
    old, new = u.filter("l_shipdate < DATE '1995-06-01'"), u.filter("l_shipdate >= DATE '1995-06-01'")
    current = F.when(F.col("l_partkey") % 9 == 0, None).when(F.col("l_partkey") % 10 == 0, 0.0).otherwise(F.min("price"))
    listings = old.groupBy(*KEYS).agg(current.alias("current_price"), F.when(F.col("l_suppkey") % 3 > 0, F.max("at")).alias("fetched"))
    incoming = new.groupBy(*KEYS).agg(F.when(F.col("l_partkey") % 13 > 0, F.max("price")).alias("price"))
    return ledger.price_observations(listings, old.select(*KEYS, "price", "at", F.struct("id", "price").alias("id")), incoming, KEYS, F.expr("TIMESTAMP_NTZ '1995-01-01 00:00:00'"))


@query(
    "retired_notices",
    """WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 7 > 0 THEN p_size::DOUBLE END AS stored, CASE WHEN p_partkey % 5 > 0 THEN p_size + p_partkey % 4 * 0.6::DOUBLE END AS stated, p_size % 5 AS rooms, CASE WHEN p_partkey % 3 > 0 THEN (p_size + (p_partkey % 11 = 0)::INT) % 5 END AS stated_rooms,
  DATE '2024-01-10' + (p_partkey % 20)::INT AS gone, CASE WHEN p_partkey % 6 > 0 THEN TIMESTAMP '2024-01-15 23:30:00' + p_partkey % 9 * INTERVAL 1 DAY END AS seen FROM part)
SELECT p_partkey, CASE WHEN abs(stored - stated) > CASE WHEN 0.05 * greatest(stored, stated) > 1 THEN 0.05::DOUBLE * greatest(stored, stated) ELSE 1 END THEN 'size' WHEN rooms <> stated_rooms THEN 'rooms' END AS contradiction,
  CASE WHEN seen IS NULL OR gone >= seen::DATE THEN gone END AS delisted FROM x""",
)
def retired_notices(spark, d):
    """Notices about parts: size and rooms against the stored ones, and the date against the last sight."""
    k, size = F.col("p_partkey"), F.col("p_size")
    stored = F.when(k % 7 > 0, size.cast("double"))
    stated = F.when(k % 5 > 0, size + (k % 4) * F.lit(0.6))
    rooms = F.when(k % 3 > 0, (size + F.when(k % 11 == 0, 1).otherwise(0)) % 5)
    gone = F.date_add(F.lit("2024-01-10").cast("date"), (k % 20).cast("int"))
    seen = F.when(k % 6 > 0, F.expr("TIMESTAMP_NTZ '2024-01-15 23:30:00' + make_dt_interval(CAST(p_partkey % 9 AS INT))"))
    return table(spark, d, "part").select("p_partkey", ledger.notice_contradiction(stated, stored, rooms, size % 5).alias("contradiction"), ledger.clamped_delisting(gone, seen).alias("delisted"))


@query(
    "photo_store",
    f"""WITH o AS (SELECT 'u' || (user_id * 7 + event_id % 5) AS url, CASE WHEN event_type <> 'error' THEN event_id END AS hash, ts AS moment FROM events),
s AS (SELECT url, struct_extract(arg_max({{'h': hash}}, {{'a': moment, 'b': coalesce(hash, -1)}}), 'h') AS hash, count(*) AS attempts, max(moment) AS last_attempt FROM o GROUP BY url)
SELECT url, hash, attempts, last_attempt, hash IS NOT NULL OR last_attempt > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AS known FROM s""",
)
def photo_store(spark, d):
    """Outcomes of two runs saved one after the other; a url is known unless it last failed more than a week ago."""
    url = F.concat(F.lit("u"), (F.col("user_id") * 7 + F.col("event_id") % 5).cast("string"))
    o = table(spark, d, "events").select(url.alias("url"), F.when(F.col("event_type") != "error", F.col("event_id")).alias("hash"), F.col("ts").alias("at"))
    cut = F.expr("TIMESTAMP_NTZ '2024-01-16 00:00:00'")
    store = spark.createDataFrame([], "url string, hash long, attempts long, last_attempt timestamp_ntz")
    store = ledger.save_outcomes(ledger.save_outcomes(store, o.filter(F.col("at") < cut)), o.filter(F.col("at") >= cut))
    known = ledger.known_outcomes(store, o, now()).select("url", F.lit(True).alias("known"))
    return store.join(known, "url", "left").withColumn("known", F.coalesce("known", F.lit(False)))


@query(
    "verdict_failures",
    f"""WITH e AS (SELECT user_id, event_id % 3 AS kind, event_type, ts, event_id FROM events),
ok AS (SELECT user_id, kind, max(ts) AS done FROM e WHERE event_type = 'purchase' AND ts < TIMESTAMP '2024-01-20' GROUP BY ALL),
f AS (SELECT e.* FROM e ANTI JOIN (SELECT user_id, kind FROM ok WHERE user_id % 4 = 0) c USING (user_id, kind) WHERE event_type = 'error')
SELECT user_id, kind, count(*)::BIGINT AS fail_count, arg_max('error ' || event_id, {{'a': ts, 'b': 'error ' || event_id}}) AS last_error, max(ts) AS last_failed,
  count(*) >= 3 AND max(ts) > TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY AS parked FROM f GROUP BY user_id, kind""",
)
def verdict_failures(spark, d):
    """Failures recorded in two runs, then those of some users' successful verdicts cleared."""
    e = table(spark, d, "events").withColumn("kind", F.col("event_id") % 3)
    failures = e.filter("event_type = 'error'").select("user_id", "kind", F.concat(F.lit("error "), F.col("event_id").cast("string")).alias("error"), F.col("ts").alias("at"))
    cut = F.expr("TIMESTAMP_NTZ '2024-01-16 00:00:00'")
    keys = ["user_id", "kind"]
    book = spark.createDataFrame([], "user_id long, kind long, fail_count long, last_error string, last_failed timestamp_ntz")
    book = ledger.record_failures(ledger.record_failures(book, failures.filter(F.col("at") < cut), keys), failures.filter(F.col("at") >= cut), keys)
    book = ledger.clear_failures(book, e.filter("event_type = 'purchase' AND user_id % 4 = 0 AND ts < TIMESTAMP_NTZ '2024-01-20 00:00:00'"), keys)
    stopped = ledger.parked(book, now()).select(*keys, F.lit(True).alias("parked"))
    return book.join(stopped, keys, "left").withColumn("parked", F.coalesce("parked", F.lit(False)))


@query("zero_success", "SELECT user_id, count(*)::BIGINT AS attempted FROM events WHERE event_id % 4 = 0 GROUP BY user_id HAVING count(*) FILTER (WHERE event_type = 'purchase') = 0")
def zero_success(spark, d):
    e = table(spark, d, "events")
    return ledger.zero_success(e, "user_id", F.col("event_id") % 4 == 0, F.col("event_type") == "purchase")


@query(
    "rescue_set",
    """WITH x AS (SELECT p_partkey AS a, p_partkey + 1 AS b, p_partkey % 2 AS e, p_partkey % 3 AS h, p_partkey % 5 AS t FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0)
SELECT a, b FROM x WHERE (a // 4 = b // 4) AND (h = 0 OR t < 3)""",
)
def rescue_set(spark, d):
    """Neighbouring parts as suggestions. Prices agree within groups of four; photos of multiples of three differ in 10 bits,
    others in 11; descriptions of t < 3 are alike but for their order, others share half of their letters."""
    k = F.col("p_partkey")
    pairs = table(spark, d, "part").filter("p_partkey % 2 = 0 OR p_partkey % 3 = 0").select(
        k.alias("a"), (k + 1).alias("b"), F.floor(k / 4).alias("a_price"), F.floor((k + 1) / 4).alias("b_price"), F.lit(80.0).alias("a_m2"), F.lit(80.0).alias("b_m2"),
        F.array(k).alias("a_hashes"), F.array(k.bitwiseXOR(F.when(k % 3 == 0, (1 << 50) - (1 << 40)).otherwise((1 << 51) - (1 << 40)))).alias("b_hashes"),
        F.lit("gran piso centro").alias("a_description"), F.when(k % 5 < 3, "centro gran piso").when(k % 5 == 3, "").otherwise("vvvvv wwww xxxxx").alias("b_description"),
    )
    return ledger.rescued(pairs).select("a", "b")


@query(
    "reevaluated_suggestions",
    """SELECT p_partkey AS a, p_partkey + 1 AS b, CASE WHEN p_partkey % 7 = 6 OR p_partkey % 7 = 5 THEN 'delete' WHEN p_partkey % 7 = 0 THEN 'merge' WHEN p_partkey % 7 = 1 THEN 'reject' WHEN p_partkey % 7 = 2 THEN 'keep' ELSE 'update' END AS action,
  CASE WHEN p_partkey % 7 IN (2, 5, 6) THEN 'phone' WHEN p_partkey % 7 = 4 THEN 'phone' ELSE 'photo_hash' END AS basis, CASE WHEN p_partkey % 7 IN (2, 5, 6) THEN 0.75 ELSE p_partkey % 7 / 10 END::DOUBLE AS confidence FROM part""",
)
def reevaluated_suggestions(spark, d):
    k = F.col("p_partkey")
    m = k % 7
    rows = table(spark, d, "part").select(k.alias("a"), (k + 1).alias("b"), m.alias("m"))
    pending = rows.select("a", "b", F.lit("phone").alias("basis"), F.lit(0.75).alias("confidence"))
    decision = F.when(F.col("m") == 0, "merge").when(F.col("m") == 1, "reject").when(F.col("m") == 5, "none").otherwise("suggest")
    fresh = rows.filter("m < 6").select("a", "b", F.when(F.col("m").isin(2, 4), "phone").otherwise("photo_hash").alias("basis"), decision.alias("decision"), F.when(F.col("m") == 2, 0.75).otherwise(F.col("m") / 10).alias("confidence"))
    return ledger.reevaluated(pending, fresh)


@query(
    "vetoes_and_revert",
    """WITH v AS (SELECT p_partkey AS lo, p_partkey + 1 AS hi FROM part WHERE p_partkey % 3 <> 1), l AS (SELECT DISTINCT p_partkey AS lo FROM part WHERE p_partkey % 5 = 0)
SELECT 'veto' AS kind, lo AS a, hi AS b FROM v WHERE lo NOT IN (SELECT lo FROM l)
UNION ALL SELECT 'listing', p_partkey, CASE WHEN p_partkey % 4 = 1 AND p_partkey % 8 <> 1 THEN p_partkey * 10 WHEN p_partkey % 8 = 1 THEN 7 ELSE p_partkey * 10 END FROM part WHERE p_partkey % 4 < 3
UNION ALL SELECT 'listing', p_partkey, 5 FROM part WHERE p_partkey % 4 = 3""",
)
def vetoes_and_revert(spark, d):
    """Vetoes after rejections and liftings; listings after merge 1 (keys of remainder 1 by 4) was reverted: those moved on
    since (remainder 1 by 8) stay, and so do those of merge 2 (remainder 3)."""
    k = F.col("p_partkey")
    p = table(spark, d, "part").select("p_partkey")
    old = p.filter(k % 3 == 0).select(k.alias("lo"), (k + 1).alias("hi"))
    rejected = p.filter(k % 3 == 2).select((k + 1).alias("a"), k.alias("b"))
    lifted = p.filter(k % 5 == 0).select(k.alias("a"), (k + 1).alias("b"))
    vetoes = ledger.vetoes_after(old, rejected, lifted).select(F.lit("veto").alias("kind"), F.col("lo").alias("a"), F.col("hi").alias("b"))
    now = F.when(k % 8 == 1, 7).when(k % 4 == 1, 6).when(k % 4 == 3, 5).otherwise(k * 10)
    current = p.select(k.alias("listing_id"), now.alias("property_id"))
    snapshot = p.filter(k % 2 == 1).select(F.when(k % 4 == 1, 1).otherwise(2).alias("merge_id"), k.alias("listing_id"), (k * 10).alias("before"), F.when(k % 4 == 1, 6).otherwise(5).alias("after"))
    back = ledger.reverted(current, snapshot, 1)
    return vetoes.unionByName(back.select(F.lit("listing").alias("kind"), F.col("listing_id").alias("a"), F.col("property_id").alias("b")))
