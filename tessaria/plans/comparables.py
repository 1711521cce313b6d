"""Distances, comparables, the ranked feed and investment figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessaria.functions.geo import circle_polygon, great_circle_km, haversine_m, in_box, polyline_decode, polyline_encode
from tessaria.operators import feed, finance, keyed, market, queues, scope
from tessaria.operators.joins import nearest, within_km_join, within_own_km_join
from tessaria.operators.selection import feed_filters
from tessaria.plans.registry import LINE_ORDER, LINE_ORDER_SQL, PARTS_SQL, km_sql, parts, query
from tessaria.session import table


def homes(spark, d):
    return parts(spark, d).select("id", F.col("p_type").alias("kind"), F.col("p_size").alias("size"), "price", "lat", "lon", "rooms", "ground")


@query(
    "distances",
    f"""SELECT id, round({km_sql("x", "c")}, 4) AS km, round(2 * 6371000 * asin(sqrt(pow(sin((radians(40.4) - radians(x.lat)) / 2), 2)
  + cos(radians(x.lat)) * cos(radians(40.4)) * pow(sin((radians(-3.7) - radians(x.lon)) / 2), 2))), 1) AS m FROM {PARTS_SQL} x, (SELECT 40.4 AS lat, -3.7 AS lon) c
WHERE {km_sql("x", "c")} <= 120""",
)
def distances(spark, d):
    rows = homes(spark, d).filter(scope.radius("lat", "lon", (40.4, -3.7), 120))
    return rows.select("id", F.round(great_circle_km("lat", "lon", 40.4, -3.7), 4).alias("km"), F.round(haversine_m("lat", "lon", 40.4, -3.7), 1).alias("m"))


AREA_SQL = f"""(SELECT a.id, any_value(a.price / a.p_size) AS m2, count(b.id) AS n, quantile_cont(b.price / b.p_size, 0.5) AS median
  FROM {PARTS_SQL} a LEFT JOIN {PARTS_SQL} b ON a.p_type = b.p_type AND a.id <> b.id AND abs(a.lat - b.lat) < 0.7 AND {km_sql("a", "b")} <= 60 GROUP BY a.id)"""


@query(
    "area_price",
    f"""SELECT id, n::BIGINT AS n_comps, CASE WHEN n >= 5 THEN round(median, 6) END AS median_m2, CASE WHEN n >= 5 THEN round((m2 - median) / median * 100, 4) END AS pct_vs_average FROM {AREA_SQL}""",
)
def area_price(spark, d):
    return market.area_price(homes(spark, d), 60)


@query(
    "rent_estimate",
    f"""WITH c AS (SELECT a.id, count(*) AS n, quantile_cont(b.price, 0.25) AS p25, quantile_cont(b.price, 0.5) AS p50, quantile_cont(b.price, 0.75) AS p75
  FROM {PARTS_SQL} a JOIN {PARTS_SQL} b ON a.p_type = b.p_type AND a.id <> b.id AND b.p_size BETWEEN a.p_size * 0.65::DOUBLE AND a.p_size * 1.35::DOUBLE AND abs(a.lat - b.lat) < 0.7 AND {km_sql("a", "b")} <= 60 GROUP BY a.id)
SELECT id, n::BIGINT AS n, round(p25, 6) AS p25, round(p50, 6) AS p50, round(p75, 6) AS p75, CASE WHEN n >= 8 AND (p75 - p25) / p50 <= 0.6 THEN 'high'
  WHEN n >= 3 AND (n >= 8 OR (p75 - p25) / p50 <= 0.6) THEN 'low' ELSE 'insufficient' END AS confidence FROM c""",
)
def rent_estimate(spark, d):
    return market.rent_estimate(homes(spark, d), 60)


LIKE_SQL = f"""(SELECT id, basis, reference, 1 - m2 / reference AS below FROM (SELECT a.id, a.m2, CASE WHEN n_segment >= 3 THEN 'segment' WHEN n_pool >= 3 THEN 'pool' END AS basis,
  CASE WHEN n_segment >= 3 THEN segment WHEN n_pool >= 3 THEN pool END AS reference FROM (SELECT *, price / p_size AS m2 FROM {PARTS_SQL}) a
  JOIN (SELECT p_type, p_size // 10 AS decade, count(*) AS n_pool, quantile_cont(price / p_size, 0.5) AS pool FROM {PARTS_SQL} GROUP BY ALL) w ON w.p_type = a.p_type AND w.decade = a.p_size // 10
  LEFT JOIN (SELECT x.id, count(*) AS n_segment, quantile_cont(y.price / y.p_size, 0.5) AS segment FROM {PARTS_SQL} x JOIN {PARTS_SQL} y ON x.p_type = y.p_type AND x.p_size // 10 = y.p_size // 10
    AND x.ground = y.ground AND abs(x.rooms - y.rooms) <= 1 AND y.p_size BETWEEN x.p_size * 0.75::DOUBLE AND x.p_size * 1.25::DOUBLE GROUP BY x.id) s ON s.id = a.id))"""


def like_rows(spark, d):
    rows = homes(spark, d).withColumn("decade", F.floor(F.col("size") / 10))
    return market.like_for_like(rows, ("kind", "decade"))


@query("like_for_like", f"SELECT id, basis, round(reference, 6) AS reference, round(below, 6) AS below FROM {LIKE_SQL}")
def like_for_like(spark, d):
    return like_rows(spark, d)


@query(
    "effective_score",
    f"""SELECT id, round(coalesce(CASE WHEN p_size % 7 > 0 THEN (p_size % 7) / 10::DOUBLE END, -1) + least(greatest(coalesce(price / 2000 - 0.5, 0), 0), 0.5) * 0.5 + least(p_size % 5, 3) * 0.05
  + (rooms % 4) * 0.03::DOUBLE + CASE WHEN ground THEN 0.04 ELSE 0 END + least(p_size * 5 / 180::DOUBLE * 0.04 + (p_size % 11) / 50::DOUBLE / 0.2 * 0.07, 0.11), 6) AS effective FROM {PARTS_SQL}""",
)
def effective_score(spark, d):
    c = F.col
    score = F.when(c("p_size") % 7 > 0, c("p_size") % 7 / 10)
    made = feed.effective_score(score, c("price") / 2000 - 0.5, c("p_size") % 5, c("rooms") % 4, c("ground"), c("p_size") * 5, c("p_size") % 11 / 50)
    return parts(spark, d).select("id", F.round(made, 6).alias("effective"))


FEED_SQL = f"""WITH base AS (SELECT l_partkey, min(l_extendedprice / l_quantity) AS ask, min(l_shipdate) AS first_seen, count(*)::BIGINT AS n_listings FROM lineitem WHERE l_returnflag = 'N' GROUP BY l_partkey),
moved AS (SELECT l_partkey, greatest((previous - unit) / previous, 0) AS fall FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY {", ".join(c + " DESC" for c in LINE_ORDER)}) AS rn FROM (
  SELECT *, l_extendedprice / l_quantity AS unit, lag(l_extendedprice / l_quantity) OVER (PARTITION BY l_partkey ORDER BY {LINE_ORDER_SQL}) AS previous FROM lineitem)) WHERE rn = 1 AND previous > 0),
rows AS (SELECT p.id, p.rooms AS profile, n_listings, ask, first_seen, below, fall, p.p_size, p.ground, epoch(TIMESTAMP '1999-01-01') AS now FROM base JOIN {PARTS_SQL} p ON p.id = l_partkey
  LEFT JOIN {LIKE_SQL} k ON k.id = p.id LEFT JOIN moved m ON m.l_partkey = p.id),
scored AS (SELECT *, floor((now - epoch(first_seen)) / 86400) AS dom, first_seen > TIMESTAMP '1995-01-01' AS fresh FROM rows),
tiered AS (SELECT *, CASE WHEN fresh AND avg(fresh::INT) OVER (PARTITION BY profile) <= 0.6 THEN 1 ELSE 0 END AS tier,
  round((p_size % 7) / 10::DOUBLE + least(greatest(coalesce(round(below, 6), 0), 0), 0.5) * 0.5 + least(p_size % 5, 3) * 0.05::DOUBLE + CASE WHEN ground THEN 0.04 ELSE 0 END
    + least(dom / 180 * 0.04 + coalesce(fall, 0) / 0.2 * 0.07, 0.11), 8) AS score FROM scored)
SELECT profile, id, tier, score, n_listings, dom::BIGINT AS dom, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY tier DESC, score DESC, id DESC) AS rank FROM tiered) WHERE rank <= 50"""


@query("ranked_feed", FEED_SQL)
def ranked_feed(spark, d):
    """Per profile (rooms) the 50 best properties: cheapest active price, like-for-like discount, last price move, days on
    market, novelty before score."""
    line = table(spark, d, "lineitem")
    base = line.filter("l_returnflag = 'N'").groupBy("l_partkey").agg(F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("ask"), F.min("l_shipdate").alias("first_seen"), F.count("*").alias("n_listings"))
    moved = keyed.moves(line.withColumn("unit", F.col("l_extendedprice") / F.col("l_quantity")), ["l_partkey"], [F.col(c) for c in LINE_ORDER], "unit")
    last = keyed.latest_per_key(moved, ["l_partkey"], [F.col(c).desc() for c in LINE_ORDER]).filter("previous > 0")
    fall = last.select(F.col("l_partkey").alias("id"), F.greatest((F.col("previous") - F.col("unit")) / F.col("previous"), F.lit(0.0)).alias("fall"))
    rows = parts(spark, d).withColumn("decade", F.floor(F.col("p_size") / 10))
    below = market.like_for_like(rows.withColumnsRenamed({"p_type": "kind", "p_size": "size"}), ("kind", "decade")).select("id", "below")
    joined = rows.join(base, F.col("id") == F.col("l_partkey")).join(below, "id", "left").join(fall, "id", "left").withColumn("anchor", F.expr("TIMESTAMP_NTZ '1995-01-01 00:00:00'"))
    days = F.floor((F.unix_micros(F.lit("1999-01-01 00:00:00").cast("timestamp")) - F.unix_micros(F.col("first_seen").cast("timestamp"))) / 86_400_000_000)
    tiered = feed.novelty_tier(joined.withColumn("dom", days), "first_seen", "anchor", "rooms")
    score = feed.effective_score(F.col("p_size") % 7 / 10, F.col("below"), F.col("p_size") % 5, F.lit(0), F.col("ground"), F.col("dom"), F.col("fall"))
    scored = tiered.select(F.col("rooms").alias("profile"), "id", "tier", F.round(score, 8).alias("score"), "n_listings", "dom")
    ranked = scored.withColumn("rank", F.row_number().over(keyed.Window.partitionBy("profile").orderBy(F.desc("tier"), F.desc("score"), F.desc("id"))))
    return ranked.filter("rank <= 50")


ANCHORS_SQL = """(WITH e AS (SELECT user_id % 6 AS profile, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id % 6 ORDER BY ts) > INTERVAL 30 MINUTE, true) AS new FROM events),
v AS (SELECT profile, ts, row_number() OVER (PARTITION BY profile ORDER BY ts DESC) AS back FROM e WHERE new)
SELECT profile, coalesce(max(CASE WHEN profile > 0 THEN ts - to_years((26 + profile)::INT) END) FILTER (WHERE back = 2), TIMESTAMP '1994-12-31') AS anchor, coalesce(count(*) FILTER (WHERE back = 2 AND profile > 0) = 0, true) AS never FROM v GROUP BY profile)"""


@query(
    "composed_feed",
    f"""WITH l AS (SELECT l_partkey AS id, l_suppkey % 10 AS source, l_returnflag = 'N' AND l_linestatus = 'O' AS active, l_shipdate AS t, l_extendedprice / l_quantity AS unit, * FROM lineitem),
vis AS (SELECT id, count(*) FILTER (WHERE active) = 0 OR count(*) FILTER (WHERE active AND source NOT IN (3, 7)) > 0 AS visible, min(t) FILTER (WHERE source NOT IN (3, 7)) AS first_seen, bool_or(active AND source = 5) AS five FROM l GROUP BY id),
fb AS (SELECT user_id AS id, arg_max(event_type, {{'t': ts, 'e': event_id}}) AS kind FROM events WHERE event_type IN ('purchase', 'error') GROUP BY user_id),
base AS (SELECT p.id, p.rooms AS profile, p.p_size, p.ground, first_seen, round(below, 6) AS below FROM {PARTS_SQL} p LEFT JOIN vis ON vis.id = p.id LEFT JOIN {LIKE_SQL} k ON k.id = p.id LEFT JOIN fb ON fb.id = p.id
  WHERE p.p_size % 13 > 0 AND coalesce(visible, true) AND kind IS DISTINCT FROM 'error' AND (NOT ground OR coalesce(five, false)) AND (p.rooms <> 4 OR below >= 0)),
n AS (SELECT *, coalesce(first_seen > anchor, false) AS is_new FROM base JOIN {ANCHORS_SQL} a USING (profile)),
c AS (SELECT *, never OR avg(is_new::INT) OVER (PARTITION BY profile) > 0.6 AS cold_start FROM n),
m AS (SELECT id, t AS at, unit, previous FROM (SELECT *, lag(unit) OVER (PARTITION BY id ORDER BY {LINE_ORDER_SQL}) AS previous, row_number() OVER (PARTITION BY id ORDER BY {", ".join(x + " DESC" for x in LINE_ORDER)}) AS rn FROM l) WHERE rn = 1 AND previous > 0 AND unit <> previous),
s AS (SELECT c.*, CASE WHEN is_new AND NOT cold_start THEN 1 ELSE 0 END AS tier, CASE WHEN m.at > anchor THEN (unit - previous) / previous END AS change,
  round((p_size % 7) / 10::DOUBLE + least(greatest(coalesce(below, 0), 0), 0.5) * 0.5 + least(p_size % 5, 3) * 0.05::DOUBLE + CASE WHEN ground THEN 0.04 ELSE 0 END + least(greatest(coalesce((previous - unit) / previous, 0), 0) / 0.2 * 0.07, 0.11), 8) AS score FROM c LEFT JOIN m ON m.id = c.id)
SELECT profile, id, tier, score, round(change, 8) AS change, anchor, cold_start, row_number() OVER (PARTITION BY profile ORDER BY tier DESC, score DESC, id DESC)::INTEGER AS rank FROM s""",
)
def composed_feed(spark, d):
    """The whole feed: properties that match their profile (rooms) and are visible beside two disabled sources, filtered by
    feedback, source and discount, new ones first by each profile's own anchor (its visit before the last, long ago; profile
    0 was never there), with the last price move since then."""
    line = table(spark, d, "lineitem").withColumn("unit", F.col("l_extendedprice") / F.col("l_quantity"))
    listed = line.select(F.col("l_partkey").alias("id"), (F.col("l_suppkey") % 10).alias("source"), ((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O")).alias("active_sale"), F.col("l_shipdate").alias("first_seen"))
    pool = feed.visible_pool(listed, spark.createDataFrame([(3,), (7,)], "source long"))
    visits = table(spark, d, "events").select((F.col("user_id") % 6).alias("profile"), "ts")
    seen = queues.visit_anchor(visits, "profile", "ts", 30)
    previous = F.when(F.col("profile") > 0, F.expr("previous - make_interval(CAST(26 + profile AS INT))"))
    anchors = feed.profile_anchors(seen.select("profile", previous.alias("previous"), F.expr("TIMESTAMP_NTZ '1995-01-01 00:00:00'").alias("created")))
    verdict = table(spark, d, "events").filter("event_type IN ('purchase', 'error')").groupBy(F.col("user_id").alias("id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("kind"))
    feedback = verdict.select("id", F.when(F.col("kind") == "error", "reject").otherwise("accept").alias("feedback"))
    rows = parts(spark, d).withColumn("decade", F.floor(F.col("p_size") / 10))
    below = market.like_for_like(rows.withColumnsRenamed({"p_type": "kind", "p_size": "size"}), ("kind", "decade")).select("id", F.round("below", 6).alias("below"))
    base = rows.filter("p_size % 13 > 0").withColumnRenamed("rooms", "profile").join(pool, "id", "left").filter(F.coalesce("visible", F.lit(True))).join(below, "id", "left").join(feedback, "id", "left")
    base = base.filter((~F.col("ground") | feed_filters({"source": 5})) & feed_filters({}) & ((F.col("profile") != 4) | feed_filters({"least_below": 0.0})))
    ranked = feed.with_novelty(base, anchors)
    moved = keyed.latest_per_key(keyed.moves(line, ["l_partkey"], [F.col(c) for c in LINE_ORDER], "unit"), ["l_partkey"], [F.col(c).desc() for c in LINE_ORDER])
    moves = moved.filter("previous > 0 AND unit <> previous").select(F.col("l_partkey").alias("id"), F.col("l_shipdate").alias("at"), F.col("unit").alias("price"), "previous")
    fall = F.greatest((F.col("previous") - F.col("price")) / F.col("previous"), F.lit(0.0))
    scored = ranked.join(moves.select("id", fall.alias("fall")), "id", "left").join(feed.changes_since(moves, ranked), ["profile", "id"], "left")
    score = feed.effective_score(F.col("p_size") % 7 / 10, F.col("below"), F.col("p_size") % 5, F.lit(0), F.col("ground"), F.lit(0), F.col("fall"))
    out = scored.select("profile", "id", "tier", F.round(score, 8).alias("score"), F.round("change", 8).alias("change"), "anchor", "cold_start")
    return keyed.numbered_within(out, "profile", (F.desc("tier"), F.desc("score"), F.desc("id")), "rank")


PLACES_SQL = """(SELECT n_nationkey AS place, 36 + (n_nationkey * 7919 % 70) / 10::DOUBLE AS lat, -9 + (n_nationkey * 104729 % 120) / 10::DOUBLE AS lon, (n_nationkey * 7919 % 90) * 1000 AS pop FROM nation)"""
CUSTOMER_SQL = "(SELECT c_custkey, 36 + (c_custkey * 7919 % 70000) / 10000::DOUBLE AS lat, -9 + (c_custkey * 104729 % 120000) / 10000::DOUBLE AS lon FROM customer)"


def places(spark, d):
    n = F.col("n_nationkey").cast("long")
    return table(spark, d, "nation").select(n.alias("place"), (36 + n * 7919 % 70 / 10.0).alias("lat"), (-9 + n * 104729 % 120 / 10.0).alias("lon"), (n * 7919 % 90 * 1000).alias("pop"))


def located_customers(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", (36 + k * 7919 % 70000 / 10000.0).alias("lat"), (-9 + k * 104729 % 120000 / 10000.0).alias("lon"))


@query(
    "nearest_place",
    f"""SELECT c_custkey, arg_min(place, {{'a': round(km - 0.5 * ln(1 + pop), 6), 'b': place}})::BIGINT AS place FROM (SELECT c.c_custkey, p.place, p.pop, {km_sql("c", "p")} AS km FROM {CUSTOMER_SQL} c, {PLACES_SQL} p)
WHERE km <= 140 GROUP BY c_custkey""",
)
def nearest_place(spark, d):
    """Bound first, then rank by distance less a bonus for population."""
    pairs = within_km_join(located_customers(spark, d), places(spark, d), 140, max_lat=45)
    rank = F.round(great_circle_km("l.lat", "l.lon", "r.lat", "r.lon") - 0.5 * F.log1p(F.col("r.pop")), 6)
    return pairs.groupBy("l.c_custkey").agg(F.min_by("r.place", F.struct(rank, F.col("r.place"))).alias("place"))


@query(
    "coverage_point",
    f"SELECT place, count(*) FILTER (WHERE {km_sql('c', 'p')} <= coalesce(pop / 1000, 0))::BIGINT AS covered FROM {PLACES_SQL} p, {CUSTOMER_SQL} c GROUP BY place",
)
def coverage_point(spark, d):
    """Customers within each place's own radius, on grids of doubling cells."""
    p = places(spark, d)
    pairs = within_own_km_join(p.withColumn("km", F.coalesce(F.col("pop") / 1000, F.lit(0.0))), located_customers(spark, d), "km", base=8.0, max_lat=45)
    return p.select("place").join(pairs.groupBy("l.place").agg(F.count("*").alias("n")), "place", "left").select("place", F.coalesce("n", F.lit(0)).alias("covered"))


FAR_PLACES_SQL = f"(SELECT place, CASE WHEN place % 5 = 0 THEN lat + 14 ELSE lat END AS lat, lon FROM {PLACES_SQL})"


@query(
    "nearest_fallback",
    f"""SELECT place, arg_min(id, {{'a': round(km, 6), 'b': id}}) AS id, min(round(km, 6)) AS km FROM (SELECT p.place, x.id, {km_sql("p", "x")} AS km FROM {FAR_PLACES_SQL} p, {PARTS_SQL} x) GROUP BY place""",
)
def nearest_fallback(spark, d):
    """Nearest property of each place; a fifth of the places lie far from all, so that the wider searches are needed."""
    far = places(spark, d).withColumn("lat", F.when(F.col("place") % 5 == 0, F.col("lat") + 14).otherwise(F.col("lat")))
    return nearest(far, parts(spark, d), "place", "id")


@query("polyline_round_trip")
def polyline_round_trip(spark, d):
    """Circle polygons encoded and decoded again; ``worst`` is the largest error in degrees."""
    rows = places(spark, d).select("place", circle_polygon("lat", "lon", F.lit(25.0)).alias("ring"))
    rows = rows.withColumn("line", polyline_encode("ring")).withColumn("back", polyline_decode("line"))
    worst = F.array_max(F.zip_with("ring", "back", lambda a, b: F.greatest(F.abs(a["lat"] - b["lat"]), F.abs(a["lon"] - b["lon"]))))
    return rows.select("place", "line", F.round(worst, 7).alias("worst"))


@query(
    "box_prefilter",
    f"SELECT count(*)::BIGINT AS n FROM {PARTS_SQL} x WHERE lat BETWEEN 40.4 - 50 / 111.0::DOUBLE * 1.15 AND 40.4 + 50 / 111.0::DOUBLE * 1.15 AND lon BETWEEN -3.7 - 50 / (111.320 * cos(radians(40.4))) * 1.15 AND -3.7 + 50 / (111.320 * cos(radians(40.4))) * 1.15",
)
def box_prefilter(spark, d):
    return parts(spark, d).filter(in_box("lat", "lon", 40.4, -3.7, 50)).agg(F.count("*").alias("n"))


PROVINCES = ("Málaga", "MADRID ", "Las Palmas", "barcelona", "València/Valencia", "Bizkaia", "nowhere", None, "Sevilla")
#: Transfer tax of PROVINCES in percent.
PROVINCE_TAX = (7, 6, 6.5, 10, 9, 4, 8, 8, 7)


@query(
    "yield_flip",
    f"""WITH b AS (SELECT id, price * 100 AS price, CASE WHEN id % 17 > 0 THEN price * 0.5 END AS rent, p_size AS m2, {list(PROVINCE_TAX)}[id % 9 + 1]::DOUBLE AS tax, CASE WHEN id % 3 = 0 THEN 400.0 END AS ibi, CASE WHEN id % 4 = 0 THEN 100 * (id % 50) END AS fee, id % 5 AS c FROM {PARTS_SQL}),
k AS (SELECT *, CASE WHEN fee <= 2000 THEN fee END AS f, price * tax / 100 + price * 0.003 + price * 0.002 + 300 AS costs, CASE c WHEN 0 THEN 400 * m2 WHEN 1 THEN 900 * m2 WHEN 2 THEN 650 * m2 WHEN 3 THEN 0 END AS works FROM b),
n AS (SELECT *, rent * 12 - CASE WHEN ibi IS NULL AND f IS NULL THEN 0.25 * rent * 12 ELSE coalesce(ibi, 0) + coalesce(f, 0) * 12 + 0.08 * rent * 12 END AS net FROM k)
SELECT id, round(rent * 1200 / price, 6) AS gross, round(net / price * 100, 6) AS net, round((net - price * 0.8 * 0.0025 / (1 - pow(1.0025, -300)) * 12) / (price * 0.2 + costs) * 100, 6) AS cash_on_cash, CASE WHEN rent IS NOT NULL THEN round(costs, 4) END AS costs, works::DOUBLE AS works,
  round(price * 1.4 - price - works - price * 0.1, 4) AS margin, round((price * 1.4 - price - works - price * 0.1) / (price * 1.1 + works), 8) AS margin_share FROM n""",
)
def yield_flip(spark, d):
    """Parts as homes in provinces of several regions, some with a published tax or fee."""
    k = F.col("id")
    rows = parts(spark, d).select("id", (F.col("price") * 100).alias("price"), F.col("p_size").alias("m2"), F.when(k % 17 > 0, F.col("price") * 0.5).alias("rent"))
    province = F.element_at(F.array(*map(F.lit, PROVINCES)), (k % 9 + 1).cast("int"))
    found = finance.yields(F.col("price"), F.col("rent"), province, F.when(k % 3 == 0, 400.0), F.when(k % 4 == 0, 100.0 * (k % 50)))
    condition = F.when(k % 5 < 3, "a_reformar").when(k % 5 == 3, "reformado").otherwise("unclear")
    repair = finance.works(F.col("m2"), condition, F.when(k % 5 == 0, "leve").when(k % 5 == 1, "integral"))
    margin, share = finance.flip(F.col("price") * 1.4, F.col("price"), repair)
    return rows.select("id", *(F.round(found[n], 4 if n == "costs" else 6).alias(n) for n in found), repair.alias("works"), F.round(margin, 4).alias("margin"), F.round(share, 8).alias("margin_share"))


@query(
    "investment_metrics",
    f"""WITH a AS (SELECT id, n, CASE WHEN n >= 5 THEN round(median, 6) END AS median FROM {AREA_SQL}),
c AS (SELECT a.id, count(*) AS n, quantile_cont(b.price, 0.25) AS p25, quantile_cont(b.price, 0.5) AS p50, quantile_cont(b.price, 0.75) AS p75
  FROM {PARTS_SQL} a JOIN {PARTS_SQL} b ON a.p_type = b.p_type AND a.id <> b.id AND b.p_size BETWEEN a.p_size * 0.65::DOUBLE AND a.p_size * 1.35::DOUBLE AND abs(a.lat - b.lat) < 0.7 AND {km_sql("a", "b")} <= 60 GROUP BY a.id),
x AS (SELECT p.id, p.price, p.p_size AS m2, a.median, a.n AS sample, round(p50, 6) AS p50, coalesce(c.n >= 3 AND (c.n >= 8 OR (p75 - p25) / p50 <= 0.6), false) AS usable, coalesce(c.n >= 8 AND (p75 - p25) / p50 <= 0.6, false) AS sure,
  CASE WHEN p.id % 6 = 0 THEN 12 * p.p_size END AS assumed FROM {PARTS_SQL} p LEFT JOIN a ON a.id = p.id LEFT JOIN c ON c.id = p.id WHERE p.p_size > 0)
SELECT id, round(coalesce(assumed, CASE WHEN usable THEN p50 END), 6) AS rent, CASE WHEN assumed IS NOT NULL THEN 'profile_assumption' WHEN NOT usable THEN 'insufficient_data' WHEN sure THEN 'market_comparable_high' ELSE 'market_comparable_low' END AS method,
  round(CASE WHEN usable THEN (assumed - p50) / p50 END, 6) AS disagreement, round(coalesce(assumed, CASE WHEN usable THEN p50 END) * 1200 / price, 6) AS gross, round(median * m2, 4) AS arv, CASE WHEN median IS NOT NULL THEN CASE WHEN sample >= 15 THEN 'high' ELSE 'low' END END AS arv_confidence,
  round(median * m2 - price - 650 * m2 - price * 0.1::DOUBLE, 1) AS margin FROM x""",
)
def investment_metrics(spark, d):
    """Area price, rent estimate (a sixth with a profile's assumption), yield, resale value and flip margin of every part."""
    rows = homes(spark, d).filter("size > 0")
    area = market.area_price(rows, 60).select("id", "n_comps", "median_m2")
    rent = market.rent_estimate(rows, 60).select("id", "p50", "confidence")
    x = rows.join(area, "id", "left").join(rent, "id", "left")
    monthly, method, disagreement = market.rent_decision(F.col("size"), F.lit(True), F.when(F.col("id") % 6 == 0, 12.0), F.col("p50"), F.col("confidence"))
    value, sure = finance.resale(F.col("median_m2"), F.col("size"), F.col("n_comps"))
    margin, _ = finance.flip(value, F.col("price"), finance.works(F.col("size"), F.lit("a_reformar"), F.lit(None).cast("string")))
    gross = finance.yields(F.col("price"), monthly, F.lit(None).cast("string"))["gross"]
    return x.select("id", F.round(monthly, 6).alias("rent"), method.alias("method"), F.round(disagreement, 6).alias("disagreement"), F.round(gross, 6).alias("gross"), F.round(value, 4).alias("arv"), sure.alias("arv_confidence"), F.round(margin, 1).alias("margin"))


@query(
    "cheapest_rent",
    f"""WITH l AS (SELECT *, l_orderkey * 10 + l_linenumber AS id, l_extendedprice / l_quantity AS price FROM lineitem WHERE l_returnflag <> 'R' AND l_linestatus = 'O' AND l_linenumber % 7 > 0 AND l_shipdate >= TIMESTAMP '1998-06-01' - INTERVAL 400 DAY)
SELECT l_partkey, min(price) AS price, arg_min(l_shipdate, {{'a': price, 'b': -epoch_us(l_shipdate), 'c': id}}) AS last_seen FROM l GROUP BY l_partkey""",
)
def cheapest_rent(spark, d):
    """The cheapest fresh rental of each part; lines of every seventh number have no price."""
    rows = table(spark, d, "lineitem").select(
        "l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.when(F.col("l_linenumber") % 7 > 0, F.col("l_extendedprice") / F.col("l_quantity")).otherwise(0.0).alias("price"),
        F.when(F.col("l_returnflag") == "R", "withdrawn").otherwise("active").alias("status"), F.when(F.col("l_linestatus") == "O", "rent").otherwise("sale").alias("operation"), F.col("l_shipdate").alias("last_seen"),
    )
    return market.cheapest_fresh(rows, "l_partkey", F.expr("TIMESTAMP_NTZ '1998-06-01 00:00:00'"), 400)

