"""Queues, digests, diagnoses and reviews over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessaria.operators import keyed, linkage, market, queues, scope
from tessaria.plans.registry import AS_OF, LINE_ORDER, LINE_ORDER_SQL, PARTS_SQL, parts, query
from tessaria.session import table

KINDS = ("purchase", "click", "view")


@query(
    "missing_verdicts",
    f"""WITH w AS (SELECT user_id, unnest(['purchase', 'click', 'view']) AS event_type FROM (SELECT DISTINCT user_id FROM events)),
d AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 80), f AS (SELECT user_id, event_type FROM events WHERE value < 15 AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY GROUP BY ALL HAVING count(*) >= 3)
SELECT user_id, event_type FROM w WHERE (user_id, event_type) NOT IN (SELECT user_id, event_type FROM d) AND (user_id, event_type) NOT IN (SELECT user_id, event_type FROM f)""",
)
def missing_verdicts(spark, d):
    e = table(spark, d, "events")
    return queues.missing_work(e.select("user_id").distinct(), KINDS, e.filter("value > 80"), e.filter("value < 15"), "user_id", "event_type", "ts", AS_OF)


@query(
    "queue_claim",
    "SELECT event_id, coalesce(user_id % 3, 0) + 1 AS attempts, CASE WHEN user_id % 3 + 1 >= 3 THEN 'unreachable' ELSE 'processing' END AS status FROM (SELECT * FROM events WHERE event_type = 'view' ORDER BY ts, event_id LIMIT 40)",
)
def queue_claim(spark, d):
    q = table(spark, d, "events").select("event_id", "ts", (F.col("user_id") % 3).alias("attempts"), F.when(F.col("event_type") == "view", "pending").otherwise("done").alias("status"))
    return queues.claim(q, "status", [F.col("ts"), F.col("event_id")], 40, "attempts", 3).drop("ts")


@query(
    "retention_purge",
    f"SELECT event_id FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY OR user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
)
def retention_purge(spark, d):
    active = table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    return queues.retained(table(spark, d, "events"), "ts", 10, AS_OF, active, "user_id").select("event_id")


@query("zombie_runs", f"SELECT event_id, CASE WHEN event_type = 'click' AND ts < TIMESTAMP '{AS_OF}' - INTERVAL 6 HOUR THEN 'failed' WHEN event_type = 'click' THEN 'running' ELSE 'done' END AS status FROM events")
def zombie_runs(spark, d):
    runs = table(spark, d, "events").select("event_id", "ts", F.when(F.col("event_type") == "click", "running").otherwise("done").alias("status"))
    return queues.reconcile_running(runs, "status", "ts", 6, AS_OF).drop("ts")


@query(
    "visit_anchor",
    """WITH s AS (SELECT user_id, ts FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events) WHERE p IS NULL OR epoch_us(ts) - epoch_us(p) > 1800000000)
SELECT user_id, max(ts) AS current, list_sort(list(ts), 'DESC')[2] AS previous FROM s GROUP BY user_id""",
)
def visit_anchor(spark, d):
    return queues.visit_anchor(table(spark, d, "events"), "user_id", "ts", 30)


@query(
    "scope_union",
    f"SELECT round(lat, 4) AS lat, round(lon, 4) AS lon, max(radius)::BIGINT AS radius FROM (SELECT lat, lon, p_size AS radius FROM {PARTS_SQL} UNION ALL SELECT lat + 0.00001, lon, p_size * 2 FROM {PARTS_SQL} WHERE id % 3 = 0) GROUP BY ALL",
)
def scope_union(spark, d):
    p = parts(spark, d).select("lat", "lon", F.col("p_size").cast("long").alias("radius"), "id")
    more = p.filter("id % 3 = 0").select((F.col("lat") + 0.00001).alias("lat"), "lon", (F.col("radius") * 2).alias("radius"))
    return queues.rounded_scopes(p.drop("id").union(more), "lat", "lon")


@query(
    "sole_culprit",
    f"""WITH m AS (SELECT (p_size NOT BETWEEN 5 AND 45)::INT AS size, (price NOT BETWEEN 950 AND 1800)::INT AS price, (coalesce(nullif(p_size % 7, 0), 3) = 3)::INT AS floor FROM {PARTS_SQL})
SELECT sum((size = 1 AND size + price + floor = 1)::INT)::BIGINT AS size, sum((price = 1 AND size + price + floor = 1)::INT)::BIGINT AS price, sum((floor = 1 AND size + price + floor = 1)::INT)::BIGINT AS floor FROM m""",
)
def sole_culprit(spark, d):
    floor = F.nullif(F.col("p_size") % 7, F.lit(0))
    return scope.sole_culprit(parts(spark, d), {"size": F.col("p_size").between(5, 45), "price": F.col("price").between(950, 1800), "floor": floor != 3})


@query(
    "digest",
    f"""WITH new AS (SELECT 'new' AS kind, o_custkey AS id, count(*)::BIGINT AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY o_custkey),
drops AS (SELECT 'drop', l_partkey, count(*)::BIGINT FROM (SELECT l_partkey, l_shipdate, l_extendedprice / l_quantity AS unit, lag(l_extendedprice / l_quantity) OVER (PARTITION BY l_partkey, l_suppkey ORDER BY {LINE_ORDER_SQL}) AS previous FROM lineitem)
  WHERE (previous - unit) / previous BETWEEN 0.01 AND 0.60 AND l_shipdate >= TIMESTAMP '1998-01-01' GROUP BY l_partkey),
changes AS (SELECT 'status', o_custkey, count(*)::BIGINT FROM (SELECT o_custkey, o_orderdate, o_orderstatus, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS was FROM orders) WHERE was <> o_orderstatus AND o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY o_custkey)
SELECT * FROM new UNION ALL SELECT * FROM drops UNION ALL SELECT * FROM changes""",
)
def digest(spark, d):
    """New orders, price drops and status changes since the last digest."""
    since = F.expr("TIMESTAMP_NTZ '1998-01-01 00:00:00'")
    orders, line = table(spark, d, "orders"), table(spark, d, "lineitem").withColumn("unit", F.col("l_extendedprice") / F.col("l_quantity"))
    new = orders.filter(F.col("o_orderdate") >= since).groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"))
    drops = market.price_drops(keyed.moves(line, ["l_partkey", "l_suppkey"], [F.col(c) for c in LINE_ORDER], "unit"), "unit")
    drops = drops.filter(F.col("l_shipdate") >= since).groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("n"))
    changes = keyed.moves(orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], "o_orderstatus").filter((F.col("previous") != F.col("o_orderstatus")) & (F.col("o_orderdate") >= since))
    changes = changes.groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"))
    named = [df.select(F.lit(kind).alias("kind"), "id", "n") for kind, df in (("new", new), ("drop", drops), ("status", changes))]
    return named[0].unionByName(named[1]).unionByName(named[2])


RATES = {"view": (3.0, 15.0), "click": (1.0, 5.0)}


@query(
    "usage_cost",
    "SELECT ts::DATE AS day, round(sum((value * 100 * CASE event_type WHEN 'view' THEN 3 WHEN 'click' THEN 1 ELSE 0 END + value * 10 * CASE event_type WHEN 'view' THEN 15 WHEN 'click' THEN 5 ELSE 0 END) / 1000000), 6) AS cost FROM events GROUP BY 1",
)
def usage_cost(spark, d):
    u = table(spark, d, "events").withColumns({"tin": F.col("value") * 100, "tout": F.col("value") * 10, "day": F.to_date("ts")})
    return u.groupBy("day").agg(F.round(F.sum(queues.cost(u, "event_type", "tin", "tout", RATES)), 6).alias("cost"))


SUGGESTED_SQL = "(SELECT user_id % 20 AS lo, 20 + user_id % 7 AS hi, event_type AS basis, round(value / 100, 3) AS confidence FROM events)"


def suggestions(spark, d):
    """Confidences rounded as the SQL twin does: scaled first, so a half that the division left a bit short (74.85 / 100) goes up."""
    return table(spark, d, "events").select((F.col("user_id") % 20).alias("lo"), (20 + F.col("user_id") % 7).alias("hi"), F.col("event_type").alias("basis"), (F.round(F.col("value") / 100 * 1000) / 1000).alias("confidence"))


@query("review_groups", f"SELECT lo, hi, count(*)::BIGINT AS n, arg_min(basis, {{'c': -confidence, 'b': basis}}) AS top, max(confidence) AS confidence, string_agg(basis, ',' ORDER BY confidence DESC, basis) AS evidence FROM {SUGGESTED_SQL} GROUP BY lo, hi")
def review_groups(spark, d):
    return queues.review_groups(suggestions(spark, d), "lo", "hi", "basis", "confidence")


@query("basis_sets", f"SELECT basis, count(*)::BIGINT AS groups FROM (SELECT DISTINCT lo, hi, basis FROM {SUGGESTED_SQL}) GROUP BY basis")
def basis_sets(spark, d):
    return queues.basis_sets(suggestions(spark, d), ["lo", "hi"], "basis")


@query(
    "reconcile_states",
    """WITH s AS (SELECT c_custkey % 5 AS profile_id, c_custkey AS pid, c_custkey // 3 * 3 AS survivor, ['rejected', 'new', 'visited', 'offer'][c_custkey % 4 + 1] AS stage, c_custkey % 4 AS rank, c_acctbal > 0 AS matched FROM customer)
SELECT profile_id, survivor AS property_id, arg_max(stage, rank) AS stage, bool_or(matched) AS matched, bool_or(stage = 'rejected') AND bool_or(rank > 1) AS conflict FROM s GROUP BY profile_id, survivor""",
)
def reconcile_states(spark, d):
    k = F.col("c_custkey")
    stages = F.array(*map(F.lit, ("rejected", "new", "visited", "offer")))
    c = table(spark, d, "customer")
    states = c.select((k % 5).alias("profile_id"), k.alias("property_id"), stages[(k % 4).cast("int")].alias("stage"), (F.col("c_acctbal") > 0).alias("matched"))
    return linkage.reconcile_states(states, c.select(k.alias("property_id"), (F.floor(k / 3) * 3).alias("survivor")), {"rejected": 0, "new": 1, "visited": 2, "offer": 3})


@query(
    "captures_per_portal",
    r"""SELECT regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^.*?([^.]+\.[^.]+\.[^.]+)$', '\1') AS portal, count(*)::BIGINT AS n, count(DISTINCT url)::BIGINT AS urls FROM pages GROUP BY 1""",
)
def captures_per_portal(spark, d):
    host = F.lower(F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1))
    portal = F.regexp_replace(host, r"^.*?([^.]+\.[^.]+\.[^.]+)$", "$1").alias("portal")
    return table(spark, d, "pages").groupBy(portal).agg(F.count("*").alias("n"), F.count_distinct("url").alias("urls"))


@query("sync_watermarks", "SELECT 'orders' AS name, max(o_orderdate) AS mark FROM orders UNION ALL SELECT 'lineitem', max(l_shipdate) FROM lineitem UNION ALL SELECT 'events', max(ts) FROM events")
def sync_watermarks(spark, d):
    marks = [table(spark, d, t).agg(F.max(c).alias("mark")).select(F.lit(t).alias("name"), "mark") for t, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts"))]
    return marks[0].union(marks[1]).union(marks[2])


@query(
    "last_run_list",
    "SELECT n_name, n, last, status FROM nation JOIN (SELECT c_nationkey, count(*)::BIGINT AS n, max(o_orderdate) AS last, arg_max(o_orderstatus, {'a': o_orderdate, 'b': o_orderkey}) AS status FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey) ON c_nationkey = n_nationkey",
)
def last_run_list(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    per = o.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last"), keyed.latest_value("o_orderstatus", "o_orderdate", "o_orderkey").alias("status"))
    return table(spark, d, "nation").join(per, F.col("n_nationkey") == F.col("c_nationkey")).select("n_name", "n", "last", "status")


@query(
    "price_timeline",
    f"SELECT l_partkey, min(l_extendedprice / l_quantity) AS low, max(l_extendedprice / l_quantity) AS high, last(l_extendedprice / l_quantity ORDER BY {LINE_ORDER_SQL}) AS now, count(*)::BIGINT AS n FROM lineitem GROUP BY l_partkey",
)
def price_timeline(spark, d):
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.min(unit).alias("low"), F.max(unit).alias("high"), F.max_by(unit, F.struct(*LINE_ORDER)).alias("now"), F.count("*").alias("n"))


MERGED_SQL = """WITH st AS (SELECT c_custkey % 3 AS profile_id, c_custkey // 3 AS property_id, ['new', 'reviewing', 'interested', 'contacted', 'visited', 'offer_made', 'closed', 'rejected'][c_custkey * 7 // 3 % 8 + 1] AS stage,
  c_acctbal > 0 AS matched, CASE WHEN c_custkey % 5 > 0 THEN round(c_acctbal / 10000, 3) END AS score FROM customer WHERE c_custkey % 7 > 0),
r AS (SELECT * FROM (VALUES ('new', 0), ('reviewing', 1), ('interested', 2), ('contacted', 3), ('visited', 4), ('offer_made', 5), ('closed', 6), ('rejected', 6)) r(stage, rank)),
x AS (SELECT l.profile_id, l.property_id AS losing, l.property_id - 1 AS survivor, l.stage AS ls, l.matched AS lm, l.score AS lsc, s.property_id IS NOT NULL AS there, s.stage AS ss, s.matched AS sm, s.score AS ssc, a.rank AS lr, b.rank AS sr
  FROM st l LEFT JOIN st s ON s.profile_id = l.profile_id AND s.property_id = l.property_id - 1 LEFT JOIN r a ON a.stage = l.stage LEFT JOIN r b ON b.stage = s.stage WHERE l.property_id % 4 = 1),
k AS (SELECT *, CASE WHEN NOT there THEN 'rekeyed_no_prior_survivor_state' WHEN ls = ss THEN 'identical_stage_dropped' WHEN (ls = 'rejected' AND ss <> 'new') OR (ss = 'rejected' AND ls <> 'new') THEN 'conflict_dropped' ELSE 'stage_reconciled' END AS kind FROM x)"""


def _merged(spark, d):
    k = F.col("c_custkey")
    stages = F.array(*map(F.lit, linkage.STAGE_RANK))
    c = table(spark, d, "customer").filter("c_custkey % 7 > 0")
    score = F.when(k % 5 > 0, F.round(F.col("c_acctbal") / 10000, 3))
    states = c.select((k % 3).alias("profile_id"), F.floor(k / 3).alias("property_id"), stages[(F.floor(k * 7 / 3) % 8).cast("int")].alias("stage"), (F.col("c_acctbal") > 0).alias("matched"), score.alias("score"))
    losing = states.select(F.col("property_id").alias("losing")).filter("losing % 4 = 1").distinct()
    return states, linkage.merge_states(states, losing.withColumn("survivor", F.col("losing") - 1))


@query(
    "merged_states",
    f"""{MERGED_SQL} SELECT profile_id, survivor AS property_id, CASE WHEN NOT there THEN ls WHEN kind = 'stage_reconciled' AND lr > sr THEN ls ELSE ss END AS stage, coalesce(lm, false) OR coalesce(sm, false) AS matched, CASE WHEN NOT there THEN lsc END AS score FROM k
UNION ALL SELECT profile_id, property_id, stage, matched, score FROM st WHERE property_id % 4 <> 1 AND NOT EXISTS (FROM k WHERE k.profile_id = st.profile_id AND k.survivor = st.property_id)""",
)
def merged_states(spark, d):
    """Every fourth property loses to the one before it: states of three profiles folded, scores of folded ones to be made anew."""
    return _merged(spark, d)[1][0]


@query("merge_log", f"{MERGED_SQL} SELECT profile_id, survivor, losing, kind, ls AS l_stage, lm AS l_matched, lsc AS l_score, ss AS s_stage, sm AS s_matched, ssc AS s_score FROM k")
def merge_log(spark, d):
    """What each merge did to each profile's state, with both rows as they were."""
    return _merged(spark, d)[1][1]


@query("merges_reverted", f"{MERGED_SQL} SELECT profile_id, property_id, stage, matched, score FROM st")
def merges_reverted(spark, d):
    """All merges taken back from their log: the states that were there before."""
    _, (after, log) = _merged(spark, d)
    return linkage.unmerge_states(after, log)


@query(
    "diagnostics",
    """WITH p AS (SELECT page_id, url, strlen(html)::BIGINT AS html_bytes, len(regexp_extract_all(html, '<a ')) AS links, row_number() OVER (ORDER BY page_id DESC) AS rn FROM pages), t AS (SELECT count(*) AS total, coalesce(sum(html_bytes), 0) AS total_bytes FROM p)
SELECT page_id, url, html_bytes, links::INTEGER AS links, total::BIGINT AS total, total_bytes::BIGINT AS total_bytes FROM p, t WHERE rn <= 50""",
)
def diagnostics(spark, d):
    """The newest fifty stored pages (a list's limit), beside count and bytes of all (one row)."""
    p = table(spark, d, "pages").select("page_id", "url", F.octet_length("html").cast("long").alias("html_bytes"), F.size(F.regexp_extract_all("html", F.lit("<a "), F.lit(0))).alias("links"))
    totals = p.agg(F.count("*").alias("total"), F.coalesce(F.sum("html_bytes"), F.lit(0)).alias("total_bytes"))
    return p.orderBy(F.desc("page_id")).limit(50).join(F.broadcast(totals))
