"""Selection, preview and roll-up queries over parts as properties, events as tasks and usage, pages as searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessaria.operators import health, ingest, keyed, linkage, scope, scoring, selection
from tessaria.plans.registry import AS_OF, PARTS_SQL, km_sql, parts, query
from tessaria.session import table

def now():
    return F.expr(f"TIMESTAMP_NTZ '{AS_OF}'")

STATES = ("vacant", "tenanted", "occupied_illegally", None)
GRADES = ("frontline", "sea_view", "near_beach", "none", None)
#: Option sets of the filter query, each with the SQL of what it keeps.
FILTERS = (
    ({}, "feedback IS DISTINCT FROM 'reject'"),
    ({"show_rejected": True}, "true"),
    ({"source": "s1"}, "k % 3 = 1 AND feedback IS DISTINCT FROM 'reject'"),
    ({"occupancy": "occupied", "show_rejected": True}, "k % 4 IN (1, 2)"),
    ({"occupancy": "free", "condition": "reformado", "show_rejected": True}, "k % 4 = 0 AND k % 2 = 1"),
    ({"least_below": 0.1, "show_rejected": True}, "k % 7 > 0 AND k % 10 >= 1"),
    ({"caveat": "okupa", "show_rejected": True}, "k % 5 = 1"),
    ({"flag": "deuda", "show_rejected": True}, "k % 6 = 2"),
    ({"beach": "sea_view", "show_rejected": True}, "k % 5 IN (0, 1)"),
    ({"beach": "near_beach", "heritage": True, "show_rejected": True}, "k % 5 IN (0, 1, 2) AND k % 8 = 1"),
    ({"vpo": False, "show_rejected": True}, "k % 9 = 1"),
    ({"alerts": True, "show_rejected": True}, "k % 5 = 1 OR k % 6 = 2"),
    ({"alerts": False, "show_rejected": True}, "k % 5 > 1 AND k % 6 > 2"),
    ({"feedback": "accept"}, "feedback = 'accept'"),
    ({"only_new": True, "show_rejected": True}, "k % 11 = 1"),
    ({"severity": "integral", "show_rejected": True}, "k % 3 = 2"),
)


@query(
    "feed_filters",
    "WITH x AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 1 THEN 'reject' WHEN 2 THEN 'accept' END AS feedback FROM part) "
    + " UNION ALL ".join(f"SELECT {i} AS filter, count(*)::BIGINT AS n, coalesce(sum(k), 0)::BIGINT AS keys FROM x WHERE {w}" for i, (_, w) in enumerate(FILTERS)),
)
def feed_filters(spark, d):
    """How many parts, and which, pass each set of filters; signals of some parts were never assessed. One pass."""
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(
        k.alias("id"), F.array(F.concat(F.lit("s"), (k % 3).cast("string"))).alias("sources"), F.element_at(F.array(*map(F.lit, STATES)), (k % 4 + 1).cast("int")).alias("occupancy"),
        F.when(k % 2 == 1, "reformado").otherwise("a_reformar").alias("condition"), F.when(k % 3 == 2, "integral").alias("severity"), F.when(k % 7 > 0, (k % 10) / 10).alias("below"),
        F.when(k % 4 == 1, "reject").when(k % 4 == 2, "accept").alias("feedback"), F.when(k % 5 > 0, F.when(k % 5 == 1, F.array(F.lit("okupa"))).otherwise(F.array(F.lit("info")))).alias("caveats"),
        F.when(k % 6 > 1, F.when(k % 6 == 2, F.array(F.lit("deuda"))).otherwise(F.array().cast("array<string>"))).alias("flags"), F.element_at(F.array(*map(F.lit, GRADES)), (k % 5 + 1).cast("int")).alias("beach"),
        F.when(k % 8 < 2, k % 8 == 1).alias("heritage"), F.when(k % 9 < 2, k % 9 == 0).alias("vpo"), (k % 11 == 1).alias("is_new"), F.lit(None).cast("timestamp").alias("first_seen"),
    )
    tests = [selection.feed_filters(o, warn=("okupa",)) for o, _ in FILTERS]
    hits = rows.select("id", F.explode(F.array(*(F.when(t, i) for i, t in enumerate(tests)))).alias("filter")).filter("filter IS NOT NULL")
    found = hits.groupBy("filter").agg(F.count("*").alias("n"), F.sum("id").alias("keys"))
    every = spark.range(len(FILTERS)).select(F.col("id").cast("int").alias("filter"))
    return every.join(found, "filter", "left").select("filter", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("keys", F.lit(0)).alias("keys"))


@query(
    "recapture_cohort",
    f"""WITH x AS (SELECT page_id AS id, url, CASE WHEN page_id % 7 > 0 THEN page_id % 5 END AS photos, CASE WHEN page_id % 6 > 0 THEN TIMESTAMP '{AS_OF}' - (page_id % 40) * INTERVAL 1 DAY END AS fetched, CASE WHEN page_id % 4 > 0 THEN page_id % 9 END AS best FROM pages WHERE page_id % 11 > 0 AND page_id % 13 > 0)
SELECT kind, id, url, photo_count, best_score, row_number() OVER (PARTITION BY kind ORDER BY best_score DESC NULLS LAST, photo_count, id DESC)::INTEGER AS place FROM (
SELECT 'few_photos' AS kind, id, url, coalesce(photos, 0)::INTEGER AS photo_count, best AS best_score FROM x WHERE coalesce(photos, 0) < 3
UNION ALL SELECT 'stale_capture', id, url, coalesce(photos, 0)::INTEGER, best FROM x WHERE fetched IS NULL OR fetched < TIMESTAMP '{AS_OF}' - INTERVAL 20 DAY
UNION ALL SELECT 'never_requeued', id, url, coalesce(photos, 0)::INTEGER, best FROM x WHERE id % 3 = 0)""",
)
def recapture_cohort(spark, d):
    """The three cohorts (the last of candidates alone), each in its order."""
    k = F.col("page_id")
    photos = F.when(k % 7 > 0, F.concat(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.when(i < k % 5, F.lit("p")))))
    rows = table(spark, d, "pages").select(
        k.alias("id"), "url", photos.alias("photos"), F.when(k % 6 > 0, F.expr(f"TIMESTAMP_NTZ '{AS_OF}' - make_dt_interval(CAST(page_id % 40 AS INT))")).alias("fetched"), F.when(k % 4 > 0, k % 9).alias("best_score"),
        F.when(k % 11 > 0, "active").otherwise("withdrawn").alias("status"), F.when(k % 13 > 0, "sale").otherwise("rent").alias("operation"), (k % 3 == 0).alias("candidate"),
    )
    out = None
    for kind, threshold in (("few_photos", 3), ("stale_capture", 20), ("never_requeued", 0)):
        cohort = selection.recapture_cohort(rows, kind, threshold, now(), candidates=kind == "never_requeued")
        placed = keyed.numbered(cohort, (F.desc_nulls_last("best_score"), F.asc("photo_count"), F.desc("id")), "place").withColumn("place", F.col("place").cast("int"))
        placed = placed.select(F.lit(kind).alias("kind"), "id", "url", "photo_count", "best_score", "place")
        out = placed if out is None else out.unionByName(placed)
    return out


NEEDS_SQL = "(SELECT c_custkey, 3 - count(DISTINCT event_type) FILTER (WHERE (event_type = 'purchase' AND event_id % 2 = 0) OR (event_type = 'view' AND event_id % 2 = 1) OR (event_type = 'click' AND event_id % 2 = 1)) AS missing FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY c_custkey)"


def needs(spark, d):
    verdicts = table(spark, d, "events").select(F.col("user_id").alias("c_custkey"), F.col("event_type").alias("kind"), (F.col("event_id") % 2).cast("string").alias("version"))
    return selection.needs_verdict(table(spark, d, "customer"), verdicts, "c_custkey", {"purchase": "0", "view": "1", "click": "1"})


@query("oldest_unverified", f"SELECT c_custkey, missing::INTEGER AS missing FROM {NEEDS_SQL} JOIN customer USING (c_custkey) WHERE missing > 0 ORDER BY c_acctbal, c_custkey LIMIT 24")
def oldest_unverified(spark, d):
    """The batch of customers that miss a current verdict, oldest (least balance) first: a top-k."""
    rows = needs(spark, d).join(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey")
    return rows.orderBy("c_acctbal", "c_custkey").limit(24).select("c_custkey", "missing")


@query(
    "bump_preview",
    f"""SELECT eligible, reopened, average, CASE WHEN reopened = 0 THEN 0 ELSE round(reopened * average, 6) END AS projected FROM (SELECT count(*) FILTER (WHERE c_acctbal > 0)::BIGINT AS eligible, count(*) FILTER (WHERE c_acctbal > 0 AND missing > 0)::BIGINT AS reopened FROM customer JOIN {NEEDS_SQL} USING (c_custkey)),
(SELECT round(avg(value), 6) AS average FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY)""",
)
def bump_preview(spark, d):
    rows = table(spark, d, "customer").join(needs(spark, d), "c_custkey", "left")
    usage = table(spark, d, "events").filter((F.col("event_type") == "purchase") & (F.col("ts") >= now() - F.expr("INTERVAL 7 DAYS"))).agg(F.round(F.avg("value"), 6).alias("cost"))
    found = selection.preview(rows, F.col("c_acctbal") > 0, F.col("missing").isNotNull(), usage, "cost")
    return found.withColumn("projected", F.round("projected", 6))


@query(
    "scope_preview",
    f"""SELECT count(*)::BIGINT AS n, count(*) FILTER (WHERE c_mktsegment <> 'BUILDING' AND missing > 0 AND c_nationkey % 2 = 1)::BIGINT AS newly, CASE WHEN count(*) FILTER (WHERE c_mktsegment <> 'BUILDING' AND missing > 0 AND c_nationkey % 2 = 1) = 0 THEN 0
  ELSE ((count(*) FILTER (WHERE c_mktsegment <> 'BUILDING' AND missing > 0 AND c_nationkey % 2 = 1) + 7) // 8 - 1) * 600 END::BIGINT AS seconds FROM customer JOIN {NEEDS_SQL} USING (c_custkey) WHERE c_acctbal BETWEEN 0 AND 5000""",
)
def scope_preview(spark, d):
    """Rows in a scope, those that it would newly make eligible, and how long their verdicts would take."""
    rows = table(spark, d, "customer").join(needs(spark, d), "c_custkey", "left").filter(F.col("c_acctbal").between(0, 5000))
    newly = (F.col("c_mktsegment") != "BUILDING") & F.col("missing").isNotNull() & (F.col("c_nationkey") % 2 == 1)
    counts = rows.agg(F.count("*").alias("n"), F.count_if(newly).alias("newly"))
    return counts.withColumn("seconds", selection.backlog_seconds(F.col("newly"), 8, 600))


@query(
    "task_staleness",
    f"""WITH t AS (SELECT user_id, event_type, max(ts) FILTER (WHERE event_id % 3 > 0) AS last FROM events GROUP BY ALL)
SELECT user_id, event_type, last IS NOT NULL AS done, coalesce(last > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY, false) AS muted, NOT coalesce(last > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY, false) AS due, CASE WHEN last IS NOT NULL THEN greatest(0, epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(last)) // 86400000000 END AS age_days FROM t""",
)
def task_staleness(spark, d):
    return tasks(spark, d).select("user_id", "event_type", "s.done", "s.muted", "s.due", "s.age_days")


def tasks(spark, d):
    last = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max(F.when(F.col("event_id") % 3 > 0, F.col("ts"))).alias("last"))
    return last.select("user_id", "event_type", selection.staleness(F.col("last"), 7, now()).alias("s"))


@query(
    "due_rank",
    f"""WITH t AS (SELECT user_id, event_type, max(ts) FILTER (WHERE event_id % 3 > 0) AS last FROM events GROUP BY ALL), c AS (SELECT user_id % 10 AS profile, event_type AS portal, coalesce(last > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY, false) AS muted FROM t),
g AS (SELECT profile, portal, CASE WHEN bool_and(NOT muted) THEN 0 WHEN bool_or(NOT muted) THEN 1 ELSE 2 END AS r FROM c GROUP BY ALL) SELECT portal, min(r)::INTEGER AS rank FROM g GROUP BY portal""",
)
def due_rank(spark, d):
    rows = tasks(spark, d).select((F.col("user_id") % 10).alias("profile"), F.col("event_type").alias("portal"), F.col("s.due").alias("due"))
    return selection.due_rank(rows, ["profile"], "portal", "due")


@query(
    "merged_hosts",
    """WITH h AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, count(*) AS n, max(CASE WHEN page_id % 3 > 0 THEN length(html) END) AS slowest, min(CASE WHEN page_id % 2 > 0 THEN page_id END) AS oldest FROM pages GROUP BY 1)
SELECT regexp_replace(host, '^www[0-9]*\\.', '') AS portal, sum(n)::BIGINT AS n, max(slowest)::INTEGER AS slowest, min(oldest) AS oldest FROM h GROUP BY 1""",
)
def merged_hosts(spark, d):
    """Pages counted per host, then hosts merged to their portal."""
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    k = F.col("page_id")
    per = table(spark, d, "pages").groupBy(host.alias("host")).agg(F.count("*").alias("n"), F.max(F.when(k % 3 > 0, F.length("html"))).alias("slowest"), F.min(F.when(k % 2 > 0, k)).alias("oldest"))
    return selection.merged_groups(per.withColumn("portal", F.regexp_replace("host", r"^www[0-9]*\.", "")), "portal", ["n"], ["slowest"], ["oldest"])


@query(
    "ranked_news",
    """WITH x AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 > 0 THEN p_size % 7 / 10::DOUBLE END AS below, p_partkey % 3 AS n_flags, CASE WHEN p_partkey % 4 > 0 THEN p_size % 11 END AS score FROM part)
SELECT id, row_number() OVER (ORDER BY below DESC NULLS LAST, n_flags DESC, score DESC NULLS LAST, id DESC) AS place FROM x""",
)
def ranked_news(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, d, "part").select(k.alias("id"), F.when(k % 5 > 0, size % 7 / 10).alias("below"), (k % 3).alias("n_flags"), F.when(k % 4 > 0, (size % 11).cast("double")).alias("score"))
    return keyed.numbered(rows, selection.ranked_news(rows), "place").select("id", "place")


@query(
    "portal_labels",
    """WITH x AS (SELECT page_id, ['comprar-casa-rural', 'comprar-', 'pisos-nuevos', 'ático-dúplex', 'plaza-de-garaje', 'suelo-urbano', 'oficina'][page_id % 7 + 1] AS slug FROM pages)
SELECT page_id, ['Casa rural', 'comprar-', 'Pisos nuevos', 'Ático dúplex', 'Plaza de garaje', 'Suelo urbano', 'Oficina'][page_id % 7 + 1] AS label, [NULL, NULL, 'piso', 'atico', 'garaje', 'terreno', NULL][page_id % 7 + 1] AS kind, CASE WHEN page_id % 9 > 0 THEN slug || '-' || page_id END AS segment FROM x""",
)
def portal_labels(spark, d):
    k = F.col("page_id")
    slug = F.element_at(F.array(*map(F.lit, ("comprar-casa-rural", "comprar-", "pisos-nuevos", "ático-dúplex", "plaza-de-garaje", "suelo-urbano", "oficina"))), (k % 7 + 1).cast("int"))
    fragment = F.when(k % 9 > 0, F.concat(F.lit("/a/"), slug, F.lit("-"), k.cast("string"), F.when(k % 2 == 0, "/").otherwise("?x=/y#z"))).otherwise(F.lit("/?q=/z"))
    label = selection.slug_label(slug)
    return table(spark, d, "pages").select("page_id", label.alias("label"), selection.canonical_type(label).alias("kind"), selection.last_segment(fragment).alias("segment"))


@query(
    "search_tiers",
    f"""WITH t AS (SELECT id AS task, id % 3 AS portal, id % 4 AS section, id % 40 AS place, lat, lon FROM {PARTS_SQL}), e AS (SELECT id AS example, id % 3 AS portal, id % 4 AS section, id % 61 AS place, lat, lon, 't' || id AS template FROM {PARTS_SQL} WHERE id % 5 = 0),
o AS (SELECT 0 AS portal, 1 AS section, 'own' AS template), n AS (SELECT t.task, arg_min(e.template, {{'a': round({km_sql("t", "e")}, 6), 'b': e.example}}) AS near FROM t JOIN e USING (portal, section) WHERE {km_sql("t", "e")} <= 25 GROUP BY t.task),
x AS (SELECT portal, section, place, arg_min(template, example) AS exact FROM e GROUP BY ALL)
SELECT task, coalesce(o.template, exact, near) AS template, CASE WHEN o.template IS NOT NULL THEN 'override' WHEN exact IS NOT NULL THEN 'exact' WHEN near IS NOT NULL THEN 'near' ELSE 'default' END AS tier FROM t LEFT JOIN o USING (portal, section) LEFT JOIN x USING (portal, section, place) LEFT JOIN n USING (task)""",
)
def search_tiers(spark, d):
    p = parts(spark, d)
    k = F.col("id")
    where = ((k % 3).alias("portal"), (k % 4).alias("section"))
    examples = p.filter(k % 5 == 0).select(k.alias("example"), *where, (k % 61).alias("place"), "lat", "lon", F.concat(F.lit("t"), k.cast("string")).alias("template"))
    overrides = spark.createDataFrame([(0, 1, "own")], "portal long, section long, template string")
    return selection.search_tiers(p.select(k.alias("task"), *where, (k % 40).alias("place"), "lat", "lon"), overrides, examples)


@query(
    "score_breakdown",
    """WITH x AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 6 > 0 THEN p_size % 10 / 10::DOUBLE END AS base, CASE WHEN p_partkey % 4 > 0 THEN (p_partkey % 9 - 2) / 10::DOUBLE END AS below, p_partkey % 5 AS distress, p_partkey % 4 AS beach, p_partkey % 3 = 0 AS tourist, CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 300 END AS days, CASE WHEN p_partkey % 7 > 0 THEN p_partkey % 40 / 100::DOUBLE END AS fall FROM part),
b AS (SELECT *, coalesce(days, 0) / 180::DOUBLE * 0.04::DOUBLE AS a1, coalesce(fall, 0) / 0.2::DOUBLE * 0.07::DOUBLE AS a2 FROM x),
t AS (SELECT id, unnest([{'term': 'base', 'boost': coalesce(base, 0)::DOUBLE, 'has': base IS NOT NULL}, {'term': 'below_market', 'boost': least(greatest(coalesce(below, 0), 0), 0.5)::DOUBLE * 0.5, 'has': below IS NOT NULL}, {'term': 'distress', 'boost': least(distress, 3) * 0.05::DOUBLE, 'has': distress > 0},
  {'term': 'beach', 'boost': beach * 0.03::DOUBLE, 'has': beach > 0}, {'term': 'tourist', 'boost': CASE WHEN tourist THEN 0.04 ELSE 0 END::DOUBLE, 'has': tourist},
  {'term': 'days_on_market', 'boost': a1 * CASE WHEN a1 + a2 > 0 THEN least(a1 + a2, 0.11) / (a1 + a2) ELSE 0 END, 'has': days IS NOT NULL}, {'term': 'price_drop', 'boost': a2 * CASE WHEN a1 + a2 > 0 THEN least(a1 + a2, 0.11) / (a1 + a2) ELSE 0 END, 'has': fall IS NOT NULL}]) AS u FROM b),
c AS (SELECT id, count(*) FILTER (WHERE u.has AND u.term <> 'base') AS signals, bool_or(u.has AND u.term = 'base') AS has_base FROM t GROUP BY id)
SELECT id, u.term AS term, round(u.boost / 1.64 * 100, 6) AS points, u.has AS has_data, CASE WHEN NOT has_base THEN 'baja' WHEN signals >= 3 THEN 'alta' WHEN signals >= 1 THEN 'media' ELSE 'baja' END AS confidence FROM t JOIN c USING (id)""",
)
def score_breakdown(spark, d):
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(
        k.alias("id"), F.when(k % 6 > 0, F.col("p_size") % 10 / 10).alias("base"), F.when(k % 4 > 0, (k % 9 - 2) / 10).alias("below"), (k % 5).alias("distress"), (k % 4).alias("beach"), (k % 3 == 0).alias("tourist"),
        F.when(k % 5 > 0, k % 300).alias("days"), F.when(k % 7 > 0, k % 40 / 100).alias("drop"),
    )
    sure = selection.with_confidence(rows.filter("id IS NOT NULL"), "id")
    return selection.score_terms(sure, "id", keep=["confidence"]).withColumn("points", F.round("points", 6))


TRACKED_SQL = "(SELECT user_id, event_id % 20 AS item FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_id % 20 ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type IN ('click', 'purchase', 'error')) WHERE rn = 1 AND event_type = 'purchase')"


@query(
    "tracked_drops",
    f"""WITH h AS (SELECT l_suppkey, l_partkey, l_shipdate, l_extendedprice / l_quantity AS price, lag(l_extendedprice / l_quantity) OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice) AS old FROM lineitem)
SELECT user_id, count(*)::BIGINT AS drops, round(max((old - price) / old), 6) AS deepest, max(l_shipdate) AS last FROM h JOIN {TRACKED_SQL} t ON l_partkey % 20 = t.item AND l_suppkey % 50 = t.user_id WHERE old IS NOT NULL AND old <> 0 AND price < old AND (old - price) / old BETWEEN 0.01 AND 0.6 GROUP BY user_id""",
)
def tracked_drops(spark, d):
    """Price drops of what a user follows: items whose newest feedback is a purchase."""
    e = table(spark, d, "events").filter(F.col("event_type").isin("click", "purchase", "error")).withColumn("item", F.col("event_id") % 20)
    newest = e.groupBy("user_id", "item").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state")).filter("state = 'purchase'")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    w = keyed.Window.partitionBy("l_partkey", "l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice")
    h = table(spark, d, "lineitem").select((F.col("l_partkey") % 20).alias("item"), (F.col("l_suppkey") % 50).alias("user_id"), "l_shipdate", price.alias("price"), F.lag(price).over(w).alias("old"))
    fall = (F.col("old") - F.col("price")) / F.col("old")
    drops = h.filter((F.col("old") != 0) & (F.col("price") < F.col("old")) & fall.between(0.01, 0.6))
    return drops.join(newest, ["user_id", "item"]).groupBy("user_id").agg(F.count("*").alias("drops"), F.round(F.max(fall), 6).alias("deepest"), F.max("l_shipdate").alias("last"))


@query(
    "map_candidates",
    """WITH x AS (SELECT p_type, p_partkey AS id, CASE WHEN p_partkey % 6 > 0 THEN p_size END AS lat, row_number() OVER (PARTITION BY p_type, p_partkey % 6 > 0 ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part)
SELECT p_type, count(*) FILTER (WHERE lat IS NOT NULL)::BIGINT AS plottable, count(*) FILTER (WHERE lat IS NULL)::BIGINT AS unplottable, string_agg(id, ',' ORDER BY rn) FILTER (WHERE lat IS NOT NULL AND rn <= 500) AS ids FROM x GROUP BY p_type""",
)
def map_candidates(spark, d):
    """Per type the first 500 parts that can be plotted, and how many can and cannot."""
    p = table(spark, d, "part").withColumn("lat", F.when(F.col("p_partkey") % 6 > 0, F.col("p_size")))
    counts = p.groupBy("p_type").agg(F.count("lat").alias("plottable"), F.count_if(F.col("lat").isNull()).alias("unplottable"))
    w = keyed.Window.partitionBy("p_type").orderBy(F.desc("p_retailprice"), "p_partkey")
    first = p.filter("lat IS NOT NULL").withColumn("rn", F.row_number().over(w)).filter("rn <= 500")
    ids = first.groupBy("p_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "p_partkey"))), lambda x: x["p_partkey"].cast("string")), ",").alias("ids"))
    return counts.join(ids, "p_type", "left")


@query(
    "novelties",
    """WITH x AS (SELECT user_id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-29' GROUP BY user_id), t AS (SELECT sum(n) AS total, count(*) AS profiles FROM x)
SELECT user_id, n::BIGINT AS n, row_number() OVER (ORDER BY n DESC, user_id) AS place, total::BIGINT AS total, profiles::BIGINT AS profiles FROM x, t""",
)
def novelties(spark, d):
    """Every profile with new rows in order, beside the totals (one row, joined by broadcast)."""
    n = table(spark, d, "events").filter("ts >= TIMESTAMP_NTZ '2024-01-29 00:00:00'").groupBy("user_id").agg(F.count("*").alias("n"))
    totals = n.agg(F.sum("n").alias("total"), F.count("*").alias("profiles"))
    return keyed.numbered(n, (F.desc("n"), F.asc("user_id")), "place").join(F.broadcast(totals))


@query(
    "staleness",
    """WITH s AS (SELECT user_id, max(ts) AS seen, round(avg(value), 2) * 2 - 10 AS points FROM events GROUP BY user_id), x AS (SELECT c_custkey, seen, points, CASE WHEN seen IS NOT NULL THEN greatest(floor((epoch_us(TIMESTAMP '2024-02-10') - epoch_us(seen)) / 86400000000), 0) END::BIGINT AS days FROM customer LEFT JOIN s ON user_id = c_custkey)
SELECT c_custkey, days, CASE WHEN days <= 7 THEN 'fresh' WHEN days <= 21 THEN 'aging' WHEN days IS NOT NULL THEN 'stale' END AS band,
  CASE WHEN points IS NULL THEN NULL WHEN points >= 70 THEN 'A' WHEN points >= 50 THEN 'B' WHEN points >= 30 THEN 'C' ELSE 'D' END AS letter FROM x""",
)
def staleness(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("seen"), (F.round(F.avg("value"), 2) * 2 - 10).alias("points"))
    c = table(spark, d, "customer").select("c_custkey").join(e, F.col("c_custkey") == F.col("user_id"), "left")
    days = health.staleness_days(F.col("seen"), F.expr("TIMESTAMP_NTZ '2024-02-10 00:00:00'"))
    return c.withColumn("days", days).select("c_custkey", "days", health.staleness_band(F.col("days")).alias("band"), health.score_band(F.col("points")).alias("letter"))


NAMES = ("Ñora", "nube", "Ávila", "azul", "10", "Zamora", "zanja", "9.5", "ñandú", "Cádiz", "", "cine")


@query(
    "collated_page",
    f"""WITH x AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 13 < 12 THEN {list(NAMES)}[p_partkey % 13 + 1] END AS cell FROM part)
SELECT id, cell, row_number() OVER (ORDER BY cell IS NULL, TRY_CAST(nullif(cell, '') AS DOUBLE) IS NULL, TRY_CAST(nullif(cell, '') AS DOUBLE), cell COLLATE es, id) AS place FROM x""",
)
def collated_page(spark, d):
    """A page's sort: numbers first by value, then texts as Spanish dictionaries have them, nulls last."""
    at = (F.col("p_partkey") % 13).cast("int")
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(at < 12, F.element_at(F.array(*map(F.lit, NAMES)), at + 1)).alias("cell"))
    return keyed.numbered(rows, (*selection.table_order("cell"), F.asc("id")), "place")


@query(
    "stale_profiles",
    "WITH p AS (SELECT user_id, max(ts) AS done FROM events WHERE event_type = 'purchase' GROUP BY user_id), n AS (SELECT max(ts) AS newest FROM events WHERE event_type = 'view') SELECT c_custkey, done, newest FROM customer LEFT JOIN p ON user_id = c_custkey, n WHERE newest IS NOT NULL AND (done IS NULL OR done < newest)",
)
def stale_profiles(spark, d):
    """Profiles that were last worked out before the newest listing; none are told while a sweep runs."""
    e = table(spark, d, "events")
    done = e.filter("event_type = 'purchase'").groupBy(F.col("user_id").alias("c_custkey")).agg(F.max("ts").alias("done"))
    newest = e.filter("event_type = 'view'").agg(F.max("ts").alias("newest"))  # one row beside each profile
    rows = table(spark, d, "customer").select("c_custkey").join(done, "c_custkey", "left").join(F.broadcast(newest))
    return rows.filter(F.col("newest").isNotNull() & (F.col("done").isNull() | (F.col("done") < F.col("newest"))))


@query("activations", "SELECT user_id, count(*)::BIGINT AS n, min(moment) AS first FROM (SELECT user_id, min(ts) AS moment FROM events GROUP BY user_id UNION SELECT user_id, ts FROM events WHERE event_type = 'view') GROUP BY user_id")
def activations(spark, d):
    """First sights and later activations, each moment once."""
    e = table(spark, d, "events")
    both = e.groupBy("user_id").agg(F.min("ts").alias("at")).union(e.filter("event_type = 'view'").select("user_id", "ts")).distinct()
    return both.groupBy("user_id").agg(F.count("*").alias("n"), F.min("at").alias("first"))


@query("zipped_update", "SELECT o_custkey, o_orderkey, arr.s AS status FROM (SELECT o_custkey, o_orderkey, {'s': CASE WHEN o_orderkey % 2 = 0 THEN 'seen' ELSE o_orderstatus END} AS arr FROM orders WHERE o_orderkey % 3 <> 1)")
def zipped_update(spark, d):
    """A bulk update that comes as arrays of equal length (keys, values), one pair per customer, joined to the rows."""
    o = table(spark, d, "orders").filter("o_orderkey % 3 <> 1").select("o_custkey", "o_orderkey", "o_orderstatus")
    arrays = o.filter("o_orderkey % 2 = 0").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("keys")).withColumn("values", F.transform("keys", lambda k: F.lit("seen")))
    news = arrays.select(F.explode(F.arrays_zip("keys", "values")).alias("z")).select(F.col("z.keys").alias("o_orderkey"), F.col("z.values").alias("new"))
    return o.join(news, "o_orderkey", "left").select("o_custkey", "o_orderkey", F.coalesce("new", "o_orderstatus").alias("status"))


@query(
    "extraction_quality",
    """WITH x AS (SELECT p_partkey AS k FROM part), s AS (SELECT k, 3 * (k % 2 = 0)::INT + 3 * (k % 3 = 0 OR k % 5 = 0)::INT + 3 * (k % 4 > 0)::INT + 2 * (k % 5 > 0)::INT + 2 * (k % 6 > 0)::INT + 2 * (k % 7 > 1)::INT + (k % 8 > 1)::INT + (k % 9 > 0)::INT + (k % 10 > 0)::INT AS hit FROM x)
SELECT k AS id, round(hit / 18::DOUBLE, 3) AS score, CASE WHEN hit / 18::DOUBLE >= 0.85 THEN 'A' WHEN hit / 18::DOUBLE >= 0.65 THEN 'B' WHEN hit / 18::DOUBLE >= 0.45 THEN 'C' ELSE 'F' END AS grade FROM s""",
)
def extraction_quality(spark, d):
    """The nine weighted fields of a listing, as parts have them: some texts blank, some photo lists empty."""
    k = F.col("p_partkey")
    some = lambda c, kind="double": F.when(c, F.lit("1")).cast(kind)
    rows = table(spark, d, "part").select(
        k.alias("id"), some(k % 2 == 0).alias("price"), some(k % 3 == 0).alias("lat"), some(k % 3 == 0).alias("lon"), F.when(k % 5 == 0, "calle a").otherwise(" ").alias("address"), some(k % 4 > 0).alias("m2"), some(k % 5 > 0, "string").alias("kind"), some(k % 6 > 0).alias("rooms"),
        F.when(k % 7 > 1, F.array(F.lit("p"))).when(k % 7 == 1, F.array().cast("array<string>")).alias("photos"), F.when(k % 8 > 1, "text").when(k % 8 == 1, "  ").alias("description"), some(k % 9 > 0).alias("bathrooms"), some(k % 10 > 0, "string").alias("energy"),
    )
    score = ingest.extraction_score()
    return rows.select("id", F.round(score, 3).alias("score"), ingest.grade(score).alias("grade"))


@query(
    "scope_rules",
    """WITH x AS (SELECT p_partkey AS k FROM part) SELECT k, CASE WHEN k % 3 > 0 THEN k % 7 WHEN k % 5 >= 3 THEN k % 4 END AS rooms, k % 4 <> 1 AS elevator, k % 6 <> 2 AS wanted, CASE WHEN k % 5 IN (0, 1) THEN false WHEN k % 5 = 2 THEN k % 2 = 0 ELSE true END AND k % 11 <> 0 AS other_kind,
  CASE WHEN k % 4 > 0 THEN 1 / (1 + k % 10)::DOUBLE WHEN k % 8 > 0 THEN k % 10 / 10::DOUBLE ELSE 0.5 END AS cold FROM x""",
)
def scope_rules(spark, d):
    """Structured before extracted values, elevators that may be unknown, rejected ones, kinds that conflict, cold starts."""
    k = F.col("k")
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("k")).withColumns({
        "s": F.when(k % 3 > 0, k % 7), "x": k % 4, "c": k % 5 / 5, "e": F.when(k % 4 == 0, True).when(k % 4 == 1, False), "f": F.when(k % 6 == 2, "reject").when(k % 6 == 3, "accept"),
        "v": F.when(k % 4 > 0, k % 10), "p": F.when(k % 8 > 0, k % 10 / 10),
    })
    other = F.when(k % 5 == 0, "piso").when(k % 5 == 1, "atico").when(k % 5 == 2, F.when(k % 2 == 0, "local").otherwise("piso")).otherwise("chalet")
    return rows.select(
        "k", scope.structured_or_extracted("s", "x", "c").alias("rooms"), scope.elevator_allowed("e", True).alias("elevator"), scope.not_rejected("f").alias("wanted"),
        linkage.type_conflict(F.lit("piso"), other, k % 11 == 0).alias("other_kind"), scoring.cold_start(F.col("v"), F.col("p")).alias("cold"),
    )


CARDS_SQL = """WITH pr AS (SELECT s_suppkey AS profile_id, TIMESTAMP '1994-01-01' + to_days((s_suppkey * 37 % 1000)::INT) AS anchor, CASE WHEN s_suppkey % 4 > 0 THEN 8 + s_suppkey % 5 END AS rent FROM supplier),
st AS (SELECT DISTINCT l_suppkey AS profile_id, l_partkey AS property_id, CASE WHEN (l_partkey + l_suppkey) % 11 > 0 THEN round((l_partkey * 31 + l_suppkey) % 997 / 1000::DOUBLE, 3) END AS score, CASE WHEN l_partkey % 3 = 0 THEN 'cold_start' ELSE 'trained' END AS score_kind, nullif(p_size % 40, 0) AS m2
  FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_partkey % 7 > 0),
li AS (SELECT l_partkey AS property_id, l_orderkey % 5 AS source, l_returnflag = 'N' AS active, l_returnflag = 'N' AND l_linestatus = 'O' AS active_sale, l_extendedprice / l_quantity AS price, l_shipdate AS first_seen, CASE WHEN l_linenumber % 3 > 0 THEN 'p' || l_orderkey || '-' || l_linenumber END AS photo FROM lineitem),
pe AS (SELECT property_id, min(price) FILTER (WHERE active_sale) AS price, min(first_seen) FILTER (WHERE source <> 3) AS first_seen, min(struct_pack(s := source, p := photo)) FILTER (WHERE active AND photo IS NOT NULL) AS ph FROM li GROUP BY property_id),
fb AS (SELECT profile_id, property_id, arg_max(kind, {'t': ts, 'e': event_id}) AS kind FROM (SELECT user_id % (SELECT count(*) FROM supplier) + 1 AS profile_id, event_id % (SELECT count(*) FROM part) + 1 AS property_id, ['accept', 'reject', 'star', 'clear'][event_id // 7 % 4 + 1] AS kind, ts, event_id FROM events) GROUP BY ALL),
m AS (SELECT st.*, pe.price, pe.first_seen, pe.ph.p AS photo, fb.kind, anchor, rent, o.c IS NOT NULL AS flag FROM st JOIN pr USING (profile_id) LEFT JOIN pe USING (property_id) LEFT JOIN fb USING (profile_id, property_id) LEFT JOIN (SELECT DISTINCT o_custkey AS c FROM orders WHERE o_orderpriority = '1-URGENT') o ON o.c = st.property_id),
g AS (SELECT profile_id, count(*) AS matched_count, count(*) FILTER (WHERE first_seen > anchor AND kind IS DISTINCT FROM 'reject') AS new_count, min(price) AS min_price, quantile_cont(price, 0.5) AS median_price, max(price) AS max_price, count(*) FILTER (WHERE score_kind = 'cold_start') AS cold_start_count,
  count(*) FILTER (WHERE score_kind = 'trained') AS trained_count, quantile_cont(rent * 12 * m2 / price * 100, 0.5) FILTER (WHERE price > 0 AND m2 > 0) AS yield_median, count(*) FILTER (WHERE flag) AS flagged_count FROM m GROUP BY profile_id),
v AS (SELECT profile_id, count(*) FILTER (WHERE kind = 'accept') AS accepted_count, count(*) FILTER (WHERE kind = 'reject') AS rejected_count FROM fb GROUP BY profile_id),
b AS (SELECT profile_id, string_agg(property_id || ':' || coalesce(photo, '-'), ',' ORDER BY rn) AS thumbnails FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY score DESC NULLS LAST, property_id DESC) AS rn FROM m) WHERE rn <= 4 GROUP BY profile_id)
SELECT pr.profile_id, coalesce(matched_count, 0)::BIGINT AS matched_count, coalesce(new_count, 0)::BIGINT AS new_count, coalesce(accepted_count, 0)::BIGINT AS accepted_count, coalesce(rejected_count, 0)::BIGINT AS rejected_count, round(min_price, 4) AS min_price, round(median_price, 4) AS median_price, round(max_price, 4) AS max_price,
  coalesce(cold_start_count, 0)::BIGINT AS cold_start_count, coalesce(trained_count, 0)::BIGINT AS trained_count, round(yield_median, 4) AS yield_median, coalesce(flagged_count, 0)::BIGINT AS flagged_count, thumbnails FROM pr LEFT JOIN g USING (profile_id) LEFT JOIN v USING (profile_id) LEFT JOIN b USING (profile_id)"""


@query("profile_cards", CARDS_SQL)
def profile_cards(spark, d):
    """Suppliers as profiles over the parts they have: counts, prices, yields, flags and pictures, each profile by its own anchor."""
    k, s, line = F.col("l_partkey"), F.col("l_suppkey"), table(spark, d, "lineitem")
    sk = F.col("s_suppkey")
    profiles = table(spark, d, "supplier").select(sk.alias("profile_id"), (F.expr("TIMESTAMP_NTZ '1994-01-01 00:00:00'") + F.make_dt_interval((sk * 37 % 1000).cast("int"))).alias("anchor"), F.when(sk % 4 > 0, 8 + sk % 5).alias("rent"))
    sizes = table(spark, d, "part").select(F.col("p_partkey").alias("property_id"), F.nullif(F.col("p_size") % 40, F.lit(0)).alias("m2"))
    states = line.filter("l_partkey % 7 > 0").select(s.alias("profile_id"), k.alias("property_id")).distinct().join(sizes, "property_id")
    number, owner = F.col("property_id"), F.col("profile_id")
    score = F.when((number + owner) % 11 > 0, F.round((number * 31 + owner) % 997 / 1000, 3))
    states = states.withColumns({"matched": F.lit(True), "score": score, "score_kind": F.when(number % 3 == 0, "cold_start").otherwise("trained")})
    photo = F.when(F.col("l_linenumber") % 3 > 0, F.concat(F.lit("p"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")))
    active = F.col("l_returnflag") == "N"
    listings = line.select(k.alias("property_id"), (F.col("l_orderkey") % 5).alias("source"), active.alias("active"), (active & (F.col("l_linestatus") == "O")).alias("active_sale"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_shipdate").alias("first_seen"), F.array(F.lit(None).cast("string"), photo).alias("photos"))
    n_profiles, n_properties = table(spark, d, "supplier").count(), table(spark, d, "part").count()
    kinds = F.array(*map(F.lit, ("accept", "reject", "star", "clear")))
    events = table(spark, d, "events").select((F.col("user_id") % n_profiles + 1).alias("profile_id"), (F.col("event_id") % n_properties + 1).alias("property_id"), kinds[(F.floor(F.col("event_id") / 7) % 4).cast("int")].alias("kind"), "ts", "event_id")
    feedback = events.groupBy("profile_id", "property_id").agg(F.max_by("kind", F.struct("ts", "event_id")).alias("kind"))
    flagged = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("property_id"))
    cards = selection.profile_cards(profiles, states, listings, spark.createDataFrame([(3,)], "source long"), feedback, flagged)
    rounded = {c: F.round(c, 4) for c in ("min_price", "median_price", "max_price", "yield_median")}
    return cards.withColumns(rounded | {"thumbnails": F.array_join(F.transform("thumbnails", lambda x: F.concat_ws(":", x["property_id"].cast("string"), F.coalesce(x["photo"], F.lit("-")))), ",")})
