"""Aggregations, JSON, windows over events, activity and health."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessaria.operators import health, keyed
from tessaria.operators.joins import full_diff
from tessaria.plans.registry import AS_OF, LINE_ORDER, events, query
from tessaria.plans.relational import SESSIONS_SQL
from tessaria.session import table


PAIRS_SQL = """WITH s AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem),
p AS (SELECT a.l_suppkey AS lo, b.l_suppkey AS hi, a.l_partkey FROM s a JOIN s b ON a.l_partkey = b.l_partkey AND a.l_suppkey < b.l_suppkey)
SELECT lo, hi, count(*)::BIGINT AS n, max(l_partkey) AS top FROM p GROUP BY lo, hi HAVING count(*) >= 12"""


@query("unordered_pairs", PAIRS_SQL)
def unordered_pairs(spark, d):
    """Suppliers that share 12 parts or more of the whole catalogue."""
    return health.pair_counts(table(spark, d, "lineitem"), "l_partkey", "l_suppkey", 12)


@query(
    "explode_json_having",
    """WITH j AS (SELECT user_id, event_type, json_extract_string(props, '$.k')::INT AS k FROM events), x AS (SELECT *, unnest([k % 5, k % 7, NULL]) AS flag FROM j)
SELECT flag, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS users, array_to_string(list_slice(list_sort(list(DISTINCT event_type)), 1, 3), '|') AS types FROM x WHERE flag IS NOT NULL AND flag NOT IN (2, 6) GROUP BY flag HAVING count(*) >= 100""",
)
def explode_json_having(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    flags = F.explode(F.array_compact(F.array(k % 5, k % 7, F.lit(None))))
    rows = table(spark, d, "events").select("user_id", "event_type", flags.alias("flag"))
    dismissed = spark.createDataFrame([(2,), (6,)], "flag int")
    rows = rows.join(F.broadcast(dismissed), "flag", "left_anti")
    return rows.groupBy("flag").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.array_join(F.slice(F.array_sort(F.collect_set("event_type")), 1, 3), "|").alias("types")).filter("n >= 100")


@query(
    "pivot_latest_assessment",
    """WITH l AS (SELECT user_id, event_type, arg_max(value, {'a': ts, 'b': event_id}) AS v FROM events GROUP BY ALL)
SELECT user_id, max(v) FILTER (WHERE event_type = 'purchase') AS purchase, max(v) FILTER (WHERE event_type = 'click') AS click, max(v) FILTER (WHERE event_type = 'view') AS view, bool_or(v > 90) AS any_high FROM l GROUP BY user_id""",
)
def pivot_latest_assessment(spark, d):
    latest = table(spark, d, "events").groupBy("user_id", "event_type").agg(keyed.latest_value("value", "ts", "event_id").alias("v"))
    of = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("v"))).alias(kind)
    return latest.groupBy("user_id").agg(of("purchase"), of("click"), of("view"), F.bool_or(F.col("v") > 90).alias("any_high"))


@query(
    "photo_order_cap",
    """WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS place FROM documents),
f AS (SELECT doc_id, word, min(place) AS place FROM w WHERE word <> '' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS pos FROM f)
SELECT doc_id, pos::INTEGER AS pos, word FROM r WHERE pos <= 8""",
)
def photo_order_cap(spark, d):
    """The first eight distinct words of each text, in order."""
    words = F.slice(F.array_distinct(F.filter(F.split("text", " "), lambda w: w != "")), 1, 8)
    return table(spark, d, "documents").select("doc_id", F.posexplode(words).alias("at", "word")).select("doc_id", (F.col("at") + 1).alias("pos"), "word")


@query("json_agg_ordered", "SELECT o_custkey, string_agg(o_orderpriority || ':' || o_orderkey, '|' ORDER BY o_orderdate DESC, o_orderkey) AS orders FROM orders GROUP BY o_custkey")
def json_agg_ordered(spark, d):
    entry = F.struct((-F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("at"), "o_orderkey", F.concat_ws(":", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("text"))
    lists = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(entry)).alias("rows"))
    return lists.select("o_custkey", F.array_join("rows.text", "|").alias("orders"))


@query(
    "percentiles_mixed",
    """SELECT event_type, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75,
  quantile_disc(value, 0.5) FILTER (WHERE user_id % 2 = 0) AS disc FROM events GROUP BY event_type""",
)
def percentiles_mixed(spark, d):
    table(spark, d, "events").createOrReplaceTempView("events_view")
    return spark.sql("""SELECT event_type, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY value), 6) AS p25, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY value), 6) AS p50,
      round(percentile_cont(0.75) WITHIN GROUP (ORDER BY value), 6) AS p75, percentile_disc(0.5) WITHIN GROUP (ORDER BY value) FILTER (WHERE user_id % 2 = 0) AS disc FROM events_view GROUP BY event_type""")


@query(
    "rolling_buckets",
    "SELECT event_type, "
    + ", ".join(f"count(*) FILTER (WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL {i + 1} DAY AND ts < TIMESTAMP '{AS_OF}' - INTERVAL {i} DAY)::BIGINT AS d{i}" for i in range(7))
    + f", round(coalesce(sum(value) FILTER (WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY), 0), 4) AS month FROM events GROUP BY event_type",
)
def rolling_buckets(spark, d):
    return health.day_buckets(table(spark, d, "events"), "event_type", "ts", AS_OF, F.col("value"))


@query(
    "queue_depth_flow",
    f"""SELECT user_id % 10 AS queue, count(*) FILTER (WHERE event_type = 'view')::BIGINT AS depth, count(*) FILTER (WHERE event_type = 'view' AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY)::BIGINT AS inflow,
  count(*) FILTER (WHERE event_type = 'purchase' AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY)::BIGINT AS outflow, min(ts) FILTER (WHERE event_type = 'view') AS oldest,
  CASE WHEN count(*) FILTER (WHERE event_type = 'view' AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) > count(*) FILTER (WHERE event_type = 'purchase' AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) THEN 'growing'
  WHEN count(*) FILTER (WHERE event_type = 'view' AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) < count(*) FILTER (WHERE event_type = 'purchase' AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) THEN 'draining' ELSE 'steady' END AS trend
FROM events GROUP BY user_id % 10""",
)
def queue_depth_flow(spark, d):
    e = table(spark, d, "events").withColumn("queue", F.col("user_id") % 10)
    return health.queue_flow(e, "queue", "ts", F.col("event_type") == "view", F.col("event_type") == "purchase", AS_OF)


@query(
    "source_status",
    f"""WITH s AS (SELECT user_id, max(ts) AS last, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) AS n FROM events GROUP BY user_id),
t AS (SELECT *, CASE WHEN errors * 4 > n THEN 'failing' WHEN last < TIMESTAMP '{AS_OF}' - INTERVAL 48 HOUR THEN 'stuck' WHEN last < TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR THEN 'due' ELSE 'fresh' END AS status FROM s)
SELECT user_id % 7 AS portal, count(*)::BIGINT AS sources, ['fresh', 'due', 'stuck', 'failing'][max(list_position(['fresh', 'due', 'stuck', 'failing'], status))] AS worst FROM t GROUP BY ALL""",
)
def source_status(spark, d):
    per = health.source_status(table(spark, d, "events"), "user_id", "ts", F.col("event_type") == "error", AS_OF)
    return health.worst_of(per.withColumn("portal", F.col("user_id") % 7), "portal")


@query(
    "activity_feed",
    f"""WITH st AS (SELECT user_id, ts, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events WHERE event_type <> 'click'),
a AS (SELECT 'order' AS kind, o_custkey::VARCHAR AS source, o_orderdate AS t, o_orderdate AS t_end, o_orderstatus AS status, o_orderkey AS id FROM orders
UNION ALL SELECT 'line', l_suppkey::VARCHAR, l_shipdate, l_shipdate, l_returnflag, l_orderkey * 10 + l_linenumber FROM lineitem
UNION ALL SELECT 'session', user_id::VARCHAR, min(ts), max(ts), count(*)::VARCHAR, min(event_id) FROM {SESSIONS_SQL} GROUP BY user_id, session
UNION ALL SELECT 'sweep', NULL, date_trunc('hour', ts)::TIMESTAMP, max(ts), count(*)::VARCHAR, min(event_id) FROM events GROUP BY date_trunc('hour', ts) HAVING count(*) FILTER (WHERE event_type = 'purchase') = 0
UNION ALL SELECT 'requeue', user_id::VARCHAR, date_trunc('hour', ts)::TIMESTAMP, NULL, count(*)::VARCHAR, min(event_id) FROM events WHERE event_type = 'error' GROUP BY user_id, date_trunc('hour', ts)
UNION ALL SELECT 'pass', NULL, date_trunc('day', ts)::TIMESTAMP, max(ts), count(DISTINCT user_id)::VARCHAR, min(event_id) FROM events GROUP BY date_trunc('day', ts)
UNION ALL SELECT 'manual', user_id::VARCHAR, ts, NULL, 'requested', event_id FROM events WHERE event_type = 'purchase' AND value > 40
UNION ALL SELECT 'state', user_id::VARCHAR, ts, NULL, CASE WHEN event_type = 'view' THEN 'resurrected' ELSE event_type END, event_id FROM st WHERE event_type <> 'view' OR before <> 'view')
SELECT kind, source, t, t_end, status, id FROM a ORDER BY t DESC, kind, id, source, status LIMIT 400""",
)
def activity_feed(spark, d):
    """The newest 400 of eight kinds of activity: orders and lines as crawls, sessions, hours without a purchase as sweeps without
    results, hours of errors as requeued batches, days as passes, large purchases as manual runs, and changes of state
    (events of plain activity only where they follow another state)."""
    shape = lambda df, kind, source, t, t_end, status, id_: df.select(F.lit(kind).alias("kind"), source.cast("string").alias("source"), F.col(t).alias("t"), (F.col(t_end) if t_end else F.lit(None).cast("timestamp_ntz")).alias("t_end"), status.cast("string").alias("status"), id_.alias("id"))
    e, nobody = table(spark, d, "events"), F.lit(None)
    user, n, first = F.col("user_id"), F.col("n"), F.col("id")
    grouped = lambda df, unit, *keys: df.groupBy(*keys, F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("t")).agg(F.count("*").alias("n"), F.min("event_id").alias("id"), F.max("ts").alias("t_end"), F.count_if(F.col("event_type") == "purchase").alias("bought"), F.count_distinct("user_id").alias("users"))
    sessions = keyed.sessionize(events(spark, d), ["user_id"], "at", 30).groupBy("user_id", "session").agg(F.min("ts").alias("t"), F.max("ts").alias("t_end"), F.count("*").alias("n"), F.min("event_id").alias("id"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    states = e.filter("event_type <> 'click'").withColumn("before", F.lag("event_type").over(w)).filter("event_type <> 'view' OR before <> 'view'")
    kinds = [
        shape(table(spark, d, "orders"), "order", F.col("o_custkey"), "o_orderdate", "o_orderdate", F.col("o_orderstatus"), F.col("o_orderkey")),
        shape(table(spark, d, "lineitem"), "line", F.col("l_suppkey"), "l_shipdate", "l_shipdate", F.col("l_returnflag"), F.col("l_orderkey") * 10 + F.col("l_linenumber")),
        shape(sessions, "session", user, "t", "t_end", n, first),
        shape(grouped(e, "hour").filter("bought = 0"), "sweep", nobody, "t", "t_end", n, first),
        shape(grouped(e.filter("event_type = 'error'"), "hour", "user_id"), "requeue", user, "t", None, n, first),
        shape(grouped(e, "day"), "pass", nobody, "t", "t_end", F.col("users"), first),
        shape(e.filter("event_type = 'purchase' AND value > 40"), "manual", user, "ts", None, F.lit("requested"), F.col("event_id")),
        shape(states, "state", user, "ts", None, F.when(F.col("event_type") == "view", "resurrected").otherwise(F.col("event_type")), F.col("event_id")),
    ]
    newest = lambda df: df.orderBy(F.desc("t"), "kind", "id", "source", "status").limit(400)
    return newest(reduce(DataFrame.unionByName, map(newest, kinds)))  # of each kind first, so little is shuffled


@query("prev_activity_day", "SELECT max(day)::DATE AS day FROM (SELECT o_orderdate::DATE AS day FROM orders UNION ALL SELECT l_shipdate::DATE FROM lineitem UNION ALL SELECT ts::DATE FROM events) WHERE day < DATE '2024-01-15'")
def prev_activity_day(spark, d):
    days = [table(spark, d, t).select(F.to_date(c).alias("day")) for t, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts"))]
    return days[0].union(days[1]).union(days[2]).filter("day < DATE '2024-01-15'").agg(F.max("day").alias("day"))


DAILY_SQL = "(SELECT user_id, ts::DATE AS day, count(*) FILTER (WHERE event_type = 'purchase') AS n FROM events GROUP BY ALL)"


@query(
    "trailing_zero_run",
    f"""WITH m AS (SELECT *, sum((n > 0)::INT) OVER (PARTITION BY user_id ORDER BY day DESC ROWS UNBOUNDED PRECEDING) = 0 AS open FROM {DAILY_SQL})
SELECT user_id, count(*) FILTER (WHERE open)::BIGINT AS run, count(*)::BIGINT AS rows, min(day) FILTER (WHERE open) AS run_start, bool_or(NOT open) AS before FROM m GROUP BY user_id""",
)
def trailing_zero_run(spark, d):
    daily = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "purchase").alias("n"))
    return keyed.trailing_run(daily, ["user_id"], "day", F.col("n") == 0)


@query(
    "anomaly_z",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS rn FROM (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL)),
s AS (SELECT user_id, max(n) FILTER (WHERE rn = 1) AS cur, avg(n) FILTER (WHERE rn > 1) AS mean, stddev_pop(n) FILTER (WHERE rn > 1) AS sd, count(*) FILTER (WHERE rn > 1) AS h FROM r GROUP BY user_id)
SELECT user_id, round((cur - mean) / sd, 5) AS z, abs((cur - mean) / sd) > 2 AS anomaly FROM s WHERE h >= 4 AND sd > 0""",
)
def anomaly_z(spark, d):
    daily = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return health.z_anomaly(daily, "user_id", "day", "n")


@query(
    "comparison_merge",
    """WITH c AS (SELECT event_type || '/' || (user_id % 5) AS x, round(sum(value), 4) AS y FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1),
p AS (SELECT event_type || '/' || (user_id % 5) AS x, round(sum(value), 4) AS y FROM events WHERE ts < TIMESTAMP '2024-01-16' AND user_id % 5 < 4 GROUP BY 1)
SELECT x, c.y AS y, p.y AS y_before FROM c LEFT JOIN p USING (x) WHERE c.y IS NOT NULL""",
)
def comparison_merge(spark, d):
    e = table(spark, d, "events").withColumn("x", F.concat_ws("/", "event_type", (F.col("user_id") % 5).cast("string")))
    split = F.expr("TIMESTAMP_NTZ '2024-01-16 00:00:00'")
    current = e.filter(F.col("ts") >= split).groupBy("x").agg(F.round(F.sum("value"), 4).alias("y"))
    before = e.filter((F.col("ts") < split) & (F.col("user_id") % 5 < 4)).groupBy("x").agg(F.round(F.sum("value"), 4).alias("y_before"))
    return current.filter("y IS NOT NULL").join(before, "x", "left")


@query(
    "distribute_rounding",
    """WITH t AS (SELECT p_brand, p_type, sum(p_size) AS s FROM part GROUP BY ALL), x AS (SELECT *, 100 * s / sum(s) OVER (PARTITION BY p_brand)::DOUBLE AS exact FROM t),
f AS (SELECT *, floor(exact)::BIGINT AS base, row_number() OVER (PARTITION BY p_brand ORDER BY round(exact - floor(exact), 9) DESC, p_type) AS rn, 100 - sum(floor(exact)) OVER (PARTITION BY p_brand) AS rest FROM x)
SELECT p_brand, p_type, base + CASE WHEN rn <= rest THEN 1 ELSE 0 END AS points FROM f""",
)
def distribute_rounding(spark, d):
    terms = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.sum("p_size").alias("s"))
    return health.distribute(terms, "p_brand", "p_type", "s", 100)


@query(
    "catalog_drift",
    """WITH o AS (SELECT p_partkey AS slug, p_brand AS label FROM part WHERE p_partkey % 7 <> 0), n AS (SELECT p_partkey AS slug, CASE WHEN p_partkey % 11 = 0 THEN p_type ELSE p_brand END AS label FROM part WHERE p_partkey % 5 <> 0)
SELECT * FROM (SELECT coalesce(n.slug, o.slug) AS slug, CASE WHEN o.slug IS NULL THEN 'added' WHEN n.slug IS NULL THEN 'removed' WHEN o.label IS DISTINCT FROM n.label THEN 'changed' END AS change FROM o FULL JOIN n ON o.slug = n.slug) WHERE change IS NOT NULL""",
)
def catalog_drift(spark, d):
    p = table(spark, d, "part")
    old = p.filter("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("slug"), F.col("p_brand").alias("label"))
    new = p.filter("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("slug"), F.when(F.col("p_partkey") % 11 == 0, F.col("p_type")).otherwise(F.col("p_brand")).alias("label"))
    return full_diff(old, new, "slug", "label")


@query(
    "conversation_stats",
    """SELECT conv_id, count(*)::BIGINT AS messages, count(*) FILTER (WHERE role = 'assistant')::BIGINT AS rounds, sum(length(text))::BIGINT AS chars, left(trim(arg_min(text, turn) FILTER (WHERE role = 'user')), 40) AS preview FROM conversations GROUP BY conv_id""",
)
def conversation_stats(spark, d):
    c = table(spark, d, "conversations")
    first = F.min_by("text", F.when(F.col("role") == "user", F.col("turn")))
    return c.groupBy("conv_id").agg(F.count("*").alias("messages"), F.count_if(F.col("role") == "assistant").alias("rounds"), F.sum(F.length("text")).alias("chars"), F.left(F.trim(first), F.lit(40)).alias("preview"))


@query(
    "turn_log",
    "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text)::INTEGER AS seq FROM conversations",
)
def turn_log(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.row_number().over(w).alias("seq"))


@query(
    "overview_scalars",
    "SELECT (SELECT count(*) FROM orders)::BIGINT AS orders, (SELECT count(DISTINCT o_custkey) FROM orders)::BIGINT AS customers, (SELECT round(avg(v), 4) FROM (SELECT value AS v FROM events ORDER BY ts DESC, event_id DESC LIMIT 30)) AS recent, (SELECT max(o_orderdate) FROM orders) AS last",
)
def overview_scalars(spark, d):
    orders = table(spark, d, "orders").agg(F.count("*").alias("orders"), F.count_distinct("o_custkey").alias("customers"), F.max("o_orderdate").alias("last"))
    recent = table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(30).agg(F.round(F.avg("value"), 4).alias("recent"))
    return orders.join(F.broadcast(recent))  # one row by one row


@query(
    "profile_overview",
    f"""WITH p AS (SELECT l_suppkey, count(*) AS n, count(DISTINCT l_partkey) AS parts, min(l_extendedprice) AS low, max(l_extendedprice) AS high, quantile_cont(l_discount, 0.5) FILTER (WHERE l_returnflag = 'N') AS mid FROM lineitem GROUP BY l_suppkey),
t AS (SELECT l_suppkey, string_agg(l_partkey, ',' ORDER BY rn) AS top FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, {", ".join(c + " DESC" for c in LINE_ORDER[:5])}) AS rn FROM lineitem) WHERE rn <= 4 GROUP BY l_suppkey)
SELECT s_suppkey, coalesce(n, 0)::BIGINT AS n, coalesce(parts, 0)::BIGINT AS parts, low, high, mid, top FROM supplier LEFT JOIN p ON p.l_suppkey = s_suppkey LEFT JOIN t ON t.l_suppkey = s_suppkey""",
)
def profile_overview(spark, d):
    line = table(spark, d, "lineitem")
    mid = F.percentile(F.when(F.col("l_returnflag") == "N", F.col("l_discount")), 0.5)
    stats = line.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_distinct("l_partkey").alias("parts"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"), mid.alias("mid"))
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), *(F.desc(c) for c in LINE_ORDER[:5]))
    top = line.withColumn("rn", F.row_number().over(w)).filter("rn <= 4").groupBy("l_suppkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "l_partkey"))), lambda x: x["l_partkey"].cast("string")), ",").alias("top"))
    s = table(spark, d, "supplier").select("s_suppkey").join(stats, F.col("s_suppkey") == stats.l_suppkey, "left").drop("l_suppkey").join(top, F.col("s_suppkey") == top.l_suppkey, "left")
    return s.select("s_suppkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("parts", F.lit(0)).alias("parts"), "low", "high", "mid", "top")
