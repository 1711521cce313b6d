"""Ingest rules over split order lines and events; text normalisers over made-up strings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessaria.functions import text as T
from tessaria.operators import ingest, keyed, store
from tessaria.operators.workspace import Workspace
from tessaria.plans.registry import AS_OF, query
from tessaria.session import table

SPLIT = "1995-06-01"
LATEST_SQL = """(SELECT l_partkey, l_suppkey, arg_max(struct_pack(p := CASE WHEN l_orderkey %% 10 = 0 THEN NULL ELSE l_extendedprice / l_quantity END, f := CASE WHEN l_orderkey %% 3 = 0 THEN NULL ELSE l_linestatus END), o) AS r
  FROM (SELECT *, {'a': l_shipdate, 'b': l_orderkey, 'c': l_linenumber, 'd': l_extendedprice} AS o FROM lineitem WHERE %s) GROUP BY l_partkey, l_suppkey)"""


def latest_lines(spark, d, condition: str):
    price = F.when(F.col("l_orderkey") % 10 == 0, None).otherwise(F.col("l_extendedprice") / F.col("l_quantity"))
    feature = F.when(F.col("l_orderkey") % 3 == 0, None).otherwise(F.col("l_linestatus"))
    newest = F.max_by(F.struct(price.alias("price"), feature.alias("feature")), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice"))
    return table(spark, d, "lineitem").filter(condition).groupBy("l_partkey", "l_suppkey").agg(newest.alias("r")).select("l_partkey", "l_suppkey", "r.price", "r.feature")


@query(
    "canonical_upsert",
    f"""WITH o AS (SELECT l_partkey, l_suppkey, r.p AS price, r.f AS feature FROM {LATEST_SQL % f"l_shipdate < DATE '{SPLIT}'"}), n AS (SELECT l_partkey, l_suppkey, r.p AS price, r.f AS feature FROM {LATEST_SQL % f"l_shipdate >= DATE '{SPLIT}'"})
SELECT coalesce(n.l_partkey, o.l_partkey) AS l_partkey, coalesce(n.l_suppkey, o.l_suppkey) AS l_suppkey,
  CASE WHEN n.l_partkey IS NOT NULL AND coalesce(o.price IS NULL OR o.price <= 0 OR abs(n.price - o.price) / o.price BETWEEN 0.01::DOUBLE AND 0.6::DOUBLE, false) THEN coalesce(n.price, o.price) ELSE o.price END AS price,
  coalesce(n.feature, o.feature) AS feature,
  n.l_partkey IS NOT NULL AND coalesce(CASE WHEN o.price IS NULL OR o.price <= 0 THEN n.price IS NOT NULL AND n.price IS DISTINCT FROM o.price ELSE abs(n.price - o.price) / o.price >= 0.01::DOUBLE END, false) AS price_material,
  CASE WHEN n.l_partkey IS NULL THEN 'kept' WHEN o.l_partkey IS NULL THEN 'inserted' ELSE 'updated' END AS action
FROM o FULL JOIN n ON o.l_partkey = n.l_partkey AND o.l_suppkey = n.l_suppkey""",
)
def canonical_upsert(spark, d):
    old, new = latest_lines(spark, d, f"l_shipdate < DATE '{SPLIT}'"), latest_lines(spark, d, f"l_shipdate >= DATE '{SPLIT}'")
    return ingest.upsert(old, new, ["l_partkey", "l_suppkey"], "price", fill=["feature"])


@query(
    "counted_upsert",
    """WITH o AS (SELECT user_id, count(*) AS seen FROM events WHERE ts < TIMESTAMP '2024-01-10' AND user_id % 3 > 0 GROUP BY user_id), n AS (SELECT user_id, count(*) AS came FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY user_id)
SELECT coalesce(o.user_id, n.user_id) AS user_id, (coalesce(seen, 0) + coalesce(came, 0))::BIGINT AS seen, o.user_id IS NULL AS inserted FROM o FULL JOIN n ON o.user_id = n.user_id""",
)
def counted_upsert(spark, d):
    e = table(spark, d, "events")
    cut = F.expr("TIMESTAMP_NTZ '2024-01-10 00:00:00'")
    old = e.filter((F.col("ts") < cut) & (F.col("user_id") % 3 > 0)).groupBy("user_id").agg(F.count("*").alias("seen"))
    return ingest.counted_upsert(old, e.filter(F.col("ts") >= cut), "user_id", "seen")


@query(
    "do_nothing_upsert",
    """SELECT o_custkey, min(o_orderpriority) AS p FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1 UNION ALL SELECT o_custkey, max(o_orderpriority) FROM orders WHERE o_custkey % 3 = 0 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 2 = 0) GROUP BY 1""",
)
def do_nothing_upsert(spark, d):
    o = table(spark, d, "orders")
    old = o.filter("o_custkey % 2 = 0").groupBy("o_custkey").agg(F.min("o_orderpriority").alias("p"))
    new = o.filter("o_custkey % 3 = 0").groupBy("o_custkey").agg(F.max("o_orderpriority").alias("p"))
    return ingest.do_nothing_upsert(old, new, ["o_custkey"])


NEWEST_SQL = """(SELECT l_partkey, l_suppkey, arg_max(struct_pack(p := CASE WHEN l_orderkey %% 10 = 0 THEN NULL ELSE l_extendedprice / l_quantity END, f := CASE WHEN l_orderkey %% 3 = 0 THEN NULL ELSE l_linestatus END,
    t := CASE WHEN l_orderkey %% 4 = 0 THEN '' ELSE l_returnflag END, m := CASE WHEN l_orderkey %% 5 = 0 THEN NULL ELSE l_returnflag END, s := l_shipdate), {'a': l_shipdate, 'b': l_orderkey, 'c': l_linenumber, 'd': l_extendedprice}) AS r
  FROM lineitem WHERE l_shipdate %s GROUP BY l_partkey, l_suppkey)"""


@query(
    "write_path",
    f"""WITH o AS (SELECT l_partkey, l_suppkey, r.* FROM {NEWEST_SQL % f"< DATE '{SPLIT}'"}), n AS (SELECT l_partkey, l_suppkey, r.* FROM {NEWEST_SQL % f">= DATE '{SPLIT}'"})
SELECT coalesce(n.l_partkey, o.l_partkey) AS l_partkey, coalesce(n.l_suppkey, o.l_suppkey) AS l_suppkey,
  CASE WHEN n.l_partkey IS NOT NULL AND coalesce(o.p IS NULL OR o.p <= 0 OR abs(n.p - o.p) / o.p BETWEEN 0.01::DOUBLE AND 0.6::DOUBLE, false) THEN coalesce(n.p, o.p) ELSE o.p END AS price,
  coalesce(n.f, o.f) AS feature, coalesce(nullif(n.t, ''), o.t, n.t) AS tags, CASE WHEN n.l_partkey IS NOT NULL THEN n.m ELSE o.m END AS photo,
  coalesce(o.s, n.s)::DATE AS first_seen, greatest(o.s, n.s)::DATE AS last_seen, CASE WHEN n.l_partkey IS NULL THEN 1 ELSE 0 END AS missed,
  CASE WHEN n.l_partkey IS NULL THEN 1 ELSE 2 END AS delivery FROM o FULL JOIN n ON o.l_partkey = n.l_partkey AND o.l_suppkey = n.l_suppkey""",
)
def write_path(spark, d):
    """Two deliveries to a keyed table, a sweep that missed what the second lacks, and both deliveries once more."""
    keys = ["l_partkey", "l_suppkey"]
    # the columns of the order come first in the newest line, and its values are made once it is found
    newest = F.max(F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_linestatus", "l_returnflag"))
    odd = lambda k, c: F.when(F.col("r.l_orderkey") % k == 0, None).otherwise(F.col(f"r.{c}"))
    price = F.when(F.col("r.l_orderkey") % 10 != 0, F.col("r.l_extendedprice") / F.col("r.l_quantity"))
    tags = F.when(F.col("r.l_orderkey") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("r.l_returnflag"))
    values = {"price": price, "feature": odd(3, "l_linestatus"), "tags": tags, "photo": odd(5, "l_returnflag"), "seen": F.to_date("r.l_shipdate")}
    delivery = lambda condition: table(spark, d, "lineitem").filter(condition).groupBy(*keys).agg(newest.alias("r")).select(*keys, *(c.alias(n) for n, c in values.items()))
    first, second = delivery(f"l_shipdate < DATE '{SPLIT}'"), delivery(f"l_shipdate >= DATE '{SPLIT}'")
    columns = "l_partkey long, l_suppkey long, price double, feature string, tags array<string>, photo string, first_seen date, last_seen date, last_fetched date, missed int"
    kept = store.KeyedTable(spark, Workspace(spark, "listings").path, columns, keys, buckets=16)
    merge = store.canonical_merge(keys, "price", ["feature"], ["tags"], ["photo"])
    first, second = kept.staged(first), kept.staged(second)
    kept.apply(first, 1, merge)
    kept.update(kept.read().join(second.select(*keys), keys, "left_anti").withColumn("missed", F.col("missed") + 1))
    kept.apply(second, 2, merge)
    kept.apply(second, 2, merge)
    kept.apply(first, 1, merge)
    return kept.stored().select(*keys, "price", "feature", F.array_join("tags", "").alias("tags"), "photo", "first_seen", "last_seen", "missed", F.col("delivery").cast("int"))


@query(
    "keyed_conflicts",
    """WITH e AS (SELECT user_id, event_type, value, ts, event_id, ts < TIMESTAMP '2024-01-15' AS early FROM events),
f AS (SELECT early, user_id, event_type, arg_min(value, {'t': ts, 'e': event_id}) AS first, arg_max(value, {'t': ts, 'e': event_id}) AS last FROM e GROUP BY ALL)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, CASE WHEN a.user_id IS NOT NULL THEN a.first ELSE b.first END AS kept, CASE WHEN b.user_id IS NOT NULL THEN b.last ELSE a.last END AS latest
FROM (FROM f WHERE early) a FULL JOIN (FROM f WHERE NOT early) b ON a.user_id = b.user_id AND a.event_type = b.event_type""",
)
def keyed_conflicts(spark, d):
    """Two deliveries to two tables: one keeps the first row of a key, one takes the latest."""
    keys = ["user_id", "event_type"]
    e = table(spark, d, "events").select(*keys, "value", "ts", "event_id")
    out = []
    for name, last, merge in (("kept", False, store.keep_first(keys)), ("latest", True, store.latest_wins(keys))):
        t = store.KeyedTable(spark, Workspace(spark, name).path, "user_id long, event_type string, value double", keys, buckets=8)
        for number, early in ((1, "<"), (2, ">="), (2, ">=")):
            rows = e.filter(f"ts {early} TIMESTAMP_NTZ '2024-01-15 00:00:00'")
            t.apply(store.one_per_key(rows, keys, ["ts", "event_id"], last).select(*keys, "value"), number, merge)
        out.append(t.read().withColumnRenamed("value", name))
    return out[0].join(out[1], keys)


@query(
    "missed_discovery",
    """WITH s AS (SELECT DISTINCT user_id, date_diff('day', TIMESTAMP '2024-01-01', ts)::INT AS day FROM events), l AS (SELECT max(day) AS last FROM s),
g AS (SELECT user_id, coalesce(lead(day) OVER (PARTITION BY user_id ORDER BY day), last + 1) - day - 1 AS gap FROM s, l)
SELECT user_id, max(gap)::INTEGER AS misses, max(gap) >= 3 AS withdrawn FROM g GROUP BY user_id""",
)
def missed_discovery(spark, d):
    days = table(spark, d, "events").select("user_id", F.date_diff("ts", F.lit("2024-01-01").cast("date")).alias("day"))
    return ingest.missed_sweeps(days, "user_id", "day")


RUNS_SQL = "(SELECT user_id % 10 AS source, ts::DATE AS day, count(*) FILTER (WHERE event_type = 'error') AS gone, count(*) AS checked FROM events GROUP BY ALL)"


def runs(spark, d):
    e = table(spark, d, "events")
    return e.groupBy((F.col("user_id") % 10).alias("source"), F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "error").alias("gone"), F.count("*").alias("checked"))


@query(
    "mass_withdrawal_guard",
    f"""WITH w AS (SELECT *, coalesce(sum(gone) OVER w, 0) AS pg, coalesce(sum(checked) OVER w, 0) AS pc FROM {RUNS_SQL} WINDOW w AS (PARTITION BY source ORDER BY day ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING))
SELECT source, day, gone::BIGINT AS gone, checked::BIGINT AS checked, coalesce(gone >= 3 AND (gone / checked >= 0.8 OR (pc >= 20 AND gone / checked > pg / nullif(pc, 0) + 0.1)), false) AS held FROM w""",
)
def mass_withdrawal_guard(spark, d):
    """With a lower excess than production's 0.5, so that both outcomes occur here."""
    return ingest.mass_withdrawal(runs(spark, d), "source", "day", "gone", "checked", over=0.1)


@query(
    "skip_reason",
    f"""SELECT event_id, CASE WHEN event_type = 'purchase' THEN false WHEN value IS NULL THEN false WHEN json_extract_string(props, '$.k')::INT % 5 = 0 THEN false WHEN ts < TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY THEN false ELSE true END AS skip,
CASE WHEN event_type = 'purchase' THEN 'accepted' WHEN value IS NULL THEN 'price missing' WHEN json_extract_string(props, '$.k')::INT % 5 = 0 THEN 'list price' WHEN ts < TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY THEN 'stale' ELSE 'seen' END AS reason FROM events""",
)
def skip_reason(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    rules = [("accepted", False, F.col("event_type") == "purchase"), ("price missing", False, F.col("value").isNull()), ("list price", False, k % 5 == 0), ("stale", False, F.col("ts") < F.expr(f"TIMESTAMP_NTZ '{AS_OF}' - INTERVAL 10 DAYS"))]
    return table(spark, d, "events").select("event_id", ingest.skip_reason(rules).alias("r")).select("event_id", "r.skip", "r.reason")


SCORES_SQL = """(SELECT event_id, user_id % 10 AS source, ts::DATE AS day, (3 * (event_type <> 'error')::INT + 5 * (value > 20)::INT + 2 * (json_extract_string(props, '$.k')::INT % 3 > 0)::INT) / 10::DOUBLE AS score FROM events)"""


def scores(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, d, "events").withColumns({"f1": F.when(F.col("event_type") != "error", 1), "f2": F.when(F.col("value") > 20, 1), "f3": F.when(k % 3 > 0, 1)})
    return rows.select("event_id", (F.col("user_id") % 10).alias("source"), F.to_date("ts").alias("day"), ingest.quality_score({"f1": 3, "f2": 5, "f3": 2}).alias("score"))


@query(
    "quality_score",
    f"""SELECT grade, count(*)::BIGINT AS n, round(avg(score), 6) AS mean FROM (SELECT *, CASE WHEN score >= 0.85 THEN 'A' WHEN score >= 0.65 THEN 'B' WHEN score >= 0.45 THEN 'C' ELSE 'F' END AS grade FROM {SCORES_SQL}) GROUP BY grade""",
)
def quality_score(spark, d):
    return scores(spark, d).groupBy(ingest.grade(F.col("score")).alias("grade")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"))


@query(
    "run_summary",
    f"""WITH s AS (SELECT source, day, round(score, 2) AS score, CASE WHEN source < 5 THEN 2 ELSE 1 + event_id % 2 END AS v FROM {SCORES_SQL} WHERE event_id % 11 > 0)
SELECT source, day, count(*)::BIGINT AS n, round(avg(score), 3) AS mean_score, count(*) FILTER (WHERE score >= 0.85)::BIGINT AS grade_a, count(*) FILTER (WHERE score >= 0.65 AND score < 0.85)::BIGINT AS grade_b,
  count(*) FILTER (WHERE score >= 0.45 AND score < 0.65)::BIGINT AS grade_c, count(*) FILTER (WHERE score < 0.45)::BIGINT AS grade_f, count(*) FILTER (WHERE score < 0.65)::BIGINT AS low_quality,
  CASE WHEN count(DISTINCT v) = 1 THEN min(v) END::BIGINT AS weights_version FROM s GROUP BY source, day""",
)
def run_summary(spark, d):
    """A run per source and day; sources from 5 on mix two versions of the weights, every eleventh row has no score."""
    version = F.when(F.col("source") < 5, F.lit(2).cast("long")).otherwise(1 + F.col("event_id") % 2)
    rows = scores(spark, d).withColumn("score", F.when(F.col("event_id") % 11 > 0, F.round("score", 2))).withColumn("v", version)
    rows = rows.withColumn("run", F.struct("source", "day"))
    return ingest.run_summary(rows, "run", "score", "v").select("run.source", "run.day", "n", "mean_score", "grade_a", "grade_b", "grade_c", "grade_f", "low_quality", "weights_version")


@query(
    "quality_trend",
    f"""WITH r AS (SELECT source, day, round(avg(score), 6) AS mean FROM {SCORES_SQL} GROUP BY ALL),
b AS (SELECT *, CASE WHEN count(*) OVER w >= 2 THEN avg(mean) OVER w END AS baseline FROM r WINDOW w AS (PARTITION BY source ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
SELECT source, day, mean, round(baseline, 8) AS baseline, coalesce(mean - baseline <= -0.1, false) AS degraded FROM b""",
)
def quality_trend(spark, d):
    daily = scores(spark, d).groupBy("source", "day").agg(F.round(F.avg("score"), 6).alias("mean"))
    return ingest.quality_trend(daily, "source", "day", "mean").withColumn("baseline", F.round("baseline", 8))


FAIRNESS_SQL = "WITH a AS (SELECT c_custkey, max(ts) AS last FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY c_custkey) SELECT c_custkey, last, row_number() OVER (ORDER BY last ASC NULLS FIRST, c_custkey) AS turn FROM a"


@query("scope_fairness", FAIRNESS_SQL)
def scope_fairness(spark, d):
    """Every customer in turn: never attempted first, then by the oldest attempt."""
    c = table(spark, d, "customer").select("c_custkey")
    e = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    rows = c.join(e, c.c_custkey == e.user_id, "left").select("c_custkey", "last")
    return keyed.numbered(rows, (F.asc_nulls_first("last"), F.asc("c_custkey")), "turn")


@query(
    "freshness_cycle",
    """WITH t AS (SELECT DISTINCT user_id, event_type FROM events), c AS (SELECT DISTINCT user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-27')
SELECT user_id, count(*) FILTER (WHERE c.user_id IS NULL)::BIGINT AS missing, CASE WHEN count(c.user_id) = 0 THEN 'start' WHEN count(*) FILTER (WHERE c.user_id IS NULL) = 0 THEN 'skip' ELSE 'continue' END AS decision FROM t LEFT JOIN c USING (user_id, event_type) GROUP BY user_id""",
)
def freshness_cycle(spark, d):
    """A cycle is complete when every target has been discovered since it began. (The SQL counts c by its key.)"""
    e = table(spark, d, "events")
    per = e.groupBy("user_id", "event_type").agg(F.bool_or(F.col("ts") >= F.expr("TIMESTAMP_NTZ '2024-01-27 00:00:00'")).alias("found"))
    counts = per.groupBy("user_id").agg(F.count_if(~F.col("found")).alias("missing"), F.count_if("found").alias("done"))
    return counts.select("user_id", "missing", F.when(F.col("done") == 0, "start").when(F.col("missing") == 0, "skip").otherwise("continue").alias("decision"))


STARTS = ("C/ ", "Avda. ", "Pza. ", "Av. ", "CL. ", "cl ", "AV ", "c/", "Pº ", "Avenida ")
ADDRESS_SQL = f"(SELECT p_partkey, {list(STARTS)}[p_partkey % 10 + 1] || p_name || ', Nº ' || p_size || ' 3ª Málaga' AS a FROM part)"


def addresses(spark, d):
    start = F.element_at(F.array(*map(F.lit, STARTS)), (F.col("p_partkey") % 10 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", F.concat(start, "p_name", F.lit(", Nº "), F.col("p_size").cast("string"), F.lit(" 3ª Málaga")).alias("a"))


@query(
    "norm_address",
    f"""SELECT p_partkey, trim(regexp_replace(regexp_replace(replace(replace(strip_accents(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(a), '\\bc/(\\W|$)', 'calle\\1', 'g'), '\\bcl(\\. |\\.| )', 'calle ', 'g'),
  '\\bavda(\\. |\\.| )', 'avenida ', 'g'), '\\bav(\\. |\\.| )', 'avenida ', 'g'), '\\bpza(\\. |\\.| )', 'plaza ', 'g'), '\\bpº ', 'paseo ', 'g')), 'º', 'o'), 'ª', 'a'), '[^0-9a-z_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS address FROM {ADDRESS_SQL}""",
)
def norm_address(spark, d):
    return addresses(spark, d).select("p_partkey", T.normalize_address(F.col("a")).alias("address"))


FLOORS = ("Planta Baja", "BAJO B", "Ático", "Semisótano", "Sótano 2", "Entreplanta", "ª planta", None, "PB", "Semi-sótano", "03", "Entresuelo 1", "Principal", "Bajos", "bajo cubierta", " bj ", "A partir de la 15ª planta", "sin datos")
#: Per floor text: dedup's floor, scoring's number, the feed's ground flag. 'ª planta' has the part's size before it.
FLOOR_RESULTS = (
    ("bajo", 0, True), ("bajo", 0, True), ("atico", 50, False), ("semisotano", -0.5, True), ("sotano", -1, False), ("entresuelo", 0.5, True), (None, None, False), (None, None, False), (None, None, True),
    ("sotano", -0.5, False), ("3", 3, False), ("entresuelo", 0, True), ("principal", None, False), ("bajo", 0, True), ("bajo", 0, False), (None, None, True), ("15", 15, False), (None, None, False),
)
_sql_value = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
FLOOR_ROWS = ", ".join(f"({i}, {', '.join(map(_sql_value, r))})" for i, r in enumerate(FLOOR_RESULTS))


@query(
    "norm_floor",
    f"""SELECT p_partkey, CASE WHEN i = 6 THEN (p_size % 9)::VARCHAR ELSE floor END AS floor, CASE WHEN i = 6 THEN p_size % 9 ELSE number END::DOUBLE AS number, ground
FROM part JOIN (VALUES {FLOOR_ROWS}) r(i, floor, number, ground) ON p_partkey % {len(FLOORS)} = i""",
)
def norm_floor(spark, d):
    """Floor texts of portals; the twin lists what each has to give."""
    k = (F.col("p_partkey") % len(FLOORS)).cast("int")
    f = F.element_at(F.array(*map(F.lit, FLOORS)), k + 1)
    f = F.when(k == 6, F.concat((F.col("p_size") % 9).cast("string"), f)).otherwise(f)
    return table(spark, d, "part").select("p_partkey", f.alias("f")).select("p_partkey", T.normalize_floor(F.col("f")).alias("floor"), T.floor_number(F.col("f")).alias("number"), T.is_ground_floor(F.col("f")).alias("ground"))


@query(
    "ref_code_equiv",
    """WITH c AS (SELECT p_partkey AS k, 'x' || (p_partkey // 3) || CASE p_partkey % 3 WHEN 1 THEN '-1' WHEN 2 THEN '-2' ELSE '' END AS code FROM part),
b AS (SELECT *, CASE WHEN length(regexp_extract(code, '^(.+)[-_/][0-9a-z]{1,3}$', 1)) >= 4 THEN regexp_extract(code, '^(.+)[-_/][0-9a-z]{1,3}$', 1) END AS base FROM c)
SELECT a.k AS k, a.code = z.code OR coalesce(a.base IS NOT NULL AND z.base IS NULL AND a.base = z.code, false) OR coalesce(z.base IS NOT NULL AND a.base IS NULL AND z.base = a.code, false) AS same FROM b a JOIN b z ON z.k = a.k + 1""",
)
def ref_code_equiv(spark, d):
    k = F.col("p_partkey")
    suffix = F.when(k % 3 == 1, "-1").when(k % 3 == 2, "-2").otherwise("")
    c = table(spark, d, "part").select(k.alias("k"), F.concat(F.lit("x"), F.floor(k / 3).cast("string"), suffix).alias("code"))
    pairs = c.join(c.select((F.col("k") - 1).alias("k"), F.col("code").alias("next")), "k")
    return pairs.select("k", T.codes_equivalent(F.col("code"), F.col("next")).alias("same"))


#: Code texts (# stands for the part's key) and what each has to give.
CODES = (
    ("Ref: AB-#", "ab-#"), ("  Referencia #00X ", "#00x"), ("N/A", None), ("ab1", None), ("without", None), ("REFORMA-#", "reforma-#"), ("REF123#", "ref123#"), ("IDX-77#", "idx-77#"), ("ref.- 10#0", "10#0"),
    ("pendiente", None), ("sin referencia", None), ("0", None), ("ref", None), (None, None), ("Codigo #00", "codigo #00"), ("8385 11 #", "8385 11 #"), ("referencia", None),
)
CODE_ROWS = ", ".join(f"({i}, {_sql_value(x)})" for i, (_, x) in enumerate(CODES))


@query("norm_reference_code", f"SELECT p_partkey, replace(x, '#', p_partkey::VARCHAR) AS code FROM part JOIN (VALUES {CODE_ROWS}) r(i, x) ON p_partkey % {len(CODES)} = i")
def norm_reference_code(spark, d):
    k, s = (F.col("p_partkey") % len(CODES)).cast("int"), F.col("p_partkey").cast("string")
    c = F.element_at(F.array(*(F.lit(x) for x, _ in CODES)), k + 1)
    return table(spark, d, "part").select("p_partkey", T.normalize_reference_code(F.replace(c, F.lit("#"), s)).alias("code"))


@query(
    "phones",
    """WITH t AS (SELECT doc_id, ' ' || (600000000 + doc_id * 7919 % 99999999) || ' or +34 ' || substr((700000000 + doc_id * 104729 % 99999999)::VARCHAR, 1, 3) || '-' || substr((700000000 + doc_id * 104729 % 99999999)::VARCHAR, 4, 3) || '.' || substr((700000000 + doc_id * 104729 % 99999999)::VARCHAR, 7, 3) || ' id 1' || (600000000 + doc_id) AS s FROM documents),
m AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(s, '(?:^|[^0-9])((?:\\+34[\\s.-]?)?[6789][0-9]{2}[\\s.-]?[0-9]{3}[\\s.-]?[0-9]{3})(?:[^0-9]|$)', 1), lambda v: regexp_replace(v, '[^0-9]', '', 'g'))) AS n FROM t)
SELECT doc_id, string_agg(DISTINCT n, ',' ORDER BY n) AS phones FROM (SELECT doc_id, CASE WHEN length(n) = 11 THEN substr(n, 3) ELSE n END AS n FROM m) GROUP BY doc_id""",
)
def phones(spark, d):
    """A national number, one with prefix and separators, and a longer number that is none."""
    i = F.col("doc_id")
    other = (700000000 + i * 104729 % 99999999).cast("string")
    s = F.concat(F.lit(" "), (600000000 + i * 7919 % 99999999).cast("string"), F.lit(" or +34 "), F.substring(other, 1, 3), F.lit("-"), F.substring(other, 4, 3), F.lit("."), F.substring(other, 7, 3), F.lit(" id 1"), (600000000 + i).cast("string"))
    return table(spark, d, "documents").select("doc_id", F.array_join(T.extract_phones(s), ",").alias("phones"))


#: A page's text with some of the challenge's phrases put in by its key: none, one, two, one twice, or two within a script.
PLANTED = (
    "", "<p>Muchas peticiones</p>", "<p>¿Por qué esta verificación?</p><b>DESLIZA hacia la derecha</b>", "<p>en poco tiempo</p><p>en poco tiempo</p>",
    "<script>muchas peticiones en poco tiempo</script><noscript>velocidad sobrehumana</noscript>", "<i>Velocidad\n sobrehumana</i>, muchas   peticiones",
)
PLANTED_SQL = ", ".join("'" + x.replace("\n", "' || chr(10) || '") + "'" for x in PLANTED)
_BARE_SQL = "h"
for _tag in ("script", "style", "noscript"):
    _BARE_SQL = f"regexp_replace({_BARE_SQL}, '<{_tag}\\b.*?</{_tag}\\s*>', ' ', 'gis')"


@query(
    "soft_block",
    f"""WITH p AS (SELECT page_id, html || [{PLANTED_SQL}][page_id % {len(PLANTED)} + 1] AS h FROM pages),
t AS (SELECT page_id, trim(regexp_replace(strip_accents(lower(regexp_replace({_BARE_SQL}, '<[^>]*>', ' ', 'gs'))), '\\s+', ' ', 'g')) AS t FROM p)
SELECT page_id, length(t)::INTEGER AS n_visible, page_id % {len(PLANTED)} IN (2, 5) AS blocked FROM t""",
)
def soft_block(spark, d):
    """Visible text of pages, and whether two different phrases of the challenge stand in it."""
    more = F.element_at(F.array(*map(F.lit, PLANTED)), (F.col("page_id") % len(PLANTED) + 1).cast("int"))
    text = T.visible_text(F.concat("html", more))
    return table(spark, d, "pages").select("page_id", F.length(text).alias("n_visible"), (T.phrase_hits(text, T.CHALLENGE) >= T.CHALLENGE_HITS).alias("blocked"))


@query(
    "url_match_key",
    r"""SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\.', '') || regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/$', '') AS match_key FROM pages""",
)
def url_match_key(spark, d):
    return table(spark, d, "pages").select("page_id", T.match_key(F.col("url")).alias("match_key"))


@query(
    "scalar_normalisers",
    """SELECT p_partkey, nullif(regexp_replace(string_split(p_size || '.' || lpad((p_partkey % 1000)::VARCHAR, 3, '0') || ',50', ',')[1], '[^0-9]', '', 'g'), '')::BIGINT AS amount,
CASE WHEN length(upper('ab ' || lpad(p_partkey::VARCHAR, 18, '7'))) = 21 THEN 'AB' || lpad(p_partkey::VARCHAR, 18, '7') END AS cadastral,
CASE WHEN p_partkey % 8 < 4 THEN 'network' WHEN p_partkey % 8 < 7 THEN 'structure_change' ELSE 'other' END AS failure FROM part""",
)
def scalar_normalisers(spark, d):
    k = F.col("p_partkey")
    amount = F.concat(F.col("p_size").cast("string"), F.lit("."), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(",50"))
    messages = ("ReadTimeout json", "SSL certificate problem", "Host Unreachable", "ConnectionError: reset", "JSONDecodeError", "missing price", "KeyError 'ad'", "boom")
    message = F.element_at(F.array(*map(F.lit, messages)), (k % 8 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", T.spanish_number(amount).alias("amount"), T.normalize_cadastral(F.concat(F.lit("ab "), F.lpad(k.cast("string"), 18, "7"))).alias("cadastral"), T.failure_class(message).alias("failure"))


@query(
    "content_hash",
    """SELECT o_custkey, sha256('[' || string_agg('{"id":' || o_orderkey || ',"d":"' || trim(o_orderpriority) || '"}', ',' ORDER BY o_orderkey) || ']') AS hash FROM orders GROUP BY o_custkey""",
)
def content_hash(spark, d):
    lists = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("text"))).alias("rows"))
    return lists.select("o_custkey", T.content_hash("rows").alias("hash"))
