"""Smaller query parts: fetch decisions, feature vectors, chart series, ordered JSON, average ratios, option lists, addresses
of searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessaria.functions import urls
from tessaria.operators import ingest, scoring
from tessaria.plans.registry import AS_OF, query
from tessaria.session import table


@query(
    "fetch_decision",
    f"""WITH x AS (SELECT event_id AS id, event_id % 17 = 0 AS backfills, CASE WHEN event_id % 3 > 0 THEN 'r' END AS code, event_id % 13 = 0 AS accepted, CASE WHEN event_id % 11 > 0 THEN ts END AS fetched, CASE event_id % 10 WHEN 0 THEN 'withdrawn' WHEN 1 THEN NULL ELSE 'active' END AS status,
  CASE WHEN event_id % 4 = 0 THEN 100 + event_id % 3 * 0.6::DOUBLE END AS listed, CASE WHEN event_id % 7 > 0 THEN 100.0 END::DOUBLE AS stored, CASE WHEN event_id % 5 = 0 THEN ts + INTERVAL 1 SECOND WHEN event_id % 5 = 1 THEN ts END AS observed, CASE WHEN event_id % 9 = 0 THEN 0 ELSE 864000 END AS every FROM events),
d AS (SELECT id, CASE WHEN backfills AND code IS NULL THEN (false, 'reference code') WHEN accepted THEN (false, 'accepted') WHEN fetched IS NULL THEN (false, 'never fetched') WHEN status <> 'active' THEN (false, 'not active')
  WHEN listed IS NOT NULL THEN CASE WHEN stored IS NULL THEN (false, 'price missing') WHEN listed > 101 THEN (false, 'list price changed') ELSE (true, 'list price unchanged') END
  WHEN every <= 0 THEN (false, 'always') WHEN stored IS NULL THEN (false, 'price missing') WHEN observed > fetched THEN (false, 'unconfirmed') WHEN date_diff('second', fetched, TIMESTAMP '{AS_OF}') >= every THEN (false, 'stale') ELSE (true, 'fresh') END AS r FROM x)
SELECT id, r[1] AS skip, r[2] AS reason FROM d""",
)
def fetch_decision(spark, d):
    k = F.col("event_id")
    rows = table(spark, d, "events").select(
        k.alias("id"), (k % 17 == 0).alias("backfills_code"), F.when(k % 3 > 0, "r").alias("code"), (k % 13 == 0).alias("accepted"), F.when(k % 11 > 0, F.col("ts")).alias("fetched"),
        F.when(k % 10 == 0, "withdrawn").when(k % 10 > 1, "active").alias("status"), F.when(k % 4 == 0, 100 + k % 3 * F.lit(0.6)).alias("listed"), F.when(k % 7 > 0, 100.0).alias("price"),
        F.when(k % 5 == 0, F.col("ts") + F.expr("INTERVAL 1 SECOND")).when(k % 5 == 1, F.col("ts")).alias("observed"), F.when(k % 9 == 0, 0).otherwise(864000).alias("refetch_seconds"),
    )
    return rows.select("id", ingest.skip_reason(ingest.fetch_rules(F.expr(f"TIMESTAMP_NTZ '{AS_OF}'"))).alias("r")).select("id", "r.skip", "r.reason")


@query(
    "feature_vector",
    """WITH x AS (SELECT p_partkey AS k, p_retailprice AS price, CASE WHEN p_partkey % 9 > 0 THEN p_size END AS m2 FROM part)
SELECT k, round(CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN price / 1000 WHEN 2 THEN price / m2 / (1000 / 25::DOUBLE) ELSE CASE WHEN m2 IS NULL THEN price / 1200 ELSE price / m2 / (1200 / m2::DOUBLE) END END, 8) AS f0, m2::DOUBLE AS f1, (m2 % 6)::DOUBLE AS f2, [0, 3, NULL, 50][k % 4 + 1]::DOUBLE AS f3, CASE k % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END::DOUBLE AS f4, 1950 + k % 70::DOUBLE AS f5, (k % 200)::DOUBLE AS f6, (k % 40) / 100::DOUBLE AS f7 FROM x""",
)
def feature_vector(spark, d):
    """The eight features of a part under four kinds of scope: none, a price band, both bands, a lowest price with sizes."""
    k, m2 = F.col("p_partkey"), F.when(F.col("p_partkey") % 9 > 0, F.col("p_size"))
    rows = table(spark, d, "part").select(
        k.alias("k"), F.col("p_retailprice").alias("price"), m2.alias("m2"), (m2 % 6).alias("rooms"), F.element_at(F.array(F.lit("Bajo A"), F.lit("3º"), F.lit("?"), F.lit("Ático")), (k % 4 + 1).cast("int")).alias("floor"),
        F.when(k % 3 < 2, k % 3 == 0).alias("elevator"), (1950 + k % 70).alias("year"), (k % 200).alias("days"), (k % 40 / 100).alias("drop"),
        F.when(k % 4 > 0, F.when(k % 4 == 3, 1200.0).otherwise(800.0)).alias("price_min"), F.when(k % 4 == 3, None).when(k % 4 > 0, 1200.0).alias("price_max"),
        F.when(k % 4 == 2, 20.0).alias("size_min"), F.when(k % 4 == 2, 30.0).when(k % 4 == 3, m2.cast("double")).alias("size_max"),
    )
    features = scoring.raw_features()
    return rows.select("k", *((F.round(c, 8) if i == 0 else c).alias(f"f{i}") for i, c in enumerate(features)))


@query(
    "chart_series",
    """WITH p AS (SELECT user_id % 40 AS x, count(*) AS y FROM events WHERE event_type = 'view' GROUP BY 1), c AS (SELECT user_id % 40 AS x, arg_max(CASE WHEN event_id % 6 > 0 THEN value END, {'a': ts, 'b': event_id}) AS y FROM events WHERE event_type = 'purchase' AND user_id % 40 < 30 GROUP BY 1)
SELECT p.x::VARCHAR AS x, p.y::DOUBLE AS y, (SELECT v FROM (SELECT value AS v, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS rn FROM events e WHERE e.event_type = 'purchase' AND e.user_id % 40 = p.x AND e.event_id % 6 > 0 AND e.user_id % 40 < 30) WHERE rn = 1) AS y_comparison FROM p""",
)
def chart_series(spark, d):
    """A series and its comparison by the text of x: rows without y count for nothing, and of the others the last wins."""
    e = table(spark, d, "events")
    primary = e.filter("event_type = 'view'").groupBy((F.col("user_id") % 40).alias("x")).agg(F.count("*").cast("double").alias("y"))
    compared = e.filter("event_type = 'purchase' AND user_id % 40 < 30").select((F.col("user_id") % 40).alias("x"), F.when(F.col("event_id") % 6 > 0, F.col("value")).alias("y"), F.struct("ts", "event_id").alias("order"))
    return ingest.chart_merge(primary, compared, "x", "y", "order")


@query(
    "ordered_json",
    """SELECT user_id, '[' || string_agg('{"id":' || event_id || ',"type":"' || event_type || '"}', ',' ORDER BY event_id) || ']' AS events, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS types FROM events WHERE value > 20 GROUP BY user_id""",
)
def ordered_json(spark, d):
    """A user's rows as ordered JSON, and the distinct types among them as one text."""
    rows = table(spark, d, "events").filter("value > 20")
    entries = F.array_sort(F.collect_list(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))))
    return rows.groupBy("user_id").agg(F.to_json(entries).alias("events"), F.array_join(F.array_sort(F.collect_set("event_type")), "|").alias("types"))


@query(
    "average_of_ratios",
    "WITH r AS (SELECT user_id % 20 AS portal, user_id, count(*) FILTER (WHERE event_type = 'error') AS bad, count(*) FILTER (WHERE event_type <> 'view') AS n FROM events GROUP BY ALL) SELECT portal, round(avg(bad / nullif(n, 0)::DOUBLE), 8) AS mean, round(sum(bad) / nullif(sum(n), 0)::DOUBLE, 8) AS pooled FROM r GROUP BY portal",
)
def average_of_ratios(spark, d):
    """Per portal the mean of its users' failure shares (users without tries aside), and the share of all tries."""
    per = table(spark, d, "events").groupBy((F.col("user_id") % 20).alias("portal"), "user_id").agg(F.count_if(F.col("event_type") == "error").alias("bad"), F.count_if(F.col("event_type") != "view").alias("n"))
    return per.groupBy("portal").agg(F.round(F.avg(F.try_divide("bad", "n")), 8).alias("mean"), F.round(F.try_divide(F.sum("bad"), F.sum("n")), 8).alias("pooled"))


@query(
    "filter_options",
    "SELECT 'segment' AS filter, c_mktsegment AS value, count(*)::BIGINT AS n FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY ALL UNION ALL SELECT 'nation', n_name, count(DISTINCT c_custkey)::BIGINT FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY n_name UNION ALL SELECT 'status', o_orderstatus, count(*)::BIGINT FROM orders GROUP BY o_orderstatus",
)
def filter_options(spark, d):
    """Options of three filters: a plain list, one over a star join, one of a fact column."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    bought = c.join(o.select(F.col("o_custkey").alias("c_custkey")).distinct(), "c_custkey", "left_semi").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    option = lambda df, name, column: df.filter(F.col(column).isNotNull()).groupBy(F.lit(name).alias("filter"), F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return option(c, "segment", "c_mktsegment").unionByName(option(bought, "nation", "n_name")).unionByName(option(o, "status", "o_orderstatus"))


TEMPLATE = "https://portal.es/{operation}/{place}-{section}/id-{id}"


@query(
    "search_urls",
    """WITH x AS (SELECT page_id AS k, CASE page_id % 6 WHEN 0 THEN 'http://portal.es/venta/malaga-centro/id-' || page_id WHEN 1 THEN 'https://other.es/venta/malaga-centro/id-1' WHEN 2 THEN 'https://portal.es/venta/malaga/' || page_id WHEN 3 THEN NULL ELSE 'https://portal.es/alquiler/el-ejido-playa/id-' || page_id END AS url FROM pages)
SELECT k, CASE WHEN k % 6 > 3 THEN 'alquiler' END AS operation, CASE WHEN k % 6 > 3 THEN 'el-ejido' END AS place, CASE WHEN k % 6 > 3 THEN 'playa' END AS section, CASE WHEN k % 6 > 3 THEN k::VARCHAR END AS id, CASE k % 6 WHEN 0 THEN 'scheme' WHEN 1 THEN 'host' WHEN 2 THEN 'path' WHEN 3 THEN 'missing' END AS rejected,
  'https://portal.es/venta/a%20b-c%2Fd/id-' || k AS built FROM x""",
)
def search_urls(spark, d):
    """Addresses of searches read by a template, why others are rejected, and addresses built from the same template."""
    k = F.col("page_id")
    key = k.cast("string")
    url = F.when(k % 6 == 0, F.concat(F.lit("http://portal.es/venta/malaga-centro/id-"), key)).when(k % 6 == 1, "https://other.es/venta/malaga-centro/id-1").when(k % 6 == 2, F.concat(F.lit("https://portal.es/venta/malaga/"), key)).when(k % 6 > 3, F.concat(F.lit("https://portal.es/alquiler/el-ejido-playa/id-"), key))
    read = urls.parse(TEMPLATE, url)
    built = urls.build(TEMPLATE, {"operation": F.lit("venta"), "place": F.lit("a b"), "section": F.lit("c/d"), "id": key})
    return table(spark, d, "pages").select(k.alias("k"), *(read[n].alias(n) for n in ("operation", "place", "section", "id")), urls.rejection(TEMPLATE, url).alias("rejected"), built.alias("built"))
