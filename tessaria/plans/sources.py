"""Source readers over the pages table, and streaming jobs over events run to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessaria.operators.workspace import Workspace, shared_folder
from tessaria.plans.registry import query
from tessaria.plans.relational import SESSIONS_SQL
from tessaria.session import table
from tessaria.sources import connectors, readers, sitemaps
from tessaria.streaming import captures, jobs, stateful


@query("page_titles")
def page_titles(spark, d):
    """Title, heading and text of every page by selectors with fallbacks."""
    found = readers.select_texts(table(spark, d, "pages"), "page_id", "html", {"title": ("title", "h1"), "body": ("main", "article", "body")})
    return found.select("page_id", "title", F.length("body").alias("n_body"))


@query(
    "sitemap_reconcile",
    """WITH f AS (SELECT DISTINCT url FROM pages WHERE page_id % 4 <> 0), k AS (SELECT DISTINCT url FROM pages WHERE page_id % 3 <> 0)
SELECT coalesce(f.url, k.url) AS url, CASE WHEN k.url IS NULL THEN 'added' WHEN f.url IS NULL THEN 'stale' ELSE 'known' END AS state FROM f FULL JOIN k ON f.url = k.url""",
)
def sitemap_reconcile(spark, d):
    """Sitemap documents made of page addresses, read back and held against the listed ones."""
    p = table(spark, d, "pages")
    maps = p.filter("page_id % 4 <> 0").select(F.concat(F.lit("<url><loc> "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit(" </loc></url>")).alias("xml"))
    found = maps.select(F.explode(readers.sitemap_locations(F.col("xml"))).alias("url"))
    return readers.reconcile_worklist(found, p.filter("page_id % 3 <> 0"), "url")


@query(
    "circuit_breaker",
    """SELECT user_id, event_id, count(*) OVER w >= 20 AND avg((event_type = 'error')::INT) OVER w > 0.25 AS open FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
)
def circuit_breaker(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("failed"))
    return readers.breaker(e, "user_id", "event_id", "failed", limit=0.25).drop("failed")


def _events(spark, d):
    return jobs.event_source(spark, f"{d}/events.parquet")


def _finished(spark, stream, mode):
    """A stream's results once its input is read; each run has a folder of its own in the shared one."""
    return jobs.run_to_table(stream, mode, f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}")


@query("stream_day_counts", "SELECT event_type, ts::DATE AS day, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def stream_day_counts(spark, d):
    return _finished(spark, jobs.day_counts(_events(spark, d), "event_type"), "complete").select("event_type", F.to_date("day").alias("day"), "n")


@query(
    "stream_sessions",
    f"SELECT user_id, session_day AS day, count(*)::BIGINT AS n, min(ts) AS started, max(ts) AS ended FROM (SELECT *, (ts + INTERVAL 1 HOUR)::DATE AS session_day FROM {SESSIONS_SQL}) GROUP BY user_id, session, session_day",
)
def stream_sessions(spark, d):
    """Gaps of exactly 30 minutes do not occur in these events, so both readings of the bound agree."""
    return _finished(spark, jobs.sessions(_events(spark, d), "user_id"), "complete")


@query("stream_last_seen", "SELECT user_id, max(ts) AS last_seen FROM events GROUP BY user_id")
def stream_last_seen(spark, d):
    return _finished(spark, jobs.last_seen(_events(spark, d), "user_id"), "complete")


@query("stream_price_state")
def stream_price_state(spark, d):
    """Keyed state has no SQL twin; tests hold it against a plain loop."""
    rows = _finished(spark, jobs.price_state(_events(spark, d), "user_id", "value", "event_id"), "update")
    return rows.groupBy("user_id").agg(F.max_by("price", "changes").alias("price"), F.max("changes").alias("changes"))


@query(
    "stream_failures",
    """WITH e AS (SELECT user_id, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)
SELECT user_id, (max(i) - coalesce(max(i) FILTER (WHERE NOT bad), 0))::BIGINT AS failures FROM e GROUP BY user_id""",
)
def stream_failures(spark, d):
    """Failures in a row at the end of each user's events; no user is silent for as long as the state's lifetime here."""
    stateful.use_rocksdb(spark)
    stream = _events(spark, d).withColumn("bad", F.col("event_type") == "error")
    return _finished(spark, stateful.failures(stream, "user_id", "bad", "event_id", days=400), "update").filter("NOT gone").select("user_id", "failures")


@query(
    "stream_missed_sweeps",
    """WITH s AS (SELECT DISTINCT user_id % 10 AS source, date_diff('day', DATE '2024-01-01', ts::DATE) AS sweep, user_id AS id FROM events),
n AS (SELECT source, sweep, row_number() OVER (PARTITION BY source ORDER BY sweep) AS k FROM (SELECT DISTINCT source, sweep FROM s)),
g AS (SELECT source, id, k, lead(k) OVER (PARTITION BY source, id ORDER BY k) AS next FROM s JOIN n USING (source, sweep))
SELECT g.source::BIGINT AS source, n.sweep::BIGINT AS sweep, id::BIGINT AS id FROM g JOIN n ON g.source = n.source AND n.k = g.k + 3 WHERE coalesce(next > g.k + 3, true)""",
)
def stream_missed_sweeps(spark, d):
    """Users as ids and days as sweeps of ten sources: who was missed three times in a row, and when."""
    stateful.use_rocksdb(spark)
    e = table(spark, d, "events")
    sweeps = e.groupBy((F.col("user_id") % 10).alias("source"), F.date_diff("ts", F.lit("2024-01-01").cast("date")).cast("long").alias("sweep")).agg(F.collect_set("user_id").alias("found"))
    space = Workspace(spark, "sweeps")
    written = space.write(sweeps, "sweeps")
    stream = spark.readStream.schema(written.schema).parquet(f"{space.path}/sweeps")
    return _finished(spark, stateful.missed_sweeps(stream), "append")


@query(
    "stream_visits",
    """WITH e AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 30 MINUTE, true) AS new FROM events),
v AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS back FROM e WHERE new)
SELECT user_id, max(ts) FILTER (WHERE back = 1) AS current, max(ts) FILTER (WHERE back = 2) AS previous FROM v GROUP BY user_id""",
)
def stream_visits(spark, d):
    """The visit anchor as a stream; the last row that each user's state gave."""
    stateful.use_rocksdb(spark)
    rows = _finished(spark, stateful.visits(_events(spark, d), "user_id", 30, "400 days"), "update")
    last = rows.groupBy("user_id").agg(F.max_by(F.struct("current", "previous"), F.struct("seen", "current")).alias("v"))
    when = lambda c: F.timestamp_micros(F.col(f"v.{c}")).cast("timestamp_ntz").alias(c)
    return last.select("user_id", when("current"), when("previous"))


@query(
    "sitemap_frontier",
    """WITH p AS (SELECT url, page_id // 20 AS leaf, page_id // 160 AS mid FROM pages)
SELECT url AS loc, (CASE WHEN min(mid % 3) = 0 THEN 2 ELSE 3 END)::INT AS depth, count(DISTINCT leaf)::BIGINT AS listed_in FROM p WHERE leaf % 5 <> 4 GROUP BY url""",
)
def sitemap_frontier(spark, d):
    """Page locations through a root, nested indexes and leaves of stored sitemaps. Indexes list their root again (a cycle) and a
    leaf of the next index (a repeat); two of three come through one index more; every fifth leaf is not stored."""
    p = table(spark, d, "pages").select("url", F.floor(F.col("page_id") / 20).alias("leaf"), F.floor(F.col("page_id") / 160).alias("mid"))
    entry = lambda kind, loc: F.concat(F.lit(f"<{kind}><loc> "), F.replace(loc, F.lit("&"), F.lit("&amp;")), F.lit(f" </loc></{kind}>"))
    name = lambda kind, c: F.concat(F.lit(f"{kind}-"), F.col(c).cast("string"))
    document = lambda rows, url, parts: rows.groupBy(url.alias("url")).agg(F.array_join(F.collect_list(parts), "\n").alias("xml"))
    leaves = document(p.filter("leaf % 5 <> 4"), name("leaf", "leaf"), entry("url", F.col("url")))
    pairs = p.select("leaf", "mid").distinct()
    indexes = document(pairs, name("mid", "mid"), F.concat(entry("sitemap", name("leaf", "leaf")), entry("sitemap", F.lit("root"))))
    mids = p.select("mid").distinct()
    far = mids.filter("mid % 3 > 0").select(name("far", "mid").alias("url"), entry("sitemap", name("mid", "mid")).alias("xml"))
    root = document(mids, F.lit("root"), entry("sitemap", F.when(F.col("mid") % 3 > 0, name("far", "mid")).otherwise(name("mid", "mid"))))
    stored = leaves.unionByName(indexes).unionByName(far).unionByName(root)
    _, found = sitemaps.frontier(stored, spark.createDataFrame([("root",)], "url string"))
    return found.select("loc", "depth", "listed_in")


PAGE_SQL = r"""p AS (SELECT page_id, url, html, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
s AS (SELECT *, CASE WHEN regexp_matches(host, '(^|\.)example\.org$') THEN 'gallery' WHEN regexp_matches(host, '(^|\.)example\.net$') THEN 'tracker' WHEN regexp_matches(host, '(^|\.)example\.com$') THEN 'captured' END AS source,
  host || ':' || regexp_extract(path, '/([A-Za-z0-9]+)/?$', 1) AS external_id, trim(path, '/').split('/')[1] AS section, regexp_extract(html, 'track\((\d+)\)', 1) AS number, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
  list_transform(regexp_extract_all(html, '<a href="([^"]*)"', 1), lambda x: regexp_extract(url, '^[^/]*//[^/?#]*', 0) || x) AS links FROM p WHERE regexp_matches(path, '/[A-Za-z0-9]+/?$'))"""


@query(
    "connector_listings",
    rf"""WITH {PAGE_SQL}, v AS (SELECT * FROM (VALUES ('gallery', 'es', 'piso'), ('gallery', 'en', 'casa'), ('gallery', 'fr', 'terreno'), ('tracker', 'en', 'piso'), ('tracker', 'de', 'local'), ('tracker', 'es', 'casa'), ('captured', 'fr', 'garaje')) t(source, word, property_type)),
r AS (SELECT *, CASE WHEN source = 'gallery' THEN lang ELSE section END AS word, number::BIGINT AS no FROM s WHERE source IS NOT NULL AND (source = 'gallery' OR number <> ''))
SELECT source, external_id, url, 'active' AS status, CASE WHEN source <> 'gallery' AND regexp_matches(url, '\?.*page=') THEN 'rent' ELSE 'sale' END AS operation,
  CASE WHEN source = 'gallery' THEN CASE WHEN url LIKE 'https%' THEN 'agency' ELSE 'particular' END END AS listing_kind, property_type,
  CASE WHEN source <> 'gallery' THEN no * 100.0::DOUBLE END AS current_price, CASE WHEN source = 'gallery' THEN len(links)::INT WHEN no % 6 > 0 THEN (no % 6)::INT END AS rooms,
  CASE WHEN source = 'gallery' THEN array_to_string(list_sort(list_distinct(list_transform(links, lambda x: lower(x.split('/')[-1])))), ',') ELSE '' END AS features,
  CASE WHEN source = 'gallery' THEN array_to_string(links[1:3], ',') ELSE '' END AS photo_urls
FROM r LEFT JOIN v USING (source, word)""",
)
def connector_listings(spark, d):
    """Three sites of two payloads from stored pages, through the Python data source, as canonical listings."""
    rows = connectors.normalize(connectors.pages(spark, f"{d}/pages.parquet"), connectors.vocabulary(spark))
    listed = lambda c: F.array_join(c, ",").alias(c)
    return rows.select("source", "external_id", "url", "status", "operation", "listing_kind", "property_type", "current_price", "rooms", F.array_join(F.array_sort("features"), ",").alias("features"), listed("photo_urls"))


@query("connector_discovery", rf"WITH {PAGE_SQL} SELECT source, external_id, min(url) AS url FROM s WHERE source = 'gallery' OR (source = 'tracker' AND number <> '') GROUP BY source, external_id")
def connector_discovery(spark, d):
    return connectors.discovered(connectors.pages(spark, f"{d}/pages.parquet"))


def _captures(spark, d):
    """Pages as a queue of captures, a minute apart; every seventeenth is a challenge."""
    stream = jobs.event_source(spark, f"{d}/pages.parquet", at=None)
    challenge = F.when(F.col("page_id") % 17 == 0, "<p>Muchas peticiones</p><p>en poco tiempo</p>").otherwise("")
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 60)
    return stream.select(F.col("page_id").alias("capture_id"), "url", F.concat("html", challenge).alias("html"), at.alias("at"))


def _worked(spark, d):
    few = (F.length("html") - F.length(F.replace("html", F.lit("<p>")))) / 3 < 3
    return captures.work(spark, _captures(spark, d), f"{shared_folder(spark)}/captures-{uuid.uuid4().hex}", F.col("url").contains("page="), few, batch=200)


OUTCOMES_SQL = r"""p AS (SELECT page_id, url, html, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, TIMESTAMP '2024-01-01' + to_minutes(page_id) AS seen FROM pages),
k AS (SELECT *, CASE WHEN regexp_matches(host, '(^|\.)example\.org$') THEN 'gallery' WHEN regexp_matches(host, '(^|\.)example\.net$') THEN 'tracker' WHEN regexp_matches(host, '(^|\.)example\.com$') THEN 'captured' END AS source,
  regexp_matches(path, '/[A-Za-z0-9]+/?$') AND regexp_matches(host, '(^|\.)example\.(org|net|com)$') AND url NOT LIKE '%page=%' AS detail, host || ':' || regexp_extract(path, '/([A-Za-z0-9]+)/?$', 1) AS id FROM p),
o AS (SELECT *, CASE WHEN NOT detail AND source IS NOT NULL THEN 'listing' WHEN NOT detail THEN 'failed' WHEN page_id % 17 = 0 THEN 'blocked' WHEN (length(html) - length(replace(html, '<p>', ''))) / 3 < 3 THEN 'withdrawn'
  WHEN CASE WHEN source = 'gallery' THEN html NOT LIKE '%<title>%' ELSE NOT regexp_matches(html, 'track\(\d+\)') END THEN 'failed' ELSE 'done' END AS status FROM k)"""


@query(
    "capture_outcomes",
    rf"""WITH {OUTCOMES_SQL} SELECT page_id AS capture_id, status, source, CASE WHEN status <> 'listing' AND source IS NOT NULL AND regexp_matches(path, '/[A-Za-z0-9]+/?$') THEN id END AS external_id,
  CASE WHEN status = 'failed' THEN CASE WHEN source IS NULL THEN 'unknown address' ELSE 'no payload' END END AS reason FROM o""",
)
def capture_outcomes(spark, d):
    """The capture queue as a stream, worked off in claims: each page done, listing, blocked, withdrawn or failed."""
    return _worked(spark, d).select("capture_id", "status", "source", "external_id", "reason")


@query(
    "capture_sightings",
    rf"""WITH {OUTCOMES_SQL}, s AS (SELECT source, id AS external_id, seen FROM o WHERE status = 'done' UNION ALL
  SELECT source, host || ':' || unnest(regexp_extract_all(html, '<a href="/(?:[^"?#]*/)?([A-Za-z0-9]+)/?"', 1)), seen FROM o WHERE status = 'listing')
SELECT source, external_id, max(seen) AS last_seen FROM s GROUP BY source, external_id""",
)
def capture_sightings(spark, d):
    return captures.sightings(_worked(spark, d)).withColumn("last_seen", F.col("last_seen").cast("timestamp_ntz"))


@query("stream_trailing_counts", "SELECT event_type, (ts::DATE + k::INT)::TIMESTAMP AS until, count(*)::BIGINT AS n FROM events, range(1, 8) r(k) GROUP BY ALL")
def stream_trailing_counts(spark, d):
    """Sliding windows of seven days, a day apart."""
    return _finished(spark, jobs.trailing_counts(_events(spark, d), "event_type"), "complete").select("event_type", F.col("until").cast("timestamp_ntz").alias("until"), "n")


@query("stream_first_arrivals", "SELECT DISTINCT user_id, event_type FROM events")
def stream_first_arrivals(spark, d):
    """One row per key; here all rows arrive in one trigger, within the watermark."""
    return _finished(spark, jobs.first_arrivals(_events(spark, d), ["user_id", "event_type"]), "append").select("user_id", "event_type")


@query("embedded_props", "SELECT p_partkey AS id, p_name AS name, p_retailprice AS price, p_size % 3 = 0 AS lift, CASE WHEN p_partkey % 7 > 0 THEN p_size END AS size FROM part WHERE p_partkey % 11 > 0")
def embedded_props(spark, d):
    """Listing pages that carry their record as JSON in a script, one kind by assignment, one by element id, read back."""
    k = F.col("p_partkey")
    body = F.to_json(F.struct(k.alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"), (F.col("p_size") % 3 == 0).alias("lift"), F.when(k % 7 > 0, F.col("p_size")).alias("size")))
    page = F.when(k % 11 == 0, "<html><body>none</body></html>").when(k % 2 == 0, F.concat(F.lit("<script>window.__INITIAL_PROPS__ = "), body, F.lit(";</script><p>x</p>"))).otherwise(F.concat(F.lit('<script type="application/json" id="__NEXT_DATA__">'), body, F.lit("</script>")))
    schema = "id long, name string, price double, lift boolean, size int"
    found = F.coalesce(readers.embedded_json(F.col("html"), "window.__INITIAL_PROPS__", schema), readers.script_json(F.col("html"), "__NEXT_DATA__", schema))
    return table(spark, d, "part").select(page.alias("html")).select(found.alias("r")).filter("r IS NOT NULL").select("r.*")


@query("paged_json", "SELECT c_custkey AS id, c_name AS name, round(c_acctbal, 2) AS balance FROM customer")
def paged_json(spark, d):
    """Result pages of a JSON interface, fifty rows each, from files."""
    c = table(spark, d, "customer")
    row = F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.round("c_acctbal", 2).alias("balance"))
    pages = c.groupBy(F.floor(F.col("c_custkey") / 50).alias("page")).agg(F.collect_list(row).alias("items"), F.count("*").alias("n"))
    path = Workspace(spark, "paged").path
    pages.write.json(f"{path}/pages")
    return readers.json_pages(spark, f"{path}/pages", "items", "page long, n long, items array<struct<id:long,name:string,balance:double>>", lines=True)


@query("gazetteer_places", "SELECT n_name AS name, r_name AS province, 36 + n_nationkey % 9 AS lat, -9 + n_nationkey % 12 AS lon, n_nationkey * 1000 AS population FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 7 > 0 UNION ALL SELECT n_name, NULL, 36 + n_nationkey % 9, -9 + n_nationkey % 12, NULL FROM nation WHERE n_nationkey % 7 = 0")
def gazetteer_places(spark, d):
    """A gazetteer written as CSV and read by its schema; blank cells are null."""
    n = F.col("n_nationkey").cast("long")
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    known = n % 7 > 0
    path = Workspace(spark, "gazetteer").path
    rows.select(F.col("n_name").alias("name"), F.when(known, F.col("r_name")).alias("province"), (36 + n % 9).cast("double").alias("lat"), (-9 + n % 12).cast("double").alias("lon"), F.when(known, n * 1000).alias("population")).write.option("header", True).csv(f"{path}/places")
    return readers.gazetteer(spark, f"{path}/places").withColumns({"lat": F.col("lat").cast("int"), "lon": F.col("lon").cast("int")})
