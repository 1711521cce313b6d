"""Connectors, keyed state, keyed tables, the search index and distributed gradient steps: behaviour beyond the SQL twins."""

import datetime
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessaria.operators import feed, joins, keyed, market, scoring, search, search_index, store
from tessaria.operators.components import MergedGroups, ordered_components
from tessaria.operators.workspace import Workspace
from tessaria.sources import connectors, sitemaps
from tessaria.streaming import captures, jobs, stateful

PAGE = '<html lang="ES"><head><title>Piso &amp; sol</title><script>track({n})</script></head><nav><a href="/Sol">x</a><a href="/mar">y</a></nav><article><h1>Un piso</h1><p>Texto</article></html>'


@pytest.fixture()
def pages(spark, tmp_path):
    rows = [(i, f"https://www.host{i % 7}.example.{('org', 'net', 'com', 'edu')[i % 4]}/en/{i}?page=2", PAGE.replace("{n}", str(i))) for i in range(400)]
    rows += [(400, None, None), (401, "http://a.example.org/", PAGE), (402, "http://a.example.org/x", "no page"), (403, "http://notexample.org/x", PAGE), (404, "http://example.net/de/9", PAGE)]
    folder = str(tmp_path / "pages.parquet")
    spark.createDataFrame(rows, "page_id long, url string, html string").repartitionByRange(4, "page_id").write.option("parquet.block.size", 4096).parquet(folder)
    return folder


def test_connectors(spark, pages):
    raw = connectors.pages(spark, pages)
    counts = {r.source: r["count"] for r in raw.groupBy("source").count().collect()}
    assert counts == {"gallery": 100, "tracker": 100, "captured": 100}  # other hosts, pages without payload and addresses without number have no rows
    found = {r.external_id: r for r in connectors.normalize(raw, connectors.vocabulary(spark)).collect()}
    org, net = found["www.host4.example.org:4"], found["www.host5.example.net:5"]
    assert (org.property_type, org.current_price, org.description, org.rooms, org.features, org.operation) == ("piso", None, "Un piso", 2, ["sol", "mar"], "sale")
    assert (net.property_type, net.current_price, net.rooms, net.operation, net.features) == ("piso", 500.0, 5, "rent", [])
    assert found["www.host6.example.com:6"].property_type is None and set(connectors.CANONICAL) == set(org.asDict())
    assert {r.source for r in connectors.discovered(raw).collect()} == {"gallery", "tracker"}  # the captured source is not swept


def test_connector_filters_are_pushed(spark, pages):
    raw = connectors.pages(spark, pages)
    wanted = raw.filter((F.col("page_id") > 350) & (F.col("source") == "tracker"))
    assert sorted(r.page_id for r in wanted.collect()) == [i for i in range(351, 400) if i % 4 == 1]
    reader = connectors._Reader(pages, connectors.CONNECTORS)
    every = len(reader.partitions())
    assert list(reader.pushFilters([connectors.GreaterThan(("page_id",), 350), connectors.In(("source",), ("tracker",))]))
    assert 0 < len(reader.partitions()) < every and list(reader.connectors) == ["tracker"]
    assert {r.source for r in connectors.pages(spark, pages, ["gallery"]).collect()} == {"gallery"}


def days(spark, tmp_path, rows, schema):
    """One file a day, in order of time, as a stream of one file a trigger."""
    df = spark.createDataFrame(rows, schema).withColumn("at", F.col("at").cast("timestamp"))
    for i, arrival in enumerate(sorted({r[-1] for r in rows})):
        df.filter(F.col("arrival") == arrival).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    return spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_failures_are_forgotten(spark, tmp_path):
    """Equal times by the tie; a timer ends silent keys; a row later than the watermark changes nothing."""
    stateful.use_rocksdb(spark)
    rows = [(1, "2024-01-01 10:00:00", 1, True, 0), (1, "2024-01-01 10:00:00", 0, False, 0), (2, "2024-01-20 10:00:00", 0, False, 1), (3, "2024-02-20 10:00:00", 0, True, 2), (1, "2024-01-02 10:00:00", 0, True, 3), (2, "2024-02-21 10:00:00", 0, True, 3), (3, "2024-03-30 10:00:00", 0, True, 4)]
    stream = days(spark, tmp_path, rows, "k long, at string, tie long, bad boolean, arrival int")
    out = jobs.run_to_table(stateful.failures(stream, "k", "bad", "tie", 14), "update", str(tmp_path / "out")).collect()
    seen = [(r.k, r.failures, r.gone) for r in out]
    assert sorted(seen) == [(1, 1, False), (1, 1, True), (2, 0, False), (2, 0, True), (2, 1, False), (2, 1, True), (3, 1, False), (3, 1, False), (3, 1, True)]


def test_visits_in_any_order(spark, tmp_path):
    """Rows that come late, but within the watermark, fall in their place; later ones are dropped."""
    stateful.use_rocksdb(spark)
    at = lambda h, m=0: f"2024-01-01 {h:02d}:{m:02d}:00"
    rows = [(1, at(9), 0), (1, at(10), 0), (1, at(9, 25), 1), (1, at(9, 50), 1), (1, at(12), 2), (2, at(12), 2), (1, at(8), 3), (1, at(14), 4)]
    stream = days(spark, tmp_path, rows, "k long, at string, arrival int")
    out = jobs.run_to_table(stateful.visits(stream, "k", 30, "1 hour"), "update", str(tmp_path / "out")).collect()
    hour = lambda x: x and datetime.datetime.fromtimestamp(x / 1e6, datetime.UTC).strftime("%H:%M")
    last = max((r for r in out if r.k == 1), key=lambda r: r.seen)
    assert (hour(last.current), hour(last.previous)) == ("14:00", "12:00")
    assert ("09:00", None) in [(hour(r.current), hour(r.previous)) for r in out if r.k == 1]  # 9:25 and 9:50 join 9:00 and 10:00


def files(path):
    return {p.relative_to(path) for p in Path(path).rglob("*.parquet")}


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    t = store.KeyedTable(spark, str(tmp_path / "t"), "k long, v double, n int", ["k"], buckets=8)
    first = spark.createDataFrame([(i, float(i), 0) for i in range(100)], "k long, v double, n int")
    t.apply(first, 1, store.latest_wins(["k"]))
    before = files(tmp_path / "t")
    t.apply(spark.createDataFrame([(5, -1.0, 1)], "k long, v double, n int"), 2, store.latest_wins(["k"]))
    touched = {f.parts[0] for f in before ^ files(tmp_path / "t")}
    assert len(touched) == 1 and t.read().count() == 100 and t.read().filter("k = 5").first().v == -1.0
    # an older delivery that comes again changes nothing; an empty one neither; another session goes on
    again = store.KeyedTable(spark.newSession(), str(tmp_path / "t"), "k long, v double, n int", ["k"], buckets=8)
    again.apply(first, 1, store.latest_wins(["k"]))
    again.apply(first.limit(0), 3, store.latest_wins(["k"]))
    assert again.read().filter("k = 5").first().v == -1.0
    again.apply(spark.createDataFrame([(5, 9.0, 9), (500, 1.0, 1)], "k long, v double, n int"), 4, store.keep_first(["k"]))
    assert {(r.k, r.v) for r in again.read().filter("k IN (5, 500)").collect()} == {(5, -1.0), (500, 1.0)}


def test_canonical_merge(spark, tmp_path):
    t = store.KeyedTable(spark, str(tmp_path / "t"), "k long, price double, f string, tags array<string>, photo string, first_seen int, last_seen int, last_fetched int, missed int", ["k"], buckets=2)
    merge = store.canonical_merge(["k"], "price", ["f"], ["tags"], ["photo"])
    rows = lambda *r: spark.createDataFrame(list(r), "k long, price double, f string, tags array<string>, photo string, seen int")
    t.apply(rows((1, 100.0, "a", ["x"], "p", 5), (2, None, None, [], None, 5)), 1, merge)
    t.update(t.read().withColumn("missed", F.lit(2)))
    t.apply(rows((1, 300.0, None, [], None, 4)), 2, merge)  # too large a move, nothing new, seen earlier than before
    assert [tuple(r) for r in t.read().orderBy("k").collect()] == [(1, 100.0, "a", ["x"], None, 5, 5, 5, 0), (2, None, None, [], None, 5, 5, 5, 2)]


def test_one_per_key_decides_ties(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (2, 1, None)], "k int, t int, v string").repartition(3)
    assert {tuple(r) for r in store.one_per_key(df, ["k"], ["t"]).collect()} == {(1, 5, "b"), (2, 1, None)}
    assert {tuple(r) for r in store.one_per_key(df, ["k"], ["t"], last=False).collect()} == {(1, 5, "a"), (2, 1, None)}


DOCS = [(1, "Ref AB-12", "Los pisos del centro", "ascensor"), (2, None, "Piso céntrico sin ascensor", None), (3, "AB 12", "", "piso"), (4, "centro", "pisos luces", "casas"), (5, None, None, None)]
QUESTIONS = ["piso", "pisos -ascensor", '"ab 12"', "luz or casa", '"centro ascensor"', "-piso", '"ref ab" or "centro pisos"', "Ő", '"pisos del" centro', ""]


def test_index_equals_scan(spark, tmp_path):
    """Every question over all columns (phrases may go on into the next column), then after changes, removals and a compaction."""
    weighted = {w: F.col(w) for w in "ABC"}
    docs = spark.createDataFrame(DOCS, "id long, A string, B string, C string")
    index = search_index.SearchIndex(spark, str(tmp_path / "index"), buckets=4)
    assert index.update(docs, "id", weighted) == 5 and index.update(docs, "id", weighted) == 0

    def hold(rows, questions):
        line = F.concat_ws(" ", "A", "B", "C")
        for q in questions:
            scan = {r.id for r in rows.filter(search.matches(line, q, stems=True)).collect()}
            assert {r.key for r in index.search(q).collect()} == scan, q

    hold(docs, QUESTIONS)
    assert {r.key for r in index.search("ascensor", "C").collect()} == {1} and {r.key for r in index.search("piso", ["B", "C"]).collect()} == {1, 2, 3, 4}
    changed = docs.withColumn("B", F.when(F.col("id") == 2, "una casa").otherwise(F.col("B")))
    assert index.update(changed, "id", weighted) == 1
    index.remove(spark.createDataFrame([(3,)], "id long"))
    left = changed.filter("id <> 3")
    hold(left, QUESTIONS[:4])
    index.compact()
    again = search_index.SearchIndex(spark.newSession(), str(tmp_path / "index"), buckets=4)
    assert {r.key for r in again.search("casa").collect()} == {2, 4} and again.update(changed, "id", weighted) == 1  # the removed one comes back
    assert {r.key for r in again.search("-luz").collect()} == {1, 2, 3, 5}


def test_stems(spark):
    words = ["pisos", "piso", "luces", "casa", "casas", "meses", "intereses", "centro", "ref", "azul", "azules"]
    assert [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(search.stem(F.col("w"))).collect()] == [search.stemmed(w) for w in words]
    assert search.stemmed("pisos") == search.stemmed("pisas") == "pis" and search.stemmed("luces") == "luz" and search.stemmed("intereses") == "interes"


def test_gradient_models_equal_descend(spark):
    rng = np.random.default_rng(4)
    x = rng.random((150, 2))
    y = (x[:, 0] + 0.3 * rng.random(150) > 0.6).astype(int)
    profile = np.where(np.arange(150) < 100, 1, np.where(np.arange(150) < 140, 2, 3))
    df = spark.createDataFrame([(int(p), float(a), float(b), int(t)) for p, (a, b), t in zip(profile, x, y, strict=True)], "p int, a double, b double, t int")
    found = {r.profile: r for r in scoring.gradient_models(df, "p", ("a", "b"), "t", steps=7, written_every=3).collect()}
    assert set(found) == {1, 2}  # ten labels are too few
    for p, r in found.items():
        w, bias, own = np.zeros(2), 0.0, profile == p
        for _ in range(7):
            error = 1 / (1 + np.exp(-(x[own] @ w + bias))) - y[own]
            w, bias = w - 0.5 * (x[own].T @ error / own.sum() + w / own.sum()), bias - 0.5 * error.mean()
        assert np.allclose([r.bias, *r.weights], [bias, *w], atol=1e-12) and r.n == own.sum()


def test_sitemap_frontier(spark):
    """Nested indexes, a cycle, a child listed twice, a document that is not stored, namespaces, entities and CDATA."""
    s = lambda *locs: "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in locs)
    docs = [
        ("root", f"<sitemapindex>{s('a', 'b', 'gone')}</sitemapindex>"),
        ("a", s("root", "c", "b")),
        ("b", '<ns:url xmlns:ns="x"><ns:loc> http://x/?a=1&amp;b=2 </ns:loc><ns:lastmod>2024-01-02</ns:lastmod></ns:url><url><lastmod>2024</lastmod></url>'),
        ("c", "<url>\n<loc><![CDATA[http://x/3]]></loc></url><url><loc>http://x/?a=1&amp;b=2</loc><lastmod>2024-02-01</lastmod></url>" + s("d")),
        ("d", s("a")),
        ("other", "<url><loc>http://never</loc></url>"),
        ("null", None),
    ]
    documents = spark.createDataFrame([*docs, docs[2]], "url string, xml string")
    known, pages = sitemaps.frontier(documents, spark.createDataFrame([("root",), (None,), ("null",)], "url string"))
    assert {(r.url, r.depth, r.stored) for r in known.collect()} == {("root", 0, True), ("null", 0, True), ("a", 1, True), ("b", 1, True), ("gone", 1, False), ("c", 2, True), ("d", 3, True)}
    assert {tuple(r) for r in pages.collect()} == {("http://x/?a=1&b=2", 1, 2, "2024-02-01"), ("http://x/3", 2, 1, None)}
    with pytest.raises(RuntimeError):
        sitemaps.frontier(documents, spark.createDataFrame([("root",)], "url string"), most_rounds=2)
    assert sitemaps.frontier(documents.limit(0), spark.createDataFrame([], "url string"))[1].count() == 0


def test_own_radius_join(spark):
    """Radii from metres to 1,000 km against all pairs; one far-reaching row does not widen the others' cells."""
    draw = random.Random(3)
    point = lambda: (draw.uniform(36, 44), draw.uniform(-9, 3))
    left = [(i, *point(), draw.choice([0.0, 0.3, 5.0, 8.0, 40.0, 1000.0])) for i in range(60)] + [(90, None, 1.0, 5.0), (91, 40.0, 1.0, None), (92, 40.0, 1.0, -1.0)]
    right = [(i, *point()) for i in range(300)] + [(900, left[0][1], left[0][2]), (901, None, 0.0)]
    l, r = spark.createDataFrame(left, "id int, lat double, lon double, km double"), spark.createDataFrame(right, "id int, lat double, lon double")
    got = {(x[0], x[1]) for x in joins.within_own_km_join(l, r, "km", max_lat=45).select("l.id", "r.id").collect()}
    a, b = l.alias("l"), r.alias("r")
    near = joins.great_circle_km("l.lat", "l.lon", "r.lat", "r.lon") <= F.col("l.km")
    assert got == {(x[0], x[1]) for x in a.crossJoin(b).filter(near).select("l.id", "r.id").collect()} and (0, 900) in got
    assert joins.within_own_km_join(l.limit(0), r, "km").count() == 0


def in_turn(links, vetoes, ties):
    """Links one by one by falling confidence and tie, each unless it brings a vetoed pair together."""
    group = {}
    for a, b, *_ in links:
        group.setdefault(a, {a})
        group.setdefault(b, {b})
    for a, b, c in sorted(links, key=lambda x: (-x[2], -ties[x[:2]], -x[0], -x[1])):
        x, y = group[a], group[b]
        if x is not y and not any((p in x and q in y) or (p in y and q in x) for p, q in vetoes):
            x |= y
            for n in y:
                group[n] = x
    return {n: min(g) for n, g in group.items()}


@pytest.mark.parametrize("seed", range(4))
def test_ordered_components(spark, seed):
    draw = random.Random(seed)
    links = {}
    for _ in range(70):
        a, b = sorted(draw.sample(range(40), 2))
        links[a, b] = draw.choice([0.75, 0.9, 1.0])
    links = [(a, b, c) for (a, b), c in links.items()]
    vetoes = [tuple(sorted(draw.sample(range(40), 2))) for _ in range(6)] if seed else []
    df = spark.createDataFrame(links, "a long, b long, confidence double")
    ties = {(r.a, r.b): r.t for r in df.select("a", "b", F.xxhash64("a", "b").alias("t")).collect()}
    want = in_turn(links, vetoes, ties)
    got = {r.node: r.label for r in ordered_components(Workspace(spark, "t"), df, spark.createDataFrame(vetoes, "lo long, hi long")).collect()}
    assert got == want and all(got.get(x) != got.get(y) for x, y in vetoes if x in got and y in got)


def test_merged_groups_by_deliveries(spark, tmp_path):
    """Three deliveries under vetoes equal one; components that a delivery does not reach keep their rows as they are."""
    draw = random.Random(9)
    links = [(draw.randrange(0, 15), draw.randrange(15, 30), draw.choice([0.5, 0.9])) for _ in range(24)] + [(100, 101, 0.9)]
    vetoes = spark.createDataFrame([(1, 17), (3, 20), (5, 6)], "lo long, hi long")
    df = lambda rows: spark.createDataFrame(rows, "a long, b long, confidence double")
    groups = MergedGroups(spark, str(tmp_path / "groups"), buckets=64)
    groups.add(df([links[-1], *links[:8]]), 1, vetoes)
    before = {p.name for p in (tmp_path / "groups" / "nodes").rglob("*.parquet")}
    groups.add(df(links[8:16]), 2, vetoes)
    MergedGroups(spark.newSession(), str(tmp_path / "groups"), buckets=64).add(df(links[16:-1]), 3, vetoes)
    assert before & {p.name for p in (tmp_path / "groups" / "nodes").rglob("*.parquet")}  # buckets of untouched nodes
    best = {}
    for a, b, c in links:
        best[a, b] = max(c, best.get((a, b), 0))
    once = {r.node: r.label for r in ordered_components(Workspace(spark, "t"), df([(a, b, c) for (a, b), c in best.items()]), vetoes).collect()}
    assert {r.node: r.label for r in groups.labels().collect()} == once


def test_cursor_round_trip():
    row = (1, 0.5, 7, "2024-01-01T00:00:00+00:00", True)
    assert feed.decode_cursor(feed.encode_cursor(*row)) == row
    assert feed.decode_cursor(feed.encode_cursor(0, None, 7, "2024-01-01", False)) == (0, -1.0, 7, "2024-01-01", False)
    bad = ["", "x", "!!!", feed.encode_cursor(1, 0.5, 0, "2024-01-01", True), feed.encode_cursor(1, 0.5, 7, "soon", True), feed.encode_cursor(1, float("inf"), 7, "2024-01-01", True), feed.encode_cursor(True, 0.5, 7, "2024-01-01", True)]
    assert [feed.decode_cursor(x) for x in bad] == [None] * len(bad)


def test_pages_of_the_feed(spark):
    """All pages after one another are the whole ranking, ties and missing scores included."""
    draw = random.Random(1)
    rows = [(i, draw.randint(0, 1), draw.choice([None, 0.5, 0.25, 0.75])) for i in range(1, 60)]
    df = spark.createDataFrame(rows, "id long, tier int, score double").repartition(3)
    got, cursor = [], None
    while True:
        page = feed.page(df, 7, cursor).collect()
        got += [r.id for r in page[:7]]
        if len(page) <= 7:
            break
        last = page[6]
        cursor = feed.decode_cursor(feed.encode_cursor(last.tier, last.score, last.id, "2024-01-01", False))
    assert got == [i for i, *_ in sorted(rows, key=lambda r: (-r[1], -(r[2] if r[2] is not None else -1), -r[0]))]


def test_novelty_by_profile(spark):
    """Each profile by its own anchor: never visited, mostly new and ordinary ones; a missing sight is not new."""
    pool = spark.createDataFrame([(1, 1, 5), (1, 2, 20), (2, 3, 5), (2, 4, 20), (2, 5, None), (3, 6, 20), (3, 7, 30)], "profile int, id int, first_seen int")
    anchors = spark.createDataFrame([(1, 10, True), (2, 10, False), (3, 10, False)], "profile int, anchor int, never boolean")
    got = {r.id: (r.is_new, r.cold_start, r.tier) for r in feed.with_novelty(pool, anchors).collect()}
    assert got == {1: (False, True, 0), 2: (True, True, 0), 3: (False, False, 0), 4: (True, False, 1), 5: (False, False, 0), 6: (True, True, 0), 7: (True, True, 0)}
    seen = spark.createDataFrame([(1, None, "2024-01-05"), (2, "2024-01-01", "2024-01-05")], "profile int, previous string, created string").selectExpr("profile", "CAST(previous AS timestamp) previous", "CAST(created AS timestamp) created")
    assert {(r.profile, str(r.anchor)[:10], r.never) for r in feed.profile_anchors(seen).collect()} == {(1, "2024-01-04", True), (2, "2024-01-01", False)}


def test_visible_pool(spark):
    rows = [(1, 3, True, 1), (1, 4, False, 9), (2, 3, True, 1), (2, 5, True, 8), (3, 3, False, 2), (4, None, True, 3)]
    got = {r.id: (r.visible, r.first_seen, r.sources) for r in feed.visible_pool(spark.createDataFrame(rows, "id int, source int, active_sale boolean, first_seen int"), spark.createDataFrame([(3,)], "source int")).collect()}
    assert got == {1: (False, 9, []), 2: (True, 8, [5]), 3: (True, None, []), 4: (True, 3, [])}


def test_places_within_groups(spark):
    rows = [(i % 3, i * 7 % 50, i) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, v int, id int").repartition(5)
    order = (F.desc("v"), F.asc("id"))
    want = {}
    for g in range(3):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        want |= {r[2]: (n, own[n - 2][2] if n > 1 else None, own[n][2] if n < len(own) else None) for n, r in enumerate(own, 1)}
    places = {r.id: r.place for r in keyed.numbered_within(df, "g", order, "place").collect()}
    beside = {r.id: (r.prev, r.next) for r in keyed.adjacent(df, "g", order, "id").collect()}
    assert {i: (places[i], *beside[i]) for i in places} == want


def test_captures_again_change_nothing(spark, tmp_path):
    """Two runs over the same queue: every capture has one outcome; unknown addresses, notices and challenges are told apart."""
    block = "<p>Muchas peticiones</p><p>en poco tiempo</p>"
    rows = [(1, "http://a.example.org/x1", PAGE), (2, "http://a.example.org/list?page=1", PAGE), (3, "http://elsewhere.com/x", PAGE), (4, "http://a.example.net/x4", PAGE + block), (5, "http://a.example.net/x5", "gone"), (6, "http://a.example.org/x6", "<p>no title</p>"), (7, None, None)]
    df = spark.createDataFrame(rows, "capture_id long, url string, html string").withColumn("at", F.timestamp_seconds(F.col("capture_id") * 60))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):
        out = captures.work(spark, stream, str(tmp_path / "work"), F.col("url").contains("page="), F.col("html") == "gone", batch=3)
        assert sorted((r.capture_id, r.status, r.source, r.reason) for r in out.collect()) == [(1, "done", "gallery", None), (2, "listing", "gallery", None), (3, "failed", None, "unknown address"), (4, "blocked", "tracker", None), (5, "withdrawn", "tracker", None), (6, "failed", "gallery", "no payload"), (7, "failed", None, "unknown address")]
    seen = {(r.external_id, r.last_seen.minute) for r in captures.sightings(out).collect()}
    assert seen == {("a.example.org:x1", 1), ("a.example.org:Sol", 2), ("a.example.org:mar", 2)}


def test_relisted_pairs(spark):
    """Prices as of both ends, with the current price where history has none; the bound of 90 days is in, equal times are not."""
    ts = lambda df, c: df.withColumn(c, F.date_add(F.lit("2024-01-01"), F.col(c)).cast("timestamp"))
    listings = ts(spark.createDataFrame([(1, 1, 0, 100.0), (1, 2, 40, 90.0), (2, 3, 0, 100.0), (2, 4, 101, 50.0), (3, 5, 0, 100.0)], "p int, l int, first_seen int, current_price double"), "first_seen")
    status = ts(spark.createDataFrame([(1, 1, 10, "gone"), (2, 3, 10, "gone"), (3, 5, 5, "gone"), (3, 5, 5, "active"), (3, 5, 95, "active")], "p int, l int, at int, status string"), "at")
    history = ts(spark.createDataFrame([(1, 1, 5, 120.0), (1, 1, 11, 10.0), (1, 2, 41, 108.0), (3, 5, 95, 80.0)], "p int, l int, at int, price double"), "at")
    got = {r.p: (round(r.fall, 6), r.n, r.relisted_at.timetuple().tm_yday) for r in market.relisted_lower(listings, status, history, ("p", "l"), "p", ("gone",), ("active",)).collect()}
    assert got == {1: (0.1, 1, 41), 3: (0.2, 1, 96)}
