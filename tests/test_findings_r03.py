"""What the findings of round 3 named, each on the smallest rows that show it."""

import datetime
import math
import os
import random

import duckdb
import pytest
from compare import compare
from pyspark.sql import functions as F

from tessaria.operators import health, ingest, joins, market, scoring, search, search_index, selection, store
from tessaria.operators.components import MergedGroups
from tessaria.plans import catalog
from tessaria.streaming import captures

SF = "/root/testdata/sf0.001"


def both(spark, folder, name):
    return compare(spark, str(folder), catalog.queries()[name], catalog.oracle_sql()[name])


def copy_with(folder, name, sql):
    """The smallest tables with one of them replaced by a query over it."""
    for f in os.listdir(SF):
        if f.endswith(".parquet") and f != f"{name}.parquet":
            os.symlink(f"{SF}/{f}", f"{folder}/{f}")
    duckdb.connect().execute(f"COPY ({sql.format(t=f"'{SF}/{name}.parquet'")}) TO '{folder}/{name}.parquet'")
    return folder


def test_f1_score_breakdown_joins_nothing(spark):
    plan = catalog.queries()["score_breakdown"](spark, SF)._jdf.queryExecution().toString()
    assert "Join" not in plan and "Broadcast" not in plan


def test_f1_score_breakdown_odd_ids(spark, tmp_path):
    """A part without id meets nothing, an id that comes twice meets itself, as in SQL."""
    twice = "SELECT * FROM {t} UNION ALL (SELECT * REPLACE (p_size + 1 AS p_size) FROM {t} WHERE p_partkey < 9) UNION ALL (SELECT * REPLACE (NULL::BIGINT AS p_partkey) FROM {t} LIMIT 1)"
    copy_with(tmp_path, "part", twice)
    found = catalog.queries()["score_breakdown"](spark, str(tmp_path))
    assert found.filter("id IS NULL").isEmpty() and found.filter("id = 3").count() == 14


def test_f1_score_breakdown_shuffles_parts_not_terms(spark):
    """Terms are written out after the shuffle, so a part is one row in it."""
    plan = catalog.queries()["score_breakdown"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert 0 <= plan.index("Generate explode") < plan.index("Window") < plan.index("Exchange hashpartitioning(id")


def test_f1_score_breakdown_repeated_ids_as_in_sql(spark, tmp_path):
    """Rows of one id count together, on an id without base (6), one with few signals (80) and one of negative key."""
    odd = "SELECT * FROM {t} UNION ALL SELECT * FROM {t} WHERE p_partkey IN (3, 6, 80) UNION ALL (SELECT * REPLACE (NULL::INTEGER AS p_size) FROM {t} WHERE p_partkey < 9) UNION ALL (SELECT * REPLACE (-p_partkey AS p_partkey) FROM {t}) UNION ALL (SELECT * REPLACE (NULL::BIGINT AS p_partkey) FROM {t} LIMIT 2)"
    assert both(spark, copy_with(tmp_path, "part", odd), "score_breakdown") == ""


def percentile(values, point):
    values = sorted(values)
    at = (len(values) - 1) * point
    return values[math.floor(at)] + (values[math.ceil(at)] - values[math.floor(at)]) * (at - math.floor(at))


@pytest.mark.parametrize("band", [None, ("size", 0.65, 1.35)])
@pytest.mark.parametrize("tile", [joins.TILE, 7])
def test_f2_f4_f7_near_percentiles_hold_all_pairs(spark, monkeypatch, band, tile):
    monkeypatch.setattr(joins, "TILE", tile)
    rng = random.Random(3)
    rows = [(i // 2 if i < 20 else i, rng.choice("ab") if i % 31 else None, 40 + rng.random(), -3 + rng.random(), rng.choice([None, 1.0, 2.0, 5.0, 9.0]), rng.randint(10, 30)) for i in range(300)]
    rows += [(1000 + i, "a", 40.5, -2.5, float(i), 20) for i in range(30)] + [(2000, "a", None, 1.0, 1.0, 20), (2001, "c", 40.5, -2.5, 1.0, 20)]
    df = spark.createDataFrame(rows, "id long, kind string, lat double, lon double, v double, size int")
    found = sorted((r.id, r.n, [None if x is None else round(x, 9) for x in r.p]) for r in joins.near_percentiles(df, 20, "v", (0.25, 0.5), 50, band).collect())
    want = []
    for a in rows:
        if a[1] is None or a[2] is None:
            continue
        near = []
        for b in rows:
            if b[0] != a[0] and b[1] == a[1] and b[2] is not None and (not band or 0.65 * a[5] <= b[5] <= 1.35 * a[5]):
                p, q, x, y = map(math.radians, (a[2], b[2], a[3], b[3]))
                if 6371 * math.acos(min(1, math.cos(p) * math.cos(q) * math.cos(y - x) + math.sin(p) * math.sin(q))) <= 20:
                    near.append(b[4])
        known = [v for v in near if v is not None]
        if near:
            want.append((a[0], len(near), [round(percentile(known, x), 9) if known else None for x in (0.25, 0.5)]))
    key = lambda x: (x[0], x[1], str(x[2]))
    assert sorted(found, key=key) == sorted(want, key=key)


def test_f3_f5_f6_a_segment_is_asked_for_once(spark, monkeypatch):
    seen = []
    real = market.band_join
    monkeypatch.setattr(market, "band_join", lambda l, r, *rest: seen.append((l.count(), r.count())) or real(l, r, *rest))
    rows = [(i, "k", 1, 20, float(i % 4), 2, True) for i in range(400)] + [(900, "k", 1, 20, None, 2, True), (901, None, 1, 20, 1.0, 2, True), (902, "k", 1, 20, 1.0, None, True)]
    df = spark.createDataFrame(rows, "id long, kind string, decade int, size int, price double, rooms int, ground boolean")
    out = {r.id: (r.basis, r.reference) for r in market.like_for_like(df, ("kind", "decade")).collect()}
    assert seen == [(3, 7)]
    assert out[0] == ("segment", 0.075) and out[902] == ("pool", 0.05) and out[900] == ("segment", 0.075) and 901 not in out


@pytest.mark.parametrize("name", ["link_cascade", "link_components"])
def test_f8_f9_parts_beyond_twenty_four_thousand(spark, tmp_path, name):
    folder = copy_with(tmp_path, "lineitem", "SELECT * REPLACE (l_partkey + 200000 * (l_partkey % 3) AS l_partkey) FROM {t} WHERE l_partkey < 60")
    assert both(spark, folder, name) == ""


def test_f10_deviation_has_one_order(spark, tmp_path):
    """Many users of whom some are exactly two deviations off; the twin sums from the newest day back."""
    counts = "SELECT u, k, 1 + hash(u * 31 + k) % 4 AS n FROM range(3000) a(u), range(8) b(k)"
    folder = copy_with(tmp_path, "events", f"SELECT u AS user_id, TIMESTAMP '2024-01-01' + to_days(k::INT) AS ts FROM ({counts}) c, range(4) r(j) WHERE j < n")
    assert both(spark, folder, "anomaly_z") == ""
    days = [(1, d, n) for d, n in enumerate((3, None, 5, 4, 9))] + [(2, d, 7) for d in range(6)]
    rows = health.z_anomaly(spark.createDataFrame(days, "k int, d int, n long"), "k", "d", "n").collect()
    assert [(r.k, r.z, r.anomaly) for r in rows] == [(1, 6.12372, True)]


def test_f11_age_counts_ticks_of_the_second(spark):
    at = datetime.datetime(2024, 1, 21, 0, 0, 0, 500000)
    row = spark.createDataFrame([(False, "r", False, at, "active", None, 1.0, None, 864000)], "backfills_code boolean, code string, accepted boolean, fetched timestamp_ntz, status string, listed double, price double, observed timestamp_ntz, refetch_seconds int")
    rules = ingest.fetch_rules(F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'"))
    assert row.select(ingest.skip_reason(rules).alias("r")).first()["r"].reason == "stale"


def test_f12_confidence_rounds_as_the_twin(spark, tmp_path):
    folder = copy_with(tmp_path, "events", "SELECT * REPLACE (CASE event_id % 4 WHEN 0 THEN 74.85 WHEN 1 THEN 51.15 WHEN 2 THEN 50.75 ELSE 74.86 END AS value) FROM {t}")
    assert both(spark, folder, "review_groups") == ""


def test_f13_settled_tasks_do_not_look_around(spark, monkeypatch):
    seen = []
    real = selection.within_km_join
    monkeypatch.setattr(selection, "within_km_join", lambda l, r, *rest, **more: seen.append((sorted(x.task for x in l.collect()), r.count())) or real(l, r, *rest, **more))
    where = "portal long, section long, place long, lat double, lon double"
    tasks = spark.createDataFrame([(1, 0, 1, 5, 40.0, 0.0), (2, 0, 2, 7, 40.0, 0.0), (3, 0, 2, 8, 40.0, 0.0), (4, 0, 2, 8, None, 0.0)], f"task long, {where}")
    examples = spark.createDataFrame([(9, 0, 2, 7, 40.1, 0.0, "b"), (8, 0, 2, 1, 40.1, 0.0, "a"), (7, 0, 2, 1, 40.2, 0.0, "c")], f"example long, {where}, template string")
    overrides = spark.createDataFrame([(0, 1, "own")], "portal long, section long, template string")
    found = {r.task: (r.template, r.tier) for r in selection.search_tiers(tasks, overrides, examples).collect()}
    assert found == {1: ("own", "override"), 2: ("b", "exact"), 3: ("a", "near"), 4: (None, "default")}
    assert seen == [([3], 2)]


def test_f22_each_step_reads_written_weights(spark):
    df = spark.createDataFrame([(i % 2, float(i % 5), i % 3 == 0) for i in range(80)], "p int, a double, t boolean")
    made = scoring.gradient_models(df.withColumn("t", F.col("t").cast("int")), "p", ("a",), "t", steps=3)
    assert all("/step3/" in f for f in made.inputFiles())


def test_f15_pairs_are_made_from_one_row_a_group(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 30), rng.randint(0, 12)) for _ in range(400)] + [(None, 1), (3, None), (99, 5)]
    held = {}
    for g, m in rows:
        if g is not None and m is not None:
            held.setdefault(g, set()).add(m)
    want = {}
    for g, members in held.items():
        for a in members:
            for b in members:
                if a < b:
                    want.setdefault((a, b), []).append(g)
    found = health.pair_counts(spark.createDataFrame(rows, "g long, m long"), "g", "m", 5)
    assert {(r.lo, r.hi): (r.n, r.top) for r in found.collect()} == {k: (len(v), max(v)) for k, v in want.items() if len(v) >= 5}


@pytest.mark.parametrize("name", ["capture_outcomes", "capture_sightings"])
def test_f16_f18_claims_of_a_trigger_are_one_job(spark, monkeypatch, name):
    calls = []
    real = captures.outcomes
    monkeypatch.setattr(captures, "outcomes", lambda *a: calls.append(1) or real(*a))
    assert both(spark, SF, name) == ""
    assert len(calls) == 1


def test_f16_f18_each_claim_has_its_rows(spark, tmp_path):
    pages = [(i, f"https://a.example.org/x/{i}", "<html></html>", i * 60) for i in range(10)]
    spark.createDataFrame(pages, "capture_id long, url string, html string, s long").withColumn("at", F.timestamp_seconds("s")).drop("s").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    captures.work(spark, stream, str(tmp_path / "work"), F.lit(False), F.lit(False), batch=4)
    rows = spark.read.parquet(str(tmp_path / "work" / "outcomes")).groupBy("claim").agg(F.sort_array(F.collect_list("capture_id")).alias("ids")).collect()
    assert {r.claim: r.ids for r in rows} == {"0-0": [0, 1, 2, 3], "0-1": [4, 5, 6, 7], "0-2": [8, 9]}


def test_f14_a_delivery_that_comes_again_rewrites_nothing(spark, tmp_path):
    t = store.KeyedTable(spark, str(tmp_path / "t"), "k long, v double", ["k"], buckets=4)
    rows = lambda keys, v: spark.createDataFrame([(k, v) for k in keys], "k long, v double")
    files = lambda: {p for p in (tmp_path / "t").rglob("*.parquet")}
    first = t.staged(rows(range(60), 1.0))
    t.apply(first, 1, store.latest_wins(["k"]))
    t.apply(rows(range(30, 90), 2.0), 2, store.latest_wins(["k"]))
    before = files()
    t.apply(first, 1, store.latest_wins(["k"]))
    t.apply(rows(range(30, 90), 3.0), 2, store.latest_wins(["k"]))
    assert files() == before
    # a delivery that had been cut off: only what is missing of it comes in
    t.apply(rows(range(80, 91), 2.5), 2, store.latest_wins(["k"]))
    assert {(r.k, r.v) for r in t.read().collect()} == {(k, 1.0 if k < 30 else 2.5 if k == 90 else 2.0) for k in range(91)}


def test_f20_f21_facts_are_dealt_once_by_listing(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        planned = {n: catalog.queries()[n](spark, SF)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for n in ("relisted_as_of", "profile_digest")}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert planned["relisted_as_of"] <= 10 and planned["profile_digest"] <= 40  # there were 20 and 48


def test_f19_no_join_of_groups_is_broadcast(spark, tmp_path):
    groups = MergedGroups(spark, str(tmp_path / "g"), buckets=2)
    links = lambda *rows: spark.createDataFrame([(*r, 0.5) for r in rows], "a long, b long, confidence double")
    groups.add(links((1, 2), (2, 3), (7, 8)), 1)
    groups.add(links((3, 7), (9, 10)), 2)
    assert {(r.node, r.label) for r in groups.labels().collect()} == {(n, 9 if n > 8 else 1) for n in (1, 2, 3, 7, 8, 9, 10)}
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    plans = [runs.apply(i).physicalPlanDescription() for i in range(max(0, runs.size() - 30), runs.size())]
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)


def test_f17_words_equal_tokens(spark):
    """Every letter and sign there is, within a word."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{chr(c)}b cd" for c in points[i : i + 4096]) for i in range(0, len(points), 4096)] + ["", "a", "e\u0301", "\u0301"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    want = [w for r in df.orderBy("i").select(search.tokens(F.col("t"))).collect() for w in r[0]]
    words, text = search.words_of(texts)
    assert words.to_pylist() == want and list(text[-2:]) == [len(texts) - 3, len(texts) - 2]


@pytest.mark.parametrize("block", [search_index.BLOCK, 9])
def test_f17_postings_take_no_shuffle(spark, monkeypatch, block):
    """A document's postings are made where the document is, block by block, and are those of its words one by one."""
    monkeypatch.setattr(search_index, "BLOCK", block)
    rng = random.Random(5)
    text = lambda: rng.choice([None, "", "¡Pisos, luces!", " ".join(rng.choice(["piso", "pisos", "Luz", "casas", "é", "??", "meses"]) for _ in range(rng.randint(1, 30)))])
    rows = [(i, text(), text()) for i in range(-40, 40)]
    found = search_index.posting_lists(spark.createDataFrame(rows, "id long, a string, b string"), "id", {"B": F.col("a"), "A": F.col("b")})
    assert "Exchange" not in found._jdf.queryExecution().toString()
    want = {}
    for i, *texts in rows:
        words = [(w, t) for w, t in zip("BA", texts, strict=True) for t in search.words_of([t or ""])[0].to_pylist()]
        for at, (weight, word) in enumerate(words):
            want.setdefault((search.stemmed(word), i, weight), []).append(at)
    singles = search_index.apart(found)
    assert {(r.lexeme, r.key, r.weight): r["at"] for r in singles.collect()} == want
    assert singles.count() == search_index.apart(found, places=False).distinct().count() == len(want)


def test_f17_places_are_read_for_phrases_alone(spark, tmp_path):
    index = search_index.SearchIndex(spark, str(tmp_path / "index"), buckets=2)
    rows = [(1, "uno dos", "tres"), (2, "dos uno", "dos"), (3, None, "uno"), (None, "uno dos", None)]
    assert index.update(spark.createDataFrame(rows, "id long, a string, b string"), "id", {"A": F.col("a"), "B": F.col("b")}) == 4
    plan = lambda q: index.search(q)._jdf.queryExecution().executedPlan().toString()
    assert "at#" in plan('"uno dos"') and "at#" not in plan("uno -tres")
    for q, weights, keys in (("uno -tres", None, {2, 3}), ('"dos tres"', None, {1}), ('"uno dos"', None, {1, 2}), ('"uno dos" -tres or uno', "B", {3}), ('uno "uno dos"', "A", {1})):
        assert {r.key for r in index.search(q, weights).collect()} == keys, q
