"""Boundary cases of scalar functions and rules."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessaria.functions import geo, text
from tessaria.operators import finance, ingest, joins, keyed, linkage, scoring, search
from tessaria.operators.workspace import Workspace
from tessaria.plans import catalog, sqlgate
from tessaria.sources import readers
from tessaria.streaming import jobs, stateful


def values(spark, column, *rows):
    """A column over rows of one to three string cells (x, y, z)."""
    width = len(rows[0])
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{n} string" for n in "xyz"[:width]))
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_address(spark):
    assert values(spark, text.normalize_address(F.col("x")), ("C/ Mayor, 3",), ("Avda. Constitución  nº 5",), (None,)) == ["calle mayor 3", "avenida constitucion no 5", None]
    rows = [("cl mayor",), ("av constitucion",), ("c/foo 3ª",), ("Pza.Nueva",), ("Pº del Prado",), ("Cl. Ancha",)]
    assert values(spark, text.normalize_address(F.col("x")), *rows) == ["calle mayor", "avenida constitucion", "c foo 3a", "plaza nueva", "paseo del prado", "calle ancha"]


def test_floors_differ_on_purpose(spark):
    rows = [("Semisótano",), ("3ª planta",), ("Bajo cubierta",), (None,), ("PB",), ("Planta baja",), ("entreplanta",), ("03",), ("Semi-sótano",), ("bajos",)]
    assert values(spark, text.normalize_floor(F.col("x")), *rows) == ["semisotano", "3", "bajo", None, None, "bajo", "entresuelo", "3", "sotano", "bajo"]
    assert values(spark, text.floor_number(F.col("x")), *rows) == [-0.5, 3.0, 0.0, None, None, 0.0, 0.5, 3.0, -0.5, 0.0]
    assert values(spark, text.is_ground_floor(F.col("x")), *rows) == [True, False, False, False, True, True, True, False, False, True]


def test_failures(spark):
    rows = [("Host unreachable",), ("SSL certificate",), ("bad JSON",), ("boom",), ("json timed out",)]
    assert values(spark, text.failure_class(F.col("x")), *rows) == ["network", "network", "structure_change", "other", "network"]


def test_content_hash_cannot_collide(spark):
    df = spark.createDataFrame([([(1, "a\n2:b")],), ([(1, "a"), (2, "b")],), ([(2, " b "), (1, "a")],), ([(None, None)],)], "rows array<struct<id:long,text:string>>")
    one, two, three, none = [r[0] for r in df.select(text.content_hash("rows")).collect()]
    assert one != two == three and none == hashlib.sha256(b'[{"id":null,"d":""}]').hexdigest()


def test_phones(spark):
    rows = [("call 612 345 678 or +34 912-345-678.",), ("1612345678",), ("34612345678",)]
    assert values(spark, text.extract_phones(F.col("x")), *rows) == [["612345678", "912345678"], [], []]


def test_codes(spark):
    rows = [("x123", "x123-1"), ("x123-1", "x123-2"), ("x123", "x123"), (None, "x123"), ("x123-1", "x123-1")]
    assert values(spark, text.codes_equivalent(F.col("x"), F.col("y")), *rows) == [True, False, True, False, True]
    assert values(spark, text.normalize_reference_code(F.col("x")), ("Ref. A-12",), ("pendiente",), ("ab1",), ("REFORMA-12",), ("REF1234",)) == ["a-12", None, None, "reforma-12", "ref1234"]
    assert values(spark, text.code_base(F.col("x")), ("ab-12",), ("abcd/2",)) == [None, "abcd"]


def test_numbers_and_cadastral(spark):
    assert values(spark, text.spanish_number(F.col("x")), ("379.000,50 €",), ("",), (None,)) == [379000, None, None]
    assert values(spark, text.normalize_cadastral(F.col("x")), ("9872023 VH5797S 0001 WX",), ("A" * 20,)) == ["9872023VH5797S0001WX", None]


def test_visible_text_and_phrases(spark):
    page = "<html><style>x{}</style><script>var captcha</script><p>Verifique: ¿es un ROBOT?</p></html>"
    assert values(spark, text.visible_text(F.col("x")), (page,)) == ["verifique: ¿es un robot?"]


def test_token_sort(spark):
    assert values(spark, text.token_sort_ratio("x", "y"), ("calle mayor 3", "3 mayor calle"), ("a", None), ("abcd", "abxy")) == [1.0, None, 0.5]


def test_distances_agree(spark):
    row = spark.range(1).select(geo.haversine_m(40.0, -3.0, 40.1, -3.1).alias("m"), geo.great_circle_km(40.0, -3.0, 40.1, -3.1).alias("km"), geo.great_circle_km(40.0, -3.0, 40.0, -3.0).alias("zero")).first()
    assert row.m == pytest.approx(row.km * 1000, rel=1e-6) and row.zero < 1e-3


def test_polyline_known_value(spark):
    ring = F.array(*(F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for a, b in ((38.5, -120.2), (40.7, -120.95), (43.252, -126.453))))
    row = spark.range(1).select(ring.alias("p")).select(geo.polyline_encode("p").alias("line")).withColumn("back", geo.polyline_decode("line")).first()
    assert row.line == "_p~iF~ps|U_ulLnnqC_mqNvxq`@" and [tuple(p) for p in row.back] == [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]


def test_price_rules(spark):
    rows = [(None, 100.0), (0.0, 100.0), (100.0, 100.5), (100.0, 101.0), (100.0, 160.0), (100.0, 161.0), (100.0, None)]
    df = spark.createDataFrame(rows, "a double, b double").select(ingest.adoptable(F.col("a"), F.col("b")), ingest.material(F.col("a"), F.col("b")))
    assert [tuple(r) for r in df.collect()] == [(True, True), (True, True), (False, False), (True, True), (True, True), (False, True), (False, False)]


def test_hashes(spark):
    near, far = 2**10 - 1, 2**11 - 1
    df = spark.createDataFrame([([0], [near]), ([0], [far]), ([0, 5], []), ([0, near], [0])], "a array<long>, b array<long>")
    assert [r[0] for r in df.select(linkage.match_ratio(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, None, 1.0]
    assert spark.range(1).select(linkage.ratio_confidence(F.lit(0.6)), linkage.ratio_confidence(F.lit(1.0))).first()[:] == (0.6, 0.8)


def test_hash_bands_find_ten_flips(spark):
    rng = np.random.default_rng(3)
    pairs = []
    for _ in range(50):
        a = int(rng.integers(-(2**63), 2**63 - 1))
        flips = sum(1 << int(b) for b in rng.choice(64, 10, replace=False))
        b = (a & (2**64 - 1)) ^ flips
        pairs.append(([a], [b - 2**64 if b >= 2**63 else b]))
    df = spark.createDataFrame(pairs, "a array<long>, b array<long>")
    assert all(df.filter(F.arrays_overlap(linkage.hash_keys(F.col("a")[0], n), linkage.hash_keys(F.col("b")[0], n))).count() == 50 for n in (12, 13, 14, 16))


LISTING = "listing_id long, property_id long, source string, agency string, kind string, cadastral string, code string, address string, floor string, lat double, lon double, m2 double, price double, rooms int, phones array<string>, hashes array<long>"


def listing(i, **more):
    row = dict(listing_id=i, property_id=i, source=f"s{i}", agency="a", kind=None, cadastral=None, code=None, address=None, floor=None, lat=None, lon=None, m2=None, price=None, rooms=None, phones=[], hashes=[])
    return tuple((row | more)[c.split()[0]] for c in LISTING.split(", "))


def linked(spark, *rows, **more):
    df = spark.createDataFrame(rows, LISTING)
    pairs = linkage.candidate_pairs(df, **more)
    return {(r.a, r.b): (r.basis, r.decision, r.confidence) for r in linkage.cascade(pairs, df).collect()}, df


def test_cascade_cases(spark):
    here = dict(lat=40.0, lon=-3.0, m2=100.0)
    found, _ = linked(
        spark,
        listing(1, cadastral="C", price=100.0), listing(2, cadastral="C", price=900.0),
        listing(3, code="x123", **here), listing(4, code="x123-1", **here),
        listing(5, code="x9-1", **here, source="q"), listing(6, code="x9-2", **here),
        listing(7, address="calle mayor 3", **here), listing(8, address="3 mayor calle", **here | {"lat": 40.0001}),
        listing(9, phones=["6"], kind="particular", m2=50.0, price=100.0), listing(10, phones=["6"], kind="particular", m2=50.0, price=105.0),
        listing(17, phones=["5"], kind="particular", m2=50.0, price=100.0), listing(18, phones=["5"], m2=50.0, price=105.0),
        listing(19, phones=["4"], kind="agency", m2=50.0, price=100.0), listing(20, phones=["4"], m2=50.0, price=105.0),
        listing(11, hashes=[7], price=100.0, m2=70.0), listing(12, hashes=[7], price=104.0, m2=70.0),
        listing(13, hashes=[9 << 40], price=100.0, m2=70.0), listing(14, hashes=[9 << 40], price=104.0, m2=71.0),
        listing(15, phones=["8"], price=100.0), listing(16, phones=["8"], price=131.0 / 0.9),
    )
    assert found[1, 2] == ("cadastral", "merge", 1.0)
    assert found[3, 4] == ("reference_code", "suggest", 0.4)
    assert found[5, 6][:2] == ("code_conflict", "none")
    assert found[7, 8] == ("address_coords", "merge", 0.9)
    assert found[9, 10] == ("phone", "merge", 0.9) and found[17, 18] == ("phone", "suggest", 0.75) and found[19, 20][:2] == ("none", "none")
    assert found[11, 12] == ("photo_hash", "merge", 0.9)
    assert found[13, 14] == ("photo_hash", "suggest", 0.8)
    assert found[15, 16][:2] == ("price_gap", "reject")


def test_blocking_equals_all_pairs(spark):
    rng = np.random.default_rng(5)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    centres = rng.integers(-(2**63), 2**63 - 1, 4).tolist()

    def near_hash():
        flipped = pick(centres) & (2**64 - 1)
        for bit in rng.choice(64, int(rng.integers(0, 8)), replace=False).tolist():
            flipped ^= 1 << bit
        return flipped - 2**64 if flipped >= 2**63 else flipped

    rows = [
        listing(i, source=pick("abc"), agency=pick([None, "p", "q"]), kind=pick([None, "particular", "agency"]), cadastral=pick([None, None, "C1", "C2"]), code=pick([None, "r1", "r1-1", "r22"]), address=pick(["calle a 1", "calle a 2", "plaza b 9"]), floor=pick([None, "1", "2"]),
                lat=40 + int(rng.integers(5)) * 0.00009, lon=-3 + int(rng.integers(5)) * 0.00009, m2=pick([50.0, 51.0, 80.0]), price=pick([100.0, 104.0, 120.0, 150.0, None, 0.0]), rooms=pick([0, 1, 2, 4]), phones=pick([[], ["6"], ["6", "7"]]), hashes=pick([[], [7], [7, 2**40], [2**11 - 1 + 2**60], [2**10 - 1], [near_hash(), near_hash()]]))
        for i in range(120)
    ]
    found, df = linked(spark, *rows)
    ids = df.select("listing_id", "source")
    every = ids.alias("x").join(ids.alias("y"), (F.col("x.listing_id") < F.col("y.listing_id")) & (F.col("x.source") != F.col("y.source"))).select(F.col("x.listing_id").alias("a"), F.col("y.listing_id").alias("b"))
    every = {(r.a, r.b): (r.basis, r.decision, r.confidence) for r in linkage.cascade(every, df).collect() if r.decision in ("merge", "suggest")}
    assert {k: v for k, v in found.items() if v[1] in ("merge", "suggest")} == every and every


def test_vetoes_and_merges(spark):
    rows = [listing(1, cadastral="C"), listing(2, cadastral="C"), listing(3, cadastral="C"), listing(4)]
    vetoes = spark.createDataFrame([(1, 2)], "lo long, hi long")
    found, df = linked(spark, *rows)
    verdicts = spark.createDataFrame([(a, b, *v) for (a, b), v in found.items()], "a long, b long, basis string, decision string, confidence double")
    merged = lambda v: {r.listing_id: r.property_id for r in linkage.merged_properties(verdicts, df, v).collect()}
    assert merged(None) == {1: 1, 2: 1, 3: 1, 4: 4}
    assert merged(vetoes) == {1: 1, 2: 2, 3: 3, 4: 4}
    assert (1, 2) not in linked(spark, *rows, vetoes=vetoes)[0]


def test_reconcile(spark):
    states = spark.createDataFrame([(1, 1, "new", True), (1, 2, "visited", False), (2, 1, "rejected", False), (2, 2, "visited", True)], "profile_id long, property_id long, stage string, matched boolean")
    survivors = spark.createDataFrame([(1, 1), (2, 1)], "property_id long, survivor long")
    out = {r.profile_id: (r.stage, r.matched, r.conflict) for r in linkage.reconcile_states(states, survivors, {"rejected": 0, "new": 1, "visited": 2}).collect()}
    assert out == {1: ("visited", True, False), 2: ("visited", True, True)}


def test_sessions_bound(spark):
    rows = [(1, "2024-01-01 10:00:00"), (1, "2024-01-01 10:30:00"), (1, "2024-01-01 11:00:01"), (1, "2024-01-01 22:50:00"), (1, "2024-01-01 23:10:00")]
    df = spark.createDataFrame(rows, "k int, t string").withColumn("t", F.col("t").cast("timestamp"))
    assert [r.session for r in keyed.sessionize(df, ["k"], "t", 30).orderBy("t").collect()] == [1, 1, 2, 3, 4]


def test_annuity_without_interest(spark):
    assert spark.range(1).select(finance.annuity(F.lit(1200.0), 0, 10)).first()[0] == 10.0


def test_gradient_descent_separates():
    x = np.array([[-1.0], [-0.5], [0.5], [1.0]] * 10)
    w = scoring.descend(x, (x[:, 0] > 0).astype(float))
    assert w[1] > 1 and abs(w[0]) < 1e-9


def test_search_grammar(spark):
    rows = [("El piso está en Málaga centro",), ("Ático en Málaga",), ("Centro de Málaga",)]
    ask = lambda q: values(spark, search.matches(F.col("x"), q), *rows)
    assert ask("malaga") == [True] * 3
    assert ask('"malaga centro"') == [True, False, False]
    assert ask("malaga -centro or piso") == [True, True, False]


@pytest.mark.parametrize("sql", ["DELETE FROM t", "SELECT 1; SELECT 2", "WITH x AS (SELECT 1) INSERT INTO t SELECT 1", "SELECT * INTO x FROM t"])
def test_gateway_refuses(sql):
    with pytest.raises(sqlgate.Refused):
        sqlgate.check(sql)


def test_gateway_allows_and_limits(spark):
    spark.range(500).createOrReplaceTempView("allowed")
    spark.range(5).createOrReplaceTempView("hidden")
    gate = sqlgate.Gateway(spark, {"allowed"})
    assert gate.execute("SELECT id, 'drop; not' AS s FROM allowed".replace(";", ",")).count() == 200
    assert gate.execute("WITH c AS (SELECT id FROM allowed) SELECT count(*) AS n FROM c").first().n == 500
    with pytest.raises(sqlgate.Refused):
        gate.execute("SELECT * FROM allowed JOIN hidden USING (id)")
    for sql in (
        "SELECT * FROM other.allowed",
        "WITH parquet AS (SELECT 1) SELECT count(*) FROM parquet.`/root/testdata/sf0.001/nation.parquet`",
        "SELECT (SELECT max(id) FROM hidden) AS m FROM allowed",
        "SELECT * FROM allowed WHERE id IN (SELECT id FROM hidden)",
        "SELECT * FROM hidden, (WITH hidden AS (SELECT 1) SELECT * FROM hidden)",
        "SELECT * FROM range(10)",
        "SELECT reflect('java.lang.System', 'getenv') AS e",
        "SELECT " + ", ".join(f"{i} AS c{i}" for i in range(31)),
    ):
        with pytest.raises(sqlgate.Refused):
            gate.execute(sql)
    assert gate.execute("WITH c AS (SELECT id FROM allowed), e AS (SELECT id FROM c) SELECT (SELECT max(id) FROM e) AS m").first().m == 499
    assert len(gate.execute("SELECT repeat('x', 30000) AS s").first().s) == 20_000
    assert len(gate.rows("SELECT id FROM allowed")) == 200
    spark.range(0, 3000, 1, 3000).createOrReplaceTempView("slow")
    with pytest.raises(sqlgate.Refused, match="seconds"):
        sqlgate.Gateway(spark, {"slow"}).rows("SELECT sum(id) AS s FROM slow", seconds=1)
    assert sqlgate.date_range("7d", "2024-01-31") == {"date_from": "2024-01-24", "date_to": "2024-01-31", "before_from": "2024-01-16", "before_to": "2024-01-23"}
    assert gate.cost("SELECT id FROM allowed") > 0 and "Physical Plan" in gate.explain("SELECT id FROM allowed")
    assert sqlgate.rewrite("x WHERE __gf_a__ AND __gf_b__", {"a": ("c", 3), "b": ("e", [])}, {}) == ("x WHERE c = :gf_a AND TRUE", {"gf_a": 3})


def test_selectors(spark):
    html = "<div class='p x'> 12 € <script>no</script></div><h1 id=t>Title<br>two</h1>"
    df = spark.createDataFrame([(1, html), (2, None)], "k long, html string")
    out = readers.select_texts(df, "k", "html", {"price": ("#price", "div.p"), "title": ("h1#t", "title")} | {"id": ("#t",)})
    assert [tuple(r) for r in out.orderBy("k").collect()] == [(1, "12 €", "Titletwo", "Titletwo"), (2, None, None, None)]


def test_embedded_json(spark):
    html = '<script>window.__INITIAL_PROPS__ = {"ad": {"id": 7, "price": 10.5}};</script>'
    assert values(spark, readers.embedded_json(F.col("x"), "__INITIAL_PROPS__", "ad struct<id:long,price:double>")["ad"]["id"], (html,), ("<p>",)) == [7, None]


def test_paged_json_and_gazetteers(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"page": 1, "items": [{"id": 1, "price": 2.5}, {"id": 2}]}')
    (tmp_path / "b.json").write_text('{"page": 2,\n "items": []}')
    rows = readers.json_pages(spark, str(tmp_path / "*.json"), "items", "page int, items array<struct<id:long,price:double>>")
    assert sorted(tuple(r) for r in rows.collect()) == [(1, 2.5), (2, None)]
    names = [x.split()[0] for x in readers.PLACE_SCHEMA.split(",")]
    values_ = {"name": "Ávila", "province": "Ávila", "lat": "40.65", "lon": "-4.7", "population": "57000"}
    (tmp_path / "g.csv").write_text(",".join(names) + "\n" + ",".join(values_.get(n, "") for n in names) + "\n")
    row = readers.gazetteer(spark, str(tmp_path / "g.csv")).first()
    assert (row.name, row.lat) == ("Ávila", 40.65)


def test_missed_sweeps_stream(spark, tmp_path):
    sweeps = [(1, s, ids) for s, ids in enumerate([[1, 2], [1], [1], [1, 2], [1], [1], [1], [1]])]
    for s in sweeps:
        spark.createDataFrame([s], "source long, sweep long, found array<long>").write.parquet(str(tmp_path / "in" / str(s[1])))
    stream = spark.readStream.schema("source long, sweep long, found array<long>").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stateful.use_rocksdb(spark)
    out = jobs.run_to_table(stateful.missed_sweeps(stream), "append", str(tmp_path / "out"))
    assert [(r.sweep, r.id) for r in out.collect()] == [(6, 2)]


def test_full_diff_takes_the_first(spark):
    old = spark.createDataFrame([("a", "x", 2), ("a", "y", 1), ("b", None, 1), ("c", "z", 1)], "slug string, label string, i int")
    new = spark.createDataFrame([("a", "y", 5), ("b", "q", 1), ("d", "w", 1), ("d", "v", 2)], "slug string, label string, i int")
    assert {tuple(r) for r in joins.full_diff(old, new, "slug", "label", "i").collect()} == {("b", "changed"), ("c", "removed"), ("d", "added")}


def test_grid_join_stops_beyond_its_latitude(spark):
    far = spark.createDataFrame([(1, 70.0, 0.0)], "id long, lat double, lon double")
    with pytest.raises(Exception, match="latitude"):
        joins.within_km_join(far, far, 10).collect()


def test_near_hashes_equal_all_pairs(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(-(2**63), 2**63 - 1, 20).tolist()
    values = set()
    for h in base * 8:
        x = h & (2**64 - 1)
        for bit in rng.choice(64, int(rng.integers(0, 13)), replace=False).tolist():
            x ^= 1 << bit
        values.add(x - 2**64 if x >= 2**63 else x)
    want = {(a, b) for a in values for b in values if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 10}
    df = spark.createDataFrame([(h,) for h in values] * 2, "hash long")
    for segments in (12, 13, 14, None):
        assert {tuple(r) for r in linkage.near_hashes(Workspace(spark, "test"), df, segments).collect()} == want and len(want) > 100


def test_compared_pairs_grow_slower_than_all_pairs(spark):
    """Keys that random hashes share are as many as foreseen, and the work for one hash grows with the root of their number."""
    df = spark.range(20_000).select(F.xxhash64("id").alias("h"))
    met = df.select(F.explode(linkage.hash_keys(F.col("h"))).alias("key")).groupBy("key").count().agg(F.sum(F.expr("count * (count - 1) / 2"))).first()[0]
    assert abs(met / linkage.comparisons(20_000, linkage.SEGMENTS) - 1) < 0.05
    work = lambda n: linkage.KEY_COST * linkage.comb(linkage.segments_for(n), 10) + linkage.comparisons(n, linkage.segments_for(n)) / n
    assert all(work(10 ** (i + 1)) < 3.6 * work(10**i) for i in range(4, 8))


def test_pairs_of_the_whole_catalogue(spark, tmp_path):
    draw = random.Random(3)
    rows = [(part, draw.randrange(8)) for part in range(1, 60) for _ in range(6)]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    shared = {}
    for part, lo in set(rows):
        for other, hi in set(rows):
            if part == other and lo < hi:
                shared.setdefault((lo, hi), []).append(part)
    want = {(lo, hi, len(p), max(p)) for (lo, hi), p in shared.items() if len(p) >= 12}
    have = [tuple(r) for r in catalog.queries()["unordered_pairs"](spark, str(tmp_path)).select("lo", "hi", "n", "top").collect()]
    assert want and len(have) == len(want) and set(have) == want


def test_fairness_numbers_every_customer(spark):
    d = "/root/testdata/sf0.001"
    last = {r.user_id: r.last for r in spark.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(F.max("ts").alias("last")).collect()}
    keys = [r.c_custkey for r in spark.read.parquet(f"{d}/customer.parquet").collect()]
    want = sorted(keys, key=lambda k: (k in last, last.get(k) or 0, k))
    rows = catalog.queries()["scope_fairness"](spark, d).collect()
    assert [r.c_custkey for r in sorted(rows, key=lambda r: r.turn)] == want and sorted(r.turn for r in rows) == list(range(1, len(keys) + 1))
    assert all(r.last == last.get(r.c_custkey) for r in rows)


def test_numbered_over_many_ranges(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = spark.range(5000).select(((F.col("id") * 7919) % 5003).alias("k"))
    out = keyed.numbered(rows, (F.asc("k"),), "turn").collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert [r.turn for r in sorted(out, key=lambda r: r.k)] == list(range(1, 5001))
    assert keyed.numbered(rows.limit(0), (F.asc("k"),), "turn").count() == 0
