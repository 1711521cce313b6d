"""Filter audit, periodic runs and sharding against plain versions, with edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from brute import SCHEMA, corpus, words
from compare import compare

from tessaria.llm import catalog, filter_audit, periodic_runs, sharding
from tessaria.llm.blocks import mix

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    return [(d, t) for d, t, *_ in corpus()]


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_periodic_runs"])
def test_sql_twins(spark, name):
    assert compare(spark, SF, catalog.queries()[name], catalog.oracle_sql()[name]) == ""


# --- filter audit


def plain_audit(docs, labels):
    """(part, order, step): counts, by going through every order for every document."""
    texts = [(d, p or "", t or "") for d, p, t in docs]
    least = {}
    for d, _, t in texts:
        if d is not None:
            least[t] = min(d, least.get(t, d))
    good, toxic = ({d for d, q, x in labels if d is not None and (q, x)[k] == 1} for k in (0, 1))
    out, removed = defaultdict(Counter), Counter()
    for d, part, t in texts:
        w = words(t)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": d is not None and t in least and least[t] < d,
        }
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, f in enumerate(order, 1):
                row = out[part, order, step]
                row["redundant"] += fails[f] and gone
                row["unique_fails"] += fails[f] and sum(fails.values()) == 1
                now = fails[f] and not gone
                row["removed"] += now
                row["good_lost"] += now and d in good
                row["toxic_lost"] += now and d in toxic
                gone |= now
                row["kept"] += not gone
                removed[part, f] += now
    return {(p, o, s): tuple(row[c] for c in filter_audit.COUNTS) + (removed[p, o[s - 1]],) for (p, o, s), row in out.items()}


def audited(spark, docs, labels):
    rows = spark.createDataFrame(docs, "doc_id long, source string, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = filter_audit.replay(filter_audit.flags(rows, marks)).collect()
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in (*filter_audit.COUNTS, "shapley")) for r in found}


def test_filter_audit(spark, plain):
    draw = random.Random(5)
    junk = ["A B C " * 100, "x # y", "word " * 300, "Ä Ö Ü É" * 80]
    docs = [(d, draw.choice(["web", "mail", None, ""]), t) for d, t in plain] + [(1000 + i, "web", t) for i, t in enumerate(junk * 2)]
    docs += [(1001, "web", junk[1]), (None, "mail", junk[0]), (None, None, None), (2, "mail", None)]
    labels = [(d, draw.randint(0, 1), draw.randint(0, 1)) for d, *_ in docs if d is not None] + [(0, None, None), (None, 1, 1), (1000, 1, 1), (1000, 0, 0)]
    want = plain_audit(docs, labels)
    assert audited(spark, docs, labels) == want and len(want) == 600 * len({p for p, *_ in want})


def test_filter_audit_other_rows(spark):
    assert audited(spark, [], []) == {}
    clash = spark.createDataFrame([(1, "s", "text", 5, "x", 1, 2)], "doc_id long, source string, text string, part int, fails string, step int, bits int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.replay(filter_audit.flags(clash, labels)).count() == 600
    # two filters of another alphabet, and rows of one doc_id that are equal: neither fails E
    rows = spark.createDataFrame([(1, "s", "a b"), (1, "s", "a b"), (2, "s", "a b")], "doc_id long, source string, text string")
    assert sorted(r.fails for r in filter_audit.flags(rows, labels).collect()) == [1, 1, 17]
    long = spark.createDataFrame([(1, "s", "ab cd " * 700_000), (2, "s", "x" * 3_000_000)], "doc_id long, source string, text string")
    assert sorted((r.doc_id, r.fails) for r in filter_audit.flags(long, labels).collect()) == [(1, 2), (2, 1)]


# --- periodic runs


def plain_runs(x, least=12):
    """(start, end, smallest period) of all runs: every period tried."""
    out = {}
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i + q < len(x):
            s = i
            while i + q < len(x) and x[i] == x[i + q]:
                i += 1
            if i - s >= q and i - s + q >= least:
                out.setdefault((s, i + q), q)
            i = max(i, s + 1)
    return sorted((s, e, q) for (s, e), q in out.items())


def sequences(n, seed=2):
    draw = random.Random(seed)
    for _ in range(n):
        k = draw.choice([1, 2, 2, 3, 5, 30])
        x = [draw.randrange(k) for _ in range(draw.randint(0, 150))]
        kind = draw.random()
        if kind < 0.3 and x:
            x = x[: draw.randint(1, len(x))] * draw.randint(1, 6)
        elif kind < 0.5:
            x = x[:20] * 3 + x + x[:20] * 2 + x[5:60] + x[:20] * 3
        elif kind < 0.6:
            a, b = [0], [0, 1]
            while len(b) < 200:
                a, b = b, b + a
            x = b[: draw.randint(20, 200)]
        elif kind < 0.7:
            x = [bin(i).count("1") % 2 for i in range(draw.randint(10, 300))]
            x += x[:100]
        yield x


@pytest.mark.parametrize("least", [2, 6, 12])
def test_runs_of_sequences(least):
    """Random, periodic, nested, Fibonacci and Thue-Morse sequences, many in one block."""
    texts = list(sequences(400))
    for at in range(0, len(texts), 8):
        some = texts[at : at + 8]
        first = np.concatenate(([0], np.cumsum([len(x) for x in some])))
        found = periodic_runs.runs_of(mix(np.array([v for x in some for v in x], np.uint64) + np.uint64(9)), first, least)
        for i, x in enumerate(some):
            own = found[(found[:, 0] >= first[i]) & (found[:, 0] < first[i + 1])]
            assert [(s - first[i], e - first[i], q) for s, e, q in own.tolist()] == plain_runs(x, least)


def test_previous_factors_and_blocks():
    for x in list(sequences(60, seed=7)):
        if not x:
            continue
        first = np.array([0, len(x)])
        factors = periodic_runs.Factors(np.array(x, np.int64), np.zeros(len(x), np.int64), first)
        assert factors.order.tolist() == sorted(range(len(x)), key=lambda i: x[i:])
        length, source = periodic_runs.previous_factors(factors)

        def common(i, j, x=x):
            n = 0
            while max(i, j) + n < len(x) and x[i + n] == x[j + n]:
                n += 1
            return n

        for i in range(len(x)):
            assert length[i] == max((common(i, j) for j in range(i)), default=0)
            assert not length[i] or (source[i] < i and common(i, int(source[i])) == length[i])
        starts, counts = periodic_runs.lz_blocks(length, first)
        assert counts.tolist() == [len(starts)] and all(b - a == max(1, length[a]) for a, b in zip(starts, [*starts[1:], len(x)], strict=True))


def plain_detect(doc, text, least=12):
    w = words(text)
    n, h = len(w), zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a, p = (h // 10) % n, 1 + (n - (h // 10) % n) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    runs = plain_runs(w, least)
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    best = min(((-(e - s), s, q) for s, e, q in runs), default=None)
    listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(runs), best and best[1], best and -best[0], best and best[2], best and 1000 * -best[0] // best[2], sha(listed), sha(kept))


def test_periodic_runs(spark, plain):
    draw = random.Random(8)
    rows = [(d, t) for d, t in plain if not t or len(t) < 20000]
    rows += [(5000 + i, " ".join(f"w{v}" for v in x) + draw.choice(["", "\n"])) for i, x in enumerate(sequences(80, seed=4))]
    rows += [(9, rows[20][1]), (9, rows[20][1]), (None, "a b " * 20), (None, None)]
    found = periodic_runs.detect(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), reorder=periodic_runs.planted).collect()
    have = Counter((r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in found)
    assert have == Counter((d, *plain_detect(d, t)) for d, t in rows)
    assert sum(zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows) > 5 and max(r.n_runs for r in found) > 3
    for r in found:
        assert [(x.start, x.start + x.length, x.period) for x in r.runs] == sorted((x.start, x.start + x.length, x.period) for x in r.runs)


def test_periodic_runs_other_rows(spark):
    assert periodic_runs.detect(spark.createDataFrame([], SCHEMA)).count() == 0
    clash = spark.createDataFrame([(1, "a b " * 20, 7, 8)], "doc_id long, text string, runs int, period int")
    assert [(r.doc_id, r.n_runs, r.period, r.collapsed) for r in periodic_runs.detect(clash).collect()] == [(1, 1, 2, "a b")]
    with pytest.raises(ValueError):
        periodic_runs.detect(clash, keep=("doc_id", "runs"))
    # texts of several megabytes: one word, one long period, and no period at all
    draw = random.Random(1)
    long = [(1, "ab " * 800_000), (2, " ".join(f"w{draw.randrange(10**6)}" for _ in range(100_000)) * 5), (3, " ".join(f"w{draw.randrange(10**6)}" for _ in range(400_000))), (4, "x" * 4_000_000)]
    found = {r.doc_id: (r.n_runs, r.start, r.period) for r in periodic_runs.detect(spark.createDataFrame(long, "doc_id long, text string")).collect()}
    assert found[1] == (1, 0, 1) and found[2][0] == 1 and found[2][2] in (99_999, 100_000) and found[3] == found[4] == (0, None, None)


# --- sharding


def sharded(spark, rows, shards=8):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    records = sharding.records(docs)
    sizes = sharding.slot_sizes(records)
    shard_of = sharding.rebalanced(sharding.even(shards=shards), sizes, shards)
    table = spark.createDataFrame(list(enumerate(shard_of)), "vslot int, shard int")
    return sharding.placed(records, table).collect(), records, sizes


def test_sharding(spark, plain):
    rows = [*plain, (None, "x"), (None, "x"), (3, plain[0][1]), (3, plain[0][1]), (777, "é" * 1_000_000)]
    found, _, _ = sharded(spark, rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    places = defaultdict(list)
    for r in found:
        places[r.shard].append(r.slot)
    assert all(sorted(own) == list(range(len(own))) for own in places.values()) and set(places) <= set(range(8))
    assert all(len({r.shard for r in found if r.doc_id == d}) == 1 for d in {r.doc_id for r in found} - {None})


def test_sharding_query(spark):
    found = catalog.queries()["op13_sharding"](spark, SF)
    assert found.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and dict(found.dtypes)["grown_shard"] == "int"
    rows = found.collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: (r["size"], r.text_crc32, r.law) for r in rows} == {d: (len(t.encode()) + 1, zlib.crc32(t.encode()), "bytes") for d, t in docs.items()} and len(rows) == len(docs)
    load = Counter()
    for r in rows:
        load[r.shard] += r["size"]
    assert max(load.values()) - min(load.values()) <= 0.001 * sum(load.values()) / 8
    assert sorted(r.slot for r in rows if r.shard == 0) == list(range(sum(r.shard == 0 for r in rows)))


def test_sharding_other_rows(spark):
    assert sharded(spark, [])[0] == []
    clash = spark.createDataFrame([(1, "a", 5, 6, 7)], "doc_id long, text string, shard int, vslot int, part int")
    records = sharding.records(clash)
    assert [tuple(r) for r in sharding.placed(records, spark.createDataFrame(list(enumerate(sharding.even())), "vslot int, shard int")).select("doc_id", "size", "slot").collect()] == [(1, 2, 0)]


@pytest.mark.parametrize("seed", range(6))
def test_map_edits(seed):
    draw = random.Random(seed)
    sizes = {s: int(draw.paretovariate(1.3) * 1000) for s in range(4096) if draw.random() < 0.9}
    total = sum(sizes.values())

    def load(shard_of, n):
        out = [0] * n
        for slot, size in sizes.items():
            out[shard_of[slot]] += size
        return out

    first = sharding.rebalanced(sharding.even(), sizes, 8)
    even = load(first, 8)
    assert max(even) - min(even) <= max(0.0005 * total / 8, max(sizes.values()) * 2 - total / 8)
    # a map that is near equal is left alone; growth moves slots into the new shard alone
    assert sharding.rebalanced(first, sizes, 8) == first
    more = sharding.grown(first, sizes, 8)
    assert all(b in (a, 8) for a, b in zip(first, more, strict=True))
    nine = load(more, 9)
    if max(sizes.values()) < total / 100:
        assert max(nine) < 1.03 * total / 9 and min(nine) > 0.97 * total / 9
    # new bytes on some slots: few move
    for s in draw.sample(sorted(sizes), 40):
        sizes[s] *= 3
    again = sharding.rebalanced(more, sizes, 9)
    assert sum(a != b for a, b in zip(more, again, strict=True)) < 400


def test_map_versions(spark, plain, tmp_path):
    """Versions are kept, and another session goes on from the last."""
    _, records, sizes = sharded(spark, [(d, t) for d, t in plain])
    one = sharding.SlotMap(spark, str(tmp_path / "map"))
    assert one.versions() == [] and one.save(sharding.even()) == 0 and one.rebalance(records, 8) == 1
    other = sharding.SlotMap(spark.newSession(), str(tmp_path / "map"))
    assert other.grow(records, 8) == 2 and other.versions() == [0, 1, 2]
    assert other.load(0) == sharding.even() and other.load(1) == sharding.rebalanced(sharding.even(), sizes, 8)
    moved = [(a, b) for a, b in zip(other.load(1), other.load(), strict=True) if a != b]
    assert moved and all(b == 8 for _, b in moved)
