"""What the findings of round 4 named, each on the smallest rows that show it."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_findings_r03 import both, copy_with
from test_functions import LISTING, listing

from tessaria.operators import components, hamming, linkage
from tessaria.operators.workspace import Workspace
from tessaria.plans import linking

#: Numbers of parts whose hashes differ in nine bits.
PAIR = (30369, 33151)


def made_lines(parts, shift=0):
    """Lines of these parts, each by forty suppliers."""
    return f"SELECT t.* REPLACE (p::BIGINT AS l_partkey, (s + {shift})::BIGINT AS l_suppkey, (1 + s % 3)::INTEGER AS l_linenumber, 10::DOUBLE AS l_quantity, 9000.0 + 400 * (s % 5) AS l_extendedprice) FROM (SELECT * FROM {{t}} LIMIT 1) t, (SELECT unnest({list(parts)}) AS p), range(40) a(s)"


@pytest.mark.parametrize("name", ["link_cascade", "link_components"])
@pytest.mark.parametrize(("parts", "shift"), [(PAIR, 0), ((1, 2, 3), 99_990), ((1, 2, 3), 250_000_000), ((2**23 - 1, 2**23, 2**23 + 4, 7, 3_000_000_000), 0)])
def test_f2_pairs_are_of_one_part(spark, tmp_path, name, parts, shift):
    """Parts whose numbers hash alike, suppliers past the twin's steps, and parts past the code's words."""
    assert both(spark, copy_with(tmp_path, "lineitem", made_lines(parts, shift)), name) == ""


def test_f2_photos_of_parts_are_apart(spark):
    """Words of the code differ in eleven bits or more: no two of 20,000 parts have near photos."""
    words = np.zeros(1, dtype=np.uint64)
    for i in range(linking.CODE_BITS):
        words = np.concatenate([words, words ^ np.uint64(linking.CODE << i)])
    assert np.bitwise_count(words[1:]).min() == 11
    rows = spark.range(20_000).select(linking.part_photos(F.col("id"), F.lit(0).cast("long")).alias("h"))
    photos = np.array([r.h for r in rows.collect()]).view(np.uint64)
    assert photos.shape == (20_000, 1) and set((photos[:, 0] >> np.uint64(linking.LOW_BITS)).tolist()) <= set(words.tolist())
    assert len(set((photos[:, 0] >> np.uint64(linking.LOW_BITS)).tolist())) == 20_000


def near_values(rng, flips=13):
    values = set()
    for h in rng.integers(0, 2**63 - 1, 25).tolist() * 8:
        for bit in rng.choice(63, int(rng.integers(0, flips)), replace=False).tolist():
            h ^= 1 << bit
        values.add(h)
    return sorted(values), {(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 10}


def test_f1_f3_near_hashes_write_each_hash_once(spark, monkeypatch):
    """Keys of hashes are compared in memory: nothing of many rows a hash is written."""
    written = {}
    real = Workspace.write
    monkeypatch.setattr(Workspace, "write", lambda self, df, name: written.setdefault(name, real(self, df, name)))
    values, want = near_values(np.random.default_rng(4))
    found = linkage.near_hashes(Workspace(spark, "test"), spark.createDataFrame([(h,) for h in values], "hash long"))
    assert {tuple(r) for r in found.collect()} == want and sum(df.count() for df in written.values()) == len(values)


@pytest.mark.parametrize("segments", [12, 15])
def test_f1_f3_crowded_groups_are_compared_by_blocks(spark, monkeypatch, segments):
    """Each near pair comes once, also where a group of hashes is dealt to blocks and where all hashes begin alike."""
    monkeypatch.setattr(hamming, "TILE", 7)
    values, want = near_values(np.random.default_rng(6))
    found = hamming.near_pairs(spark.createDataFrame([(h,) for h in values], "hash long"), len(values), segments, 10).collect()
    assert len(found) == len(want) and {tuple(r) for r in found} == want and len(want) > 100


def test_f1_f3_verdicts_equal_those_of_all_pairs(spark):
    rng = np.random.default_rng(9)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    rows = [
        listing(i, property_id=int(rng.integers(1000)), source=pick("abc"), agency=pick([None, "p", "q"]), kind=pick([None, "particular", "agency"]), cadastral=pick([None, None, None, "C1", "C2"]), code=pick([None, None, "r123", "r123-1", "r123-2", "r22"]), address=pick([None, "calle a 1", "calle a 2", "plaza b 9"]), floor=pick([None, "1", "2"]),
                lat=40.0001 + int(rng.integers(9)) * 0.00005, lon=-3 + int(rng.integers(9)) * 0.00006, m2=pick([None, 50.0, 51.0, 80.0]), price=pick([100.0, 104.0, 120.0, 150.0, None]), rooms=pick([0, 1, 2, 4]), phones=pick([[], [], ["6"], ["6", "7"], ["8", "7"]]), hashes=pick([[], [], [7], [7, 2**40], [2**11 - 1 + 2**60], [2**10 - 1]]))
        for i in range(150)
    ]
    df = spark.createDataFrame(rows, LISTING)
    x, y = df.alias("x"), df.alias("y")
    on = (F.col("x.listing_id") < F.col("y.listing_id")) & (F.col("x.source") != F.col("y.source")) & (F.col("x.property_id") != F.col("y.property_id"))
    every = linkage.cascade(x.join(y, on).select(F.col("x.listing_id").alias("a"), F.col("y.listing_id").alias("b")), df).collect()
    phones = {r[0]: set(r[14]) for r in rows}
    kept = lambda r: r.decision in ("merge", "suggest") or (r.basis != "none" and phones[r.a] & phones[r.b])
    want = {(r.a, r.b): tuple(r)[2:] for r in every if kept(r)}
    found = [r for r in linkage.verdicts(df).collect() if kept(r)]
    assert len(found) == len(want) and {(r.a, r.b): (r.basis, r.decision, r.confidence) for r in found} == want
    assert {b for b, _, _ in want.values()} >= {"cadastral", "code_conflict", "address_coords", "reference_code", "price_gap", "photo_hash", "phone"}


def test_f1_links_are_cut_to_a_forest(spark):
    """A group of n listings that are all linked sends n - 1 links to the components, not n (n - 1) / 2."""
    links = [(100 * g + i, 100 * g + j) for g in range(5) for i in range(20) for j in range(i + 1, 20)]
    cut = components.forest(spark.createDataFrame(links, "a long, b long").coalesce(1)).collect()
    assert {tuple(r) for r in cut} == {(100 * g, 100 * g + i) for g in range(5) for i in range(1, 20)}
