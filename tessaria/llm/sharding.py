"""Sharding by fixed virtual slots.

A record's key decides its virtual slot for good: one of ``SLOTS``, by a hash. Bytes are summed per slot, and a map says which
shard has which slot. The map is kept as numbered versions in a folder; a new version is the last one, edited: slots move
from the fullest shard to the emptiest until sizes are near equal (``rebalanced``), or from all shards to added ones alone
(``grown``). Slots that do not move keep their shard, and so do all their records.

Only the map and the bytes per slot (``SLOTS`` rows each, at most) reach the driver. Places in a shard are gapless: counts
per slot and part of a slot give each its first place, so no task numbers a whole shard.

A null text has no bytes (size 1, checksum of the empty text). Rows without doc_id are dealt by their row number. Repeated
rows share doc_id and so slot and shard, with places of their own; sizes are near equal as far as no doc_id alone holds
more than a shard's share. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessaria.operators.workspace import Workspace

SLOTS, PARTS, SHARDS = 4096, 64, 8
#: Largest difference of two shards that is left, as a part of the mean, where moves can still lessen it.
TOLERANCE = 0.0005


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, vslot; written once, as places follow from row numbers."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.monotonically_increasing_id().alias("_row"))
    key = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit("row"), "_row")).otherwise(F.xxhash64("doc_id"))
    return Workspace(docs.sparkSession, "sharding").write(rows.withColumn("vslot", F.pmod(key, F.lit(slots)).cast("int")), "records")


def even(slots: int = SLOTS, shards: int = SHARDS) -> list[int]:
    """The first map: equal numbers of neighbouring slots for each shard."""
    return [slot * shards // slots for slot in range(slots)]


def _nearest(own: list[tuple[int, int]], want: float, below: int) -> tuple[int, int] | None:
    """Of (size, slot) pairs in order the one of size 1 .. below - 1 that is nearest to ``want``."""
    i = bisect_left(own, (want, -1))
    fits = [own[j] for j in (i - 1, i) if 0 <= j < len(own) and 0 < own[j][0] < below]
    return min(fits, key=lambda x: (abs(x[0] - want), x)) if fits else None


def rebalanced(shard_of: list[int], sizes: dict[int, int], shards: int, tolerance: float = TOLERANCE) -> list[int]:
    """The map edited until the fullest and the emptiest shard differ by ``tolerance`` of the mean, or no move of a slot and no
    exchange of two between them lessens the difference. Every edit lessens the sum of squares, so it ends."""
    out = list(shard_of)
    own: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(out):
        own[shard].append((sizes.get(slot, 0), slot))
    for rows in own:
        rows.sort()
    load = [sum(size for size, _ in rows) for rows in own]
    room = tolerance * sum(load) / shards

    def move(pair: tuple[int, int], a: int, b: int) -> None:
        own[a].remove(pair)
        insort(own[b], pair)
        out[pair[1]] = b
        load[a] -= pair[0]
        load[b] += pair[0]

    while True:
        full, low = max(range(shards), key=lambda s: (load[s], -s)), min(range(shards), key=lambda s: (load[s], s))
        gap = load[full] - load[low]
        if gap <= room:
            return out
        pair = _nearest(own[full], gap / 2, gap)
        best = (abs(pair[0] - gap / 2), pair, None) if pair else None
        if best is None or best[0] > gap / 8:
            for other in own[low]:
                taken = _nearest(own[full], other[0] + gap / 2, other[0] + gap)
                if taken and taken[0] > other[0] and (best is None or abs(taken[0] - other[0] - gap / 2) < best[0]):
                    best = (abs(taken[0] - other[0] - gap / 2), taken, other)
        if best is None:
            return out
        move(best[1], full, low)
        if best[2]:
            move(best[2], low, full)


def _level(loads: list[int], new: int) -> float:
    """How full all end up where shards above the level give what they have above it to a new one."""
    level = float(new)
    for k, _ in enumerate(loads := sorted(loads, reverse=True)):
        level = (new + sum(loads[: k + 1])) / (k + 2)
        if k + 1 == len(loads) or level >= loads[k + 1]:
            break
    return level


def grown(shard_of: list[int], sizes: dict[int, int], shards: int, added: int = 1) -> list[int]:
    """The map with ``added`` shards more: slots move to the new shards and nowhere else, always from the fullest old one. A
    shard gives no more once its slots are too large for what it has above the level."""
    out = list(shard_of)
    for new in range(shards, shards + added):
        own: list[list[tuple[int, int]]] = [[] for _ in range(new)]
        for slot, shard in enumerate(out):
            own[shard].append((sizes.get(slot, 0), slot))
        for rows in own:
            rows.sort()
        load, got, giving = [sum(size for size, _ in rows) for rows in own], 0, set(range(new))
        while giving:
            full = max(giving, key=lambda s: (load[s], -s))
            above = load[full] - max(got, _level([load[s] for s in giving], got))
            pair = _nearest(own[full], above, int(2 * above)) if above > 0 else None
            if pair is None:
                giving.remove(full)
                continue
            own[full].remove(pair)
            load[full] -= pair[0]
            got += pair[0]
            out[pair[1]] = new
    return out


class SlotMap:
    """Versions of the map in a folder of the shared store; another session can open it again. A version is written whole and
    never changed, so a lost task repeats without harm."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and files.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS")))

    def save(self, shard_of: list[int]) -> int:
        version = max(self.versions(), default=-1) + 1
        rows = self.spark.createDataFrame(list(enumerate(shard_of)), "vslot int, shard int").coalesce(1)
        rows.write.mode("overwrite").parquet(f"{self.path}/v{version}")
        return version

    def table(self, version: int | None = None) -> DataFrame:
        return self.spark.read.schema("vslot int, shard int").parquet(f"{self.path}/v{max(self.versions()) if version is None else version}")

    def load(self, version: int | None = None) -> list[int]:
        return [r.shard for r in self.table(version).sort("vslot").collect()]

    def rebalance(self, rows: DataFrame, shards: int, tolerance: float = TOLERANCE) -> int:
        return self.save(rebalanced(self.load(), slot_sizes(rows), shards, tolerance))

    def grow(self, rows: DataFrame, shards: int, added: int = 1) -> int:
        return self.save(grown(self.load(), slot_sizes(rows), shards, added))


def slot_sizes(rows: DataFrame) -> dict[int, int]:
    return {r.vslot: r.bytes for r in rows.groupBy("vslot").agg(F.sum("size").alias("bytes")).collect()}


def placed(rows: DataFrame, slot_map: DataFrame, parts: int = PARTS) -> DataFrame:
    """Rows with their shard and ``slot``, the place there. Each virtual slot is numbered in ``parts`` parts by row, so that a
    hot slot is no task's alone."""
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("_row"), F.lit(parts)).cast("int"))
    counts = dealt.groupBy("vslot", "part").count().join(F.broadcast(slot_map), "vslot")
    before = Window.partitionBy("shard").orderBy("vslot", "part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("vslot", "part", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    number = F.row_number().over(Window.partitionBy("vslot", "part").orderBy("doc_id", "_row"))
    numbered = dealt.withColumn("number", number)
    return numbered.join(firsts, ["vslot", "part"]).select("doc_id", "size", "text_crc32", "vslot", "shard", (F.col("first") + F.col("number") - 1).alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with the map that even slots became by one rebalancing (law ``bytes``)."""
    rows = records(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    slot_map = SlotMap(spark, Workspace(spark, "slots").path)
    slot_map.save(even())
    slot_map.rebalance(rows, SHARDS)
    out = placed(rows, slot_map.table())
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
