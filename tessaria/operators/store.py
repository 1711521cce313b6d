"""Keyed tables in a folder: upserts rewrite only the buckets of the keys that a delivery has.

Rows are dealt to ``bucket`` partitions by a hash of their key. A delivery meets the rows of its buckets in one join, dealt by
slots of a bucket so that a task's rows belong to few buckets, and dynamic partition overwrite puts the result in the place of
those buckets once all tasks are done; until then repeated tasks read the same old files. Deliveries are numbered; rows remember
the last one that touched them, so a delivery that comes again, or was cut off half-way and is repeated, changes nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaria.operators.ingest import adoptable
from tessaria.operators.workspace import Workspace

BUCKET, DELIVERY, SLOT = "bucket", "delivery", "_slot"
#: A bucket is dealt to so many tasks, each of which writes a file of it.
SLOTS = 8

#: Gives the table's columns of a key from its old row ``o.*`` and its new one ``n.*``; ``was`` and ``came`` tell which are there.
Merge = Callable[[Sequence[str], Column, Column], list[Column]]


class KeyedTable:
    """Opens a table of the given columns (DDL, without bucket and delivery), or starts one."""

    def __init__(self, spark: SparkSession, path: str, columns: str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets
        self.schema = f"{columns}, {DELIVERY} long, {BUCKET} int"
        self.columns = [f.name for f in spark.createDataFrame([], self.schema).schema][:-2]
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            spark.createDataFrame([], self.schema).write.mode("ignore").partitionBy(BUCKET).parquet(self.path)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def stored(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def read(self) -> DataFrame:
        return self.stored().drop(BUCKET, DELIVERY)

    def staged(self, new: DataFrame) -> DataFrame:
        """A delivery written once with its buckets; ``apply`` and ``update`` take it as it is."""
        return Workspace(self.spark, "delivery").write(new.withColumn(BUCKET, self.bucket()), "new")

    def apply(self, new: DataFrame, number: int, merge: Merge) -> None:
        """Merges delivery ``number`` (one row per key; as it is or ``staged``). A new row whose key has had this delivery or a
        later one counts as not there; buckets without any other new row are left alone."""
        came = new if BUCKET in new.columns else self.staged(new)
        touched = _buckets(came)
        had = self.stored().filter(F.col(BUCKET).isin(touched) & (F.col(DELIVERY) >= number))
        if touched and not had.isEmpty():  # keys alone tell which buckets have something new
            touched = _buckets(came.select(*self.keys, BUCKET).join(had.select(*self.keys).hint("merge"), self.keys, "left_anti"))
        if not touched:
            return
        there = F.lit(True).alias("_there")
        n = self._dealt(came.filter(F.col(BUCKET).isin(touched)).select("*", there)).alias("n")
        o = self._dealt(self.stored().filter(F.col(BUCKET).isin(touched)).select("*", there)).alias("o")
        both = o.join(n.hint("merge"), self._same(), "full")
        was = F.col("o._there").isNotNull()
        fresh = F.col("n._there").isNotNull() & ~F.coalesce(F.col(f"o.{DELIVERY}") >= number, F.lit(False))
        last = F.greatest(F.when(fresh, F.lit(number).cast("long")), F.col(f"o.{DELIVERY}")).alias(DELIVERY)
        self._replace(both.select(*merge(self.columns, was, fresh), last, F.coalesce(f"o.{BUCKET}", f"n.{BUCKET}").alias(BUCKET)))

    def update(self, changed: DataFrame) -> None:
        """Puts ``changed`` (the table's columns, stored keys alone) in the place of the rows of their keys."""
        rows = self.staged(changed.select(*self.columns))
        touched = _buckets(rows)
        if touched:
            n = self._dealt(rows.withColumn("_there", F.lit(True))).alias("n")
            o = self._dealt(self.stored().filter(F.col(BUCKET).isin(touched))).alias("o")
            new = [F.when(F.col("n._there"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in self.columns]
            self._replace(o.join(n.hint("merge"), self._same(), "left").select(*new, f"o.{DELIVERY}", f"o.{BUCKET}"))

    def _dealt(self, rows: DataFrame) -> DataFrame:
        slot = F.col(BUCKET) * SLOTS + F.pmod(F.hash(*self.keys), F.lit(SLOTS))
        return rows.withColumn(SLOT, slot).repartition(SLOT)

    def _same(self) -> list[Column]:
        return [F.col(f"o.{c}") == F.col(f"n.{c}") for c in (SLOT, *self.keys)]

    def _replace(self, rows: DataFrame) -> None:
        """``rows`` hold whole buckets, those of a bucket in few tasks."""
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)


def _buckets(rows: DataFrame) -> list[int]:
    return [r[0] for r in rows.select(BUCKET).distinct().collect()]  # at most as many as there are buckets


def canonical_merge(keys: Sequence[str], price: str, fill: Sequence[str] = (), lists: Sequence[str] = (), overwrite: Sequence[str] = (), at: str = "seen") -> Merge:
    """The canonical overlay: ``fill`` columns keep the old value where the new is null, ``lists`` where the new is empty too,
    ``overwrite`` columns take the new row's as they are, the price moves if it is adoptable; first_seen stays, last_seen and
    last_fetched move on by ``at`` (never back), and missed starts again from 0. Untouched rows stay."""

    def merge(columns: Sequence[str], was: Column, came: Column) -> list[Column]:
        new = lambda c: F.when(came, F.col(f"n.{c}"))
        old, now = F.col(f"o.{price}"), new(price)
        made = {c: F.coalesce(new(c), f"o.{c}") for c in fill} | {c: F.coalesce(f"o.{c}", f"n.{c}") for c in keys}
        made |= {c: F.coalesce(F.when(F.size(new(c)) > 0, new(c)), F.col(f"o.{c}"), new(c)) for c in lists}
        made |= {c: F.when(came, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) for c in overwrite}
        made |= {price: F.when(came & adoptable(old, now), F.coalesce(now, old)).otherwise(old)}
        made |= {"first_seen": F.coalesce("o.first_seen", new(at))} | {c: F.greatest(f"o.{c}", new(at)) for c in ("last_seen", "last_fetched")}
        made |= {"missed": F.when(came, 0).otherwise(F.col("o.missed"))}
        return [made[c].alias(c) for c in columns]

    return merge


def keep_first(keys: Sequence[str]) -> Merge:
    """Rows that are there stay as they are; only new keys come in."""
    return lambda columns, was, came: [F.when(was, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in columns]


def latest_wins(keys: Sequence[str]) -> Merge:
    """New rows take the place of those of their keys."""
    return lambda columns, was, came: [F.when(came, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in columns]


def one_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool = True) -> DataFrame:
    """The last (or first) row of each key by ``order``, whole rows deciding ties, so that a repeated task picks the same."""
    rest = [c for c in rows.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    chosen = pick(F.struct(*rest), F.struct(*(F.col(c).alias(f"_{i}") for i, c in enumerate([*order, *(c for c in rest if c not in order)]))))
    return rows.groupBy(*keys).agg(chosen.alias("_r")).select(*keys, "_r.*").select(*rows.columns)
