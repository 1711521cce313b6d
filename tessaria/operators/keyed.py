"""Per-key operators: latest row, sessions, runs, moves, rankings, paging."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaria.operators.workspace import Workspace

Cols = Sequence[str]


def latest_per_key(df: DataFrame, keys: Cols, order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order (ties must be broken by the order). Spark keeps only each task's
    first rows before the shuffle (window group limit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def latest_value(value: str, at: str, tie: str) -> Column:
    """The value of the newest row, as an aggregate: combines before the shuffle, unlike a window."""
    return F.max_by(value, F.struct(at, tie))


def moves(df: DataFrame, keys: Cols, order: Sequence[Column], value: str) -> DataFrame:
    """Adds ``previous``, the value one row before in the key's order."""
    return df.withColumn("previous", F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))


def sessionize(df: DataFrame, keys: Cols, ts: str, gap_minutes: int, zone: str = "Europe/Madrid") -> DataFrame:
    """Adds ``session``: counts up at a key's first row, after a gap of more than ``gap_minutes``, and where the local
    day changes. ``ts`` is a UTC timestamp and unique in its key."""
    w = Window.partitionBy(*keys).orderBy(ts)
    before = F.lag(ts).over(w)
    day = lambda c: F.to_date(F.from_utc_timestamp(c, zone))
    gap = F.unix_micros(F.col(ts)) - F.unix_micros(before) > gap_minutes * 60_000_000
    starts = F.when(before.isNull() | gap | (day(F.col(ts)) != day(before)), 1).otherwise(0)
    return df.withColumn("_new", starts).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def trailing_run(df: DataFrame, keys: Cols, order: str, hit: Column) -> DataFrame:
    """Per key: ``run`` (rows at the end for which ``hit`` holds), ``rows``, ``run_start`` (order value where the run begins)
    and ``before`` (whether any earlier row misses)."""
    later = Window.partitionBy(*keys).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    open_ = F.sum(F.when(hit, 0).otherwise(1)).over(later) == 0
    marked = df.withColumn("_open", open_)
    return marked.groupBy(*keys).agg(F.count_if("_open").alias("run"), F.count("*").alias("rows"), F.min(F.when(F.col("_open"), F.col(order))).alias("run_start"), F.coalesce(F.bool_or(~F.col("_open")), F.lit(False)).alias("before"))


def lexicographic(cursor: Sequence[tuple[Column, object, bool]]) -> Column:
    """Rows after a cursor in a multi-key order: (column, cursor value, descending), highest key first."""
    steps, equal = [], F.lit(True)
    for column, value, descending in cursor:
        steps.append(equal & ((column < F.lit(value)) if descending else (column > F.lit(value))))
        equal = equal & (column == F.lit(value))
    return reduce(lambda a, b: a | b, steps)


def keyset_page(df: DataFrame, cursor: Sequence[tuple[Column, object, bool]], order: Sequence[Column], size: int) -> DataFrame:
    """The ``size`` rows after the cursor, plus one that tells whether there are more: a top-k, never a full sort."""
    return df.filter(lexicographic(cursor)).orderBy(*order).limit(size + 1)


def stale_nomination(df: DataFrame, due: Column, excluded: DataFrame, key: str, order: Sequence[Column], budget: int) -> DataFrame:
    """The first ``budget`` due rows whose key is not excluded."""
    return df.filter(due).join(excluded.select(key).distinct(), key, "left_anti").orderBy(*order).limit(budget)


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """All rows with their place from 1 on in ``order``, which must have no ties. Rows are sorted by ranges and numbered
    within them; only the counts of the ranges come together."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    rows = Workspace(df.sparkSession, "numbered").write(ranged.withColumns({"_range": F.shiftright(place, 33), "_at": place.bitwiseAND((1 << 33) - 1)}), "rows")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return rows.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_offset") + F.col("_at") + 1).drop("_range", "_at", "_offset")


def numbered_within(df: DataFrame, group: str, order: Sequence[Column], name: str) -> DataFrame:
    """All rows with their place from 1 on within their group (no nulls), in ``order`` without ties. A large group spreads over
    many ranges of rows; only its first place comes to all of them."""
    rows = numbered(df, (F.asc(group), *order), "_place")
    firsts = rows.groupBy(group).agg(F.min("_place").alias("_first"))
    return rows.join(firsts, group).withColumn(name, (F.col("_place") - F.col("_first") + 1).cast("int")).drop("_place", "_first")


def adjacent(df: DataFrame, group: str, order: Sequence[Column], key: str) -> DataFrame:
    """key, prev and next: the keys beside each row within its group, in ``order`` without ties. Rows meet their neighbours by
    number, so no task sorts a whole group."""
    rows = Workspace(df.sparkSession, "adjacent").write(numbered(df.select("*"), (F.asc(group), *order), "_place").select(F.col(group).alias("_group"), F.col(key).alias(key), "_place"), "rows")
    near = lambda step, name: rows.select((F.col("_place") + step).alias("_place"), F.col("_group").alias(f"_{name}"), F.col(key).alias(name))
    both = rows.join(near(1, "prev"), "_place", "left").join(near(-1, "next"), "_place", "left")
    return both.select(key, *(F.when(F.col(f"_{n}") == F.col("_group"), F.col(n)).alias(n) for n in ("prev", "next")))
