"""Connected components of an edge table: by least-label propagation with pointer jumping; by order of confidence where vetoed
pairs must stay apart; and kept up to date by deliveries of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaria.operators.store import KeyedTable, latest_wins
from tessaria.operators.workspace import Workspace


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = np.concatenate([np.asarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in (0, 1)])
        nodes, at = np.unique(ends, return_inverse=True)
        a, b = at[: len(ends) // 2], at[len(ends) // 2 :]
        label = np.arange(len(nodes))
        while True:
            least = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, a, least)
            np.minimum.at(new, b, least)
            new = new[new]
            if (new == label).all():
                break
            label = new
        told = np.flatnonzero(label != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[label[told]]), pa.array(nodes[told])], ["a", "b"])


def forest(edges: DataFrame) -> DataFrame:
    """Links (a < b) with the same components as those given: in each Arrow batch a node keeps one, to the least node that the
    batch's links lead to. Nothing is shuffled."""
    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(_joined, "a long, b long")


def components(space: Workspace, edges: DataFrame, name: str = "labels") -> DataFrame:
    """(a, b) links to (node, label): label is the least node of its component.

    A round takes the least label among a node's neighbours, then the label of that label, so long chains shorten by
    halves. Every round is written to the shared folder; joins read written tables, so that adaptive execution can
    split the rows of a popular label. They are merge joins, as broadcasts would bring all labels to the driver twice a
    round. Repeated and reversed links and self-links do no harm.
    """
    both = space.write(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}_both")
    labels = space.write(both.groupBy("a").agg(F.min("b").alias("near")).select(F.col("a").alias("node"), F.least("a", "near").alias("label")), f"{name}_0")
    # labels only ever fall, so equal sums mean that nothing has changed
    total = lambda x: x.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
    round_, before = 0, total(labels)
    while True:
        near = both.join(labels.withColumnRenamed("node", "b").hint("merge"), "b").select(F.col("a").alias("node"), "label")
        step = space.write(labels.union(near).groupBy("node").agg(F.min("label").alias("label")), f"{name}_{round_}_step")
        far = step.select(F.col("node").alias("label"), F.col("label").alias("far"))
        jumped = step.join(far.hint("merge"), "label").select("node", F.least("label", "far").alias("label"))
        new = space.write(jumped, f"{name}_{round_ + 1}")
        after = total(new)
        space.drop(f"{name}_{round_}_step")
        space.drop(f"{name}_{round_}")
        labels, round_ = new, round_ + 1
        if before == after:
            return labels
        before = after


def ordered_components(space: Workspace, edges: DataFrame, vetoes: DataFrame, name: str = "ordered") -> DataFrame:
    """(a, b, confidence) links to (node, label) as if links were followed one by one by falling confidence (equal ones by a
    hash of the pair), each unless it would bring a vetoed pair (lo, hi) together.

    Components without a vetoed pair are plain ones. In the others a round decides every link that comes first among those
    of both its groups: nothing before it touches them, so its turn has come. It joins the two groups, or is dropped with
    all others between them if they hold a vetoed pair. Hashed ties keep the rounds few.
    """
    links = space.write(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "confidence").groupBy("a", "b").agg(F.max("confidence").alias("confidence")), f"{name}_links")
    labels = components(space, links, f"{name}_plain")
    apart = vetoes.filter("lo <> hi").select(F.least("lo", "hi").alias("x"), F.greatest("lo", "hi").alias("y")).distinct()
    side = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"_{c}"))
    held = space.write(apart.join(side("x"), "x").join(side("y"), "y").filter("_x = _y").select("x", "y", F.col("_x").alias("label")), f"{name}_held")
    mixed = held.select("label").distinct()
    free = labels.join(mixed, "label", "left_anti").select("node", "label")
    own = space.write(labels.join(mixed, "label", "left_semi").select("node", F.col("node").alias("label")), f"{name}_own0")
    order = F.struct("confidence", F.xxhash64("a", "b").alias("tie"), "a", "b")
    rest = links.join(own.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("a").alias("x"), F.col("b").alias("y"), order.alias("turn"))
    rest, banned = space.write(rest, f"{name}_rest0"), space.write(held.select("x", "y"), f"{name}_banned0")
    round_ = 0
    while not rest.isEmpty():
        round_ += 1
        both = rest.select("x", "turn").union(rest.select(F.col("y").alias("x"), "turn"))
        first = space.write(both.groupBy("x").agg(F.max("turn").alias("turn")), f"{name}_first{round_}")
        due = rest.join(first, ["x", "turn"], "left_semi").join(first.withColumnRenamed("x", "y"), ["y", "turn"], "left_semi").select("x", "y")
        due = space.write(due, f"{name}_due{round_}")
        joined = space.write(due.join(banned, ["x", "y"], "left_anti").select(F.col("y").alias("old"), F.col("x").alias("new")), f"{name}_joined{round_}")
        moved = lambda df, c: df.join(joined.withColumnsRenamed({"old": c, "new": "_new"}), c, "left").withColumn(c, F.coalesce("_new", c)).drop("_new")  # noqa: E731, B023
        pairs = lambda df, *more: moved(moved(df, "x"), "y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), *more).filter("x <> y")  # noqa: E731, B023
        left = pairs(rest.join(due, ["x", "y"], "left_anti"), "turn").groupBy("x", "y").agg(F.max("turn").alias("turn"))
        own = space.write(moved(own, "label"), f"{name}_own{round_}")
        banned = space.write(pairs(banned).distinct(), f"{name}_banned{round_}")
        rest = space.write(left, f"{name}_rest{round_}")
    return free.unionByName(own)


class MergedGroups:
    """Groups kept in a folder and fed by deliveries of links (a, b, confidence). A delivery touches only the components that
    its links reach: their stored links and the new ones are followed again, in order of confidence, and only rows of nodes
    whose group changed are written. So k deliveries give what one gives."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.nodes = KeyedTable(spark, f"{path}/nodes", "node long, component long, label long", ["node"], buckets)
        self.links = KeyedTable(spark, f"{path}/links", "a long, b long, confidence double, component long", ["a", "b"], buckets)
        self.spark = spark

    def labels(self) -> DataFrame:
        return self.nodes.read().select("node", "label")

    def add(self, links: DataFrame, number: int, vetoes: DataFrame | None = None) -> None:
        """Delivery ``number`` (in rising order) of links, under the vetoes (lo, hi) that hold now; pairs that a veto has parted
        after they were joined come apart when a delivery touches their component."""
        space = Workspace(self.spark, "groups")
        new = space.write(links.filter("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("confidence").alias("confidence")), "new")
        stored, kept = self.nodes.read(), self.links.read()
        # merge joins throughout: no delivery is broadcast by way of the driver
        named = lambda c: stored.select(F.col("node").alias(c), F.col("component").alias(f"_{c}")).hint("merge")
        met = new.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
        renamed = space.write(components(space, met, "met").select(F.col("node").alias("component"), F.col("label").alias("_now")), "renamed").hint("merge")
        old_links = kept.join(renamed, "component").select("a", "b", "confidence", F.col("_now").alias("component"))
        ends = new.join(named("a"), "a", "left").select("a", "b", "confidence", F.coalesce("_a", "a").alias("component")).join(renamed, "component").select("a", "b", "confidence", F.col("_now").alias("component"))
        every = space.write(old_links.unionByName(ends).groupBy("a", "b").agg(F.max("confidence").alias("confidence"), F.first("component").alias("component")), "every")
        of_node = every.select(F.col("a").alias("node"), "component").union(every.select("b", "component")).distinct()
        # without vetoes a component is a group
        named_now = of_node.withColumn("label", F.col("component")) if vetoes is None else of_node.join(ordered_components(space, every, vetoes).hint("merge"), "node")
        now = space.write(named_now.select("node", "component", "label"), "now")
        same = lambda table, df: df.join(table.hint("merge"), df.columns, "left_anti")
        self.nodes.apply(same(stored, now), number, latest_wins(["node"]))
        self.links.apply(same(kept, every), number, latest_wins(["a", "b"]))
