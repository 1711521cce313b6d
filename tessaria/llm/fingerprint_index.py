"""Substring dedup with a log-structured fingerprint index, kept in a folder and fed by deliveries.

A fingerprint stands for the consecutive windows of ``WINDOW`` words that share one anchor: the anchor's key and the
context, a hash of all their words. The folder holds

* ``runs``: sorted immutable runs of fingerprints, bucketed by key, each with one document that has it;
* ``texts``: the texts of each delivery, bucketed by doc_id, on which matches are verified;
* ``state``: after every step a list of the runs, so an index can be opened again, in another session, and continued.

Each table has as many buckets as its own size asks for; a run that outgrows them gets more when it is compacted, so an index
that starts small does not stay narrow.

``add`` takes a delivery: its keys are merge-joined with every run; where a key has one context alone, that context
decides; where it has several, windows are verified one by one, by the hashes of their words taken from the texts of both
sides. A window goes if an earlier delivery has it, or a smaller document of its own delivery. Then the delivery's new
fingerprints are appended as a run, and runs of one level are compacted: by a merge join that shuffles nothing where their
buckets agree and suffice.

Nulls and empty texts have no words: n_words 0, the hash of the empty text. Texts under 50 words lose nothing. Repeated
texts lose all words but in the least document id. Rows of one doc_id in a delivery are one document, which takes nothing
from itself; rows without doc_id are left out. An empty delivery gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaria.llm.blocks import anchors, blocks, signed, word_hashes, words
from tessaria.llm.spans import BLOCK, K, WINDOW, anchor_rows, remove, texts_of, window_rows, windows_between
from tessaria.operators.workspace import Workspace

BATCHES = 4
#: What one bucket of texts and of fingerprints should hold, and the least number of buckets.
BUCKET_CHARS, BUCKET_PRINTS, LEAST_BUCKETS = 256_000_000, 4_000_000, 12
RUN, TEXT = "key BIGINT, context BIGINT, doc_id BIGINT", "doc_id BIGINT, version BIGINT, text STRING"


class FingerprintIndex:
    """Opens the index in a folder (of any file system that all executors share), or starts one there."""

    def __init__(self, spark: SparkSession, path: str, window: int = WINDOW, k: int = K):
        self.spark, self.path = spark, path.rstrip("/")
        self.mark = uuid.uuid4().hex
        self.attached: list[str] = []
        states = self._states()
        if states:
            rows = spark.read.text(max(states)).collect()
            self.state = json.loads(rows[0].value)
            if (self.state["window"], self.state["k"]) != (window, k):
                raise ValueError(f"the index has windows of {self.state['window']} words")
        else:
            self.state = {"window": window, "k": k, "made": 0, "runs": [], "texts": [], "buckets": {}, "prints": {}}

    def _states(self) -> list[str]:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/state")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        folders = [x.getPath() for x in fs.listStatus(path)] if fs.exists(path) else []
        return [x.toString() for x in folders if fs.exists(jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]

    def _save(self) -> None:
        """A state counts once it is whole, so a delivery that fails half-way leaves the index as it was."""
        self.state["saved"] = self.state.get("saved", 0) + 1
        self.spark.createDataFrame([(json.dumps(self.state),)], "value string").coalesce(1).write.text(f"{self.path}/state/{self.state['saved']:08d}")

    def _table(self, name: str, columns: str, key: str) -> DataFrame:
        """A table of the folder, with its buckets known to this session."""
        known = f"index_{self.mark}_{name.replace('/', '_').replace('-', '_')}"
        if known not in self.attached:
            self.spark.sql(f"CREATE TABLE {known} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {self.state['buckets'][name]} BUCKETS LOCATION '{self.path}/{name}'")
            self.attached.append(known)
        return self.spark.table(known)

    def _write(self, rows: DataFrame, folder: str, key: str, buckets: int) -> str:
        """Writes a bucketed table under a new name; rows are dealt by key already."""
        self.state["made"] += 1
        name = f"{folder}/{self.state['made']:08d}-{uuid.uuid4().hex[:8]}"
        known = f"index_{self.mark}_{name.replace('/', '_').replace('-', '_')}"
        self.state["buckets"][name] = buckets
        rows.write.bucketBy(buckets, key).sortBy(key).option("path", f"{self.path}/{name}").option("compression", "zstd").saveAsTable(known)
        self.spark.sql(f"DROP TABLE {known}")
        return name

    def run(self, name: str) -> DataFrame:
        return self._table(name, RUN, "key")

    def close(self) -> None:
        """Takes the index's tables out of the session's catalog; the folder stays."""
        for known in self.attached:
            self.spark.sql(f"DROP TABLE IF EXISTS {known}")
        self.attached = []

    def add(self, docs: DataFrame) -> DataFrame:
        """Indexes a delivery and gives the rows of ``spans.remove`` for its documents."""
        space = Workspace(self.spark, "fingerprints")
        window, k = self.state["window"], self.state["k"]
        texts = texts_of(docs)
        chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
        buckets = max(LEAST_BUCKETS, ceil(chars / BUCKET_CHARS))
        earlier = list(self.state["texts"])
        name = self._write(texts.repartition(buckets, "doc_id"), "texts", "doc_id", buckets)
        texts = self._table(name, TEXT, "doc_id")
        rows = space.write(anchor_rows(texts, window, k), "anchors")
        own = space.write(rows.groupBy("key", "context").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last")), "own")
        summary = space.write(own.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("last").alias("last"), F.min("context").alias("low"), F.max("context").alias("high")), "summary")

        met = self._met(space, summary)
        old = met.groupBy("key").agg(F.min("context").alias("old_low"), F.max("context").alias("old_high"))
        low, high = F.least("low", "old_low"), F.greatest("high", "old_high")
        keys = summary.join(old, "key", "left").filter(F.col("old_low").isNotNull() | (F.col("first") < F.col("last")))
        keys = space.write(keys.select("key", "first", F.col("old_low").isNotNull().alias("old"), (low != high).alias("multi")), "keys")
        found = space.write(rows.join(keys, "key"), "found")
        plain = found.filter(~F.col("multi") & (F.col("old") | (F.col("doc_id") > F.col("first")))).select("doc_id", "version", "lo", "hi")
        several = found.filter("multi").select("doc_id", "version", "key", "context", "lo", "hi")
        held = met.select("key", "context", F.lit(True).alias("seen")).distinct()
        contexts = space.write(own.select("key", "context", F.col("doc_id").alias("own")).join(keys.filter("multi").select("key"), "key", "left_semi").join(held, ["key", "context"], "left"), "contexts")
        late = F.coalesce("seen", F.lit(False)) | (F.col("doc_id") > F.col("own"))
        judged = space.write(several.join(contexts, ["key", "context"]).select("doc_id", "version", "lo", "hi", late.alias("late")), "judged")

        here = window_rows(texts, judged.filter(~F.col("late")).drop("late"), window, buckets).withColumn("old", F.lit(False))
        wanted = space.write(met.join(keys.filter("multi").select("key"), "key", "left_semi").select("doc_id", "key").distinct(), "wanted")
        there = [keyed_windows(self._table(t, TEXT, "doc_id"), wanted, window, k, self.state["buckets"][t]) for t in earlier]
        for part in (here, *there):  # one by one: a union of bucketed tables loses its rows' places
            part.write.mode("append").parquet(f"{space.path}/windows")
        windows = self.spark.read.schema("doc_id long, version long, start int, hash long, old boolean").parquet(f"{space.path}/windows")
        firsts = windows.groupBy("hash").agg(F.bool_or("old").alias("known"), F.min(F.when(~F.col("old"), F.col("doc_id"))).alias("own"), F.max(F.when(~F.col("old"), F.col("doc_id"))).alias("last"))
        firsts = space.write(firsts.filter("known OR own < last").select("hash", "known", "own"), "firsts")
        single = windows.filter(~F.col("old")).join(firsts, "hash").filter(F.col("known") | (F.col("doc_id") > F.col("own"))).select("doc_id", "version", F.col("start").alias("lo"), F.col("start").alias("hi"))
        ranges = space.write(plain.unionByName(judged.filter("late").drop("late")).unionByName(single), "ranges")

        new = own.join(held.drop("seen"), ["key", "context"], "left_anti").select("key", "context", "doc_id")
        new = space.write(new, "new")
        self._append(new.repartition(buckets, "key"), buckets, new.count())
        self.state["texts"].append(name)
        self._save()
        while len(self.state["runs"]) > 1 and self.state["runs"][-1][1] == self.state["runs"][-2][1]:
            self.compact()
        return remove(texts, ranges, window, buckets=buckets)

    def _append(self, rows: DataFrame, buckets: int, prints: int) -> None:
        run = self._write(rows, "runs", "key", buckets)
        self.state["prints"][run] = prints
        self.state["runs"].append([run, 0])

    def _met(self, space: Workspace, summary: DataFrame) -> DataFrame:
        """Fingerprints of all runs whose key a delivery has: one merge join a run, bucket by bucket."""
        met = self.spark.createDataFrame([], RUN)
        met.write.parquet(f"{space.path}/met")
        for run, _ in self.state["runs"]:
            self.run(run).join(summary.select("key").hint("merge"), "key", "left_semi").write.mode("append").parquet(f"{space.path}/met")
        return self.spark.read.schema(RUN).parquet(f"{space.path}/met")

    def compact(self) -> None:
        """Merges the last two runs, which have no fingerprint in common, into one of the next level. Where both have the buckets
        that the new run needs, which is enough for a join by key and context, each task merges one bucket and writes it
        again; else the rows are dealt anew."""
        conf, setting = self.spark.conf, "spark.sql.requireAllClusterKeysForCoPartition"
        (old, level), (new, _) = self.state["runs"][-2:]
        have, prints = [self.state["buckets"][x] for x in (old, new)], self.state["prints"].pop(old) + self.state["prints"].pop(new)
        buckets = max(*have, ceil(prints / BUCKET_PRINTS))
        before = conf.get(setting)
        conf.set(setting, "false")
        try:
            if have == [buckets, buckets]:
                a, b = self.run(old).alias("a"), self.run(new).hint("merge").alias("b")
                both = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.context") == F.col("b.context")), "full")
                both = both.select(*(F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in ("key", "context", "doc_id")))
            else:
                both = self.run(old).unionByName(self.run(new)).repartition(buckets, "key")
            name = self._write(both, "runs", "key", buckets)
        finally:
            conf.set(setting, before)
        self.state["runs"][-2:] = [[name, level + 1]]
        self.state["prints"][name] = prints
        self._save()
        for gone in (old, new):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{gone}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def keyed_windows(texts: DataFrame, wanted: DataFrame, window: int, k: int, buckets: int) -> DataFrame:
    """Windows of the texts whose anchors have the wanted (doc_id, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            size = np.asarray(pa.compute.list_value_length(lists))
            keys = np.asarray(lists.flatten())
            rows = np.repeat(np.arange(len(size)), size)
            for block in blocks(batch.column(2), BLOCK):
                w = words(block)
                a = anchors(word_hashes(block, w), w.first, window, k)
                own = slice(*np.searchsorted(rows, (block.lo, block.hi)))
                asked = np.empty(own.stop - own.start, [("row", np.int64), ("key", np.int64)])
                asked["row"], asked["key"] = rows[own] - block.lo, keys[own]
                have = np.empty(len(a.row), asked.dtype)
                have["row"], have["key"] = a.row, signed(a.key)
                some = np.isin(have, asked)
                base = w.first[a.row[some]]
                row, start, h = windows_between(block, w, a.row[some], a.lo[some] - base, a.hi[some] - base, window)
                ids = [batch.column(i).slice(block.lo, block.hi - block.lo).take(pa.array(row)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(start.astype(np.int32)), pa.array(signed(h)), pa.array(np.ones(len(row), bool))], ["doc_id", "version", "start", "hash", "old"])

    keys = wanted.repartition(buckets, "doc_id").groupBy("doc_id").agg(F.collect_list("key").alias("keys"))
    rows = texts.join(keys, "doc_id").select("doc_id", "version", "text", "keys")
    return rows.mapInArrow(run, "doc_id long, version long, start int, hash long, old boolean")


def dedup(docs: DataFrame, batches: int = BATCHES, window: int = WINDOW, k: int = K, path: str | None = None) -> DataFrame:
    """The rows of ``spans.remove`` with each document checked against all of smaller id: the documents come as
    ``batches`` deliveries by ranges of doc_id, in order, to an index in ``path`` (or a folder of its own)."""
    spark = docs.sparkSession
    index = FingerprintIndex(spark, path or Workspace(spark, "index").path, window, k)
    low, high = docs.agg(F.min(F.col("doc_id").cast("long")), F.max(F.col("doc_id").cast("long"))).first()
    width = ((high or 0) - (low or 0)) // batches + 1
    out = None
    for b in range(batches):
        start = (low or 0) + b * width
        part = index.add(docs.filter((F.col("doc_id") >= start) & (F.col("doc_id") < start + width)))
        out = part if out is None else out.unionByName(part)
    index.close()
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), "spans")
