"""A maintained search index: positional postings of stemmed lexemes with weights, by segments.

A document is several columns of text, each with a weight letter; their words are numbered through, column after column.
The folder holds ``lists`` (segment, bucket of the lexeme; lexeme, weight, some keys, and the places of the lexeme in each) and
``texts`` (a keyed table: key, hash of the texts, the segment that has its postings). ``update`` indexes only documents
whose texts have changed, as a new segment; a posting is live while its document still names its segment, so what is
replaced needs no rewriting, and a segment counts once the documents name it. ``compact`` writes live postings together.
``search`` opens the buckets of the query's lexemes alone: phrases meet by intersecting shifted places.

Postings are made in Arrow batches, whose distinct words are stemmed once; a block of documents has one list of each lexeme
and weight, and lists are shuffled once, to their buckets. A folder with ``postings`` and ``documents`` is of an earlier layout; it counts as empty and is indexed anew.
"""

from __future__ import annotations

import zlib
from collections.abc import Collection, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaria.operators.search import parse, stemmed, stems_of, words_of
from tessaria.operators.store import KeyedTable, latest_wins
from tessaria.operators.workspace import Workspace

LIST = "lexeme string, weight string, keys array<long>, at array<array<int>>"
#: Bytes of text that are worked on at once in a task, or one document where it is longer.
BLOCK = 4 << 20


def posting_lists(docs: DataFrame, key: str, weighted: Mapping[str, Column]) -> DataFrame:
    """lexeme, weight, keys, at (word numbers, in order, by key) of blocks of documents. Null texts have no words."""
    weights = pa.array(list(weighted), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_numpy(), [c.to_pylist() for c in batch.columns[1:]]
            sizes = np.sum([[len(t) for t in column] for column in texts], axis=0, dtype="i8")
            block = (np.cumsum(sizes) - sizes) // BLOCK
            bounds = [*np.flatnonzero(np.diff(block, prepend=-1)), len(keys)]
            for start, end in zip(bounds, bounds[1:], strict=False):
                yield _listed(keys[start:end], [t.decode("utf-8", "replace") for of_one in zip(*(c[start:end] for c in texts), strict=True) for t in of_one], weights)

    texts = [F.coalesce(c, F.lit("")).cast("string").cast("binary").alias(f"text_{i}") for i, c in enumerate(weighted.values())]
    return docs.select(F.col(key).cast("long").alias("key"), *texts).filter("key IS NOT NULL").mapInArrow(run, LIST)


def _listed(keys: np.ndarray, texts: list[str], weights: pa.Array) -> pa.RecordBatch:
    """Posting lists of documents, whose texts follow each other."""
    words, text = words_of(texts)
    coded = words.dictionary_encode()
    lexemes = stems_of(coded.dictionary).dictionary_encode()
    lexeme = lexemes.indices.to_numpy()[coded.indices.to_numpy()].astype("i8")
    doc, weight = np.divmod(text, len(weights))
    at = (np.arange(len(doc)) - np.searchsorted(doc, np.arange(len(keys)))[doc]).astype("i4")
    which = (lexeme * len(weights) + weight) * len(keys) + doc
    order = np.argsort(which, kind="stable")
    posting = np.flatnonzero(np.diff(which[order], prepend=-1))
    one = order[posting]
    row = np.flatnonzero(np.diff(which[one] // len(keys), prepend=-1))
    places = pa.ListArray.from_arrays(_offsets(posting, len(order)), pa.array(at[order]))
    held = [pa.ListArray.from_arrays(_offsets(row, len(one)), x) for x in (pa.array(keys[doc[one]]), places)]
    return pa.RecordBatch.from_arrays([lexemes.dictionary.take(pa.array(lexeme[one[row]])), weights.take(pa.array(weight[one[row]])), *held], ["lexeme", "weight", "keys", "at"])


def _offsets(starts: np.ndarray, end: int) -> pa.Array:
    return pa.array(np.append(starts, end).astype("i4"))


def apart(lists: DataFrame, places: bool = True) -> DataFrame:
    """A row for each key of posting lists: key and, where asked for, at, besides the other columns."""
    rest = [c for c in lists.columns if c not in ("keys", "at")]
    if not places:
        return lists.select(*rest, F.explode("keys").alias("key"))
    return lists.select(*rest, F.inline(F.arrays_zip("keys", "at")).alias("key", "at"))


class SearchIndex:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.documents = KeyedTable(spark, f"{self.path}/texts", "key long, hash long, segment int", ["key"], buckets)

    def _next(self) -> int:
        """A number that no segment has had, whole or not."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/lists")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
        return max((int(n.partition("=")[2]) for n in names if n.startswith("segment=")), default=0) + 1

    def _write(self, rows: DataFrame, segment: int) -> None:
        dealt = rows.withColumn("bucket", F.pmod(F.crc32(F.encode("lexeme", "UTF-8")), F.lit(self.buckets)).cast("int"))
        # a large bucket goes to several tasks and files
        dealt.hint("rebalance", "bucket").sortWithinPartitions("bucket", "lexeme").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/lists/segment={segment}")

    def update(self, docs: DataFrame, key: str, weighted: Mapping[str, Column]) -> int:
        """Indexes new and changed documents (one row per key) and gives their number."""
        rows = docs.select(F.col(key).cast("long").alias("key"), *(c.cast("string").alias(f"text_{w}") for w, c in weighted.items()))
        texts = {w: F.col(f"text_{w}") for w in weighted}
        # nulls are told from empty texts, and columns from each other
        now = rows.withColumn("hash", F.xxhash64(*(x for c in texts.values() for x in (c.isNull(), c))))
        stored = self.documents.read().select("key", F.col("hash").alias("_had"))
        changed = now.join(stored, "key", "left").filter(F.col("_had").isNull() | (F.col("_had") != F.col("hash"))).drop("_had")
        changed = Workspace(self.spark, "index").write(changed, "changed")
        n = changed.count()
        if n:
            segment = self._next()
            self._write(posting_lists(changed, "key", texts), segment)
            self.documents.apply(changed.select("key", "hash", F.lit(segment).alias("segment")), segment, latest_wins(["key"]))
        return n

    def remove(self, keys: DataFrame) -> None:
        """Takes documents out: they name no segment any more."""
        gone = self.documents.read().join(keys.select(F.col(keys.columns[0]).cast("long").alias("key")).distinct(), "key", "left_semi")
        self.documents.update(gone.withColumns({"segment": F.lit(0), "hash": F.lit(None).cast("long")}))

    def postings(self, lexemes: Collection[str] | None = None, places: bool = True) -> DataFrame:
        """Live postings, of the given lexemes or of all: lexeme, weight, segment, the first key of their list, key, at."""
        rows = self.spark.read.schema(f"{LIST}, segment int, bucket int").parquet(f"{self.path}/lists")
        if lexemes is not None:
            rows = rows.filter(F.col("bucket").isin(sorted({zlib.crc32(x.encode()) % self.buckets for x in lexemes})) & F.col("lexeme").isin(sorted(lexemes)))
        singles = apart(rows.select("lexeme", "weight", "segment", F.col("keys")[0].alias("head"), "keys", "at"), places)
        return singles.join(self.documents.read().select("key", "segment"), ["key", "segment"], "left_semi")

    def compact(self) -> None:
        """All live postings as one segment, in the lists that they are in; older folders are left to whoever still reads them."""
        segment = self._next()
        lists = self.postings().groupBy("lexeme", "weight", "segment", "head").agg(F.collect_list(F.struct("key", "at")).alias("p"))
        self._write(lists.select("lexeme", "weight", F.col("p.key").alias("keys"), "p.at"), segment)
        held = self.documents.read().filter("segment > 0")
        self.documents.update(held.withColumn("segment", F.lit(segment)))

    def search(self, query: str, weights: Collection[str] | None = None) -> DataFrame:
        """Keys of the documents that answer a query (grammar of ``search.parse``), looking at words of the given weights."""
        alternatives = [[(negated, tuple(map(stemmed, words))) for negated, words in a] for a in parse(query)]
        lexemes = sorted({w for a in alternatives for _, words in a for w in words})
        names = {w: f"_{i}" for i, w in enumerate(lexemes)}
        live = self.documents.read().filter("segment > 0").select("key")
        if not lexemes:
            return live.limit(0)
        # places are read for phrases alone
        in_phrases = {w for a in alternatives for _, words in a if len(words) > 1 for w in words}
        found = self.postings(lexemes, places=bool(in_phrases))
        if weights is not None:
            found = found.filter(F.col("weight").isin(list(weights)))
        held = [F.flatten(F.collect_list(F.when(F.col("lexeme") == w, F.col("at")))) if w in in_phrases else F.bool_or(F.col("lexeme") == w) for w in lexemes]
        per = found.groupBy("key").agg(*(c.alias(names[w]) for w, c in zip(lexemes, held, strict=True)))
        if any(all(negated for negated, _ in a) for a in alternatives):
            per = live.join(per, "key", "left")

        def back(at: str, n: int) -> Column:
            return F.transform(at, lambda x: (x - n).cast("int"))

        def term(words: tuple[str, ...]) -> Column:
            at = F.col(names[words[0]])
            for i, w in enumerate(words[1:], 1):
                at = F.array_intersect(at, back(names[w], i))
            return F.coalesce(F.size(at) > 0 if words[0] in in_phrases else at, F.lit(False))

        hit = F.lit(False)
        for a in alternatives:
            both = F.lit(True)
            for negated, words in a:
                both = both & (~term(words) if negated else term(words))
            hit = hit | both
        return per.filter(hit).select("key")
