"""Stupid-backoff scores of all documents under the n-gram counts of all other documents.

The corpus is cut into sections of documents. Each section asks once for each of its distinct n-grams: the questions,
sorted by hash and partitioned by its leading bits, meet in one count table per partition, which sums the sections'
counts and answers every section in the order of its questions. Joined back to the section's texts, the counts score
every word, and scores are summed per document. A frequent n-gram costs a partition one entry per section, whatever its
number of occurrences, so no n-gram is hot; sections and partitions grow in number with the corpus and not in size. A
section writes a row only for partitions of which it has n-grams, so rows never outnumber the sections' distinct n-grams.

score(w | u v) = c(uvw)/c(uv) if c(uvw) > 0, else ALPHA * score(w | v); likewise for v, then c(w)/N; a word that no
other document has scores ALPHA/N. c and N leave out the document's own words. The first words of a text have shorter
contexts. If no other document has words, every word scores ALPHA.

Words are taken unchanged. N-gram hashes have as many bits as keep the share of n-grams with an equal hash under 2**-20.
Null and empty texts: n_words 0, log_score 0. Every row is a document of its own, those of a repeated or missing doc_id
too, and repeated texts count as often as they come. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaria.llm.blocks import U, blocks, ngram_hashes, word_hashes, words

ORDER, ALPHA = 3, 0.4
#: Characters of a section, the least number of sections and of count tables, and n-grams of one count table.
SECTION_CHARS, LEAST_PARTS, PART_NGRAMS = 12_000_000, 48, 8_000_000


def totals(docs: DataFrame) -> tuple[int, int]:
    """Words and bytes of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array([len(words(block).start)]), pa.array([len(block.data)])], ["words", "bytes"])

    row = docs.select("text").mapInArrow(run, "words long, bytes long").agg(F.sum("words"), F.sum("bytes")).first()
    return row[0] or 0, row[1] or 0


def section_ngrams(texts: pa.ChunkedArray, order: int, bits: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words per row, and per n: for each position of the section's words the hash of the n-gram that ends there and
    whether it lies within its row."""
    hashes, counts = [], []
    for chunk in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        for block in blocks(chunk):
            w = words(block)
            hashes.append(word_hashes(block, w))
            counts.append(np.diff(w.first))
    h = np.concatenate(hashes) if hashes else np.zeros(0, U)
    count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    place = np.arange(len(h)) - np.repeat(np.cumsum(count) - count, count)
    out = []
    for n in range(1, order + 1):
        grams = np.zeros(len(h), U)
        grams[n - 1 :] = ngram_hashes(h, n)
        out.append((grams >> U(64 - bits), place >= n - 1))
    return count, out


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending distinct values: the first, then differences of the fewest bytes that hold them all."""
    if not len(values):
        return b""
    steps = np.diff(values)
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + int(values[0]).to_bytes(8, "little") + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_sorted(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, U)
    width = raw[0]
    steps = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, width)
    out = np.zeros((len(steps) + 1, 8), np.uint8)
    out[0] = np.frombuffer(raw, np.uint8, 8, offset=1)
    out[1:, :width] = steps
    return np.cumsum(out.view("<u8").ravel(), dtype=U)


def pack_counts(values: np.ndarray) -> bytes:
    """Counts as bytes, 255 standing for the next of the large ones at the end."""
    large = values >= 255
    return np.where(large, 255, values).astype(np.uint8).tobytes() + values[large].astype("<u8").tobytes()


def unpack_counts(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<u8", offset=n).astype(np.int64)
    return out


def lm_scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA) -> DataFrame:
    """doc_id, n_words, log_score (natural logarithm, summed over the words), and n_order1 .. n_orderN: words scored by
    n-grams of that order (words that no other document has are in none)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    total, size = totals(docs)
    sections = max(LEAST_PARTS, ceil(size / SECTION_CHARS))
    leading = ceil(log2(max(LEAST_PARTS, total * order / PART_NGRAMS)))
    bits = min(64, max(40, ceil(log2(max(2, total * order))) + 20))
    orders = range(order)

    def ask(group: pa.Table) -> pa.Table:
        _, grams = section_ngrams(group["text"], order, bits)
        found = [np.unique(h[inside], return_counts=True) for h, inside in grams]
        edges = np.unique(np.concatenate([values >> U(bits - leading) for values, _ in found]))
        columns: dict[str, list] = {}
        for n, (values, times) in enumerate(found):
            own = values >> U(bits - leading)
            pairs = list(zip(np.searchsorted(own, edges).tolist(), np.searchsorted(own, edges, "right").tolist(), strict=True))
            columns[f"h{n}"] = [pack_sorted(values[a:b]) for a, b in pairs]
            columns[f"c{n}"] = [pack_counts(times[a:b]) for a, b in pairs]
        fixed = {"section": pa.array([group["section"][0].as_py()] * len(edges), pa.int64()), "part": pa.array(edges.astype(np.int64))}
        return pa.table(fixed | {k: pa.array(v, pa.binary()) for k, v in columns.items()})

    def answer(group: pa.Table) -> pa.Table:
        out = {"section": group["section"], "part": group["part"]}
        for n in orders:
            asked = [unpack_sorted(x.as_buffer().to_pybytes()) for x in group[f"h{n}"]]
            times = [unpack_counts(x.as_buffer().to_pybytes(), len(a)) for x, a in zip(group[f"c{n}"], asked, strict=True)]
            values, place = np.unique(np.concatenate(asked), return_inverse=True)
            sums = np.zeros(len(values), np.int64)
            np.add.at(sums, place, np.concatenate(times))
            split = np.split(sums[place], np.cumsum([len(a) for a in asked])[:-1])
            out[f"a{n}"] = pa.array([pack_counts(x) for x in split], pa.binary())
        return pa.table(out)

    def score(group: pa.Table, answers: pa.Table) -> pa.Table:
        count, grams = section_ngrams(group["text"], order, bits)
        answers = answers.sort_by("part")
        edges = answers["part"].to_numpy().astype(U)
        row = np.repeat(np.arange(len(count)), count)
        other = []  # per order and word: occurrences in other documents of the n-gram that ends there
        for n, (h, inside) in enumerate(grams):
            values, place = np.unique(h[inside], return_inverse=True)
            size = np.diff(np.searchsorted(values >> U(bits - leading), np.concatenate((edges, [U(1 << leading)])))).tolist()
            sums = np.concatenate([np.zeros(0, np.int64), *(unpack_counts(x.as_buffer().to_pybytes(), k) for x, k in zip(answers[f"a{n}"], size, strict=True))])
            _, own, times = np.unique(row[inside].astype(np.int64) * max(len(values), 1) + place, return_inverse=True, return_counts=True)
            left = np.zeros(len(h), np.int64)
            left[inside] = sums[place] - times[own]
            other.append(left)
        rest = (total - count)[row]
        used = np.zeros(len(row), np.int64)
        value = np.where(rest > 0, log(alpha) - np.log(np.maximum(rest, 1)), log(alpha))
        for n in orders:
            # the context of an n-gram is the shorter n-gram that ends one word before
            below = np.concatenate(([0], other[n - 1][:-1])) if n else rest
            seen = other[n] > 0
            value = np.where(seen, np.log(np.maximum(other[n], 1)) - np.log(np.maximum(below, 1)), value + (log(alpha) if n else 0) * grams[n][1])
            used[seen] = n + 1
        made = {"doc_id": group["doc_id"], "n_words": count.astype(np.int64), "log_score": np.bincount(row, weights=value, minlength=len(count)).astype(float)}
        return pa.table(made | {f"n_order{n + 1}": np.bincount(row[used == n + 1], minlength=len(count)).astype(np.int64) for n in orders})

    dealt = docs.withColumn("section", F.pmod(F.xxhash64("doc_id", "text"), F.lit(sections)).cast("long"))
    questions = ", ".join(f"h{n} binary, c{n} binary" for n in orders)
    asked = dealt.groupBy("section").applyInArrow(ask, f"section long, part long, {questions}")
    answered = asked.groupBy("part").applyInArrow(answer, "section long, part long, " + ", ".join(f"a{n} binary" for n in orders))
    scored = "doc_id long, n_words long, log_score double, " + ", ".join(f"n_order{n + 1} long" for n in orders)
    return dealt.groupBy("section").cogroup(answered.groupBy("section")).applyInArrow(score, scored)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).withColumn("log_score", F.round("log_score", 4))


#: The same by n-grams as rows: w has each word with the n-grams that end there, o how often other documents have them.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS t FROM documents), u AS (SELECT doc_id, unnest(t) AS x1, unnest(range(1, len(t) + 1)) AS i FROM d),
w AS (SELECT *, lag(x1) OVER p || ' ' || x1 AS x2, lag(x1, 2) OVER p || ' ' || lag(x1) OVER p || ' ' || x1 AS x3 FROM u WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
c1 AS (SELECT x1, count(*) AS n FROM w GROUP BY x1), c2 AS (SELECT x2, count(*) AS n FROM w GROUP BY x2), c3 AS (SELECT x3, count(*) AS n FROM w GROUP BY x3),
o AS (SELECT w.doc_id, i, x2, x3, c1.n - count(*) OVER (PARTITION BY w.doc_id, w.x1) AS o1, CASE WHEN x2 IS NULL THEN 0 ELSE c2.n - count(*) OVER (PARTITION BY w.doc_id, w.x2) END AS o2, CASE WHEN x3 IS NULL THEN 0 ELSE c3.n - count(*) OVER (PARTITION BY w.doc_id, w.x3) END AS o3,
  (SELECT count(*) FROM u) - count(*) OVER (PARTITION BY w.doc_id) AS rest FROM w JOIN c1 USING (x1) LEFT JOIN c2 USING (x2) LEFT JOIN c3 USING (x3)),
b AS (SELECT *, lag(o1) OVER p AS b1, lag(o2) OVER p AS b2 FROM o WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id, CASE WHEN o3 > 0 THEN 3 WHEN o2 > 0 THEN 2 WHEN o1 > 0 THEN 1 ELSE 0 END AS used, CASE WHEN o3 > 0 THEN ln(o3 / b2::DOUBLE) WHEN o2 > 0 THEN ln(o2 / b1::DOUBLE) + CASE WHEN x3 IS NULL THEN 0 ELSE ln(0.4) END
  ELSE CASE WHEN o1 > 0 THEN ln(o1 / rest::DOUBLE) WHEN rest > 0 THEN ln(0.4 / rest) ELSE ln(0.4) END + CASE WHEN x2 IS NULL THEN 0 WHEN x3 IS NULL THEN ln(0.4) ELSE 2 * ln(0.4) END END AS v FROM b)
SELECT doc_id, len(t)::BIGINT AS n_words, round(coalesce(sum(v), 0), 4) AS log_score, count(*) FILTER (WHERE used = 1)::BIGINT AS n_order1, count(*) FILTER (WHERE used = 2)::BIGINT AS n_order2, count(*) FILTER (WHERE used = 3)::BIGINT AS n_order3
FROM d LEFT JOIN s USING (doc_id) GROUP BY doc_id, t
"""
