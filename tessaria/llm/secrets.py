"""Secret scans: fixed rules, and character Markov models compared by log-likelihood ratio.

The rules find assignments, access keys and long hex strings. The method adds stretches of ``LEAST`` or more characters of
``[A-Za-z0-9+/_=-]`` that a character-bigram model of random strings explains better than one of ordinary identifiers,
by ``THRESHOLD`` nats or more: whole strings, or their best-scoring stretches where words are joined to a secret. Both
models are trained from labelled samples: random strings over common alphabets, and identifiers made of words of at most
``SAMPLE_DOCS`` documents (taken by a hash of doc_id; rows without doc_id are scanned, but give no words). What a rule has matched is left out, and the rest beside it scored.

Spans are kind:start:end in code points, end exclusive, in order of start, then kind. Null and empty texts: no spans.
Repeated rows are scanned alike; empty tables give no rows (and leave the models to their smoothing).
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaria.llm.blocks import LOWER, Block, blocks

KINDS = ("assign", "access", "hex", "markov")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
LEAST, THRESHOLD, DISTINCT = 20, 15.0, 8
SAMPLE_DOCS, RANDOM_STRINGS = 500, 4000
MASK = "[SECRET]"
#: Words of the training sample, as a Java pattern.
WORD = r"(?<![\w+/=-])[A-Za-z]{3,16}(?![\w+/=-])"
ALPHABET = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SEPARATOR = ALPHABET.index(b"+")
CODE = np.full(256, -1, np.int64)
CODE[list(ALPHABET)] = np.arange(len(ALPHABET))
HEX = np.zeros(256, bool)
HEX[list(b"0123456789abcdef")] = True
SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long, redacted string"


def runs(block: Block, table: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the maximal runs of at least ``least`` bytes of a class, within rows."""
    inside = np.zeros(len(block.data) + 2, bool)
    inside[1:-1] = table[block.data]
    edge = np.zeros(len(block.data) + 1, bool)
    edge[block.offsets] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    long = end - start >= least
    return start[long], end[long]


def transitions(strings: list[bytes]) -> np.ndarray:
    """Smoothed log-probabilities of the next character, by the one before."""
    n = len(ALPHABET)
    count = np.full((n, n), 0.5)
    for s in strings:
        codes = CODE[np.frombuffer(s, np.uint8)]
        np.add.at(count, (codes[:-1], codes[1:]), 1)
    return np.log(count / count.sum(axis=1, keepdims=True))


def random_strings(n: int = RANDOM_STRINGS, seed: int = 7) -> list[bytes]:
    """Labelled positives: strings drawn evenly from alphabets that keys are written in."""
    draw = random.Random(seed)
    text = ALPHABET.decode()
    alphabets = [text[:26] + text[52:62], text[26:62], text[:62], text[:64], text[:62] + "_-", "0123456789abcdef", "0123456789ABCDEF"]
    return ["".join(draw.choices(alphabets[i % len(alphabets)], k=draw.randint(20, 64))).encode() for i in range(n)]


def identifiers(words: list[str], n: int = RANDOM_STRINGS, seed: int = 11) -> list[bytes]:
    """Labelled negatives: names, paths, numbers and rules made of ordinary words."""
    draw = random.Random(seed)
    out = [w.encode() for w in words]
    for i in range(n):
        own = draw.choices(words, k=draw.randint(2, 5)) if words else ["name", "value"]
        joined = [*(sep.join(own) for sep in "_-/+="), "".join(w.capitalize() for w in own), "".join(own).lower(), "".join(own).upper()]
        out.append(joined[i % len(joined)].encode())
        if i % 4 == 0:
            out.append("".join(draw.choices("0123456789", k=draw.randint(8, 24))).encode())
            out.append(draw.choice("=-_+/aAxX0").encode() * draw.randint(8, 40))
            out.append(f"{draw.choice(own)}-{draw.randint(0, 99999)}".encode())
    return out


def train(positive: list[bytes], negative: list[bytes]) -> np.ndarray:
    """Log-likelihood ratio of each pair of characters."""
    return transitions(positive) - transitions(negative)


def sample_words(docs: DataFrame, limit: int = SAMPLE_DOCS) -> list[str]:
    """Distinct ASCII words of a bounded sample of documents, which depends on the documents alone: first ids are chosen,
    then the words of their texts (the least text of a repeated id) are found where the texts are."""
    ids = docs.filter(F.col("text").isNotNull()).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).collect()
    texts = docs.filter(F.col("doc_id").isin(*{r.doc_id for r in ids if r.doc_id is not None})).groupBy("doc_id").agg(F.min(F.col("text").cast("string")).alias("text"))
    words = texts.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).alias("word")).distinct()
    return sorted(r.word for r in words.collect())


def stretches(codes: np.ndarray, ratio: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the secrets in a string: all of it if it scores ``THRESHOLD``, else its best-scoring stretch of
    ``LEAST`` or more characters that does, out to the next separators, and then those of what is left on both sides."""
    score = np.concatenate(([0.0], np.cumsum(ratio[codes[:-1], codes[1:]])))
    cuts = np.flatnonzero(codes >= SEPARATOR)
    out, todo = [], [(0, len(codes))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < LEAST:
            continue
        own = score[lo:hi]
        a, b = lo, hi
        if own[-1] - own[0] < THRESHOLD:
            gain = own[LEAST - 1 :] - np.minimum.accumulate(own[: hi - lo - LEAST + 1])
            last = int(gain.argmax())
            if gain[last] < THRESHOLD:
                continue
            a, b = lo + int(own[: last + 1].argmin()), lo + last + LEAST
            before, after = np.searchsorted(cuts, a), np.searchsorted(cuts, b)
            a = max(lo, int(cuts[before - 1]) + 1 if before else 0)
            b = min(hi, int(cuts[after]) if after < len(cuts) else hi)
        if len(np.unique(codes[a:b])) >= DISTINCT:
            out.append((a, b))
        todo += [(lo, a), (b, hi)]
    return sorted(out)


def beside(a: int, b: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What is left of a stretch without the ``taken`` ones."""
    out = []
    for s, e in sorted(taken):
        if s < b and e > a:
            out.append((a, s))
            a = max(a, e)
    return [(x, y) for x, y in [*out, (a, b)] if y - x >= LEAST]


def scan_block(block: Block, ratio: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """Spans by row: (start, kind, end), in bytes of the block."""
    data, offsets = block.data, block.offsets
    raw, low = data.tobytes(), LOWER[data].tobytes()
    found: dict[int, list[tuple[int, int, int]]] = {}
    row_of = lambda at: int(np.searchsorted(offsets, at, "right")) - 1

    def rows_with(words: tuple[bytes, ...], text: bytes) -> set[int]:
        rows = set()
        for word in words:
            at = text.find(word)
            while at >= 0:
                row = row_of(at)
                rows.add(row)
                at = text.find(word, int(offsets[row + 1]))
        return rows

    for kind, pattern, keys, text, group, least in ((0, ASSIGN, KEYWORDS, low, 2, LEAST_ASSIGN), (1, ACCESS, (b"AKIA",), raw, 0, LEAST_ACCESS)):
        for row in rows_with(keys, text):
            base = int(offsets[row])
            for m in pattern.finditer(raw[base : int(offsets[row + 1])]):
                if len(m[group]) >= least:
                    found.setdefault(row, []).append((base + m.start(), kind, base + m.end()))
    for a, b in zip(*(x.tolist() for x in runs(block, HEX, LEAST_HEX)), strict=True):
        found.setdefault(row_of(a), []).append((a, 2, b))
    start, end = runs(block, CODE >= 0, LEAST)
    for a, b in zip(start.tolist(), end.tolist(), strict=True):
        row = row_of(a)
        for lo, hi in beside(a, b, [(s, e) for s, k, e in found.get(row, []) if k != 3]):
            for x, y in stretches(CODE[data[lo:hi]], ratio):
                found.setdefault(row, []).append((lo + x, 3, lo + y))
    return {row: sorted(own) for row, own in found.items() if own}


def scan(docs: DataFrame, ratio: np.ndarray, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, then SCHEMA; ``redacted`` is the text with every span replaced by MASK (overlapping spans
    by one)."""
    empty = hashlib.sha256(b"").hexdigest()
    others = [c for c in keep if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0)):
                n = block.hi - block.lo
                found = scan_block(block, ratio)
                counts = np.zeros((4, n), np.int64)
                base, spans = [empty] * n, [""] * n
                text = batch.column(0).slice(block.lo, n)
                redacted = text.to_pylist() if found else None
                for row, own in found.items():
                    at = int(block.offsets[row])
                    raw = block.text(row)
                    points = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
                    told = [(k, f"{KINDS[k]}:{points[a - at]}:{points[b - at]}") for a, k, b in own]
                    for k, _ in told:
                        counts[k, row] += 1
                    spans[row] = ",".join(x for _, x in told)
                    base[row] = hashlib.sha256(",".join(x for k, x in told if k < 3).encode()).hexdigest()
                    parts, last = [], 0
                    for a, _, b in own:
                        if a - at >= last:
                            parts += [raw[last : a - at], MASK.encode()]
                        last = max(last, b - at)
                    redacted[row] = b"".join([*parts, raw[last:]]).decode("utf-8", "replace")
                made = [*(pa.array(counts[k]) for k in range(3)), pa.array(base, pa.string()), pa.array(spans, pa.string()), pa.array(counts[3]), pa.array(redacted, pa.string()) if found else text]
                yield pa.RecordBatch.from_arrays([*(batch.column(0 if c == "text" else 1 + others.index(c)).slice(block.lo, n) for c in keep), *made], [*keep, *(x.split()[0] for x in SCHEMA.split(", "))])

    kinds = ", ".join(f"`{c}` {'string' if c == 'text' else docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(F.col("text").cast("string"), *others).mapInArrow(run, f"{kinds}, {SCHEMA}")


def model(docs: DataFrame) -> np.ndarray:
    return train(random_strings(), identifiers(sample_words(docs)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, model(docs)).drop("redacted")
