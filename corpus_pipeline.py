"""From raw documents to packed training sequences: quality rules, near-dedup, substring dedup, secrets, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Columns of the input that share a name with a stage's own are carried under other names and given back unchanged. Null
and empty texts fail the quality rules; later stages, on their own, keep a null text as it is. Rows without doc_id are
dropped by the near-dedup stage, which also leaves one row of each doc_id. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaria.llm import minhash, packing, quality, secrets, suffix_array
from tessaria.operators.workspace import Workspace

#: Shingle length of the near-dedup stage.
SHINGLE_WORDS = 5
ROW = "__row_hash"


def _carried(docs: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """doc_id, text, and all columns but the text under neutral names."""
    others = [c for c in docs.columns if c != "text"]
    return docs.select("doc_id", "text", *(F.col(c).alias(f"_c{i}") for i, c in enumerate(others))), tuple(f"_c{i}" for i in range(len(others)))


def _restored(rows: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The columns of documents, with ``text`` for the text and its length for n_chars."""
    names = iter(range(len(docs.columns)))
    out = []
    for c in docs.columns:
        column = F.col(text) if c == "text" else F.col(f"_c{next(names)}")
        if c == "n_chars":
            column = F.when(F.col(text).isNull(), column).otherwise(F.length(text)).cast(docs.schema[c].dataType)
        out.append(column.alias(c))
    return rows.select(*out)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    renamed, names = _carried(docs)
    others = [c for c in docs.columns if c != "text"]
    lang = names[others.index("lang")] if "lang" in others else None
    return _restored(quality.judge(renamed, quality.vocabulary(), keep=("text", *names), lang=lang).filter("kept"), docs, "text")


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the least doc_id. Of different rows of one doc_id the one of least
    row hash stays, so a repeated task chooses alike."""
    kept = minhash.near_duplicates(docs, SHINGLE_WORDS).filter("kept").select("doc_id").distinct()
    row = F.xxhash64(*docs.columns).alias(ROW)
    chosen = docs.select("doc_id", row).groupBy("doc_id").agg(F.min(ROW).alias(ROW)).join(kept, "doc_id", "left_semi")
    return docs.select("*", row).join(chosen, ["doc_id", ROW], "left_semi").dropDuplicates(["doc_id", ROW]).select(*docs.columns)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has; those with no words left go."""
    renamed, names = _carried(docs)
    cleaned = suffix_array.dedup(renamed, keep=names).filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    return _restored(cleaned, docs, "cleaned")


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret masked."""
    renamed, names = _carried(docs)
    return _restored(secrets.scan(renamed, secrets.model(docs), keep=names), docs, "redacted")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces, with their ids, placed in sequences."""
    return packing.pack(packing.token_pieces(docs, *packing.vocabulary(), with_ids=True))


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_dedup", minhash_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: Tokenisers, character models and suffix extension are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again by the next."""
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = space.write(stage(spark, docs, sf_dir), name)
    return docs
