"""From raw documents to token ids: five stages, each written and read again before the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.llm import bpe, decontaminate, line_dedup, near_dedup, quality
from tillcast.llm.rows import table
from tillcast.session import materialize

SHINGLE_WORDS = 5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; an empty table, or one without labels, passes whole."""
    machine = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, machine).where("predicted = 1").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without their site's boilerplate lines; ``n_chars`` follows the text.

    Copies are still there and count as one page, else a text copied often would be cut from all its copies.
    """
    cut = line_dedup.drop_boilerplate(docs, copies_once=True)
    return cut.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(*docs.columns)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id; of rows repeating an id one."""
    kept = near_dedup.near_duplicates(docs, SHINGLE_WORDS).where("kept").select(F.col("doc_id").alias("_kept"))
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi").dropDuplicates(["doc_id"])


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an exact benchmark passage."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    leaks = found.where(F.size("hit") > 0).select(F.col("doc_id").alias("_leak"))
    return docs.join(leaks, F.col("doc_id").eqNullSafe(F.col("_leak")), "left_anti")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with a digest of what they decode to."""
    path = bpe.public_path()
    slim = docs.select("doc_id", "lang", "source", "text")
    return bpe.encode(slim, path, decoded="decoded").select(
        "doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality", keep_quality),
    ("lines", drop_lines),
    ("near_duplicates", keep_distinct),
    ("benchmark", keep_uncontaminated),
    ("tokens", tokenize),
]
# A trained classifier and a tokenizer have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
