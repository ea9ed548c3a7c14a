"""A training corpus from raw documents: toxicity, near-duplicates, benchmark
contamination, secrets, token ids.

Each stage takes all its predecessor kept and returns it with its decisions applied.
All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsig.llm import bpe, secretscan, simhash, toxicity
from logsig.llm.queries import BPE_RANKS, contaminated, toxicity_model
from logsig.session import delete_table, shared_folder, temporary_tables

#: Near-duplicates: words of a shingle and the most differing bits.
SHINGLE = 3
MAX_DISTANCE = 3
REDACTED = "[SECRET]"


def whole(docs: DataFrame, *columns: str) -> DataFrame:
    """The rows as one column, so that no name of theirs can clash, and some columns."""
    return docs.select(F.struct("*").alias("_row"), *columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    scored = toxicity.scored(whole(docs, "text"), toxicity_model(docs, spark, folder))
    return scored.filter("predicted = 0").select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group."""
    return simhash.representatives(docs, "doc_id", shingle=SHINGLE, max_distance=MAX_DISTANCE)


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents of which benchmark passages are less than a twentieth."""
    bad = contaminated(docs, spark, folder).filter("contaminated").select(
        F.col("doc_id").alias("_bad"), F.col("digest").alias("_bad_digest")
    )
    rows = docs.select(
        F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_digest")
    )
    same = F.col("_id").eqNullSafe(F.col("_bad")) & (F.col("_digest") == F.col("_bad_digest"))
    return rows.join(bad.distinct(), same, "left_anti").select("_row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with the owner-specific credentials in them replaced; widely copied examples
    stay as they are. ``n_chars`` follows the text."""
    columns = [f"`{c}`" for c in docs.columns]
    return secretscan.redacted(docs, "text", REDACTED).withColumn(
        "n_chars", F.length("text").cast("bigint")
    ).select(*columns)


def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with their token ids and number, checked by decoding them. The new columns get
    an underscore where the documents have one of their name."""
    path, pattern = public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN
    made = bpe.encoded(whole(docs, "text"), "text", path, pattern, check=True)
    names = []
    for name in ("token_ids", "n_tokens"):
        while name in docs.columns:
            name += "_"
        names.append(name)
    return made.select(
        "_row.*", F.col("token_ids").alias(names[0]), F.size("token_ids").alias(names[1])
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("byte_bpe", encode),
]

#: SQL has neither the trained model nor the fingerprints and merges.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that the last stage returns. What a stage wrote, and the tables it stored on
    its way, go once the next one is written."""
    docs, held = spark.read.parquet(f"{folder}/documents.parquet"), None
    for _, stage in STAGES:
        path = shared_folder(spark)
        with temporary_tables(spark):
            stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        if held is not None:
            delete_table(spark, held)
        held = path
    return docs
