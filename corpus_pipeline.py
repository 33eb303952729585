"""A training corpus from ``documents``: five stages, each written as Parquet and read again as the next one's documents.

Every stage but the last returns the columns of its documents, whatever their
names. Null and empty texts stay; rows with a null id, and rows that repeat one, are
kept or dropped as their texts ask; an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, lines, simhash, toxicity
from tessera.llm.common import cut, fold, free_name, hadoop, shared_path, temporary


def _side(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` as a side of a join: broadcast if counted to be small."""
    return F.broadcast(rows) if rows.count() <= lines.SMALL else rows


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at or over their language's threshold go. Labels are learned outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, fold(F.col("doc_id"), 3) != 1)
    return toxicity.reject(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.deduplicate(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents similar by 0.8 or more in five-word shingles that of the smallest id stays; rows without an id stay."""
    found, own = simhash.similar_documents(docs), free_name(docs, "id")
    gone = cut(found.where("doc_id <> component_id").select(F.col("doc_id").alias(own)).distinct())
    return docs.join(_side(docs, gone), docs["doc_id"].cast("long") == F.col(own), "left_anti")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with windows of two or more benchmark items go; from the others the covered spans are cut, and n_chars follows."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("BPE encoding", encode),
]

#: SQL can't express the stages; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        path = shared_path(spark, f"pipeline-{k}")
        with temporary(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            fs, old = hadoop(spark, before)
            fs.delete(old, True)
        before = path
    return docs
