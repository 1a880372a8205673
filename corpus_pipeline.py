"""Training-data pipeline over ``documents``: each stage's rows are written and read again as the next one's input.

Every row is a document of its own, told apart by id and text: rows of one id with other texts get
verdicts of their own, rows with a null id are judged like others, and rows that agree in both share
their verdict and stay repeated.  Null and empty texts have no perplexity and go in the first stage.
Other columns stay until the last stage; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ranklake.llm import bpe, decontamination, near_dedup, quality_classifier, suffix_dedup
from ranklake.llm.common import checkpoint, delete_folder, shared_folder, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: 80 % of five-word shingles (four words are op6's own)."""
    return near_dedup.keep_one(docs, width=5)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay where they occur first and are cut elsewhere."""
    return suffix_dedup.dedup(docs, length_col="n_chars")


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontamination.remove(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, as digests, with the decoded text's digest."""
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = file.read()
    # idle workers keep their caches beside the next stages' memory, so they are smaller here
    return bpe.encode(docs, ranks, public_tokenizers.PATTERN, max_pieces=100_000, max_transitions=120_000)


STAGES = [
    ("quality_classifier", quality),
    ("near_duplicates", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("decontamination", benchmark_free),
    ("byte_level_bpe", tokens),
]

#: No stage but the fourth can be written in SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        done = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            done.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    done = checkpoint(done)
    delete_folder(spark, folder)
    return done
