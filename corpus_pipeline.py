"""A training corpus from raw documents: rank, drop copies, cut repeats, mix, encode."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispan.llm import mixing, near_dedup, pieces, quality_ranking, substring_dedup
from lexispan.llm.queries import public_vocabulary, table
from lexispan.session import drop_staged, staged_count, staged_path, staged_since, staging

_of_last_stage: list = []


def stage(fn):
    """Delete what the stage before has staged: its rows are written and read again by the time the next one begins."""

    @functools.wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_staged(_of_last_stage)
        before = staged_count()
        out = fn(spark, docs, sf_dir)
        _of_last_stage[:] = staged_since(before)
        return out

    return run_stage


@stage
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the cut."""
    return quality_ranking.good_documents(docs, quality_ranking.learn(docs, table(spark, sf_dir, "labels")))


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: runs of five words, likeness of 0.8 or more."""
    return near_dedup.without_near_duplicates(docs, k=5, percent=80)


@stage
def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of fifty words or more that stand earlier; texts without any stay as they are."""
    left = substring_dedup.without_repeats(docs, window=50)
    return left.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars")))


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs)


@stage
def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and the check that they give back the text."""
    return pieces.round_trips(docs, public_vocabulary("piece_bpe_32k.model"), keep_ids=True)


STAGES = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", drop_near_copies),
    ("substring dedup", cut_repeated_passages),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_and_decode),
]
#: SQL can't say the stages; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents, each written and read again; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for _, apply in STAGES[:-1]:
        path = staged_path(spark)
        with staging():
            apply(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
