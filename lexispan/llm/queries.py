"""One query for each operator, over the whole tables, and SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import staged_path
from . import (
    fingerprints, host_text, license_scan, mixing, near_dedup, pieces, prefix_trie, quality_ranking, repetition, reply_trees, substring_dedup,
    token_files, turn_repair,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def public_vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies; every executor has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op2_token_files(spark, folder):
    path = staged_path(spark)
    token_files.tokenize_to_files(table(spark, folder, "documents"), path, public_vocabulary("word_bpe_49k.json"), end_id=1)
    return token_files.checksums(token_files.read_token_files(spark, path))


@query
def op9_quality_rules(spark, folder):
    return repetition.quality_rules(table(spark, folder, "documents"))


@query
def op10_pieces(spark, folder):
    return pieces.round_trips(table(spark, folder, "documents"), public_vocabulary("piece_bpe_32k.model"))


@query
def op1_fingerprints(spark, folder):
    return fingerprints.edit_test(table(spark, folder, "documents"))


@query
def op3_quality_ranking(spark, folder):
    documents = table(spark, folder, "documents")
    return quality_ranking.quality_scores(documents, quality_ranking.learn(documents, table(spark, folder, "labels")))


@query
def op5_near_duplicates(spark, folder):
    return near_dedup.near_duplicates(table(spark, folder, "documents"), k=4, percent=80)


@query
def op6_source_mixture(spark, folder):
    return mixing.mixture(table(spark, folder, "documents")).drop("repeats")


ORACLES["op6_source_mixture"] = "select doc_id, size, source_size, target, taken from (" + mixing.mixture_sql() + ")"


@query
def op8_license_notices(spark, folder):
    return license_scan.license_digest(license_scan.license_notices(table(spark, folder, "documents")))


@query
def op4_host_text(spark, folder):
    return host_text.main_texts(table(spark, folder, "pages"))


@query
def op7_passages(spark, folder):
    return substring_dedup.passage_digest(table(spark, folder, "documents"), window=20)


@query
def op11_prefix_trie(spark, folder):
    return prefix_trie.prefix_trie(table(spark, folder, "conversations"))


@query
def op12_reply_trees(spark, folder):
    return reply_trees.conversation_digest(reply_trees.formatted_conversations(table(spark, folder, "conversations")))


ORACLES["op12_reply_trees"] = reply_trees.DIGEST_SQL


@query
def op13_turn_repair(spark, folder):
    return turn_repair.repaired_conversations(table(spark, folder, "conversations"))
