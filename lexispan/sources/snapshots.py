"""Stored term memory: reading snapshots into rows, writing one per job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions.text import text

OCCURRENCE = (
    "struct<chunk_id:string,unit_id:bigint,section:string,element_type:string,source_snippet:string,"
    "surrounding_source:string,target_candidate:string>"
)
TERM = (
    "struct<term_id:string,source_term:string,normalized_source:string,aliases:array<string>,status:string,"
    "candidate_types:array<string>,frequency:bigint,chunk_count:bigint,section_count:bigint,token_count:int,"
    "match_priority:int,candidate_score:double,reason:array<string>,confidence:double,version:int,"
    "target_term:string,target:string,review_reason:string,"
    "target_candidates:array<struct<target:string,count:bigint,chunks:array<string>>>,"
    f"occurrences:array<{OCCURRENCE}>>"
)
SNAPSHOT = (
    "schema_version int, job_id string, target_lang string, created_at double, updated_at double, "
    + ", ".join(f"{b} map<string,{TERM}>" for b in K.TERM_BUCKETS)
    + ", excluded array<struct<source_term:string,normalized_source:string,filter_reason:string,frequency:bigint>>"
)


def read_term_memory(spark: SparkSession, path: str) -> DataFrame:
    """One row per stored term; the bucket is a column, ``target`` counts as ``target_term``."""
    raw = spark.read.schema(SNAPSHOT).json(path, multiLine=True)
    buckets = F.array(
        *[F.struct(F.lit(b).alias("bucket"), F.map_entries(F.coalesce(b, F.create_map().cast(f"map<string,{TERM}>"))).alias("e")) for b in K.TERM_BUCKETS]
    )
    rows = raw.select(
        F.col("job_id").alias("doc_id"), "target_lang", F.timestamp_seconds("updated_at").alias("updated_at"),
        F.explode(buckets).alias("_b"),
    ).select("doc_id", "target_lang", "updated_at", F.col("_b.bucket").alias("bucket"), F.posexplode("_b.e").alias("term_order", "_e"))
    return _named(rows)


def _named(rows: DataFrame) -> DataFrame:
    out = rows.select(
        "doc_id", "target_lang", "updated_at", "bucket", "term_order", F.col("_e.key").alias("_id"), "_e.value.*"
    )
    return out.withColumn("target_term", F.coalesce(F.nullif(text("target_term"), F.lit("")), "target")).withColumn(
        "term_id", F.coalesce("term_id", "_id")
    ).drop("target", "_id")


def read_excluded(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(SNAPSHOT).json(path, multiLine=True)
    return raw.select(F.col("job_id").alias("doc_id"), F.explode("excluded").alias("_x")).select("doc_id", "_x.*")


def write_snapshot(df: DataFrame, path: str, key: str = "job_id") -> None:
    """Replace the stored rows of the jobs in the frame; other jobs stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
