"""Working tables that the checks derive from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import document_key
from ..operators.batching import assign_scope_batches
from ..operators.jobs import number_events
from ..operators.nodes import context_text, neighbour_context, read_nodes
from ..operators.units import build_units
from ..session import materialize
from ..sources.tables import read_table, spread

_kept: dict[tuple, DataFrame] = {}


def kept(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    """Derived tables are written once per session and folder."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _kept:
        _kept[key] = materialize(build())
    return _kept[key]


def forget() -> None:
    _kept.clear()


def documents(spark, sf):
    return spread(read_table(spark, sf, "documents"))


def nodes(spark, sf):
    return read_nodes(documents(spark, sf))


def _built(spark, sf):
    return build_units(nodes(spark, sf), stage=lambda name, df: kept(spark, sf, name, lambda: df))


def units(spark, sf):
    return kept(spark, sf, "units", lambda: _built(spark, sf)[0])


def targets(spark, sf):
    return kept(spark, sf, "targets", lambda: _built(spark, sf)[1])


def units_and_targets(spark, sf):
    return units(spark, sf), targets(spark, sf)


def context_units(spark, sf):
    """Units with page scopes and neighbour context, as a translation job would see them."""

    def build():
        paged = assign_scope_batches(nodes(spark, sf))
        near = neighbour_context(paged).withColumn(
            "context_text", context_text("previous_text", "next_text", F.lit(""), F.lit(""))
        )
        return build_units(near.drop("previous_text", "next_text"))[0]

    return kept(spark, sf, "context_units", build)


def pairs(spark, sf):
    """A user turn and the next turn of its conversation."""
    turns = read_table(spark, sf, "conversations")
    answers = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("translated"))
    return turns.where("role = 'user'").join(answers, ["conv_id", "turn"]).select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("unit_id"), F.col("text").alias("original"),
        "translated", F.lit("paragraph").alias("element_type"),
    )


def glossary(spark, sf):
    def build():
        words = nodes(spark, sf).select(
            "doc_id", "node_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{3,}"), F.lit(0))).alias("source_term")
        )
        counted = words.groupBy("doc_id", "source_term").agg(F.count(F.lit(1)).alias("frequency")).where("frequency >= 2")
        from ..operators.ordering import dense_number

        n = F.col("frequency")
        rows = counted.select(
            "doc_id", F.concat(F.lit("g_"), F.lower("source_term")).alias("term_id"), "source_term",
            F.lower("source_term").alias("normalized_source"), F.array(F.upper("source_term")).alias("aliases"), "frequency",
            F.when(n >= 4, "locked").when(n == 3, "soft_locked").otherwise("pending").alias("bucket"),
            F.concat("source_term", F.lit("um")).alias("target_term"), F.lit(1).alias("token_count"),
            n.alias("match_priority"), F.least(F.lit(1.0), n / 10.0).alias("candidate_score"),
            F.lit(None).cast("string").alias("review_reason"), (-n).alias("_o"),
        )
        return dense_number(rows, ["doc_id"], ["_o", "source_term"], "term_order", 1).drop("_o")

    return kept(spark, sf, "glossary", build)


def entries(spark, sf):
    """Document terms in their full schema, derived from the glossary."""
    none = F.array().cast("array<string>")
    n = F.col("frequency")
    target = F.when(n >= 3, F.upper("source_term"))
    status = F.when(n == 2, "analysis_hint").when(n == 3, "review_required").otherwise("preferred")
    meaning = F.when(n == 2, "").otherwise(F.concat(F.lit("seen "), n.cast("string"), F.lit(" times")))
    forms = F.array("source_term", F.concat(F.lit("the "), F.lower("source_term")))
    return glossary(spark, sf).select(
        "doc_id", F.concat(F.lit("e_"), F.lower("source_term")).alias("term_id"), F.col("term_order").alias("entry_order"),
        "source_term", forms.alias("source_terms"), F.transform(forms, document_key).alias("normalized_sources"),
        F.when(n == 2, "raw_evidence_candidate").when(n == 3, "term").otherwise("analysis_candidate").alias("memory_kind"),
        status.alias("status"), meaning.alias("meaning"), F.lit("").alias("full_form"), F.lit("").alias("document_local_role"),
        F.lit("").alias("why_it_matters"), F.lit("").alias("target_pattern"), (n == 3).alias("target_decision_needed"),
        (n == 3).alias("needs_review"), F.lit("").alias("resolver_priority"), F.lit("").alias("target_language_risk"),
        F.lit("").alias("pre_judge_inject_policy"), F.lit(False).alias("core_concept"),
        F.lit(False).alias("requires_preferred_target"), F.col("candidate_score").alias("confidence"),
        target.alias("preferred_target"), F.lit("sense_001").alias("active_sense_id"), none.alias("family_ids"),
        F.array(
            F.struct(
                F.lit("sense_001").alias("sense_id"), meaning.alias("meaning"), status.alias("status"),
                target.alias("preferred_target"), F.col("candidate_score").alias("confidence"), F.lit("").alias("evidence"),
                F.lit("").alias("target_language_risk"), F.lit("").alias("resolver_priority"),
            )
        ).alias("senses"),
        F.when(
            n >= 3,
            F.array(
                *[
                    F.struct(
                        t.alias("target"), F.lit(s).alias("status"), n.alias("count"), F.lit("seed").alias("source"),
                        F.lit("").alias("reason"), none.alias("evidence_refs"),
                    )
                    for t, s in ((F.upper("source_term"), "preferred"), (F.concat("source_term", F.lit("us")), "candidate"))
                ]
            ),
        ).otherwise(F.array()).cast(
            "array<struct<target:string,status:string,count:bigint,source:string,reason:string,evidence_refs:array<string>>>"
        ).alias("target_candidates"),
        F.when(n >= 4, F.array(F.upper("source_term"), F.concat("source_term", F.lit("os")))).otherwise(none).alias("do_not_translate_as"),
        F.array().cast("array<struct<target:string,status:string,reason:string>>").alias("avoid_targets"),
        none.alias("do_not_confuse_with_source_terms"), F.lit("").alias("evidence"), "frequency",
    )


def usage(spark, sf):
    return read_table(spark, sf, "events").select(
        F.col("user_id").alias("job_id"), F.col("event_id").alias("turn"), F.col("event_type").alias("model"), "ts",
        F.get_json_object("props", "$.k").try_cast("bigint").alias("prompt_tokens"),
        F.col("value").try_cast("bigint").alias("completion_tokens"),
    )


def prices(spark):
    rows = [("view", 1.0, 4.0), ("click", 2.0, 6.0), ("purchase", 1.0, 3.0), ("signup", 3.0, 5.0)]
    return spark.createDataFrame(
        [(*r, 0.2) for r in rows], "model string, input_usd_per_1m double, output_usd_per_1m double, usd_per_image double"
    )


def raw_job_events(spark, sf):
    kind = F.col("event_type")
    return read_table(spark, sf, "events").select(
        F.col("user_id").alias("job_id"), "ts", F.col("event_id").alias("seq"), "value",
        F.when(kind == "signup", "translation_started").when(kind == "purchase", "completed")
        .when(kind == "error", "job_error").otherwise("blocks_translated").alias("event"),
        F.create_map(
            F.lit("k"), F.get_json_object("props", "$.k"), F.lit("pairs"), F.col("props"),
            F.lit("kind"), kind,
        ).alias("data"),
    )


def job_events(spark, sf):
    return number_events(raw_job_events(spark, sf))
