"""Checks of review decisions in families with a weaker spelling of each term."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.review import apply_review_actions, review_history
from . import corpus as C
from . import sqltext as S
from .registry import check


def _families(spark, sf):
    """Document terms, each with a possessive form as a raw candidate of its own."""
    terms = C.entries(spark, sf).drop("frequency")
    changed = {
        "term_id": F.concat(F.lit("v_"), F.lower("source_term")), "entry_order": F.col("entry_order") + 100000,
        "source_term": F.concat("source_term", F.lit("'s")), "memory_kind": F.lit("raw_evidence_candidate"), "status": F.lit("analysis_hint"),
        "preferred_target": F.lit(None).cast("string"), "source_terms": F.array().cast("array<string>"),
        "target_candidates": F.array().cast(terms.schema["target_candidates"].dataType),
    }
    return terms.unionByName(terms.withColumns(changed))


def _actions(spark, sf):
    """A target for the term, another one for its form, and the form dropped where the term's count is even."""
    e = C.entries(spark, sf)
    form = F.concat("source_term", F.lit("'s"))
    own = F.when(F.length("source_term") > 5, F.concat("source_term", F.lit("us")))
    steps = F.array(
        F.struct(F.lit(0).alias("n"), F.lit("mark_preferred").alias("type"), F.col("source_term").alias("source_term"), own.alias("target")),
        F.struct(F.lit(1).alias("n"), F.lit("mark_preferred").alias("type"), form.alias("source_term"), F.concat("source_term", F.lit("zz")).alias("target")),
        F.struct(F.lit(2).alias("n"), F.when(F.col("frequency") % 2 == 0, "drop_candidate").alias("type"), form.alias("source_term"), F.lit(None).cast("string").alias("target")),
    )
    rows = e.select("doc_id", "entry_order", F.inline(steps)).where("type is not null")
    empty = [F.lit("").alias(c) for c in ("preferred_target", "status", "meaning")]
    return rows.select(
        "doc_id", (F.col("entry_order") * 4 + F.col("n")).cast("bigint").alias("action_seq"), "type", "source_term", "target", *empty, F.lit("seen").alias("reason")
    )


# The target of the term itself, then that of its form: a stronger term (three places or more) passes its own on.
FAMILY = """
told AS (SELECT *, frequency >= 3 AS stronger, frequency % 2 = 0 AS dropped, 4 * entry_order AS seq, 'v_' || lower(source_term) AS form_id,
  CASE WHEN length(source_term) > 5 THEN source_term || 'us' ELSE coalesce(preferred_target, '') END AS first_target FROM entries),
fam AS (SELECT *, CASE WHEN stronger THEN first_target ELSE source_term || 'zz' END AS form_target FROM told)
"""


@check("review_history", S.with_(S.GLOSSARY, FAMILY) + """
SELECT doc_id, term_id, seq AS action_seq, 'first_target' AS change, first_target AS detail FROM fam
UNION ALL SELECT doc_id, form_id, seq, 'family_target', first_target FROM fam WHERE first_target <> ''
UNION ALL SELECT doc_id, form_id, seq + 1, 'first_target', form_target FROM fam
UNION ALL SELECT doc_id, term_id, seq + 1, 'family_target', form_target FROM fam WHERE NOT stronger
UNION ALL SELECT doc_id, form_id, seq + 2, 'confirmed_target', form_target FROM fam WHERE dropped""")
def _(spark, sf):
    return review_history(_actions(spark, sf), _families(spark, sf)).select("doc_id", "term_id", "action_seq", "change", "detail")


@check("reviewed_families", S.with_(S.GLOSSARY, FAMILY) + """
SELECT doc_id, term_id, CASE WHEN stronger THEN 'preferred' ELSE 'blocked' END AS status, CASE WHEN stronger THEN first_target ELSE form_target END AS preferred_target,
  CASE WHEN stronger THEN 2 ELSE 1 + (first_target <> '')::INT END AS candidate_count, CASE WHEN stronger THEN 1 ELSE 2 END AS history_rows FROM fam
UNION ALL
SELECT doc_id, form_id, CASE WHEN dropped THEN 'blocked' ELSE 'preferred' END, form_target,
  CASE WHEN stronger THEN 1 ELSE 1 + (first_target <> '')::INT END, 1 + (first_target <> '')::INT + dropped::INT FROM fam""")
def _(spark, sf):
    out = apply_review_actions(_actions(spark, sf), _families(spark, sf))
    return out.select("doc_id", "term_id", "status", "preferred_target", "candidate_count", "history_rows")
