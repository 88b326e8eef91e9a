"""Composed operators: mining, observation, quality, seeding, review, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quality import needs_translation
from ..operators import actions as A
from ..operators import document_terms as D
from ..operators import matching as M
from ..operators import mining
from ..operators import term_memory as TM
from ..operators.batching import assign_scope_batches, assign_unit_batches
from ..operators.nodes import context_text, neighbour_context, read_nodes, table_context
from ..operators.quality_report import quality_report  # noqa: F401
from ..operators.retrieval import select_sections
from ..operators.translator import Translate, translate_units
from ..operators.units import build_units, evaluation_units, fragment_context, fragments_of, with_hints
from ..session import materialize


def judge_units(units: DataFrame, keys: list[str], korean: bool = False) -> DataFrame:
    """Candidate statistics with the exclusion rule, staged for the steps after it."""
    unit_key = ["doc_id", "unit_id"]
    carry = list(dict.fromkeys([*keys, *unit_key, "_chunk", "_section", "element_type", "is_header"]))
    # Hashed once a unit, not once a candidate.
    found = mining.extract_candidates(mining.hashed_places(units), korean, carry)
    # Read again for what is counted apart; without texts and alias lists it is small.
    slim = materialize(found.withColumn("has_alias", F.size("aliases") > 0).drop("aliases"))
    return materialize(mining.judge_candidates(mining.term_stats(slim, keys, units, unit_key)))


def mine_units(units: DataFrame, keys: list[str], korean: bool = False, judged: DataFrame | None = None) -> DataFrame:
    """Scored, pruned and numbered terms with their aliases."""
    judged = judge_units(units, keys, korean) if judged is None else judged
    scored = mining.score_terms(judged)
    numbered = mining.number_terms(scored, keys)
    kept = mining.prune_nested(numbered, keys)
    in_brackets = units.where(F.contains("text", F.lit("(")))
    aliases = mining.term_aliases(mining.extract_candidates(in_brackets, korean, [*keys, "element_type", "is_header"]), keys)
    return kept.join(aliases, [*keys, "normalized_source"], "left").withColumn(
        "aliases", F.coalesce("aliases", F.array().cast("array<string>"))
    )


def mine_terms(docs: DataFrame, language: str = "ko") -> DataFrame:
    """Terms per document, from text to numbered candidates.

    Source text counts as Korean when the target language is English.
    """
    paged = assign_scope_batches(read_nodes(docs))
    units, _ = build_units(paged)
    return mine_units(materialize(units), ["doc_id"], language in ("en", "eng", "english", "영어"))


def mine_corpus(docs: DataFrame, k: int | None = None) -> DataFrame:
    """Terms of the whole corpus; a document is a chunk, its first line a section."""
    nodes = read_nodes(docs)
    units = nodes.withColumn("chunk_id", F.col("doc_id").cast("string")).withColumn("unit_id", F.col("node_id"))
    judged = judge_units(units.withColumn("corpus", F.lit("all")), ["corpus"])
    scored = mining.score_terms(judged).drop("corpus")
    return scored if k is None else scored.orderBy(F.desc("candidate_score"), F.desc("frequency"), "normalized_source").limit(k)


def contextual_units(docs: DataFrame, paragraph_context: bool = True) -> tuple[DataFrame, DataFrame]:
    """Units with everything a translator sees around them, and their targets.

    Context is the heading, the table's caption and the neighbouring
    paragraphs; without paragraph context, the neighbouring fragments of the
    unit's own paragraph. Abbreviation and dialogue hints come last.
    """
    paged = assign_scope_batches(read_nodes(docs))
    titles = table_context(paged).select("doc_id", "table_index", F.col("table_title").alias("_title"))
    near = neighbour_context(paged) if paragraph_context else paged.withColumns(
        {c: F.lit("") for c in ("previous_text", "next_text")}
    )
    heading = F.when(F.coalesce("element_type", F.lit("")) != "heading", F.col("section"))
    seen = near.join(titles, ["doc_id", "table_index"], "left").withColumn(
        "context_text", context_text("previous_text", "next_text", heading, F.coalesce("_title", "table_title"))
    ).drop("previous_text", "next_text", "_title")
    seen = materialize(seen)
    units, targets = build_units(seen)
    if not paragraph_context:
        first = targets.groupBy("doc_id", "unit_id").agg(F.min(F.struct("node_id", "fragment_index")).alias("_t")).select("doc_id", "unit_id", "_t.*")
        beside = first.join(fragment_context(fragments_of(seen)), ["doc_id", "node_id", "fragment_index"]).select(
            "doc_id", "unit_id",
            F.concat_ws("\n", *[
                F.when(F.trim(c) != "", F.concat(F.lit(f"{label}: "), F.col(c)))
                for label, c in (("SAME_PARAGRAPH_PREVIOUS", "previous_fragment"), ("SAME_PARAGRAPH_NEXT", "next_fragment"))
            ]).alias("_beside"),
        )
        units = units.join(beside, ["doc_id", "unit_id"], "left").withColumn(
            "context_text", F.concat_ws("\n", F.nullif("context_text", F.lit("")), F.nullif("_beside", F.lit("")))
        ).drop("_beside")
    return with_hints(units), targets


def observe_and_promote(
    units: DataFrame, translations: DataFrame, terms: DataFrame, language: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Observations, promotion decisions, and collisions among the terms then locked."""
    observed = materialize(TM.dedupe_observations(TM.observe(units, translations, terms, language)))
    notes = observed.where("review_reason is not null").groupBy("doc_id", "term_id").agg(
        F.max_by("review_reason", "unit_id").alias("_note")
    )
    noted = terms.join(notes, ["doc_id", "term_id"], "left").withColumn(
        "review_reason", F.coalesce("_note", "review_reason")
    ).drop("_note")
    decided = TM.promotion(noted, TM.target_dispersion(TM.target_counts(observed)))
    promoted = decided.where("decision = 'promote'").select("doc_id", "term_id", F.col("target_term").alias("_t"))
    locked = noted.join(promoted, ["doc_id", "term_id"], "left").withColumn(
        "bucket", F.when(F.col("_t").isNotNull(), "soft_locked").otherwise(F.col("bucket"))
    ).withColumn("target_term", F.coalesce("_t", "target_term")).drop("_t")
    demoted = TM.demotion(locked).select("doc_id", "term_id", "source_term", "reason")
    left = locked.join(demoted, ["doc_id", "term_id"], "left_anti")
    collided = TM.target_collisions(left).select("doc_id", "term_id", "source_term", "reason")
    return observed, decided, demoted.unionByName(collided)


def seed_document_terms(seeds: dict[str, DataFrame], terms: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Document term memory from analysis seeds and mined terms."""
    proof = D.representative_evidence(terms, occurrences).groupBy("doc_id", "normalized_source").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("rank", F.left("snippet", F.lit(220)).alias("s"))))["s"], " | ").alias("evidence")
    )
    raw = terms.join(proof, ["doc_id", "normalized_source"], "left").select(
        "doc_id", F.col("term_order").alias("seed_order"), "source_term", F.col("aliases").alias("source_terms"),
        F.lit("analysis_hint").alias("status"), F.lit(True).alias("target_decision_needed"), F.lit("low").alias("resolver_priority"),
        F.col("candidate_score").alias("confidence"), "evidence",
    )
    seeded = materialize(D.seed_entries(D.union_seeds({**seeds, "raw_evidence_candidate": raw})))
    attached = materialize(D.attach_families(D.sanitize_entries(seeded)))
    return D.remove_sibling_targets(attached)


def review_input(entries: DataFrame, terms: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Merged families in review order with the quality of their evidence."""
    families = materialize(D.merge_families(entries))
    members = D.family_components(entries)
    proof = D.review_evidence(entries, terms, occurrences).join(members, ["doc_id", "term_id"])
    quality = D.evidence_quality(proof, ["doc_id", "component"])
    order = entries.select("doc_id", "term_id", "entry_order")
    rows = families.join(quality, ["doc_id", "component"], "left").join(order, ["doc_id", "term_id"])
    return D.review_queue(rows)


def resolver_scopes(entries: DataFrame, injections: DataFrame, observed: DataFrame) -> DataFrame:
    found = materialize(A.classify_observations(injections, observed.drop("scope")))
    return A.resolver_signals(entries, found, observed)


def translation_context(units: DataFrame, entries: DataFrame, sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Relevant document terms and memory sections of each batch.

    The units of a batch are looked up together: their own texts first, then
    the contexts around them.
    """
    # Batching reads the units several times.
    rows = assign_unit_batches(materialize(units.select("doc_id", "unit_id", "text", "context_text", "context_scope")))
    listed = F.array_sort(F.collect_list(F.struct("unit_id", "text", "context_text", "context_scope")))
    batches = materialize(
        rows.groupBy("doc_id", "batch_id").agg(listed.alias("_u")).select(
            "doc_id", "batch_id", F.array_join(F.col("_u.text"), "\n").alias("text"),
            F.array_join(F.array_distinct(F.filter(F.col("_u.context_text"), lambda c: c != "")), "\n").alias("context_text"),
            F.get("_u.context_scope", F.lit(0)).alias("scope"),
        )
    )
    terms = M.relevant_document_terms(batches.withColumnRenamed("batch_id", "unit_id"), entries).withColumnRenamed("unit_id", "batch_id")
    queries = batches.select(F.col("doc_id").alias("job_id"), F.col("batch_id").alias("query_id"), "scope", F.col("text").alias("query"))
    return terms, select_sections(queries, sections)


def evaluate(docs: DataFrame, language: str, translate: Translate) -> DataFrame:
    """Rows for outside scoring: unit, target, source and translation.

    Documents that already read as the language are skipped before units are built.
    """
    todo = docs.where(needs_translation("text", F.lit(language)))
    # The test reads whole texts, and batching, units and facts read the lines: both are written once.
    nodes = materialize(assign_scope_batches(materialize(read_nodes(todo))))
    units, targets = build_units(nodes)
    units = materialize(units)
    done = translate_units(assign_unit_batches(units), translate, language)
    return evaluation_units(units, targets, nodes, done.select("doc_id", "unit_id", "translated"))
