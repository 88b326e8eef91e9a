"""Term memory: observed targets, promotion, demotion, collisions, merging."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions.terms import (
    ambiguous_acronym,
    bad_target,
    entry_sources,
    storage_skip_reason,
    target_candidate,
    too_short_target,
    unrelated_acronyms,
)
from ..functions.text import clean_evidence, extract_acronyms, let, normalize_source, rank_of, strip, text, words
from .matching import match_terms
from .mining import shorter_runs
from .ordering import top_k


def observe(units: DataFrame, translations: DataFrame, terms: DataFrame, language: str) -> DataFrame:
    """One row per open term and unit with the observed target or the reason it is not kept."""
    open_terms = terms.where(F.col("bucket").isin("pending", "review", "soft_locked"))
    hits = match_terms(units, open_terms, ["doc_id", "unit_id"], ["doc_id"])
    rows = hits.join(units.select("doc_id", "unit_id", "chunk_id", F.col("text").alias("source_text")), ["doc_id", "unit_id"])
    rows = rows.join(translations, ["doc_id", "unit_id"], "left").withColumn("translated", text("translated"))
    rows = rows.join(open_terms.select("doc_id", "term_id", "source_term", "aliases"), ["doc_id", "term_id"])
    rows = rows.withColumn("_c", target_candidate("source_text", "translated", "matched_source"))
    sources = F.array_append(entry_sources("source_term", "aliases"), F.col("matched_source"))
    shape = (
        F.when(text("_c") == "", "")
        .when(bad_target("matched_source", "_c"), "bad_target_candidate_shape")
        .when(too_short_target("matched_source", "_c"), "target_too_short_for_source")
        .when(F.size(unrelated_acronyms("_c", sources)) > 0, "target_contains_unrelated_acronym")
        .otherwise("")
    )
    rows = rows.withColumn("_shape", shape).withColumn("_c", F.when(F.col("_shape") == "", F.nullif(text("_c"), F.lit(""))))
    skip = storage_skip_reason("translated", "_c", F.lit(language))
    rows = rows.withColumn("storage_skip_reason", skip)
    script = F.col("storage_skip_reason").isin(
        "unexpected_script_in_translation", "unexpected_script_in_target_candidate"
    )
    return rows.select(
        "doc_id", "term_id", "unit_id", "chunk_id", "matched_source", "translated",
        F.when(~script, F.col("_c")).alias("target_candidate"), "storage_skip_reason",
        F.when(script, F.col("storage_skip_reason")).otherwise(F.nullif("_shape", F.lit(""))).alias("review_reason"),
    )


def observation_key() -> Column:
    stored = F.when(F.col("storage_skip_reason") == "", F.col("translated")).otherwise("")
    return F.concat_ws("|", "chunk_id", F.col("unit_id").cast("string"), stored, text("target_candidate"))


def dedupe_observations(observed: DataFrame) -> DataFrame:
    """The same observation of a term counts once."""
    return observed.withColumn("observation_key", observation_key()).dropDuplicates(["doc_id", "term_id", "observation_key"])


def target_counts(observed: DataFrame) -> DataFrame:
    """How often each target was seen per term, in how many chunks, and where first."""
    kept = observed.where((text("target_candidate") != "") & (F.col("storage_skip_reason") == ""))
    return kept.groupBy("doc_id", "term_id", F.col("target_candidate").alias("target")).agg(
        F.count(F.lit(1)).alias("count"), F.countDistinct("chunk_id").alias("chunk_count"),
        F.min("unit_id").alias("first_seen"),
    )


def target_chunks(observed: DataFrame) -> DataFrame:
    """The chunks themselves stay rows, so that a frequent target has no endless list."""
    kept = observed.where((text("target_candidate") != "") & (F.col("storage_skip_reason") == ""))
    return kept.select("doc_id", "term_id", F.col("target_candidate").alias("target"), "chunk_id").distinct()


def target_dispersion(counts: DataFrame) -> DataFrame:
    """Top target with its share, and the entropy of all targets, per term.

    Entropy is ln(total) - sum(c ln c) / total, which needs one pass of sums.
    """
    c = F.col("count").cast("double")
    out = counts.groupBy("doc_id", "term_id").agg(
        F.sum("count").alias("total"), F.count(F.lit(1)).alias("target_kinds"),
        F.max_by(F.struct("target", "count"), F.struct(F.col("count"), -F.col("first_seen"))).alias("_top"),
        F.sum(c * F.log(c)).alias("_clogc"),
    )
    return out.select(
        "doc_id", "term_id", "total", "target_kinds", F.col("_top.target").alias("top_target"),
        F.col("_top.count").alias("top_count"), (F.col("_top.count") / F.col("total")).alias("top_share"),
        F.greatest(F.log(F.col("total").cast("double")) - F.col("_clogc") / F.col("total"), F.lit(0.0)).alias("entropy"),
    )


def promotion(terms: DataFrame, dispersion: DataFrame) -> DataFrame:
    """Decision per pending term: ``promote``, ``review`` with a reason, or ``keep``."""
    rows = terms.where(F.col("bucket") == "pending").join(dispersion, ["doc_id", "term_id"], "left")
    source, target = F.col("source_term"), text("top_target")
    score = F.coalesce(F.nullif("candidate_score", F.lit(0.0)), "confidence", F.lit(0.0))
    sources = entry_sources("source_term", "aliases")
    reason = (
        F.when(text("review_reason") != "", F.col("review_reason"))
        .when(
            (F.coalesce("frequency", F.lit(0)) < 2) | F.col("top_target").isNull()
            | (F.col("top_count") < K.LOCK_MIN_TARGET_COUNT), "keep",
        )
        .when(F.col("top_share") < K.LOCK_MIN_TARGET_SHARE, "target_conflict")
        .when((F.col("target_kinds") >= 3) & (F.col("entropy") > K.LOCK_MAX_TARGET_ENTROPY), "target_entropy_high")
        .when((score < K.LOCK_MIN_SCORE) & (score < K.LOCK_MIN_OBSERVED_SCORE), "keep")
        .otherwise(target_problem(source, target, sources, "aliases"))
    )
    confidence = F.bround(
        F.greatest(F.coalesce("confidence", F.lit(0.0)), F.least(F.lit(0.85), 0.65 + F.col("top_count") * 0.08)), 4
    )
    decision = F.when(F.col("_r") == "keep", "keep").when(F.col("_r") == "", "promote").otherwise("review")
    return rows.withColumn("_r", reason).select(
        "doc_id", "term_id", "source_term", decision.alias("decision"),
        F.when(decision == "review", F.col("_r")).alias("reason"),
        F.when(decision == "promote", target).alias("target_term"),
        F.when(decision == "promote", confidence).otherwise(F.col("confidence")).alias("confidence"),
    )


def target_problem(source, target, sources, aliases) -> Column:
    """First rule that a target breaks, or empty."""
    return (
        F.when(bad_target(source, target), "bad_target_candidate_shape")
        .when(too_short_target(source, target), "target_too_short_for_source")
        .when(F.size(unrelated_acronyms(target, sources)) > 0, "target_contains_unrelated_acronym")
        .when(ambiguous_acronym(source, aliases), "ambiguous_acronym_aliases")
        .otherwise("")
    )


def demotion(terms: DataFrame) -> DataFrame:
    """Soft-locked entries that must go back to review, with the reason."""
    soft = terms.where(F.col("bucket") == "soft_locked")
    problem = target_problem("source_term", "target_term", entry_sources("source_term", "aliases"), "aliases")
    reason = F.when(text("review_reason") != "", F.col("review_reason")).otherwise(problem)
    return soft.withColumn("reason", reason).where("reason <> ''").select("doc_id", "term_id", "source_term", "reason")


def _sources_and_runs(terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    names = F.array_distinct(F.transform(entry_sources("source_term", "aliases"), lambda s: F.array_join(words(normalize_source(s)), " ")))
    rows = terms.select("doc_id", "_target", "term_id", F.explode(names).alias("name"))
    runs = let(F.split("name", " "), lambda w: shorter_runs(w, F.size(w)))
    return rows, rows.select("doc_id", "_target", "term_id", F.explode(runs).alias("run")).distinct()


def target_collisions(terms: DataFrame) -> DataFrame:
    """Soft-locked terms that share a target with an unrelated term.

    Two terms are related when a source form of one equals, or is a word run of,
    a form of the other. A term collides when fewer terms of its target group are
    related to it than the group has. Counts of names and runs bound that number
    from both sides without pairing terms; only terms between the bounds have
    their distinct relatives looked up.
    """
    soft = terms.where((F.col("bucket") == "soft_locked") & (strip("target_term") != "")).withColumn(
        "_target", normalize_source("target_term")
    )
    group = ["doc_id", "_target"]
    sizes = soft.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_n"), F.min_by("target_term", "term_id").alias("_shown")
    ).where("_n > 1")
    soft = soft.join(sizes, group)
    names, runs = _sources_and_runs(soft)
    by_run = runs.groupBy(*group, "run").agg(F.count(F.lit(1)).alias("_holders"))
    by_name = names.groupBy(*group, "name").agg(F.countDistinct("term_id").alias("_owners"))
    # Terms that hold one of my names, and terms whose name is one of my runs.
    up = names.join(by_run.withColumnRenamed("run", "name"), [*group, "name"]).select(*group, "term_id", F.col("_holders").alias("_c"))
    down = runs.join(by_name.withColumnRenamed("name", "run"), [*group, "run"]).select(*group, "term_id", F.col("_owners").alias("_c"))
    bounds = up.unionByName(down).groupBy(*group, "term_id").agg(F.max("_c").alias("_low"), F.sum("_c").alias("_high"))
    rows = soft.join(bounds, [*group, "term_id"])
    sure = rows.where("_high < _n").select(*group, "term_id")
    open_ids = rows.where("_high >= _n and _low < _n").select(*group, "term_id")
    mine = names.join(open_ids, [*group, "term_id"], "left_semi")
    my_runs = runs.join(open_ids, [*group, "term_id"], "left_semi")
    relatives = (
        mine.join(runs.select(*group, F.col("run").alias("name"), F.col("term_id").alias("_other")), [*group, "name"])
        .select(*group, "term_id", "_other")
        .unionByName(
            my_runs.join(names.select(*group, F.col("name").alias("run"), F.col("term_id").alias("_other")), [*group, "run"])
            .select(*group, "term_id", "_other")
        )
        .distinct().groupBy(*group, "term_id").agg(F.count(F.lit(1)).alias("_related"))
    )
    counted = relatives.join(sizes.select(*group, "_n"), group).where("_related < _n").select(*group, "term_id")
    found = soft.join(sure.unionByName(counted), [*group, "term_id"], "left_semi")
    known = F.flatten(F.transform(entry_sources("source_term", "aliases"), extract_acronyms))
    target_codes = extract_acronyms("_shown")
    exempt = (F.size(target_codes) > 0) & (F.size(F.array_except(target_codes, known)) == 0)
    return found.where(~exempt).select("doc_id", "term_id", "source_term", "target_term", F.lit("target_collision").alias("reason"))


def merge_scan(memory: DataFrame, scan: DataFrame) -> DataFrame:
    """Merge scanned candidates into stored terms found by any source form.

    Counts and scores take the maximum, lists the union; a candidate without a
    stored term joins the pending bucket.
    """
    from .matching import find_entries

    keys = scan.select("doc_id", F.col("normalized_source").alias("key"))
    found = find_entries(keys, memory, ["doc_id"]).select(
        "doc_id", F.col("key").alias("normalized_source"), F.col("term_id").alias("_stored")
    )
    rows = scan.join(found, ["doc_id", "normalized_source"], "left")
    shared = ["frequency", "chunk_count", "section_count", "candidate_score", "match_priority"]
    lists = ["aliases", "candidate_types", "reason"]
    known = rows.where("_stored is not null").select("doc_id", F.col("_stored").alias("term_id"), *shared, *lists)
    every = memory.select("doc_id", "term_id", *shared, *lists).unionByName(known)
    numbers = every.groupBy("doc_id", "term_id").agg(*[F.max(c).alias(c) for c in shared])
    out = memory.drop(*shared).join(numbers, ["doc_id", "term_id"])
    for name in lists:
        items = every.select("doc_id", "term_id", F.explode(name).alias("_v")).where(strip("_v") != "").distinct()
        merged = items.groupBy("doc_id", "term_id").agg(F.array_sort(F.collect_list("_v")).alias("_l"))
        out = out.drop(name).join(merged, ["doc_id", "term_id"], "left").withColumn(
            name, F.coalesce("_l", F.array().cast("array<string>"))
        ).drop("_l")
    new = rows.where("_stored is null").drop("_stored").withColumn("bucket", F.lit("pending"))
    return out.unionByName(new, allowMissingColumns=True)


def merge_occurrences(stored: DataFrame, scanned: DataFrame, memory: DataFrame, most: int = K.MAX_OCCURRENCES) -> DataFrame:
    """Stored and scanned occurrences of each stored term, each place once, at most ``most`` spread evenly.

    ``stored`` has doc_id, term_id and occ_order; ``scanned`` has
    normalized_source in place of term_id. Both have chunk_id, unit_id and
    source_snippet, which tell places apart.
    """
    from .matching import find_entries
    from .mining import sample_evenly

    keys = scanned.select("doc_id", F.col("normalized_source").alias("key")).distinct()
    found = find_entries(keys, memory, ["doc_id"]).select("doc_id", F.col("key").alias("normalized_source"), "term_id")
    new = scanned.join(found, ["doc_id", "normalized_source"]).drop("normalized_source").withColumn("_later", F.lit(1))
    rows = stored.withColumn("_later", F.lit(0)).unionByName(new, allowMissingColumns=True)
    place = ["doc_id", "term_id", "chunk_id", "unit_id", "source_snippet"]
    rest = [c for c in rows.columns if c not in place]
    first = rows.groupBy(*place).agg(F.min_by(F.struct(*rest), F.struct("_later", "occ_order")).alias("_r")).select(*place, "_r.*")
    return sample_evenly(first, ["doc_id", "term_id"], ["_later", "occ_order"], most).drop("_later")


def memory_summary(terms: DataFrame) -> DataFrame:
    """Terms per bucket; absent buckets count zero."""
    return terms.groupBy("doc_id").agg(
        *[F.count_if(F.col("bucket") == b).alias(b) for b in K.TERM_BUCKETS]
    )


# Limits and bucket order of the analysis sample.
SAMPLE_TERMS, SAMPLE_OCCURRENCES, SAMPLE_CHARS = 64, 2, 24000
SAMPLE_BUCKETS = {"locked": 0, "soft_locked": 1, "review": 2, "pending": 3}


def analysis_sample(
    terms: DataFrame, occurrences: DataFrame, max_terms: int = SAMPLE_TERMS,
    per_term: int = SAMPLE_OCCURRENCES, max_chars: int = SAMPLE_CHARS,
) -> DataFrame:
    """Occurrence snippets for an analysis, in term order, under three caps.

    A snippet is used once over all terms. Terms without a snippet of their own
    do not count. The sample stops with the snippet that reaches the budget.

    What a term may use depends on all terms before it, so the rows of a
    document are walked in order. The walk streams sorted rows and remembers
    only the chosen snippets (at most ``max_terms * per_term``). For the same
    reason no term needs more offers than that number plus its own.
    """
    rank = F.struct(
        rank_of(F.col("bucket"), SAMPLE_BUCKETS, 99).alias("a"), (-F.col("candidate_score")).alias("b"),
        (-F.col("frequency")).alias("c"), (-F.col("token_count")).alias("d"), F.col("source_term").alias("e"),
    )
    ranked = terms.select("doc_id", "normalized_source", rank.alias("_rank"))
    raw = F.coalesce(F.nullif(text("source_snippet"), F.lit("")), "surrounding_source")
    offers = occurrences.select("doc_id", "normalized_source", "unit_id", clean_evidence(raw).alias("snippet"))
    offers = offers.where("snippet <> ''").groupBy("doc_id", "normalized_source", "snippet").agg(
        F.min("unit_id").alias("unit_id")
    )
    offers = top_k(
        offers, ["doc_id", "normalized_source"], [F.col("unit_id"), F.col("snippet")], (max_terms + 1) * per_term, "_i"
    )
    rows = offers.join(ranked, ["doc_id", "normalized_source"])
    ordered = rows.repartition("doc_id").sortWithinPartitions("doc_id", "_rank", "normalized_source", "_i")

    def walk(batches):
        doc = term = None
        for batch in batches:
            out = []
            for d, key, unit, snippet in zip(batch.doc_id, batch.normalized_source, batch.unit_id, batch.snippet):
                if d != doc:
                    doc, term, chars, count, seen = d, None, 0, 0, set()
                if key != term:
                    term, own = key, 0
                full = count >= max_terms if own == 0 else own >= per_term
                if full or chars >= max_chars or snippet in seen:
                    continue
                seen.add(snippet)
                own, chars = own + 1, chars + len(snippet)
                count += own == 1
                out.append((d, key, count, own, unit, snippet, chars))
            yield pd.DataFrame(
                out, columns=["doc_id", "normalized_source", "term_place", "place", "unit_id", "snippet", "chars_so_far"]
            )

    key_type = terms.schema["doc_id"].dataType.simpleString()
    return ordered.select("doc_id", "normalized_source", "unit_id", "snippet").mapInPandas(
        walk,
        f"doc_id {key_type}, normalized_source string, term_place bigint, place bigint, unit_id bigint, "
        "snippet string, chars_so_far bigint",
    )
