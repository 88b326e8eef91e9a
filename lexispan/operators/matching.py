"""Which terms occur in which texts, and lookups by source form.

Forms go to automata, see ``inside.py``: each text of a scope is read once for
all forms of the scope. A form that must stand as a whole word is taken only
where no character of the mode's alphabet touches it (Latin letters, digits and
Hangul for ``words``; lower-case Latin letters and digits for ``key_words``).
In the mode ``words``, which ignores case, the pattern is then checked on the
survivors; in the others the automaton's answer is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions.text import (
    col,
    contains_term,
    document_key,
    let,
    normalize_source,
    rank_of,
    strip,
    text,
    token_count,
)
from .inside import forms_inside
from .ordering import top_k

#: Characters that a match may not touch, by mode.
SOLID = {"words": "A-Za-z0-9가-힣", "key_words": "a-z0-9"}

WORDS, KEY_WORDS, KEY_INSIDE = "words", "key_words", "key_inside"


def match_forms(
    texts: DataFrame, forms: DataFrame, text_key: list[str], scope: list[str], body: str = "text",
    form: str = "form", mode: str = WORDS,
) -> DataFrame:
    """All (text, form) pairs where the text contains the form; nothing is capped.

    ``scope`` columns must agree. Modes: ``words`` matches whole words and
    ignores case; ``key_words`` does so on lower-case collapsed keys;
    ``key_inside`` accepts a form anywhere inside the text's key.
    """
    key_of = (lambda c: F.lower(text(c))) if mode == WORDS else document_key
    usable = strip(form) if mode == WORDS else document_key(form)
    keyed = forms.where(usable != "").withColumn("_key", key_of(form))
    kept = [*text_key, *[s for s in scope if s not in text_key]]
    found = forms_inside(
        texts.withColumn("_body", key_of(body)), keyed, kept, scope, "_body", "_key", SOLID.get(mode, ""), body
    )
    pairs = found.join(keyed, [*scope, "_key"]).drop("_key")
    if mode != WORDS:
        return pairs
    both = pairs.join(texts.select(*text_key, F.col(body).alias("_body")), text_key)
    return both.where(contains_term("_body", form)).drop("_body")


def first_form(
    texts: DataFrame, entries: DataFrame, text_key: list[str], body: str = "text", mode: str = KEY_INSIDE
) -> DataFrame:
    """One row per text and entry with the first source form that the text contains."""
    forms = entries.select(
        "doc_id", "term_id",
        F.posexplode(F.array_distinct(F.concat(F.array(strip("source_term")), F.coalesce("source_terms", F.array().cast("array<string>"))))).alias("_i", "form"),
    )
    hits = match_forms(texts, forms, text_key, ["doc_id"], body, mode=mode)
    return hits.groupBy(*text_key, "term_id").agg(F.min_by("form", "_i").alias("matched_source"))


def match_terms(
    texts: DataFrame, terms: DataFrame, text_key: list[str], scope: list[str], body: str = "text",
    mode: str = WORDS,
) -> DataFrame:
    """One row per text and term with the best matching form, longest first.

    ``terms`` has ``term_id``, ``source_term`` and ``aliases``.
    """
    forms = terms.select(
        *scope, "term_id", F.explode(source_forms("source_term", "aliases")).alias("form")
    ).distinct()
    hits = match_forms(texts, forms, text_key, scope, body, mode=mode)
    order = F.struct(token_count("form"), F.length("form"), F.col("form"))
    return hits.groupBy(*text_key, *[s for s in scope if s not in text_key], "term_id").agg(
        F.max_by("form", order).alias("matched_source")
    )


def source_forms(term, aliases) -> Column:
    forms = F.concat(F.array(strip(term)), F.coalesce(col(aliases), F.array().cast("array<string>")))
    return F.array_distinct(F.filter(F.transform(forms, lambda a: strip(a)), lambda a: a != ""))


def find_entries(keys: DataFrame, terms: DataFrame, scope: list[str]) -> DataFrame:
    """First entry of the store for each normalised key: bucket order, then term order."""
    forms = terms.select(
        *scope, "term_id", "bucket", "term_order",
        F.explode(F.array_distinct(F.transform(source_forms("source_term", "aliases"), normalize_source))).alias("key"),
    )
    bucket = rank_of(F.col("bucket"), {b: i for i, b in enumerate(K.TERM_BUCKETS)}, 99)
    hits = keys.select(*scope, "key").distinct().join(forms, [*scope, "key"])
    return hits.groupBy(*scope, "key").agg(
        F.min_by(F.struct("term_id", "bucket"), F.struct(bucket, F.col("term_order"), F.col("term_id"))).alias("_e")
    ).select(*scope, "key", "_e.*")


def find_document_entries(keys: DataFrame, entries: DataFrame, target_first: bool = True) -> DataFrame:
    """Entry of a source text: exact source term, preferring target kinds, else an alias of a target entry."""
    context = F.col("memory_kind").isin(K.CONTEXT_KINDS)
    exact = entries.select(
        "doc_id", "term_id", "entry_order", document_key("source_term").alias("key"),
        F.when(context & F.lit(target_first), 1).otherwise(0).alias("_rank"),
        # Among context entries the last one is the fallback.
        F.when(context & F.lit(target_first), -F.col("entry_order")).otherwise(F.col("entry_order")).alias("_o"),
    )
    alias = entries.where(~context).select(
        "doc_id", "term_id", "entry_order",
        F.explode(F.array_distinct(F.transform("source_terms", document_key))).alias("key"),
        F.lit(2).alias("_rank"), F.col("entry_order").alias("_o"),
    )
    hits = keys.select("doc_id", "key").distinct().join(exact.unionByName(alias), ["doc_id", "key"])
    return hits.groupBy("doc_id", "key").agg(F.min_by("term_id", F.struct("_rank", "_o")).alias("term_id"))


def eligible_terms(terms: DataFrame) -> DataFrame:
    """Locked and soft-locked entries that may be shown: a usable target and no open review."""
    from ..functions.terms import ambiguous_acronym, bad_target, entry_sources, too_short_target, unrelated_acronyms

    soft = F.col("bucket") == "soft_locked"
    sources = entry_sources("source_term", "aliases")
    return terms.where(
        F.col("bucket").isin("locked", "soft_locked")
        & (text("source_term") != "") & (text("target_term") != "")
        & ~(soft & (text("review_reason") != ""))
        & ~too_short_target("source_term", "target_term")
        & ~bad_target("source_term", "target_term")
        & ~(soft & (F.size(unrelated_acronyms("target_term", sources)) > 0))
        & ~(soft & ambiguous_acronym("source_term", "aliases"))
    )


def relevant_terms(
    texts: DataFrame, terms: DataFrame, text_key: list[str], scope: list[str], k: int = K.MAX_RELEVANT_TERMS,
    body: str = "text",
) -> DataFrame:
    """Top-k glossary terms per text: locked first, more tokens, higher priority, source."""
    usable = eligible_terms(terms)
    hits = match_terms(texts, usable, text_key, scope, body)
    facts = usable.select(
        *scope, "term_id", "source_term", "target_term", "bucket", "match_priority",
        F.coalesce(F.col("token_count"), F.lit(0)).alias("_tc"),
    )
    rows = hits.join(facts, [*scope, "term_id"]).withColumn(
        "token_count", F.greatest(F.col("_tc"), token_count("matched_source"))
    )
    bucket = rank_of(F.col("bucket"), {"locked": 0, "soft_locked": 1}, 99)
    order = [bucket, F.col("token_count").desc(), F.col("match_priority").desc(), F.col("source_term"), F.col("term_id")]
    return top_k(rows.drop("_tc"), text_key, order, k)


def applied_terms(applications: DataFrame) -> DataFrame:
    """Uses per term with the last chunk and time."""
    used = applications.where(text("term_id") != "")
    return used.groupBy("doc_id", "term_id").agg(
        F.count(F.lit(1)).alias("prompt_use_count"),
        F.max_by("chunk_id", F.struct("applied_at", "chunk_id")).alias("last_applied_chunk_id"),
        F.max("applied_at").alias("last_applied_at"),
    )


def injectable(entries: DataFrame) -> DataFrame:
    """Document terms that may enter a prompt."""
    policy, status = F.lower(strip("pre_judge_inject_policy")), F.lower(strip("status"))
    raw = F.lower(strip("memory_kind")) == "raw_evidence_candidate"
    explained = (strip("meaning") != "") | (strip("full_form") != "") | (strip("document_local_role") != "")
    return entries.where(
        ~policy.isin(K.BLOCKED_POLICIES)
        & ((text("preferred_target") != "") | (~status.isin("blocked", "drop_candidate") & ~(raw & ~explained)))
    )


def compact_code(c) -> Column:
    """Short, without blanks, with letters but none in lower case."""
    t = strip(c)
    return (
        (F.length(t) <= 16) & ~t.rlike(r"(?U)\s") & t.rlike(r"\p{L}") & ~t.rlike(r"\p{IsLowercase}")
    )


def preferred_scope(term, preferred, sources) -> Column:
    s, p = strip(term), strip(preferred)
    key = document_key(s)
    spelled = F.exists(
        col(sources),
        lambda a: (strip(a) != "") & (document_key(a) != key) & ~compact_code(a),
    )
    hit = (s != "") & (p != "") & (key == document_key(p)) & compact_code(s) & spelled
    return F.when(hit, "exact_source_term_only").otherwise("")


def preferred_application(term, preferred, sources) -> Column:
    """How strictly the preferred target applies."""
    s, p = strip(term), strip(preferred)
    scope = preferred_scope(term, preferred, sources)
    inflects = s.rlike(r"(?iU)(?:\b\w+(?:ed|ing|er|est|s)\b|\s+)") | p.rlike("(?:하다|되다|시키다|받다|주다|보다|있다|없다)$")
    return (
        F.when(scope != "", scope)
        .when((s == "") | (p == ""), "")
        .when(compact_code(s), "exact")
        .when(s.rlike(r"(?U)^[A-Z][A-Za-z0-9'_-]*(?:\s+[A-Z][A-Za-z0-9'_-]*)*\z"), "exact")
        .when(s.rlike(r"\p{IsLowercase}") & inflects, "contextual_meaning")
        .otherwise("exact")
    )


def entry_matches(texts: DataFrame, entries: DataFrame, text_key: list[str], body: str) -> DataFrame:
    """Distinct (text, entry) pairs by any source form of the entry."""
    forms = entries.select(
        "doc_id", "term_id", F.explode(F.array_union(F.array("source_term"), "source_terms")).alias("form")
    ).withColumn("form", document_key("form")).distinct()
    hits = match_forms(texts, forms, text_key, ["doc_id"], body, mode=KEY_WORDS)
    return hits.select(*text_key, "term_id").distinct()


def relevant_document_terms(
    units: DataFrame, entries: DataFrame, k: int = K.MAX_RELEVANT_DOCUMENT_TERMS
) -> DataFrame:
    """Top-k document terms per unit.

    Order: found in the unit itself before its context, has a preferred target,
    status rank, longest source form, entry order. Entries with the same source
    are one row: the place of the first, the content of the best.
    """
    from .document_terms import prompt_rank, prompt_view

    usable = injectable(entries)
    key = ["doc_id", "unit_id"]
    # What stands in the text stands in text and context, too; without context the text is read once.
    alone, around = F.struct(F.lit(2).alias("_level"), text("text").alias("_t")), F.struct(
        F.lit(1).alias("_level"), F.concat_ws("\n", text("text"), text("context_text")).alias("_t")
    )
    looked = units.select(*key, F.explode(F.when(strip("context_text") == "", F.array(alone)).otherwise(F.array(alone, around))).alias("_l"))
    hits = entry_matches(looked.select(*key, "_l.*"), usable, [*key, "_level"], "_t")
    near = hits.groupBy(*key, "term_id").agg(F.max("_level").alias("match_level"))
    longest = F.array_max(F.transform(F.array_union(F.array("source_term"), "source_terms"), lambda s: F.length(s)))
    scored = usable.withColumn(
        "_score",
        F.struct(
            F.when(text("preferred_target") != "", 1).otherwise(0).alias("pref"),
            rank_of(F.lower(strip("status")), K.MATCH_STATUS_RANK, 10).alias("status"),
            longest.alias("longest"), (-F.col("entry_order")).alias("place"),
        ),
    )
    shown = prompt_view(scored).select(
        "doc_id", "term_id", "source_term", "status", F.col("shown_target").alias("preferred_target"), "_score",
        prompt_rank("source_term", "shown_target", "status", "memory_kind").alias("_prompt"),
        document_key("source_term").alias("_key"),
    )
    rows = near.join(shown, ["doc_id", "term_id"])
    place = F.struct("match_level", "_score")
    merged = rows.groupBy(*key, "_key").agg(
        F.max(place).alias("_place"),
        F.max_by(
            F.struct("term_id", "source_term", "status", "preferred_target", "match_level"), F.struct(F.col("_prompt"), place)
        ).alias("_e"),
    )
    return top_k(merged, key, [F.col("_place").desc()], k).select(*key, "rank", "_e.*")


def clean_kind(c, fallback: str = "term") -> Column:
    raw = strip(c)
    return (
        F.when(raw.isin("term_memory_seed", "initial_term_candidate"), "term")
        .when(raw == "source_meaning", "source_note")
        .when(raw != "", raw)
        .otherwise(fallback)
    )


def filter_analysis(entries: DataFrame, texts: DataFrame, k: int = K.MAX_RELEVANT_DOCUMENT_TERMS) -> DataFrame:
    """Analysis entries that occur in the lookup texts of their document, the first k in order."""
    hits = entry_matches(texts, entries, ["doc_id", "unit_id"], "text").select("doc_id", "term_id").distinct()
    kept = entries.join(hits, ["doc_id", "term_id"], "left_semi")
    return top_k(kept, ["doc_id"], [F.col("entry_order")], k)


def source_backed(entries: DataFrame, source_terms: DataFrame, texts: DataFrame) -> DataFrame:
    """Entries backed by a known source term or by the source text.

    The source field becomes the first backed form and only backed forms stay.
    """
    forms = entries.select(
        "doc_id", "term_id", F.posexplode(F.array_distinct(F.concat(F.array("source_term"), "source_terms"))).alias("_i", "form")
    ).withColumn("key", document_key("form"))
    known = source_terms.select("doc_id", document_key("source_term").alias("key")).distinct()
    by_term = forms.join(known, ["doc_id", "key"], "left_semi")
    in_text = match_forms(
        texts, forms.select("doc_id", F.col("key").alias("form")).distinct(), ["doc_id", "unit_id"], ["doc_id"],
        mode=KEY_INSIDE,
    ).select("doc_id", F.col("form").alias("key")).distinct()
    by_text = forms.join(in_text, ["doc_id", "key"], "left_semi")
    backed = by_term.unionByName(by_text).distinct().groupBy("doc_id", "term_id").agg(
        F.array_sort(F.collect_list(F.struct("_i", "form"))).alias("_b")
    )
    return entries.join(backed, ["doc_id", "term_id"]).withColumn(
        "source_term", F.get("_b.form", F.lit(0))
    ).withColumn("source_terms", F.col("_b.form")).drop("_b")


def injection_log(matches: DataFrame, entries: DataFrame, scope: str = "context_scope") -> DataFrame:
    """Which term went to which unit, with which target and how strongly.

    ``matches`` is :func:`first_form` with the scope of the unit.
    """
    target = strip("preferred_target")
    pool = F.array_distinct(
        F.filter(F.transform("candidate_targets", lambda t: strip(t)), lambda t: t != "")
    )
    rows = matches.join(entries, ["doc_id", "term_id"])
    out = rows.select(
        "doc_id", "unit_id", F.col(scope).alias("scope"), F.col("matched_source").alias("source_term"),
        F.nullif(target, F.lit("")).alias("injected_target"), pool.alias("candidate_targets"),
        F.when(target != "", "preferred")
        .when(text("suggested_target") != "", "suggested")
        .when(F.size(pool) > 0, "candidate_pool")
        .otherwise("source_context").alias("injection_strength"),
        "status", "memory_kind", "needs_review", "target_decision_needed", "term_id", "entry_order",
    ).withColumn("injected_target", F.coalesce("injected_target", F.when(F.col("injection_strength") == "suggested", F.lit(None).cast("string"))))
    marker = [document_key("source_term").alias("_s"), document_key("injected_target").alias("_t")]
    keyed = out.select("*", *marker)
    return keyed.groupBy("doc_id", "unit_id", "scope", "_s", "_t").agg(
        F.min_by(F.struct(*[c for c in out.columns if c not in ("doc_id", "unit_id", "scope")]), "entry_order").alias("_r")
    ).select("doc_id", "unit_id", "scope", "_r.*")


def term_violations(pairs: DataFrame, entries: DataFrame, pair_key: list[str]) -> DataFrame:
    """Source has a strict term but the translation lacks its preferred target."""
    policy = F.lower(strip("pre_judge_inject_policy"))
    strict = entries.where(
        (F.lower(strip("memory_kind")) != "raw_evidence_candidate")
        & (strip("preferred_target") != "")
        & (preferred_application("source_term", "preferred_target", "source_terms") != "contextual_meaning")
        & ~policy.isin("source_meaning_only", "blocked", "drop", "drop_candidate", "unresolved")
    )
    hits = first_form(pairs, strict, pair_key, "original")
    rows = hits.join(strict.select("doc_id", "term_id", "preferred_target", "status", "memory_kind"), ["doc_id", "term_id"])
    rows = rows.join(pairs.select(*pair_key, "translated"), pair_key)
    lacks = ~F.contains(document_key("translated"), document_key("preferred_target"))
    return rows.where(lacks).drop("translated")
