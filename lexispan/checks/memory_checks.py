"""Checks of matching, term memory, document terms and quality."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import quality as Q
from ..functions import terms as T
from ..functions import text as X
from ..functions import fixed as K
from ..operators import actions as A
from ..operators import document_terms as D
from ..operators import matching as M
from ..operators import quality_report as QR
from ..operators import term_memory as TM
from ..plans import pipelines as P
from . import corpus as C
from . import sqltext as S
from .mining_checks import mined
from .registry import check

G = S.with_(S.GLOSSARY)
# Both forms of a term have the same length and match alike, so the greater text wins.
MATCHES = f"""
forms AS (SELECT doc_id, term_id, source_term, unnest(list_distinct([source_term] || aliases)) AS form FROM terms),
hits AS (SELECT n.doc_id, n.node_id AS unit_id, term_id, max(form) AS matched_source
  FROM nodes n JOIN forms f ON f.doc_id = n.doc_id AND {S.edge_contains('n.text', 'f.form')} GROUP BY ALL)
"""


def node_units(spark, sf):
    n = C.nodes(spark, sf)
    return n.withColumn("unit_id", F.col("node_id")).withColumn("chunk_id", F.concat_ws(":", F.lit("n"), F.col("node_id").cast("string"))).withColumn(
        "context_text", F.lit("")
    ).withColumn("context_scope", F.lit("docx:body"))


@check("term_matches", S.with_(S.GLOSSARY, MATCHES) + " SELECT doc_id, unit_id, term_id, matched_source FROM hits")
def _(spark, sf):
    return M.match_terms(node_units(spark, sf), C.glossary(spark, sf), ["doc_id", "unit_id"], ["doc_id"])


@check("term_occurrence_counts", S.with_(S.GLOSSARY, MATCHES) + f"""
SELECT h.doc_id, h.unit_id, h.term_id, CAST({S.edge_count('n.text', 't.source_term')} AS BIGINT) AS uses
FROM hits h JOIN nodes n ON n.doc_id = h.doc_id AND n.node_id = h.unit_id JOIN terms t ON t.doc_id = h.doc_id AND t.term_id = h.term_id""")
def _(spark, sf):
    units, terms = node_units(spark, sf), C.glossary(spark, sf)
    hits = M.match_terms(units, terms, ["doc_id", "unit_id"], ["doc_id"])
    rows = hits.join(units.select("doc_id", "unit_id", "text"), ["doc_id", "unit_id"]).join(
        terms.select("doc_id", "term_id", "source_term"), ["doc_id", "term_id"]
    )
    return rows.select("doc_id", "unit_id", "term_id", X.count_term("text", "source_term").cast("bigint").alias("uses"))


@check("eligible_terms", G + " SELECT doc_id, term_id, bucket, target_term FROM terms WHERE bucket IN ('locked', 'soft_locked')")
def _(spark, sf):
    return M.eligible_terms(C.glossary(spark, sf)).select("doc_id", "term_id", "bucket", "target_term")


@check("relevant_terms", S.with_(S.GLOSSARY, MATCHES) + """
, r AS (SELECT h.doc_id, unit_id, h.term_id, matched_source, row_number() OVER (PARTITION BY h.doc_id, unit_id ORDER BY
    CASE bucket WHEN 'locked' THEN 0 ELSE 1 END, match_priority DESC, source_term) AS rank
  FROM hits h JOIN terms t USING (doc_id, term_id) WHERE bucket IN ('locked', 'soft_locked'))
SELECT doc_id, unit_id, term_id, matched_source, rank FROM r WHERE rank <= 18""")
def _(spark, sf):
    best = M.relevant_terms(node_units(spark, sf), C.glossary(spark, sf), ["doc_id", "unit_id"], ["doc_id"])
    return best.select("doc_id", "unit_id", "term_id", "matched_source", F.col("rank").cast("bigint").alias("rank"))


@check("applied_terms", S.with_(S.GLOSSARY, MATCHES) + """
SELECT h.doc_id, h.term_id, count(*) AS prompt_use_count, 'n:' || max(unit_id) AS last_applied_chunk_id FROM hits h
JOIN terms t USING (doc_id, term_id) WHERE bucket <> 'pending' GROUP BY h.doc_id, h.term_id""")
def _(spark, sf):
    units = node_units(spark, sf)
    terms = C.glossary(spark, sf).where("bucket <> 'pending'")
    hits = M.match_terms(units, terms, ["doc_id", "unit_id"], ["doc_id"])
    used = hits.withColumn("chunk_id", F.concat_ws(":", F.lit("n"), F.col("unit_id").cast("string"))).withColumn(
        "applied_at", F.timestamp_seconds("unit_id")
    )
    return M.applied_terms(used).select("doc_id", "term_id", "prompt_use_count", "last_applied_chunk_id")


@check("found_entries", G + """
, k AS (SELECT DISTINCT doc_id, unnest([lower(source_term), 'no ' || lower(source_term)]) AS key FROM terms)
SELECT k.doc_id, key, term_id, bucket FROM k JOIN terms t ON t.doc_id = k.doc_id AND lower(t.source_term) = k.key""")
def _(spark, sf):
    terms = C.glossary(spark, sf)
    low = F.lower("source_term")
    keys = terms.select("doc_id", F.explode(F.array(low, F.concat(F.lit("no "), low))).alias("key"))
    return M.find_entries(keys, terms, ["doc_id"])


@check("document_entry_lookup", G + """
SELECT doc_id, key, term_id FROM (SELECT doc_id, term_id, lower(source_term) AS key FROM entries
  UNION ALL SELECT doc_id, term_id, 'the ' || lower(source_term) FROM entries)""")
def _(spark, sf):
    entries = C.entries(spark, sf)
    keys = entries.select("doc_id", F.explode("normalized_sources").alias("key"))
    return M.find_document_entries(keys, entries)


@check("injectable_entries", G + " SELECT doc_id, term_id FROM entries WHERE frequency >= 3")
def _(spark, sf):
    return M.injectable(C.entries(spark, sf)).select("doc_id", "term_id")


@check("preferred_application", G + """
SELECT doc_id, term_id, CASE WHEN preferred_target IS NULL THEN '' ELSE 'exact' END AS as_is,
  CASE WHEN preferred_target IS NULL THEN '' WHEN length(source_term) <= 16 THEN 'exact_source_term_only'
       ELSE 'exact' END AS as_code,
  CASE WHEN preferred_target IS NULL THEN '' WHEN regexp_matches('the ' || lower(source_term), '\\s') THEN 'contextual_meaning' ELSE 'exact' END AS as_phrase
FROM entries""")
def _(spark, sf):
    e = C.entries(spark, sf)
    code, phrase = F.upper("source_term"), F.concat(F.lit("the "), F.lower("source_term"))
    target = F.col("preferred_target")
    return e.select(
        "doc_id", "term_id", M.preferred_application("source_term", target, "source_terms").alias("as_is"),
        M.preferred_application(code, target, "source_terms").alias("as_code"),
        M.preferred_application(phrase, target, F.array(phrase)).alias("as_phrase"),
    )


INSIDE = f"""
inside AS (SELECT n.doc_id, n.node_id AS unit_id, e.term_id FROM nodes n JOIN entries e ON e.doc_id = n.doc_id
  AND regexp_matches({S.dkey('n.text')}, '(?:^|[^a-z0-9])' || lower(e.source_term) || '(?:$|[^a-z0-9])') AND contains(lower(n.text), lower(e.source_term)))
"""


@check("relevant_document_terms", S.with_(S.GLOSSARY, INSIDE) + """
, r AS (SELECT i.doc_id, unit_id, term_id, row_number() OVER (PARTITION BY i.doc_id, unit_id ORDER BY
    CASE WHEN preferred_target IS NULL THEN 0 ELSE 1 END DESC, CASE status WHEN 'preferred' THEN 90 WHEN 'review_required' THEN 55 ELSE 20 END DESC,
    length(source_term) DESC, entry_order) AS rank, CASE WHEN frequency >= 4 THEN preferred_target ELSE '' END AS preferred_target
  FROM inside i JOIN entries USING (doc_id, term_id) WHERE frequency >= 3)
SELECT doc_id, unit_id, term_id, rank, preferred_target FROM r WHERE rank <= 12""")
def _(spark, sf):
    best = M.relevant_document_terms(node_units(spark, sf), C.entries(spark, sf))
    return best.select("doc_id", "unit_id", "term_id", F.col("rank").cast("bigint").alias("rank"), "preferred_target")


@check("filtered_analysis", S.with_(S.GLOSSARY, INSIDE) + """
, h AS (SELECT DISTINCT doc_id, term_id FROM inside), r AS (SELECT doc_id, term_id, row_number() OVER (PARTITION BY doc_id ORDER BY entry_order) AS rank
  FROM entries JOIN h USING (doc_id, term_id)) SELECT doc_id, term_id, rank FROM r WHERE rank <= 12""")
def _(spark, sf):
    kept = M.filter_analysis(C.entries(spark, sf), node_units(spark, sf))
    return kept.select("doc_id", "term_id", F.col("rank").cast("bigint").alias("rank"))


@check("source_backed_entries", G + """
, backed AS (SELECT DISTINCT e.doc_id, e.term_id FROM entries e JOIN nodes n ON n.doc_id = e.doc_id AND contains(lower(n.text), 'the ' || lower(source_term)))
SELECT e.doc_id, e.term_id, e.source_term, CASE WHEN b.term_id IS NULL THEN 1 ELSE 2 END AS forms FROM entries e
LEFT JOIN backed b ON b.doc_id = e.doc_id AND b.term_id = e.term_id""")
def _(spark, sf):
    kept = M.source_backed(C.entries(spark, sf), C.glossary(spark, sf), node_units(spark, sf))
    return kept.select("doc_id", "term_id", "source_term", F.size("source_terms").alias("forms"))


SUB = """
subs AS (SELECT n.doc_id, n.node_id AS unit_id, n.text, e.term_id, e.source_term, e.entry_order, e.frequency, e.preferred_target
  FROM nodes n JOIN entries e ON e.doc_id = n.doc_id AND contains(lower(n.text), lower(e.source_term)))
"""


@check("injection_log", S.with_(S.GLOSSARY, SUB) + """
SELECT doc_id, unit_id, 'docx:body' AS scope, source_term, CASE WHEN frequency >= 4 THEN preferred_target END AS injected_target,
  CASE WHEN frequency >= 4 THEN 'preferred' WHEN frequency = 3 THEN 'candidate_pool' ELSE 'source_context' END AS injection_strength FROM subs""")
def _(spark, sf):
    return injections(spark, sf).select("doc_id", "unit_id", "scope", "source_term", "injected_target", "injection_strength")


def injections(spark, sf):
    def build():
        units = node_units(spark, sf)
        shown = D.prompt_view(C.entries(spark, sf))
        shown = shown.withColumn("preferred_target", F.col("shown_target")).withColumn("suggested_target", F.lit(""))
        hits = M.first_form(units, shown, ["doc_id", "unit_id"]).withColumn("context_scope", F.lit("docx:body"))
        return M.injection_log(hits, shown)

    return C.kept(spark, sf, "injections", build)




def translated(spark, sf):
    """A stand-in translation that keeps some terms and loses others."""
    t = F.col("text")
    changed = F.when(F.length(t) > 200, F.replace(t, F.lit("a"), F.lit("A"))).otherwise(F.lower(t))
    return node_units(spark, sf).withColumn("translated", changed)


@check("strict_term_violations", S.with_(S.GLOSSARY, SUB) + """
SELECT doc_id, unit_id, term_id, source_term AS matched_source, preferred_target FROM subs WHERE frequency >= 3
  AND NOT contains(lower(CASE WHEN length(text) > 200 THEN 'xx' ELSE text END), lower(preferred_target))""")
def _(spark, sf):
    pairs = node_units(spark, sf).select(
        "doc_id", "unit_id", F.col("text").alias("original"), half_translated().alias("translated")
    )
    found = M.term_violations(pairs, C.entries(spark, sf), ["doc_id", "unit_id"])
    return found.select("doc_id", "unit_id", "term_id", "matched_source", "preferred_target")


# --- observation ------------------------------------------------------------


def _observed(spark, sf):
    def build():
        units = node_units(spark, sf)
        parts = units.select(
            "doc_id", F.explode(F.split("text", r"(?<=[.!?])\s+")).alias("text"), "node_id"
        ).where("text rlike '^[A-Z][a-z]{3,}[.!?]$'").select("doc_id", "node_id", "text").distinct()
        rows = parts.withColumn("unit_id", F.col("node_id")).withColumn("chunk_id", F.concat_ws(":", F.lit("n"), F.col("node_id").cast("string")))
        rows = rows.withColumn("text", F.regexp_replace("text", "[.!?]$", ""))
        # One single-word sentence per line, the first by text.
        rows = rows.groupBy("doc_id", "unit_id", "chunk_id").agg(F.min("text").alias("text"))
        done = rows.select("doc_id", "unit_id", F.concat(F.lit("mo "), F.lower("text")).alias("translated"))
        return TM.observe(rows, done, C.glossary(spark, sf), "de")

    return C.kept(spark, sf, "observed", build)


OBS = """
singles AS (SELECT doc_id, node_id, regexp_replace(s, '[.!?]$', '') AS text FROM (
   SELECT doc_id, node_id, unnest(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(3), 'g'), chr(3))) AS s FROM nodes)
  WHERE regexp_full_match(s, '[A-Z][a-z]{3,}[.!?]')),
obs_units AS (SELECT doc_id, node_id AS unit_id, min(text) AS text FROM singles GROUP BY ALL),
observed AS (SELECT u.doc_id, term_id, unit_id, 'n:' || unit_id AS chunk_id, upper(u.text) AS up, u.text, 'mo ' || lower(u.text) AS target
  FROM obs_units u JOIN terms t ON t.doc_id = u.doc_id AND lower(t.source_term) = lower(u.text) AND bucket IN ('pending', 'soft_locked'))
"""


@check("observed_targets", S.with_(S.GLOSSARY, OBS) + """
SELECT doc_id, term_id, unit_id, CAST(NULL AS VARCHAR) AS target_candidate, 'no_target_candidate' AS storage_skip_reason,
  'x' AS reason FROM observed WHERE false UNION ALL
SELECT doc_id, term_id, unit_id, CASE WHEN bad THEN NULL ELSE target END, CASE WHEN bad THEN 'no_target_candidate' ELSE '' END, '' FROM (
  SELECT *, contains(target, ' ' || lower(text)) AS bad FROM observed)""")
def _(spark, sf):
    return _observed(spark, sf).select(
        "doc_id", "term_id", "unit_id", "target_candidate", "storage_skip_reason", F.coalesce("review_reason", F.lit("")).alias("reason")
    )


CONV = """
turns AS (SELECT conv_id AS doc_id, turn AS unit_id, role, array_to_string(regexp_extract_all(text, '^[A-Za-z]+'), '') AS target,
  'c:' || turn AS chunk_id FROM conversations),
seen AS (SELECT doc_id, 't_' || role AS term_id, unit_id, chunk_id, target FROM turns WHERE target <> ''),
counts AS (SELECT doc_id, term_id, target, count(*) AS count, count(DISTINCT chunk_id) AS chunk_count, min(unit_id) AS first_seen FROM seen GROUP BY ALL)
"""


def _turn_targets(spark, sf):
    turns = C.read_table(spark, sf, "conversations")
    return turns.select(
        F.col("conv_id").alias("doc_id"), F.concat(F.lit("t_"), "role").alias("term_id"), F.col("turn").alias("unit_id"),
        F.concat(F.lit("c:"), F.col("turn").cast("string")).alias("chunk_id"), F.col("text").alias("translated"),
        F.regexp_extract("text", "^([A-Za-z]+)", 1).alias("target_candidate"), F.lit("").alias("storage_skip_reason"),
    )


@check("target_counts", S.with_(CONV) + " SELECT * FROM counts")
def _(spark, sf):
    return TM.target_counts(_turn_targets(spark, sf))


@check("target_chunks", S.with_(CONV) + " SELECT DISTINCT doc_id, term_id, target, chunk_id FROM seen")
def _(spark, sf):
    return TM.target_chunks(_turn_targets(spark, sf))


@check("deduplicated_observations", S.with_(CONV) + """ SELECT doc_id, 't_' || role AS term_id, count(DISTINCT unit_id) AS n FROM turns GROUP BY ALL""")
def _(spark, sf):
    twice = _turn_targets(spark, sf).unionByName(_turn_targets(spark, sf))
    return TM.dedupe_observations(twice).groupBy("doc_id", "term_id").agg(F.count(F.lit(1)).alias("n"))


DISP = """
tot AS (SELECT doc_id, term_id, CAST(sum(count) AS BIGINT) AS total, count(*) AS target_kinds, arg_max(target, count * 1000000 - first_seen) AS top_target,
   max(count) AS top_count FROM counts GROUP BY ALL),
disp AS (SELECT t.*, top_count / total AS top_share, (SELECT -sum((c.count / t.total) * ln(c.count / t.total)) FROM counts c
   WHERE c.doc_id = t.doc_id AND c.term_id = t.term_id) AS entropy FROM tot t)
"""


@check("target_dispersion", S.with_(CONV, DISP) + """
SELECT doc_id, term_id, total, target_kinds, top_target, top_count, round(top_share, 6) AS top_share, round(abs(entropy), 6) AS entropy FROM disp""")
def _(spark, sf):
    d = TM.target_dispersion(TM.target_counts(_turn_targets(spark, sf)))
    return d.withColumn("top_share", F.round("top_share", 6)).withColumn("entropy", F.round(F.abs("entropy"), 6))


@check("promotion_decisions", S.with_(CONV.replace("array_to_string(regexp_extract_all(text, '^[A-Za-z]+'), '') AS target", "CASE WHEN length(text) > 250 THEN 'Lang' ELSE 'Kurz' END AS target"), DISP) + """
SELECT doc_id, term_id, CASE WHEN top_count < 2 THEN 'keep' WHEN top_share < 0.6 THEN 'review' ELSE 'promote' END AS decision,
  CASE WHEN top_count >= 2 AND top_share < 0.6 THEN 'target_conflict' END AS reason,
  CASE WHEN top_count >= 2 AND top_share >= 0.6 THEN top_target END AS target_term,
  CASE WHEN top_count >= 2 AND top_share >= 0.6 THEN round_even(greatest(0.5, least(0.85, 0.65 + top_count * 0.08))::DOUBLE, 4) ELSE 0.5 END AS confidence
FROM disp""")
def _(spark, sf):
    seen = _turn_targets(spark, sf).withColumn(
        "target_candidate", F.when(F.length("translated") > 250, "Lang").otherwise("Kurz")
    )
    terms = seen.groupBy("doc_id", "term_id").agg(F.count(F.lit(1)).alias("frequency")).select(
        "doc_id", "term_id", F.lit("Turn").alias("source_term"), F.array().cast("array<string>").alias("aliases"),
        F.lit("pending").alias("bucket"), (F.col("frequency") + 1).alias("frequency"), F.lit(0.5).alias("candidate_score"),
        F.lit(0.5).alias("confidence"), F.lit("").alias("review_reason"),
    )
    return TM.promotion(terms, TM.target_dispersion(TM.target_counts(seen))).drop("source_term")


@check("demoted_terms", G + """
SELECT doc_id, term_id, CASE WHEN length(source_term) > 9 THEN 'bad_target_candidate_shape' ELSE 'target_contains_unrelated_acronym' END AS reason
FROM terms WHERE bucket = 'soft_locked' AND (length(source_term) > 9 OR length(source_term) < 6)""")
def _(spark, sf):
    n = F.length("source_term")
    target = (
        F.when(n > 9, F.repeat(F.lit("lang "), 12)).when(n < 6, F.concat("source_term", F.lit(" ABC"))).otherwise(F.col("target_term"))
    )
    terms = C.glossary(spark, sf).withColumn("target_term", F.when(n < 6, F.lit("Ding ABC")).otherwise(target))
    return TM.demotion(terms).select("doc_id", "term_id", "reason")


@check("target_collisions", G + """
, soft AS (SELECT doc_id, term_id, source_term, lower(left(source_term, 2)) AS target FROM terms WHERE bucket = 'soft_locked')
SELECT DISTINCT a.doc_id, a.term_id FROM soft a JOIN soft b ON a.doc_id = b.doc_id AND a.target = b.target AND a.term_id <> b.term_id""")
def _(spark, sf):
    terms = C.glossary(spark, sf).withColumn("target_term", F.lower(F.left("source_term", F.lit(2))))
    return TM.target_collisions(terms).select("doc_id", "term_id")


@check("merged_scan", G + """
, scan AS (SELECT doc_id, lower(source_term) AS k, source_term, frequency + 5 AS frequency FROM terms WHERE frequency >= 3)
SELECT t.doc_id, t.term_id, greatest(t.frequency, coalesce(s.frequency, 0)) AS frequency, bucket,
  CASE WHEN s.k IS NULL THEN upper(t.source_term) ELSE upper(t.source_term) || '|' || t.source_term || '+' END AS aliases
FROM terms t LEFT JOIN scan s ON s.doc_id = t.doc_id AND s.k = lower(t.source_term)""")
def _(spark, sf):
    none = F.array().cast("array<string>")
    memory = C.glossary(spark, sf).withColumns(
        {"candidate_types": none, "reason": none, "chunk_count": F.lit(1).cast("bigint"), "section_count": F.lit(1).cast("bigint")}
    )
    scan = memory.where("frequency >= 3").withColumn("frequency", F.col("frequency") + 5).withColumn(
        "aliases", F.array(F.concat("source_term", F.lit("+")))
    ).drop("bucket", "term_id", "term_order", "target_term", "review_reason")
    return TM.merge_scan(memory, scan).select(
        "doc_id", "term_id", "frequency", "bucket", F.array_join("aliases", "|").alias("aliases")
    )


@check("memory_summary", G + """
SELECT doc_id, count(*) FILTER (bucket = 'pending') AS pending, 0::BIGINT AS review, count(*) FILTER (bucket = 'soft_locked') AS soft_locked,
  count(*) FILTER (bucket = 'locked') AS locked FROM terms GROUP BY doc_id""")
def _(spark, sf):
    return TM.memory_summary(C.glossary(spark, sf))


# --- document terms ---------------------------------------------------------


@check("entry_status_counts", G + " SELECT doc_id, status, count(*) AS entries FROM entries GROUP BY ALL")
def _(spark, sf):
    return D.entry_status_counts(C.entries(spark, sf))


def base_entries(spark, sf):
    """Two-word entries: every glossary word with the word before it in alphabetical order."""
    return mined(spark, sf).where("token_count >= 2").select(
        "doc_id", F.concat(F.lit("m_"), "normalized_source").alias("term_id"), "source_term", F.col("aliases").alias("source_terms"),
        "term_order",
    )


@check("crowded_bases", G + """
, w AS (SELECT doc_id, lower(source_term) AS key, repeat(left(lower(source_term), 1), 3) AS base FROM terms)
SELECT doc_id, base, count(DISTINCT key) AS term_count FROM w GROUP BY ALL HAVING count(DISTINCT key) >= 4""")
def _(spark, sf):
    """Terms of a document share a base if they begin with one letter."""
    e = C.entries(spark, sf)
    low = F.lower("source_term")
    split = F.concat_ws(" ", F.repeat(F.left(low, F.lit(1)), F.lit(3)), low)
    return D.ambiguous_bases(e.withColumns({"source_term": split, "source_terms": F.array(split)})).select("doc_id", "base", "term_count")


@check("entries_to_review", G + """
, b AS (SELECT doc_id, 'the' AS base FROM entries GROUP BY doc_id HAVING count(*) >= 3)
SELECT e.doc_id, term_id FROM entries e WHERE frequency = 2 OR frequency = 3 OR confidence < 0.8""")
def _(spark, sf):
    return D.needs_review(C.entries(spark, sf), all_preferred=False).select("doc_id", "term_id")


@check("noise_and_codes", S.with_(S.NODES) + f"""
, w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM nodes)
SELECT w, (lower(w) IN ({", ".join("'" + x.replace("'", "''") + "'" for x in K.COMMON_SOURCE_WORDS)})
   OR w IN ({", ".join("'" + x + "'" for x in K.TITLECASE_GENERIC_NOISE)})) AS noise,
  (w = upper(w) AND length(w) BETWEEN 2 AND 8 AND (length(w) <= 5 OR NOT regexp_matches(w, '[AEIOU]'))
   AND lower(w) NOT IN ({", ".join("'" + x.replace("'", "''") + "'" for x in K.COMMON_SOURCE_WORDS)})) AS code FROM w""")
def _(spark, sf):
    ws = C.nodes(spark, sf).select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w")).distinct()
    return ws.select("w", D.raw_noise(F.lit("raw_evidence_candidate"), "w").alias("noise"), D.code_like_acronym("w").alias("code"))


@check("sanitized_entries", G + """
SELECT doc_id, term_id, CASE WHEN frequency <= 3 THEN 'analysis_hint' ELSE status END AS status,
  CASE WHEN frequency = 3 THEN NULL ELSE preferred_target END AS preferred_target,
  CASE WHEN frequency >= 4 THEN source_term || 'os' ELSE '' END AS avoid, CASE WHEN frequency = 3 THEN 'source_note' ELSE memory_kind END AS memory_kind
FROM entries""")
def _(spark, sf):
    e = C.entries(spark, sf).withColumn(
        "memory_kind", F.when(F.col("frequency") == 3, "source_meaning").otherwise(F.col("memory_kind"))
    )
    return D.sanitize_entries(e).select(
        "doc_id", "term_id", "status", "preferred_target", F.array_join("do_not_translate_as", "|").alias("avoid"), "memory_kind"
    )


@check("snapshot_problems", G + """
SELECT doc_id, term_id, 'preferred_target_in_avoid' AS reason FROM entries WHERE frequency >= 4
UNION ALL SELECT doc_id, term_id, unnest(['context_entry_has_preferred_target', 'context_entry_sense_has_preferred_target']) FROM entries WHERE frequency = 3""")
def _(spark, sf):
    e = C.entries(spark, sf).withColumn(
        "memory_kind", F.when(F.col("frequency") == 3, "source_meaning").otherwise(F.col("memory_kind"))
    )
    return D.validate_snapshot(e)


@check("sanitized_snapshot_problems", "SELECT 0::BIGINT AS doc_id, '' AS term_id, '' AS reason WHERE false")
def _(spark, sf):
    e = C.entries(spark, sf).withColumn(
        "memory_kind", F.when(F.col("frequency") == 3, "source_meaning").otherwise(F.col("memory_kind"))
    )
    return D.validate_snapshot(D.sanitize_entries(e))


@check("prompt_view", G + """
SELECT doc_id, term_id, CASE WHEN frequency >= 4 THEN preferred_target ELSE '' END AS shown_target,
  CASE WHEN frequency = 3 THEN upper(source_term) || '|' || source_term || 'us' ELSE '' END AS candidate_targets,
  CASE WHEN frequency >= 4 THEN source_term || 'os' ELSE '' END AS avoid, frequency = 3 AS needs_review FROM entries""")
def _(spark, sf):
    return D.prompt_view(C.entries(spark, sf)).select(
        "doc_id", "term_id", "shown_target", F.array_join("candidate_targets", "|").alias("candidate_targets"),
        F.array_join("do_not_translate_as", "|").alias("avoid"), "needs_review",
    )


@check("deduplicated_prompt_terms", G + """
, doubled AS (SELECT doc_id, left(lower(source_term), 4) AS key, term_id, entry_order, frequency,
   CASE WHEN frequency >= 4 THEN 1 ELSE 0 END AS p, CASE status WHEN 'preferred' THEN 90 WHEN 'review_required' THEN 60 ELSE 20 END AS s,
   CASE memory_kind WHEN 'term' THEN 60 WHEN 'raw_evidence_candidate' THEN 30 ELSE 25 END AS kr FROM entries)
SELECT doc_id, arg_max(term_id, p * 1000000000 + s * 1000000 + kr * 10000 - entry_order) AS term_id, min(entry_order) AS place FROM doubled GROUP BY doc_id, key""")
def _(spark, sf):
    view = D.prompt_view(C.entries(spark, sf))
    short = view.withColumn("source_term", F.left(F.lower("source_term"), F.lit(4)))
    return D.dedupe_prompt_terms(short).select("doc_id", "term_id", "place")


FAM = """
fams AS (SELECT doc_id, left(lower(source_term), 1) AS f, list(source_term ORDER BY entry_order) AS kids, min(entry_order) AS o FROM entries GROUP BY ALL HAVING count(*) >= 2)
"""


def family_entries(spark, sf):
    """The entries and one family per first letter that two or more of them share."""
    e = C.entries(spark, sf).drop("frequency")
    letter = F.left(F.lower("source_term"), F.lit(1))
    fams = e.groupBy("doc_id", letter.alias("_f")).agg(
        F.array_sort(F.collect_list(F.struct("entry_order", "source_term"))).alias("_k"), F.min("entry_order").alias("_o")
    ).where("size(_k) >= 2")
    kids = F.concat(F.transform("_k", lambda x: x["source_term"]), F.array(F.concat(F.lit("new "), F.col("_f"))))
    fields = {f.name: f.dataType for f in e.schema}
    given = {
        "doc_id": F.col("doc_id"), "term_id": F.concat(F.lit("f_"), "_f"), "entry_order": F.col("_o") + 1000000,
        "source_term": F.concat(F.lit("family "), "_f"), "source_terms": kids, "memory_kind": F.lit("term_family"),
        "status": F.lit("analysis_hint"), "meaning": F.concat(F.lit("words in "), "_f"),
    }
    empty = {n: F.array() for n, t in fields.items() if t.typeName() == "array"}
    rows = fams.select(*[given.get(n, empty.get(n, F.lit(None))).cast(t).alias(n) for n, t in fields.items()])
    return e.unionByName(rows)


@check("attached_families", S.with_(S.GLOSSARY, FAM) + """
SELECT e.doc_id, e.term_id, coalesce('f_' || f.f, '') AS families, coalesce(array_to_string(list_filter(f.kids || ['new ' || f.f], lambda x: lower(x) <> lower(e.source_term)), '|'), '') AS siblings
FROM entries e LEFT JOIN fams f ON f.doc_id = e.doc_id AND f.f = left(lower(e.source_term), 1)
UNION ALL SELECT doc_id, 'new', 'f_' || f, array_to_string(kids, '|') FROM fams
UNION ALL SELECT doc_id, 'f_' || f, '', '' FROM fams""")
def _(spark, sf):
    out = D.attach_families(family_entries(spark, sf))
    return out.select(
        "doc_id", F.when(F.startswith("source_term", F.lit("new ")), "new").otherwise(F.col("term_id")).alias("term_id"),
        F.array_join("family_ids", "|").alias("families"), F.array_join("do_not_confuse_with_source_terms", "|").alias("siblings"),
    )


@check("sibling_targets_removed", S.with_(S.GLOSSARY, FAM) + """
, sib AS (SELECT f.doc_id, f.f, e.term_id, lower(e.preferred_target) AS t FROM fams f JOIN entries e ON e.doc_id = f.doc_id AND left(lower(e.source_term), 1) = f.f
  WHERE e.preferred_target IS NOT NULL),
 avoid AS (SELECT doc_id, term_id, left(lower(source_term), 1) AS f, unnest([upper(source_term), source_term || 'os']) AS a FROM entries WHERE frequency >= 4)
SELECT e.doc_id, e.term_id, coalesce(string_agg(a.a, '|' ORDER BY CASE WHEN ends_with(a.a, 'os') THEN 1 ELSE 0 END), '') AS avoid FROM entries e
LEFT JOIN (SELECT * FROM avoid a WHERE NOT EXISTS (SELECT 1 FROM sib s WHERE s.doc_id = a.doc_id AND s.f = a.f AND s.term_id <> a.term_id AND s.t = lower(a.a))) a
  ON a.doc_id = e.doc_id AND a.term_id = e.term_id GROUP BY ALL""")
def _(spark, sf):
    from ..session import materialize

    out = D.remove_sibling_targets(materialize(D.attach_families(family_entries(spark, sf))))
    return out.where("term_id like 'e\\_%'").select("doc_id", "term_id", F.array_join("do_not_translate_as", "|").alias("avoid"))


def seeds(spark, sf):
    e = C.entries(spark, sf)
    base = e.select("doc_id", F.col("entry_order").alias("seed_order"), "source_term", "source_terms", "confidence", "frequency", "preferred_target")
    return {
        "term_memory_seed": base.where("frequency >= 4"),
        "initial_term_candidate": base.where("frequency >= 3"),
        "source_meaning": base.where("frequency = 3").drop("preferred_target"),
        "acronym": base.where("frequency = 2"),
    }


SEEDS = """
seeds AS (SELECT doc_id, source_term, entry_order, frequency, preferred_target, 0 AS r, 'term' AS kind FROM entries WHERE frequency >= 4
  UNION ALL SELECT doc_id, source_term, entry_order, frequency, preferred_target, 2, 'term' FROM entries WHERE frequency >= 3
  UNION ALL SELECT doc_id, source_term, entry_order, frequency, NULL, 3, 'source_note' FROM entries WHERE frequency = 3
  UNION ALL SELECT doc_id, source_term, entry_order, frequency, preferred_target, 5, 'acronym' FROM entries WHERE frequency = 2)
"""


@check("united_seeds", S.with_(S.GLOSSARY, SEEDS) + " SELECT doc_id, source_term, r AS source_rank, kind FROM seeds")
def _(spark, sf):
    from ..operators.matching import clean_kind

    return D.union_seeds(seeds(spark, sf)).select("doc_id", "source_term", "source_rank", clean_kind("seed_source").alias("kind"))


@check("seeded_entries", S.with_(S.GLOSSARY, SEEDS) + """
, firsts AS (SELECT doc_id, kind = 'source_note' AS ctx, lower(source_term) AS k, arg_min(struct_pack(source_term, kind, preferred_target, r, entry_order), r * 1000000 + entry_order) AS x
  FROM seeds GROUP BY ALL),
 crowded AS (SELECT doc_id, 'the' AS base FROM entries GROUP BY doc_id HAVING count(DISTINCT lower(source_term)) >= 4)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY x.r, x.entry_order) AS entry_order, x.source_term AS source_term, x.kind AS memory_kind,
  CASE WHEN x.preferred_target IS NULL THEN 'analysis_hint' ELSE 'initial_seed' END AS status,
  x.preferred_target IS NULL AS target_decision_needed FROM firsts""")
def _(spark, sf):
    return D.seed_entries(D.union_seeds(seeds(spark, sf))).select(
        "doc_id", "entry_order", "source_term", "memory_kind", "status", "target_decision_needed"
    )


@check("merged_lists", S.with_(S.GLOSSARY) + """
, l AS (SELECT doc_id, list(source_term ORDER BY entry_order) AS a, list(lower(source_term) ORDER BY entry_order) AS b FROM entries GROUP BY doc_id)
SELECT doc_id, array_to_string((a || b)[1:12], '|') AS merged FROM l""")
def _(spark, sf):
    e = C.entries(spark, sf)
    rows = e.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("entry_order", "source_term"))).alias("_l"))
    a = F.transform("_l", lambda x: x["source_term"])
    b = F.transform("_l", lambda x: F.lower(x["source_term"]))
    return rows.select("doc_id", F.array_join(X.merge_lists(a, b, 12), "|").alias("merged"))


@check("unrelated_acronyms", S.with_(S.NODES) + f"""
, a AS (SELECT doc_id, node_id, list_distinct(list_filter({"regexp_extract_all(regexp_replace(text, '[^" + chr(92) + "x00-" + chr(92) + "x7F]', 'z', 'g'), '" + chr(92) + "b[A-Z][A-Z0-9&/-]+" + chr(92) + "b')"}, lambda x: NOT {S.noise('x')})) AS l, section FROM nodes),
 h AS (SELECT doc_id, l AS h FROM a WHERE node_id = 0)
SELECT doc_id, node_id, CAST(len(list_filter(a.l, lambda x: NOT list_contains(h.h, x))) AS BIGINT) AS n FROM a JOIN h USING (doc_id)""")
def _(spark, sf):
    return C.nodes(spark, sf).select(
        "doc_id", "node_id", F.size(T.unrelated_acronyms("text", F.array("section"))).cast("bigint").alias("n")
    )


@check("entry_evidence", G + """
SELECT e.doc_id, e.term_id, t.term_id AS normalized_source FROM entries e JOIN terms t ON t.doc_id = e.doc_id AND lower(t.source_term) = lower(e.source_term)""")
def _(spark, sf):
    terms = C.glossary(spark, sf).withColumn("normalized_source", F.col("term_id"))
    return D.evidence_for(C.entries(spark, sf), terms)


@check("review_queue", G + """
, q AS (SELECT doc_id, term_id, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN needs_review THEN 0 ELSE 1 END,
   CASE WHEN preferred_target IS NULL THEN 1 ELSE 0 END, CASE memory_kind WHEN 'analysis_candidate' THEN 0 WHEN 'term' THEN 3 ELSE 4 END,
   lower(source_term), entry_order) - 1 AS queue_position FROM entries)
SELECT doc_id, term_id, queue_position, queue_position // 40 AS chunk FROM q""")
def _(spark, sf):
    return D.review_queue(C.entries(spark, sf)).select("doc_id", "term_id", "queue_position", "chunk")


CHAIN = """
chain AS (SELECT doc_id, term_id, entry_order, lower(source_term) AS a, left(lower(source_term), 4) AS b, right(lower(source_term), 4) AS c, frequency, preferred_target FROM entries),
keys AS (SELECT doc_id, term_id, entry_order, unnest([a, b, c]) AS k FROM chain)
"""


def chained(spark, sf, n=4):
    """Entries linked by equal word beginnings or ends of n letters."""
    low = F.lower("source_term")
    forms = F.array(low, F.left(low, F.lit(n)), F.right(low, F.lit(n)))
    return C.entries(spark, sf).withColumn("source_terms", forms)


@check("alias_families", "WITH RECURSIVE " + S.GLOSSARY.strip() + ",\n" + CHAIN.strip() + """,
edge AS (SELECT DISTINCT x.doc_id, x.entry_order AS p, y.entry_order AS q FROM keys x JOIN keys y ON x.doc_id = y.doc_id AND x.k = y.k),
reach AS (SELECT doc_id, entry_order AS p, entry_order AS q FROM entries UNION SELECT r.doc_id, r.p, e.q FROM reach r JOIN edge e ON e.doc_id = r.doc_id AND e.p = r.q)
SELECT r.doc_id, a.term_id, b.term_id AS component FROM (SELECT doc_id, p, min(q) AS m FROM reach GROUP BY ALL) r
JOIN entries a ON a.doc_id = r.doc_id AND a.entry_order = r.p JOIN entries b ON b.doc_id = r.doc_id AND b.entry_order = r.m""")
def _(spark, sf):
    return D.family_components(chained(spark, sf))


@check("merged_families")
def _(spark, sf):
    return D.merge_families(chained(spark, sf))


@check("family_targets", S.with_(S.GLOSSARY, CHAIN.replace(", 4)", ", 2)")) + """
, m AS (SELECT k.*, CASE e.memory_kind WHEN 'analysis_candidate' THEN 4 WHEN 'term' THEN 3 ELSE 1 END AS auth, e.preferred_target AS t FROM keys k JOIN entries e USING (doc_id, term_id))
SELECT a.doc_id, a.term_id, arg_min(b.t, b.entry_order) AS family_target FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.k = b.k AND b.auth > a.auth AND b.t IS NOT NULL GROUP BY ALL""")
def _(spark, sf):
    return D.family_target(chained(spark, sf, 2))


# --- actions ----------------------------------------------------------------


def actions(spark, sf):
    """One proposed action per entry; its kind follows from the entry."""
    n = F.col("frequency")
    kind = (
        F.when(n == 2, F.when(F.length("source_term") > 6, "drop_candidate").otherwise("no_update"))
        .when(n == 3, "mark_preferred").when(n == 4, "source_meaning_only").when(n == 5, "add_sense").otherwise("update_sense")
    )
    return C.entries(spark, sf).select(
        "doc_id", F.col("entry_order").alias("action_seq"), kind.alias("type"), F.lit("").alias("term_id"), "source_term",
        F.when(F.length("source_term") > 5, F.concat("source_term", F.lit("us"))).alias("target"), F.lit(None).cast("string").alias("preferred_target"),
        F.lit("").alias("target_relation"), F.lit("").alias("sense_id"), F.lit("").alias("status"), F.lit("").alias("superseded_by"),
        F.lit("seen").alias("reason"), F.array().cast("array<string>").alias("evidence_refs"), F.lit(False).alias("set_active"),
        F.lit("").alias("meaning"),
    )


ACT = """
acts AS (SELECT doc_id, entry_order AS action_seq, source_term, term_id, frequency, preferred_target, CASE WHEN frequency = 2 THEN CASE WHEN length(source_term) > 6 THEN 'drop_candidate' ELSE 'no_update' END
  WHEN frequency = 3 THEN 'mark_preferred' WHEN frequency = 4 THEN 'source_meaning_only' WHEN frequency = 5 THEN 'add_sense' ELSE 'update_sense' END AS type,
  CASE WHEN length(source_term) > 5 THEN source_term || 'us' END AS target FROM entries)
"""
REVIEWED = """
reviewed AS (SELECT *, CASE WHEN type = 'add_sense' THEN 'unsupported_action' WHEN type = 'no_update' AND preferred_target IS NULL THEN 'raw_candidate_no_update_not_allowed'
  WHEN type = 'mark_preferred' AND target IS NULL THEN 'target_required' ELSE '' END AS reject_reason FROM acts)
"""


@check("review_actions", S.with_(S.GLOSSARY, ACT, REVIEWED) + """
SELECT doc_id, action_seq, type, term_id AS entry_id, reject_reason, CASE WHEN type = 'mark_preferred' THEN 'same_meaning_variant' ELSE '' END AS target_relation,
  CASE WHEN type = 'mark_preferred' THEN 'preferred' ELSE '' END AS status FROM reviewed""")
def _(spark, sf):
    return A.sanitize_review_actions(actions(spark, sf), C.entries(spark, sf)).select(
        "doc_id", "action_seq", "type", "entry_id", "reject_reason", "target_relation", "status"
    )


@check("deduplicated_actions", S.with_(S.GLOSSARY, ACT, REVIEWED) + """
, twice AS (SELECT * FROM reviewed WHERE reject_reason = '' UNION ALL SELECT doc_id, action_seq + 100000, source_term, term_id, frequency, preferred_target, 'drop_candidate', target, '' FROM reviewed WHERE frequency = 3)
SELECT doc_id, term_id AS entry_id, type = 'update_sense' AS is_update, arg_min(type, CASE type WHEN 'drop_candidate' THEN 0 WHEN 'source_meaning_only' THEN 1 WHEN 'mark_preferred' THEN 2 WHEN 'no_update' THEN 3 ELSE 0 END * 1000000 + action_seq) AS type
FROM twice GROUP BY ALL""")
def _(spark, sf):
    first = actions(spark, sf)
    more = first.join(C.entries(spark, sf).where("frequency = 3").select("doc_id", "source_term"), ["doc_id", "source_term"], "left_semi")
    more = more.withColumn("type", F.lit("drop_candidate")).withColumn("action_seq", F.col("action_seq") + 100000)
    clean = A.sanitize_review_actions(first.unionByName(more.select(*first.columns)), C.entries(spark, sf))
    out = A.dedupe_actions(clean, C.entries(spark, sf))
    return out.select("doc_id", "entry_id", (F.col("type") == "update_sense").alias("is_update"), "type")


@check("resolver_actions", S.with_(S.GLOSSARY, ACT) + """
SELECT doc_id, action_seq, CASE WHEN type = 'no_update' THEN '' WHEN type = 'mark_preferred' THEN 'mark_preferred_disabled_preferred_finalized_by_pre_judge'
  WHEN frequency > 6 THEN 'source_term_not_in_current_scope' ELSE '' END AS reject_reason FROM acts""")
def _(spark, sf):
    e = C.entries(spark, sf)
    scope = e.where("frequency <= 6").select("doc_id", "source_term")
    risks = e.select("doc_id", "source_term", F.col("preferred_target").alias("target"))
    return A.sanitize_resolver_actions(actions(spark, sf), e, scope, risks).select("doc_id", "action_seq", "reject_reason")


@check("classified_observations", S.with_(S.GLOSSARY, SUB, "outs AS (SELECT *, CASE WHEN length(text) > 200 THEN 'xx' ELSE text END AS out FROM subs)") + """
SELECT doc_id, unit_id, source_term, CASE WHEN frequency >= 4 THEN CASE WHEN contains(lower(out), lower(source_term)) THEN 'echoed_injected_target' ELSE 'injected_target_not_observed' END
  WHEN frequency = 3 AND contains(lower(out), lower(source_term)) THEN 'echoed_candidate_pool_target' ELSE 'no_target_candidate' END AS observation_type FROM outs""")
def _(spark, sf):
    observed = node_units(spark, sf).select(
        "doc_id", "unit_id", F.col("text").alias("source_text"), half_translated().alias("translated")
    )
    return A.classify_observations(injections(spark, sf), observed).select("doc_id", "unit_id", "source_term", "observation_type")


def half_translated():
    """Short lines keep their terms, long ones lose them all."""
    return F.when(F.length("text") > 200, "xx").otherwise(F.col("text"))


@check("resolver_gates", S.with_(S.GLOSSARY, SUB, "outs AS (SELECT *, CASE WHEN length(text) > 200 THEN 'xx' ELSE text END AS out FROM subs)") + """
, sig AS (SELECT doc_id, count(*) AS observations, count(DISTINCT term_id) AS matched_entries,
   count(*) FILTER (frequency >= 4 AND NOT contains(lower(out), lower(source_term))) AS actionable FROM outs GROUP BY doc_id)
SELECT d.doc_id, coalesce(matched_entries, 0) AS matched_entries, CASE WHEN coalesce(matched_entries, 0) = 0 THEN 'no_source_term_in_scope'
  WHEN actionable > 0 THEN 'llm_should_decide' ELSE 'covered_by_pre_judge_or_candidate_pool' END AS gate_reason
FROM (SELECT DISTINCT doc_id FROM nodes) d LEFT JOIN sig USING (doc_id)""")
def _(spark, sf):
    observed = node_units(spark, sf).select(
        "doc_id", "unit_id", F.col("context_scope").alias("scope"), F.col("text").alias("source_text"),
        half_translated().alias("translated"),
    )
    out = P.resolver_scopes(C.entries(spark, sf), injections(spark, sf), observed)
    return out.select("doc_id", "matched_entries", "gate_reason")


@check("influence_risks", S.with_(S.GLOSSARY, SUB) + """
SELECT doc_id, unit_id, source_term, CASE WHEN frequency >= 4 THEN preferred_target ELSE upper(source_term) END AS target
FROM subs WHERE frequency >= 3""")
def _(spark, sf):
    same = node_units(spark, sf).select("doc_id", "unit_id", F.col("text").alias("source_text"), F.col("text").alias("translated"))
    found = A.classify_observations(injections(spark, sf), same)
    return A.influence_risks(found).select("doc_id", "unit_id", "source_term", "target")


@check("risk_marked_entries", G + " SELECT doc_id, term_id FROM entries WHERE frequency = 3")
def _(spark, sf):
    e = C.entries(spark, sf)
    return A.risk_marked(e.withColumn("resolver_priority", F.when(F.col("needs_review"), "High").otherwise("low"))).select("doc_id", "term_id")


@check("applied_actions", S.with_(S.GLOSSARY, ACT) + """
SELECT doc_id, action_seq, type, CASE WHEN type IN ('no_update') THEN true WHEN type IN ('drop_candidate', 'source_meaning_only') THEN false
   WHEN type = 'mark_preferred' AND target IS NULL THEN false WHEN target IS NOT NULL THEN false ELSE true END AS applied,
  CASE WHEN type = 'no_update' THEN '' WHEN type IN ('drop_candidate', 'source_meaning_only') THEN 'unsupported_action'
   WHEN type = 'mark_preferred' AND target IS NULL THEN 'target_required'
   WHEN target IS NOT NULL THEN 'target_relation_required_for_competing_preferred' ELSE '' END AS reason FROM acts""")
def _(spark, sf):
    e = C.entries(spark, sf).drop("frequency")
    return A.fold_results(A.fold_actions(e, actions(spark, sf))).select("doc_id", "action_seq", "type", "applied", "reason")


@check("action_audit", S.with_(S.GLOSSARY, ACT) + """
SELECT type, applied, reason, count(*) AS actions FROM (SELECT type, CASE WHEN type IN ('no_update') THEN true WHEN type IN ('drop_candidate', 'source_meaning_only') THEN false
   WHEN type = 'mark_preferred' AND target IS NULL THEN false WHEN target IS NOT NULL THEN false ELSE true END AS applied,
  CASE WHEN type = 'no_update' THEN '' WHEN type IN ('drop_candidate', 'source_meaning_only') THEN 'unsupported_action'
   WHEN type = 'mark_preferred' AND target IS NULL THEN 'target_required'
   WHEN target IS NOT NULL THEN 'target_relation_required_for_competing_preferred' ELSE '' END AS reason FROM acts) GROUP BY ALL""")
def _(spark, sf):
    e = C.entries(spark, sf).drop("frequency")
    return A.action_audit(A.fold_results(A.fold_actions(e, actions(spark, sf))))


@check("reviewed_entries", S.with_(S.GLOSSARY, ACT) + """
SELECT doc_id, term_id, CASE type WHEN 'drop_candidate' THEN 'blocked' WHEN 'mark_preferred' THEN 'preferred' WHEN 'source_meaning_only' THEN 'source_meaning_only'
   WHEN 'no_update' THEN 'analysis_hint' ELSE 'preferred' END AS status,
  CASE WHEN type = 'mark_preferred' THEN coalesce(target, preferred_target) ELSE preferred_target END AS preferred_target,
  CASE type WHEN 'drop_candidate' THEN 'blocked' WHEN 'source_meaning_only' THEN 'source_meaning_only' WHEN 'mark_preferred' THEN '' ELSE '' END AS policy FROM acts""")
def _(spark, sf):
    out = A.apply_review_actions(actions(spark, sf), C.entries(spark, sf))
    return out.select("doc_id", "term_id", "status", "preferred_target", X.text("pre_judge_inject_policy").alias("policy"))


# --- quality ----------------------------------------------------------------


@check("pair_checks", S.with_(S.PAIRS) + """
SELECT doc_id, unit_id, regexp_matches(translated, '(?i)\\b(?:PREVIOUS|NEXT|SECTION_HEADING|TABLE_TITLE|ABBREVIATION_HINTS):')
   AND NOT regexp_matches(original, '(?i)\\b(?:PREVIOUS|NEXT|SECTION_HEADING|TABLE_TITLE|ABBREVIATION_HINTS):') AS label_leaked,
  (json_valid(trim(translated)) AND regexp_matches(trim(translated), '^[\\[{]') AND NOT (json_valid(trim(original)) AND regexp_matches(trim(original), '^[\\[{]'))) AS corrupted,
  (left(trim(translated), 1) IN ('"', '''', '“', '‘', '«') AND left(trim(original), 1) NOT IN ('"', '''', '“', '‘', '«') AND NOT regexp_matches(original, '["“”‘’«»]')) AS structure_drift,
  trim(translated) = '' AS blank_output, trim(translated) = trim(original) AS unchanged,
  list_filter(regexp_extract_all(translated, '[^\\x00-\\x{024F}]'), lambda c: false) = [] AS no_foreign FROM pairs""")
def _(spark, sf):
    o, t = "original", "translated"
    return C.pairs(spark, sf).select(
        "doc_id", "unit_id", Q.label_leaked(o, t).alias("label_leaked"), Q.corrupted(o, t).alias("corrupted"),
        Q.structure_drift(o, t).alias("structure_drift"), Q.blank_output(o, t).alias("blank_output"),
        Q.unchanged_output(o, t).alias("unchanged"), (F.size(Q.foreign_characters(o, t)) == 0).alias("no_foreign"),
    )


def latin(x):
    """Latin words of a text; those that touch letters beyond ASCII are none."""
    return f"regexp_extract_all({S.ascii_edges(x)}, '\\b[A-Za-z][A-Za-z][A-Za-z''-]*\\b')"


def code_like(x, words):
    telling = f"len(list_filter({words}, lambda w: length(w) >= 4 AND regexp_matches(w, '[a-z]'))) > 0"
    return f"({x} = '' OR regexp_matches({x}, '^[A-Z0-9][A-Z0-9./_+() -]*$') OR NOT {telling})"


TITLE_WORD = "[A-Z][A-Za-z0-9''&/-]*|[A-Z0-9&/-]{2,}"


@check("untranslated_into_korean", S.with_(S.PAIRS) + f"""
, p AS (SELECT doc_id, unit_id, {S.strip_wide("coalesce(original, '')")} AS o, {S.strip_wide("coalesce(translated, '')")} AS t FROM pairs)
, q AS (SELECT *, {latin('t')} AS ws, {S.collapse_wide("trim(t, ' .,:;!?" + chr(34) + "''()[]{}')")} AS c FROM p)
, r AS (SELECT *, {latin('c')} AS cs, o <> '' AND lower({S.collapse_wide('o')}) = lower({S.collapse_wide('t')}) AS same FROM q)
SELECT doc_id, unit_id, CASE WHEN NOT regexp_matches(t, '[A-Za-z]') OR {code_like('t', 'ws')} OR c = ''
    OR (len(cs) BETWEEN 1 AND 6 AND ({code_like('c', 'cs')} OR regexp_matches(c, '^(?:{TITLE_WORD})(?:{S.BLANK}+(?:{TITLE_WORD}|of|the|and|for|in))*$'))) THEN false
  WHEN regexp_matches(t, '[가-힣]') THEN len(list_filter(ws, lambda w: length(w) >= 4 AND regexp_matches(w, '^[a-z]'))) > 0
  ELSE len(ws) >= 2 AND (same OR len(list_filter(ws, lambda w: length(w) >= 4 AND regexp_matches(w, '[a-z]'))) >= 2) END AS left_over FROM r""")
def _(spark, sf):
    return C.pairs(spark, sf).select("doc_id", "unit_id", Q.latin_left_in_korean("original", "translated").alias("left_over"))


@check("safe_for_memory", S.with_(S.PAIRS) + """
SELECT doc_id, unit_id, trim(translated) <> '' AND trim(translated) <> trim(original) AS safe FROM pairs""")
def _(spark, sf):
    return C.pairs(spark, sf).select(
        "doc_id", "unit_id", Q.safe_for_memory("original", "translated", F.lit("en"), F.lit(""), "element_type").alias("safe")
    )


@check("batch_response_problems", S.with_(S.PAIRS) + """
, r AS (SELECT doc_id, unit_id AS id, unit_id AS n FROM pairs WHERE length(translated) > 150
  UNION ALL SELECT doc_id, unit_id, unit_id FROM pairs WHERE length(translated) > 400 UNION ALL SELECT doc_id, unit_id + 1000, unit_id FROM pairs WHERE length(translated) > 500)
, c AS (SELECT doc_id, id, count(*) AS n FROM r GROUP BY ALL)
SELECT doc_id, 'duplicate_id' AS problem, id FROM c WHERE n > 1 UNION ALL SELECT doc_id, 'unexpected_id', id FROM c WHERE id >= 1000
UNION ALL SELECT doc_id, 'missing_id_in_response', unit_id FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = p.doc_id AND c.id = p.unit_id)
UNION ALL SELECT doc_id, 'id_not_an_integer', NULL FROM pairs WHERE length(translated) > 600""")
def _(spark, sf):
    p = C.pairs(spark, sf)
    expected = p.select("doc_id", F.lit(0).cast("bigint").alias("batch_id"), F.col("unit_id").alias("id"))
    n = F.length("translated")
    none = F.lit(None).cast("string")
    ident = F.col("unit_id")
    offers = F.array_compact(
        F.array(
            F.when(n > 150, F.struct(ident.cast("string").alias("id"), ident.alias("i"))),
            F.when(n > 400, F.struct(ident.cast("string").alias("id"), (ident + 100).alias("i"))),
            F.when(n > 500, F.struct((ident + 1000).cast("string").alias("id"), (ident + 200).alias("i"))),
            F.when(n > 600, F.struct(F.concat(F.lit("x"), ident.cast("string")).alias("id"), (ident + 300).alias("i"))),
        )
    )
    responses = p.withColumn("_o", F.explode(offers)).select(
        "doc_id", F.lit(0).cast("bigint").alias("batch_id"), F.col("_o.i").alias("item_index"), F.col("_o.id").alias("id"),
        F.col("translated").alias("t"), none.alias("translated"), none.alias("translation"), none.alias("text"),
    )
    return QR.check_batches(expected, responses).select("doc_id", "problem", "id")


# Two turns in a row get one translation; the second one is the repeat.
TWINS = """
WITH p AS (SELECT conv_id AS doc_id, turn AS unit_id, text AS original, first_value(text) OVER (PARTITION BY conv_id, turn // 2 ORDER BY turn) AS translated FROM conversations),
 q AS (SELECT *, lag(translated) OVER w AS before, lag(original) OVER w AS source FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY unit_id))
SELECT doc_id, unit_id FROM q WHERE before = translated AND source <> original AND length(regexp_replace(lower(translated), '[^\\p{L}\\p{N}]', '', 'g')) >= 24"""


@check("adjacent_duplicates", TWINS)
def _(spark, sf):
    from ..sources.tables import read_table

    turns = read_table(spark, sf, "conversations")
    pair = Window.partitionBy("conv_id", F.floor(F.col("turn") / 2)).orderBy("turn")
    doubled = turns.select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("unit_id"), F.col("text").alias("original"),
        F.first("text").over(pair).alias("translated"),
    )
    return QR.adjacent_duplicates(doubled, ["doc_id"])


@check("adjacent_near_duplicates")
def _(spark, sf):
    """Every second turn is given the translation of the turn before it less none to four tenths, so ratios lie on both sides of the bound."""
    from ..sources.tables import read_table

    turns = read_table(spark, sf, "conversations")
    pair = Window.partitionBy("conv_id", F.floor(F.col("turn") / 2)).orderBy("turn")
    first = F.coalesce(F.first("text").over(pair), F.lit(""))
    cut = F.when(F.col("turn") % 2 == 1, F.floor(F.length(first) * (F.col("conv_id") % 5) / 10)).otherwise(0).cast("int")
    doubled = turns.select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("unit_id"), F.col("text").alias("original"),
        F.substring(first, cut + 1, F.length(first)).alias("translated"),
    )
    return QR.adjacent_duplicates(doubled, ["doc_id"])


@check("quality_report")
def _(spark, sf):
    """Lines of a document against the line before, with the document's own entries."""
    before = F.coalesce(F.lag("text").over(Window.partitionBy("doc_id").orderBy("node_id")), F.col("text"))
    pairs = C.nodes(spark, sf).select("doc_id", F.col("node_id").alias("unit_id"), F.col("text").alias("original"), before.alias("translated"), "element_type")
    return QR.quality_report(pairs, C.entries(spark, sf), "ko")


@check("evidence_quality", S.with_(S.NODES) + """
, e AS (SELECT doc_id, node_id, length(text) < 60 AS short, regexp_matches(text, '[.!?]["'')\\]}]*$') AS done, contains(lower(text), 'the') AS present, node_id AS pos FROM nodes)
SELECT doc_id, count(*) AS selected_count, count(*) FILTER (short) AS too_short_count, count(*) FILTER (done) AS complete_sentence_count,
  count(*) FILTER (present) AS term_present_count, CASE WHEN count(DISTINCT pos) = 1 OR max(pos) - min(pos) <= 2 THEN 'single_area'
   WHEN count(DISTINCT pos) >= 3 THEN 'distributed' ELSE 'multiple_areas' END AS document_spread,
  array_to_string(list_sort(list(DISTINCT pos))[1:8], '|') AS positions FROM e GROUP BY doc_id""")
def _(spark, sf):
    from ..functions.evidence import ends_sentence, occurrence_position

    rows = C.nodes(spark, sf).select(
        "doc_id", (F.length("text") < 60).alias("too_short"), ends_sentence("text").alias("complete_sentence"),
        F.contains(F.lower("text"), F.lit("the")).alias("term_present"),
        occurrence_position(F.concat(F.lit("docx:page:"), F.col("node_id").cast("string"))).alias("position"),
    )
    return D.evidence_quality(rows, ["doc_id"]).withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), "|"))


@check("analysis_sample")
def _(spark, sf):
    return TM.analysis_sample(_with_scores(spark, sf), _occurrences(spark, sf))


def _with_scores(spark, sf):
    return mined(spark, sf).withColumn("bucket", F.lit("pending"))


def _occurrences(spark, sf):
    def build():
        from ..operators import mining

        return mining.occurrences_in(C.context_units(spark, sf), mined(spark, sf), ["doc_id"])

    return C.kept(spark, sf, "occurrences", build)


@check("representative_evidence")
def _(spark, sf):
    return D.representative_evidence(mined(spark, sf), _occurrences(spark, sf))


@check("seeded_document_terms")
def _(spark, sf):
    return P.seed_document_terms(seeds(spark, sf), mined(spark, sf), _occurrences(spark, sf))


@check("review_input")
def _(spark, sf):
    return P.review_input(C.entries(spark, sf), mined(spark, sf), _occurrences(spark, sf))


def _promotion(spark, sf, part):
    def build():
        units = node_units(spark, sf)
        done = translated(spark, sf).select("doc_id", "unit_id", "translated")
        terms = C.glossary(spark, sf).withColumn("confidence", F.col("candidate_score"))
        return P.observe_and_promote(units, done, terms, "de")[part]

    return C.kept(spark, sf, f"promotion_{part}", build)


@check("observed_and_promoted")
def _(spark, sf):
    return _promotion(spark, sf, 1)


@check("promotion_observations")
def _(spark, sf):
    return _promotion(spark, sf, 0)


@check("promotion_demotions")
def _(spark, sf):
    return _promotion(spark, sf, 2)
