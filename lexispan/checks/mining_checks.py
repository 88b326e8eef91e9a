"""Checks of term mining and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import mining
from ..operators import retrieval as R
from ..plans import pipelines as P
from . import corpus as C
from . import sqltext as S
from .registry import check
from .text_checks import INVALID, bad_ngram, independent, repeated

CAND = f"""
segs AS (SELECT doc_id, unit_id, g, list_filter(regexp_extract_all(seg, '{S.WORD}'), lambda w: w <> '') AS ws FROM (
  SELECT doc_id, unit_id, unnest(string_split_regex({S.collapse('text')}, '{S.SEG}')) AS seg,
         generate_subscripts(string_split_regex({S.collapse('text')}, '{S.SEG}'), 1) AS g FROM units)),
singles AS (SELECT doc_id, unit_id, w AS raw, 4 AS bits, 3000000000 + g * 1000000 + i AS pos FROM (
  SELECT doc_id, unit_id, g, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM segs)
  WHERE regexp_full_match(w, '[A-Z][A-Za-z''/-]{{2,}}') AND NOT {S.upper_('w')} AND lower(w) NOT IN (
    {", ".join("'" + x + "'" for x in __import__('lexispan.functions.fixed', fromlist=['x']).NAME_STOPWORDS)})),
grams AS (SELECT doc_id, unit_id, array_to_string(ws[i:i + n - 1], ' ') AS raw, 8 AS bits,
    3000000000 + g * 1000000 + n * 100000 + i AS pos FROM (
  SELECT doc_id, unit_id, g, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM segs, (SELECT unnest([2,3,4,5,6]) AS n) WHERE len(ws) >= n)
  WHERE regexp_matches(array_to_string(ws[i:i + n - 1], ' '), '(?:^| )[A-Z]')),
acros AS (SELECT doc_id, unit_id, a AS raw, 1 AS bits, 2000000000 + i AS pos FROM (
  SELECT doc_id, unit_id, unnest(l) AS a, generate_subscripts(l, 1) AS i FROM (
    SELECT doc_id, unit_id, regexp_extract_all(regexp_replace(text, '[^\\x00-\\x7F]', 'z', 'g'), '\\b[A-Z][A-Z0-9&/-]+\\b') AS l FROM units))
  WHERE NOT {S.noise('a')}),
every AS (SELECT doc_id, unit_id, {S.clean('raw')} AS surface, bits, pos FROM (
  SELECT * FROM singles UNION ALL SELECT * FROM grams UNION ALL SELECT * FROM acros)),
keyed AS (SELECT *, {S.norm('surface')} AS k FROM every WHERE surface <> ''),
cands AS (SELECT doc_id, unit_id, k, bit_or(bits) AS bits,
    coalesce(arg_max(surface, pos) FILTER ({S.upper_('surface')}), arg_min(surface, pos)) AS surface FROM keyed GROUP BY ALL),
counted AS (SELECT c.*, u.element_type, u.section, u.chunk, u.segkeys, CASE WHEN {S.plain_count('lower(u.text)', 'lower(c.surface)')} > 1
    THEN greatest({S.edge_count('u.text', 'c.surface')}, 1) ELSE 1 END AS n
  FROM cands c JOIN (SELECT *, list_transform(list_append(string_split_regex(text, '{S.SEG}'), text), lambda s: {S.norm(S.clean('s'))}) AS segkeys
    FROM units) u USING (doc_id, unit_id)),
stats AS (SELECT GROUPKEY k, arg_min(surface, ORDERKEY) AS source_term, CAST(sum(n) AS BIGINT) AS frequency,
    count(DISTINCT chunk) AS chunk_count, count(DISTINCT section) AS section_count,
    count(*) FILTER (element_type = 'heading') AS heading_count, count(*) FILTER (list_contains(segkeys, k)) AS standalone_occurrence_count,
    bit_or(bits | CASE WHEN element_type = 'heading' THEN 32 ELSE 0 END
      | CASE WHEN element_type <> 'heading' AND (bits & 9) = 8 THEN 128 ELSE 0 END
      | CASE WHEN element_type <> 'heading' AND (bits & 4) > 0 THEN 256 ELSE 0 END) AS raw_bits
  FROM counted GROUP BY GROUPKEY k),
sized AS (SELECT *, {S.tokens('source_term')} AS token_count, {S.clean('source_term')} AS raw, {S.words('lower(' + S.clean('source_term') + ')')} AS ws FROM stats),
typed_terms AS (SELECT *, raw_bits | CASE WHEN regexp_full_match(source_term, '[A-Z][A-Z0-9&/-]+') AND NOT {S.noise('source_term')} THEN 1 ELSE 0 END
    | CASE WHEN token_count > 1 THEN 8 ELSE 0 END AS b FROM sized),
judged AS (SELECT *, {INVALID} AS invalid, b | CASE WHEN (b & 617) = 0 THEN 16 ELSE 0 END AS type_bits,
   {S.is_acronym('source_term')} AS acro,
   (({S.is_acronym('source_term')} AND NOT {S.noise('source_term')}) OR {S.mixed('source_term')}) AS single_ok FROM typed_terms),
reasons AS (SELECT *, CASE WHEN invalid <> '' THEN invalid WHEN {repeated('source_term')} THEN 'cross_boundary_repeated_token'
   WHEN token_count = 0 THEN 'empty_or_non_word' WHEN length(source_term) < 2 THEN 'too_short'
   WHEN token_count = 1 AND NOT single_ok AND (type_bits & 4) = 0 THEN 'generic_single_word'
   WHEN token_count > 1 AND NOT {independent('source_term')} THEN 'not_independent_term_shape'
   WHEN (type_bits & 128) > 0 AND {bad_ngram('source_term')} THEN 'bad_body_ngram_shape'
   WHEN token_count > 1 AND {S.is_acronym("string_split(source_term, ' ')[-1]")} THEN 'alias_joined_ngram'
   WHEN token_count = 1 AND frequency < 2 AND (type_bits & 97) = 0 THEN 'single_word_low_frequency'
   WHEN frequency < 2 AND (type_bits & 99) = 0 THEN 'low_frequency'
   WHEN acro AND NOT (CASE WHEN length(source_term) <= 2 THEN heading_count >= 2 OR standalone_occurrence_count >= 2
       ELSE frequency >= 2 OR heading_count >= 1 OR standalone_occurrence_count >= 1 END) THEN 'unvalidated_acronym' ELSE '' END AS filter_reason
  FROM judged),
scored AS (SELECT *, round_even(greatest(0, least(1, least(0.35, frequency / 5.0 * 0.35) + least(0.15, chunk_count / 5.0 * 0.15)
    + least(0.10, section_count / 6.0 * 0.10) + CASE WHEN (type_bits & 32) > 0 THEN 0.2 ELSE 0 END
    + CASE WHEN (type_bits & 1) > 0 THEN 0.12 ELSE 0 END + CASE WHEN (type_bits & 4) > 0 THEN 0.10 ELSE 0 END
    + least(0.18, greatest(0, token_count - 1) * 0.08)
    + CASE WHEN token_count = 1 AND NOT single_ok AND (type_bits & 4) = 0 THEN -0.25 ELSE 0 END))::DOUBLE, 4) AS candidate_score
  FROM reasons WHERE filter_reason = '')
"""


def mining_sql(group: str, order: str) -> str:
    keys = f"{group}, " if group else ""
    return CAND.replace("GROUPKEY ", keys).replace("ORDERKEY", order)


DOC_UNITS = S.UNITS.replace("units AS (", "units0 AS (") + ",\nunits AS (SELECT *, 'docx:body' AS chunk FROM units0)"
DOC_MINE = S.with_(DOC_UNITS, mining_sql("doc_id", "unit_id"))
CORPUS_UNITS = S.NODES + ",\nunits AS (SELECT doc_id, node_id AS unit_id, text, element_type, section, doc_id AS chunk FROM typed)"
CORPUS_MINE = S.with_(CORPUS_UNITS, mining_sql("", "doc_id * 1000000 + unit_id"))


def judged(spark, sf):
    return C.kept(spark, sf, "judged", lambda: P.judge_units(C.units(spark, sf), ["doc_id"]))


def mined(spark, sf):
    return C.kept(spark, sf, "mined", lambda: P.mine_units(C.units(spark, sf), ["doc_id"], judged=judged(spark, sf)))


@check("corpus_terms", CORPUS_MINE + """
SELECT k AS normalized_source, source_term, frequency, chunk_count, section_count, heading_count, standalone_occurrence_count,
  token_count, candidate_score FROM scored ORDER BY candidate_score DESC, frequency DESC, k LIMIT 50""")
def _(spark, sf):
    return P.mine_corpus(C.documents(spark, sf), 50).select(
        "normalized_source", "source_term", "frequency", "chunk_count", "section_count", "heading_count",
        "standalone_occurrence_count", F.col("token_count").cast("bigint").alias("token_count"), "candidate_score",
    )


@check("unit_candidates", S.with_(DOC_UNITS, mining_sql("doc_id", "unit_id")) + """
SELECT doc_id, unit_id, k AS normalized_source, surface, bits AS type_bits, n AS unit_frequency FROM counted""")
def _(spark, sf):
    return mining.extract_candidates(C.units(spark, sf)).select(
        "doc_id", "unit_id", "normalized_source", "surface", F.col("raw_bits").alias("type_bits"),
        F.col("unit_frequency").cast("bigint").alias("unit_frequency"),
    )


@check("term_statistics", DOC_MINE + """
SELECT doc_id, k AS normalized_source, source_term, frequency, chunk_count, section_count, heading_count,
  standalone_occurrence_count, token_count, filter_reason FROM reasons""")
def _(spark, sf):
    return judged(spark, sf).select(
        "doc_id", "normalized_source", "source_term", "frequency", "chunk_count", "section_count", "heading_count",
        "standalone_occurrence_count", F.col("token_count").cast("bigint").alias("token_count"), "filter_reason",
    )


@check("exclusion_report", DOC_MINE + """
SELECT filter_reason, count(*) AS terms, CAST(sum(frequency) AS BIGINT) AS frequency FROM reasons WHERE filter_reason <> '' GROUP BY filter_reason""")
def _(spark, sf):
    return mining.exclusion_report(judged(spark, sf))


@check("term_scores", DOC_MINE + """
SELECT doc_id, k AS normalized_source, candidate_score, CAST(floor(token_count * 100 + candidate_score * 100) AS BIGINT) AS match_priority,
  round_even(least(0.35, frequency / 5.0 * 0.35)::DOUBLE, 4) AS frequency_part,
  round_even(least(0.18, greatest(0, token_count - 1) * 0.08)::DOUBLE, 4) AS phrase_part FROM scored""")
def _(spark, sf):
    return mining.score_terms(judged(spark, sf)).select(
        "doc_id", "normalized_source", "candidate_score", "match_priority",
        F.col("score_breakdown.frequency").alias("frequency_part"), F.col("score_breakdown.phrase_bonus").alias("phrase_part"),
    )


@check("mined_terms", DOC_MINE + """
, numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY frequency DESC, token_count DESC, k) AS term_order FROM scored),
 nested AS (SELECT DISTINCT s.doc_id, s.k FROM numbered s JOIN numbered l ON s.doc_id = l.doc_id AND l.token_count > s.token_count
   AND contains(' ' || l.k || ' ', ' ' || s.k || ' ') AND l.frequency >= greatest(1, s.frequency * 0.8)
   WHERE s.standalone_occurrence_count = 0)
SELECT n.doc_id, n.k AS normalized_source, n.source_term, n.frequency, n.candidate_score, n.term_order,
  'term_' || lpad(CAST(n.term_order AS VARCHAR), greatest(3, length(CAST(n.term_order AS VARCHAR)))::INT, '0') AS term_id
FROM numbered n ANTI JOIN nested x ON n.doc_id = x.doc_id AND n.k = x.k""")
def _(spark, sf):
    return mined(spark, sf).select(
        "doc_id", "normalized_source", "source_term", "frequency", "candidate_score", "term_order", "term_id"
    )


@check("evenly_sampled_lines", S.with_(S.NODES) + """
, sized AS (SELECT doc_id, node_id, count(*) OVER (PARTITION BY doc_id) AS n FROM nodes),
 slots AS (SELECT DISTINCT doc_id, CAST(round_even((s * (n - 1) / 7.0)::DOUBLE, 0) AS BIGINT) AS node_id FROM (SELECT DISTINCT doc_id, n FROM sized WHERE n > 8), generate_series(0, 7) g(s))
SELECT doc_id, node_id FROM sized WHERE n <= 8 UNION ALL SELECT doc_id, node_id FROM slots""")
def _(spark, sf):
    return mining.sample_evenly(C.nodes(spark, sf), ["doc_id"], ["node_id"], 8).select("doc_id", "node_id")


@check("term_evidence")
def _(spark, sf):
    units = C.context_units(spark, sf)
    terms = mined(spark, sf)
    rows = mining.occurrences_in(units, terms, ["doc_id"])
    return mining.sample_evenly(rows, ["doc_id", "normalized_source"], ["unit_id"]).drop("section_path")


TOK = f"toks AS (SELECT doc_id, {S.search_tokens('text')} AS t FROM documents)"


@check("token_document_frequency", S.with_(TOK) + """
, u AS (SELECT doc_id, unnest(list_distinct(t)) AS token FROM toks) SELECT token, count(*) AS document_frequency FROM u GROUP BY token""")
def _(spark, sf):
    return R.bm25_stats(C.documents(spark, sf), [], ["doc_id"])


@check("corpus_size", S.with_(TOK) + " SELECT count(*) AS document_count, round(avg(len(t)), 6) AS average_length FROM toks")
def _(spark, sf):
    return R.corpus_size(C.documents(spark, sf), []).withColumn("average_length", F.round("average_length", 6))


@check("bm25_ranking", S.with_(TOK, """
stat AS (SELECT count(*) AS n, avg(len(t)) AS al FROM toks),
 q AS (SELECT item_id, unnest(list_distinct(""" + S.search_tokens("text") + """)) AS token FROM benchmark),
 post AS (SELECT doc_id, len(t) AS l, token, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS token FROM toks)
   WHERE token IN (SELECT token FROM q) GROUP BY ALL),
 df AS (SELECT token, count(*) AS df FROM post GROUP BY token),
 score AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * l / al))) AS s
   FROM post JOIN q USING (token) JOIN df USING (token), stat GROUP BY ALL),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(s, 9) DESC, doc_id) AS rank FROM score WHERE s > 0)""") + """
SELECT item_id, doc_id, rank, round(s, 5) AS score FROM ranked WHERE rank <= 10""")
def _(spark, sf):
    queries = C.read_table(spark, sf, "benchmark").select("item_id", F.col("text").alias("query"))
    best = R.bm25_rank(queries, C.documents(spark, sf), [], ["item_id"], ["doc_id"], 10)
    return best.select("item_id", "doc_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 5).alias("score"))


SECT = """
md AS (SELECT user_id, string_agg('## ' || day || chr(10) || body, chr(10) ORDER BY day) AS text FROM (
  SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, string_agg(event_type || ' ' || event_id, chr(10) ORDER BY event_id) AS body
  FROM events GROUP BY ALL) GROUP BY user_id),
sections AS (SELECT user_id AS job_id, day AS title, 2 AS level, row_number() OVER (PARTITION BY user_id ORDER BY day) - 1 AS section_index,
  string_agg(event_type || ' ' || event_id, chr(10) ORDER BY event_id) AS body FROM (
  SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_type, event_id FROM events) GROUP BY user_id, day)
"""


def sections(spark, sf):
    """A memory text per user: one section per day."""
    rows = C.read_table(spark, sf, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    line = F.struct("event_id", F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("s"))
    days = rows.groupBy("user_id", "day").agg(F.array_join(F.array_sort(F.collect_list(line))["s"], "\n").alias("body"))
    part = F.struct("day", F.concat(F.lit("## "), "day", F.lit("\n"), "body").alias("s"))
    texts = days.groupBy(F.col("user_id").alias("job_id")).agg(F.array_join(F.array_sort(F.collect_list(part))["s"], "\n").alias("text"))
    return R.split_sections(texts)


@check("memory_sections", S.with_(SECT) + " SELECT job_id, CAST(section_index AS BIGINT) AS section_index, level, title, body FROM sections")
def _(spark, sf):
    return sections(spark, sf).select("job_id", F.col("section_index").cast("bigint").alias("section_index"), "level", "title", "body")


@check("section_manifest", S.with_(SECT) + """
SELECT job_id, count(*) AS section_count, CAST(sum(length(body) + length(title) + 4) AS BIGINT) AS char_count FROM sections GROUP BY job_id""")
def _(spark, sf):
    return R.section_manifest(sections(spark, sf))


#: Sections of queries ``q`` (job_id, query_id, query).
SELECTION = """
 direct AS (SELECT q.job_id, query_id, section_index, 0 AS branch FROM q JOIN sections s ON s.job_id = q.job_id AND contains(query, title)),
 t AS (SELECT job_id, section_index, """ + S.search_tokens("title || chr(10) || body") + """ AS t FROM sections),
 stat AS (SELECT job_id, count(*) AS n, avg(len(t)) AS al FROM t GROUP BY job_id),
 qt AS (SELECT job_id, query_id, unnest(list_distinct(""" + S.search_tokens("query") + """)) AS token FROM q ANTI JOIN direct USING (job_id, query_id)),
 post AS (SELECT job_id, section_index, len(t) AS l, token, count(*) AS tf FROM (SELECT *, unnest(t) AS token FROM t) GROUP BY ALL),
 df AS (SELECT job_id, token, count(*) AS df FROM post GROUP BY ALL),
 score AS (SELECT p.job_id, query_id, section_index, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / al))) AS s
   FROM post p JOIN qt USING (job_id, token) JOIN df USING (job_id, token) JOIN stat USING (job_id) GROUP BY ALL),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY job_id, query_id ORDER BY round(s, 9) DESC, section_index) AS r FROM score),
 bm AS (SELECT job_id, query_id, section_index, 1 AS branch FROM ranked WHERE r <= 5),
 last_ AS (SELECT job_id, section_index FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY section_index DESC) AS r FROM sections) WHERE r <= 3),
 tail AS (SELECT job_id, query_id, section_index, 2 AS branch FROM q ANTI JOIN direct USING (job_id, query_id) ANTI JOIN bm USING (job_id, query_id) JOIN last_ USING (job_id))"""
SELECTED = """
SELECT job_id, query_id, CAST(section_index AS BIGINT) AS section_index, branch FROM (
  SELECT * FROM direct UNION ALL SELECT * FROM bm UNION ALL SELECT * FROM tail)"""


@check("selected_sections", S.with_(SECT, """
q AS (SELECT user_id AS job_id, max(event_id) AS query_id, CASE WHEN user_id < 50 THEN max(strftime(ts, '%Y-%m-%d')) WHEN user_id < 100
   THEN arg_max(event_type || ' ' || event_id, event_id) ELSE 'nothing like it' END AS query FROM events GROUP BY user_id),
""" + SELECTION) + SELECTED)
def _(spark, sf):
    last = F.struct("event_id", F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("s"))
    rows = C.read_table(spark, sf, "events").groupBy(F.col("user_id").alias("job_id")).agg(
        F.max("event_id").alias("query_id"), F.max(F.date_format("ts", "yyyy-MM-dd")).alias("_day"), F.max(last)["s"].alias("_last")
    )
    query = F.when(F.col("job_id") < 50, F.col("_day")).when(F.col("job_id") < 100, F.col("_last")).otherwise("nothing like it")
    queries = rows.select("job_id", "query_id", query.alias("query"), F.lit("").alias("scope"))
    return R.select_sections(queries, sections(spark, sf)).select(
        "job_id", "query_id", F.col("section_index").cast("bigint").alias("section_index"), "branch"
    )


LOOK = "('" + "','".join(R.LOOKUP_STOPWORDS) + "')"
LOOKUP = f"""w AS (SELECT doc_id, trim(unnest({S.search_tokens('text')}), '-''') AS token FROM documents),
 c AS (SELECT doc_id, token, count(*) AS uses FROM w WHERE length(token) >= 4 AND token NOT IN {LOOK} GROUP BY ALL),
 looked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY uses DESC, token) AS rank FROM c)"""


@check("lookup_words", S.with_(LOOKUP) + " SELECT doc_id, token, uses, rank FROM looked WHERE rank <= 80")
def _(spark, sf):
    return R.lookup_terms(C.documents(spark, sf), ["doc_id"]).withColumn("rank", F.col("rank").cast("bigint"))


@check("memory_relevance", S.with_(LOOKUP, S.NODES) + """
, m AS (SELECT doc_id, text AS memory_text FROM nodes WHERE node_id = 0)
SELECT m.doc_id, coalesce(count(l.token) FILTER (contains(lower(memory_text), l.token)), 0) + any_value(CASE WHEN contains(lower(memory_text), d.lang) THEN 3 ELSE 0 END) AS relevance
FROM m JOIN documents d ON d.doc_id = m.doc_id LEFT JOIN (SELECT * FROM looked WHERE rank <= 80) l ON l.doc_id = m.doc_id GROUP BY m.doc_id""")
def _(spark, sf):
    docs = C.documents(spark, sf)
    memory = C.nodes(spark, sf).where("node_id = 0").select("doc_id", F.col("text").alias("memory_text")).join(
        docs.select("doc_id", F.col("lang").alias("scope")), "doc_id"
    )
    return R.relevance_score(memory, R.lookup_terms(docs, ["doc_id"]), ["doc_id"])
