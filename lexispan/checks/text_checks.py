"""Checks of node reading, text functions and unit building."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import quality as Q
from ..functions import terms as T
from ..functions import text as X
from ..operators import batching, mining, nodes as N, scopes, units as U
from ..plans import pipelines as P
from . import corpus as C
from . import sqltext as S
from .registry import check

@check("read_nodes", S.with_(S.NODES) + " SELECT doc_id, node_id, text, section, element_type FROM typed")
def _(spark, sf):
    return C.nodes(spark, sf).select("doc_id", "node_id", "text", "section", "element_type")


@check(
    "normalized_text",
    S.with_(S.NODES) + f"""
SELECT doc_id, node_id, {S.norm('text')} AS source_key, {S.dkey('text')} AS document_key, {S.clean('text')} AS cleaned,
  {S.tokens('text')} AS word_tokens, array_to_string({S.search_tokens('text')}, '|') AS search_tokens,
  CAST(ceil(length(text) / 4.0) AS BIGINT) AS estimated_tokens FROM nodes""",
)
def _(spark, sf):
    return C.nodes(spark, sf).select(
        "doc_id", "node_id", X.normalize_source("text").alias("source_key"), X.document_key("text").alias("document_key"),
        X.clean_term("text").alias("cleaned"), X.token_count("text").cast("bigint").alias("word_tokens"),
        F.array_join(X.search_tokens("text"), "|").alias("search_tokens"),
        X.estimate_tokens("text").alias("estimated_tokens"),
    )


ACR = r"regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', 'z', 'g'), '\b[A-Z][A-Z0-9&/-]+\b')"


@check(
    "acronyms",
    S.with_(S.NODES) + f"""
, found AS (SELECT doc_id, unnest({ACR}) AS acronym FROM nodes)
SELECT doc_id, acronym, count(*) AS uses, bool_or({S.is_acronym('acronym')}) AS strict,
  bool_or({S.mixed('acronym')}) AS mixed_case FROM found WHERE NOT {S.noise('acronym')} GROUP BY doc_id, acronym""",
)
def _(spark, sf):
    from ..functions import fixed as K

    found = C.nodes(spark, sf).select(
        "doc_id", F.explode(F.regexp_extract_all("text", F.lit(K.ACRONYM), F.lit(0))).alias("acronym")
    ).where(~X.is_acronym_noise("acronym"))
    return found.groupBy("doc_id", "acronym").agg(
        F.count(F.lit(1)).alias("uses"), F.max(X.is_acronym("acronym")).alias("strict"),
        F.max(X.is_mixed_case("acronym")).alias("mixed_case"),
    )


INVALID = f"""CASE WHEN raw = '' THEN 'empty' WHEN lower(raw) IN ('blank','n/a','na','none','null') THEN 'placeholder'
  WHEN ws[-1] IN {S.FUNCTION} THEN 'ends_with_function_word' WHEN ws[1] IN {S.FUNCTION} THEN 'starts_with_function_word'
  WHEN {S.noise('raw')} THEN 'acronym_noise' WHEN len(ws) >= 8 AND NOT {S.is_acronym('raw')} THEN 'too_long_sentence_like_phrase'
  WHEN len(ws) >= 4 AND len(list_intersect(ws, {S.MARKERS})) > 0 THEN 'sentence_pattern' ELSE '' END"""


def independent(t):
    ws = S.words(t)
    return (
        f"CASE WHEN {S.is_acronym(t)} THEN NOT {S.noise(t)} ELSE len({ws}) >= 2 AND (len(list_filter({ws}, lambda w: "
        f"NOT {S.signal('w')})) = 0 OR len(list_filter({ws}, lambda w: {S.mixed('w')})) > 0) END"
    )


def title_like(t):
    ws = f"list_filter(list_transform({S.words(t)}, lambda w: trim(w, '()[]:;,.')), lambda w: w <> '' AND lower(w) NOT IN {S.STARTERS} AND lower(w) NOT IN {S.FUNCTION})"
    return f"(len({ws}) > 0 AND len(list_filter({ws}, lambda w: NOT ({S.signal('w')} OR {S.mixed('w')}))) = 0)"


def repeated(t):
    ws = f"list_filter(list_transform({S.words(t)}, lambda w: trim(w, '()/')), lambda w: {S.signal('w')} OR {S.mixed('w')})"
    return f"(len({ws}) <> len(list_distinct({ws})))"


def bad_ngram(t):
    ws = f"list_filter(list_transform({S.words(t)}, lambda w: lower(trim(w, '()[]:;,.'))), lambda w: w <> '')"
    return (
        f"(len({ws}) = 0 OR {ws}[-1] IN {S.FUNCTION} OR {ws}[1] IN {S.FUNCTION} OR "
        f"len(list_filter({ws}[2:], lambda w: w IN {S.STARTERS})) > 0 OR NOT {title_like(t)})"
    )


@check(
    "term_shapes",
    S.with_(S.NODES) + f"""
, segs AS (SELECT DISTINCT trim(unnest(string_split_regex(text, '{S.SEG}'))) AS phrase FROM nodes),
 prepared AS (SELECT phrase, {S.clean('phrase')} AS raw, {S.words('lower(' + S.clean('phrase') + ')')} AS ws FROM segs WHERE phrase <> '')
SELECT phrase, {INVALID} AS invalid_reason, {independent('phrase')} AS independent, {title_like('phrase')} AS title_like,
  {bad_ngram('phrase')} AS bad_ngram, {repeated('phrase')} AS repeated_token FROM prepared""",
)
def _(spark, sf):
    from ..functions import fixed as K

    segs = C.nodes(spark, sf).select(F.explode(F.split("text", K.SEGMENT_SPLIT)).alias("p")).select(
        X.strip("p").alias("phrase")
    ).where("phrase <> ''").distinct()
    return segs.select(
        "phrase", T.invalid_reason("phrase").alias("invalid_reason"), T.independent_shape("phrase").alias("independent"),
        T.title_like("phrase").alias("title_like"), T.bad_body_ngram("phrase").alias("bad_ngram"),
        T.repeated_key_token("phrase").alias("repeated_token"),
    )


@check(
    "text_fragments",
    S.with_(S.FRAGMENTS) + " SELECT doc_id, node_id, CAST(fragment_index AS BIGINT) AS fragment_index, CAST(fragment_count AS BIGINT) AS fragment_count, fragment_text FROM fragments",
)
def _(spark, sf):
    f = U.fragments_of(C.nodes(spark, sf))
    return f.select(
        "doc_id", "node_id", F.col("fragment_index").cast("bigint").alias("fragment_index"),
        F.col("fragment_count").cast("bigint").alias("fragment_count"), "fragment_text",
    )


@check(
    "fragment_context",
    S.with_(S.FRAGMENTS) + """
SELECT doc_id, node_id, CAST(fragment_index AS BIGINT) AS fragment_index,
  right(lag(fragment_text) OVER w, 260) AS previous_fragment, left(lead(fragment_text) OVER w, 260) AS next_fragment
FROM fragments WINDOW w AS (PARTITION BY doc_id, node_id ORDER BY fragment_index)""",
)
def _(spark, sf):
    return U.fragment_context(U.fragments_of(C.nodes(spark, sf))).withColumn(
        "fragment_index", F.col("fragment_index").cast("bigint")
    )


@check(
    "translation_units",
    S.with_(S.UNITS) + " SELECT doc_id, unit_id, text, element_type, section, target_count, first_node_id FROM units",
)
def _(spark, sf):
    return C.units(spark, sf).select("doc_id", "unit_id", "text", "element_type", "section", "target_count", "first_node_id")


@check(
    "unit_targets",
    S.with_(S.UNITS) + """
SELECT f.doc_id, unit_id, node_id, CAST(fragment_index AS BIGINT) AS fragment_index FROM fragments f
JOIN units u ON u.doc_id = f.doc_id AND u.element_type = f.element_type AND u.text = f.fragment_text""",
)
def _(spark, sf):
    return C.targets(spark, sf).select(
        "doc_id", "unit_id", "node_id", F.col("fragment_index").cast("bigint").alias("fragment_index")
    )


@check(
    "neighbour_context",
    S.with_(S.NODES) + """
SELECT doc_id, node_id, left(lag(text) OVER w, 220) AS previous_text, left(lead(text) OVER w, 220) AS next_text
FROM nodes WINDOW w AS (PARTITION BY doc_id ORDER BY node_id)""",
)
def _(spark, sf):
    return N.neighbour_context(C.nodes(spark, sf)).select("doc_id", "node_id", "previous_text", "next_text")


@check(
    "scope_batches",
    "WITH RECURSIVE " + S.NODES.strip() + """,
walk AS (
  SELECT doc_id, node_id, 1::BIGINT AS page_num, 1 AS items, length(text) AS chars FROM nodes WHERE node_id = 0
  UNION ALL
  SELECT n.doc_id, n.node_id,
    CASE WHEN w.items >= 20 OR w.chars + length(n.text) > 6000 THEN w.page_num + 1 ELSE w.page_num END,
    CASE WHEN w.items >= 20 OR w.chars + length(n.text) > 6000 THEN 1 ELSE w.items + 1 END,
    CASE WHEN w.items >= 20 OR w.chars + length(n.text) > 6000 THEN length(n.text) ELSE w.chars + length(n.text) END
  FROM walk w JOIN nodes n ON n.doc_id = w.doc_id AND n.node_id = w.node_id + 1)
SELECT doc_id, node_id, page_num FROM walk""",
)
def _(spark, sf):
    return batching.assign_scope_batches(C.nodes(spark, sf)).select("doc_id", "node_id", "page_num")


@check(
    "resolved_nodes",
    S.with_(S.FRAGMENTS) + """
SELECT doc_id, node_id, any_value(node_text) AS original,
  regexp_replace(string_agg(trim('[de] ' || fragment_text), ' ' ORDER BY fragment_index),
    '([가-힣A-Za-z0-9])\\s+\\(([A-Z0-9&/.-]{2,})\\)', '\\1(\\2)', 'g') AS translated FROM fragments GROUP BY doc_id, node_id""",
)
def _(spark, sf):
    units, targets = C.units_and_targets(spark, sf)
    return U.resolve_nodes(C.nodes(spark, sf), units, targets, U.translate_mock(units, "de"))


@check(
    "evaluation_units",
    S.with_(S.UNITS) + """
SELECT f.doc_id, unit_id, node_id, CAST(fragment_index AS BIGINT) AS fragment_index, u.text AS source_text,
  '[de] ' || u.text AS translated, f.section FROM fragments f
JOIN units u ON u.doc_id = f.doc_id AND u.element_type = f.element_type AND u.text = f.fragment_text""",
)
def _(spark, sf):
    units, targets = C.units_and_targets(spark, sf)
    rows = U.evaluation_units(units, targets, C.nodes(spark, sf), U.translate_mock(units, "de"))
    return rows.select(
        "doc_id", "unit_id", "node_id", F.col("fragment_index").cast("bigint").alias("fragment_index"),
        "source_text", "translated", "section",
    )


@check(
    "translation_pairs",
    S.with_(S.NODES) + """, map AS (SELECT DISTINCT text AS original, lower(text) AS translated FROM nodes WHERE node_id = 0)
SELECT n.doc_id, node_id AS id, n.text AS original, coalesce(m.translated, n.text) AS translated
FROM nodes n LEFT JOIN map m ON m.original = n.text""",
)
def _(spark, sf):
    nodes = C.nodes(spark, sf)
    mapping = nodes.where("node_id = 0").select(F.col("text").alias("original"), F.lower("text").alias("translated")).distinct()
    return U.translation_pairs(nodes, mapping).select("doc_id", "id", "original", "translated")


@check(
    "edited_pairs",
    S.with_(S.PAIRS) + """
, edits AS (SELECT conv_id AS doc_id, turn - 1 AS id, text AS translated, 2 AS seq FROM conversations WHERE turn >= 2
  UNION ALL SELECT conv_id, turn - 1, lower(text), 1 FROM conversations WHERE turn >= 2)
SELECT p.doc_id, unit_id AS id, original, coalesce(e.t, p.translated) AS translated FROM pairs p
LEFT JOIN (SELECT doc_id, id, arg_max(translated, seq) AS t FROM edits GROUP BY ALL) e ON e.doc_id = p.doc_id AND e.id = p.unit_id""",
)
def _(spark, sf):
    pairs = C.pairs(spark, sf).select("doc_id", F.col("unit_id").alias("id"), "original", "translated")
    later = C.read_table(spark, sf, "conversations").where("turn >= 2").select(
        F.col("conv_id").alias("doc_id"), (F.col("turn") - 1).alias("id"), F.col("text").alias("t")
    )
    edits = later.select("doc_id", "id", F.col("t").alias("translated"), F.lit(2).alias("edit_seq")).unionByName(
        later.select("doc_id", "id", F.lower("t").alias("translated"), F.lit(1).alias("edit_seq"))
    )
    return U.apply_edits(pairs, edits)


@check(
    "previous_translations",
    S.with_(S.UNITS) + """
, targets AS (SELECT f.doc_id, unit_id, node_id, fragment_index FROM fragments f
  JOIN units u ON u.doc_id = f.doc_id AND u.element_type = f.element_type AND u.text = f.fragment_text)
SELECT u.doc_id, u.unit_id, coalesce(p.previous, '') AS previous FROM units u LEFT JOIN (
  SELECT t.doc_id, unit_id, arg_min(lower(n.text), node_id * 1000000 + fragment_index) AS previous FROM targets t
  JOIN nodes n USING (doc_id, node_id) WHERE node_id > 0 GROUP BY ALL) p ON p.doc_id = u.doc_id AND p.unit_id = u.unit_id""",
)
def _(spark, sf):
    units, targets = C.units_and_targets(spark, sf)
    earlier = C.nodes(spark, sf).where("node_id > 0").select("doc_id", "node_id", F.lower("text").alias("previous"))
    return U.previous_translation(units, targets, earlier)


@check(
    "container_names",
    S.with_(S.NODES) + f"""
SELECT doc_id, node_id, CASE WHEN node_id = 0 THEN 'text_box' ELSE 'paragraph' END AS container_type,
  'docx:body' AS container_id, 'docx:page:' || node_id AS scope, 'docx:page:' || node_id AS chunk,
  CASE WHEN node_id = 0 THEN 'heading' WHEN contains(lower(text), ' and ') THEN 'table_cell' ELSE 'paragraph' END AS element
FROM nodes""",
)
def _(spark, sf):
    n = C.nodes(spark, sf)
    shape = F.when(F.col("node_id") == 0, "title box")
    none = F.lit(None).cast("int")
    group = F.when(F.contains(F.lower("text"), F.lit(" and ")), "table_cell").otherwise("")
    scope = N.context_scope(none, F.lit(""), F.col("node_id"), "source")
    return n.select(
        "doc_id", "node_id",
        N.container_type(F.lit("paragraph"), none, none, F.lit(""), F.lit(""), shape, "source").alias("container_type"),
        N.container_id("doc_format", none, none, F.lit(""), F.lit(""), "source").alias("container_id"),
        scope.alias("scope"), N.chunk_id(scope, "node_id").alias("chunk"),
        N.element_type(F.when(F.col("node_id") == 0, "heading"), group, "text", "type").alias("element"),
    )


@check(
    "parsed_scopes",
    """
WITH s AS (SELECT event_id, CASE WHEN event_type = 'view' THEN 'pptx:slide:' || user_id WHEN event_type = 'click' THEN 'docx:page:' || user_id
  WHEN event_type = 'error' THEN 'docx:page:x' || user_id ELSE 'xlsx:sheet:' || event_type || ':' || user_id END AS scope FROM events)
SELECT event_id, scope, split_part(scope, ':', 2) AS kind,
  CASE WHEN scope LIKE 'xlsx%' THEN NULL ELSE try_cast(split_part(scope, ':', 3) AS BIGINT) END AS number,
  CASE WHEN scope LIKE 'xlsx:sheet:%' THEN substr(scope, 12) ELSE '' END AS sheet_name,
  coalesce(CASE WHEN scope LIKE 'xlsx%' THEN NULL ELSE try_cast(split_part(scope, ':', 3) AS BIGINT) END, 1000000000) AS sort_number FROM s""",
)
def _(spark, sf):
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    scope = (
        F.when(kind == "view", F.concat(F.lit("pptx:slide:"), user)).when(kind == "click", F.concat(F.lit("docx:page:"), user))
        .when(kind == "error", F.concat(F.lit("docx:page:x"), user)).otherwise(F.concat(F.lit("xlsx:sheet:"), kind, F.lit(":"), user))
    )
    rows = C.read_table(spark, sf, "events").select("event_id", scope.alias("scope"))
    return rows.select("event_id", "scope", N.parse_scope("scope").alias("p")).select("event_id", "scope", "p.*")


@check(
    "slide_context",
    S.with_(S.NODES) + """
, slides AS (SELECT doc_id, node_id // 5 AS slide_index, string_agg(text, ' ' ORDER BY node_id) AS t FROM nodes GROUP BY ALL),
 first AS (SELECT doc_id, t FROM slides WHERE slide_index = 0)
SELECT s.doc_id, s.slide_index, concat_ws(' ', f.t, p.t, s.t) AS context_text FROM slides s JOIN first f ON f.doc_id = s.doc_id
LEFT JOIN slides p ON p.doc_id = s.doc_id AND p.slide_index = s.slide_index - 1""",
)
def _(spark, sf):
    slides = C.nodes(spark, sf).withColumn("slide_index", F.floor(F.col("node_id") / 5).cast("bigint"))
    return N.slide_context(slides)


@check(
    "table_context",
    S.with_(S.NODES) + """
, marked AS (SELECT doc_id, node_id, text, CASE WHEN length(text) <= 60 AND node_id > 0 THEN node_id // 4 END AS table_index FROM nodes),
 carried AS (SELECT *, last_value(CASE WHEN table_index IS NULL AND node_id = 0 THEN left(text, 220) END IGNORE NULLS)
   OVER (PARTITION BY doc_id ORDER BY node_id) AS heading FROM marked)
SELECT doc_id, table_index, '' AS table_title, coalesce(arg_min(heading, node_id) FILTER (heading IS NOT NULL), '') AS table_section
FROM carried WHERE table_index IS NOT NULL GROUP BY ALL""",
)
def _(spark, sf):
    marked = C.nodes(spark, sf).withColumn(
        "table_index", F.when((F.length("text") <= 60) & (F.col("node_id") > 0), F.floor(F.col("node_id") / 4).cast("bigint"))
    )
    return N.table_context(marked)


@check(
    "grid_context",
    S.with_("""cells AS (
  SELECT doc_id, row, col, 'c' || col || 'r' || row AS ref, w AS text FROM (
    SELECT conv_id AS doc_id, turn AS row, unnest(string_split(text, chr(10))) AS w,
           CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INT) AS col FROM conversations)
  WHERE trim(w) <> ''),
 shown AS (SELECT *, ref || ': ' || left(trim(text), 120) AS s FROM cells),
 above AS (SELECT doc_id, row, col, string_agg(s, ' | ' ORDER BY br) AS t FROM (
   SELECT a.doc_id, a.row, a.col, b.s, b.row AS br, row_number() OVER (PARTITION BY a.doc_id, a.row, a.col ORDER BY b.row DESC) AS r
   FROM shown a JOIN shown b ON a.doc_id = b.doc_id AND a.col = b.col AND b.row < a.row) WHERE r <= 6 GROUP BY ALL),
 left_ AS (SELECT doc_id, row, col, string_agg(s, ' | ' ORDER BY c) AS t FROM (
   SELECT a.doc_id, a.row, a.col, b.s, b.col AS c, row_number() OVER (PARTITION BY a.doc_id, a.row, a.col ORDER BY b.col DESC) AS r
   FROM shown a JOIN shown b ON a.doc_id = b.doc_id AND a.row = b.row AND b.col < a.col) WHERE r <= 6 GROUP BY ALL),
 prev AS (SELECT doc_id, row, col, string_agg(s, ' | ' ORDER BY br, bc) AS t FROM (
   SELECT a.doc_id, a.row, a.col, b.s, b.row AS br, b.col AS bc, row_number() OVER (PARTITION BY a.doc_id, a.row, a.col ORDER BY b.row DESC, b.col DESC) AS r
   FROM shown a JOIN shown b ON a.doc_id = b.doc_id AND a.row - b.row BETWEEN 1 AND 3) WHERE r <= 6 GROUP BY ALL),
 near AS (SELECT doc_id, row, col, string_agg(s, ' | ' ORDER BY br, bc) AS t FROM (
   SELECT a.doc_id, a.row, a.col, b.s, b.row AS br, b.col AS bc, row_number() OVER (PARTITION BY a.doc_id, a.row, a.col ORDER BY b.row, b.col) AS r
   FROM shown a JOIN shown b ON a.doc_id = b.doc_id AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 2 AND NOT (a.row = b.row AND a.col = b.col))
   WHERE r <= 6 GROUP BY ALL)""") + """
SELECT c.doc_id, c.row, c.col, concat_ws(chr(10), 'SHEET: chat', 'CELL: ' || c.ref, 'COLUMN_HEADERS_OR_ABOVE: ' || a.t,
  'ROW_LABELS_OR_LEFT: ' || l.t, 'PREVIOUS_ROWS: ' || p.t, 'NEARBY_CELLS: ' || n.t) AS context_text
FROM shown c LEFT JOIN above a USING (doc_id, row, col) LEFT JOIN left_ l USING (doc_id, row, col)
LEFT JOIN prev p USING (doc_id, row, col) LEFT JOIN near n USING (doc_id, row, col)""",
)
def _(spark, sf):
    turns = C.read_table(spark, sf, "conversations")
    cells = turns.select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("row"), F.posexplode(F.split("text", "\n")).alias("_i", "text")
    ).where("trim(text) <> ''")
    cells = cells.select(
        "doc_id", F.lit("chat").alias("sheet_name"), "row", (F.col("_i") + 1).alias("col"), "text",
        F.concat(F.lit("c"), (F.col("_i") + 1).cast("string"), F.lit("r"), F.col("row").cast("string")).alias("cell_ref"), F.lit("").alias("merged_range"),
    )
    return N.grid_context(cells).select("doc_id", "row", "col", "context_text")


@check(
    "nodes_in_scopes",
    S.with_(S.NODES) + """
, sheeted AS (SELECT *, CASE WHEN node_id = 0 THEN 'cover' WHEN node_id <= 3 THEN 'front' ELSE 'rest' END AS sheet_name, node_id // 5 + 1 AS page_num FROM nodes)
SELECT s.doc_id, s.node_id FROM sheeted s JOIN documents d ON d.doc_id = s.doc_id
WHERE (d.lang = 'en' AND page_num = 2) OR (d.lang = 'fr' AND sheet_name = 'front') OR (d.lang = 'de' AND sheet_name = 'cover')""",
)
def _(spark, sf):
    n = F.col("node_id")
    sheeted = C.nodes(spark, sf).withColumn(
        "sheet_name", F.when(n == 0, "cover").when(n <= 3, "front").otherwise("rest")
    ).withColumn("page_num", F.floor(n / 5).cast("bigint") + 1).withColumn("slide_index", F.lit(None).cast("int"))
    lang = F.col("lang")
    asked = C.documents(spark, sf).where(lang.isin("en", "fr", "de")).select(
        "doc_id", F.when(lang == "en", "docx:page:2").otherwise("").alias("scope"),
        F.when(lang.isin("fr", "de"), "sheet").otherwise("").alias("kind"),
        F.when(lang == "fr", "2").alias("index"), F.when(lang == "de", "cover (1)").alias("name"),
    )
    return N.nodes_for_scope(sheeted, N.normalize_scopes(asked)).select("doc_id", "node_id")


@check(
    "document_metrics",
    S.with_(S.UNITS) + f"""
, m AS (SELECT doc_id, CAST(sum(len(regexp_extract_all(text, '{S.SEARCH}'))) AS BIGINT) AS source_word_count,
  CAST(sum(length(text)) AS BIGINT) AS total_chars, 1::BIGINT AS scope_count, count(*) AS translation_unit_count FROM units GROUP BY doc_id),
 t AS (SELECT *, CAST(ceil(total_chars / 4.0) AS BIGINT) AS document_estimated_tokens FROM m),
 b AS (SELECT *, least(greatest(CAST(ceil(document_estimated_tokens * 0.125) AS BIGINT), 1024), 4096) AS prompt_memory_budget_tokens FROM t)
SELECT *, least(greatest(CAST(ceil(prompt_memory_budget_tokens * 0.25) AS BIGINT), 256), 1024) AS summary_target_tokens FROM b""",
)
def _(spark, sf):
    return scopes.memory_budget(scopes.document_metrics(C.units(spark, sf)))


@check(
    "single_names",
    S.with_(S.NODES) + f"""
, w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{S.WORD}')) AS word FROM nodes)
SELECT word FROM w WHERE regexp_full_match(word, '[A-Z][A-Za-z''/-]{{2,}}') AND NOT {S.upper_('word')} AND lower(word) NOT IN (
 {", ".join("'" + x + "'" for x in __import__('lexispan.functions.fixed', fromlist=['x']).NAME_STOPWORDS)})""",
)
def _(spark, sf):
    ws = C.nodes(spark, sf).select(F.explode(X.word_tokens("text")).alias("word")).distinct()
    return ws.where(T.single_name("word"))


@check(
    "translatable_lines",
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS lines, count(*) FILTER ({S.translatable(S.strip('line'))}) AS translatable,
  count(*) FILTER (length(trim(line)) >= 6 AND regexp_full_match(trim(line), '[!"#$%&''()*+,./0-9:;<=>?@\\[\\]^_`{{|}}~\\\\\\s-]{{3,}}')
    AND regexp_matches(line, '[!"#$%&''()*+]{{3,}}')) AS junk FROM l GROUP BY doc_id""",
)
def _(spark, sf):
    lines = C.documents(spark, sf).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(X.is_translatable("line")).alias("translatable"),
        F.count_if(Q.symbol_junk("line")).alias("junk"),
    )


@check(
    "script_counts",
    """SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z]')) AS BIGINT) AS latin, 0::BIGINT AS ko, 0::BIGINT AS kana,
  0::BIGINT AS han, 0::BIGINT AS cyrillic FROM documents""",
)
def _(spark, sf):
    return C.documents(spark, sf).select(
        "doc_id", *[v.cast("bigint").alias(k) for k, v in Q.script_counts("text").items()]
    )


SENT = r"""len(list_filter(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9\s,.;:!?()''"$%&/\-–—]{24,}'),
  lambda r: len(regexp_extract_all(r, '[A-Za-z]+(?:[''-][A-Za-z]+)?')) >= 4)) > 0"""


@check(
    "needs_translation",
    f"""SELECT doc_id, {SENT} AS into_korean, false AS into_english, {SENT} AS into_japanese, {SENT} AS into_chinese,
  regexp_matches(text, '[A-Za-z]') AS into_other, CASE lang WHEN 'en' THEN 'en' ELSE lang END AS code FROM documents""",
)
def _(spark, sf):
    named = F.when(F.col("lang") == "en", " English ").otherwise(F.upper("lang"))
    return C.documents(spark, sf).select(
        "doc_id", Q.needs_translation("text", F.lit("Korean")).alias("into_korean"),
        Q.needs_translation("text", F.lit("eng")).alias("into_english"),
        Q.needs_translation("text", F.lit("ja")).alias("into_japanese"),
        Q.needs_translation("text", F.lit("중국어")).alias("into_chinese"),
        Q.needs_translation("text", F.lit("xx")).alias("into_other"), X.normalize_language(named).alias("code"),
    )


# Hints that follow the context are cut off here; they have a query of their own.
@check(
    "contextual_units",
    S.with_(S.UNITS) + """
, n AS (SELECT doc_id, node_id, section, lag(text) OVER w AS p, lead(text) OVER w AS f FROM nodes WINDOW w AS (PARTITION BY doc_id ORDER BY node_id))
SELECT u.doc_id, u.unit_id, concat_ws(chr(10), CASE WHEN u.first_node_id > 0 THEN 'SECTION_HEADING: ' || n.section END,
  'PREVIOUS: ' || left(p, 220), 'NEXT: ' || left(f, 220)) AS context
FROM units u JOIN n ON n.doc_id = u.doc_id AND n.node_id = u.first_node_id""",
)
def _(spark, sf):
    units, _ = P.contextual_units(C.documents(spark, sf))
    plain = F.regexp_replace(F.coalesce("context_text", F.lit("")), r"(?s)\n?ABBREVIATION_HINTS: .*$", "")
    return units.select("doc_id", "unit_id", plain.alias("context"))


@check(
    "units_beside_fragments",
    S.with_(S.UNITS) + """
, x AS (SELECT doc_id, node_id, fragment_index, element_type, fragment_text, section, lag(fragment_text) OVER w AS p, lead(fragment_text) OVER w AS f
   FROM fragments WINDOW w AS (PARTITION BY doc_id, node_id ORDER BY fragment_index)),
 y AS (SELECT doc_id, element_type, fragment_text, arg_min(struct_pack(p, f, n := node_id, s := section), node_id * 1000000 + fragment_index) AS b FROM x GROUP BY ALL)
SELECT u.doc_id, u.unit_id, concat_ws(chr(10), CASE WHEN b.n > 0 THEN 'SECTION_HEADING: ' || b.s END,
  'SAME_PARAGRAPH_PREVIOUS: ' || right(trim(b.p), 260), 'SAME_PARAGRAPH_NEXT: ' || left(trim(b.f), 260)) AS context
FROM units u JOIN y ON y.doc_id = u.doc_id AND y.element_type = u.element_type AND y.fragment_text = u.text""",
)
def _(spark, sf):
    units, _ = P.contextual_units(C.documents(spark, sf), paragraph_context=False)
    plain = F.regexp_replace(F.coalesce("context_text", F.lit("")), r"(?s)\n?ABBREVIATION_HINTS: .*$", "")
    return units.select("doc_id", "unit_id", plain.alias("context"))
