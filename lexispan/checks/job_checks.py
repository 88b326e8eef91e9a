"""Checks of jobs, usage, scopes, style rules, memory text and model answers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import batching
from ..operators import jobs as J
from ..operators import scopes as SC
from ..operators import units as U
from ..operators.ordering import dense_number, neighbours
from ..operators.translator import mock
from ..plans import pipelines as P
from ..sources.tables import read_table
from . import corpus as C
from . import sqltext as S
from .memory_checks import INSIDE, node_units
from .mining_checks import SECT, SELECTED, SELECTION, sections
from .registry import check

E = S.with_(S.EVENTS)
U_ = S.with_(S.USAGE)


@check("numbered_events", E + " SELECT job_id, event_id, event, ts FROM job_events")
def _(spark, sf):
    return C.job_events(spark, sf).select("job_id", "event_id", "event", "ts")


@check("replayed_events", E + " SELECT job_id, event_id, event FROM job_events WHERE event_id > 20")
def _(spark, sf):
    return J.replay_events(C.job_events(spark, sf), 20).select("job_id", "event_id", "event")


@check("job_state", E + """
SELECT job_id, coalesce(CASE arg_max(event, event_id) FILTER (event <> 'blocks_translated') WHEN 'translation_started' THEN 'translating'
  WHEN 'completed' THEN 'done' WHEN 'job_error' THEN 'error' END, 'pending') AS status, count(*) AS event_count, arg_max(event, event_id) AS last_event
FROM job_events GROUP BY job_id""")
def _(spark, sf):
    return J.job_state(C.job_events(spark, sf)).select("job_id", "status", "event_count", "last_event")


@check("job_payload", """
SELECT user_id AS job_id, key, CASE key WHEN 'k' THEN k ELSE kind END AS value FROM (
  SELECT user_id, arg_max(json_extract_string(props, '$.k'), (ts, event_id)) AS k, arg_max(event_type, (ts, event_id)) AS kind FROM events GROUP BY user_id),
  (SELECT unnest(['k', 'kind']) AS key)""")
def _(spark, sf):
    return J.job_payload(C.job_events(spark, sf))


@check("light_payload", "SELECT event_id, 'k|kind' AS keys FROM events")
def _(spark, sf):
    rows = J.drop_heavy(C.raw_job_events(spark, sf), "data")
    return rows.select(F.col("seq").alias("event_id"), F.array_join(F.array_sort(F.map_keys("data")), "|").alias("keys"))


@check("compact_records", """
SELECT event_id, nullif(CASE WHEN event_type = 'view' THEN '' ELSE event_type END, '') AS event_type, CASE WHEN event_type = 'view' THEN 'k' ELSE 'k|t' END AS keys FROM events""")
def _(spark, sf):
    kind = F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type"))
    rows = C.read_table(spark, sf, "events").select(
        "event_id", kind.alias("event_type"), F.create_map(F.lit("k"), F.col("props"), F.lit("t"), kind).alias("m")
    )
    out = J.compact(rows, ["event_type", "m"])
    return out.select("event_id", "event_type", F.array_join(F.array_sort(F.map_keys("m")), "|").alias("keys"))


@check("safe_numbers", """
SELECT event_id, CAST(round_even(value, 0) AS BIGINT) AS whole, CASE WHEN event_type = 'view' THEN NULL ELSE round(value, 4) END AS number FROM events""")
def _(spark, sf):
    shown = F.when(F.col("event_type") == "view", F.concat(F.lit("n/a "), F.col("value").cast("string"))).otherwise(F.col("value").cast("string"))
    return C.read_table(spark, sf, "events").select(
        "event_id", X.safe_int("value").alias("whole"), F.round(X.safe_float(shown), 4).alias("number")
    )


@check("normalized_errors", """
SELECT event_id, CASE event_type WHEN 'view' THEN props WHEN 'click' THEN 'click failed' ELSE '문서 번역 중 오류가 발생했습니다.' END AS msg,
  CASE event_type WHEN 'view' THEN '08001001' WHEN 'click' THEN '08003002' WHEN 'error' THEN 'odd' ELSE '08099000' END AS error_code,
  CASE event_type WHEN 'view' THEN 'model_call' WHEN 'click' THEN 'pipeline' ELSE 'unknown' END AS error_family FROM events""")
def _(spark, sf):
    kind = F.col("event_type")
    data = F.create_map(
        F.lit("msg"), F.lit(""), F.lit("error"), F.when(kind == "view", F.col("props")).otherwise(""),
        F.lit("detail"), F.when(kind == "click", "click failed").otherwise(""),
        F.lit("error_code"), F.when(kind == "view", "08001001").when(kind == "click", "08003002").when(kind == "error", "odd").otherwise(""),
    )
    rows = C.read_table(spark, sf, "events").select("event_id", data.alias("data"))
    return J.normalize_errors(rows).select("event_id", "msg", "error_code", "error_family")


@check("job_outcomes", S.with_(S.EVENTS, S.USAGE) + """
, e AS (SELECT job_id, min(ts) AS t0, min(event_id) FILTER (event IN ('completed', 'job_error')) AS last FROM job_events GROUP BY job_id HAVING last IS NOT NULL),
 u AS (SELECT job_id, CAST(sum(prompt_tokens) AS BIGINT) AS p, CAST(sum(completion_tokens) AS BIGINT) AS c FROM usage_rows GROUP BY job_id)
SELECT e.job_id, CASE j.event WHEN 'completed' THEN 'done' ELSE 'error' END AS outcome, CAST((epoch_us(j.ts) - epoch_us(e.t0)) // 1000 AS BIGINT) AS elapsed_ms,
  coalesce(p, 0) AS prompt_tokens, coalesce(c, 0) AS completion_tokens FROM e JOIN job_events j ON j.job_id = e.job_id AND j.event_id = e.last LEFT JOIN u ON u.job_id = e.job_id""")
def _(spark, sf):
    return J.job_outcomes(C.job_events(spark, sf), C.usage(spark, sf))


@check("live_progress", E + """
, p AS (SELECT job_id, count(*) FILTER (event = 'blocks_translated') AS done, count(*) + 10 AS total, CAST((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS BIGINT) AS ms FROM job_events GROUP BY job_id)
SELECT job_id, done AS progress_completed, total AS progress_total, round_even((done / total * 100.0)::DOUBLE, 1) AS progress_percent,
  CASE WHEN done > 0 THEN CAST(floor(ms / done * (total - done)) AS BIGINT) END AS eta_ms, ms AS progress_elapsed_ms FROM p""")
def _(spark, sf):
    events = C.job_events(spark, sf)
    totals = events.groupBy("job_id").agg((F.count(F.lit(1)) + 10).alias("total_units"))
    return J.live_progress(events.withColumn("units", F.lit(1)).join(totals, "job_id"))


@check("priced_usage", U_ + """
SELECT turn, u.model, prompt_tokens, completion_tokens, p.model IS NOT NULL AS known_model,
  round(coalesce(prompt_tokens / 1000000.0 * input_usd_per_1m + completion_tokens / 1000000.0 * output_usd_per_1m, 0)::DOUBLE, 10) AS cost_usd
FROM usage_rows u LEFT JOIN prices p ON p.model = u.model""")
def _(spark, sf):
    rows = J.price_usage(C.usage(spark, sf), C.prices(spark))
    return rows.select("turn", "model", "prompt_tokens", "completion_tokens", "known_model", F.round("cost_usd", 10).alias("cost_usd"))


@check("usage_by_model", U_ + """
SELECT u.job_id, u.model, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
  CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS total_tokens, count(*) AS turns, any_value(p.model) IS NOT NULL AS known_model,
  round(coalesce(sum(prompt_tokens) / 1000000.0 * any_value(input_usd_per_1m) + sum(completion_tokens) / 1000000.0 * any_value(output_usd_per_1m), 0)::DOUBLE, 6) AS cost_usd
FROM usage_rows u LEFT JOIN prices p ON p.model = u.model GROUP BY u.job_id, u.model""")
def _(spark, sf):
    return J.usage_cost(C.usage(spark, sf), C.prices(spark))


@check("usage_totals", U_ + """
, m AS (SELECT job_id, model, CAST(sum(prompt_tokens) AS BIGINT) AS pt, CAST(sum(completion_tokens) AS BIGINT) AS ct FROM usage_rows GROUP BY ALL)
SELECT job_id, CAST(sum(pt) AS BIGINT) AS prompt_tokens, CAST(sum(ct) AS BIGINT) AS completion_tokens, CAST(sum(pt + ct) AS BIGINT) AS total_tokens,
  count(*) FILTER (p.model IS NULL) AS unpriced_models,
  round_even((sum(coalesce(pt / 1000000.0 * input_usd_per_1m + ct / 1000000.0 * output_usd_per_1m, 0)) * 1400)::DOUBLE, 4) AS credit
FROM m LEFT JOIN prices p ON p.model = m.model GROUP BY job_id""")
def _(spark, sf):
    return J.usage_totals(C.usage(spark, sf), C.prices(spark), 1400.0).withColumn("credit", F.bround("credit", 4))


@check("next_versions", """
SELECT user_id AS job_id, coalesce(max(CASE WHEN event_type = 'purchase' THEN event_id END) + 1, 1) AS next_version FROM events GROUP BY user_id""")
def _(spark, sf):
    events = C.read_table(spark, sf, "events").select(F.col("user_id").alias("job_id"), "event_type", F.col("event_id").alias("version"))
    return J.next_version(events, events.where("event_type = 'purchase'"))


@check("reused_memory", """
SELECT user_id AS job_id, bool_or(event_type = 'signup') AS reused, count(*) FILTER (event_type = 'signup') AS stored FROM events GROUP BY user_id""")
def _(spark, sf):
    events = C.read_table(spark, sf, "events").select(F.col("user_id").alias("job_id"), "event_type")
    stored = events.where("event_type = 'signup'").groupBy("job_id").agg(F.count(F.lit(1)).alias("stored"))
    return J.reuse_or_compute(events, stored, lambda jobs: jobs.withColumn("stored", F.lit(0).cast("bigint")))


@check("session_state", """
WITH l AS (SELECT user_id AS session_id, event_type AS key, arg_max(value, (ts, event_id)) AS value, max(ts) AS t FROM events GROUP BY ALL)
SELECT session_id, key, round(value, 6) AS value FROM l WHERE epoch_us(timestamp '2024-01-30 00:00:00') - epoch_us(t) <= 21600000000 * 8""")
def _(spark, sf):
    changes = C.read_table(spark, sf, "events").select(
        F.col("user_id").alias("session_id"), F.col("event_type").alias("key"), "value", F.col("ts").alias("updated_at"),
        F.lit(21600 * 8).alias("ttl_seconds"), F.col("event_id").alias("change_id"),
    )
    now = F.lit("2024-01-30 00:00:00").cast("timestamp")
    return J.latest_session_state(changes, now).select("session_id", "key", F.round("value", 6).alias("value"))


# --- scopes -----------------------------------------------------------------

ROLL = S.with_("""
p AS (SELECT a.conv_id AS job_id, a.turn AS o, trim(a.text) AS s, trim(b.text) AS t FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user'),
 r AS (SELECT job_id, o, 1::BIGINT AS item_count, CAST(len(regexp_extract_all(s, '""" + S.SEARCH + """')) AS BIGINT) AS word_count, length(s) + length(t) AS char_count FROM p)""")


def scope_rows(spark, sf):
    p = C.pairs(spark, sf).select(
        F.col("doc_id").alias("job_id"), F.concat(F.lit("turn:"), F.col("unit_id").cast("string")).alias("scope"),
        F.col("unit_id").alias("scope_order"), "original", "translated",
    )
    return SC.scope_rollup(p)


@check("scope_rollup", ROLL + """
SELECT job_id, 'turn:' || o AS scope, item_count, word_count, char_count, CAST(sum(word_count) OVER w AS BIGINT) AS memory_word_count,
  CAST(sum(char_count) OVER w AS BIGINT) AS memory_char_count FROM r WINDOW w AS (PARTITION BY job_id ORDER BY o)""")
def _(spark, sf):
    return scope_rows(spark, sf).drop("scope_order")


@check("recent_scopes", ROLL + """
SELECT job_id, 'turn:' || o AS scope, recency FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY o DESC) AS recency FROM r) WHERE recency <= 2""")
def _(spark, sf):
    return SC.recent_scopes(scope_rows(spark, sf), 2).select("job_id", "scope", F.col("recency").cast("bigint").alias("recency"))


@check("batch_element_types", S.with_(S.NODES) + """
SELECT doc_id, CASE WHEN bool_or(node_id > 0 AND length(text) < 60) THEN CASE WHEN bool_or(node_id > 0 AND length(text) >= 60) THEN 'heading,list_item,paragraph,zone' ELSE 'heading,list_item,zone' END
  WHEN bool_or(node_id > 0 AND length(text) >= 60) THEN 'heading,paragraph' ELSE 'heading' END AS element_types FROM nodes GROUP BY doc_id""")
def _(spark, sf):
    n = C.nodes(spark, sf)
    short = (F.col("node_id") > 0) & (F.length("text") < 60)
    kinds = F.when(F.col("node_id") == 0, F.array(F.lit("heading"))).when(short, F.array(F.lit("zone"), F.lit("list_item"))).otherwise(F.array(F.lit("paragraph")))
    return SC.batch_element_types(n.select("doc_id", F.explode(kinds).alias("element_type")), ["doc_id"])


RULES = [
    ("base", None, [], 5, "keep numbers", None), ("base", None, ["heading"], 9, "short headings", None),
    ("tone", "formal", [], 7, "formal tone", None), ("tone", "plain", [], 7, "plain tone", None),
    ("base", None, ["paragraph"], 8, "full sentences", {"tone": "formal"}), ("base", None, [], 6, "never", {"tone": "plain"}),
]


@check("style_rules", S.with_(S.NODES) + """
SELECT doc_id, node_id, CASE WHEN node_id = 0 THEN 'short headings|formal tone|keep numbers' ELSE 'full sentences|formal tone|keep numbers' END AS rules FROM nodes""")
def _(spark, sf):
    rules = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(RULES)],
        "rule_order int, category string, value string, element_types array<string>, priority int, rule string, `when` map<string,string>",
    )
    out = SC.applicable_rules(C.nodes(spark, sf), rules, {"tone": "formal"}, ["doc_id", "node_id"])
    return out.select("doc_id", "node_id", F.array_join("rules", "|").alias("rules"))


@check("memory_lines", S.with_(S.NODES) + f"""
, k AS (SELECT doc_id, node_id, CASE WHEN node_id = 0 THEN 'Tone' ELSE '**Open References**' END AS label,
  CASE WHEN length(text) > 200 THEN text WHEN length(text) > 100 THEN 'Name = ' || text ELSE 'Use the translation ' || text END AS line FROM nodes)
SELECT doc_id, node_id, CASE WHEN node_id = 0 THEN 'Style continuity' ELSE 'Open references' END AS label, {S.glossary_like('line')} AS glossary_like FROM k""")
def _(spark, sf):
    t, n = F.col("text"), F.length("text")
    line = F.when(n > 200, t).when(n > 100, F.concat(F.lit("Name = "), t)).otherwise(F.concat(F.lit("Use the translation "), t))
    label = F.when(F.col("node_id") == 0, "Tone").otherwise("**Open References**")
    return C.nodes(spark, sf).select(
        "doc_id", "node_id", SC.memory_label(label).alias("label"), SC.glossary_like(line).alias("glossary_like")
    )


@check("sanitized_memory", S.with_(S.NODES) + f"""
, s AS (SELECT doc_id, node_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace({S.strip_wide("'Alpha = Beta. ' || text")},
    '([.!?。！？]){S.BLANK}+', '\\1' || chr(3), 'g'), '\\n+', chr(3), 'g'), chr(3)),
  lambda x: trim(x, e' \\t\\r\\n-•')), lambda x: x <> '' AND NOT {S.glossary_like('x')}) AS l FROM nodes)
SELECT doc_id, node_id, {S.strip_wide("array_to_string(l[1:8], ' ')")} AS memory FROM s""")
def _(spark, sf):
    return C.nodes(spark, sf).select("doc_id", "node_id", SC.sanitize_memory(F.concat(F.lit("Alpha = Beta. "), "text")).alias("memory"))


@check("batch_payload", S.with_(S.NODES) + """
SELECT doc_id, count(*) AS items, true AS valid, arg_min(text, node_id) AS first_text FROM nodes GROUP BY doc_id""")
def _(spark, sf):
    p = SC.batch_payload(node_units(spark, sf), ["doc_id"])
    return p.select(
        "doc_id", F.json_array_length("payload").cast("bigint").alias("items"), F.try_parse_json("payload").isNotNull().alias("valid"),
        F.get_json_object("payload", "$[0].s").alias("first_text"),
    )


@check("response_items", S.with_(S.PAIRS) + """
SELECT doc_id, unit_id, '0' AS id, CASE WHEN length(original) > 200 THEN NULL ELSE translated END AS t, CASE WHEN length(original) > 200 THEN translated END AS translation FROM pairs""")
def _(spark, sf):
    p = C.pairs(spark, sf)
    long = F.length("original") > 200
    item = F.when(long, F.to_json(F.struct(F.lit(0).alias("id"), F.col("translated").alias("translation")))).otherwise(
        F.to_json(F.struct(F.lit(0).alias("id"), F.col("translated").alias("t")))
    )
    answer = F.when(long, F.concat(F.lit('Sure: {"items": ['), item, F.lit("]} done"))).otherwise(F.concat(F.lit("```json\n["), item, F.lit("]\n```")))
    got = SC.response_items(p.select("doc_id", "unit_id", answer.alias("response")), ["doc_id", "unit_id"])
    return got.select("doc_id", "unit_id", "id", "t", "translation")


@check("output_cleanup", S.with_(S.NODES) + """
SELECT doc_id, node_id, 'NATO는 ' || regexp_replace(text || ' x (ABC)', '([가-힣A-Za-z0-9])\\s+\\(([A-Z0-9&/.-]{2,})\\)', '\\1(\\2)', 'g') AS cleaned FROM nodes""")
def _(spark, sf):
    return C.nodes(spark, sf).select(
        "doc_id", "node_id", X.cleanup_translation(F.concat(F.lit("NATO 는 "), "text", F.lit(" x (ABC)"))).alias("cleaned")
    )


@check("abbreviation_hints", S.with_(S.NODES) + """
, w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{5,}')) AS word FROM nodes),
 g AS (SELECT doc_id, word FROM w WHERE regexp_full_match(word, '[A-Z][a-z]+'))
, first_ AS (SELECT doc_id, min(word) AS word FROM g GROUP BY doc_id)
SELECT doc_id, 'ABBREVIATION_HINTS: ' || left(word, 4) || '. = ' || word AS hint FROM first_""")
def _(spark, sf):
    w = C.nodes(spark, sf).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{5,}"), F.lit(0))).alias("word"))
    first = w.groupBy("doc_id").agg(F.min("word").alias("word"))
    hint = U.abbreviation_hints(F.concat(F.lit("see "), F.left("word", F.lit(4)), F.lit(". now")), F.concat_ws(" ", F.lit("about"), "word", F.concat("word", F.lit("er"))))
    return first.select("doc_id", hint.alias("hint"))


# A turn becomes speech of its first name to its last one; turns with quotation marks of their own are left out.
# Only what the SQL twin can say; dialogue_hints_of_turns and dialogue_hints_of_lines are the whole job.
QUOTED, ADDRESSED = "[\"”’“‘']", "\\bto\\s+[A-Z]"
FAMILY, PEER, RITE = (
    w.replace(" ", "|") for w in (
        "mother father parent parents sister brother daughter son child children family newchild baby", "friend classmate peer groupmate",
        "instructor teacher class community ceremony committee elder chief assignment apology apologize anthem ritual",
    )
)
PRONOUNS = "('he', 'she', 'they', 'it', 'we', 'i', 'you')"


@check("dialogue_hints", f"""
WITH c AS (SELECT conv_id, turn, text, regexp_extract_all(text, '[A-Z][a-z]{{2,}}') AS w,
   coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS before FROM conversations),
n AS (SELECT *, w[1] AS a, w[len(w)] AS b FROM c
   WHERE len(w) >= 2 AND NOT regexp_matches(text, '{QUOTED.replace("'", "''")}') AND NOT regexp_matches(text, '{ADDRESSED}'))
SELECT conv_id, turn, true AS direct, CASE WHEN lower(a) IN {PRONOUNS} THEN NULL ELSE a END AS speaker,
  CASE WHEN lower(b) IN {PRONOUNS} THEN NULL ELSE b END AS listener,
  nullif(concat_ws(', ', CASE WHEN regexp_matches(before || chr(10) || text, '(?i)\\b(?:{FAMILY})\\b') THEN 'family_or_caregiver_child' END,
   CASE WHEN regexp_matches(before || chr(10) || text, '(?i)\\b(?:{PEER})\\b') THEN 'peer_or_friend' END,
   CASE WHEN regexp_matches(text, '(?i)\\b(?:{RITE})\\b') THEN 'institutional_or_ritualized' END), '') AS cues FROM n""")
def _(spark, sf):
    turns = read_table(spark, sf, "conversations")
    names = F.regexp_extract_all("text", F.lit("[A-Z][a-z]{2,}"), F.lit(0))
    before = F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    named = turns.select("conv_id", "turn", "text", before.alias("before"), names.alias("w")).where(
        (F.size("w") >= 2) & ~F.col("text").rlike(QUOTED) & ~F.col("text").rlike(ADDRESSED)
    )
    line = F.concat(F.lit("“"), "text", F.lit("” "), F.get("w", F.lit(0)), F.lit(" said to "), F.element_at("w", -1))
    hint = U.dialogue_hint(line, F.col("before"), F.lit("paragraph"), F.lit("docx"))
    return named.select("conv_id", "turn", hint.alias("h")).select(
        "conv_id", "turn", F.col("h.is_direct_speech").alias("direct"), F.col("h.speaker_candidate").alias("speaker"),
        F.col("h.listener_candidate").alias("listener"), F.col("h.local_relation_cues").alias("cues"),
    )


HINT_FIELDS = {
    "direct": "is_direct_speech", "register": "register_hint", "speaker": "speaker_candidate",
    "listener": "listener_candidate", "cues": "local_relation_cues",
}


def turn_hints(turns):
    """Hint of every turn's own text, beside the turn before; null where a turn holds no direct speech."""
    placed = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    numbered = dense_number(turns.where(placed), ["conv_id"], ["turn", "text"], "_n")
    near = neighbours(numbered, ["conv_id"], "_n", {"before": ("text", -1)}).select("conv_id", "turn", "text", "before")
    loose = turns.where(~placed).select("conv_id", "turn", "text", F.lit(None).cast("string").alias("before"))
    hint = U.dialogue_hint("text", "before", F.lit("paragraph"), F.lit("docx"))
    return near.unionByName(loose).withColumn("h", hint).select("conv_id", "turn", *[F.col(f"h.{v}").alias(k) for k, v in HINT_FIELDS.items()])


def line_hints(nodes):
    """Hint of every line of every document, beside the line before."""
    near = neighbours(nodes.select("doc_id", "node_id", "text", "element_type", "doc_format"), ["doc_id"], "node_id", {"before": ("text", -1)})
    hint = U.dialogue_hint("text", "before", "element_type", "doc_format")
    return near.withColumn("h", hint).select("doc_id", "node_id", *[F.col(f"h.{v}").alias(k) for k, v in HINT_FIELDS.items()])


# Every row, unchanged; SQL cannot say these patterns, so there is no twin and the tests hold them against brute force.
@check("dialogue_hints_of_turns")
def _(spark, sf):
    return turn_hints(read_table(spark, sf, "conversations"))


@check("dialogue_hints_of_lines")
def _(spark, sf):
    return line_hints(C.nodes(spark, sf))


UNIT_WALK = """,
walk AS (
  SELECT doc_id, node_id, 1::BIGINT AS batch_id, 1 AS items, length(text) + 100 AS chars FROM nodes WHERE node_id = 0
  UNION ALL
  SELECT n.doc_id, n.node_id,
    CASE WHEN w.items >= 24 OR w.chars + length(n.text) + 100 > 9000 THEN w.batch_id + 1 ELSE w.batch_id END,
    CASE WHEN w.items >= 24 OR w.chars + length(n.text) + 100 > 9000 THEN 1 ELSE w.items + 1 END,
    CASE WHEN w.items >= 24 OR w.chars + length(n.text) + 100 > 9000 THEN length(n.text) + 100 ELSE w.chars + length(n.text) + 100 END
  FROM walk w JOIN nodes n ON n.doc_id = w.doc_id AND n.node_id = w.node_id + 1)
"""


@check("unit_batches", "WITH RECURSIVE " + S.NODES.strip() + UNIT_WALK + "SELECT doc_id, node_id AS unit_id, batch_id FROM walk")
def _(spark, sf):
    return batching.assign_unit_batches(node_units(spark, sf)).select("doc_id", "unit_id", "batch_id")


@check("evaluated_documents", S.with_(S.UNITS) + f"""
, t AS (SELECT f.doc_id, unit_id, node_id, u.text FROM fragments f JOIN units u ON u.doc_id = f.doc_id AND u.element_type = f.element_type AND u.text = f.fragment_text)
SELECT t.doc_id, unit_id, node_id, t.text AS source_text, '[ko] ' || t.text AS translated FROM t JOIN documents USING (doc_id)
WHERE {__import__('lexispan.checks.text_checks', fromlist=['SENT']).SENT.replace('regexp_extract_all(text,', 'regexp_extract_all(documents.text,')}""")
def _(spark, sf):
    return P.evaluate(C.documents(spark, sf), "ko", mock).select("doc_id", "unit_id", "node_id", "source_text", "translated")


@check("translation_modes", S.with_(S.UNITS) + " SELECT doc_id, unit_id, text AS noop, '[fr] ' || text AS mock FROM units")
def _(spark, sf):
    u = C.units(spark, sf)
    return U.translate_noop(u).withColumnRenamed("translated", "noop").join(
        U.translate_mock(u, "fr").withColumnRenamed("translated", "mock"), ["doc_id", "unit_id"]
    )


@check("translation_context", "WITH RECURSIVE " + S.GLOSSARY.strip() + "," + INSIDE + UNIT_WALK + """
, r AS (SELECT doc_id, batch_id, term_id, row_number() OVER (PARTITION BY doc_id, batch_id ORDER BY
    CASE WHEN preferred_target IS NULL THEN 0 ELSE 1 END DESC, CASE status WHEN 'preferred' THEN 90 WHEN 'review_required' THEN 55 ELSE 20 END DESC,
    length(source_term) DESC, entry_order) AS rank
  FROM (SELECT DISTINCT i.doc_id, w.batch_id, i.term_id FROM inside i JOIN walk w ON w.doc_id = i.doc_id AND w.node_id = i.unit_id)
  JOIN entries USING (doc_id, term_id) WHERE frequency >= 3)
SELECT doc_id, batch_id, term_id, rank FROM r WHERE rank <= 12""")
def _(spark, sf):
    terms = _context(spark, sf)[0]
    return terms.select("doc_id", "batch_id", "term_id", F.col("rank").cast("bigint").alias("rank"))


@check("translation_sections", "WITH RECURSIVE " + S.NODES.strip() + UNIT_WALK.rstrip() + ",\n" + SECT.strip() + """,
q AS (SELECT w.doc_id AS job_id, w.batch_id AS query_id, string_agg(n.text, chr(10) ORDER BY n.node_id) AS query
  FROM walk w JOIN nodes n ON n.doc_id = w.doc_id AND n.node_id = w.node_id WHERE w.doc_id IN (SELECT job_id FROM sections) GROUP BY ALL),
""" + SELECTION + SELECTED)
def _(spark, sf):
    found = _context(spark, sf)[1]
    return found.select("job_id", "query_id", F.col("section_index").cast("bigint").alias("section_index"), "branch")


def _context(spark, sf):
    rows = sections(spark, sf).withColumn("job_id", F.col("job_id").cast("bigint"))
    return P.translation_context(node_units(spark, sf), C.entries(spark, sf), rows)
