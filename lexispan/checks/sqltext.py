"""SQL spellings of the text rules, and the common table expressions of the twins."""

from __future__ import annotations

from ..functions import fixed as K

WORD = "[A-Za-z][A-Za-z0-9&''/-]*|[가-힣][가-힣0-9·/-]*"
SEARCH = "[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)*|[가-힣]+"
SEG = r"[,;:.!?。！？()\[\]\n\r]+"
STARTERS = "('the','this','that','these','those','a','an')"
FUNCTION = "('and','or','of','in','to','for','with','by','from','as')"
MARKERS = (
    "['am','are','be','been','being','can','could','did','do','does','had','has','have','is','may','might',"
    "'must','shall','should','was','were','will','would']"
)


def strip(x):
    return f"trim({x}, e' \\t\\n\\r')"


#: White space, and letters, digits and marks beyond ASCII, as patterns with ``(?U)`` see them.
BLANK = "[\\t-\\r \\x{85}\\p{Z}]"
WIDE_WORD = "[\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}\\x{200C}\\x{200D}\\x{24B6}-\\x{24E9}\\x{1F130}-\\x{1F149}\\x{1F150}-\\x{1F169}\\x{1F170}-\\x{1F189}]"


def strip_wide(x):
    """Trim all white space, that beyond ASCII as well."""
    return f"trim({x}, '{K.SPACE_CHARS}')"


def collapse_wide(x):
    return strip_wide(f"regexp_replace({x}, '{BLANK}+', ' ', 'g')")


def ascii_edges(x):
    """Letters beyond ASCII as 1, other such characters as blanks, so that ASCII word edges fall where those with ``(?U)`` do."""
    return f"regexp_replace(regexp_replace({x}, '[^\\x00-\\x7F{WIDE_WORD[1:-1]}]', ' ', 'g'), '[^\\x00-\\x7F]', '1', 'g')"


def collapse(x):
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'), e' \\t\\n\\r')"


def dkey(x):
    return f"lower({collapse(x)})"


def norm(x):
    return f"regexp_replace(regexp_replace(lower({strip(x)}), '[-_]+', ' ', 'g'), '\\s+', ' ', 'g')"


def clean(x):
    v = f"replace(replace({x}, '–', '-'), '—', '-')"
    v = f"regexp_replace({v}, '(?i)^(table|figure)\\s+\\d+\\.\\s*', '')"
    v = f"regexp_replace({v}, '(?i)^(table|figure)\\s+', '')"
    v = f"trim({collapse(f'regexp_replace({v}, chr(92)||chr(100)||chr(43)||chr(36), chr(0))')}, e' \\t\\r\\n,.;:()[]{{}}')"
    v = v.replace("chr(92)||chr(100)||chr(43)||chr(36), chr(0)", "'\\d+$', ''")
    return f"regexp_replace({v}, '(?i)^(?:the|this|that|these|those|a|an)(?: +|$)', '')"


def tokens(x):
    return f"len(regexp_extract_all({x}, '{WORD}'))"


def search_tokens(x):
    return f"list_transform(regexp_extract_all({x}, '{SEARCH}'), lambda t: lower(t))"


def is_acronym(x):
    return f"regexp_full_match({strip(x)}, '[A-Z]{{2,}}(?:/[A-Z]{{2,}})?')"


def noise(x):
    return f"regexp_full_match({strip(x)}, '(?i)(?:i|ii|iii|iv|v|vi|vii|viii|ix|x)')"


def upper_(x):
    return f"(upper({x}) = {x} and lower({x}) <> {x})"


def mixed(x):
    t = strip(x)
    return (
        f"(regexp_matches({t}, '\\p{{Lu}}') and regexp_matches({t}, '\\p{{Ll}}') and "
        f"regexp_matches({t}, '[\\p{{Lu}}\\p{{Ll}}]\\p{{Lu}}|(?:^|[^\\p{{Lu}}\\p{{Ll}}])\\p{{Ll}}'))"
    )


def signal(w):
    return f"(regexp_matches({w}, '^\\p{{Lu}}') or {upper_(w)})"


def words(x):
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"


def edge_contains(t, term):
    """Whole-word containment, ignoring case."""
    return (
        f"(contains(lower({t}), lower({term})) and regexp_matches({t}, '(?i)(?:^|[^A-Za-z0-9가-힣])' || "
        f"regexp_escape({term}) || '(?:$|[^A-Za-z0-9가-힣])'))"
    )


def edge_count(t, term):
    """Whole-word count: doubled edges let neighbours share a blank."""
    def twice(x):
        return f"regexp_replace({x}, '([^A-Za-z0-9가-힣])', '\\1\\1', 'g')"

    return (
        f"len(regexp_extract_all({twice(t)}, '(?i)(?:^|[^A-Za-z0-9가-힣])' || regexp_escape({twice(term)}) || "
        f"'(?:$|[^A-Za-z0-9가-힣])'))"
    )


def plain_count(t, term):
    return f"((length({t}) - length(replace({t}, {term}, ''))) // greatest(length({term}), 1))"


def translatable(x):
    return (
        f"({x} <> '' and not starts_with({x}, '=') and not regexp_full_match({x}, '[\\d\\s.,%+\\-$€£¥₩:/()]+') "
        f"and not regexp_matches({x}, '^https?://') and not regexp_full_match({x}, '[^@\\s]+@[^@\\s]+\\.[^@\\s]+'))"
    )


def glossary_like(x):
    """Lines that map terms: by words, a Korean phrase, an arrow, a colon before Han, kana or Hangul, or a set phrase."""
    edge = f"0-9A-Za-z_{WIDE_WORD[1:-1]}"
    terms = (
        f"(?i)(?:^|[^{edge}])(?:glossary|terminology|term{BLANK}+mapping|source[- ]target|source{BLANK}+term|target{BLANK}+term|"
        f"preferred{BLANK}+target|preferred{BLANK}+translation|do[- ]not[- ]use|blocked{BLANK}+target|"
        f"translate(?:d)?{BLANK}+(?:as|to)|render(?:ed)?{BLANK}+(?:as|to))(?:$|[^{edge}])"
    )
    korean = f"(?:로|으로|라고){BLANK}*(?:번역|표기|렌더링)|번역(?:어|명|표현){BLANK}*(?:결정|매핑|고정|유지)"
    phrases = "must be translated|should be translated|keep the translation|use the translation|translate consistently as"
    line = strip_wide(f"regexp_replace({strip_wide(x)}, '^[-*]+', '')")
    left = strip_wide(f"string_split({line}, ':')[1]")
    right = strip_wide(f"substr({line}, strpos({line}, ':') + 1)")
    colon = (
        f"CASE WHEN NOT contains({x}, ':') THEN false ELSE ({left} <> '' AND {right} <> '' AND length({left}) <= 70 AND length({right}) <= 120 "
        f"AND NOT regexp_matches(lower({left}), '^(?:section|clause|chapter|part|annex|table|figure|fig\\.|wave|scope|page|pp\\.)') "
        f"AND len(regexp_extract_all({left}, '{SEARCH}')) BETWEEN 1 AND 8 AND len(regexp_extract_all({right}, '{SEARCH}')) <= 16 "
        f"AND regexp_matches({right}, '[가-힣一-龥ぁ-ゟ゠-ヿ]') AND NOT ends_with({line}, '.')) END"
    )
    return (
        f"({strip_wide(x)} <> '' AND (regexp_matches({x}, '{terms}') OR regexp_matches({x}, '{korean}') "
        f"OR regexp_matches({strip_wide(x)}, '{BLANK}(?:->|=>|=){BLANK}') OR regexp_matches(lower({x}), '{phrases}') OR {colon}))"
    )


NODES = f"""
lines AS (
  SELECT doc_id, {strip('line')} AS text, pos FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
           generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
nodes AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS node_id, text,
         first_value(text) OVER (PARTITION BY doc_id ORDER BY pos) AS section
  FROM lines WHERE {translatable('text')}),
typed AS (SELECT *, CASE WHEN node_id = 0 THEN 'heading' ELSE 'paragraph' END AS element_type FROM nodes)
"""


def pack(pieces, limit):
    """Greedy joining of a list; pieces that start with chr(2) stay alone."""
    return (
        f"list_transform(string_split(list_reduce({pieces}, lambda a, s: CASE WHEN starts_with(s, chr(2)) "
        f"OR starts_with(string_split(a, chr(1))[-1], chr(2)) "
        f"OR length(string_split(a, chr(1))[-1]) + 1 + length(s) > {limit} "
        f"THEN a || chr(1) || s ELSE a || ' ' || s END), chr(1)), lambda c: replace(c, chr(2), ''))"
    )


FRAGMENTS = NODES + f""",
sentences AS (
  SELECT *, list_filter(list_transform(string_split(regexp_replace(text, '([.!?。！？])\\s+', '\\1' || chr(3), 'g'), chr(3)),
                lambda s: trim(s)), lambda s: s <> '') AS ss FROM typed),
pieces AS (
  SELECT *, CASE WHEN length(text) <= 500 THEN [text]
    WHEN len(ss) <= 1 THEN {pack("list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')", 800)}
    ELSE {pack("flatten(list_transform(ss, lambda s: CASE WHEN length(s) > 800 THEN list_transform(" + pack("list_filter(string_split_regex(s, '\\s+'), lambda w: w <> '')", 800) + ", lambda c: chr(2) || c) ELSE [s] END))", 800)}
    END AS fs FROM sentences),
fragments AS (
  SELECT doc_id, node_id, section, element_type, text AS node_text, len(fs) AS fragment_count,
         unnest(fs) AS fragment_text, generate_subscripts(fs, 1) - 1 AS fragment_index FROM pieces)
"""

UNITS = FRAGMENTS + """,
firsts AS (
  SELECT doc_id, element_type, fragment_text, min(node_id * 1000000 + fragment_index) AS place, count(*) AS target_count,
         arg_min(section, node_id * 1000000 + fragment_index) AS section FROM fragments GROUP BY ALL),
units AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS unit_id, fragment_text AS text,
         element_type, section, target_count, place // 1000000 AS first_node_id FROM firsts)
"""

GLOSSARY = NODES + """,
glossary AS (
  SELECT doc_id, word AS source_term, count(*) AS frequency, min(node_id) AS first_node FROM (
    SELECT doc_id, node_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{3,}')) AS word FROM nodes)
  GROUP BY doc_id, word HAVING count(*) >= 2),
terms AS (
  SELECT doc_id, source_term, frequency, 'g_' || lower(source_term) AS term_id, [upper(source_term)] AS aliases,
         CASE WHEN frequency >= 4 THEN 'locked' WHEN frequency = 3 THEN 'soft_locked' ELSE 'pending' END AS bucket,
         source_term || 'um' AS target_term, 1 AS token_count, frequency AS match_priority,
         least(1.0, frequency / 10.0)::DOUBLE AS candidate_score,
         row_number() OVER (PARTITION BY doc_id ORDER BY frequency DESC, source_term) AS term_order
  FROM glossary),
entries AS (
  SELECT doc_id, 'e_' || lower(source_term) AS term_id, term_order AS entry_order, source_term, frequency,
         [source_term, 'the ' || lower(source_term)] AS source_terms,
         CASE WHEN frequency = 2 THEN 'raw_evidence_candidate' WHEN frequency = 3 THEN 'term' ELSE 'analysis_candidate' END AS memory_kind,
         CASE WHEN frequency = 2 THEN 'analysis_hint' WHEN frequency = 3 THEN 'review_required' ELSE 'preferred' END AS status,
         CASE WHEN frequency >= 3 THEN upper(source_term) END AS preferred_target,
         CASE WHEN frequency = 2 THEN '' ELSE 'seen ' || frequency || ' times' END AS meaning,
         frequency = 3 AS needs_review, candidate_score AS confidence
  FROM terms)
"""

PAIRS = """
pairs AS (
  SELECT a.conv_id AS doc_id, a.turn AS unit_id, a.text AS original, b.text AS translated, 'paragraph' AS element_type
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
  WHERE a.role = 'user')
"""

USAGE = """
usage AS (
  SELECT user_id AS job_id, event_id AS turn, event_type AS model, ts,
         greatest(coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0), 0) AS prompt_tokens,
         greatest(coalesce(CAST(trunc(value) AS BIGINT), 0), 0) AS completion_tokens FROM events),
usage_rows AS (SELECT * FROM usage WHERE prompt_tokens > 0 OR completion_tokens > 0),
prices AS (SELECT * FROM (VALUES ('view', 1.0, 4.0), ('click', 2.0, 6.0), ('purchase', 1.0, 3.0), ('signup', 3.0, 5.0))
           p(model, input_usd_per_1m, output_usd_per_1m))
"""

EVENTS = """
job_events AS (
  SELECT user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS event_id, ts, value,
         CASE event_type WHEN 'signup' THEN 'translation_started' WHEN 'purchase' THEN 'completed'
              WHEN 'error' THEN 'job_error' ELSE 'blocks_translated' END AS event,
         json_extract_string(props, '$.k') AS k FROM events)
"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip().rstrip(",") for p in parts)
