"""Shape rules for term candidates and for their observed targets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as K
from .text import (
    clean_term,
    col,
    contains_term,
    contains_tokens,
    extract_acronyms,
    has_hangul,
    is_acronym,
    is_acronym_noise,
    is_mixed_case,
    is_upper,
    let,
    normalize_source,
    quote,
    single_word_term,
    starts_upper,
    strip,
    target_unit_count,
    text,
    token_count,
    words,
)

EDGE_MARKS = "()[]:;,."


def invalid_reason(term) -> Column:
    """Why a term cannot stand as a candidate; empty when it can."""

    def rules(raw, ws):
        n = F.size(ws)
        return (
            F.when((raw == "") | (n == 0), "empty")
            .when(F.lower(raw).isin(K.PLACEHOLDERS), "placeholder")
            .when(F.element_at(ws, -1).isin(K.FUNCTION_WORDS), "ends_with_function_word")
            .when(F.get(ws, F.lit(0)).isin(K.FUNCTION_WORDS), "starts_with_function_word")
            .when(is_acronym_noise(raw), "acronym_noise")
            .when((n >= 8) & ~is_acronym(raw), "too_long_sentence_like_phrase")
            .when((n >= 4) & F.exists(ws, lambda w: w.isin(K.SENTENCE_MARKERS)), "sentence_pattern")
            .otherwise("")
        )

    return let(clean_term(term), lambda raw: let(words(F.lower(raw)), lambda ws: rules(raw, ws)))


def independent_shape(term) -> Column:
    ws = words(term)
    several = F.size(ws) >= 2
    return (
        F.when(has_hangul(term), True)
        .when(is_acronym(term), ~is_acronym_noise(term))
        .otherwise(
            several
            & (
                F.forall(ws, lambda w: starts_upper(w) | is_upper(w))
                | F.exists(ws, is_mixed_case)
            )
        )
    )


def title_like(term) -> Column:
    skip = K.LEADING_STOPWORDS + K.FUNCTION_WORDS
    content = F.filter(
        F.transform(words(term), lambda w: F.btrim(w, F.lit(EDGE_MARKS))),
        lambda w: (w != "") & ~F.lower(w).isin(skip),
    )
    return let(
        content,
        lambda ws: (F.size(ws) > 0)
        & (
            F.exists(ws, has_hangul)
            | F.forall(ws, lambda w: starts_upper(w) | is_upper(w) | is_mixed_case(w))
        ),
    )


def bad_body_ngram(term) -> Column:
    lowers = F.filter(
        F.transform(words(term), lambda w: F.lower(F.btrim(w, F.lit(EDGE_MARKS)))), lambda w: w != ""
    )
    bad = let(
        lowers,
        lambda ws: (F.size(ws) == 0)
        | F.try_element_at(ws, F.lit(-1)).isin(K.FUNCTION_WORDS)
        | F.get(ws, F.lit(0)).isin(K.FUNCTION_WORDS)
        | F.exists(F.slice(ws, 2, F.size(ws)), lambda w: w.isin(K.LEADING_STOPWORDS)),
    )
    return bad | ~title_like(term)


def repeated_key_token(term) -> Column:
    keys = F.filter(
        F.transform(words(term), lambda w: F.btrim(w, F.lit("()/"))),
        lambda w: starts_upper(w) | is_upper(w) | is_mixed_case(w),
    )
    return let(keys, lambda ks: F.size(ks) != F.size(F.array_distinct(ks)))


def single_name(word) -> Column:
    """One title-case word that is no stop word."""
    w = F.btrim(text(word), F.lit(" \t\r\n,.;:()[]{}\"“”‘’"))
    return w.rlike(r"^[A-Z][A-Za-z'/-]{2,}\z") & ~is_upper(w) & ~F.lower(w).isin(K.NAME_STOPWORDS)


def valid_acronym(term, has_alias, frequency, headings, table_headers, standalone) -> Column:
    shown = (headings >= 1) | (table_headers >= 1) | (standalone >= 1)
    often = (headings >= 2) | (table_headers >= 2) | (standalone >= 2)
    return (is_acronym(term) & ~is_acronym_noise(term)) & (
        has_alias
        | F.when(F.length(term) <= 2, often).otherwise((frequency >= 2) | shown)
    )


def _has(types: Column, *names: str) -> Column:
    return F.arrays_overlap(types, F.array(*[F.lit(n) for n in names]))


def exclusion_reason(shape, term, tokens, frequency, noted, paired, acronym_ok) -> Column:
    """First rule that rejects a candidate; empty when it is kept.

    ``shape`` is what the words of the term say against it, ``noted`` whether it
    is an acronym or stands in a heading or table header, ``paired`` whether it
    stands with an abbreviation.
    """
    rare = col(frequency) < 2
    return (
        F.when(col(shape) != "", col(shape))
        .when((col(tokens) == 1) & rare & ~noted, "single_word_low_frequency")
        .when(rare & ~noted & ~paired, "low_frequency")
        .when(is_acronym(term) & ~acronym_ok, "unvalidated_acronym")
        .otherwise("")
    )


SCORE_PARTS = [
    "frequency", "chunk_coverage", "section_coverage", "heading_bonus", "table_bonus",
    "acronym_bonus", "parenthetical_bonus", "name_bonus", "phrase_bonus", "generic_penalty",
]


def score_breakdown(term, frequency, chunks, sections, types) -> Column:
    """The ten capped score parts, each rounded to four places."""
    types, n = col(types), token_count(term)
    name = _has(types, "single_titlecase_proper_noun")

    def bonus(cond, value):
        return F.when(cond, F.lit(value)).otherwise(F.lit(0.0))

    parts = [
        F.least(F.lit(0.35), col(frequency) / 5.0 * 0.35),
        F.least(F.lit(0.15), col(chunks) / 5.0 * 0.15),
        F.least(F.lit(0.10), col(sections) / 6.0 * 0.10),
        bonus(_has(types, "heading_term"), 0.20),
        bonus(_has(types, "table_header_term", "table_term"), 0.12),
        bonus(_has(types, "acronym"), 0.12),
        bonus(_has(types, "parenthetical_pair"), 0.08),
        bonus(name, 0.10),
        F.least(F.lit(0.18), F.greatest(F.lit(0), n - 1) * 0.08),
        bonus((n == 1) & ~single_word_term(term) & ~name, -0.25),
    ]
    return F.struct(*[p.cast("double").alias(k) for k, p in zip(SCORE_PARTS, parts)])


def score_total(parts: Column) -> Column:
    total = parts["frequency"]
    for name in SCORE_PARTS[1:]:
        total = total + parts[name]
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 4)


def score_rounded(parts: Column) -> Column:
    return F.struct(*[F.bround(parts[k], 4).alias(k) for k in SCORE_PARTS])


def score_reasons(parts: Column) -> Column:
    given = [F.when(F.bround(parts[k], 4) > 0, F.lit(k)) for k in SCORE_PARTS[:-1]]
    given.append(F.when(parts["generic_penalty"] != 0, F.lit("generic_penalty")))
    return F.array_compact(F.array(*given))


# --- observed targets ------------------------------------------------------


def length_ratio_bad(term, target) -> Column:
    term, target = text(term), text(target)
    units, size = target_unit_count(target), F.length(target)
    in_parens = F.regexp_like(
        target, F.concat(F.lit(r"(?iU)\(\s*"), quote(term), F.lit(r"\s*\)"))
    )
    return (
        F.when(is_acronym(term) & in_parens, (units >= 8) | (size > 45))
        .when(is_acronym(term), (units >= 5) | (size > 35))
        .when((F.greatest(token_count(term), F.lit(1)) <= 2) & (units >= 8), True)
        .otherwise(size > F.greatest(F.lit(45), F.length(term) * 4))
    )


def clause_shape(target) -> Column:
    t = strip(target)
    return (F.length(t) > 20) & (t.rlike(K.TOPIC_PREFIX) | t.rlike(K.OBJECT_PREFIX))


def expands_short_source(term, target) -> Column:
    s, t = strip(term), strip(target)
    return (
        (s != "") & (t != "") & ~is_acronym(s) & (token_count(s) == 1)
        & (normalize_source(s) != normalize_source(t))
        & contains_term(t, s) & (target_unit_count(t) >= 2)
    )


def bad_target(term, target) -> Column:
    t = strip(target)
    return (t == "") | length_ratio_bad(term, t) | clause_shape(t) | expands_short_source(term, t)


def too_short_target(term, target) -> Column:
    target = text(target)
    few = target_unit_count(target) <= 1
    n = token_count(term)
    coded = target.rlike(r"\([A-Z0-9&/-]{2,}\)")
    return (target == "") | (~is_acronym(term) & few & ((n >= 4) | ((n >= 3) & ~coded)))


def entry_sources(term, aliases) -> Column:
    """Distinct source forms, most tokens first, then longest, then by text."""
    forms = F.concat(F.array(strip(term)), F.coalesce(col(aliases), F.array().cast("array<string>")))
    forms = F.array_distinct(F.filter(F.transform(forms, lambda a: strip(a)), lambda a: a != ""))
    keyed = F.transform(
        forms, lambda a: F.struct((-token_count(a)).alias("n"), (-F.length(a)).alias("l"), a.alias("s"))
    )
    return F.transform(F.array_sort(keyed), lambda x: x["s"])


def unrelated_acronyms(target, sources) -> Column:
    """Acronyms in the target that no source form has."""
    known = F.flatten(F.transform(col(sources), extract_acronyms))
    return F.array_except(extract_acronyms(target), known)


def ambiguous_acronym(term, aliases) -> Column:
    """An acronym with two spelled-out forms that do not contain each other."""
    full = F.filter(
        F.coalesce(col(aliases), F.array().cast("array<string>")),
        lambda a: (strip(a) != "") & ~F.contains(a, F.lit("(")),
    )
    names = F.array_distinct(F.transform(full, normalize_source))
    clash = F.exists(
        names,
        lambda a: F.exists(
            names, lambda b: (a < b) & ~contains_tokens(a, b) & ~contains_tokens(b, a)
        ),
    )
    return is_acronym(term) & clash


FOREIGN_FOR_KOREAN = r"[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\u0400-\u04ff]"
FOREIGN_FOR_ENGLISH = r"[\uac00-\ud7a3\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\u0400-\u04ff]"


def unexpected_script(target, lang) -> Column:
    t, code = text(target), F.lower(strip(lang))
    return (
        F.when(code.isin("korean", "ko", "kor", "한국어"), t.rlike(FOREIGN_FOR_KOREAN))
        .when(code.isin("english", "en", "eng", "영어"), t.rlike(FOREIGN_FOR_ENGLISH))
        .otherwise(False)
    )


def storage_skip_reason(translated, candidate, lang) -> Column:
    """Why an observed translation is not kept; empty when it is."""
    t, c = text(translated), text(candidate)

    def failed(x):
        return strip(x).rlike(r"^\[(?:번역 실패|Translation failed)")

    return (
        F.when(t == "", "empty_translation")
        .when(failed(t) | failed(c), "failed_translation_marker")
        .when(unexpected_script(t, lang), "unexpected_script_in_translation")
        .when((c != "") & unexpected_script(c, lang), "unexpected_script_in_target_candidate")
        .when(c == "", "no_target_candidate")
        .otherwise("")
    )


def _split_parts(t, pattern) -> Column:
    parts = F.transform(F.split(text(t), pattern), lambda p: strip(p))
    return F.filter(parts, lambda p: p != "")


def _shortest(found) -> Column:
    keyed = F.transform(found, lambda s: F.struct(F.length(s).alias("l"), s.alias("s")))
    return F.array_min(keyed)["s"]


def _by_parenthetical(source, target, term) -> Column:
    own = F.nullif(F.regexp_extract(text(term), K.PAREN_PAIR, 2), F.lit(""))
    pair = F.coalesce(own, F.regexp_extract(text(source), K.PAREN_PAIR, 2))
    abbr = F.when(is_acronym(term), strip(term)).otherwise(clean_term(pair))
    return let(abbr, lambda a: F.when(a != "", _named_in_parens(a, target, term)))


def _named_in_parens(abbr, target, term) -> Column:
    opening = F.concat(F.lit(r"(?iU)\(\s*"), quote(abbr), F.lit(r"\s*\)"))
    # Everything before each "(ABC)": prefixes of the target that end at a match.
    pieces = F.split(text(target), opening)
    marks = F.regexp_extract_all(text(target), opening, F.lit(0))

    def prefixes(pieces, marks):
        upto = F.transform(
            F.sequence(F.lit(1), F.size(marks)),
            lambda i: F.concat_ws(
                "",
                F.transform(
                    F.slice(pieces, F.lit(1), i),
                    lambda p, j: F.when(j == 0, p).otherwise(F.concat(F.get(marks, j - 1), p)),
                ),
            ),
        )
        return F.filter(upto, lambda p: strip(p) != "")

    def tail(prefix):
        parts = _split_parts(strip(prefix), K.TARGET_BOUNDARY)
        raw = F.coalesce(F.try_element_at(parts, F.lit(-1)), strip(prefix))
        raw = F.regexp_replace(strip(raw), K.TOPIC_PREFIX, "")
        raw = F.regexp_replace(raw, K.OBJECT_PREFIX, "")
        raw = strip(F.regexp_replace(raw, K.ENGLISH_POSSESSIVE_PREFIX, ""))
        return F.regexp_replace(F.btrim(raw, F.lit(" \t\r\n,.;:()[]{}")), K.SPACES, " ")

    def good(marks):
        tails = F.transform(let(pieces, lambda p: prefixes(p, marks)), tail)
        named = F.transform(
            F.filter(tails, lambda r: r != ""), lambda r: F.concat(r, F.lit("("), abbr, F.lit(")"))
        )
        return F.filter(named, lambda c: ~bad_target(term, c))

    loose = F.regexp_extract_all(
        text(target),
        F.concat(F.lit(r"(?iU)([가-힣A-Za-z0-9·/\-&\s]{1,80}\(\s*"), quote(abbr), F.lit(r"\s*\))")),
        F.lit(1),
    )
    loose = F.filter(
        F.transform(loose, lambda m: F.btrim(m, F.lit(" ,.;:"))), lambda m: ~bad_target(term, m)
    )
    return let(marks, lambda m: F.when(F.size(m) > 0, F.coalesce(_shortest(good(m)), _shortest(loose))))


def _by_colon(source, target, term) -> Column:
    s, t = text(source), text(target)

    def side(value, i):
        head = F.substring_index(value, ":", 1)
        rest = F.substr(value, F.length(head) + 2, F.length(value))
        return strip(head if i == 0 else rest)

    hit = None
    for i in (0, 1):
        cond = (side(t, i) != "") & (
            (normalize_source(side(s, i)) == normalize_source(term)) | contains_term(side(s, i), term)
        )
        hit = F.when(cond, side(t, i)) if hit is None else hit.when(cond, side(t, i))
    return F.when(F.contains(s, F.lit(":")) & F.contains(t, F.lit(":")), hit)


def _by_parallel_split(source, target, term) -> Column:
    sp, tp = _split_parts(source, K.SOURCE_SEPARATORS), _split_parts(target, K.TARGET_SEPARATORS)
    pairs = F.arrays_zip(sp.alias("s"), tp.alias("t"))
    hits = F.filter(pairs, lambda p: normalize_source(p["s"]) == normalize_source(term))
    return F.when(F.size(sp) == F.size(tp), F.get(hits, F.lit(0))["t"])


def target_candidate(source, target, term) -> Column:
    """Target of a term in a sentence pair: parenthetical, exact, colon, parallel lists."""
    s, t = text(source), text(target)
    usable = (t != "") & (normalize_source(s) != normalize_source(t))
    exact = normalize_source(s) == normalize_source(term)
    return F.when(
        usable,
        F.coalesce(
            _by_parenthetical(s, t, term),
            F.when(exact, F.when(~bad_target(term, strip(t)), strip(t))).otherwise(
                F.coalesce(_by_colon(s, t, term), _by_parallel_split(s, t, term))
            ),
        ),
    )
