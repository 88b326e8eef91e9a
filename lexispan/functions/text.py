"""Text normalisation and counting as JVM column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as K


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lits(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def let(value: Column, use) -> Column:
    """Evaluate a value once and use it many times in an expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def rank_of(c: Column, ranks: dict, default) -> Column:
    """Look a value up in a small constant table."""
    out = None
    for value, rank in ranks.items():
        out = F.when(c == value, F.lit(rank)) if out is None else out.when(c == value, F.lit(rank))
    return out.otherwise(F.lit(default))


def text(c) -> Column:
    """Missing text counts as the empty string."""
    return F.coalesce(col(c), F.lit(""))


def strip(c, chars: str = K.SPACE_CHARS) -> Column:
    return F.btrim(text(c), F.lit(chars))


def collapse(c) -> Column:
    """Trim and reduce every run of white space to one blank."""
    return strip(F.regexp_replace(text(c), K.SPACES, " "))


def nonempty(c) -> Column:
    """Empty text becomes null, so that coalesce() skips it."""
    return F.nullif(strip(c), F.lit(""))


def normalize_source(c) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip(c)), "[-_]+", " "), K.SPACES, " ")


def document_key(c) -> Column:
    """Lower-case, white space collapsed, hyphens kept."""
    return F.lower(collapse(c))


def clean_term(c) -> Column:
    v = F.translate(text(c), "–—", "--")
    v = F.regexp_replace(v, r"(?iU)^(Table|Figure)\s+\d+\.\s*", "")
    v = F.regexp_replace(v, r"(?iU)^(Table|Figure)\s+", "")
    v = F.btrim(collapse(F.regexp_replace(v, r"(?U)\d+$", "")), F.lit(" \t\r\n,.;:()[]{}"))
    return F.regexp_replace(v, r"(?i)^(?:" + "|".join(K.LEADING_STOPWORDS) + r")(?: +|\z)", "")


def words(c) -> Column:
    """White-space words, no empties."""
    return F.filter(F.split(text(c), K.SPACES), lambda w: w != "")


def word_tokens(c) -> Column:
    return F.regexp_extract_all(text(c), F.lit(K.WORD), F.lit(0))


def token_count(c) -> Column:
    return F.regexp_count(text(c), F.lit(K.WORD))


def search_tokens(c) -> Column:
    return F.transform(F.regexp_extract_all(text(c), F.lit(K.SEARCH_TOKEN), F.lit(0)), F.lower)


def target_unit_count(c) -> Column:
    return F.regexp_count(text(c), F.lit("[가-힣A-Za-z0-9]+"))


def has_hangul(c) -> Column:
    return text(c).rlike("[가-힣]")


def is_acronym(c) -> Column:
    return strip(c).rlike(r"^[A-Z]{2,}(?:/[A-Z]{2,})?\z")


def is_acronym_noise(c) -> Column:
    return strip(c).rlike(K.ROMAN_NUMERAL)


def is_mixed_case(c) -> Column:
    """Upper and lower letters, but not in title case."""
    t = strip(c)
    upper, lower = r"\p{IsUppercase}", r"\p{IsLowercase}"
    cased = f"[{upper}{lower}]"
    not_title = f"{cased}{upper}|(?<!{cased}){lower}"
    return t.rlike(lower) & t.rlike(upper) & t.rlike(not_title)


def single_word_term(c) -> Column:
    return (
        (is_acronym(c) & ~is_acronym_noise(c))
        | is_mixed_case(c)
        | (has_hangul(c) & (F.length(strip(c)) >= 2))
    )


def is_upper(c) -> Column:
    t = text(c)
    return t.rlike(r"\p{IsUppercase}") & ~t.rlike(r"\p{IsLowercase}")


def starts_upper(c) -> Column:
    return text(c).rlike(r"^\p{IsUppercase}")


def extract_acronyms(c) -> Column:
    found = F.regexp_extract_all(text(c), F.lit(K.ACRONYM), F.lit(0))
    return F.array_distinct(F.filter(found, lambda a: ~is_acronym_noise(a)))


def quote(c) -> Column:
    """Escape a text so that it stands for itself inside a pattern."""
    return F.regexp_replace(text(c), r"([\\^$.|?*+()\[\]{}#&~-])", r"\\$1")


def term_pattern(term) -> Column:
    """Whole-word pattern; letters, digits and Hangul syllables are word characters."""
    return F.concat(F.lit("(?iu)" + K.EDGE_LEFT), quote(term), F.lit(K.EDGE_RIGHT))


def contains_term(t, term) -> Column:
    t, term = text(t), text(term)
    # The plain containment test is cheap and rejects nearly every row.
    return (term != "") & F.contains(F.lower(t), F.lower(term)) & F.regexp_like(t, term_pattern(term))


def contains_key(normalized_text, key) -> Column:
    """Whole-word containment between texts that are already document keys."""
    t, k = text(normalized_text), text(key)
    pattern = F.concat(F.lit("(?<![a-z0-9])"), quote(k), F.lit("(?![a-z0-9])"))
    return (k != "") & F.contains(t, k) & F.regexp_like(t, pattern)


def plain_count(haystack, needle) -> Column:
    """Non-overlapping plain occurrences of one text in another."""
    h, n = text(haystack), text(needle)
    removed = F.length(h) - F.length(F.replace(h, n, F.lit("")))
    return F.when(n == "", 0).otherwise((removed / F.length(n)).cast("int"))


def count_term(t, term) -> Column:
    """Whole-word occurrences of a term, ignoring case."""
    plain = plain_count(F.lower(text(t)), F.lower(text(term)))
    return F.when(plain == 0, 0).otherwise(F.regexp_count(text(t), term_pattern(term)))


def frequency_in_unit(t, term) -> Column:
    """Occurrences of a term that was extracted from this text: never below one.

    One plain occurrence gives one whichever way the word edges fall, so the
    pattern only runs for repeated terms.
    """
    plain = plain_count(F.lower(text(t)), F.lower(text(term)))
    exact = F.when(plain > 1, F.regexp_count(text(t), term_pattern(term))).otherwise(F.lit(1))
    return F.greatest(exact, F.lit(1))


def contains_tokens(container, item) -> Column:
    """The item's tokens are a shorter run inside the container's tokens."""
    c = F.array_join(words(normalize_source(container)), " ")
    i = F.array_join(words(normalize_source(item)), " ")
    inside = F.contains(F.concat(F.lit(" "), c, F.lit(" ")), F.concat(F.lit(" "), i, F.lit(" ")))
    return (i != "") & inside & (F.size(F.split(i, " ")) < F.size(F.split(c, " ")))


def segment_keys(t) -> Column:
    """Normalised cleaned segments of a text, and the whole text itself."""
    parts = F.concat(F.split(text(t), K.SEGMENT_SPLIT), F.array(text(t)))
    return F.array_distinct(F.transform(parts, lambda s: normalize_source(clean_term(s))))


def standalone(t, term) -> Column:
    return F.array_contains(segment_keys(t), normalize_source(term))


def clean_evidence(c) -> Column:
    return collapse(F.regexp_replace(collapse(c), K.CONTEXT_LABEL + r"\s*", ""))


def estimate_tokens(c) -> Column:
    return F.ceil(F.length(text(c)) / 4)


def source_base(c, possessive: bool = False) -> Column:
    """First word of a term, when it is longer than two characters and not a number."""
    first = F.get(F.split(document_key(c), " "), F.lit(0))
    if possessive:
        first = F.regexp_replace(first, "(?:'s|’s)$", "")
    return F.when((F.length(first) <= 2) | first.rlike(r"(?U)^\d+\z"), "").otherwise(text(first))


def family_key(c) -> Column:
    k = F.regexp_replace(document_key(c), r"^(?:the|a|an) +", "")
    return F.regexp_replace(k, "(?:'s|’s)$", "")


def safe_float(c) -> Column:
    return col(c).cast("string").try_cast("double")


def safe_int(c) -> Column:
    return F.bround(safe_float(c), 0).try_cast("bigint")


def merge_lists(a, b, limit: int | None = None) -> Column:
    """Ordered distinct union of two lists, cut to a limit."""
    empty = F.array().cast("array<string>")
    merged = F.array_distinct(F.concat(F.coalesce(col(a), empty), F.coalesce(col(b), empty)))
    return merged if limit is None else F.slice(merged, 1, limit)


def cleanup_translation(c) -> Column:
    """No blank before a Korean particle or an acronym in parentheses."""
    t = F.regexp_replace(text(c), r"(?U)([가-힣A-Za-z0-9])\s+\(([A-Z0-9&/.-]{2,})\)", "$1($2)")
    return F.regexp_replace(
        t,
        r"(?U)([A-Za-z0-9&/.-]+|\([A-Z0-9&/.-]{2,}\))\s+"
        r"(은|는|이|가|을|를|와|과|로|으로|에|에서|에게|부터|까지)(?=\s|$|[,.!?;:)\]])",
        "$1$2",
    )


def normalize_language(c) -> Column:
    t = F.lower(strip(c))
    out = None
    for code, names in K.LANGUAGE_ALIASES.items():
        out = F.when(t.isin(names), code) if out is None else out.when(t.isin(names), code)
    return out.otherwise(t)


def is_translatable(c) -> Column:
    """Not blank, no formula, not only numbers and money, no web or mail address."""
    t = strip(c)
    return (
        (t != "")
        & ~F.startswith(t, F.lit("="))
        & ~t.rlike(r"(?U)^[\d\s.,%+\-$€£¥₩:/()]+$")
        & ~t.rlike(r"^https?://")
        & ~t.rlike(r"(?U)^[^@\s]+@[^@\s]+\.[^@\s]+$")
    )


def try_int(c) -> Column:
    """Whole number or null; no decimals, as for a parsed id."""
    t = strip(c)
    return F.when(t.rlike(r"^[+-]?\d+\z"), t.try_cast("bigint"))
