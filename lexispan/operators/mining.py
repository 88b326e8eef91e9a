"""Term mining: candidates per unit, statistics, exclusion, score, pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed as K
from ..functions.evidence import evidence_context, short_snippet
from ..functions.terms import (
    exclusion_reason,
    score_breakdown,
    score_reasons,
    score_rounded,
    score_total,
    single_name,
    valid_acronym,
)
from ..functions.text import (
    clean_term,
    collapse,
    frequency_in_unit,
    is_acronym_noise,
    let,
    normalize_source,
    strip,
    text,
    token_count,
    words,
)
from ..session import materialize
from .mining_kernel import MADE, candidates_of, keys_of
from .nodes import container_id, container_type
from .ordering import dense_number
from .term_shape_kernel import shape_reasons

# A candidate's types are one bit each, so that they merge with bit_or.
TYPE_BITS = {
    "acronym": 1, "parenthetical_pair": 2, "single_titlecase_proper_noun": 4, "repeated_phrase": 8,
    "proper_noun": 16, "heading_term": 32, "table_header_term": 64, "body_ngram": 128,
    "body_proper_noun": 256, "table_term": 512,
}
B = TYPE_BITS


def type_names(bits) -> Column:
    bits = F.col(bits) if isinstance(bits, str) else bits
    named = [F.when(bits.bitwiseAND(F.lit(v)) > 0, F.lit(k)) for k, v in sorted(B.items())]
    return F.array_compact(F.array(*named))


def korean_words(tokens: Column) -> Column:
    """Word tokens of a Korean segment without particles and predicate endings."""

    def stem(w):
        t = F.when(w.rlike("[가-힣]"), F.regexp_replace(w, K.KOREAN_PARTICLE_END, "")).otherwise(w)
        out = None
        for ending in K.KOREAN_PREDICATE_ENDINGS:
            cond = w.rlike("[가-힣]") & F.endswith(t, F.lit(ending)) & (F.length(t) > len(ending) + 1)
            cut = F.left(t, F.length(t) - len(ending))
            out = F.when(cond, cut) if out is None else out.when(cond, cut)
        return strip(out.otherwise(t))

    return F.filter(F.transform(tokens, stem), lambda w: F.length(w) >= 2)


def segment_words(t, korean: bool = False) -> Column:
    """Word tokens of every segment of a text."""

    def tokens(s):
        found = F.regexp_extract_all(s, F.lit(K.WORD), F.lit(0))
        return korean_words(found) if korean else found

    return F.transform(F.split(text(t), K.SEGMENT_SPLIT), tokens)


def paren_pairs(t, pattern: str = K.PAREN_PAIR) -> Column:
    """Full form and abbreviation of every ``Full Form (ABC)`` in a text."""
    full = F.regexp_extract_all(t, F.lit(pattern), F.lit(1))
    abbr = F.regexp_extract_all(t, F.lit(pattern), F.lit(2))
    cleaned = F.zip_with(
        full, abbr, lambda a, b: F.struct(clean_term(a).alias("full"), clean_term(b).alias("abbr"))
    )
    return F.filter(cleaned, lambda p: (p["full"] != "") | (p["abbr"] != ""))


def extract_candidates(units: DataFrame, korean: bool = False, carry: list[str] | None = None) -> DataFrame:
    """One row per unit and candidate key, with per-unit counts.

    Columns find words, pairs and acronyms; word runs are spelled and merged by
    key inside the unit before any shuffle (``mining_kernel.py``). The surface is
    the first one seen, replaced by a later one that is longer or all upper case.
    ``carry`` names the columns of the unit that go on each row, all by default.
    """
    carry = units.columns if carry is None else carry
    rows = _parts_of_units(units, korean, carry)
    schema = T.StructType([*(rows.schema[c] for c in carry), *T.StructType.fromDDL(MADE).fields])
    found = rows.mapInArrow(lambda batches: candidates_of(batches, carry, korean, B), schema)
    return found.withColumn("place_bits", place_bits("element_type", "is_header", F.col("raw_bits")))


def candidate_keys(units: DataFrame, carry: list[str], korean: bool = False) -> DataFrame:
    """One row per unit and candidate key, without its counts and forms."""
    rows = _parts_of_units(units, korean, carry)
    schema = T.StructType([*(rows.schema[c] for c in carry), T.StructField("normalized_source", T.StringType())])
    return rows.mapInArrow(lambda batches: keys_of(batches, carry, korean, B), schema)


def _parts_of_units(units: DataFrame, korean: bool, carry: list[str]) -> DataFrame:
    """Texts of units with what columns find in them."""
    flat = collapse("text")
    pairs = paren_pairs(flat)
    if korean:
        pairs = F.concat(pairs, paren_pairs(flat, K.KOREAN_PAREN_PAIR))
    pairs = F.when(F.contains("text", F.lit("(")), pairs).otherwise(F.array().cast("array<struct<full:string,abbr:string>>"))
    acronyms = F.transform(
        F.filter(F.regexp_extract_all(flat, F.lit(K.ACRONYM), F.lit(0)), lambda a: ~is_acronym_noise(a)), clean_term
    )
    none = F.array().cast("array<array<string>>")
    return units.where(strip("text") != "").select(
        *carry, F.col("text").alias("_text"), flat.alias("_flat"), pairs.alias("_pairs"), acronyms.alias("_acronyms"),
        (segment_words(flat, True) if korean else none).alias("_segments"), (segment_words("text", True) if korean else none).alias("_raw"),
    )


def place_bits(element_type: str, is_header: str, bits: Column) -> Column:
    """Types that a candidate has by where its unit stands."""
    element = text(element_type)
    heading, header = element.isin(K.HEADING_ELEMENTS), F.coalesce(F.col(is_header), F.lit(False))
    table = element.isin(K.TABLE_ELEMENTS)
    phrase = bits.bitwiseAND(F.lit(B["repeated_phrase"] | B["acronym"] | B["parenthetical_pair"])) == B["repeated_phrase"]
    named = bits.bitwiseAND(F.lit(B["single_titlecase_proper_noun"])) > 0
    body = ~heading & ~table & ~header
    placed = [(heading, "heading_term"), (header, "table_header_term"), (body & phrase, "body_ngram"), (body & named, "body_proper_noun"), (table, "table_term")]
    out = F.lit(0)
    for holds, name in placed:
        out = out.bitwiseOR(F.when(holds, B[name]).otherwise(0))
    return out


def hashed_places(rows: DataFrame) -> DataFrame:
    """Chunks and sections as 64-bit hashes; rows that have these stay as they are."""
    if "_chunk" in rows.columns:
        return rows
    hashed = lambda c: F.when(c.isNotNull(), F.xxhash64(c))
    return rows.withColumns({"_chunk": hashed(F.col("chunk_id")), "_section": hashed(F.nullif(strip("section"), F.lit("")))}).drop("chunk_id", "section")


def term_stats(candidates: DataFrame, keys: list[str], units: DataFrame, unit_key: list[str]) -> DataFrame:
    """Statistics per group and term; counts combine on the map side.

    Frequencies follow the first surface form: where the forms of a term differ
    (a hyphen against a blank), its units are counted again for the first form.
    Forms, chunks and sections go through the shuffle as 64-bit hashes, of which
    only the least and the greatest are kept; terms for which these differ have
    theirs counted. ``candidates`` is read twice and should be written before.
    """
    element = text("element_type")
    order = [c for c in unit_key if c not in keys]
    slim = hashed_places(candidates).withColumn("_form", F.xxhash64(F.lower("surface")))
    bounds = [f(f"_{name}").alias(f"_{name}{i}") for name in ("form", "chunk", "section") for i, f in enumerate((F.min, F.max))]
    stats = materialize(slim.groupBy(*keys, "normalized_source").agg(
        F.min(F.struct(*order, "surface")).alias("_first"), F.count(F.lit(1)).alias("unit_count"), F.sum("unit_frequency").alias("_frequency"),
        *bounds,
        F.count_if(element.isin(K.HEADING_ELEMENTS)).alias("heading_count"),
        F.count_if(F.coalesce(F.col("is_header"), F.lit(False))).alias("table_header_count"),
        F.count_if(element.isin(K.TABLE_ELEMENTS)).alias("table_count"),
        F.count_if("is_standalone").alias("standalone_occurrence_count"),
        F.bit_or(F.col("raw_bits").bitwiseOR(F.col("place_bits"))).alias("_bits"),
        F.max("has_alias").alias("_aliased"),
    ))
    term = [*keys, "normalized_source"]
    # Terms with several forms, chunks or sections meet their rows once; what is counted apart reads those.
    differ = [F.coalesce(F.col(f"_{n}0") < F.col(f"_{n}1"), F.lit(False)).alias(f"_{n}_differs") for n in ("form", "chunk", "section")]
    several = stats.select(*term, *differ, F.col("_first.surface").alias("_source")).where("_form_differs or _chunk_differs or _section_differs")
    rows = materialize(slim.select(*term, *order, "_chunk", "_section").join(several, term))

    def apart(name: str) -> DataFrame:
        """Distinct values of terms that have more than one."""
        values = rows.where(f"_{name}_differs and _{name} is not null").select(*term, f"_{name}").distinct()
        return values.groupBy(*term).agg(F.count(F.lit(1)).alias(f"_{name}s"))

    bodies = units.select(*unit_key, F.col("text").alias("_body"))
    places = rows.where("_form_differs").select(*term, *order, "_source")
    again = places.join(bodies, unit_key).groupBy(*term).agg(F.sum(frequency_in_unit("_body", F.col("_source"))).alias("_exact"))
    stats = stats.join(apart("chunk"), term, "left").join(apart("section"), term, "left").join(again, term, "left")
    one = lambda name: F.coalesce(f"_{name}s", F.col(f"_{name}0").isNotNull().cast("bigint")).alias(f"{name}_count")
    stats = stats.select("*", one("chunk"), one("section"), F.coalesce("_exact", "_frequency").alias("frequency"))
    source = F.col("_first.surface")
    exact_acronym = source.rlike(r"^[A-Z][A-Z0-9&/-]+\z") & ~is_acronym_noise(source)
    bits = (
        F.col("_bits")
        .bitwiseOR(F.when(exact_acronym, B["acronym"]).otherwise(0))
        .bitwiseOR(F.when(token_count(source) > 1, B["repeated_phrase"]).otherwise(0))
    )
    noted = B["acronym"] | B["repeated_phrase"] | B["heading_term"] | B["table_header_term"] | B["table_term"]
    # A term with no other sign is taken for a proper noun.
    bits = bits.bitwiseOR(F.when(bits.bitwiseAND(F.lit(noted)) == 0, B["proper_noun"]).otherwise(0))
    return stats.select(
        *keys, "normalized_source", source.alias("source_term"),
        "frequency", "unit_count", "chunk_count", "section_count", "heading_count", "table_header_count", "table_count",
        "standalone_occurrence_count", bits.alias("type_bits"), F.col("_bits").alias("raw_bits"),
        F.col("_aliased").alias("has_alias"), token_count(source).alias("token_count"),
    )


def term_aliases(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct alias forms per term."""
    forms = candidates.where(F.size("aliases") > 0).select(
        *keys, "normalized_source", F.explode("aliases").alias("alias")
    ).distinct()
    return forms.groupBy(*keys, "normalized_source").agg(F.array_sort(F.collect_list("alias")).alias("aliases"))


def judge_candidates(stats: DataFrame) -> DataFrame:
    """Add ``filter_reason``: the first rule that excludes a candidate, or empty."""
    ok = valid_acronym(
        F.col("source_term"), F.col("has_alias"), F.col("frequency"), F.col("heading_count"),
        F.col("table_header_count"), F.col("standalone_occurrence_count"),
    )
    has = lambda *names: F.col("type_bits").bitwiseAND(F.lit(sum(B[n] for n in names))) > 0
    shape = shape_reasons("source_term", "token_count", has("single_titlecase_proper_noun"), has("body_ngram"))
    noted = has("acronym", "heading_term", "table_header_term")
    reason = exclusion_reason("_shape", "source_term", "token_count", "frequency", noted, has("parenthetical_pair"), ok)
    return stats.withColumn("_shape", shape).withColumn("filter_reason", reason).drop("_shape")


def exclusion_report(judged: DataFrame) -> DataFrame:
    return judged.where("filter_reason <> ''").groupBy("filter_reason").agg(
        F.count(F.lit(1)).alias("terms"), F.sum("frequency").alias("frequency")
    )


def score_terms(judged: DataFrame) -> DataFrame:
    """Score, breakdown, reasons and match priority of the kept candidates."""
    parts = score_breakdown("source_term", "frequency", "chunk_count", "section_count", "candidate_types")
    kept = judged.where("filter_reason = ''").withColumn("candidate_types", type_names("type_bits")).withColumn("_p", parts)
    score = score_total(F.col("_p"))
    return kept.select(
        *[c for c in judged.columns if c != "filter_reason"], "candidate_types",
        score.alias("candidate_score"),
        F.floor(F.col("token_count") * 100 + score * 100).cast("bigint").alias("match_priority"),
        score_rounded(F.col("_p")).alias("score_breakdown"),
        F.array_sort(F.array_union(score_reasons(F.col("_p")), type_names("raw_bits"))).alias("reason"),
    )


def number_terms(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Total order by frequency, tokens and key, with ``term_001`` ids."""
    out = _number(scored, keys)
    return out.withColumn("term_id", F.format_string("term_%03d", "term_order"))


def _number(scored: DataFrame, keys: list[str]) -> DataFrame:
    shifted = scored.withColumn("_t", -F.col("token_count"))
    # Blocks follow the sort order: exact frequencies, with the long tail of rare
    # terms cut by the leading characters of the key.
    f = F.col("frequency")
    tail = F.when(f <= 8, F.concat(F.lpad((20 + F.col("_t")).cast("string"), 2, "0"), F.left("normalized_source", F.lit(2))))
    block = F.concat(F.lpad((F.lit(10**12) - f).cast("string"), 13, "0"), F.coalesce(tail, F.lit("")))
    out = dense_number(
        shifted.withColumn("_f", -f), keys, ["_f", "_t", "normalized_source"], "term_order", 1, block=block
    )
    return out.drop("_f", "_t")


def prune_nested(terms: DataFrame, keys: list[str]) -> DataFrame:
    """Drop a term inside a longer one with at least 80 % of its frequency.

    Longer terms offer their shorter word runs (at most twenty per six-word
    term); an equi-join on the run replaces the comparison of all pairs.
    """
    ws = words(normalize_source("source_term"))
    runs = let(ws, lambda w: shorter_runs(w, F.size(w) - 1))
    kept = [c for c in terms.columns if c not in keys]
    own = F.struct(*kept)
    none = F.lit(None).cast(terms.select(own.alias("x")).schema["x"].dataType)
    offers = F.when(
        F.size(ws) >= 2, F.transform(runs, lambda r: F.struct(r.alias("run"), none.alias("own")))
    ).otherwise(F.array().cast(f"array<struct<run:string,own:{none_type(terms, own)}>>"))
    itself = F.array(F.struct(F.array_join(ws, " ").alias("run"), own.alias("own")))
    spread = terms.select(
        *keys, F.col("frequency").alias("_f"), F.col("token_count").alias("_n"), F.explode(F.concat(itself, offers)).alias("_o"),
    ).withColumn("_run", F.col("_o.run"))
    # One shuffle on the run: the term itself meets the best frequency offered by
    # longer terms of each length; no list of containers is kept.
    dealt = spread.repartition(*keys, "_run")
    by_length = dealt.groupBy(*keys, "_run", "_n").agg(
        F.collect_list("_o.own").alias("_own"), F.max(F.when(F.col("_o.own").isNull(), F.col("_f"))).alias("_f")
    )
    met = by_length.groupBy(*keys, "_run").agg(
        F.flatten(F.collect_list("_own")).alias("_own"), F.collect_list(F.struct("_n", "_f")).alias("_best")
    )
    rows = met.where(F.size("_own") > 0).select(*keys, F.explode("_own").alias("_own"), "_best")
    t = F.col("_own")
    longer = F.filter("_best", lambda b: (b["_n"] > F.col("_own.token_count")) & b["_f"].isNotNull())
    best = F.array_max(F.transform(longer, lambda b: b["_f"]))
    open_term = (t["standalone_occurrence_count"] <= 0) & ~t["has_alias"] & (t["token_count"] > 0)
    nested = open_term & (best >= F.greatest(F.lit(1.0), t["frequency"] * 0.8))
    return rows.where(~F.coalesce(nested, F.lit(False))).select(*keys, "_own.*")


def shorter_runs(ws: Column, longest: Column) -> Column:
    """Distinct word runs of one to ``longest`` words."""
    return F.array_distinct(
        F.flatten(
            F.transform(
                F.sequence(F.lit(1), longest),
                lambda n: F.transform(
                    F.sequence(F.lit(1), F.size(ws) - n + 1), lambda i: F.array_join(F.slice(ws, i, n), " ")
                ),
            )
        )
    )


def none_type(df: DataFrame, value: Column) -> str:
    return df.select(value.alias("x")).schema["x"].dataType.simpleString()


def occurrences_in(units: DataFrame, terms: DataFrame, keys: list[str]) -> DataFrame:
    """Evidence rows of the kept terms in units; few candidates are kept, so texts join them afterwards."""
    unit_key = list(dict.fromkeys([*keys, "doc_id", "unit_id"]))
    found = candidate_keys(units, unit_key)
    kept = found.join(terms.select(*keys, "normalized_source"), [*keys, "normalized_source"], "left_semi")
    return term_occurrences(materialize(kept).join(units, unit_key), terms, keys)


def term_occurrences(candidates: DataFrame, terms: DataFrame, keys: list[str]) -> DataFrame:
    """Evidence rows of the kept terms."""
    kept = terms.select(*keys, "normalized_source", "source_term")
    rows = candidates.join(kept, [*keys, "normalized_source"])
    around = evidence_context("text", "context_text", "source_term")
    none = F.lit(None).cast("int")
    return rows.withColumn("_e", F.coalesce(F.nullif(around, F.lit("")), "text")).select(
        *keys, "normalized_source", "source_term", "unit_id", "chunk_id", "section",
        F.when(strip("section") != "", F.array("section")).otherwise(F.array().cast("array<string>")).alias("section_path"),
        "element_type",
        container_type("element_type", "table_index", none, F.lit(""), F.lit(""), F.lit(""), "source").alias("container_type"),
        container_id("doc_format", "table_index", none, F.lit(""), F.lit(""), "source").alias("container_id"),
        "table_title", "is_header",
        short_snippet(F.col("_e"), "source_term", 360).alias("source_snippet"),
        short_snippet(F.col("_e"), "source_term", 520).alias("surrounding_source"),
        F.lit("source_occurrence").alias("evidence_type"),
    )


def sample_evenly(df: DataFrame, keys: list[str], order: list[str], n: int = K.MAX_OCCURRENCES) -> DataFrame:
    """At most n rows per group, spread evenly from the first to the last.

    Positions and group sizes come from block numbering, so a group of any size
    is cut without gathering it.
    """
    numbered = dense_number(df, keys, order, "_i")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    small = F.col("_n") <= n
    if n == 1:
        return numbered.where("_i = 0").drop("_i")
    # Row i is picked when some slot s rounds to it: s lies next to i * (n - 1) / last.
    last = F.col("_n") - 1
    guess = F.floor(F.col("_i") * (n - 1) / last)
    hit = F.exists(
        F.transform(F.array(*[F.lit(d) for d in (-1, 0, 1, 2)]), lambda d: guess + d),
        lambda s: (s >= 0) & (s <= n - 1) & (F.bround(s * last / F.lit(float(n - 1)), 0) == F.col("_i")),
    )
    return numbered.join(sizes, keys).where(small | hit).drop("_i", "_n")
