"""Candidates and statistics against a walk over the units in plain Python."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lexispan.operators import mining
from lexispan.operators import mining_kernel as kernel
from lexispan.plans.pipelines import judge_units


def units(spark, seed, korean=False):
    rng = random.Random(seed)
    latin = ["Data", "data-base", "Data Base", "Data-Base", "the", "The Server", "NATO", "Table 4.", "of", "Model7", "x_y", "McDonald", "Foo-", "été", "A/B", "İstanbul"]
    hangul = ["서버에서", "보안을", "검토합니다", "데이터", "API", "시스템은"]
    joins = [" ", " ", " ", ", ", ". ", "; ", "\n", " (", ") ", "  "]
    rows = []
    for i in range(120):
        text = "".join(rng.choice(hangul if korean and rng.random() < 0.7 else latin) + rng.choice(joins) for _ in range(rng.randrange(25)))
        rows.append((i % 3, i, text if i % 11 else None, rng.choice(["paragraph", "heading", "table_cell", None]), rng.choice([True, False, None]), f"c{i % 4}", rng.choice(["", "s1", "s2", None])))
    return spark.createDataFrame(rows, "doc_id long, unit_id long, text string, element_type string, is_header boolean, chunk_id string, section string").repartition(3)


def count(text, term):
    return len(re.findall(r"(?<![A-Za-z0-9가-힣])" + re.escape(term) + r"(?![A-Za-z0-9가-힣])", text, re.I))


def test_statistics_follow_the_first_form(spark):
    """Frequency, chunks and sections of every term, with hyphened and blank forms in one group."""
    data = units(spark, 1)
    texts = {(r["doc_id"], r["unit_id"]): r["text"] for r in data.collect()}
    groups = defaultdict(list)
    rows = mining.extract_candidates(data).collect()
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["unit_id"])):
        groups[r["doc_id"], r["normalized_source"]].append(r)
    want = {}
    for k, rs in groups.items():
        first = rs[0]["surface"]
        frequency = sum(count(texts[r["doc_id"], r["unit_id"]], first) or 1 for r in rs)
        sections = {r["section"] for r in rs if r["section"]}
        want[k] = (first, frequency, len(rs), len({r["chunk_id"] for r in rs}), len(sections), any(r["aliases"] for r in rs))
    stats = judge_units(data, ["doc_id"])
    assert {
        (r["doc_id"], r["normalized_source"]): (r["source_term"], r["frequency"], r["unit_count"], r["chunk_count"], r["section_count"], r["has_alias"])
        for r in stats.collect()
    } == want
    mixed = [k for k, rs in groups.items() if len({r["surface"].lower() for r in rs}) > 1]
    assert mixed and any(want[k][1] != len(groups[k]) for k in mixed)


def test_runs_span_a_signal():
    rng = random.Random(4)
    for _ in range(300):
        ws = [rng.choice(["a", "B", "c", "D-e", "서버"]) for _ in range(rng.randrange(12))]
        for korean, pattern in ((False, "^[A-Z]"), (True, "[가-힣]|^[A-Z]")):
            want = [" ".join(ws[i : i + n]) for n in range(2, 7) for i in range(len(ws) - n + 1) if any(re.search(pattern, w) for w in ws[i : i + n])]
            assert [run for run, _ in kernel.runs_of(ws, korean)] == want


def test_occurrences():
    rng = random.Random(5)
    for _ in range(500):
        text = "".join(rng.choice(["Ab", "ab", " ", "-", "é", "가", "x"]) for _ in range(rng.randrange(2, 20)))
        term = rng.choice(["Ab", "ab-ab", "é", "x x"])
        plain = text.lower().count(term.lower())
        assert kernel.occurrences(text, text.lower(), term) == (max(1, count(text, term)) if plain > 1 else 1)


@pytest.mark.parametrize("korean", [False, True])
def test_clean_and_key_agree_with_columns(spark, korean):
    """What the kernel does to a word run is what the column expressions do."""
    from lexispan.functions.text import clean_term, normalize_source

    rng = random.Random(6)
    words = ["Table", "figure", "The", "the", "a", "Data-Base", "x7", "Foo-", "A--B", "İstanbul", "서버", "9", "An", "Model77", "von"]
    runs = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 6))) for _ in range(400)]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(runs)], "i int, run string").select("i", clean_term("run").alias("c"), normalize_source(clean_term("run")).alias("k")).orderBy("i").collect()
    for run, r in zip(runs, rows):
        got = kernel.cleaned(run, run.split(" ")[0])
        assert (got, kernel.keyed(got)) == (r["c"], r["k"]), run


def test_segment_keys_agree_with_columns(spark):
    from lexispan.functions.text import segment_keys

    rng = random.Random(7)
    parts = ["Table 4. ", "The ", "data–base", "x_y", " \u00a0", "\x1c", "\u3000", "(", "), ", "9", "서버", "\n", "Model 77", "a--B ", "."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", segment_keys("text").alias("k")).orderBy("i").collect()
    for text, r in zip(texts, rows):
        assert kernel.segment_keys(text) == set(r["k"]), repr(text)


def test_korean_counts_use_stems(spark):
    data = units(spark, 2, korean=True).where("text is not null")
    rows = mining.extract_candidates(data, korean=True).select("normalized_source", "surface", "unit_frequency", mining.segment_words("text", True).alias("segments")).collect()
    assert any(r["unit_frequency"] > 1 for r in rows)
    for r in rows:
        wanted = kernel.keyed(r["surface"]).split()
        found = 0
        for ws in r["segments"]:
            stems = [kernel.keyed(w) for w in ws]
            found += sum(" ".join(stems[i : i + len(wanted)]) == " ".join(wanted) for i in range(len(stems) - len(wanted) + 1))
        assert r["unit_frequency"] == max(found, 1)


def test_no_expand_over_candidates(spark):
    plan = judge_units(units(spark, 3), ["doc_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan
    assert mining.extract_candidates(units(spark, 3), carry=["unit_id", "element_type", "is_header"]).where(F.col("unit_frequency") < 1).count() == 0


def test_statistics_carry_no_long_strings(spark, monkeypatch):
    """Sections and chunks of any length go through the shuffle as hashes; counts are the exact ones."""
    rows = [("d", i, "Alpha Beta is here. Alpha-Beta too" if i % 2 else "Alpha Beta again", "c" * 999 + str(i % 3), "s" * 999 + str(i % 2) if i else None, "paragraph", False) for i in range(6)]
    data = spark.createDataFrame(rows, "doc_id string, unit_id long, text string, chunk_id string, section string, element_type string, is_header boolean")
    staged, write = [], mining.materialize
    monkeypatch.setattr(mining, "materialize", lambda df: (staged.append(dict(df.dtypes)), write(df))[1])
    candidates = mining.extract_candidates(data, carry=["doc_id", "unit_id", "chunk_id", "section", "element_type", "is_header"]).withColumn("has_alias", F.lit(False))
    found = {r["normalized_source"]: r for r in mining.term_stats(candidates, ["doc_id"], data, ["doc_id", "unit_id"]).collect()}
    r = found["alpha beta"]
    assert (r["unit_count"], r["chunk_count"], r["section_count"], r["frequency"]) == (6, 3, 2, 6)
    assert staged and all(kind != "string" or name in ("doc_id", "normalized_source", "_source") for table in staged for name, kind in table.items())


def test_occurrences_join_texts_last(spark):
    data = units(spark, 12).withColumns({c: F.lit(None).cast("string") for c in ("context_text", "table_title", "source", "doc_format")})
    data = data.withColumn("table_index", F.lit(None).cast("int")).withColumn("doc_id", F.lit("d"))
    every = mining.extract_candidates(data)
    terms = every.groupBy("doc_id", "normalized_source").agg(F.min("surface").alias("source_term")).where("length(normalized_source) % 2 = 0")
    whole = mining.term_occurrences(every, terms, ["doc_id"])
    found = mining.occurrences_in(data, terms, ["doc_id"])
    assert found.columns == whole.columns and found.count() == whole.count() > 0 and found.exceptAll(whole).count() == 0


def test_shape_reasons_agree_with_columns(spark):
    """What the kernel says of a term is what the rules say as columns, in their order."""
    from lexispan.functions import terms as T
    from lexispan.functions import text as X
    from lexispan.operators.term_shape_kernel import shape_reasons

    rng = random.Random(8)
    parts = ["The", "the", "of", "Of", "and", "is", "would", "IX", "ii", "NATO", "A/B", "AB/CD", "iPhone", "McDonald", "N/A", "blank", "Data", "(Data)", "Foo-", "x", "서버", "서버가", "9", "Model7", "é", "École", "ÉTÉ", "a", "[Data]", "data", "Table", "–", ".", "Table 4.", "\x1c", "ǅ", "ⅷ", "İs"]
    terms = ["", " ", "IX", "N/A", "Blank ", "AB\x1c", "A B C D E F G H", "Foo  Bar", " Foo Bar", "Foo Bar AB", "Data 9", "Foo　Bar", "x9"]
    terms += [rng.choice([" ", " ", " ", "  ", "\t"]).join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    rows = spark.createDataFrame([(t, rng.random() < 0.3, rng.random() < 0.5) for t in terms], "term string, name boolean, ngram boolean")
    rows = rows.withColumn("n", X.token_count("term"))
    n, several = F.col("n"), F.col("n") > 1
    rules = F.coalesce(
        F.nullif(T.invalid_reason("term"), F.lit("")),
        F.when(T.repeated_key_token("term"), "cross_boundary_repeated_token").when((F.col("term") == "") | (n == 0), "empty_or_non_word")
        .when(F.length("term") < 2, "too_short").when((n == 1) & ~X.single_word_term("term") & ~F.col("name"), "generic_single_word")
        .when(several & ~T.independent_shape("term"), "not_independent_term_shape").when(F.col("ngram") & T.bad_body_ngram("term"), "bad_body_ngram_shape")
        .when(several & X.is_acronym(F.element_at(F.split("term", " "), -1)), "alias_joined_ngram").otherwise(""),
    )
    found = rows.withColumn("kernel", shape_reasons("term", "n", "name", "ngram")).withColumn("columns", rules)
    assert found.where("kernel <> columns").select("term", "name", "ngram", "kernel", "columns").collect() == []
    assert found.select("kernel").distinct().count() > 10


def test_judging_cuts_no_term_into_words_in_columns(spark):
    """Words of a term are looked at once, in a batch; sections are hashed a unit, not a candidate."""
    stats = spark.createDataFrame([("d", "Data Base", 2, 2, 8, 0, 0, 0, False)], "doc_id string, source_term string, token_count int, frequency long, type_bits int, heading_count long, table_header_count long, standalone_occurrence_count long, has_alias boolean")
    judged = mining.judge_candidates(stats)
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "split(" not in plan and judged.first()["filter_reason"] == ""
    data = units(spark, 9)
    once = mining.hashed_places(data)
    assert {"_chunk", "_section"} <= set(once.columns) and not {"chunk_id", "section"} & set(once.columns) and mining.hashed_places(once) is once


def test_candidate_keys_are_those_of_candidates(spark):
    for korean in (False, True):
        data = units(spark, 10, korean)
        carry = ["doc_id", "unit_id", "element_type", "is_header"]
        want = mining.extract_candidates(data, korean, carry).select("doc_id", "unit_id", "normalized_source")
        got = mining.candidate_keys(data, ["doc_id", "unit_id"], korean)
        assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0
