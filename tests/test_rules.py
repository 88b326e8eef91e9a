"""Limits that are gone, rules of actions, matching next to Hangul, staged tables."""

import os
import random
import re
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from lexispan import session
from lexispan.checks import corpus
from lexispan.functions.terms import bad_body_ngram
from lexispan.operators import action_rules as R
from lexispan.operators import actions as A
from lexispan.operators import batching, matching, mining
from lexispan.operators import document_terms as D
from lexispan.operators import term_memory as TM

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("mode", [matching.WORDS, matching.KEY_WORDS, matching.KEY_INSIDE])
def test_matching_next_to_hangul(spark, mode):
    rng = random.Random(5)
    pieces = ["GPU", "gpu를", "한국", "한국은", "Größe", "gamma-ray", "the", "§", "C++", "서버", "서버GPU", "x1", " ", " ", "."]
    texts = [(1, i, "".join(rng.choice(pieces) + rng.choice(["", " ", "-"]) for _ in range(7))) for i in range(150)]
    forms = [(1, f"t{i}", f) for i, f in enumerate(["GPU", "한국", "서버", "größe", "gamma-ray", "the gpu", "§", "c++", "한국은", "x1", "한국 gpu", "ß"])]
    t = spark.createDataFrame(texts, "doc_id long, unit_id long, text string")
    f = spark.createDataFrame(forms, "doc_id long, term_id string, form string")
    got = {(r.unit_id, r.term_id) for r in matching.match_forms(t, f, ["doc_id", "unit_id"], ["doc_id"], mode=mode).collect()}
    key = lambda s: " ".join(s.lower().split())

    def holds(s, w):
        if mode == matching.KEY_INSIDE:
            return key(w) in key(s)
        edge = "a-z0-9" if mode == matching.KEY_WORDS else "A-Za-z0-9가-힣"
        s, w = (key(s), key(w)) if mode == matching.KEY_WORDS else (s, w)
        return bool(re.search(rf"(?<![{edge}]){re.escape(w)}(?![{edge}])", s, 0 if mode == matching.KEY_WORDS else re.I))

    assert got == {(i, k) for _, i, s in texts for _, k, w in forms if holds(s, w)}


def test_every_word_of_a_long_term_is_checked(one):
    for n in (999, 1000, 1500):
        words = ["Alpha"] * n
        assert not one({"t": " ".join(words)}, bad=bad_body_ngram("t"))["bad"]
        words[-2] = "The"
        assert one({"t": " ".join(words)}, bad=bad_body_ngram("t"))["bad"]


def test_long_terms_are_nested_as_well(spark):
    def name(n):
        return " ".join(f"Word{i}" for i in range(n))

    rows = [(1, name(n), name(n).lower(), n, 5, 0, False) for n in (9, 10, 11, 14)]
    terms = spark.createDataFrame(
        rows, "doc_id long, source_term string, normalized_source string, token_count int, frequency long, standalone_occurrence_count long, has_alias boolean"
    )
    assert [r.token_count for r in mining.prune_nested(terms, ["doc_id"]).collect()] == [14]


def test_more_than_a_thousand_forms(spark):
    base = corpus.entries(spark, SMALL).drop("frequency").limit(1)
    families = spark.createDataFrame([(1, 0, "f0", 1200), (1, 1, "f1", 3)], "d long, o long, id string, n int")
    forms = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.concat("id", F.lit(" child "), F.format_string("%05d", i)))
    rows = families.crossJoin(base.drop("doc_id", "term_id", "entry_order", "source_term", "source_terms", "memory_kind")).select(
        *[
            {"doc_id": F.col("d"), "term_id": F.col("id"), "entry_order": F.col("o"), "source_term": F.col("id"),
             "source_terms": forms, "memory_kind": F.lit("term_family")}.get(c, F.col(c)).alias(c)
            for c in base.columns
        ]
    )
    made = D.attach_families(rows).where("memory_kind = 'term'").orderBy("entry_order").select("source_term").collect()
    assert [r[0] for r in made] == [f"f0 child {i:05d}" for i in range(1, 1201)] + [f"f1 child {i:05d}" for i in range(1, 4)]


@pytest.mark.parametrize("items", [3, 40])
def test_batches_longer_than_a_block(spark, items):
    rng = random.Random(items)
    sizes = [rng.randrange(1, 9) for _ in range(200)]
    rows = spark.createDataFrame([(1, i, n) for i, n in enumerate(sizes)], "g long, i long, n long")
    got = [r.batch_id for r in batching.assign_batches(rows, ["g"], "i", F.col("n"), items, 90, block_rows=16).orderBy("i").collect()]
    want, batch, count, chars = [], 1, 0, 0
    for n in sizes:
        if count and (count >= items or chars + n > 90):
            batch, count, chars = batch + 1, 0, 0
        count, chars = count + 1, chars + n
        want.append(batch)
    assert got == want


def test_shared_context_counts_once(spark):
    rng = random.Random(2)
    rows = [(1, i, "t" * rng.randrange(1, 9), rng.choice(["c" * 30, "d" * 20, ""])) for i in range(120)]
    units = spark.createDataFrame(rows, "doc_id long, unit_id long, text string, context_text string")
    got = [r.batch_id for r in batching.assign_unit_batches(units, 7, 500, context_once=True).orderBy("unit_id").collect()]
    want, batch, count, chars, held = [], 1, 0, 0, ""
    for _, _, text, context in rows:
        cost = len(text) + 100 + (0 if count and context == held else len(context))
        if count and (count >= 7 or chars + cost > 500):
            batch, count, chars = batch + 1, 0, 0
            cost = len(text) + 100 + len(context)
        held = context if not count else held
        count, chars = count + 1, chars + cost
        want.append(batch)
    assert got == want


def test_occurrences_are_united(spark):
    memory = corpus.glossary(spark, SMALL).orderBy("doc_id", "term_order").limit(1)
    term = memory.first()
    fields = "doc_id long, {} string, occ_order long, chunk_id string, unit_id long, source_snippet string"
    stored = spark.createDataFrame([(term.doc_id, term.term_id, i, "c", i, "s") for i in range(3)], fields.format("term_id"))
    scanned = spark.createDataFrame([(term.doc_id, term.normalized_source, i, "c", i, "s") for i in range(2, 300)], fields.format("normalized_source"))
    got = TM.merge_occurrences(stored, scanned, memory).collect()
    assert len(got) == 128 and min(r.unit_id for r in got) == 0 and max(r.unit_id for r in got) == 299
    assert len(TM.merge_occurrences(stored, scanned.where("unit_id < 5"), memory).collect()) == 5


def test_untouched_entries_stay(spark):
    entries = corpus.entries(spark, SMALL).drop("frequency")
    one = entries.orderBy("doc_id", "term_id").limit(1).select(
        "doc_id", F.lit(1).cast("bigint").alias("action_seq"), F.lit("drop_candidate").alias("type"), "term_id", "source_term",
        *[F.lit(None).cast("string").alias(c) for c in ("target", "preferred_target", "target_relation", "sense_id", "status", "superseded_by", "reason", "meaning")],
    )
    out = A.apply_review_actions(one, entries)
    assert out.count() == entries.count() and out.where("status = 'blocked'").count() >= 1
    folded = A.fold_actions(entries, one)
    assert A.folded_entries(folded, entries).count() == entries.count()


def act(kind, source, **more):
    return {"type": kind, "source_term": source} | more


def test_action_fields_and_structure():
    family = {"term_id": "f", "source_term": "Server", "source_terms": ["Server", "Web Server", "Mail Server"], "memory_kind": "term_family", "status": "preferred", "meaning": "m"}
    child = {"term_id": "c", "source_term": "Web Server", "source_terms": ["Web Server"], "memory_kind": "term", "status": "active", "preferred_target": "웹"}
    f = R.Family([family, child])
    assert f.apply(act("mark_avoid", "Web Server", target="메일"), 1) == ("mark_avoid", "", "메일")
    # The missing child is made, context entries lose their status, siblings know each other.
    mail = f.by_source["mail server"][0]
    assert mail["family_ids"] == ["f"] and mail["do_not_confuse_with_source_terms"] == ["Web Server"] and mail["meaning"] == "m"
    assert family["status"] == "analysis_hint" and child["family_ids"] == ["f"]
    # A sibling's preferred target leaves the avoid lists.
    f.apply(act("mark_preferred", "Mail Server", target="메일"), 2)
    assert child["do_not_translate_as"] == [] and child["avoid_targets"] == []
    f.apply(act("add_sense", "Web Server", document_local_meaning="x", confidence=0.4, evidence="e", evidence_refs=["r"], resolver_priority="high"), 3)
    made = child["senses"][-1]
    assert (made["meaning"], made["confidence"], made["evidence_refs"], made["resolver_priority"]) == ("x", 0.4, ["r"], "high")
    f.apply(act("request_repair", "Web Server", reason="why", target="웹", replacement="망"), 4)
    assert child["repair_requests"][0]["replacement"] == "망"
    f.apply(act("update_note", "Server", meaning="n", evidence_refs=["q"]), 5)
    assert family["meaning"] == "n" and family["evidence_refs"] == ["q"]
    f.apply(act("add_target_candidate", "New", target="새", source_terms=["Newer"], memory_kind="acronym"), 6)
    assert f.by_source["new"][0]["source_terms"] == ["New", "Newer"] and f.by_source["new"][0]["memory_kind"] == "acronym"


def test_staged_tables_are_deleted(spark):
    folder = session.shared_folder(spark) + "/lexispan"
    count = lambda: len(os.listdir(folder)) if os.path.isdir(folder) else 0
    before = count()
    with session.staging():
        session.materialize(spark.range(3))
        assert count() == before + 1
    assert count() == before


def test_workers_import_the_package_from_another_folder(tmp_path):
    """A Python stage runs although the working folder is not the repository and no path is set."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "from lexispan.session import local_session, ship\n"
        "spark = local_session(2, '1g'); ship(spark)\n"
        "from lexispan.operators.translator import mock, translate_units\n"
        "df = spark.createDataFrame([(1, 1, 'a', 1)], 'doc_id long, unit_id long, text string, batch_id long')\n"
        "print('GOT', translate_units(df, mock, 'de').first().translated)\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "GOT [de] a" in got.stdout, got.stderr[-2000:]


def test_language_is_told_without_counting_letters(spark):
    """The same answers as by counts, and no string is made of every letter."""
    import random
    import re

    from pyspark.sql import functions as F

    from lexispan.functions import quality as Q

    rng = random.Random(5)
    parts = ["word", "a-b-c", "it's", "x", "-", "12", "한국", "ㄱ", "漢", "漢字", "かな", "カ", "Ж", "é", "\n", ", "]
    texts = ["", None, *("".join(rng.choice(parts) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randrange(16))) for _ in range(400))]
    data = spark.createDataFrame([(i, t, c) for i, t in enumerate(texts) for c in ("ko", "en", "ja", "zh", "fr")], "i int, t string, c string")
    test = Q.needs_translation("t", F.col("c"))
    assert ", [A-Za-z], 0)" not in data.select(test)._jdf.queryExecution().optimizedPlan().toString()
    for t, c, got in data.select("t", "c", test).collect():
        t = t or ""
        n = {k: len(re.findall(p, t)) for k, p in (("ko", Q.HANGUL_LETTER), ("la", Q.LATIN), ("ka", Q.KANA), ("ha", Q.HAN))}
        runs = re.findall(r"""[A-Za-z][A-Za-z0-9\s,.;:!?()'"$%&/\-–—]{24,}""", t)
        sentence = any(len(re.findall(r"[A-Za-z]+(?:['-][A-Za-z]+)?", r)) >= 4 for r in runs)
        want = {
            "ko": n["ka"] > 0 or n["ha"] >= 2 or sentence, "en": n["ko"] + n["ka"] + n["ha"] > 0,
            "ja": n["ko"] > 0 or sentence or (n["ha"] > 0 and n["ka"] == 0), "zh": n["ko"] > 0 or n["ka"] > 0 or sentence, "fr": True,
        }[c]
        assert got == (want if sum(n.values()) else False), (t, c)
