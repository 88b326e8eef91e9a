"""Operators on small tables, with brute-force twins and skewed groups."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispan.checks import QUERIES, ORACLES, corpus
from lexispan.functions import fixed as K
from lexispan.operators import batching, matching, mining, ordering
from lexispan.operators import actions as A
from lexispan.operators import document_terms as D
from lexispan.operators import nodes as N
from lexispan.operators import quality_report as QR
from lexispan.operators import term_memory as TM
from lexispan.operators import units as U
from lexispan.operators.translator import translate_units
from lexispan.sources import snapshots

SMALL = "/root/testdata/sf0.001"


def greedy(sizes, items, chars):
    out, batch, n, c = [], 1, 0, 0
    for s in sizes:
        if n and (n >= items or c + s > chars):
            batch, n, c = batch + 1, 0, 0
        out.append(batch)
        n, c = n + 1, c + s
    return out


@pytest.mark.parametrize("block", [7, 16, 1000])
def test_batches_equal_a_plain_walk(spark, block):
    rng = random.Random(block)
    data = [(d, i, rng.choice([1, 5, 9, 30, 70])) for d, n in ((1, 97), (2, 5), (3, 1), (4, 64)) for i in range(n)]
    df = spark.createDataFrame(data, "doc_id long, i long, size long")
    got = batching.assign_batches(df, ["doc_id"], "i", F.col("size"), 5, 60, "b", block).collect()
    for doc in (1, 2, 3, 4):
        mine = [r.b for r in sorted((r for r in got if r.doc_id == doc), key=lambda r: r.i)]
        assert mine == greedy([s for d, _, s in data if d == doc], 5, 60)


def test_numbering_and_neighbours_cross_blocks(spark):
    df = spark.createDataFrame([(1, i * 3) for i in range(50)], "g long, o long")
    got = sorted((r.o, r.n) for r in ordering.dense_number(df, ["g"], ["o"], "n", rows=10).collect())
    assert got == [(i * 3, i) for i in range(50)]
    dense = spark.range(50).select(F.lit(1).alias("g"), F.col("id").alias("i"), F.col("id").cast("string").alias("v"))
    near = ordering.neighbours(dense, ["g"], "i", {"p": ("v", -1), "n": ("v", 1)}, rows=8).collect()
    assert len(near) == 50
    assert all(r.p == (str(r.i - 1) if r.i else None) and r.n == (str(r.i + 1) if r.i < 49 else None) for r in near)


def test_carry_forward(spark):
    df = spark.createDataFrame([(1, i, "h" if i == 5 else None) for i in range(40)], "g long, i long, v string")
    got = {r.i: r.c for r in ordering.carry_forward(df, ["g"], ["i"], F.col("v"), "c", rows=6).collect()}
    assert [got[i] for i in (4, 5, 39)] == [None, "h", "h"]


@pytest.mark.parametrize("n", [1, 7, 128, 129, 300])
def test_even_sampling(spark, n):
    df = spark.range(n).select(F.lit("k").alias("k"), F.col("id").alias("i"))
    got = sorted(r.i for r in mining.sample_evenly(df, ["k"], ["i"], 128).collect())
    want = list(range(n)) if n <= 128 else sorted({round(s * (n - 1) / 127) for s in range(128)})
    assert got == want


def test_captions_bind_to_one_table(spark):
    rows = [
        (1, 0, "Intro", "heading", None), (1, 1, "Table 1. Costs", "paragraph", None), (1, 2, "a", "cell", 0),
        (1, 3, "b", "cell", 1), (1, 4, "Table 2: Gains", "paragraph", None), (1, 5, "c", "cell", 2),
    ]
    df = spark.createDataFrame(rows, "doc_id long, node_id long, text string, element_type string, table_index int").withColumn("source", F.lit("body"))
    got = {r.table_index: (r.table_title, r.table_section) for r in N.table_context(df).collect()}
    assert got == {0: ("Table 1. Costs", "Intro"), 1: ("", "Intro"), 2: ("Table 2: Gains", "Intro")}


def test_matching_equals_brute_force(spark):
    words = ["Alpha", "beta", "gamma-ray", "the", "X", "§", "C++"]
    rng = random.Random(3)
    texts = [(1, i, " ".join(rng.choice(words) for _ in range(6))) for i in range(60)]
    forms = [(1, "t1", "alpha"), (1, "t2", "gamma"), (1, "t3", "the X"), (1, "t4", "§"), (1, "t5", "C++"), (1, "t6", "zeta")]
    t = spark.createDataFrame(texts, "doc_id long, unit_id long, text string")
    f = spark.createDataFrame(forms, "doc_id long, term_id string, form string")
    got = {(r.unit_id, r.term_id) for r in matching.match_forms(t, f, ["doc_id", "unit_id"], ["doc_id"]).collect()}
    import re

    want = {
        (i, k) for _, i, s in texts for _, k, w in forms
        if re.search(rf"(?<![A-Za-z0-9가-힣]){re.escape(w)}(?![A-Za-z0-9가-힣])", s, re.I)
    }
    assert got == want
    inside = {
        (r.unit_id, r.term_id)
        for r in matching.match_forms(t, f, ["doc_id", "unit_id"], ["doc_id"], mode=matching.KEY_INSIDE).collect()
    }
    assert inside == {(i, k) for _, i, s in texts for _, k, w in forms if w.lower() in s.lower()}


def test_alias_chain_is_one_family(spark):
    entries = corpus.entries(spark, SMALL).limit(0)
    chain = [("A B", ["B C"]), ("B C", ["C D"]), ("C D", ["D E"]), ("Z", ["Y"])]
    base = spark.createDataFrame([(9, i, f"e{i}", s, [s, *a]) for i, (s, a) in enumerate(chain)], "doc_id long, entry_order long, term_id string, source_term string, source_terms array<string>")
    got = {r.term_id: r.component for r in D.family_components(base).collect()}
    assert got == {"e0": "e0", "e1": "e0", "e2": "e0", "e3": "e3"}
    assert entries.columns


def soft_locked(spark, rows):
    return spark.createDataFrame(
        [(1, f"t{i}", s, a, "soft_locked", t) for i, (s, a, t) in enumerate(rows)],
        "doc_id long, term_id string, source_term string, aliases array<string>, bucket string, target_term string",
    )


def test_collisions(spark):
    terms = soft_locked(spark, [
        ("Data Server", [], "서버"), ("Server", [], "서버"), ("Client", [], "클라이언트"), ("Customer", [], "클라이언트"),
        ("Alpha Beta", ["AB"], "에이비"), ("AB", ["Alpha Beta"], "에이비"),
    ])
    assert {r.term_id for r in TM.target_collisions(terms).collect()} == {"t2", "t3"}


def test_response_checks(spark):
    expected = spark.createDataFrame([(1, 1, i) for i in range(4)], "doc_id long, batch_id long, id long")
    none = None
    items = [(1, 1, 0, "0", "a", none, none, none), (1, 1, 1, "0", "b", none, none, none), (1, 1, 2, "9", "c", none, none, none),
             (1, 1, 3, "x", "d", none, none, none), (1, 1, 4, "1", none, none, none, none), (1, 1, 5, "2", none, "t", none, none)]
    responses = spark.createDataFrame(items, "doc_id long, batch_id long, item_index long, id string, t string, translated string, translation string, text string")
    got = {(r.problem, r.id) for r in QR.check_batches(expected, responses).collect()}
    assert got == {
        ("duplicate_id", 0), ("unexpected_id", 9), ("id_not_an_integer", None), ("translation_not_a_string", 1),
        ("missing_id_in_response", 1), ("missing_id_in_response", 3),
    }


def test_adjacent_leak(spark):
    speech = "“You must never open the old door again,” she said."
    rows = [
        (1, 0, "He walked along the long and empty road home.", speech),
        (1, 1, "“Ne rouvre jamais la vieille porte,” dit-elle.", speech),
        (1, 2, "Completely different narrative text number one.", "The same target sentence appears for both of them."),
        (1, 3, "Another story entirely, with other words in it.", "The same target sentence appears for both of them."),
    ]
    df = spark.createDataFrame(rows, "doc_id long, unit_id long, original string, translated string")
    got = {r.unit_id for r in QR.adjacent_duplicates(df, ["doc_id"]).collect()}
    assert got == {0, 3}


def entry_row(spark, **over):
    """Two full entries on the schema of the derived table."""
    schema = corpus.entries(spark, SMALL).drop("frequency").schema
    base = {f.name: None for f in schema}
    for f in schema:
        if f.dataType.typeName() == "array":
            base[f.name] = []
    rows = []
    for i, (s, p) in enumerate([("Server", "서버"), ("Client", None)]):
        rows.append({**base, "doc_id": 1, "term_id": f"e{i}", "entry_order": i, "source_term": s, "source_terms": [s], "memory_kind": "term", "status": "initial_seed", "preferred_target": p})
    open_schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    return spark.createDataFrame([tuple(r[f.name] for f in schema) for r in rows], open_schema)


def test_action_fold_is_ordered(spark):
    entries = entry_row(spark)
    fields = "doc_id long, action_seq long, type string, term_id string, source_term string, target string, preferred_target string, target_relation string, sense_id string, status string, superseded_by string, reason string, evidence_refs array<string>, set_active boolean, meaning string"

    def act(seq, kind, source, target=None, relation="", preferred=None):
        return (1, seq, kind, "", source, target, preferred, relation, "", "", "", "", [], False, "")

    acts = spark.createDataFrame(
        [
            act(1, "mark_preferred", "Server", "머신"), act(2, "mark_avoid", "Server", "서버"),
            act(3, "mark_preferred", "Server", "머신", "same_meaning_variant"), act(4, "mark_avoid", "Server", "서버"),
            act(5, "mark_preferred", "Server", "서버", "same_meaning_variant"), act(6, "add_sense", "Router", preferred="라우터"),
            act(7, "drop", "Server"), act(8, "no_update", "Server"),
        ],
        fields,
    )
    folded = A.fold_actions(entries, acts)
    got = {r.action_seq: (r.applied, r.reason) for r in A.fold_results(folded).collect()}
    assert got == {
        1: (False, "target_relation_required_for_competing_preferred"), 2: (False, "cannot_avoid_current_preferred_target"),
        3: (True, ""), 4: (True, ""), 5: (False, "target_is_already_avoid_or_deprecated"), 6: (True, ""),
        7: (False, "unsupported_action"), 8: (True, ""),
    }
    after = {r.source_term: r for r in A.folded_entries(folded, entries).collect()}
    assert after["Server"].preferred_target == "머신" and after["Server"].do_not_translate_as == ["서버"]
    assert after["Router"].term_id == "dtm_003" and after["Router"].preferred_target == "라우터"


def test_promotion_ladder(spark):
    rows = [("a", 2, 0.9, [("x", 3)]), ("b", 2, 0.9, [("x", 2), ("y", 2)]), ("c", 1, 0.9, [("x", 3)]), ("d", 2, 0.1, [("x", 3)]), ("e", 2, 0.9, [("x", 1)])]
    terms = spark.createDataFrame([(1, t, "Server", [], "pending", f, s, s, "") for t, f, s, _ in rows], "doc_id long, term_id string, source_term string, aliases array<string>, bucket string, frequency long, candidate_score double, confidence double, review_reason string")
    counts = spark.createDataFrame([(1, t, v, c, i) for t, _, _, cs in rows for i, (v, c) in enumerate(cs)], "doc_id long, term_id string, target string, count long, first_seen long")
    got = {r.term_id: r.decision for r in TM.promotion(terms, TM.target_dispersion(counts)).collect()}
    assert got == {"a": "promote", "b": "review", "c": "keep", "d": "keep", "e": "keep"}


def test_translator_halves_failing_batches(spark):
    def picky(texts, language):
        if any("bad" in t for t in texts):
            raise RuntimeError("no")
        return [t.upper() for t in texts]

    df = spark.createDataFrame([(1, i, "bad" if i == 3 else f"t{i}", 1) for i in range(6)], "doc_id long, unit_id long, text string, batch_id long")
    got = {r.unit_id: (r.translated, r.failure) for r in translate_units(df, picky, "de").collect()}
    assert got[3] == ("bad", "RuntimeError: no") and got[5] == ("T5", "")


def test_snapshots(spark, tmp_path):
    path = tmp_path / "memory.json"
    path.write_text('{"schema_version": 1, "job_id": "j1", "updated_at": 1.5, "pending": {"term_001": {"source_term": "Server", "target": "서버"}}, "locked": {"term_002": {"source_term": "Client", "target_term": "고객"}}, "excluded": [{"source_term": "x", "filter_reason": "too_short"}]}')
    got = {(r.bucket, r.term_id, r.source_term, r.target_term) for r in snapshots.read_term_memory(spark, str(path)).collect()}
    assert got == {("pending", "term_001", "Server", "서버"), ("locked", "term_002", "Client", "고객")}
    assert snapshots.read_excluded(spark, str(path)).count() == 1
    out = str(tmp_path / "store")
    snapshots.write_snapshot(spark.createDataFrame([("a", 1), ("b", 2)], "job_id string, v long"), out)
    snapshots.write_snapshot(spark.createDataFrame([("a", 5)], "job_id string, v long"), out)
    assert {(r.job_id, r.v) for r in snapshots.read_snapshot(spark, out).collect()} == {("a", 5), ("b", 2)}


def test_micro_batch_merge_is_repeatable(spark):
    from lexispan.streaming.terms import foreach_batch_merge

    none = F.array().cast("array<string>")
    extra = {"candidate_types": none, "reason": none, "chunk_count": F.lit(1).cast("bigint"), "section_count": F.lit(1).cast("bigint")}
    memory = corpus.glossary(spark, SMALL).withColumns(extra)
    scan = memory.withColumn("frequency", F.col("frequency") + 3).drop("bucket", "term_id", "term_order", "target_term", "review_reason")
    store = {}
    merge = foreach_batch_merge(lambda batch_id: memory, lambda df, i: store.__setitem__(i, df))
    merge(scan, 7)
    merge(scan, 7)
    before = memory.agg(F.sum("frequency")).first()[0]
    assert store[7].agg(F.sum("frequency")).first()[0] == before + 3 * memory.count() and list(store) == [7]


def test_hot_group_matches_completely(spark):
    texts = spark.range(3000).select(F.lit(1).alias("doc_id"), F.col("id").alias("unit_id"), F.lit("the hot Term here").alias("text"))
    forms = spark.createDataFrame([(1, "t", "hot term"), (1, "u", "here")], "doc_id int, term_id string, form string")
    assert matching.match_forms(texts, forms, ["doc_id", "unit_id"], ["doc_id"]).count() == 6000


def test_analysis_sample_uses_a_snippet_once(spark):
    terms = spark.createDataFrame([(1, k, k, "pending", s, 2, 1) for k, s in (("a", 0.9), ("b", 0.8), ("c", 0.7))], "doc_id long, normalized_source string, source_term string, bucket string, candidate_score double, frequency long, token_count int")
    occ = spark.createDataFrame([(1, k, u, f"s{u}", "") for k in "abc" for u in (0, 1, 2)], "doc_id long, normalized_source string, unit_id long, source_snippet string, surrounding_source string")
    got = {(r.normalized_source, r.snippet) for r in TM.analysis_sample(terms, occ).collect()}
    assert got == {("a", "s0"), ("a", "s1"), ("b", "s2")}


def test_no_cross_join_in_plans(spark):
    for name in ("term_matches", "injection_log", "relevant_terms", "mined_terms", "target_collisions"):
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_every_sql_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 100


def test_entry(spark):
    import __spark_entry__ as entry

    assert 0 < entry.entry(spark).count() <= 50
    assert K.MAX_OCCURRENCES == 128


def test_nodes_do_not_drag_their_document_along(spark):
    docs = spark.createDataFrame([(1, "Head line here\nfirst body line\nsecond body line")], "doc_id long, text string")
    rows = N.read_nodes(docs)
    above = rows._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
    assert "_lines" not in above
    got = [(r.node_id, r.section, r.text) for r in rows.orderBy("node_id").collect()]
    assert got == [(0, "Head line here", "Head line here"), (1, "Head line here", "first body line"), (2, "Head line here", "second body line")]


def test_units_are_numbered_without_their_texts(spark):
    docs = spark.createDataFrame([(1, "Head line here\nsame body line\nother body line\nsame body line")], "doc_id long, text string")
    seen, staged = N.read_nodes(docs), {}
    # A node that is given twice is one place.
    built, targets = U.build_units(seen.unionByName(seen.where("node_id = 2")), stage=lambda name, df: staged.setdefault(name, df))
    assert not {"text", "fragment_text", "section"} & {c for df in staged.values() for c in df.columns}
    assert [(r.unit_id, r.text, r.target_count) for r in built.orderBy("unit_id").collect()] == [
        (0, "Head line here", 1), (1, "same body line", 2), (2, "other body line", 2)
    ]
    assert {(r.node_id, r.unit_id) for r in targets.collect()} == {(0, 0), (1, 1), (2, 2), (3, 1)}
    before = spark.createDataFrame([(1, 1, ""), (1, 3, "late"), (1, 2, "own")], "doc_id long, node_id long, previous string")
    got = {r.unit_id: r.previous for r in U.previous_translation(built, targets, before).collect()}
    assert got == {0: "", 1: "late", 2: "own"}
