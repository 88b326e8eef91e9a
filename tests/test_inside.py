"""Forms inside texts against plain containment."""

import random

import pytest

from lexispan.operators import inside, matching


def rows(seed):
    rng = random.Random(seed)
    letters = ["a", "b", "ab", " ", "é", "서", "버", "x-y", "\U0001f600"]
    text = lambda most: "".join(rng.choice(letters) for _ in range(rng.randrange(most)))
    scopes = ["one", "two", "hot", "hot", "hot", None]
    texts = [(rng.choice(scopes), i, text(40) if i % 9 else None) for i in range(300)]
    forms = [(rng.choice(scopes + ["none"]), f"t{i}", text(5)) for i in range(80)]
    return texts, forms


@pytest.mark.parametrize("most", [(1 << 19, 1 << 23), (6, 90)])
def test_forms_inside_texts(spark, monkeypatch, most):
    """In one shard and portion and in many; every pair once, none across scopes."""
    monkeypatch.setattr(inside, "FORM_CHARS", most[0])
    monkeypatch.setattr(inside, "TEXT_CHARS", most[1])
    texts, forms = rows(1)
    left = spark.createDataFrame(texts, "doc_id string, unit_id long, text string").repartition(3)
    right = spark.createDataFrame(forms, "doc_id string, term_id string, form string")
    found = matching.match_forms(left, right, ["doc_id", "unit_id"], ["doc_id"], mode=matching.KEY_INSIDE)
    key = lambda s: " ".join(s.lower().split())
    want = [(d, u, t, f) for d, u, x in texts for e, t, f in forms if d is not None and d == e and x is not None and key(f) and key(f) in key(x)]
    assert sorted((r["doc_id"], r["unit_id"], r["term_id"], r["form"]) for r in found.collect()) == sorted(want)


def test_texts_are_moved_once(spark):
    """A scope of a hundred thousand characters of forms still sends each text to one task."""
    texts = spark.range(50).selectExpr("if(id < 0, 'e', 'd') as doc_id", "id as unit_id", "concat('text with form', id, ' inside') as text")
    forms = spark.range(20000).selectExpr("if(id < 0, 'e', 'd') as doc_id", "concat('t', id) as term_id", "concat('form', id) as form")
    found = matching.match_forms(texts, forms, ["doc_id", "unit_id"], ["doc_id"], mode=matching.KEY_INSIDE)
    assert found.count() == sum(len(str(i)) for i in range(50))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_forms_between_solid_characters_are_left_out(spark):
    texts = spark.createDataFrame([(1, 1, "subway sub"), (1, 2, "subway"), (1, 3, "a sub-way"), (1, 4, "가sub"), (2, 5, "sub")], "doc_id long, unit_id long, key string")
    forms = spark.createDataFrame([(1, "sub"), (1, "way"), (1, "sub-way"), (1, ".net")], "doc_id long, form string")
    found = inside.forms_inside(texts, forms, ["doc_id", "unit_id"], ["doc_id"], "key", "form", "A-Za-z0-9가-힣")
    assert sorted((r.unit_id, r._key) for r in found.collect()) == [(1, "sub"), (3, "sub"), (3, "sub-way"), (3, "way")]


def test_context_is_searched_apart_from_the_text(spark):
    """One search for the text and, where there is one, its context; what stands in both counts as the text's."""
    asked = []
    real = matching.forms_inside

    def seen(texts, *rest):
        asked.append(texts.count())
        return real(texts, *rest)

    units = spark.createDataFrame(
        [(1, 1, "Alpha runs", ""), (1, 2, "nothing", "near Alpha"), (1, 3, "Alpha here", "Alpha there"), (1, 4, "Alphabet", " ")],
        "doc_id long, unit_id long, text string, context_text string",
    )
    entry = spark.createDataFrame([(1, "e", "Alpha")], "doc_id long, term_id string, source_term string").selectExpr(
        "*", "array(source_term) AS source_terms", "1L AS entry_order", "'preferred' AS status", "'term' AS memory_kind", "'' AS meaning", "'' AS full_form",
        "'' AS document_local_role", "'' AS pre_judge_inject_policy", "'ALPHA' AS preferred_target", "false AS needs_review", "false AS target_decision_needed",
        "cast(array() AS array<string>) AS do_not_translate_as", "cast(array() AS array<struct<target:string,status:string,count:bigint,source:string,reason:string,evidence_refs:array<string>>>) AS target_candidates",
        "cast(array() AS array<struct<target:string,status:string,reason:string>>) AS avoid_targets", "'' AS resolver_priority", "'' AS target_language_risk",
        "cast(array() AS array<string>) AS family_ids", "cast(array() AS array<string>) AS do_not_confuse_with_source_terms", "'' AS evidence", "0.5D AS confidence", "false AS core_concept",
        "false AS requires_preferred_target", "'' AS active_sense_id", "'' AS why_it_matters", "'' AS target_pattern",
        "cast(array() AS array<struct<sense_id:string,meaning:string,status:string,preferred_target:string,confidence:double,evidence:string,target_language_risk:string,resolver_priority:string>>) AS senses",
    )
    try:
        matching.forms_inside = seen
        found = {(r.unit_id, r.match_level) for r in matching.relevant_document_terms(units, entry).collect()}
    finally:
        matching.forms_inside = real
    assert found == {(1, 2), (2, 1), (3, 2)} and asked == [6]
