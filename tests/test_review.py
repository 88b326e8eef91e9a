"""Review write-back by joins against a plain walk over the actions."""

import random

import pytest
from pyspark.sql import functions as F

from lexispan.operators.review import apply_review_actions, review_history

ENTRY = (
    "doc_id long, term_id string, entry_order long, source_term string, source_terms array<string>, memory_kind string, status string, "
    "preferred_target string, pre_judge_inject_policy string, needs_review boolean, target_decision_needed boolean, meaning string, "
    "why_it_matters string, core_concept boolean, target_candidates array<struct<target:string,status:string,source:string,reason:string>>, "
    "senses array<struct<sense_id:string,preferred_target:string,status:string>>"
)
ACTION = "doc_id long, action_seq long, type string, source_term string, target string, preferred_target string, status string, meaning string, reason string"
RANK = {"analysis_candidate": 4, "term": 3, "acronym": 3, "raw_evidence_candidate": 1, "term_family": 2, "source_note": 2, "resolver_added": 2}
TAKES = {"term", "acronym", "raw_evidence_candidate", "analysis_candidate", "resolver_added"}


def key(v):
    return " ".join((v or "").lower().split())


def families(e):
    out = set()
    for s in [e["source_term"], *(e["source_terms"] or [])]:
        k = key(s)
        for article in ("the ", "a ", "an "):
            if k.startswith(article):
                k = k[len(article):]
                break
        out.add(k.removesuffix("'s"))
    return out - {""}


def meant(entries, kind, source):
    exact = [e for e in entries if key(e["source_term"]) == source]
    core = [e for e in exact if e["core_concept"] and e["memory_kind"] in TAKES]
    if kind in ("drop_candidate", "source_meaning_only"):
        order = [e for e in exact if e["memory_kind"] == "raw_evidence_candidate"] + [e for e in exact if e not in core]
    else:
        order = core
    order += exact + [e for e in entries if source in {key(s) for s in e["source_terms"] or []}]
    return order[0] if order else None


def walk(entries, actions):
    """Sequential result by document: changed entries and history rows."""
    history = []
    for a in sorted(actions, key=lambda a: a["action_seq"]):
        mine = sorted((e for e in entries if e["doc_id"] == a["doc_id"]), key=lambda e: e["entry_order"])
        kind = a["type"]
        if kind not in ("no_update", "mark_preferred", "drop_candidate", "source_meaning_only") or not key(a["source_term"]):
            continue
        e = meant(mine, kind, key(a["source_term"]))
        if e is None or (kind == "mark_preferred" and e["memory_kind"] not in TAKES) or (kind == "no_update" and not e["preferred_target"]):
            continue
        target = a["target"] or a["preferred_target"] or e["preferred_target"] or ""
        near = [m for m in mine if m is not e and m["memory_kind"] in TAKES and families(m) & families(e)]
        weak = [m for m in near if RANK[m["memory_kind"]] <= RANK[e["memory_kind"]]]
        closed = {"drop_candidate": "blocked", "source_meaning_only": "source_meaning_only"}.get(kind)
        follow = []
        if kind == "mark_preferred" and target:
            strong = [m["preferred_target"] for m in near if m not in weak and m["preferred_target"]]
            target = (strong or [target])[0]
            follow = weak
            for m in [e, *weak]:
                m["preferred_target"] = target
                if key(target) not in {key(c["target"]) for c in m["target_candidates"]}:
                    m["target_candidates"].append({"target": target, "status": "preferred", "source": "term_pre_judge", "reason": a["reason"] or ""})
        for m in [e, *(weak if closed else follow)]:
            m.update(needs_review=False, target_decision_needed=False, pre_judge_inject_policy=closed, status=closed or "preferred")
        e["status"] = closed or a["status"] or ("preferred" if kind == "mark_preferred" else "initial_seed")
        if kind == "source_meaning_only" and a["meaning"]:
            e["meaning"] = a["meaning"]
        if closed and a["reason"]:
            e["why_it_matters"] = a["reason"]
        for s in e["senses"] or []:
            if key(s["preferred_target"]) == key(target):
                s["status"] = e["status"]
        for c in e["target_candidates"]:
            if key(c["target"]) == key(target) or c["source"] == "term_resolver":
                c["source"] = "term_pre_judge"
        history.append((e["doc_id"], e["term_id"], a["action_seq"], "first_target" if kind == "mark_preferred" else "confirmed_target", target))
        history += [(m["doc_id"], m["term_id"], a["action_seq"], "family_target", target) for m in follow]
    return entries, history


def made(seed):
    r = random.Random(seed)
    bases = ["Web", "Mail", "Größe", "서버"]
    entries, actions = [], []
    for doc in (1, 2, 3, 4, 5, 6, None):
        for i in range(14):
            forms = [r.choice(["", "the ", "The  "]) + b + r.choice(["", "'s"]) for b in r.sample(bases, r.choice([1, 1, 1, 2]))]
            entries.append({
                "doc_id": doc, "term_id": f"e{i:02d}", "entry_order": i * 2, "source_term": forms[0], "source_terms": r.choice([forms, [], None]),
                "memory_kind": r.choice(list(RANK)), "status": "old", "preferred_target": r.choice([None, "", "alt"]), "pre_judge_inject_policy": "p",
                "needs_review": r.choice([True, None]), "target_decision_needed": True, "meaning": "m", "why_it_matters": "w", "core_concept": r.choice([None, False, True]),
                "target_candidates": [{"target": t, "status": "candidate", "source": r.choice(["seed", "term_resolver"]), "reason": ""} for t in r.sample(["Alt", "neu", "nuovo"], r.randrange(3))],
                "senses": r.choice([None, [{"sense_id": "s", "preferred_target": t, "status": "open"} for t in r.sample([None, "Alt", "neu"], 2)]]),
            })
        for n in range(r.choice([6, 25])):
            e = r.choice(entries[-14:])
            actions.append({
                "doc_id": doc, "action_seq": n, "type": r.choice(["mark_preferred"] * 4 + ["no_update", "drop_candidate", "source_meaning_only", "add_sense", None]),
                "source_term": r.choice([e["source_term"].upper(), e["source_term"], "unknown", None, "web"]), "target": r.choice([None, "", "neu", "neu2", "nuovo"]),
                "preferred_target": r.choice([None, "dritte"]), "status": r.choice([None, "", "confirmed"]), "meaning": r.choice([None, "sense"]), "reason": r.choice([None, "why", ""]),
            })
    return entries, actions


FIELDS = [
    "term_id", "status", "preferred_target", "pre_judge_inject_policy", "needs_review", "target_decision_needed", "meaning", "why_it_matters",
    "target_candidates", "senses",
]


@pytest.mark.parametrize("seed", range(2))
def test_review_equals_walk(spark, seed):
    entries, actions = made(seed)
    # Rows without a document belong to nothing that an action could reach.
    e, a = spark.createDataFrame(entries, ENTRY), spark.createDataFrame(actions, ACTION)
    got = {(r.doc_id, r.term_id): r.asDict(True) for r in apply_review_actions(a.union(a), e).collect()}
    log = [(r.doc_id, r.term_id, r.action_seq, r.change, r.detail) for r in review_history(a, e).collect()]
    want, history = walk(entries, [x for x in actions if x["doc_id"] is not None])
    assert sorted(log) == sorted(history)
    assert len(got) == len(want)
    for w in want:
        g = got[w["doc_id"], w["term_id"]]
        assert {f: g[f] for f in FIELDS} == {f: w[f] for f in FIELDS}
        assert g["candidate_count"] == len(w["target_candidates"])
        assert g["history_rows"] == sum(h[:2] == (w["doc_id"], w["term_id"]) for h in history)


def test_copied_targets_take_rounds(spark):
    """A target that is copied from entry to entry, each copy by an action without one."""
    entries, actions = made(0)
    e = entries[0]
    names = ["A", "B", "C", "D", "E"]
    chain = [e | {"doc_id": 1, "term_id": n, "entry_order": i, "source_term": n, "source_terms": [n, *names[i + 1:i + 2]], "memory_kind": "term",
                  "core_concept": False, "preferred_target": None, "target_candidates": [], "senses": None} for i, n in enumerate(names)]
    acts = [actions[0] | {"doc_id": 1, "action_seq": i, "type": "mark_preferred", "source_term": n, "target": "neu" if n == "A" else None, "preferred_target": None,
                          "status": None, "reason": ""} for i, n in enumerate(names)]
    out = apply_review_actions(spark.createDataFrame(acts, ACTION), spark.createDataFrame(chain, ENTRY))
    assert [r.preferred_target for r in out.orderBy("term_id").collect()] == ["neu"] * 5


def test_nothing_to_review(spark):
    e = spark.createDataFrame(made(1)[0], ENTRY)
    none = spark.createDataFrame([], ACTION)
    assert apply_review_actions(none, e).count() == e.count() and review_history(none, e).count() == 0
    assert apply_review_actions(none, e.limit(0)).where(F.col("status") == "old").count() == 0
