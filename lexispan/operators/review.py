"""Review decisions written back to document terms, by joins and aggregates.

Which entry an action means, and which members of its families follow it, rests
on columns that no action changes. So no task walks the actions of a document:
every effect of an action is a row, and every field takes the last row that
writes it. Effects on a family are kept once per family key and authority, not
once per member; members look up the rows of their keys.

One value depends on earlier actions: the target of an action that gives none,
or whose family has a stronger member with a target. These are looked up as of
the action's number, in rounds, until no target changes; a round more is needed
only where one such target was taken from another one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, document_key, family_key
from ..session import materialize
from .document_terms import NONE, authority, entry_sources, is_target
from .matching import clean_kind

TERMINAL_ORDER = {"drop_candidate": 0, "source_meaning_only": 1, "mark_preferred": 2, "no_update": 3}
#: Kinds that close an entry without a target, with the status they leave.
CLOSING = {"drop_candidate": "blocked", "source_meaning_only": "source_meaning_only"}

MEMBER = ["doc_id", "term_id"]
SLOT = ["doc_id", "key", "level"]


def _is_closing() -> Column:
    return F.col("type").isin(*CLOSING)


def _sets_target() -> Column:
    return (F.col("type") == "mark_preferred") & (F.coalesce("target", F.lit("")) != "")


def _columns(entries: DataFrame) -> DataFrame:
    """The unchanging columns of an entry that decide what an action reaches."""
    core = [F.coalesce(c, F.lit(False)) for c in ("core_concept", "requires_preferred_target") if c in entries.columns]
    keys = F.array_distinct(F.filter(F.transform(entry_sources(), family_key), lambda k: k != ""))
    return entries.select(
        *MEMBER, F.struct("entry_order", "term_id").alias("place"), document_key("source_term").alias("source"),
        F.array_distinct(F.transform(F.coalesce("source_terms", F.array().cast(NONE)), document_key)).alias("forms"),
        clean_kind("memory_kind").alias("memory_kind"), is_target("memory_kind").alias("takes_target"),
        authority("memory_kind").alias("level"), collapse("preferred_target").alias("start"),
        (F.array_contains(F.array(F.lit(False), *core), True) & is_target("memory_kind")).alias("core"),
        # An entry without any form is a family of its own.
        F.when(F.size(keys) > 0, keys).otherwise(F.array(F.concat(F.lit("\x1eid:"), "term_id"))).alias("keys"),
    )


def _meant(actions: DataFrame, rows: DataFrame) -> DataFrame:
    """Every terminal action with the entry it means; an action sent twice counts once."""
    cols = [c for c in actions.columns if c != "doc_id"]
    acts = actions.select(
        "doc_id", collapse("type").alias("type"), document_key("source_term").alias("source"), "action_seq",
        F.struct(F.col("action_seq"), F.xxhash64(F.to_json(F.struct(*cols)))).alias("at"),
        F.coalesce(F.nullif(collapse("target"), F.lit("")), collapse("preferred_target")).alias("own"),
        *[collapse(c).alias(c) for c in ("status", "meaning", "reason")],
    )
    acts = acts.where(F.col("type").isin(*TERMINAL_ORDER) & (F.col("source") != "")).dropDuplicates(["doc_id", "at"])
    wanted = acts.select("doc_id", "source").distinct()
    raw = F.col("memory_kind") == "raw_evidence_candidate"
    exact = rows.select(
        *MEMBER, "place", "source", F.when(raw, 0).when(~F.col("core"), 1).otherwise(2).alias("closing"),
        F.when(F.col("core"), 0).otherwise(1).alias("naming"),
    )
    forms = rows.select(*MEMBER, "place", F.explode("forms").alias("source"), F.lit(3).alias("closing"), F.lit(3).alias("naming"))
    found = exact.unionByName(forms).join(wanted, ["doc_id", "source"], "left_semi").groupBy("doc_id", "source").agg(
        F.min_by("term_id", F.struct("closing", "place")).alias("_closing"), F.min_by("term_id", F.struct("naming", "place")).alias("_naming")
    )
    acts = acts.join(found, ["doc_id", "source"]).withColumn("term_id", F.when(_is_closing(), F.col("_closing")).otherwise(F.col("_naming")))
    acts = acts.drop("source", "_closing", "_naming").join(rows.select(*MEMBER, "takes_target", "level", "start", "place"), MEMBER)
    return acts.where((F.col("type") != "mark_preferred") | F.col("takes_target")).drop("takes_target")


def _reach(effects: DataFrame, keys: DataFrame) -> DataFrame:
    """Effects at every family key and level of authority that they reach."""
    slots = effects.join(keys.select(*MEMBER, "key"), MEMBER)
    return slots.withColumn("level", F.explode(F.sequence(F.lit(1), F.col("level"))))


def _as_of(asked: DataFrame, writes: DataFrame, keys: DataFrame) -> DataFrame:
    """Target that entry ``of`` has just before ``at``; ``asked`` has doc_id, at, of."""
    who = keys.select("doc_id", F.col("term_id").alias("of"), "key", "level")
    asks = asked.join(who, ["doc_id", "of"]).select(*SLOT, "at", "of", F.lit(None).cast("string").alias("target"))
    rows = asks.unionByName(writes.select(*SLOT, "at", F.lit(None).cast(asked.schema["of"].dataType).alias("of"), "target"))
    before = Window.partitionBy(*SLOT).orderBy("at", F.col("of").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    write = F.when(F.col("target").isNotNull(), F.struct("at", "target"))
    seen = rows.withColumn("last", F.last(write, ignorenulls=True).over(before)).where("of is not null")
    seen = seen.groupBy("doc_id", "at", "of").agg(F.max("last").alias("last"))
    start = keys.select("doc_id", F.col("term_id").alias("of"), "start", "takes_target").distinct()
    taken = F.when(F.col("takes_target"), F.col("last.target"))
    return seen.join(start, ["doc_id", "of"]).select("doc_id", "at", "of", F.coalesce(taken, "start").alias("had"))


def _stronger(acts: DataFrame, writes: DataFrame, keys: DataFrame) -> DataFrame:
    """The first family member of more authority that has a target by then: ``doc_id, at, strong``."""
    first = writes.groupBy(*SLOT).agg(F.min("at").alias("since"))
    offers = keys.where("takes_target").join(first, SLOT, "left").groupBy(*MEMBER).agg(F.min("since").alias("since"), F.max("start").alias("start"))
    offers = offers.where("start <> '' or since is not null").withColumn("since", F.when(F.col("start") == "", F.col("since")))
    # A key and level needs only its first offer of each moment.
    offers = offers.drop("start").join(keys.where("level > 1").select(*MEMBER, "key", "level", "place"), MEMBER).withColumn(
        "level", F.explode(F.sequence(F.lit(1), F.col("level") - 1))
    ).groupBy(*SLOT, "since").agg(F.min("place").alias("place"))
    asks = acts.where("type = 'mark_preferred'").select(*MEMBER, "at", "level").join(keys.select(*MEMBER, "key"), MEMBER)
    rows = asks.select(*SLOT, "at", F.lit(None).cast(keys.schema["place"].dataType).alias("place"), F.lit(1).alias("side")).unionByName(
        offers.select(*SLOT, F.col("since").alias("at"), "place", F.lit(0).alias("side"))
    )
    before = Window.partitionBy(*SLOT).orderBy(F.col("at").asc_nulls_first(), "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("best", F.min("place").over(before)).where("side = 1 and best is not null")
    return rows.groupBy("doc_id", "at").agg(F.min("best").alias("best")).select("doc_id", "at", F.col("best.term_id").alias("strong"))


def _with_targets(acts: DataFrame, keys: DataFrame) -> DataFrame:
    """Actions with ``had``, the entry's target before, and ``target``, the one that they set or confirm."""
    acts = materialize(acts.withColumn("target", F.col("own")))
    while True:
        writes = materialize(_reach(acts.where(_sets_target()).select(*MEMBER, "level", "at", "target"), keys))
        asked = acts.join(_stronger(acts, writes, keys), ["doc_id", "at"], "left")
        each = asked.select("doc_id", "at", F.explode(F.array_compact(F.array("term_id", "strong"))).alias("of"))
        had = materialize(_as_of(each, writes, keys))
        out = asked.join(had.select("doc_id", "at", F.col("of").alias("term_id"), F.col("had").alias("_had")), ["doc_id", "at", "term_id"], "left")
        out = out.join(had.select("doc_id", "at", F.col("of").alias("strong"), F.col("had").alias("theirs")), ["doc_id", "at", "strong"], "left")
        named = F.coalesce(F.nullif("own", F.lit("")), "_had", F.lit(""))
        given = F.when((F.col("type") == "mark_preferred") & (named != ""), F.coalesce("theirs", named)).otherwise(named)
        out = materialize(out.select(
            *[c for c in acts.columns if c not in ("target", "had")], F.col("_had").alias("had"), given.alias("target"), F.col("target").alias("_was"),
        ))
        changed = out.where((F.col("type") == "mark_preferred") & ~F.col("target").eqNullSafe(F.col("_was"))).limit(1).count()
        acts = out.drop("_was")
        if not changed:
            return acts.where("type <> 'no_update' or had <> ''")


def _decided(actions: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Actions that take effect, with their targets, and the family keys of the documents they touch."""
    rows = _columns(entries)
    acts = _meant(actions, rows)
    touched = acts.select("doc_id").distinct()
    keys = materialize(rows.join(touched, "doc_id", "left_semi").select(
        *MEMBER, "place", "level", "takes_target", "start", F.explode("keys").alias("key")
    ))
    return _with_targets(acts, keys), keys


def _followers(acts: DataFrame, keys: DataFrame, fields: list[str]) -> DataFrame:
    """Members that take over the target of an action on another entry, once each."""
    slots = _reach(acts.where(_sets_target()).select(*MEMBER, "level", "at", *fields), keys).withColumnRenamed("term_id", "_by")
    met = slots.join(keys.where("takes_target").select(*MEMBER, "key", "level"), SLOT).where("term_id <> _by")
    return met.select(*MEMBER, "at", *fields).distinct()


def _history(acts: DataFrame, keys: DataFrame) -> DataFrame:
    own = acts.select(
        *MEMBER, "at", "action_seq", "type", "target", "reason",
        F.when(F.col("type") == "mark_preferred", "first_target").otherwise("confirmed_target").alias("change"),
    )
    family = _followers(acts, keys, ["action_seq", "type", "target", "reason"]).withColumn("change", F.lit("family_target"))
    return own.unionByName(family)


def review_history(actions: DataFrame, entries: DataFrame) -> DataFrame:
    """One row for each change that a review action makes to an entry.

    ``doc_id, term_id, action_seq, type, change, status, detail, reason``:
    ``change`` is ``first_target``, ``confirmed_target`` or, for members that
    take over a target, ``family_target``; ``detail`` is the target.
    """
    return _history(*_decided(actions, entries)).select(
        *MEMBER, "action_seq", "type", "change", F.lit("applied").alias("status"), F.col("target").alias("detail"), "reason"
    )


def apply_review_actions(actions: DataFrame, entries: DataFrame) -> DataFrame:
    """Apply accepted review actions in order and spread them to weaker family members.

    Gives per entry the fields that reviews change, with target candidates,
    senses (where the entries have them), the number of candidates and the
    number of history rows gained. Entries without an action stay as they are.
    Actions on unknown or empty source terms, of other kinds, confirmations of
    entries without a target and targets for context entries change nothing.
    """
    acts, keys = _decided(actions, entries)
    closed = F.create_map(*[F.lit(x) for pair in CLOSING.items() for x in pair])
    policy = closed[F.col("type")]
    status = F.coalesce(
        policy, F.nullif("status", F.lit("")), F.when(F.col("type") == "mark_preferred", "preferred").otherwise("initial_seed")
    )

    def last(value: Column, when: Column, name: str) -> Column:
        return F.max_by(value, F.when(when, F.col("at"))).alias(name)

    own = acts.groupBy(*MEMBER).agg(
        F.max(F.struct("at", F.lit(1).alias("own"), status.alias("status"), policy.alias("policy"))).alias("_mine"),
        F.max(F.when(_sets_target(), F.struct("at", "target"))).alias("_my_target"),
        last(F.col("meaning"), (F.col("type") == "source_meaning_only") & (F.col("meaning") != ""), "_meaning"),
        last(F.col("reason"), _is_closing() & (F.col("reason") != ""), "_reason"),
    )
    spread = _reach(acts.where(_is_closing() | _sets_target()), keys).groupBy(*SLOT).agg(
        F.max(F.struct("at", F.lit(0).alias("own"), F.coalesce(policy, F.lit("preferred")).alias("status"), policy.alias("policy"))).alias("last"),
        F.max(F.when(_sets_target(), F.struct("at", "target"))).alias("target"),
    )
    family = keys.where("takes_target").select(*MEMBER, "key", "level").join(spread, SLOT).groupBy(*MEMBER).agg(
        F.max("last").alias("_theirs"), F.max("target").alias("_their_target")
    )
    history = materialize(_history(acts, keys))
    gained = history.groupBy(*MEMBER).agg(F.count(F.lit(1)).alias("_rows"))
    new = history.where(_sets_target()).groupBy(*MEMBER, document_key("target").alias("_k")).agg(
        F.min(F.struct("at", "target", "reason")).alias("_n")
    ).groupBy(*MEMBER).agg(F.array_sort(F.collect_list("_n")).alias("_new"))
    # A sense or candidate with the target of an own action is marked by it.
    named = acts.groupBy(*MEMBER, document_key("target").alias("_k")).agg(F.max_by(status, "at").alias("_s"))
    named = named.groupBy(*MEMBER).agg(F.map_from_entries(F.collect_list(F.struct("_k", "_s"))).alias("_named"))

    out = entries
    for part in (own, family, gained, new, named):
        out = out.join(part, MEMBER, "left")
    end, target = F.greatest("_mine", "_theirs"), F.greatest("_my_target", "_their_target")
    out = out.withColumn("_end", end).withColumn("_target", target)
    hit = F.col("_end").isNotNull()
    kept = [F.when(~hit, F.col(c)).otherwise(F.lit(False)).alias(c) for c in ("needs_review", "target_decision_needed")]
    listed = _candidates(entries)
    result = out.select(
        *MEMBER, F.coalesce("_end.status", "status").alias("status"), F.coalesce("_target.target", "preferred_target").alias("preferred_target"),
        F.when(hit, F.col("_end.policy")).otherwise(F.col("pre_judge_inject_policy")).alias("pre_judge_inject_policy"), *kept,
        F.coalesce("_meaning", "meaning").alias("meaning"), F.coalesce("_reason", "why_it_matters").alias("why_it_matters"),
        listed.alias("target_candidates"), *([_senses(entries).alias("senses")] if "senses" in entries.columns else []),
        F.coalesce("_rows", F.lit(0)).cast("bigint").alias("history_rows"),
    )
    return result.withColumn("candidate_count", F.coalesce(F.size("target_candidates"), F.lit(0)).cast("bigint"))


def _candidates(entries: DataFrame) -> Column:
    """Candidates with their new source, and new ones behind them in the order they came."""
    kind = entries.schema["target_candidates"].dataType
    fields = kind.elementType.fieldNames()
    old = F.coalesce("target_candidates", F.array().cast(kind))
    if "source" in fields:
        mine = lambda c: F.map_contains_key(F.col("_named"), document_key(c["target"])) | (c["source"] == "term_resolver")
        marked = F.transform(old, lambda c: c.withField("source", F.when(mine(c), "term_pre_judge").otherwise(c["source"])))
        old = F.when(F.col("_named").isNotNull(), marked).otherwise(old)
    given = {"status": F.lit("preferred"), "source": F.lit("term_pre_judge")}
    missing = F.filter("_new", lambda n: ~F.exists(F.coalesce("target_candidates", F.array().cast(kind)), lambda c: document_key(c["target"]) == document_key(n["target"])))

    def made(n: Column) -> Column:
        values = given | {"target": n["target"], "reason": n["reason"]}
        return F.struct(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.elementType.fields])

    return F.when(F.col("_new").isNull(), old).otherwise(F.concat(old, F.transform(missing, made)))


def _senses(entries: DataFrame) -> Column:
    def sense(s: Column) -> Column:
        return s.withField("status", F.coalesce(F.try_element_at("_named", document_key(s["preferred_target"])), s["status"]))

    return F.when(F.col("_named").isNull() | F.col("senses").isNull(), F.col("senses")).otherwise(F.transform("senses", sense))
