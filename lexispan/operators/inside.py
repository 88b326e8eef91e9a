"""Dictionary forms anywhere inside texts, with one automaton for each shard of a scope's forms.

A scope's distinct forms are cut into shards of bounded size and its texts into
portions of bounded size. A shard and a portion meet in one task: forms are
sorted before texts, so the task compiles the forms to an Aho-Corasick
automaton and then streams the texts through it. A text is moved once for each
shard of its scope, which is once unless the scope has forms of more than
``FORM_CHARS`` characters; nothing is capped, and the automaton's answer is exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of the forms that one automaton is made of, and of the texts that a task takes for it.
FORM_CHARS = 1 << 19
TEXT_CHARS = 1 << 23

_GROUP = ["_scope", "_shard", "_portion"]


def _searched(batches: Iterator[pa.RecordBatch], kept: list[str], solid: str) -> Iterator[pa.RecordBatch]:
    touch = re.compile(f"[{solid}]").match if solid else None

    def apart(key: str, end: int, size: int) -> bool:
        return not (end >= size and touch(key, end - size)) and not touch(key, end + 1)

    now, automaton, ready = None, None, False
    for batch in batches:
        names = batch.schema.names
        columns = [batch.column(names.index(c)).to_pylist() for c in (*_GROUP, "_side", "_key")]
        rows: list[int] = []
        found: list[str] = []
        for i, (*group, side, key) in enumerate(zip(*columns)):
            if group != now:
                now, automaton, ready = group, ahocorasick.Automaton(), False
            if side == 0:
                automaton.add_word(key, key)
                continue
            if not ready:
                if len(automaton):
                    automaton.make_automaton()
                ready = True
            if len(automaton):
                hits = {form for end, form in automaton.iter(key) if touch is None or apart(key, end, len(form))}
                rows += [i] * len(hits)
                found += hits
        if rows:
            taken = batch.select(kept).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(found, pa.string())], [*kept, "_key"])


def forms_inside(
    texts: DataFrame, forms: DataFrame, kept: list[str], scope: list[str], body: str, form: str, solid: str = "", raw: str | None = None
) -> DataFrame:
    """``kept`` columns of each text and every key of the forms of its scope that stands in it.

    ``body`` and ``form`` are keys already, compared character by character. Empty
    forms stand nowhere; rows with a null in ``scope`` match nothing. With ``solid``,
    a class of characters, a form counts only where none of these touches it.
    ``raw`` names the text that a body was made of: portions are planned by its
    length, so that keys are made once.
    """
    name = F.to_json(F.struct(*scope), {"ignoreNullFields": "false"})
    whole = lambda df, c: df.where(" and ".join(f"`{s}` is not null" for s in scope)).withColumn("_key", F.coalesce(F.col(c), F.lit("")))
    words = whole(forms, form).where("_key <> ''").select(name.alias("_scope"), "_key").distinct()
    bodies = whole(texts, body).where("_key <> ''").select(*kept, "_key").withColumn("_scope", name)
    parts = lambda most: F.greatest(F.ceil(F.sum(F.char_length("_key")) / most), F.lit(1).cast("bigint"))
    sized = whole(texts, raw or body).select(name.alias("_scope"), "_key")
    plan = words.groupBy("_scope").agg(parts(FORM_CHARS).alias("_shards")).join(
        sized.groupBy("_scope").agg(parts(TEXT_CHARS).alias("_portions")), "_scope"
    )
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    none = [F.lit(None).cast(bodies.schema[c].dataType).alias(c) for c in kept]
    left = words.join(plan, "_scope").select(
        "_scope", F.pmod(F.xxhash64("_key"), F.col("_shards")).alias("_shard"), every("_portions").alias("_portion"), F.lit(0).alias("_side"), "_key", *none
    )
    right = bodies.join(plan, "_scope").select(
        "_scope", every("_shards").alias("_shard"), F.pmod(F.xxhash64(*kept), F.col("_portions")).alias("_portion"), F.lit(1).alias("_side"), "_key", *kept
    )
    schema = T.StructType([*[T.StructField(c, bodies.schema[c].dataType) for c in kept], T.StructField("_key", T.StringType())])
    met = left.unionByName(right).repartition(*_GROUP).sortWithinPartitions(*_GROUP, "_side")
    return met.mapInArrow(lambda batches: _searched(batches, kept, solid), schema)
