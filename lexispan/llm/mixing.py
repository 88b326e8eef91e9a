"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

Every source has a cap, ``max_epochs`` times its own words. Words are poured
over the sources in proportion to their weights; a source that is full is
clamped and what it cannot hold goes to the others by weight. Sorted by cap per
weight, sources fill up in that order, so running sums give the level at which
the pouring ends without a loop.

A source whose target is r times its words is taken floor(r) times as a whole.
For the rest its documents are lined up by a seeded hash and taken up to the
remaining number of words; the document on the border is taken if at least half
of it lies before it. Running sums over the line go by blocks, about as many as
a block has documents, so a source that holds a third of all rows is spread
over many tasks.

Null and empty texts have size 0, add nothing and get no extra take. A null source is a source of
its own, after all others. Rows that repeat a document count as rows of their
own. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], max_epochs: float) -> DataFrame:
    """source, n_docs, source_size, target: one row for each source. ``sizes`` has source and size."""
    totals = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = ((F.row_number().over(in_order) - 1) % len(weights)) + 1
    weighed = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn)).withColumn(
        "cap", max_epochs * F.col("source_size").cast("double")
    )
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    poured = weighed.select(
        "*", F.row_number().over(filling).alias("turn"),
        F.sum("source_size").over(everything).alias("total"),
        F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("full"),
        F.sum("weight").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("open_weight"),
    ).withColumn("level", (F.col("total") - F.col("full")) / F.col("open_weight"))
    # The first source that the level does not fill is where the pouring ends.
    ends = F.when(F.col("cap") >= F.col("weight") * F.col("level"), F.struct("turn", "level"))
    return poured.withColumn("last", F.min(ends).over(everything)).select(
        "source", "n_docs", "source_size",
        F.when(F.col("turn") < F.col("last.turn"), F.col("cap"))
        .otherwise(F.least(F.col("cap"), F.col("weight") * F.col("last.level"))).alias("target"),
    )


def mixture(
    documents: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_epochs: float = 3.0, seed: int = 17,
    id_column="doc_id", text_column="text", source_column="source",
) -> DataFrame:
    """doc_id, size, source_size, target, repeats (how often the mix takes the document) and taken (words that it takes)."""
    # md5 in place of a numeric hash: the order is the same in every engine.
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))))
    rows = materialize(
        documents.select(
            F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), n_words(F.col(text_column)).alias("size"),
            key.alias("line"),
        )
    )
    targets = source_targets(rows, weights, max_epochs)
    blocks = F.ceil(F.sqrt(F.col("n_docs").cast("double")))
    share = F.conv(F.substring("line", 1, 8), 16, 10).cast("double") / 4294967296.0
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    named = rows.withColumnRenamed("source", "own").join(targets, F.col("own").eqNullSafe(F.col("source")))
    placed = named.select(
        "doc_id", "source", "size", "line", "source_size", "target", F.floor(share * blocks).alias("block"), ratio.alias("ratio")
    )
    before = Window.unboundedPreceding, -1
    in_block = Window.partitionBy("source", "block").orderBy("line", "doc_id", "size").rowsBetween(*before)
    lined = placed.withColumn("ahead", F.coalesce(F.sum("size").over(in_block), F.lit(0)))
    sums = placed.groupBy("source", "block").agg(F.sum("size").alias("block_size"))
    over = Window.partitionBy("source").orderBy("block").rowsBetween(*before)
    starts = sums.select(
        F.col("source").alias("of"), F.col("block").alias("in"), F.coalesce(F.sum("block_size").over(over), F.lit(0)).alias("start")
    )
    joined = lined.join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("in")))
    rest = (F.col("ratio") - F.floor("ratio")) * F.col("source_size")
    more = (F.col("start") + F.col("ahead") + F.col("size") / 2.0 <= rest) & (F.col("size") > 0)
    repeats = F.floor("ratio").cast("long") + more.cast("long")
    return joined.select(
        "doc_id", "size", "source_size", "target", repeats.alias("repeats"), (F.col("size") * repeats).alias("taken")
    )


def mixed_documents(documents: DataFrame, id_column="doc_id", text_column="text", source_column="source", **options) -> DataFrame:
    """Every row as often as the mix takes it, with all its columns; equal rows are taken together."""
    whole = F.xxhash64(*[F.col(c) for c in documents.columns])
    named = documents.withColumn("_row", whole)
    taken = mixture(named, id_column="_row", text_column=text_column, source_column=source_column, **options)
    often = taken.groupBy("doc_id").agg(F.sum("repeats").alias("_often")).where("_often > 0").withColumnRenamed("doc_id", "_row")
    once = named.dropDuplicates(["_row"]).join(often, "_row")
    return once.withColumn("_turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_often")))).select(*[F.col(c) for c in documents.columns])


def mixture_sql(weights=(5.0, 2.0, 1.0), max_epochs: float = 3.0, seed: int = 17) -> str:
    """The same rows from ``documents`` in SQL."""
    listed = ", ".join(str(float(w)) for w in weights)
    return f"""
    with sized as (
        select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
            md5('{seed}:' || coalesce(doc_id::varchar, '')) as line from documents
    ), totals as (select source, sum(size)::bigint as source_size from sized group by source),
    weighed as (
        select *, ([{listed}])[1 + (row_number() over (order by source asc nulls last) - 1) % {len(weights)}]::double as weight,
            {max_epochs}::double * source_size as cap from totals
    ), poured as (
        select *, row_number() over w as turn, (select sum(source_size) from totals) as total,
            coalesce(sum(cap) over (order by cap / weight, source asc nulls last rows between unbounded preceding and 1 preceding), 0) as f,
            sum(weight) over (order by cap / weight, source asc nulls last rows between current row and unbounded following) as open_weight
        from weighed window w as (order by cap / weight, source asc nulls last)
    ), levels as (select *, (total::double - f) / open_weight as level from poured),
    last as (select turn as last_turn, level as last_level from levels where cap >= weight * level order by turn limit 1),
    targets as (
        select source, source_size, case when turn < last_turn then cap else least(cap, weight * last_level) end as target
        from levels, last
    ), lined as (
        select s.*, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0 end as ratio,
            coalesce(sum(s.size) over (partition by s.source order by line, doc_id, size
                rows between unbounded preceding and 1 preceding), 0)::bigint as ahead
        from sized s join targets t on s.source is not distinct from t.source
    ), taking as (
        select *, floor(ratio)::bigint
            + (size > 0 and ahead + size / 2.0::double <= (ratio - floor(ratio)) * source_size)::bigint as repeats from lined
    )
    select doc_id, size, source_size, target, repeats, (size * repeats)::bigint as taken from taking"""
