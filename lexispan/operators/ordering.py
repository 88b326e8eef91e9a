"""Order-dependent building blocks that survive a very large group.

A plain window over a group puts the whole group into one task. Here the
order column is cut into blocks, the block is part of the partition key, and
only one summary row per block crosses block borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 65536


def _block(order: str, rows: int) -> Column:
    return F.floor(F.col(order) / rows).cast("bigint")


def running_sum(
    df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, rows: int = BLOCK_ROWS,
    block: Column | None = None,
) -> DataFrame:
    """Inclusive running sum per group; the first order column is a whole number."""
    block = _block(order[0], rows) if block is None else block
    df = df.withColumn("__b", block).withColumn("__v", value)
    totals = df.groupBy(*keys, "__b").agg(F.sum("__v").alias("__t"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "__b", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__o"))
    inside = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.withColumn("__s", F.sum("__v").over(inside))
        .join(offsets, [*keys, "__b"])
        .withColumn(name, F.col("__s") + F.col("__o"))
        .drop("__b", "__v", "__s", "__o")
    )


def dense_number(
    df: DataFrame, keys: list[str], order: list[str], name: str, start: int = 0,
    rows: int = BLOCK_ROWS, block: Column | None = None,
) -> DataFrame:
    """Number rows 0, 1, 2, ... per group."""
    out = running_sum(df, keys, order, F.lit(1), name, rows, block)
    return out.withColumn(name, (F.col(name) - 1 + start).cast("bigint"))


def neighbours(
    df: DataFrame, keys: list[str], order: str, columns: dict[str, tuple[str, int]],
    rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Values of the row before or after; ``order`` is dense within the group.

    ``columns`` maps a new name to (source column, -1 or +1). Rows at a block
    border are also sent to the block next door as ghosts.
    """
    b, o = _block(order, rows), F.col(order)
    edge = F.array(
        b, F.when(o % rows == 0, b - 1), F.when(o % rows == rows - 1, b + 1)
    )
    spread = df.withColumn("__home", b).withColumn("__b", F.explode(F.array_compact(edge)))
    w = Window.partitionBy(*keys, "__b").orderBy(order)
    for name, (source, step) in columns.items():
        spread = spread.withColumn(name, F.lag(source, 1).over(w) if step < 0 else F.lead(source, 1).over(w))
    return spread.where("__b = __home").drop("__b", "__home")


def carry_forward(
    df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, rows: int = BLOCK_ROWS
) -> DataFrame:
    """Last non-null value at or before each row."""
    df = df.withColumn("__b", _block(order[0], rows)).withColumn("__v", value)
    last = df.where("__v is not null").groupBy(*keys, "__b").agg(
        F.max_by("__v", F.struct(*order)).alias("__l")
    )
    blocks = df.select(*keys, "__b").distinct().join(last, [*keys, "__b"], "left")
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*keys, "__b", F.last("__l", ignorenulls=True).over(before).alias("__o"))
    inside = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.withColumn("__s", F.last("__v", ignorenulls=True).over(inside))
        .join(blocks, [*keys, "__b"])
        .withColumn(name, F.coalesce("__s", "__o"))
        .drop("__b", "__v", "__s", "__o")
    )


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First k rows per group. Spark limits each map task to k rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
