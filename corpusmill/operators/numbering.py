"""Ordered operators that do not put a whole group into one task.

A plain window over a group sorts the group in one task. Where a group may hold
a large part of all rows, these operators cut it into blocks of the leading
order column, solve each block alone, and carry one small summary row per block
across the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 4096


def _block(order: str, size: int) -> Column:
    return F.floor(F.col(order) / size)


def dense_index(
    df: DataFrame, keys: list[str], order: list[str], name: str, size: int = BLOCK, whole: Column | None = None
) -> DataFrame:
    """Row number 1..n within ``keys`` by ``order``; ``order[0]`` is a number.

    ``whole``, the same for all rows of a key, marks groups known to be small: each is one
    block, so that only the others' blocks are counted.
    """
    block = _block(order[0], size)
    if whole is not None:
        whole = F.coalesce(whole, F.lit(False))
        block = F.when(whole & F.col(order[0]).isNotNull(), F.lit(0)).otherwise(block)
    df = df.withColumn("_block", block)
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        (df if whole is None else df.where(~whole)).groupBy(*keys, "_block")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    placed = df.join(offsets, [*keys, "_block"], "inner" if whole is None else "left")
    before = F.col("_before") if whole is None else F.coalesce("_before", F.lit(0))
    return placed.withColumn(name, (F.row_number().over(inside) + before).cast("bigint")).drop("_block", "_before")


def fill_forward(
    df: DataFrame, keys: list[str], order: list[str], value: str, name: str, size: int = BLOCK,
    strict: bool = False,
) -> DataFrame:
    """Last non-null ``value`` up to the row (``strict``: before the row)."""
    df = df.withColumn("_block", _block(order[0], size))
    last_in_block = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order)))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        df.groupBy(*keys, "_block")
        .agg(last_in_block.alias("_last"))
        .select(*keys, "_block", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    )
    end = -1 if strict else 0
    inside = (
        Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    )
    return (
        df.join(carried, [*keys, "_block"])
        .withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col("_carried")))
        .drop("_block", "_carried")
    )


def neighbours(
    df: DataFrame, keys: list[str], index: str, before: int, columns: list[str], name: str, size: int = BLOCK
) -> DataFrame:
    """Array of the up to ``before`` preceding rows (as structs, oldest first).

    ``index`` is a dense row number. The last rows of a block are copied to the
    next block, so frames never look outside their own block.
    """
    df = df.withColumn("_block", _block(index, size)).withColumn("_copy", F.lit(False))
    halo = df.where(F.col(index) % size >= size - before).withColumns(
        {"_block": F.col("_block") + 1, "_copy": F.lit(True)}
    )
    frame = Window.partitionBy(*keys, "_block").orderBy(index).rowsBetween(-before, -1)
    return (
        df.unionByName(halo)
        .withColumn(name, F.collect_list(F.struct(*columns)).over(frame))
        .where(~F.col("_copy"))
        .drop("_block", "_copy")
    )


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of each key; each map task already keeps one row per key."""
    by_order = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(by_order)).where("_rn = 1").drop("_rn")


def page(df: DataFrame, order: list[Column], skip: int, limit: int) -> DataFrame:
    """Offset and limit in a stated order."""
    return df.orderBy(*order).offset(skip).limit(limit)
