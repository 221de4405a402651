"""Recognised boxes to text lines in reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import let, strip

PAGE = ["doc_id", "page"]


def _anchors(ys: Column, tolerance: int) -> Column:
    """First height of each line: a line lasts while y - anchor fits."""

    def step(state: Column, y: Column) -> Column:
        same = (F.size(state) > 0) & (y - F.get(state, F.size(state) - 1) <= tolerance)
        return F.when(same, state).otherwise(F.concat(state, F.array(y)))

    return F.aggregate(ys, F.array().cast("array<bigint>"), step)


def reading_lines(boxes: DataFrame, tolerance: int = 20) -> DataFrame:
    """Lines ``(doc_id, page, anchor, line)`` of boxes ``(x, y, text)``.

    Boxes of one height share a line, so the ordered fold runs over the
    distinct heights of a page, whose number the page height bounds. The boxes
    meet the line of each height by page and are grouped where they met it, so
    they are shuffled once.
    """
    words = boxes.select(
        *PAGE, F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"),
        strip(F.col("text")).alias("text"),
    ).where("text <> '' AND y IS NOT NULL")
    heights = words.groupBy(*PAGE).agg(F.array_sort(F.collect_set("y")).alias("_ys"))
    last = let(
        _anchors(F.col("_ys"), tolerance),
        lambda starts: F.transform("_ys", lambda y: F.array_max(F.filter(starts, lambda a: a <= y))),
    )
    lines = heights.select(*PAGE, F.map_from_arrays("_ys", last).alias("_lines"))
    met = words.join(lines.hint("shuffle_hash"), PAGE).select(*PAGE, F.element_at("_lines", F.col("y")).alias("anchor"), "y", "x", "text")
    line = F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("y", "x", "text"))), lambda b: b.text), " "
    )
    return met.groupBy(*PAGE, "anchor").agg(line.alias("line"))


def reading_text(boxes: DataFrame, tolerance: int = 20) -> DataFrame:
    """Text of each page, one line per row of boxes."""
    ordered = F.sort_array(F.collect_list(F.struct("anchor", "line")))
    return reading_lines(boxes, tolerance).groupBy(*PAGE).agg(
        F.array_join(F.transform(ordered, lambda r: r.line), "\n").alias("text")
    )


def table_regions(boxes: DataFrame) -> DataFrame:
    """Boxes large enough to be a table, from top to bottom."""
    return boxes.where("w > 200 AND h > 100").orderBy(*PAGE, "y", "x")
