"""Spreadsheet cell grids to Markdown chunks of 20 rows.

Input rows are ``(doc_id, sheet, row_idx, cells)`` with null for an empty cell.
Row indexes are dense, so a row's batch follows from its index; rows are
rendered before the only row-level shuffle, which groups at most 20 of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill import vocab
from corpusmill.functions.metadata import sheet_row_ids
from corpusmill.functions.text import contains_any, strip

SHEET = ["doc_id", "sheet"]


def _row_text(cells: Column) -> Column:
    return F.lower(F.array_join(cells, " "))


def _one_line(c: Column) -> Column:
    return strip(F.regexp_replace(c, "\n", " "))


def header_rows(grids: DataFrame) -> DataFrame:
    """Index of each sheet's header row: the first with a header word, else 0."""
    found = F.when(contains_any(_row_text(F.col("cells")), vocab.SHEET_HEADER_TOKENS), F.col("row_idx"))
    return grids.groupBy(*SHEET).agg(F.coalesce(F.min(found), F.lit(0)).alias("header_idx"))


def sheet_heads(grids: DataFrame) -> DataFrame:
    """Preamble text, column names and first data row of each sheet."""
    top = grids.join(header_rows(grids), SHEET).where("row_idx <= header_idx + 1")
    filled = F.filter(
        F.transform("cells", lambda c: strip(F.coalesce(c, F.lit("")))), lambda c: c != ""
    )
    line = F.when(
        (F.col("row_idx") < F.col("header_idx")) & (F.size(filled) > 0),
        F.concat(F.lit(" - "), F.array_join(filled, " | ")),
    )
    here = F.when(F.col("row_idx") == F.col("header_idx"), F.col("cells"))
    below = F.when(
        (F.col("row_idx") > F.col("header_idx"))
        & contains_any(_row_text(F.col("cells")), vocab.SUB_HEADER_TOKENS),
        F.col("cells"),
    )
    heads = top.groupBy(*SHEET, "header_idx").agg(
        F.sort_array(F.collect_list(F.when(line.isNotNull(), F.struct("row_idx", line.alias("line"))))).alias("pre"),
        F.first(here, ignorenulls=True).alias("head"),
        F.first(below, ignorenulls=True).alias("sub"),
    )
    names = F.transform(
        "head", lambda c, j: F.coalesce(_one_line(c), F.concat(F.lit("Column_"), j.cast("string")))
    )
    two_level = F.zip_with(
        names,
        F.transform("sub", lambda c: F.coalesce(_one_line(c), F.lit(""))),
        lambda h, s: strip(F.concat(h, F.lit(" "), s)),
    )
    context = F.array_join(F.transform("pre", lambda p: p.line), "\n")
    return heads.select(
        *SHEET,
        "header_idx",
        (F.col("header_idx") + F.when(F.col("sub").isNotNull(), 2).otherwise(1)).alias("data_idx"),
        F.coalesce(two_level, names).alias("headers"),
        F.when(
            context != "",
            F.concat(F.lit(f"{vocab.SHEET_CONTEXT_TITLE}\n"), context, F.lit(f"\n\n{vocab.SHEET_LIST_TITLE}\n")),
        ).otherwise(F.lit(f"{vocab.SHEET_LIST_TITLE}\n")).alias("context"),
    )


def sheet_chunks(grids: DataFrame, rows_per_chunk: int = vocab.ROWS_PER_TABLE_CHUNK) -> DataFrame:
    """One Markdown chunk per 20 data rows, behind the sheet's preamble."""
    heads = sheet_heads(grids)
    cleaned = F.transform(
        "cells",
        lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "\n", " "), r"\.0\z", ""),
    )
    batches = (
        grids.join(heads.select(*SHEET, "data_idx"), SHEET)
        .where("row_idx >= data_idx")
        .withColumn("batch", F.floor((F.col("row_idx") - F.col("data_idx")) / rows_per_chunk))
        .withColumn("clean", cleaned)
        .select(
            *SHEET, "batch", "row_idx",
            F.concat(F.lit("| "), F.array_join("clean", " | "), F.lit(" |")).alias("line"),
            sheet_row_ids(F.col("clean")).alias("ids"),
        )
        .groupBy(*SHEET, "batch")
        .agg(F.sort_array(F.collect_list(F.struct("row_idx", "line", "ids"))).alias("rows"))
    )
    rule = F.array_join(F.transform("headers", lambda _: F.lit("---")), "|")
    content = F.concat(
        "context",
        F.lit("| "), F.array_join("headers", " | "), F.lit(" |\n|"), rule, F.lit("|\n"),
        F.array_join(F.transform("rows", lambda r: r.line), "\n"),
    )
    return batches.join(heads, SHEET).select(
        *SHEET, "batch", content.alias("content"),
        F.lit("excel_table").alias("content_type"),
        F.flatten(F.transform("rows", lambda r: r.ids)).alias("student_ids_in_chunk"),
        F.size("rows").alias("table_row_count"),
        F.col("headers").alias("table_headers"),
    )
