"""Document versions, activity flags and validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.operators.numbering import BLOCK, dense_index, fill_forward


def version_log(uploads: DataFrame, size: int = BLOCK) -> DataFrame:
    """Version, parent and activity of each upload of a file name, by id.

    One summary row per block of ids and file name is carried over the file's
    history, so that a file with very many uploads is still split.
    """
    rows = uploads.withColumn("_block", F.floor(F.col("id") / size))
    by_block = Window.partitionBy("filename").orderBy("_block")
    earlier = by_block.rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        rows.groupBy("filename", "_block")
        .agg(F.count(F.lit(1)).alias("_n"), F.max("id").alias("_last"))
        .select(
            "filename", "_block",
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
            F.lag("_last").over(by_block).alias("_prev"),
            F.max("_last").over(Window.partitionBy("filename")).alias("_newest"),
        )
    )
    inside = Window.partitionBy("filename", "_block").orderBy("id")
    return rows.join(blocks, ["filename", "_block"]).withColumns({
        "version": (F.row_number().over(inside) + F.col("_before")).cast("bigint"),
        "parent_id": F.coalesce(F.lag("id").over(inside), F.col("_prev")),
        "is_active": F.col("id") == F.col("_newest"),
    }).drop("_block", "_before", "_prev", "_newest")


def version_log_with_deletes(events: DataFrame, size: int = BLOCK) -> DataFrame:
    """Versions where soft deletes and restores happen between uploads.

    ``events`` holds ``(filename, seq, kind, doc_id)`` with kind ``upload``,
    ``delete`` or ``restore`` of the file's latest upload. An upload that finds
    no active row starts again at version 1 without a parent.
    """
    uploads = events.where("kind = 'upload'").select("filename", "seq", F.col("doc_id").alias("id"))
    flags = events.where("kind <> 'upload'").groupBy(F.col("doc_id").alias("prev_id")).agg(
        F.max_by("kind", "seq").alias("last_flag")
    )
    rows = fill_forward(uploads, ["filename"], ["seq"], "id", "prev_id", size, strict=True)
    rows = rows.join(flags, "prev_id", "left")
    rows = dense_index(rows, ["filename"], ["seq"], "n", size)
    fresh = F.col("prev_id").isNull() | F.coalesce(F.col("last_flag") == "delete", F.lit(False))
    rows = rows.withColumn("_start", F.when(fresh, F.col("n")))
    rows = fill_forward(rows, ["filename"], ["seq"], "_start", "_from", size)
    return rows.select(
        "filename", "seq", "id",
        (F.col("n") - F.col("_from") + 1).alias("version"),
        F.when(F.col("_start").isNull(), F.col("prev_id")).alias("parent_id"),
    )


def blocking_uploads(documents: DataFrame) -> DataFrame:
    """Number of active unprocessed documents, and whether uploads may start."""
    waiting = F.count_if(F.col("is_active") & ~F.col("is_processed"))
    return documents.agg(waiting.alias("processing"), (waiting == 0).alias("may_upload"))


def apply_flags(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Next snapshot after soft deletes and restores; ``changes`` is (key, flag)."""
    return (
        rows.join(changes.select(key, "flag"), key, "left")
        .withColumn("is_active", F.coalesce("flag", "is_active"))
        .drop("flag")
    )


def drop_document_chunks(chunks: DataFrame, doc_ids: DataFrame) -> DataFrame:
    return chunks.join(doc_ids.select("doc_id"), "doc_id", "left_anti")


def superseded(log: DataFrame) -> DataFrame:
    """Documents whose chunks an upload removed."""
    return log.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("doc_id"))


def history(log: DataFrame) -> DataFrame:
    """Each version with the file's newest id and version."""
    newest = log.groupBy("filename").agg(F.max("version").alias("newest_version"), F.max("id").alias("newest_id"))
    return log.join(newest, "filename")


def rollback(log: DataFrame, targets: DataFrame) -> DataFrame:
    """Make the chosen version of a file its only active one."""
    chosen = targets.select("filename", F.col("id").alias("_target"))
    return log.join(chosen, "filename", "left").withColumn(
        "is_active", F.when(F.col("_target").isNotNull(), F.col("id") == F.col("_target")).otherwise(F.col("is_active"))
    ).drop("_target")


def valid_at(ts: Column) -> Column:
    """Effective on or before ``ts`` and not yet expired; open ends allowed."""
    started = F.col("effective_date").isNull() | (F.col("effective_date") <= ts)
    running = F.col("expiry_date").isNull() | (ts < F.col("expiry_date"))
    return started & running


def backfill_role(users: DataFrame) -> DataFrame:
    plain = F.col("role").isNull() | (F.col("role") == "user")
    return users.withColumn("role", F.when(F.col("is_superuser") & plain, "admin").otherwise(F.col("role")))


def add_column(df: DataFrame, name: str, kind: str, default=None) -> DataFrame:
    """Column with a default, unless it is there already."""
    return df if name in df.columns else df.withColumn(name, F.lit(default).cast(kind))
