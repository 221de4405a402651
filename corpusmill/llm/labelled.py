"""Labelled rows that a model may learn from, and held-out rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(id_col: str) -> Column:
    """True for the fold that nothing is learned from: crc32 of the id as text mod 5 is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, seed: int = 3) -> DataFrame:
    """(id, text, label): at most ``rows`` labelled documents outside the held-out fold.

    The rows of smallest seeded hash are taken, so the sample is the same in each run.
    Its ids, bounded by ``rows``, are broadcast to the documents. Ids with more than
    one label, and null ids, texts and labels, are left out.
    """
    usable = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("_most")).where("label = _most").select("doc_id", "label"))
    picked = usable.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(rows)
    return (
        docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(picked), "doc_id")
        .select(F.col("doc_id").alias("id"), "text", F.col("label").cast("int").alias("label")))
