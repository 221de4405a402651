"""Continuous ingest: new pages to stored chunks, in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmill.operators.chunking import ingest
from corpusmill.operators.versions import drop_document_chunks, superseded
from corpusmill.sources.sinks import read_chunks, write_chunks

PAGE_SCHEMA = "doc_id bigint, page bigint, raw_text string"


def current_chunks(spark: SparkSession, store: str, log: DataFrame) -> DataFrame:
    """Stored chunks less those of documents that a later version in the log replaced."""
    return drop_document_chunks(read_chunks(spark, f"{store}/chunks"), superseded(log))


def start_ingest(
    spark: SparkSession, pages_dir: str, documents: DataFrame, store: str, checkpoint: str,
    files_per_trigger: int = 1, buckets: int = 64, schema: str = PAGE_SCHEMA,
) -> StreamingQuery:
    """Ingest page files (all pages of a document in one file) as they arrive.

    Each micro-batch is a batch of the store, so a repeated one replaces its
    own rows and no others. ``processed`` beside the store lists the documents
    written, one row per document and micro-batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        chunks = ingest(batch.select("doc_id", "page", "raw_text"), documents)
        write_chunks(batch.sparkSession, chunks, f"{store}/chunks", buckets, batch_id)
        done = batch.select("doc_id").distinct().withColumn("batch_id", F.lit(batch_id))
        (
            done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id").parquet(f"{store}/processed")
        )

    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(pages_dir)
        .writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
