"""Keyed chunk store on Parquet, message append and processed flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.numbering import first_per_key


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows by ``chunk_uid``; new rows replace old ones."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return first_per_key(both, ["chunk_uid"], [F.desc("_new")]).drop("_new")


def attach_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks with their vectors; a chunk without one is an error at run time."""
    joined = chunks.join(vectors.select("chunk_uid", "embedding"), "chunk_uid", "left")
    checked = F.when(F.col("embedding").isNull(), F.raise_error(F.lit("chunk without vector"))).otherwise(F.col("embedding"))
    return joined.withColumn("embedding", checked)


def bucket(doc_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(buckets)).cast("int")


def write_chunks(spark: SparkSession, new: DataFrame, path: str, buckets: int = 64, batch: int = 0) -> None:
    """Add one batch of chunks to a store partitioned by batch and document bucket.

    A batch is a folder of its own and no other is touched, so a failed write loses
    nothing and writing a batch again replaces it. Later batches win on reading.
    """
    placed = new.withColumn("doc_bucket", bucket(F.col("doc_id"), buckets))
    placed.write.mode("overwrite").partitionBy("doc_bucket").parquet(f"{path}/store_batch={batch}")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The store's rows: of each ``chunk_uid`` that of the latest batch."""
    return first_per_key(spark.read.parquet(path), ["chunk_uid"], [F.desc("store_batch")]).drop("store_batch")


def compact_chunks(spark: SparkSession, path: str, target: str, buckets: int = 64) -> None:
    """The store's rows as one batch before all others of the new store ``target``."""
    write_chunks(spark, read_chunks(spark, path).drop("doc_bucket"), target, buckets, -1)


def reset_chunks(spark: SparkSession, path: str) -> None:
    """Drop all batches of a store; it holds no file until the next one is written."""
    empty = spark.read.parquet(path).limit(0)
    empty.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("store_batch", "doc_bucket").parquet(path)


def turn_messages(turns: DataFrame) -> DataFrame:
    """Two messages per turn, the user's before the answer."""
    pair = F.array(
        F.struct(F.lit("user").alias("role"), F.col("query").alias("content"), F.lit(0).alias("part")),
        F.struct(F.lit("ai").alias("role"), F.col("answer").alias("content"), F.lit(1).alias("part")),
    )
    return turns.select("session_id", "turn", F.explode(pair).alias("m")).select(
        "session_id", (F.col("turn") * 2 + F.col("m.part")).alias("turn"), "m.role", "m.content"
    )


def append_messages(messages: DataFrame, path: str) -> None:
    messages.write.mode("append").parquet(path)


def mark_processed(documents: DataFrame, written: DataFrame) -> DataFrame:
    """Documents whose chunks were written become processed."""
    done = written.select(F.col("doc_id").alias("id")).distinct().withColumn("_done", F.lit(True))
    return documents.join(done, "id", "left").withColumn(
        "is_processed", F.coalesce("_done", "is_processed")
    ).drop("_done")
