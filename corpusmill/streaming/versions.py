"""Versions of uploaded files as keyed state, and tombstones of the chunks they replace."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusmill.operators.versions import drop_document_chunks
from corpusmill.sources.sinks import read_chunks, write_chunks

EVENT_SCHEMA = "filename string, seq bigint, kind string, doc_id bigint"
OUTPUT = "filename string, seq bigint, id bigint, version bigint, parent_id bigint"
STATE = "last_id bigint, version bigint, deleted boolean"


def stream_versions(events: DataFrame) -> DataFrame:
    """Version and parent of each upload of a stream of ``EVENT_SCHEMA``, as
    ``versions.version_log_with_deletes`` gives them for a table.

    State per file name is its latest upload, that upload's version and whether it is
    deleted. Within a micro-batch events are taken by ``seq``; across micro-batches those
    of a file name must arrive in order. Flags of another than the latest upload change
    nothing, and a file name's events of one micro-batch meet in one task.
    """

    def update(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, version, deleted = state.get if state.exists else (None, 0, False)
        rows = []
        for event in pd.concat(batches).sort_values("seq").itertuples(index=False):
            if event.kind == "upload":
                parent = None if deleted else last
                last, version, deleted = int(event.doc_id), 1 if parent is None else version + 1, False
                rows.append((key[0], event.seq, last, version, parent))
            elif event.doc_id == last:
                deleted = event.kind == "delete"
        state.update((last, version, deleted))
        yield pd.DataFrame(rows, columns=["filename", "seq", "id", "version", "parent_id"]).astype({"parent_id": "Int64"})

    return events.groupBy("filename").applyInPandasWithState(update, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def start_versions(events: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Write the versions of each micro-batch, with its number, to ``store/versions``.

    A repeated micro-batch replaces its own rows. A version with a parent is the
    tombstone of the parent's chunks.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/versions/batch_id={batch_id}")

    return (
        stream_versions(events).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def read_versions(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(OUTPUT).parquet(f"{store}/versions")


def tombstones(spark: SparkSession, store: str) -> DataFrame:
    """Documents whose chunks a later upload replaced."""
    return read_versions(spark, store).where("parent_id IS NOT NULL").select(F.col("parent_id").alias("doc_id"))


def live_chunks(spark: SparkSession, store: str) -> DataFrame:
    """The latest chunks of ``store/chunks`` less those with a tombstone."""
    return drop_document_chunks(read_chunks(spark, f"{store}/chunks"), tombstones(spark, store))


def compact_store(spark: SparkSession, store: str, target: str, buckets: int = 64) -> None:
    """The live chunks as the first batch of the new store ``target``, which holds no file of a replaced one."""
    write_chunks(spark, live_chunks(spark, store).drop("doc_bucket"), f"{target}/chunks", buckets, -1)
