"""Token ids of documents in seekable files of zstandard frames, and back."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.byte_tokens import byte_spelled, default_tokenizer
from corpusmill.llm.seekable import Reader, Writer
from corpusmill.session import shared_folder, written

FILES = "shard long, path string, docs long, tokens long, bytes long"
BATCH_CHARS = 4_000_000


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder that Spark names by URI or plain path."""
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows whose texts are tokenised together."""
    held, size = [], 0
    for batch in batches:
        at = 0
        for k, chars in enumerate(pc.utf8_length(batch.column("_text")).to_pylist()):
            size += (chars or 0) + 16
            if size > BATCH_CHARS:
                held.append(batch.slice(at, k + 1 - at))
                yield pa.Table.from_batches(held)
                held, at, size = [], k + 1, 0
        if at < len(batch):
            held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def _write_shard(folder: str, tokenizer: str, end_id: int, frame_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled, end = byte_spelled(tokenizer), end_id.to_bytes(4, "little")
        width = 2 if max(spelled.vocabulary, end_id + 1) <= 1 << 16 else 4
        system, root = _opened(folder)
        task = TaskContext.get()
        shard = task.partitionId()
        path = f"{root}/ids-{shard:06d}-{task.taskAttemptId()}.zst"
        writer = out = None
        for part in _in_parts(batches):
            texts = part.column("_text").combine_chunks()
            for doc_id, tokens in zip(part.column("_id").to_pylist(), spelled.texts(texts)):
                if writer is None:
                    system.create_dir(root, recursive=True)
                    out = system.open_output_stream(path, compression=None)
                    writer = Writer(out, width, frame_bytes)
                writer.add(doc_id, tokens + end)
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pylist([
                {"shard": shard, "path": path, "docs": writer.docs, "tokens": writer.tokens, "bytes": writer.bytes}])

    return write


def write_token_files(
    docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", *,
    tokenizer: str | None = None, end_id: int = 2, frame_bytes: int = 1 << 20,
) -> DataFrame:
    """Writes the ids of all documents, in ascending id order, to files below ``folder``, and
    returns the files ``(shard, path, docs, tokens, bytes)`` in ``folder``'s file system.

    A text becomes the ids of the whole text and ``end_id``; null texts are empty. Null ids
    come first; rows of equal id are documents of their own, in the order of a hash of their
    text. The range exchange samples ids and hashes only, so also many rows of one id are cut.
    An empty table makes no file. Further columns are not read.

    A task streams its range into one file and holds one frame. Its file's name has the
    attempt's number; the returned table, written once all tasks ended, names the files of
    the attempts that counted, so what lost or repeated tasks leave is never read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.withColumn("_tie", F.xxhash64("_text"))
    order = [F.col("_id").asc_nulls_first(), F.col("_tie")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("_id", "_text")
    return written(ranged.mapInArrow(_write_shard(folder, tokenizer or default_tokenizer(), end_id, frame_bytes), FILES), "token-files")


def _reader(system: fs.FileSystem, path: str) -> tuple[Reader, fs.NativeFile]:
    file = system.open_input_file(path)
    return Reader(lambda at, n: file.read_at(n, at), file.size()), file


def _read_shards(folder: str, doc_ids: set[int] | None, with_tokens: bool):
    columns = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["tokens"] * with_tokens

    def frame(rows: list[tuple]) -> pd.DataFrame:
        table = pd.DataFrame(rows, columns=columns, dtype=object)
        return table.assign(doc_id=pd.array(table["doc_id"].tolist(), dtype="Int64"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, _ = _opened(folder)
        for batch in batches:
            for path, base in zip(batch["path"].tolist(), batch["base"].tolist()):
                with system.open_input_file(path) as file:
                    reader = Reader(lambda at, n, file=file: file.read_at(n, at), file.size())
                    out, size = [], 0
                    for d in reader.documents(doc_ids):
                        out.append((d.doc_id, base + d.start, len(d.tokens) // 4, zlib.crc32(d.tokens), *([d.tokens] * with_tokens)))
                        size += len(d.tokens) * with_tokens + 64
                        if size > 1 << 24:
                            yield frame(out)
                            out, size = [], 0
                    yield frame(out)

    return read


def _with_bases(files: DataFrame) -> DataFrame:
    """Files with the tokens of all files before them. There is a row per file, so their
    running sum is made on the driver.
    """
    placed, base = [], 0
    for _, path, tokens in sorted(files.select("shard", "path", "tokens").collect()):
        placed.append((path, base))
        base += tokens
    return files.sparkSession.createDataFrame(placed, "path string, base long").repartition(max(1, len(placed)))


def read_token_files(files: DataFrame, folder: str, doc_ids: set[int] | None = None, *, with_tokens: bool = False) -> DataFrame:
    """Documents ``(doc_id, start, n_tokens, ids_crc32)`` read back from the files, a file a
    task, a frame at a time, each checked; ``start`` counts the tokens of all documents before.

    With ``doc_ids`` only the frames whose directory entry can hold one are decompressed.
    ``with_tokens`` adds the ids as little-endian unsigned 32-bit numbers.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", tokens binary" if with_tokens else "")
    return _with_bases(files).mapInPandas(_read_shards(folder, doc_ids, with_tokens), schema)


def token_folder(spark: SparkSession) -> str:
    """A fresh folder for token files, shared by all executors."""
    return shared_folder(spark, "token-ids")
