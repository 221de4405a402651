"""Passages of words that stand elsewhere as well, found by difference-cover anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.hashing import P, mixed, nonzero, prefix_sums, run_hashes, word_bounds
from corpusmill.llm.repeats import SCHEMA, marked, settled
from corpusmill.session import written

# Every difference modulo 21 is one of two members, so two equal passages have equal
# offsets, fewer than 21 words in, at which both stand on the cover.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
SECOND = 0xC2B2AE3D27D4EB4F


def word_sums(text: str | None) -> tuple[bytes, np.ndarray, np.ndarray, list[np.ndarray]]:
    """The text's bytes, the bounds of its words, and running sums over the words' hashes."""
    raw = (text or "").encode("utf-8", "replace")
    start, end = word_bounds(raw)
    words = run_hashes(prefix_sums(np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)), start, end)
    return raw, start, end, [prefix_sums(words), prefix_sums(words, SECOND)]


def passage_hashes(sums: list[np.ndarray], start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of 64 bits for each run of words; the second is never 0."""
    a, b = run_hashes(sums[0], start, end, P), run_hashes(sums[1], start, end, SECOND)
    return a.view(np.int64), nonzero(b)


def anchors(sums: list[np.ndarray], window: int) -> tuple[np.ndarray, ...]:
    """Key, context, position and window starts before it, for each anchor of a document.

    An anchor is a run of ``window - 20`` words at a cover position; its context reaches
    over all windows that hold the run.
    """
    n, width = len(sums[0]) - 1, window - PERIOD + 1
    at = np.arange(max(0, n - width + 1) if n >= window else 0)
    at = at[np.isin(at % PERIOD, COVER)]
    low, high = np.maximum(at - (PERIOD - 1), 0), np.minimum(at + window, n)
    key, _ = passage_hashes(sums, at, at + width)
    context = run_hashes(sums[1], low, high, SECOND) + (at - low).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)
    return key, nonzero(mixed(context)), at, np.zeros(len(at), np.int64)


def _sightings(batch: pa.RecordBatch, of) -> Iterator[pa.RecordBatch]:
    found = [[], [], [], [], []]
    for i, row in enumerate(zip(*(batch.column(c) for c in batch.schema.names))):
        key, context, at, span = of(*row[1:])
        for kept, c in zip(found, (key, context, np.full(len(key), row[0].as_py(), np.int64), at, span)):
            kept.append(c)
    if found[0]:
        yield settled(*(np.concatenate(c) for c in found))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = 35) -> DataFrame:
    """Per input row: id, n_words, n_removed, kept_sha256 and kept, the words left, joined
    by spaces.

    A word goes if a window of ``window`` words over it stands anywhere else, in another
    document or in the same. First, hashes of short runs at cover positions meet: equal
    runs with equal surroundings settle all windows around them. Where runs are equal but their
    surroundings differ, matches are extended: the hashes of the single windows meet.
    Only texts of documents with such runs are read for that.

    Null texts have no words. Ids are whole numbers; a null id takes no part in matches and
    loses nothing; rows of one id are copies of each other.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = base.where("id IS NOT NULL")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _sightings(batch, lambda text: anchors(word_sums(text.as_py())[3], window))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def single(text, open_at) -> tuple[np.ndarray, ...]:
            sums = word_sums(text.as_py())[3]
            n = len(sums[0]) - 1
            at = np.array(open_at.as_py(), np.int64)
            starts = np.unique((at[:, None] - np.arange(PERIOD)).reshape(-1))
            starts = starts[(starts >= 0) & (starts <= n - window)]
            key, context = passage_hashes(sums, starts, starts + window)
            return key, context, starts, np.zeros(len(starts), np.int64)

        for batch in batches:
            yield from _sightings(batch, single)

    marks = written(
        marked(known.mapInArrow(first, SCHEMA)).groupBy("id").agg(
            F.collect_set(F.when(F.col("repeated"), F.col("at"))).alias("around"), F.collect_set(F.when(F.col("open"), F.col("at"))).alias("open")), "substring-anchors")
    opened = known.join(marks.where(F.size("open") > 0).select("id", "open"), "id").select("id", "text", "open")
    extended = marked(opened.mapInArrow(second, SCHEMA)).where("repeated").groupBy("id").agg(F.collect_set("at").alias("starts"))
    joined = known.join(marks.select("id", "around").join(written(extended, "substring-windows"), "id", "full"), "id", "left")
    whole = base.where("id IS NULL").select("id", "text", F.lit(None).cast("array<int>").alias("around"), F.lit(None).cast("array<int>").alias("starts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, around, starts in zip(*(batch.column(c) for c in ("text", "around", "starts"))):
                words = (text.as_py() or "").encode("utf-8", "replace").split()
                n = len(words)
                steps = np.zeros(n + 1, np.int64)
                at = np.array(around.as_py() or [], np.int64)
                low, high = np.maximum(at - (PERIOD - 1), 0), np.minimum(at + window, n)
                fits = (high - low) >= window
                one = np.array(starts.as_py() or [], np.int64)
                np.add.at(steps, np.concatenate([low[fits], one]), 1)
                np.add.at(steps, np.concatenate([high[fits], one + window]), -1)
                kept = b" ".join([w for w, c in zip(words, np.cumsum(steps)[:-1].tolist()) if not c]) if steps.any() else b" ".join(words)
                out.append((n, int((np.cumsum(steps)[:-1] > 0).sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
            columns = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string())))], names=["id", "n_words", "n_removed", "kept_sha256", "kept"])

    rows = joined.select("id", "text", "around", "starts").union(whole)
    return rows.mapInArrow(cut, "id long, n_words long, n_removed long, kept_sha256 string, kept string").withColumnRenamed("id", id_col)
