"""Byte passages that stand earlier as well, found by suffix arrays over candidate segments."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.hashing import mixed, nonzero, prefix_sums, run_hashes
from corpusmill.llm.repeats import SCHEMA, marked, settled
from corpusmill.llm.suffixes import shared, suffix_order
from corpusmill.session import written

GRAM, PIECE = 24, 60_000
SECOND = 0xC2B2AE3D27D4EB4F
BLOCK_BYTES, BLOCK_SEGMENTS = 1 << 20, 1 << 16


def segments(raw: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Key, context, first start and number of starts of a text's segments.

    All windows of ``length`` bytes whose smallest 24-byte hash, the leftmost of equal
    ones, stands at one place are a segment; equal windows have equal keys, wherever
    they stand. Context is a hash of the segment's bytes and of where the place is in it.
    """
    kept = [[], [], [], []]
    width = length - GRAM + 1
    for base in range(0, len(raw) - length + 1, PIECE):
        b = raw[base : base + PIECE + length - 1]
        sums = prefix_sums(b.astype(np.uint64) + np.uint64(1))
        at = np.arange(len(b) - GRAM + 1)
        grams = run_hashes(sums, at, at + GRAM)
        least = (grams & ~np.uint64(0xFFFF)) | at.astype(np.uint64)
        size = 1
        while size < width:
            step = min(size, width - size)
            least, size = np.minimum(least[:-step], least[step:]), size + step
        place = (least & np.uint64(0xFFFF)).astype(np.int64)
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        number = np.diff(np.append(first, len(place)))
        end = first + number - 1 + length
        context = run_hashes(sums, first, end) + (place[first] - first).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)
        for c, v in zip(kept, (mixed(grams[place[first]]).view(np.int64), nonzero(mixed(context)), base + first, number)):
            c.append(v)
    return tuple(np.concatenate(c) for c in kept) if kept[0] else (np.zeros(0, np.int64),) * 4


def later(text: np.ndarray, lengths: np.ndarray, ids: np.ndarray, at: np.ndarray, span: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Segment, start and verdict of every window in a block of segments.

    ``text`` holds the segments one after the other. True where an equal window of smaller
    (id, start) is in the block.
    """
    ends = np.repeat(np.cumsum(lengths), lengths)
    begin = np.cumsum(lengths) - lengths
    inside = np.arange(len(text)) - np.repeat(begin, lengths)
    wanted = inside < np.repeat(span, lengths)
    order = suffix_order(text, ends, wanted, length)
    segment = np.searchsorted(begin, order, side="right") - 1
    start = at[segment] + order - begin[segment]
    run = np.cumsum(np.append(True, ~shared(order, text, ends, length)))
    by = np.lexsort((start, ids[segment], run))
    head = np.append(True, run[by][1:] != run[by][:-1])
    best = np.flatnonzero(head)[np.cumsum(head) - 1]
    after = (ids[segment[by]] != ids[segment[by[best]]]) | (start[by] != start[by[best]])
    return segment[by], start[by], after


def _runs(ids: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """id, first and end byte of each run of windows at neighbouring starts."""
    order = np.lexsort((start, ids))
    ids, start = ids[order], start[order]
    new = np.append(True, (ids[1:] != ids[:-1]) | (start[1:] > start[:-1] + 1)) if len(ids) else np.zeros(0, bool)
    close = np.append(new[1:], True) if len(ids) else new
    return ids[new], start[new], start[close] + length


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = 100) -> DataFrame:
    """Per input row: id, n_bytes, n_removed, n_spans, kept_sha256 and spans, the removed
    byte ranges.

    A byte goes if a string of ``length`` bytes over it also starts earlier, in a document
    of smaller id or before in the same one. Windows are grouped into segments by the
    smallest hash inside them, so equal windows meet under one key. Segments that are
    equal as a whole settle at once. Where different ones share a key, their texts are
    sorted by two-stage suffix sorting in blocks of about a megabyte, and windows with
    a common prefix of full length are compared by place. A key with more segments than
    a block holds is sorted in several, whose windows then meet by hash.

    Null texts are empty. Ids are whole numbers; a null id takes no part and loses
    nothing; rows of one id are one document.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = base.where("id IS NOT NULL")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[], [], [], [], []]
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                raw = np.frombuffer((text.as_py() or "").encode("utf-8", "replace"), np.uint8)
                if len(raw) >= length:
                    key, context, at, span = segments(raw, length)
                    for c, v in zip(found, (key, context, np.full(len(key), i, np.int64), at, span)):
                        c.append(v)
            if found[0]:
                yield settled(*(np.concatenate(c) for c in found))

    place = F.struct("at", "span")
    marks = written(
        marked(known.mapInArrow(first, SCHEMA)).groupBy("id").agg(
            F.collect_set(F.when(F.col("repeated") & ~F.col("first"), place)).alias("gone"),
            F.collect_set(F.when(F.col("open"), F.struct("key", "at", "span"))).alias("open")), "suffix-segments")

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                out = []
                for i, text, wanted in zip(*(batch.column(c).slice(lo, 256).to_pylist() for c in ("id", "text", "open"))):
                    raw = (text or "").encode("utf-8", "replace")
                    out += [(w["key"], i, w["at"], w["span"], raw[w["at"] : w["at"] + w["span"] + length - 1]) for w in wanted]
                columns = list(zip(*out)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["key", "id", "at", "span", "bytes"])

    def sorted_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, whole = [], 0, True  # whole: the block holds all of the keys in it

        def close(complete: bool) -> pa.RecordBatch:
            nonlocal block, size
            text = np.frombuffer(b"".join(r[4] for r in block), np.uint8)
            ids, at, span = (np.array([r[k] for r in block], np.int64) for k in (1, 2, 3))
            segment, start, after = later(text, np.array([len(r[4]) for r in block]), ids, at, span, length)
            lost = _runs(ids[segment[after]], start[after], length)
            columns = [*lost, np.zeros(len(lost[0]), np.int64), np.zeros(len(lost[0]), np.int64)]
            if not complete:  # the first ones of this block meet those of the key's other blocks
                left = ~after
                begin = np.cumsum([0, *(len(r[4]) for r in block)])[segment[left]] + start[left] - at[segment[left]]
                sums = [prefix_sums(text.astype(np.uint64) + np.uint64(1), p) for p in (0x9E3779B97F4A7C15, SECOND)]
                hashes = [run_hashes(s, begin, begin + length, p).view(np.int64) | k for s, p, k in zip(sums, (0x9E3779B97F4A7C15, SECOND), (1, 0))]
                more = [ids[segment[left]], start[left], start[left] + length, *hashes]
                columns = [np.concatenate(p) for p in zip(columns, more)]
            block, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["id", "low", "high", "a", "b"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "id", "at", "span", "bytes"))):
                if block and (size >= BLOCK_BYTES or len(block) >= BLOCK_SEGMENTS):
                    if row[0] != block[-1][0]:
                        yield close(whole)
                        whole = True
                    elif size >= 4 * BLOCK_BYTES:
                        yield close(False)
                        whole = False
                block.append(row)
                size += len(row[4])
        if block:
            yield close(whole)

    opened = known.join(marks.where(F.size("open") > 0).select("id", "open"), "id").select("id", "text", "open")
    met = opened.mapInArrow(fetched, "key long, id long, at int, span int, bytes binary").repartition("key").sortWithinPartitions("key", "id", "at")
    found = written(met.mapInArrow(sorted_blocks, "id long, low long, high long, a long, b long"), "suffix-runs")
    apart = found.where("a <> 0")
    earliest = apart.groupBy("a", "b").agg(F.min(F.struct("id", "low")).alias("place"))
    crossed = apart.join(earliest, ["a", "b"]).where(F.struct("id", "low") > F.col("place")).select("id", "low", "high")
    runs = found.where("a = 0").select("id", "low", "high").union(crossed).groupBy("id").agg(F.collect_list(F.struct("low", "high")).alias("runs"))
    joined = known.join(marks.select("id", "gone").join(runs, "id", "full"), "id", "left").select("id", "text", "gone", "runs")
    kinds = "array<struct<at:int,span:int>>", "array<struct<low:bigint,high:bigint>>"
    alone = base.where("id IS NULL").select("id", "text", F.lit(None).cast(kinds[0]).alias("gone"), F.lit(None).cast(kinds[1]).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span_kind = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
        for batch in batches:
            out = []
            for text, gone, runs in zip(*(batch.column(c) for c in ("text", "gone", "runs"))):
                raw = (text.as_py() or "").encode("utf-8", "replace")
                lost = sorted([(g["at"], g["at"] + g["span"] + length - 1) for g in gone.as_py() or []] + [(r["low"], r["high"]) for r in runs.as_py() or []])
                spans: list[list[int]] = []
                for low, high in lost:
                    if spans and low <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], high)
                    else:
                        spans.append([low, high])
                kept = hashlib.sha256()
                for a, b in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(raw)]):
                    kept.update(raw[a:b])
                out.append((len(raw), sum(b - a for a, b in spans), len(spans), kept.hexdigest(), [{"low": a, "high": b} for a, b in spans]))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), span_kind)))],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    fields = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<low:bigint,high:bigint>>"
    return joined.union(alone).mapInArrow(cut, fields).withColumnRenamed("id", id_col)
