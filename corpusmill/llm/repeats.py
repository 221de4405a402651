"""Passages seen more than once: sightings gathered by hash, with each task's own repeats
settled before anything is shuffled.

A sighting is (key, context, id, at, span): the hash of an anchor, the hash of the
passage around it, and where it stands. Of equal sightings, a task sends one on; the
others are known to be repeats at once. So a passage that a third of all documents share
arrives once per task and batch, and no group is ever held in memory.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

COLUMNS = ("key", "context", "id", "at", "span", "seen")
SCHEMA = "key long, context long, id long, at int, span int, seen boolean"
KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
MARKS = "key long, id long, at int, span int, repeated boolean, open boolean, first boolean"


def _batch(names: tuple[str, ...], kinds: tuple, columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=list(names))


def settled(key: np.ndarray, context: np.ndarray, ids: np.ndarray, at: np.ndarray, span: np.ndarray) -> pa.RecordBatch:
    """One sighting of each (key, context), the first by (id, at), and all further ones as
    ``seen`` with a key of their own that spreads them evenly. The first one is ``seen`` as
    well if there are further ones; its key stays. Sightings at the place of another one,
    from rows of one id, are sent once.
    """
    order = np.lexsort((at, ids, context, key))
    key, context, ids, at, span = (c[order] for c in (key, context, ids, at, span))
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (context[1:] != context[:-1])
    seen = ~new
    several = new & np.append(seen[1:], False)
    once = new.copy()
    once[1:] |= (ids[1:] != ids[:-1]) | (at[1:] != at[:-1])
    own = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + at.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)
    # context is 0 for the further ones only: hashes of contexts are never 0
    columns = [np.where(seen, own, key), np.where(seen, 0, context), ids, at, span, seen | several]
    return _batch(COLUMNS, KINDS, [c[once] for c in columns])


def marked(sightings: DataFrame) -> DataFrame:
    """(key, id, at, span, repeated, open): the sightings that matter.

    ``repeated``: the passage around it stands elsewhere as well, before it or after it;
    the first of equal passages has it too, and ``first`` tells it and all sightings at its
    place apart. ``open``: the first of its passage, where other passages share the anchor, so that longer matches
    inside have still to be looked for.
    """
    names = ("key", "id", "at", "span", "repeated", "open", "first")
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_())

    def tasks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None  # rows of the running key that the next rows may decide: one or two
        prior = None  # key, context, place and ``first`` of the row before them, where that key is crowded

        def work(columns: list[np.ndarray], end: bool) -> pa.RecordBatch:
            nonlocal carried, prior
            key, context, ids, at, span, seen = columns
            n, own = len(key), context != 0
            same_key, same, place = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
            same_key[1:] = (key[1:] == key[:-1]) & own[1:] & own[:-1]
            same[1:] = same_key[1:] & (context[1:] == context[:-1])
            place[1:] = same[1:] & (ids[1:] == ids[:-1]) & (at[1:] == at[:-1])
            if prior is not None and own[0]:
                same_key[0] = key[0] == prior[0]
                same[0] = same_key[0] and context[0] == prior[1]
                place[0] = same[0] and (ids[0], at[0]) == prior[2:4]
            repeated = seen | same
            repeated[:-1] |= same[1:]
            run = np.cumsum(~same_key)  # 0 where it goes on from before
            crowded = np.zeros(int(run[-1]) + 1, bool)
            crowded[run[same_key & ~same]] = True
            crowded[0] = True
            first = own & ~same
            opened = first & crowded[run]
            # rows at one place follow each other; all are first if the one they begin with is
            begin = np.maximum.accumulate(np.where(place, 0, np.arange(n)))
            first = np.where(place[begin], prior is not None and prior[4], first[begin])
            emit = np.ones(n, bool)
            if not end:
                low = int(np.searchsorted(run, run[-1]))
                if crowded[run[-1]]:
                    emit[-1] = False
                    prior = (key[-2], context[-2], ids[-2], at[-2], first[-2]) if n - 1 > low else (prior if run[-1] == 0 else None)
                else:
                    emit[low] = emit[-1] = False
                    prior = None
                carried = [c[~emit] for c in columns]
            keep = emit & (repeated | opened)
            return _batch(names, kinds, [c[keep] for c in (key, ids, at, span, repeated, opened, first)])

        for batch in batches:
            if batch.num_rows:
                columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in COLUMNS]
                yield work([np.concatenate(p) for p in zip(carried, columns)] if carried else columns, False)
        if carried:
            yield work(carried, True)

    sent = sightings.repartition("key").sortWithinPartitions("key", "context", "id", "at")
    return sent.mapInArrow(tasks, MARKS)
