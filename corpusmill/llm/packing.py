"""Packing token ids into sequences of fixed length by minimum bin slack."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.tokens import default_tokenizer, spelled

FIELDS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length make the sum closest to, and not above, the capacity.

    Bit s of a whole number says that sum s can be reached. Lengths enter from the
    longest on, their counts in powers of two; the bits before each entry are kept, so the
    chosen counts are read off backwards.
    """
    mask, bits, entered = (1 << (capacity + 1)) - 1, 1, []
    for length in sorted((n for n, c in counts.items() if c and n <= capacity), reverse=True):
        left, step = min(counts[length], capacity // length), 1
        while left and not bits >> capacity:
            step = min(step, left)
            entered.append((length, step, bits))
            bits |= (bits << (length * step)) & mask
            left, step = left - step, step * 2
        if bits >> capacity:
            break
    best, chosen = bits.bit_length() - 1, {}
    for length, step, before in reversed(entered):
        if not before >> best & 1:
            chosen[length] = chosen.get(length, 0) + step
            best -= length * step
    return chosen


class Packer:
    """Pieces of one task. Items wait by length until enough have come for full sequences."""

    def __init__(self, capacity: int, first_id: int, waiting: int = 64) -> None:
        self.capacity, self.next_id, self.waiting = capacity, first_id, waiting
        self.items: dict[int, list] = {}
        self.total = 0
        self.rows: list[tuple] = []

    def _piece(self, item: tuple, sequence: int, offset: int) -> int:
        doc, start, ids, doc_tokens = item
        length = len(ids) // 4
        self.rows.append((doc, start, length, zlib.crc32(ids), doc_tokens, sequence, offset))
        return offset + length

    def _take(self, length: int) -> tuple:
        waiting = self.items[length]
        item = waiting.pop()
        if not waiting:
            del self.items[length]
        self.total -= length
        return item

    def _wait(self, item: tuple) -> None:
        length = len(item[2]) // 4
        self.items.setdefault(length, []).append(item)
        self.total += length

    def add(self, doc, ids: bytes) -> None:
        """Whole sequences of a document are cut off first; the rest waits."""
        n, size = len(ids) // 4, self.capacity * 4
        for at in range(0, n - n % self.capacity, self.capacity):
            self._piece((doc, at, ids[at * 4 : at * 4 + size], n), self.next_id, 0)
            self.next_id += 1
        if n % self.capacity:
            self._wait((doc, n - n % self.capacity, ids[(n - n % self.capacity) * 4 :], n))

    def pack(self, to_end: bool = False) -> None:
        """Sequences around the longest item, while enough items wait to fill them."""
        while self.total >= self.capacity * (1 if to_end else self.waiting):
            longest = max(self.items)
            counts = {n: len(x) - (n == longest) for n, x in self.items.items()}
            chosen = fill(counts, self.capacity - longest)
            chosen[longest] = chosen.get(longest, 0) + 1
            exact = sum(n * c for n, c in chosen.items()) == self.capacity
            for _ in range(min(len(self.items[n]) // c for n, c in chosen.items()) if exact else 1):
                offset = 0
                for n, c in chosen.items():
                    for _ in range(c):
                        offset = self._piece(self._take(n), self.next_id, offset)
                if not exact:  # no multiset fits: the longest item left is cut
                    self._cut(self._take(max(self.items)), offset)
                self.next_id += 1
                if not to_end and self.total < self.capacity * self.waiting:
                    return

    def _cut(self, item: tuple, offset: int) -> None:
        doc, start, ids, n = item
        room = self.capacity - offset
        self._piece((doc, start, ids[: room * 4], n), self.next_id, offset)
        self._wait((doc, start + room, ids[room * 4 :], n))

    def finish(self) -> None:
        """The task's last tokens, less than one sequence, go out as sequences of powers of two."""
        self.pack(to_end=True)
        rest = [item for n in sorted(self.items, reverse=True) for item in self.items[n]]
        room, offset, left = 0, 0, self.total
        while rest:
            if not room:
                room, offset = 1 << (left.bit_length() - 1), 0
            doc, start, ids, n = rest.pop(0)
            here = min(room, len(ids) // 4)
            self._piece((doc, start, ids[: here * 4], n), self.next_id, offset)
            room, offset, left = room - here, offset + here, left - here
            self.next_id += not room
            if ids[here * 4 :]:
                rest.insert(0, (doc, start + here, ids[here * 4 :], n))
        self.items, self.total = {}, 0


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = 2048, end_id: int = 1, tokenizer: str | None = None) -> DataFrame:
    """Pieces of the documents' token ids: id, start, length, ids_crc32, doc_tokens,
    sequence_id and offset.

    Each task packs the documents of its input split, so nothing is shuffled. Whole
    sequences are cut off a document; its rest waits with others until minimum bin slack
    fills a sequence around the longest of them. Only fewer than ``capacity`` tokens
    per task end in shorter sequences, of powers of two, so there is no padding.
    Sequence ids are unique: the task's partition and a running number.

    Null and empty texts are the end id alone; null and repeated ids are packed row by
    row. ``tokenizer`` is the path of a tokenizer file that every executor can open.
    """
    path = tokenizer or default_tokenizer()
    kind = docs.schema[id_col].dataType
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = spelled(path)
        packer = Packer(capacity, TaskContext.get().partitionId() << 32)
        end = end_id.to_bytes(4, "little")
        schema = None

        def rows() -> pa.RecordBatch:
            columns = list(zip(*packer.rows)) or [()] * 7
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            if schema is None:
                schema = pa.schema([("id", batch.schema.field("id").type), *((n.split()[0], pa.int64()) for n in FIELDS.split(", "))])
            texts = batch.column("text")
            for lo in range(0, batch.num_rows, 512):
                part = texts.slice(lo, 512).to_pylist()
                for doc, ids in zip(batch.column("id").slice(lo, 512).to_pylist(), words.texts(part)):
                    packer.add(doc, ids + end)
                packer.pack()
            yield rows()
        if schema is not None:
            packer.finish()
            yield rows()

    found = source.mapInArrow(tasks, f"id {kind.simpleString()}, {FIELDS}")
    return found.withColumnRenamed("id", id_col)
