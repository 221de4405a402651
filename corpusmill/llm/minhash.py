"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard similarity."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.components import components
from corpusmill.llm.hashing import mixed, prefix_sums, run_hashes, word_bounds
from corpusmill.session import written

SHINGLE, CELLS = 5, 1 << 20
STEP = np.uint64(0x2545F4914F6CDD1D)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's runs of five words, A-Z lower-cased.

    A text of fewer words has its whole sequence as one; a text without words has none.
    """
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    start, end = word_bounds(low.tobytes())
    word = run_hashes(prefix_sums(low.astype(np.uint64) + np.uint64(1)), start, end)
    if not len(word):
        return word
    width = min(SHINGLE, len(word))
    total = np.zeros(len(word) - width + 1, np.uint64)
    for i in range(width):
        total = total * STEP + word[i : i + len(total)]
    return np.unique(mixed(total + np.uint64(width)))


@lru_cache(4)
def _permutations(seed: int, coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and all windows of the second: row p is what its circular
    shifts by 0, 1, 2 ... give cell p.
    """
    random = np.random.Generator(np.random.PCG64(seed))
    first, second = random.permutation(CELLS), random.permutation(CELLS).astype(np.uint32)
    return first, np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[: coordinates - 1]]), coordinates)


def signature(items: np.ndarray, coordinates: int, seed: int = 7) -> np.ndarray:
    """Circulant MinHash: the first permutation scatters the items' cells, and coordinate k
    is the smallest value of the second one, shifted by k, over them.
    """
    first, shifted = _permutations(seed, coordinates)
    cells = first[(items >> np.uint64(44)).astype(np.int64)]
    least = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(cells), 2048):
        np.minimum(least, shifted[cells[lo : lo + 2048]].min(axis=0), out=least)
    return least


def band_keys(values: np.ndarray, rows: int) -> np.ndarray:
    grouped = values.reshape(-1, rows).astype(np.uint64)
    keys = np.arange(len(grouped), dtype=np.uint64)
    for i in range(rows):
        keys = mixed(keys * STEP + grouped[:, i])
    return keys.view(np.int64)


def sketches(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(id, n, set_a, set_b, sig, keys) per document: the size of its set, two hashes of the
    whole set, a byte of each coordinate, and its band keys. Empty sets have no keys.
    """
    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text"):
                items = shingles(text.as_py())
                a, b = (int(mixed(items + np.uint64(k)).sum(dtype=np.uint64).view(np.int64)) for k in (1, 2))
                values = signature(items, bands * rows)
                out.append((len(items), a, b, (values & 0xFF).astype(np.uint8).tobytes(), band_keys(values, rows) if len(items) else []))
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["id", "n", "set_a", "set_b", "sig", "keys"])

    return docs.mapInArrow(tasks, f"id {docs.schema['id'].dataType.simpleString()}, n long, set_a long, set_b long, sig binary, keys array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(id, items): the set as sorted 8-byte numbers."""
    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([shingles(t.as_py()).tobytes() for t in batch.column("text")], pa.binary())], names=["id", "items"])

    return docs.mapInArrow(tasks, f"id {docs.schema['id'].dataType.simpleString()}, items binary")


def similar(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted distinct numbers."""
    small, large = (one, two) if len(one) < len(two) else (two, one)
    common = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return 100 * common >= percent * (len(one) + len(two) - common)


def counted(small: DataFrame, rows: int = 500_000) -> DataFrame:
    """A table of a few numbers a row, to be broadcast if it has at most so many rows; the
    join shuffles otherwise.
    """
    return F.broadcast(small) if small.count() <= rows else small


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int, few_pairs: int = 20_000) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    Few pairs, of counted number, are broadcast to the sets, which are then not shuffled.
    """
    few = pairs.count() <= few_pairs
    sent = F.broadcast if few else (lambda df: df)
    needed = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    there = sets.join(sent(needed), "id") if few else sets
    left = there.select(F.col("id").alias("a"), F.col("items").alias("x"))
    right = there.select(F.col("id").alias("b"), F.col("items").alias("y"))
    both = left.join(sent(pairs), "a").join(right, "b").select("a", "b", "x", "y")

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                one, two = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                keep.append(similar(one, two, percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    return both.mapInArrow(tasks, f"a {kind}, b {kind}")


def blocks_of(rows: DataFrame, seed: int, visits: bool, block: int = 512) -> DataFrame:
    """(key, block, guest, id, component): the documents of buckets of several components.

    A bucket is dealt into blocks of about ``block`` documents, by a seeded hash. With
    ``visits``, those outside the bucket's largest component also visit all other blocks,
    so that every pair between components meets; without, only pairs inside a block do.
    """
    sizes = rows.groupBy("key", "component").agg(F.count("*").alias("c")).groupBy("key").agg(
        F.sum("c").alias("m"), F.count("*").alias("parts"), F.max_by("component", F.struct("c", "component")).alias("main"))
    several = sizes.where("parts > 1").withColumn("blocks", F.ceil(F.col("m") / block))
    dealt = rows.join(several, "key").withColumn("home", F.pmod(F.xxhash64(F.lit(seed), "id"), F.col("blocks")))
    everywhere = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    stays = F.col("component") == F.col("main") if visits else F.lit(True)
    dealt = dealt.withColumn("block", F.explode(F.when(stays, F.array("home")).otherwise(everywhere)))
    return dealt.select("key", "block", (F.col("block") != F.col("home")).alias("guest"), "id", "component")


def likely(one: tuple, many: tuple, i: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Partners of document i in other components that may be similar enough, best first.

    Left out is what the sizes of the sets rule out, or where the signatures' agreement
    lies four to five deviations below the threshold. Also the agreement of all.
    """
    coordinates = many[3].shape[1]
    agree = ((many[3] == one[3][i]).sum(axis=1) / coordinates - 1 / 256) / (1 - 1 / 256)
    low = percent / 100 - 4.5 * (0.25 * 0.75 / coordinates) ** 0.5
    n, own = many[1], one[1][i]
    at = np.flatnonzero((many[2] != one[2][i]) & (agree >= low) & (100 * np.minimum(n, own) >= percent * np.maximum(n, own)))
    return at[np.argsort(-agree[at], kind="stable")], agree


def in_blocks(met: DataFrame, more: list[str], work, names: list[str], kinds: tuple, schema: str, block: int = 512) -> DataFrame:
    """Runs work(one, many, same) over pairs of column tuples (id, n, component, signatures,
    *more): a block with itself, and its guests, block by block, with its own documents.
    """
    fields = ["key", "block", "guest", "id", "n", "component", "sig", *more]

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hosts, guests, out = None, [], [], []

        def columns(rows: list) -> tuple:
            i, n, c, s, *rest = zip(*rows)
            return i, np.array(n), np.array(c), np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1), *rest

        def visit() -> None:
            if hosts and guests:
                out.extend((*now, *r) for r in work(columns(guests), columns(hosts), False))
            guests.clear()

        def close() -> None:
            visit()
            if len(hosts) > 1:
                own = columns(hosts)
                out.extend((*now, *r) for r in work(own, own, True))
            hosts.clear()

        def sent() -> pa.RecordBatch:
            found = list(zip(*out)) or [()] * (2 + len(names))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(found, (pa.int64(), pa.int64(), *kinds))], names=["key", "block", *names])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in fields)):
                if row[:2] != now:
                    close()
                    now = row[:2]
                (guests if row[2] else hosts).append(row[3:])
                if len(guests) >= block:
                    visit()
            yield sent()
        close()
        yield sent()

    sent_on = met.select(*fields).repartition("key", "block").sortWithinPartitions("key", "block", "guest", "id")
    return sent_on.mapInArrow(tasks, "key long, block long, " + schema)


def best_pairs(rows: DataFrame, sigs: DataFrame, percent: int, most: int, seed: int) -> DataFrame:
    """(a, b): each document of a bucket with its ``most`` likeliest partners of other components."""
    def work(one: tuple, many: tuple, same: bool) -> Iterator[tuple]:
        for i in range(len(one[0])):
            at, agree = likely(one, many, i, percent)
            yield from ((one[0][i], many[0][j], float(agree[j])) for j in at[:most])

    found = in_blocks(blocks_of(rows, seed, False).join(sigs, "id"), [], work, ["a", "b", "agree"], (pa.int64(), pa.int64(), pa.float64()), "a long, b long, agree double")
    each = found.groupBy("a", "b").agg(F.max("agree").alias("agree"))
    ranked = each.withColumn("at", F.row_number().over(Window.partitionBy("a").orderBy(F.col("agree").desc(), "b"))).where(F.col("at") <= most)
    return ranked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def remaining_links(rows: DataFrame, sigs: DataFrame, sets: DataFrame, percent: int, seed: int) -> DataFrame:
    """(a, b): links that join all components which any pair of a bucket links.

    Every likely pair between components is confirmed where it meets, on full sets, unless
    the links found before in the block have joined the two; so a block sends on
    fewer links than it has components. Sets travel only with documents that have a likely
    partner.
    """
    def flags(one: tuple, many: tuple, same: bool) -> Iterator[tuple]:
        hit = np.zeros(len(many[0]), bool)
        for i in range(len(one[0])):
            at, _ = likely(one, many, i, percent)
            hit[at] = True
            if len(at) and not same:
                yield True, one[0][i], int(one[2][i])
        yield from ((False, many[0][j], int(many[2][j])) for j in np.flatnonzero(hit))

    def links(one: tuple, many: tuple, same: bool) -> Iterator[tuple]:
        joined: dict[int, int] = {}

        def top(c: int) -> int:
            while c in joined:
                c = joined[c]
            return c

        items = [np.frombuffer(x, np.uint64) for x in many[4]]
        for i in range(len(one[0])):
            own = np.frombuffer(one[4][i], np.uint64)
            for j in likely(one, many, i, percent)[0]:
                if (same and j < i) or top(one[2][i]) == top(many[2][j]):
                    continue
                if similar(own, items[j], percent):
                    joined[top(one[2][i])] = top(many[2][j])
                    yield one[0][i], many[0][j]

    flagged = in_blocks(blocks_of(rows, seed, True).join(sigs, "id"), [], flags, ["guest", "id", "component"], (pa.bool_(), pa.int64(), pa.int64()), "guest boolean, id long, component long")
    flagged = written(flagged.distinct(), "minhash-flagged")
    return in_blocks(flagged.join(sigs, "id").join(sets, "id"), ["items"], links, ["a", "b"], (pa.int64(), pa.int64()), "a long, b long").select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, percent: int = 75, bands: int = 40, rows: int = 4) -> DataFrame:
    """Per input row: id, n_shingles, component_id and kept.

    Texts of one set stand for each other, so copies never meet. The rest meets in the
    buckets of ``bands`` bands of ``rows`` coordinates; two sets at the threshold miss all
    of them with a chance of 3 in 10 million. Candidates are confirmed on full sets in
    three rounds. The first two tie each document to its best partners, which joins most
    groups; the third confirms every remaining pair between different components of a
    bucket. Groups need no pairs inside a component for their component ids, so copies
    are never expanded into all pairs.

    Texts are read a second time for the candidates' sets: candidate ids of counted number
    are broadcast to them, up to half a million; more are joined by a shuffle.

    Sets are of 64-bit hashes. Empty texts are linked with nothing. Ids are whole
    numbers; rows of one id count as one document, and a null id takes no part: its
    component_id is null and the row is kept.
    """
    known = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    made = written(sketches(known, bands, rows), "minhash-sketches")
    reps = made.where("id IS NOT NULL AND n > 0").groupBy("set_a", "set_b", "n").agg(F.min("id").alias("rep"))
    # one row per set: the others would only meet their copies
    chosen = made.where("n > 0").select("set_a", "set_b", "id").join(reps.select("set_a", "set_b", F.col("rep").alias("id")), ["set_a", "set_b", "id"]).select("id").distinct()
    keyed = made.where("n > 0").select("id", "keys").join(chosen, "id", "left_semi").dropDuplicates(["id"]).select("id", F.explode("keys").alias("key"))
    keyed = written(keyed, "minhash-keys")
    shared = written(keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key"), "minhash-shared")
    buckets = written(keyed.join(shared, "key"), "minhash-buckets")
    ids = written(buckets.select("id").distinct(), "minhash-ids")
    sigs = written(made.select("id", "n", "sig").join(counted(ids), "id", "left_semi").dropDuplicates(["id"]), "minhash-sigs")
    sets = written(shingle_sets(known.join(counted(ids), "id", "left_semi")).dropDuplicates(["id"]), "minhash-sets")
    links, parts = None, None
    for most in (1, 6, None):
        labelled = buckets.withColumn("component", F.col("id")) if parts is None else (
            buckets.join(parts, "id", "left").withColumn("component", F.coalesce("component", "id")))
        if most:
            found = confirmed(written(best_pairs(labelled, sigs, percent, most, seed=17 + most), "minhash-pairs"), sets, percent)
        else:
            found = remaining_links(labelled, sigs, sets, percent, seed=17)
        links = written(found if parts is None else found.union(parts.select(F.col("id").alias("a"), F.col("component").alias("b"))), "minhash-links")
        parts = components(links)
    named = reps.join(parts, reps["rep"] == parts["id"], "left").select("set_a", "set_b", F.coalesce("component", "rep").alias("c"))
    joined = made.select("id", "n", "set_a", "set_b").join(named, ["set_a", "set_b"], "left")
    component = F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("c"))).otherwise(F.col("id"))
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` whose document stays, with their columns: one of each component."""
    gone = near_duplicates(docs.select("doc_id", "text"), **settings).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
