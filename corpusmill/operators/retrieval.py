"""Keyword, semantic and hybrid retrieval for whole batches of queries.

``chunks`` hold ``chunk_uid`` and the searched fields; filters are applied to
them before any search, so that limits count visible chunks only. ``queries``
hold ``query_id`` and ``keywords`` (array) or ``vector``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill import vocab
from corpusmill.functions.text import fold, strip
from corpusmill.operators.filters import TOKEN_BOUNDS, is_invalid_vector, word_tokens
from corpusmill.session import written

FIELDS = ["content", "title", "content_folded"]

# Query vectors are shipped to the executors only up to this size.
BROADCAST_BYTES = 64 << 20
# Needles are, as rows of a hash table, several times their text, and the driver holds the
# tables of all searches of a plan at once.
NEEDLE_BYTES = 8 << 20
# Hash places of needles' words that are shipped with any number of needles.
SLOTS = 1 << 18
QUERY_BLOCK = 1024
VECTOR_BLOCK = 32768


# --- embedding --------------------------------------------------------------
def hashing_encoder(dim: int = 64):
    """Encoder stand-in: signed feature hashing of words, unit length."""

    @F.pandas_udf("array<float>")
    def encode(texts: pd.Series) -> pd.Series:
        def one(text: str) -> np.ndarray:
            out = np.zeros(dim, dtype=np.float32)
            for word in text.lower().split():
                code = zlib.crc32(word.encode())
                out[code % dim] += 1.0 if code & 0x10000 else -1.0
            size = float(np.linalg.norm(out))
            return out / size if size else out

        return texts.map(one)

    return encode


def embed(df: DataFrame, text: str, encoder, dim: int, name: str = "embedding") -> DataFrame:
    """Vector of each text, encoding every distinct (cut) text once.

    A text the encoder gives nothing for gets the zero vector.
    """
    cut = F.substring(text, 1, vocab.EMBED_CHARS)
    keyed = df.withColumn("_key", F.sha2(cut, 256))
    encoded = keyed.groupBy("_key").agg(F.first(cut).alias("_cut")).select(
        "_key", encoder("_cut").alias(name)
    )
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return keyed.join(encoded, "_key", "left").withColumn(name, F.coalesce(name, zero)).drop("_key")


# --- semantic search --------------------------------------------------------
def _unit(rows: list) -> np.ndarray:
    matrix = np.asarray([np.asarray(r, dtype=np.float64) for r in rows])
    size = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(size == 0, 1.0, size)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Top k by score, then id; ``scores`` is one row."""
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


class _Running:
    """Running top k of a block of queries over batches of vectors."""

    def __init__(self, query_ids: list, matrix: np.ndarray, k: int):
        self.query_ids, self.matrix, self.k = query_ids, matrix, k
        self.ids = [np.empty(0, dtype=object)] * len(query_ids)
        self.scores = [np.empty(0)] * len(query_ids)

    def add(self, pdf: pd.DataFrame) -> None:
        if pdf.empty:
            return
        ids = pdf["chunk_uid"].to_numpy(dtype=object)
        scores = self.matrix @ _unit(list(pdf["embedding"])).T
        for q in range(len(self.query_ids)):
            row = scores[q]
            if len(row) > self.k:
                # All that reach the k-th best score, so that ties are settled by id.
                row_at = np.flatnonzero(row >= np.partition(row, -self.k)[-self.k])
            else:
                row_at = np.arange(len(row))
            self.ids[q], self.scores[q] = _best(
                np.concatenate([self.ids[q], ids[row_at]]), np.concatenate([self.scores[q], row[row_at]]), self.k
            )

    def rows(self) -> pd.DataFrame:
        return pd.DataFrame({
            "query_id": np.repeat(np.asarray(self.query_ids), [len(i) for i in self.ids]),
            "chunk_uid": np.concatenate(self.ids) if self.ids else [],
            "score": np.concatenate(self.scores) if self.scores else [],
        })


def _limit_per_query(hits: DataFrame, limit: int, order: list[Column], name: str = "rank") -> DataFrame:
    ranked = Window.partitionBy("query_id").orderBy(*order)
    return hits.withColumn(name, F.row_number().over(ranked)).where(F.col(name) <= limit)


def semantic_search(
    chunks: DataFrame, queries: DataFrame, limit: int = vocab.SEARCH_LIMIT, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Exact cosine top k: ``(query_id, chunk_uid, score, rank)``.

    Few queries travel to the vectors as one matrix of checked size; each task
    keeps k hits per query. Many queries meet the vectors in a grid of blocks
    of bounded size. Either way only k rows per query and task are shuffled.
    """
    vectors = chunks.select("chunk_uid", "embedding").where(~is_invalid_vector(F.col("embedding")))
    usable = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).where(
        ~is_invalid_vector(F.col("vector"))
    )
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_uid {chunks.schema['chunk_uid'].dataType.simpleString()}, score double"
    size = usable.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dim")).first()
    if size.n * (size.dim or 0) * 8 <= broadcast_bytes:
        hits = _search_small(vectors, usable, limit, schema, size.n)
    else:
        hits = _search_grid(vectors, usable, limit, schema, size.n)
    return _limit_per_query(hits, limit, [F.desc("score"), F.col("chunk_uid")])


def semantic_pairs(pairs: DataFrame, queries: DataFrame, chunks: DataFrame, limit: int = vocab.SEARCH_LIMIT) -> DataFrame:
    """Cosine top k of each query among its own chunks, given as ``(query_id, chunk_uid)``."""
    stored = chunks.select("chunk_uid", F.col("embedding").cast("array<double>").alias("_v")).where(~is_invalid_vector(F.col("embedding")))
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("_q")).where(~is_invalid_vector(F.col("vector")))

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    v, q = F.col("_v"), F.col("_q")
    scored = pairs.join(asked, "query_id").join(stored, "chunk_uid").withColumn("score", dot(v, q) / F.sqrt(dot(v, v) * dot(q, q)))
    return _limit_per_query(scored.select("query_id", "chunk_uid", "score"), limit, [F.desc("score"), F.col("chunk_uid")])


def _search_small(vectors: DataFrame, queries: DataFrame, limit: int, schema: str, bound: int) -> DataFrame:
    # The size was checked; one row more than counted shows a source that grew since.
    rows = queries.limit(bound + 1).collect()
    if len(rows) > bound:
        raise RuntimeError("queries were added while the search was planned; run it again")
    rows.sort(key=lambda r: r.query_id)
    ids = [r.query_id for r in rows]
    matrix = _unit([r.vector for r in rows]) if rows else np.zeros((0, 1))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = _Running(ids, matrix, limit)
        if ids:
            for pdf in batches:
                best.add(pdf)
            yield best.rows()

    return vectors.mapInPandas(scan, schema)


def _search_grid(vectors: DataFrame, queries: DataFrame, limit: int, schema: str, n_queries: int) -> DataFrame:
    n_q = max(1, -(-n_queries // QUERY_BLOCK))
    n_v = max(1, -(-vectors.count() // VECTOR_BLOCK))
    q_at = F.pmod(F.xxhash64("query_id"), F.lit(n_q)).alias("_q")
    v_at = F.pmod(F.xxhash64("chunk_uid"), F.lit(n_v)).alias("_v")
    left = queries.select("query_id", "vector", q_at, F.explode(F.sequence(F.lit(0), F.lit(n_v - 1))).alias("_v"))
    right = vectors.select("chunk_uid", "embedding", v_at, F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("_q"))

    def cell(asked: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or stored.empty:
            return pd.DataFrame({"query_id": [], "chunk_uid": [], "score": []})
        best = _Running(list(asked["query_id"]), _unit(list(asked["vector"])), limit)
        best.add(stored)
        return best.rows()

    left = left.withColumns({"_q": F.col("_q").cast("int"), "_v": F.col("_v").cast("int")})
    right = right.withColumns({"_q": F.col("_q").cast("int"), "_v": F.col("_v").cast("int")})
    return left.groupBy("_q", "_v").cogroup(right.groupBy("_q", "_v")).applyInPandas(cell, schema)


# --- keyword search ---------------------------------------------------------
def needles(queries: DataFrame) -> DataFrame:
    """One row per query, keyword and searched field, with the words to find."""
    keywords = queries.select("query_id", F.posexplode("keywords").alias("kw_idx", "keyword")).where(
        F.coalesce(F.col("keyword"), F.lit("")) != ""
    ).withColumn("_folded", fold(F.col("keyword")))
    other = (F.col("_folded") != "") & (F.col("_folded") != F.lower(strip(F.col("keyword"))))
    terms = F.array(
        *[F.struct(F.lit(i).alias("field_idx"), F.lit(f).alias("field"), F.col("keyword").alias("term"))
          for i, f in enumerate(FIELDS[:2])],
        F.when(other, F.struct(F.lit(2).alias("field_idx"), F.lit(FIELDS[2]).alias("field"), F.col("_folded").alias("term"))),
    )
    rows = keywords.select("query_id", "kw_idx", F.explode(F.filter(terms, lambda t: t.isNotNull())).alias("t"))
    words = F.when(
        F.col("t.field") == "title", word_tokens(F.col("t.term"), *TOKEN_BOUNDS["title"])
    ).otherwise(word_tokens(F.col("t.term"), *TOKEN_BOUNDS["content"]))
    rows = rows.select("query_id", "kw_idx", "t.field_idx", "t.field", F.array_sort(words).alias("words"))
    return rows.where(F.size("words") > 0).withColumn("needle", F.array_join("words", " "))


def token_index(chunks: DataFrame, fields: list[str] | None = None, extra: list[str] | None = None) -> DataFrame:
    """Distinct words of each chunk and field, with ``extra`` columns of the chunk; may be
    stored and reused.
    """
    columns = [
        F.struct(F.lit(f).alias("field"), word_tokens(F.col(f), *TOKEN_BOUNDS[f]).alias("tokens"))
        for f in (fields or FIELDS) if f in chunks.columns
    ]
    extra = extra or []
    rows = chunks.select("chunk_uid", *extra, F.explode(F.array(*columns)).alias("e"))
    return rows.select("chunk_uid", *extra, "e.field", "e.tokens")


def _fits(df: DataFrame, text: str, max_bytes: int) -> bool:
    """Whether the table, counted by its longest column, is within the bound."""
    size = df.agg(F.coalesce(F.sum(F.octet_length(text) * 3 + 64), F.lit(0)).alias("s")).first().s
    return size <= max_bytes


def _asked_postings(index: DataFrame, needles: DataFrame) -> DataFrame:
    """(_row, chunk_uid, field, word) of the words that share a hash place with a word of a
    needle, written, so that texts are worked out once. There are ``SLOTS`` places at most.
    """
    slot = F.pmod(F.xxhash64("field", "word"), F.lit(SLOTS)).cast("int").alias("_slot")
    slots = needles.select("field", F.explode("words").alias("word")).select(slot).distinct()
    numbered = index.withColumn("_row", F.monotonically_increasing_id())
    words = numbered.select("_row", "chunk_uid", "field", F.explode("tokens").alias("word"))
    return written(words.select("*", slot).join(F.broadcast(slots), "_slot", "left_semi").drop("_slot"), "asked-postings")


def _matches(index: DataFrame, needles: DataFrame, max_bytes: int, limit: int) -> DataFrame:
    """(field, needle, chunk_uid) of the chunks that hold all words of a needle; of a needle
    of one word at least the first ``limit``, else all.

    Needles of checked size go to the postings, which then are not shuffled at
    all; of a needle of several words, those that each row has are counted, as
    the list of a long text must not stand beside each of its words. More
    needles meet the postings of their words in a shuffle: those of one word the first of each
    map task, others all by their longest word, a stand-in for the rarest, and
    only candidates meet the postings of the other words.
    """
    if _fits(needles, "needle", max_bytes):
        numbered = index.withColumn("_row", F.monotonically_increasing_id())
        words = numbered.select("_row", "chunk_uid", "field", F.explode("tokens").alias("word"))
        one, more = needles.where(F.size("words") == 1), needles.where(F.size("words") > 1)
        single = words.drop("_row").join(F.broadcast(one.select("field", "needle", F.get("words", F.lit(0)).alias("word"))), ["field", "word"])
        parts = more.select("field", "needle", F.size("words").alias("_size"), F.explode("words").alias("word"))
        several = words.join(F.broadcast(parts), ["field", "word"]).groupBy("_row", "chunk_uid", "field", "needle", "_size").agg(
            F.count(F.lit(1)).alias("_met")).where("_met = _size")
        return single.select("field", "needle", "chunk_uid").unionByName(several.select("field", "needle", "chunk_uid"))
    words = _asked_postings(index, needles)
    one, more = needles.where(F.size("words") == 1), needles.where(F.size("words") > 1)
    first = Window.partitionBy("field", "word").orderBy("chunk_uid")
    firsts = words.select("chunk_uid", "field", "word").withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= limit)
    single = firsts.withColumnRenamed("word", "anchor").join(one.hint("merge"), ["field", "anchor"]).select("field", "needle", "chunk_uid")
    pair = ["chunk_uid", "field", "needle"]
    found = written(words.withColumnRenamed("word", "anchor").join(more.hint("merge"), ["field", "anchor"]).select("_row", *pair, "anchor", "words"), "candidates")
    rest = found.select("_row", *pair, F.size("words").alias("_size"), F.explode(F.array_except("words", F.array("anchor"))).alias("word"))
    whole = rest.join(words.select("_row", "field", "word"), ["_row", "field", "word"]).groupBy("_row", *pair, "_size").agg(
        F.count(F.lit(1)).alias("_met")).where("_met = _size - 1")
    # An id of several rows counts as often as rows that have the longest word meet whole ones.
    several = found.select(*pair).join(whole.select(*pair), pair).select("field", "needle", "chunk_uid")
    return single.unionByName(several)


def keyword_search(
    chunks: DataFrame, queries: DataFrame, limit: int = vocab.SEARCH_LIMIT, index: DataFrame | None = None,
    broadcast_bytes: int = NEEDLE_BYTES,
) -> DataFrame:
    """First matches of each keyword in each field, merged per query.

    Equal needles of many queries are searched once. Each map task keeps
    ``limit`` matches per needle before the shuffle, so that a needle found in
    a third of all chunks still moves few rows.
    """
    wanted = needles(queries)
    longest = F.array_max(F.transform("words", lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))).w
    distinct = wanted.select("field", "needle", "words").distinct().withColumn("anchor", longest)
    found = _matches(token_index(chunks) if index is None else index, distinct, broadcast_bytes, limit)
    return merge_matches(wanted, found, limit)


def merge_matches(wanted: DataFrame, found: DataFrame, limit: int = vocab.SEARCH_LIMIT) -> DataFrame:
    """Hits of each query from the matches ``(field, needle, chunk_uid)`` of its needles: the
    first ``limit`` of a needle, then the first places.
    """
    by_uid = Window.partitionBy("field", "needle").orderBy("chunk_uid")
    first = found.withColumn("_n", F.row_number().over(by_uid)).where(F.col("_n") <= limit).drop("_n")
    place = F.struct("kw_idx", "field_idx", "chunk_uid")
    hits = wanted.drop("words").join(first, ["field", "needle"]).groupBy("query_id", "chunk_uid").agg(
        F.min(place).alias("place")
    )
    return _limit_per_query(hits, 2 * limit, [F.col("place")]).select("query_id", "chunk_uid", "rank")


# --- merge and strategy -----------------------------------------------------
def keyword_score(keywords: Column, content: Column) -> Column:
    """0.80 to 0.95 by the share of keywords found in the content."""
    lowered = F.lower(F.coalesce(content, F.lit("")))
    found = F.size(F.filter(keywords, lambda k: (k != "") & F.contains(lowered, F.lower(k))))
    share = 0.15 * found / F.greatest(F.size(keywords), F.lit(1))
    return F.least(F.lit(0.80) + share, F.lit(0.99))


def with_payload(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Payload of the few hits, fetched after all limits."""
    return hits.join(chunks, "chunk_uid")


def hybrid_merge(
    keyword_hits: DataFrame, semantic_hits: DataFrame, queries: DataFrame, chunks: DataFrame,
    limit: int = vocab.SEARCH_LIMIT,
) -> DataFrame:
    """Scored keyword hits plus semantic hits not seen yet, best first."""
    scored = (
        keyword_hits.join(chunks.select("chunk_uid", "content"), "chunk_uid")
        .join(queries.select("query_id", "keywords"), "query_id")
        .select("query_id", "chunk_uid", keyword_score(F.col("keywords"), F.col("content")).alias("kw_score"),
                F.col("rank").alias("kw_rank"))
    )
    semantic = semantic_hits.select(
        "query_id", "chunk_uid", F.coalesce("score", F.lit(0.0)).alias("sem_score"), F.col("rank").alias("sem_rank")
    )
    merged = scored.join(semantic, ["query_id", "chunk_uid"], "full_outer").select(
        "query_id", "chunk_uid",
        F.coalesce("kw_score", "sem_score").alias("score"),
        F.when(F.col("kw_rank").isNotNull(), F.struct(F.lit(0).alias("src"), F.col("kw_rank").alias("at")))
        .otherwise(F.struct(F.lit(1).alias("src"), F.col("sem_rank").alias("at"))).alias("_place"),
    )
    return _limit_per_query(merged, limit, [F.desc("score"), F.col("_place"), F.col("chunk_uid")]).drop("_place")


def hybrid_search(chunks: DataFrame, queries: DataFrame, limit: int = vocab.SEARCH_LIMIT) -> DataFrame:
    return hybrid_merge(
        keyword_search(chunks, queries, limit), semantic_search(chunks, queries, limit), queries, chunks, limit
    )


def search_strategy(intent: Column, has_target: Column, keywords: Column) -> Column:
    """Keyword for a name look-up, semantic without keywords, else hybrid."""
    empty = F.size(F.coalesce(keywords, F.array().cast("array<string>"))) == 0
    return (
        F.when(empty, "semantic")
        .when((intent == "student_lookup") & ~has_target, "keyword")
        .otherwise("hybrid")
    )


def search_by_strategy(chunks: DataFrame, queries: DataFrame, limit: int = vocab.SEARCH_LIMIT) -> DataFrame:
    """Each query by its own ``strategy``; keyword hits keep a null score.

    Each engine runs once, for all queries that need it.
    """
    by_keyword = written(keyword_search(chunks, queries.where("strategy <> 'semantic'"), limit), "keyword-hits")
    by_vector = written(semantic_search(chunks, queries.where("strategy <> 'keyword'"), limit), "semantic-hits")

    def part(hits: DataFrame, kind: str) -> DataFrame:
        return hits.join(queries.where(F.col("strategy") == kind).select("query_id"), "query_id", "left_semi")

    found = {
        "keyword": part(by_keyword, "keyword").withColumn("score", F.lit(None).cast("double")),
        "semantic": part(by_vector, "semantic"),
        "hybrid": hybrid_merge(part(by_keyword, "hybrid"), part(by_vector, "hybrid"), queries, chunks, limit),
    }
    columns = ["query_id", "chunk_uid", "score", "rank"]
    out = None
    for name, hits in found.items():
        kind = hits.select(*columns, F.lit(name).alias("strategy"))
        out = kind if out is None else out.unionByName(kind)
    return out


def retry_with_keywords(hits: DataFrame, queries: DataFrame, chunks: DataFrame, limit: int = vocab.SEARCH_LIMIT) -> DataFrame:
    """Keyword search for semantic queries that found nothing; the hits are written, as they
    are read twice.
    """
    hits = written(hits, "semantic-hits")
    missed = queries.join(hits.select("query_id").distinct(), "query_id", "left_anti").where(
        (F.col("strategy") == "semantic") & (F.size("keywords") > 0)
    )
    retried = keyword_search(chunks, missed, limit).select(
        "query_id", "chunk_uid", F.lit(None).cast("double").alias("score"), "rank", F.lit("keyword").alias("strategy")
    )
    return hits.unionByName(retried)


def rescore(hits: DataFrame, scorer) -> DataFrame:
    """Optional re-ranker: ``scorer(query, content)`` gives the new score."""
    scored = hits.withColumn("score", scorer("query", "content").cast("double")).drop("rank")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_uid")
    return scored.withColumn("rank", F.row_number().over(ranked))


# --- names and ids ----------------------------------------------------------
def list_rows(content: Column) -> Column:
    """(id, name) of each Markdown list row in a chunk."""
    pattern = F.lit("(?U)" + vocab.ROW_ID_NAME)
    return F.zip_with(
        F.regexp_extract_all(content, pattern, F.lit(1)), F.regexp_extract_all(content, pattern, F.lit(2)),
        lambda i, n: F.struct(strip(i).alias("id"), strip(n).alias("name")),
    )


def students_by_name(chunks: DataFrame, queries: DataFrame, limit: int = vocab.SEARCH_LIMIT) -> DataFrame:
    """Students in list chunks whose name holds all words of ``queries.name``.

    Searches list chunks of any scope or activity.
    """
    lists = chunks.where(F.col("content_type").isin("student_list", "excel_table"))
    named = queries.where(F.coalesce("name", F.lit("")) != "").select(
        "query_id", F.split(strip(F.col("name")), r"\s+").alias("keywords")
    )
    hits = keyword_search(lists, named, limit).join(lists.select("chunk_uid", "content"), "chunk_uid").join(named, "query_id")
    rows = hits.select("query_id", "rank", "keywords", F.posexplode(list_rows(F.col("content"))).alias("pos", "s"))
    whole = F.forall("keywords", lambda w: F.contains(F.lower(F.col("s.name")), F.lower(w)))
    firsts = rows.where(whole).groupBy("query_id", "s.id", "s.name").agg(F.min(F.struct("rank", "pos")).alias("_at"))
    ordered = Window.partitionBy("query_id").orderBy("_at")
    return firsts.withColumn("ord", F.row_number().over(ordered)).drop("_at")


def resolve_target(
    explicit_id: Column, name: Column, last_id: Column, last_name: Column, n_found: Column, found_id: Column,
    short_followup: Column, routed: Column,
) -> Column:
    """Struct (target_id, ambiguous) of a routed turn.

    ``n_found``/``found_id`` come from the look-up of ``name``. An explicit id
    wins; the remembered name keeps the remembered id; a new name is looked up;
    several matches ask back; a short personal follow-up keeps the id.
    """
    known = F.coalesce(
        F.forall(F.split(F.lower(name), r"\s+"), lambda w: F.contains(F.lower(last_name), w)), F.lit(False)
    )
    lookup = name.isNotNull() & F.when(last_name.isNotNull(), ~known).otherwise(last_id.isNull())
    target = (
        F.when(explicit_id.isNotNull(), explicit_id)
        .when(name.isNotNull() & last_name.isNotNull() & known, last_id)
        .when(lookup & (n_found == 1), found_id)
        .when(name.isNull() & short_followup, last_id)
    )
    ambiguous = routed & explicit_id.isNull() & lookup & (n_found > 1)
    return F.struct(F.when(routed, target).alias("target_id"), F.coalesce(ambiguous, F.lit(False)).alias("ambiguous"))
