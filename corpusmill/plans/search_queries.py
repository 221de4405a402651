"""Retrieval, ranking and contexts for batches of queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import ranking as K
from corpusmill.operators import retrieval as R
from corpusmill.operators import understanding as Q
from corpusmill.plans import sqltext as S
from corpusmill.plans.registry import query
from corpusmill.plans.tables import CTES
from corpusmill.session import shared_folder
from corpusmill.sources import index_store as IX

col = F.col
YEAR_NOW = 2025

# --- inputs -----------------------------------------------------------------
# Oracle form of the search corpus, of the batch of queries and of their vectors.
CTES["corpus"] = f"""
SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS chunk_uid, doc_id, text AS content, source AS title, {S.fold('text')} AS content_folded FROM documents
"""
CTES["asked_words"] = f"""
SELECT query_id, w, row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1 AS kw_idx FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, lower(w) ORDER BY pos) AS rn FROM (
    SELECT item_id AS query_id, unnest(l) AS w, unnest(range(1, len(l) + 1)) AS pos FROM (
      SELECT item_id, string_split(replace(text, chr(10), ' '), ' ') AS l FROM benchmark)) WHERE w <> '') WHERE rn = 1
"""
CTES["centroids"] = """
SELECT query_id, list(a ORDER BY pos) AS vector FROM (
  SELECT label AS query_id, pos, avg(x) AS a FROM (
    SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings)
  GROUP BY label, pos) GROUP BY query_id
"""


def corpus(t):
    """Documents as chunks."""
    return t.documents.select(
        F.lpad(col("doc_id").cast("string"), 12, "0").alias("chunk_uid"), "doc_id", col("text").alias("content"),
        col("source").alias("title"), T.fold(col("text")).alias("content_folded"),
    )


def asked(t):
    """Every benchmark text as a query with its distinct words as keywords."""
    words = T.compact_keywords(F.split(F.translate("text", "\n", " "), " "))
    return t.benchmark.select(col("item_id").alias("query_id"), words.alias("keywords"))


def centroids(t):
    """Mean vector of each label, as query vectors."""
    dims = t.embeddings.select("label", F.posexplode(col("embedding").cast("array<double>")).alias("pos", "x"))
    means = dims.groupBy("label", "pos").agg(F.avg("x").alias("a"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "a")))
    return means.groupBy(col("label").alias("query_id")).agg(F.transform(ordered, lambda s: s.a).alias("vector"))


def vectors(t):
    return t.embeddings.select(F.lpad(col("vec_id").cast("string"), 12, "0").alias("chunk_uid"), "embedding")


_WORDS = "list_filter(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+'), lambda z: length(z) BETWEEN 2 AND {high})"


def _w(x: str, high: int = 32) -> str:
    return _WORDS.format(x=x, high=high)


def keyword_sql(words: str, chunks: str, limit: int = 20, of_words: str = "", of_chunks: str = "", on: str = "") -> str:
    """query_id, chunk_uid, rank of the keyword search over ``chunks``; ``on`` adds a condition
    on columns that words (n) and chunks (d) carry.
    """
    return f"""
SELECT query_id, chunk_uid, rank FROM (
  SELECT query_id, chunk_uid, row_number() OVER (PARTITION BY query_id ORDER BY kw_idx, field_idx, chunk_uid) AS rank FROM (
    SELECT query_id, chunk_uid, kw_idx, field_idx, row_number() OVER (PARTITION BY query_id, chunk_uid ORDER BY kw_idx, field_idx) AS seen FROM (
      SELECT query_id, kw_idx, field_idx, chunk_uid, row_number() OVER (PARTITION BY query_id, kw_idx, field_idx ORDER BY chunk_uid) AS n FROM (
        SELECT query_id, kw_idx, n.field_idx, chunk_uid FROM (
          SELECT query_id, kw_idx, field_idx, len(list_distinct(ws)) AS need, unnest(list_distinct(ws)) AS tok{of_words} FROM (
            SELECT query_id, kw_idx, 0 AS field_idx, {_w('w')} AS ws{of_words} FROM {words}
            UNION ALL SELECT query_id, kw_idx, 1, {_w('w', 40)}{of_words} FROM {words}
            UNION ALL SELECT query_id, kw_idx, 2, {_w('f')}{of_words} FROM (SELECT *, {S.fold('w')} AS f FROM {words}) WHERE f <> '' AND f <> lower(trim(w)))) n
        JOIN (SELECT chunk_uid, 0 AS field_idx, unnest(list_distinct({_w('content')})) AS tok{of_chunks} FROM {chunks}
          UNION ALL SELECT chunk_uid, 1, unnest(list_distinct({_w('title', 40)})){of_chunks} FROM {chunks}
          UNION ALL SELECT chunk_uid, 2, unnest(list_distinct({_w('content_folded')})){of_chunks} FROM {chunks}) d ON d.field_idx = n.field_idx AND d.tok = n.tok {on}
        GROUP BY query_id, kw_idx, n.field_idx, chunk_uid HAVING count(*) = any_value(need)))
    WHERE n <= {limit}) WHERE seen = 1) WHERE rank <= {2 * limit}"""


_SEMANTIC = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_uid) AS rank FROM (
  SELECT query_id, lpad(CAST(vec_id AS VARCHAR), 12, '0') AS chunk_uid, list_cosine_similarity(CAST(embedding AS DOUBLE[]), vector) AS score
  FROM embeddings, {centroids})) WHERE rank <= 20"""


@query("search_semantic", "query_id bigint, chunk_uid string, rank bigint, score double",
       f"SELECT query_id, chunk_uid, rank, round(score, 6) AS score FROM ({_SEMANTIC})")
def _(t):
    hits = R.semantic_search(vectors(t), centroids(t))
    return hits.withColumn("score", F.round("score", 6))


@query("search_semantic_grid", "query_id bigint, chunk_uid string, rank bigint, score double",
       f"SELECT query_id, chunk_uid, rank, round(score, 6) AS score FROM ({_SEMANTIC})")
def _(t):
    hits = R.semantic_search(vectors(t), centroids(t), broadcast_bytes=0)
    return hits.withColumn("score", F.round("score", 6))


@query("search_keyword", "query_id bigint, chunk_uid string, rank bigint", keyword_sql("{asked_words}", "{corpus}"))
def _(t):
    return R.keyword_search(corpus(t), asked(t))


_SEM_DOCS = _SEMANTIC.replace("FROM embeddings, {centroids}", "FROM embeddings, {centroids} WHERE vec_id IN (SELECT doc_id FROM documents)")


@query("search_keyword_shuffled", "query_id bigint, chunk_uid string, rank bigint", keyword_sql("{asked_words}", "{corpus}"))
def _(t):
    return R.keyword_search(corpus(t), asked(t), broadcast_bytes=0)


def stored_corpus(t):
    """The corpus in a fresh store, as three batches: a third of the chunks first has another
    text, and every seventh is taken out again. Returns the folder.
    """
    path, chunks = shared_folder(t.spark, "index"), corpus(t)
    third = col("doc_id") % 3 == 0
    old = chunks.where(third).withColumns({"content": F.reverse("content"), "content_folded": T.fold(F.reverse("content"))})
    IX.write_batch(old.unionByName(chunks.where(~third)), path, 0)
    IX.write_batch(chunks.where(third), path, 1)
    IX.write_batch(chunks.limit(0), path, 2, chunks.where(col("doc_id") % 7 == 0))
    return path


_STORED = keyword_sql("{asked_words}", "(SELECT * FROM {corpus} WHERE doc_id % 7 <> 0)")


@query("search_keyword_stored", "query_id bigint, chunk_uid string, rank bigint", _STORED)
def _(t):
    return IX.keyword_search_stored(t.spark, stored_corpus(t), asked(t))


@query("fetch_payload", "query_id bigint, chunk_uid string, rank bigint, title string, content string",
       f"SELECT query_id, s.chunk_uid, rank, title, content FROM ({_STORED}) s JOIN {{corpus}} c ON c.chunk_uid = s.chunk_uid")
def _(t):
    path = stored_corpus(t)
    return IX.fetch_payload(t.spark, path, IX.keyword_search_stored(t.spark, path, asked(t)), ["title", "content"])


# Queries of the hybrid search: a label's vector with the words of its benchmark text.
CTES["hybrid_words"] = "SELECT a.* FROM {asked_words} a JOIN {centroids} c ON c.query_id = a.query_id"
_HYBRID = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, src, src_rank, chunk_uid) AS rank FROM (
  SELECT coalesce(k.query_id, s.query_id) AS query_id, coalesce(k.chunk_uid, s.chunk_uid) AS chunk_uid,
    CASE WHEN k.query_id IS NULL THEN 1 ELSE 0 END AS src, coalesce(k.rank, s.rank) AS src_rank,
    CASE WHEN k.query_id IS NULL THEN s.score ELSE least(0.99, 0.8 + 0.15 * CAST(m AS DOUBLE) / greatest(total, 1)) END AS score
  FROM (SELECT h.query_id, h.chunk_uid, any_value(h.rank) AS rank, count(*) FILTER (WHERE contains(lower(c.content), lower(w.w))) AS m, count(*) AS total
        FROM ({keyword_sql('{hybrid_words}', '{corpus}')}) h JOIN {{corpus}} c ON c.chunk_uid = h.chunk_uid JOIN {{hybrid_words}} w ON w.query_id = h.query_id
        GROUP BY h.query_id, h.chunk_uid) k
  FULL OUTER JOIN ({_SEM_DOCS}) s ON s.query_id = k.query_id AND s.chunk_uid = k.chunk_uid)) WHERE rank <= 20"""


def hybrid_inputs(t):
    chunks = corpus(t).join(vectors(t), "chunk_uid", "left")
    return chunks, centroids(t).join(asked(t), "query_id")


@query("search_hybrid", "query_id bigint, chunk_uid string, rank bigint, score double",
       f"SELECT query_id, chunk_uid, rank, round(score, 6) AS score FROM ({_HYBRID})")
def _(t):
    chunks, queries = hybrid_inputs(t)
    return R.hybrid_search(chunks, queries).withColumn("score", F.round("score", 6))


@query("search_strategy", "query_id bigint, has_target boolean, strategy string", """
SELECT query_id, h AS has_target, CASE WHEN segment = 'MACHINERY' THEN 'semantic' WHEN segment = 'BUILDING' AND NOT h THEN 'keyword' ELSE 'hybrid' END AS strategy
FROM {questions}, (VALUES (TRUE), (FALSE)) v(h)""")
def _(t):
    words = F.when(col("segment") == "MACHINERY", F.array().cast("array<string>")).otherwise(F.split("query", " "))
    rows = t.questions.select(
        "query_id", F.explode(F.array(F.lit(True), F.lit(False))).alias("has_target"), words.alias("words"),
        F.when(col("segment") == "BUILDING", "student_lookup").otherwise("schedule").alias("intent"))
    return rows.withColumn("strategy", R.search_strategy(col("intent"), col("has_target"), col("words")))


@query("search_by_strategy", "query_id bigint, chunk_uid string, rank bigint, score double, strategy string", f"""
SELECT query_id, chunk_uid, rank, NULL AS score, 'keyword' AS strategy FROM ({keyword_sql('{hybrid_words}', '{corpus}')}) WHERE query_id % 3 = 0
UNION ALL SELECT query_id, chunk_uid, rank, round(score, 6), 'semantic' FROM ({_SEM_DOCS}) WHERE query_id % 3 = 1 AND query_id IN (SELECT query_id FROM {{hybrid_words}})
UNION ALL SELECT query_id, chunk_uid, rank, round(score, 6), 'hybrid' FROM ({_HYBRID}) WHERE query_id % 3 = 2""")
def _(t):
    chunks, queries = hybrid_inputs(t)
    kinds = F.array(F.lit("keyword"), F.lit("semantic"), F.lit("hybrid"))
    queries = queries.withColumn("strategy", F.get(kinds, (col("query_id") % 3).cast("int")))
    return R.search_by_strategy(chunks, queries).withColumn("score", F.round("score", 6))


@query("search_retry_keyword", "query_id bigint, chunk_uid string, rank bigint, strategy string", f"""
SELECT query_id, chunk_uid, rank, 'keyword' AS strategy FROM ({keyword_sql('{asked_words}', '{corpus}')}) WHERE query_id NOT IN (SELECT query_id FROM {{centroids}})
UNION ALL SELECT query_id, chunk_uid, rank, 'semantic' FROM ({_SEMANTIC}) WHERE query_id IN (SELECT item_id FROM benchmark)""")
def _(t):
    queries = asked(t).join(centroids(t), "query_id", "left").withColumn("strategy", F.lit("semantic"))
    found = R.semantic_search(vectors(t), queries).withColumn("strategy", F.lit("semantic"))
    return R.retry_with_keywords(found.select("query_id", "chunk_uid", "score", "rank", "strategy"), queries, corpus(t))


# Words of a message by the encoder's rule: code % 64 is the place, bit 16 the sign.
_FEATURES = f"""SELECT id, code % 64 AS place, sum(CASE WHEN (code >> 16) & 1 = 1 THEN 1.0 ELSE -1.0 END * n) AS x FROM (
  SELECT id, w, count(*) AS n FROM (SELECT id, unnest(string_split(lower(translate(content, chr(10), ' ')), ' ')) AS w FROM {{messages}}) WHERE w <> '' GROUP BY ALL) m
  JOIN (SELECT w, {S.crc32('w')} AS code FROM (SELECT DISTINCT unnest(string_split(lower(translate(content, chr(10), ' ')), ' ')) AS w FROM {{messages}}), (SELECT {S.CRC_TABLE} AS crc)) c ON c.w = m.w
  GROUP BY ALL"""


@query("embed_texts", "id bigint, norm double, dim bigint, vector string", f"""
SELECT m.id, CASE WHEN v.id IS NULL THEN 0.0 ELSE 1.0 END AS norm, 64 AS dim, coalesce(vector, '') AS vector FROM {{messages}} m LEFT JOIN (
  SELECT id, string_agg(CAST(place AS VARCHAR) || ':' || CAST(CAST(round(1000 * x / size) AS BIGINT) AS VARCHAR), ' ' ORDER BY place) AS vector
  FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY id)) AS size FROM ({_FEATURES})) WHERE x <> 0 GROUP BY id) v ON v.id = m.id""")
def _(t):
    rows = R.embed(t.messages, "content", R.hashing_encoder(64), 64)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    cells = F.transform("embedding", lambda x, i: F.when(x != 0, F.concat_ws(":", i.cast("string"), F.round(1000 * x.cast("double")).cast("long").cast("string"))))
    vector = F.array_join(F.filter(cells, lambda c: c.isNotNull()), " ")
    return rows.select("id", F.round(norm, 3).alias("norm"), F.size("embedding").alias("dim"), vector.alias("vector"))


def _shared_words(query: str, content: str):
    """Re-ranker stand-in: distinct words of the query that the content has."""
    words = lambda c: F.array_distinct(F.split(F.lower(c), " "))
    return F.size(F.array_intersect(words(query), words(content)))


_SHARED = "len(list_intersect(list_distinct(string_split(lower(query), ' ')), list_distinct(string_split(lower(content), ' '))))"


@query("search_rescored", "query_id bigint, chunk_uid string, rank bigint, score double", f"""
SELECT query_id, chunk_uid, row_number() OVER (PARTITION BY query_id ORDER BY {_SHARED} DESC, chunk_uid) AS rank, {_SHARED} AS score FROM {{hits}}""")
def _(t):
    return R.rescore(t.hits, _shared_words)


_NAMES = "SELECT DISTINCT given, person AS name, CASE given WHEN 'An' THEN 0 WHEN 'Nam' THEN 1 WHEN 'Minh' THEN 2 ELSE 3 END AS query_id FROM {notices}"


@query("search_students_by_name", "query_id bigint, id string, name string, ord bigint", f"""
SELECT query_id, id, name, row_number() OVER (PARTITION BY query_id ORDER BY rank, pos) AS ord FROM (
  SELECT query_id, id, name, rank, pos, row_number() OVER (PARTITION BY query_id, id, name ORDER BY rank, pos) AS rn FROM (
    SELECT h.query_id, rank, r.pos, CASE r.pos WHEN 0 THEN n.msv ELSE n.msv2 END AS id, CASE r.pos WHEN 0 THEN n.person ELSE 'Trần Thị ' || n.given END AS name, q.name AS wanted
    FROM ({keyword_sql('(SELECT query_id, unnest(string_split(name, chr(32))) AS w, unnest([0, 1, 2]) AS kw_idx FROM (' + _NAMES + '))',
                       '(SELECT chunk_uid, content, title, ' + S.fold('content') + ' AS content_folded FROM {notices} WHERE kind = 5)')}) h
    JOIN {{notices}} n ON n.chunk_uid = h.chunk_uid JOIN ({_NAMES}) q ON q.query_id = h.query_id, (VALUES (0), (1)) r(pos))
  WHERE name = wanted) WHERE rn = 1""")
def _(t):
    chunks = t.notices.withColumn("content_folded", T.fold(col("content")))
    return R.students_by_name(chunks, t.sql(_NAMES))


@query("route_target_student", "query_id bigint, target_id string, ambiguous boolean", """
SELECT query_id, CASE n WHEN 0 THEN id WHEN 1 THEN 'L1' WHEN 2 THEN CASE k WHEN 1 THEN 'F1' END WHEN 3 THEN CASE k WHEN 1 THEN 'F1' END WHEN 4 THEN 'L1' END AS target_id,
  n IN (2, 3) AND k = 2 AS ambiguous
FROM (SELECT query_id, user_id % 6 AS n, 1 + user_id % 2 AS k, '22' || lpad(CAST(query_id AS VARCHAR), 8, '0') AS id FROM {questions})""")
def _(t):
    n, k = col("user_id") % 6, 1 + col("user_id") % 2
    no = F.lit(None).cast("string")
    explicit = F.when(n == 0, F.concat(F.lit("22"), F.lpad(col("query_id").cast("string"), 8, "0")))
    name = F.when(n == 1, "Văn Nam").when(n.isin(2, 3), "Lê Hoa").otherwise(no)
    last_id = F.when(n.isin(1, 2, 4), "L1").otherwise(no)
    last_name = F.when(n.isin(1, 2), "Nguyễn Văn Nam").otherwise(no)
    rows = t.questions.select("query_id", R.resolve_target(
        explicit, name, last_id, last_name, k, F.lit("F1"), n == 4, F.lit(True)).alias("r"))
    return rows.select("query_id", "r.*")


# --- ranking ----------------------------------------------------------------
_TAGLESS = S.strip(S.rep("replace(" + S.rep("content", "<[^>]+>", " ") + ", '|', ' ')", r"\s+", " "))
_GARBAGE = f"""((len(string_split(content, '<td')) - 1 > 0 AND CAST(len(string_split(content, '<td></td>')) - 1 AS DOUBLE) / (len(string_split(content, '<td')) - 1) > 0.4)
  OR (content_type IN ('table_html_scan', 'table_md_scan', 'table_md') AND length({_TAGLESS}) < 50))"""
_VALID = f"""SELECT * EXCLUDE (best) FROM (SELECT *, coalesce(max(score) OVER (PARTITION BY query_id), 0) AS best FROM {{hits}})
WHERE best > 1e-9 AND coalesce(score, 0) >= CASE WHEN best < 0.5 THEN best * 0.7 ELSE 0.45 END AND NOT {_GARBAGE}"""


@query("rank_filter_results", "query_id bigint, chunk_uid string, score double", f"SELECT query_id, chunk_uid, score FROM ({_VALID})")
def _(t):
    return K.filter_results(t.hits)


def _any(x: str, terms) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in terms) + ")"


_YEARS = "[CAST(y AS INT) FOR y IN regexp_extract_all({x}, '(?:^|[^\\p{{L}}\\p{{N}}_])(20[0-9]{{2}})(?:$|[^\\p{{L}}\\p{{N}}_])', 1)]"


def _years(x: str) -> str:
    """Whole-word years; separators are doubled as matches share them."""
    spaced = S.rep(x, r"([^\p{L}\p{N}_])", r"\1\1")
    return f"[CAST(y AS INT) FOR y IN regexp_extract_all({spaced}, '(?:^|[^\\p{{L}}\\p{{N}}_])(20[0-9]{{2}})(?:$|[^\\p{{L}}\\p{{N}}_])', 1)]"


def _ranges(x: str) -> str:
    return f"regexp_extract_all({x}, '(20[0-9]{{2}}\\s*[-/]\\s*20[0-9]{{2}})', 1)"


def _norm_ranges(x: str) -> str:
    return f"[least(left(r, 4), right(r, 4)) || '-' || greatest(left(r, 4), right(r, 4)) FOR r IN {_ranges(x)}]"


from corpusmill import vocab as _v  # noqa: E402

_GROUP = "CASE " + " ".join(f"WHEN {_any('q', terms)} THEN '{name}'" for name, terms in _v.QUERY_GROUPS) + " END"
_SAME = "CASE g " + " ".join(f"WHEN '{name}' THEN {_any('lt', terms)}" for name, terms in _v.TITLE_GROUPS.items()) + " ELSE FALSE END"
_OTHER = "(" + " OR ".join(_any("lt", terms) for terms in _v.TITLE_GROUPS.values()) + ")"
_H = {name: _any("c", terms) for name, terms in _v.SEMESTERS}
_A = {name: _any("q", terms) for name, terms in _v.SEMESTERS}


def _pm(own: str, other: str) -> str:
    return f"(CASE WHEN {_H[own]} THEN 0.15 ELSE 0 END - CASE WHEN {_H[other]} THEN 0.10 ELSE 0 END)"


_RANKED = f"""
SELECT *, coalesce(score, 0.5)
  + CASE WHEN g IS NULL OR lt = '' THEN 0 WHEN {_SAME} THEN 0.20 WHEN {_OTHER} THEN -0.10 ELSE 0 END
  + CASE WHEN len(qr) > 0 AND len(dr) > 0 THEN CASE WHEN list_has_any(qr, dr) THEN 0.35 WHEN list_has_any(qy, dy) THEN -0.10 ELSE -0.30 END
         WHEN len(qy) > 0 AND len(dy) > 0 THEN CASE WHEN list_has_any(qy, dy) THEN 0.25 ELSE -0.25 END
         WHEN len(qy) > 0 THEN -0.05 WHEN len(dy) = 0 THEN 0
         WHEN list_max(dy) >= {YEAR_NOW} THEN 0.15 WHEN list_max(dy) = {YEAR_NOW} - 1 THEN 0.05 ELSE -0.10 END
  + CASE WHEN {_A['hk1']} THEN {_pm('hk1', 'hk2')} WHEN {_A['hk2']} THEN {_pm('hk2', 'hk1')} WHEN {_A['hk3']} THEN {_pm('hk3', 'hk1')}
         WHEN {_H['hk3']} THEN 0.015 WHEN {_H['hk2']} THEN 0.010 WHEN {_H['hk1']} THEN 0.005 ELSE 0 END AS rank_score
FROM (SELECT *, {_GROUP} AS g, {_years('q')} AS qy, {_norm_ranges('q')} AS qr, {_years('d')} AS dy, {_norm_ranges('d')} AS dr
  FROM (SELECT *, lower(query) AS q, lower(title) AS lt, lower(content) AS c, coalesce(date, 'None') || ' ' || title || ' ' || lower(content) AS d FROM ({_VALID})))"""


@query("rank_scores", "query_id bigint, chunk_uid string, rank_score double",
       f"SELECT query_id, chunk_uid, round(rank_score, 6) AS rank_score FROM ({_RANKED})")
def _(t):
    return K.rank_scores(K.filter_results(t.hits), YEAR_NOW).withColumn("rank_score", F.round("rank_score", 6))


@query("rank_rerank", "query_id bigint, chunk_uid string, rank bigint",
       f"SELECT query_id, chunk_uid, row_number() OVER (PARTITION BY query_id ORDER BY round(rank_score, 9) DESC, rank, chunk_uid) AS rank FROM ({_RANKED})")
def _(t):
    return K.rerank(K.filter_results(t.hits), YEAR_NOW)


@query("rank_scores_tuned", "query_id bigint, chunk_uid string, rank_score double", f"""
SELECT query_id, chunk_uid, round(rank_score + CASE WHEN chunk_type = 'table' THEN 0.3 ELSE 0 END
  + 0.15 * (CASE WHEN contains(c, 'msv') THEN 1 ELSE 0 END + CASE WHEN contains(c, 'stt') THEN 1 ELSE 0 END) / 2
  + 0.05 * CASE WHEN contains(c, 'phụ lục') THEN 1 ELSE 0 END, 6) AS rank_score FROM ({_RANKED})""")
def _(t):
    scored = K.rank_scores(K.filter_results(t.hits), YEAR_NOW, ["table"], None, ["MSV", "STT"], ["phụ lục"])
    return scored.withColumn("rank_score", F.round("rank_score", 6))


@query("rank_years", "query_id bigint, years string, ranges string",
       f"SELECT query_id, array_to_string(list_sort(list_distinct({_years('query')})), ',') AS years, array_to_string(list_sort(list_distinct({_norm_ranges('query')})), ',') AS ranges FROM {{questions}}")
def _(t):
    pairs = F.transform(K.year_ranges(col("query")), lambda r: F.concat_ws("-", r.lo.cast("string"), r.hi.cast("string")))
    years = F.transform(F.array_sort(K.years(col("query"))), lambda y: y.cast("string"))
    return t.questions.select("query_id", F.array_join(years, ",").alias("years"), F.array_join(F.array_sort(pairs), ",").alias("ranges"))


_TERMS = "list_slice([t FOR t IN [" + ", ".join(f"'{x}'" for x in _v.TOPIC_TERMS) + "] IF contains({q}, t)], 1, 5)"


def _topic_sql(text: str, terms: str) -> str:
    return f"(len({terms}) = 0 OR len([z FOR z IN {terms} IF contains({S.fold_query(text)}, {S.fold_query('z')})]) > 0)"


@query("rank_topic_terms", "query_id bigint, terms string",
       f"SELECT query_id, array_to_string({_TERMS.format(q='lower(query)')}, ',') AS terms FROM {{questions}}")
def _(t):
    return t.questions.select("query_id", F.array_join(K.topic_terms(col("query")), ",").alias("terms"))


_TEXT = "title || ' ' || source || ' ' || content"
_GUARD_IN = f"SELECT *, {_topic_sql(_TEXT, 'terms')} AS is_on FROM (SELECT *, {_TERMS.format(q='lower(query)')} AS terms FROM {{hits}})"


@query("rank_topic_guard", "query_id bigint, chunk_uid string", f"""
SELECT query_id, chunk_uid FROM (SELECT *, bool_or(is_on) OVER (PARTITION BY query_id) AS any_on FROM ({_GUARD_IN}))
WHERE is_on OR (NOT any_on AND NOT contains(lower(query), 'tết') AND NOT contains(lower(query), 'nguyên đán'))""")
def _(t):
    return K.topic_guard(t.hits)


@query("rank_year_filter", "query_id bigint, chunk_uid string", f"""
SELECT query_id, chunk_uid FROM (
  SELECT *, CASE WHEN len(qr) > 0 OR len(qy) >= 2 THEN min(cls) OVER (PARTITION BY query_id) END AS best FROM (
    SELECT *, CASE WHEN NOT is_on OR len(qy) = 0 THEN NULL WHEN list_has_any(qr, hr) THEN 1
      WHEN len(hy) > 0 AND list_has_all(hy, qy) THEN 2 WHEN list_has_any(hy, qy) THEN 3 END AS cls
    FROM (SELECT *, list_distinct({_years('query')}) AS qy, {_norm_ranges('query')} AS qr, {_years('d')} AS hy, {_norm_ranges('d')} AS hr
      FROM (SELECT *, title || ' ' || coalesce(date, 'None') || ' ' || source || ' ' || content AS d FROM ({_GUARD_IN})))))
WHERE best IS NULL OR cls = best""")
def _(t):
    return K.explicit_year_filter(t.hits)


_INTENT = "CASE WHEN contains(query, 'Thông báo') OR contains(query, 'nội dung') OR contains(query, 'văn bản') THEN 'document_info' WHEN contains(query, 'lịch') THEN 'schedule' WHEN contains(query, 'thủ tục') THEN 'regulation' ELSE 'general' END"
_HI = f"SELECT *, {_INTENT} AS intent FROM {{hits}}"


def hits_with_intent(t):
    return t.sql(_HI)


_TOP = f"SELECT * FROM ({_HI}) WHERE rank <= CASE WHEN intent IN ('document_info', 'regulation') THEN 8 ELSE 6 END"


@query("rank_top_k", "query_id bigint, chunk_uid string, rank bigint", f"SELECT query_id, chunk_uid, rank FROM ({_TOP})")
def _(t):
    return K.top_k(hits_with_intent(t))


@query("chunks_scroll", "doc_id bigint, chunk_uid string",
       "SELECT doc_id, chunk_uid FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_uid) AS n FROM {notices} WHERE is_active) WHERE n <= 50")
def _(t):
    return K.scroll_by_document(t.notices)


_EXPANDED = f"""
WITH top AS ({_TOP}), docs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, f) AS doc_rank FROM (
  SELECT query_id, doc_id, any_value(intent) AS intent, count(*) AS n, min(rank) AS f FROM top GROUP BY query_id, doc_id)) WHERE doc_rank <= 2),
scrolled AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_uid) AS n FROM {{notices}} WHERE is_active) WHERE n <= 50),
added AS (SELECT * FROM (SELECT d.query_id, d.doc_rank, d.intent, s.*, row_number() OVER (PARTITION BY d.query_id, d.doc_id ORDER BY o_orderkey) AS in_doc
  FROM docs d JOIN scrolled s ON s.doc_id = d.doc_id WHERE length(trim(content)) >= 30 AND NOT (d.intent = 'document_info' AND content_type = 'student_list')
  AND NOT EXISTS (SELECT 1 FROM top h WHERE h.query_id = d.query_id AND h.chunk_uid = s.chunk_uid)) WHERE in_doc <= 10)
SELECT query_id, chunk_uid, doc_id, chunk_id, intent, title, doc_number, date, issuer, source, content, content_type, score, row_number() OVER (PARTITION BY query_id ORDER BY doc_rank, in_doc, chunk_uid) AS rank FROM (
  SELECT query_id, chunk_uid, doc_id, chunk_id, intent, title, doc_number, date, issuer, source, content, content_type, score, 0 AS doc_rank, rank AS in_doc FROM top
  UNION ALL SELECT query_id, chunk_uid, doc_id, chunk_id, intent, title, doc_number, date, issuer, source, content, content_type, NULL, doc_rank, in_doc FROM added)"""


@query("rank_expand_documents", "query_id bigint, chunk_uid string, rank bigint", f"SELECT query_id, chunk_uid, rank FROM ({_EXPANDED})")
def _(t):
    return K.expand_documents(K.top_k(hits_with_intent(t)), t.notices)


_FOCUS = """SELECT h.*, row_number() OVER (PARTITION BY h.query_id ORDER BY CAST(regexp_extract(chunk_id, '(\\d+)$', 1) AS BIGINT), rank) AS ord FROM ({src}) h JOIN (
  SELECT query_id, doc_id FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, max(coalesce(score, 0)) DESC, min(rank)) AS rn
  FROM ({src}) GROUP BY query_id, doc_id) WHERE rn = 1) p ON p.query_id = h.query_id AND p.doc_id = h.doc_id"""


@query("rank_focus_document", "query_id bigint, chunk_uid string, rank bigint",
       "SELECT query_id, chunk_uid, ord AS rank FROM (" + _FOCUS.replace("{src}", "SELECT * FROM {hits}") + ")")
def _(t):
    return K.focus_primary(t.hits)


@query("rank_chunk_numbers", "o_orderkey bigint, a bigint, b bigint",
       "SELECT o_orderkey, o_orderkey AS a, 1000000000 AS b FROM {notices}")
def _(t):
    return t.notices.select("o_orderkey", K.chunk_number(col("chunk_id")).alias("a"), K.chunk_number(col("content_type")).alias("b"))


@query("rank_relaxed_fallback", "query_id bigint, chunk_uid string, rank bigint", f"""
WITH raw AS ({_HI}), valid AS (SELECT * FROM ({_VALID}) WHERE score > 0.97)
SELECT query_id, chunk_uid, rank FROM valid
UNION ALL SELECT query_id, chunk_uid, ord FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS ord FROM raw
  WHERE intent IN ('document_info', 'regulation', 'schedule') AND length(trim(content)) >= 30 AND query_id NOT IN (SELECT query_id FROM valid)) WHERE ord <= 3""")
def _(t):
    raw = hits_with_intent(t)
    return K.relaxed_fallback(K.filter_results(raw).where("score > 0.97"), raw)


_LABELS = " || ".join(f"CASE WHEN coalesce({f}, '') NOT IN ('', 'Không xác định') THEN '{label}: ' || {f} || ' | ' ELSE '' END" for f, label in _v.CONTEXT_LABELS)


def contexts_sql(src: str) -> str:
    """query_id, context of hits with a rank."""
    return f"""
SELECT query_id, string_agg(part, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY ord) AS context FROM (
  SELECT *, coalesce(sum(length(part)) OVER (PARTITION BY query_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_first, num, rank, chunk_uid) AS ord FROM (
      SELECT *, min(rank) OVER (PARTITION BY query_id, doc_id) AS doc_first, CAST(regexp_extract(chunk_id, '(\\d+)$', 1) AS BIGINT) AS num,
        '[' || CASE WHEN {_LABELS} = '' THEN source ELSE regexp_replace({_LABELS}, ' \\| $', '') END || ']' || chr(10)
        || CASE WHEN length(shown) > 2000 THEN left(shown, 2000) || chr(10) || '...[đã cắt bớt]' ELSE shown END AS part
      FROM (SELECT *, CASE WHEN content_type IN ('table_md_scan', 'table_md') THEN trim(regexp_replace(content, '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10) || ' ') ELSE content END AS shown FROM ({src}))
      WHERE length(trim(content)) >= 20 AND NOT (len(string_split(content, '<td')) > 1 AND CAST(len(string_split(content, '<td></td>')) - 1 AS DOUBLE) / (len(string_split(content, '<td')) - 1) > 0.4)
        AND NOT (content_type IN ('table_md_scan', 'table_md') AND length(trim(replace(shown, '|', ' '))) < 30))))
WHERE before < 15000 GROUP BY query_id"""


@query("rank_contexts", "query_id bigint, context string", contexts_sql("SELECT * FROM {hits}"))
def _(t):
    return K.build_contexts(t.hits)


@query("answer_sources", "query_id bigint, doc_id bigint, filename string, score double, ord bigint", """
SELECT query_id, doc_id, source AS filename, round_even(coalesce(score, 0) * 100, 0) / 100 AS score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS ord
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank) AS rn FROM {hits} WHERE doc_id <> 0) WHERE rn = 1""")
def _(t):
    return K.answer_sources(t.hits)


# --- end to end over documents ----------------------------------------------
_BATCH = f"""SELECT k.query_id, k.chunk_uid, k.rank, c.doc_id, 'chunk_' || CAST(c.doc_id AS VARCHAR) AS chunk_id, 'text' AS content_type, c.title, c.content,
  CAST(NULL AS VARCHAR) AS doc_number, CAST(NULL AS VARCHAR) AS date, CAST(NULL AS VARCHAR) AS issuer, c.title AS source
FROM ({keyword_sql('{asked_words}', '(SELECT * FROM {corpus} WHERE doc_id % 5 <> 0)')}) k JOIN {{corpus}} c ON c.chunk_uid = k.chunk_uid"""


@query("batch_search_contexts", "query_id bigint, context string",
       contexts_sql(_BATCH).replace("'[' || CASE", "'[' || CASE"))
def _(t):
    """Public chunks by keyword for every benchmark text, as bounded contexts."""
    from corpusmill.operators.filters import visible

    chunks = visible(corpus(t).withColumns({
        "is_active": F.lit(True), "access_scope": F.when(col("doc_id") % 5 == 0, "private").otherwise("public")}))
    hits = R.with_payload(R.keyword_search(chunks, asked(t)), chunks).withColumns({
        "chunk_id": F.concat(F.lit("chunk_"), col("doc_id")), "content_type": F.lit("text"), "chunk_type": F.lit("text"),
        "source": col("title"), **{c: F.lit(None).cast("string") for c in ("doc_number", "date", "issuer")}})
    return K.build_contexts(hits)
