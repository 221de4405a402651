"""Chunking of whole documents, and document versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import chunking as C
from corpusmill.operators import ingest_graph as I
from corpusmill.operators import page_tables as P
from corpusmill.operators import versions as V
from corpusmill.plans import sqltext as S
from corpusmill.plans import table_queries as TQ
from corpusmill.plans.registry import REGISTRY, query
from corpusmill.plans.tables import CTES

col = F.col
_PAGE_KEYS = "doc_id, page"


@query("pages_normalize", "doc_id bigint, page bigint, content string",
       f"SELECT doc_id, page, cleaned AS content FROM ({S.clean('{page_texts}', _PAGE_KEYS, 'raw_text')}) WHERE length(cleaned) >= 30")
def _(t):
    return C.normalize_pages(t.page_texts)


@query("pages_drop_table_noise", "doc_id bigint, page bigint, content string", f"""
SELECT doc_id, page, cleaned AS content FROM ({S.clean(
    "(SELECT p.doc_id, p.page, raw_text, x.page IS NOT NULL AS has_table FROM {page_texts} p LEFT JOIN (SELECT DISTINCT doc_id, page FROM {page_texts} WHERE contains(raw_text, '|')) x ON x.doc_id = p.doc_id AND x.page = p.page)",
    _PAGE_KEYS, 'raw_text', 'has_table')}) WHERE length(cleaned) >= 30""")
def _(t):
    return C.normalize_pages(t.page_texts, t.page_texts.where(col("raw_text").contains("|")))


@query("pages_split_recursive", "doc_id bigint, page bigint, pos bigint, content string")
def _(t):
    return C.split_pages(C.normalize_pages(t.page_texts))


_DEDUPED = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, content_type, {S.fold('content')}
  ORDER BY chunk_type <> 'text', pos) AS rn FROM {{pieces}}) WHERE rn = 1"""


@query("chunks_deduplicate", "doc_id bigint, page bigint, pos bigint, content string, content_type string",
       f"SELECT doc_id, page, pos, content, content_type FROM ({_DEDUPED})")
def _(t):
    return C.deduplicate(t.pieces)


_NUMBERED = f"""SELECT doc_id, page, content, row_number() OVER (PARTITION BY doc_id ORDER BY page, chunk_type <> 'text', pos) AS chunk_order,
  max(page) OVER (PARTITION BY doc_id) AS doc_total_pages FROM ({_DEDUPED})"""


@query("chunks_number", "doc_id bigint, page bigint, chunk_order bigint, chunk_id string, doc_total_pages bigint, content string",
       f"SELECT doc_id, page, chunk_order, 'chunk_' || CAST(chunk_order AS VARCHAR) AS chunk_id, doc_total_pages, content FROM ({_NUMBERED})")
def _(t):
    totals = t.page_texts.groupBy("doc_id").agg(F.max("page").alias("doc_total_pages"))
    return C.number_chunks(C.deduplicate(t.pieces), totals, pages_per_block=8)


def _uuid5(seed: str) -> str:
    h = f"sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({seed}))"
    return (f"(SELECT substr(h,1,8)||'-'||substr(h,9,4)||'-5'||substr(h,14,3)||'-'||translate(substr(h,17,1),'0123456789abcdef','89ab89ab89ab89ab')"
            f"||substr(h,18,3)||'-'||substr(h,21,12) FROM (SELECT {h} AS h))")


_SEED = f"CAST(doc_id AS VARCHAR) || ':' || CAST(version AS VARCHAR) || ':' || chunk_id || ':' || left({S.fold('content')}, 160)"


@query("chunks_point_ids", "o_orderkey bigint, chunk_uid string",
       f"SELECT o_orderkey, {_uuid5(_SEED)} AS chunk_uid FROM (SELECT *, 1 + o_orderkey % 3 AS version FROM {{notices}})")
def _(t):
    uid = C.point_id(col("doc_id"), 1 + col("o_orderkey") % 3, col("chunk_id"), col("content"))
    return t.notices.select("o_orderkey", uid.alias("chunk_uid"))


@query("chunks_payload", "doc_id bigint, chunk_id string, version bigint, access_scope string, target_id string, content_folded string, is_active boolean, chunk_uid string", f"""
SELECT doc_id, chunk_id, version, access_scope, target_id, {S.fold('content')} AS content_folded, TRUE AS is_active, {_uuid5(_SEED)} AS chunk_uid
FROM (SELECT n.doc_id, 'chunk_' || CAST(chunk_order AS VARCHAR) AS chunk_id, content, version, access_scope, target_id
  FROM ({_NUMBERED}) n JOIN (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY id) AS version FROM {{uploads}}) u ON u.id = n.doc_id)""")
def _(t):
    documents = V.version_log(t.uploads).withColumnRenamed("id", "doc_id")
    return C.payload(C.number_chunks(C.deduplicate(t.pieces)), documents)


@query("ingest_documents", "doc_id bigint, chunk_id string, page bigint, doc_total_pages bigint, version bigint, content string, chunk_uid string")
def _(t):
    documents = V.version_log(t.uploads).withColumnRenamed("id", "doc_id")
    return C.ingest(t.page_texts, documents)


@query("ingest_with_tables", "doc_id bigint, chunk_id string, page bigint, chunk_type string, content_type string, content string, chunk_uid string")
def _(t):
    documents = V.version_log(t.uploads).withColumnRenamed("id", "doc_id")
    return C.ingest(t.page_texts, documents, P.table_chunks(t.table_rows))


# --- ingest of all kinds of files ---------------------------------------------
# Oracle only: chunks of tables, the text chosen for each page, its first text, and sheets.
CTES["ingest_tables"] = f"""
SELECT doc_id, page, table_no, batch, part, content, content_type, 'pdfplumber' AS ocr_engine FROM ({REGISTRY['table_chunks'].sql.replace('{table_rows}', '{file_tables}')})
UNION ALL SELECT doc_id, page, table_no, 0, part, content, content_type, 'ppstructure' FROM ({TQ.SCAN_CHUNKS}) WHERE doc_id % 2 <> 0
  OR doc_id NOT IN (SELECT doc_id FROM ({REGISTRY['table_chunks'].sql.replace('{table_rows}', '{file_tables}')}))
"""
CTES["file_profile"] = f"""
SELECT doc_id, coalesce(bool_or(length({S.strip('raw_text')}) >= 60) FILTER (WHERE page = 1), FALSE) AS has, greatest(max(page), 1) AS total,
  min(raw_text) FILTER (WHERE page = 1) AS short FROM {{file_pages}} GROUP BY doc_id
"""
CTES["chosen_pages"] = f"""
SELECT p.doc_id, page, raw_text, 'native_pdf' AS ocr_engine FROM {{file_pages}} p JOIN {{file_profile}} f ON f.doc_id = p.doc_id WHERE has
UNION ALL SELECT r.doc_id, page, raw_text, 'hybrid_ocr' FROM (
  SELECT doc_id, page, string_agg(line, chr(10) ORDER BY anchor) AS raw_text FROM ({REGISTRY['ocr_reading_lines'].sql}) WHERE doc_id % 3 <> 0 GROUP BY doc_id, page) r
  LEFT JOIN {{file_profile}} f ON f.doc_id = r.doc_id WHERE NOT coalesce(has, FALSE)
"""
CTES["ingest_meta"] = f"""
SELECT doc_id, {TQ.META_FIELDS} FROM (SELECT doc_id, {S.normalize_whitespace(S.normalize_unicode('raw'))} AS x FROM (
  SELECT f.doc_id, coalesce(c.cleaned, n.raw_text, p.short, '') AS raw FROM {{files}} f LEFT JOIN {{file_profile}} p ON p.doc_id = f.doc_id
  LEFT JOIN (SELECT doc_id, raw_text FROM {{chosen_pages}} WHERE ocr_engine = 'native_pdf' AND page = 1) n ON n.doc_id = f.doc_id
  LEFT JOIN ({S.clean(f"(SELECT doc_id, page, raw_text FROM {{chosen_pages}} WHERE ocr_engine = 'hybrid_ocr' AND {S.fold('raw_text')} <> '' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page) = 1)", 'doc_id, page', 'raw_text')}) c ON c.doc_id = f.doc_id))
"""
CTES["ingest_text"] = f"""
SELECT doc_id, page, cleaned AS content FROM ({S.clean(
    "(SELECT p.doc_id, p.page, raw_text, x.page IS NOT NULL AS has_table FROM {chosen_pages} p LEFT JOIN (SELECT DISTINCT doc_id, page FROM {ingest_tables}) x ON x.doc_id = p.doc_id AND x.page = p.page)",
    _PAGE_KEYS, 'raw_text', 'has_table')}) WHERE length(cleaned) >= 30
"""
_FAN_IN = f"""
SELECT t.doc_id, page, 0 AS kind, 'text' AS chunk_type, 'text' AS content_type, ocr_engine, content, [0] AS pos, 'page' AS branch FROM {{ingest_text}} t JOIN {{chosen_pages}} USING (doc_id, page)
UNION ALL SELECT doc_id, page, 1, 'table', content_type, ocr_engine, content, [table_no, batch, part], 'page' FROM {{ingest_tables}}
UNION ALL SELECT doc_id, NULL, 1, NULL, 'excel_table', NULL, content, [ascii(sheet), batch], 'grid' FROM ({REGISTRY['sheet_chunks'].sql})"""
_NAMED = "regexp_replace(translate(filename, '_-', '  '), '\\.xlsx$', '')"
_INGESTED = f"""
SELECT c.*, 'chunk_' || CAST(chunk_order AS VARCHAR) AS chunk_id, f.filename AS source, f.version, f.access_scope, f.target_id, CASE WHEN branch = 'grid' THEN 1 ELSE coalesce(total, 1) END AS doc_total_pages,
  CASE WHEN branch = 'grid' THEN 'Danh_sách' ELSE m.doc_type END AS doc_type, CASE WHEN branch = 'grid' THEN {_NAMED} ELSE {S.normalize_whitespace('m.title')} END AS title,
  CASE WHEN branch = 'page' THEN m.doc_number END AS doc_number, CASE WHEN branch = 'page' THEN m.date END AS date,
  CASE WHEN branch = 'grid' THEN 'Không xác định' ELSE {S.normalize_whitespace('m.issuer')} END AS issuer
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(page, 0), kind, pos, content) AS chunk_order FROM (
    SELECT i.* FROM ({_FAN_IN}) i JOIN {{files}} f ON f.doc_id = i.doc_id AND (f.filename LIKE '%.xlsx') = (branch = 'grid')
    QUALIFY row_number() OVER (PARTITION BY i.doc_id, page, content_type, {S.fold('content')} ORDER BY kind, pos, content) = 1)) c
  JOIN {{files}} f ON f.doc_id = c.doc_id JOIN {{ingest_meta}} m ON m.doc_id = c.doc_id LEFT JOIN {{file_profile}} p ON p.doc_id = c.doc_id"""


def extracts(t):
    """What decoders would give of the files of all kinds."""
    return I.Extracts(t.file_pages, t.file_boxes, t.file_tables, t.scan_tables, t.grids)


@query("ingest_all", "doc_id bigint, chunk_order bigint, chunk_id string, page bigint, chunk_type string, content_type string, ocr_engine string, source string, version bigint, access_scope string, "
       "doc_total_pages bigint, doc_type string, title string, doc_number string, date string, issuer string, content string, chunk_uid string",
       f"SELECT *, {_uuid5(_SEED)} AS chunk_uid FROM ({_INGESTED})")
def _(t):
    # Pages count as one piece each, so that the rows do not depend on the recursive splitter.
    return I.ingest_all(t.files, extracts(t), size=1 << 30)


# --- versions ---------------------------------------------------------------
_LOG = """SELECT id, filename, is_processed, row_number() OVER w AS version, lag(id) OVER w AS parent_id, lead(id) OVER w IS NULL AS is_active
FROM {uploads} WINDOW w AS (PARTITION BY filename ORDER BY id)"""


@query("versions_log", "id bigint, filename string, version bigint, parent_id bigint, is_active boolean", _LOG)
def _(t):
    return V.version_log(t.uploads, size=64)


_WITH_DELETES = """
WITH u AS (SELECT filename, doc_id AS id, lag(doc_id) OVER w AS prev, row_number() OVER w AS n FROM {upload_events} WHERE kind = 'upload' WINDOW w AS (PARTITION BY filename ORDER BY seq)),
f AS (SELECT doc_id, arg_max(kind, seq) AS last_flag FROM {upload_events} WHERE kind <> 'upload' GROUP BY doc_id),
s AS (SELECT u.*, prev IS NULL OR coalesce(last_flag = 'delete', FALSE) AS fresh FROM u LEFT JOIN f ON f.doc_id = prev)
SELECT id, filename, n - max(CASE WHEN fresh THEN n END) OVER (PARTITION BY filename ORDER BY n) + 1 AS version, CASE WHEN NOT fresh THEN prev END AS parent_id FROM s"""


@query("versions_with_deletes", "id bigint, filename string, version bigint, parent_id bigint", _WITH_DELETES)
def _(t):
    return V.version_log_with_deletes(t.upload_events, size=640)


@query("versions_upload_gate", "processing bigint, may_upload boolean",
       f"SELECT count(*) AS processing, count(*) = 0 AS may_upload FROM ({_LOG}) WHERE is_active AND NOT is_processed")
def _(t):
    return V.blocking_uploads(V.version_log(t.uploads))


@query("versions_delete_restore", "id bigint, is_active boolean",
       f"SELECT v.id, coalesce(l.toxic = 0, is_active) AS is_active FROM ({_LOG}) v LEFT JOIN labels l ON l.doc_id = v.id")
def _(t):
    changes = t.labels.select(col("doc_id").alias("id"), (col("toxic") == 0).alias("flag"))
    return V.apply_flags(V.version_log(t.uploads), changes, "id")


@query("versions_chunk_flags", "doc_id bigint, page bigint, is_active boolean",
       "SELECT p.doc_id, page, coalesce(l.toxic = 0, TRUE) AS is_active FROM {page_texts} p LEFT JOIN labels l ON l.doc_id = p.doc_id")
def _(t):
    changes = t.labels.select("doc_id", (col("toxic") == 0).alias("flag"))
    return V.apply_flags(t.page_texts.withColumn("is_active", F.lit(True)), changes, "doc_id")


@query("versions_drop_chunks", "doc_id bigint, page bigint",
       f"SELECT doc_id, page FROM {{page_texts}} WHERE doc_id NOT IN (SELECT parent_id FROM ({_LOG}) WHERE parent_id IS NOT NULL)")
def _(t):
    return V.drop_document_chunks(t.page_texts, V.superseded(V.version_log(t.uploads)))


@query("versions_history", "id bigint, version bigint, newest_version bigint, newest_id bigint",
       f"SELECT id, version, max(version) OVER (PARTITION BY filename) AS newest_version, max(id) OVER (PARTITION BY filename) AS newest_id FROM ({_LOG})")
def _(t):
    return V.history(V.version_log(t.uploads))


@query("versions_rollback", "id bigint, is_active boolean", f"""
SELECT id, CASE WHEN target IS NULL THEN is_active ELSE id = target END AS is_active
FROM ({_LOG}) v LEFT JOIN (SELECT source, max(d.doc_id) AS target FROM documents d JOIN labels l ON l.doc_id = d.doc_id AND l.quality = 1 GROUP BY source) x ON x.source = v.filename""")
def _(t):
    good = t.documents.join(t.labels.where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    targets = good.groupBy(col("source").alias("filename")).agg(F.max("doc_id").alias("id"))
    return V.rollback(V.version_log(t.uploads), targets)


_ASOF = "SELECT c_custkey AS doc_id, CAST('1996-01-01' AS TIMESTAMP) + c_nationkey * INTERVAL '100' DAY AS ts FROM {customer}"


@query("versions_valid_at", "doc_id bigint, id bigint", f"""
SELECT v.doc_id, v.id FROM {{valid_documents}} v JOIN ({_ASOF}) q ON q.doc_id = v.doc_id
WHERE (effective_date IS NULL OR effective_date <= ts) AND (expiry_date IS NULL OR ts < expiry_date)""")
def _(t):
    return t.valid_documents.join(t.sql(_ASOF), "doc_id").where(V.valid_at(col("ts"))).select("doc_id", "id")


@query("users_backfill_role", "id bigint, role string",
       "SELECT id, CASE WHEN is_superuser AND (role IS NULL OR role = 'user') THEN 'admin' ELSE role END AS role FROM {users}")
def _(t):
    return V.backfill_role(t.users)


@query("schema_add_column", "id bigint, is_processed boolean, file_path string, role string",
       "SELECT u.id, is_processed, CAST(NULL AS VARCHAR) AS file_path, 'user' AS role FROM {uploads} u")
def _(t):
    docs = V.add_column(t.uploads, "is_processed", "boolean", False)
    return V.add_column(V.add_column(docs, "file_path", "string"), "role", "string", "user")
