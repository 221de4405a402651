"""Sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import chunking as C
from corpusmill.operators import versions as V
from corpusmill.plans.chunk_queries import _LOG, _WITH_DELETES
from corpusmill.plans.dialogue_queries import _BOTH, _NUM, _PARTS, _TURNS
from corpusmill.plans.registry import query
from corpusmill.session import shared_folder
from corpusmill.sources import landing as L
from corpusmill.sources import sinks as K
from corpusmill.streaming.ingest import current_chunks, start_ingest
from corpusmill.streaming.memory import stream_memory
from corpusmill.streaming.versions import compact_store, read_versions, start_versions

col = F.col

_FILES = """SELECT o_orderkey AS id, o_orderdate AS ts, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 10 END AS length,
  CASE o_orderkey % 5 WHEN 0 THEN 'Diem_ren-luyen ' || CAST(o_orderkey AS STRING) || '.xlsx' WHEN 1 THEN 'BANG.XLS' WHEN 2 THEN 'a.b_c.csv' WHEN 3 THEN 'notice.pdf' ELSE '.csv' END AS name FROM {orders}"""


@query("landing_uploads", "id bigint, stored_name string",
       f"SELECT id, strftime(ts, '%Y%m%d%H%M%S') || '_' || name AS stored_name FROM ({_FILES}) WHERE length > 0")
def _(t):
    return L.accept_uploads(t.sql(_FILES))


@query("landing_routes", "id bigint, route string, title string", f"""
SELECT id, CASE WHEN ext IN ('.xls', '.xlsx', '.csv') THEN 'grid' ELSE 'page' END AS route, translate(CASE WHEN ext = '' THEN name ELSE replace(name, ext, '') END, '_-', '  ') AS title
FROM (SELECT *, lower(regexp_extract(name, '[^.](\\.[^./]*)$', 1)) AS ext FROM ({_FILES}))""")
def _(t):
    return t.sql(_FILES).select("id", L.route(col("name")).alias("route"), L.sheet_metadata(col("name")).title.alias("title"))


@query("pages_profile", "doc_id bigint, has_native boolean, total_pages bigint",
       "SELECT doc_id, bool_or(page = 1 AND length(trim(raw_text, chr(10) || chr(9) || chr(13) || ' ')) >= 60) AS has_native, max(page) AS total_pages FROM {page_texts} GROUP BY doc_id")
def _(t):
    return L.text_profile(t.page_texts)


@query("pages_choose_source", "doc_id bigint, page bigint, engine string", """
SELECT doc_id, page, CASE WHEN has THEN 'native' ELSE 'ocr' END AS engine FROM {page_texts} p
JOIN (SELECT doc_id AS d, bool_or(page = 1 AND length(trim(raw_text, chr(10) || chr(9) || chr(13) || ' ')) >= 60) AS has FROM {page_texts} GROUP BY doc_id) ON d = doc_id""")
def _(t):
    pages = t.page_texts.select("doc_id", "page")
    return L.choose_text(pages.withColumn("engine", F.lit("native")), pages.withColumn("engine", F.lit("ocr")), L.text_profile(t.page_texts))


@query("tables_choose_source", "o_orderkey bigint", """
SELECT o_orderkey FROM {notices} WHERE kind = 1 UNION ALL SELECT o_orderkey FROM {notices} WHERE kind = 4 AND doc_id NOT IN (SELECT doc_id FROM {notices} WHERE kind = 1)""")
def _(t):
    return L.choose_tables(t.notices.where("kind = 1"), t.notices.where("kind = 4"))


_OUT = """SELECT event_id, CASE WHEN event_type = 'click' THEN 'log [x] started [1, ' || chr(10) || '[' || chr(123) || '"text": "a [b] ' || CAST(event_id AS STRING) || '"' || chr(125) || ', ' || chr(123) || '"text": "c"' || chr(125) || ']  '
  WHEN event_type = 'error' THEN 'no list here' ELSE 'warn [' || event_type || '] [' || chr(123) || '"text": "' || event_type || '"' || chr(125) || '] done]' END AS out FROM {events}"""


@query("json_salvage", "event_id bigint, n bigint, first string", f"""
SELECT event_id, CASE WHEN out LIKE 'log%' THEN 2 ELSE 0 END AS n, CASE WHEN out LIKE 'log%' THEN 'a [b] ' || CAST(event_id AS VARCHAR) END AS first FROM ({_OUT})""")
def _(t):
    rows = t.sql(_OUT).select("event_id", L.salvage_json_array(col("out")).alias("items"))
    return rows.select("event_id", F.size("items").alias("n"), F.get_json_object(F.get("items", F.lit(0)), "$.text").alias("first"))


@query("landing_files", "lang string, bytes bigint, empty bigint",
       "SELECT lang, sum(octet_length(encode(text)) + 1) AS bytes, 0 AS empty FROM documents GROUP BY lang")
def _(t):
    path = shared_folder(t.spark, "uploads")
    t.documents.select("lang", "text").write.partitionBy("lang").text(path)
    files = L.landed_files(t.spark, path).withColumn("lang", F.regexp_extract("path", "lang=([^/]*)", 1))
    return files.groupBy("lang").agg(F.sum("length").alias("bytes"), F.count_if(F.octet_length("content") != F.col("length")).alias("empty"))


# A third of the parts with a quote inside a cell, a third with a quoted cell of two lines.
_CSV = """SELECT p_partkey % 8 AS g, p_partkey, CASE p_partkey % 3 WHEN 0 THEN '7" ' || p_name WHEN 1 THEN p_name || ',' || chr(10) || '"x"' ELSE p_name END AS name, p_brand FROM {part}"""


@query("csv_grid_rows", "source string, row_idx bigint, cells string", f"""
SELECT 'g' || CAST(g AS VARCHAR) AS source, row_number() OVER (PARTITION BY g ORDER BY p_partkey) - 1 AS row_idx, CAST(p_partkey AS VARCHAR) || '|' || name || '|' || p_brand AS cells FROM ({_CSV})""")
def _(t):
    path = shared_folder(t.spark, "csv")
    quoted = F.when(col("name").contains("\n"), F.concat(F.lit('"'), F.replace("name", F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(col("name"))
    rows = t.sql(_CSV).withColumn("value", F.concat_ws(",", col("p_partkey").cast("string"), quoted, "p_brand"))
    rows.repartition("g").sortWithinPartitions("g", "p_partkey").select("g", "value").write.partitionBy("g").text(path)
    group = F.concat(F.lit("g"), F.get("cells", F.lit(0)).cast("long") % 8)
    return L.csv_grids(t.spark, path).select(group.alias("source"), "row_idx", F.array_join("cells", "|").alias("cells"))


# --- sinks ------------------------------------------------------------------
@query("chunks_upsert", "chunk_uid string, content string", """
SELECT 'u' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS chunk_uid, CASE WHEN kind <= 3 THEN 'new' ELSE title END AS content FROM {notices} WHERE kind >= 2 OR kind <= 3""")
def _(t):
    old = t.notices.where("kind >= 2").select("chunk_uid", col("title").alias("content"))
    return K.upsert(old, t.notices.where("kind <= 3").select("chunk_uid", F.lit("new").alias("content")))


@query("chunks_with_vectors", "chunk_uid string, dim bigint", "SELECT CAST(vec_id AS VARCHAR) AS chunk_uid, len(embedding) AS dim FROM embeddings")
def _(t):
    vectors = t.embeddings.select(col("vec_id").cast("string").alias("chunk_uid"), "embedding")
    return K.attach_vectors(vectors.select("chunk_uid"), vectors).select("chunk_uid", F.size("embedding").alias("dim"))


@query("chunks_store_roundtrip", "chunk_uid string, content string", """
SELECT chunk_uid, CASE WHEN kind <= 3 THEN 'new' ELSE title END AS content FROM {notices}""")
def _(t):
    path = shared_folder(t.spark, "store")
    slim = t.notices.select("chunk_uid", "doc_id", "kind", col("title").alias("content"))
    K.write_chunks(t.spark, slim.where("kind >= 2").drop("kind"), path, 8)
    K.write_chunks(t.spark, slim.where("kind <= 3").withColumn("content", F.lit("new")).drop("kind"), path, 8, batch=1)
    return K.read_chunks(t.spark, path)


@query("chunks_reset", "chunk_uid string, content string",
       "SELECT chunk_uid, 'new' AS content FROM {notices} WHERE kind <= 3")
def _(t):
    path = shared_folder(t.spark, "reset")
    slim = t.notices.select("chunk_uid", "doc_id", "kind", col("title").alias("content"))
    K.write_chunks(t.spark, slim.where("kind >= 2").drop("kind"), path, 8)
    K.reset_chunks(t.spark, path)
    K.write_chunks(t.spark, slim.where("kind <= 3").withColumn("content", F.lit("new")).drop("kind"), path, 8, batch=1)
    return K.read_chunks(t.spark, path)


@query("messages_append", "session_id string, turn bigint, role string, content string", f"""
SELECT session_id, turn * 2 AS turn, 'user' AS role, query AS content FROM ({_TURNS}) UNION ALL SELECT session_id, turn * 2 + 1, 'ai', answer FROM ({_TURNS})""")
def _(t):
    path = shared_folder(t.spark, "messages")
    K.append_messages(K.turn_messages(t.sql(_TURNS)), path)
    return t.spark.read.parquet(path)


@query("documents_mark_processed", "id bigint, is_processed boolean",
       "SELECT id, is_processed OR EXISTS (SELECT 1 FROM {page_texts} p WHERE p.doc_id = id AND length(raw_text) >= 30) AS is_processed FROM {uploads}")
def _(t):
    return K.mark_processed(t.uploads, t.page_texts.where(F.length("raw_text") >= 30))


# --- streams ----------------------------------------------------------------
@query("stream_ingest", "doc_id bigint, chunk_id string, content string, chunk_uid string")
def _(t):
    base = shared_folder(t.spark, "ingest")
    t.page_texts.select("doc_id", "page", "raw_text").repartition(4, "doc_id").write.parquet(f"{base}/pages")
    documents = V.version_log(t.uploads).withColumnRenamed("id", "doc_id")
    run = start_ingest(t.spark, f"{base}/pages", documents, base, f"{base}/checkpoint", 2, 8)
    run.awaitTermination()
    return current_chunks(t.spark, base, documents)


@query("stream_session_memory", "session_id string, turn bigint, turn_count bigint, recent string, summary string", f"""
SELECT a.session_id, a.turn, a.n AS turn_count,
  (SELECT string_agg({_BOTH}, chr(10) ORDER BY n) FROM ({_NUM}) b WHERE b.session_id = a.session_id AND b.n <= a.n AND b.n > a.n // 4 * 4 - 2) AS recent,
  coalesce((SELECT string_agg(part, ' | ' ORDER BY n) FROM ({_PARTS}) p WHERE p.session_id = a.session_id AND p.n <= a.n), '') AS summary
FROM ({_NUM}) a""")
def _(t):
    base = shared_folder(t.spark, "memory")
    turns = t.sql(_TURNS).select("session_id", "turn", "query", "answer").repartition(4, "session_id")
    turns.write.parquet(f"{base}/turns")
    source = t.spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/turns")
    run = (
        stream_memory(source).writeStream.format("parquet").outputMode("append").option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return t.spark.read.parquet(f"{base}/out")


def _versions_store(t) -> str:
    """A store whose versions were streamed, the events coming in three steps by ``seq``."""
    base = shared_folder(t.spark, "versions")
    low, high = t.upload_events.agg(F.coalesce(F.min("seq"), F.lit(0)), F.coalesce(F.max("seq"), F.lit(0))).first()
    steps = t.upload_events.withColumn("step", F.floor((col("seq") - low) * 3 / (high - low + 1)))
    for step in range(3):
        steps.where(col("step") == step).select("filename", "seq", "kind", "doc_id").repartition(2, "filename").write.mode("append").parquet(f"{base}/events")
    events = t.spark.readStream.schema(t.upload_events.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/events")
    start_versions(events, base, f"{base}/checkpoint").awaitTermination()
    return base


@query("stream_versions", "id bigint, filename string, version bigint, parent_id bigint", _WITH_DELETES)
def _(t):
    return read_versions(t.spark, _versions_store(t))


@query("chunks_compact_replaced", "doc_id bigint, chunk_uid string",
       f"SELECT doc_id, chunk_uid FROM {{notices}} WHERE doc_id NOT IN (SELECT parent_id FROM ({_WITH_DELETES}) WHERE parent_id IS NOT NULL)")
def _(t):
    base = _versions_store(t)
    K.write_chunks(t.spark, t.notices.select("doc_id", "chunk_uid"), f"{base}/chunks", 8)
    compact_store(t.spark, base, f"{base}/compacted", 8)
    return t.spark.read.parquet(f"{base}/compacted/chunks")
