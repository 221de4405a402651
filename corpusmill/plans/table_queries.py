"""Metadata, filters, spreadsheet grids, page tables and recognised boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill import vocab
from corpusmill.functions import metadata as M
from corpusmill.functions import text as T
from corpusmill.operators import filters as FL
from corpusmill.operators import grids as G
from corpusmill.operators import ocr as O
from corpusmill.operators import page_tables as P
from corpusmill.plans import sqltext as S
from corpusmill.plans.registry import query

col = F.col

# --- metadata ---------------------------------------------------------------
_DATES = """SELECT o_orderkey, CASE o_orderkey % 6
  WHEN 0 THEN 'ký ' || yy || '-' || mm || '/' || dd || ' x'
  WHEN 1 THEN 'Hà Nội, Ngày ' || dd || ' tháng ' || mm || '  năm ' || yy
  WHEN 2 THEN '31/02/' || yy || ' rồi ' || yy || '-' || mm || '-31'
  WHEN 3 THEN dd || '/' || mm || '/' || yy || chr(10) || 'ngày 1 tháng 1 năm 2020'
  WHEN 4 THEN 'Không xác định' ELSE '12-1999 ' || dd END AS raw FROM {notices}"""


def _date_sql(x: str) -> str:
    nw = S.NOT_WORD
    ymd = rf"(?:^|{nw})(20[0-9]{{2}})[-/]([0-9]{{1,2}})[-/]([0-9]{{1,2}})(?:$|{nw})"
    dmy = rf"(?:^|{nw})([0-9]{{1,2}})[-/]([0-9]{{1,2}})[-/](20[0-9]{{2}})(?:$|{nw})"
    words = r"(?i)ngày\s*([0-9]{1,2})\s*tháng\s*([0-9]{1,2})\s*năm\s*(20[0-9]{2})"

    def one(pattern: str, order: tuple[int, int, int]) -> str:
        parts = " || '-' || ".join(f"regexp_extract({x}, '{pattern}', {g})" for g in order)
        return f"TRY_CAST(nullif({parts}, '--') AS DATE)"

    return f"strftime(coalesce({one(ymd, (1, 2, 3))}, {one(dmy, (3, 2, 1))}, {one(words, (3, 2, 1))}), '%Y-%m-%d')"


@query("metadata_dates", "o_orderkey bigint, date string",
       f"SELECT o_orderkey, {_date_sql('raw')} AS date FROM ({_DATES})")
def _(t):
    return t.sql(_DATES).select("o_orderkey", M.sanitize_date(col("raw")).alias("date"))


_FIRST = """SELECT o_orderkey, 'Trường Đại học  Mẫu' || chr(10) || 'Số : ' || CASE WHEN sem = '1' THEN '.;' ELSE doc_number END || '.' || chr(10)
  || CASE WHEN sem = '2' THEN 'BỘ LUẬT x' ELSE title END || chr(10) || content AS raw, title, doc_number, date, issuer, yy FROM {notices}"""
_txt = S.normalize_whitespace(S.normalize_unicode("raw"))
_WSC = r"[\s\x{A0}]"


def _first(*parts: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({p}, '')" for p in parts) + ", 'Không xác định')"


# Metadata fields of a normalised text x.
META_FIELDS = f"""CASE WHEN lower(x) LIKE '%thông báo%' THEN 'Thông_báo' WHEN lower(x) LIKE '%quyết định%' THEN 'Quyết_định'
    WHEN lower(x) LIKE '%công văn%' THEN 'Công_văn' WHEN lower(x) LIKE '%kế hoạch%' THEN 'Kế_hoạch'
    WHEN lower(x) LIKE '%báo cáo%' THEN 'Báo_cáo' WHEN lower(x) LIKE '%danh sách%' THEN 'Danh_sách' ELSE 'Khác' END AS doc_type,
  {_first(r"regexp_extract(x, '(?i)(THÔNG\s+BÁO[^\n]{0,200})', 1)", r"regexp_extract(x, '(?i)(QUYẾT\s+ĐỊNH[^\n]{0,200})', 1)", r"regexp_extract(x, '(?i)(CÔNG\s+VĂN[^\n]{0,200})', 1)")} AS title,
  {_first(r"trim(regexp_extract(x, 'Số\s*[:.]?\s*([0-9A-Za-z/\-\.]+)', 1), '.,;:')", r"trim(regexp_extract(x, 'số\s*[:.]?\s*([0-9A-Za-z/\-\.]+)', 1), '.,;:')")} AS doc_number,
  {_date_sql('x')} AS date,
  {_first(r"regexp_extract(x, '(?i)(Trường\s+Đại\s+học\s+[^\n]{3,120})', 1)", r"regexp_extract(x, '(?i)(Bộ\s+[^\n]{3,120})', 1)")} AS issuer"""

_meta_sql = f"""
SELECT o_orderkey, title AS given_title, doc_number AS given_number, date AS given_date, issuer AS given_issuer, yy,
  {META_FIELDS}
FROM (SELECT *, {_txt} AS x FROM ({_FIRST}))"""


@query("metadata_from_text", "o_orderkey bigint, doc_type string, title string, doc_number string, date string, issuer string",
       f"SELECT o_orderkey, doc_type, {S.normalize_whitespace('title')} AS title, doc_number, date, {S.normalize_whitespace('issuer')} AS issuer FROM ({_meta_sql})")
def _(t):
    return t.sql(_FIRST).select("o_orderkey", M.metadata_from_text(col("raw")).alias("m")).select("o_orderkey", "m.*")


@query("metadata_merge", "o_orderkey bigint, doc_type string, title string, doc_number string, date string, issuer string, section string",
       f"""SELECT o_orderkey, doc_type, coalesce(nullif(given_title, 'Không xác định'), {S.normalize_whitespace('title')}) AS title,
  coalesce(nullif(given_number, 'Không xác định'), doc_number) AS doc_number, coalesce(strftime(TRY_CAST(given_date AS DATE), '%Y-%m-%d'), date) AS date,
  coalesce(nullif(given_issuer, 'Không xác định'), {S.normalize_whitespace('issuer')}) AS issuer, 'khac' AS section FROM ({_meta_sql})""")
def _(t):
    found = t.sql(_FIRST).withColumn("m", M.metadata_from_text(col("raw")))
    primary = {"title": col("title"), "doc_number": col("doc_number"), "date": col("date"), "issuer": col("issuer")}
    fallback = {name: col(f"m.{name}") for name in vocab.META_DEFAULTS}
    return found.select("o_orderkey", *[c.alias(n) for n, c in M.merge_metadata(primary, fallback).items()])


_GEN = "regexp_matches(lower(array_to_string(cells, ' ')), 'stt|mã|nội dung|khóa|học kỳ')"


def _student_sql(cells: str) -> str:
    x = S.fold(f"array_to_string({cells}, ' ')")
    return f"(regexp_matches({x}, 'ma sinh vien|msv|ma sv') AND regexp_matches({x}, 'ho ten|ten sinh vien|sinh vien|lop'))"


@query("table_header_tests", "doc_id bigint, page bigint, table_no bigint, row_idx bigint, is_student boolean, is_generic boolean",
       f"SELECT doc_id, page, table_no, row_idx, {_student_sql('cells')} AS is_student, {_GEN} AS is_generic FROM {{table_rows}}")
def _(t):
    return t.table_rows.select(
        *P.TABLE, "row_idx", M.is_student_header(col("cells")).alias("is_student"),
        M.is_generic_header(col("cells")).alias("is_generic"))


@query("table_row_ids", "doc_id bigint, page bigint, table_no bigint, row_idx bigint, id string, sheet_ids string", """
SELECT doc_id, page, table_no, row_idx, [d FOR d IN [regexp_replace(c, '[^0-9]', '', 'g') FOR c IN cells] IF length(d) = 10][1] AS id,
  array_to_string([c FOR c IN [trim(x) FOR x IN cells] IF regexp_matches(c, '^[0-9]{10}$')], ',') AS sheet_ids FROM {table_rows}""")
def _(t):
    return t.table_rows.select(
        *P.TABLE, "row_idx", M.row_student_id(col("cells")).alias("id"),
        F.array_join(M.sheet_row_ids(F.transform("cells", lambda c: F.trim(c))), ",").alias("sheet_ids"))


# --- filters ----------------------------------------------------------------
@query("filter_match_value", "o_orderkey bigint", "SELECT o_orderkey FROM {notices} WHERE content_type = 'text' AND is_active")
def _(t):
    spec = {"must": [{"key": "content_type", "match": {"value": "text"}}, {"key": "is_active", "match": {"value": True}}]}
    return t.notices.where(FL.compile_filter(t.notices, spec)).select("o_orderkey")


def _tokens(x: str, low: int = 2, high: int = 32) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) BETWEEN {low} AND {high})"


@query("filter_match_text", "doc_id bigint, has_the boolean, has_und_das boolean, has_nothing boolean", f"""
SELECT doc_id, list_has_all(w, ['the']) AS has_the, list_has_all(w, ['und', 'das']) AS has_und_das, FALSE AS has_nothing
FROM (SELECT doc_id, {_tokens('text')} AS w FROM documents)""")
def _(t):
    docs = t.documents.select("doc_id", "text")
    test = lambda words: FL.match_text(col("text"), F.lit(words))
    return docs.select(
        "doc_id", test("THE").alias("has_the"), test("und, das").alias("has_und_das"), test("a - !").alias("has_nothing"))


@query("filter_match_any", "o_orderkey bigint", "SELECT o_orderkey FROM {notices} WHERE content_type IN ('text', 'table_md')")
def _(t):
    spec = {"must": [{"key": "content_type", "match": {"any": ["text", "table_md"]}}, {"key": "title", "match": {"any": []}}]}
    return t.notices.where(FL.compile_filter(t.notices, spec)).select("o_orderkey")


@query("filter_must_should_must_not", "o_orderkey bigint", f"""
SELECT o_orderkey FROM {{notices}} WHERE is_active AND (access_scope = 'public' OR list_has_all({_tokens('title', 2, 40)}, ['học', 'phí']))
  AND NOT (content_type = 'student_list' OR kind = 4)""")
def _(t):
    spec = {
        "must": [{"key": "is_active", "match": {"value": True}}, {"key": "x"}, "noise"],
        "should": [{"key": "access_scope", "match": {"value": "public"}}, {"key": "title", "match": {"text": "học phí"}}],
        "must_not": [{"key": "content_type", "match": {"value": "student_list"}}, {"key": "kind", "match": {"any": 4}}],
    }
    return t.notices.where(FL.compile_filter(t.notices, spec)).select("o_orderkey")


@query("filter_security", "o_orderkey bigint", "SELECT o_orderkey FROM {notices} WHERE is_active AND access_scope = 'public'")
def _(t):
    return FL.visible(t.notices).select("o_orderkey")


@query("filter_private_scope", "query_id bigint, o_orderkey bigint", """
SELECT query_id, o_orderkey FROM {questions} JOIN {notices} ON doc_id = query_id
WHERE is_active AND (access_scope = 'public' OR target_id = 'user' || CAST(user_id % 7 AS VARCHAR))""")
def _(t):
    asked = t.questions.join(t.notices, col("doc_id") == col("query_id"))
    return asked.where(FL.visible_to(F.concat(F.lit("user"), col("user_id") % 7))).select("query_id", "o_orderkey")


@query("filter_student_ids", "o_orderkey bigint, n_ids bigint", """
SELECT o_orderkey, 2 AS n_ids FROM {notices} WHERE kind = 5 AND is_active AND access_scope = 'public' AND msv IN ('2200000007', '2200000011')""")
def _(t):
    chunks = t.notices.where("kind = 5").withColumn("student_ids_in_chunk", F.array("msv", "msv2"))
    spec = FL.with_ids(FL.security_spec(), ["2200000007", "2200000011"])
    return chunks.where(FL.compile_filter(chunks, spec)).select("o_orderkey", F.size("student_ids_in_chunk").alias("n_ids"))


@query("filter_types_by_intent", "o_orderkey bigint, intent string", """
SELECT o_orderkey, intent FROM {notices}, (VALUES ('student_lookup'), ('document_info'), ('schedule')) v(intent)
WHERE NOT (intent IN ('student_lookup', 'document_info') AND content_type = 'student_list')""")
def _(t):
    intents = F.explode(F.array(*[F.lit(i) for i in ("student_lookup", "document_info", "schedule")])).alias("intent")
    rows = t.notices.select("o_orderkey", "content_type", intents)
    return rows.where(FL.type_allowed(col("intent"), col("content_type"), F.lit(False))).select("o_orderkey", "intent")


@query("filter_preferred_types", "o_orderkey bigint",
       "SELECT o_orderkey FROM {notices} WHERE is_active AND access_scope = 'public' AND chunk_type = 'table' AND sem = '2'")
def _(t):
    chunks = FL.visible(t.notices.withColumn("time_info", col("sem")))
    return chunks.where(FL.preferred(chunks, ["table"], "2")).select("o_orderkey")


@query("filter_invalid_vectors", "vec_id bigint, variant bigint, invalid boolean", """
SELECT vec_id, v AS variant, v > 0 AS invalid FROM embeddings, (VALUES (0), (1), (2)) x(v)""")
def _(t):
    zero = F.transform("embedding", lambda x: x * 0)
    variants = F.posexplode(F.array(col("embedding"), zero, F.array().cast("array<float>"))).alias("variant", "v")
    return t.embeddings.select("vec_id", variants).select("vec_id", "variant", FL.is_invalid_vector(col("v")).alias("invalid"))


# --- spreadsheet grids ------------------------------------------------------
_RT = "lower(array_to_string(cells, ' '))"
_heads = f"""
SELECT g.doc_id, g.sheet, any_value(header_idx) AS header_idx,
  any_value(header_idx) + CASE WHEN bool_or(row_idx = header_idx + 1 AND regexp_matches({_RT}, 'điểm số|lớp xếp loại')) THEN 2 ELSE 1 END AS data_idx,
  string_agg(CASE WHEN row_idx < header_idx THEN nullif(' - ' || array_to_string([trim(c) FOR c IN cells IF trim(c) <> ''], ' | '), ' - ') END, chr(10) ORDER BY row_idx) AS pre,
  any_value(cells) FILTER (WHERE row_idx = header_idx) AS head,
  any_value(cells) FILTER (WHERE row_idx = header_idx + 1 AND regexp_matches({_RT}, 'điểm số|lớp xếp loại')) AS sub
FROM {{grids}} g JOIN (SELECT doc_id, sheet, coalesce(min(row_idx) FILTER (WHERE regexp_matches({_RT}, 'stt|mã sinh viên|họ và tên')), 0) AS header_idx FROM {{grids}} GROUP BY doc_id, sheet) h
  ON h.doc_id = g.doc_id AND h.sheet = g.sheet WHERE row_idx <= header_idx + 1 GROUP BY g.doc_id, g.sheet"""
_heads2 = f"""
SELECT doc_id, sheet, header_idx, data_idx,
  CASE WHEN pre IS NULL THEN '' ELSE '**THÔNG TIN CHUNG:**' || chr(10) || pre || chr(10) || chr(10) END || '**DANH SÁCH CHI TIẾT:**' || chr(10) AS context,
  [trim(coalesce(trim(replace(head[j], chr(10), ' ')), 'Column_' || CAST(j - 1 AS VARCHAR)) || CASE WHEN sub IS NULL THEN '' ELSE ' ' || coalesce(trim(replace(sub[j], chr(10), ' ')), '') END) FOR j IN range(1, len(head) + 1)] AS headers
FROM ({_heads})"""


@query("sheet_header_rows", "doc_id bigint, sheet string, header_idx bigint",
       f"SELECT doc_id, sheet, header_idx FROM ({_heads})")
def _(t):
    return G.header_rows(t.grids)


@query("sheet_context", "doc_id bigint, sheet string, data_idx bigint, context string",
       f"SELECT doc_id, sheet, data_idx, context FROM ({_heads2})")
def _(t):
    return G.sheet_heads(t.grids)


@query("sheet_column_names", "doc_id bigint, sheet string, headers string",
       f"SELECT doc_id, sheet, array_to_string(headers, '|') AS headers FROM ({_heads2})")
def _(t):
    return G.sheet_heads(t.grids).select("doc_id", "sheet", F.array_join("headers", "|").alias("headers"))


@query("sheet_chunks", "doc_id bigint, sheet string, batch bigint, content string, ids string, n_rows bigint", f"""
SELECT r.doc_id, r.sheet, batch, any_value(context) || '| ' || any_value(array_to_string(headers, ' | ')) || ' |' || chr(10)
  || '|' || any_value(array_to_string(['---' FOR h IN headers], '|')) || '|' || chr(10) || string_agg('| ' || array_to_string(clean, ' | ') || ' |', chr(10) ORDER BY row_idx) AS content,
  string_agg(nullif(array_to_string([c FOR c IN clean IF regexp_matches(c, '^[0-9]{{10}}$')], ','), ''), ',' ORDER BY row_idx) AS ids, count(*) AS n_rows
FROM (SELECT g.doc_id, g.sheet, row_idx, (row_idx - data_idx) // 20 AS batch, context, headers, [regexp_replace(replace(coalesce(c, ''), chr(10), ' '), '\\.0$', '') FOR c IN cells] AS clean
  FROM {{grids}} g JOIN ({_heads2}) h ON h.doc_id = g.doc_id AND h.sheet = g.sheet WHERE row_idx >= data_idx) r
GROUP BY r.doc_id, r.sheet, batch""")
def _(t):
    return G.sheet_chunks(t.grids).select(
        "doc_id", "sheet", "batch", "content", F.array_join("student_ids_in_chunk", ",").alias("ids"),
        col("table_row_count").alias("n_rows"))


# --- page tables ------------------------------------------------------------
_CLEANED = f"""SELECT * FROM (SELECT doc_id, page, table_no, row_idx, [{S.strip(S.rep(S.fix_ocr('c'), '[ ' + chr(92) + 't]+', ' '))} FOR c IN cells] AS c1 FROM {{table_rows}})
"""
_cells = "[CASE WHEN " + S.fold("c") + " = '' THEN '' ELSE c END FOR c IN c1]"
_CLEAN = f"SELECT doc_id, page, table_no, row_idx, {_cells} AS cells FROM ({_CLEANED}) WHERE len([c FOR c IN {_cells} IF c <> '']) > 0"
_HEAD = f"""
SELECT doc_id, page, table_no, first_idx, own, last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page, table_no) AS header
FROM (SELECT doc_id, page, table_no, min(row_idx) AS first_idx, arg_min(cells, row_idx) AS f,
  CASE WHEN {_student_sql('arg_min(cells, row_idx)')} OR regexp_matches(lower(array_to_string(arg_min(cells, row_idx), ' ')), 'stt|mã|nội dung|khóa|học kỳ') THEN arg_min(cells, row_idx) END AS own
  FROM ({_CLEAN}) GROUP BY doc_id, page, table_no HAVING count(*) >= 2)"""


@query("table_row_cleaning", "doc_id bigint, page bigint, table_no bigint, row_idx bigint, cells string",
       f"SELECT doc_id, page, table_no, row_idx, array_to_string(cells, '|') AS cells FROM ({_CLEAN})")
def _(t):
    return P.clean_rows(t.table_rows).select(*P.TABLE, "row_idx", F.array_join("cells", "|").alias("cells"))


@query("table_header_carry", "doc_id bigint, page bigint, table_no bigint, header string, own boolean",
       f"SELECT doc_id, page, table_no, array_to_string(header, '|') AS header, own IS NOT NULL AS own FROM ({_HEAD}) WHERE header IS NOT NULL")
def _(t):
    heads = P.table_headers(P.clean_rows(t.table_rows), pages_per_block=24)
    return heads.select(*P.TABLE, F.array_join("header", "|").alias("header"), (col("header_idx") >= 0).alias("own"))


_fit = "[coalesce(cells[j], '') FOR j IN range(1, len(header) + 1)]"


@query("table_chunks", "doc_id bigint, page bigint, table_no bigint, batch bigint, part bigint, content string, content_type string, n_rows bigint, ids string", f"""
SELECT doc_id, page, table_no, (n - 1) // 20 AS batch, 0 AS part,
  '| ' || any_value(array_to_string(header, ' | ')) || ' |' || chr(10) || '|' || any_value(array_to_string(['---' FOR h IN header], '|')) || '|' || chr(10)
  || string_agg('| ' || array_to_string({_fit}, ' | ') || ' |', chr(10) ORDER BY n) AS content,
  CASE WHEN any_value({_student_sql('header')}) THEN 'student_list' ELSE 'table_md' END AS content_type, count(*) AS n_rows,
  CASE WHEN any_value({_student_sql('header')}) THEN array_to_string(list_distinct_keep(list(id ORDER BY n)), ',') END AS ids
FROM (SELECT c.doc_id, c.page, c.table_no, cells, header, [d FOR d IN [regexp_replace(x, '[^0-9]', '', 'g') FOR x IN cells] IF length(d) = 10][1] AS id,
    row_number() OVER (PARTITION BY c.doc_id, c.page, c.table_no ORDER BY row_idx) AS n
  FROM ({_CLEAN}) c JOIN ({_HEAD}) h ON h.doc_id = c.doc_id AND h.page = c.page AND h.table_no = c.table_no AND header IS NOT NULL
  WHERE own IS NULL OR row_idx > first_idx)
GROUP BY doc_id, page, table_no, (n - 1) // 20""".replace(
    "list_distinct_keep(list(id ORDER BY n))",
    "[x FOR x, i IN [z FOR z IN list(id ORDER BY n) IF z IS NOT NULL] IF list_position([z FOR z IN list(id ORDER BY n) IF z IS NOT NULL], x) = i]"))
def _(t):
    return P.table_chunks(t.table_rows).select(
        *P.TABLE, "batch", "part", "content", "content_type", col("table_row_count").alias("n_rows"),
        F.array_join("student_ids_in_chunk", ",").alias("ids"))


_SCAN_MD = r"""
SELECT doc_id, page, table_no,
  (SELECT string_agg(line, chr(10) ORDER BY i) FROM (SELECT i, '| ' || array_to_string(cells, ' | ') || ' |' || CASE WHEN i = 1 THEN chr(10) || '|---|---|---|' ELSE '' END AS line
    FROM (SELECT i, [trim(regexp_replace(replace(replace(replace(c, '&amp;', '&'), '<b>', ''), '</b>', ''), 'Tong cong', 'Tổng cộng', 'g')) FOR c IN regexp_extract_all(r, '<td>(.*?)</td>', 1)] AS cells
      FROM (SELECT unnest(rows) AS r, unnest(range(1, len(rows) + 1)) AS i)) WHERE array_to_string(cells, '') <> '')) AS md
FROM (SELECT doc_id, page, table_no, regexp_extract_all(html, '<tr>(.*?)</tr>', 1) AS rows FROM {scan_tables})"""


@query("html_tables_to_markdown", "doc_id bigint, page bigint, table_no bigint, md string", _SCAN_MD)
def _(t):
    return t.scan_tables.select(*P.TABLE, P.html_table_markdown(col("html")).alias("md"))


# Each scanned table has three data lines after the two of its head; a line opens a part if
# the open one would pass 1200 characters with it.
_SCAN_LINES = f"SELECT doc_id, page, table_no, l, l[1] || chr(10) || l[2] AS head FROM (SELECT *, string_split(md, chr(10)) AS l FROM ({_SCAN_MD}))"
_SCAN_OPENS = f"""SELECT *, length(head) + length(l[3]) + length(l[4]) + 2 > 1200 AS b4,
  CASE WHEN length(head) + length(l[3]) + length(l[4]) + 2 > 1200 THEN length(head) + length(l[4]) + length(l[5]) + 2
    ELSE length(head) + length(l[3]) + length(l[4]) + length(l[5]) + 3 END > 1200 AS b5 FROM ({_SCAN_LINES})"""
SCAN_CHUNKS = f"""
SELECT doc_id, page, table_no, part, any_value(head) || chr(10) || string_agg(line, chr(10) ORDER BY i) AS content,
  CASE WHEN any_value({_student_sql('[l[1]]')}) THEN 'student_list' ELSE 'table_md_scan' END AS content_type, count(*) AS n_rows,
  CASE WHEN any_value({_student_sql('[l[1]]')}) THEN coalesce(string_agg([d FOR d IN [regexp_replace(c, '[^0-9]', '', 'g') FOR c IN string_split(line, '|')] IF length(d) = 10][1], ',' ORDER BY i), '') END AS ids
FROM (SELECT *, l[i] AS line, CASE WHEN i >= 4 AND b4 THEN 1 ELSE 0 END + CASE WHEN i >= 5 AND b5 THEN 1 ELSE 0 END AS part
  FROM ({_SCAN_OPENS}), unnest([3, 4, 5]) AS r(i))
GROUP BY doc_id, page, table_no, part"""


@query("scan_table_chunks", "doc_id bigint, page bigint, table_no bigint, part bigint, content string, content_type string, n_rows bigint, ids string, size bigint",
       f"SELECT *, length(content) AS size FROM ({SCAN_CHUNKS})")
def _(t):
    return P.scan_table_chunks(t.scan_tables).select(
        *P.TABLE, "part", "content", "content_type", col("table_row_count").alias("n_rows"),
        F.array_join("student_ids_in_chunk", ",").alias("ids"), F.length("content").alias("size"))


# --- recognised boxes -------------------------------------------------------
@query("ocr_reading_lines", "doc_id bigint, page bigint, anchor bigint, line string", f"""
SELECT b.doc_id, b.page, anchor, string_agg(text, ' ' ORDER BY y, x, text) AS line
FROM (SELECT w.*, (SELECT max(a.anchor) FROM {{anchors}} a WHERE a.doc_id = w.doc_id AND a.page = w.page AND a.anchor <= w.y) AS anchor
  FROM (SELECT doc_id, page, x, y, {S.strip('text')} AS text FROM {{ocr_boxes}}) w WHERE text <> '') b
GROUP BY b.doc_id, b.page, anchor""")
def _(t):
    return O.reading_lines(t.ocr_boxes)


@query("ocr_table_regions", "doc_id bigint, page bigint, x bigint, y bigint, w bigint, h bigint",
       "SELECT doc_id, page, x, y, w, h FROM {ocr_boxes} WHERE w > 200 AND h > 100")
def _(t):
    return O.table_regions(t.ocr_boxes)
