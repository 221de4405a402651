"""Rule-based answers over contexts, hits and generated answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill import vocab as V
from corpusmill.operators import extraction as A
from corpusmill.operators.numbering import dense_index
from corpusmill.plans import sqltext as S
from corpusmill.plans.registry import query
from corpusmill.plans.search_queries import _HI, _any
from corpusmill.plans.tables import CTES

col = F.col

# One question, context and generated answer per notice.
CTES["cases"] = """
SELECT o_orderkey AS query_id, kind, content_type, chunk_uid, 1 AS rank, source, title, doc_id,
  CASE kind WHEN 1 THEN 'Thu học phí kỳ ' || sem || ', nội dung' WHEN 2 THEN CASE WHEN sem = '1' THEN 'Doi tuong mien giam hoc phi la ai?' ELSE 'nội dung quyết định miễn giảm' END
    WHEN 3 THEN 'Lịch nghỉ tet nguyen dan' WHEN 4 THEN 'học phí' ELSE 'Điểm của ' || given || ' và Trần' END AS query,
  '[Văn bản: ' || title || ' | Số: ' || doc_number || ' | Ngày: ' || coalesce(date, 'Không rõ') || ']' || chr(10) || content AS context,
  CASE WHEN kind = 5 THEN 'Sinh viên ' || msv || ' đạt ' || points || ' điểm rèn luyện' || chr(10) || 'Sinh viên 99' || substr(msv, 3) || ' khác'
    WHEN kind = 4 THEN 'Mã 1234567890'
    WHEN kind = 3 THEN 'Hiện chưa tìm thấy thông tin phù hợp. Vui lòng liên hệ phòng' || CASE WHEN sem = '1' THEN '. Ngày ban hành 1' ELSE '' END
    WHEN kind = 2 THEN 'Xin lỗi, không tìm thấy thông tin'
    ELSE 'Bảng:' || chr(10) || '| STT | A | B |' || chr(10) || '|---|---|---|' || chr(10) || '| 1 | ... | ' || CASE WHEN sem = '1' THEN money3 ELSE '-' END || ' |' || chr(10) || '| 2 | … |  |'
      || chr(10) || '| 3 | x | y |' || chr(10) || chr(10) || chr(10) || chr(10) || 'hết' END AS answer
FROM {notices}
"""

# Per case its notice and the three after it of the same document.
CTES["case_hits"] = """
SELECT c.query_id, c.query, 'general' AS intent, n.chunk_uid, n.content, n.content_type, n.title, n.source, 1 + ahead AS rank
FROM (SELECT query_id, query, doc_id, m, unnest(range(0, 4)) AS ahead FROM (SELECT query_id, query, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY query_id) AS m FROM {cases})) c
JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o_orderkey) AS m FROM {notices}) n ON n.doc_id = c.doc_id AND n.m = c.m + c.ahead
"""


def case_hits(t):
    placed = dense_index(t.notices, ["doc_id"], ["o_orderkey"], "m").withColumn("m", col("m").cast("bigint"))
    asked = t.cases.select("query_id", "query").join(placed.select(col("o_orderkey").alias("query_id"), "doc_id", "m"), "query_id")
    ahead = asked.select("query_id", "query", "doc_id", "m", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("ahead")).withColumn("m", col("m") + col("ahead"))
    found = placed.select("doc_id", "m", "chunk_uid", "content", "content_type", "title", "source")
    return ahead.join(found, ["doc_id", "m"]).select(
        "query_id", "query", F.lit("general").alias("intent"), "chunk_uid", "content", "content_type", "title", "source", (col("ahead") + 1).alias("rank"))


# The hits of two thirds of the questions come from scans of untitled documents, half of these with one text among them.
CTES["scan_hits"] = f"""
SELECT query_id, query, intent, chunk_uid, content, source, rank,
  CASE WHEN query_id % 3 = 1 OR rank % 5 = 4 THEN title ELSE 'Không xác định' END AS title,
  CASE WHEN query_id % 3 = 1 THEN content_type WHEN query_id % 3 = 2 AND rank = 2 THEN 'text' ELSE 'table_md_scan' END AS content_type
FROM ({_HI})
"""

_ID_ROWS = """SELECT query_id, rank, pos, id, name FROM (
  SELECT h.query_id, h.query, h.rank, 0 AS pos, n.msv AS id, n.person AS name FROM {hits} h JOIN {notices} n ON n.chunk_uid = h.chunk_uid WHERE n.kind = 5
  UNION ALL SELECT h.query_id, h.query, h.rank, 1, n.msv2, 'Trần Thị ' || n.given FROM {hits} h JOIN {notices} n ON n.chunk_uid = h.chunk_uid WHERE n.kind = 5)"""


_RECORDS = """
SELECT query_id, msv, ho_ten, diem, 'Tốt' AS xep_loai, hoc_ky, row_number() OVER (PARTITION BY query_id ORDER BY CAST(substr(yy, 3) AS INT) DESC, sem DESC, rank) AS ord FROM (
  SELECT h.query_id, n.msv, n.person AS ho_ten, n.points AS diem, 'HK' || n.sem || ' (' || n.yy || '-' || n.yy2 || ')' AS hoc_ky, n.yy, n.sem, h.rank,
    row_number() OVER (PARTITION BY h.query_id, n.sem, n.yy, n.points ORDER BY h.rank) AS rn
  FROM {hits} h JOIN {notices} n ON n.chunk_uid = h.chunk_uid WHERE n.kind = 5 AND n.doc_id = h.query_id) WHERE rn = 1"""


@query("student_records", "query_id bigint, msv string, ho_ten string, diem string, xep_loai string, hoc_ky string, ord bigint", _RECORDS)
def _(t):
    targets = t.questions.select("query_id", F.concat(F.lit("22"), F.lpad(col("query_id").cast("string"), 8, "0")).alias("target_id"))
    return A.student_records(t.hits, targets)


@query("student_record_answers", "query_id bigint, msv string, answer string", f"""
SELECT query_id, msv, '**Điểm rèn luyện** của **' || arg_min(ho_ten, ord) || '** (MSV: `' || msv || '`):' || chr(10) || chr(10)
  || string_agg('- **' || hoc_ky || '**: **' || diem || ' điểm** — Xếp loại: ' || xep_loai, chr(10) ORDER BY ord) AS answer
FROM ({_RECORDS}) GROUP BY query_id, msv""")
def _(t):
    targets = t.questions.select("query_id", F.concat(F.lit("22"), F.lpad(col("query_id").cast("string"), 8, "0")).alias("target_id"))
    return A.record_answers(A.student_records(t.hits, targets))


_WORDS = f"regexp_extract_all(regexp_replace(query, ' ', '  ', 'g'), '(?:^|{S.NOT_WORD})([{V.UPPER_CLASS}][{V.LOWER_CLASS}]+)(?:$|{S.NOT_WORD})', 1)"
_AMB = f"""SELECT query_id, ws[1] AS name, count(*) AS n FROM (
  SELECT DISTINCT r.query_id, id, name, {_WORDS} AS ws FROM ({_ID_ROWS}) r JOIN {{questions}} q ON q.query_id = r.query_id
  WHERE NOT regexp_matches(query, '(^|[^0-9])[0-9]{{10}}($|[^0-9])')) WHERE len([w FOR w IN ws IF contains(lower(name), lower(w))]) > 0 GROUP BY query_id, ws HAVING count(*) > 1"""


@query("names_ambiguous", "query_id bigint, name string, n bigint", _AMB)
def _(t):
    return A.ambiguous_names(t.hits)


@query("names_clarify", "query_id bigint, answer string", f"""
SELECT a.query_id, coalesce('Mình tìm thấy **' || CAST(m AS VARCHAR) || ' sinh viên** có tên chứa "' || a.name || '", bạn muốn hỏi về ai?' || chr(10) || chr(10) || l || chr(10) || chr(10) || 'Bạn hãy nhập **mã sinh viên** để mình tìm chính xác nhé!',
  'Mình không tìm thấy sinh viên nào tên **' || a.name || '** trong dữ liệu.') AS answer
FROM ({_AMB}) a LEFT JOIN (SELECT query_id, count(*) AS m, string_agg('- **' || name || '** — MSV: `' || id || '`', chr(10) ORDER BY rank, pos) AS l FROM (
  SELECT r.*, row_number() OVER (PARTITION BY r.query_id, id, r.name ORDER BY rank, pos) AS rn FROM ({_ID_ROWS}) r JOIN ({_AMB}) x ON x.query_id = r.query_id AND contains(lower(r.name), lower(x.name)))
  WHERE rn = 1 GROUP BY query_id) b ON b.query_id = a.query_id""")
def _(t):
    return A.clarifications(t.hits, A.ambiguous_names(t.hits))


@query("context_header_fields", "query_id bigint, title string, so string, ngay string", """
SELECT query_id, title, so, ngay FROM (SELECT o_orderkey AS query_id, title, doc_number AS so, coalesce(date, 'Không rõ') AS ngay FROM {notices})""")
def _(t):
    head = F.regexp_extract("context", r"\[(.*?)\]", 1)
    return t.cases.select("query_id", A.header_fields(head).alias("h")).select("query_id", "h.*")


_QF, _CF = S.fold_query("query"), S.fold_query("context")


@query("answer_exemption", "query_id bigint, answer string", f"""
SELECT query_id, CASE WHEN contains(q, 'doi tuong') AND (contains(q, 'mien') OR contains(q, 'giam hoc phi')) AND regexp_matches(q, 'la ai|la gi|doi tuong nao') AND (i1 OR i2) THEN
  '{V.EXEMPT_TITLE}' || chr(10) || chr(10) || CASE WHEN i1 THEN '- {V.EXEMPT_TEXT_1.format(school="Trường")}' || chr(10) ELSE '' END
  || CASE WHEN i2 THEN '- {V.EXEMPT_TEXT_2}' || chr(10) ELSE '' END || chr(10) || '{V.EXEMPT_TAIL}' END AS answer
FROM (SELECT query_id, {_QF} AS q, regexp_matches({_CF}, 'mien giam hoc phi.{{0,400}}phu luc 1') AS i1,
  regexp_matches({_CF}, '81 2021.{{0,300}}phu luc 2|phu luc 2.{{0,300}}81 2021') AS i2 FROM {{cases}})""")
def _(t):
    return t.cases.select("query_id", A.exemption_answer(col("query"), col("context")).alias("answer"))


@query("answer_fee_notice", "query_id bigint, answer string", """
SELECT query_id, answer FROM (SELECT o_orderkey AS query_id, CASE WHEN kind = 1 THEN
 '**' || title || '**' || chr(10) || chr(10) || '**Số:** ' || doc_number || ' | **Ngày:** ' || coalesce(date, 'Không rõ') || chr(10) || chr(10)
 || '**Mức học phí (đồng/tín chỉ):**' || chr(10) || '- Khóa 11: **' || '6.' || money3 || '.000**' || chr(10) || '- Khóa 12: **120.000**' || chr(10) || '- Khóa 13: **130.000**' || chr(10) || chr(10)
 || '**Các khoản lệ phí:**' || chr(10) || '- Học phí kỳ ' || sem || ': **6.' || money3 || '.000đ**' || chr(10) || '- Tiền nước uống: **120.000đ**' || chr(10) || '- Tổng cộng: **130.000đ**' || chr(10) || chr(10)
 || '**Cổng thanh toán:** https://pay.example.org/k' || sem || chr(10) || '**Phương thức nộp:**' || chr(10)
 || '- Nộp tiền mặt tại Phòng Kế hoạch - Tài chính (Tầng 1, tòa nhà 31 Dịch Vọng Hậu).' || chr(10) || '- Nộp qua QR-Code động trên cổng sinh viên.' END AS answer FROM {notices})""")
def _(t):
    return A.fee_answers(t.cases).select("query_id", col("fee_answer").alias("answer"))


@query("answer_directives", "query_id bigint, answer string", """
SELECT query_id, CASE WHEN kind = 3 THEN '**Thông báo nghỉ Tết Nguyên đán 2026**' || chr(10) || chr(10) || '**Số:** ' || doc_number || ' | **Ngày ban hành:** ' || coalesce(date, 'Không rõ') || chr(10) || chr(10)
  || '**Điều 1:** Bàn giao phòng làm việc trước ngày ' || dd || '-' || mm || '-' || yy || ' cho bộ phận trực của trường' || chr(10) || chr(10)
  || '**Điều 2:** Kiểm tra an toàn điện nước và niêm phong toàn bộ khu giảng đường số ' || dd END AS answer
FROM (SELECT *, o_orderkey AS query_id FROM {notices})""")
def _(t):
    return t.cases.select("query_id", A.directive_answer(col("query"), col("context")).alias("answer"))


# --- sections, tables, outline ----------------------------------------------
_ITEMS = """'Từ ngày ' || dd || '/' || mm || '/' || yy || ' đến hết kỳ ' || sem || '{sep}Nghị định 81/2021 áp dụng phụ lục 2 mức ' || money3 || '.000'"""
_DECREE = "'Sinh viên thuộc hộ nghèo, năm học ' || yy || '-' || yy2 || '{sep}Hồ sơ gồm giấy khai sinh và đơn số ' || dd"


@query("context_sections", "query_id bigint, idx bigint, title string, items string", f"""
SELECT o_orderkey AS query_id, 0 AS idx, 'Điều 1. Đối tượng miễn giảm học phí theo phụ lục 1' AS title, {_DECREE.format(sep="|")} AS items FROM {{notices}} WHERE kind = 2
UNION ALL SELECT o_orderkey, 1, 'Thời gian nộp hồ sơ', {_ITEMS.format(sep="|")} FROM {{notices}} WHERE kind = 2""")
def _(t):
    return A.generic_sections(t.cases).select("query_id", "idx", "title", F.array_join("items", "|").alias("items"))


@query("context_four_sections", "query_id bigint, section string, items string",
       f"SELECT o_orderkey AS query_id, 'Thời gian nộp hồ sơ' AS section, {_ITEMS.format(sep='|')} AS items FROM {{notices}} WHERE kind = 2")
def _(t):
    return A.four_sections(t.cases).select("query_id", "section", F.array_join("items", "|").alias("items"))


@query("context_money_tables", "query_id bigint, idx bigint, headers string, rows string", """
SELECT o_orderkey AS query_id, 0 AS idx, 'STT|Nội dung thu|Số tiền' AS headers, '1|Học phí kỳ ' || sem || '|6.' || money3 || '.000 đ' || chr(10) || '2|Tiền nước uống|120.000 đ' || chr(10) || '2|tiền nước uống|130.000 đ' AS rows
FROM {notices} WHERE kind = 1""")
def _(t):
    rows = F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "\n")
    return A.money_tables(t.cases).select("query_id", "idx", F.array_join("headers", "|").alias("headers"), rows.alias("rows"))


@query("context_compact_table", "query_id bigint, md string", """
SELECT o_orderkey AS query_id, '| A | Cột 2 | Cột 3 |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| ' || sem || ' | ' || yy || ' | ' || mm || ' |' || chr(10) || '| x |  |  |' AS md FROM {notices}""")
def _(t):
    rows = F.array(F.array("sem", "yy", "mm"), F.array(F.lit("x")))
    return t.notices.select(col("o_orderkey").alias("query_id"), F.array_join(A.compact_table(F.array(F.lit("A")), rows), "\n").alias("md"))


_HEAD = "'**Văn bản: ' || title || ' | Số: ' || doc_number || ' | Ngày: ' || coalesce(date, 'Không rõ') || '**' || chr(10) || chr(10) || '**Nội dung chính theo yêu cầu:** ' || query || chr(10) || chr(10) || "
_OUTLINES = f"""
SELECT query_id, CASE kind WHEN 1 THEN {_HEAD} '**Bảng dữ liệu liên quan:**' || chr(10) || chr(10) || '| STT | Nội dung thu | Số tiền |' || chr(10) || '| --- | --- | --- |' || chr(10)
    || '| 1 | Học phí kỳ ' || sem || ' | 6.' || money3 || '.000 đ |' || chr(10) || '| 2 | Tiền nước uống | 120.000 đ |' || chr(10) || '| 2 | tiền nước uống | 130.000 đ |'
  ELSE {_HEAD} '**Điều 1. Đối tượng miễn giảm học phí theo phụ lục 1:**' || chr(10) || '- ' || {_DECREE} || chr(10) || chr(10) || '**Thời gian nộp hồ sơ:**' || chr(10) || '- ' || {_ITEMS} END AS outline
FROM (SELECT c.query_id, c.query, n.* FROM {{cases}} c JOIN {{notices}} n ON n.o_orderkey = c.query_id) WHERE kind <= 2""".replace("{sep}", "' || chr(10) || '- ")


@query("context_outlines", "query_id bigint, outline string", _OUTLINES)
def _(t):
    return A.outlines(t.cases)


@query("answer_enrich", "query_id bigint, answer string")
def _(t):
    return A.enrich_answers(t.cases).select("query_id", "answer")


# --- post-checks ------------------------------------------------------------
@query("answer_suppress_placeholders", "query_id bigint, answer string", f"""
SELECT query_id, CASE WHEN kind = 1 THEN CASE WHEN contains(answer, '| 1 | ... | - |') THEN 'Bảng:' || chr(10) || '{V.PLACEHOLDER_NOTE}' || chr(10) || chr(10) || 'hết'
  ELSE regexp_replace(answer, '\\n{{3,}}', chr(10) || chr(10), 'g') END ELSE answer END AS answer
FROM (SELECT *, 1 FROM {{cases}})""".replace("CASE WHEN contains(answer, '| 1 | ... | - |')", "CASE WHEN 2 >= greatest(1, floor(3 * 0.6)) AND contains(answer, '| 1 | ... | - |') OR contains(answer, '| 2 | … |') AND 1 >= greatest(1, floor(3 * 0.6))"))
def _(t):
    return A.suppress_placeholder_tables(t.cases.withColumnRenamed("query_id", "id")).select(col("id").alias("query_id"), "answer")


_AF = S.fold_query("answer")


@query("answer_no_data_detector", "query_id bigint, no_data boolean", f"""
SELECT query_id, regexp_matches(left(f, 220), '{'|'.join(V.NO_DATA_OPENERS)}') AND NOT regexp_matches(f, '{'|'.join(V.SUBSTANTIVE_MARKERS)}')
  AND ({' + '.join(f"CASE WHEN contains(f, '{c}') THEN 1 ELSE 0 END" for c in V.NO_DATA_CHECKS)}) >= 2 AS no_data
FROM (SELECT query_id, {_AF} AS f FROM {{cases}})""")
def _(t):
    return t.cases.select("query_id", A.is_no_data(col("answer")).alias("no_data"))


_CONTACT = "CASE intent " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.CONTACT_BY_INTENT.items()) + f" ELSE '{V.CONTACT_DEFAULT}' END"


@query("answer_no_data", "query_id bigint, answer string", f"""
SELECT query_id, {' || chr(10) || '.join("'" + line + "'" for line in V.NO_DATA_LINES).replace('{query}', "' || " + S.normalize_query('query') + " || '").replace('{contact}', "' || " + _CONTACT + " || '")} AS answer
FROM (SELECT *, CASE WHEN user_id < 8 THEN 'exam' WHEN user_id < 16 THEN 'document_info' ELSE 'general' END AS intent FROM {{questions}})""")
def _(t):
    intent = F.when(col("user_id") < 8, "exam").when(col("user_id") < 16, "document_info").otherwise("general")
    return t.questions.select("query_id", A.no_data_answer(col("query"), intent).alias("answer"))


@query("answer_grounding", "query_id bigint, answer string", f"""
SELECT query_id, CASE WHEN kind = 5 THEN string_split(answer, chr(10))[1] WHEN kind = 4 THEN answer || '{V.UNVERIFIED_NOTE}' ELSE answer END AS answer FROM {{cases}}""")
def _(t):
    return t.cases.select("query_id", A.grounded(col("answer"), col("context")).alias("answer"))


def _noisy_sql(hits: str) -> str:
    return f"""SELECT query_id FROM (SELECT query_id, any_value(query) AS query, count(*) AS n, count(*) FILTER (WHERE content_type IN ('table_html_scan', 'table_md_scan', 'table_md')) AS a,
  count(*) FILTER (WHERE content_type = 'text') AS b, count(*) FILTER (WHERE lower(title) IN ('', 'không xác định')) AS u FROM {hits} GROUP BY query_id)
WHERE {_any('lower(query)', V.SAFE_QUERY_TERMS)} AND a >= greatest(3, floor(n * 0.7)) AND b = 0 AND u >= greatest(2, floor(n * 0.6))"""


@query("answer_noisy_contexts", "query_id bigint", _noisy_sql("{scan_hits}"))
def _(t):
    return A.noisy_queries(t.scan_hits)


_PLAIN = S.strip(S.rep(S.rep("content", "<[^>]+>", " "), f"[{S.WS}]+", " "))
_DAY = f"(?:^|{S.NOT_WORD})([0-9]{{1,2}}[/-][0-9]{{1,2}}[/-][0-9]{{4}})(?:$|{S.NOT_WORD})"
_SPAN = f"(?:^|{S.NOT_WORD})(20[0-9]{{2}}\\s*[-/]\\s*20[0-9]{{2}})(?:$|{S.NOT_WORD})"
_FACT = ", ".join(f"CASE WHEN {_any('f', marks)} THEN '- {fact}' END" for marks, fact in V.SAFE_FACTS)


@query("answer_safe_facts", "query_id bigint, answer string", f"""
SELECT query_id, '**Tài liệu liên quan:** ' || src || chr(10) || chr(10) || '{V.SAFE_LEAD}' || chr(10)
  || coalesce(nullif(concat_ws(chr(10), '- Nội dung có nhắc tới năm học **' || nullif(y, '') || '**.', {_FACT},
    '- Mốc thời gian OCR đọc được: ' || nullif(array_to_string(days, ', '), '') || '.'), ''), '- {V.SAFE_NOTHING}')
  || chr(10) || chr(10) || '{V.SAFE_TAIL}' AS answer
FROM (SELECT query_id, src, {S.fold_query('src || chr(32) || text')} AS f, replace(regexp_replace(regexp_extract(src || ' ' || text, '{_SPAN}', 1), '\\s+', '', 'g'), '/', '-') AS y,
    ['`' || d || '`' FOR d IN list_filter(ds, lambda x, i: list_position(ds, x) = i)[1:2]] AS days
  FROM (SELECT *, regexp_extract_all(text, '{_DAY}', 1) AS ds FROM (
    SELECT query_id, arg_min(regexp_replace(regexp_replace(source, '^\\d{{14}}_', ''), '_(\\d{{4}})\\.pdf$', '.pdf'), rank) AS src,
      coalesce(string_agg(p, ' ' ORDER BY rank) FILTER (WHERE length(p) >= 30), '') AS text
    FROM (SELECT *, {_PLAIN} AS p FROM {{scan_hits}} WHERE query_id IN ({_noisy_sql('{scan_hits}')})) GROUP BY query_id)))""")
def _(t):
    return A.safe_answers(t.scan_hits)


@query("answer_precedence", "query_id bigint, answer_kind string", f"""
SELECT query_id, CASE WHEN kind = 5 THEN 'records' WHEN query_id IN ({_noisy_sql('{case_hits}')}) THEN 'safe'
  WHEN kind = 2 AND query LIKE 'Doi tuong%' THEN 'exemption' WHEN kind = 1 THEN 'fee' WHEN kind = 3 THEN 'directives' ELSE 'generated' END AS answer_kind FROM {{cases}}""")
def _(t):
    targets = t.cases.where("kind = 5").select("query_id", F.concat(F.lit("22"), F.lpad(col("doc_id").cast("string"), 8, "0")).alias("target_id"))
    records = A.record_answers(A.student_records(case_hits(t), targets)).select("query_id", col("answer").alias("records"))
    safe = A.safe_answers(case_hits(t)).select("query_id", col("answer").alias("safe"))
    rows = A.fee_answers(t.cases).join(records, "query_id", "left").join(safe, "query_id", "left")
    best = A.choose_answer({
        "records": col("records"), "safe": col("safe"),
        "exemption": A.exemption_answer(col("query"), col("context")), "fee": col("fee_answer"),
        "directives": A.directive_answer(col("query"), col("context")), "generated": col("answer")})
    return rows.select("query_id", best.alias("b")).select("query_id", "b.answer_kind")
