"""Input tables of the queries: the given ones and those derived from them.

A derived table is written once, in SQL that Spark and an ANSI engine both
read, so that its rows grow with the given tables and an oracle sees the same
input. ``{name}`` stands for another table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.numbering import dense_index

CTES: dict[str, str] = {}

# Pages of 20 lines.
CTES["page_texts"] = """
SELECT doc_id, lang, source, CAST(page AS BIGINT) AS page, raw_text FROM (
  SELECT doc_id, lang, source, floor((pos - 1) / 20) + 1 AS page,
         string_agg(line, chr(10) ORDER BY pos) AS raw_text
  FROM (SELECT doc_id, lang, source, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS pos
        FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS l FROM {documents}))
  GROUP BY doc_id, lang, source, floor((pos - 1) / 20))
"""

# One notice chunk per order. A document is a customer; school year and
# semester follow from the order.
CTES["notices"] = """
SELECT o.*,
  CASE o.kind
    WHEN 1 THEN o.title || chr(10) || 'Chương trình đại học: 540.000 | 560.' || o.money3 || ' | 6.' || o.money3 || '.000' || chr(10)
      || '| STT | Nội dung thu | Số tiền |' || chr(10) || '|---|---|---|' || chr(10)
      || '| 1 | Học phí kỳ ' || o.sem || ' | 6.' || o.money3 || '.000 đ |' || chr(10)
      || '| 2 | Tiền nước uống | 120.000 đ |' || chr(10)
      || '| 2 | tiền nước uống | 130.000 đ |' || chr(10)
      || 'Tổng cộng 6 ' || o.money3 || ' 000 d. Nộp tiền mặt hoặc QR code tại https://pay.example.org/k' || o.sem || ').'
    WHEN 2 THEN 'QUYẾT ĐỊNH Số: ' || CAST(o.o_orderkey AS STRING) || '/QĐ ngày ' || o.dd || ' tháng ' || o.mm || ' năm ' || o.yy || chr(10)
      || 'Điều 1. Đối tượng miễn giảm học phí theo phụ lục 1:' || chr(10)
      || '- Sinh viên thuộc hộ nghèo, năm học ' || o.yy || '-' || o.yy2 || chr(10)
      || '- Hồ sơ gồm giấy khai sinh và đơn số ' || o.dd || chr(10)
      || 'Thời gian nộp hồ sơ:' || chr(10) || 'Từ ngày ' || o.dd || '/' || o.mm || '/' || o.yy || ' đến hết kỳ ' || o.sem || chr(10)
      || 'Nghị định 81/2021 áp dụng phụ lục 2 mức ' || o.money3 || '.000'
    WHEN 3 THEN 'Thông báo nghỉ Tết nguyên đán ' || o.yy || '. Các công việc sau đây:' || chr(10)
      || '1. Bàn giao phòng làm việc trước ngày ' || o.dd || '-' || o.mm || '-' || o.yy || ' cho bộ phận trực của trường' || chr(10)
      || '2. Kiểm tra an toàn điện nước và niêm phong toàn bộ khu giảng đường số ' || o.dd || chr(10)
      || '3. ngắn' || chr(10) || '- Nơi nhận: các khoa'
    WHEN 4 THEN '<td></td><td></td><td>' || CAST(o.o_orderkey AS STRING) || '</td> hk' || o.sem || ' năm ' || o.yy
    ELSE 'Đợt: HK' || o.sem || ' (' || o.yy || '-' || o.yy2 || ')' || chr(10)
      || '| STT | MSV | Họ tên | Giới tính | Ngày sinh | Điểm | Xếp loại |' || chr(10) || '|---|---|---|---|---|---|---|' || chr(10)
      || '| 1 | ' || o.msv || ' | ' || o.person || ' | Nam | 01/02/2004 | ' || o.points || ' | Tốt |' || chr(10)
      || '| 2 | ' || o.msv2 || ' | Trần Thị ' || o.given || ' | Nữ | 03/04/2004 | 7' || o.sem || ' | Khá |'
  END AS content
FROM (
  SELECT b.*,
    CASE b.kind
      WHEN 1 THEN 'Thông báo thu học phí kỳ ' || b.sem || ' năm học ' || b.yy || '-' || b.yy2
      WHEN 2 THEN 'Quyết định miễn giảm học phí năm ' || b.yy
      WHEN 3 THEN 'Thông báo nghỉ Tết nguyên đán ' || b.yy
      WHEN 4 THEN 'Không xác định'
      ELSE 'Danh sách điểm rèn luyện HK' || b.sem || ' ' || b.yy || '-' || b.yy2 END AS title,
    CASE b.kind WHEN 1 THEN 'table_md' WHEN 2 THEN 'text' WHEN 3 THEN 'text'
      WHEN 4 THEN 'table_md_scan' ELSE 'student_list' END AS content_type,
    CASE WHEN b.kind IN (2, 3) THEN 'text' ELSE 'table' END AS chunk_type
  FROM (
    SELECT o_orderkey, o_custkey AS doc_id, o_orderdate, o_orderstatus, o_totalprice,
      'u' || lpad(CAST(o_orderkey AS STRING), 12, '0') AS chunk_uid,
      'chunk_' || CAST(o_orderkey AS STRING) AS chunk_id,
      CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 1 WHEN '2' THEN 2 WHEN '3' THEN 3 WHEN '4' THEN 4 ELSE 5 END AS kind,
      CAST(1 + o_orderkey % 3 AS STRING) AS sem,
      CAST(2019 + year(o_orderdate) % 8 AS STRING) AS yy,
      CAST(2020 + year(o_orderdate) % 8 AS STRING) AS yy2,
      CAST(month(o_orderdate) AS STRING) AS mm,
      CAST(day(o_orderdate) AS STRING) AS dd,
      lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0') AS money3,
      '22' || lpad(CAST(o_custkey AS STRING), 8, '0') AS msv,
      '23' || lpad(CAST(o_orderkey AS STRING), 8, '0') AS msv2,
      CAST(50 + o_orderkey % 50 AS STRING) AS points,
      CASE o_custkey % 4 WHEN 0 THEN 'An' WHEN 1 THEN 'Nam' WHEN 2 THEN 'Minh' ELSE 'Linh' END AS given,
      'Nguyễn Văn ' || CASE o_custkey % 4 WHEN 0 THEN 'An' WHEN 1 THEN 'Nam' WHEN 2 THEN 'Minh' ELSE 'Linh' END AS person,
      CASE WHEN o_orderstatus = 'F' THEN 'Không xác định' ELSE CAST(o_orderkey AS STRING) || '/TB' END AS doc_number,
      CASE WHEN o_orderstatus = 'F' THEN NULL ELSE CAST(2019 + year(o_orderdate) % 8 AS STRING) || '-'
        || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '-' || lpad(CAST(day(o_orderdate) AS STRING), 2, '0') END AS date,
      CASE WHEN o_orderstatus = 'O' THEN 'Phòng Đào tạo' ELSE 'Không xác định' END AS issuer,
      '20240101000000_notice_' || CAST(o_custkey AS STRING) || '_' || lpad(CAST(o_custkey % 10000 AS STRING), 4, '0') || '.pdf' AS source,
      CASE WHEN o_custkey % 5 = 0 THEN 'private' ELSE 'public' END AS access_scope,
      'user' || CAST(o_custkey % 7 AS STRING) AS target_id,
      o_orderstatus <> 'P' AS is_active
    FROM {orders}) b) o
"""

# One question per customer.
CTES["questions"] = """
SELECT c_custkey AS query_id, c_nationkey AS user_id, c_mktsegment AS segment,
  CASE
    WHEN c_mktsegment = 'AUTOMOBILE' THEN 'Thông báo thu học phí kỳ ' || sem || ' năm học ' || yy || '-' || yy2 || ' là bao nhiêu?'
    WHEN c_mktsegment = 'BUILDING' AND c_nationkey < 8 THEN 'Điểm rèn luyện của sinh viên ' || person
    WHEN c_mktsegment = 'BUILDING' AND c_nationkey < 16 THEN 'xếp loại của msv ' || msv || ' hk' || sem
    WHEN c_mktsegment = 'BUILDING' THEN 'điểm thi của trần thị bình là bao nhiêu'
    WHEN c_mktsegment = 'FURNITURE' AND c_nationkey < 12 THEN 'nội dung quyết định miễn giảm học phí năm ' || yy
    WHEN c_mktsegment = 'FURNITURE' THEN 'Doi tuong mien giam hoc phi la ai?'
    WHEN c_mktsegment = 'HOUSEHOLD' AND c_nationkey < 12 THEN 'lịch nghỉ tết nguyên đán ' || yy || ' khi nào?'
    WHEN c_mktsegment = 'HOUSEHOLD' THEN 'thủ tục  học bổng kỳ ii ' || yy || '/' || yy2
    WHEN c_nationkey < 6 THEN 'Xin chào bạn!'
    WHEN c_nationkey < 12 THEN 'còn của Nam thì sao'
    WHEN c_nationkey < 18 THEN 'cho tôi xin văn bản "quy chế" thi, chi tiết hơn về nó'
    ELSE ' ' || CAST(c_custkey AS STRING) || ' ' END AS query
FROM (
  SELECT c_custkey, c_nationkey, c_mktsegment,
    CAST(1 + c_nationkey % 3 AS STRING) AS sem,
    CAST(2019 + c_nationkey % 8 AS STRING) AS yy,
    CAST(2020 + c_nationkey % 8 AS STRING) AS yy2,
    '22' || lpad(CAST(c_custkey AS STRING), 8, '0') AS msv,
    'Nguyễn Văn ' || CASE c_custkey % 4 WHEN 0 THEN 'An' WHEN 1 THEN 'Nam' WHEN 2 THEN 'Minh' ELSE 'Linh' END AS person
  FROM {customer}) c
"""

# Up to 20 candidate chunks per question, from the documents of the asking
# customer and of the next one; some keyword hits carry no score.
CTES["hits"] = """
SELECT * FROM (
  SELECT h.*, CAST(row_number() OVER (PARTITION BY query_id ORDER BY coalesce(score, -1.0) DESC, chunk_uid) AS BIGINT) AS rank
  FROM (
    SELECT q.query_id, q.query, n.chunk_uid, n.doc_id, n.chunk_id, n.title, n.doc_number, n.date, n.issuer, n.source,
      n.content, n.content_type, n.chunk_type,
      CASE WHEN n.o_orderkey % 11 = 0 THEN NULL
           WHEN q.segment = 'MACHINERY' THEN CAST(CAST(floor(n.o_totalprice) AS BIGINT) % 500 AS DOUBLE) / 1000
           ELSE CAST(CAST(floor(n.o_totalprice) AS BIGINT) % 1000 AS DOUBLE) / 1000 END AS score
    FROM (SELECT query_id, query, segment, query_id AS doc_id FROM {questions}
          UNION ALL SELECT query_id, query, segment, query_id + 1 AS doc_id FROM {questions}) q
    JOIN {notices} n ON n.doc_id = q.doc_id) h) r
WHERE rank <= 20
"""

# Users, sessions, messages, feedback and audit rows.
CTES["users"] = """
SELECT c_custkey AS id, c_name AS full_name,
  lower(replace(c_name, '#', '.')) || '@' || lower(c_mktsegment) || '.example.org' AS email,
  c_acctbal >= 0 AS is_active, c_nationkey = 0 AS is_superuser,
  CASE WHEN c_nationkey IN (0, 1) THEN 'user' WHEN c_nationkey = 2 THEN 'admin' WHEN c_nationkey = 3 THEN 'lecturer'
       WHEN c_nationkey = 4 THEN NULL ELSE 'user' END AS role
FROM {customer}
"""
CTES["uploads"] = """
SELECT doc_id AS id, source AS filename, CAST(doc_id % 1000 AS BIGINT) AS uploaded_by,
  CASE WHEN doc_id % 5 = 0 THEN 'private' ELSE 'public' END AS access_scope,
  'user' || CAST(doc_id % 7 AS STRING) AS target_id, n_chars > 500 AS is_processed, n_chars
FROM {documents}
"""
CTES["messages"] = """
SELECT conv_id * 1000 + turn AS id, 's' || CAST(conv_id AS STRING) AS session_id, conv_id,
  conv_id % 50 AS user_id, turn, CASE role WHEN 'assistant' THEN 'ai' ELSE role END AS role, text AS content
FROM {conversations}
"""
CTES["sessions"] = """
SELECT session_id AS id, min(user_id) AS user_id, max(id) AS updated_at, count(*) AS n_messages,
  CASE WHEN min(conv_id) % 4 = 0 THEN NULL ELSE min(conv_id) % 4 = 1 END AS is_pinned
FROM {messages} GROUP BY session_id
"""
CTES["feedback"] = """
SELECT m.id AS chat_message_id, CASE WHEN l.quality = 1 THEN 5 ELSE 1 END AS score, m.content AS rejected_response,
  CASE WHEN l.toxic = 1 THEN NULL ELSE 'Fixed: ' || m.content END AS chosen_response,
  CASE WHEN l.quality = 1 THEN 'pending' WHEN l.toxic = 1 THEN 'pending' ELSE 'reviewed' END AS status
FROM {messages} m JOIN {labels} l ON l.doc_id = m.conv_id
WHERE m.role = 'ai'
"""


# A sheet per supplier and return flag: preamble, header, rows of line items.
CTES["grids"] = """
SELECT * FROM (
  SELECT DISTINCT l_suppkey AS doc_id, l_returnflag AS sheet, 0 AS row_idx, ['Trường', NULL, ' Danh sách ' || l_returnflag, '', NULL] AS cells FROM {lineitem}
  UNION ALL SELECT DISTINCT l_suppkey, l_returnflag, 1, [NULL, NULL, NULL, NULL, NULL] FROM {lineitem}
  UNION ALL SELECT DISTINCT l_suppkey, l_returnflag, 2, ['STT', 'Mã sinh viên', NULL, 'Điểm', 'Xếp' || chr(10) || 'loại'] FROM {lineitem}
  UNION ALL SELECT DISTINCT l_suppkey, l_returnflag, 3, [NULL, '', 'Họ' || chr(10) || 'tên', 'điểm số', NULL] FROM {lineitem} WHERE l_returnflag = 'R'
  UNION ALL SELECT l_suppkey, l_returnflag, n + CASE WHEN l_returnflag = 'R' THEN 3 ELSE 2 END,
    [CAST(n AS VARCHAR), '22' || lpad(CAST(l_partkey AS VARCHAR), 8, '0'), CASE WHEN l_linestatus = 'O' THEN NULL ELSE 'SV' || chr(10) || CAST(l_orderkey AS VARCHAR) END,
     CAST(l_quantity AS VARCHAR), CASE WHEN l_tax > 0.04 THEN 'Tốt' ELSE NULL END]
  FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_linestatus, l_tax) AS n FROM {lineitem}))
"""
# A table per order with a header row in some; the page follows the order date.
CTES["table_rows"] = """
SELECT o_custkey AS doc_id, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS page, o_orderkey AS table_no, 0 AS row_idx,
  CASE WHEN substr(o_orderpriority, 1, 1) < '3' THEN ['STT', 'MSV', 'Họ tên', 'Lớp'] ELSE ['STT', 'Noi dung', 'Số tiền'] END AS cells
FROM {orders} WHERE o_orderstatus = 'F'
UNION ALL
SELECT o_custkey, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT), o_orderkey, l_linenumber * 10000000 + l_partkey,
  CASE WHEN l_quantity < 5 THEN ['', '  ', '---'] ELSE [CAST(l_linenumber AS VARCHAR), '22' || lpad(CAST(l_partkey AS VARCHAR), 8, '0') || ' ', 'Phần  ' || CAST(l_suppkey AS VARCHAR), 'K' || l_returnflag, l_linestatus] END
FROM (SELECT l_orderkey, l_linenumber, l_partkey, min(l_quantity) AS l_quantity, min(l_suppkey) AS l_suppkey, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus
      FROM {lineitem} GROUP BY l_orderkey, l_linenumber, l_partkey) JOIN {orders} ON o_orderkey = l_orderkey
"""
# An HTML table per order.
CTES["scan_tables"] = """
SELECT o_custkey AS doc_id, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS page, o_orderkey AS table_no,
  '<table border=1><tr><td>STT</td><td>' || CASE WHEN o_orderstatus = 'F' THEN 'Mã sinh viên' ELSE 'Nội dung' END || '</td><td>Họ &amp; tên sinh viên</td></tr>'
  || '<tr><td>1</td><td><b>22' || lpad(CAST(o_custkey AS STRING), 8, '0') || '</b></td><td>' || repeat('Khoản thu số ' || CAST(o_orderkey AS STRING) || ' ', 20) || '</td></tr>'
  || '<tr><td></td><td> </td></tr>'
  || '<tr><td>2</td><td>23' || lpad(CAST(o_orderkey AS STRING), 8, '0') || '</td><td>' || repeat('Tong cong ', CAST(1 + o_custkey % 50 AS INT)) || '</td></tr>'
  || '<tr><td>3</td><td>x</td><td>' || repeat('cuối ', 60) || '</td></tr></table>' AS html
FROM {orders}
"""
# A box per word of a document: 200 words to a page, jittered heights.
CTES["ocr_boxes"] = """
SELECT doc_id, CAST(floor(i / 200) + 1 AS BIGINT) AS page, CAST(i % 8 * 100 AS BIGINT) AS x,
  CAST(floor((i % 200) / 8) * 25 + length(word) * 7 % 23 AS BIGINT) AS y,
  CAST(length(word) * 45 AS BIGINT) AS w, CAST(40 + i % 150 AS BIGINT) AS h, word AS text
FROM (SELECT doc_id, unnest(l) AS word, unnest(range(0, len(l))) AS i
      FROM (SELECT doc_id, string_split(text, ' ') AS l FROM {documents}))
"""
# Every line of a page as a piece; every third one plays a table.
CTES["pieces"] = """
SELECT doc_id, page, pos, line AS content, CASE WHEN pos % 3 = 2 THEN 'table_md' ELSE 'text' END AS content_type,
  CASE WHEN pos % 3 = 2 THEN 'table' ELSE 'text' END AS chunk_type
FROM (SELECT doc_id, page, unnest(l) AS line, unnest(range(0, len(l))) AS pos
      FROM (SELECT doc_id, page, string_split(raw_text, chr(10)) AS l FROM {page_texts}))
"""
# Files of all kinds: every fourth is a spreadsheet. Some have native pages only, some
# recognised boxes only, some both; some first pages begin like a decision.
CTES["files"] = """
SELECT id AS doc_id, CASE WHEN id % 4 = 0 THEN 'Danh_sach-' || CAST(id AS STRING) || '.xlsx' ELSE 'van_ban_' || CAST(id AS STRING) || '.PDF' END AS filename,
  CAST(1 + id % 3 AS BIGINT) AS version, CASE WHEN id % 5 = 0 THEN 'private' ELSE 'public' END AS access_scope, 'user' || CAST(id % 7 AS STRING) AS target_id
FROM (SELECT doc_id AS id FROM {documents} UNION SELECT c_custkey FROM {customer} UNION SELECT s_suppkey FROM {supplier}) f
"""
CTES["file_pages"] = """
SELECT doc_id, page, CASE WHEN page = 1 AND doc_id % 5 = 0 THEN 'Trường Đại học  Mẫu' || chr(10) || 'Số : ' || CAST(doc_id AS STRING) || '/QĐ. ngày 5 tháng 9 năm 2025' || chr(10)
  || 'QUYẾT ĐỊNH về lớp ' || CAST(doc_id AS STRING) || chr(10) || raw_text ELSE raw_text END AS raw_text
FROM {page_texts} WHERE doc_id % 3 <> 1
"""
CTES["file_boxes"] = """
SELECT doc_id, page, x, y, text FROM {ocr_boxes} WHERE doc_id % 3 <> 0
"""
CTES["file_tables"] = """
SELECT * FROM {table_rows} WHERE doc_id % 2 = 0
"""
# Sessions of eight turns. Some ask for a student by a name that one or many have, some by id,
# and some by neither, as a follow-up.
CTES["turn_questions"] = """
SELECT c_custkey AS query_id, 's' || CAST(CAST(floor(c_custkey / 8) AS BIGINT) AS STRING) AS session_id, c_custkey AS turn,
  CASE
    WHEN c_nationkey % 6 = 0 THEN 'Điểm rèn luyện của sinh viên ' || CASE WHEN c_custkey % 3 = 1 THEN 'Trần Thị Nam' ELSE 'Đặng Th' || translate(CAST(c_custkey - c_custkey % 3 AS STRING), '0123456789', 'aeioubcdgh') END
    WHEN c_nationkey % 6 = 1 THEN 'xếp loại của msv 22' || lpad(CAST(c_custkey AS STRING), 8, '0') || ' hk' || sem
    WHEN c_nationkey % 6 = 2 THEN 'còn điểm kỳ ' || sem || ' thì sao?'
    WHEN c_mktsegment = 'AUTOMOBILE' THEN 'Thông báo thu học phí kỳ ' || sem || ' năm học ' || yy || '-' || yy2 || ' là bao nhiêu?'
    WHEN c_mktsegment = 'FURNITURE' THEN 'nội dung quyết định miễn giảm học phí năm ' || yy
    WHEN c_mktsegment = 'HOUSEHOLD' THEN 'lịch nghỉ tết nguyên đán ' || yy || ' khi nào?'
    WHEN c_mktsegment = 'MACHINERY' THEN 'quy định nộp học phí ' || yy || '-' || yy2 || ' hoặc ' || yy
    ELSE 'zzz qqq ' || CAST(c_custkey AS STRING) END AS query
FROM (
  SELECT c_custkey, c_nationkey, c_mktsegment, CAST(1 + c_nationkey % 3 AS STRING) AS sem,
    CAST(2019 + c_nationkey % 8 AS STRING) AS yy, CAST(2020 + c_nationkey % 8 AS STRING) AS yy2
  FROM {customer}) c
"""
# The notices; the lists of every third document name a student that only that document has.
CTES["turn_chunks"] = """
SELECT chunk_uid, doc_id, chunk_id, o_orderkey, title, doc_number, date, issuer, source, content_type, chunk_type, is_active, access_scope, target_id,
  CASE WHEN kind = 5 THEN msv || ',' || msv2 END AS listed,
  CASE WHEN doc_id % 3 = 0 THEN replace(content, person, 'Đặng Th' || translate(CAST(doc_id AS STRING), '0123456789', 'aeioubcdgh')) ELSE content END AS content
FROM {notices}
"""
# Upload, delete and restore events of the documents of one source.
CTES["upload_events"] = """
SELECT source AS filename, doc_id * 10 AS seq, 'upload' AS kind, doc_id FROM {documents}
UNION ALL SELECT source, d.doc_id * 10 + 1, 'delete', d.doc_id FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id WHERE l.quality = 0 OR l.toxic = 1
UNION ALL SELECT source, d.doc_id * 10 + 2, 'restore', d.doc_id FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id WHERE l.toxic = 1
"""
# Documents with validity, one per order.
CTES["valid_documents"] = """
SELECT o_orderkey AS id, o_custkey AS doc_id, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END AS effective_date,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate + INTERVAL '200' DAY END AS expiry_date
FROM {orders}
"""
# Oracle only: first height of each text line of a page.
CTES["anchors"] = """
SELECT doc_id, page, min(y) AS anchor FROM {ocr_boxes} WHERE trim(text) <> '' GROUP BY doc_id, page
UNION ALL
SELECT a.doc_id, a.page, (SELECT min(b.y) FROM {ocr_boxes} b WHERE trim(b.text) <> '' AND b.doc_id = a.doc_id AND b.page = a.page AND b.y > a.anchor + 20)
FROM anchors a WHERE a.anchor IS NOT NULL
"""


class Tables:
    """Lazy access to the tables below one directory."""

    BASE = [
        "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
        "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
    ]

    TEXTS = ["documents", "pages", "conversations", "orders", "embeddings"]

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in self.BASE:
            return self._spread(name, self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet"))
        if hasattr(type(self), f"_{name}"):
            return getattr(type(self), f"_{name}")(self)
        if name in CTES:
            return self.sql(CTES[name])
        raise AttributeError(name)

    def _spread(self, name: str, df: DataFrame) -> DataFrame:
        """Spread a table of texts that lies in fewer files than there are cores.

        A single small file is read by one task, which then does all the text
        work. Tables of many files are left as they are.
        """
        cores = self.spark.sparkContext.defaultParallelism
        if name in self.TEXTS and len(df.inputFiles()) < cores:
            return df.repartition(cores)
        return df

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over given and derived tables written as ``{name}``."""
        names = set(re.findall(r"\{(\w+)\}", text))
        return self.spark.sql(text, **{n: getattr(self, n) for n in names})

    def _page_texts(self) -> DataFrame:
        lines = self.documents.selectExpr("doc_id", "lang", "source", r"split(text, '\n') as lines")
        return lines.selectExpr(
            "doc_id", "lang", "source",
            "explode(transform(sequence(1, cast(ceil(size(lines) / 20) as int)),"
            " p -> struct(cast(p as bigint) as page,"
            r" array_join(slice(lines, (p - 1) * 20 + 1, 20), '\n') as raw_text))) as s",
        ).select("doc_id", "lang", "source", "s.page", "s.raw_text")

    def _grids(self) -> DataFrame:
        order = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_linestatus", "l_tax"]
        rows = self.lineitem.select("l_suppkey", "l_returnflag", *order)
        rows = dense_index(rows, ["l_suppkey", "l_returnflag"], order, "n")
        data = rows.selectExpr(
            "l_suppkey as doc_id", "l_returnflag as sheet",
            "n + if(l_returnflag = 'R', 3, 2) as row_idx",
            r"array(cast(n as string), '22' || lpad(cast(l_partkey as string), 8, '0'),"
            r" if(l_linestatus = 'O', null, 'SV\n' || cast(l_orderkey as string)),"
            " cast(l_quantity as string), if(l_tax > 0.04D, 'Tốt', null)) as cells",
        )
        sheets = self.lineitem.selectExpr("l_suppkey as doc_id", "l_returnflag as sheet").distinct()
        top = sheets.selectExpr(
            "doc_id", "sheet",
            "inline(array(struct(0L, array('Trường', null, ' Danh sách ' || sheet, '', null)),"
            " struct(1L, array(cast(null as string), null, null, null, null)),"
            r" struct(2L, array('STT', 'Mã sinh viên', null, 'Điểm', 'Xếp\nloại')),"
            r" struct(3L, array(null, '', 'Họ\ntên', 'điểm số', null)))) as (row_idx, cells)",
        ).where("row_idx < 3 or sheet = 'R'")
        return top.unionByName(data)

    def _table_rows(self) -> DataFrame:
        orders = self.orders.selectExpr(
            "o_custkey as doc_id", "cast(year(o_orderdate) * 12 + month(o_orderdate) as bigint) as page",
            "o_orderkey as table_no", "o_orderstatus", "substr(o_orderpriority, 1, 1) < '3' as listed",
        )
        heads = orders.where("o_orderstatus = 'F'").selectExpr(
            "doc_id", "page", "table_no", "0L as row_idx",
            "if(listed, array('STT', 'MSV', 'Họ tên', 'Lớp'), array('STT', 'Noi dung', 'Số tiền')) as cells",
        )
        lines = self.lineitem.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(
            *[F.min(c).alias(c) for c in ("l_quantity", "l_suppkey", "l_returnflag", "l_linestatus")]
        )
        body = lines.join(orders, lines.l_orderkey == orders.table_no).selectExpr(
            "doc_id", "page", "table_no", "l_linenumber * 10000000L + l_partkey as row_idx",
            "if(l_quantity < 5, array('', '  ', '---'), array(cast(l_linenumber as string),"
            " '22' || lpad(cast(l_partkey as string), 8, '0') || ' ', 'Phần  ' || cast(l_suppkey as string),"
            " 'K' || l_returnflag, l_linestatus)) as cells",
        )
        return heads.unionByName(body)

    def _ocr_boxes(self) -> DataFrame:
        words = self.documents.select("doc_id", F.posexplode(F.split("text", " ")).alias("i", "word"))
        return words.selectExpr(
            "doc_id", "cast(floor(i / 200) + 1 as bigint) as page", "cast(i % 8 * 100 as bigint) as x",
            "cast(floor((i % 200) / 8) * 25 + length(word) * 7 % 23 as bigint) as y",
            "cast(length(word) * 45 as bigint) as w", "cast(40 + i % 150 as bigint) as h", "word as text",
        )

    def _pieces(self) -> DataFrame:
        lines = self.page_texts.select("doc_id", "page", F.posexplode(F.split("raw_text", "\n")).alias("pos", "content"))
        return lines.selectExpr(
            "doc_id", "page", "pos", "content", "if(pos % 3 = 2, 'table_md', 'text') as content_type",
            "if(pos % 3 = 2, 'table', 'text') as chunk_type",
        )
