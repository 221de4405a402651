"""Ingest of all kinds of files and answers to whole sessions, on small fixtures."""

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import ingest_graph as I
from corpusmill.operators import retrieval as R
from corpusmill.operators import turn_plan as P

LONG = "Một dòng văn bản đủ dài để không bị bỏ đi khi làm sạch trang này"


@pytest.fixture(scope="module")
def payload(spark):
    docs = spark.createDataFrame([
        (1, "a.pdf", 1, "public", None), (2, "b.pdf", 2, "private", "u"), (3, "c_d-e.XLSX", 1, "public", None), (4, "empty.pdf", 1, "public", None), (5, "g.csv", 1, "public", None)],
        "doc_id long, filename string, version long, access_scope string, target_id string")
    native = f"QUYẾT ĐỊNH về học bổng\nSố: 12/QD ngày 5 tháng 9 năm 2025\n{LONG}\n| a | b |"
    pages = spark.createDataFrame([(1, 1, native), (1, 2, f"{LONG} hai\n| x | y |\n12.5"), (2, 1, "short"), (3, 1, LONG)], "doc_id long, page int, raw_text string")
    words = [(2, 2, i * 10, 40, w) for i, w in enumerate(f"THÔNG BÁO {LONG}".split())] + [(2, 1, 0, 0, "..."), (1, 1, 0, 0, "không dùng")]
    boxes = spark.createDataFrame(words, "doc_id long, page int, x int, y int, text string")
    cells = [["STT", "MSV", "Họ tên"], ["1", "2200000001", "An"], ["2", "2200000002", "Bình"]]
    tables = spark.createDataFrame([(1, 2, 1, i, c) for i, c in enumerate(cells)], "doc_id long, page int, table_no int, row_idx int, cells array<string>")
    html = "<table><tr><td>STT</td><td>Nội dung</td></tr><tr><td>1</td><td>x</td></tr></table>"
    scans = spark.createDataFrame([(1, 1, 1, html), (2, 2, 1, html)], "doc_id long, page int, table_no int, html string")
    rows = [(3, s, n, i, c) for s, n in (("Z", 1), ("A", 2)) for i, c in enumerate([["STT", "Tên"], *([str(k), s] for k in range(25))])]
    grids = spark.createDataFrame(rows + [(1, "S", 1, 0, ["STT"])], "doc_id long, sheet string, sheet_no int, row_idx int, cells array<string>")
    model = spark.createDataFrame([(1, "Tên từ mô hình", "không xác định"), (2, None, "9/TB")], "doc_id long, title string, doc_number string")
    out = I.ingest_all(docs, I.Extracts(pages, boxes, tables, scans, grids, model), R.hashing_encoder(8), 8)
    return out.orderBy("doc_id", "chunk_order").collect()


def test_branches_meet_in_one_order(payload):
    got = [(r.doc_id, r.chunk_id, r.page, r.content_type, r.ocr_engine) for r in payload]
    assert got == [
        (1, "chunk_1", 1, "text", "native_pdf"), (1, "chunk_2", 2, "text", "native_pdf"), (1, "chunk_3", 2, "student_list", "pdfplumber"),
        (2, "chunk_1", 2, "text", "hybrid_ocr"), (2, "chunk_2", 2, "table_md_scan", "ppstructure"),
        *((3, f"chunk_{k}", None, "excel_table", None) for k in range(1, 5))]
    assert [r.sheet_name for r in payload if r.doc_id == 3] == ["Z", "Z", "A", "A"]  # by sheet_no
    assert {r.doc_id: r.doc_total_pages for r in payload} == {1: 2, 2: 1, 3: 1}


def test_tables_steer_the_cleaning_of_their_pages(payload):
    first, second = payload[0].content, payload[1].content
    assert "| a | b |" in first and "| x | y |" not in second and "12.5" not in second


def test_payload_has_metadata_and_vectors(payload):
    by = {r.doc_id: r for r in payload}
    one, two, three = by[1], by[2], by[3]
    assert (one.title, one.doc_number, one.date, one.doc_type, one.source) == ("Tên từ mô hình", "12/QD", "2025-09-05", "Quyết_định", "a.pdf")
    assert (two.doc_number, two.doc_type, two.access_scope, two.version) == ("9/TB", "Thông_báo", "private", 2)
    assert (three.title, three.doc_type, three.date) == ("c d e.XLSX", "Danh_sách", None)
    assert all(len(r.embedding) == 8 and r.is_active and r.content_folded for r in payload)
    assert len({r.chunk_uid for r in payload}) == len(payload)


# --- sessions ---------------------------------------------------------------------
def _list(term, *people):
    rows = [f"| {i} | {msv} | {name} | Nam | 01/02/2004 | {points} | Tốt |" for i, (msv, name, points) in enumerate(people, 1)]
    return f"Đợt: {term}\n| STT | MSV | Họ tên | Giới tính | Ngày sinh | Điểm | Xếp loại |\n|---|---|---|---|---|---|---|\n" + "\n".join(rows)


CHUNKS = [
    ("c1", 1, "student_list", "Điểm rèn luyện", _list("HK1 (2024-2025)", ("2200000001", "Đặng Thao", 80), ("2200000002", "Lê Hoa", 70)), ["2200000001", "2200000002"]),
    ("c2", 1, "student_list", "Điểm rèn luyện", _list("HK2 (2024-2025)", ("2200000001", "Đặng Thao", 90), ("2200000003", "Lê Hoa", 60)), ["2200000001", "2200000003"]),
    ("c3", 2, "text", "Quy định học bổng", "Quy định về học bổng của trường gồm nhiều điều kiện và thủ tục khác nhau.", []),
]
TURNS = [
    ("a", 1, "Điểm rèn luyện của sinh viên Đặng Thao"), ("a", 2, "còn điểm rèn luyện thì sao"), ("a", 3, "Điểm rèn luyện của sinh viên Lê Hoa"),
    ("a", 4, "xếp loại rèn luyện của msv 2200000003"), ("a", 5, "quy định học bổng gồm những thủ tục gì"), ("b", 1, "còn điểm rèn luyện thì sao"), ("b", 2, "Xin chào"),
]


@pytest.fixture(scope="module")
def session_inputs(spark):
    fields = "chunk_uid string, doc_id long, content_type string, title string, content string, student_ids_in_chunk array<string>"
    chunks = spark.createDataFrame(CHUNKS, fields).withColumns({
        "content_folded": T.fold(F.col("content")), "chunk_id": F.concat(F.lit("chunk_"), F.substring("chunk_uid", 2, 1)), "chunk_type": F.lit("text"), "source": F.lit("f.pdf"),
        "is_active": F.lit(True), "access_scope": F.lit("public"), **{c: F.lit(None).cast("string") for c in ("target_id", "doc_number", "date", "issuer")}})
    turns = spark.createDataFrame([(i, *t) for i, t in enumerate(TURNS)], "query_id long, session_id string, turn long, query string")
    return turns, chunks


def test_a_session_remembers_its_student(session_inputs):
    answers, _ = P.answer_turns(*session_inputs, 2025)
    got = {(r.session_id, r.turn): r for r in answers.collect()}
    assert {k: (r.target_id, r.answer_kind) for k, r in got.items() if r.turn < 5 and k != ("b", 2)} == {
        ("a", 1): ("2200000001", "records"), ("a", 2): ("2200000001", "records"), ("a", 3): (None, "clarify"),
        ("a", 4): ("2200000003", "records"), ("b", 1): (None, "generate")}
    assert "90 điểm" in got["a", 1].answer and "80 điểm" in got["a", 1].answer
    assert "2200000002" in got["a", 3].answer and "2200000003" in got["a", 3].answer
    assert got["a", 5].answer_kind == "generate" and "học bổng" in got["a", 5].context


def test_generated_answers_are_checked_and_vectors_searched(session_inputs):
    turns, chunks = session_inputs
    encoder = R.hashing_encoder(16)
    turns = R.embed(turns, "query", encoder, 16, "vector")
    chunks = R.embed(chunks, "content", encoder, 16)
    model = lambda rows: rows.select("query_id", F.lit("Sinh viên 9999999999 không có.\nHọc bổng cần điều kiện và thủ tục.").alias("answer"))
    answers, valid = P.answer_turns(turns, chunks, 2025, model)
    got = {(r.session_id, r.turn): r for r in answers.collect()}
    assert got["a", 5].answer_kind == "generated" and "9999999999" not in got["a", 5].answer
    assert got["a", 2].answer_kind == "records"
    assert {r.chunk_uid for r in valid.where("query_id = 1").collect()} <= {"c1", "c2"}


def test_cosine_of_given_pairs(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [3.0, 4.0]), ("z", [0.0, 0.0])], "chunk_uid string, embedding array<double>")
    queries = spark.createDataFrame([(1, [2.0, 0.0])], "query_id long, vector array<double>")
    pairs = spark.createDataFrame([(1, "a"), (1, "b"), (1, "z")], "query_id long, chunk_uid string")
    got = [(r.chunk_uid, round(r.score, 6), r["rank"]) for r in R.semantic_pairs(pairs, queries, vectors, 5).orderBy("rank").collect()]
    assert got == [("a", 1.0, 1), ("b", 0.6, 2)]
