"""Rule-based answers on worked-out cases."""

from pyspark.sql import functions as F
from test_operators import hits

from corpusmill.operators import extraction as A


def cases(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id int, query string, context string, answer string")


FEE = (
    "[Văn bản: Thu học phí kỳ II | Số: 1/TB]\nkhông liên quan\n"
    "[Văn bản: Thu học phí kỳ I năm học 2024-2025 | Số: 9/TB | Ngày: 2024-08-01]\n"
    "Học phí chính quy: 540.000 | 560.000 | 580.000\n| 1 | Tiền nước | 120.000 đ |\n| 2 | tiền nước | 130.000 đ |\n"
    "| 3 | Bảo hiểm | 90.000 |\nnộp tại https://pay.example.org/x). Máy POS"
)


def test_fee_answer_picks_the_section(spark):
    df = cases(spark, (1, "học phí kỳ 1 năm học 2024-2025", FEE, ""), (2, "lịch thi", FEE, ""))
    got = {r.query_id: r.fee_answer for r in A.fee_answers(df).collect()}
    assert got[2] is None
    assert got[1].split("\n") == [
        "**Thu học phí kỳ I năm học 2024-2025**", "", "**Số:** 9/TB | **Ngày:** 2024-08-01", "",
        "**Mức học phí (đồng/tín chỉ):**", "- Khóa 11: **540.000**", "- Khóa 12: **560.000**", "- Khóa 13: **580.000**", "",
        "**Các khoản lệ phí:**", "- Tiền nước: **120.000đ**", "- Bảo hiểm: **90.000**", "",
        "**Cổng thanh toán:** https://pay.example.org/x", "**Phương thức nộp:**",
        "- Nộp qua thẻ ATM nội địa tại Phòng Kế hoạch - Tài chính (máy POS).",
    ]


def test_fee_answer_needs_amounts(spark):
    df = cases(spark, (1, "thu học phí kỳ 1", "[kỳ I]\nkhông có số", ""))
    assert A.fee_answers(df).first().fee_answer is None


CONTEXT = "[T]\nNội dung nộp:\nmột điều\nThời gian nộp:\nhai\nMức nộp thêm:\nba điều dài hơn để đủ một trăm hai mươi ký tự trong dàn ý\n"


def test_enrich_replaces_partial_answers(spark):
    df = cases(
        spark,
        (1, "thông tin nộp", CONTEXT, "Xin lỗi, không có"),
        (2, "thông tin nộp", CONTEXT, "Có nội dung nộp, thời gian nộp và mức nộp thêm như sau " * 5),
        (3, "thông tin nộp", "ngắn", "Xin lỗi"),
        (4, "thông tin nộp", CONTEXT, "một câu trả lời không nói tới mục nào"),
    )
    got = {r.query_id: r.answer for r in A.enrich_answers(df).collect()}
    assert got[1].startswith("**T**\n\n**Nội dung chính theo yêu cầu:** thông tin nộp") and got[4] == got[1]
    assert got[2].startswith("Có nội dung") and got[3] == "Xin lỗi"


def test_four_sections(spark):
    context = "Thoi gian nop ho so:\n- tháng 9\nLưu ý: mang thẻ\n- mang thẻ sinh viên\n[x]\nLưu ý: mang thẻ"
    got = {r.section: r["items"] for r in A.four_sections(cases(spark, (1, "q", context, ""))).collect()}
    assert got == {"Thời gian nộp hồ sơ": ["tháng 9"], "Lưu ý": ["Lưu ý: mang thẻ", "mang thẻ sinh viên"]}


def test_safe_facts(spark):
    text = "| hồ sơ miễn giảm học phí | năm học 2024 / 2025 | ngày 01/02/2025 và 01/02/2025 rồi 3-4-2025, 5/6/2025 |"
    rows = [{"query": "nội dung hồ sơ", "title": "Không xác định", "content_type": "table_md_scan", "content": text,
             "source": "20240101000000_don_2024.pdf"} for _ in range(3)]
    answer = A.safe_answers(hits(spark, rows)).first().answer.split("\n")
    assert answer[0] == "**Tài liệu liên quan:** don.pdf"
    assert answer[3:6] == [
        "- Nội dung có nhắc tới năm học **2024-2025**.",
        "- Tài liệu đề cập hồ sơ **miễn, giảm học phí** cho sinh viên.",
        "- Mốc thời gian OCR đọc được: `01/02/2025`, `3-4-2025`.",
    ]
    mixed = [{**rows[0], "content_type": "text"}, *rows]
    assert A.safe_answers(hits(spark, mixed)).count() == 0


def test_directives_keep_the_longest(spark):
    body = "nội dung chỉ đạo đủ dài để được giữ lại trong danh sách"
    context = f"[Số: 5]\nTết. Các công việc sau đây:\n2. {body} hai\n1. {body}\n1. {body} dài hơn\n13. {body}\nTrân trọng 3. {body}"
    df = cases(spark, (1, "tet nguyen dan", context, ""))
    got = df.select(A.directive_answer(F.col("query"), F.col("context")).alias("a")).first().a.split("\n")
    assert got[2:] == ["**Số:** 5", "", f"**Điều 1:** {body} dài hơn", "", f"**Điều 2:** {body} hai"]
