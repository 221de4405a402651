"""Scalars against small fixtures with expected values worked out by hand."""

import unicodedata
import uuid

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import metadata as M
from corpusmill.functions import text as T
from corpusmill.operators.chunking import point_id


def apply(spark, fn, value):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("given, expected", [
    ("Đối tượng miễn giảm học phí", "oi tuong mien giam hoc phi"),
    ("Điều 1. Quyết định", "ieu 1 quyet inh"),
    ("Tổng cộng 6.000.000đ", "tong cong 6 000 000"),
    ("ố\u200bi", "oi"), ("ﬁ ½ Ⅷ", "fi 1 2 viii"), (None, ""),
])
def test_fold(spark, given, expected):
    assert apply(spark, T.fold, given) == expected
    again = apply(spark, T.fold, expected)
    assert again == expected


def test_fold_drops_exactly_combining_marks(spark):
    text = "".join(f"a{chr(p)}b " for p in range(0x300, 0x1AFF) if unicodedata.category(chr(p)).startswith("M"))
    plain = unicodedata.normalize("NFKD", text)
    plain = "".join(c for c in plain if not unicodedata.combining(c)).lower()
    expected = " ".join("".join(c if c in "0123456789abcdefghijklmnopqrstuvwxyz" else " " for c in plain).split())
    assert apply(spark, T.fold, text) == expected


def test_fold_query_splits_at_zero_width(spark):
    assert apply(spark, T.fold_query, "ố\u200bi") == "o i"


@pytest.mark.parametrize("fn, given, expected", [
    (T.normalize_whitespace, "a  b \r\n\n\n c", "a b\nc"),
    (T.fix_ocr, "3o1", "301"), (T.fix_ocr, "0l", "01"), (T.fix_ocr, "Kh6a DIÉN", "Khóa điện"),
    (T.clean_text, "Xin chao\nxin  CHÀO\nkhac", "Xin chao\nkhac"), (T.clean_text, "---", ""),
    (T.clean_text, "đ", ""), (T.clean_text, " one ", "one"),
    (T.session_title, "x" * 51, "x" * 50 + "..."),
    (T.display_source, "20240101000000_a_0001.PDF", "a.pdf"),
    (T.scrub_answer, "Trả lời: 你好 hi ,, x", "hi, x"), (T.scrub_answer, "你好", "你好"),
    (T.clean_context_line, "- 1. abc", "abc"), (T.clean_context_line, "[x]", ""),
    (T.clean_directive, "abc | d --- [x] <b> ef. Trân trọng x", "abc d ef"),
    (M.sanitize_date, "ngày 5 tháng 9 năm 2025", "2025-09-05"), (M.sanitize_date, "31/02/2025", None),
    (M.sanitize_date, "2025-9-5", "2025-09-05"), (M.sanitize_date, "31/02/2025 ngày 1 tháng 2 năm 2024", "2024-02-01"),
])
def test_scalars(spark, fn, given, expected):
    assert apply(spark, fn, given) == expected


@pytest.mark.parametrize("given, noisy", [("ab", True), ("123", True), ("a normal line", False), ("| a |", True),
                                          ("STT x", True), ("Khoang", False), ("a????", True), ("1.5.2", True)])
def test_noisy_lines(spark, given, noisy):
    assert apply(spark, T.is_noisy_line, given) is noisy


@pytest.mark.parametrize("given, money", [("6.000.000", True), ("6000.000", False), ("600", False)])
def test_money(spark, given, money):
    assert apply(spark, T.is_money, given) is money


def test_point_id_is_uuid5(spark):
    fold = "quyet inh so 93"
    got = apply(spark, lambda x: point_id(F.lit(12), F.lit(3), F.lit("chunk_7"), x), "Quyết định số 93")
    assert got == str(uuid.uuid5(uuid.NAMESPACE_URL, f"12:3:chunk_7:{fold}")) == "59f656d4-c070-59ed-9169-96933b4338e7"
