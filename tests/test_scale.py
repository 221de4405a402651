"""Plans that must not grow faster than their input."""

import re

import pandas as pd
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import numbering as N
from corpusmill.operators import ocr as O
from corpusmill.operators import page_tables as P
from corpusmill.operators import extraction as A
from corpusmill.operators import ranking as K
from corpusmill.operators import retrieval as R
from corpusmill.session import written


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_contains_any_works_its_text_out_once(spark):
    found = T.contains_any(T.fold(F.lower(F.col("x"))), ["mot", "hai", "ba"])
    plan = _plan(spark.createDataFrame([("Một",), (None,)], "x string").select(found.alias("f")))
    assert len(re.findall(r"lower\(x#\d+\)", plan.split("\n")[1] if "\n" in plan else plan)) <= 1
    rows = spark.createDataFrame([("Một hai",), ("bốn",), (None,)], "x string").select(T.contains_any(F.col("x"), ["hai"]).alias("f"), T.contains_any(T.fold(F.col("x")), ["mot", "hai"]).alias("g")).collect()
    assert [tuple(r) for r in rows] == [(True, True), (False, False), (None, False)]


def test_cleaning_of_ascii_and_other_texts(spark):
    rows = [("A\t b\r\n\n c",), ("é x​",), ("KK İı Ốͅ",), ("",), (None,)]
    got = spark.createDataFrame(rows, "x string").select(
        T.normalize_whitespace(F.col("x")).alias("w"), T.normalize_unicode(F.col("x")).alias("u"), T.fold(F.col("x")).alias("f")).collect()
    assert [r.w for r in got][0] == "A b\nc"
    assert [r.u for r in got][1] == "é x"
    assert [r.f for r in got] == ["a b c", "e x", "kk i o", "", ""]


def test_search_copies_no_word_list_beside_its_words(spark):
    chunks = spark.createDataFrame(
        [("1", "alpha beta gamma", "t", "alpha beta gamma"), ("1", "alpha beta", "t", "alpha beta"), ("2", "beta", "u", "beta")],
        "chunk_uid string, content string, title string, content_folded string")
    queries = spark.createDataFrame([(7, ["beta alpha"]), (8, ["beta"])], "query_id long, keywords array<string>")
    index = R.token_index(chunks)
    hits = R.keyword_search(chunks, queries, index=index)
    assert sorted((r.query_id, r.chunk_uid, r["rank"]) for r in hits.collect()) == [(7, "1", 1), (8, "1", 1), (8, "2", 2)]
    shuffled = R.keyword_search(chunks, queries, index=index, broadcast_bytes=0)
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, shuffled.collect()))
    kept = re.findall(r"Generate explode\(tokens#\d+\), \[([^\]]*)\]", _plan(hits))
    assert kept and not any("tokens" in k for k in kept)


def test_lines_of_contexts_are_shuffled_once(spark):
    text = "Điều 1. Đối tượng áp dụng:\n- một\n- hai\nThời gian nộp hồ sơ:\n- ba\n\n| A | Số |\n|---|---|\n| x | 1.000 |"
    rows = spark.createDataFrame([(1, text), (1, text), (2, "không có gì"), (None, text)], "query_id long, context string")
    sections = A.generic_sections(rows)
    assert _plan(sections).count("Exchange hashpartitioning") == 1
    assert [(r.query_id, r.idx, r["items"]) for r in sections.orderBy("idx").collect()] == [(1, 0, ["một", "hai"]), (1, 1, ["ba"])]
    tables = A.money_tables(rows.where("query_id = 1").limit(1))
    assert [(r.idx, r.headers, r["rows"]) for r in tables.collect()] == [(0, ["A", "Số"], [["x", "1.000"]])]


def test_years_filter_hits_of_queries_with_several_years_only(spark):
    hits = spark.createDataFrame(
        [(1, "học phí 2020-2021", "a", "học phí 2020-2021"), (1, "học phí 2020-2021", "b", "học phí 2022"), (2, "học phí 2020", "c", "học phí 2022")],
        "query_id long, query string, chunk_uid string, content string").withColumns({c: F.lit(None).cast("string") for c in ("title", "date", "source")})
    assert sorted(r.chunk_uid for r in K.explicit_year_filter(hits).collect()) == ["a", "c"]


def test_heights_of_a_page_are_folded_without_copies_and_boxes_shuffled_once(spark):
    rows = [(1, 1, x, y, f" w{x}.{y} ") for x in (5, 1) for y in (0, 20, 21, 41, 42, 90)] + [(1, 1, 0, 7, "  "), (1, 2, 0, None, "x"), (None, 1, 0, 3, "n")]
    boxes = spark.createDataFrame(rows, "doc_id long, page long, x long, y long, text string")
    lines = O.reading_lines(boxes)
    got = {r.anchor: r.line for r in lines.collect()}
    assert got == {0: "w1.0 w5.0 w1.20 w5.20", 21: "w1.21 w5.21 w1.41 w5.41", 42: "w1.42 w5.42", 90: "w1.90 w5.90"}
    assert "Generate" not in _plan(lines)  # a row for each height met the boxes by height, in one more shuffle


def test_small_tables_are_numbered_without_counting_blocks(spark):
    rows = [(k, 5000 * i % 65537) for k in (1, 2) for i in range(9)]
    df = spark.createDataFrame(rows, "k long, i long")
    plain = N.dense_index(df, ["k"], ["i"], "n")
    for whole in (F.lit(True), F.col("k") == 1, F.lit(None).cast("boolean")):
        assert sorted(N.dense_index(df, ["k"], ["i"], "n", whole=whole).collect()) == sorted(plain.collect())
    assert "HashAggregate" not in _plan(N.dense_index(df, ["k"], ["i"], "n", whole=F.lit(True)))


def test_plain_tables_are_read_without_the_parser(monkeypatch):
    html = "<TABLE border=1><tr><td>a &amp; <b>b</b><td colspan='2'>\n<th> c </tr>x<tr><td>1</table> y"
    assert P._plain_rows(html) == P._parsed_rows(html) == [[["a &", "b"], [], ["c"]], [["1"]]]
    odd = ["<table><tr><td>a < b</td></tr></table>", "<table><tr><td><!-- <td> -->x</table>", "<table><tr><td><table><tr><td>n</table></table>", "<tr><td>x", "<table><tr><td>a<br/>b</table>", "<table><tr><td>q</td x></table>", "a", ""]
    assert all(P._plain_rows(h) is None for h in odd)
    monkeypatch.setattr(P, "_Cells", None)
    assert P._table_cells(pd.Series([html, None]))[0] == [["a & b", "", "c"], ["1"]]


def test_plain_texts_take_the_short_way_with_the_same_result(spark):
    texts = ["Phần  12 ", "2200000001 ", "a", "Tong  cong", "Tong cong", "1O5", "x0l", "a\u00a0b", "--", "", None, "K\u0301 a", "olf", "Một dòng – hai"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    got = [r[0] for r in df.select(T.clean_text(F.col("x"))).collect()]
    assert got == ["Phần 12", "2200000001", "a", "Tong cong", "Tổng cộng", "105", "x0l", "a b", "", "", "", "Ḱ a", "01", "Một dòng – hai"]
    plain = [r[0] for r in df.select(T.is_plain(F.col("x"))).collect()]
    assert plain == [True, True, True, True, False, False, False, False, False, False, False, False, False, True]


def test_tables_that_fit_are_packed_at_once(spark):
    md = "| a |\n|---|\n" + "\n".join(f"| {i} |" for i in range(4))
    df = spark.createDataFrame([(md,), ("x\n\ny",)], "md string")
    for size in (10, 20, len(md) - 1, len(md)):
        parts = df.select(P.pack_table(F.col("md"), size)).collect()[0][0]
        assert all(p.startswith("| a |\n|---|\n") and len(p) <= max(size, 20) for p in parts)
        assert (parts == [md]) == (size >= len(md)) and "\n".join(p[12:] for p in parts) == md[12:]


def test_only_postings_of_asked_words_are_shuffled(spark):
    rows = [(f"c{i:02d}", "t", f"common w{i} " + " ".join(f"x{i}y{k}" for k in range(200))) for i in range(30)]
    chunks = spark.createDataFrame(rows, "chunk_uid string, title string, content string").withColumn("content_folded", F.lit(""))
    queries = spark.createDataFrame([(1, ["common", "common w7", "w7 w8"])], "query_id long, keywords array<string>")
    postings = R._asked_postings(R.token_index(chunks), R.needles(queries)).where("field = 'content'")
    assert 32 <= postings.count() < 100
    got = R.keyword_search(chunks, queries, 5, broadcast_bytes=0).orderBy("rank").collect()
    assert [x.chunk_uid for x in got] == ["c00", "c01", "c02", "c03", "c04", "c07"]


def test_packed_files_are_not_taken_for_small_tables(spark):
    # A million rows of texts that pack well: some MB as a file, many times that as rows.
    wide = spark.range(1_000_000).select(F.xxhash64("id").alias("id"), F.repeat(F.lit("text "), 40).alias("text"))
    stored = written(wide, "packed")
    size = int(str(stored._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    asked = spark.range(1_000_000).select(F.xxhash64("id").alias("id"))
    plan = _plan(written(asked.repartition(4), "asked").join(stored, "id"))
    assert size > 64_000_000
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_blank_and_letter_classes_hold_what_they_held(spark):
    points = spark.range(1, 0x30000).where("id < 55296 OR id > 57343").select(F.col("id").cast("int").alias("p"))
    chars = points.select("p", F.decode(F.unhex(F.lpad(F.hex("p"), 8, "0")), "UTF-32").alias("c"))
    old_plain = r"\A[ -~]*+[ -~\x{A1}-\x{AC}\x{AE}-\x{2FF}\x{1E00}-\x{1EFF}\x{2010}-\x{2027}]*+\z"
    pairs = [(f"[{T.WS}]", "(?U)" + T._BLANK), ("[^0-9A-Za-z]", r"\P{Alnum}"), (old_plain, T._PLAIN)]
    other = chars.select(*[F.count_if(F.col("c").rlike(a) != F.col("c").rlike(b)).alias(f"n{i}") for i, (a, b) in enumerate(pairs)]).first()
    assert list(other) == [0, 0, 0]
    assert chars.where(F.col("c").rlike("(?U)" + T._BLANK)).count() == len(T.WS_CHARS)


def test_lines_of_contexts_are_normalised_and_folded_once(spark):
    contexts = spark.createDataFrame([(1, "[Văn bản]\nĐiều 1. Đối tượng:\n- <b>Con</b> hộ nghèo\nThời gian nộp hồ sơ :\n2. Ký túc xá\nhạn  cuối\nhạn cuối")], "query_id long, context string")
    sections = A.generic_sections(contexts)
    assert _plan(sections).count("Normalizer, compose, ") == 1
    # The line itself, and the folded form of a heading, of a numbered form, and of a sentence that lost a mark.
    assert _plan(sections).count("Normalizer, decompose, ") <= 4
    assert [(r.idx, r.title, r["items"]) for r in sections.orderBy("idx").collect()] == [
        (0, "Điều 1. Đối tượng", ["Con hộ nghèo"]), (1, "Thời gian nộp hồ sơ", ["Ký túc xá", "hạn cuối"])]
    four = A.four_sections(contexts)
    assert _plan(four).count("Normalizer, compose, ") == 1
    assert [(r.section, r["items"]) for r in four.collect()] == [("Thời gian nộp hồ sơ", ["Ký túc xá", "hạn cuối"])]


def test_each_correction_waits_for_its_own_stem(spark):
    rows = [("Tong cong 5 Noi dung",), ("tong cong Noİ dung",), ("? Ngân Chuo’ng chuong",), ("Tién dién nuóc uóng cá nám",), ("2o5 olf 0L Kh6a",), ("hoá đơn số 6",), (None,)]
    fixed = T.fix_ocr(F.col("x"))
    frame = spark.createDataFrame(rows, "x string").select(fixed.alias("x"))
    plan = _plan(frame)
    # A test of the lower-cased text before each rule, and one before all.
    assert len(re.findall(r"Contains\(lower\(|contains\(lower\(", plan)) >= len(T.vocab.OCR_FIXES)
    got = [r.x for r in frame.collect()]
    assert got == ["Tổng cộng 5 Nội dung", "Tổng cộng Nội dung", "- Ngân Chương Chương", "Tiền điện nước uống cả năm", "205 01 01 Khóa", "hoá đơn số 6", ""]
    plain = spark.createDataFrame(rows, "x string").select(T.is_plain(F.col("x")).alias("p")).collect()
    assert [r.p for r in plain] == [False, False, False, False, False, True, False]
    blank = spark.createDataFrame([(" \t　\x1c",), ("",), (" a",), (None,)], "x string").select(T.is_blank(F.col("x")).alias("b")).collect()
    assert [r.b for r in blank] == [True, True, False, None]
