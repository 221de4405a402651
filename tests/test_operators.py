"""Operators on small tables, against brute force or worked-out results."""

import random

import numpy as np
from pyspark.sql import functions as F

from corpusmill.operators import chunking as C
from corpusmill.operators import extraction as A
from corpusmill.operators import numbering as N
from corpusmill.operators import ocr as O
from corpusmill.operators import page_tables as P
from corpusmill.operators import ranking as K
from corpusmill.operators import retrieval as R
from corpusmill.operators import versions as V
from corpusmill.session import shared_folder
from corpusmill.sources import sinks
from corpusmill.streaming import versions as SV
from corpusmill.streaming.memory import stream_memory


def test_numbering_across_blocks(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else f"k{i % 3}", i * 3, None if i % 4 else f"v{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "k string, o bigint, v string").repartition(5)
    got = {(r.k, r.o): r for r in N.fill_forward(N.dense_index(df, ["k"], ["o"], "n", 16), ["k"], ["o"], "v", "f", 16).collect()}
    near = {(r.k, r.o): [x.o for x in r.b] for r in N.neighbours(
        N.dense_index(df, ["k"], ["o"], "n", 16), ["k"], "n", 3, ["o"], "b", 8).collect()}
    for key in {r[0] for r in rows}:
        last, seen = None, []
        for n, (_, o, v) in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: r[1]), start=1):
            last = v or last
            assert (got[key, o].n, got[key, o].f) == (n, last)
            assert near[key, o] == seen[-3:]
            seen.append(o)


def test_pack_table_keeps_header(spark):
    md = "\n".join(["| h |", "|---|"] + [str(i) * 700 for i in range(3)])
    parts = spark.createDataFrame([(md,)], "m string").select(P.pack_table(F.col("m")).alias("p")).first().p
    assert [p.split("\n")[:2] for p in parts] == [["| h |", "|---|"]] * 3


def test_pack_table_matches_greedy(spark):
    rng = random.Random(3)
    lines = ["| a |", "|---|"] + ["x" * rng.randint(1, 500) for _ in range(60)]
    parts = spark.createDataFrame([("\n".join(lines),)], "m string").select(P.pack_table(F.col("m")).alias("p")).first().p
    expected, open_lines = [], []
    for line in lines[2:]:
        if open_lines and len("\n".join(lines[:2] + open_lines + [line])) > 1200:
            expected.append("\n".join(lines[:2] + open_lines))
            open_lines = []
        open_lines.append(line)
    assert parts == expected + ["\n".join(lines[:2] + open_lines)]


def test_reading_lines_use_the_anchor(spark):
    boxes = spark.createDataFrame([(1, 1, 0, y, f"w{y}") for y in (0, 15, 30)], "doc_id int, page int, x int, y int, text string")
    assert sorted(r.line for r in O.reading_lines(boxes).collect()) == ["w0 w15", "w30"]


def test_split_text():
    text = "Điều 1 " + "a " * 300 + "\nĐiều 2 " + "b " * 500 + "\nĐiều 3 c"
    parts = C.split_text(text)
    assert all(len(p) <= 850 for p in parts)
    assert parts[0].startswith("Điều 1") and any(p.startswith("Điều 2") for p in parts)
    assert C.split_text("short") == ["short"] and C.split_text("x" * 2000)[1][:120] == "x" * 120
    assert "".join(C.split_text("abcdefghij", 4, 0, [""])) == "abcdefghij"


def test_versions(spark):
    uploads = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "a")], "id bigint, filename string")
    got = {r.id: (r.version, r.parent_id, r.is_active) for r in V.version_log(uploads, size=2).collect()}
    assert got == {1: (1, None, False), 2: (2, 1, False), 3: (1, None, True), 4: (3, 2, True)}


def test_semantic_search_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(300, 8)).round(2)
    vectors[50:80] = vectors[7]  # a group of equal copies
    asked = rng.normal(size=(5, 8))
    chunks = spark.createDataFrame([(f"{i:04d}", v.tolist()) for i, v in enumerate(vectors)], "chunk_uid string, embedding array<double>").repartition(4)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)] + [(9, [0.0] * 8)], "query_id int, vector array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = unit(asked) @ unit(vectors).T
    for bound in (R.BROADCAST_BYTES, 0):
        hits = R.semantic_search(chunks, queries, 10, bound).collect()
        for q in range(5):
            got = sorted((h.rank, round(h.score, 9)) for h in hits if h.query_id == q)
            assert got == [(i + 1, round(s, 9)) for i, s in enumerate(sorted(scores[q], reverse=True)[:10])]
        assert not [h for h in hits if h.query_id == 9]


def test_keyword_score(spark):
    df = spark.createDataFrame([(["a", "zz"], "xx A"), (["a", "x"], "xx A")], "k array<string>, c string")
    assert [round(r.s, 3) for r in df.select(R.keyword_score(F.col("k"), F.col("c")).alias("s")).collect()] == [0.875, 0.95]


HIT = ("query_id int, query string, intent string, chunk_uid string, doc_id int, chunk_id string, title string, doc_number string,"
       " date string, issuer string, source string, content string, content_type string, chunk_type string, score double, rank int")


def hits(spark, rows):
    base = dict(query_id=1, query="q", intent="general", title="t", doc_number=None, date=None, issuer=None,
                source="s", content="some words that are long enough to stay here", content_type="text", chunk_type="text")
    full = [{**base, "chunk_uid": f"u{i}", "doc_id": 1, "chunk_id": f"chunk_{i}", "score": 0.9, "rank": i, **r} for i, r in enumerate(rows, 1)]
    return spark.createDataFrame(full, HIT)


def test_adaptive_threshold(spark):
    low = K.filter_results(hits(spark, [{"score": s} for s in (0.4, 0.3, 0.2)]))
    high = K.filter_results(hits(spark, [{"score": s} for s in (0.9, 0.5, 0.4)]))
    assert low.count() == 2 and high.count() == 2


def test_single_year_does_not_filter(spark):
    rows = [{"query": "năm 2025", "content": f"text of year {y} that is long"} for y in (2025, 2023)]
    assert K.explicit_year_filter(hits(spark, rows)).count() == 2
    rows = [{"query": "năm học 2024-2025", "content": f"text of year {y} that is long"} for y in ("2024-2025", "2024")]
    assert [r.chunk_uid for r in K.explicit_year_filter(hits(spark, rows)).collect()] == ["u1"]


def test_context_stops_at_the_limit(spark):
    rows = [{"content": "x" * 1996} for _ in range(10)]
    parts = K.context_parts(hits(spark, rows)).orderBy("ord").collect()
    assert len(parts) == 8 and {len(p.part) for p in parts} == {len("[Văn bản: t]\n") + 1996}


def test_grounding(spark):
    df = spark.createDataFrame([("Sinh viên 1111111111 có điểm tốt\nkhác 2222222222", "ctx 1111111111"), ("2222222222", "ctx")], "a string, c string")
    got = [r.g for r in df.select(A.grounded(F.col("a"), F.col("c")).alias("g")).collect()]
    assert got[0] == "Sinh viên 1111111111 có điểm tốt" and got[1].startswith("2222222222\n\n⚠️")


def test_sections_and_outline(spark):
    context = "[Văn bản: T]\nĐối tượng nộp:\n- một điều dài\n- một điều dài\n- hai\nThời gian nộp:\nba\n\n| A | B |\n|---|---|\n| x | 1.000 |\n| y | z |"
    df = spark.createDataFrame([(1, "noi dung hoc phi can nop trong thoi gian nao cua cac doi tuong", context)], "query_id int, query string, context string")
    sections = {r.title: r["items"] for r in A.generic_sections(df).collect()}
    assert sections == {"Đối tượng nộp": ["một điều dài", "hai"], "Thời gian nộp": ["ba"]}
    tables = A.money_tables(df).collect()
    assert [(t["headers"], t["rows"]) for t in tables] == [(["A", "B"], [["x", "1.000"]])]
    outline = A.outlines(df).first().outline
    assert outline.startswith("**Văn bản: T**\n\n**Nội dung chính theo yêu cầu:**")
    assert "**Thời gian nộp:**\n- ba" in outline and outline.endswith("| A | B |\n| --- | --- |\n| x | 1.000 |")


def test_store_is_idempotent(spark):
    path = shared_folder(spark, "store")
    rows = spark.createDataFrame([(f"u{i}", i % 3, f"c{i}") for i in range(20)], "chunk_uid string, doc_id bigint, content string")
    for _ in range(2):
        sinks.write_chunks(spark, rows, path, 4)
    assert spark.read.parquet(path).count() == 20


def test_stream_memory_continues_between_runs(spark):
    base = shared_folder(spark, "memory")
    schema = "session_id string, turn bigint, query string, answer string"
    out = []
    for part in (range(0, 5), range(5, 9)):
        spark.createDataFrame([("s", t, f"q{t}", f"a{t}") for t in part], schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        run = (stream_memory(spark.readStream.schema(schema).parquet(f"{base}/in")).writeStream.format("parquet")
               .option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start())
        run.awaitTermination()
        out = {r.turn: r for r in spark.read.parquet(f"{base}/out").collect()}
    assert out[8].turn_count == 9 and out[7].recent == "User: q6\nBot: a6\nUser: q7\nBot: a7"
    assert out[8].summary.count(" | ") == 1 and out[2].summary == ""


def test_stream_versions_and_compaction(spark):
    """Upload, re-upload, delete, upload in four batches; compaction leaves no replaced chunk on disk."""
    base = shared_folder(spark, "versions")
    steps = [[("f", 1, "upload", 10), ("g", 2, "upload", 20)], [("f", 3, "upload", 11)],
             [("f", 4, "delete", 11), ("g", 5, "delete", 20), ("g", 6, "restore", 20)], [("f", 7, "upload", 12), ("g", 9, "upload", 22), ("g", 8, "upload", 21)]]
    for n, step in enumerate(steps):
        spark.createDataFrame(step, SV.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/events")
        SV.start_versions(spark.readStream.schema(SV.EVENT_SCHEMA).parquet(f"{base}/events"), base, f"{base}/cp").awaitTermination()
        uploads = [(e[3], f"u{e[3]}", "text") for e in step if e[2] == "upload"]
        sinks.write_chunks(spark, spark.createDataFrame(uploads, "doc_id bigint, chunk_uid string, content string"), f"{base}/chunks", 2, n)
    columns = ["filename", "seq", "id", "version", "parent_id"]
    batch = V.version_log_with_deletes(spark.createDataFrame(sum(steps, []), SV.EVENT_SCHEMA)).select(columns)
    got = sorted(map(tuple, SV.read_versions(spark, base).select(columns).collect()))
    assert got == sorted(map(tuple, batch.collect()))
    assert [(r[2], r[3], r[4]) for r in got if r[0] == "f"] == [(10, 1, None), (11, 2, 10), (12, 1, None)]
    SV.compact_store(spark, base, f"{base}/new", 2)
    assert {r.doc_id for r in spark.read.parquet(f"{base}/new/chunks").collect()} == {11, 12, 22}


def test_skewed_keyword_search(spark):
    """A word in most chunks still gives the first chunks, in both plans."""
    rows = [(f"{i:05d}", "common" + (" rare" if i % 50 == 0 else ""), "t", "common") for i in range(500)]
    chunks = spark.createDataFrame(rows, "chunk_uid string, content string, title string, content_folded string").repartition(6)
    queries = spark.createDataFrame([(1, ["common"]), (2, ["rare common"])], "query_id int, keywords array<string>")
    for bound in (R.BROADCAST_BYTES, 0):
        got = R.keyword_search(chunks, queries, 20, broadcast_bytes=bound).collect()
        assert sorted(h.chunk_uid for h in got if h.query_id == 1) == [f"{i:05d}" for i in range(20)]
        assert sorted(h.chunk_uid for h in got if h.query_id == 2) == [f"{i:05d}" for i in range(0, 500, 50)]
