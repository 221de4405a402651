"""Landing, salvage, HTML tables and ingest with tables, on small fixtures."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import chunking as C
from corpusmill.operators import page_tables as P
from corpusmill.session import shared_folder
from corpusmill.sources import landing as L
from corpusmill.sources import sinks
from corpusmill.streaming.ingest import current_chunks


def test_landed_files_skip_empty(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.pdf").write_bytes(b"123")
    (tmp_path / "empty.pdf").write_bytes(b"")
    assert [(r.name, r.length, bytes(r.content)) for r in L.landed_files(spark, str(tmp_path)).collect()] == [("x.pdf", 3, b"123")]


def test_csv_keeps_cells_and_quoted_breaks(spark, tmp_path):
    (tmp_path / "one.csv").write_text('1,2,3,4\n"a\nb, ""c""",,x\n\nlast\n')
    (tmp_path / "two.csv").write_text(',"",z\n')
    got = {(r.source, r.row_idx): r.cells for r in L.csv_grids(spark, str(tmp_path)).collect()}
    assert got == {
        ("one.csv", 0): ["1", "2", "3", "4"],
        ("one.csv", 1): ['a\nb, "c"', None, "x"],
        ("one.csv", 2): ["last"],
        ("two.csv", 0): [None, None, "z"],
    }


def _python_rows(text):
    """Records of a text by a plain scan: a quote opens at the start of a cell only."""
    lines, at, out = text.split("\n"), 0, []

    def is_open(record):
        while record:
            quoted = re.match(r'"[^"]*+(?:""[^"]*+)*+"[^,]*(,|$)', record, re.S)
            if record[0] == '"' and not quoted:
                return True
            cell = quoted or re.match("[^,]*(,|$)", record, re.S)
            record = record[cell.end():]
        return False

    while at < len(lines):
        end = next((e for e in range(at + 1, len(lines) + 1) if not is_open("\n".join(lines[at:e]))), at + 1)
        out.append("\n".join(lines[at:end]))
        at = end
    return [x for x in out if x]


def test_quotes_open_at_the_start_of_a_cell_only(spark, tmp_path):
    (tmp_path / "a.csv").write_text('1,5" pipe,x\n2,b,y\n3,c,z\n4,7" rod,w\n5,e,v\n')
    (tmp_path / "b.csv").write_text('1,a\n2,"never closed,b\n3,"" c\n4,d\n')
    got = [[r.cells for r in L.csv_grids(spark, str(tmp_path / f)).orderBy("row_idx").collect()] for f in ("a.csv", "b.csv")]
    assert got[0] == [["1", '5" pipe', "x"], ["2", "b", "y"], ["3", "c", "z"], ["4", '7" rod', "w"], ["5", "e", "v"]]
    assert got[1] == [["1", "a"], ["2", "\"never closed", "b"], ["3", " c"], ["4", "d"]]


@pytest.mark.parametrize("split", ["1g", "64"])
def test_records_do_not_depend_on_splits(spark, tmp_path, split):
    r = random.Random(9)
    names = []
    for k in range(12):
        text = "\n".join(",".join(r.choice(["a", "", '"b"', '"c', 'd"', 'e"f', '""', '"g""h"', '"""', "i"]) for _ in range(r.randint(1, 4))) for _ in range(40))
        (tmp_path / f"{k}.csv").write_text(text + "\n")
        names.append((f"{k}.csv", text))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = L.csv_grids(spark, str(tmp_path)).groupBy("source").agg(F.count("*").alias("n")).collect()
        lines = spark.read.text(str(tmp_path)).select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_split"),
                                                     F.monotonically_increasing_id().alias("_place"), F.col("value").alias("line"))
        assert split == "1g" or lines.select("_path", "_split").distinct().count() > 24
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {x.source: x.n for x in got} == {name: len(_python_rows(text)) for name, text in names}


def test_salvage_takes_whole_lists_only(spark):
    cases = {
        't {"k":[1], "n": 2': [],
        """log [{"text":"a"}] ['x']""": [],
        'log [x] [{"text": "a [b]"}, 2] ': ['{"text": "a [b]"}', "2"],
        "[1], 2]": [],
        "[1]]": [],
        "[]": [],
        "": [],
        None: [],
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", L.salvage_json_array(F.col("t")).alias("x")).collect()
    compact = {r.t: [x.replace(" ", "") for x in r.x] for r in rows}
    assert compact == {t: [x.replace(" ", "") for x in want] for t, want in cases.items()}


def test_html_tables_with_open_tags_and_entities(spark):
    html = "<table><tr><th>A<th>B</tr><tr><td>&agrave;&#233;&#x1EBF;</td><td>R&amp;D &lt;x&gt; &unknown; &nbsp;y<tr><td>1<td>2</table> end"
    md = spark.createDataFrame([(html,)], "h string").select(P.html_table_markdown(F.col("h")).alias("m")).first().m
    assert md == "| A | B |\n|---|---|\n| àéế | R&D <x> &unknown; y |\n| 1 | 2 |"


def test_html_is_read_as_a_parser_reads_it(spark):
    cases = {
        "<table><tr><td>&abreve; &dstrok; R&amp D &notit; &#x80;</td></tr></table>": "| ă đ R& D ¬it; € |\n|---|",
        "<table><tr><td>out<table><tr><td>in</td></tr></table></td><td>b</td></tr></table>": "| out in | in | b |\n|---|---|---|\n| in |",
        "<table><tr><!-- <td>no</td> --><td>a</td></tr></table>": "| a |\n|---|",
        '<table><tr><td title="a>b" data-x=\'c>d\'>x</td></tr></table>': "| x |\n|---|",
        "<TABLE><TR><TD>a<TD>b<TR><TD>c": "| a | b |\n|---|---|\n| c |",
        "<tr><td>no table</td>": "| no table |\n|---|", "plain": "", "": "",
    }
    rows = spark.createDataFrame([(h,) for h in cases], "h string").select("h", P.html_table_markdown(F.col("h")).alias("m")).collect()
    assert {r.h: r.m for r in rows} == cases


def test_store_keeps_latest_batch_and_compacts(spark):
    path, target = shared_folder(spark, "store"), shared_folder(spark, "store")
    schema = "chunk_uid string, doc_id bigint, content string"
    sinks.write_chunks(spark, spark.createDataFrame([("a", 1, "old"), ("b", 2, "old")], schema), path, 4)
    for _ in range(2):
        sinks.write_chunks(spark, spark.createDataFrame([("a", 1, "new"), ("c", 1, "new")], schema), path, 4, batch=1)
    sinks.compact_chunks(spark, path, target, 4)
    sinks.write_chunks(spark, spark.createDataFrame([("b", 2, "newest")], schema), target, 4, batch=2)
    read = [{r.chunk_uid: r.content for r in sinks.read_chunks(spark, p).collect()} for p in (path, target)]
    assert read == [{"a": "new", "b": "old", "c": "new"}, {"a": "new", "b": "newest", "c": "new"}]


def test_replaced_versions_leave_the_current_chunks(spark):
    store = shared_folder(spark, "ingest")
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "chunk_uid string, doc_id bigint")
    sinks.write_chunks(spark, rows, f"{store}/chunks", 4)
    log = spark.createDataFrame([(1, None), (2, 1), (3, None)], "doc_id bigint, parent_id bigint")
    assert sorted(r.doc_id for r in current_chunks(spark, store, log).collect()) == [2, 3]


def test_ingest_orders_tables_after_text(spark):
    text = "Quy định về thời gian đào tạo của sinh viên hệ chính quy trong năm học mới."
    pages = spark.createDataFrame([(1, 1, text), (1, 2, text + " Trang hai.")], "doc_id long, page long, raw_text string")
    documents = spark.createDataFrame([(1, 1, "public", None)], "doc_id long, version long, access_scope string, target_id string")
    tables = spark.createDataFrame(
        [(1, 1, 10, 0, 0, "| z | ten |"), (1, 1, 2, 1, 0, "| y | second |"), (1, 1, 2, 0, 1, "| b | part |"), (1, 1, 2, 0, 0, "| x | first |")],
        "doc_id long, page long, table_no long, batch long, part int, content string",
    ).withColumn("content_type", F.lit("table_md"))
    rows = C.ingest(pages, documents, tables).orderBy("chunk_order").collect()
    assert [r.chunk_type for r in rows] == ["text", "table", "table", "table", "table", "text"]
    assert [r.content for r in rows[1:5]] == ["| x | first |", "| b | part |", "| y | second |", "| z | ten |"]
    assert [r.chunk_id for r in rows] == [f"chunk_{i}" for i in range(1, 7)]


def test_reset_store_holds_only_later_batches(spark, tmp_path):
    from corpusmill.sources import sinks

    path = str(tmp_path / "store")
    rows = lambda *ids: spark.createDataFrame([(i, 1) for i in ids], "chunk_uid string, doc_id long")
    sinks.write_chunks(spark, rows("a", "b"), path, 2)
    sinks.write_chunks(spark, rows("c"), path, 2, batch=1)
    sinks.reset_chunks(spark, path)
    sinks.write_chunks(spark, rows("d"), path, 2, batch=2)
    assert [r.chunk_uid for r in sinks.read_chunks(spark, path).collect()] == ["d"]
