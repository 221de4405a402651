"""Ingest of all kinds of files in one plan.

    grids ──────────────► sheet chunks ───────────────────┐
    native tables ┐                                       │
    scanned HTML ─┴► table chunks ──┬─────────────────────┤► dedupe ► number ► payload
                                    └► pages with a table │            (metadata, id, vector)
    native pages ┐                           │            │
    boxes ───────┴► chosen text ► clean ◄────┘ ► split ───┘
          └► first page ► metadata ───────────────────────────────────────┘

All branches meet under one order key: page, text before tables, place on the page. Sheets
have page 0 and the place of their sheet. The pages that hold a chosen table steer the cleaning
of the text branch, so tables are built and written first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill import vocab
from corpusmill.functions.metadata import merge_metadata, metadata_from_text
from corpusmill.functions.text import clean_text, fold, normalize_unicode, normalize_whitespace, strip
from corpusmill.operators.chunking import deduplicate, normalize_pages, number_chunks, point_id, split_pages
from corpusmill.operators.grids import sheet_chunks
from corpusmill.operators.ocr import reading_text
from corpusmill.operators.page_tables import scan_table_chunks, table_chunks
from corpusmill.operators.retrieval import embed
from corpusmill.session import written
from corpusmill.sources.landing import choose_tables, route, sheet_metadata, text_profile

META = list(vocab.META_DEFAULTS)


@dataclass(frozen=True)
class Extracts:
    """What the decoders give of the files, by ``doc_id``.

    ``pages`` (page, raw_text) of native text, ``boxes`` (page, x, y, text) of recognised
    text, ``tables`` (page, table_no, row_idx, cells) with lines, ``scans`` (page, table_no,
    html) of recognised tables, ``grids`` (sheet, row_idx, cells) of spreadsheets, and
    optionally ``model_metadata`` with some of the metadata fields.
    """

    pages: DataFrame
    boxes: DataFrame
    tables: DataFrame
    scans: DataFrame
    grids: DataFrame
    model_metadata: DataFrame | None = None


def choose_pages(pages: DataFrame, boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages with ``ocr_engine``, profile): native text of documents whose first page has
    enough of it, else the text of boxes in reading order.
    """
    profile = text_profile(pages)
    native = pages.select("doc_id", F.col("page").cast("long").alias("page"), "raw_text", F.lit("native_pdf").alias("ocr_engine"))
    read = reading_text(boxes).select("doc_id", F.col("page").cast("long").alias("page"), F.col("text").alias("raw_text"), F.lit("hybrid_ocr").alias("ocr_engine"))
    has = F.coalesce("has_native", F.lit(False))
    both = native.unionByName(read).join(profile.select("doc_id", "has_native"), "doc_id", "left")
    return both.where(has == (F.col("ocr_engine") == "native_pdf")).drop("has_native"), profile


def first_texts(chosen: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, first_text) that metadata is read from: the native first page if there is
    enough of it, else the first recognised page that holds words, else what the first
    native page has.
    """
    places = chosen.where((F.col("ocr_engine") == "native_pdf") & (F.col("page") == 1) | (F.col("ocr_engine") != "native_pdf") & (fold(F.col("raw_text")) != ""))
    best = places.groupBy("doc_id").agg(F.min_by(F.struct("raw_text", "ocr_engine"), "page").alias("best"))
    short = pages.where("page = 1").groupBy("doc_id").agg(F.min("raw_text").alias("short"))
    found = best.join(short, "doc_id", "full_outer")
    text = F.when(F.col("best.ocr_engine") == "native_pdf", strip(F.col("best.raw_text"))).otherwise(clean_text(F.col("best.raw_text")))
    return found.select("doc_id", F.coalesce(F.when(F.col("best").isNotNull(), text), strip(F.col("short")), F.lit("")).alias("first_text"))


def document_metadata(documents: DataFrame, first: DataFrame, model_metadata: DataFrame | None, issuer: Column | None) -> DataFrame:
    """Documents with ``kind`` and the metadata that each of their chunks gets.

    A spreadsheet's comes from its name. Other files merge the model's fields, if there are
    any, over those the rules find in the first text.
    """
    docs = documents.withColumn("kind", route(F.col("filename"))).join(first, "doc_id", "left")
    found = docs.withColumn("_rules", metadata_from_text(F.coalesce("first_text", F.lit(""))))
    primary: dict[str, Column] = {}
    if model_metadata is not None:
        fields = [c for c in META if c in model_metadata.columns]
        found = found.join(model_metadata.select("doc_id", *(F.col(c).alias(f"_model_{c}") for c in fields)), "doc_id", "left")
        primary = {c: F.col(f"_model_{c}") for c in fields}
    merged = merge_metadata(primary, {c: F.col(f"_rules.{c}") for c in META})
    sheet = sheet_metadata(F.col("filename"), issuer)
    sheet_fields = {c: sheet.getField(c) for c in ("doc_type", "issuer", "title")}
    is_grid = F.col("kind") == "grid"
    fields = {c: F.when(is_grid, sheet_fields[c] if c in sheet_fields else F.lit(None).cast("string")).otherwise(merged[c]) for c in META}
    return found.withColumns(fields).drop("_rules", "first_text", *(f"_model_{c}" for c in primary))


def _placed(chunks: DataFrame, kind: str, *place: Column) -> DataFrame:
    return chunks.withColumns({"_kind": F.lit(kind), "pos": F.array(*(p.cast("long") for p in place))})


def table_branch(tables: DataFrame, scans: DataFrame) -> DataFrame:
    """Chunks of native tables; of documents without any, those of scanned ones."""
    native = table_chunks(tables).withColumn("ocr_engine", F.lit("pdfplumber"))
    scanned = scan_table_chunks(scans).withColumns({"ocr_engine": F.lit("ppstructure"), "batch": F.lit(0).cast("long")})
    chosen = choose_tables(native, scanned).withColumns({"chunk_type": F.lit("table"), "page": F.col("page").cast("long")})
    return _placed(chosen, "page", F.col("table_no"), F.col("batch"), F.col("part")).drop("table_no", "batch", "part")


def sheet_branch(grids: DataFrame) -> DataFrame:
    """Sheet chunks at page 0, in the order of sheets: ``sheet_no``, if given, or their names."""
    order = "sheet_no" if "sheet_no" in grids.columns else "sheet"
    sheets = grids.groupBy("doc_id", "sheet").agg(F.min(order).alias("_order"))
    by_order = Window.partitionBy("doc_id").orderBy("_order", "sheet")
    numbers = sheets.select("doc_id", "sheet", F.row_number().over(by_order).alias("_sheet_no"))
    chunks = sheet_chunks(grids.drop("sheet_no")).join(numbers, ["doc_id", "sheet"])
    placed = _placed(chunks.withColumns({"page": F.lit(0).cast("long"), "chunk_type": F.lit("table")}), "grid", F.col("_sheet_no"), F.col("batch"))
    return placed.withColumnRenamed("sheet", "sheet_name").drop("_sheet_no", "batch")


def ingest_all(
    documents: DataFrame, extracts: Extracts, encoder=None, dim: int = 64, issuer: Column | None = None, **split_options
) -> DataFrame:
    """Payload rows of all files: chunks with order, label, id, metadata, and vector if an
    encoder is given.

    ``documents`` holds ``doc_id, filename, version, access_scope, target_id``; the name routes
    a file to the grid or the page branch, and extracts of the other branch don't count.
    A file without any chunk gives no row. The table branch and the deduplicated chunks
    are written to the shared folder, as each is read twice.
    """
    tables = written(table_branch(extracts.tables, extracts.scans), "ingest-tables")
    chosen, profile = choose_pages(extracts.pages, extracts.boxes)
    chosen = written(chosen, "ingest-pages")
    text = split_pages(normalize_pages(chosen, tables), **split_options)
    text = _placed(text, "page", F.col("pos"))
    meta = document_metadata(documents, first_texts(chosen, extracts.pages), extracts.model_metadata, issuer)
    chunks = text.unionByName(tables, allowMissingColumns=True).unionByName(sheet_branch(extracts.grids), allowMissingColumns=True)
    kinds = documents.select("doc_id", route(F.col("filename")).alias("_kind"))
    unique = written(deduplicate(chunks.join(kinds, ["doc_id", "_kind"], "left_semi")), "ingest-chunks")
    totals = profile.select("doc_id", F.col("total_pages").alias("doc_total_pages"))
    numbered = number_chunks(unique, totals).drop("_kind", "pos")
    fields = [*META, "version", "access_scope", "target_id", "kind", F.col("filename").alias("source")]
    out = numbered.join(meta.select("doc_id", *fields), "doc_id")
    is_grid = F.col("kind") == "grid"
    tidy = {c: F.when(F.col(c).isNotNull(), normalize_whitespace(normalize_unicode(F.col(c)))) for c in META}
    payload = out.withColumns(tidy).withColumns({
        "doc_total_pages": F.when(is_grid, 1).otherwise(F.coalesce("doc_total_pages", F.lit(1))).cast("long"),
        "chunk_type": F.when(~is_grid, F.col("chunk_type")),
        "page": F.when(~is_grid, F.col("page")),
        "content_folded": fold(F.col("content")),
        "is_active": F.lit(True),
        "chunk_uid": point_id(F.col("doc_id"), F.col("version"), F.col("chunk_id"), F.col("content")),
    }).drop("kind")
    return payload if encoder is None else embed(payload, "content", encoder, dim)
