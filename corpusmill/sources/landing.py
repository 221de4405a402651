"""Landing of files, routing by type, and choice between native and OCR text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill import vocab
from corpusmill.functions.text import strip
from corpusmill.operators.numbering import dense_index

GRID_TYPES = [".xls", ".xlsx", ".csv"]


def landed_files(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Non-empty files below a folder: path, name, length, time, content."""
    reader = spark.readStream if stream else spark.read
    files = reader.format("binaryFile").option("recursiveFileLookup", "true")
    if stream:
        files = files.schema("path string, modificationTime timestamp, length long, content binary")
    return files.load(path).where("length > 0").withColumn("name", F.substring_index("path", "/", -1))


def landed_name(ts: Column, name: Column) -> Column:
    """Name of the stored file: time stamp and upload name."""
    return F.concat(F.date_format(ts, "yyyyMMddHHmmss"), F.lit("_"), name)


def accept_uploads(uploads: DataFrame) -> DataFrame:
    """Uploads ``(name, ts, length)`` that are not empty, with stored names."""
    return uploads.where("length > 0").withColumn("stored_name", landed_name(F.col("ts"), F.col("name")))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"[^.](\.[^./]*)\z", 1))


def route(name: Column) -> Column:
    """``grid`` for spreadsheets and CSV, else ``page``."""
    return F.when(extension(name).isin(*GRID_TYPES), "grid").otherwise("page")


def sheet_metadata(name: Column, issuer: Column | None = None) -> Column:
    """Struct of metadata a spreadsheet gets from its file name."""
    title = F.translate(F.replace(name, extension(name), F.lit("")), "_-", "  ")
    return F.struct(
        F.lit(vocab.SHEET_DOC_TYPE).alias("doc_type"),
        (issuer if issuer is not None else F.lit(vocab.UNKNOWN)).alias("issuer"),
        title.alias("title"),
    )


# One cell that is closed, and what a line ends in if a quote stays open.
_CLOSED = r'(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|(?!")[^,]*+)'
_OPENS = rf'\A(?:{_CLOSED},)*+"[^"]*+(?:""[^"]*+)*+\z'
_REST = r'[^"]*+(?:""[^"]*+)*+'


def _running(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Sum of ``value`` over the earlier lines of a file: inside a split by a window, the
    splits before it by one summary row each.
    """
    rows = rows.withColumn("_v", value)
    earlier = Window.partitionBy("_path").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_path", "_split").agg(F.sum("_v").alias("_s")).select(
        "_path", "_split", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_path", "_split").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn(name, F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    return summed.join(sums, ["_path", "_split"]).withColumn(name, F.col(name) + F.col("_before")).drop("_v", "_before")


def _composed(rows: DataFrame, keys: list[str], place: str) -> DataFrame:
    """(``_set``, ``_flips``) of the rows before each: what the last row that sets the state
    whatever it was sets it to, flips after it included, and all flips if none does.
    """
    before = Window.partitionBy(*keys).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.withColumn("_upto", F.sum(F.col("flips").cast("int")).over(upto))
    last = F.max(F.when(F.col("sets").isNotNull(), F.struct(place, "sets", "_upto"))).over(before)
    flips = F.coalesce(F.sum(F.col("flips").cast("int")).over(before), F.lit(0))
    odd = lambda n: n % 2 == 1
    placed = counted.withColumns({"_last": last, "_all": flips})
    return placed.withColumns({
        "_set": F.when(F.col("_last").isNotNull(), F.col("_last.sets") != odd(F.col("_all") - F.col("_last._upto"))),
        "_flips": odd(F.col("_all"))}).drop("_last", "_all", "_upto")


def quote_states(lines: DataFrame) -> DataFrame:
    """Lines ``(_path, _split, _place, line)`` with ``inside``: whether a quoted cell is open
    where the line begins.

    A quote opens a cell only at its start. So a line maps the state before it (in a cell, or
    not) to the one behind it, by two patterns: it keeps, flips or sets it. Such maps compose,
    in a split by a window and over splits by one summary row each. A quote that no later
    line of the file closes opens nothing.
    """
    line = F.col("line")
    from_out = line.rlike(_OPENS)
    from_in = line.rlike(rf'\A{_REST}\z') | F.regexp_replace(line, rf'\A{_REST}"[^,]*+(,|\z)', "$1").rlike(r'\A,') & F.regexp_replace(
        line, rf'\A{_REST}"[^,]*+,', "").rlike(_OPENS)
    rows = lines.withColumns({"_out": from_out, "_in": from_in}).withColumns({
        "sets": F.when(F.col("_out") == F.col("_in"), F.col("_out")), "flips": F.col("_out") & ~F.col("_in")})
    local = _composed(rows, ["_path", "_split"], "_place")
    ends = local.groupBy("_path", "_split").agg(F.max_by(F.struct("_set", "_flips", "sets", "flips"), "_place").alias("e"))
    whole = ends.select(
        "_path", "_split",
        F.when(F.col("e.sets").isNotNull(), F.col("e.sets")).otherwise(F.col("e._set") != F.col("e.flips")).alias("sets"),
        (F.col("e._flips") != F.col("e.flips")).alias("flips"))
    # a split that sets the state has its flips in what it sets
    whole = whole.withColumn("flips", F.when(F.col("sets").isNull(), F.col("flips")).otherwise(F.lit(False)))
    starts = _composed(whole, ["_path"], "_split").select(
        "_path", "_split", F.coalesce(F.col("_set"), F.col("_flips")).alias("_begins"))
    state = F.coalesce(F.col("_set"), F.col("_begins") != F.col("_flips"))
    known = local.join(starts, ["_path", "_split"]).withColumn("inside", state)
    opening = F.when(~F.col("inside") & F.col("_out"), F.struct("_split", "_place"))
    closing = F.when(F.col("inside") & ~F.col("_in") | ~F.col("inside") & ~F.col("_out"), F.struct("_split", "_place"))
    last = known.groupBy("_path").agg(F.max(opening).alias("_opened"), F.max(closing).alias("_closed"), F.max(F.struct("_split", "_place")).alias("_end"))
    # the last line that opens a cell, if no line behind it ends outside
    stray = F.when(F.col("_closed").isNull() | (F.col("_closed") < F.col("_opened")), F.col("_opened"))
    loose = last.select("_path", stray.alias("_stray"))
    fixed = F.when(F.col("_stray").isNotNull() & (F.struct("_split", "_place") > F.col("_stray")), F.lit(False)).otherwise(F.col("inside"))
    return known.join(loose, "_path").withColumn("inside", fixed).select("_path", "_split", "_place", "line", "inside")


def csv_cells(record: Column) -> Column:
    """All cells of one CSV record; quotes around a cell are taken off, empty cells are null."""
    cells = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(r',("[^"]*+(?:""[^"]*+)*+"[^,]*|[^,]*)'), F.lit(1))
    quoted = r'(?s)\A"([^"]*+(?:""[^"]*+)*+)"(.*)\z'
    bare = F.transform(cells, lambda c: F.when(c.rlike(quoted), F.concat(
        F.replace(F.regexp_extract(c, quoted, 1), F.lit('""'), F.lit('"')), F.regexp_extract(c, quoted, 2))).otherwise(c))
    return F.transform(bare, lambda c: F.nullif(c, F.lit("")))


def csv_grids(spark: SparkSession, path: str) -> DataFrame:
    """Cell grids ``(source, sheet, row_idx, cells)`` of headerless CSV files.

    Lines are read in parallel and stay so in large files: a record starts at each
    line where no quoted cell is open, so a quoted line break joins its
    lines. Rows keep all their cells, of whatever number; blank lines are no rows.
    Files of one name in different folders are files of their own.
    """
    lines = spark.read.text(path, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_place"),
        F.col("value").alias("line"),
    )
    start = (~F.col("inside")).cast("long")
    placed = _running(quote_states(lines), start, "_starts").withColumn("_record", F.col("_starts") + start)
    records = placed.groupBy("_path", "_record").agg(
        F.sort_array(F.collect_list(F.struct("_split", "_place", "line"))).alias("_lines"))
    records = records.select(
        "_path", "_record", F.array_join(F.transform("_lines", lambda x: x.line), "\n").alias("_text")).where("_text <> ''")
    numbered = dense_index(records, ["_path"], ["_record"], "n", 4096)
    return numbered.select(
        F.substring_index("_path", "/", -1).alias("source"), F.lit("csv").alias("sheet"), (F.col("n") - 1).alias("row_idx"), csv_cells(F.col("_text")).alias("cells"))


def text_profile(pages: DataFrame, min_chars: int = vocab.FIRST_PAGE_NATIVE_CHARS) -> DataFrame:
    """Per document: native text on the first page, and number of pages."""
    first = F.when(F.col("page") == 1, F.length(strip(F.coalesce("raw_text", F.lit("")))) >= min_chars)
    return pages.groupBy("doc_id").agg(
        F.coalesce(F.max(first), F.lit(False)).alias("has_native"), F.greatest(F.max("page"), F.lit(1)).alias("total_pages")
    )


def choose_text(native: DataFrame, recognised: DataFrame, profile: DataFrame) -> DataFrame:
    """Native pages of documents with native text, recognised pages of the rest."""
    has = profile.where("has_native").select("doc_id")
    return native.join(has, "doc_id", "left_semi").unionByName(recognised.join(has, "doc_id", "left_anti"))


def choose_tables(native: DataFrame, scanned: DataFrame) -> DataFrame:
    """Native table chunks; scanned ones of documents without any."""
    missing = scanned.join(native.select("doc_id").distinct(), "doc_id", "left_anti")
    return native.unionByName(missing, allowMissingColumns=True)


def salvage_json_array(text: Column) -> Column:
    """Elements (as JSON texts) of the right-most suffix that is a JSON list.

    Each suffix is parsed as the first of two elements. The second, a hash of the text,
    arrives there only if the suffix is one whole list: trailing text neither completes
    it nor is passed over.
    """
    strict = {"allowSingleQuotes": "false"}
    pieces = F.split(text, r"\[")
    count = F.size(pieces)
    end = F.sha2(text, 256)

    def suffix(k: Column) -> Column:
        return F.concat(F.lit("["), strip(F.array_join(F.slice(pieces, k + 1, count), "[")))

    def parsed(k: Column) -> Column:
        both = F.from_json(F.concat(F.lit("["), suffix(k), F.lit(',"'), end, F.lit('"]')), "array<string>", strict)
        whole = (F.size(both) == 2) & (F.get(both, F.lit(1)) == end)
        return F.when(whole, F.from_json(F.get(both, F.lit(0)), "array<string>", strict))

    places = F.when(count > 1, F.sequence(count - 1, F.lit(1), F.lit(-1)))
    found = F.filter(F.transform(places, parsed), lambda p: p.isNotNull())
    return F.coalesce(F.get(found, F.lit(0)), F.array().cast("array<string>"))
