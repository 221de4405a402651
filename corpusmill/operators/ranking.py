"""Filtering, re-ranking and context assembly of search hits.

``hits`` hold one row per query and hit: ``query_id, query, chunk_uid, doc_id,
chunk_id, title, doc_number, date, issuer, source, content, content_type,
chunk_type, score, rank``. The search limit bounds the hits of a query, so the
windows per query below work on a few dozen rows each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill import vocab
from corpusmill.functions.text import contains_any, fold_query, let, nfc, normalize_query, strip, strip_tags, text_or_empty
from corpusmill.operators.numbering import first_per_key


def _per_query():
    """Window over the (bounded) rows of a query."""
    return Window.partitionBy("query_id")


# --- years and topics -------------------------------------------------------
def years(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit("(?U)" + vocab.YEAR), F.lit(0))
    return F.array_distinct(F.transform(found, lambda y: y.cast("int")))


def year_ranges(text: Column) -> Column:
    """Distinct (lo, hi) pairs of years joined by a dash or slash."""
    pattern = F.lit("(?U)" + vocab.YEAR_RANGE)
    pairs = F.zip_with(
        F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2)),
        lambda a, b: F.struct(
            F.least(a.cast("int"), b.cast("int")).alias("lo"), F.greatest(a.cast("int"), b.cast("int")).alias("hi")
        ),
    )
    return F.array_distinct(pairs)


def topic_terms(query: Column) -> Column:
    """Up to five topic terms of a query."""
    terms = F.array(*[F.lit(t) for t in vocab.TOPIC_TERMS])
    return let(F.lower(normalize_query(query)), lambda q: F.slice(F.filter(terms, lambda t: F.contains(q, t)), 1, 5))


def topic_matches(text: Column, terms: Column) -> Column:
    """Any folded term within the folded text; no terms match everything."""
    folded_terms = F.filter(F.transform(terms, fold_query), lambda t: t != "")
    hit = let(fold_query(text), lambda x: F.exists(folded_terms, lambda t: F.contains(x, t)))
    return (F.size(terms) == 0) | hit


def _joined(*columns: str) -> Column:
    return F.concat_ws(" ", *[text_or_empty(F.col(c)) for c in columns])


def _shown(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("None"))


# --- thresholds and garbage -------------------------------------------------
def _count_of(text: Column, needle: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)


def is_empty_table(content: Column) -> Column:
    """More than 40 % of the HTML cells are empty."""
    cells = _count_of(content, "<td")
    return (cells > 0) & (_count_of(content, "<td></td>") / F.greatest(cells, F.lit(1)) > 0.4)


def is_garbage(content: Column, content_type: Column) -> Column:
    visible = strip_tags(F.translate(F.regexp_replace(content, "<[^>]+>", " "), "|", " "))
    short = content_type.isin(*vocab.TABLE_TYPES) & (F.length(visible) < 50)
    return F.coalesce(is_empty_table(content) | short, F.lit(False))


def filter_results(hits: DataFrame) -> DataFrame:
    """Hits above the query's adaptive threshold, without garbage chunks.

    A ``strategy`` column, if present, lets keyword hits pass without scores.
    """
    best = F.coalesce(F.max("score").over(_per_query()), F.lit(0.0))
    best = F.greatest(best, F.lit(0.0))
    by_keyword = F.col("strategy") == "keyword" if "strategy" in hits.columns else F.lit(False)
    threshold = F.when(F.col("_best") < 0.5, F.col("_best") * 0.7).otherwise(0.45)
    return (
        hits.withColumn("_best", best)
        .where((F.col("_best") > 1e-9) | by_keyword)
        .where(F.coalesce("score", F.lit(0.0)) >= threshold)
        .where(~is_garbage(F.col("content"), F.col("content_type")))
        .drop("_best")
    )


# --- heuristic re-ranking ---------------------------------------------------
def _query_group(query: Column) -> Column:
    return F.coalesce(*[F.when(contains_any(query, terms), F.lit(name)) for name, terms in vocab.QUERY_GROUPS])


def _title_bonus(query: Column, title: Column) -> Column:
    group = _query_group(query)
    marks = F.array(*[
        F.when(contains_any(title, terms), F.lit(name)) for name, terms in vocab.TITLE_GROUPS.items()
    ])

    def bonus(found: Column) -> Column:
        return (
            F.when(F.array_contains(found, group), 0.20).when(F.size(found) > 0, -0.10).otherwise(0.0)
        )

    scored = let(F.filter(marks, lambda m: m.isNotNull()), bonus)
    return F.when((title != "") & (query != "") & group.isNotNull(), scored).otherwise(0.0)


def _year_bonus(as_of_year: int) -> Column:
    q_years, q_ranges = F.col("_qy"), F.col("_qr")
    d_years, d_ranges = F.col("_dy"), F.col("_dr")
    newest = F.array_max(d_years)
    return (
        F.when(
            (F.size(q_ranges) > 0) & (F.size(d_ranges) > 0),
            F.when(F.arrays_overlap(q_ranges, d_ranges), 0.35)
            .when(F.arrays_overlap(q_years, d_years), -0.10).otherwise(-0.30),
        )
        .when(
            (F.size(q_years) > 0) & (F.size(d_years) > 0),
            F.when(F.arrays_overlap(q_years, d_years), 0.25).otherwise(-0.25),
        )
        .when(F.size(q_years) > 0, -0.05)
        .when(newest.isNull(), 0.0)
        .when(newest >= as_of_year, 0.15)
        .when(newest == as_of_year - 1, 0.05)
        .otherwise(-0.10)
    )


def _semester_bonus(query: Column, content: Column) -> Column:
    asked = [contains_any(query, terms) for _, terms in vocab.SEMESTERS]
    holds = [contains_any(content, terms) for _, terms in vocab.SEMESTERS]

    def plus_minus(own: Column, other: Column) -> Column:
        return F.when(own, 0.15).otherwise(0.0) - F.when(other, 0.10).otherwise(0.0)

    return (
        F.when(asked[0], plus_minus(holds[0], holds[1]))
        .when(asked[1], plus_minus(holds[1], holds[0]))
        .when(asked[2], plus_minus(holds[2], holds[0]))
        .when(holds[2], 0.015).when(holds[1], 0.010).when(holds[0], 0.005).otherwise(0.0)
    )


def rank_scores(
    hits: DataFrame, as_of_year: int, preferred_types: list[str] | None = None, time_filter: str | None = None,
    columns: list[str] | None = None, keywords: list[str] | None = None,
) -> DataFrame:
    """Add ``rank_score``; the search score itself is not changed."""
    content = F.col("_content")
    out = hits.withColumns({
        "_query": F.lower(nfc(text_or_empty(F.col("query")))),
        "_title": F.lower(text_or_empty(F.col("title"))),
        "_content": F.lower(text_or_empty(F.col("content"))),
    })
    text = F.concat_ws(" ", text_or_empty(F.col("title")), content)
    dated = F.concat_ws(" ", _shown("date"), text)
    out = out.withColumns({
        "_qy": years(F.col("_query")), "_qr": year_ranges(F.col("_query")),
        "_dy": years(dated), "_dr": year_ranges(dated),
    })
    score = F.coalesce("score", F.lit(0.5))
    if preferred_types:
        score = score + F.when(F.col("chunk_type").isin(*preferred_types), 0.3 / len(preferred_types)).otherwise(0.0)
    if time_filter and "time_info" in hits.columns:
        score = score + F.when(F.col("time_info").contains(time_filter), 0.2).otherwise(0.0)
    for terms, weight in ((columns, 0.15), (keywords, 0.05)):
        if terms:
            found = sum((content.contains(x.lower()).cast("int") for x in terms), F.lit(0))
            score = score + weight * found / len(terms)
    score = (
        score + _title_bonus(F.col("_query"), F.col("_title")) + _year_bonus(as_of_year)
        + _semester_bonus(F.col("_query"), content)
    )
    return out.withColumn("rank_score", score).drop("_query", "_title", "_content", "_qy", "_qr", "_dy", "_dr")


def rerank(hits: DataFrame, as_of_year: int, **options) -> DataFrame:
    """New ``rank`` by descending ``rank_score``, ties in the former order."""
    scored = rank_scores(hits, as_of_year, **options)
    order = _per_query().orderBy(F.desc(F.round("rank_score", 9)), "rank", "chunk_uid")
    return scored.withColumn("rank", F.row_number().over(order))


# --- year cascade and topic guard -------------------------------------------
def explicit_year_filter(hits: DataFrame) -> DataFrame:
    """Keep the best year class: same range, all years, some years.

    With topic terms, classes count on-topic hits only; without any such hit
    everything stays. A single year never filters, as a full match is no
    partial one.
    """
    q = normalize_query(F.col("query"))
    text = F.concat_ws(" ", text_or_empty(F.col("title")), _shown("date"), text_or_empty(F.col("source")), text_or_empty(F.col("content")))
    out = hits.withColumn("_q", q).withColumns({"_qy": years(F.col("_q")), "_qr": year_ranges(F.col("_q"))}).drop("_q")
    # Hits of other queries all stay, so their texts are not looked at.
    several = (F.size("_qr") > 0) | (F.size("_qy") >= 2)
    out = out.withColumns({
        "_terms": F.when(several, topic_terms(F.col("query"))), "_text": F.when(several, text),
    }).withColumns({"_hy": F.when(several, years(F.col("_text"))), "_hr": F.when(several, year_ranges(F.col("_text")))}).drop("_text")
    year_class = (
        F.when(F.arrays_overlap("_qr", "_hr"), 1)
        .when((F.size("_hy") > 0) & (F.size(F.array_except("_qy", "_hy")) == 0), 2)
        .when(F.arrays_overlap("_qy", "_hy"), 3)
    )
    on_topic = topic_matches(_joined("title", "source", "content"), F.col("_terms"))
    out = out.withColumn("_class", F.when(several, F.when(on_topic & (F.size("_qy") > 0), year_class)))
    usable = F.when(F.size("_qr") > 0, F.col("_class")).when(
        F.col("_class") == 1, F.lit(None)).otherwise(F.col("_class"))
    best = F.min(usable).over(_per_query())
    return (
        out.withColumn("_best", F.when(several, best))
        .where(F.col("_best").isNull() | (F.coalesce(usable, F.lit(0)) == F.col("_best")))
        .drop("_qy", "_qr", "_hy", "_hr", "_terms", "_class", "_best")
    )


def topic_guard(hits: DataFrame) -> DataFrame:
    """On-topic hits; without any, all of them, or none for a strict topic."""
    out = hits.withColumns({
        "_terms": topic_terms(F.col("query")),
        "_strict": contains_any(F.lower(normalize_query(F.col("query"))), vocab.STRICT_TOPICS),
    }).withColumn("_on", topic_matches(_joined("title", "source", "content"), F.col("_terms")))
    return (
        out.withColumn("_any", F.bool_or("_on").over(_per_query()))
        .where(F.col("_on") | (~F.col("_any") & ~F.col("_strict")))
        .drop("_terms", "_strict", "_on", "_any")
    )


# --- top k, expansion, focus, fallback --------------------------------------
def top_k(hits: DataFrame) -> DataFrame:
    """8 hits for documents and regulations, else 6, by ``rank``."""
    place = F.row_number().over(_per_query().orderBy("rank", "chunk_uid"))
    limit = F.when(F.col("intent").isin("document_info", "regulation"), 8).otherwise(6)
    return hits.withColumn("rank", place).where("rank <= 8").where(F.col("rank") <= limit)


def chunk_number(chunk_id: Column) -> Column:
    """Trailing number of a chunk label; labels without one come last."""
    digits = F.nullif(F.regexp_extract(chunk_id, r"(\d+)\z", 1), F.lit(""))
    return F.coalesce(digits.cast("bigint"), F.lit(10**9).cast("bigint"))


def scroll_by_document(chunks: DataFrame, limit: int = vocab.SCROLL_LIMIT) -> DataFrame:
    """First active chunks of every document by id, without vectors."""
    slim = chunks.where("is_active").drop("embedding")
    place = Window.partitionBy("doc_id").orderBy("chunk_uid")
    return slim.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= limit).drop("_n")


def expand_documents(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Up to ten more chunks of the two documents with most hits.

    Only documents that some query expands are scrolled; new chunks follow the
    hits, first the better document's, in chunk order.
    """
    excluded = F.when(F.col("intent") == "document_info", F.lit("student_list"))
    stats = hits.where("doc_id IS NOT NULL").groupBy("query_id", "doc_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min("rank").alias("_first"),
        F.first("query").alias("query"), F.first("intent").alias("intent"),
    )
    by_count = _per_query().orderBy(F.desc("_n"), "_first")
    top = stats.withColumn("_doc_rank", F.row_number().over(by_count)).where(
        F.col("_doc_rank") <= vocab.EXPANSION_DOCS
    ).drop("_n", "_first")
    scrolled = scroll_by_document(chunks.join(top.select("doc_id").distinct(), "doc_id", "left_semi"))
    usable = scrolled.where(F.length(strip(F.coalesce("content", F.lit("")))) >= vocab.MIN_TEXT_CHARS)
    candidates = top.join(usable, "doc_id").where(
        excluded.isNull() | (F.coalesce("content_type", F.lit("")) != excluded)
    ).join(hits.select("query_id", "chunk_uid"), ["query_id", "chunk_uid"], "left_anti")
    in_doc = Window.partitionBy("query_id", "doc_id").orderBy(chunk_number(F.col("chunk_id")), "chunk_id", "chunk_uid")
    added = candidates.withColumn("_in_doc", F.row_number().over(in_doc)).where(
        F.col("_in_doc") <= vocab.EXPANSION_PER_DOC
    )
    both = hits.withColumns({"_doc_rank": F.lit(0), "_in_doc": F.col("rank").cast("int")}).unionByName(
        added.withColumns({"score": F.lit(None).cast("double"), "rank": F.lit(None).cast("int")}).select(
            *[c for c in added.columns if c in hits.columns], "score", "rank", "_doc_rank", "_in_doc"),
        allowMissingColumns=True,
    )
    place = F.row_number().over(_per_query().orderBy("_doc_rank", "_in_doc", "chunk_uid"))
    return both.withColumn("rank", place).drop("_doc_rank", "_in_doc")


def focus_primary(hits: DataFrame) -> DataFrame:
    """Chunks of the document with most hits, then best score, in chunk order."""
    stats = hits.where("doc_id IS NOT NULL").groupBy("query_id", "doc_id").agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.coalesce("score", F.lit(0.0))).alias("_best"), F.min("rank").alias("_first")
    )
    best = first_per_key(stats, ["query_id"], [F.desc("_n"), F.desc("_best"), F.col("_first")])
    kept = hits.join(best.select("query_id", F.col("doc_id").alias("_doc")), "query_id", "left").where(
        F.col("_doc").isNull() | (F.col("doc_id") == F.col("_doc"))
    )
    place = _per_query().orderBy(chunk_number(F.col("chunk_id")), "chunk_id", "rank", "chunk_uid")
    ordered = F.when(F.col("_doc").isNull(), F.col("rank")).otherwise(F.row_number().over(place))
    return kept.withColumn("rank", ordered).drop("_doc")


def relaxed_fallback(valid: DataFrame, raw: DataFrame) -> DataFrame:
    """Three raw hits for document-like queries whose hits were all dropped."""
    wanted = raw.where(F.col("intent").isin("document_info", "regulation", "schedule", "exam")).where(
        F.length(strip(F.coalesce("content", F.lit("")))) >= vocab.MIN_TEXT_CHARS
    )
    lost = wanted.join(valid.select("query_id").distinct(), "query_id", "left_anti")
    place = F.row_number().over(_per_query().orderBy("rank", "chunk_uid"))
    first = lost.withColumn("rank", place).where("rank <= 3")
    return valid.unionByName(first, allowMissingColumns=True)


# --- context ----------------------------------------------------------------
def context_parts(hits: DataFrame) -> DataFrame:
    """Parts of each query's context: ``(query_id, ord, part)``.

    Documents keep their first-seen order, chunks their own; parts stop once
    the running length has reached the limit.
    """
    ctype = F.coalesce("content_type", "chunk_type", F.lit(""))
    one_line = strip(F.regexp_replace("content", r"(?U)\s+", " "))
    tidy = strip(F.regexp_replace("content", r"\n{3,}", "\n\n"))
    shown = F.when(ctype == "table_html_scan", one_line).when(
        ctype.isin("table_md_scan", "table_md"), tidy).otherwise(F.col("content"))
    visible = F.when(ctype == "table_html_scan", F.regexp_replace("_shown", "<[^>]+>", "")).when(
        ctype.isin("table_md_scan", "table_md"), strip(F.translate("_shown", "|", " ")))
    rows = (
        hits.where(F.length(strip(F.coalesce("content", F.lit("")))) >= 20)
        .where(~is_empty_table(F.col("content")))
        .withColumn("_shown", shown)
        .where(F.coalesce(F.length(visible) >= 30, F.lit(True)))
    )
    cut = F.when(
        F.length("_shown") > vocab.CONTEXT_PART_LIMIT,
        F.concat(F.substring("_shown", 1, vocab.CONTEXT_PART_LIMIT), F.lit(vocab.CONTEXT_CUT_MARK)),
    ).otherwise(F.col("_shown"))
    labels = F.filter(
        F.array(*[
            F.when(
                (F.coalesce(F.col(f), F.lit("")) != "") & (F.col(f) != vocab.UNKNOWN),
                F.concat(F.lit(f"{label}: "), F.col(f)),
            )
            for f, label in vocab.CONTEXT_LABELS
        ]),
        lambda x: x.isNotNull(),
    )
    header = F.when(F.size(labels) > 0, F.array_join(labels, " | ")).otherwise(
        F.coalesce("source", F.lit(vocab.UNNAMED_SOURCE)))
    rows = rows.withColumn("part", F.concat(F.lit("["), header, F.lit("]\n"), cut)).withColumn(
        "_doc", F.min("rank").over(Window.partitionBy("query_id", "doc_id"))
    )
    order = _per_query().orderBy("_doc", chunk_number(F.col("chunk_id")), "chunk_id", "rank", "chunk_uid")
    before = F.coalesce(
        F.sum(F.length("part")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    return rows.select("query_id", F.row_number().over(order).alias("ord"), "part", before.alias("_before")).where(
        F.col("_before") < vocab.CONTEXT_LIMIT
    ).drop("_before")


def build_contexts(hits: DataFrame) -> DataFrame:
    """One bounded context text per query."""
    parts = F.sort_array(F.collect_list(F.struct("ord", "part")))
    return context_parts(hits).groupBy("query_id").agg(
        F.array_join(F.transform(parts, lambda p: p.part), vocab.CONTEXT_SEPARATOR).alias("context")
    )


def answer_sources(hits: DataFrame) -> DataFrame:
    """First hit of each document of a query, with its file name and score."""
    firsts = first_per_key(hits.where("doc_id IS NOT NULL AND doc_id <> 0"), ["query_id", "doc_id"], [F.col("rank"), F.col("chunk_uid")])
    place = F.row_number().over(_per_query().orderBy("rank", "chunk_uid"))
    return firsts.select(
        "query_id", "doc_id", F.coalesce("source", F.lit(vocab.UNKNOWN_FILENAME)).alias("filename"),
        # Half-even on the binary value, as the double holds it.
        (F.bround(F.coalesce("score", F.lit(0.0)) * 100, 0) / 100).alias("score"), place.alias("ord"),
    )
