"""Rule-based answers over tables of contexts, hits and generated answers.

Contexts and answers are bounded texts (a context stops at 15,000 characters),
one row per query. Lines are exploded and grouped per query where order
matters; single-row rules are plain column expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill import vocab
from corpusmill.functions.text import (
    clean_amount,
    clean_directive,
    contains_any,
    display_source,
    fold_query,
    format_folded_amount,
    is_money,
    is_placeholder_cell,
    is_table_separator,
    keep_first_by,
    let,
    normalize_query,
    plain_sentence,
    rstrip,
    some,
    strip,
    strip_tags,
)
from corpusmill.operators.numbering import first_per_key
from corpusmill.operators.retrieval import list_rows


def _per_query():
    """Window over the (bounded) rows of a query."""
    return Window.partitionBy("query_id")


def _fill(template: str, **values: Column) -> Column:
    """Template with ``{name}`` slots as a concatenation."""
    pieces = re.split(r"\{(\w*)\}", template)
    unnamed = iter(values.values())
    out = []
    for i, piece in enumerate(pieces):
        if i % 2 == 0:
            out.append(F.lit(piece))
        else:
            out.append(values[piece] if piece else next(unnamed))
    return F.concat(*out)


def _lines(*items: Column | str | None) -> Column:
    """Lines joined by line ends; null items are left out."""
    kept = [F.lit(i) if isinstance(i, str) else i for i in items]
    return strip(F.array_join(F.filter(F.array(*kept), lambda x: x.isNotNull()), "\n"))


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _some(text: Column, pattern: str, group: int = 1) -> Column:
    return some(F.regexp_extract(text, pattern, group))


# --- student records --------------------------------------------------------
def _term(content: Column, title: Column) -> Column:
    def of(text: Column, pattern: str) -> Column:
        name, years = F.regexp_extract(text, "(?iuU)" + pattern, 1), F.regexp_extract(text, "(?iuU)" + pattern, 2)
        return F.when(years != "", F.concat(F.upper(name), F.lit(" ("), years, F.lit(")")))

    return F.coalesce(
        of(content, vocab.TERM_IN_CONTENT), of(F.coalesce(title, F.lit("")), vocab.TERM_IN_TITLE),
        F.lit(vocab.TERM_UNKNOWN),
    )


def record_rows(hits: DataFrame) -> DataFrame:
    """Every seven-column student row of the hits, with its term."""
    groups = [_all(F.col("content"), "(?U)" + vocab.ROW_RECORD, g) for g in (1, 2, 5, 6)]
    rows = F.transform(
        F.arrays_zip(*[g.alias(n) for g, n in zip(groups, ("msv", "ho_ten", "diem", "xep_loai"))]), lambda r: r
    )
    return hits.select(
        "query_id", "rank", _term(F.col("content"), F.col("title")).alias("hoc_ky"), F.posexplode(rows).alias("pos", "r")
    ).select(
        "query_id", "rank", "pos", "hoc_ky", F.col("r.msv").alias("msv"), strip(F.col("r.ho_ten")).alias("ho_ten"),
        F.col("r.diem").alias("diem"), strip(F.col("r.xep_loai")).alias("xep_loai"),
    )


def student_records(hits: DataFrame, targets: DataFrame) -> DataFrame:
    """Records of each query's target id, newest term first.

    Rows are parsed once for all ids and joined to ``targets`` (query_id,
    target_id).
    """
    wanted = record_rows(hits).join(targets.withColumnRenamed("target_id", "msv"), ["query_id", "msv"])
    unique = first_per_key(wanted, ["query_id", "msv", "hoc_ky", "diem"], [F.col("rank"), F.col("pos")])
    year = F.coalesce(F.nullif(F.regexp_extract("hoc_ky", r"20(\d{2})", 1), F.lit("")).cast("int"), F.lit(0))
    term = F.coalesce(F.nullif(F.regexp_extract("hoc_ky", r"(?i)HK(\d)", 1), F.lit("")).cast("int"), F.lit(0))
    order = Window.partitionBy("query_id", "msv").orderBy(F.desc(year), F.desc(term), "rank", "pos")
    return unique.withColumn("ord", F.row_number().over(order)).drop("rank", "pos")


def record_answers(records: DataFrame) -> DataFrame:
    line = _fill(vocab.RECORD_LINE, term=F.col("hoc_ky"), score=F.col("diem"), grade=F.col("xep_loai"))
    grouped = records.groupBy("query_id", "msv").agg(
        F.min_by("ho_ten", "ord").alias("name"), F.sort_array(F.collect_list(F.struct("ord", line.alias("line")))).alias("l")
    )
    head = _fill(vocab.RECORD_HEAD, name=F.col("name"), id=F.col("msv"))
    return grouped.select(
        "query_id", "msv", F.concat_ws("\n", head, F.array_join(F.transform("l", lambda x: x.line), "\n")).alias("answer")
    )


# --- ambiguous names --------------------------------------------------------
def _name_words(query: Column) -> Column:
    return _all(query, rf"(?U)\b[{vocab.UPPER_CLASS}][{vocab.LOWER_CLASS}]+\b")


def ambiguous_names(hits: DataFrame) -> DataFrame:
    """First name word of queries that fit several listed students.

    ``(query_id, name, n)``; queries with an explicit id are left out.
    """
    asked = hits.where(~F.col("query").rlike(r"(?U)\b\d{10}\b")).withColumn("_words", _name_words(F.col("query")))
    rows = asked.select("query_id", "_words", F.explode(list_rows(F.col("content"))).alias("s")).where(
        F.exists("_words", lambda w: F.contains(F.lower(F.col("s.name")), F.lower(w)))
    ).select("query_id", F.get("_words", F.lit(0)).alias("name"), "s").distinct()
    return rows.groupBy("query_id", "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def clarifications(hits: DataFrame, names: DataFrame) -> DataFrame:
    """Question listing the students that fit ``names`` (query_id, name)."""
    rows = hits.join(names.select("query_id", "name"), "query_id").select(
        "query_id", "name", "rank", F.posexplode(list_rows(F.col("content"))).alias("pos", "s")
    ).where(F.contains(F.lower(F.col("s.name")), F.lower(F.col("name"))))
    firsts = rows.groupBy("query_id", "s").agg(F.min(F.struct("rank", "pos")).alias("at"))
    listed = firsts.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "s"))), lambda x: x.s).alias("l"))
    line = lambda s: _fill(vocab.CLARIFY_LINE, name=s.getField("name"), id=s.id)
    found = F.concat_ws(
        "\n", _fill(vocab.CLARIFY_HEAD, n=F.size("l").cast("string"), name=F.col("name")),
        F.array_join(F.transform("l", line), "\n"), F.lit(vocab.CLARIFY_TAIL),
    )
    return names.select("query_id", "name").join(listed, "query_id", "left").select(
        "query_id", F.when(F.col("l").isNull(), _fill(vocab.CLARIFY_NONE, name=F.col("name"))).otherwise(found).alias("answer")
    )


# --- context headers --------------------------------------------------------
def header_fields(header: Column) -> Column:
    """Struct (title, so, ngay) of a context header; the last of each wins."""
    parts = F.filter(F.transform(F.split(header, r"\|"), lambda p: normalize_query(p)), lambda p: F.contains(p, F.lit(":")))
    pairs = F.filter(
        F.transform(
            parts, lambda p: F.struct(fold_query(p).alias("k"), strip(F.regexp_replace(p, r"(?s)\A[^:]*:", "")).alias("v"))
        ),
        lambda s: s.v != "",
    )

    def last(prefix: str) -> Column:
        found = F.filter(pairs, lambda s: F.startswith(s.k, F.lit(prefix)))
        return let(found, lambda f: F.get(f, F.size(f) - 1).v)

    return F.struct(last("van ban").alias("title"), last("so").alias("so"), last("ngay").alias("ngay"))


# --- exemption and fee answers ----------------------------------------------
def exemption_answer(query: Column, context: Column, school: str = "Trường") -> Column:
    """Who is exempt from fees, if query and context speak of it; else null."""

    def rules(q: Column) -> Column:
        asked = (
            q.contains("doi tuong") & contains_any(q, ["mien", "giam hoc phi"]) & contains_any(q, vocab.EXEMPT_ASK)
        )

        def items(ctx: Column) -> Column:
            first = ctx.rlike(vocab.EXEMPT_ITEM_1)
            second = ctx.rlike("|".join(f"(?:{p})" for p in vocab.EXEMPT_ITEM_2))
            text = _lines(
                vocab.EXEMPT_TITLE, "",
                F.when(first, F.lit("- " + vocab.EXEMPT_TEXT_1.format(school=school))),
                F.when(second, F.lit("- " + vocab.EXEMPT_TEXT_2)), "", vocab.EXEMPT_TAIL,
            )
            return F.when(first | second, text)

        return F.when(asked, let(fold_query(context), items))

    return let(fold_query(query), rules)


def _triples(text: Column) -> Column:
    """(prefix, three amounts) of each run of three amounts."""
    between, found = F.split(text, vocab.FEE_TRIPLE), _all(text, vocab.FEE_TRIPLE, 0)
    amounts = F.zip_with(
        F.zip_with(_all(text, vocab.FEE_TRIPLE, 1), _all(text, vocab.FEE_TRIPLE, 2), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
        _all(text, vocab.FEE_TRIPLE, 3),
        lambda p, c: F.array(clean_amount(p.a), clean_amount(p.b), clean_amount(c)),
    )
    starts = F.transform(
        found,
        lambda _, i: F.aggregate(F.slice(between, 1, i + 1), F.lit(0), lambda s, x: s + F.length(x))
        + F.aggregate(F.slice(found, 1, i), F.lit(0), lambda s, x: s + F.length(x)),
    )
    return F.zip_with(
        starts, amounts,
        lambda at, a: F.struct(
            F.substring(text, F.greatest(at - 120, F.lit(0)) + 1, F.least(at, F.lit(120))).alias("prefix"), a.alias("amounts")
        ),
    )


def fee_answers(rows: DataFrame) -> DataFrame:
    """Add ``fee_answer`` to rows with ``query`` and ``context``; null if none.

    Works on the context section whose header names the asked semester and
    years (else the first). The context is one line by then, so rules that
    speak of lines see all of it. Dates keep no slash after folding, so a
    payment period is never found and has no rule here.
    """
    q = F.col("_q")
    out = rows.withColumn("_q", fold_query(F.col("query"))).withColumns({
        "_fee": contains_any(q, vocab.FEE_WORDS) & contains_any(q, vocab.FEE_SCOPES),
        "_sem": F.when(q.rlike(r"\bky\s*(1|i)\b"), 1).when(q.rlike(r"\bky\s*(2|ii)\b"), 2).otherwise(0),
        "_years": F.when(F.size(_all(q, r"20\d{2}")) >= 2, F.slice(_all(q, r"20\d{2}"), 1, 2)).otherwise(
            F.array().cast("array<string>")),
    })
    # Other queries carry an empty context from here on.
    text = F.when(F.col("_fee"), normalize_query(F.col("context"))).otherwise(F.lit(""))
    out = out.withColumn("_ctx", text).withColumns({
        "_heads": F.transform(_all(F.col("_ctx"), r"\[(.*?)\]", 1), lambda h: normalize_query(h)),
        "_sections": F.split("_ctx", r"\[.*?\]"),
    })

    def fits(head: Column) -> Column:
        folded = fold_query(head)
        semester = (
            (F.col("_sem") == 0)
            | ((F.col("_sem") == 1) & contains_any(folded, vocab.FEE_FIRST))
            | ((F.col("_sem") == 2) & contains_any(folded, vocab.FEE_SECOND))
        )
        return semester & F.forall("_years", lambda y: F.contains(folded, y))

    fitting = F.array_position(F.transform("_heads", fits), True)
    out = out.withColumn("_at", F.when(F.size("_heads") == 0, 0).when(fitting == 0, 1).otherwise(fitting).cast("int"))
    out = out.withColumns({
        "_text": F.when(F.col("_at") == 0, F.col("_ctx")).otherwise(F.get("_sections", F.col("_at"))),
        "_head": F.coalesce(F.when(F.col("_at") > 0, F.get("_heads", F.col("_at") - 1)), F.lit("")),
    }).withColumns({"_fold": fold_query(F.col("_text")), "_head_fold": fold_query(F.col("_head")), "_meta": header_fields(F.col("_head"))})
    both = F.concat_ws("\n", "_fold", "_head_fold")
    right_semester = (
        F.when(F.col("_sem") == 1, contains_any(both, vocab.FEE_FIRST))
        .when(F.col("_sem") == 2, contains_any(both, vocab.FEE_SECOND))
        .otherwise(contains_any(F.col("_fold"), vocab.FEE_ANY_SEMESTER))
    )
    money = F.filter(F.transform(_all(F.col("_text"), r"[0-9][0-9\.,]*"), lambda x: clean_amount(x)), lambda x: is_money(x))
    out = out.withColumns({"_ok": F.col("_fee") & right_semester, "_money": money, "_triples": _triples(F.col("_text"))})
    by_line = F.when(
        F.col("_text").contains("|") & F.col("_fold").contains("chuong trinh") & (F.size("_money") >= 3),
        F.slice("_money", -3, 3),
    )
    by_triple = F.get(
        F.filter(
            "_triples",
            lambda t: contains_any(fold_query(t.prefix), vocab.FEE_TRIPLE_MARKERS) & F.forall(t.amounts, lambda x: is_money(x)),
        ),
        F.lit(0),
    ).amounts
    items = F.zip_with(
        _all(F.col("_text"), "(?iu)" + vocab.FEE_ROW, 1), _all(F.col("_text"), "(?iu)" + vocab.FEE_ROW, 2),
        lambda a, b: F.struct(
            strip(F.regexp_replace(a, r"\s+", " "), " .;-").alias("item"), F.regexp_replace(b, r"\s+", "").alias("amount")
        ),
    )
    listed = keep_first_by(F.filter(items, lambda s: F.length(s.item) >= 3), lambda s: F.lower(s.item))
    power = _some(F.col("_fold"), vocab.FEE_POWER)
    power_row = F.when(
        power.isNotNull(),
        F.array(F.struct(F.lit(vocab.FEE_POWER_ITEM).alias("item"), F.concat(power, F.lit("đ")).alias("amount"))),
    )
    total = format_folded_amount(_some(F.col("_fold"), vocab.FEE_TOTAL))
    out = out.withColumns({
        "_rates": F.coalesce(by_line, by_triple),
        "_fees": let(listed, lambda x: F.when(F.size(x) > 0, x).otherwise(F.coalesce(power_row, x))),
        "_total": F.coalesce(
            F.when(is_money(total), F.concat(total, F.lit("đ"))),
            F.when(F.col("_fold").contains("tong cong"), F.concat(F.get("_money", F.size("_money") - 1), F.lit("đ"))),
        ),
        "_portal": rstrip(_some(F.col("_text"), r"(https?://\S+)"), ".),;"),
        "_ways": F.filter(
            F.array(*[F.when(contains_any(F.col("_fold"), marks), F.lit(f"- {way}")) for marks, way in vocab.PAY_METHODS]),
            lambda x: x.isNotNull(),
        ),
    })
    has_rates, has_fees, has_ways = F.col("_rates").isNotNull(), F.size("_fees") > 0, F.size("_ways") > 0
    meta = F.nullif(
        F.concat_ws(
            " | ", _fill("**Số:** {}", x=F.col("_meta.so")), _fill("**Ngày:** {}", x=F.col("_meta.ngay"))
        ),
        F.lit(""),
    )
    title = F.coalesce("_meta.title", F.lit(vocab.FEE_TITLE))
    answer = _lines(
        _fill("**{}**", x=title), "", meta, F.when(meta.isNotNull(), F.lit("")),
        F.when(has_rates, F.lit(vocab.FEE_RATES)),
        *[F.when(has_rates, _fill(line, x=F.get("_rates", F.lit(i)))) for i, line in enumerate(vocab.FEE_RATE_LINES)],
        F.when(has_rates, F.lit("")),
        F.when(has_fees, F.lit(vocab.FEE_ITEMS)),
        F.when(has_fees, F.array_join(F.transform(F.slice("_fees", 1, 5), lambda s: _fill("- {a}: **{b}**", a=s.item, b=s.amount)), "\n")),
        F.when(has_fees & F.col("_total").isNotNull(), _fill(vocab.FEE_SUM, x=F.col("_total"))),
        F.when(has_fees, F.lit("")),
        F.when(F.col("_portal").isNotNull(), _fill(vocab.FEE_PORTAL, x=F.col("_portal"))),
        F.when(has_ways, F.lit(vocab.FEE_METHODS)),
        F.when(has_ways, F.array_join("_ways", "\n")),
    )
    return out.withColumn("fee_answer", F.when(F.col("_ok") & (has_rates | has_fees), answer)).select(*rows.columns, "fee_answer")


# --- numbered directives ----------------------------------------------------
def directives(context: Column) -> Column:
    """(num, body) of numbered directives 1 to 12, the longest body of each."""
    work = F.regexp_replace(context, rf"(?siu)\A.*?{vocab.DIRECTIVE_ANCHOR}", "")
    markers = "|".join(re.escape(m) for m in vocab.CUT_MARKERS)
    work = F.regexp_replace(work, rf"(?s)(?:{markers}).*\z", "")

    def collect(text: Column) -> Column:
        pattern = "(?s)" + vocab.DIRECTIVE_ITEM
        pairs = F.zip_with(
            _all(text, pattern, 1), _all(text, pattern, 2),
            lambda n, b: F.struct(n.cast("int").alias("num"), clean_directive(b).alias("body")),
        )
        good = F.filter(pairs, lambda p: p.num.between(1, 12) & (F.length(p.body) >= 40))
        ranked = F.array_sort(F.transform(good, lambda p, i: F.struct(p.num.alias("num"), (-F.length(p.body)).alias("l"), i.alias("i"), p.body.alias("body"))))
        firsts = let(ranked, lambda a: F.filter(a, lambda s, i: (i == 0) | (F.get(a, i - 1).num != s.num)))
        return F.transform(firsts, lambda s: F.struct(s.num.alias("num"), s.body.alias("body")))

    return let(work, collect)


def directive_answer(query: Column, context: Column) -> Column:
    """Directives of a holiday notice in order; null for other queries."""
    q = fold_query(query)
    wanted = let(q, lambda x: x.contains("tet") & x.contains("nguyen dan")) & fold_query(context).contains("tet")
    header = F.regexp_extract(context, r"(?s)\[(.*?)\]", 1)
    meta = F.nullif(
        F.concat_ws(
            " | ",
            _fill("**Số:** {}", x=F.nullif(normalize_query(_some(header, r"Số:\s*([^|]+)")), F.lit(""))),
            _fill("**Ngày ban hành:** {}", x=F.nullif(normalize_query(_some(header, r"Ngày:\s*([^|]+)")), F.lit(""))),
        ),
        F.lit(""),
    )

    def render(found: Column) -> Column:
        body = F.array_join(F.transform(found, lambda d: _fill("**Điều {n}:** {b}\n", n=d.num.cast("string"), b=d.body)), "\n")
        return F.when(
            F.size(found) > 0, _lines(vocab.DIRECTIVE_TITLE, "", meta, F.when(meta.isNotNull(), F.lit("")), body)
        )

    return F.when(wanted, let(directives(context), render))


# --- sections, tables and outline -------------------------------------------
def _context_lines(contexts: DataFrame) -> DataFrame:
    return contexts.select("query_id", F.posexplode(F.split("context", "\n")).alias("pos", "raw"))


def generic_heading(text: Column, folded: Column) -> Column:
    """Heading text of a normalised line and its folded form, or null."""
    words = lambda c: F.size(F.filter(F.split(c, " "), lambda w: w != ""))

    def forms(plain: Column, numbered: Column) -> Column:
        ok_numbered = (numbered != "") & (words(numbered) <= 15) & (
            text.endswith(":") | contains_any(fold_query(numbered), vocab.HEADING_TOKENS)
        )
        # Colons and blanks at the end fold to nothing, so that this form folds as the line does.
        ok_plain = text.endswith(":") & let(words(plain), lambda n: n.between(2, 15)) & ~plain.rlike("(?U)" + vocab.YEAR)
        return F.when(folded.rlike(vocab.HEADING_START), plain).when(ok_numbered, numbered).when(ok_plain, plain)

    numbered = rstrip(strip(F.regexp_extract(text, r"(?U)\A\d+\.\s*(.+)\z", 1)), ":")
    made = F.struct(strip(rstrip(text, ":")).alias("plain"), numbered.alias("numbered"))
    # Only such lines can be headings by one of the forms.
    usable = (folded != "") & (text.endswith(":") | folded.rlike(vocab.HEADING_START) | text.rlike(r"(?U)\A\d+\.")) & ~contains_any(
        folded, vocab.HEADING_STOPS)
    return F.when(usable, let(made, lambda m: forms(m.plain, m.numbered)))


def generic_sections(contexts: DataFrame, max_sections: int = 8, max_items: int = 8) -> DataFrame:
    """(query_id, idx, title, items): headings with their first distinct items."""
    lines = _context_lines(contexts).withColumn("text", normalize_query(F.col("raw"))).where(
        (F.col("text") != "") & ~(F.col("text").startswith("[") & F.col("text").endswith("]"))
    ).withColumn("_fold", fold_query(F.col("text"))).where(~contains_any(F.col("_fold"), vocab.SECTION_SKIPS))
    lines = lines.withColumn("head", generic_heading(F.col("text"), F.col("_fold")))

    def listed(x: Column) -> Column:
        # Most sentences are the whole line, whose folded form is known.
        skipped = F.when(x == F.col("text"), contains_any(F.col("_fold"), vocab.ITEM_SKIPS)).otherwise(contains_any(fold_query(x), vocab.ITEM_SKIPS))
        return F.when((x != "") & (F.length(x) <= 260) & ~skipped, x)

    lines = lines.withColumn("item", F.when(F.col("head").isNull(), let(plain_sentence(F.col("text")), listed)))
    so_far = _per_query().orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    folded = F.when(F.col("head").isNotNull(), fold_query(F.col("head")))
    lines = lines.select("query_id", "pos", "head", "item", folded.alias("_key"))
    lines = lines.withColumn("key", F.last("_key", ignorenulls=True).over(so_far))
    # Headings and items meet in one aggregation, so that lines are shuffled once, by query.
    firsts = lines.where("query_id IS NOT NULL AND key IS NOT NULL").groupBy("query_id", "key", "item").agg(
        F.min(F.when(F.col("head").isNotNull(), F.struct("pos", "head"))).alias("_head"), F.min("pos").alias("pos")
    )
    listed = F.sort_array(F.collect_list(F.when(F.col("item").isNotNull(), F.struct("pos", "item"))))
    sections = firsts.groupBy("query_id", "key").agg(F.min("_head").alias("_head"), listed.alias("_items"))
    place = F.row_number().over(_per_query().orderBy("at"))
    return sections.where("_head IS NOT NULL").where(F.size("_items") > 0).select(
        "query_id", F.col("_head.head").alias("title"), F.col("_head.pos").alias("at"),
        F.slice(F.transform("_items", lambda s: s.item), 1, max_items).alias("items"),
    ).where(
        (F.trim("title") != "") & (F.length("title") <= 140)
    ).withColumn("idx", place - 1).where(F.col("idx") < max_sections).select("query_id", "idx", "title", "items")


def four_sections(contexts: DataFrame, max_items: int = 8) -> DataFrame:
    """Items of the four fixed sections, by marker lines."""

    def marker(folded: Column) -> Column:
        return F.coalesce(*[
            F.when(contains_any(folded, first) & contains_any(folded, second), F.lit(name))
            for name, first, second in vocab.FOUR_SECTIONS
        ])

    lines = _context_lines(contexts).withColumn("text", normalize_query(F.col("raw"))).withColumns({
        "mark": let(fold_query(F.col("text")), marker), "item": plain_sentence(F.col("text")),
    })
    lines = lines.withColumn("tail", F.when(
        F.col("mark").isNotNull(), let(strip(F.regexp_extract("text", r"\A[^:]*:(.*)\z", 1)), plain_sentence)))
    tail = F.col("tail")
    item = F.when(
        F.col("mark").isNull() | ~(F.col("text").endswith(":") & (tail == "")),
        F.coalesce(F.nullif("item", F.lit("")), F.when(F.col("mark").isNotNull(), F.nullif(tail, F.lit("")))),
    )
    so_far = _per_query().orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    found = lines.withColumn("item", item).withColumn(
        "section", F.last("mark", ignorenulls=True).over(so_far)
    ).where("section IS NOT NULL AND item IS NOT NULL").groupBy("query_id", "section", "item").agg(F.min("pos").alias("pos"))
    return found.groupBy("query_id", "section").agg(
        F.slice(F.transform(F.sort_array(F.collect_list(F.struct("pos", "item"))), lambda s: s.item), 1, max_items).alias("items")
    )


def _blocks(lines: DataFrame, key: str) -> DataFrame:
    """Lines with ``block``: the position where their Markdown table starts.

    A table is a header line followed by a rule, up to the last line of the
    same run of lines with pipes.
    """
    by_pos = Window.partitionBy(key).orderBy("pos")
    piped = F.col("raw").contains("|")
    lines = lines.withColumns({
        "_start": piped & is_table_separator(F.lead("raw", 1, "").over(by_pos)),
        "_run": F.sum(F.when(piped, 0).otherwise(1)).over(by_pos),
    })
    run = Window.partitionBy(key, "_run", piped)
    first = F.min(F.when(F.col("_start"), F.col("pos"))).over(run)
    return lines.withColumn("block", F.when(piped & (F.col("pos") >= first), first)).drop("_start", "_run")


def _cells(line: Column) -> Column:
    return F.transform(F.split(strip(strip(line), "|"), r"\|"), lambda c: strip(c))


def money_tables(contexts: DataFrame, max_tables: int = 2, max_rows: int = 6) -> DataFrame:
    """(query_id, idx, headers, rows, folded) of tables with amounts."""
    lines = _blocks(_context_lines(contexts), "query_id").where("block IS NOT NULL").withColumns({
        "n": F.col("pos") - F.col("block"), "cells": _cells(F.col("raw")),
    })
    # Headers and rows meet in one aggregation, so that lines are shuffled once, by query.
    named = let(F.filter("cells", lambda c: c != ""), lambda h: F.when((F.col("n") == 0) & (F.size(h) > 0), h))
    counts = (F.col("n") >= 2) & F.exists("cells", lambda c: c.rlike(vocab.MONEY)) & F.exists("cells", lambda c: ~is_placeholder_cell(c))
    told = lines.where("query_id IS NOT NULL").select(
        "query_id", "block", named.alias("_head"), F.when(counts, F.struct("n", F.col("cells").alias("row"))).alias("_row"))
    grouped = told.groupBy("query_id", "block").agg(
        F.sort_array(F.collect_list("_head")).alias("_heads"), F.sort_array(F.collect_list("_row")).alias("_rows"),
    ).where((F.size("_heads") > 0) & (F.size("_rows") > 0)).withColumn("headers", F.get("_heads", F.lit(0)))

    def fitted(row: Column, head: Column) -> Column:
        return F.slice(F.concat(row, F.array_repeat(F.lit(""), F.size(head))), F.lit(1), F.size(head))

    # A query that comes twice has each row under each of its headers.
    all_rows = F.flatten(F.transform("_rows", lambda r: F.transform("_heads", lambda h: fitted(r.row, h))))
    place = F.row_number().over(_per_query().orderBy("block"))
    return grouped.select(
        "query_id", (place - 1).alias("idx"), "headers", F.slice(all_rows, 1, max_rows).alias("rows"),
        fold_query(F.concat_ws(" ", F.array_join("headers", " "), F.array_join(F.flatten(all_rows), " "))).alias("folded"),
    ).where(F.col("idx") < max_tables)


def compact_table(headers: Column, rows: Column) -> Column:
    """Markdown lines; missing column names are filled in."""
    width = F.greatest(F.size(headers), F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0)))
    names = F.concat(
        headers,
        F.transform(
            F.filter(F.sequence(F.lit(1), width), lambda i: i > F.size(headers)),
            lambda i: F.concat(F.lit(vocab.FILLER_COLUMN), i.cast("string")),
        ),
    )
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    body = F.transform(rows, lambda r: line(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))))
    return F.when(
        F.size(headers) > 0, F.concat(F.array(line(names), line(F.array_repeat(F.lit("---"), width))), body)
    ).otherwise(F.array().cast("array<string>"))


def outlines(rows: DataFrame) -> DataFrame:
    """Outline of each context for its query: ``(query_id, outline)``."""
    sections, tables = generic_sections(rows), money_tables(rows)
    q = rows.select("query_id", "query", "context").withColumn("_q", fold_query(F.col("query")))
    words = F.filter(F.split("_q", " "), lambda w: (F.length(w) >= 3) & ~w.isin(*vocab.OUTLINE_STOPS))
    fee_asked = contains_any(F.col("_q"), vocab.OUTLINE_FEE_ASKED)
    hay = fold_query(F.concat_ws(" ", "title", F.array_join(F.slice("items", 1, 6), " ")))
    scored = sections.join(q.drop("context"), "query_id").withColumn("_hay", hay).withColumn(
        "score",
        F.size(F.filter(words, lambda w: F.contains(F.col("_hay"), w)))
        + F.when(fee_asked & contains_any(F.col("_hay"), vocab.OUTLINE_FEE_FOUND), 4).otherwise(0)
        + F.when(F.col("_q").contains("noi dung"), F.greatest(F.lit(0), 2 - F.col("idx"))).otherwise(0),
    )
    text = F.concat(
        F.lit("**"), F.trim("title"), F.lit(":**\n"),
        F.array_join(F.transform(F.slice("items", 1, 6), lambda i: F.concat(F.lit("- "), i)), "\n"), F.lit("\n"),
    )
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "idx", text.alias("text"), "title")))
    picked = scored.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("_n"), F.transform(F.slice(ranked, 1, 4), lambda x: F.struct(x.text.alias("text"), x.title.alias("title"))).alias("_sections")
    )
    found = tables.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("idx", "headers", "rows", "folded"))).alias("_tables"))

    def first_with(marks: list[str]) -> Column:
        return F.coalesce(
            F.get(F.filter("_tables", lambda t: contains_any(t.folded, marks)), F.lit(0)), F.get("_tables", F.lit(0))
        )

    chosen = (
        F.when(F.col("_q").contains("hoc phi"), first_with(vocab.OUTLINE_TUITION_TABLE))
        .when(F.col("_q").contains("le phi"), first_with(vocab.OUTLINE_FEE_TABLE))
        .otherwise(F.get("_tables", F.lit(0)))
    )
    trimmed = F.transform(F.split("context", "\n"), lambda x: strip(x))
    header = strip(F.get(F.filter(trimmed, lambda x: x.startswith("[") & x.endswith("]")), F.lit(0)), "[]")
    out = q.join(picked, "query_id", "left").join(found, "query_id", "left").withColumns({
        "_n": F.coalesce("_n", F.lit(0)), "_header": F.nullif(header, F.lit("")), "_table": chosen,
    })
    show_table = F.col("_table").isNotNull() & (
        contains_any(F.col("_q"), vocab.OUTLINE_TABLE_ASKED) | (F.least(F.col("_n"), F.lit(4)) < 2)
    )
    outline = _lines(
        _fill("**{}**", x=F.col("_header")), F.when(F.col("_header").isNotNull(), F.lit("")),
        F.concat(F.lit(vocab.OUTLINE_LEAD), normalize_query(F.col("query"))), "",
        F.array_join(F.transform("_sections", lambda s: s.text), "\n"),
        F.when(show_table, F.concat(F.lit(vocab.OUTLINE_TABLE + "\n\n"), F.array_join(compact_table(F.col("_table.headers"), F.col("_table.rows")), "\n"))),
    )
    return out.where((F.col("_n") >= 2) | F.col("_tables").isNotNull()).select(
        "query_id", outline.alias("outline")
    ).where(F.length("outline") >= 120)


def enrich_answers(rows: DataFrame) -> DataFrame:
    """Replace a partial ``answer`` by the context's outline."""
    folded, titles = F.col("_a"), F.col("_titles")
    lines = F.transform(F.split("outline", "\n"), lambda x: strip(x))
    heads = F.transform(
        F.filter(lines, lambda x: x.rlike(r"\A\*\*(.+?):\*\*\z")), lambda x: F.regexp_extract(x, r"\A\*\*(.+?):\*\*\z", 1)
    )
    money = lambda c: F.size(_all(F.col(c), vocab.MONEY))
    out = rows.join(outlines(rows), "query_id", "left").withColumns({
        "_a": fold_query(F.col("answer")), "_titles": heads,
    })
    overlap = F.size(F.filter(F.slice(titles, 1, 5), lambda x: F.contains(folded, fold_query(x))))
    partial = (
        (contains_any(folded, vocab.ANSWER_ERRORS) & (F.length(folded) < 240))
        | ((F.size(titles) >= 3) & (overlap <= 1))
        | ((money("context") >= 3) & (money("answer") < 2))
        | (fold_query(F.col("query")).contains("noi dung") & (F.length("answer") < F.floor(F.length("outline") * 0.55)))
    )
    usable = F.col("outline").isNotNull() & (F.coalesce("answer", F.lit("")) != "")
    return out.withColumn("answer", F.when(usable & partial, F.col("outline")).otherwise(F.col("answer"))).select(*rows.columns)


# --- post-checks of generated answers ---------------------------------------
def suppress_placeholder_tables(answers: DataFrame) -> DataFrame:
    """Tables that are mostly placeholders become one note. ``(id, answer)``."""
    piped = answers.where(F.col("answer").contains("|"))
    lines = _blocks(piped.select("id", F.posexplode(F.split("answer", "\n")).alias("pos", "raw")), "id")
    data = lines.where("block IS NOT NULL").where(~is_table_separator(F.col("raw"))).withColumn("cells", _cells(F.col("raw")))
    order = F.row_number().over(Window.partitionBy("id", "block").orderBy("pos"))
    checked = F.when(F.size("cells") > 1, F.slice("cells", 2, F.size("cells"))).otherwise(F.col("cells"))
    empty = ~F.exists(checked, lambda c: ~is_placeholder_cell(c))
    marks = data.withColumns({"_n": order, "_empty": empty}).where("_n > 1").groupBy("id", "block").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_empty").alias("empty")
    ).where(F.col("empty") >= F.greatest(F.lit(1), F.floor(F.col("n") * 0.6))).select("id", "block", F.lit(True).alias("_drop"))
    shown = lines.join(marks, ["id", "block"], "left").where("_drop IS NULL OR pos = block").withColumn(
        "raw", F.when(F.col("_drop"), F.lit(vocab.PLACEHOLDER_NOTE)).otherwise(F.col("raw"))
    )
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "raw"))), lambda x: x.raw), "\n")
    rebuilt = shown.groupBy("id").agg(strip(F.regexp_replace(text, r"\n{3,}", "\n\n")).alias("_new"))
    return answers.join(rebuilt, "id", "left").withColumn("answer", F.coalesce("_new", "answer")).drop("_new")


def is_no_data(answer: Column) -> Column:
    """Opens like a no-data answer and holds no substance."""

    def rules(folded: Column) -> Column:
        checks = sum((folded.contains(c).cast("int") for c in vocab.NO_DATA_CHECKS), F.lit(0))
        return (
            contains_any(F.substring(folded, 1, 220), vocab.NO_DATA_OPENERS)
            & ~contains_any(folded, vocab.SUBSTANTIVE_MARKERS) & (checks >= 2)
        )

    return let(fold_query(answer), rules)


def no_data_answer(query: Column, intent: Column) -> Column:
    contact = F.coalesce(
        *[F.when(intent == name, F.lit(value)) for name, value in vocab.CONTACT_BY_INTENT.items()], F.lit(vocab.CONTACT_DEFAULT)
    )
    return _fill("\n".join(vocab.NO_DATA_LINES), query=normalize_query(query), contact=contact)


def grounded(answer: Column, context: Column) -> Column:
    """Drop lines with ten-digit ids that the context does not hold."""
    ids = lambda c: _all(c, r"(?U)\b\d{10}\b")

    def check(fake: Column) -> Column:
        kept = strip(F.array_join(F.filter(F.split(answer, "\n"), lambda x: ~F.arrays_overlap(ids(x), fake)), "\n"))
        cut = let(kept, lambda k: F.when(F.length(k) > 20, k).otherwise(F.concat(answer, F.lit(vocab.UNVERIFIED_NOTE))))
        return F.when(F.size(fake) == 0, answer).otherwise(cut)

    skip = (F.coalesce(answer, F.lit("")) == "") | (F.coalesce(context, F.lit("")) == "")
    return F.when(skip, answer).otherwise(let(F.array_except(ids(answer), ids(context)), check))


# --- noisy contexts ---------------------------------------------------------
def noisy_queries(hits: DataFrame) -> DataFrame:
    """Queries whose hits are scanned tables of untitled documents only."""
    title = F.lower(normalize_query(F.coalesce("title", F.lit(""))))
    ctype = F.lower(F.coalesce("content_type", F.lit("")))
    stats = hits.withColumn("_title", title).groupBy("query_id").agg(
        F.first("query").alias("query"), F.first("intent").alias("intent"), F.count(F.lit(1)).alias("n"),
        F.count_if(ctype.isin(*vocab.TABLE_TYPES)).alias("tables"), F.count_if(ctype == "text").alias("texts"),
        F.count_if(F.col("_title").isin("", vocab.UNKNOWN_FORMS[0])).alias("unknown"),
    )
    return stats.where(
        (F.col("intent") != "student_lookup")
        & contains_any(F.lower(normalize_query(F.col("query"))), vocab.SAFE_QUERY_TERMS)
        & (F.col("tables") >= F.greatest(F.lit(3), F.floor(F.col("n") * 0.7))) & (F.col("texts") == 0)
        & (F.col("unknown") >= F.greatest(F.lit(2), F.floor(F.col("n") * 0.6)))
    ).select("query_id")


def safe_answers(hits: DataFrame) -> DataFrame:
    """Cautious facts for noisy queries: ``(query_id, answer)``."""
    noisy = hits.join(noisy_queries(hits), "query_id", "left_semi").withColumns({
        "_place": F.row_number().over(_per_query().orderBy("rank", "chunk_uid")),
        "_source": F.nullif(normalize_query(F.col("source")), F.lit("")),
    })
    source = F.col("_source")
    snippet = strip_tags(F.coalesce("content", F.lit("")))
    parts = F.sort_array(F.collect_list(F.when((F.length(snippet) >= 30) & (F.col("_place") <= 20), F.struct("_place", snippet.alias("s")))))
    rows = noisy.groupBy("query_id").agg(
        F.min_by(source, F.when(source.isNotNull(), F.col("_place"))).alias("_src"),
        F.array_join(F.transform(parts, lambda p: p.s), " ").alias("_text"),
    ).withColumn("_src", display_source(F.coalesce("_src", F.lit(vocab.SAFE_SOURCE)))).withColumn(
        "_both", F.concat_ws(" ", "_src", "_text")).withColumn("_fold", fold_query(F.col("_both")))
    year = _some(F.col("_both"), r"(?U)\b(20\d{2}\s*[-/]\s*20\d{2})\b")
    dates = F.slice(F.array_distinct(_all(F.col("_text"), r"(?U)\b\d{1,2}[/-]\d{1,2}[/-]\d{4}\b")), 1, 2)
    facts = F.filter(
        F.array(
            _fill(vocab.SAFE_YEAR, x=F.replace(F.regexp_replace(year, r"\s+", ""), F.lit("/"), F.lit("-"))),
            *[F.when(contains_any(F.col("_fold"), marks), F.lit(fact)) for marks, fact in vocab.SAFE_FACTS],
            F.when(
                F.size(dates) > 0,
                _fill(vocab.SAFE_DATES, x=F.array_join(F.transform(dates, lambda d: F.concat(F.lit("`"), d, F.lit("`"))), ", ")),
            ),
        ),
        lambda x: x.isNotNull(),
    )
    bullets = let(
        facts,
        lambda f: F.array_join(
            F.transform(F.when(F.size(f) > 0, f).otherwise(F.array(F.lit(vocab.SAFE_NOTHING))), lambda x: F.concat(F.lit("- "), x)), "\n"
        ),
    )
    answer = _lines(_fill(vocab.SAFE_HEAD, x=F.col("_src")), "", vocab.SAFE_LEAD, bullets, "", vocab.SAFE_TAIL)
    return rows.select("query_id", answer.alias("answer"))


# --- precedence -------------------------------------------------------------
ANSWER_KINDS = ["records", "safe", "exemption", "fee", "directives", "generated"]


def choose_answer(candidates: dict[str, Column]) -> Column:
    """Struct (answer_kind, answer) of the first kind that has an answer."""
    return F.coalesce(*[
        F.when(F.coalesce(candidates[kind], F.lit("")) != "", F.struct(F.lit(kind).alias("answer_kind"), candidates[kind].alias("answer")))
        for kind in ANSWER_KINDS if kind in candidates
    ])
