"""Quality rules: counts per document and line frequency across the documents of a host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.columns import SPACES, seeded, whole, words
from corpusmill.session import written

WINDOW = 5
#: What a line with a word holds.
WORDS = "[^\\x20\\x09-\\x0D]"


def _line_hash(line: Column) -> Column:
    """Hash of a line trimmed, in lower case, with 0 for each run of digits."""
    return seeded(1, F.lower(F.regexp_replace(F.btrim(line, F.lit(SPACES)), "[0-9]+", "0")))


def _windows(tokens: str) -> Column:
    return F.when(F.size(tokens) >= WINDOW, F.sequence(F.lit(1), F.size(tokens) - (WINDOW - 1))).otherwise(F.expr("array()").cast("array<int>"))


def _repeated_words(tokens: str, starts: str) -> Column:
    """Words inside 5-word windows that the text holds twice or more.

    Equal windows meet by sorting; the union of the covered runs is counted from
    the distance of each start to the one before it.
    """
    spelled = F.transform(starts, lambda i: F.struct(F.array_join(F.slice(tokens, i, F.lit(WINDOW)), " ").alias("w"), i.alias("i")))
    return F.when(F.size(F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.slice(tokens, i, F.lit(WINDOW)))))) < F.size(starts), F.sort_array(spelled))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per input row: id, host, text_hash, the base counts and ``lines``,
    the hash and length of each normalised line (trimmed, lower case, digit runs as 0).
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), whole(F.col(text_col)).alias("text"))
    split = base.select("*", words(F.col("text")).alias("tokens"), F.filter(F.split("text", "\n"), lambda x: x.rlike(WORDS)).alias("rows"))
    started = split.select("*", _windows("tokens").alias("starts"))
    paired = started.select("*", _repeated_words("tokens", "starts").alias("sorted"))
    at = lambda i: F.get("sorted", i)["w"]
    twice = F.filter("sorted", lambda x, i: (x["w"] == F.coalesce(at(i + 1), F.lit(""))) | (x["w"] == F.when(i > 0, at(i - 1)).otherwise(F.lit(""))))
    marked = paired.select("*", F.sort_array(F.transform(twice, lambda x: x["i"])).alias("hit"))
    covered = F.aggregate(
        "hit", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")))
    normal = F.transform("rows", lambda x: F.struct(_line_hash(x).alias("h"), F.char_length(F.btrim(x, F.lit(SPACES))).alias("n")))
    return marked.select(
        "id", "host", F.xxhash64("text").alias("text_hash"),
        F.size("tokens").cast("long").alias("n_words"),
        F.char_length(F.array_join("tokens", "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.regexp_replace("text", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("rows") - F.size(F.array_distinct("rows"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered["n"], F.lit(0)).cast("long").alias("n_repeat_words"),
        normal.alias("lines"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """Verdict per input row: id, counts, ``base_failed``, ``chars_dropped`` and ``kept``.

    A line is above the limits of its host if at least ``min_documents`` different
    texts of the host hold it, and no fewer than the square root of their number, a
    share that falls as the host grows; every document but the one of smallest id that
    holds it loses it. A document with less than ``min_left`` of its line characters left
    is depleted and rejected, as is one that fails the base rules. Texts are counted,
    not rows, so copies of one text do not make its lines common.

    Null or empty texts have no words and fail the base rules; a null host is a host
    of its own; rows with a null id lose no lines; equal rows get equal results, and
    rows of one id with different texts each their own.
    """
    return judged(docs, id_col, text_col, host_col, **limits).drop("host", "text_hash", "gone")


def judged(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", *,
    min_words: int = 10, max_repeat_percent: int = 20, min_documents: int = 20, min_left: float = 0.5,
) -> DataFrame:
    """The columns of ``quality_rules``, host and text_hash, which tell rows of one id apart,
    and ``gone``, the hashes of the normalised lines that the row loses.
    """
    base = written(measured(docs, id_col, text_col, host_col), "quality-rules")
    row = ["id", "host", "text_hash"]
    known = base.where(F.col("id").isNotNull())
    # (host, hash, text) is aggregated first, so a line or host with a third of all rows is spread.
    lines = known.select(*row, F.posexplode("lines").alias("at", "line")).select(*row, "at", "line.h", "line.n")
    common = lines.groupBy("host", "h", "text_hash").agg(F.min("id").alias("id")).groupBy("host", "h").agg(F.count("*").alias("texts"), F.min("id").alias("first"))
    hosts = known.groupBy("host", "text_hash").agg(F.lit(1)).groupBy("host").agg(F.count("*").alias("of"))
    at_host = F.col("l.host").eqNullSafe(F.col("r.host"))
    over = written(
        common.where(F.col("texts") >= min_documents).alias("l").join(hosts.alias("r"), at_host)
        .where(F.col("texts") * F.col("texts") >= F.col("of")).select("l.host", "h", "first"), "quality-rules-lines")
    # A set of places, as equal rows lose the same lines.
    lost = (
        lines.alias("l").join(over.alias("r"), at_host & (F.col("l.h") == F.col("r.h")) & (F.col("id") > F.col("first")))
        .groupBy("id", "l.host", "text_hash").agg(F.collect_set(F.struct("at", "l.h", "n")).alias("lost"))
        .select(*row, F.transform("lost", lambda x: x["h"]).alias("gone"), F.aggregate("lost", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("dropped")))
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    counted = base.select("*", total.alias("chars"), failed.alias("base_failed")).drop("lines").alias("b")
    same = (F.col("b.id") == F.col("x.id")) & F.col("b.host").eqNullSafe(F.col("x.host")) & (F.col("b.text_hash") == F.col("x.text_hash"))
    return (
        counted.join(lost.alias("x"), same, "left").select("b.*", "gone", F.coalesce("dropped", F.lit(0)).alias("chars_dropped"))
        .select(
            F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "chars_dropped",
            (~F.col("base_failed") & (F.col("chars") - F.col("chars_dropped") >= min_left * F.col("chars"))).alias("kept"),
            "host", "text_hash", "gone"))


def keep_good(docs: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns, each by its own verdict;
    texts are without the lines above the limits.
    """
    verdicts = judged(docs.select("doc_id", "text", "source"), **limits).where("kept")
    good = verdicts.groupBy(F.col("doc_id").alias("id"), "host", "text_hash").agg(F.first("gone").alias("gone"))
    whole_rows = docs.select(F.struct(*docs.columns).alias("doc"))
    own = (
        F.col("doc.doc_id").eqNullSafe(F.col("id")) & F.col("doc.source").cast("string").eqNullSafe(F.col("host"))
        & (F.xxhash64(whole(F.col("doc.text"))) == F.col("text_hash")))
    left = F.array_join(F.filter(F.split("doc.text", "\n"), lambda x: ~F.array_contains("gone", _line_hash(x)) | ~x.rlike(WORDS)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("doc.text")).otherwise(left)
    return whole_rows.join(good, own).select(*[text.alias(c) if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns])
