"""Line deduplication across documents, by hash of the normalised line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.columns import SPACES, ascii_lower, seeded, whole
from corpusmill.session import written


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(id, positions): the positions of the lines a document loses.

    Lines travel as two independent 64-bit hashes. Distinct documents are counted
    over (line, document) first, so that a very common line is spread; the join that
    brings the counts back has one row per line on one side, and a common line on
    the other side is split by the adaptive skew join.
    """
    keys = F.transform(F.split(whole(F.col(text_col)), "\n"), line_key)
    hashed = F.transform(keys, lambda k: F.when(F.char_length(k) >= min_chars, F.struct(F.xxhash64(k).alias("a"), seeded(2, k).alias("b"))))
    lines = (
        docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(hashed).alias("pos", "key"))
        .where(F.col("key").isNotNull()).select("id", "pos", "key.a", "key.b"))
    lines = written(lines, "line-dedup")
    counted = lines.groupBy("a", "b", "id").agg(F.lit(1)).groupBy("a", "b").agg(F.count("*").alias("docs"), F.max("id").alias("last"))
    # written, so that it joins by an exchange of its own, which lets a common line be split
    often = written(counted.where(F.col("docs") >= min_docs).select("a", "b", "last"), "line-dedup-often")
    return lines.join(often, ["a", "b"]).where(F.col("id") != F.col("last")).groupBy("id").agg(F.collect_set("pos").alias("positions"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """Input columns with the text less its repeated lines, and n_lines, n_dropped.

    A key of at least ``min_chars`` code points that at least ``min_docs`` documents
    hold stays only in the document of largest id. Null and empty texts are one
    empty line; repeated lines of the keeper stay; rows with a null id stay whole;
    rows of equal id count as one document.
    """
    lost = repeated_lines(docs, id_col, text_col, **limits).select(F.col("id").alias("_lost_id"), F.col("positions").alias("_lost"))
    split = F.split(whole(F.col(text_col)), "\n")
    joined = docs.join(lost, docs[id_col] == lost["_lost_id"], "left").withColumn("_lines", split)
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_lost"))
    kept = F.array_join(F.transform(left, lambda p: F.get("_lines", p)), "\n")
    own = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    text = F.when(F.col("_lost").isNull(), whole(F.col(text_col))).otherwise(kept).alias(text_col)
    return joined.select(*own, text, F.size("_lines").cast("long").alias("n_lines"), F.coalesce(F.size("_lost"), F.lit(0)).cast("long").alias("n_dropped"))
