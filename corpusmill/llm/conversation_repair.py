"""Repair of conversations whose turns do not alternate as ``(s?(ua)+)?``.

Turns get one order over the whole table, one letter each for their role and first fault, and
each conversation's letters are aligned with the grammar (``turn_alignment``). The edits then
meet the turns again in that order, so texts are shuffled once and read as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import turn_alignment
from corpusmill.llm.columns import SPACES
from corpusmill.session import written

COLUMNS = ["conv_id", "turn", "role", "text"]
ROLES = {"u": "user", "a": "assistant"}


def _full(text: Column) -> Column:
    return F.coalesce(text, F.lit(" "))


def damage(turns: DataFrame) -> DataFrame:
    """Conversation turns with faults by the hash of ``conv_id:turn`` modulo 20: 0 drops a
    turn, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes its role user.

    Null roles and texts become one space, as do null parts of the hashed key. Other
    columns are left out.
    """
    key = F.concat(_full(F.col("conv_id").cast("string")), F.lit(":"), _full(F.col("turn").cast("string")))
    hit = (F.crc32(F.encode(key, "UTF-8")) % 20).cast("int")
    rows = turns.select("conv_id", "turn", _full(F.col("role")).alias("role"), _full(F.col("text")).alias("text"), hit.alias("_hit"))
    text = F.when(F.col("_hit") == 1, "").when(F.col("_hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("_hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = rows.where("_hit <> 0").withColumns({"text": text, "role": F.when(F.col("_hit") == 4, "user").otherwise(F.col("role"))})
    return rows.select(*COLUMNS, copies.alias("_copy")).drop("_copy")


def _ordered(turns: DataFrame) -> DataFrame:
    """Turns with ``_key`` (their conversation, null as one of its own), ``_same`` (hash of
    role and text) and ``_pos``, which grows by turn (nulls first), then ``_same``.

    The range exchange cuts long conversations, also at turns of one number. The result is
    written, so that later steps see one numbering.
    """
    rows = turns.select("conv_id", "turn", _full(F.col("role")).alias("role"), _full(F.col("text")).alias("text")).withColumns({
        "_key": F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("")),
        "_same": F.md5(F.encode(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), "UTF-8")),
    })
    order = [F.col("_key"), F.col("turn").asc_nulls_first(), F.col("_same")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(placed.withColumn("_pos", F.monotonically_increasing_id()), "turns")


def _coded(ordered: DataFrame) -> DataFrame:
    """(_key, _pos, turn, fault, code) of each turn; the code is its letter for ``align``."""
    last = F.substring(F.rtrim(F.col("text"), F.lit(SPACES)), -1, 1)
    kind = F.position(F.substring("role", 1, 1), F.lit("sua"))
    rows = ordered.select(
        "_key", "_pos", "turn", "_same", F.when((kind > 0) & (F.col("role") != ""), kind).otherwise(4).alias("kind"),
        (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))
    first = rows.groupBy("_key", "_same").agg(F.min("_pos").alias("first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("_pos") > F.col("first"), "duplicate").when(F.col("cut"), "truncated")
    marked = rows.join(first, ["_key", "_same"]).withColumn("fault", fault)
    letter = lambda letters: F.substring(F.lit(letters), F.col("kind"), F.lit(1))
    code = F.when(F.col("fault").isin("blank", "duplicate"), letter("0123")).when(F.col("fault") == "truncated", letter("SUAO")).otherwise(letter("suao"))
    return marked.select("_key", "_pos", "turn", "fault", code.alias("code"))


def _aligned(codes: pd.Series) -> pd.DataFrame:
    rows = []
    for c in codes:
        initials = "".join(map(turn_alignment.initial, c))
        legal = sum(initials.count(pair) for pair in ("su", "ua", "au"))
        rows.append((*turn_alignment.align(c), max(0, len(c) - 1) - legal))
    return pd.DataFrame([(cost, illegal, audit) for cost, audit, illegal in rows], columns=["cost", "illegal", "audit"])


def _audited(coded: DataFrame) -> DataFrame:
    """A row per conversation: counts of faults, gaps, illegal neighbours, cost and audit.

    Letters are joined 4096 places at a time first, so that a long conversation meets as its
    blocks; together they are as long as its audit.
    """
    kinds = ("blank", "duplicate", "truncated")
    part = coded.groupBy("_key", F.shiftright("_pos", 12).alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("_pos", "code"))).alias("rows"),
        *(F.count(F.when(F.col("fault") == k, 1)).alias(k) for k in kinds))
    part = part.withColumn("codes", F.array_join(F.transform("rows", lambda r: r.code), "")).drop("rows")
    whole = part.groupBy("_key").agg(
        F.sort_array(F.collect_list(F.struct("part", "codes"))).alias("parts"), *(F.sum(k).alias(k) for k in kinds))
    align = F.pandas_udf(_aligned, "cost long, illegal long, audit string")
    aligned = whole.withColumn("found", align(F.array_join(F.transform("parts", lambda p: p.codes), "")))
    numbers = coded.groupBy("_key", "turn").agg(F.lit(1)).groupBy("_key").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    return aligned.join(numbers, "_key").select("_key", "gaps", *kinds, "found.illegal", "found.cost", "found.audit")


REPAIRED = "conv_key string, place long, edit string, pos long, role string, text string"


def _apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Turns that the audits leave, of rows in order: a conversation's audit, then its turns.

    The audit stays until its conversation ends; turns pass by.
    """
    key, audit, at, place, expected = None, "", 0, 0, "u"

    def inserted(out: list) -> None:
        nonlocal at, place, expected
        while at < len(audit) and audit[at] == "I":
            out.append((key, place, "I", None, ROLES[expected], ""))
            at, place, expected = at + 1, place + 1, "a" if expected == "u" else "u"

    for batch in batches:
        out: list[tuple] = []
        for k, edits, pos, role, text in zip(batch["_key"], batch["_audit"], batch["_pos"], batch["role"], batch["text"]):
            if edits is not None:
                key, audit, at, place, expected = k, edits, 0, 0, "u"
                inserted(out)  # also those of a conversation without turns
                continue
            edit, at = audit[at], at + 1
            if edit != "D":
                out.append((key, place, edit, pos, role if edit == "K" else ROLES[expected], text))
                place += 1
                expected = "u" if (role[:1] if edit == "K" else expected) != "u" else "a"
            inserted(out)
        table = pd.DataFrame(out, columns=[c.split()[0] for c in REPAIRED.split(", ")], dtype=object)
        yield table.assign(pos=pd.array(table["pos"].tolist(), dtype="Int64"))


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hash of each conversation's lines ``role:text``, of rows in order."""
    key, digest, begun = None, hashlib.sha256(), False
    for batch in batches:
        out = []
        for k, role, text in zip(batch["conv_key"], batch["role"], batch["text"]):
            if k != key or not begun:
                if begun:
                    out.append((key, digest.hexdigest()))
                key, digest, begun = k, hashlib.sha256(), True
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        yield pd.DataFrame(out, columns=["conv_key", "sha256"])
    if begun:
        yield pd.DataFrame([(key, digest.hexdigest())], columns=["conv_key", "sha256"])


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, repaired turns) of turns ``(conv_id, turn, role, text)``.

    The first holds ``conv_key, gaps, blank, duplicate, truncated, illegal, cost, audit`` of
    each conversation, the second the turns that the audit keeps, changes or inserts, in
    order of ``place``. A conversation's turns are taken by turn, nulls first, equal numbers
    by the hash of role and text, so repeated rows stand side by side; the first fault of a
    turn counts. Null roles and texts are one space, null ``conv_id`` is a conversation of
    its own (key ``""``, else ``c`` and the id), and further columns are left out. An empty
    table gives two empty ones.

    A conversation's texts pass one task as a stream, sorted on disk; only its audit, one
    letter a turn, is held.
    """
    ordered = _ordered(turns)
    audited = written(_audited(_coded(ordered)), "turn-audits")
    nothing = {c: F.lit(None).cast(kind) for c, kind in (("role", "string"), ("text", "string"))}
    audits = audited.select("_key", F.col("audit").alias("_audit"), F.lit(-1).cast("long").alias("_pos")).withColumns(nothing)
    rows = ordered.select("_key", F.lit(None).cast("string").alias("_audit"), "_pos", "role", "text")
    streams = audits.unionByName(rows).repartition("_key").sortWithinPartitions("_key", "_pos")
    repaired = streams.mapInPandas(_apply, REPAIRED)
    return audited.withColumnRenamed("_key", "conv_key"), repaired


def digests(repaired: DataFrame) -> DataFrame:
    """``(conv_key, sha256)`` of the repaired lines, in the tasks that made them."""
    return repaired.mapInPandas(_digests, "conv_key string, sha256 string")


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """A row per ``conv_id`` of the table before damage: counts, audit and hash of the
    repaired lines. A conversation without turns left has zeros, no edits, and the hash of
    nothing.
    """
    audited, repaired = repair(damage(conversations))
    key = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit(""))
    ids = conversations.select("conv_id").distinct().withColumn("conv_key", key)
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    joined = ids.join(audited, "conv_key", "left").join(digests(repaired), "conv_key", "left")
    return joined.select(
        "conv_id", *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
