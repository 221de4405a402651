"""Conversation state over whole tables of turns.

Sessions can be long, so frames and carried values run over blocks of turns
(see ``numbering``). ``turns`` hold ``(session_id, turn, …)``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill import vocab
from corpusmill.operators.numbering import dense_index, fill_forward, neighbours

KEPT_MESSAGES = 4
SUMMARY_TURNS = 4
BOT_CHARS = 400
SUMMARY_CHARS = 200


def session_key(user_id: Column, session_id: Column) -> Column:
    """``user:session``, or the user alone; ``anonymous`` without a user."""
    return F.concat_ws(":", F.coalesce(user_id.cast("string"), F.lit("anonymous")), session_id)


def session_history(messages: DataFrame) -> DataFrame:
    """All messages of a session as one text, in turn order."""
    ordered = F.sort_array(F.collect_list(F.struct("turn", "content")))
    return messages.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.transform(ordered, lambda m: m.content), "\n").alias("history"),
    )


def recent_messages(turns: DataFrame, size: int = 4096) -> DataFrame:
    """The last four messages before each turn: two per earlier turn.

    ``turns`` hold the user query and the answer of each turn.
    """
    numbered = dense_index(turns, ["session_id"], ["turn"], "n", size)
    framed = neighbours(numbered, ["session_id"], "n", KEPT_MESSAGES // 2, ["query", "answer"], "_before", size)
    said = F.flatten(
        F.transform(
            "_before",
            lambda t: F.array(
                F.concat(F.lit("User: "), t.query), F.concat(F.lit("Bot: "), F.substring(t.answer, 1, BOT_CHARS))
            ),
        )
    )
    return framed.withColumn("recent", said).drop("_before")


def lead_summary(turns: Column) -> Column:
    """Default summary of a group of messages: their leading characters."""
    return F.substring(F.array_join(turns, "\n"), 1, SUMMARY_CHARS)


def session_memory(
    turns: DataFrame, summarise: Callable[[Column], Column] = lead_summary, size: int = 4096
) -> DataFrame:
    """Memory after each turn: summary, kept messages and turn count.

    Every fourth turn the kept messages are summarised and cut to the last
    four. The kept list therefore depends only on the last few turns: between
    compactions it holds the four messages left by the last one and those since.
    """
    numbered = dense_index(turns, ["session_id"], ["turn"], "turn_count", size)
    # A compaction sees up to 12 messages: four kept and eight new ones.
    reach = SUMMARY_TURNS + KEPT_MESSAGES // 2 - 1
    framed = neighbours(
        numbered, ["session_id"], "turn_count", reach, ["turn_count", "query", "answer"], "_before", size
    )
    here = F.array(F.struct("turn_count", "query", "answer"))
    window = F.concat("_before", here)
    done = F.floor(F.col("turn_count") / SUMMARY_TURNS) * SUMMARY_TURNS
    compacted = F.col("turn_count") % SUMMARY_TURNS == 0

    def messages(rows: Column) -> Column:
        return F.flatten(
            F.transform(
                rows,
                lambda t: F.array(
                    F.concat(F.lit("User: "), t.query),
                    F.concat(F.lit("Bot: "), F.substring(t.answer, 1, BOT_CHARS)),
                ),
            )
        )

    since = F.filter(window, lambda t: t.turn_count > done - KEPT_MESSAGES // 2)
    summed = F.filter(window, lambda t: t.turn_count > done - SUMMARY_TURNS - KEPT_MESSAGES // 2)
    out = framed.withColumns({
        "recent": messages(since),
        "_part": F.when(compacted, summarise(messages(summed))),
    })
    # Summaries grow by one part per four turns; only those rows are collected.
    parts = out.where("_part IS NOT NULL").select("session_id", "turn_count", "_part")
    so_far = Window.partitionBy("session_id").orderBy("turn_count").rowsBetween(Window.unboundedPreceding, 0)
    summaries = parts.select(
        "session_id", F.col("turn_count").alias("_done"),
        F.array_join(F.collect_list("_part").over(so_far), " | ").alias("summary"),
    )
    return (
        out.withColumn("_done", done.cast("bigint"))
        .join(summaries, ["session_id", "_done"], "left")
        .withColumn("summary", F.coalesce("summary", F.lit("")))
        .drop("_before", "_part", "_done")
    )


def context_history(summary: Column, recent: Column) -> Column:
    """Summary line, if any, and the last four messages."""
    last = F.slice(recent, F.greatest(F.size(recent) - KEPT_MESSAGES + 1, F.lit(1)), KEPT_MESSAGES)
    head = F.array(F.concat(F.lit("[Tóm tắt hội thoại trước: "), summary, F.lit("]")))
    return F.when(F.coalesce(summary, F.lit("")) != "", F.concat(head, last)).otherwise(last)


def last_topic(turns: DataFrame, size: int = 4096) -> DataFrame:
    """Topic remembered before each turn.

    ``turns`` hold intent, title and number of the top hit; unknown titles and
    student look-ups leave the topic as it was.
    """
    known = F.nullif(F.nullif("title", F.lit(vocab.UNKNOWN)), F.lit(""))
    number = F.nullif(F.nullif("doc_number", F.lit(vocab.UNKNOWN)), F.lit(""))
    topic = F.when(
        (F.col("intent") != "student_lookup") & known.isNotNull(), F.concat_ws(" - ", number, known)
    )
    return fill_forward(
        turns.withColumn("_topic", topic), ["session_id"], ["turn"], "_topic", "last_topic", size, strict=True
    ).drop("_topic")


def last_student(turns: DataFrame, size: int = 4096) -> DataFrame:
    """Student id and name remembered before each turn.

    ``turns`` hold ``set_id``/``set_name``: the values the turn leaves behind,
    ``''`` for a reset and null for no change.
    """
    out = fill_forward(turns, ["session_id"], ["turn"], "set_id", "last_student_id", size, strict=True)
    out = fill_forward(out, ["session_id"], ["turn"], "set_name", "last_student_name", size, strict=True)
    return out.withColumns({
        c: F.nullif(F.col(c), F.lit("")) for c in ("last_student_id", "last_student_name")
    })


def student_updates(query_id: Column, name: Column, remembered: Column, found_id: Column, found_name: Column) -> Column:
    """Struct (set_id, set_name) a look-up turn leaves behind.

    An explicit id resets the name; a name that is not contained in the
    remembered one resets the id, unless a look-up resolved it.
    """
    words = F.split(F.lower(name), r"\s+")
    changed = F.exists(words, lambda w: ~F.contains(F.lower(remembered), w))
    return (
        F.when(query_id.isNotNull(), F.struct(query_id.alias("set_id"), F.lit("").alias("set_name")))
        .when(found_id.isNotNull(), F.struct(found_id.alias("set_id"), found_name.alias("set_name")))
        .when(
            F.coalesce(changed, F.lit(False)),
            F.struct(F.lit("").alias("set_id"), F.lit(None).cast("string").alias("set_name")),
        )
    )


def last_sources(turns: DataFrame, size: int = 4096) -> DataFrame:
    """Source list shown on request: that of the last answered turn.

    ``sources`` is null for turns without retrieval and '' after a no-data turn.
    """
    return fill_forward(turns, ["session_id"], ["turn"], "sources", "cached_sources", size, strict=True)
