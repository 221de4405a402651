"""Listings and change-set merges over users, documents, sessions and feedback.

A write of the application is a table of requested changes joined to the base
table; the result is the next snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import session_title
from corpusmill.operators.numbering import first_per_key, page


def list_documents(documents: DataFrame, users: DataFrame, skip: int = 0, limit: int = 100) -> DataFrame:
    """Active documents with their uploader, a page at a time by id."""
    rows = page(documents.where("is_active"), [F.col("id")], skip, limit)
    people = users.select(F.col("id").alias("uploaded_by"), F.col("full_name").alias("uploader"))
    return rows.join(people, "uploaded_by", "left")


def list_trash(documents: DataFrame, skip: int = 0, limit: int = 100) -> DataFrame:
    return page(documents.where("NOT is_active"), [F.col("id")], skip, limit)


def document_content(documents: DataFrame, landed: DataFrame) -> DataFrame:
    """Documents whose file is present in the landing listing (``path``)."""
    return documents.join(landed.select(F.col("path").alias("file_path")), "file_path", "left_semi")


def list_sessions(sessions: DataFrame, user_id: int, skip: int = 0, limit: int = 100) -> DataFrame:
    """Sessions of a user: pinned first, then most recent (unset flags lead)."""
    order = [F.desc_nulls_first("is_pinned"), F.desc_nulls_first("updated_at"), F.col("id")]
    return page(sessions.where(F.col("user_id") == user_id), order, skip, limit)


def list_messages(messages: DataFrame, sessions: DataFrame, user_id: int) -> DataFrame:
    """Messages of all sessions the user owns, in time order per session."""
    owned = sessions.where(F.col("user_id") == user_id).select(F.col("id").alias("session_id"))
    return messages.join(owned, "session_id", "left_semi").orderBy("session_id", "turn", "id")


def touch_sessions(sessions: DataFrame, requests: DataFrame) -> DataFrame:
    """Next sessions: new ones titled by their first query, owned ones touched.

    ``requests`` holds ``(session_id, user_id, query, ts)``.
    """
    asked = requests.groupBy(F.col("session_id").alias("id"), "user_id").agg(
        F.min_by("query", "ts").alias("first_query"), F.max("ts").alias("last_ts")
    )
    touched = sessions.join(asked.select("id", "user_id", "last_ts"), ["id", "user_id"], "left").withColumn(
        "updated_at", F.coalesce("last_ts", "updated_at")
    ).drop("last_ts")
    new = asked.join(sessions.select("id"), "id", "left_anti").select(
        "id", "user_id", session_title(F.col("first_query")).alias("title"), F.col("last_ts").alias("updated_at")
    )
    return touched.unionByName(new, allowMissingColumns=True)


def patch(rows: DataFrame, changes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Set the given (non-null) fields only."""
    new = changes.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    out = rows.join(new, key, "left")
    return out.withColumns({f: F.coalesce(f"_{f}", f) for f in fields}).drop(*[f"_{f}" for f in fields])


def patch_set(rows: DataFrame, changes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Set the flagged fields, also to null; ``set_<field>`` is the flag."""
    new = changes.select(
        key, *[F.col(f).alias(f"_{f}") for f in fields], *[F.col(f"set_{f}").alias(f"_set_{f}") for f in fields]
    )
    out = rows.join(new, key, "left")
    merged = {
        f: F.when(F.coalesce(F.col(f"_set_{f}"), F.lit(False)), F.col(f"_{f}")).otherwise(F.col(f)) for f in fields
    }
    return out.withColumns(merged).select(*rows.columns)


def delete_sessions(sessions: DataFrame, messages: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions and messages left after deleting ``doomed`` (id, user_id) pairs."""
    owned = sessions.join(doomed.select("id", "user_id"), ["id", "user_id"], "left_semi").select("id")
    left = sessions.join(owned, "id", "left_anti")
    gone = owned.select(F.col("id").alias("session_id"))
    return left, messages.join(gone, "session_id", "left_anti")


def list_users(users: DataFrame, me: int, skip: int = 0, limit: int = 100) -> DataFrame:
    return page(users.where(F.col("id") != me), [F.col("id")], skip, limit)


def create_users(users: DataFrame, requests: DataFrame) -> DataFrame:
    """Users plus accepted requests: e-mail new to the table and to the batch."""
    fresh = requests.join(users.select("email"), "email", "left_anti")
    fresh = first_per_key(fresh, ["email"], [F.col("request_id")])
    accepted = fresh.withColumns({
        "is_superuser": F.coalesce("is_superuser", F.lit(False)) | F.coalesce(F.col("role") == "admin", F.lit(False)),
        "role": F.coalesce("role", F.lit("user")),
        "is_active": F.lit(True),
    }).drop("request_id")
    return users.unionByName(accepted, allowMissingColumns=True)


def delete_users(doomed: DataFrame, me: int, **tables: DataFrame) -> dict[str, DataFrame]:
    """Tables left after deleting users and all that hangs on them.

    ``tables``: users, documents, sessions, messages, feedback. Documents stay,
    without uploader.
    """
    ids = doomed.where(F.col("id") != me).select("id")
    owned = tables["sessions"].join(ids.select(F.col("id").alias("user_id")), "user_id", "left_semi").select(
        F.col("id").alias("session_id")
    )
    said = tables["messages"].join(owned, "session_id", "left_semi").select(F.col("id").alias("chat_message_id"))
    marks = ids.select(F.col("id").alias("uploaded_by"), F.lit(True).alias("_gone"))
    documents = tables["documents"].join(marks, "uploaded_by", "left").withColumn(
        "uploaded_by", F.when(F.col("_gone").isNull(), F.col("uploaded_by"))
    ).drop("_gone")
    return {
        "users": tables["users"].join(ids, "id", "left_anti"),
        "documents": documents,
        "sessions": tables["sessions"].join(owned.select(F.col("session_id").alias("id")), "id", "left_anti"),
        "messages": tables["messages"].join(owned, "session_id", "left_anti"),
        "feedback": tables["feedback"].join(said, "chat_message_id", "left_anti"),
    }


def toggle(users: DataFrame, changes: DataFrame, field: str, me: int) -> DataFrame:
    """Flip a flag of the named users, never of the caller."""
    marks = changes.where(F.col("id") != me).select("id").distinct().withColumn("_flip", F.lit(True))
    return users.join(marks, "id", "left").withColumn(
        field, F.when(F.col("_flip"), ~F.col(field)).otherwise(F.col(field))
    ).drop("_flip")


def audit_details(details: Column, structured: bool) -> Column:
    """JSON of a struct, map or array; other values as text; '' if missing."""
    text = F.to_json(details) if structured else details.cast("string")
    return F.coalesce(text, F.lit(""))


def append_audit(log: DataFrame, entries: DataFrame, structured: bool = False) -> DataFrame:
    rows = entries.withColumns({
        "entity_id": F.col("entity_id").cast("string"),
        "details": audit_details(F.col("details"), structured),
    })
    return log.unionByName(rows.select(*log.columns))


def user_counts(users: DataFrame) -> DataFrame:
    return users.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("is_superuser").alias("superusers"),
        F.count_if("is_active").alias("active"),
    )


def any_processing(documents: DataFrame) -> DataFrame:
    return documents.where("is_active").agg(
        F.coalesce(F.bool_or(~F.col("is_processed")), F.lit(False)).alias("processing")
    )


def bad_cases(feedback: DataFrame, messages: DataFrame) -> DataFrame:
    """Disliked answers with the message they judge."""
    said = messages.select(F.col("id").alias("chat_message_id"), "session_id", "content")
    return feedback.where("score = 1").join(said, "chat_message_id")


def correct_feedback(feedback: DataFrame, corrections: DataFrame) -> DataFrame:
    new = corrections.select("chat_message_id", F.col("chosen_response").alias("_chosen"))
    return feedback.join(new, "chat_message_id", "left").withColumns({
        "status": F.when(F.col("_chosen").isNotNull(), "reviewed").otherwise(F.col("status")),
        "chosen_response": F.coalesce("_chosen", "chosen_response"),
    }).drop("_chosen")


def preference_pairs(messages: DataFrame, feedback: DataFrame) -> DataFrame:
    """(prompt, chosen, rejected) of reviewed feedback.

    The prompt is the user message one turn before the judged answer, found by
    an equi-join on session and turn rather than a window over sessions.
    """
    judged = feedback.where("status = 'reviewed' AND chosen_response IS NOT NULL")
    answers = messages.select(F.col("id").alias("chat_message_id"), "session_id", "turn").join(
        judged.select("chat_message_id", "chosen_response", "rejected_response"), "chat_message_id"
    ).withColumn("turn", F.col("turn") - 1)
    prompts = messages.where("role = 'user'").select("session_id", "turn", F.col("content").alias("prompt"))
    return answers.join(prompts, ["session_id", "turn"]).select(
        "chat_message_id", "prompt", F.col("chosen_response").alias("chosen"),
        F.col("rejected_response").alias("rejected"),
    )


def training_ready(feedback: DataFrame, needed: int = 100) -> DataFrame:
    reviewed = F.count_if(F.col("status") == "reviewed")
    return feedback.agg(reviewed.alias("reviewed"), (reviewed > needed).alias("ready"))
