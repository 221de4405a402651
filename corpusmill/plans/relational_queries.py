"""Listings and change-set merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import filters as FL
from corpusmill.operators import relational as R
from corpusmill.operators import versions as V
from corpusmill.operators.conversation import session_history
from corpusmill.plans.chunk_queries import _LOG
from corpusmill.plans.registry import query

col = F.col
ME = 7


def _documents(t):
    return V.version_log(t.uploads)


_DOCS = f"SELECT v.*, u.uploaded_by FROM ({_LOG}) v JOIN {{uploads}} u ON u.id = v.id"


@query("documents_list", "id bigint, filename string, version bigint, uploader string",
       f"SELECT d.id, filename, version, full_name AS uploader FROM (SELECT * FROM ({_DOCS}) WHERE is_active ORDER BY id LIMIT 100 OFFSET 1) d LEFT JOIN {{users}} u ON u.id = d.uploaded_by")
def _(t):
    return R.list_documents(_documents(t), t.users, 1)


@query("documents_trash", "id bigint, filename string, version bigint",
       f"SELECT id, filename, version FROM ({_DOCS}) WHERE NOT is_active ORDER BY id LIMIT 100 OFFSET 5")
def _(t):
    return R.list_trash(_documents(t), 5)


@query("documents_content", "id bigint",
       "SELECT id FROM {uploads} WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = id)")
def _(t):
    docs = t.uploads.withColumn("file_path", F.concat(F.lit("/landing/"), col("id")))
    return R.document_content(docs, t.labels.select(F.concat(F.lit("/landing/"), col("doc_id")).alias("path")))


@query("documents_any_processing", "processing boolean",
       f"SELECT coalesce(bool_or(NOT is_processed), FALSE) AS processing FROM ({_LOG}) WHERE is_active")
def _(t):
    return R.any_processing(_documents(t))


@query("sessions_list", "id string, is_pinned boolean, updated_at bigint",
       f"SELECT id, is_pinned, updated_at FROM {{sessions}} WHERE user_id = {ME} ORDER BY is_pinned DESC NULLS FIRST, updated_at DESC NULLS FIRST, id LIMIT 100")
def _(t):
    return R.list_sessions(t.sessions, ME)


@query("messages_list", "id bigint, session_id string, role string, content string",
       f"SELECT id, session_id, role, content FROM {{messages}} WHERE session_id IN (SELECT id FROM {{sessions}} WHERE user_id = {ME})")
def _(t):
    return R.list_messages(t.messages, t.sessions, ME)


_REQ = """SELECT CASE WHEN conv_id % 2 = 0 THEN session_id ELSE 'new-' || session_id END AS session_id, CASE WHEN conv_id % 3 = 0 THEN user_id + 1 ELSE user_id END AS user_id,
  content AS query, id + 5000000 AS ts FROM {messages} WHERE role = 'user'"""


@query("sessions_touch", "id string, user_id bigint, title string, updated_at bigint", f"""
SELECT s.id, s.user_id, CAST(NULL AS VARCHAR) AS title, coalesce(a.last_ts, s.updated_at) AS updated_at FROM {{sessions}} s
LEFT JOIN (SELECT session_id, user_id, max(ts) AS last_ts FROM ({_REQ}) GROUP BY session_id, user_id) a ON a.session_id = s.id AND a.user_id = s.user_id
UNION ALL
SELECT session_id, user_id, CASE WHEN length(q) > 50 THEN left(q, 50) || '...' ELSE q END, last_ts
FROM (SELECT session_id, user_id, arg_min(query, ts) AS q, max(ts) AS last_ts FROM ({_REQ}) GROUP BY session_id, user_id) WHERE session_id LIKE 'new-%'""")
def _(t):
    return R.touch_sessions(t.sessions, t.sql(_REQ))


_PATCH = "SELECT session_id AS id, CASE WHEN min(conv_id) % 3 = 0 THEN NULL ELSE 'T' || session_id END AS title, CASE WHEN min(conv_id) % 2 = 0 THEN TRUE ELSE NULL END AS is_pinned FROM {messages} WHERE role = 'system' OR turn = 0 GROUP BY session_id"


@query("sessions_patch", "id string, title string, is_pinned boolean",
       f"SELECT s.id, coalesce(p.title, 'old') AS title, coalesce(p.is_pinned, s.is_pinned) AS is_pinned FROM {{sessions}} s LEFT JOIN ({_PATCH}) p ON p.id = s.id")
def _(t):
    return R.patch(t.sessions.withColumn("title", F.lit("old")), t.sql(_PATCH), "id", ["title", "is_pinned"])


_DOOMED = "SELECT session_id AS id, CASE WHEN conv_id % 3 = 0 THEN user_id ELSE user_id + 1 END AS user_id FROM {messages} WHERE turn = 1"


@query("sessions_delete", "kind string, id string", f"""
WITH gone AS (SELECT s.id FROM {{sessions}} s JOIN ({_DOOMED}) d ON d.id = s.id AND d.user_id = s.user_id)
SELECT 'session' AS kind, id FROM {{sessions}} WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'message', CAST(id AS VARCHAR) FROM {{messages}} WHERE session_id NOT IN (SELECT id FROM gone)""")
def _(t):
    sessions, messages = R.delete_sessions(t.sessions, t.messages, t.sql(_DOOMED))
    return sessions.select(F.lit("session").alias("kind"), "id").unionByName(
        messages.select(F.lit("message").alias("kind"), col("id").cast("string").alias("id")))


@query("session_history", "session_id string, n bigint, history string",
       "SELECT session_id, count(*) AS n, string_agg(content, chr(10) ORDER BY turn) AS history FROM {messages} GROUP BY session_id")
def _(t):
    return session_history(t.messages)


@query("users_list", "id bigint, full_name string", f"SELECT id, full_name FROM {{users}} WHERE id <> {ME} ORDER BY id LIMIT 100 OFFSET 3")
def _(t):
    return R.list_users(t.users, ME, 3)


@query("users_get", "id bigint, email string", f"SELECT id, email FROM {{users}} WHERE id = {ME}")
def _(t):
    return t.users.where(col("id") == ME)


@query("users_search", "id bigint", "SELECT id FROM {users} WHERE contains(lower(email), 'mach') OR contains(lower(coalesce(full_name, '')), 'mach')")
def _(t):
    return t.users.where(FL.search_box(F.lit("MACH")))


@query("users_roles", "id bigint, is_admin boolean, is_manager boolean", """
SELECT id, is_superuser OR coalesce(role = 'admin', FALSE) AS is_admin, is_superuser OR coalesce(role IN ('admin', 'lecturer'), FALSE) AS is_manager FROM {users}""")
def _(t):
    return t.users.select("id", FL.is_admin().alias("is_admin"), FL.is_content_manager().alias("is_manager"))


_NEW = """SELECT s_suppkey AS request_id, s_suppkey + 10000000 AS id, s_name AS full_name, CASE WHEN s_suppkey % 2 = 0
  THEN 'customer.' || lpad(CAST(s_suppkey AS STRING), 9, '0') || '@machinery.example.org' ELSE 'n' || CAST(s_nationkey AS STRING) || '@example.org' END AS email,
  FALSE AS is_superuser, CASE WHEN s_nationkey = 1 THEN 'admin' WHEN s_nationkey = 2 THEN NULL ELSE 'user' END AS role FROM {supplier}"""


@query("users_create", "id bigint, email string, is_superuser boolean, role string, is_active boolean", f"""
SELECT id, email, is_superuser, role, is_active FROM {{users}}
UNION ALL SELECT id, email, coalesce(role = 'admin', FALSE), coalesce(role, 'user'), TRUE
FROM (SELECT *, row_number() OVER (PARTITION BY email ORDER BY request_id) AS rn FROM ({_NEW}) WHERE email NOT IN (SELECT email FROM {{users}})) WHERE rn = 1""")
def _(t):
    return R.create_users(t.users, t.sql(_NEW))


_SET = "SELECT c_custkey AS id, CASE WHEN c_nationkey < 10 THEN 'lecturer' ELSE NULL END AS role, c_nationkey < 15 AS set_role, 'X' AS full_name, c_nationkey = 3 AS set_full_name FROM {customer}"


@query("users_update", "id bigint, role string, full_name string",
       f"SELECT u.id, CASE WHEN set_role THEN p.role ELSE u.role END AS role, CASE WHEN set_full_name THEN p.full_name ELSE u.full_name END AS full_name FROM {{users}} u LEFT JOIN ({_SET}) p ON p.id = u.id")
def _(t):
    return R.patch_set(t.users, t.sql(_SET), "id", ["role", "full_name"])


@query("users_delete", "kind string, id string, extra string", f"""
WITH ids AS (SELECT id FROM {{users}} WHERE role IS NULL AND id <> {ME}), own AS (SELECT id FROM {{sessions}} WHERE user_id IN (SELECT id FROM ids))
SELECT 'user' AS kind, CAST(id AS VARCHAR) AS id, '' AS extra FROM {{users}} WHERE id NOT IN (SELECT id FROM ids)
UNION ALL SELECT 'document', CAST(id AS VARCHAR), CASE WHEN uploaded_by IN (SELECT id FROM ids) THEN NULL ELSE CAST(uploaded_by AS VARCHAR) END FROM {{uploads}}
UNION ALL SELECT 'session', id, '' FROM {{sessions}} WHERE id NOT IN (SELECT id FROM own)
UNION ALL SELECT 'message', CAST(id AS VARCHAR), '' FROM {{messages}} WHERE session_id NOT IN (SELECT id FROM own)
UNION ALL SELECT 'feedback', CAST(chat_message_id AS VARCHAR), '' FROM {{feedback}} WHERE chat_message_id NOT IN (SELECT id FROM {{messages}} WHERE session_id IN (SELECT id FROM own))""")
def _(t):
    doomed = t.users.where("role IS NULL").select("id")
    left = R.delete_users(doomed, ME, users=t.users, documents=t.uploads, sessions=t.sessions,
                          messages=t.messages, feedback=t.feedback)
    keys = {"users": ("user", "id"), "documents": ("document", "id"), "sessions": ("session", "id"),
            "messages": ("message", "id"), "feedback": ("feedback", "chat_message_id")}
    parts = []
    for name, (kind, key) in keys.items():
        extra = col("uploaded_by").cast("string") if name == "documents" else F.lit("")
        parts.append(left[name].select(F.lit(kind).alias("kind"), col(key).cast("string").alias("id"), extra.alias("extra")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("users_toggle", "id bigint, is_superuser boolean, is_active boolean",
       f"SELECT id, CASE WHEN role = 'lecturer' AND id <> {ME} THEN NOT is_superuser ELSE is_superuser END AS is_superuser, CASE WHEN role = 'admin' AND id <> {ME} THEN NOT is_active ELSE is_active END AS is_active FROM {{users}}")
def _(t):
    users = R.toggle(t.users, t.users.where("role = 'lecturer'"), "is_superuser", ME)
    return R.toggle(users, t.users.where("role = 'admin'"), "is_active", ME)


@query("audit_page", "event_id bigint, event_type string, props string",
       "SELECT event_id, event_type, props FROM events ORDER BY event_id LIMIT 100 OFFSET 50")
def _(t):
    from corpusmill.operators.numbering import page

    return page(t.events, [col("event_id")], 50, 100)


@query("audit_append", "entity_id string, action string, details string",
       """SELECT CAST(event_id AS VARCHAR) AS entity_id, event_type AS action, '{"user":' || CAST(user_id AS VARCHAR) || ',"kind":"' || event_type || '"}' AS details FROM events
UNION ALL SELECT CAST(event_id AS VARCHAR), event_type, coalesce(props, '') FROM events""")
def _(t):
    base = t.events.select(col("event_id").alias("entity_id"), col("event_type").alias("action"), "user_id", "props")
    log = base.limit(0).select(col("entity_id").cast("string"), "action", F.lit("").alias("details"))
    structured = base.withColumn("details", F.struct(col("user_id").alias("user"), col("action").alias("kind")))
    return R.append_audit(R.append_audit(log, structured, True), base.withColumn("details", col("props")))


@query("users_counts", "total bigint, superusers bigint, active bigint",
       "SELECT count(*) AS total, count(*) FILTER (WHERE is_superuser) AS superusers, count(*) FILTER (WHERE is_active) AS active FROM {users}")
def _(t):
    return R.user_counts(t.users)


@query("feedback_bad_cases", "chat_message_id bigint, session_id string, content string",
       "SELECT chat_message_id, session_id, content FROM {feedback} f JOIN {messages} m ON m.id = f.chat_message_id WHERE score = 1")
def _(t):
    return R.bad_cases(t.feedback, t.messages)


_FIX = "SELECT id AS chat_message_id, 'Better: ' || content AS chosen_response FROM {messages} WHERE role = 'ai' AND turn < 3"


@query("feedback_correct", "chat_message_id bigint, status string, chosen_response string",
       f"SELECT f.chat_message_id, CASE WHEN c.chosen_response IS NOT NULL THEN 'reviewed' ELSE status END AS status, coalesce(c.chosen_response, f.chosen_response) AS chosen_response FROM {{feedback}} f LEFT JOIN ({_FIX}) c ON c.chat_message_id = f.chat_message_id")
def _(t):
    return R.correct_feedback(t.feedback, t.sql(_FIX))


@query("feedback_preference_pairs", "chat_message_id bigint, prompt string, chosen string, rejected string", """
SELECT chat_message_id, prompt, chosen_response AS chosen, rejected_response AS rejected
FROM (SELECT id, lag(content) OVER w AS prompt, lag(role) OVER w AS prev_role FROM {messages} WINDOW w AS (PARTITION BY session_id ORDER BY turn)) m
JOIN {feedback} f ON f.chat_message_id = m.id WHERE prev_role = 'user' AND status = 'reviewed' AND chosen_response IS NOT NULL""")
def _(t):
    return R.preference_pairs(t.messages, t.feedback)


@query("feedback_training_ready", "reviewed bigint, ready boolean",
       "SELECT count(*) FILTER (WHERE status = 'reviewed') AS reviewed, count(*) FILTER (WHERE status = 'reviewed') > 100 AS ready FROM {feedback}")
def _(t):
    return R.training_ready(t.feedback)
