"""Query understanding and conversation state."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill import vocab as V
from corpusmill.operators import conversation as C
from corpusmill.operators import understanding as Q
from corpusmill.plans import sqltext as S
from corpusmill.plans.registry import query
from corpusmill.plans.search_queries import _any

col = F.col
_NQ = S.normalize_query("query")
_NW = S.NOT_WORD
_LETTER = r"[\p{L}\p{N}_À-ỹ]"


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# --- names and intent -------------------------------------------------------
def _plausible(x: str) -> str:
    tokens = f"[w FOR w IN string_split({x}, ' ') IF w <> '']"
    bad = f"len([w FOR w IN string_split({x}, ' ') IF list_contains({_list(V.NOT_NAME_WORDS)}, lower(w))])"
    return f"(NOT regexp_matches({x}, '[0-9]') AND len({tokens}) BETWEEN 2 AND 5 AND {bad} < greatest(2, len({tokens}) - 1))"


_SPANS = f"regexp_extract_all(nq, '(?:^|{_NW})([A-ZÀ-Ỹ]{_LETTER}{{1,6}}(?:\\s+[A-ZÀ-Ỹ]{_LETTER}{{1,6}}){{1,4}})(?:$|{_NW})', 1)"
_AFTER = f"trim(regexp_extract(nq, '(?i)(?:của|hỏi về|về)\\s+(?:sinh viên|bạn|bạn tên|người tên)?\\s*({_LETTER}+(?:\\s+{_LETTER}+){{1,4}})', 1))"
_CUT = f"trim(regexp_replace(' ' || after || ' ', '(?i){_NW}(là|bao nhiêu|như thế nào|ra sao|học|tại){_NW}.*', ''))"
_NAMED = f"""SELECT query_id, user_id, segment, query, nq, lower(nq) AS low,
  CASE WHEN {_any('lower(nq)', V.PERSON_HINTS)} THEN coalesce([s FOR s IN {_SPANS} IF NOT {_any('s', V.PLACE_SPANS)} AND {_plausible('s')}][-1],
    CASE WHEN {_plausible('cand')} THEN array_to_string([upper(left(w, 1)) || lower(substr(w, 2)) FOR w IN string_split(cand, ' ')], ' ') END) END AS person
FROM (SELECT *, {_CUT} AS cand FROM (SELECT *, {_AFTER} AS after FROM (SELECT *, {_NQ} AS nq FROM {{questions}})))"""


@query("query_person_name", "query_id bigint, person string", f"SELECT query_id, person FROM ({_NAMED})")
def _(t):
    return t.questions.select("query_id", Q.person_name(col("query")).alias("person"))


@query("query_person_plausible", "id bigint, ok boolean",
       f"SELECT id, {_plausible('replace(full_name, chr(35), chr(32))')} AS ok FROM {{users}}")
def _(t):
    return t.users.select("id", Q.looks_like_person_name(F.translate("full_name", "#", " ")).alias("ok"))


_INTENT = f"""CASE WHEN {_any('low', V.INTENT_DOC_STRONG)} THEN 'document_info'
  WHEN regexp_matches(nq, '(^|{_NW})[0-9]{{10}}($|{_NW})') OR {_any('low', V.INTENT_STUDENT)} THEN 'student_lookup'
  WHEN {_any('low', V.INTENT_SCORE)} AND person IS NOT NULL THEN 'student_lookup'
  WHEN {_any('low', V.INTENT_DOC)} THEN 'document_info' WHEN {_any('low', V.INTENT_SCORE)} THEN 'score_general'
  WHEN {_any('low', V.INTENT_SCHEDULE)} THEN 'schedule' WHEN {_any('low', V.INTENT_REGULATION)} THEN 'regulation'
  WHEN {_any('low', V.INTENT_EXAM)} THEN 'exam' ELSE 'general' END"""


@query("query_intent", "query_id bigint, intent string", f"SELECT query_id, {_INTENT} AS intent FROM ({_NAMED})")
def _(t):
    return t.questions.select("query_id", Q.intent(col("query")).alias("intent"))


# --- gates ------------------------------------------------------------------
_BARE = S.rep("low", r"[?!.,;: ]+\z")
_NWORDS = "len([w FOR w IN string_split(low, ' ') IF w <> ''])"
_TALK = f"list_contains({_list(V.SMALL_TALK)}, bare)"
_SHORT = f"regexp_matches(low, '(^|{_NW})(?:{'|'.join(V.FOLLOWUP_SHORT)})($|{_NW})')"
_STARTS = "(" + " OR ".join(f"starts_with(low, '{p}')" for p in V.FOLLOWUP_STARTS) + ")"


def _gate(history: str) -> str:
    return f"""CASE WHEN regexp_matches(bare, '^(xin\\s+chào|(chào|hello|hi|hey)($|{_NW}))') OR regexp_matches(bare, '^(cảm\\s*ơn|(thanks|thank you)($|{_NW}))') OR {_TALK} THEN FALSE
  WHEN {_any('low', V.DOMAIN_TERMS)} THEN TRUE
  WHEN {history} AND ({_any('low', V.FOLLOWUP_LONG)} OR (NOT {_TALK} AND (({_NWORDS} <= 6 AND {_STARTS}) OR ({_SHORT} AND {_NWORDS} > 3)))) THEN TRUE
  WHEN contains(low, '?') AND length(low) > 8 THEN TRUE ELSE length(low) > 15 END"""


@query("query_needs_search", "query_id bigint, first_turn boolean, later_turn boolean",
       f"SELECT query_id, {_gate('FALSE')} AS first_turn, {_gate('TRUE')} AS later_turn FROM (SELECT *, {_BARE} AS bare FROM ({_NAMED}))")
def _(t):
    return t.questions.select(
        "query_id", Q.needs_search(col("query"), F.lit(False)).alias("first_turn"),
        Q.needs_search(col("query"), F.lit(True)).alias("later_turn"))


@query("query_student_followup", "query_id bigint, followup boolean, without_memory boolean",
       f"SELECT query_id, {_NWORDS} <= 8 AND {_any('low', V.PERSONAL_TERMS)} AS followup, FALSE AS without_memory FROM ({_NAMED})")
def _(t):
    return t.questions.select(
        "query_id", Q.is_student_followup(col("query"), F.lit("1")).alias("followup"),
        Q.is_student_followup(col("query"), F.lit(None).cast("string")).alias("without_memory"))


@query("query_bare_number", "query_id bigint, bare boolean",
       f"SELECT query_id, regexp_matches(nq, '^[0-9]+$') AS bare FROM ({_NAMED})")
def _(t):
    return t.questions.select("query_id", Q.is_bare_number(col("query"), F.lit(True)).alias("bare"))


_RW = "NOT list_contains({g}, x) AND length(x) > 5 AND ({h} OR {t})"


@query("query_rewrite_gate", "query_id bigint, first_turn boolean, later_turn boolean", f"""
SELECT query_id, {_RW.format(g=_list(V.REWRITE_GREETINGS), h='FALSE', t=_any('x', V.REWRITE_CONTEXT_TERMS))} AS first_turn,
  {_RW.format(g=_list(V.REWRITE_GREETINGS), h='TRUE', t='TRUE')} AS later_turn FROM (SELECT *, trim(lower(query)) AS x FROM {{questions}})""")
def _(t):
    return t.questions.select(
        "query_id", Q.needs_rewrite(col("query"), F.lit(False)).alias("first_turn"),
        Q.needs_rewrite(col("query"), F.lit(True)).alias("later_turn"))


_SWAP = "CASE " + " ".join(
    f"WHEN contains(low, '{p}') THEN left(low, instr(low, '{p}') - 1) || '\"Quy chế\"' || substr(low, instr(low, '{p}') + {len(p)})"
    for p in V.PRONOUNS) + " ELSE query END"


@query("query_pronouns", "query_id bigint, resolved string, without_topic string",
       f"SELECT query_id, {_SWAP} AS resolved, query AS without_topic FROM (SELECT *, lower(query) AS low FROM {{questions}})")
def _(t):
    return t.questions.select(
        "query_id", Q.resolve_pronoun(col("query"), F.lit("Quy chế")).alias("resolved"),
        Q.resolve_pronoun(col("query"), F.lit(None).cast("string")).alias("without_topic"))


# --- keywords ---------------------------------------------------------------
_U, _L = V.UPPER_CLASS, V.LOWER_CLASS
_FULL = f"regexp_extract_all(nq, '(?:^|{_NW})((?:[{_U}][{_L}]+\\s+){{1,3}}[{_U}][{_L}]+)(?:$|{_NW})', 1)"
_KW = f"""list_concat(full_names,
  [w FOR w IN [trim(x, '?,.!') FOR x IN string_split(nq, ' ')] IF length(w) >= 2 AND regexp_matches(w, '^\\p{{Lu}}') AND NOT list_contains({_list(V.COMMON_WORDS)}, lower(w)) AND len([n FOR n IN full_names IF contains(n, w)]) = 0],
  [p FOR p IN {_list(V.DOMAIN_PHRASES)} IF contains(low, p) OR contains({S.fold_query('nq')}, {S.fold_query('p')})],
  {', '.join(f"CASE WHEN {_any('low', g)} THEN {_list(g)} ELSE [] END" for g in V.SYNONYM_GROUPS)},
  [w FOR w IN regexp_extract_all(low, '{_LETTER}{{3,}}') IF NOT list_contains({_list(V.COMMON_WORDS)}, w) AND NOT regexp_matches(w, '^[0-9]+$')],
  regexp_extract_all(nq, '(?:^|{_NW})([0-9]{{7,10}})(?:$|{_NW})', 1),
  flatten([[regexp_replace(r, '\\s+', '', 'g'), replace(regexp_replace(r, '\\s+', '', 'g'), '/', '-')] FOR r IN regexp_extract_all(nq, '(20[0-9]{{2}}\\s*[-/]\\s*20[0-9]{{2}})', 1)]),
  regexp_extract_all(regexp_replace(nq, '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g'), '(?:^|{_NW})(20[0-9]{{2}})(?:$|{_NW})', 1),
  regexp_extract_all(nq, '["''](.+?)["'']', 1))"""
_KEYS = f"""SELECT query_id, string_agg(k, '|' ORDER BY i) AS keywords FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, lower(k) ORDER BY i) AS rn FROM (
    SELECT query_id, unnest(ks) AS k, unnest(range(1, len(ks) + 1)) AS i FROM (
      SELECT query_id, {_KW} AS ks FROM (SELECT *, {_FULL} AS full_names FROM ({_NAMED}))))
  WHERE length(k) >= 2) WHERE rn = 1 GROUP BY query_id"""


@query("query_keywords", "query_id bigint, keywords string",
       f"SELECT q.query_id, coalesce(k.keywords, '') AS keywords FROM {{questions}} q LEFT JOIN ({_KEYS}) k ON k.query_id = q.query_id")
def _(t):
    return t.questions.select("query_id", F.array_join(Q.keywords(col("query")), "|").alias("keywords"))


@query("query_keywords_merge", "query_id bigint, merged string", """
SELECT query_id, string_agg(w, '|' ORDER BY i) AS merged FROM (SELECT *, row_number() OVER (PARTITION BY query_id, w ORDER BY i) AS rn FROM (
  SELECT query_id, unnest(l) AS w, unnest(range(1, len(l) + 1)) AS i FROM (
    SELECT query_id, list_concat(string_split(query, ' '), string_split(lower(query), ' ')) AS l FROM {questions}))) WHERE rn = 1 GROUP BY query_id""")
def _(t):
    merged = Q.merge_keywords(F.split("query", " "), F.split(F.lower("query"), " "))
    return t.questions.select("query_id", F.array_join(merged, "|").alias("merged"))


@query("query_explicit_ids", "query_id bigint, ids string, injected string, kept string", f"""
SELECT query_id, array_to_string(ids, ',') AS ids, CASE WHEN len(ids) > 0 OR contains(query, target) THEN query ELSE query || ' (cho sinh viên mã ' || target || ')' END AS injected,
  array_to_string([w FOR w IN string_split(query, ' ') IF w <> target], ' ') AS kept
FROM (SELECT *, regexp_extract_all(query, '(?:^|{_NW})([0-9]{{10}})(?:$|{_NW})', 1) AS ids, '22' || lpad(CAST(query_id AS VARCHAR), 8, '0') AS target FROM {{questions}})""")
def _(t):
    target = F.concat(F.lit("22"), F.lpad(col("query_id").cast("string"), 8, "0"))
    return t.questions.select(
        "query_id", F.array_join(Q.explicit_ids(col("query")), ",").alias("ids"),
        Q.inject_target(col("query"), target).alias("injected"),
        F.array_join(Q.drop_target_keyword(F.split("query", " "), target), " ").alias("kept"))


# --- conversation state -----------------------------------------------------
# Question and answer pairs: a user message and the message after it.
_TURNS = """SELECT u.session_id, u.turn, u.content AS query, a.content AS answer, u.user_id, u.conv_id FROM {messages} u
  JOIN {messages} a ON a.session_id = u.session_id AND a.turn = u.turn + 1 AND a.role = 'ai' WHERE u.role = 'user'"""
_BOTH = "'User: ' || query || chr(10) || 'Bot: ' || left(answer, 400)"


@query("memory_recent_messages", "session_id string, turn bigint, recent string", f"""
SELECT session_id, turn, coalesce(string_agg({_BOTH}, chr(10)) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS recent FROM ({_TURNS})""")
def _(t):
    return C.recent_messages(t.sql(_TURNS), size=4).withColumn("recent", F.array_join("recent", "\n"))


_NUM = f"SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS n FROM ({_TURNS})"
_PARTS = f"""SELECT a.session_id, a.n, left(string_agg('User: ' || b.query || chr(10) || 'Bot: ' || left(b.answer, 400), chr(10) ORDER BY b.n), 200) AS part
  FROM ({_NUM}) a JOIN ({_NUM}) b ON b.session_id = a.session_id AND b.n <= a.n AND b.n > a.n - 6 WHERE a.n % 4 = 0 GROUP BY a.session_id, a.n"""


@query("memory_update", "session_id string, turn bigint, turn_count bigint, recent string, summary string, history string", f"""
SELECT session_id, turn, turn_count, recent, summary, CASE WHEN summary = '' THEN last4 ELSE '[Tóm tắt hội thoại trước: ' || summary || ']' || chr(10) || last4 END AS history
FROM (SELECT a.session_id, a.turn, a.n AS turn_count,
  (SELECT string_agg({_BOTH}, chr(10) ORDER BY n) FROM ({_NUM}) b WHERE b.session_id = a.session_id AND b.n <= a.n AND b.n > a.n // 4 * 4 - 2) AS recent,
  (SELECT string_agg({_BOTH}, chr(10) ORDER BY n) FROM ({_NUM}) b WHERE b.session_id = a.session_id AND b.n <= a.n AND b.n > a.n - 2) AS last4,
  coalesce((SELECT string_agg(part, ' | ' ORDER BY n) FROM ({_PARTS}) p WHERE p.session_id = a.session_id AND p.n <= a.n), '') AS summary
  FROM ({_NUM}) a)""")
def _(t):
    memory = C.session_memory(t.sql(_TURNS), size=8)
    history = C.context_history(col("summary"), col("recent"))
    return memory.select("session_id", "turn", "turn_count", F.array_join("recent", "\n").alias("recent"), "summary",
                         F.array_join(history, "\n").alias("history"))


_TOPICS = """SELECT session_id, turn, CASE WHEN turn % 4 = 1 THEN 'student_lookup' ELSE 'general' END AS intent,
  CASE WHEN turn % 3 = 0 THEN 'Không xác định' ELSE 'T' || CAST(turn AS STRING) END AS title, CASE WHEN turn % 5 = 0 THEN 'Không xác định' ELSE 'N' || CAST(turn AS STRING) END AS doc_number FROM {messages}"""


@query("memory_last_topic", "session_id string, turn bigint, last_topic string", f"""
SELECT session_id, turn, last_value(topic IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_topic
FROM (SELECT *, CASE WHEN intent <> 'student_lookup' AND title <> 'Không xác định' THEN CASE WHEN doc_number = 'Không xác định' THEN title ELSE doc_number || ' - ' || title END END AS topic FROM ({_TOPICS}))""")
def _(t):
    return C.last_topic(t.sql(_TOPICS), size=4)


@query("memory_session_keys", "id bigint, key string, anonymous string",
       "SELECT id, CAST(user_id AS VARCHAR) || ':' || session_id AS key, 'anonymous:' || session_id AS anonymous FROM {messages}")
def _(t):
    return t.messages.select(
        "id", C.session_key(col("user_id"), col("session_id")).alias("key"),
        C.session_key(F.lit(None), col("session_id")).alias("anonymous"))


_STUDENT = """SELECT session_id, turn, CASE turn % 5 WHEN 0 THEN '22' || lpad(CAST(turn AS STRING), 8, '0') WHEN 3 THEN '' ELSE NULL END AS set_id,
  CASE turn % 5 WHEN 0 THEN '' WHEN 1 THEN 'Nguyễn Văn ' || CAST(turn AS STRING) ELSE NULL END AS set_name FROM {messages}"""
_FRAME = "OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query("memory_last_student", "session_id string, turn bigint, last_student_id string, last_student_name string", f"""
SELECT session_id, turn, nullif(last_value(set_id IGNORE NULLS) {_FRAME}, '') AS last_student_id, nullif(last_value(set_name IGNORE NULLS) {_FRAME}, '') AS last_student_name FROM ({_STUDENT})""")
def _(t):
    return C.last_student(t.sql(_STUDENT), size=4)


_UPD = """SELECT query_id, CASE WHEN user_id % 4 = 0 THEN '2200000001' ELSE NULL END AS explicit_id, CASE user_id % 3 WHEN 0 THEN 'Văn Nam' WHEN 1 THEN 'Lê Hoa' ELSE NULL END AS name,
  CASE WHEN user_id % 5 = 1 THEN 'F9' ELSE NULL END AS found_id FROM {questions}"""


@query("memory_student_updates", "query_id bigint, set_id string, set_name string", f"""
SELECT query_id, CASE WHEN explicit_id IS NOT NULL THEN explicit_id WHEN found_id IS NOT NULL THEN found_id WHEN name = 'Lê Hoa' THEN '' END AS set_id,
  CASE WHEN explicit_id IS NOT NULL THEN '' WHEN found_id IS NOT NULL THEN 'Trần Bình' END AS set_name FROM ({_UPD})""")
def _(t):
    update = C.student_updates(col("explicit_id"), col("name"), F.lit("Nguyễn Văn Nam"), col("found_id"), F.lit("Trần Bình"))
    return t.sql(_UPD).select("query_id", update.alias("u")).select("query_id", "u.set_id", "u.set_name")


_SRC = """SELECT session_id, turn, CASE turn % 4 WHEN 1 THEN 'doc' || CAST(turn AS STRING) WHEN 3 THEN '' ELSE NULL END AS sources FROM {messages}"""


@query("memory_last_sources", "session_id string, turn bigint, cached_sources string",
       f"SELECT session_id, turn, last_value(sources IGNORE NULLS) {_FRAME} AS cached_sources FROM ({_SRC})")
def _(t):
    return C.last_sources(t.sql(_SRC), size=4)
