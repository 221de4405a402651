"""Text cleaning over whole tables of documents, pages, messages and notices."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.plans import sqltext as S
from corpusmill.plans.registry import query

col = F.col


@query("text_normalize_unicode", "doc_id bigint, out string",
       f"SELECT doc_id, {S.normalize_unicode('text')} AS out FROM documents")
def _(t):
    return t.documents.select("doc_id", T.normalize_unicode(col("text")).alias("out"))


@query("text_normalize_whitespace", "page_id bigint, out string",
       f"SELECT page_id, {S.normalize_whitespace('html')} AS out FROM pages")
def _(t):
    return t.pages.select("page_id", T.normalize_whitespace(col("html")).alias("out"))


_OCR_IN = "SELECT o_orderkey, replace(replace(content, 'Tiền nước', 'Tién nuóc'), 'Tổng cộng', 'TONG CONG 3o' || sem || ' 0l') AS raw FROM {notices}"


@query("text_ocr_fixes", "o_orderkey bigint, out string",
       f"SELECT o_orderkey, {S.fix_ocr('raw')} AS out FROM ({_OCR_IN})")
def _(t):
    return t.sql(_OCR_IN).select("o_orderkey", T.fix_ocr(col("raw")).alias("out"))


@query("text_noisy_lines", "doc_id bigint, n_lines bigint, n_noisy bigint", f"""
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE {S.noisy('line')}) AS n_noisy
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id""")
def _(t):
    lines = t.documents.select("doc_id", F.split("text", "\n").alias("lines"))
    return lines.select(
        "doc_id", F.size("lines").alias("n_lines"),
        F.size(F.filter("lines", T.is_noisy_line)).alias("n_noisy"),
    )


@query("text_clean", "doc_id bigint, cleaned string", S.clean("documents", "doc_id", "text"))
def _(t):
    return t.documents.select("doc_id", T.clean_text(col("text")).alias("cleaned"))


@query("text_clean_drop_noise", "doc_id bigint, cleaned string", S.clean("documents", "doc_id", "text", "true"))
def _(t):
    return t.documents.select("doc_id", T.clean_text(col("text"), drop_noise=True).alias("cleaned"))


@query("text_fold", "doc_id bigint, folded string", f"SELECT doc_id, {S.fold('text')} AS folded FROM documents")
def _(t):
    return t.documents.select("doc_id", T.fold(col("text")).alias("folded"))


_ZW = "SELECT o_orderkey, replace(title, 'năm', 'n' || chr(8203) || 'ăm') AS raw FROM {notices}"


@query("text_fold_query", "o_orderkey bigint, as_query string, as_text string",
       f"SELECT o_orderkey, {S.fold_query('raw')} AS as_query, {S.fold('raw')} AS as_text FROM ({_ZW})")
def _(t):
    return t.sql(_ZW.replace("chr(8203)", "'​'")).select(
        "o_orderkey", T.fold_query(col("raw")).alias("as_query"), T.fold(col("raw")).alias("as_text")
    )


@query("text_normalize_query", "id bigint, out string",
       f"SELECT id, {S.normalize_query('content')} AS out FROM {{messages}}")
def _(t):
    return t.messages.select("id", T.normalize_query(col("content")).alias("out"))


@query("metadata_normalize_strings", "o_orderkey bigint, title string, issuer string, tags string", f"""
SELECT o_orderkey, {S.normalize_whitespace(S.normalize_unicode("'  ' || title || ' '"))} AS title, issuer,
  {S.normalize_whitespace(S.normalize_unicode("' ' || source || '  '"))} || '|' || target_id AS tags FROM {{notices}}""")
def _(t):
    meta = T.normalize_string_map(F.create_map(
        F.lit("title"), F.concat(F.lit("  "), "title", F.lit(" ")), F.lit("issuer"), F.col("issuer")))
    tags = T.normalize_strings(F.array(F.concat(F.lit(" "), "source", F.lit("  ")), F.col("target_id")))
    return t.notices.select("o_orderkey", meta.alias("m"), F.array_join(tags, "|").alias("tags")).select(
        "o_orderkey", col("m.title").alias("title"), col("m.issuer").alias("issuer"), "tags")


@query("keywords_compact", "conv_id bigint, turn bigint, words string", f"""
SELECT m.conv_id, m.turn, coalesce(j.words, '') AS words FROM conversations m LEFT JOIN (
  SELECT conv_id, turn, string_agg(w, ' ' ORDER BY pos) AS words FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, turn, lower(w) ORDER BY pos) AS rn FROM (
      SELECT conv_id, turn, {S.normalize_whitespace(S.normalize_unicode('w'))} AS w, pos FROM (
        SELECT conv_id, turn, unnest(l) AS w, unnest(range(1, len(l) + 1)) AS pos
        FROM (SELECT conv_id, turn, string_split(text, ' ') AS l FROM conversations)))
    WHERE w <> '') WHERE rn = 1 GROUP BY conv_id, turn) j ON j.conv_id = m.conv_id AND j.turn = m.turn""")
def _(t):
    words = T.compact_keywords(F.split("text", " "))
    return t.conversations.select("conv_id", "turn", F.array_join(words, " ").alias("words"))


_ANS = """SELECT id, CASE turn % 3 WHEN 0 THEN 'Trả lời: ' || content || ' , , 你好 тест  x'
 WHEN 1 THEN 'markdown - ' || content ELSE '漢字' END AS raw, content FROM {messages}"""
_FOREIGN = r"[\x{4e00}-\x{9fff}\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{ac00}-\x{d7af}\x{0400}-\x{04ff}\x{3000}-\x{303f}\x{ff00}-\x{ffef}]+"
_s = S.rep(S.strip("raw"), _FOREIGN)
_s = S.strip(S.rep(_s, r"\A(markdown\s*[-:]\s*|Trả lời\s*:\s*|Answer\s*:\s*)", "", "i"))
_s = S.rep(_s, r"\A(?:markdown)\s*[-:—]?\s*", "", "i")
_s = S.strip(S.rep(S.rep(_s, rf"[{S.WS}]*,[{S.WS}]*,[{S.WS}]*", ", "), r"[ \t]{2,}", " "))


@query("answer_scrub", "id bigint, out string, rewritten string", f"""
SELECT id, coalesce(nullif(x, ''), raw) AS out, coalesce(nullif(y, ''), content) AS rewritten
FROM (SELECT id, raw, content, {_s} AS x,
  {S.strip(S.rep('raw', r'[а-яА-ЯёЁ\x{4e00}-\x{9fff}\x{3040}-\x{309f}\x{30a0}-\x{30ff}]'))} AS y FROM ({_ANS}))""")
def _(t):
    return t.sql(_ANS).select(
        "id", T.scrub_answer(col("raw")).alias("out"), T.scrub_rewrite(col("raw"), col("content")).alias("rewritten"))


@query("html_strip_tags", "page_id bigint, out string",
       f"SELECT page_id, {S.strip(S.rep(S.rep('html', '<[^>]+>', ' '), f'[{S.WS}]+', ' '))} AS out FROM pages")
def _(t):
    return t.pages.select("page_id", T.strip_tags(col("html")).alias("out"))


_MD = """SELECT id, CASE turn % 2 WHEN 0 THEN replace(content, '. ', chr(10) || '- ') || chr(10) || '- ' || chr(10) || chr(10) || chr(10) || '2. '
  ELSE content || '   ' END AS raw FROM {messages}"""
_ITEM = r"(?:[-*+]\s+|\d+\.\s+)"


def _tidy(x: str) -> str:
    x = f"replace(replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(160), ' ')"
    x = S.rep(x, r"(?m)[ \t]+$")
    x = S.rep(S.rep(x, r"(?m)^\s*[-*+]\s*$"), r"(?m)^\s*\d+\.\s*$")
    x = S.rep(x, r"\n{3,}", "\n\n")
    return S.strip(S.rep(x, rf"(\n\s*{_ITEM}.+)\n{{2,}}(\s*{_ITEM})", "\\1\n\\2"))


@query("markdown_tidy", "id bigint, out string", f"SELECT id, {_tidy('raw')} AS out FROM ({_MD})")
def _(t):
    return t.sql(_MD).select("id", T.tidy_markdown(col("raw")).alias("out"))


_FLAT = "SELECT id, replace(content, chr(10), ' ') AS raw FROM {messages}"


@query("answer_paragraphs", "id bigint, out string", f"""
SELECT id, CASE WHEN regexp_matches(x, '(^|\\n)\\s*({_ITEM}|#{{1,6}}\\s+|\\|)') OR regexp_matches(x, '`{{3}}|`[^`]+`|\\*\\*[^*]+\\*\\*')
    OR length(x) <= 220 OR len(p) < 3 THEN x
  ELSE array_to_string([array_to_string(p[i : i + 1], ' ') FOR i IN range(1, len(p) + 1, 2)], chr(10) || chr(10)) END AS out
FROM (SELECT id, x, [s FOR s IN string_split({S.rep('x', '([.!?])' + chr(92) + 's+(' + chr(92) + 'S)', chr(92) + '1' + chr(1) + chr(92) + '2')}, chr(1)) IF trim(s) <> ''] AS p
  FROM (SELECT id, {_tidy('raw')} AS x FROM ({_FLAT})))""")
def _(t):
    return t.sql(_FLAT).select("id", T.paragraph_answer(col("raw")).alias("out"))


@query("session_titles", "id bigint, title string",
       "SELECT id, CASE WHEN length(content) > 50 THEN left(content, 50) || '...' ELSE content END AS title FROM {messages}")
def _(t):
    return t.messages.select("id", T.session_title(col("content")).alias("title"))


@query("display_sources", "o_orderkey bigint, out string", r"""
SELECT o_orderkey, regexp_replace(regexp_replace(source, '^\d{14}_', ''), '_(\d{4})\.pdf$', '.pdf') AS out FROM {notices}""")
def _(t):
    return t.notices.select("o_orderkey", T.display_source(col("source")).alias("out"))


_AMT = "SELECT o_orderkey, ' .6.' || money3 || '.000 đ,' AS a, '6 ' || money3 || ' 00' || sem AS b, money3 AS c FROM {notices}"
_clean_amt = S.strip(S.rep("a", "[^0-9.,]"), ".,")


@query("money_tokens", "o_orderkey bigint, amount string, is_money boolean, folded string, folded_is_money boolean, short_is_money boolean", rf"""
SELECT o_orderkey, amount, regexp_matches(amount, '^\d{{1,3}}(?:[.,]\d{{3}})+$') AS is_money, folded,
  regexp_matches(folded, '^\d{{1,3}}(?:[.,]\d{{3}})+$') AS folded_is_money, regexp_matches(c, '^\d{{1,3}}(?:[.,]\d{{3}})+$') AS short_is_money
FROM (SELECT o_orderkey, c, {_clean_amt} AS amount, CASE WHEN length(d) > 3 THEN left(d, length(d) - 3) || '.' || right(d, 3) ELSE d END AS folded
  FROM (SELECT *, {S.rep('b', '[^0-9]')} AS d FROM ({_AMT})))""")
def _(t):
    amount, folded = T.clean_amount(col("a")), T.format_folded_amount(col("b"))
    return t.sql(_AMT).select(
        "o_orderkey", amount.alias("amount"), T.is_money(amount).alias("is_money"), folded.alias("folded"),
        T.is_money(folded).alias("folded_is_money"), T.is_money(col("c")).alias("short_is_money"))


_LINES = "SELECT o_orderkey, i, lines[i] AS line FROM (SELECT o_orderkey, string_split(content, chr(10)) AS lines FROM {notices}), generate_series(1, 20) g(i) WHERE i <= len(lines)"
_ctx = S.strip(S.rep(S.rep(S.normalize_query("line"), "<[^>]+>", " "), f"[{S.WS}]+", " "))
_ctx = S.rep(S.rep(_ctx, rf"\A[-*]+[{S.WS}]*"), rf"\A\d+\.[{S.WS}]*")


@query("table_line_tests", "o_orderkey bigint, i bigint, is_separator boolean, is_placeholder boolean, plain string", rf"""
SELECT o_orderkey, i, regexp_matches(line, '\A\s*\|?\s*:?-{{2,}}:?\s*(\|\s*:?-{{2,}}:?\s*)+\|?\s*\z') AS is_separator,
  trim(line) IN ('', '…') OR regexp_matches(trim(line), '\A[.\-–_\s]+\z') AS is_placeholder,
  CASE WHEN x IN ('', '---') OR (x LIKE '[%' AND x LIKE '%]') OR x LIKE '%|%' THEN '' ELSE x END AS plain
FROM (SELECT *, {_ctx} AS x FROM ({_LINES}))""")
def _(t):
    lines = t.notices.select("o_orderkey", F.posexplode(F.split("content", "\n")).alias("i", "line"))
    return lines.select(
        "o_orderkey", (col("i") + 1).alias("i"), T.is_table_separator(col("line")).alias("is_separator"),
        T.is_placeholder_cell(col("line")).alias("is_placeholder"), T.clean_context_line(col("line")).alias("plain"))


_dir = S.rep(S.rep(S.normalize_query("content"), "<[^>]+>", " "), r"\[[^\]]+\]", " ")
_dir = S.rep(S.rep(_dir, r"\||---", " "), r"(?s)(?:Trân trọng|- Nơi nhận|KT\. BỘ TRƯỞNG|KT\. BO TRUONG|THỨ TRƯỞNG|THU TRUONG).*\z")


@query("directive_bodies", "o_orderkey bigint, body string",
       f"SELECT o_orderkey, {S.strip(S.rep(_dir, f'[{S.WS}]+', ' '), ' ;,.' + chr(92) + '-')} AS body FROM {{notices}}")
def _(t):
    return t.notices.select("o_orderkey", T.clean_directive(col("content")).alias("body"))


@query("name_capitalize", "id bigint, out string", """
SELECT id, array_to_string([upper(left(w, 1)) || lower(substr(w, 2)) FOR w IN string_split(replace(full_name, '#', ' #x-'), ' ')], ' ') AS out
FROM {users}""")
def _(t):
    return t.users.select("id", T.capitalize_words(F.replace("full_name", F.lit("#"), F.lit(" #x-"))).alias("out"))
