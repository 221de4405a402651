"""One registered query per operator, over the whole of its table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import (
    avi, conversation_repair, line_dedup, minhash, mixing, packing, quality_classifier, quality_rules, spelling_variants,
    substring_dedup, suffix_dedup, token_files, toxicity)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.line_dedup(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(_table(spark, sf_dir, "documents")).drop("spans")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, *toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op7_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.media_columns(_table(spark, sf_dir, "documents")).drop("clips")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.train(docs, _table(spark, sf_dir, "labels")))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.token_folder(spark)
    files = token_files.write_token_files(_table(spark, sf_dir, "documents"), folder)
    return token_files.read_token_files(files, folder)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling_variants.damaged_words(_table(spark, sf_dir, "documents"))
    return spelling_variants.group_words(spelling_variants.frequent_words(words))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.damaged_and_repaired(_table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    listed = (
        op1_quality_rules, op2_line_dedup, op3_substring_dedup, op4_suffix_dedup, op5_minhash, op6_toxicity, op7_avi,
        op8_packing, op9_mixing, op10_quality_classifier, op11_token_files, op12_spelling_variants, op13_conversation_repair, pipeline)
    return {f.__name__: f for f in listed}


WORD = "[^\\x20\\x09-\\x0D]+"
TRIMMED = "trim({}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
t AS (SELECT *, regexp_extract_all(text, '{WORD}') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS k FROM t, unnest(range(1, len(w) - 3)) AS r(i)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
gaps AS (SELECT doc_id, least(5, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -5)) AS g FROM twice),
again AS (SELECT doc_id, sum(g) AS n FROM gaps GROUP BY doc_id),
rows AS (SELECT doc_id, source, text, unnest(l) AS x FROM t),
norm AS (SELECT doc_id, source, text, lower(regexp_replace({TRIMMED.format('x')}, '[0-9]+', '0', 'g')) AS k, length({TRIMMED.format('x')}) AS n FROM rows),
held AS (SELECT source, k, count(DISTINCT text) AS texts, min(doc_id) AS first FROM norm GROUP BY source, k),
hosts AS (SELECT source, count(DISTINCT text) AS of FROM d GROUP BY source),
many AS (SELECT held.* FROM held JOIN hosts ON held.source IS NOT DISTINCT FROM hosts.source WHERE texts >= 20 AND texts * texts >= of),
lost AS (SELECT doc_id, sum(n) AS n FROM norm JOIN many ON norm.source IS NOT DISTINCT FROM many.source AND norm.k = many.k AND doc_id > first GROUP BY doc_id),
chars AS (SELECT doc_id, sum(n) AS n FROM norm GROUP BY doc_id),
base AS (
  SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(lost.n, 0) AS BIGINT) AS chars_dropped, coalesce(chars.n, 0) AS chars
  FROM t LEFT JOIN again ON t.doc_id = again.doc_id LEFT JOIN lost ON t.doc_id = lost.doc_id LEFT JOIN chars ON t.doc_id = chars.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, chars_dropped,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND chars - chars_dropped >= 0.5 * chars AS kept
FROM base
"""

OP2 = f"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
l AS (SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS pos FROM s),
k AS (SELECT *, {ASCII_LOWER.format(TRIMMED.format('line'))} AS key FROM l),
often AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.*, last IS NOT NULL AND last <> doc_id AS gone FROM k LEFT JOIN often ON k.key = often.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP3 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS k FROM d, unnest(range(1, len(w) - 33)) AS r(i)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY k) > 1),
covered AS (SELECT DISTINCT doc_id, i + o AS p FROM twice, range(0, 35) AS r(o)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
left_over AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS kept, count(*) AS n FROM words LEFT JOIN covered ON words.doc_id = covered.doc_id AND words.p = covered.p WHERE covered.p IS NULL GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN left_over ON d.doc_id = left_over.doc_id
"""

OP5 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({ASCII_LOWER.format("coalesce(text, '')")}, '{WORD}') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM d, unnest(range(1, len(w) - 3)) AS r(i)
  UNION SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reached AS (SELECT DISTINCT a AS doc_id, a AS other FROM both_ways UNION SELECT reached.doc_id, both_ways.b FROM reached JOIN both_ways ON reached.other = both_ways.a),
part AS (SELECT doc_id, min(other) AS c FROM reached GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN part ON part.doc_id = d.doc_id
"""


# The checksum of a list of bytes, its table made by the rule of the polynomial.
CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
CRC32 = "xor(list_reduce(list_prepend(4294967295, {bytes}), lambda c, b: xor(c >> 8, crc[CAST(xor(c, b) & 255 AS INT) + 1])), 4294967295)"
LETTER_BYTES = "flatten(list_transform(string_split({}, ''), lambda z: CASE WHEN unicode(z) < 128 THEN [unicode(z)::BIGINT] ELSE [195::BIGINT, unicode(z)::BIGINT - 64] END))"

OP12 = f"""
WITH RECURSIVE k AS MATERIALIZED (SELECT {CRC_TABLE} AS crc),
runs AS (SELECT doc_id, run, count(*) AS n FROM (
  SELECT doc_id, {ASCII_LOWER.format('run')} AS run FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)) GROUP BY ALL),
hashed AS (SELECT run, n, {CRC32.format(bytes=LETTER_BYTES.format("(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)"))} AS h FROM runs, k),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
gaps AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) AS r(i)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM gaps a JOIN gaps b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT g.word, w.word, w.n FROM gaps g JOIN words w ON g.rest = w.word
  UNION SELECT w.word, g.word, g.n FROM gaps g JOIN words w ON g.rest = w.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
formed AS MATERIALIZED (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n
  FROM words LEFT JOIN best ON words.word = best.word),
walk AS (SELECT word, coalesce(form, word) AS top FROM formed UNION SELECT walk.word, formed.form FROM walk JOIN formed ON formed.word = walk.top WHERE formed.form IS NOT NULL)
SELECT formed.word, form, top AS root, n, n_near, form_n FROM formed JOIN walk ON walk.word = formed.word
WHERE top NOT IN (SELECT word FROM formed WHERE form IS NOT NULL)
"""


def _cheapest(*ways: str) -> str:
    """The least (cost, audit, repaired) of several."""
    return f"list_min([{', '.join(ways)}])"


def _after(cost: str, letter: str, behind: str, line: str | None = None) -> str:
    """The state ``behind`` with one more edit before it, and the repaired line it leaves."""
    text = f"{behind}.t" if line is None else f"list_prepend({line}, {behind}.t)"
    return f"{{'c': {behind}.c + {cost}, 'a': '{letter}' || {behind}.a, 't': {text}}}"


def _turn(symbol: str, same: str, then: str) -> str:
    """The ways of one turn where ``symbol`` is expected; ``same`` and ``then`` are the states
    behind the turn if it goes or stays.
    """
    role = {"u": "user", "a": "assistant"}[symbol]
    kept = f"CASE WHEN gone THEN NULL WHEN left(role, 1) = '{symbol}' THEN {_after('cut', 'K', then, 'line')} ELSE {_after('cut + 2', 'R', then, f"'{role}:' || text")} END"
    return f"{_after('3', 'D', same)}, {kept}"


# Backwards over the turns: what the rest costs where a user turn is expected or the end (u),
# an assistant turn (a), a user turn behind a system turn (p), and at the beginning (b); w_ is
# the same with no insertion before the turn.
OP13 = f"""
WITH RECURSIVE k AS MATERIALIZED (SELECT {CRC_TABLE} AS crc),
hit AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {CRC32.format(bytes="list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda z: unicode(z)::BIGINT)")} % 20 AS h
  FROM conversations, k),
damaged AS (SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hit)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(CAST(length(role) AS VARCHAR) || ':' || role || text)) AS pos FROM damaged),
faults AS (SELECT *, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) AS pair FROM placed),
turns AS MATERIALIZED (SELECT conv_id, turn, pos, role, text, role || ':' || text AS line, pair, last = '' AS blank, last <> '' AND again AS duplicate, last = '' OR again AS gone,
  CAST(last <> '' AND NOT again AND last NOT IN ('.', '!', '?') AS INT) AS cut FROM faults),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate,
  sum(cut) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n FROM turns GROUP BY conv_id),
back AS (
  SELECT conv_id, n, {{'c': 0, 'a': '', 't': []::VARCHAR[]}} AS b, {{'c': 4, 'a': 'II', 't': ['user:', 'assistant:']}} AS p,
    {{'c': 0, 'a': '', 't': []::VARCHAR[]}} AS u, {{'c': 2, 'a': 'I', 't': ['assistant:']}} AS a FROM counts
  UNION ALL
  SELECT conv_id, n,
    {_cheapest('wb', _after('2', 'I', 'wu1', "'user:'"), _after('4', 'II', 'wa0', "'user:'").replace("list_prepend('user:', wa0.t)", "list_prepend('user:', list_prepend('assistant:', wa0.t))"))},
    {_cheapest('wp', _after('2', 'I', 'wu1', "'user:'"), _after('4', 'II', 'wa0', "'user:'").replace("list_prepend('user:', wa0.t)", "list_prepend('user:', list_prepend('assistant:', wa0.t))"))},
    {_cheapest('wa0', _after('2', 'I', 'wu1', "'user:'"))}, {_cheapest('wu1', _after('2', 'I', 'wa0', "'assistant:'"))}
  FROM (SELECT back.conv_id, back.n - 1 AS n,
      {_cheapest(_turn('u', 'b', 'a'), "CASE WHEN NOT gone AND left(role, 1) = 's' THEN " + _after('cut', 'K', 'p', 'line') + " END")} AS wb,
      {_cheapest(_turn('u', 'p', 'a'))} AS wp, {_cheapest(_turn('u', 'u', 'a'))} AS wa0, {_cheapest(_turn('a', 'a', 'u'))} AS wu1
    FROM back JOIN turns ON turns.conv_id IS NOT DISTINCT FROM back.conv_id AND turns.pos = back.n)),
done AS (SELECT conv_id, b FROM back WHERE n = 0)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(b.c, 0) AS BIGINT) AS cost, coalesce(b.a, '') AS audit,
  sha256(coalesce(array_to_string(b.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM ids.conv_id
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express; the others are tested against brute force,
    exact round trips and held-out labels.
    """
    return {"op1_quality_rules": OP1, "op2_line_dedup": OP2, "op3_substring_dedup": OP3, "op5_minhash": OP5, "op12_spelling_variants": OP12, "op13_conversation_repair": OP13}
