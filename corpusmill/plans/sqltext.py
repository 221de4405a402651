"""Oracle SQL fragments for the text functions.

The oracle's regular expressions know neither look-around nor Unicode word
boundaries, so the same rules are phrased with captured neighbours.
"""

from __future__ import annotations

WS = r"\t\n\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
NOT_WORD = r"[^\p{L}\p{N}\p{M}_]"


def rep(x: str, pattern: str, by: str = "", flags: str = "g") -> str:
    pattern = pattern.replace("'", "''")
    return f"regexp_replace({x}, '{pattern}', '{by}', '{flags}')"


def strip(x: str, chars: str = WS) -> str:
    return rep(rep(x, rf"\A[{chars}]+"), rf"[{chars}]+\z")


def normalize_unicode(x: str) -> str:
    x = f"replace(nfc_normalize(coalesce({x}, '')), chr(160), ' ')"
    return rep(x, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{200B}-\x{200D}]")


def normalize_whitespace(x: str) -> str:
    x = f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    x = rep(x, r"[ \t]+", " ")
    return strip(rep(x, rf"[{WS}]*\n[{WS}]*", "\n"))


def fold(x: str) -> str:
    x = rep(f"coalesce({x}, '')", r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{200B}-\x{200D}]")
    return f"trim({rep(f'lower(strip_accents({x}))', '[^0-9a-z]+', ' ')})"


def fold_query(x: str) -> str:
    return f"trim({rep(f'lower(strip_accents({x}))', '[^0-9a-z]+', ' ')})"


def normalize_query(x: str) -> str:
    return strip(rep(f"nfc_normalize(coalesce({x}, ''))", rf"[{WS}]+", " "))


def _word(x: str, word: str, by: str) -> str:
    """Whole-word replacement, run twice as matches share their neighbours."""
    pattern = rf"(^|{NOT_WORD})(?:{word})($|{NOT_WORD})"
    once = rep(x, pattern, rf"\1{by}\2", "gi")
    return rep(once, pattern, rf"\1{by}\2", "gi")


def fix_ocr(x: str) -> str:
    words = [
        ("Kh6a", "Khóa"), ("Chuo['’]?ng", "Chương"), ("chuong", "chương"), ("Tién", "Tiền"),
        ("dién", "điện"), ("nuóc", "nước"), ("uóng", "uống"), ("Tong cong", "Tổng cộng"),
        ("Noi dung", "Nội dung"), ("Dai hoc", "Đại học"),
    ]
    for word, by in words:
        x = _word(x, word, by)
    x = rep(x, r"\?\s*Ngân", "- Ngân", "gi")
    x = _word(x, "cá nám", "cả năm")
    x = rep(x, rf"([0-9])[oO]([1-9])($|{NOT_WORD})", r"\1" + "0" + r"\2\3")
    return _word(_word(x, "olf", "01"), "0l", "01")


def noisy(x: str) -> str:
    t = strip(x)
    letters = f"length({rep(t, '[^' + chr(92) + 'p{L}]')})"
    digits = f"length({rep(t, '[^' + chr(92) + 'p{Nd}²³¹⁰⁴-⁹₀-₉]')})"
    junk = f"length({rep(t, '[^?_]')})"
    return (
        f"(length({t}) <= 2 OR regexp_matches({t}, '(?s)\\A\\|[^\\n]+\\|\\z')"
        f" OR regexp_matches({t}, '\\A[0-9]+(?:[.,][0-9]+)+\\z')"
        f" OR regexp_matches({t}, '(?i)\\A(?:STT|Noi|Nội|Khóa|Khoa)($|{NOT_WORD})')"
        f" OR ({letters} = 0 AND {digits} > 0) OR ({digits} > {letters} * 2 AND length({t}) > 12)"
        f" OR {junk} >= greatest(3, length({t}) // 4))"
    )


def clean(table: str, keys: str, text: str, noise: str | None = None) -> str:
    """SELECT keys, cleaned for every row of ``table``."""
    first = keys.split(",")[0].strip()
    where = f"AND NOT ({noise} AND {noisy('line')})" if noise else ""
    extra = f", {noise}" if noise and noise != "true" else ""
    on = " AND ".join(f"k.{c.strip()} = j.{c.strip()}" for c in keys.split(","))
    return f"""
SELECT {', '.join('k.' + c.strip() for c in keys.split(','))}, coalesce(j.cleaned, '') AS cleaned
FROM {table} k LEFT JOIN (
  SELECT {keys}, string_agg(line, chr(10) ORDER BY pos) AS cleaned FROM (
    SELECT {keys}, line, pos, row_number() OVER (PARTITION BY {keys}, {fold('line')} ORDER BY pos) AS rn FROM (
      SELECT {keys}{extra}, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS pos FROM (
        SELECT {keys}{extra}, string_split({normalize_whitespace(fix_ocr(normalize_unicode(text)))}, chr(10)) AS l
        FROM {table}))
    WHERE {fold('line')} <> '' {where})
  WHERE rn = 1 GROUP BY {keys}) j ON {on}"""


# crc32 of a text's UTF-8 bytes; the table follows from the polynomial.
CRC_TABLE = (
    "list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),"
    " lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
)


def crc32(x: str, table: str = "crc") -> str:
    """Needs a column ``table`` that holds CRC_TABLE."""
    digit = "(instr('0123456789ABCDEF', substr(hex(encode({x})), {at}, 1)) - 1)"
    high, low = digit.format(x=x, at="CAST(2 * i + 1 AS INT)"), digit.format(x=x, at="CAST(2 * i + 2 AS INT)")
    octets = f"[CAST(16 * {high} + {low} AS BIGINT) FOR i IN range(octet_length(encode({x})))]"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, {table}[CAST(xor(c, b) & 255 AS INT) + 1])), 4294967295)"
