"""Text cleaning as column expressions.

Every function takes and returns a Column, so a whole table of texts is cleaned
inside the scan stage without a Python worker. Unicode normal forms come from
the ICU library that Spark ships, called through the built-in ``reflect``.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill import vocab

_ICU = "com.ibm.icu.text.Normalizer"
# Characters that str.strip() and \s treat as white space (Unicode).
# Written as ranges only: mixed with single characters, a class is far slower.
WS = (
    r"\t-\r\x1C-\x20\x{85}-\x{85}\x{A0}-\x{A0}\x{1680}-\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}-\x{2029}\x{202F}-\x{202F}\x{205F}-\x{205F}\x{3000}-\x{3000}"
)
WS_CHARS = "".join(chr(p) for p in range(0x3001) if chr(p).isspace())
# The same set by the character's category, under the flag (?U): two tests a character, not one a range.
_BLANK = r"[\s\x1C-\x1F]"
_NOT_WORD_OR_END = r"[\x00-\t\x0B-/:-@\[-`{-\x{10FFFF}]+"
# Letters and signs that no normal form changes: below U+0300, the further Latin letters and
# common punctuation. Blanks are the only white space; ASCII texts pass the cheap first part.
# The commonest ranges stand outside, as an inner class is looked at after the outer one.
_PLAIN = r"\A[ -~[\x{1E00}-\x{1EFF}[\x{A1}-\x{AC}\x{AE}-\x{2FF}\x{2010}-\x{2027}]]]*\z"
_LATIN = r"\A[\x00-\x{36F}\x{2010}-\x{2027}]*\z"
_DROPPED = r"(?![ -~])[\x00-\x08\x0B-\f\x0E-\x1F\x7F-\x7F\x{200B}-\x{200D}]"


def _combining_class() -> str:
    """Regex class of the characters with a non-zero combining class.

    The Latin block is left to a plain range, and the category is tested first,
    so that letters never reach the long list of ranges.
    """
    points = [p for p in range(0x370, 0x110000) if unicodedata.combining(chr(p))]
    parts, start = [], points[0]
    for here, following in zip(points, points[1:] + [None]):
        if following != here + 1:
            parts.append(f"\\x{{{start:X}}}-\\x{{{here:X}}}")
            start = following
    return r"[\p{M}\p{Cn}&&[" + "".join(parts) + "]]+"


_MARKS = _combining_class()
# One pass for all stems of ``vocab``, which are tried only where a first letter of theirs stands.
_FIRST = "".join(sorted({s[0] for s in vocab.OCR_FIX_STEMS}))
_STEMS = f"(?=[{_FIRST}])(?:" + "|".join(map(re.escape, vocab.OCR_FIX_STEMS)) + ")"
# Stems are looked for by a rare sign of theirs, if they have one, else as they are.
_SIGNS = {s: [ch for ch in s if not ch.isascii() or ch.isdigit()] for s in vocab.OCR_FIX_STEMS}
_RARE = "[" + "".join(sorted({signs[0] for signs in _SIGNS.values() if signs})) + "]"
_COMMON = [s for s, signs in _SIGNS.items() if not signs]
# The stem without which a rule does nothing.
_STEM_OF = {p: next(s for s in vocab.OCR_FIX_STEMS if s in p.lower()) for p, _ in vocab.OCR_FIXES}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def contains_any(c: Column, terms: Iterable[str]) -> Column:
    """Whether the text holds one of the terms; the text is worked out once for all of them."""

    def test(text: Column) -> Column:
        out = F.lit(False)
        for term in terms:
            out = out | text.contains(term)
        return out

    return let(c, test)


def some(c: Column) -> Column:
    """The text, or null if it is empty; ``nullif`` would work it out twice."""
    return let(c, lambda x: F.when(x != "", x))


def strip(c: Column, chars: str = WS_CHARS) -> Column:
    """``str.strip``: only the ends of the text are looked at."""
    return F.btrim(c, F.lit(chars))


def is_blank(c: Column) -> Column:
    """Whether nothing is left of the text by ``strip``; most texts are settled by their first sign."""
    return ~c.rlike(r"(?U)[^\s\x1C-\x1F]")


def rstrip(c: Column, chars: str = WS_CHARS) -> Column:
    return F.rtrim(c, F.lit(chars))


def collapse_blanks(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"(?U){_BLANK}+", " "))


def nfc(c: Column) -> Column:
    return F.reflect(F.lit(_ICU), F.lit("compose"), c, F.lit(False))


def _unmarked(c: Column) -> Column:
    decomposed = F.reflect(F.lit(_ICU), F.lit("decompose"), c, F.lit(True))

    def further(text: Column) -> Column:
        # The long class of marks is only met by texts that go beyond the Latin block of marks.
        return F.when(~text.rlike(_LATIN), F.regexp_replace(text, _MARKS, "")).otherwise(text)

    return let(F.regexp_replace(decomposed, r"[\x{300}-\x{34E}\x{350}-\x{36F}]+", ""), further)


def normalize_unicode(c: Column) -> Column:
    """NFC, NBSP to blank, zero-width and control characters removed."""
    return F.regexp_replace(F.replace(nfc(text_or_empty(c)), F.lit("\xa0"), F.lit(" ")), _DROPPED, "")


def normalize_whitespace(c: Column) -> Column:
    """Unix line ends, single blanks, trimmed lines, no empty lines."""
    c = F.replace(F.regexp_replace(text_or_empty(c), r"\r\n?", "\n"), F.lit("\t"), F.lit(" "))
    c = F.regexp_replace(c, " {2,}", " ")
    lines = lambda x: F.when(x.contains("\n"), F.regexp_replace(x, f"(?U)(?![!-~]){_BLANK}*\\n{_BLANK}*", "\n")).otherwise(x)
    return strip(let(c, lines))


def _words(c: Column) -> Column:
    """Lower-cased last, as ASCII: no other letter of a decomposed text has an ASCII lower case."""
    return F.lower(F.trim(F.regexp_replace(_unmarked(c), r"\P{Alnum}+", " ")))


def fold(c: Column) -> Column:
    """Accent-free lower-case ASCII words, for search."""
    return _words(F.regexp_replace(text_or_empty(c), _DROPPED, ""))


def fold_query(c: Column) -> Column:
    """As ``fold``, but zero-width and control characters separate words."""
    return _words(text_or_empty(c))


def normalize_query(c: Column) -> Column:
    """NFC and one blank for every run of white space, line ends included."""
    return collapse_blanks(nfc(text_or_empty(c)))


def _first_letter(pattern: str) -> str:
    """A look at the first letter of a rule that begins at a word's start, cheaper than that start; it may
    let more pass than the rule does, in any case.
    """
    start = re.match(r"(?:\(\?i\))?\\b([0-9A-Za-z])", pattern)
    if not start:
        return ""
    letter = start.group(1)
    return "(?=[" + "".join(sorted({letter.lower(), letter.upper()})) + {"k": r"\x{212A}", "s": r"\x{17F}"}.get(letter.lower(), "") + "])"


def _chain(c: Column, rules: list[tuple[str, str]], flags: str) -> Column:
    for pattern, replacement in rules:
        c = F.regexp_replace(c, _first_letter(pattern) + flags + pattern, replacement)
    return c


def _has_stem(lowered: Column) -> Column:
    """Whether a lower-cased text holds one of the stems of recognition errors."""
    common = F.lit(False)
    for stem in _COMMON:
        common = common | lowered.contains(stem)
    return common | (lowered.rlike(_RARE) & lowered.rlike(_STEMS))


def is_plain(c: Column) -> Column:
    """Whether ``clean_text`` surely changes blanks only, by a few cheap tests; else false."""
    # Of digits, such texts hold ASCII ones only.
    misread = lambda x: _has_stem(x) | x.contains("olf") | x.contains("0l") | x.rlike("[0-9]o[1-9]")
    return F.when(c.rlike(_PLAIN) & c.rlike("[0-9A-Za-z]"), ~let(F.lower(c), misread)).otherwise(F.lit(False))


def fix_ocr(c: Column) -> Column:
    """Dictionary of common recognition errors.

    Most texts need none of the replacements, so both chains stand behind a
    cheap test for a fragment that each rule needs.
    """

    def words(text: Column) -> Column:
        # The rules take these for an i, which lower case does not make of them.
        odd = text.contains("İ") | text.contains("ı")

        def after(rule: tuple[str, str]) -> Callable[[Column], Column]:
            return lambda x: F.when(odd | F.lower(x).contains(_STEM_OF[rule[0]]), _chain(x, [rule], "(?iuU)")).otherwise(x)

        fixed = text
        for rule in vocab.OCR_FIXES:
            fixed = let(fixed, after(rule))
        return F.when(let(F.lower(text), _has_stem), fixed).otherwise(text)

    def digits(text: Column) -> Column:
        needed = text.rlike("[oO0][lL1-9]") & text.rlike(vocab.OCR_DIGIT_STEMS)
        return F.when(needed, _chain(text, vocab.OCR_DIGIT_FIXES, "(?U)")).otherwise(text)

    return let(let(text_or_empty(c), words), digits)


def _count(c: Column, char_class: str) -> Column:
    return F.length(F.regexp_replace(c, f"[^{char_class}]", ""))


def is_noisy_line(c: Column) -> Column:
    """Lines that are too short, table-like, mostly digits or mostly junk."""
    starts = "|".join(vocab.TABLE_LINE_STARTS)

    def test(line: Column) -> Column:
        size = F.length(line)
        letters = _count(line, r"\p{L}")
        digits = _count(line, r"\p{Nd}²³¹⁰⁴-⁹₀-₉")
        junk = _count(line, "?_")
        return (
            (size <= 2)
            | line.rlike(r"(?s)\A\|[^\n]+\|\z")
            | line.rlike(r"\A[0-9]+(?:[.,][0-9]+)+\z")
            | line.rlike(rf"(?iuU)\A(?:{starts})\b")
            | ((letters == 0) & (digits > 0))
            | ((digits > letters * 2) & (size > 12))
            | (junk >= F.greatest(F.lit(3), F.floor(size / 4)))
        )

    return let(strip(text_or_empty(c)), test)


def _first_of_key(keyed: Column) -> Column:
    """Values of an array of (k, i, x) with the first of each non-empty key.

    Sorting by (key, position) makes it n log n in the row's own items, without
    any shuffle of the texts.
    """
    ordered = F.array_sort(F.filter(keyed, lambda s: s.k != ""))
    first = let(
        ordered,
        lambda a: F.filter(a, lambda s, i: (i == 0) | (F.get(a, i - 1).k != s.k)),
    )
    by_place = F.array_sort(F.transform(first, lambda s: F.struct(s.i.alias("i"), s.x.alias("x"))))
    return F.transform(by_place, lambda s: s.x)


def keep_first_by(items: Column, key: Callable[[Column], Column]) -> Column:
    """Items of an array with the first of each key, in order; empty keys go."""
    return _first_of_key(
        F.transform(items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))
    )


def clean_text(c: Column, drop_noise: Column | bool = False) -> Column:
    """Normalised text with OCR fixes and folded-duplicate lines removed."""
    flag = F.lit(drop_noise) if isinstance(drop_noise, bool) else drop_noise

    def dedupe(text: Column) -> Column:
        # The text is folded once as a whole; folding keeps the line ends.
        folded = F.split(F.lower(F.regexp_replace(_unmarked(text), _NOT_WORD_OR_END, " ")), "\n")

        def keyed(keys: Column) -> Column:
            def entry(line: Column, i: Column) -> Column:
                key = F.trim(F.get(keys, i))
                if drop_noise is not False:
                    key = F.when(flag & is_noisy_line(line), F.lit("")).otherwise(key)
                return F.struct(key.alias("k"), i.alias("i"), line.alias("x"))

            return F.transform(F.split(text, "\n"), entry)

        deduped = F.array_join(_first_of_key(let(folded, keyed)), "\n")
        if drop_noise is not False:
            return deduped
        # A single line with a plain letter or digit has no duplicate to lose.
        return F.when(~text.contains("\n") & text.rlike("[0-9A-Za-z]"), text).otherwise(deduped)

    cleaned = lambda x: let(normalize_whitespace(fix_ocr(normalize_unicode(x))), dedupe)
    if drop_noise is not False:
        return cleaned(c)
    single = lambda x: F.trim(F.when(x.contains("  "), F.regexp_replace(x, " {2,}", " ")).otherwise(x))
    return let(c.cast("string"), lambda x: F.when(is_plain(x), single(x)).otherwise(cleaned(x)))


def normalize_string_map(m: Column) -> Column:
    return F.transform_values(m, lambda _, v: normalize_whitespace(normalize_unicode(v)))


def normalize_strings(a: Column) -> Column:
    return F.transform(a, lambda v: normalize_whitespace(normalize_unicode(v)))


def compact_keywords(a: Column) -> Column:
    """Cleaned keywords, first of each case-insensitive form, in order."""
    return keep_first_by(normalize_strings(a), F.lower)


def scrub_answer(c: Column) -> Column:
    """Remove foreign scripts and answer prefixes; the input if nothing is left."""
    foreign = (
        r"[一-鿿぀-ゟ゠-ヿ가-힯Ѐ-ӿ　-〿＀-￯]+"
    )
    prefix = r"(?iuU)\A(markdown\s*[-:]\s*|Trả lời\s*:\s*|Answer\s*:\s*)"
    x = F.regexp_replace(strip(text_or_empty(c)), foreign, "")
    x = strip(F.regexp_replace(x, prefix, ""))
    x = F.regexp_replace(x, r"(?iuU)\A(?:markdown)\s*[-:—]?\s*", "")
    x = F.regexp_replace(x, rf"[{WS}]*,[{WS}]*,[{WS}]*", ", ")
    x = strip(F.regexp_replace(x, r"[ \t]{2,}", " "))
    return let(x, lambda y: F.when(y != "", y).otherwise(c))


def scrub_rewrite(rewritten: Column, original: Column) -> Column:
    """Remove Cyrillic and CJK from a rewritten query; the original if empty."""
    x = strip(F.regexp_replace(rewritten, r"[а-яА-ЯёЁ一-鿿぀-ゟ゠-ヿ]", ""))
    return let(x, lambda y: F.when(y != "", y).otherwise(original))


def strip_tags(c: Column) -> Column:
    return collapse_blanks(F.regexp_replace(c, "<[^>]+>", " "))


_ITEM = r"(?:[-*+]\s+|\d+\.\s+)"


def tidy_markdown(c: Column) -> Column:
    """Drop trailing blanks, orphan bullets, extra blank lines and list gaps."""
    x = F.regexp_replace(text_or_empty(c), r"\r\n?", "\n")
    x = F.translate(x, " ", " ")
    x = F.regexp_replace(x, r"(?md)[ \t]+$", "")
    x = F.regexp_replace(x, r"(?md)^\s*[-*+]\s*$", "")
    x = F.regexp_replace(x, r"(?md)^\s*\d+\.\s*$", "")
    x = F.regexp_replace(x, r"\n{3,}", "\n\n")
    x = F.regexp_replace(x, rf"(?d)(\n\s*{_ITEM}.+)\n{{2,}}(?=\s*{_ITEM})", "$1\n")
    return strip(x)


def paragraph_answer(c: Column) -> Column:
    """Split a long plain answer into paragraphs of two sentences."""

    def shape(x: Column) -> Column:
        markdown = (
            x.rlike(rf"(?d)(^|\n)\s*({_ITEM}|#{{1,6}}\s+|\|)")
            | x.rlike(r"`{3}|`[^`]+`|\*\*[^*]+\*\*")
            | x.contains("\n")
        )
        parts = F.filter(
            F.transform(F.split(x, r"(?<=[.!?])\s+(?=\S)"), lambda s: strip(s)), lambda s: s != ""
        )

        def pairs(p: Column) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(F.size(p), F.lit(1)), F.lit(2))
            joined = F.transform(starts, lambda i: F.array_join(F.slice(p, i, 2), " "))
            return F.when(F.size(p) < 3, x).otherwise(F.array_join(joined, "\n\n"))

        return F.when(markdown | (F.length(x) <= 220), x).otherwise(let(parts, pairs))

    return let(tidy_markdown(c), shape)


def session_title(c: Column) -> Column:
    return F.when(F.length(c) > 50, F.concat(F.substring(c, 1, 50), F.lit("..."))).otherwise(c)


def display_source(c: Column) -> Column:
    """Drop the landing time stamp and a four-digit suffix before ``.pdf``."""
    return F.regexp_replace(F.regexp_replace(c, r"\A\d{14}_", ""), r"(?i)_(\d{4})\.pdf\z", ".pdf")


def clean_amount(c: Column) -> Column:
    return strip(F.regexp_replace(text_or_empty(c), r"[^0-9.,]", ""), ".,")


def is_money(c: Column) -> Column:
    return text_or_empty(c).rlike(r"\A\d{1,3}(?:[.,]\d{3})+\z")


def format_folded_amount(c: Column) -> Column:
    """One dot before the last three digits, wherever the amount had blanks."""
    return F.regexp_replace(F.regexp_replace(text_or_empty(c), "[^0-9]", ""), r"\A(\d+)(\d{3})\z", "$1.$2")


def is_table_separator(c: Column) -> Column:
    return text_or_empty(c).rlike(r"\A\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)+\|?\s*\z")


def is_placeholder_cell(c: Column) -> Column:
    return let(
        normalize_query(c),
        lambda x: (x == "") | (x == "…") | x.rlike(rf"\A[.\-–_{WS}]+\z"),
    )


def clean_context_line(c: Column) -> Column:
    """Plain sentence of a context line; empty for rules, headers and tables."""
    return let(normalize_query(c), plain_sentence)


def plain_sentence(line: Column) -> Column:
    """As ``clean_context_line``, of a line that ``normalize_query`` has been through."""
    x = F.when(line.contains("<"), strip_tags(line)).otherwise(line)
    x = F.regexp_replace(x, rf"\A[-*]+[{WS}]*", "")
    x = F.regexp_replace(x, rf"\A\d+\.[{WS}]*", "")

    def test(t: Column) -> Column:
        skipped = (
            t.isin("", "---")
            | (t.startswith("[") & t.endswith("]"))
            | F.lower(t).contains("[đã cắt bớt]")
            | t.contains("|")
        )
        return F.when(skipped, F.lit("")).otherwise(t)

    return let(x, test)


def clean_directive(c: Column) -> Column:
    """Directive body up to the first signature marker, tags and pipes removed."""
    x = F.regexp_replace(normalize_query(c), "<[^>]+>", " ")
    x = F.regexp_replace(x, r"\[[^\]]+\]", " ")
    x = F.regexp_replace(x, r"\||---", " ")
    markers = "|".join(re.escape(m) for m in vocab.CUT_MARKERS)
    x = F.regexp_replace(x, rf"(?s)(?:{markers}).*\z", "")
    return strip(F.regexp_replace(x, f"[{WS}]+", " "), " -;,.")


def capitalize_words(c: Column) -> Column:
    """Each blank-separated word with one leading capital."""
    words = F.split(c, f"[{WS}]+")
    return F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))),
        " ",
    )
