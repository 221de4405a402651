"""Payload filters: nested match conditions compiled to one Column."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from corpusmill.functions.text import text_or_empty

TOKEN_BOUNDS = {"content": (2, 32), "content_folded": (2, 32), "title": (2, 40)}


def word_tokens(c: Column, low: int = 2, high: int = 32) -> Column:
    """Distinct lower-case words within the length bounds."""
    words = F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: F.length(w).between(low, high)))


def match_text(c: Column, text: Column, low: int = 2, high: int = 32) -> Column:
    """All words of ``text`` occur in ``c``; no words match nothing."""
    wanted = word_tokens(text, low, high)
    return (F.size(wanted) > 0) & (F.size(F.array_except(wanted, word_tokens(c, low, high))) == 0)


def _condition(df: DataFrame, condition: Any) -> Column | None:
    """Column of one condition; None where it says nothing."""
    if not isinstance(condition, dict):
        return None
    key, match = condition.get("key"), condition.get("match", {})
    if not key or not isinstance(match, dict):
        return None
    values: list | None = None
    if "value" in match:
        values = [match["value"]]
    elif "text" not in match:
        wanted = match.get("any")
        if wanted is None or (isinstance(wanted, (list, tuple, set)) and not wanted):
            return None
        values = list(wanted) if isinstance(wanted, (list, tuple, set)) else [wanted]
    if key not in df.columns:
        return F.lit(False)
    if values is None:
        low, high = TOKEN_BOUNDS.get(key, (2, 32))
        test = match_text(F.col(key), F.lit(str(match["text"])), low, high)
    elif isinstance(df.schema[key].dataType, t.ArrayType):
        test = F.arrays_overlap(F.col(key), F.array(*[F.lit(v) for v in values]))
    else:
        test = F.col(key).isin(*values)
    return F.coalesce(test, F.lit(False))


def compile_filter(df: DataFrame, spec: dict[str, list] | None) -> Column:
    """``must`` all, ``should`` at least one, ``must_not`` none."""
    out = F.lit(True)
    for part, combine in (("must", "and"), ("should", "or"), ("must_not", "or")):
        tests = [c for c in (_condition(df, x) for x in (spec or {}).get(part) or []) if c is not None]
        if not tests:
            continue
        joined = reduce((lambda a, b: a & b) if combine == "and" else (lambda a, b: a | b), tests)
        out = out & (~joined if part == "must_not" else joined)
    return out


def security_spec() -> dict[str, list]:
    """Active chunks of public scope, under either name of the scope key."""
    return {
        "must": [{"key": "is_active", "match": {"value": True}}],
        "should": [
            {"key": "access_scope", "match": {"value": "public"}},
            {"key": "scope", "match": {"value": "public"}},
        ],
    }


def visible(chunks: DataFrame) -> DataFrame:
    return chunks.where(compile_filter(chunks, security_spec()))


def visible_to(user: Column) -> Column:
    """Public chunks, and private ones addressed to ``user``."""
    own = (F.col("access_scope") == "private") & (F.col("target_id") == user)
    return F.coalesce(F.col("is_active") & ((F.col("access_scope") == "public") | own), F.lit(False))


def with_ids(spec: dict[str, list], ids: list[str]) -> dict[str, list]:
    """The filter narrowed to chunks that list one of the ids."""
    hard = {"key": "student_ids_in_chunk", "match": {"any": ids}}
    return {**spec, "must": [*spec.get("must", []), hard]}


# Types a query intent never searches, when no single student is identified.
EXCLUDED_TYPES = {
    "student_lookup": ["student_list", "excel_table"],
    "document_info": ["student_list"],
}


def type_allowed(intent: Column, content_type: Column, has_target: Column) -> Column:
    out = F.lit(True)
    for name, types in EXCLUDED_TYPES.items():
        out = out & ~((intent == name) & content_type.isin(*types))
    return has_target | out


def preferred(df: DataFrame, chunk_types: list[str], time_filter: str | None = None) -> Column:
    """Optional narrowing by chunk type and time, apart from the scope group."""
    out = F.lit(True)
    if chunk_types and len(chunk_types) <= 2:
        out = out & F.col("chunk_type").isin(*chunk_types)
    if time_filter:
        out = out & (F.col("time_info") == time_filter if "time_info" in df.columns else F.lit(False))
    return F.coalesce(out, F.lit(False))


def is_invalid_vector(v: Column) -> Column:
    """Null, empty, or all components within 1e-9 of zero."""
    return F.coalesce(~F.exists(v, lambda x: F.abs(x) > 1e-9), F.lit(True))


def search_box(text: Column) -> Column:
    """Email or name contains the typed text, in any case."""
    needle = F.lower(text)
    return F.lower(F.coalesce("email", F.lit(""))).contains(needle) | F.lower(
        F.coalesce("full_name", F.lit(""))
    ).contains(needle)


def is_admin() -> Column:
    return F.coalesce(F.col("is_superuser"), F.lit(False)) | F.coalesce(F.col("role") == "admin", F.lit(False))


def is_content_manager() -> Column:
    return is_admin() | F.coalesce(F.col("role") == "lecturer", F.lit(False))
