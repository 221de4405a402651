"""Column expressions that several operators of this subpackage use."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def whole(text: Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Array of the maximal runs without ASCII white space; null has none."""
    return F.array_remove(F.split(whole(text), SPACE + "+"), "")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    moved = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(moved)


def seeded(seed: int, *columns: Column) -> Column:
    """64-bit hash that differs by seed."""
    return F.xxhash64(F.lit(seed), *columns)
