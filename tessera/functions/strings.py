"""Text: anchored matches, matches with null for none, trimming by a set of characters, digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def full_match(c: Column, pattern: str) -> Column:
    return c.rlike(f"^(?:{pattern})$")


def group(c: Column, pattern: str, i: int) -> Column:
    """Group i of the first match; null, not empty, if nothing matches."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, i))


def cut(c: Column, start: Column, length: Column) -> Column:
    """substr with the rule that positions before 1 count but hold nothing."""
    begin = F.greatest(start, F.lit(1))
    return F.substring(c, begin, F.greatest(start + length - begin, F.lit(0)))


def strip_set(c: Column, chars: str, side: str = "BOTH") -> Column:
    return {"BOTH": F.btrim, "LEADING": F.ltrim, "TRAILING": F.rtrim}[side](c, F.lit(chars))


def visible(c: Column) -> Column:
    """Control characters written out."""
    for raw, shown in (("\\", "\\\\"), ("\r", "\\r"), ("\n", "\\n"), ("\t", "\\t")):
        c = F.replace(c, F.lit(raw), F.lit(shown))
    return c


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)
