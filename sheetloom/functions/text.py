"""Text helpers that agree with Unicode-aware strip, line splitting, word boundaries and upper-case tests."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space: the ASCII controls and every Unicode space that strip() removes.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body).getItem(0)


def cased(c: Column) -> Column:
    """Text as it is, in lower and in upper case."""
    return F.struct(c.alias("text"), F.lower(c).alias("low"), F.upper(c).alias("up"))


def strip(c: Column) -> Column:
    """Without white space at both ends; only the ends are searched, however long the runs of spaces between."""
    return F.btrim(c, F.lit(SPACES))


def lines(c: Column) -> Column:
    """Stripped lines without the empty ones, in order."""
    return F.filter(F.transform(F.split(c, LINE_END), strip), lambda x: x != "")


def raw_lines(c: Column) -> Column:
    """Stripped lines with the empty ones, in order."""
    return F.transform(F.split(c, LINE_END), strip)


def normalise_page(c: Column) -> Column:
    """Null becomes empty, CRLF and CR become LF, ends are stripped."""
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def contains_any(low: Column, terms: list[str]) -> Column:
    """Whether lower-cased text holds any of the terms."""
    return any_of([low.contains(t.lower()) for t in terms])


def matches_any(c: Column, patterns: list[str]) -> Column:
    """Unicode-aware search that ignores case."""
    return c.rlike("(?iU)" + "|".join(f"(?:{p})" for p in patterns))


def count_of(upper: Column, cues: list[str]) -> Column:
    """How many of the cues upper-cased text holds."""
    return reduce(lambda a, b: a + b, [upper.contains(t.upper()).cast("int") for t in cues], F.lit(0))


def is_upper(c: Column) -> Column:
    """At least one cased character and none in lower case."""
    return (F.upper(c) == c) & (F.lower(c) != c)


def block_id(page: Column, index: Column) -> Column:
    return F.concat(F.lit("page_"), page.cast("string"), F.lit("_block_"), F.when(index < 1000, F.lpad(index.cast("string"), 3, "0")).otherwise(index.cast("string")))
