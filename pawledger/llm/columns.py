"""Column builders over whole texts; built-in functions only."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

BLANKS = "[ \\t-\\r]+"
#: ASCII without digits and lower-case letters; texts are put in lower case first.
OUTSIDE_WORDS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def hash_sample(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    """All rows, or about `most` of them if there are more: those whose hash of the columns lies
    lowest. Only a count reaches the driver."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.shiftrightunsigned(F.xxhash64(*by), 11) < int((1 << 53) * (most / n)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column, between: str) -> Column:
    """The parts of a text between matches of a pattern, without empty ones. Null has none."""

    def inner(parts: Column) -> Column:
        head = F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0)
        tail = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
        return F.slice(parts, head + 1, F.size(parts) - head - tail)

    return let(F.split(F.coalesce(text, F.lit("")), between), inner)


def count_of(text: Column, letters: str) -> Column:
    """How many characters of a text are among the letters."""
    return (F.length(text) - F.length(F.translate(text, letters, ""))).cast("long")


def upto(n: Column) -> Column:
    """0, 1, ... n - 1; empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
