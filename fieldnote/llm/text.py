"""Word expressions that run in the JVM.

A word is a run of characters other than space, tab, line feed, vertical tab, form feed
and carriage return.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
WORD_BREAK = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of ``text`` in order; none for a null or blank text."""
    inner = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, WORD_BREAK))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def free_name(columns: list[str]) -> str:
    """A column name that none of ``columns`` has, in either case."""
    taken, name = {c.lower() for c in columns}, "made"
    while name in taken:
        name += "_"
    return name
