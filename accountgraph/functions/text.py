"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters a whitespace run may consist of (fixed value).
BLANKS = " \t\n\x0b\f\r"


def count_matches(text: Column, needle: str) -> Column:
    """Literal, case-sensitive, non-overlapping occurrences of ``needle``.

    Removing every match shortens the text by a whole number of needles, and
    byte lengths are known without scanning the string again.
    """
    if not needle:
        raise ValueError("the search string is empty")
    needle_bytes = len(needle.encode("utf-8"))
    removed = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(needle), F.lit("")))
    return (removed / F.lit(needle_bytes)).cast("bigint")


def tokens(line: Column) -> Column:
    """Fields of a line separated by whitespace runs, blanks at the ends ignored."""
    return F.split(F.btrim(line, F.lit(BLANKS)), r"\s+")


def joined_fields(*columns: str) -> Column:
    """One output line: the values separated by single spaces."""
    return F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns])
