"""Line and substring counting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accountgraph.functions.text import count_matches


def count_lines(lines: DataFrame) -> DataFrame:
    """Number of lines as one row ``n``."""
    return lines.agg(F.count(F.lit(1)).alias("n"))


def count_occurrences(lines: DataFrame, needle: str, column: str = "value") -> DataFrame:
    """Occurrences of ``needle`` over all lines as one row ``n``; 0 without lines."""
    return lines.agg(F.coalesce(F.sum(count_matches(F.col(column), needle)), F.lit(0)).alias("n"))
