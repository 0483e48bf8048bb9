"""Readers for whitespace-separated text files without a header.

Every parser takes a one-column frame of lines (``value``) and a ``mode``:

* ``failfast`` raises on a line with a missing or malformed field, whichever
  fields are read later and whatever later filters leave out.
* ``drop`` leaves such lines out.

Fields beyond the expected ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accountgraph import schemas
from accountgraph.functions.text import tokens


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file or folder as ``value``."""
    return spark.read.text(path)


def _check_mode(mode: str) -> None:
    if mode not in ("failfast", "drop"):
        raise ValueError(f"unknown mode {mode!r}: use 'failfast' or 'drop'")


_LINE, _FIELDS = "__line", "__fields"


def _sound(lines: DataFrame, line: str, valid: Column, mode: str) -> DataFrame:
    """Rows that are ``valid``; with ``failfast`` any other one raises and shows its ``line``.

    The check is a filter, which Spark keeps however few columns are read, and
    which comes first in the condition when later filters are merged with it.
    """
    if mode == "drop":
        return lines.where(valid)
    complaint = F.concat(F.lit("malformed field in line: "), F.coalesce(F.col(line), F.lit("")))
    return lines.where(F.when(valid, F.lit(True)).otherwise(F.raise_error(complaint).cast("boolean")))


def _once(lines: DataFrame, made: Column, name: str) -> DataFrame:
    """``lines`` with ``made`` as column ``name``.

    A generator over one element makes it: unlike a plain column, which would
    be written out again in the check and in every field, it runs once a line.
    """
    return lines.select("*", F.explode(F.array(made)).alias(name))


def parse_fields(lines: DataFrame, schema: T.StructType, mode: str = "failfast") -> DataFrame:
    """First ``len(schema)`` fields of each line, typed and named by ``schema``."""
    _check_mode(mode)
    split = _once(lines.select(F.col("value").alias(_LINE)), tokens(F.col(_LINE)), _FIELDS)
    typed = [F.get(_FIELDS, F.lit(i)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(schema)]
    made = split.select(_LINE, F.inline(F.array(F.struct(*typed))))
    valid = F.lit(True)
    for name in schema.names:
        valid = valid & F.col(f"`{name}`").isNotNull()
    return _sound(made, _LINE, valid, mode).select(*[F.col(f"`{name}`") for name in schema.names])


def parse_edges(lines: DataFrame, mode: str = "failfast") -> DataFrame:
    """``src dst``."""
    return parse_fields(lines, schemas.EDGES, mode)


def parse_visits(lines: DataFrame, mode: str = "failfast") -> DataFrame:
    """``account_id ip ts``."""
    return parse_fields(lines, schemas.WEB_LOG, mode)


def parse_ranks(lines: DataFrame, mode: str = "failfast") -> DataFrame:
    """``account_id page_rank``."""
    return parse_fields(lines, schemas.PAGE_RANK, mode)


def parse_degrees(lines: DataFrame, mode: str = "failfast") -> DataFrame:
    """``id followers pursuers``."""
    return parse_fields(lines, schemas.DEGREES, mode)


def parse_points(lines: DataFrame, mode: str = "failfast") -> DataFrame:
    """Degree lines read as two-dimensional points ``id x y``."""
    return as_points(parse_degrees(lines, mode))


def as_points(degrees: DataFrame) -> DataFrame:
    """Degree table as points: followers on the x axis, pursuers on the y axis."""
    return degrees.select(
        "id", F.col("followers").cast("double").alias("x"), F.col("pursuers").cast("double").alias("y")
    )


def parse_centroids(lines: DataFrame, mode: str = "failfast") -> DataFrame:
    """``cid x y``."""
    return parse_fields(lines, schemas.CENTROIDS, mode)


def parse_ids(lines: DataFrame, mode: str = "failfast") -> DataFrame:
    """Every field of every line as one ``id`` row; ``drop`` leaves out fields, not lines."""
    _check_mode(mode)
    each = lines.select(F.col("value").alias(_LINE), F.explode(tokens(F.col("value"))).alias(_FIELDS))
    numbers = _once(each, F.col(_FIELDS).try_cast("bigint"), "id")
    return _sound(numbers, _LINE, F.col("id").isNotNull(), mode).select("id")


def parse_vectors(lines: DataFrame, mode: str = "failfast") -> DataFrame:
    """All fields of a line as one ``features`` array."""
    _check_mode(mode)
    numbers = F.transform(tokens(F.col(_LINE)), lambda t: t.try_cast("double"))
    made = _once(lines.select(F.col("value").alias(_LINE)), numbers, "features")
    return _sound(made, _LINE, ~F.exists("features", lambda v: v.isNull()), mode).select("features")
