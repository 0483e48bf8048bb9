"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words are runs of anything but ASCII white space (fixed pattern).
WORD = re.compile(r"[^\x20\x09-\x0D]+")
# The characters between words, for Spark's trimming functions.
BLANKS = " \t\n\x0b\f\r"

_ARROW = {
    "boolean": pa.bool_(),
    "int": pa.int32(),
    "bigint": pa.int64(),
    "double": pa.float64(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<int>": pa.list_(pa.int32()),
    "array<bigint>": pa.list_(pa.int64()),
    "array<double>": pa.list_(pa.float64()),
    "array<string>": pa.list_(pa.string()),
    "array<binary>": pa.list_(pa.binary()),
}

# Parts that the candidates of one key are first ranked in.
PARTS = 64
# Characters that a batch operator holds as Python objects at once.
BLOCK_CHARS = 4_000_000


def words(text: Column) -> Column:
    """Array of the words of ``text``; empty for null and blank texts."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, r"\s+")).otherwise(F.array().cast("array<string>"))


def fresh(columns: Sequence[str], base: str) -> str:
    """A column name that none of ``columns`` equals, whatever its case."""
    taken = {c.lower() for c in columns}
    name = base
    while name in taken:
        name = f"_{name}"
    return name


def text_blocks(texts: Sequence[str], chars: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """``(start, end)`` slices of ``texts`` that hold about ``chars`` characters each, one text at least."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > chars:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def text_bytes(column: pa.Array) -> list[bytes]:
    """Texts as they lie in the column, null as the empty text."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def whole_texts(column: pa.Array) -> list[str]:
    """Texts of the column, null as the empty text; bytes that are no UTF-8 become replacement characters."""
    try:
        return [t or "" for t in column.to_pylist()]
    except UnicodeDecodeError:
        return [b.decode("utf-8", "replace") for b in text_bytes(column)]


def with_output(
    docs: DataFrame,
    compute: Callable[[list[str]], dict[str, Sequence]],
    fields: dict[str, str],
    text: str = "text",
) -> tuple[DataFrame, str]:
    """``docs`` with one more struct column, and that column's name.

    ``compute`` gets whole texts (null as the empty string) in blocks and
    returns a sequence for each of ``fields``. The struct gets a name of its
    own, so columns of ``docs`` may be called anything, with dots too: Spark
    resolves no name of theirs. Bytes that are no UTF-8 become replacement
    characters in what ``compute`` gets.
    """
    name = fresh(docs.columns, "output")
    names = docs.columns
    at = names.index(text)
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    kinds = [(field, _ARROW[kind]) for field, kind in fields.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = whole_texts(batch.column(at))
            for start, end in text_blocks(texts):
                found = compute(texts[start:end])
                made = [v if isinstance(v := found[f], pa.Array) else pa.array(v, kind) for f, kind in kinds]
                struct = pa.StructArray.from_arrays(made, [field for field, _ in kinds])
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([*part.columns, struct], made_names)

    struct = ",".join(f"{field}:{kind}" for field, kind in fields.items())
    made_names = [*plain.columns, name]
    schema = plain.select("*", F.lit(None).cast(f"struct<{struct}>").alias(name)).schema
    return plain.mapInArrow(run, schema).toDF(*names, name), name


def computed(docs: DataFrame, compute: Callable, fields: dict[str, str], key: str = "doc_id") -> DataFrame:
    """``key`` and ``fields`` of every row."""
    out, name = with_output(docs.select(key, "text"), compute, fields)
    return out.select(key, f"{name}.*")


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """True for rows whose crc32 of the id as text leaves ``fold``; a null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def drawn(rows: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """At most ``n`` rows, those whose keys hash lowest: the same ones on every run."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)


def tables_of(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together to tables of at most ``rows`` rows."""
    held, n = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, rows - n)
            held.append(part)
            at, n = at + part.num_rows, n + part.num_rows
            if n == rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def first_ranks(found: DataFrame, keys: list[str], order: list[Column], most: int, parts: int = PARTS) -> DataFrame:
    """The first ``most`` rows of each key with their ``rank``; a key's rows are first ranked in parts."""
    part = F.pmod(F.xxhash64(*found.columns), F.lit(parts)).alias("part")
    within = Window.partitionBy(*keys, "part").orderBy(*order)
    few = found.select("*", part).withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= most).drop("rank", "part")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= most)
