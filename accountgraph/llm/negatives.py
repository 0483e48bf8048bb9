"""Hard negatives by vertical scans of vector columns.

Vectors become whole numbers and lie in blocks, one array per dimension. A
scan adds up an anchor's inner products dimension by dimension, those where the
anchor is largest first. The least and the most that the remaining dimensions
can add, by the block's smallest and largest value of each, bound every row's
score, and rows that can no longer matter leave the candidates. First the best
rows of the anchor's label are found, then the best rows of other labels within
a window of each positive's score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accountgraph.functions.geometry import all_finite
from accountgraph.llm.common import first_ranks, tables_of
from accountgraph.storage import scratch_path, stored

# Vectors are multiplied by this and rounded down.
SCALE = 256
POSITIVES = 5
NEGATIVES = 10
# A negative's score times 100 lies between these multiples of the positive's.
WINDOW = (30, 90)
# Anchors of one pass over the vectors, rows of a block, and dimensions read before candidates are looked at.
ANCHORS = 4_096
BLOCK = 65_536
STEP = 8
_EXACT = 2.0**53


def whole_numbers(vectors: DataFrame, label: Column) -> DataFrame:
    """``vec_id, label, q``: rows with a label and finite components, the components as whole numbers."""
    values = F.col("embedding").cast("array<double>")
    scaled = F.transform(values, lambda x: F.floor(F.lit(float(SCALE)) * x))
    large = F.exists(values, lambda x: F.abs(x) * SCALE >= _EXACT)
    q = F.when(large, F.raise_error(F.lit("a component is too large for exact products"))).otherwise(scaled)
    sound = vectors.where(F.col("label").isNotNull() & all_finite(values))
    return sound.select("vec_id", label.cast("int").alias("label"), q.cast("array<bigint>").alias("q"))


class Columns(NamedTuple):
    """A block: row ids and labels, one array per dimension, and each dimension's least and largest value."""

    vec_id: np.ndarray
    no_id: np.ndarray
    label: np.ndarray
    values: np.ndarray
    low: np.ndarray
    high: np.ndarray


def matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of equal length from lists; shorter ones end in zeros, and ``width`` is the least length."""
    lists = lists.combine_chunks()
    flat = lists.flatten().to_numpy().astype(np.float64)
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def columns_of(table: pa.Table, width: int) -> Columns:
    """The block's columns, rows by ascending id and null ids last, so that row numbers settle ties."""
    table = table.sort_by("vec_id")
    values = np.ascontiguousarray(matrix(table["q"], width).T)
    return Columns(
        table["vec_id"].fill_null(0).to_numpy(),
        table["vec_id"].is_null().to_numpy(),
        table["label"].to_numpy(),
        values,
        values.min(axis=1),
        values.max(axis=1),
    )


def scan(
    columns: Columns,
    query: np.ndarray,
    candidates: np.ndarray,
    keep: Callable[[np.ndarray, np.ndarray], np.ndarray],
    step: int = STEP,
) -> tuple[np.ndarray, np.ndarray]:
    """Candidates that stay to the end, and their exact scores.

    ``keep`` tells from the least and the largest score that each candidate
    can still have which of them matter.
    """
    order = np.argsort(-np.abs(query), kind="stable")
    query = query[order]
    ends = np.stack([query * columns.low[order], query * columns.high[order]])
    if np.abs(ends).max(axis=0).sum() >= _EXACT:
        raise ValueError("vectors are too large for exact products")
    # What the dimensions from the k-th on can add.
    least = np.append(np.cumsum(ends.min(axis=0)[::-1])[::-1], 0)
    most = np.append(np.cumsum(ends.max(axis=0)[::-1])[::-1], 0)
    partial = np.zeros(len(candidates))
    for k in range(0, len(query), step):
        read = order[k : k + step]
        part = columns.values[read] if len(candidates) == columns.values.shape[1] else columns.values[read][:, candidates]
        partial += query[k : k + step] @ part
        done = min(k + step, len(query))
        stay = keep(partial + least[done], partial + most[done])
        if not stay.all():
            candidates, partial = candidates[stay], partial[stay]
            if not len(candidates):
                break
    return candidates, partial.astype(np.int64)


def nth_largest(values: np.ndarray, n: int) -> float:
    return np.partition(values, len(values) - n)[len(values) - n] if len(values) >= n else -np.inf


def first(rows: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` largest scores, smaller row numbers first among equals."""
    return np.lexsort((rows, -scores))[:n]


def best_of_label(columns: Columns, query: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``n`` of ``rows`` with the largest scores, and these."""
    rows, scores = scan(columns, query, rows, lambda low, high: high >= nth_largest(low, n))
    order = first(rows, scores, n)
    return rows[order], scores[order]


def window_of(positive: int, window: tuple[int, int] = WINDOW) -> tuple[int, int]:
    """Least and largest score of a negative; the first is the larger one where none fits."""
    return -(-window[0] * positive // 100), window[1] * positive // 100


def best_in_windows(
    columns: Columns, query: np.ndarray, rows: np.ndarray, windows: list[tuple[int, int]], n: int
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window the ``n`` of ``rows`` with the largest scores inside it, and these."""
    open_ones = sorted({w for w in windows if w[0] <= w[1]})
    if not open_ones:
        none = np.zeros(0, np.int64)
        return [(none, none)] * len(windows)

    def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        stay = np.zeros(len(low), bool)
        for bottom, top in open_ones:
            # Rows that are inside whatever comes raise the bottom.
            sure = low[(low >= bottom) & (high <= top)]
            stay |= (high >= max(bottom, nth_largest(sure, n))) & (low <= top)
        return stay

    rows, scores = scan(columns, query, rows, keep)
    out = {}
    for bottom, top in open_ones:
        inside = np.flatnonzero((scores >= bottom) & (scores <= top))
        order = inside[first(rows[inside], scores[inside], n)]
        out[bottom, top] = rows[order], scores[order]
    none = np.zeros(0, np.int64)
    return [out.get(w, (none, none)) for w in windows]


class Anchors(NamedTuple):
    """Anchors of a pass, and the windows of each one's positives once these are known."""

    vec_id: list[int]
    label: list[int]
    vectors: np.ndarray
    windows: list[list[tuple[int, int]]]


def _scanned(rows: DataFrame, anchors: Anchors, find: Callable, block: int) -> DataFrame:
    """``slot, of, vec_id, score`` of what ``find`` gives for each anchor in each block of rows."""
    shared = rows.sparkSession.sparkContext.broadcast(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = shared.value
        for table in tables_of(batches, block):
            columns = columns_of(table, anchors.vectors.shape[1])
            width = columns.values.shape[0]
            slots, of, ids, nulls, scores = [], [], [], [], []
            for slot, (vec_id, label, vector) in enumerate(zip(anchors.vec_id, anchors.label, anchors.vectors)):
                query = np.zeros(width)
                query[: len(vector)] = vector
                for number, (found, score) in enumerate(find(columns, anchors, slot, vec_id, label, query)):
                    slots.append(np.full(len(found), slot))
                    of.append(np.full(len(found), number))
                    ids.append(columns.vec_id[found])
                    nulls.append(columns.no_id[found])
                    scores.append(score)
            if slots:
                made = [
                    pa.array(np.concatenate(slots), pa.int32()),
                    pa.array(np.concatenate(of), pa.int32()),
                    pa.array(np.concatenate(ids), pa.int64(), mask=np.concatenate(nulls)),
                    pa.array(np.concatenate(scores), pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(made, ["slot", "of", "vec_id", "score"])

    return rows.mapInArrow(run, "slot int, of int, vec_id bigint, score bigint")


def mined(
    rows: DataFrame,
    every: int,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    window: tuple[int, int] = WINDOW,
    block: int = BLOCK,
    most_anchors: int = ANCHORS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` from ``whole_numbers``.

    Anchors are the rows whose id is divisible by ``every``. An anchor's
    positives are its first rows of the same label and another id, its
    negatives those of other labels in the window of each positive. Larger
    scores come first, then smaller ids, null ids last. A row repeated as a
    whole is one anchor, but each copy may be a positive or a negative; rows
    that share an anchor's id are not its positives. Vectors of unequal length
    count as if the shorter ended in zeros. An anchor without positives, or
    without rows in a window, has no rows for it; an empty table gives none.

    Every pass broadcasts a bounded number of anchors and scans all rows twice.
    """
    spark = rows.sparkSession
    kept = stored(rows, "vectors")
    asked = stored(kept.df.where(F.col("vec_id") % every == 0).distinct(), "anchors")
    passes = -(-asked.df.count() // most_anchors)
    if passes > 1:
        # Dealt out evenly, so that a pass has a bounded number of anchors.
        dealt = stored(asked.df.repartition(passes).withColumn("pass", F.spark_partition_id()), "anchors")
        asked.free()
        asked = dealt
    path = scratch_path(spark, "negatives")
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    spark.createDataFrame([], schema).write.parquet(path)
    for number in range(passes):
        some = asked.df.where(F.col("pass") == number) if passes > 1 else asked.df
        own = some.select("vec_id", "label", "q").toArrow()
        anchors = Anchors(own["vec_id"].to_pylist(), own["label"].to_pylist(), matrix(own["q"], 1), [])
        _one_pass(kept.df, anchors, positives, negatives, window, block).write.mode("append").parquet(path)
    kept.free()
    asked.free()
    return spark.read.schema(schema).parquet(path)


def _one_pass(
    rows: DataFrame, anchors: Anchors, positives: int, negatives: int, window: tuple[int, int], block: int
) -> DataFrame:
    def same(columns: Columns, anchors: Anchors, slot: int, vec_id: int, label: int, query: np.ndarray) -> list:
        own = np.flatnonzero((columns.label == label) & (columns.no_id | (columns.vec_id != vec_id)))
        return [best_of_label(columns, query, own, positives)]

    def others(columns: Columns, anchors: Anchors, slot: int, vec_id: int, label: int, query: np.ndarray) -> list:
        return best_in_windows(columns, query, np.flatnonzero(columns.label != label), anchors.windows[slot], negatives)

    order = [F.desc("score"), F.asc_nulls_last("vec_id")]
    found = first_ranks(_scanned(rows, anchors, same, block), ["slot"], order, positives)
    # At most so many rows an anchor; they go out again with the anchors.
    best = sorted((r["slot"], r["rank"], r["vec_id"], r["score"]) for r in found.drop("of").collect())
    windows: list[list[tuple[int, int]]] = [[] for _ in anchors.vec_id]
    for slot, _, _, score in best:
        windows[slot].append(window_of(score, window))
    near = _scanned(rows, anchors._replace(windows=windows), others, block)
    ranked = first_ranks(near, ["slot", "of"], order, negatives)
    known = rows.sparkSession.createDataFrame(
        [(slot, rank - 1, anchors.vec_id[slot], vec_id, score) for slot, rank, vec_id, score in best],
        "slot int, of int, anchor_id bigint, positive_id bigint, positive_score bigint",
    )
    return ranked.join(F.broadcast(known), ["slot", "of"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
