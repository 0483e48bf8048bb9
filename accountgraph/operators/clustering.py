"""k-means from given starting centroids and from a seeded random start.

Coordinates must be finite numbers: a point or centroid with a null, NaN or
infinite one fails the query with an error that shows it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.clustering import KMeans as VectorKMeans
from pyspark.mllib.clustering import KMeansModel as VectorKMeansModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegerType, StructType

from accountgraph.functions import nearest
from accountgraph.functions.geometry import all_finite, squared_array_distance
from accountgraph.functions.hashing import hash_below
from accountgraph.storage import Stored, stored

FEATURES = ("x", "y")
# Columns made on the way start with this.
_OWN = "__clustering_"
NEAR = f"{_OWN}near"
# Points of one block of Lloyd's rounds, and rounds after which the blocks are written.
BLOCK = 16_384
CUT = 20
# Sums of a round up to which each is a column of its own.
FEW_SUMS = 100


def _values(features: str | Sequence[str]) -> Column:
    """Coordinates as one array: of an array column, or of the numeric columns named."""
    if isinstance(features, str):
        return F.col(f"`{features}`").cast("array<double>")
    return F.array(*[F.col(f"`{f}`").cast("double") for f in features])


def _free(df: DataFrame, *names: str) -> None:
    taken = {c.lower() for c in df.columns} & set(names)
    if taken:
        raise ValueError(f"the input already has a column named {sorted(taken)[0]!r}: rename or drop it first")


def _complaint(what: str, shown: Column) -> Column:
    return F.raise_error(F.concat(F.lit(f"{what} with a coordinate that is not a finite number: "), shown))


class _Centres(NamedTuple):
    """Centroids on the driver, whose number and size the caller chose; in the order of their ids."""

    cids: list
    places: np.ndarray
    kind: DataType


def _centres(centroids: DataFrame, features: str | Sequence[str]) -> _Centres:
    found = centroids.select("cid", _values(features).alias("at")).collect()
    if not found:
        raise ValueError("no centroids given")
    for row in found:
        if row["at"] is None or not all(v is not None and np.isfinite(v) for v in row["at"]):
            raise ValueError(f"centroid with a coordinate that is not a finite number: {row}")
        if len(row["at"]) != len(found[0]["at"]):
            raise ValueError(f"centroids have different numbers of coordinates: {row}")
    found.sort(key=lambda row: (row["cid"] is not None, row["cid"]))
    return _Centres([row["cid"] for row in found], np.array([row["at"] for row in found], float), centroids.schema["cid"].dataType)


def _coordinates(values: pa.Array, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Matrix with a row per coordinate of the points that are finite and have as many, and which ones these are."""
    sound = pc.fill_null(pc.equal(pc.list_value_length(values), dimensions), False).to_numpy(zero_copy_only=False)
    flat = values.filter(pa.array(sound)).flatten().to_numpy(zero_copy_only=False)
    points = np.asarray(flat, float).reshape(-1, dimensions)
    finite = np.isfinite(points).all(axis=1)
    sound[np.flatnonzero(sound)[~finite]] = False
    return np.ascontiguousarray(points[finite].T), sound


def _nearest(points: DataFrame, centres: _Centres, features: str | Sequence[str]) -> DataFrame:
    """``points`` with the struct column ``NEAR`` of the least ``distance`` and its ``cid``; the smallest cid wins a tie.

    Only the coordinates go to Python, in Arrow batches, and meet the centres
    as blocks of a matrix.
    """
    kind = StructType().add("distance", DoubleType()).add("cid", centres.kind)
    shared = points.sparkSession.sparkContext.broadcast((centres.places, pa.array(centres.cids, to_arrow_type(centres.kind))))

    @F.arrow_udf(kind)
    def near(values: pa.Array) -> pa.Array:
        places, cids = shared.value
        at, sound = _coordinates(values, places.shape[1])
        label, distance, _ = nearest.nearest(at, places)
        place = np.zeros(len(sound), np.int64)
        place[sound] = np.arange(len(label))
        which = pa.array(place, mask=~sound)
        return pa.StructArray.from_arrays(
            [pa.array(distance).take(which), cids.take(pa.array(label)).take(which)], ["distance", "cid"], mask=pa.array(~sound)
        )

    given = [F.col(f"`{c}`") for c in points.columns]
    found = points.select(*given, near(_values(features)).alias(NEAR))
    checked = F.when(F.col(NEAR).isNotNull(), F.col(NEAR)).otherwise(_complaint("point", F.to_json(F.struct(*given))))
    return found.select(*given, checked.alias(NEAR))


def measure(points: DataFrame, centroids: DataFrame, features: str | Sequence[str] = FEATURES) -> DataFrame:
    """``points`` with the struct ``nearest``: ``distance`` to the nearest centroid and its ``cid``."""
    _free(points, "nearest")
    return _nearest(points, _centres(centroids, features), features).withColumnRenamed(NEAR, "nearest")


def assign(points: DataFrame, centroids: DataFrame, features: str | Sequence[str] = FEATURES) -> DataFrame:
    """``points`` with the ``cid`` of the nearest centroid; the smallest cid wins a tie.

    The centroids are collected: their number is the caller's choice.
    """
    _free(points, "cid")
    return _labelled(points, _centres(centroids, features), features)


def _labelled(points: DataFrame, centres: _Centres, features: str | Sequence[str]) -> DataFrame:
    return _nearest(points, centres, features).withColumn("cid", F.col(f"{NEAR}.cid")).drop(NEAR)


def _means(labelled: DataFrame, features: str | Sequence[str], weight: Column, count: str | None = None) -> DataFrame:
    total = F.sum(weight)
    counted = [] if count is None else [total.alias(count)]
    if isinstance(features, str):
        # Array columns have a length of their own: sums by place, put together again.
        at, value = f"{_OWN}at", f"{_OWN}value"
        places = labelled.select("cid", weight.alias(f"{_OWN}w"), F.posexplode(_values(features)).alias(at, value))
        each = places.groupBy("cid", at).agg(
            (F.sum(F.col(value) * F.col(f"{_OWN}w")) / F.sum(f"{_OWN}w")).alias(value), F.sum(f"{_OWN}w").alias(f"{_OWN}n")
        )
        centre = F.transform(F.sort_array(F.collect_list(F.struct(at, value))), lambda s: s[value])
        counted = [] if count is None else [F.max(f"{_OWN}n").alias(count)]
        return each.groupBy("cid").agg(centre.alias(features), *counted)
    return labelled.groupBy("cid").agg(*[(F.sum(F.col(f"`{f}`") * weight) / total).alias(f) for f in features], *counted)


def update(labelled: DataFrame, features: str | Sequence[str] = FEATURES, weight: str | None = None) -> DataFrame:
    """Mean of every non-empty cluster: ``cid``, the features and the number ``n`` of points.

    ``weight`` names a column telling how many points a row stands for.
    """
    if "n" in ([features] if isinstance(features, str) else features):
        raise ValueError("a feature is named 'n', like the count of points: rename it first")
    return _means(labelled, features, F.lit(1) if weight is None else F.col(f"`{weight}`"), "n")


class Lloyd(NamedTuple):
    labelled: DataFrame
    centroids: DataFrame


# A block of points on one row: coordinates, weights (empty: all 1), bounds, sums by centre, distances measured.
_BLOCKS = "points binary, weights binary, label binary, upper binary, lower binary, sums array<double>, measured bigint"
_FIELDS = ["points", "weights", "label", "upper", "lower", "sums", "measured"]


def _sums(points: np.ndarray, weights: np.ndarray | None, label: np.ndarray, k: int) -> list[float]:
    """Weight and weighted coordinate sums of each centre's points."""
    rows = [np.bincount(label, weights, k)]
    rows += [np.bincount(label, at if weights is None else at * weights, k) for at in points]
    return np.stack(rows).astype(float).T.ravel().tolist()


def _block(points: np.ndarray, weights: np.ndarray | None, bounds: nearest.Bounds, sums: list[float], measured: int) -> pa.RecordBatch:
    packed = [points, np.zeros(0) if weights is None else weights, *bounds]
    made = [pa.array([v.tobytes()], pa.binary()) for v in packed]
    made += [pa.array([sums], pa.list_(pa.float64())), pa.array([measured], pa.int64())]
    return pa.RecordBatch.from_arrays(made, _FIELDS)


def _unpacked(batch: pa.RecordBatch, i: int, d: int) -> tuple[np.ndarray, np.ndarray | None, nearest.Bounds]:
    points, weights, label, upper, lower = (batch.column(c)[i].as_buffer() for c in range(5))
    bounds = nearest.Bounds(np.frombuffer(label, np.int32), np.frombuffer(upper), np.frombuffer(lower))
    return np.frombuffer(points).reshape(d, -1), np.frombuffer(weights) if weights.size else None, bounds


def _first_round(places: DataFrame, centres: _Centres, features: str | Sequence[str], weight: str | None) -> DataFrame:
    """Blocks of the points, each with its nearest centre."""
    given = centres.places

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def block() -> pa.RecordBatch:
            points = np.ascontiguousarray(np.concatenate([p for p, _ in held], axis=1))
            weights = None if weight is None else np.concatenate([w for _, w in held])
            bounds = nearest.started(points, given)
            return _block(points, weights, bounds, _sums(points, weights, bounds.label, len(given)), n)

        for batch in batches:
            at, sound = _coordinates(batch.column(0), given.shape[1])
            if not sound.all():
                odd = batch.slice(int(np.argmin(sound)), 1).column(0).to_pylist()[0]
                raise ValueError(f"point with a coordinate that is not a finite number: {odd}")
            held.append((at, None if weight is None else batch.column(1).to_numpy(zero_copy_only=False).astype(float)))
            n += at.shape[1]
            if n >= BLOCK:
                yield block()
                held, n = [], 0
        if n:
            yield block()

    columns = [_values(features).alias("at")] + ([] if weight is None else [F.col(weight)])
    return places.select(*columns).mapInArrow(run, _BLOCKS)


def _next_round(blocks: DataFrame, move: nearest.Move) -> DataFrame:
    """The blocks after the centres moved; points whose bounds tell their centre need no distances."""
    d, gaps, same = move.centres.shape[1], nearest.half_gaps(move.centres), np.array_equal(move.number, np.arange(len(move.centres)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                points, weights, before = _unpacked(batch, i, d)
                bounds, measured = nearest.advanced(points, before, move, gaps)
                if same and (measured == 0 or np.array_equal(bounds.label, before.label)):
                    sums = batch.column(5)[i].as_py()
                else:
                    sums = _sums(points, weights, bounds.label, len(move.centres))
                yield _block(points, weights, bounds, sums, measured)

    return blocks.mapInArrow(run, _BLOCKS)


def _totals(blocks: DataFrame, k: int, d: int) -> tuple[np.ndarray, int]:
    """Sums of all blocks, ``k`` rows of weight and coordinates, and how many points were measured."""
    n = k * (d + 1)
    values = F.concat("sums", F.array(F.col("measured").cast("double")))
    flat = np.zeros(n + 1)
    if n < FEW_SUMS:
        # As columns they need no row each.
        found = blocks.select(*[values[i].alias(f"s{i}") for i in range(n + 1)])
        row = found.agg(*[F.coalesce(F.sum(f"s{i}"), F.lit(0.0)) for i in range(n + 1)]).first()
        flat[:] = list(row)
    else:
        for row in blocks.select(F.posexplode(values).alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value")).collect():
            flat[row["at"]] = row["value"]
    return flat[:-1].reshape(k, d + 1), int(flat[-1])


def _next_rounds_of_one(blocks: DataFrame, now: _Centres, move: nearest.Move, rounds: int) -> tuple[_Centres, list[int]]:
    """Centres after ``rounds`` more rounds over points that fit one block, and how many were measured in each.

    The sums of one block are those of all points, so its task can go on alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_unpacked(batch, i, move.centres.shape[1]) for batch in batches for i in range(batch.num_rows)]
        if not parts:
            return
        points = np.concatenate([p for p, _, _ in parts], axis=1)
        weights = None if parts[0][1] is None else np.concatenate([w for _, w, _ in parts])
        bounds = nearest.Bounds(*map(np.concatenate, zip(*[b for _, _, b in parts])))
        centres, moved, measured = now._replace(cids=list(range(len(now.cids)))), move, []
        for _ in range(rounds):
            bounds, taken = nearest.advanced(points, bounds, moved, nearest.half_gaps(moved.centres))
            measured.append(taken)
            sums = np.array(_sums(points, weights, bounds.label, len(moved.centres)))
            centres, moved = _moved(centres, sums.reshape(len(moved.centres), -1))
        made = [centres.cids, centres.places.ravel().tolist(), measured]
        kinds = [pa.int32(), pa.float64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([m], pa.list_(k)) for m, k in zip(made, kinds)], ["of", "places", "measured"])

    row = blocks.coalesce(1).mapInArrow(run, "of array<int>, places array<double>, measured array<bigint>").first()
    places = np.array(row["places"]).reshape(len(row["of"]), -1)
    return now._replace(cids=[now.cids[i] for i in row["of"]], places=places), list(row["measured"])


def _moved(centres: _Centres, sums: np.ndarray) -> tuple[_Centres, nearest.Move]:
    """Means of the clusters that have points; centres that share a cid become one."""
    by_cid: dict = {}
    for i, cid in enumerate(centres.cids):
        if sums[i, 0] > 0:
            by_cid.setdefault(cid, []).append(i)
    number, places = np.full(len(centres.cids), -1), []
    for now, own in enumerate(by_cid.values()):
        number[own] = now
        total = sums[own].sum(axis=0)
        places.append(total[1:] / total[0])
    after = np.array(places).reshape(len(by_cid), centres.places.shape[1])
    way = np.zeros(len(number))
    if len(by_cid):
        away = after[number] - centres.places
        way = np.where(number >= 0, np.sqrt((away * away).sum(axis=1)), 0.0)
    return centres._replace(cids=list(by_cid), places=after), nearest.Move(after, number, way)


def lloyd(
    points: DataFrame,
    centroids: DataFrame,
    iterations: int = 10,
    features: str | Sequence[str] = FEATURES,
    merge_places: bool = False,
    measured: list[int] | None = None,
) -> Lloyd:
    """Exactly ``iterations`` rounds of Lloyd's algorithm from the given centroids.

    A cluster that loses all its points disappears. The points are labelled
    with the centroids after the last update.

    The points lie in cached blocks, each with bounds on its distances, so a
    point far from any border between clusters needs no distances in later
    rounds. A round is one job over the blocks that adds up one row per
    cluster and block; only the sums reach the driver. ``merge_places`` first
    merges points at one place, which always share a cluster, into one row
    with their number: worth its shuffle where coordinates repeat, like
    whole-number degrees. ``measured`` gets the number of points of each round
    for which all distances were taken.
    """
    _free(points, "cid")
    now = _centres(centroids, features)
    names = [features] if isinstance(features, str) else list(features)
    columns = [F.col(f"`{f}`") for f in names]
    if iterations < 1:
        return Lloyd(_labelled(points, now, features), centroids.select("cid", *columns))
    places, weight = points.select(*columns), None
    if merge_places:
        # A place that is no place fails here, before equal ones are merged.
        shown = F.to_json(F.struct(*[F.col(f"`{c}`") for c in points.columns]))
        sound = F.when(all_finite(_values(features)), True).otherwise(_complaint("point", shown))
        weight = f"{_OWN}n"
        places = points.where(sound).select(*columns).groupBy(*columns).agg(F.count(F.lit(1)).alias(weight))
    blocks = _first_round(places, now, features, weight)
    kept: list[DataFrame] = []
    tables: list[Stored] = []
    try:
        for done in range(1, iterations + 1):
            kept.append(blocks.persist())
            sums, taken = _totals(blocks, *now.places.shape)
            if measured is not None:
                measured.append(taken)
            if len(kept) > 1:
                kept.pop(0).unpersist()
            now, move = _moved(now, sums)
            if not now.cids or done == iterations:
                break
            if done == 1 and taken <= BLOCK:
                # The first round measures every point.
                now, rest = _next_rounds_of_one(blocks, now, move, iterations - done)
                if measured is not None:
                    measured += rest
                break
            if done % CUT == 0:
                tables.append(stored(blocks, "blocks"))
                blocks = tables[-1].df
                if len(tables) > 1:
                    tables.pop(0).free()
            blocks = _next_round(blocks, move)
    finally:
        for df in kept:
            df.unpersist()
        for table in tables:
            table.free()
    schema = StructType().add("cid", now.kind)
    for f in names:
        schema.add(f, ArrayType(DoubleType()) if isinstance(features, str) else DoubleType())
    rows = [(cid, at.tolist()) if isinstance(features, str) else (cid, *at.tolist()) for cid, at in zip(now.cids, now.places)]
    last = points.sparkSession.createDataFrame(rows, schema)
    if not rows:
        # No points: nothing is labelled and no centroids are left.
        return Lloyd(points.withColumn("cid", F.lit(None).cast(now.kind)), last)
    return Lloyd(_labelled(points, now, features), last)


def within_cluster_cost(points: DataFrame, centroids: DataFrame, features: str | Sequence[str] = FEATURES) -> DataFrame:
    """Sum of squared distances of the points to their nearest centroid, one row ``cost``."""
    near = _nearest(points, _centres(centroids, features), features).select(F.col(f"{NEAR}.distance").alias("distance"))
    return near.agg(F.sum(F.col("distance") * F.col("distance")).alias("cost"))


def random_start(points: DataFrame, k: int, key: str, features: str | Sequence[str], seed: int) -> DataFrame:
    """``k`` of the points as centroids: those whose seeded hash of ``key`` is least, the smaller key first on a tie.

    The ``cid`` numbers them from 0 in that order.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    names = [features] if isinstance(features, str) else list(features)
    drawn = hash_below(2**32, seed, F.col(f"`{key}`"))
    first = points.orderBy(drawn, f"`{key}`").limit(k)
    chosen = first.agg(F.sort_array(F.collect_list(F.struct(drawn.alias("drawn"), F.col(f"`{key}`").alias("key"), F.struct(*[f"`{f}`" for f in names]).alias("at")))).alias("all"))
    placed = chosen.select(F.posexplode("all").alias("cid", "one"))
    return placed.select("cid", *[F.col("one.at")[f].alias(f) for f in names])


class RandomStart(NamedTuple):
    labelled: DataFrame
    centres: DataFrame
    cost: DataFrame


def kmeans_seeded(
    points: DataFrame,
    k: int,
    features: str | Sequence[str],
    seed: int,
    key: str,
    iterations: int = 10,
    merge_places: bool = False,
) -> RandomStart:
    """Lloyd's rounds from ``k`` points drawn by seeded hash: the same on any cluster.

    Returns the points with ``cid``, the centres ``cid`` and features, and
    ``k, cost``.
    """
    start = random_start(points, k, key, features, seed)
    found = lloyd(points, start, iterations, features, merge_places)
    cost = within_cluster_cost(points, found.centroids, features)
    return RandomStart(found.labelled, found.centroids, cost.select(F.lit(k).alias("k"), "cost"))


def kmeans_random(
    points: DataFrame, k: int, features: str | Sequence[str], seed: int, max_iter: int = 10
) -> RandomStart:
    """Library k-means with ``k`` clusters from a seeded random start.

    ``features`` names an array column, or the numeric columns to use. Returns
    the points with their ``cluster``, the centres ``cluster, centre`` and the
    sum of squared distances to the nearest centre as one row ``k, cost``.
    """
    _free(points, "cluster")
    spark = points.sparkSession
    point, vector = f"{_OWN}point", f"{_OWN}vector"
    vectors = points.withColumn(point, _values(features)).withColumn(vector, array_to_vector(point))
    # The library caches the vectors for its rounds and releases them afterwards.
    model = KMeans(k=k, maxIter=max_iter, initMode="random", seed=seed, featuresCol=vector, predictionCol="cluster").fit(vectors)
    centres = spark.createDataFrame(
        [(i, [float(v) for v in centre]) for i, centre in enumerate(model.clusterCenters())],
        "cluster int, centre array<double>",
    )
    predicted = model.transform(vectors).drop(vector)
    # The library ships the same centres to every executor, so their size is bounded.
    cost = predicted.join(F.broadcast(centres), "cluster").agg(
        F.lit(k).alias("k"), F.sum(squared_array_distance(F.col(point), F.col("centre"))).alias("cost")
    )
    return RandomStart(predicted.drop(point), centres, cost)


def kmeans_library(
    points: DataFrame, start: DataFrame, features: str | Sequence[str], max_iter: int = 10
) -> RandomStart:
    """Library k-means from given centroids, as from a random start that was drawn before.

    The library takes a start only over an RDD of vectors. It stops early when
    no centre moves, and keeps the centre of a cluster that has lost its points.
    Returns the points with the ``cluster`` of the nearest centre, the centres
    ``cluster, centre`` and ``k, cost``; clusters are numbered in the order of
    the start's ids.
    """
    _free(points, "cluster")
    spark, centres = points.sparkSession, _centres(start, features)
    vectors = points.select(_values(features).alias("at")).rdd.map(lambda row: row["at"])
    model = VectorKMeans.train(
        vectors, len(centres.cids), max_iter, epsilon=0.0, initialModel=VectorKMeansModel(centres.places.tolist())
    )
    found = [(i, [float(v) for v in centre]) for i, centre in enumerate(model.clusterCenters)]
    table = spark.createDataFrame(found, "cluster int, centre array<double>")
    own = _Centres([i for i, _ in found], np.array([at for _, at in found]), IntegerType())
    near = _nearest(points, own, features)
    cost = near.agg(F.lit(len(found)).alias("k"), F.sum(F.col(f"{NEAR}.distance") * F.col(f"{NEAR}.distance")).alias("cost"))
    return RandomStart(near.withColumn("cluster", F.col(f"{NEAR}.cid")).drop(NEAR), table, cost)
