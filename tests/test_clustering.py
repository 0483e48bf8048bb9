import hashlib

import numpy as np
import pytest
from conftest import SF_DIR, files_below, rows

from accountgraph.functions import nearest
from accountgraph.operators import clustering, graph
from accountgraph.sources import tables
from accountgraph.sources.text import as_points

POINTS = [(1, 0.0, 0.0), (2, 0.0, 2.0), (3, 10.0, 0.0), (4, 10.0, 2.0)]
STARTS = [(1, 0.0, 0.0), (2, 10.0, 0.0), (3, 100.0, 100.0)]


@pytest.fixture
def points(spark):
    return spark.createDataFrame(POINTS, "id long, x double, y double")


@pytest.fixture
def starts(spark):
    return lambda values=STARTS: spark.createDataFrame(values, "cid int, x double, y double")


@pytest.mark.parametrize("merge_places", [False, True])
def test_worked_example(points, starts, merge_places):
    for rounds in (1, 10):
        result = clustering.lloyd(points, starts(), rounds, merge_places=merge_places)
        assert rows(result.centroids) == [(1, 0.0, 1.0), (2, 10.0, 1.0)]
        assert rows(result.labelled, "id", "cid") == [(1, 1), (2, 1), (3, 2), (4, 2)]
        assert rows(clustering.within_cluster_cost(points, result.centroids)) == [(4.0,)]


def test_smallest_cid_wins_a_tie(spark, starts):
    point = spark.createDataFrame([(5, 5.0, 0.0)], "id long, x double, y double")
    assert rows(clustering.assign(point, starts()), "id", "cid") == [(5, 1)]
    assert rows(clustering.assign(point, starts(STARTS[::-1])), "id", "cid") == [(5, 1)]


def test_no_centroids(points, starts):
    empty = starts().where("cid < 0")
    for run in (clustering.assign, clustering.lloyd, clustering.within_cluster_cost):
        with pytest.raises(ValueError):
            run(points, empty)


def test_zero_rounds_keep_the_start(points, starts):
    assert rows(clustering.lloyd(points, starts(), 0).centroids) == sorted(STARTS)


def test_update_counts_points(points, starts):
    labelled = clustering.assign(points, starts())
    assert rows(clustering.update(labelled)) == [(1, 0.0, 1.0, 2), (2, 10.0, 1.0, 2)]


def by_hand(points, starts, rounds):
    """Labels and centroids of plain Lloyd rounds over ``id: coordinates``."""
    centres = dict(starts)
    for _ in range(rounds + 1):
        labels = {
            i: min(centres, key=lambda c: (sum((a - b) ** 2 for a, b in zip(p, centres[c])) ** 0.5, c)) for i, p in points.items()
        }
        last = centres
        groups = {c: [points[i] for i in points if labels[i] == c] for c in centres}
        centres = {c: [sum(v) / len(g) for v in zip(*g)] for c, g in groups.items() if g}
    return labels, last


@pytest.mark.parametrize("k", [2, 16, 17, 1000])
def test_any_number_of_centroids(spark, k):
    places = {i: [float(i * 37 % 101), float(i * 53 % 97)] for i in range(1200)}
    points = spark.createDataFrame([(i, *p) for i, p in places.items()], "id long, x double, y double")
    start = points.where(f"id < {k}").selectExpr("CAST(id AS INT) AS cid", "x", "y")
    labels, centres = by_hand(places, [(i, places[i]) for i in range(k)], 1)
    for merge_places in (False, True):
        result = clustering.lloyd(points, start, 1, merge_places=merge_places)
        assert dict(rows(result.labelled, "id", "cid")) == labels
        found = {c: [x, y] for c, x, y in rows(result.centroids)}
        assert found.keys() == centres.keys()
        for c in centres:
            assert found[c] == pytest.approx(centres[c])


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), None])
@pytest.mark.parametrize("k", [2, 17])
def test_coordinates_that_are_no_numbers(spark, points, starts, bad, k):
    odd = spark.createDataFrame([(9, bad, 1.0)], "id long, x double, y double")
    start = starts([(i, float(i), 0.0) for i in range(k)])
    runs = [lambda: clustering.assign(odd, start).collect(), lambda: clustering.within_cluster_cost(odd, start).collect()]
    runs += [lambda m=m: clustering.lloyd(odd, start, 1, merge_places=m) for m in (False, True)]
    runs.append(lambda: clustering.assign(points, start.union(odd.selectExpr("CAST(id AS INT)", "x", "y"))).collect())
    for run in runs:
        with pytest.raises(Exception, match="not a finite number"):
            run()


def test_names_that_clash(spark, points, starts):
    labelled = clustering.assign(points, starts())
    with pytest.raises(ValueError, match="cid"):
        clustering.assign(labelled, starts())
    with pytest.raises(ValueError, match="nearest"):
        clustering.measure(points.withColumnRenamed("id", "nearest"), starts())
    again = clustering.assign(labelled.drop("cid"), starts())
    assert rows(again) == rows(labelled)
    other = points.selectExpr("id AS distances", "x AS n", "y AS point")
    start = starts().toDF("cid", "n", "point")
    assert rows(clustering.lloyd(other, start, 1, ("n", "point")).centroids) == [(1, 0.0, 1.0), (2, 10.0, 1.0)]
    with pytest.raises(ValueError, match="'n'"):
        clustering.update(clustering.assign(other, start, ("n", "point")), ("n", "point"))


def cached(spark):
    return spark.sparkContext._jsc.getPersistentRDDs().size()


@pytest.mark.parametrize("merge_places", [False, True])
def test_scratch_is_freed(spark, shared, monkeypatch, points, starts, merge_places):
    monkeypatch.setattr(clustering, "CUT", 2)
    monkeypatch.setattr(clustering, "BLOCK", 1)
    before, held = set(files_below(shared)), cached(spark)
    result = clustering.lloyd(points, starts(), 7, merge_places=merge_places)
    assert not set(files_below(shared)) - before and cached(spark) == held
    assert result.labelled.count() == 4


def test_a_failed_round_leaves_nothing_cached(spark, shared, monkeypatch, points, starts):
    odd = points.union(spark.createDataFrame([(9, float("nan"), 1.0)], points.schema))
    before, held = set(files_below(shared)), cached(spark)
    for merge_places in (False, True):
        with pytest.raises(Exception, match="not a finite number"):
            clustering.lloyd(odd, starts(), 3, merge_places=merge_places)
    monkeypatch.setattr(clustering, "BLOCK", 1)
    monkeypatch.setattr(clustering, "_next_round", lambda blocks, move: blocks.selectExpr("CAST(raise_error('lost') AS array<double>) AS sums", "measured"))
    with pytest.raises(Exception, match="lost"):
        clustering.lloyd(points, starts(), 3)
    assert not set(files_below(shared)) - before and cached(spark) == held


def test_no_points(spark, points, starts):
    result = clustering.lloyd(points.where("id < 0"), starts(), 2)
    assert rows(result.labelled) == [] and rows(result.centroids) == []


def test_start_by_hash(spark, points):
    start = clustering.random_start(points, 2, "id", ("x", "y"), seed=5)
    order = sorted(POINTS, key=lambda p: int(hashlib.md5(f"5:{p[0]}".encode()).hexdigest()[:8], 16))
    assert rows(start) == [(i, *p[1:]) for i, p in enumerate(order[:2])]
    with pytest.raises(ValueError):
        clustering.random_start(points, 0, "id", ("x", "y"), 5)


def test_more_features(spark, starts):
    points = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 0.0, 0.0, 9.0)], "id long, x double, y double, z double")
    start = spark.createDataFrame([(1, 0.0, 0.0, 1.0), (2, 0.0, 0.0, 8.0)], "cid int, x double, y double, z double")
    result = clustering.lloyd(points, start, 3, ("x", "y", "z"))
    assert rows(result.centroids) == [(1, 0.0, 0.0, 0.0), (2, 0.0, 0.0, 9.0)]


def test_cost_never_grows(spark):
    points = as_points(graph.degree_table(tables.edges(spark, SF_DIR)))
    start = points.where("id < 5").selectExpr("CAST(id AS INT) AS cid", "x", "y")
    costs = [
        rows(clustering.within_cluster_cost(points, clustering.lloyd(points, start, n).centroids))[0][0]
        for n in range(4)
    ]
    assert all(later <= earlier + 1e-9 for earlier, later in zip(costs, costs[1:]))


def test_points_at_one_place_weigh_in(spark, starts):
    points = spark.createDataFrame([(i, 0.0, 0.0) for i in range(9)] + [(9, 3.0, 0.0)], "id long, x double, y double")
    result = clustering.lloyd(points, starts(), 1)
    assert rows(result.centroids) == [(1, pytest.approx(0.3), 0.0)]
    assert result.labelled.count() == 10


@pytest.mark.parametrize("seed", range(6))
def test_bounded_rounds_are_full_rounds(seed):
    """Bounds never change a label, ties and vanishing clusters included, and spare most distances in the end."""
    rng = np.random.default_rng(seed)
    if seed % 2:
        points = rng.integers(0, 12, (2, 3000)).astype(float)
    else:
        points = np.concatenate([rng.normal(c, 1.0, (3, 800)) for c in rng.uniform(-20, 20, 5)], axis=1)
    k = (3, 9, 40)[seed % 3]
    weights = rng.integers(1, 5, points.shape[1]).astype(float) if seed > 2 else None
    centres = clustering._Centres(list(range(k)), points[:, rng.choice(points.shape[1], k)].T + (seed == 4) * 50, None)
    if seed == 1:
        centres.cids[2] = 0
    bounds, spared = nearest.started(points, centres.places), 0
    for step in range(25):
        label, first, second = nearest.nearest(points, centres.places)
        assert (bounds.label == label).all(), step
        assert (bounds.upper >= first * (1 - 1e-9)).all() and (bounds.lower <= second * (1 + 1e-9)).all()
        sums = np.array(clustering._sums(points, weights, bounds.label, len(centres.cids))).reshape(len(centres.cids), -1)
        centres, move = clustering._moved(centres, sums)
        bounds, measured = nearest.advanced(points, bounds, move, nearest.half_gaps(move.centres))
        spared += points.shape[1] - measured
    assert spared > 10 * points.shape[1]


def test_later_rounds_measure_few_points(spark):
    points = as_points(graph.degree_table(tables.edges(spark, SF_DIR)))
    start = points.where("id < 5").selectExpr("CAST(id AS INT) AS cid", "x", "y")
    measured = []
    clustering.lloyd(points, start, 10, measured=measured)
    assert measured[0] == points.count() and sum(measured[1:]) < 5 * measured[0]


@pytest.mark.parametrize("block", [16_384, 200, 7])
def test_any_number_of_blocks(spark, monkeypatch, block):
    """Many blocks, one, and one sum or one column per sum give the centroids of plain rounds."""
    places = {i: [float(i * i % 37), float(i * 53 % 29)] for i in range(400)}
    points = spark.createDataFrame([(i, *p) for i, p in places.items()], "id long, x double, y double").coalesce(1)
    start = points.where("id < 6").selectExpr("CAST(id AS INT) AS cid", "x", "y")
    monkeypatch.setattr(clustering, "BLOCK", block)
    monkeypatch.setattr(clustering, "CUT", 3)
    labels, centres = by_hand(places, [(i, places[i]) for i in range(6)], 7)
    for few in (0, 100):
        monkeypatch.setattr(clustering, "FEW_SUMS", few)
        measured = []
        result = clustering.lloyd(points, start, 7, measured=measured)
        assert dict(rows(result.labelled, "id", "cid")) == labels and len(measured) == 7
        assert {c: [x, y] for c, x, y in rows(result.centroids)} == {c: pytest.approx(p) for c, p in centres.items()}


def test_centroids_of_one_id_become_one(spark, points):
    start = spark.createDataFrame([(1, 0.0, 0.0), (1, 0.0, 2.0), (2, 10.0, 0.0)], "cid int, x double, y double")
    assert rows(clustering.lloyd(points, start, 2).centroids) == [(1, 0.0, 1.0), (2, 10.0, 1.0)]


def test_points_of_other_lengths_fail(spark):
    points = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0])], "id long, v array<double>")
    start = spark.createDataFrame([(0, [0.0, 0.0])], "cid int, v array<double>")
    for run in (lambda: clustering.assign(points, start, "v").collect(), lambda: clustering.lloyd(points, start, 1, "v")):
        with pytest.raises(Exception, match="not a finite number"):
            run()


@pytest.mark.parametrize("features, name", [("embedding", "vectors"), (("x", "y"), "points")])
def test_random_start_is_consistent(spark, features, name):
    if name == "vectors":
        data = tables.vectors(spark, SF_DIR)
    else:
        data = as_points(graph.degree_table(tables.edges(spark, SF_DIR)))
    result = clustering.kmeans_random(data, 4, features, seed=3)
    again = clustering.kmeans_random(data, 4, features, seed=3)
    centres = np.array([c for _, c in rows(result.centres)])
    assert len(centres) == 4
    np.testing.assert_allclose(centres, np.array([c for _, c in rows(again.centres)]))
    cost = 0.0
    for row in result.labelled.collect():
        vector = np.array(row[features] if isinstance(features, str) else [row[f] for f in features])
        squares = ((centres - vector) ** 2).sum(axis=1)
        assert squares[row.cluster] == pytest.approx(squares.min(), rel=1e-6, abs=1e-6)
        cost += squares.min()
    assert rows(result.cost)[0] == (4, pytest.approx(cost, rel=1e-6))


def test_library_rounds_from_a_start(points, starts):
    result = clustering.kmeans_library(points, starts(STARTS[:2]), ("x", "y"))
    assert rows(result.labelled, "id", "cluster") == [(1, 0), (2, 0), (3, 1), (4, 1)]
    assert rows(result.centres) == [(0, [0.0, 1.0]), (1, [10.0, 1.0])] and rows(result.cost) == [(2, 4.0)]


def test_rounds_over_arrays(spark, points, starts):
    as_arrays = [df.selectExpr(key, "array(x, y) AS at") for df, key in ((points, "id"), (starts(), "cid"))]
    result = clustering.lloyd(*as_arrays, 3, "at")
    assert rows(result.centroids) == [(1, [0.0, 1.0]), (2, [10.0, 1.0])]
    assert rows(result.labelled, "id", "cid") == [(1, 1), (2, 1), (3, 2), (4, 2)]
