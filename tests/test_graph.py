from collections import Counter

import pytest
from conftest import SF_DIR, final_plan, planned, rows

from accountgraph.operators import graph, skew
from accountgraph.sources import tables


def test_worked_example(edges):
    assert rows(graph.account_ids(edges)) == [(1,), (2,), (3,), (4,)]
    assert rows(graph.in_degree(edges)) == [(1, 2), (2, 1), (3, 3)]
    assert rows(graph.out_degree(edges)) == [(1, 2), (2, 1), (3, 2), (4, 1)]
    assert rows(graph.follower_count(edges)) == [(1, 2), (2, 1), (3, 3), (4, 0)]
    assert rows(graph.pursuer_count(edges)) == [(1, 2), (2, 1), (3, 2), (4, 1)]
    assert rows(graph.neighbour_id_sum(edges)) == [(1, 5), (2, 3), (3, 2), (4, 3)]
    assert rows(graph.vertex_init(edges)) == [(1, 1.0), (2, 1.0), (3, 1.0), (4, 1.0)]


def test_zero_pursuers_are_kept(spark, edges):
    more = edges.union(spark.createDataFrame([(3, 5)], edges.schema))
    assert (5, 1, 0) in rows(graph.degree_table(more))
    assert (5, 0) in rows(graph.pursuer_count(more))


def test_one_pass_and_joined_degrees_agree(spark):
    edges = tables.edges(spark, SF_DIR)
    joined = graph.join_degrees(graph.follower_count(edges), graph.pursuer_count(edges))
    assert rows(graph.degree_table(edges), "id", "followers", "pursuers") == rows(joined, "id", "followers", "pursuers")


def test_degree_table_takes_one_shuffle(spark):
    assert final_plan(graph.degree_table(tables.edges(spark, SF_DIR))).count("== Initial Plan ==") <= 1
    plan = graph.degree_table(tables.edges(spark, SF_DIR))._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join") == 0
    executed = graph.degree_table(tables.edges(spark, SF_DIR))._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange") == 1


EXPECTED_WEIGHTS = [(1, 2, 0.5), (1, 3, 0.5), (2, 3, 1.0), (3, 1, 0.5), (3, 1, 0.5), (4, 3, 1.0)]


def test_edge_weights(edges):
    assert rows(graph.edge_weights(graph.weighted_edges(edges))) == EXPECTED_WEIGHTS
    assert rows(graph.out_weight_sum(graph.weighted_edges(edges))) == [(1, 2.0), (2, 1.0), (3, 2.0), (4, 1.0)]


@pytest.mark.parametrize("hot_rows", [0, 1, 2, 30])
def test_edge_weights_with_hot_sources(spark, edges, monkeypatch, hot_rows):
    monkeypatch.setattr(skew, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(skew, "HOT_KEYS", 1_000_000)
    assert rows(graph.edge_weights(graph.weighted_edges(edges))) == EXPECTED_WEIGHTS
    real = tables.edges(spark, SF_DIR)
    degree = Counter(src for src, _ in rows(real))
    expected = sorted((src, dst, 1 / degree[src]) for src, dst in rows(real))
    assert rows(graph.edge_weights(graph.weighted_edges(real))) == expected


def test_counts_take_one_scan(spark):
    edges = tables.edges(spark, SF_DIR)
    for count in (graph.follower_count, graph.pursuer_count):
        plan = planned(count(edges))
        assert (plan.count("FileScan"), plan.count("Exchange"), plan.count("Join")) == (1, 1, 0)


def test_counts_with_zeros_by_join(edges):
    assert rows(graph.with_zeros(graph.in_degree(edges), graph.account_ids(edges))) == [(1, 2), (2, 1), (3, 3), (4, 0)]


def test_hot_sources_are_spread(spark, monkeypatch, no_broadcasts):
    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    monkeypatch.setattr(skew, "HOT_KEYS", 10)
    # One source holds a third of all edges, many of them copies of one edge.
    hot = spark.range(1000).selectExpr("0L AS src", "id % 3 AS dst")
    cold = spark.range(2000).selectExpr("1 + id % 500 AS src", "id AS dst")
    weighted = graph.weighted_edges(hot.union(cold))
    weights = graph.edge_weights(weighted)
    assert weights.count() == 3000
    assert {r.weight for r in weights.where("src = 0").collect()} == {1 / 1000}
    assert {r.weight for r in weights.where("src > 0").collect()} == {1 / 4}
    plan = planned(weights)
    # Hot keys are looked up in a broadcast, the weights in one shuffle join.
    assert plan.count("BroadcastHashJoin") == 1
    assert plan.count("SortMergeJoin") == 1


def test_edge_weights_read_the_edges_for_totals_and_for_the_join(spark, monkeypatch):
    plans = []
    real = skew.pin
    monkeypatch.setattr(skew, "pin", lambda df: plans.append(planned(df)) or real(df))
    plans.append(planned(graph.edge_weights(graph.weighted_edges(tables.edges(spark, SF_DIR)))))
    assert [plan.count("FileScan") for plan in plans] == [1, 1]
