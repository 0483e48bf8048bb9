from collections import Counter

import pytest
from conftest import SF_DIR, files_below, planned, rows

from accountgraph.operators import pagerank as module
from accountgraph.operators import skew
from accountgraph.operators.pagerank import pagerank
from accountgraph.sources import tables


def by_hand(edges, rounds, damping, start):
    """Plain restatement of the update rule."""
    ids = sorted({v for edge in edges for v in edge})
    degree = Counter(src for src, _ in edges)
    rank = dict.fromkeys(ids, start)
    for _ in range(rounds):
        inflow = Counter()
        for src, dst in edges:
            inflow[dst] += rank[src] / degree[src]
        rank = {v: (1 - damping) / len(ids) + damping * inflow[v] for v in ids}
    return rank


def check(df, expected):
    found = dict(rows(df))
    assert found.keys() == expected.keys()
    for key, value in expected.items():
        assert found[key] == pytest.approx(value, rel=1e-9, abs=1e-12)


def test_one_round(edges):
    ranks = pagerank(edges, 1, 0.85)
    check(ranks, {1: 0.8875, 2: 0.4625, 3: 2.1625, 4: 0.0375})
    assert sum(r for _, r in rows(ranks)) == pytest.approx(1 + 3 * 0.85)


@pytest.mark.parametrize("rounds", [2, 10])
def test_total_follows_the_damping(edges, rounds):
    total = sum(r for _, r in rows(pagerank(edges, rounds, 0.85)))
    assert total == pytest.approx(1 + 3 * 0.85**rounds)
    uniform = sum(r for _, r in rows(pagerank(edges, rounds, 0.85, init="uniform")))
    assert uniform == pytest.approx(1.0)


def test_dangling_account(spark, edges):
    pairs = rows(edges) + [(3, 5)]
    more = spark.createDataFrame(pairs, edges.schema)
    check(pagerank(more, 5, 0.85), by_hand(pairs, 5, 0.85, 1.0))


@pytest.mark.parametrize("damping", [0, 1])
def test_extreme_damping(edges, damping):
    check(pagerank(edges, 3, damping), by_hand(rows(edges), 3, damping, 1.0))


@pytest.mark.parametrize("hot_rows, hot_keys", [(0, 10**6), (40, 10**6), (100_000, 10_000)])
def test_hot_sources_give_the_same_ranks(spark, monkeypatch, hot_rows, hot_keys):
    monkeypatch.setattr(skew, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(skew, "HOT_KEYS", hot_keys)
    base = rows(tables.edges(spark, SF_DIR))
    pairs = base + [(7, n % 900) for n in range(3000)]
    check(pagerank(spark.createDataFrame(pairs, "src long, dst long"), 3, 0.85), by_hand(pairs, 3, 0.85, 1.0))


def test_caches_are_released(spark, edges):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    pagerank(edges, 2, 0.85)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_no_edges(spark):
    assert rows(pagerank(spark.createDataFrame([], "src long, dst long"), 2, 0.85)) == []


@pytest.mark.parametrize(
    "iterations, damping, init", [(0, 0.85, 1.0), (1, -0.1, 1.0), (1, 1.1, 1.0), (1, 0.85, "random")]
)
def test_bad_arguments(edges, iterations, damping, init):
    with pytest.raises(ValueError):
        pagerank(edges, iterations, damping, init)


@pytest.mark.parametrize("folder", [SF_DIR, "/root/testdata/sf0.1"])
def test_a_round_has_one_exchange(spark, monkeypatch, no_broadcasts, folder):
    plans = []
    real = module.pinned

    def kept(df, name):
        plans.append((name, planned(df)))
        return real(df, name)

    monkeypatch.setattr(module, "pinned", kept)
    pagerank(tables.edges(spark, folder), 2, 0.85)
    rounds = [plan for name, plan in plans if name == "ranks"]
    assert len(rounds) == 2
    for plan in rounds:
        # That of the messages: edges stay where they are.
        assert plan.count("Exchange") == 1
        assert "REPARTITION_BY_COL" not in plan
        assert plan.count("ENSURE_REQUIREMENTS") == 1


def test_edges_stay_in_place_without_the_cache(spark, monkeypatch, no_broadcasts):
    """A round after the cache is gone reads the kept links and shuffles the messages only."""
    edges = tables.edges(spark, SF_DIR)
    expected = rows(pagerank(edges, 3, 0.85))
    plans = []
    real = module._messages

    def uncached(links, sources):
        spark.catalog.clearCache()
        found = real(links, sources)
        plans.append(planned(found))
        return found

    monkeypatch.setattr(module, "_messages", uncached)
    assert rows(pagerank(edges, 3, 0.85)) == expected
    assert len(plans) == 3
    for plan in plans:
        assert "InMemory" not in plan and "Exchange" not in plan


def test_superseded_checkpoints_are_deleted(spark, shared, edges):
    before = set(files_below(shared))
    ranks = pagerank(edges, 4, 0.85)
    left = {p.relative_to(shared).parts[0] for p in set(files_below(shared)) - before}
    assert len(left) == 1 and left.pop().startswith("ranks-")
    assert ranks.count() == 4
