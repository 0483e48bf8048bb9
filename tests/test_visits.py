import pytest
from conftest import SF_DIR, final_plan, planned, rows
from pyspark.sql import functions as F

from accountgraph.operators import skew, visits
from accountgraph.sources import tables

LOG = [
    (1, 7, 1480546800),
    (1, 7, 1480546801),
    (2, 7, 1483225198),
    (5, 7, 1482000000),
    (3, 9, 1482000000),
    (3, 9, 1483225199),
]
AVERAGES = [visits.top_visitor_avg_rank, visits.top_visitor_avg_rank_by_sum]


@pytest.fixture
def ranks(spark):
    return spark.createDataFrame([(1, 0.5), (2, 2.0), (3, 9.0)], "account_id long, page_rank double")


@pytest.fixture
def log(spark):
    return lambda extra=(): spark.createDataFrame(LOG + list(extra), "account_id long, ip int, ts long")


def test_parts(log, ranks):
    period = visits.in_period(log())
    assert rows(visits.ip_counts(period)) == [(7, 3), (9, 1)]
    assert rows(visits.top_ip(period)) == [(7, 3)]
    of_top = [(1, 7, 1480546801), (2, 7, 1483225198), (5, 7, 1482000000)]
    assert rows(visits.visits_of_top_ip(period)) == of_top
    assert rows(visits.join_top_ip(period)) == of_top
    assert rows(visits.rank_visits(ranks, visits.join_top_ip(period))) == [
        (1, 0.5, 1480546801, 7),
        (2, 2.0, 1483225198, 7),
    ]


@pytest.mark.parametrize("average", AVERAGES)
def test_average(log, ranks, average):
    assert rows(average(ranks, log())) == [(1.25,)]


@pytest.mark.parametrize("average", AVERAGES)
def test_average_is_per_visit(log, ranks, average):
    assert rows(average(ranks, log([(2, 7, 1483225198)]))) == [(1.5,)]


@pytest.mark.parametrize("average", AVERAGES)
def test_smallest_address_wins_a_tie(log, ranks, average):
    assert rows(average(ranks, log([(3, 9, 1482000000)] * 2))) == [(1.25,)]


@pytest.mark.parametrize("average", AVERAGES)
def test_no_visit_gives_one_null_row(log, ranks, average):
    assert rows(average(ranks, log(), 0, 1)) == [(None,)]
    assert rows(average(ranks.where("account_id = 3"), log())) == [(None,)]


def test_time_bounds_reach_the_scan(spark):
    log = visits.in_period(tables.web_log(spark, SF_DIR, 1704672000, 1705881600), 1704672000, 1705881600)
    pushed = final_plan(log.select("account_id"))
    assert "GreaterThanOrEqual(ts,2024-01-08T00:00:01)" in pushed
    assert "LessThan(ts,2024-01-22T00:00" in pushed
    narrow = rows(log)
    wide = rows(visits.in_period(tables.web_log(spark, SF_DIR), 1704672000, 1705881600))
    assert narrow == wide


def test_top_address_is_a_scalar_subquery(spark):
    plan = final_plan(visits.visits_of_top_ip(tables.web_log(spark, SF_DIR)))
    assert "Join" not in plan


@pytest.fixture
def busy(spark):
    """A log in which one account has 60 % of the visits, and ranks too large to broadcast."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    log = spark.range(0, 60_000, 1, 16).selectExpr(
        "IF(id % 5 < 3, 0, id) AS account_id", "CAST(id % 100 AS INT) AS ip", "hash(id) + 0L AS ts"
    )
    yield log, spark.range(60_000).selectExpr("id AS account_id", "id / 2D AS page_rank")
    for key in settings:
        spark.conf.unset(key)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_hot_accounts_are_found_and_counted(spark, busy, monkeypatch):
    log, _ = busy
    monkeypatch.setattr(skew, "HOT_ROWS", 100)
    assert rows(skew.hot_keys(log, "account_id")) == [(0, 36_000)]
    monkeypatch.setattr(skew, "HOT_ROWS", 40_000)
    assert rows(skew.hot_keys(log, "account_id")) == []
    assert rows(skew.hot_keys(log.where("ts IS NULL"), "account_id")) == []


def test_a_hot_account_is_dealt_over_tasks(spark, busy, monkeypatch):
    log, ranks = busy
    monkeypatch.setattr(skew, "HOT_ROWS", 100)
    joined = visits.rank_visits(ranks, log)
    assert "SortMergeJoin" in planned(joined)
    sizes = sorted(r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect())
    assert sum(sizes) == 60_000 and len(sizes) == 16 and sizes[-1] <= 2 * sizes[8]
    assert rows(joined) == rows(log.join(ranks, "account_id").select("account_id", "page_rank", "ts", "ip"))


def test_ranks_that_repeat_meet_every_visit(spark, busy, monkeypatch):
    log, ranks = busy
    monkeypatch.setattr(skew, "HOT_ROWS", 100)
    twice = ranks.where("account_id < 10").union(ranks.where("account_id = 0"))
    assert visits.rank_visits(twice, log).groupBy("account_id").count().where("account_id = 0").first()["count"] == 72_000
