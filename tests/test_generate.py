from conftest import SF_DIR, planned, rows
from pyspark.sql import functions as F

from accountgraph.operators import graph
from accountgraph.operators.generate import FIRST_TS, LAST_TS, generate_visits
from accountgraph.sources import tables


def test_seeded_log(spark):
    ids = spark.range(1, 1001)
    log = generate_visits(ids, seed=7)
    found = rows(log)
    assert found == rows(generate_visits(ids.repartition(7), seed=7))
    assert found != rows(generate_visits(ids, seed=8))
    per_id = {}
    for account, ip, ts in found:
        per_id[account] = per_id.get(account, 0) + 1
        assert 1 <= ip <= 100
        assert FIRST_TS <= ts <= LAST_TS
    assert max(per_id.values()) == 9
    assert 50 <= 1000 - len(per_id) <= 150
    assert {ip for _, ip, _ in found} == set(range(1, 101))


def test_partitions_are_sorted_by_time(spark):
    log = generate_visits(spark.range(0, 400, 1, 4), seed=7)
    placed = log.select(F.spark_partition_id().alias("p"), "ts").collect()
    for partition in {r.p for r in placed}:
        times = [r.ts for r in placed if r.p == partition]
        assert times == sorted(times)


def test_ranges_can_be_narrowed(spark):
    log = generate_visits(spark.range(50), 7, max_per_id=1, ip_max=1, first_ts=5, last_ts=5)
    assert {tuple(r)[1:] for r in log.collect()} == {(1, 5)}


def test_the_only_shuffle_is_that_of_the_ids(spark):
    assert planned(generate_visits(graph.account_ids(tables.edges(spark, SF_DIR)), 7)).count("Exchange") == 1
