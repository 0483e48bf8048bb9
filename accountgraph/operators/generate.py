"""Reproducible synthetic visit logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accountgraph.functions.hashing import hash_below, hashes_below

# Ranges of generated values, all inclusive (fixed values).
MAX_VISITS = 9
MAX_IP = 100
FIRST_TS = 1451602800
LAST_TS = 1483225199


def generate_visits(
    ids: DataFrame,
    seed: int,
    max_per_id: int = MAX_VISITS,
    ip_max: int = MAX_IP,
    first_ts: int = FIRST_TS,
    last_ts: int = LAST_TS,
) -> DataFrame:
    """0 to ``max_per_id`` visits ``account_id, ip, ts`` for each row of ``ids``.

    Rows depend on the seed and the id only, so any split of the ids over
    tasks, and any retry, gives the same log. Each partition is sorted by time.

    The ids stay where they are: nothing is shuffled.
    """
    account = F.col("id")
    visit = F.col("visit")
    visit_numbers = F.sequence(F.lit(0), hash_below(max_per_id + 1, seed, "n", account))
    numbered = ids.select("id", F.explode(visit_numbers).alias("visit"))
    # Address and time come from one digest.
    ip, ts = hashes_below([ip_max, last_ts - first_ts + 1], seed, "visit", account, visit)
    return (
        numbered.where(visit > 0)
        .select(account.alias("account_id"), (ip + 1).cast("int").alias("ip"), (ts + first_ts).alias("ts"))
        .sortWithinPartitions("ts")
    )
