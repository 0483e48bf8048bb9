"""Visit log analysis: the busiest address of a period and the ranks of what it visited."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accountgraph.operators.skew import join_rows

# Default period (fixed values): epoch seconds, both ends exclusive.
PERIOD_AFTER = 1480546800
PERIOD_BEFORE = 1483225199


def in_period(log: DataFrame, after: int = PERIOD_AFTER, before: int = PERIOD_BEFORE) -> DataFrame:
    """Visits strictly later than ``after`` and strictly earlier than ``before``."""
    return log.where((F.col("ts") > after) & (F.col("ts") < before))


def ip_counts(log: DataFrame) -> DataFrame:
    """``ip, n``: visits per address."""
    return log.groupBy("ip").agg(F.count(F.lit(1)).alias("n"))


def top_ip(log: DataFrame) -> DataFrame:
    """The address with the most visits, the smallest one on a tie, as at most one row ``ip, n``."""
    return ip_counts(log).orderBy(F.desc("n"), "ip").limit(1)


def visits_of_top_ip(log: DataFrame) -> DataFrame:
    """Visits of the busiest address, picked by a scalar subquery that can reach the scan."""
    return log.where(F.col("ip") == top_ip(log).select("ip").scalar())


def join_top_ip(log: DataFrame) -> DataFrame:
    """Visits of the busiest address, picked by a join with its one-row table."""
    return log.join(F.broadcast(top_ip(log).select("ip")), "ip", "left_semi").select(*log.columns)


def rank_visits(ranks: DataFrame, log: DataFrame) -> DataFrame:
    """``account_id, page_rank, ts, ip`` for every visit of a ranked account.

    The ranks are broadcast when their size allows. Otherwise both sides are
    shuffled on the account, and the visits of accounts that hold a large
    share of the log, found by a sketch and counted exactly, are dealt over
    several tasks.
    """
    return join_rows(log, ranks, "account_id").select("account_id", "page_rank", "ts", "ip")


def top_visitor_avg_rank(
    ranks: DataFrame, log: DataFrame, after: int = PERIOD_AFTER, before: int = PERIOD_BEFORE
) -> DataFrame:
    """Average rank over the visits of the busiest address, one row ``avg_page_rank``.

    The average is per visit: an account visited twice counts twice, and
    visits of accounts without a rank drop out. Visits are counted per account
    before the join, so it moves one row per account rather than one per visit.
    """
    visits = visits_of_top_ip(in_period(log, after, before))
    per_account = visits.groupBy("account_id").agg(F.count(F.lit(1)).alias("visits"))
    ranked = per_account.join(ranks, "account_id").where(F.col("page_rank").isNotNull())
    return ranked.agg(
        F.try_divide(F.sum(F.col("page_rank") * F.col("visits")), F.sum("visits")).alias("avg_page_rank")
    )


def top_visitor_avg_rank_by_sum(
    ranks: DataFrame, log: DataFrame, after: int = PERIOD_AFTER, before: int = PERIOD_BEFORE
) -> DataFrame:
    """The same average taken over joined visit rows as sum divided by count."""
    joined = rank_visits(ranks, join_top_ip(in_period(log, after, before)))
    return joined.agg(F.try_divide(F.sum("page_rank"), F.count("page_rank")).alias("avg_page_rank"))
