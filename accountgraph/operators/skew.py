"""Treatment of keys that hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accountgraph.storage import pin

# A key is hot when it holds more than 1/HOT_KEYS of all rows, so fewer than
# HOT_KEYS of them can exist whatever the data: one row per hot key is always
# small enough to broadcast.
HOT_KEYS = 10_000
# Below this many rows a key needs no special treatment.
HOT_ROWS = 100_000


def hot_threshold(total: Column | int) -> Column:
    """Row count above which a key is hot, given the count of all rows."""
    share = (total if isinstance(total, Column) else F.lit(total)) / F.lit(HOT_KEYS)
    return F.greatest(F.lit(float(HOT_ROWS)), share)


def join_totals(rows: DataFrame, totals: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join of ``rows`` with per-key ``totals`` that sends no hot key's rows to one task.

    ``totals`` holds one line per key with its row count in ``count``. The line
    of a hot key is repeated once for each threshold's worth of its rows, and
    its rows are dealt over the repeats in turn; which keys are hot is a
    broadcast of at most ``HOT_KEYS`` lines. The totals are made once, as a
    checkpoint, so that rows are read once for them and once for the join.
    """
    totals = pin(totals)
    salt, salts = "__skew_salt", "__skew_salts"
    threshold = hot_threshold(totals.agg(F.sum(count)).scalar())
    parts = totals.withColumn(salts, F.when(F.col(count) > threshold, F.ceil(F.col(count) / threshold)).otherwise(1).cast("int"))
    hot = parts.where(F.col(salts) > 1).select(key, salts)
    dealt = rows.join(F.broadcast(hot), key, "left").select(
        *rows.columns, F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col(salts)).cast("int"), F.lit(0)).alias(salt)
    )
    repeated = parts.select(*[c for c in totals.columns if c != count], F.explode(F.sequence(F.lit(0), F.col(salts) - 1)).alias(salt))
    return dealt.join(repeated, [key, salt]).drop(salt)


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """``key, n`` of the keys that hold too many of ``rows`` for one task, at most ``2 * HOT_KEYS`` of them.

    A sketch of bounded size names the keys that may be frequent; only these
    are then counted exactly.
    """
    sketch = rows.agg(F.expr(f"approx_top_k(`{key}`, {2 * HOT_KEYS}, {20 * HOT_KEYS})").alias("found"), F.count(F.lit(1)).alias("total"))
    likely = sketch.select(F.inline("found"), "total").where(F.col("count") * 2 > hot_threshold(F.col("total")))
    named = likely.select(F.col("item").alias(key), "total")
    counted = rows.join(F.broadcast(named), key).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.first("total").alias("total"))
    return counted.where(F.col("n") > hot_threshold(F.col("total"))).select(key, "n")


def join_rows(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Inner join on ``key`` that sends no hot key's ``rows`` to one task, whatever the join strategy.

    Rows of a hot key are dealt in turn over as many parts as they need, and
    its rows in ``others`` are repeated for each part. Where Spark broadcasts
    ``others`` anyway, by their size, keys don't matter and nothing is counted.
    """
    spark = rows.sparkSession
    threshold = int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
    if int(others._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= threshold:
        return rows.join(others, key)
    salt, salts = "__skew_salt", "__skew_salts"
    hot = hot_keys(rows, key)
    parts = pin(hot.select(key, F.ceil(F.col("n") / hot_threshold(rows.agg(F.count(F.lit(1))).scalar())).cast("int").alias(salts)))
    several = F.coalesce(salts, F.lit(1))
    dealt = rows.join(F.broadcast(parts), key, "left").select(
        *rows.columns, F.pmod(F.monotonically_increasing_id(), several).cast("int").alias(salt)
    )
    repeated = others.join(F.broadcast(parts), key, "left").select(
        *others.columns, F.explode(F.sequence(F.lit(0), several - 1)).alias(salt)
    )
    return dealt.join(repeated, [key, salt]).drop(salt)
