"""The library's tables as views of a folder of TPC-H-like Parquet tables.

The two key columns of ``lineitem`` serve as a directed multigraph, ``events``
as the visit log, ``customer`` as the rank table and ``documents`` as a text
file of lines. Each view selects only the columns it needs, so scans stay
narrow.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """``src, dst``."""
    return _table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("src"), F.col("l_orderkey").alias("dst")
    )


def page_rank(spark: SparkSession, folder: str) -> DataFrame:
    """``account_id, page_rank``."""
    return _table(spark, folder, "customer").select(
        F.col("c_custkey").alias("account_id"), F.col("c_acctbal").alias("page_rank")
    )


def _timestamp(epoch_seconds: int) -> Column:
    moment = datetime.fromtimestamp(epoch_seconds, UTC).replace(tzinfo=None)
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def web_log(spark: SparkSession, folder: str, after: int | None = None, before: int | None = None) -> DataFrame:
    """``account_id, ip, ts`` with epoch seconds.

    ``after`` and ``before`` (exclusive, epoch seconds) restrict the stored
    timestamp itself, which lets the scan skip row groups; a condition on the
    derived ``ts`` cannot.
    """
    events = _table(spark, folder, "events")
    if after is not None:
        events = events.where(F.col("ts") >= _timestamp(after + 1))
    if before is not None:
        events = events.where(F.col("ts") < _timestamp(before))
    return events.select(
        F.col("user_id").alias("account_id"),
        (F.get_json_object("props", "$.k").cast("int") + 1).alias("ip"),
        F.unix_timestamp("ts").alias("ts"),
    )


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """``value``: the lines of all documents."""
    return _table(spark, folder, "documents").select(F.explode(F.split("text", "\n")).alias("value"))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """``vec_id, embedding``."""
    return _table(spark, folder, "embeddings").select("vec_id", "embedding")
