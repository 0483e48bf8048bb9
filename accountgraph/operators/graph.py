"""Degree tables, neighbour sums and edge weights of a directed multigraph.

An edge row ``(src, dst)`` counts once each time it occurs, self-loops
included. Followers of an account are the rows with it in ``dst``, pursuers
the rows with it in ``src``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accountgraph.operators.skew import join_totals


def account_ids(edges: DataFrame) -> DataFrame:
    """Distinct ``id`` of both edge ends."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def in_degree(edges: DataFrame) -> DataFrame:
    """``id, n`` for accounts with at least one incoming edge."""
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"))


def out_degree(edges: DataFrame) -> DataFrame:
    """``id, n`` for accounts with at least one outgoing edge."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"))


def with_zeros(counts: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, n`` for every id, 0 where ``counts`` has no row."""
    return counts.join(ids, "id", "right").select("id", F.coalesce("n", F.lit(0)).alias("n"))


def follower_count(edges: DataFrame) -> DataFrame:
    """``id, n``: incoming edges of every account, in one pass like ``degree_table``."""
    return degree_table(edges).select("id", F.col("followers").alias("n"))


def pursuer_count(edges: DataFrame) -> DataFrame:
    """``id, n``: outgoing edges of every account, in one pass like ``degree_table``."""
    return degree_table(edges).select("id", F.col("pursuers").alias("n"))


def join_degrees(followers: DataFrame, pursuers: DataFrame) -> DataFrame:
    """``id, followers, pursuers`` from the two count tables."""
    return followers.withColumnRenamed("n", "followers").join(pursuers.withColumnRenamed("n", "pursuers"), "id")


def degree_table(edges: DataFrame) -> DataFrame:
    """``id, followers, pursuers`` of every account in a single aggregation.

    Each edge contributes one row per end, so both counts and the zeros come
    out of one shuffle instead of two counts, two outer joins and a join.
    """
    ends = edges.select(
        F.inline(
            F.array(
                F.struct(F.col("src").alias("id"), F.lit(0).alias("incoming"), F.lit(1).alias("outgoing")),
                F.struct(F.col("dst").alias("id"), F.lit(1).alias("incoming"), F.lit(0).alias("outgoing")),
            )
        )
    )
    return ends.groupBy("id").agg(F.sum("incoming").alias("followers"), F.sum("outgoing").alias("pursuers"))


def neighbour_id_sum(edges: DataFrame) -> DataFrame:
    """``id, id_sum``: the ids in ``dst`` added up per ``src`` (ids, not a count of rows)."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.sum("dst").alias("id_sum"))


def weighted_edges(edges: DataFrame) -> DataFrame:
    """``src, dst, weight`` with weight 1.0 for each edge row."""
    return edges.select("src", "dst", F.lit(1.0).alias("weight"))


def vertex_init(edges: DataFrame, value: float = 1.0) -> DataFrame:
    """``id, rank`` with the same starting value for every account."""
    return account_ids(edges).withColumn("rank", F.lit(float(value)))


def out_weight_sum(weighted: DataFrame) -> DataFrame:
    """``src, weight_sum`` over the outgoing edges."""
    return weighted.groupBy("src").agg(F.sum("weight").alias("weight_sum"))


def edge_weights(weighted: DataFrame) -> DataFrame:
    """``src, dst, weight`` with each weight divided by the sum over its source's edges."""
    totals = weighted.groupBy("src").agg(F.sum("weight").alias("weight_sum"), F.count(F.lit(1)).alias("n"))
    joined = join_totals(weighted, totals, key="src", count="n")
    return joined.select("src", "dst", (F.col("weight") / F.col("weight_sum")).alias("weight"))
