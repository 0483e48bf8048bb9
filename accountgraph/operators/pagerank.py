"""PageRank over a directed multigraph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accountgraph.operators import skew
from accountgraph.operators.graph import weighted_edges
from accountgraph.storage import pinned, settings


def _vertices(weighted: DataFrame) -> DataFrame:
    """``id, out_weight, out_edges`` of every account in one aggregation."""
    ends = weighted.select(
        F.inline(
            F.array(
                F.struct(F.col("src").alias("id"), F.col("weight").alias("out_weight"), F.lit(1).alias("out_edges")),
                F.struct(F.col("dst").alias("id"), F.lit(0.0).alias("out_weight"), F.lit(0).alias("out_edges")),
            )
        )
    )
    return ends.groupBy("id").agg(F.sum("out_weight").alias("out_weight"), F.sum("out_edges").alias("out_edges"))


def _parallel_weights(edges: DataFrame) -> DataFrame:
    """Repeated edges merged into one row with their summed weight."""
    return edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def pagerank(edges: DataFrame, iterations: int, damping: float, init: float | str = 1.0) -> DataFrame:
    """``id, rank`` after a fixed number of rounds.

    Each round sets ``rank(v) = (1 - d) / N + d * sum(rank(u) * w(u, v))`` with
    edge weights that add up to 1 per source; rank at accounts without
    outgoing edges is not redistributed. ``init`` is the starting rank, or
    ``"uniform"`` for 1/N.

    The weighted edges are shuffled and sorted by source once and kept, in that
    partitioning, in the shared folder; rounds read them from a cache, and what
    a lost executor held of it is read again, without another shuffle. The
    ranks keep the partitioning of the sum that made them, which is the same
    one; so a round moves only the combined messages. Sources holding a large
    share of the edges are kept apart: their edges stay spread evenly and meet
    a broadcast table with a bounded number of rows. The ranks are
    checkpointed every round, so plans stay flat and a lost executor costs at
    most one round; earlier checkpoints are deleted.

    Adaptive execution is off meanwhile: it would merge the partitions of each
    table by itself, and the two would have to be shuffled to meet again.
    """
    if iterations < 1:
        raise ValueError("iterations must be at least 1")
    if not 0 <= damping <= 1:
        raise ValueError("damping must lie between 0 and 1")
    if isinstance(init, str) and init != "uniform":
        raise ValueError("init must be a number or 'uniform'")

    with settings(edges.sparkSession, adaptive_enabled="false"):
        return _rounds(weighted_edges(edges), iterations, damping, init)


def _rounds(weighted: DataFrame, iterations: int, damping: float, init: float | str) -> DataFrame:
    counted = pinned(_vertices(weighted), "vertices")
    vertices = counted.df
    n_vertices, n_edges, most = vertices.agg(F.count(F.lit(1)), F.sum("out_edges"), F.max("out_edges")).first()
    if not n_vertices:
        return vertices.select("id", F.lit(0.0).alias("rank"))
    start = 1.0 / n_vertices if init == "uniform" else float(init)
    base = (1.0 - damping) / n_vertices

    totals = vertices.where("out_edges > 0").selectExpr("id AS src", "out_weight")
    cold_edges, hot_links, hot_ids = weighted, None, None
    if most > max(skew.HOT_ROWS, n_edges / skew.HOT_KEYS):
        hot = vertices.where(F.col("out_edges") > skew.hot_threshold(n_edges)).selectExpr("id AS src", "out_weight")
        hot_ids = hot.select("src")
        cold_edges = weighted.join(F.broadcast(hot_ids), "src", "left_anti")
        hot_links = _normalised(_parallel_weights(weighted.join(F.broadcast(hot_ids), "src")), F.broadcast(hot))
        hot_links.persist()
    by_source = _parallel_weights(cold_edges.repartition("src"))
    kept = pinned(_normalised(by_source.sortWithinPartitions("src"), totals).sortWithinPartitions("src"), "links")
    links = kept.df.persist()

    ranks, table = vertices.select("id", F.lit(start).alias("rank")), counted
    try:
        for _ in range(iterations):
            sources = ranks.selectExpr("id AS src", "rank")
            messages = _messages(links, sources)
            if hot_links is not None:
                hot_sources = sources.join(F.broadcast(hot_ids), "src", "left_semi")
                messages = messages.union(_messages(hot_links, F.broadcast(hot_sources)))
            # Every account adds a row of its own, which keeps those without
            # incoming edges and saves a join with the account table.
            inflow = messages.union(ranks.selectExpr("id", "0D AS inflow"))
            later = pinned(inflow.groupBy("id").agg(F.expr(f"{base!r}D + {damping!r}D * sum(inflow) AS rank")), "ranks")
            # The links and the broadcast ids can be made anew from the vertices.
            if table is not counted:
                table.free()
            ranks, table = later.df, later
    finally:
        links.unpersist()
        if hot_links is not None:
            hot_links.unpersist()
        kept.free()
    counted.free()
    return ranks


def _normalised(links: DataFrame, totals: DataFrame) -> DataFrame:
    """``src, dst, weight`` with the weights of each source adding up to 1."""
    return links.join(totals, "src").selectExpr("src", "dst", "weight / out_weight AS weight")


def _messages(links: DataFrame, sources: DataFrame) -> DataFrame:
    """Rank flowing along each link as ``id, inflow``."""
    return links.join(sources, "src").selectExpr("dst AS id", "rank * weight AS inflow")
