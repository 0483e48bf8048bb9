"""Complete jobs: text files in, result files out.

Each job reads whitespace-separated text, runs one operator and writes its
result. Paths may be anything Spark can read or write. ``mode`` is Spark's
save mode, and ``single_file`` asks for one part file (see ``sinks.files``).
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from accountgraph.operators import clustering, generate, graph, pagerank, text, visits
from accountgraph.sinks.files import write_csv, write_json, write_text
from accountgraph.sources.text import (
    parse_centroids,
    parse_edges,
    parse_ids,
    parse_points,
    parse_ranks,
    parse_vectors,
    parse_visits,
    read_lines,
)
from accountgraph.storage import settings


def _require(**values: str) -> None:
    for name, value in values.items():
        if not value:
            raise ValueError(f"{name} is empty")


def line_count(
    spark: SparkSession, lines: str, output: str, mode: str = "errorifexists", single_file: bool = True
) -> None:
    """Number of lines as text."""
    _require(lines=lines, output=output)
    write_text(text.count_lines(read_lines(spark, lines)), output, mode, single_file)


def grep(
    spark: SparkSession,
    lines: str,
    needle: str,
    output: str,
    output_format: str = "text",
    mode: str = "overwrite",
    single_file: bool = True,
) -> None:
    """Occurrences of ``needle`` as ``text`` or ``json``."""
    _require(lines=lines, needle=needle, output=output)
    if output_format not in ("text", "json"):
        raise ValueError(f"unknown output format {output_format!r}: use 'text' or 'json'")
    write = write_json if output_format == "json" else write_text
    write(text.count_occurrences(read_lines(spark, lines), needle), output, mode, single_file)


def neighbour_sums(
    spark: SparkSession, edges: str, output: str, mode: str = "errorifexists", single_file: bool = False
) -> None:
    """``id id_sum`` as text."""
    _require(edges=edges, output=output)
    write_text(graph.neighbour_id_sum(parse_edges(read_lines(spark, edges))), output, mode, single_file)


def top_visitor_rank(
    spark: SparkSession,
    ranks: str,
    log: str,
    output: str,
    after: int = visits.PERIOD_AFTER,
    before: int = visits.PERIOD_BEFORE,
    output_format: str = "json",
    mode: str = "overwrite",
) -> None:
    """Average rank over the visits of the busiest address as ``json`` or ``text``."""
    _require(ranks=ranks, log=log, output=output)
    if output_format not in ("text", "json"):
        raise ValueError(f"unknown output format {output_format!r}: use 'text' or 'json'")
    average = visits.top_visitor_avg_rank(
        parse_ranks(read_lines(spark, ranks)), parse_visits(read_lines(spark, log)), after, before
    )
    write = write_json if output_format == "json" else write_text
    write(average, output, mode, True)


def degree_files(
    spark: SparkSession,
    edges: str,
    output: str,
    followers_output: str,
    pursuers_output: str,
    mode: str = "errorifexists",
    single_file: bool = False,
) -> None:
    """``id followers pursuers`` and its two single-count parts as text.

    The three files share one cached degree table.
    """
    _require(edges=edges, output=output, followers_output=followers_output, pursuers_output=pursuers_output)
    degrees = graph.degree_table(parse_edges(read_lines(spark, edges))).persist()
    try:
        write_text(degrees.select("id", "followers"), followers_output, mode, single_file)
        write_text(degrees.select("id", "pursuers"), pursuers_output, mode, single_file)
        write_text(degrees, output, mode, single_file)
    finally:
        degrees.unpersist()


def lloyd_kmeans(
    spark: SparkSession,
    points: str,
    centroids: str,
    output: str,
    iterations: int = 10,
    mode: str = "errorifexists",
    single_file: bool = False,
) -> None:
    """``cid x y`` of points to ``<output>_points`` and of centroids to ``<output>_centroids``."""
    _require(points=points, centroids=centroids, output=output)
    result = clustering.lloyd(
        parse_points(read_lines(spark, points)),
        parse_centroids(read_lines(spark, centroids)),
        iterations,
        merge_places=True,
    )
    write_csv(result.labelled.select("cid", "x", "y"), f"{output}_points", mode, single_file)
    write_csv(result.centroids.select("cid", "x", "y"), f"{output}_centroids", mode, single_file)


def random_kmeans(
    spark: SparkSession, points: str, k: int, output: str, seed: int, mode: str = "errorifexists"
) -> clustering.RandomStart:
    """Cluster of every line as text, all its numbers taken as coordinates.

    Returns the centres and the cost along with the labelled rows.
    """
    _require(points=points, output=output)
    result = clustering.kmeans_random(parse_vectors(read_lines(spark, points)), k, "features", seed)
    write_text(result.labelled.select("cluster"), output, mode)
    return result


def page_ranks(
    spark: SparkSession,
    edges: str,
    iterations: int,
    damping: float,
    output: str,
    init: float | str = 1.0,
    mode: str = "errorifexists",
    single_file: bool = False,
) -> None:
    """``id rank`` as text."""
    _require(edges=edges, output=output)
    ranks = pagerank.pagerank(parse_edges(read_lines(spark, edges)), iterations, damping, init)
    write_text(ranks, output, mode, single_file)


def visit_log(
    spark: SparkSession, edges: str, output: str, seed: int, mode: str = "errorifexists", single_file: bool = False
) -> None:
    """``account ip time`` as text: a synthetic log for every account of the edge file."""
    _require(edges=edges, output=output)
    ids = parse_ids(read_lines(spark, edges)).distinct()
    # An id is small but grows into several hashed rows, so partitions of ids are not merged up to the usual size.
    with settings(spark, adaptive_coalescePartitions_minPartitionSize="64k"):
        write_text(generate.generate_visits(ids, seed), output, mode, single_file)
