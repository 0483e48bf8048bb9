"""The jobs chained as a user would: edges to log, degrees and ranks, then the rest."""

import json
from pathlib import Path

import pytest
from conftest import SF_DIR, rows
from pyspark.errors import AnalysisException

from accountgraph.operators import clustering, generate, graph, pagerank, visits
from accountgraph.plans import jobs
from accountgraph.sinks.files import write_text
from accountgraph.sources import tables
from accountgraph.sources import text as source


def contents(folder):
    return sorted(line for part in Path(folder).glob("part-*") for line in part.read_text().splitlines())


def test_chain(spark, tmp_path):
    at = lambda name: f"{tmp_path}/{name}"
    edges = tables.edges(spark, SF_DIR)
    write_text(edges, at("edges"))

    jobs.line_count(spark, at("edges"), at("lines"))
    assert contents(at("lines")) == [str(edges.count())]
    with pytest.raises(AnalysisException):
        jobs.line_count(spark, at("edges"), at("lines"))

    expected = sum(f"{src} {dst}".count("11") for src, dst in rows(edges))
    for _ in range(2):
        jobs.grep(spark, at("edges"), "11", at("grep"))
    assert contents(at("grep")) == [str(expected)]
    jobs.grep(spark, at("edges"), "11", at("grep-json"), output_format="json")
    assert [json.loads(line) for line in contents(at("grep-json"))] == [{"n": expected}]

    jobs.neighbour_sums(spark, at("edges"), at("sums"))
    assert contents(at("sums")) == sorted(f"{i} {n}" for i, n in rows(graph.neighbour_id_sum(edges)))

    jobs.degree_files(spark, at("edges"), at("degrees"), at("followers"), at("pursuers"))
    degrees = rows(graph.degree_table(edges))
    assert contents(at("degrees")) == sorted(f"{i} {f} {p}" for i, f, p in degrees)
    assert contents(at("followers")) == sorted(f"{i} {f}" for i, f, _ in degrees)
    assert contents(at("pursuers")) == sorted(f"{i} {p}" for i, _, p in degrees)

    jobs.visit_log(spark, at("edges"), at("log"), seed=5)
    log = generate.generate_visits(graph.account_ids(edges), 5)
    assert contents(at("log")) == sorted(f"{a} {i} {t}" for a, i, t in rows(log))

    jobs.page_ranks(spark, at("edges"), 2, 0.85, at("ranks"))
    ranks = dict(rows(source.parse_ranks(source.read_lines(spark, at("ranks")))))
    direct = dict(rows(pagerank.pagerank(edges, 2, 0.85)))
    assert ranks == pytest.approx(direct)

    jobs.top_visitor_rank(spark, at("ranks"), at("log"), at("average"))
    found = json.loads(contents(at("average"))[0])["avg_page_rank"]
    table = source.parse_ranks(source.read_lines(spark, at("ranks")))
    assert found == pytest.approx(rows(visits.top_visitor_avg_rank(table, log))[0][0])

    Path(at("start.txt")).write_text("0 0 0\n1 4.5 30\n2 5 20\n")
    jobs.lloyd_kmeans(spark, at("degrees"), at("start.txt"), at("kmeans"), iterations=2)
    start = source.parse_centroids(source.read_lines(spark, at("start.txt")))
    result = clustering.lloyd(source.as_points(graph.degree_table(edges)), start, 2)
    assert contents(at("kmeans_centroids")) == sorted(f"{c} {x} {y}" for c, x, y in rows(result.centroids))
    labelled = rows(result.labelled, "cid", "x", "y")
    assert contents(at("kmeans_points")) == sorted(f"{c} {x} {y}" for c, x, y in labelled)

    result = jobs.random_kmeans(spark, at("degrees"), 3, at("clusters"), seed=1)
    assert contents(at("clusters")) == sorted(str(r.cluster) for r in result.labelled.collect())
    assert result.centres.count() == 3


def test_empty_arguments(spark, tmp_path):
    with pytest.raises(ValueError):
        jobs.grep(spark, "in", "", "out")
    with pytest.raises(ValueError):
        jobs.grep(spark, "in", "a", "")
    with pytest.raises(ValueError):
        jobs.lloyd_kmeans(spark, "", "centroids", "out")
    with pytest.raises(ValueError):
        jobs.lloyd_kmeans(spark, "points", "", "out")
    with pytest.raises(ValueError):
        jobs.page_ranks(spark, "in", 1, 0.5, "")
    with pytest.raises(ValueError):
        jobs.grep(spark, "in", "a", "out", output_format="xml")
