from random import Random

import pytest
from conftest import rows
from pyspark.errors import PySparkException
from pyspark.sql import types as T

from accountgraph.operators import graph, visits
from accountgraph.operators.text import count_lines, count_occurrences
from accountgraph.sources import text as source


@pytest.mark.parametrize(
    "needle, expected", [("aa", 2), ("ab", 1), ("AB", 1), ("zz", 0), ("a.", 0), ("a\nb", 0), ("\\", 0)]
)
def test_occurrences_are_literal_and_do_not_overlap(lines, needle, expected):
    assert rows(count_occurrences(lines("aaaa", "abAB", ""), needle)) == [(expected,)]


def test_occurrences_of_wide_characters(lines):
    assert rows(count_occurrences(lines("größe größe", "x😀😀"), "öß")) == [(2,)]
    assert rows(count_occurrences(lines("größe größe", "x😀😀"), "😀")) == [(2,)]


def test_occurrences_against_python(lines):
    random = Random(11)
    texts = ["".join(random.choice("ab é") for _ in range(random.randrange(40))) for _ in range(300)]
    frame = lines(*texts).cache()
    for needle in ("a", "aa", "aba", "é", " b", "bé a"):
        assert rows(count_occurrences(frame, needle)) == [(sum(t.count(needle) for t in texts),)]
    frame.unpersist()


def test_occurrences_without_lines_are_zero(lines, spark):
    assert rows(count_occurrences(spark.createDataFrame([], "value string"), "a")) == [(0,)]


def test_empty_needle_is_rejected(lines):
    with pytest.raises(ValueError):
        count_occurrences(lines("a"), "")


def test_line_count(lines, spark):
    assert rows(count_lines(lines("aaaa", "abAB", ""))) == [(3,)]
    assert rows(count_lines(spark.createDataFrame([], "value string"))) == [(0,)]


def test_separators_and_surplus_fields(lines):
    parsed = source.parse_edges(lines("1 2 3", "4\t5", "6 \t  7", "  8 9  "))
    assert rows(parsed) == [(1, 2), (4, 5), (6, 7), (8, 9)]


@pytest.mark.parametrize("bad", ["x y", "7", "", "1.5 2", "1 99999999999999999999"])
def test_bad_lines_fail_or_drop(lines, spark, bad):
    both = lines("1 2", bad)
    assert rows(source.parse_edges(both, mode="drop")) == [(1, 2)]
    with pytest.raises(PySparkException, match="malformed field"):
        source.parse_edges(both).collect()
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        with pytest.raises(PySparkException, match="malformed field"):
            source.parse_edges(both).collect()
        assert rows(source.parse_edges(both, mode="drop")) == [(1, 2)]
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_nan_is_a_number(lines):
    assert source.parse_ranks(lines("5 NaN", "6 x"), mode="drop").count() == 1


def test_unknown_mode_is_rejected(lines):
    for parse in (source.parse_edges, source.parse_ids, source.parse_vectors):
        with pytest.raises(ValueError):
            parse(lines("1 2"), mode="ignore")


def test_typed_tables(lines):
    assert rows(source.parse_visits(lines("5 7 1480546801"))) == [(5, 7, 1480546801)]
    assert rows(source.parse_ranks(lines("5 1.0E-5", "6 2"))) == [(5, 1e-5), (6, 2.0)]
    assert rows(source.parse_points(lines("5 3 4"))) == [(5, 3.0, 4.0)]
    assert rows(source.parse_degrees(lines("5 3 4"))) == [(5, 3, 4)]
    assert rows(source.parse_centroids(lines("1 0.5 2"))) == [(1, 0.5, 2.0)]


def test_every_field_is_an_id(lines):
    assert rows(source.parse_ids(lines("1 2 3", "3\t4"))) == [(1,), (2,), (3,), (3,), (4,)]
    assert rows(source.parse_ids(lines("1 x 3", ""), mode="drop")) == [(1,), (3,)]
    with pytest.raises(PySparkException, match="malformed field"):
        source.parse_ids(lines("1 x 3")).collect()


def test_every_field_is_a_coordinate(lines):
    assert rows(source.parse_vectors(lines("1 2 3.5"))) == [([1.0, 2.0, 3.5],)]
    assert rows(source.parse_vectors(lines("1 2", "1 y"), mode="drop")) == [([1.0, 2.0],)]
    with pytest.raises(PySparkException, match="malformed field"):
        source.parse_vectors(lines("1 y")).collect()


def test_a_bad_line_fails_whatever_is_read_later(lines):
    with pytest.raises(PySparkException, match="malformed field"):
        graph.out_degree(source.parse_edges(lines("1 x", "2 3"))).collect()
    with pytest.raises(PySparkException, match="malformed field"):
        source.parse_edges(lines("1 x", "2 3")).count()
    with pytest.raises(PySparkException, match="malformed field"):
        visits.in_period(source.parse_visits(lines("1 x 5")), 10, 20).collect()
    with pytest.raises(PySparkException, match="malformed field"):
        source.parse_edges(lines("7 x")).where("src > 100").collect()
    assert source.parse_edges(lines("1 x", "2 3"), mode="drop").count() == 1


def test_a_line_is_split_once(lines):
    for parse in (source.parse_edges, source.parse_visits, source.parse_vectors, source.parse_ids):
        for mode in ("failfast", "drop"):
            assert parse(lines("1 2 3"), mode)._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 1


def test_fields_may_be_called_anything(lines):
    schema = T.StructType().add("value", T.LongType()).add("a.b", T.IntegerType())
    assert rows(source.parse_fields(lines("1 2"), schema)) == [(1, 2)]
