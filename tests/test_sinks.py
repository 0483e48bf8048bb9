import json
from pathlib import Path

import pytest
from conftest import planned, rows
from pyspark.errors import AnalysisException

from accountgraph.sinks import files
from accountgraph.sources.text import parse_edges, read_lines


def contents(folder):
    return sorted(line for part in Path(folder).glob("part-*") for line in part.read_text().splitlines())


@pytest.fixture
def table(spark):
    return spark.createDataFrame([(1, 0.5), (2, 1e-5), (3, None)], "id long, rank double").repartition(3)


def test_text_lines(table, tmp_path):
    files.write_text(table, f"{tmp_path}/out")
    assert contents(tmp_path / "out") == ["1 0.5", "2 1.0E-5", "3 null"]


def test_csv_lines(table, tmp_path):
    files.write_csv(table.dropna(), f"{tmp_path}/out")
    assert contents(tmp_path / "out") == ["1 0.5", "2 1.0E-5"]


def test_json_lines_leave_nulls_out(table, tmp_path):
    files.write_json(table, f"{tmp_path}/out")
    found = [json.loads(line) for line in contents(tmp_path / "out")]
    assert found == [{"id": 1, "rank": 0.5}, {"id": 2, "rank": 1e-5}, {"id": 3}]


@pytest.mark.parametrize("write", [files.write_text, files.write_csv, files.write_json])
def test_modes_and_single_file(spark, table, tmp_path, write):
    path = f"{tmp_path}/out"
    write(table, path)
    parts = len(list(Path(path).glob("part-*")))
    assert parts > 1
    with pytest.raises(AnalysisException):
        write(table, path)
    before = contents(path)
    write(table, path, mode="overwrite", single_file=True)
    assert len(list(Path(path).glob("part-*"))) == 1
    assert contents(path) == before
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_round_trip(spark, edges, tmp_path):
    files.write_text(edges, f"{tmp_path}/edges")
    assert rows(parse_edges(read_lines(spark, f"{tmp_path}/edges"))) == rows(edges)


def test_single_file_holds_for_any_size(spark, tmp_path):
    table = spark.range(0, 1_000_001, 1, 4)
    files.write_text(table, f"{tmp_path}/out", single_file=True)
    # In the order of the partitions, checksums included.
    assert [r.value for r in read_lines(spark, f"{tmp_path}/out").limit(3).collect()] == ["0", "1", "2"]
    assert read_lines(spark, f"{tmp_path}/out").count() == 1_000_001
    parts = list((tmp_path / "out").glob("part-*"))
    assert len(parts) == 1
    with parts[0].open() as lines:
        assert sum(1 for _ in lines) == 1_000_001


@pytest.mark.parametrize("write", [files.write_text, files.write_csv, files.write_json])
def test_a_single_file_is_written_by_many_tasks(spark, tmp_path, monkeypatch, write):
    written = []
    inner = files._written
    monkeypatch.setattr(files, "_written", lambda df, path, mode, single, w: inner(df, path, mode, single, lambda writer: written.append(planned(writer._df)) or w(writer)))
    empty = spark.range(0, 6, 1, 6).where("id IN (1, 4)")
    write(empty, f"{tmp_path}/out", single_file=True)
    assert written and "Exchange" not in written[0]
    assert [len(list((tmp_path / "out").glob(g))) for g in ("part-*", ".part-*")] == [1, 0]
    assert len(contents(tmp_path / "out")) == 2
    write(empty.where("false"), f"{tmp_path}/none", single_file=True)
    assert contents(tmp_path / "none") == [] and spark.read.text(f"{tmp_path}/none").count() == 0


def test_one_task_writes_where_files_cannot_be_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "_joining", lambda spark, path: None)
    files.write_text(spark.range(0, 100, 1, 4), f"{tmp_path}/out", single_file=True)
    assert len(list((tmp_path / "out").glob("part-*"))) == 1 and len(contents(tmp_path / "out")) == 100
