import pytest
from conftest import files_below, rows

from accountgraph import storage


class Context:
    def __init__(self, master, active=None):
        self.master = master
        self.active = active
        self._jsc = None

    def getCheckpointDir(self):
        return self.active

    def setCheckpointDir(self, folder):
        self.active = f"{folder}/made-up-id"


class Session:
    """Only what ``shared_folder`` asks of a session."""

    def __init__(self, master, configured=None, active=None):
        self.sparkContext = Context(master, active)
        self.conf = {"spark.checkpoint.dir": configured, "spark.sql.warehouse.dir": "file:/warehouse"}


def test_the_configured_folder_is_used():
    session = Session("yarn", configured="hdfs:///shared")
    assert storage.shared_folder(session) == "hdfs:///shared"
    assert session.sparkContext.active == "hdfs:///shared/made-up-id"


def test_the_configured_folder_wins_over_an_active_one():
    session = Session("yarn", configured="hdfs:///shared", active="hdfs:///other/abc")
    assert storage.shared_folder(session) == "hdfs:///shared"
    assert session.sparkContext.active == "hdfs:///shared/made-up-id"
    assert storage.shared_folder(session) == "hdfs:///shared"


def test_an_active_folder_is_kept():
    assert storage.shared_folder(Session("yarn", active="hdfs:///set/abc")) == "hdfs:///set/abc"


@pytest.mark.parametrize("active", [None, "/tmp/abc", "file:/tmp/abc"])
def test_a_cluster_without_a_shared_folder_is_an_error(active):
    with pytest.raises(RuntimeError):
        storage.shared_folder(Session("spark://host:7077", active=active))


def test_a_local_session_uses_its_warehouse():
    session = Session("local[2]")
    folder = storage.shared_folder(session)
    assert folder.startswith("file:/warehouse/scratch-")
    assert session.sparkContext.active.startswith(folder)


def test_scratch_paths_differ(spark):
    assert storage.scratch_path(spark, "a") != storage.scratch_path(spark, "a")
    assert storage.scratch_path(spark, "a").startswith(storage.shared_folder(spark))


@pytest.mark.parametrize("keep", [storage.stored, storage.pinned])
def test_what_is_kept_can_be_freed(spark, shared, keep):
    before = files_below(shared)
    kept = keep(spark.range(5), "five")
    assert rows(kept.df) == [(i,) for i in range(5)]
    assert len(files_below(shared)) > len(before)
    kept.free()
    assert files_below(shared) == before


def test_settings_come_back(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled", None)
    with storage.settings(spark, adaptive_enabled="false"):
        assert spark.conf.get("spark.sql.adaptive.enabled") == "false"
    assert spark.conf.get("spark.sql.adaptive.enabled", None) == before
