import shutil
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def shared(tmp_path_factory):
    """The folder that stands in for a cluster's shared one."""
    folder = tmp_path_factory.mktemp("shared")
    yield folder
    shutil.rmtree(folder, ignore_errors=True)


@pytest.fixture(scope="session")
def spark(shared):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("accountgraph-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def lines(spark):
    return lambda *values: spark.createDataFrame([(v,) for v in values], "value string")


@pytest.fixture
def edges(spark):
    """The worked example: a duplicate edge, an account without followers, nothing dangling."""
    return spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 1), (3, 1), (4, 3)], "src long, dst long")


@pytest.fixture
def no_broadcasts(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def rows(df, *columns):
    """Sorted rows as tuples."""
    chosen = df.select(*columns) if columns else df
    return sorted(tuple(r) for r in chosen.collect())


def final_plan(df):
    """Physical plan after running the query, as text."""
    execution = df._jdf.queryExecution()
    execution.executedPlan().executeCollect()
    return execution.executedPlan().toString()


def planned(df):
    """Physical plan before running the query, as text."""
    return df._jdf.queryExecution().executedPlan().toString()


def files_below(folder):
    return sorted(p for p in Path(folder).rglob("*") if p.is_file())
