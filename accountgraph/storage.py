"""Shared scratch space and lineage cuts."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's ``spark.checkpoint.dir``.

    Tables and checkpoints both go there, even if another checkpoint folder was
    active before. Without the setting, a checkpoint folder that was made active
    serves, but on a cluster not one of a machine's own disk. A session inside
    one machine that names no folder at all, as in a notebook, uses a part of
    its warehouse folder, removed when the program ends.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    active = context.getCheckpointDir()
    local = context.master.startswith("local")
    if configured:
        # Spark puts the active folder below the one it was given.
        if active is None or not _bare(active).startswith(f"{_bare(configured)}/"):
            context.setCheckpointDir(configured)
        return configured
    if active is not None:
        if not local and (":" not in active or active.startswith("file:")):
            raise RuntimeError(f"the checkpoint folder {active} is on one machine: set spark.checkpoint.dir to a shared one")
        return active
    if not local:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch-{uuid.uuid4().hex}"
    atexit.register(_remove_at_exit, spark, folder)
    context.setCheckpointDir(folder)
    return folder


def _bare(path: str) -> str:
    """``path`` without scheme, host and repeated slashes at its front."""
    return "/" + path.split(":", 1)[-1].strip("/")


def _remove_at_exit(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is not None:
        remove(spark, folder)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no earlier call has handed out."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder in whatever store holds it; nothing there is no error."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Stored(NamedTuple):
    """A scratch table and where it lies."""

    df: DataFrame
    path: str

    def free(self) -> None:
        remove(self.df.sparkSession, self.path)


def stored(df: DataFrame, name: str) -> Stored:
    """``df`` written to the shared folder as a Parquet table and read back.

    Suits wide reuse: each reader scans only the columns it needs. The caller
    frees it when nothing reads it any more.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return Stored(df.sparkSession.read.schema(df.schema).parquet(path), path)


def pinned(df: DataFrame, name: str) -> Stored:
    """``df`` computed now, its lineage cut by a reliable checkpoint in a folder of its own.

    Unlike a stored table it keeps its partitioning.
    """
    context, shared = df.sparkSession.sparkContext, shared_folder(df.sparkSession)
    path = scratch_path(df.sparkSession, name)
    context.setCheckpointDir(path)
    try:
        return Stored(df.checkpoint(eager=True), path)
    finally:
        context.setCheckpointDir(shared)


def pin(df: DataFrame) -> DataFrame:
    """Compute ``df`` now and cut its lineage with a reliable checkpoint that stays as long as Spark keeps it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots as underscores, without ``spark.sql.``) for a while."""
    names = {f"spark.sql.{k.replace('_', '.')}": v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
