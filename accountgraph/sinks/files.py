"""JSON, text and delimited file sinks.

Output stays parallel by default. ``single_file=True`` leaves one part file,
for consumers that read a single one: the part files are written in parallel
and the file system strings them together in their order. Where it cannot, one
task writes all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

from accountgraph.functions.text import joined_fields

_CONCAT = "fs.capability.paths.concat"


def _joining(spark: SparkSession, path: str) -> tuple[JavaObject, bool] | None:
    """A file system that can string files of ``path`` together, and whether it adds to the first one; None without it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.getScheme() == "file":
        # A machine's own disk can, below the layer that keeps checksums, but into a new file.
        return system.getRawFileSystem(), False
    return (system, True) if system.hasPathCapability(where, _CONCAT) else None


def _join_parts(spark: SparkSession, system: JavaObject, adds: bool, path: str) -> None:
    """Part files of ``path`` as one, in the order of their names."""
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    found = [f for f in system.listStatus(path_of(path)) if f.getPath().getName().startswith("part-")]
    found.sort(key=lambda f: f.getPath().getName())
    for part in found:
        # The checksums of the parts hold no longer.
        system.delete(path_of(path, f".{part.getPath().getName()}.crc"), False)
    full = [f.getPath() for f in found if f.getLen() > 0] or [f.getPath() for f in found[:1]]
    if len(full) > 1:
        first, joined = full[0], full[0] if adds else path_of(path, "_joined")
        rest = full[1:] if adds else full
        sources = spark.sparkContext._gateway.new_array(path_of, len(rest))
        for i, part in enumerate(rest):
            sources[i] = part
        system.concat(joined, sources)
        if not adds:
            system.delete(first, False)
            system.rename(joined, first)
    for part in found:
        if part.getPath() != full[0]:
            system.delete(part.getPath(), False)


def _written(df: DataFrame, path: str, mode: str, single_file: bool, write: Callable[[DataFrameWriter], None]) -> None:
    joining = _joining(df.sparkSession, path) if single_file else None
    # Without it the work before the last step still stays parallel, which coalesce(1) would end.
    write((df.repartition(1) if single_file and joining is None else df).write.mode(mode))
    if joining is not None:
        _join_parts(df.sparkSession, *joining, path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists", single_file: bool = False) -> None:
    """One JSON object per line; null columns are left out of the object."""
    _written(df, path, mode, single_file, lambda w: w.json(path))


def write_text(df: DataFrame, path: str, mode: str = "errorifexists", single_file: bool = False) -> None:
    """All columns of a row as one line, separated by single spaces."""
    lines = df.select(joined_fields(*df.columns).alias("value"))
    _written(lines, path, mode, single_file, lambda w: w.text(path))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", single_file: bool = False) -> None:
    """Space-delimited rows without a header."""
    _written(df, path, mode, single_file, lambda w: w.option("sep", " ").option("lineSep", "\n").csv(path))
