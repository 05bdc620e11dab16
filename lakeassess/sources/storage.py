"""Writing results, and keeping shared intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Names of the result tables, in output order.
RESULT_TABLES = (
    "acute_results",
    "chronic_results",
    "dependent_results",
    "ammonia_nitrogen_results",
    "chronic_ammonia_nitrogen_res",
    "sulfates_results",
    "tsi_results",
)

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach: the one the cluster names.

    Only a local session without that setting gets a temporary folder.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError(f"Set {CHECKPOINT_CONF} to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="lakeassess-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


_owned: list[list[str]] = []


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


@contextmanager
def kept_tables(spark: SparkSession) -> Iterator[None]:
    """Remove every table kept inside the block when it ends."""
    _owned.append([])
    try:
        yield
    finally:
        for path in _owned.pop():
            file_system, place = _place(spark, path)
            file_system.delete(place, True)


def keep(df: DataFrame, name: str, sort_by: list[str] | None = None) -> DataFrame:
    """Write a table to the shared folder once and read it back.

    Several results start from it; a lost executor then costs a re-read, not the
    work before it. Rows are sorted within their partitions, so a later filter
    on ``sort_by`` skips most row groups. The table is removed at the end of the
    surrounding ``kept_tables`` block, or else when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    file_system, place = _place(spark, path)
    file_system.deleteOnExit(place)
    if _owned:
        _owned[-1].append(path)
    table = df.sortWithinPartitions(*sort_by) if sort_by else df
    table.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


MANIFEST = "_tables"


def write_results(results: Mapping[str, DataFrame], folder: str, mode: str = "errorifexists") -> list[str]:
    """Write result tables as parquet under ``folder``, all or none; returns the paths.

    Tables are written to a folder beside it, then a manifest of their names, and the
    folder takes its place by one rename, so a run that fails leaves what was there. An
    existing ``folder`` raises, or with ``overwrite`` is replaced as a whole.
    """
    if mode not in ("errorifexists", "error", "overwrite"):
        raise ValueError(f"Unknown mode: {mode}")
    unknown = set(results) - set(RESULT_TABLES)
    if unknown:
        raise ValueError(f"Unknown result tables: {', '.join(sorted(unknown))}")
    names, folder = [name for name in RESULT_TABLES if name in results], folder.rstrip("/")
    if not names:
        return []
    spark = results[names[0]].sparkSession
    file_system, target = _place(spark, folder)
    if mode != "overwrite" and file_system.exists(target):
        raise FileExistsError(f"{folder} exists already")
    mark = uuid.uuid4().hex
    staging, former = (_place(spark, f"{folder}.{kind}-{mark}")[1] for kind in ("staging", "former"))
    try:
        for name in names:
            results[name].write.parquet(f"{folder}.staging-{mark}/{name}")
        spark.createDataFrame([(name,) for name in names], "name string").coalesce(1).write.text(f"{folder}.staging-{mark}/{MANIFEST}")
        replaced = file_system.exists(target)
        if replaced and not file_system.rename(target, former):
            raise OSError(f"{folder} cannot be replaced")
        if not file_system.rename(staging, target):
            if replaced:
                file_system.rename(former, target)
            raise OSError(f"{folder} cannot be written")
    finally:
        file_system.delete(staging, True)
    file_system.delete(former, True)
    return [f"{folder}/{name}" for name in names]


def read_results(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The published tables of a run, by its manifest; raises where there is none."""
    names = [row[0] for row in spark.read.text(f"{folder.rstrip('/')}/{MANIFEST}").collect()]
    return {name: spark.read.parquet(f"{folder.rstrip('/')}/{name}") for name in names}
