"""Tables written once to the shared folder, and splitting rows by key order."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import shared_folder


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table and read it back, which cuts its lineage.

    A lost executor then costs a re-read. Joins on the result plan their own
    exchanges on both sides, which adaptive execution may split when one key is hot.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_bounds(df: DataFrame, key: str, count: int) -> list[int]:
    """Up to ``count - 1`` increasing cuts of ``key`` into ranges of about as many rows.

    Reads one column; its size depends on ``count`` only.
    """
    shares = [i / count for i in range(1, count)]
    if not shares:
        return []
    found = df.agg(F.percentile_approx(key, shares, 10 * count + 1000).alias("cuts")).head()[0]
    return sorted(set(found or []))


def range_of(key: Column, bounds: list[int]) -> Column:
    """Number of bounds at or below ``key``, by binary search; 0 for null."""
    if not bounds:
        return F.lit(0)
    cuts = F.expr("array(" + ",".join(f"{b}L" for b in bounds) + ")")
    steps, step = [], 1 << (len(bounds).bit_length() - 1)
    while step:
        steps.append(step)
        step >>= 1
    n = len(bounds)
    return F.coalesce(
        F.aggregate(
            F.array(*[F.lit(s) for s in steps]),
            F.lit(0),
            lambda at, s: F.when(
                (at + s <= n) & (F.element_at(cuts, F.least(at + s, F.lit(n))) <= key), at + s
            ).otherwise(at),
        ),
        F.lit(0),
    )


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give executors this package, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="package-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in root.rglob("*.py"):
            out.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
