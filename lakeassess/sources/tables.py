"""Reading input tables."""

from __future__ import annotations

import csv
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ROW_ID
from .columns import clean_names, with_clean_names
from .records import opens, records

SAMPLES_START_ROW = 2
MACROPHYTE_START_ROW = 1


def read_table(
    spark: SparkSession, path: str, start_row: int = 1, file_format: str | None = None
) -> DataFrame:
    """Read CSV, parquet, ORC or JSON with clean column names and a ``row_id``.

    ``start_row`` is the line holding the header, for CSV files with title lines
    above it. CSV cells stay text: the assessment turns them into numbers.
    """
    kind = file_format or _format_of(path)
    if kind == "csv":
        table = _read_csv(spark, path, start_row)
    else:
        table = with_clean_names(spark.read.format(kind).load(path))
    return with_row_id(table)


def with_row_id(df: DataFrame) -> DataFrame:
    """Number rows in input order without gathering them.

    Ids rise along each file. An existing ``row_id`` is kept. The numbering
    depends on how files are split, so write the table once and read it back
    before using it in several jobs.
    """
    if ROW_ID in df.columns:
        return df
    return df.select(F.monotonically_increasing_id().alias(ROW_ID), "*")


def _format_of(path: str) -> str:
    name = path.rstrip("/").lower().removesuffix(".gz")
    for ending, kind in ((".csv", "csv"), (".txt", "csv"), (".json", "json"), (".orc", "orc")):
        if name.endswith(ending):
            return kind
    return "parquet"


def _read_csv(spark: SparkSession, path: str, start_row: int) -> DataFrame:
    """Rows below the header of every file, found by position.

    The header is the first filled record at or after line ``start_row``; it and the
    lines above it are left out of each file, whatever they hold. Files stay
    splittable and are read in parallel. One aggregate over all files finds where
    each begins and whether quoted cells run over several lines, one more job
    fetches the first lines: the number of jobs does not depend on the number of
    files. Columns are matched by name; files with other names raise.
    """
    text = spark.read.text(path)
    lines = text.select(
        "value",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias(ROW_ID),
    )
    at_start = F.when(F.col("__block") == 0, F.col(ROW_ID))
    # One row per file, and the driver holds the list of files to read them at all.
    found = lines.groupBy("__file").agg(F.min(at_start).alias("__first"), F.bool_or(opens(F.col("value"))).alias("__spans")).collect()
    found = {r["__file"]: r for r in found}
    files, listed = sorted(found), {_one_slash(file) for file in found}
    if empty := sorted(file for file in text.inputFiles() if _one_slash(file) not in listed):
        raise ValueError(f"{empty[0]}: no header at or after line {start_row}")
    headers = _headers(lines, {file: r["__first"] for file, r in found.items()}, start_row)
    layouts: dict[tuple[str, ...], int] = {}
    for file in files:
        names = headers[file][1]
        layouts.setdefault(names, len(layouts))
        if sorted(names) != sorted(next(iter(layouts))):
            raise ValueError(f"{file}: other columns than in {files[0]}")
    about = spark.createDataFrame(
        [
            (file, number, found[file]["__first"], headers[file][0], layouts[headers[file][1]], found[file]["__spans"])
            for number, file in enumerate(files)
        ],
        "__file string, __number int, __first bigint, __skipped bigint, __layout int, __spans boolean",
    )
    below = (F.col("__block") > 0) | (F.col(ROW_ID) - F.col("__first") >= F.col("__skipped"))
    rows = lines.join(F.broadcast(about), "__file").where(below)
    rows = rows.select("value", F.col("__number").alias("__file"), "__block", ROW_ID, "__layout", "__spans")
    spans = {r["__spans"] for r in found.values()}
    if spans == {True}:
        rows = records(rows)
    elif spans == {True, False}:
        rows = rows.where(~F.col("__spans")).unionByName(records(rows.where("__spans")))
    width = len(files and next(iter(layouts)))
    cells = F.from_csv("value", F.lit(", ".join(f"c{i} string" for i in range(width))), {"escape": '"'})
    rows = rows.where(F.trim("value") != "").withColumn("__cells", cells)

    def cell(name: str):
        found = F.lit(None).cast("string")
        for names, number in layouts.items():
            here = F.col(f"__cells.c{names.index(name)}")
            found = here if len(layouts) == 1 else F.when(F.col("__layout") == number, here).otherwise(found)
        return found.alias(name)

    return rows.select(ROW_ID, *[cell(name) for name in next(iter(layouts))])


def _one_slash(file: str) -> str:
    """A path as it is written by any file system: ``file:///a`` and ``file:/a`` are one."""
    return re.sub("^([A-Za-z0-9+.-]+):/+", r"\1:/", file)


def _headers(lines: DataFrame, first: dict[str, int], start_row: int) -> dict[str, tuple[int, tuple[str, ...]]]:
    """Of every file, the lines down to the end of its header and the clean names."""
    spark, wanted, headers = lines.sparkSession, start_row + 10, {}
    while missing := [file for file in first if file not in headers]:
        asked = spark.createDataFrame([(file, first[file]) for file in missing], "__file string, __first bigint")
        number = F.col(ROW_ID) - F.col("__first")
        top = lines.where("__block = 0").join(F.broadcast(asked), "__file").where(number < wanted)
        tops: dict[str, list] = {file: [] for file in missing}
        for row in top.select("__file", number.alias("n"), "value").collect():
            tops[row["__file"]].append((row["n"], row["value"]))
        for file, own in tops.items():
            own = [value for _, value in sorted(own)]
            header = _header(own, start_row)
            # A header that ends with the lines at hand may go on behind them.
            if header and (header[0] < wanted or len(own) < wanted):
                headers[file] = header
            elif len(own) < wanted:
                raise ValueError(f"{file}: no header at or after line {start_row}")
        wanted *= 4
    return headers


def _header(lines: list[str], start_row: int) -> tuple[int, tuple[str, ...]] | None:
    for number, line in enumerate(lines):
        if number >= start_row - 1 and line.strip(", "):
            reader = csv.reader(line + "\n" for line in lines[number:])
            names = next(reader)
            return number + reader.line_num, tuple(clean_names(names))
    return None


def read_stations(spark: SparkSession, path: str, file_format: str | None = None) -> DataFrame:
    """Station table: site code and water body."""
    kind = file_format or _format_of(path)
    options = {"header": True} if kind == "csv" else {}
    return spark.read.format(kind).options(**options).load(path).select("StationCode", "AUID")


def read_standards(spark: SparkSession, path: str, file_format: str | None = None) -> DataFrame:
    """Table of fixed standards with the columns the checks use."""
    kind = file_format or _format_of(path)
    options = {"header": True} if kind == "csv" else {}
    return (
        spark.read.format(kind)
        .options(**options)
        .load(path)
        .select(
            "Analyte",
            "sample_fraction",
            "acute_standard",
            "acute_units",
            "chronic_standard",
            "chronic_units",
        )
    )
