"""Tabular standards: edits by the user, acute check, pair filter."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.missing import divide, exceeds, matching_join, numeric, reported

EDITABLE = ("acute_standard", "chronic_standard")


def override_standards(standards: DataFrame, overrides: DataFrame) -> DataFrame:
    """Replace edited values. Rows can be changed, not added or removed.

    ``overrides`` has ``Analyte``, ``sample_fraction`` and either or both of the
    editable columns, one row per edited standard; a NULL there means unedited.
    """
    edited = [c for c in EDITABLE if c in overrides.columns]
    keys = ["Analyte", "sample_fraction"]
    edits = overrides.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in edited])
    joined = matching_join(standards, edits, keys, "left")
    return joined.withColumns(
        {c: F.coalesce(F.col(f"__new_{c}").cast(standards.schema[c].dataType), F.col(c)) for c in edited}
    ).select(*standards.columns)


def only_listed_analytes(data: DataFrame, standards: DataFrame, others: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose analyte may be in the standards table or in ``others``.

    A join alone would read every analyte. With the first and last name of each
    initial in a plain filter, a scan of samples sorted by analyte skips the row
    groups between. There are at most 128 initials, whatever the table's size;
    the join then tells the names apart.
    """
    initial = F.least(F.ascii("Analyte"), F.lit(127))
    named = standards.groupBy(initial.alias("initial")).agg(
        F.min("Analyte").alias("low"), F.max("Analyte").alias("high")
    )
    analyte, found = F.col("analyte"), named.collect()
    tests = [analyte.between(r["low"], r["high"]) for r in found if r["low"] is not None]
    tests += [analyte.isin(list(others))] if others else []
    tests += [analyte.isNull()] if any(r["low"] is None for r in found) else []
    return data.where(reduce(lambda a, b: a | b, tests, F.lit(False)))


def acute_single_value(data: DataFrame, standards: DataFrame) -> DataFrame:
    """Compare results with fixed acute standards.

    A standard applies to its own fraction, or to every fraction when it names
    none. Both kinds are matched in one pass over the samples.
    """
    acute = (
        standards.where(reported(standards, "acute_standard"))
        .select(
            F.col("Analyte").alias("__analyte"),
            F.col("sample_fraction").alias("__fraction"),
            numeric(standards, "acute_standard").alias("acute_standard"),
            "acute_units",
        )
    )
    applies = F.col("analyte").eqNullSafe(F.col("__analyte")) & (
        F.col("__fraction").isNull() | (F.col("__fraction") == F.col("sample_fraction"))
    )
    quotient = divide(F.col("result_value"), F.col("acute_standard"))
    return (
        with_numbers(only_listed_analytes(data, standards))
        .join(acute, applies, "inner")
        .withColumn("quotient", quotient)
        .withColumn("standard_violation", exceeds(F.col("quotient")))
        .drop("__analyte", "__fraction")
    )


def with_numbers(data: DataFrame, names: tuple[str, ...] = ("result_value", "hardness")) -> DataFrame:
    """Result and hardness, where present, as doubles."""
    return data.withColumns({n: numeric(data, n) for n in names if n in data.columns})


def filter_by_pairs(
    df: DataFrame, column: str, match_column: str, pairs: Mapping[str, str | None]
) -> DataFrame:
    """Keep rows whose ``match_column`` is the value ``pairs`` gives for ``column``.

    Built as a predicate, so it reaches the scan. Rows with a missing value in
    either column are dropped.
    """
    for name in (column, match_column):
        if name not in df.columns:
            raise ValueError(f"Column '{name}' not found in the table")
    by_value: dict[str, list[str]] = {}
    for key, value in pairs.items():
        if value is not None:
            by_value.setdefault(value, []).append(key)
    tests = [F.col(column).isin(keys) & (F.col(match_column) == value) for value, keys in by_value.items()]
    return df.where(reduce(lambda a, b: a | b, tests, F.lit(False)))
