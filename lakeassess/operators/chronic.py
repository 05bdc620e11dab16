"""Chronic standards and exceedance events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.groups import GroupSpec, HotSites, day_position, find_hot_sites, group_window
from ..functions.missing import divide, if_else, matching_join, numeric, reported, round_even
from ..params import HARDNESS_STANDARDS, HardnessStandard
from ..sources.storage import keep
from .dependent import hardness_standard
from .events import EventColumns, span_totals
from .standards import only_listed_analytes, with_numbers

MIN_VISITS = 3
SHALLOW_DEPTH = 2
NO_FRACTION = "NA_"

VISIT_COLUMNS = ["AUID", "start_date", "sample_depth"]


def depth_class(depth: Column, include_limit: bool) -> Column:
    """Shallow / Deep, NULL for a missing depth."""
    shallow = depth <= SHALLOW_DEPTH if include_limit else depth < SHALLOW_DEPTH
    return if_else(shallow, F.lit("Shallow"), F.lit("Deep"))


def with_chronic_standards(
    data: DataFrame, standards: DataFrame, hardness: Sequence[HardnessStandard] = HARDNESS_STANDARDS
) -> DataFrame:
    """Attach the chronic standard that applies to each row, and the quotient.

    A tabular standard of the analyte wins over the hardness-dependent one. It
    applies when the row's fraction contains the standard's fraction (a regular
    expression), when the standard names none, or when the row has none. Several
    applicable standards give several rows. Fractions and patterns repeat, so each
    pair is decided once, in a table of distinct pairs, and looked up by equality.
    """
    table = standards.select(
        F.col("Analyte").alias("__analyte"),
        F.coalesce("sample_fraction", F.lit(NO_FRACTION)).alias("standards_fraction"),
        numeric(standards, "chronic_standard").alias("chronic_standard"),
        reported(standards, "chronic_standard").alias("__given"),
        "chronic_units",
        # A plain word is searched as text: no pattern is compiled per row.
        F.coalesce(F.col("sample_fraction").rlike(r"^[\w ,-]*$"), F.lit(True)).alias("__plain"),
    )
    fraction, wanted = F.col("sample_fraction"), F.coalesce(F.col("standards_fraction"), F.lit(NO_FRACTION))
    patterns = table.where(~F.col("__plain")).select("__analyte", F.col("standards_fraction").alias("__pattern")).distinct()
    # A look at the standards alone tells whether there is anything to decide.
    some = not patterns.isEmpty()
    found = F.when(F.coalesce("__plain", F.lit(True)), fraction.contains(wanted))
    if some:
        found = found.when(fraction.isNotNull(), F.coalesce("__found", F.lit(False)))
    match, given = F.col("fraction_match"), F.coalesce("__given", F.lit(False))
    by_hardness = F.col("hd_chronic_standard").isNotNull()
    applies = (
        match.isNull()
        | (match == "YES")
        | ((match == "NO") & (F.col("standards_fraction") == NO_FRACTION))
    )
    metals = tuple(s.analyte for s in hardness)
    rows = (
        with_numbers(only_listed_analytes(data, standards, metals))
        .withColumn("hd_chronic_standard", hardness_standard("chronic", hardness))
        .join(table, F.col("analyte").eqNullSafe(F.col("__analyte")), "left")
        .withColumn("standards_fraction", wanted)
    )
    if some:
        rows = rows.join(_decided(data, patterns), ["analyte", "sample_fraction", "standards_fraction"], "left")
    return (
        rows
        .withColumn("fraction_match", if_else(found, F.lit("YES"), F.lit("NO")))
        .where(by_hardness | (given & applies))
        .withColumn(
            "chronic_standard",
            F.when(by_hardness & ~given, F.col("hd_chronic_standard")).otherwise(F.col("chronic_standard")),
        )
        .withColumn("quotient", divide(F.col("result_value"), F.col("chronic_standard")))
        .drop("__analyte", "__given", "__plain", "__found")
    )


def _decided(data: DataFrame, patterns: DataFrame) -> DataFrame:
    """(analyte, sample_fraction, standards_fraction, __found) of all pairs that occur."""
    seen = data.select("analyte", "sample_fraction").distinct()
    pairs = seen.join(patterns, F.col("analyte") == F.col("__analyte"))
    pattern = F.col("__pattern")
    return pairs.select("analyte", "sample_fraction", pattern.alias("standards_fraction"), F.rlike("sample_fraction", pattern).alias("__found"))


def undersampled_series(data: DataFrame, series: list[str]) -> DataFrame:
    """Series (``series`` plus depth class) with fewer than three distinct visits.

    Repeats are removed by a map-side combined aggregate on series and visit
    together, so a huge series is counted by many tasks.
    """
    classed = data.withColumn("depth_narrative", depth_class(F.col("sample_depth"), include_limit=True))
    keys = [*series, "depth_narrative"]
    return (
        classed.select(*keys, *VISIT_COLUMNS)
        .distinct()
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("times_sampled"))
        .where(F.col("times_sampled") < MIN_VISITS)
    )


SERIES = ["mlid", "analyte", "sample_fraction"]

CHRONIC = EventColumns("quotient", "chronic", "standard_violation", 4.0)


def chronic_events(
    data: DataFrame,
    standards: DataFrame,
    thermoclines: DataFrame,
    hardness: Sequence[HardnessStandard] = HARDNESS_STANDARDS,
    hot_sites: HotSites | None = None,
    min_days: float = CHRONIC.min_days,
) -> DataFrame:
    """Chronic exceedance events above the thermocline.

    Two depth classes are used on purpose: coverage counts raw depth up to 2 as
    shallow, the series splits at rounded depth below 2.
    """
    hot = hot_sites or find_hot_sites(data)
    events = EventColumns(CHRONIC.quotient, CHRONIC.prefix, CHRONIC.violation, min_days)
    # Written once: coverage and series both start from it.
    checked = keep(with_chronic_standards(data, standards, hardness), "chronic-checked")

    sparse = undersampled_series(checked, SERIES).drop("times_sampled")
    coverage_class = checked.withColumn(
        "depth_narrative", depth_class(F.col("sample_depth"), include_limit=True)
    )
    covered = matching_join(coverage_class, sparse, [*SERIES, "depth_narrative"], "left_anti")

    below = F.coalesce(F.col("sample_depth") >= F.col("__thermocline"), F.lit(False))
    above = (
        covered.where(~F.col("result_unit").contains("kg"))
        .join(thermoclines.withColumnRenamed("thermocline_depth", "__thermocline"), ["mlid", "start_date"], "left")
        .where(~below)
        .drop("__thermocline")
        .withColumn("thermocline_depth", F.lit(None).cast("double"))
        .withColumn("numeric_date", F.unix_date("start_date").cast("double"))
        .withColumn("sample_depth", round_even(F.col("sample_depth")))
        .withColumn("depth_narrative", depth_class(F.col("sample_depth"), include_limit=False))
    )
    spec = GroupSpec(
        keys=["mlid", "analyte", "depth_narrative", "sample_fraction"],
        # The last two settle the order of one sample's several standards.
        order=["start_date", "row_id", "chronic_standard", "standards_fraction"],
        position=day_position(),
        previous=("numeric_date", "quotient"),
        following=("numeric_date", "quotient"),
        totals={**events.totals(), **span_totals()},
    )
    names = [
        "row_id",
        *[c for c in data.columns if c != "row_id"],
        "hd_chronic_standard",
        "standards_fraction",
        "chronic_standard",
        "chronic_units",
        "fraction_match",
        "quotient",
        "thermocline_depth",
        "numeric_date",
        "depth_narrative",
    ]
    return group_window(above, spec, hot).select(
        *names, *[c.alias(n) for n, c in events.columns().items()]
    )
