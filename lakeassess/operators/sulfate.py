"""Sulfate standard from hardness and chloride."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import divide, exceeds, matching_join
from ..params import SulfateBand, SulfateParams
from ..schema import CHLORIDE, SULFATE
from .standards import with_numbers

VISIT = ["mlid", "start_date"]


def sulfate_standard_value(hardness: Column, chloride: Column, params: SulfateParams) -> Column:
    """First matching rule: two linear bands, then soft water, then hard water."""
    chain = F
    for band in (params.high_chloride, params.low_chloride):
        chain = chain.when(_inside(band, hardness, chloride), _linear(band, hardness, chloride))
    soft = (hardness < params.soft_hardness) | (chloride < params.soft_chloride)
    hard = (hardness > params.hard_hardness) & (chloride >= params.hard_chloride)
    return chain.when(soft, F.lit(float(params.soft_standard))).when(hard, F.lit(float(params.hard_standard)))


def _inside(band: SulfateBand, hardness: Column, chloride: Column) -> Column:
    return hardness.between(band.hardness_from, band.hardness_to) & chloride.between(
        band.chloride_from, band.chloride_to
    )


def _linear(band: SulfateBand, hardness: Column, chloride: Column) -> Column:
    total = F.lit(float(band.intercept)) + band.hardness_slope * hardness + band.chloride_slope * chloride
    return total * F.lit(float(band.factor))


def sulfate_standards(data: DataFrame, params: SulfateParams | None = None) -> DataFrame:
    """One standard per chloride sample of each visit that can be assessed.

    A visit counts when hardness is known on all its rows, chloride was sampled,
    and no chloride or sulfate result is missing. The visit test is an
    aggregate with map-side combine, not a window over all samples.
    """
    reported = F.col("result_value").isNotNull()
    complete = F.when(F.col("analyte").isin(CHLORIDE, SULFATE), reported).when(F.col("analyte").isNotNull(), True)
    visits = (
        data.groupBy(*VISIT)
        .agg(
            F.every(F.col("hardness").isNotNull()).alias("__hardness"),
            F.some(F.coalesce(F.col("analyte") == CHLORIDE, F.lit(False))).alias("__chloride"),
            F.every(F.coalesce(complete, F.lit(False))).alias("__complete"),
        )
        .where("__hardness and __chloride and __complete")
        .select(*VISIT)
    )
    chloride = with_numbers(data.where(F.col("analyte") == CHLORIDE))
    value = sulfate_standard_value(F.col("hardness"), F.col("result_value"), params or SulfateParams())
    return matching_join(chloride, visits, VISIT, "left_semi").select(*VISIT, value.alias("acute_standard"))


def sulfate_acute(data: DataFrame, params: SulfateParams | None = None) -> DataFrame:
    """Check sulfate against every standard of its visit: one row per sulfate
    sample and chloride sample of that day, NULL standard when there is none."""
    sulfate = with_numbers(data.where(F.col("analyte") == SULFATE))
    checked = (
        matching_join(sulfate, sulfate_standards(data, params), VISIT, "left")
        .withColumn("quotient", divide(F.col("result_value"), F.col("acute_standard")))
        .withColumn("standard_violation", exceeds(F.col("quotient")))
    )
    first = ["acute_standard", "result_value", "quotient", "standard_violation"]
    return checked.select(*first, *[c for c in checked.columns if c not in first])
