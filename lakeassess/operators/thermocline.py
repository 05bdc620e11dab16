"""Depth of the thermocline on each visit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.groups import GroupSpec, HotSites, depth_position, find_hot_sites, group_window
from ..functions.missing import divide, no_nan, numeric
from ..schema import TEMPERATURE

STEEP_GRADIENT = 0.5  # degrees per unit of depth


def thermocline(data: DataFrame, hot_sites: HotSites | None = None) -> DataFrame:
    """Shallowest reading whose temperature changed steeply from the one above.

    Two readings at one depth with different temperatures count as infinitely
    steep. Visits without a steep step have no row.
    """
    readings = data.where(
        (F.col("analyte") == TEMPERATURE) & F.col("mlid").isNotNull() & F.col("start_date").isNotNull()
    )
    hot = hot_sites or find_hot_sites(readings)
    # One reading per depth and time, the first in input order.
    profile = readings.groupBy("mlid", "start_date", "sample_depth", "start_time").agg(
        F.min_by(numeric(readings, "result_value"), F.col("row_id")).alias("degrees")
    )
    spec = GroupSpec(
        keys=["mlid", "start_date"],
        order=["sample_depth", "start_time"],
        position=depth_position(),
        previous=("degrees", "sample_depth"),
    )
    gradient = divide(
        no_nan(F.col("degrees") - F.col("previous_degrees")),
        no_nan(F.col("sample_depth") - F.col("previous_sample_depth")),
    )
    return (
        group_window(profile, spec, hot)
        .where(F.abs(gradient) > STEEP_GRADIENT)
        .groupBy("mlid", "start_date")
        .agg(F.min("sample_depth").alias("thermocline_depth"))
    )
