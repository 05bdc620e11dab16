"""Ammonia standards that depend on pH and temperature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.donors import fill_all_from_donors
from ..functions.formulas import ph_curve
from ..functions.groups import GroupSpec, HotSites, day_position, find_hot_sites, group_window
from ..functions.missing import divide, exceeds, matching_join, numeric, round_even
from ..params import AmmoniaParams, AmmoniaStage
from ..schema import AMMONIA, PH, TEMPERATURE
from .chronic import depth_class, undersampled_series
from .events import EventColumns, span_totals
from .standards import with_numbers

#: Analytes whose samples the chronic check reads, thermoclines included.
INPUT_ANALYTES = (AMMONIA, PH, TEMPERATURE)


def ammonia_acute(
    data: DataFrame, params: AmmoniaParams | None = None, hot_sites: HotSites | None = None
) -> DataFrame:
    """Acute check, with the pH measured at the same site, day and whole depth."""
    params = params or AmmoniaParams()
    measured = data.where(F.col("analyte").isin(AMMONIA, PH)).withColumns(
        {
            "hardness": numeric(data, "hardness"),
            "unrounded_depth": F.col("sample_depth"),
            "sample_depth": round_even(F.col("sample_depth")),
            "pH": F.when(F.col("analyte") == PH, numeric(data, "result_value")),
        }
    )
    spec = GroupSpec(keys=["mlid", "start_date", "sample_depth"], order=["row_id"], fill=("pH",))
    limit = F.lit(params.acute_limit)
    curve = ph_curve(params.acute_low, params.acute_high, params.acute_transition_ph, F.col("pH"))
    checked = (
        group_window(measured, spec, hot_sites or find_hot_sites(measured))
        .where(F.col("pH").isNotNull() & (F.col("analyte") == AMMONIA) & F.col("result_value").isNotNull())
        .withColumn("acute_standard", F.when(curve <= limit, curve).otherwise(limit))
        .withColumn("result_value", numeric(data, "result_value"))
        .withColumn("quotient", divide(F.col("result_value"), F.col("acute_standard")))
        .withColumn("standard_violation", exceeds(F.col("quotient")))
    )
    first = ["acute_standard", "quotient", "standard_violation"]
    return checked.select(*first, *[c for c in checked.columns if c not in first])


def chronic_standard_value(
    month: Column, temperature: Column, ph: Column, params: AmmoniaParams
) -> Column:
    """Standard by early life stage and temperature band."""
    present = F.coalesce(month.isin(*params.early_life_months), F.lit(False))

    def curve(stage: AmmoniaStage) -> Column:
        return ph_curve(stage.low, stage.high, params.transition_ph, ph)

    def warm(stage: AmmoniaStage) -> Column:
        exponent = F.lit(params.temperature_slope) * (F.lit(params.reference_temperature) - temperature)
        return curve(stage) * (F.lit(stage.multiplier) * F.pow(F.lit(10.0), exponent))

    present_cold = curve(params.present_cold) * F.lit(params.present_cold.multiplier)
    absent_cold = curve(params.absent_cold) * F.lit(
        params.absent_cold.multiplier * 10.0**params.cold_exponent
    )
    return (
        F.when(present & (temperature <= params.present_temperature), present_cold)
        .when(present & (temperature > params.present_temperature), warm(params.present_warm))
        .when(~present & (temperature <= params.absent_temperature), absent_cold)
        .when(~present & (temperature > params.absent_temperature), warm(params.absent_warm))
    )


def ammonia_chronic_standards(
    data: DataFrame,
    thermoclines: DataFrame,
    params: AmmoniaParams | None = None,
) -> DataFrame:
    """Ammonia samples above a known thermocline, with chronic and sub-chronic
    standards from that visit's pH and temperature.

    A site's depth class is left out for all three analytes when any fraction of
    its ammonia has fewer than three visits.
    """
    params = params or AmmoniaParams()
    ammonia = data.where(F.col("analyte") == AMMONIA)
    sparse = (
        undersampled_series(ammonia, ["mlid", "sample_fraction"]).select("mlid", "depth_narrative").distinct()
    )
    measured = (
        with_numbers(data.where(F.col("analyte").isin(AMMONIA, PH, TEMPERATURE)))
        .join(thermoclines, ["mlid", "start_date"], "inner")
        .where(F.col("sample_depth") < F.col("thermocline_depth"))
        .withColumn("rounded_depth", round_even(F.col("sample_depth")))
        .withColumn("depth_narrative", depth_class(F.col("sample_depth"), include_limit=True))
    )
    covered = matching_join(measured, sparse, ["mlid", "depth_narrative"], "left_anti")
    known = {name: F.when(F.col("analyte") == of, F.col("result_value")) for name, of in (("pH", PH), ("temperature", TEMPERATURE))}
    month = F.month("start_date")
    early = F.when(month.isin(*params.early_life_months), F.lit("Present")).otherwise(F.lit("Absent"))
    names = [
        "row_id",
        *[c for c in data.columns if c != "row_id"],
        "thermocline_depth",
        "rounded_depth",
        "depth_narrative",
        "pH",
        "temperature",
    ]
    return (
        fill_all_from_donors(covered, ["mlid", "start_date"], known)
        .select(*names)
        .where(F.col("analyte") == AMMONIA)
        .dropna(subset=["pH", "temperature", "result_value"])
        .withColumn("numeric_date", F.unix_date("start_date").cast("double"))
        .withColumn("numeric_month", month)
        .withColumn("early_life_present", early)
        .withColumn("standard", chronic_standard_value(month, F.col("temperature"), F.col("pH"), params))
        .withColumn("quotient_chronic", divide(F.col("result_value"), F.col("standard")))
        .withColumn("standard_subchronic", F.col("standard") * params.subchronic_factor)
        .withColumn("quotient_subchronic", divide(F.col("result_value"), F.col("standard_subchronic")))
    )


def ammonia_chronic_events(
    data: DataFrame,
    thermoclines: DataFrame,
    params: AmmoniaParams | None = None,
    hot_sites: HotSites | None = None,
) -> DataFrame:
    """Chronic and sub-chronic ammonia events by site and depth class.

    Every row is kept. ``first_exceedance`` / ``last_exceedance`` mark the first
    and last row of a series when it is above both standards there.
    """
    params = params or AmmoniaParams()
    hot = hot_sites or find_hot_sites(data)
    chronic = EventColumns("quotient_chronic", "chronic", "standard_violation", params.chronic_days)
    subchronic = EventColumns(
        "quotient_subchronic", "subchronic", "standard_violation_subchronic", params.subchronic_days
    )
    rows = ammonia_chronic_standards(data, thermoclines, params).withColumn("__row", F.lit(True))
    needed = ("numeric_date", "quotient_chronic", "quotient_subchronic", "__row")
    spec = GroupSpec(
        keys=["mlid", "depth_narrative"],
        order=["start_date", "row_id"],
        position=day_position(),
        previous=needed,
        following=needed,
        totals={**chronic.totals(), **subchronic.totals(), **span_totals()},
    )
    above_both = (F.col("quotient_chronic") > 1) & (F.col("quotient_subchronic") > 1)
    flags = {
        "first_exceedance": F.when(F.col("previous___row").isNull() & above_both, "No prior data"),
        "last_exceedance": F.when(F.col("following___row").isNull() & above_both, "No following data"),
    }
    added = {**chronic.columns(), **subchronic.columns(), **flags}
    kept = [c for c in rows.columns if c != "__row"]
    return group_window(rows, spec, hot).select(*kept, *[c.alias(n) for n, c in added.items()])
