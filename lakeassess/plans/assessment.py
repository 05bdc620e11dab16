"""The full assessment: inputs to seven result tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions.groups import find_hot_sites
from ..operators.ammonia import ammonia_acute, ammonia_chronic_events
from ..operators.chronic import chronic_events
from ..operators.dependent import hardness_dependent
from ..operators.prepare import prepare_samples
from ..operators.standards import acute_single_value, override_standards
from ..operators.sulfate import sulfate_acute
from ..operators.thermocline import thermocline
from ..operators.tsi import tsi_requirements, tsi_use_support
from ..params import AssessmentParams
from ..sources.storage import keep, kept_tables, write_results


@dataclass(frozen=True)
class Inputs:
    """Tables with mapped columns. ``macrophytes`` is needed for the trophic
    state only; ``overrides`` holds edited standards."""

    samples: DataFrame
    stations: DataFrame
    standards: DataFrame
    macrophytes: DataFrame | None = None
    overrides: DataFrame | None = None


def assess(inputs: Inputs, params: AssessmentParams | None = None) -> dict[str, DataFrame]:
    """All result tables by name.

    Prepared samples and thermoclines feed every check, so both are written once
    to the shared folder. Prepared samples are sorted by analyte inside each
    file: each check reads only the row groups and columns of its analytes.
    """
    params = params or AssessmentParams()
    if params.trophic_state and inputs.macrophytes is None:
        raise ValueError("Macrophyte coverage is needed to compute the trophic state")
    standards = inputs.standards
    if inputs.overrides is not None:
        standards = override_standards(standards, inputs.overrides)

    hot = find_hot_sites(inputs.samples)
    prepared = keep(prepare_samples(inputs.samples, inputs.stations), "prepared", ["analyte"])
    thermoclines = keep(thermocline(prepared, hot), "thermocline")

    results = {
        "acute_results": acute_single_value(prepared, standards),
        "chronic_results": chronic_events(
            prepared, standards, thermoclines, params.hardness, hot, params.chronic_days
        ),
        "dependent_results": hardness_dependent(prepared, params.hardness),
        "ammonia_nitrogen_results": ammonia_acute(prepared, params.ammonia, hot),
        "chronic_ammonia_nitrogen_res": ammonia_chronic_events(prepared, thermoclines, params.ammonia, hot),
        "sulfates_results": sulfate_acute(prepared, params.sulfate),
    }
    if params.trophic_state:
        required = keep(
            tsi_requirements(prepared, thermoclines, inputs.macrophytes), "tsi-requirements"
        )
        results["tsi_results"] = tsi_use_support(required)
    return results


def run(inputs: Inputs, folder: str, params: AssessmentParams | None = None, mode: str = "errorifexists") -> list[str]:
    """Assess and write every result table under ``folder``; intermediate tables are removed."""
    with kept_tables(inputs.samples.sparkSession):
        return write_results(assess(inputs, params), folder, mode)
