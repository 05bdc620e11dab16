"""Standards that depend on hardness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formulas import hardness_equation
from ..functions.missing import divide, exceeds
from ..params import HARDNESS_STANDARDS, HardnessStandard
from .standards import filter_by_pairs, with_numbers


def hardness_standard(kind: str, standards: Sequence[HardnessStandard] = HARDNESS_STANDARDS) -> Column:
    """Acute or chronic standard of a row; NULL for other analytes or fractions.

    Reads columns ``analyte``, ``sample_fraction`` and numeric ``hardness``.
    """
    chain = F
    for standard in standards:
        curve = getattr(standard, kind)
        value = hardness_equation(curve.a, curve.b, curve.cf_base, curve.cf_slope, F.col("hardness"))
        if standard.divisor != 1.0:
            value = value / F.lit(standard.divisor)
        if kind == "chronic" and standard.chronic_cap is not None:
            cap = F.lit(standard.chronic_cap)
            value = F.when(value > cap, cap).otherwise(value)
        applies = (F.col("analyte") == standard.analyte) & (F.col("sample_fraction") == standard.fraction)
        chain = chain.when(applies, value)
    return chain.otherwise(F.lit(None).cast("double"))


def hardness_dependent(
    data: DataFrame, standards: Sequence[HardnessStandard] = HARDNESS_STANDARDS
) -> DataFrame:
    """Acute check of the hardness-dependent analytes, with the chronic standard
    alongside. Row-wise: no shuffle, and the analyte filter reaches the scan."""
    pairs = {s.analyte: s.fraction for s in standards}
    checked = (
        with_numbers(filter_by_pairs(data, "analyte", "sample_fraction", pairs))
        .withColumn("acute_standard", hardness_standard("acute", standards))
        .withColumn("chronic_standard", hardness_standard("chronic", standards))
        .withColumn("quotient", divide(F.col("result_value"), F.col("acute_standard")))
        .withColumn("standard_violation", exceeds(F.col("quotient")))
    )
    first = ["acute_standard", "result_value", "quotient", "standard_violation"]
    return checked.select(*first, *[c for c in checked.columns if c not in first])
