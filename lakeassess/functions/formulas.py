"""Regulatory formulas as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import natural_log, no_nan


def hardness_equation(a, b, cf_base, cf_slope, hardness: Column) -> Column:
    """``exp(a + b ln H) * (cf_base - cf_slope ln H)``.

    With ``cf_slope = 0`` this is the constant conversion factor form. At zero
    hardness the log is minus infinity, so the product can be ``0 * inf``; that
    is missing, not NaN.
    """
    a, b, cf_base, cf_slope = (v if isinstance(v, Column) else F.lit(float(v)) for v in (a, b, cf_base, cf_slope))
    log_h = natural_log(hardness)
    # 0 * -inf is NaN, hence the branch: a constant factor has no slope term.
    factor = F.when(cf_slope == 0, cf_base).otherwise(cf_base - cf_slope * log_h)
    return no_nan(F.exp(a + b * log_h) * factor)


def half_of_sites(sites_with_data: Column, sites_total: Column) -> Column:
    """1 when at least half of the sites have data, else 0 (0 when none do)."""
    enough = (sites_with_data > 0) & (2 * sites_with_data >= sites_total)
    return F.when(sites_with_data.isNotNull(), F.coalesce(enough, F.lit(False)).cast("int"))


def ph_curve(low: float, high: float, transition_ph: float, ph: Column) -> Column:
    """Two logistic limbs around a transition pH."""
    ten = F.lit(10.0)
    return F.lit(low) / (F.lit(1.0) + F.pow(ten, F.lit(transition_ph) - ph)) + F.lit(high) / (
        F.lit(1.0) + F.pow(ten, ph - F.lit(transition_ph))
    )


def crossing_day(day_before: Column, q_before: Column, day: Column, q: Column) -> Column:
    """Day on which the line between two readings passes a quotient of 1.

    Two readings of one day cross on that day; the general formula would give
    the same up to rounding noise, on which later comparisons would depend. An
    infinite quotient puts the crossing at an undefined place, which is missing.
    """
    weighted = day_before * (F.lit(1.0) - q) + day * (q_before - F.lit(1.0))
    return F.when(day_before == day, day).otherwise(no_nan(F.try_divide(weighted, q_before - q)))
