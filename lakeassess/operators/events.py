"""Exceedance events in a series of quotients.

Between two readings the quotient is taken to change linearly, so an event
starts and ends where the line crosses 1. An event is measured when one reading
above 1 lies between two readings below 1; a run of readings above 1 leaves the
duration unknown, unless the whole series stays above 1 for long enough.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.formulas import crossing_day
from ..functions.groups import Total
from ..functions.missing import if_else, round_even


@dataclass(frozen=True)
class EventColumns:
    """Names of one event analysis over a quotient column.

    Neighbour columns (``previous_*``, ``following_*``) come from the series
    window; ``numeric_date`` is the day number of the reading.
    """

    quotient: str
    prefix: str
    violation: str
    min_days: float

    @property
    def all_above(self) -> str:
        return f"__{self.prefix}_all_above"

    def totals(self) -> dict[str, Total]:
        above = F.coalesce(F.col(self.quotient) > 1, F.lit(False))
        return {self.all_above: Total(F.every(above), F.every)}

    def columns(self) -> dict[str, Column]:
        """Start, end, duration and violation, in output order."""
        day, q = F.col("numeric_date"), F.col(self.quotient)
        day_before, q_before = F.col("previous_numeric_date"), F.col(f"previous_{self.quotient}")
        day_after, q_after = F.col("following_numeric_date"), F.col(f"following_{self.quotient}")

        crossed = crossing_day(day_before, q_before, day, q)
        start = F.when((q > 1) & (q_before < 1), F.when(crossed > day, day).otherwise(crossed))
        end = F.when((q < 1) & (q_before > 1), crossed)
        next_end = F.when((q_after < 1) & (q > 1), crossing_day(day, q, day_after, q_after))
        duration = round_even(F.when(next_end > start, next_end - start), 1)
        measured = if_else((q > 1) & (duration >= self.min_days), F.lit("EXCEEDANCE"), F.lit("NONE"))
        lasting = F.col(self.all_above) & (series_span() >= self.min_days)
        violation = F.coalesce(measured, F.when(lasting, F.lit("EXCEEDANCE")))
        return {
            f"{self.prefix}_start_date": start,
            f"{self.prefix}_end_date": end,
            f"{self.prefix}_event_duration": duration,
            self.violation: violation,
        }


def span_totals() -> dict[str, Total]:
    """Group totals that ``series_span`` needs."""
    return {
        "__first_day": Total(F.min("numeric_date"), F.min),
        "__last_day": Total(F.max("numeric_date"), F.max),
        "__undated": Total(F.count_if(F.col("numeric_date").isNull()), F.sum),
    }


def series_span() -> Column:
    """Days from the first to the last reading; NULL if any reading is undated."""
    return F.when(F.col("__undated") == 0, F.col("__last_day") - F.col("__first_day"))
