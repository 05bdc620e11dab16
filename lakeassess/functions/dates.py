"""Dates and times of day from spreadsheet numbers, text or typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .missing import parse_number, round_even

# Fixed value: day 0 of spreadsheet date serials.
SERIAL_EPOCH = "1899-12-30"
SECONDS_PER_DAY = 86400


def from_serial(number: Column) -> Column:
    return F.date_add(F.lit(SERIAL_EPOCH).cast("date"), F.floor(number).cast("int"))


def to_date_value(df: DataFrame, name: str, formats: tuple[str, ...] = ()) -> Column:
    """Date from a date, timestamp, spreadsheet serial, or text holding either.

    Text that is neither a serial nor an ISO date is tried in ``formats``, such as
    ``MM/dd/yyyy``, in that order.
    """
    value, dtype = F.col(name), df.schema[name].dataType
    if isinstance(dtype, T.DateType):
        return value
    if isinstance(dtype, T.StringType):
        number = parse_number(value)
        written = [F.try_to_timestamp(F.trim(value), F.lit(f)).cast("date") for f in formats]
        return F.when(number.isNotNull(), from_serial(number)).otherwise(F.coalesce(value.try_cast("date"), *written))
    if isinstance(dtype, T.NumericType):
        return from_serial(value.cast("double"))
    return value.cast("date")


def to_seconds_of_day(df: DataFrame, name: str, unit: str | None = None) -> Column:
    """Seconds since midnight as an int.

    ``unit`` says what numbers mean: ``"seconds"``, or ``"day"`` for a spreadsheet
    fraction of a day. Without it integer columns hold seconds, fractional columns
    and numeric text fractions of a day. Other text is read as a clock time.
    """
    if unit not in (None, "seconds", "day"):
        raise ValueError(f"Unknown time unit: {unit}")
    value, dtype = F.col(name), df.schema[name].dataType
    if isinstance(dtype, T.NumericType):
        seconds = unit == "seconds" or (unit is None and isinstance(dtype, T.IntegralType))
        return value.cast("int") if seconds else _fraction_seconds(value.cast("double"))
    if isinstance(dtype, T.StringType):
        number = parse_number(value)
        clock = F.concat(F.lit("1970-01-01 "), F.trim(value)).try_cast("timestamp_ntz")
        seconds = number.cast("int") if unit == "seconds" else _fraction_seconds(number)
        return F.when(number.isNotNull(), seconds).otherwise(_clock_seconds(clock))
    return _clock_seconds(value)


def _fraction_seconds(number: Column) -> Column:
    """Seconds of a share of a day; what rounds up to a whole day is midnight."""
    part = number - F.floor(number)
    return round_even(part * F.lit(float(SECONDS_PER_DAY))).cast("int") % SECONDS_PER_DAY


def _clock_seconds(moment: Column) -> Column:
    return (F.hour(moment) * 3600 + F.minute(moment) * 60 + F.second(moment)).cast("int")
