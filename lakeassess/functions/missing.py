"""Arithmetic and comparisons in which a missing value stays missing.

The assessment rules distinguish "no", "yes" and "cannot tell". These helpers
give that third state to built-in Spark expressions: nothing here raises on bad
input, and no NaN ever reaches a comparison (in Spark ``NaN > 1`` is true).
All of them are plain ``Column`` expressions and stay inside whole-stage codegen.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POSITIVE_INFINITY = float("inf")
NEGATIVE_INFINITY = float("-inf")

DECIMAL_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
HEX_TEXT = r"^[+-]?0[xX][0-9a-fA-F]+$"
INFINITE_TEXT = r"(?i)^[+-]?inf(inity)?$"


def no_nan(value: Column) -> Column:
    """NaN becomes NULL."""
    return F.nanvl(value, F.lit(None).cast("double"))


def parse_number(text: Column) -> Column:
    """Text to double; anything that is not a number becomes NULL.

    ``try_cast`` alone also accepts suffixes such as ``1d``, so the shape is
    checked first.
    """
    text = F.trim(text)
    infinite = F.when(text.startswith("-"), F.lit(NEGATIVE_INFINITY)).otherwise(F.lit(POSITIVE_INFINITY))
    return (
        F.when(text.rlike(DECIMAL_TEXT), text.try_cast("double"))
        .when(text.rlike(HEX_TEXT), _hexadecimal(text))
        .when(text.rlike(INFINITE_TEXT), infinite)
    )


def _hexadecimal(text: Column) -> Column:
    """Value of a signed hexadecimal number of any length, digit by digit."""
    digits = F.split(F.lower(F.regexp_replace(text, r"^[+-]?0[xX]", "")), "")
    value = F.aggregate(digits, F.lit(0.0), lambda sum_, d: sum_ * 16.0 + (F.instr(F.lit("0123456789abcdef"), d) - 1))
    return F.when(text.startswith("-"), -value).otherwise(value)


def numeric(df: DataFrame, name: str) -> Column:
    """Column ``name`` of ``df`` as a double, whatever type it was read with."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.StringType):
        return parse_number(F.col(name))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return no_nan(F.col(name).cast("double"))
    return F.col(name).cast("double")


def reported(df: DataFrame, name: str) -> Column:
    """True where something was reported, be it text that is no number."""
    text = isinstance(df.schema[name].dataType, T.StringType)
    return F.col(name).isNotNull() if text else numeric(df, name).isNotNull()


def if_else(condition: Column, yes, no) -> Column:
    """Two-way choice that is NULL when the condition is NULL."""
    return F.when(condition, yes).when(~condition, no)


def divide(top: Column, bottom: Column) -> Column:
    """Division where ``x/0`` is infinite and ``0/0`` is missing."""
    by_zero = F.when(top > 0, F.lit(POSITIVE_INFINITY)).when(top < 0, F.lit(NEGATIVE_INFINITY))
    return F.when(bottom == 0, by_zero).otherwise(no_nan(F.try_divide(top, bottom)))


def natural_log(value: Column) -> Column:
    """Natural log where ``ln(0)`` is minus infinity and negatives are missing."""
    return F.when(value == 0, F.lit(NEGATIVE_INFINITY)).otherwise(F.ln(value))


def round_even(value: Column, digits: int = 0) -> Column:
    """Round half to even. Infinite values pass through."""
    finite = F.abs(value) != POSITIVE_INFINITY
    return F.when(finite, F.bround(value, digits)).otherwise(value)


def exceeds(quotient: Column) -> Column:
    """EXCEEDANCE above 1, NONE at or below 1, NULL when unknown."""
    return if_else(quotient > 1, F.lit("EXCEEDANCE"), F.lit("NONE"))


def nulls_last(names: list[str]) -> list[Column]:
    return [F.col(n).asc_nulls_last() for n in names]


def same_keys(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    """Equi-join condition under which a missing key matches a missing key."""
    return reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in pairs])


def matching_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on ``keys`` present on both sides, NULL matching NULL, keys kept once.

    Catalyst plans this as an ordinary hash-partitioned equi-join (on
    ``coalesce(key)`` and ``isnull(key)``), so AQE can still split skewed
    partitions or switch to a broadcast when the right side turns out small.
    """
    renamed = {k: f"__right_{k}" for k in keys}
    right = right.withColumnsRenamed(renamed)
    joined = left.join(right, same_keys(left, right, list(renamed.items())), how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*renamed.values())
