"""Prepared samples: water body, usable rows, non-detects, hardness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import to_date_value, to_seconds_of_day
from ..functions.donors import fill_all_from_donors
from ..functions.missing import matching_join, numeric
from ..schema import ALKALINITY, PREPARED_COLUMNS, SITE_WATER_BODIES

# Qualifier codes, looked for anywhere in the text.
USABLE_CODES = ("S", "C")
CONDITIONAL_CODES = r"A|B|B1|B2|J(?!\p{Nd})|E|I|J5|J6|J7|K|L|L1|L2|M|N|TNTC|ND"
UNUSABLE_CODES = r"J1|J2|J3|J4|J9|Q|V|X|W|Y"
TRIP_PREFIX = r"(?i)Trip ID:.+\|\s*"

# The limit type that counts, and the share of it taken as result.
DETECTION_LIMIT = "Method Detection Level"
NON_DETECT_SHARE = 0.5


def water_body(site: Column, joined: Column) -> Column:
    """Water body of a site: the hand-set ones first, else the station table's."""
    by_hand = F.create_map(*[F.lit(v) for pair in SITE_WATER_BODIES.items() for v in pair])
    return F.coalesce(F.try_element_at(by_hand, site), joined)


def is_usable(qualifiers: Column) -> Column:
    return reduce(lambda a, b: a | b, [qualifiers.contains(c) for c in USABLE_CODES], qualifiers.isNull())


def data_usability(qualifiers: Column) -> Column:
    """Usable / Not Usable / Conditional Use, or NULL for an unknown code."""
    return (
        F.when(is_usable(qualifiers), "Usable")
        .when(qualifiers.rlike(UNUSABLE_CODES), "Not Usable")
        .when(qualifiers.rlike(CONDITIONAL_CODES), "Conditional Use")
    )


def keep_usable(df: DataFrame) -> DataFrame:
    """Add ``data_usability`` and drop rows that are not usable or unknown.

    What is left is either usable or conditional, so the full rule runs once
    per row, in the filter.
    """
    qualifiers = F.col("qualifiers")
    kept = df.where(data_usability(qualifiers) != "Not Usable")
    return kept.withColumn(
        "data_usability", F.when(is_usable(qualifiers), "Usable").otherwise("Conditional Use")
    )


def strip_trip_id(qualifiers: Column) -> Column:
    """Drop everything up to the last pipe after a trip number."""
    return F.when(qualifiers.contains("|"), F.regexp_replace(qualifiers, TRIP_PREFIX, "")).otherwise(qualifiers)


def with_water_body(samples: DataFrame, stations: DataFrame) -> DataFrame:
    """Look up each site. Spark broadcasts the station table if it measures small."""
    lookup = stations.select(F.col("StationCode").alias("mlid"), "AUID")
    joined = matching_join(samples, lookup, ["mlid"], "left")
    return joined.withColumn("AUID", water_body(F.col("mlid"), F.col("AUID")))


def with_non_detects(df: DataFrame) -> DataFrame:
    """A missing result flagged as not detected becomes half its detection limit."""
    dtype = df.schema["result_value"].dataType
    substitute = (numeric(df, "limit_value_1") * F.lit(NON_DETECT_SHARE)).cast(dtype)
    not_detected = (
        F.col("result_value").isNull()
        & F.col("qualifiers").contains("ND")
        & (F.col("limit_type_1") == DETECTION_LIMIT)
    )
    return df.withColumn("result_value", F.when(not_detected, substitute).otherwise(F.col("result_value")))


def _result(df: DataFrame) -> Column:
    """The result in its own type; NaN in a numeric column is missing."""
    text = isinstance(df.schema["result_value"].dataType, T.StringType)
    return F.col("result_value") if text else numeric(df, "result_value")


def usable_samples(
    samples: DataFrame, stations: DataFrame, date_formats: tuple[str, ...] = (), time_unit: str | None = None
) -> DataFrame:
    """All preparation steps except hardness: row-wise, one lookup join.

    ``date_formats`` and ``time_unit`` say how dates and times were written.
    """
    # The unit filter comes first so that it reaches the scan.
    kept = samples.where(~F.col("result_unit").endswith("/kg"))
    typed = with_water_body(kept, stations).withColumns(
        {
            "qualifiers": strip_trip_id(F.col("qualifiers")),
            "start_date": to_date_value(kept, "start_date", date_formats),
            "start_time": to_seconds_of_day(kept, "start_time", time_unit),
            "sample_depth": numeric(kept, "sample_depth"),
            "result_value": _result(kept),
            "analyte": F.upper("analyte"),
        }
    )
    return with_non_detects(keep_usable(typed))


def with_hardness(samples: DataFrame) -> DataFrame:
    """Alkalinity of the visit, spread over all samples of that site and day."""
    alkalinity = F.col("analyte") == ALKALINITY
    known = {"hardness": F.when(alkalinity, F.col("result_value"))}
    # Named on its own, the analyte reaches the scan: all other rules run over its rows only.
    donating = alkalinity & F.col("result_value").isNotNull()
    return fill_all_from_donors(samples, ["mlid", "start_date"], known, donating=donating)


def prepare_samples(
    samples: DataFrame,
    stations: DataFrame,
    date_formats: tuple[str, ...] = (),
    time_unit: str | None = None,
) -> DataFrame:
    """Samples with mapped columns -> the table every check starts from.

    ``result_value`` and ``hardness`` keep the type the results were read with;
    the checks turn text into numbers themselves, so text that is no number
    still counts as reported.
    """
    usable = usable_samples(samples, stations, date_formats, time_unit)
    return with_hardness(usable).select(*PREPARED_COLUMNS)
