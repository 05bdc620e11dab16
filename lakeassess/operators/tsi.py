"""Trophic state: sampling requirements, index, and use support per lake and year."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.donors import fill_all_from_donors
from ..functions.formulas import half_of_sites
from ..functions.median import exact_median
from ..functions.missing import matching_join, natural_log, numeric
from ..schema import CHLOROPHYLL, LIMIT_COLUMNS, NVSS, PHOSPHORUS, SECCHI, TEMPERATURE, TSS, VSS
from ..sources.storage import keep

# Fixed values.
MONTHS = {
    4: "april",
    5: "may",
    6: "june",
    7: "july",
    8: "august",
    9: "september",
    10: "october",
}
PEAK_MONTHS = (6, 7, 8)
MIN_MONTHS = 4
MIN_PEAK_MONTHS = 2
MIN_PARAMETERS = 2
INCHES_PER_METER = 39.3700787
SUPPORT_LIMIT = 75
PARAMETER_ANALYTES = (PHOSPHORUS, NVSS, CHLOROPHYLL)
#: Analytes whose samples the index reads, thermoclines included.
INPUT_ANALYTES = (PHOSPHORUS, TSS, VSS, CHLOROPHYLL, SECCHI, TEMPERATURE)

LAKE_YEAR = ["AUID", "collection_year"]
ANALYTE_YEAR = ["AUID", "analyte", "collection_year"]


def tsi_readings(data: DataFrame, thermoclines: DataFrame, macrophytes: DataFrame) -> DataFrame:
    """Readings that enter the index, repeats included.

    Suspended solids count only where total and volatile were both measured at
    one site, day and depth; their difference replaces both. Secchi depths go
    from inches to meters. All readings but chlorophyll must lie at or above a
    known thermocline. A visit's solids are aggregated into one record, joined to
    its readings; no window orders them.
    """
    analyte = F.col("analyte")
    relevant = data.where(
        ((analyte == PHOSPHORUS) & (F.col("sample_fraction") == "Total"))
        | analyte.isin(TSS, VSS, CHLOROPHYLL, SECCHI)
    ).where(F.col("result_value").isNotNull())
    above = F.when(
        F.col("thermocline_depth").isNotNull() & (analyte != CHLOROPHYLL),
        F.col("sample_depth") <= F.col("thermocline_depth"),
    ).otherwise(True)
    readings = (
        matching_join(relevant, macrophytes, ["AUID", "start_date"], "left")
        .join(thermoclines, ["mlid", "start_date"], "left")
        .where(above)
        .withColumn("result_value", numeric(data, "result_value"))
    )
    solids = analyte.isin(TSS, VSS)
    filled = fill_all_from_donors(
        readings,
        ["mlid", "start_date", "sample_depth"],
        {name: F.when(analyte == of, F.col("result_value")) for name, of in (("TSS", TSS), ("VSS", VSS))},
        marks={"__tss": analyte == TSS, "__vss": analyte == VSS},
        donating=solids,
    )
    paired = F.coalesce(F.col("__tss") & F.col("__vss"), F.lit(False))
    difference = F.col("TSS") - F.col("VSS")
    values = {
        "TSS": F.when(paired, F.col("TSS")),
        "VSS": F.when(paired, F.col("VSS")),
        "NVSS": F.when(difference < 0, 0.0).otherwise(difference),
        "analyte": F.when(solids, F.lit(NVSS)).otherwise(analyte),
    }
    converted = F.when(analyte == NVSS, F.col("NVSS")).when(
        analyte == SECCHI, F.col("result_value") / F.lit(INCHES_PER_METER)
    ).otherwise(F.col("result_value"))
    names = [c for c in data.columns if c not in ("row_id", "qualifiers", "data_usability", *LIMIT_COLUMNS)]
    rows = filled.where(~solids | paired)
    for name, value in values.items():
        rows = rows.withColumn(name, value)
    return rows.withColumn("result_value", converted).select(*names, "coverage", "thermocline_depth", "TSS", "VSS", "NVSS")


def tsi_samples(data: DataFrame, thermoclines: DataFrame, macrophytes: DataFrame) -> DataFrame:
    """Readings that enter the index, one row per distinct reading."""
    return tsi_readings(data, thermoclines, macrophytes).distinct()


def site_requirements(samples: DataFrame) -> DataFrame:
    """Coverage of each lake, analyte and year. Repeated readings change nothing.

    Each site's sampled months become bits of one number, so all distinct counts
    of months and of sites per month come from two aggregates with map-side
    combine instead of one pass per count. Bit 0 stands for a missing month.
    """
    month = F.coalesce("collection_month", F.lit(0))
    per_site = samples.groupBy(*ANALYTE_YEAR, "mlid").agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1), month)).alias("__months")
    )

    def has(month_number: int) -> Column:
        return F.col("__months").bitwiseAND(F.lit(1 << month_number)) != 0

    counts = per_site.groupBy(*ANALYTE_YEAR).agg(
        F.count(F.lit(1)).cast("int").alias("n_sites"),
        F.bit_or("__months").alias("__months"),
        *[F.count_if(has(m)).cast("int").alias(f"n_sites_{name}") for m, name in MONTHS.items()],
    )
    peak_bits = reduce(lambda bits, m: bits | 1 << m, PEAK_MONTHS, 0)
    # A year without dates has no month to tell sites apart by: each month then
    # counts one unknown site.
    undated = F.col("collection_year").isNull()
    counts = counts.withColumns(
        {
            **{f"n_sites_{name}": F.when(undated, 1).otherwise(F.col(f"n_sites_{name}")) for name in MONTHS.values()},
            "n_collection_months": F.bit_count("__months"),
            "n_peak_season_months": F.bit_count(F.col("__months").bitwiseAND(F.lit(peak_bits))),
        }
    )
    counts = counts.withColumns(
        {
            **{f"use_{name}": half_of_sites(F.col(f"n_sites_{name}"), F.col("n_sites")) for name in MONTHS.values()},
            "use_peak_season": _yes_no(F.col("n_peak_season_months") >= MIN_PEAK_MONTHS),
        }
    )
    usable_months = reduce(lambda a, b: a + b, [F.col(f"use_{name}") for name in MONTHS.values()])
    counts = counts.withColumn("n_use_months", usable_months).withColumn(
        "use_n_months", _yes_no(F.col("n_use_months") >= MIN_MONTHS)
    )
    peak, months = F.col("use_peak_season") == "yes", F.col("use_n_months") == "yes"
    verdict = (
        F.when(peak & months, "met")
        .when(peak, "unmet; < 4 months available")
        .when(months, "unmet; < 2 months peak season")
        .otherwise("unmet; < 4 months available; < 2 months peak season")
    )
    return drop_work_columns(counts.withColumn("min_site_reqs", verdict)).drop("__months")


def _yes_no(test: Column) -> Column:
    return F.when(test, F.lit("yes")).otherwise(F.lit("no"))


def drop_work_columns(df: DataFrame) -> DataFrame:
    """Drop the per-month flags and the site counts."""
    pattern = re.compile(r"^use_[A-Za-z]+$|n_sites")
    return df.drop(*[c for c in df.columns if pattern.search(c)])


def parameter_requirements(sites: DataFrame) -> DataFrame:
    """Whether enough parameters met the site requirements in a lake and year;
    NULL for rows that cannot count towards it. ``sites`` has one row per lake,
    analyte and year, so the window holds a handful of rows."""
    counts = (F.col("min_site_reqs") == "met") & F.col("analyte").isin(*PARAMETER_ANALYTES)
    parameters = F.count_if(counts).over(Window.partitionBy(*LAKE_YEAR))
    return sites.withColumn("use_param", F.when(counts, _yes_no(parameters >= MIN_PARAMETERS)))


def tsi_requirements(data: DataFrame, thermoclines: DataFrame, macrophytes: DataFrame) -> DataFrame:
    """Samples of the index with the requirement verdicts on every row.

    The samples are written once: counts and rows both start from them.
    """
    samples = keep(tsi_samples(data, thermoclines, macrophytes), "tsi-samples").withColumns(
        {"collection_month": F.month("start_date"), "collection_year": F.year("start_date")}
    )
    verdicts = parameter_requirements(site_requirements(samples))
    return matching_join(samples, verdicts, ANALYTE_YEAR, "left")


def analyte_year_values(requirements: DataFrame) -> DataFrame:
    """Median result and mean coverage of each lake, analyte and year that met
    the site requirements; NULL when any value of the group is missing."""
    coverage = numeric(requirements, "coverage")
    values = requirements.where(F.col("min_site_reqs") == "met").select(
        *ANALYTE_YEAR, numeric(requirements, "result_value").alias("result_value"), coverage.alias("coverage")
    )
    extras = {
        "__rows": F.count(F.lit(1)),
        "__results": F.count("result_value"),
        "__covered": F.count("coverage"),
        "__coverage": F.sum("coverage"),
    }
    rows = F.col("__rows")
    return exact_median(values, ANALYTE_YEAR, "result_value", "__median", extras).select(
        *ANALYTE_YEAR,
        F.when(rows == F.col("__results"), F.col("__median")).alias("median_analyte"),
        F.when(rows == F.col("__covered"), F.col("__coverage") / rows).alias("mean_coverage"),
    )


# Factor, offset, and factor of the value, of each analyte's index.
INDEX_FORMULAS = {
    CHLOROPHYLL: (9.81, 30.6, 1),
    SECCHI: (-14.41, 60.0, 1),
    PHOSPHORUS: (14.42, 4.15, 1000),
}
# Points below each limit, in order; the last at or above the last limit.
SOLIDS_POINTS = ((12, 0), (15, 5), (20, 10), (None, 15))
MACROPHYTE_POINTS = ((5, 15), (10, 10), (15, 5), (40, 0), (50, 5), (70, 10), (None, 15))
INDEX_POINTS = ((60, 40), (85, 50), (90, 60), (None, 70))


def trophic_index(analyte: Column, median: Column) -> Column:
    """Index value of one analyte's median."""
    by_analyte = [
        F.when(analyte == name, F.lit(factor) * natural_log(median * scale if scale != 1 else median) + F.lit(offset))
        for name, (factor, offset, scale) in INDEX_FORMULAS.items()
    ]
    return F.coalesce(*by_analyte)


def points_for(value: Column, table: tuple) -> Column:
    """Points of the first limit above the value; NULL for a missing value."""
    steps = [F.when(value < limit, points) for limit, points in table if limit is not None]
    return F.coalesce(*steps, F.when(value.isNotNull(), table[-1][1]))


def tsi_points(values: DataFrame) -> DataFrame:
    """Points of each analyte. Input has one row per lake, analyte and year, so
    a lake-year window holds at most a handful of rows."""
    lake_year = Window.partitionBy(*LAKE_YEAR)
    analyte = F.col("analyte")
    own_solids = F.when(analyte == NVSS, points_for(F.col("median_analyte"), SOLIDS_POINTS))
    scored = (
        values.withColumn("tsi_weight", trophic_index(analyte, F.col("median_analyte")))
        .withColumn("NVSS_points", F.max(own_solids).over(lake_year))
        .withColumn("macrophyte_points", points_for(F.col("mean_coverage"), MACROPHYTE_POINTS))
        .withColumn("NVSS_usable", _yes_no(F.col("NVSS_points").isNotNull()))
        .withColumn("mac_usable", _yes_no(F.col("macrophyte_points").isNotNull()))
        .withColumn("NVSS_points", F.coalesce("NVSS_points", F.lit(0)))
        .withColumn("macrophyte_points", F.coalesce("macrophyte_points", F.lit(0)))
    )
    points = points_for(F.col("tsi_weight"), INDEX_POINTS) + F.col("NVSS_points") + F.col("macrophyte_points")
    return scored.withColumns(
        {
            f"{label}_points": F.max(F.when(analyte == name, points)).over(lake_year)
            for label, name in (("secchi", SECCHI), ("chlorophyll", CHLOROPHYLL), ("phosphorus", PHOSPHORUS))
        }
    )


def tsi_use_support(requirements: DataFrame) -> DataFrame:
    """Use support of every lake and year: the verdict two indicators share."""
    assessable = (F.col("mac_usable") == "yes") | (F.col("NVSS_usable") == "yes")

    def use(points: str) -> Column:
        verdict = F.when(F.col(points) < SUPPORT_LIMIT, "FULLY SUPPORTING").otherwise("NOT SUPPORTING")
        return F.when(F.col(points).isNotNull() & assessable, verdict).otherwise("NOT ASSESSED")

    secchi, chlorophyll, phosphorus = (F.col(f"{p}_use") for p in ("secchi", "chlorophyll", "phosphorus"))
    shared = (
        F.when((secchi == chlorophyll) | (secchi == phosphorus), secchi)
        .when(chlorophyll == phosphorus, chlorophyll)
        .otherwise("NEEDS REVIEW")
    )
    return (
        tsi_points(analyte_year_values(requirements))
        .withColumns({f"{p}_use": use(f"{p}_points") for p in ("secchi", "chlorophyll", "phosphorus")})
        .withColumn("ALU_use", shared)
    )
