"""Lake input tables derived from the general test tables.

Every line item becomes one sample: its supplier is the site, its part picks the
analyte, its quantity the value, and so on. All derivations are row-wise or
plain aggregates, so they scale with the tables. The SQL in ``oracle.py`` builds
the same tables independently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Analyte, lowest value, range.
ANALYTES = [
    ("Alkalinity, total", 50.0, 500.0),
    ("pH", 6.0, 3.0),
    ("Temperature, water", 20.0, 8.0),
    ("Ammonia-nitrogen", 0.0, 6.0),
    ("Chloride", 2.0, 600.0),
    ("Sulfate", 0.0, 3000.0),
    ("Phosphorus", 0.0, 0.3),
    ("Chlorophyll a, corrected for pheophytin", 0.0, 100.0),
    ("Depth, Secchi disk depth", 2.0, 80.0),
    ("Total suspended solids", 0.0, 60.0),
    ("Volatile suspended solids", 0.0, 45.0),
    ("Cadmium", 0.0, 60.0),
    ("Copper", 0.0, 40.0),
    ("Fluoride", 0.0, 10.0),
    ("Zinc", 0.0, 300.0),
    ("Iron", 0.0, 2.0),
    ("Chromium", 0.0, 3000.0),
    ("Lead", 0.0, 300.0),
    ("Manganese", 0.0, 9000.0),
    ("Nickel", 0.0, 3000.0),
]
SECCHI_INDEX = 8
# By percent of tax and of discount.
QUALIFIERS = [None, None, None, "ND", "J", "Trip ID: 7 | J5", "Q", "S", "TNTC"]
UNITS = ["mg/L"] * 9 + [None, "mg/kg"]
DENSE_ANALYTES = ["Ammonia-nitrogen", "Ammonia-nitrogen", "pH", "Temperature, water"]

STANDARDS = [
    ("IRON", "Dissolved", 1.0, "mg/L", 0.8, "mg/L"),
    ("CHLORIDE", None, 500.0, "mg/L", 250.0, "mg/L"),
    ("COPPER", "Dissolved", None, "mg/L", 20.0, "mg/L"),
    ("FLUORIDE", "Total", 4.0, "mg/L", None, "mg/L"),
]
#: The same, with fractions given as regular expressions.
PATTERN_STANDARDS = [
    ("IRON", "Diss.+d|^Tot", 1.0, "mg/L", 0.8, "mg/L"),
    ("CHLORIDE", None, 500.0, "mg/L", 250.0, "mg/L"),
    ("COPPER", "^D[a-z]*$", None, "mg/L", 20.0, "mg/L"),
    ("FLUORIDE", "[Tt]otal$", 4.0, "mg/L", 1.5, "mg/L"),
]
STANDARDS_COLUMNS = [
    "Analyte",
    "sample_fraction",
    "acute_standard",
    "acute_units",
    "chronic_standard",
    "chronic_units",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _month() -> Column:
    return (F.lit(1) + F.expr("l_orderkey div 2") % 12).cast("int")


def _percent(name: str) -> Column:
    """A share with two decimals as a whole number of percent."""
    return (F.col(name) * 100 + 0.5).cast("int")


def _values(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    values = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(columns)})")


def _codes(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """Fixed code table of a few rows, broadcast to the samples."""
    return F.broadcast(_values(spark, columns, rows))


def _literal(value) -> str:
    if value is None:
        return "NULL"
    return f"'{value}'" if isinstance(value, str) else f"{value}D" if isinstance(value, float) else str(value)


# Suppliers that stand for sites whose water body is set by hand.
NAMED_SITES = {7: "RHL", 8: "WDW"}


def site_name(key: str = "l_suppkey") -> Column:
    named = [F.when(F.col(key) == k, name) for k, name in NAMED_SITES.items()]
    return F.coalesce(*named, F.concat(F.lit("S"), F.col(key)))


def sample_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site of every sample, read from its one column."""
    return table(spark, sf_dir, "lineitem").select(site_name().alias("mlid"))


def raw_samples(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    """Uploaded samples under their default column names.

    ``dense`` spreads all rows over ammonia, pH and temperature, which gives the
    ammonia rules enough rows per site.
    """
    tax, discount = F.col("tax_percent"), F.col("discount_percent")
    share = F.col("l_quantity") / 50.0
    depth = F.col("l_linenumber") * 0.75
    if dense:
        analytes = _codes(spark, ["kind", "analyte"], list(enumerate(DENSE_ANALYTES)))
        kind = F.col("kind")
        warm = F.lit(5.0) + 2.0 * (6 - F.abs(_month() - 7)) + 1.5 * share
        value = F.when(kind <= 1, 6.0 * share).when(kind == 2, 6.0 + 3.0 * share).otherwise(warm)
    else:
        analytes = _codes(spark, ["kind", "analyte", "low", "span"], [(i, *a) for i, a in enumerate(ANALYTES)])
        value = F.col("low") + share * F.col("span")
        depth = F.when(F.col("kind") == SECCHI_INDEX, 0.5).otherwise(depth)
    kinds = len(DENSE_ANALYTES) if dense else len(ANALYTES)
    items = (
        table(spark, sf_dir, "lineitem")
        # Left joins: a line with a code outside the tables stays, with no value for it.
        .join(analytes, F.col("l_partkey") % kinds == F.col("kind"), "left")
        .join(_codes(spark, ["tax_percent", "qualifier"], list(enumerate(QUALIFIERS))), _percent("l_tax") == tax, "left")
        .join(_codes(spark, ["discount_percent", "unit"], list(enumerate(UNITS))), _percent("l_discount") == discount, "left")
    )
    taxed = _percent("l_tax")
    unreported = ((taxed == 3) & (F.col("l_linenumber") % 2 == 1)) | ((taxed == 5) & (F.col("l_linenumber") == 7))
    no_depth = (F.col("l_linenumber") == 1) & (F.col("l_quantity") == 13)
    limit_type = F.when(F.col("l_linenumber") == 5, "Lower Reporting Limit").otherwise("Method Detection Level")
    order_line = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    within_line = (F.col("l_partkey") * 7919 + F.col("l_suppkey")) % 1048576
    return items.select(
        (order_line * 1048576 + within_line).alias("row_id"),
        site_name().alias("monitoring_location_id"),
        F.make_date(
            (2019 + F.col("l_orderkey") % 2).cast("int"), _month(), F.lit(10)
        ).alias("activity_start_date"),
        (F.col("l_orderkey") * 7 % 86400).cast("int").alias("activity_start_time"),
        F.when(~no_depth, depth).alias("activity_depth_height"),
        F.lit("m").alias("activity_depth_height_unit"),
        F.col("analyte").alias("characteristic_name"),
        F.when(F.col("l_returnflag") == "R", "Dissolved")
        .when(F.col("l_returnflag") == "A", "Total")
        .alias("sample_fraction"),
        F.when(~unreported, value).alias("result_value"),
        F.col("unit").alias("result_unit"),
        F.col("qualifier").alias("result_comment"),
        limit_type.alias("detection_limit_type_1"),
        F.lit(0.02).alias("detection_limit_value_1"),
        F.lit("mg/L").alias("detection_limit_unit_1"),
        F.lit(None).cast("string").alias("detection_limit_type_2"),
        F.lit(None).cast("double").alias("detection_limit_value_2"),
        F.lit(None).cast("string").alias("detection_limit_unit_2"),
    )


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four sites per lake."""
    return table(spark, sf_dir, "supplier").select(
        site_name("s_suppkey").alias("StationCode"),
        F.concat(F.lit("IL_L"), F.expr("s_suppkey div 4")).alias("AUID"),
    )


def standards(spark: SparkSession, rows: list = STANDARDS) -> DataFrame:
    table = _values(spark, STANDARDS_COLUMNS, rows)
    return table.withColumns({c: F.col(c).cast("double") for c in ("acute_standard", "chronic_standard")})


def raw_macrophytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly coverage per lake; every third lake lacks March, and every second
    lake's code comes without the prefix."""
    months = F.explode(F.sequence(F.lit(0), F.lit(23))).alias("month")
    return (
        table(spark, sf_dir, "supplier")
        .select(F.expr("s_suppkey div 4").alias("lake"))
        .distinct()
        .select("lake", (F.col("lake") * 52 % 80).cast("double").alias("cover"), months)
        .where(~((F.col("lake") % 3 == 0) & (F.col("month") % 12 == 2)))
        .select(
            F.concat(F.when(F.col("lake") % 2 == 0, "IL_L").otherwise("L"), F.col("lake")).alias("basin_code"),
            F.make_date(
                F.lit(2019) + F.expr("month div 12").cast("int"), F.col("month") % 12 + 1, F.lit(10)
            ).alias("collection_date"),
            F.col("cover").alias("percent_macrophyte_cover"),
        )
    )


def spreadsheet_date(date: Column) -> Column:
    """A date as a spreadsheet stores it: days since its day 0."""
    return F.datediff(date, F.lit("1899-12-30").cast("date"))


def uploads(spark: SparkSession, sf_dir: str, folder: str, names: tuple[str, ...]) -> None:
    """Inputs as CSV files, of the four those named: serial dates, times as a share of a
    day, and notes of several lines with quotes and commas."""
    raw = raw_samples(spark, sf_dir).withColumnRenamed("row_id", "Sample Key")
    notes = F.concat("monitoring_location_id", F.lit('\nas "'), "characteristic_name", F.lit('", see\n\nsheet '), F.col("Sample Key") % 7)
    raw = raw.withColumns({
        "activity_start_date": spreadsheet_date(F.col("activity_start_date")),
        "activity_start_time": F.col("activity_start_time") / 86400.0,
        "Field Notes": F.when(F.col("Sample Key") % 3 != 0, notes),
    })
    cover = raw_macrophytes(spark, sf_dir)
    cover = cover.withColumn("collection_date", spreadsheet_date(F.col("collection_date")))
    tables = {"samples": raw, "stations": stations(spark, sf_dir), "standards": standards(spark), "macrophytes": cover}
    for name in names:
        tables[name].write.options(header=True, escape='"').csv(f"{folder}/{name}")


def part_standards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A standards table that grows with the data: one row per part."""
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("PART "), F.col("p_partkey")).alias("Analyte"),
        F.when(size % 3 == 0, "Total").when(size % 3 == 1, "Dissolved").alias("sample_fraction"),
        F.when(size % 4 != 0, F.col("p_retailprice")).alias("acute_standard"),
        F.lit("mg/L").alias("acute_units"),
        F.when(size % 5 != 0, F.col("p_retailprice") / 2).alias("chronic_standard"),
        F.lit("mg/L").alias("chronic_units"),
    )


def part_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits: the highest returned and the highest accepted price of each part."""
    flag, price = F.col("l_returnflag"), F.col("l_extendedprice")
    edits = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.max(F.when((flag == "R") & (F.col("l_linenumber") == 1), price)).alias("acute_standard"),
        F.max(F.when((flag == "A") & (F.col("l_linenumber") == 2), price)).alias("chronic_standard"),
    )
    keys = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    size = F.col("p_size")
    return edits.join(keys, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat(F.lit("PART "), F.col("l_partkey")).alias("Analyte"),
        F.when(size % 3 == 0, "Total").when(size % 3 == 1, "Dissolved").alias("sample_fraction"),
        "acute_standard",
        "chronic_standard",
    )
