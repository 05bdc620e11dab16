import os
import sys

import pytest
from pyspark.sql import Row, SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.default.parallelism", "2")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.maxMetadataStringLength", "1000")  # whole schemas in plans
        # Compiling plans takes far longer than running them on a few rows.
        .config("spark.sql.codegen.wholeStage", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from lakeassess.plans.session import tune

    yield tune(session)
    session.stop()


@pytest.fixture()
def small_limit(spark):
    """Treat sites above three rows as too large for one task."""
    spark.conf.set("lakeassess.hotGroupRows", "3")
    yield 3
    spark.conf.unset("lakeassess.hotGroupRows")


SAMPLE_SCHEMA = (
    "row_id bigint, mlid string, start_date date, start_time int, sample_depth double, depth_unit string, "
    "analyte string, sample_fraction string, result_value double, result_unit string, qualifiers string, "
    "limit_type_1 string, limit_value_1 double, limit_unit_1 string, "
    "limit_type_2 string, limit_value_2 double, limit_unit_2 string"
)
PREPARED_SCHEMA = SAMPLE_SCHEMA + ", AUID string, data_usability string, hardness double"

DEFAULTS = {
    "mlid": "S1",
    "start_date": None,
    "start_time": 36000,
    "sample_depth": 1.0,
    "depth_unit": "m",
    "result_unit": "mg/L",
    "limit_type_1": "Method Detection Level",
    "limit_value_1": 0.02,
    "AUID": "IL_A",
    "data_usability": "Usable",
}


def make(spark, schema, rows, text_results=False):
    """DataFrame from partial rows; row ids follow the given order."""
    if text_results:
        schema = schema.replace("result_value double", "result_value string").replace(
            "hardness double", "hardness string"
        )
    names = [part.split()[0] for part in schema.split(", ")]
    data = []
    for i, row in enumerate(rows):
        full = {**DEFAULTS, "row_id": i, **row}
        data.append(tuple(full.get(n) for n in names))
    return spark.createDataFrame(data, schema)


@pytest.fixture()
def samples(spark):
    return lambda rows, **kw: make(spark, SAMPLE_SCHEMA, rows, **kw)


@pytest.fixture()
def prepared(spark):
    return lambda rows, **kw: make(spark, PREPARED_SCHEMA, rows, **kw)


@pytest.fixture()
def stations(spark):
    return spark.createDataFrame([("S1", "IL_A"), ("S2", "IL_A"), ("RHL", "IL_OTHER")], "StationCode string, AUID string")


def column(df, name, by="row_id"):
    """Values of one column in row order."""
    return [r[name] for r in df.orderBy(by).collect()]


def as_dicts(df: "list[Row]"):
    return [r.asDict() for r in df]
