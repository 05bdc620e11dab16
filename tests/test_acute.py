import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from conftest import column
from lakeassess.operators.ammonia import ammonia_acute
from lakeassess.operators.dependent import hardness_dependent
from lakeassess.operators.standards import acute_single_value, filter_by_pairs, override_standards
from lakeassess.operators.sulfate import sulfate_acute, sulfate_standards
from lakeassess.operators.summary import exceedance_summary, preview
from lakeassess.params import HARDNESS_STANDARDS, SulfateBand, SulfateParams

DAY = date(2020, 6, 1)
STANDARDS = (
    "Analyte string, sample_fraction string, acute_standard double, acute_units string, "
    "chronic_standard double, chronic_units string"
)


@pytest.fixture()
def standards(spark):
    return spark.createDataFrame(
        [
            ("IRON", "Dissolved", 1.0, "mg/L", 0.8, "mg/L"),
            ("CHLORIDE", None, 500.0, "mg/L", 250.0, "mg/L"),
            ("COPPER", "Dissolved", None, "mg/L", 20.0, "mg/L"),
            ("ZERO", None, 0.0, "mg/L", None, "mg/L"),
        ],
        STANDARDS,
    )


def test_acute_single_value(prepared, standards):
    rows = [
        {"analyte": "IRON", "sample_fraction": "Dissolved", "result_value": "1.5"},
        {"analyte": "IRON", "sample_fraction": "Total", "result_value": "9"},
        {"analyte": "IRON", "sample_fraction": None, "result_value": "9"},
        {"analyte": "CHLORIDE", "sample_fraction": "Total", "result_value": "500"},
        {"analyte": "CHLORIDE", "sample_fraction": None, "result_value": "text"},
        {"analyte": "COPPER", "sample_fraction": "Dissolved", "result_value": "1"},
        {"analyte": "ZERO", "sample_fraction": None, "result_value": "2"},
        {"analyte": "ZERO", "sample_fraction": None, "result_value": "0"},
    ]
    out = acute_single_value(prepared(rows, text_results=True), standards)
    got = [(r.row_id, r.quotient, r.standard_violation) for r in out.orderBy("row_id").collect()]
    assert got == [
        (0, 1.5, "EXCEEDANCE"),
        (3, 1.0, "NONE"),
        (4, None, None),
        (6, math.inf, "EXCEEDANCE"),
        (7, None, None),
    ]


def test_raising_a_standard_never_adds_exceedances(prepared, standards):
    rows = [{"analyte": "CHLORIDE", "result_value": 100.0 * i} for i in range(20)]
    counts = []
    for factor in (0.5, 1.0, 2.0):
        raised = standards.withColumn("acute_standard", F.col("acute_standard") * factor)
        out = acute_single_value(prepared(rows), raised)
        counts.append(out.where("standard_violation = 'EXCEEDANCE'").count())
    assert counts == sorted(counts, reverse=True) and counts[0] > counts[-1]


def test_override_updates_only(spark, standards):
    edits = spark.createDataFrame(
        [
            ("IRON", "Dissolved", 2.0, None),
            ("CHLORIDE", None, None, 99.0),
            ("IRON", "Total", 5.0, 5.0),
            ("NEW", None, 1.0, 1.0),
        ],
        "Analyte string, sample_fraction string, acute_standard double, chronic_standard double",
    )
    out = override_standards(standards, edits)
    assert out.columns == standards.columns
    assert {r.Analyte: (r.acute_standard, r.chronic_standard) for r in out.collect()} == {
        "IRON": (2.0, 0.8),
        "CHLORIDE": (500.0, 99.0),
        "COPPER": (None, 20.0),
        "ZERO": (0.0, None),
    }


def test_filter_by_pairs(spark):
    df = spark.createDataFrame([("A", "x"), ("A", "y"), ("B", "x"), ("C", "x"), ("A", None), (None, "x")], "k string, m string")
    out = filter_by_pairs(df, "k", "m", {"A": "x", "B": "y", "C": None})
    assert [tuple(r) for r in out.collect()] == [("A", "x")]
    assert filter_by_pairs(df, "k", "m", {}).count() == 0
    with pytest.raises(ValueError, match="nope"):
        filter_by_pairs(df, "nope", "m", {})


def _curve(curve, log_h):
    return math.exp(curve.a + curve.b * log_h) * (curve.cf_base - curve.cf_slope * log_h)


def test_hardness_dependent_for_every_analyte(prepared):
    rows = [
        {"analyte": s.analyte, "sample_fraction": s.fraction, "hardness": h, "result_value": 1.0, "start_date": DAY}
        for s in HARDNESS_STANDARDS
        for h in (100.0, 300.0)
    ]
    out = {(r.analyte, r.hardness): r for r in hardness_dependent(prepared(rows)).collect()}
    assert len(out) == 16
    for s in HARDNESS_STANDARDS:
        for h in (100.0, 300.0):
            row, log_h = out[s.analyte, h], math.log(h)
            acute, chronic = _curve(s.acute, log_h) / s.divisor, _curve(s.chronic, log_h) / s.divisor
            assert row.acute_standard == pytest.approx(acute)
            assert row.chronic_standard == pytest.approx(min(chronic, s.chronic_cap or chronic))
            assert row.quotient == pytest.approx(1 / acute)
            assert row.standard_violation == ("EXCEEDANCE" if 1 / acute > 1 else "NONE")
    assert hardness_dependent(prepared(rows)).columns[:4] == [
        "acute_standard", "result_value", "quotient", "standard_violation",
    ]


def test_hardness_edge_cases(prepared):
    rows = [
        {"analyte": "ZINC", "sample_fraction": "Dissolved", "hardness": 0.0, "result_value": 1.0},
        {"analyte": "LEAD", "sample_fraction": "Dissolved", "hardness": 0.0, "result_value": 1.0},
        {"analyte": "ZINC", "sample_fraction": "Total", "hardness": 9.0, "result_value": 1.0},
        {"analyte": "ZINC", "sample_fraction": None, "hardness": 9.0, "result_value": 1.0},
        {"analyte": "ZINC", "sample_fraction": "Dissolved", "hardness": None, "result_value": 1.0},
        {"analyte": "FLUORIDE", "sample_fraction": "Total", "hardness": 5000.0, "result_value": 1.0},
    ]
    out = {r.row_id: r for r in hardness_dependent(prepared(rows)).collect()}
    assert sorted(out) == [0, 1, 4, 5]
    assert (out[0].acute_standard, out[0].quotient, out[0].standard_violation) == (0.0, math.inf, "EXCEEDANCE")
    assert (out[1].acute_standard, out[1].standard_violation) == (None, None)
    assert (out[4].acute_standard, out[4].standard_violation) == (None, None)
    assert out[5].chronic_standard == 4.0


def test_ammonia_acute(prepared):
    rows = [
        {"analyte": "PH", "sample_depth": 2.5, "result_value": 8.0},
        {"analyte": "AMMONIA-NITROGEN", "sample_depth": 1.6, "result_value": 9.0},
        {"analyte": "AMMONIA-NITROGEN", "sample_depth": 3.4, "result_value": 9.0},
        {"analyte": "AMMONIA-NITROGEN", "sample_depth": 2.0, "result_value": None},
        {"analyte": "PH", "sample_depth": 5.0, "result_value": 6.0},
        {"analyte": "AMMONIA-NITROGEN", "sample_depth": 5.0, "result_value": 16.0},
    ]
    out = {r.row_id: r for r in ammonia_acute(prepared([{**r, "start_date": DAY} for r in rows])).collect()}
    assert sorted(out) == [1, 5]  # 2.5 rounds to 2; 3.4 has no pH; no result
    expected = 0.411 / (1 + 10 ** (7.204 - 8.0)) + 58.4 / (1 + 10 ** (8.0 - 7.204))
    assert out[1].acute_standard == pytest.approx(expected)
    assert (out[1].sample_depth, out[1].unrounded_depth, out[1].standard_violation) == (2.0, 1.6, "EXCEEDANCE")
    assert (out[5].acute_standard, out[5].standard_violation) == (15.0, "EXCEEDANCE")


@pytest.mark.parametrize(
    "hardness, chloride, expected",
    [
        (100, 25, (1276.7 + 5.508 * 100 - 1.457 * 25) * 0.65),
        (500, 500, (1276.7 + 5.508 * 500 - 1.457 * 500) * 0.65),
        (100, 5, (-57.478 + 5.79 * 100 + 0.65 * 5) * 0.65),
        (500, 24.9, (-57.478 + 5.79 * 500 + 0.65 * 24.9) * 0.65),
        (99, 100, 500.0),
        (300, 4, 500.0),
        (501, 4, 500.0),
        (501, 5, 2000.0),
        (300, 501, None),
    ],
)
def test_sulfate_ranges(prepared, hardness, chloride, expected):
    data = prepared(
        [
            {"analyte": "CHLORIDE", "result_value": float(chloride), "hardness": float(hardness), "start_date": DAY},
            {"analyte": "SULFATE", "result_value": 600.0, "hardness": float(hardness), "start_date": DAY},
        ]
    )
    row = sulfate_acute(data).first()
    assert row.acute_standard == (expected if expected is None else pytest.approx(expected))
    assert row.standard_violation == (None if expected is None else "EXCEEDANCE" if 600 > expected else "NONE")


def test_sulfate_slope_can_be_replaced(prepared):
    data = prepared([{"analyte": "CHLORIDE", "result_value": 10.0, "hardness": 200.0, "start_date": DAY}])
    params = SulfateParams(low_chloride=SulfateBand(100, 500, 5, 25, -57.478, 5.79, 54.163))
    assert sulfate_standards(data, params).first().acute_standard == pytest.approx(
        (-57.478 + 5.79 * 200 + 54.163 * 10) * 0.65
    )


def test_sulfate_visits(prepared):
    def visit(day, rows):
        return [{"start_date": date(2020, 6, day), "hardness": 50.0, **r} for r in rows]

    chloride, sulfate = {"analyte": "CHLORIDE", "result_value": 10.0}, {"analyte": "SULFATE", "result_value": 600.0}
    rows = [
        *visit(1, [chloride, chloride, sulfate]),  # two standards: two rows
        *visit(2, [chloride, sulfate, {"analyte": "IRON", "hardness": None}]),  # hardness gap
        *visit(3, [sulfate]),  # no chloride
        *visit(4, [chloride, sulfate, {"analyte": "SULFATE", "result_value": None}]),
        *visit(5, [chloride, {"analyte": "CHLORIDE", "result_value": None}, sulfate]),
        *visit(6, [chloride, sulfate, {"analyte": None}]),
    ]
    out = sulfate_acute(prepared(rows)).orderBy("start_date").collect()
    got = [(r.start_date.day, r.acute_standard) for r in out]
    assert got == [(1, 500.0), (1, 500.0), (2, None), (3, None), (4, None), (4, None), (5, None), (6, None)]


def test_exceedance_summary(prepared, spark):
    standards = spark.createDataFrame([("SULFATE", None, 500.0, "mg/L", None, None)], STANDARDS)
    rows = [
        {"analyte": "CHLORIDE", "result_value": 10.0, "hardness": 50.0, "start_date": DAY},
        {"analyte": "SULFATE", "result_value": 600.0, "hardness": 50.0, "start_date": DAY},
        {"analyte": "ZINC", "sample_fraction": "Dissolved", "result_value": 1e6, "hardness": 50.0, "start_date": DAY},
        {"analyte": "PH", "result_value": 8.0, "hardness": 50.0, "start_date": DAY},
        {"analyte": "AMMONIA-NITROGEN", "result_value": 99.0, "hardness": 50.0, "start_date": DAY},
        {"analyte": "AMMONIA-NITROGEN", "result_value": 0.1, "hardness": 50.0, "start_date": DAY},
    ]
    data = prepared(rows)
    out = exceedance_summary(
        acute_single_value(data, standards), hardness_dependent(data), ammonia_acute(data), sulfate_acute(data)
    )
    got = {r.row_id: r for r in out.collect()}
    assert out.count() == 3 and sorted(got) == [1, 2, 4]
    assert got[1].acute_units == "mg/L" and got[4].pH == 8.0 and got[2].chronic_standard is not None
    assert not {"hardness", "data_usability", "limit_type_1"} & set(out.columns)


def test_preview(prepared):
    data = prepared([{"analyte": "PH", "result_value": float(i)} for i in range(9)]).repartition(4)
    assert [r.row_id for r in preview(data).collect()] == [0, 1, 2, 3, 4, 5]
