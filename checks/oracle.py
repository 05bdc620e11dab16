"""The registered queries in SQL, written against the raw test tables.

Each query is a chain of named subqueries; ``_query`` adds the ones it needs.
"""

from __future__ import annotations

import re

from . import derive


def _text(value) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(value)


def _list(values) -> str:
    return "[" + ", ".join(_text(v) for v in values) + "]"


def _rows(rows) -> str:
    return ", ".join("(" + ", ".join(_text(v) for v in row) + ")" for row in rows)


TAX = "CAST(floor(l_tax * 100 + 0.5) AS INT)"
DISCOUNT = "CAST(floor(l_discount * 100 + 0.5) AS INT)"
MONTH = "CAST(1 + (l_orderkey // 2) % 12 AS INT)"


def _samples(dense: bool) -> str:
    share = "(l_quantity / 50.0::DOUBLE)"
    if dense:
        analyte = f"{_list(derive.DENSE_ANALYTES)}[CAST(l_partkey % 4 + 1 AS INT)]"
        value = (
            f"CASE WHEN l_partkey % 4 <= 1 THEN 6.0::DOUBLE * {share} "
            f"WHEN l_partkey % 4 = 2 THEN 6.0::DOUBLE + 3.0::DOUBLE * {share} "
            f"ELSE 5.0::DOUBLE + 2.0::DOUBLE * (6 - abs({MONTH} - 7)) + 1.5::DOUBLE * {share} END"
        )
        depth = "l_linenumber * 0.75::DOUBLE"
    else:
        index = f"CAST(l_partkey % {len(derive.ANALYTES)} + 1 AS INT)"
        analyte = f"{_list([a for a, _, _ in derive.ANALYTES])}[{index}]"
        low = f"({_list([lo for _, lo, _ in derive.ANALYTES])}::DOUBLE[])[{index}]"
        span = f"({_list([s for _, _, s in derive.ANALYTES])}::DOUBLE[])[{index}]"
        value = f"{low} + {share} * {span}"
        depth = f"CASE WHEN l_partkey % {len(derive.ANALYTES)} = {derive.SECCHI_INDEX} THEN 0.5::DOUBLE ELSE l_linenumber * 0.75::DOUBLE END"
    return f"""
SELECT (l_orderkey * 8 + l_linenumber) * 1048576 + (l_partkey * 7919 + l_suppkey) % 1048576 AS row_id,
  CASE l_suppkey WHEN 7 THEN 'RHL' WHEN 8 THEN 'WDW' ELSE 'S' || l_suppkey END AS mlid,
  make_date(CAST(2019 + l_orderkey % 2 AS INT), {MONTH}, 10) AS start_date,
  CAST(l_orderkey * 7 % 86400 AS INT) AS start_time,
  CASE WHEN NOT (l_linenumber = 1 AND l_quantity = 13) THEN {depth} END AS sample_depth,
  'm' AS depth_unit,
  {analyte} AS analyte,
  CASE l_returnflag WHEN 'R' THEN 'Dissolved' WHEN 'A' THEN 'Total' END AS sample_fraction,
  CASE WHEN NOT (({TAX} = 3 AND l_linenumber % 2 = 1) OR ({TAX} = 5 AND l_linenumber = 7))
       THEN {value} END AS result_value,
  {_list(derive.UNITS)}[{DISCOUNT} + 1] AS result_unit,
  {_list(derive.QUALIFIERS)}[{TAX} + 1] AS qualifiers,
  CASE WHEN l_linenumber = 5 THEN 'Lower Reporting Limit' ELSE 'Method Detection Level' END AS limit_type_1,
  0.02::DOUBLE AS limit_value_1,
  'mg/L' AS limit_unit_1,
  CAST(NULL AS VARCHAR) AS limit_type_2,
  CAST(NULL AS DOUBLE) AS limit_value_2,
  CAST(NULL AS VARCHAR) AS limit_unit_2
FROM lineitem"""


# Zero, negative and missing arguments as the rules want them.
def ln(x: str) -> str:
    return f"CASE WHEN {x} = 0 THEN '-Infinity'::DOUBLE WHEN {x} > 0 THEN ln({x}) END"


def div(a: str, b: str) -> str:
    return (
        f"CASE WHEN {b} = 0 THEN CASE WHEN {a} > 0 THEN 'Infinity'::DOUBLE "
        f"WHEN {a} < 0 THEN '-Infinity'::DOUBLE END ELSE {a} / nullif({b}, 0) END"
    )


def violation(q: str) -> str:
    return f"CASE WHEN {q} > 1 THEN 'EXCEEDANCE' WHEN {q} <= 1 THEN 'NONE' END"


def fill(x: str, keys: str) -> str:
    return (
        f"coalesce(last_value({x} IGNORE NULLS) OVER (PARTITION BY {keys} ORDER BY row_id "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
        f"first_value({x} IGNORE NULLS) OVER (PARTITION BY {keys} ORDER BY row_id "
        "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
    )


def depth_class(test: str) -> str:
    return f"CASE WHEN {test} THEN 'Shallow' WHEN NOT ({test}) THEN 'Deep' END"


def _curve(kind: str) -> str:
    """Hardness-dependent standards, written out from the coefficient table."""
    coefficients = {
        "acute": [
            ("CADMIUM", "Dissolved", "exp(-2.918 + 1.128 * lh) * (1.138672 - lh * 0.041838)"),
            ("CHROMIUM", "Dissolved", "exp(3.688 + 0.8190 * lh) * 0.316"),
            ("COPPER", "Dissolved", "exp(-1.464 + 0.9422 * lh) * 0.960"),
            ("LEAD", "Dissolved", "exp(-1.301 + 1.273 * lh) * (1.46203 - lh * 0.145712)"),
            ("MANGANESE", "Dissolved", "exp(4.9187 + 0.7467 * lh) * 0.9812"),
            ("NICKEL", "Dissolved", "exp(0.5173 + 0.8460 * lh) * 0.998"),
            ("FLUORIDE", "Total", "exp(6.7319 + 0.5394 * lh) / 1000"),
            ("ZINC", "Dissolved", "exp(0.9035 + 0.8473 * lh) * 0.978"),
        ],
        "chronic": [
            ("CADMIUM", "Dissolved", "exp(-3.490 + 0.7852 * lh) * (1.101672 - lh * 0.041838)"),
            ("CHROMIUM", "Dissolved", "exp(1.561 + 0.8190 * lh) * 8.60"),
            ("COPPER", "Dissolved", "exp(-1.465 + 0.8545 * lh) * 6.7319"),
            ("LEAD", "Dissolved", "exp(-2.863 + 1.273 * lh) * (1.46203 - lh * 0.145712)"),
            ("MANGANESE", "Dissolved", "exp(4.0635 + 0.7467 * lh) * 0.9812"),
            ("NICKEL", "Dissolved", "exp(-2.286 + 0.8460 * lh) * 0.997"),
            (
                "FLUORIDE",
                "Total",
                "CASE WHEN exp(6.0445 + 0.5394 * lh) / 1000 > 4 THEN 4 ELSE exp(6.0445 + 0.5394 * lh) / 1000 END",
            ),
            ("ZINC", "Dissolved", "exp(-0.4456 + 0.8473 * lh) * 0.986"),
        ],
    }
    branches = " ".join(
        f"WHEN analyte = '{a}' AND sample_fraction = '{f}' THEN {e}" for a, f, e in coefficients[kind]
    )
    return f"CASE {branches} END"


def ph_curve(low: float, high: float, mid: float) -> str:
    return f"({low} / (1 + pow(10.0, {mid} - ph)) + {high} / (1 + pow(10.0, ph - {mid})))"


def _events(q: str, prefix: str, verdict: str, days: int) -> str:
    """Event columns from quotient ``q`` with its neighbours in columns
    ``{q}_lag``, ``{q}_lead``, ``d_lag``, ``d_lead``."""
    lag, lead = f"{q}_lag", f"{q}_lead"
    # Two readings of one day cross on that day.
    crossed = f"CASE WHEN d_lag = d THEN d ELSE (d_lag * (1 - {q}) + d * ({lag} - 1)) / nullif({lag} - {q}, 0) END"
    start = f"CASE WHEN {q} > 1 AND {lag} < 1 THEN CASE WHEN {crossed} > d THEN d ELSE {crossed} END END"
    end = f"CASE WHEN {q} < 1 AND {lag} > 1 THEN {crossed} END"
    next_end = (
        f"CASE WHEN {lead} < 1 AND {q} > 1 THEN CASE WHEN d = d_lead THEN d "
        f"ELSE (d * (1 - {lead}) + d_lead * ({q} - 1)) / nullif({q} - {lead}, 0) END END"
    )
    return f"""{start} AS {prefix}_start_date, {end} AS {prefix}_end_date, {next_end} AS {prefix}_next_end"""


def _durations(q: str, prefix: str, verdict: str, days: int) -> str:
    duration = (
        f"round_even(CASE WHEN {prefix}_next_end > {prefix}_start_date "
        f"THEN {prefix}_next_end - {prefix}_start_date END, 1)"
    )
    test = f"({q} > 1 AND {duration} >= {days})"
    return f"""{duration} AS {prefix}_event_duration,
  coalesce(CASE WHEN {test} THEN 'EXCEEDANCE' WHEN NOT {test} THEN 'NONE' END,
    CASE WHEN {q}_all AND span >= {days} THEN 'EXCEEDANCE' END) AS {verdict}"""


PARTS: dict[str, str] = {
    "samples": _samples(dense=False),
    "samples_dense": _samples(dense=True),
    "stations": "SELECT CASE s_suppkey WHEN 7 THEN 'RHL' WHEN 8 THEN 'WDW' ELSE 'S' || s_suppkey END AS code, "
    "'IL_L' || (s_suppkey // 4) AS auid FROM supplier",
    "standards": "SELECT * REPLACE (CAST(s_acute AS DOUBLE) AS s_acute, CAST(s_chronic AS DOUBLE) AS s_chronic) FROM (VALUES "
    + _rows(derive.STANDARDS)
    + ") AS t(s_analyte, s_fraction, s_acute, s_acute_units, s_chronic, s_chronic_units)",
    "macrophytes": """
SELECT 'IL_L' || lake AS m_auid, make_date(CAST(2019 + month // 12 AS INT), CAST(month % 12 + 1 AS INT), 10) AS m_date,
  CAST(lake * 52 % 80 AS DOUBLE) AS coverage
FROM (SELECT lake, unnest(range(0, 24)) AS month FROM (SELECT DISTINCT s_suppkey // 4 AS lake FROM supplier))
WHERE NOT (lake % 3 = 0 AND month % 12 = 2)""",
}


def _prep(suffix: str) -> dict[str, str]:
    return {
        f"cleaned{suffix}": f"""
SELECT s.* REPLACE (
    regexp_replace(qualifiers, '(?i)Trip ID:.+\\|\\s*', '') AS qualifiers,
    upper(analyte) AS analyte),
  CASE mlid WHEN 'RHL' THEN 'IL_RHL' WHEN 'WDW' THEN 'IL_WDW' ELSE auid END AS "AUID"
FROM samples{suffix} s LEFT JOIN stations ON s.mlid = code
WHERE result_unit NOT LIKE '%/kg'""",
        f"rated{suffix}": f"""
SELECT *, CASE
    WHEN qualifiers IS NULL OR regexp_matches(qualifiers, '[SC]') THEN 'Usable'
    WHEN (regexp_matches(qualifiers, 'A|B|E|I|K|L|M|N|J5|J6|J7') OR regexp_matches(qualifiers, 'J([^0-9]|$)'))
      AND NOT regexp_matches(qualifiers, 'J1|J2|J3|J4|J9|Q|V|X|W|Y') THEN 'Conditional Use'
    WHEN regexp_matches(qualifiers, 'J1|J2|J3|J4|J9|Q|V|X|W|Y') THEN 'Not Usable' END AS data_usability
FROM cleaned{suffix}""",
        f"usable{suffix}": f"""
SELECT * REPLACE (CASE WHEN result_value IS NULL AND qualifiers LIKE '%ND%'
    AND limit_type_1 = 'Method Detection Level' THEN limit_value_1 * 0.5::DOUBLE ELSE result_value END AS result_value)
FROM rated{suffix} WHERE data_usability <> 'Not Usable'""",
        f"prep{suffix}": f"""
SELECT * EXCLUDE (alkalinity), {fill("alkalinity", "mlid, start_date")} AS hardness
FROM (SELECT *, CASE WHEN analyte = 'ALKALINITY, TOTAL' THEN result_value END AS alkalinity FROM usable{suffix})""",
        f"tc{suffix}": f"""
SELECT mlid, start_date, min(sample_depth) AS thermocline_depth FROM (
  SELECT *, {div("(degrees - lag_degrees)", "(sample_depth - lag_depth)")} AS gradient FROM (
    SELECT *, lag(degrees) OVER w AS lag_degrees, lag(sample_depth) OVER w AS lag_depth FROM (
      SELECT mlid, start_date, sample_depth, start_time, result_value AS degrees FROM prep{suffix}
      WHERE analyte = 'TEMPERATURE, WATER' AND mlid IS NOT NULL AND start_date IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY mlid, start_date, sample_depth, start_time ORDER BY row_id) = 1)
    WINDOW w AS (PARTITION BY mlid, start_date ORDER BY sample_depth NULLS LAST, start_time NULLS LAST)))
WHERE abs(gradient) > 0.5 GROUP BY mlid, start_date""",
    }


for _suffix in ("", "_dense"):
    PARTS.update(_prep(_suffix))

PARTS.update(
    {
        "acute": f"""
SELECT p.*, s_acute AS acute_standard, s_acute_units AS acute_units, {div("result_value", "s_acute")} AS quotient
FROM prep p JOIN standards ON s_analyte = analyte AND (s_fraction IS NULL OR s_fraction = sample_fraction)
WHERE s_acute IS NOT NULL""",
        "logs": f"SELECT *, {ln('hardness')} AS lh FROM prep",
        "metals": """
SELECT * FROM logs WHERE sample_fraction = CASE
  WHEN analyte IN ('CADMIUM', 'COPPER', 'CHROMIUM', 'LEAD', 'MANGANESE', 'NICKEL', 'ZINC') THEN 'Dissolved'
  WHEN analyte = 'FLUORIDE' THEN 'Total' END""",
        "dependent": f"""
SELECT *, {div("result_value", "acute_standard")} AS quotient,
  {div("result_value", "chronic_standard")} AS chronic_quotient
FROM (SELECT *, {_curve("acute")} AS acute_standard, {_curve("chronic")} AS chronic_standard FROM metals)""",
        **{
            f"ammonia{suffix}": f"""
SELECT *, {div("result_value", "acute_standard")} AS quotient FROM (
  SELECT *, least({ph_curve(0.411, 58.4, 7.204)}, 15) AS acute_standard FROM (
    SELECT *, {fill("own_ph", "mlid, start_date, sample_depth")} AS ph FROM (
      SELECT * REPLACE (round_even(sample_depth, 0) AS sample_depth), sample_depth AS unrounded_depth,
        CASE WHEN analyte = 'PH' THEN result_value END AS own_ph
      FROM prep{suffix} WHERE analyte IN ('AMMONIA-NITROGEN', 'PH')))
  WHERE ph IS NOT NULL AND analyte = 'AMMONIA-NITROGEN' AND result_value IS NOT NULL)"""
            for suffix in ("", "_dense")
        },
        "sulfate_std": """
SELECT mlid, start_date, CASE
    WHEN h BETWEEN 100 AND 500 AND cl BETWEEN 25 AND 500 THEN (1276.7 + 5.508 * h - 1.457 * cl) * 0.65
    WHEN h BETWEEN 100 AND 500 AND cl BETWEEN 5 AND 25 THEN (-57.478 + 5.79 * h + 0.65 * cl) * 0.65
    WHEN h < 100 OR cl < 5 THEN 500 WHEN h > 500 AND cl >= 5 THEN 2000 END AS acute_standard
FROM (SELECT mlid, start_date, analyte, hardness AS h, result_value AS cl,
    bool_and(hardness IS NOT NULL) OVER v AND
    bool_and(CASE WHEN analyte IN ('CHLORIDE', 'SULFATE') THEN result_value IS NOT NULL ELSE true END) OVER v AS complete
  FROM prep WINDOW v AS (PARTITION BY mlid, start_date))
WHERE analyte = 'CHLORIDE' AND complete""",
        "sulfate": f"""
SELECT p.*, acute_standard, {div("result_value", "acute_standard")} AS quotient
FROM prep p LEFT JOIN sulfate_std s ON p.mlid = s.mlid AND p.start_date = s.start_date
WHERE analyte = 'SULFATE'""",
        "matched": f"""
SELECT *, {div("result_value", "chronic_standard")} AS quotient FROM (
  SELECT * EXCLUDE (hd, s_chronic), hd AS hd_chronic_standard,
    CASE WHEN hd IS NOT NULL AND s_chronic IS NULL THEN hd ELSE s_chronic END AS chronic_standard
  FROM (SELECT l.*, {_curve("chronic")} AS hd, s_chronic, coalesce(s_fraction, 'NA_') AS standards_fraction,
      CASE WHEN sample_fraction IS NULL THEN NULL
           WHEN regexp_matches(sample_fraction, coalesce(s_fraction, 'NA_')) THEN 'YES' ELSE 'NO' END AS fraction_match
    FROM logs l LEFT JOIN standards ON s_analyte = analyte)
  WHERE hd IS NOT NULL OR (s_chronic IS NOT NULL AND
    (fraction_match IS NULL OR fraction_match = 'YES' OR standards_fraction = 'NA_')))""",
        "sparse": f"""
SELECT mlid, analyte, sample_fraction, depth_narrative, count(*) AS times_sampled FROM (
  SELECT DISTINCT "AUID", mlid, start_date, analyte, sample_fraction, sample_depth,
    {depth_class("sample_depth <= 2")} AS depth_narrative FROM matched)
GROUP BY mlid, analyte, sample_fraction, depth_narrative HAVING count(*) < 3""",
        "series": f"""
SELECT *, lag(d) OVER w AS d_lag, lead(d) OVER w AS d_lead,
  lag(quotient) OVER w AS quotient_lag, lead(quotient) OVER w AS quotient_lead,
  bool_and(coalesce(quotient > 1, false)) OVER g AS quotient_all, max(d) OVER g - min(d) OVER g AS span
FROM (SELECT * REPLACE (round_even(sample_depth, 0) AS sample_depth),
    {depth_class("round_even(sample_depth, 0) < 2")} AS depth_narrative,
    CAST(date_diff('day', DATE '1970-01-01', start_date) AS DOUBLE) AS d
  FROM (SELECT m.*, t.thermocline_depth FROM matched m
    LEFT JOIN tc t ON m.mlid = t.mlid AND m.start_date = t.start_date
    LEFT JOIN sparse s ON m.mlid IS NOT DISTINCT FROM s.mlid AND m.analyte IS NOT DISTINCT FROM s.analyte
      AND m.sample_fraction IS NOT DISTINCT FROM s.sample_fraction
      AND ({depth_class("m.sample_depth <= 2")}) IS NOT DISTINCT FROM s.depth_narrative
    WHERE s.times_sampled IS NULL AND m.result_unit NOT LIKE '%kg%')
  WHERE NOT coalesce(sample_depth >= thermocline_depth, false))
WINDOW w AS (PARTITION BY mlid, analyte, depth_narrative, sample_fraction
    ORDER BY start_date, row_id, chronic_standard NULLS LAST, standards_fraction),
  g AS (PARTITION BY mlid, analyte, depth_narrative, sample_fraction)""",
        "chronic": f"""
SELECT *, {_durations("quotient", "chronic", "standard_violation", 4)}
FROM (SELECT *, {_events("quotient", "chronic", "standard_violation", 4)} FROM series)""",
        "an_sparse": f"""
SELECT DISTINCT mlid, depth_narrative FROM (
  SELECT mlid, sample_fraction, depth_narrative FROM (
    SELECT DISTINCT "AUID", mlid, start_date, sample_fraction, sample_depth,
      {depth_class("sample_depth <= 2")} AS depth_narrative FROM prep_dense WHERE analyte = 'AMMONIA-NITROGEN')
  GROUP BY mlid, sample_fraction, depth_narrative HAVING count(*) < 3)""",
        "an_filled": f"""
SELECT *, {fill("own_ph", "mlid, start_date")} AS ph, {fill("own_temp", "mlid, start_date")} AS temperature FROM (
  SELECT p.*, {depth_class("p.sample_depth <= 2")} AS depth_narrative,
    CASE WHEN analyte = 'PH' THEN result_value END AS own_ph,
    CASE WHEN analyte = 'TEMPERATURE, WATER' THEN result_value END AS own_temp
  FROM prep_dense p JOIN tc_dense t ON p.mlid = t.mlid AND p.start_date = t.start_date
  WHERE p.sample_depth < t.thermocline_depth AND analyte IN ('AMMONIA-NITROGEN', 'PH', 'TEMPERATURE, WATER')) f
WHERE NOT EXISTS (SELECT 1 FROM an_sparse s WHERE s.mlid = f.mlid
  AND s.depth_narrative IS NOT DISTINCT FROM f.depth_narrative)""",
        "an_std": f"""
SELECT *, {div("result_value", "standard")} AS quotient_chronic, standard * 2.5 AS standard_subchronic,
  {div("result_value", "(standard * 2.5)")} AS quotient_subchronic FROM (
  SELECT *, CASE
      WHEN early_life_present = 'Present' AND temperature <= 14.51 THEN {ph_curve(0.0577, 2.487, 7.688)} * 2.85
      WHEN early_life_present = 'Absent' AND temperature <= 7
        THEN {ph_curve(0.0577, 2.487, 7.688)} * (1.45 * pow(10.0, 0.504))
      ELSE {ph_curve(0.0577, 2.487, 7.688)} * (1.45 * pow(10.0, 0.028 * (25 - temperature))) END AS standard
  FROM (SELECT *, CASE WHEN month(start_date) BETWEEN 3 AND 10 THEN 'Present' ELSE 'Absent' END AS early_life_present,
      CAST(date_diff('day', DATE '1970-01-01', start_date) AS DOUBLE) AS d
    FROM an_filled WHERE analyte = 'AMMONIA-NITROGEN' AND ph IS NOT NULL AND temperature IS NOT NULL
      AND result_value IS NOT NULL))""",
        "an_series": """
SELECT *, lag(d) OVER w AS d_lag, lead(d) OVER w AS d_lead,
  lag(quotient_chronic) OVER w AS quotient_chronic_lag, lead(quotient_chronic) OVER w AS quotient_chronic_lead,
  lag(quotient_subchronic) OVER w AS quotient_subchronic_lag,
  lead(quotient_subchronic) OVER w AS quotient_subchronic_lead,
  bool_and(coalesce(quotient_chronic > 1, false)) OVER g AS quotient_chronic_all,
  bool_and(coalesce(quotient_subchronic > 1, false)) OVER g AS quotient_subchronic_all,
  max(d) OVER g - min(d) OVER g AS span,
  row_number() OVER w AS place, count(*) OVER g AS places
FROM an_std
WINDOW w AS (PARTITION BY mlid, depth_narrative ORDER BY start_date, row_id),
  g AS (PARTITION BY mlid, depth_narrative)""",
        "an_events": f"""
SELECT *, {_durations("quotient_chronic", "chronic", "standard_violation", 30)},
  {_durations("quotient_subchronic", "subchronic", "standard_violation_subchronic", 4)},
  CASE WHEN place = 1 AND quotient_chronic > 1 AND quotient_subchronic > 1 THEN 'No prior data' END AS first_exceedance,
  CASE WHEN place = places AND quotient_chronic > 1 AND quotient_subchronic > 1
    THEN 'No following data' END AS last_exceedance
FROM (SELECT *, {_events("quotient_chronic", "chronic", "", 30)},
  {_events("quotient_subchronic", "subchronic", "", 4)} FROM an_series)""",
        "tsi_raw": """
SELECT p.*, coverage, thermocline_depth,
  CASE WHEN analyte = 'TOTAL SUSPENDED SOLIDS' THEN result_value END AS tss0,
  CASE WHEN analyte = 'VOLATILE SUSPENDED SOLIDS' THEN result_value END AS vss0
FROM prep p LEFT JOIN macrophytes m ON p."AUID" = m_auid AND p.start_date = m_date
  LEFT JOIN tc t ON p.mlid = t.mlid AND p.start_date = t.start_date
WHERE ((analyte = 'PHOSPHORUS' AND sample_fraction = 'Total') OR analyte IN ('TOTAL SUSPENDED SOLIDS',
    'VOLATILE SUSPENDED SOLIDS', 'CHLOROPHYLL A, CORRECTED FOR PHEOPHYTIN', 'DEPTH, SECCHI DISK DEPTH'))
  AND result_value IS NOT NULL
  AND (thermocline_depth IS NULL OR analyte = 'CHLOROPHYLL A, CORRECTED FOR PHEOPHYTIN'
    OR sample_depth <= thermocline_depth)""",
        "tsi_paired": """
SELECT * FROM tsi_raw
WINDOW k AS (PARTITION BY mlid, start_date, sample_depth)
QUALIFY analyte NOT IN ('TOTAL SUSPENDED SOLIDS', 'VOLATILE SUSPENDED SOLIDS') OR
  (count(*) FILTER (WHERE analyte = 'TOTAL SUSPENDED SOLIDS') OVER k > 0 AND
   count(*) FILTER (WHERE analyte = 'VOLATILE SUSPENDED SOLIDS') OVER k > 0)""",
        "tsi_samples": f"""
SELECT DISTINCT mlid, "AUID", start_date, start_time, sample_depth, analyte, sample_fraction,
  CASE analyte WHEN 'NVSS' THEN nvss WHEN 'DEPTH, SECCHI DISK DEPTH' THEN result_value / 39.3700787::DOUBLE
    ELSE result_value END AS result_value,
  depth_unit, result_unit, hardness, coverage, thermocline_depth, tss AS "TSS", vss AS "VSS", nvss AS "NVSS"
FROM (SELECT *, CASE WHEN tss - vss < 0 THEN 0 ELSE tss - vss END AS nvss FROM (
  SELECT * REPLACE (CASE WHEN analyte IN ('TOTAL SUSPENDED SOLIDS', 'VOLATILE SUSPENDED SOLIDS')
      THEN 'NVSS' ELSE analyte END AS analyte),
    {fill("tss0", "mlid, start_date, sample_depth")} AS tss, {fill("vss0", "mlid, start_date, sample_depth")} AS vss
  FROM tsi_paired))""",
        "tsi_counts": """
SELECT "AUID", analyte, CAST(year(start_date) AS INT) AS collection_year,
  count(DISTINCT month(start_date)) AS months,
  count(DISTINCT CASE WHEN month(start_date) IN (6, 7, 8) THEN month(start_date) END) AS peak,
  count(DISTINCT mlid) AS sites, """
        + ", ".join(
            f"count(DISTINCT CASE WHEN month(start_date) = {m} THEN mlid END) AS sites_{m}" for m in range(4, 11)
        )
        + """
FROM tsi_samples GROUP BY ALL""",
        "tsi_sites": """
SELECT "AUID", analyte, collection_year, CAST(months AS INT) AS n_collection_months,
  CAST(peak AS INT) AS n_peak_season_months, CASE WHEN peak >= 2 THEN 'yes' ELSE 'no' END AS use_peak_season,
  CAST(usable AS INT) AS n_use_months, CASE WHEN usable >= 4 THEN 'yes' ELSE 'no' END AS use_n_months,
  CASE WHEN peak >= 2 AND usable >= 4 THEN 'met' WHEN peak >= 2 THEN 'unmet; < 4 months available'
    WHEN usable >= 4 THEN 'unmet; < 2 months peak season'
    ELSE 'unmet; < 4 months available; < 2 months peak season' END AS min_site_reqs
FROM (SELECT *, """
        + " + ".join(
            f"CASE WHEN sites_{m} > 0 AND sites_{m}::DOUBLE / sites >= 0.5 THEN 1 ELSE 0 END" for m in range(4, 11)
        )
        + " AS usable FROM tsi_counts)",
        "tsi_params": """
SELECT *, CASE WHEN counts THEN CASE WHEN count(*) FILTER (WHERE counts) OVER (PARTITION BY "AUID", collection_year) >= 2
    THEN 'yes' ELSE 'no' END END AS use_param
FROM (SELECT *, min_site_reqs = 'met' AND analyte IN ('PHOSPHORUS', 'NVSS',
  'CHLOROPHYLL A, CORRECTED FOR PHEOPHYTIN') AS counts FROM tsi_sites)""",
        "tsi_required": """
SELECT s.*, month(start_date) AS collection_month, p.* EXCLUDE ("AUID", analyte, counts)
FROM tsi_samples s JOIN tsi_params p ON s."AUID" IS NOT DISTINCT FROM p."AUID" AND s.analyte = p.analyte
  AND year(s.start_date) IS NOT DISTINCT FROM p.collection_year""",
        "tsi_values": """
SELECT "AUID", analyte, collection_year,
  CASE WHEN count(*) = count(result_value) THEN median(result_value) END AS median_analyte,
  CASE WHEN count(*) = count(coverage) THEN avg(coverage) END AS mean_coverage
FROM tsi_required WHERE min_site_reqs = 'met' GROUP BY ALL""",
        "tsi_scored": f"""
SELECT *, CASE analyte
    WHEN 'CHLOROPHYLL A, CORRECTED FOR PHEOPHYTIN' THEN 9.81 * ({ln("median_analyte")}) + 30.6
    WHEN 'DEPTH, SECCHI DISK DEPTH' THEN 60 - 14.41 * ({ln("median_analyte")})
    WHEN 'PHOSPHORUS' THEN 14.42 * ({ln("(median_analyte * 1000)")}) + 4.15 END AS tsi_weight,
  max(CASE WHEN analyte = 'NVSS' THEN CASE WHEN median_analyte < 12 THEN 0 WHEN median_analyte < 15 THEN 5
    WHEN median_analyte < 20 THEN 10 WHEN median_analyte >= 20 THEN 15 END END)
    OVER (PARTITION BY "AUID", collection_year) AS nvss_p,
  CASE WHEN mean_coverage >= 15 AND mean_coverage < 40 THEN 0
    WHEN mean_coverage >= 10 AND mean_coverage < 15 THEN 5 WHEN mean_coverage >= 40 AND mean_coverage < 50 THEN 5
    WHEN mean_coverage >= 5 AND mean_coverage < 10 THEN 10 WHEN mean_coverage >= 50 AND mean_coverage < 70 THEN 10
    WHEN mean_coverage < 5 THEN 15 WHEN mean_coverage >= 70 THEN 15 END AS mac_p
FROM tsi_values""",
        "tsi_points": """
SELECT "AUID", analyte, collection_year, median_analyte, mean_coverage, tsi_weight,
  coalesce(nvss_p, 0) AS "NVSS_points", coalesce(mac_p, 0) AS macrophyte_points,
  CASE WHEN nvss_p IS NULL THEN 'no' ELSE 'yes' END AS "NVSS_usable",
  CASE WHEN mac_p IS NULL THEN 'no' ELSE 'yes' END AS mac_usable,
  max(CASE WHEN analyte = 'DEPTH, SECCHI DISK DEPTH' THEN points END) OVER l AS secchi_points,
  max(CASE WHEN analyte = 'CHLOROPHYLL A, CORRECTED FOR PHEOPHYTIN' THEN points END) OVER l AS chlorophyll_points,
  max(CASE WHEN analyte = 'PHOSPHORUS' THEN points END) OVER l AS phosphorus_points
FROM (SELECT *, CASE WHEN tsi_weight < 60 THEN 40 WHEN tsi_weight < 85 THEN 50 WHEN tsi_weight < 90 THEN 60
    WHEN tsi_weight >= 90 THEN 70 END + coalesce(nvss_p, 0) + coalesce(mac_p, 0) AS points FROM tsi_scored)
WINDOW l AS (PARTITION BY "AUID", collection_year)""",
        "tsi_used": "SELECT *, "
        + ", ".join(
            f"CASE WHEN {p}_points IS NOT NULL AND (mac_usable = 'yes' OR \"NVSS_usable\" = 'yes') THEN "
            f"CASE WHEN {p}_points < 75 THEN 'FULLY SUPPORTING' ELSE 'NOT SUPPORTING' END "
            f"ELSE 'NOT ASSESSED' END AS {p}_use"
            for p in ("secchi", "chlorophyll", "phosphorus")
        )
        + " FROM tsi_points",
    }
)

def _finding(table: str, depth: str, extra: dict[str, str]) -> str:
    columns = ", ".join(f"{extra.get(c, 'NULL')} AS {c}" for c in ("acute_units", "chronic_standard", "ph"))
    return (
        'SELECT row_id, mlid, "AUID", start_date, analyte, sample_fraction, result_value, '
        f"{depth} AS sample_depth, acute_standard, quotient, {columns} FROM {table} WHERE quotient > 1"
    )


def _full_join(left: str, right: str) -> str:
    shared = ["row_id", "mlid", "AUID", "start_date", "analyte", "sample_fraction", "result_value", "sample_depth"]
    shared += ["acute_standard", "quotient", "acute_units", "chronic_standard", "ph"]
    keys = ["row_id", "AUID", "sample_depth", "acute_standard", "quotient"]
    columns = ", ".join(f'coalesce(l."{c}", r."{c}") AS "{c}"' for c in shared)
    test = " AND ".join(f'l."{k}" IS NOT DISTINCT FROM r."{k}"' for k in keys)
    return f"SELECT {columns} FROM ({left}) l FULL JOIN ({right}) r ON {test}"


PARTS["findings"] = _full_join(
    _full_join(
        _full_join(
            _finding("acute", "sample_depth", {"acute_units": "acute_units"}),
            _finding("dependent", "sample_depth", {"chronic_standard": "chronic_standard"}),
        ),
        _finding("ammonia", "sample_depth", {"ph": "ph"}),
    ),
    _finding("sulfate", "sample_depth", {}),
)


def _needed(sql: str, seen: list[str]) -> None:
    """Names of subqueries a statement uses, in dependency order."""
    for name in PARTS:
        if name not in seen and re.search(rf"\b(?:FROM|JOIN)\s+\(?{name}\b", sql):
            _needed(PARTS[name], seen)
            if name not in seen:
                seen.append(name)


def _query(sql: str) -> str:
    names: list[str] = []
    _needed(sql, names)
    head = ",\n".join(f"{n} AS ({PARTS[n].strip()})" for n in names)
    return f"WITH {head}\n{sql}" if names else sql


def r6(*names: str) -> str:
    return ", ".join(f'round({n}, 6) AS {n}' for n in names)


WHO = 'row_id, mlid, "AUID", start_date, analyte, sample_fraction, round(result_value, 6) AS result_value'
VERDICT = f"{r6('acute_standard', 'quotient')}, {violation('quotient')} AS standard_violation"

_SIZE = "CASE p_size % 3 WHEN 0 THEN 'Total' WHEN 1 THEN 'Dissolved' END"

ORACLE_SQL: dict[str, str] = {
    "column_map": _query(
        "SELECT * REPLACE ('mg/L' AS result_unit, result_unit AS limit_unit_1, "
        "round(sample_depth, 6) AS sample_depth, round(result_value, 6) AS result_value) FROM samples"
    ),
    "prep_samples": _query(
        "SELECT * REPLACE (round(sample_depth, 6) AS sample_depth, round(result_value, 6) AS result_value, "
        "round(hardness, 6) AS hardness) FROM prep"
    ),
    "usability_counts": _query(
        "SELECT qualifiers, data_usability, count(*) AS n_rows FROM usable GROUP BY qualifiers, data_usability"
    ),
    "nondetect_substitution": _query(
        "SELECT row_id, analyte, qualifiers, limit_type_1, round(result_value, 6) AS result_value FROM usable"
    ),
    "hardness_fill": _query(
        "SELECT row_id, mlid, start_date, analyte, round(hardness, 6) AS hardness FROM prep"
    ),
    "standards_override": f"""
WITH base AS (SELECT 'PART ' || p_partkey AS "Analyte", {_SIZE} AS sample_fraction,
    CASE WHEN p_size % 4 <> 0 THEN p_retailprice END AS acute, CASE WHEN p_size % 5 <> 0 THEN p_retailprice / 2 END AS chronic
  FROM part),
edits AS (SELECT 'PART ' || l_partkey AS "Analyte",
    max(CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN l_extendedprice END) AS new_acute,
    max(CASE WHEN l_returnflag = 'A' AND l_linenumber = 2 THEN l_extendedprice END) AS new_chronic
  FROM lineitem GROUP BY l_partkey)
SELECT "Analyte", sample_fraction, round(coalesce(new_acute, acute), 6) AS acute_standard, 'mg/L' AS acute_units,
  round(coalesce(new_chronic, chronic), 6) AS chronic_standard, 'mg/L' AS chronic_units
FROM base LEFT JOIN edits USING ("Analyte")""",
    "acute_single_value": _query(f"SELECT {WHO}, {VERDICT}, acute_units FROM acute"),
    "named_vector_filter": _query(f"SELECT {WHO} FROM metals"),
    "hardness_equation": _query(
        "SELECT row_id, round(hardness, 6) AS hardness, "
        "round(exp(-1.301 + 1.273 * lh) * (1.46203 - 0.145712 * lh), 6) AS lead_acute FROM logs"
    ),
    "hardness_acute": _query(f"SELECT {WHO}, round(hardness, 6) AS hardness, {VERDICT} FROM dependent"),
    "hardness_chronic": _query(
        f"SELECT {WHO}, {r6('hardness', 'chronic_standard', 'chronic_quotient')} FROM dependent"
    ),
    "ammonia_acute": _query(
        f"SELECT {WHO}, {r6('sample_depth', 'unrounded_depth')}, round(ph, 6) AS \"pH\", {VERDICT} FROM ammonia_dense"
    ),
    "sulfate_standard": _query(
        "SELECT mlid, start_date, round(CAST(acute_standard AS DOUBLE), 6) AS acute_standard FROM sulfate_std"
    ),
    "sulfate_acute": _query(
        f"SELECT {WHO}, round(hardness, 6) AS hardness, "
        + VERDICT.replace("round(acute_standard", "round(CAST(acute_standard AS DOUBLE)")
        + " FROM sulfate"
    ),
    "thermocline": _query("SELECT mlid, start_date, round(thermocline_depth, 6) AS thermocline_depth FROM tc"),
    "chronic_standard_match": _query(
        f"SELECT {WHO}, round(hd_chronic_standard, 6) AS hd_chronic_standard, standards_fraction, fraction_match, "
        f"{r6('chronic_standard', 'quotient')} FROM matched"
    ),
    "undersampled_series": _query(
        "SELECT mlid, analyte, sample_fraction, depth_narrative, times_sampled FROM sparse"
    ),
    "chronic_events": _query(
        f"SELECT {WHO}, round(sample_depth, 6) AS sample_depth, depth_narrative, "
        f"{r6('chronic_standard', 'quotient')}, d AS numeric_date, "
        f"{r6('chronic_start_date', 'chronic_end_date', 'chronic_event_duration')}, standard_violation FROM chronic"
    ),
    "ammonia_chronic_standard": _query(
        'SELECT row_id, mlid, start_date, depth_narrative, round(ph, 6) AS "pH", round(temperature, 6) AS temperature, '
        f"early_life_present, {r6('standard', 'quotient_chronic', 'quotient_subchronic')} FROM an_std"
    ),
    "ammonia_chronic_events": _query(
        "SELECT row_id, mlid, start_date, depth_narrative, "
        f"{r6('quotient_chronic', 'chronic_start_date', 'chronic_end_date', 'chronic_event_duration')}, "
        "standard_violation FROM an_events"
    ),
    "ammonia_subchronic_events": _query(
        "SELECT row_id, mlid, start_date, depth_narrative, "
        f"{r6('quotient_subchronic', 'subchronic_start_date', 'subchronic_end_date', 'subchronic_event_duration')}, "
        "standard_violation_subchronic FROM an_events"
    ),
    "ammonia_first_last": _query(
        "SELECT row_id, mlid, start_date, depth_narrative, first_exceedance, last_exceedance FROM an_events"
    ),
    "tsi_nvss": _query(
        'SELECT mlid, "AUID", start_date, start_time, sample_depth, analyte, sample_fraction, '
        + r6("result_value", "hardness", "coverage", "thermocline_depth", '"TSS"', '"VSS"', '"NVSS"')
        + " FROM tsi_samples"
    ),
    "tsi_site_requirements": _query("SELECT * FROM tsi_sites"),
    "tsi_param_requirements": _query(
        'SELECT mlid, "AUID", start_date, start_time, sample_depth, analyte, sample_fraction, '
        "round(result_value, 6) AS result_value, CAST(collection_month AS INT) AS collection_month, "
        "CAST(collection_year AS INT) AS collection_year, n_collection_months, n_peak_season_months, "
        "use_peak_season, n_use_months, use_n_months, min_site_reqs, use_param FROM tsi_required"
    ),
    "tsi_points": _query(
        "SELECT * REPLACE (round(median_analyte, 6) AS median_analyte, round(mean_coverage, 6) AS mean_coverage, "
        "round(tsi_weight, 6) AS tsi_weight) FROM tsi_points"
    ),
    "tsi_use_support": _query(
        """SELECT "AUID", analyte, collection_year, secchi_use, chlorophyll_use, phosphorus_use,
  CASE WHEN secchi_use = chlorophyll_use THEN secchi_use WHEN secchi_use = phosphorus_use THEN secchi_use
    WHEN chlorophyll_use = phosphorus_use THEN chlorophyll_use ELSE 'NEEDS REVIEW' END AS "ALU_use"
FROM tsi_used"""
    ),
    "exceedance_summary": _query(
        f"SELECT {WHO}, {VERDICT}, acute_units, round(CAST(chronic_standard AS DOUBLE), 6) AS chronic_standard, "
        'round(CAST(ph AS DOUBLE), 6) AS "pH" FROM findings'
    ),
    "preview": _query(
        "SELECT row_id, mlid, start_date, analyte, round(result_value, 6) AS result_value "
        "FROM samples ORDER BY row_id LIMIT 6"
    ),
}

ORACLE_SQL["ingest_table"] = """SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS name_full, CAST(c_nationkey AS VARCHAR) AS nation,
  round(c_acctbal, 6) AS balance FROM customer
UNION ALL
SELECT CAST(s_suppkey AS VARCHAR), s_name, CAST(s_nationkey AS VARCHAR), round(s_acctbal, 6) FROM supplier"""

ORACLE_SQL["uploaded_samples"] = _query(
    "SELECT row_id, mlid, start_date, start_time, round(sample_depth, 6) AS sample_depth, round(result_value, 6) AS result_value, "
    "CASE WHEN row_id % 3 <> 0 THEN mlid || chr(10) || 'as \"' || analyte || '\", see' || chr(10) || chr(10) || 'sheet ' "
    "|| CAST(row_id % 7 AS VARCHAR) END AS field_notes FROM samples"
)
ORACLE_SQL["acute_from_uploads"] = ORACLE_SQL["acute_single_value"]
ORACLE_SQL["uploaded_macrophytes"] = _query('SELECT m_auid AS "AUID", m_date AS start_date, round(coverage, 6) AS coverage FROM macrophytes')
ORACLE_SQL["chronic_pattern_match"] = ORACLE_SQL["chronic_standard_match"].replace(_rows(derive.STANDARDS), _rows(derive.PATTERN_STANDARDS))

# The finding of each result table, as in the registry.
_FINDINGS = {
    "acute_results": ("acute_single_value", "standard_violation = 'EXCEEDANCE'"),
    "chronic_results": ("chronic_events", "standard_violation = 'EXCEEDANCE'"),
    "dependent_results": ("hardness_acute", "standard_violation = 'EXCEEDANCE'"),
    "ammonia_nitrogen_results": ("ammonia_acute", "standard_violation = 'EXCEEDANCE'"),
    "chronic_ammonia_nitrogen_res": ("ammonia_chronic_events", "standard_violation = 'EXCEEDANCE'"),
    "sulfates_results": ("sulfate_acute", "standard_violation = 'EXCEEDANCE'"),
    "tsi_results": ("tsi_use_support", "\"ALU_use\" = 'NOT SUPPORTING'"),
}
ORACLE_SQL["assessment_tables"] = "\nUNION ALL\n".join(
    f"SELECT '{table}' AS table_name, count(*) AS n_rows, count(*) FILTER (WHERE {finding}) AS n_findings\n"
    f"FROM ({ORACLE_SQL[query]})"
    for table, (query, finding) in _FINDINGS.items()
)
