"""Column roles of the input tables."""

from __future__ import annotations

# Role -> column name expected by default.
SAMPLE_COLUMNS: dict[str, str] = {
    "mlid": "monitoring_location_id",
    "start_date": "activity_start_date",
    "start_time": "activity_start_time",
    "sample_depth": "activity_depth_height",
    "depth_unit": "activity_depth_height_unit",
    "analyte": "characteristic_name",
    "sample_fraction": "sample_fraction",
    "result_value": "result_value",
    "result_unit": "result_unit",
    "qualifiers": "result_comment",
    "limit_type_1": "detection_limit_type_1",
    "limit_value_1": "detection_limit_value_1",
    "limit_unit_1": "detection_limit_unit_1",
    "limit_type_2": "detection_limit_type_2",
    "limit_value_2": "detection_limit_value_2",
    "limit_unit_2": "detection_limit_unit_2",
}

# Role -> column name expected by default.
MACROPHYTE_COLUMNS: dict[str, str] = {
    "AUID": "basin_code",
    "collection_date_id": "collection_date",
    "coverage": "percent_macrophyte_cover",
}

ROW_ID = "row_id"

# Column names.
LIMIT_COLUMNS = [
    "limit_type_1",
    "limit_value_1",
    "limit_unit_1",
    "limit_type_2",
    "limit_value_2",
    "limit_unit_2",
]

# Columns of prepared samples, in order.
PREPARED_COLUMNS = [ROW_ID, *SAMPLE_COLUMNS, "AUID", "data_usability", "hardness"]

# Analyte names with a role in the rules.
ALKALINITY = "ALKALINITY, TOTAL"
AMMONIA = "AMMONIA-NITROGEN"
PH = "PH"
TEMPERATURE = "TEMPERATURE, WATER"
CHLORIDE = "CHLORIDE"
SULFATE = "SULFATE"
PHOSPHORUS = "PHOSPHORUS"
TSS = "TOTAL SUSPENDED SOLIDS"
VSS = "VOLATILE SUSPENDED SOLIDS"
CHLOROPHYLL = "CHLOROPHYLL A, CORRECTED FOR PHEOPHYTIN"
SECCHI = "DEPTH, SECCHI DISK DEPTH"
NVSS = "NVSS"

# Sites whose water body is set by hand.
SITE_WATER_BODIES: dict[str, str] = {
    "RGF-2": "IL_RGF",
    "WTP-1": "IL_WTP",
    "RHL": "IL_RHL",
    "RHZH": "IL_RHZH",
    "RHZG": "IL_RHZG",
    "RGK": "IL_RGK",
    "RTZJ": "IL_RTZJ",
    "RGZO": "IL_RGZO",
    "RDZP": "IL_RDZP",
    "RDZF": "IL_RDZF",
    "WDW": "IL_WDW",
}
