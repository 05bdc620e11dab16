"""Column names: clean headers and map them to roles."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import MACROPHYTE_COLUMNS, ROW_ID, SAMPLE_COLUMNS


def clean_name(header: str) -> str:
    """One header in snake_case: ``"Result Value (mg/L)"`` -> ``result_value_mg_l``."""
    text = header.replace("%", " percent ").replace("#", " number ")
    text = re.sub(r"['\"]", "", text)
    # Accents go, letters stay.
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    text = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", text)
    text = re.sub(r"[^0-9A-Za-z]+", "_", text).strip("_").lower()
    if not text or text[0].isdigit():
        text = f"x{text}"
    return text


def clean_names(headers: list[str]) -> list[str]:
    """Clean all headers; a name taken already gets the next free ``_2``, ``_3``, ..."""
    out: dict[str, None] = {}
    for header in headers:
        name = base = clean_name(header)
        number = 1
        while name in out:
            number += 1
            name = f"{base}_{number}"
        out[name] = None
    return list(out)


def with_clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*clean_names(df.columns))


def map_columns(
    df: DataFrame, defaults: Mapping[str, str], chosen: Mapping[str, str | None] | None = None
) -> DataFrame:
    """Keep one column per role and name it after the role.

    ``chosen`` replaces default source names. A role without a column in the
    table raises. ``row_id`` is carried along when present.
    """
    mapping = {**defaults, **(chosen or {})}
    unknown = [role for role in mapping if role not in defaults]
    if unknown:
        raise ValueError(f"Unknown column roles: {', '.join(sorted(unknown))}")
    missing = [role for role, name in mapping.items() if not name or name not in df.columns]
    if missing:
        raise ValueError(f"Please select a column for: {', '.join(missing)}")
    kept = [F.col(ROW_ID)] if ROW_ID in df.columns and ROW_ID not in mapping else []
    return df.select(*kept, *[F.col(f"`{name}`").alias(role) for role, name in mapping.items()])


def map_sample_columns(df: DataFrame, chosen: Mapping[str, str | None] | None = None) -> DataFrame:
    return map_columns(df, SAMPLE_COLUMNS, chosen)


def map_macrophyte_columns(df: DataFrame, chosen: Mapping[str, str | None] | None = None) -> DataFrame:
    """Also puts the ``IL_`` prefix on water bodies and names the date ``start_date``."""
    from ..functions.dates import to_date_value

    mapped = map_columns(df, MACROPHYTE_COLUMNS, chosen)
    prefixed = F.when(F.col("AUID").contains("IL_"), F.col("AUID")).otherwise(
        F.concat(F.lit("IL_"), F.col("AUID"))
    )
    return mapped.select(
        prefixed.alias("AUID"),
        to_date_value(mapped, "collection_date_id").alias("start_date"),
        "coverage",
    )
