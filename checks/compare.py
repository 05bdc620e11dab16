"""Run registered queries against their SQL and compare whole results.

    python -m checks.compare [folder] [query ...]

``HOT_ROWS=20`` treats every site above 20 rows as too large for one task, so the
segmented plans run on small data too.
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if os.path.exists(f"{sf_dir}/{name}.parquet"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, rows sorted by their text."""
    df = df[sorted(df.columns)].astype(object).where(df.notna(), None)
    for name in df.columns:
        df[name] = df[name].map(_plain)
    return df.sort_values(list(df.columns), key=lambda c: c.map(str)).reset_index(drop=True)


def _plain(value):
    if value is None:
        return None
    if hasattr(value, "isoformat"):
        return value.isoformat()[:10]
    if isinstance(value, bool) or isinstance(value, str):
        return value
    number = round(float(value), 6)
    return 0.0 if number == 0 else number


def differences(ours: pd.DataFrame, theirs: pd.DataFrame) -> str | None:
    """What differs, or None."""
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(set(ours.columns) ^ set(theirs.columns))}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    a, b = normal(ours), normal(theirs)
    unequal = (a != b) & ~(a.isna() & b.isna())
    if unequal.any().any():
        rows = unequal.any(axis=1)
        return f"{rows.sum()} rows differ in {list(unequal.columns[unequal.any()])}\n{a[rows].head(3)}\n{b[rows].head(3)}"
    return None


def main() -> int:
    from checks.oracle import ORACLE_SQL
    from checks.registry import QUERIES

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if os.environ.get("HOT_ROWS"):
        spark.conf.set("lakeassess.hotGroupRows", os.environ["HOT_ROWS"])
    con = connect(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        df = QUERIES[name](spark, sf_dir)
        ours = df.toPandas()
        took = time.time() - start
        try:
            theirs = con.execute(ORACLE_SQL[name])
            types = [str(d[1]) for d in theirs.description]
            columns = [d[0] for d in theirs.description]
            result = differences(ours, theirs.df())
            kinds = dict(zip(columns, types))
            spark_kinds = {f.name: f.dataType.simpleString() for f in df.schema}
            odd = {c: (spark_kinds[c], k) for c, k in kinds.items() if c in spark_kinds and not _same(spark_kinds[c], k)}
            if odd:
                result = f"{result or ''} types {odd}"
        except duckdb.Error as error:
            result = f"SQL: {error}"
        failed += result is not None
        print(f"{name}: {'ok' if result is None else result} ({len(ours)} rows, {took:.1f} s)", flush=True)
    return failed


def _same(spark_kind: str, sql_kind: str) -> bool:
    pairs = {"string": "VARCHAR", "double": "DOUBLE", "bigint": "BIGINT", "int": "INTEGER", "date": "DATE"}
    return pairs.get(spark_kind) == sql_kind


if __name__ == "__main__":
    sys.exit(main())
