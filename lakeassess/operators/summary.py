"""Exceedances over all acute checks, and a preview."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import LIMIT_COLUMNS

DROPPED = [*LIMIT_COLUMNS, "data_usability", "hardness"]

# Two rows are the same finding when these agree: the sample, its water body and
# reported depth, and the standard it was held against. All other shared columns
# follow from them.
FINDING = ["row_id", "AUID", "sample_depth", "acute_standard", "quotient"]


def exceedance_summary(
    acute: DataFrame, dependent: DataFrame, ammonia: DataFrame, sulfate: DataFrame
) -> DataFrame:
    """Exceedances of the four acute checks in one table.

    A finding made by two checks is one row with the columns of both; a column
    its check lacks is NULL. Each check is filtered before it is combined, in one
    shuffle.
    """
    tables = [
        t.where(F.col("standard_violation") == "EXCEEDANCE").drop(*DROPPED)
        for t in (acute, dependent, ammonia, sulfate)
    ]
    tagged = [t.withColumn("__table", F.lit(i)) for i, t in enumerate(tables)]
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    columns = [c for c in together.columns if c != "__table"]
    others = [c for c in columns if c not in FINDING]
    # Findings a check makes several times stay apart. Numbering and merging both
    # use the partitioning of this one exchange.
    own = Window.partitionBy(*FINDING, "__table").orderBy("standard_violation")
    numbered = together.repartition(*FINDING).withColumn("__number", F.row_number().over(own))
    merged = numbered.groupBy(*FINDING, "__number").agg(*[F.first(c, ignorenulls=True).alias(c) for c in others])
    return merged.select(*columns)


def preview(df: DataFrame, rows: int = 6) -> DataFrame:
    """First rows in input order."""
    return df.orderBy("row_id").limit(rows)
