"""Exact median per group without holding a group in one task."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import keep
from .missing import matching_join

BUCKETS_PER_LOG = 65536.0
#: Most distinct values of a group that one task ranks.
RANKED = 1 << 16
#: Parts a crowded bucket is cut into, again and again.
PARTS = 4096


def _narrowed(counted: DataFrame, crowded: DataFrame, keys: list[str], value: str, carried: list[str], ranked: int) -> DataFrame:
    """Ranges of values around the middle ranks of crowded buckets, of at most ``ranked``
    distinct values each.

    Every round cuts each crowded range into equal parts between its smallest and
    largest value, counts them, and goes on with those the middle ranks fall into.
    The two ends never share a part, so every round narrows.
    """
    number, done = F.col(value), None
    while True:
        inside = matching_join(counted, crowded, [*keys, "__bucket"], "inner").where(
            number.between(F.col("__first"), F.col("__last"))
        )
        share = (number - F.col("__first")) / (F.col("__last") - F.col("__first"))
        cut = [*keys, "__bucket", "__first"]
        parts = inside.groupBy(*cut, F.floor(share * PARTS).alias("__part")).agg(
            F.sum("__n").alias("__n"),
            F.count(value).alias("__distinct"),
            F.min(value).alias("__from"),
            F.max(value).alias("__last"),
            *[F.max(c).alias(c) for c in carried],
        )
        reached = F.col("__below") + F.sum("__n").over(Window.partitionBy(*cut).orderBy("__part"))
        found = keep(
            parts.withColumn("__reached", reached)
            .where((F.col("__reached") >= F.col("__low")) & (F.col("__reached") - F.col("__n") < F.col("__high")))
            .withColumns({"__below": F.col("__reached") - F.col("__n"), "__first": F.col("__from")})
            .select(*keys, "__bucket", "__first", "__last", "__distinct", *carried),
            "median-ranges",
        )
        calm = found.where(F.col("__distinct") <= ranked)
        done = calm if done is None else done.unionByName(calm)
        crowded = found.where(F.col("__distinct") > ranked)
        if crowded.isEmpty():
            return done


def exact_median(
    df: DataFrame,
    keys: list[str],
    value: str,
    name: str,
    sums: Mapping[str, Column] | None = None,
    ranked: int = RANKED,
) -> DataFrame:
    """Median of the non-missing values of double column ``value`` in each group.

    ``sums`` are further aggregates that add up (counts and sums), computed on
    the way. A group without values has a NULL median.

    Equal values are counted first (map-side combined). Counts per coarse bucket
    tell which bucket holds the middle; only that bucket's distinct values are
    then ranked. The bucket never decreases as the value grows, so no group is
    sorted as a whole: the first window sees one row per bucket, the second the
    distinct values of one bucket. A bucket of more than ``ranked`` distinct values
    (at least 2) is first narrowed to a range that holds no more.
    """
    sums = dict(sums or {})
    number = F.col(value)
    bucket = F.floor(F.signum(number) * F.log1p(F.abs(number)) * F.lit(BUCKETS_PER_LOG))
    # Written once: the buckets and the ranks both start from the counts.
    counted = keep(
        df.groupBy(*keys, value)
        .agg(F.count(value).alias("__n"), *[c.alias(n) for n, c in sums.items()])
        .withColumn("__bucket", bucket),
        "median-counts",
    )
    by_bucket = Window.partitionBy(*keys).orderBy(F.col("__bucket").asc_nulls_first())
    whole = Window.partitionBy(*keys)
    total = F.sum("__n").over(whole)
    middle = (
        counted.groupBy(*keys, "__bucket")
        .agg(
            *[F.sum(c).alias(c) for c in ("__n", *sums)],
            F.count(value).alias("__distinct"),
            F.min(value).alias("__first"),
            F.max(value).alias("__last"),
        )
        .withColumns(
            {
                "__reached": F.sum("__n").over(by_bucket),
                "__low": F.floor((total + 1) / 2),
                "__high": F.floor(total / 2) + 1,
                **{n: F.sum(n).over(whole) for n in sums},
            }
        )
        # The buckets holding the two middle ranks; the missing values' own row
        # stands in for a group that has no others.
        .where(
            ((F.col("__reached") >= F.col("__low")) & (F.col("__reached") - F.col("__n") < F.col("__high")))
            & (F.col("__bucket").isNotNull() | (F.col("__low") == 0))
        )
        .withColumn("__below", F.col("__reached") - F.col("__n"))
    )
    carried = ["__low", "__high", "__below", *sums]
    middle = keep(middle.select(*keys, "__bucket", "__first", "__last", "__distinct", *carried), "median-buckets")
    values = counted.select(*keys, value, "__n", "__bucket")
    crowded = middle.where(F.col("__distinct") > ranked)
    if not crowded.isEmpty():
        narrow = _narrowed(values, crowded, keys, value, carried, ranked)
        middle = middle.where(F.col("__distinct") <= ranked).unionByName(narrow)
    in_range = Window.partitionBy(*keys, "__bucket", "__first").orderBy(value)
    ranks = (
        matching_join(values, middle, [*keys, "__bucket"], "inner")
        .where(number.isNull() | number.between(F.col("__first"), F.col("__last")))
        .withColumn("__rank", F.col("__below") + F.sum("__n").over(in_range))
    )
    low = F.min(F.when(F.col("__rank") >= F.col("__low"), number))
    high = F.min(F.when(F.col("__rank") >= F.col("__high"), number))
    return ranks.groupBy(*keys).agg(
        ((low + high) / 2).alias(name), *[F.max(n).alias(n) for n in sums]
    )
