"""Ordered work inside groups that stays balanced when one site is huge.

A window over (site, ...) sends every row of a group to one task. That is fine
for ordinary sites and impossible for one that holds a third of all rows. So:

* ``find_hot_sites`` counts rows per site (one column scanned, map-side
  combined) and keeps the sites above a limit.
* Without hot sites, ``group_window`` is a plain window: one exchange.
* With hot sites, the input is written once, and groups of those sites are cut
  into consecutive segments of about the limit each. The segment number joins the
  partition key of an explicit exchange, so a hot group spreads over many tasks
  whatever partitioning an earlier join left. What a row needs from outside its
  segment (the reading before the first row, the last known value, a total over
  the group) comes from a table with one row per segment.

The number of segments follows the largest group. Cuts and edges are joined
without a hint: Spark broadcasts them if they measure small and shuffles them
otherwise.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.storage import keep
from .missing import matching_join, nulls_last

HOT_ROWS_CONF = "lakeassess.hotGroupRows"
HOT_ROWS_DEFAULT = 4_000_000

SEGMENT = "__segment"
BEYOND_LAST_DAY = 3_000_000  # later than any date Spark can hold, in days


@dataclass(frozen=True)
class HotSites:
    """Sites too large for one task. ``sites`` is empty for most data."""

    limit: int
    sites: tuple[str | None, ...] = ()
    site_column: str = "mlid"

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(s,) for s in self.sites], f"{self.site_column} string")


def hot_row_limit(spark: SparkSession) -> int:
    return int(spark.conf.get(HOT_ROWS_CONF, str(HOT_ROWS_DEFAULT)))


def find_hot_sites(samples: DataFrame, site_column: str = "mlid") -> HotSites:
    """Runs one narrow aggregate. Returns at most rows / limit names."""
    limit = hot_row_limit(samples.sparkSession)
    hot = samples.groupBy(site_column).count().where(F.col("count") > limit).select(site_column)
    return HotSites(limit, tuple(r[0] for r in hot.collect()), site_column)


def row_position() -> Column:
    """Sort position of rows ordered by ``row_id`` alone."""
    return F.col("row_id").cast("double")


def day_position(day: str = "start_date") -> Column:
    """Sort position of rows ordered by day, missing days last, then ``row_id``.

    ``row_id`` enters as a fraction of a day below 1, so position never
    decreases along the sort order.
    """
    number = F.coalesce(F.unix_date(day), F.lit(BEYOND_LAST_DAY)).cast("double")
    return number + F.col("row_id").cast("double") * F.lit(2.0**-63)


def depth_position(depth: str = "sample_depth") -> Column:
    """Sort position of rows ordered by depth, missing depths last."""
    return F.coalesce(F.col(depth), F.lit(float("inf")))


@dataclass(frozen=True)
class Total:
    """Aggregate over the whole group, built from per-segment parts.

    ``part`` runs over the rows, ``combine`` over the segments' parts.
    """

    part: Column
    combine: object = F.max


@dataclass(frozen=True)
class GroupSpec:
    """What to add to each row of a group.

    ``previous`` / ``following``: columns to take from the neighbouring row,
    added as ``previous_<name>`` / ``following_<name>``.
    ``fill``: columns whose missing values are filled from the last known value
    before the row, else from the first one after it.
    ``totals``: group aggregates by output name.
    """

    keys: list[str]
    order: list[str] = field(default_factory=list)
    position: Column | None = None
    previous: tuple[str, ...] = ()
    following: tuple[str, ...] = ()
    fill: tuple[str, ...] = ()
    totals: dict[str, Total] = field(default_factory=dict)


def group_window(df: DataFrame, spec: GroupSpec, hot: HotSites) -> DataFrame:
    """Add neighbours, filled values and totals to every row of ``df``."""
    if not hot.sites:
        return _finish(_local(df, spec, spec.keys), df.columns, spec)
    # Sizes, cuts, edges and rows all start from this one table.
    cut = _cut_hot_groups(keep(df, "hot-input"), spec, hot)
    edges = _segment_edges(cut, spec)
    local = _local(cut.repartition(*spec.keys, SEGMENT), spec, [*spec.keys, SEGMENT])
    merged = matching_join(local, edges, [*spec.keys, SEGMENT], "left")
    return _finish(merged, df.columns, spec, segmented=True)


def _local(df: DataFrame, spec: GroupSpec, keys: list[str]) -> DataFrame:
    """Plain windows over ``keys``. All share one exchange and one sort."""
    whole = Window.partitionBy(*keys)
    out: dict[str, Column] = {}
    if spec.order:
        ordered = whole.orderBy(*nulls_last(spec.order))
        so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        everything = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        if spec.previous:
            out["__previous"] = F.lag(F.struct(*spec.previous)).over(ordered)
        if spec.following:
            out["__following"] = F.lead(F.struct(*spec.following)).over(ordered)
        for name in spec.fill:
            # A row with no known value before it takes the first known value of
            # the group. (A current-row-to-end frame would be quadratic.)
            out[f"__before_{name}"] = F.last(name, ignorenulls=True).over(so_far)
            out[f"__first_{name}"] = F.first(name, ignorenulls=True).over(everything)
    for name, total in spec.totals.items():
        out[f"__total_{name}"] = total.part.over(whole)
    return df.withColumns(out)


def _cut_hot_groups(df: DataFrame, spec: GroupSpec, hot: HotSites) -> DataFrame:
    """Add the segment number: NULL in ordinary groups, 0.. in hot ones."""
    position = spec.position if spec.position is not None else row_position()
    hot_rows = matching_join(df, hot.frame(df.sparkSession), [hot.site_column], "left_semi")
    sizes = hot_rows.groupBy(*spec.keys).count().where(F.col("count") > hot.limit)
    largest = sizes.agg(F.max("count")).head()[0]
    if largest is None:
        return df.withColumn(SEGMENT, F.lit(None).cast("int"))
    most = math.ceil(largest / hot.limit)
    shares = F.expr("array(" + ", ".join(f"{i / most}D" for i in range(1, most)) + ")")
    sized = (
        hot_rows.groupBy(*spec.keys)
        .agg(
            F.count(F.lit(1)).alias("__rows"),
            F.percentile_approx(position, shares, 10 * most + 10_000).alias("__quantiles"),
        )
        .where(F.col("__rows") > hot.limit)
    )
    wanted = F.ceil(F.col("__rows") / F.lit(hot.limit)).cast("int")
    cuts = keep(
        sized.select(
            *spec.keys,
            F.array_distinct(
                F.transform(
                    F.sequence(F.lit(1), wanted - 1),
                    lambda k: F.element_at("__quantiles", F.greatest(F.lit(1), (k * most / wanted).cast("int"))),
                )
            ).alias("__cuts"),
        ),
        "hot-cuts",
    )
    joined = matching_join(df, cuts, spec.keys, "left")
    segment = F.when(
        F.col("__cuts").isNotNull(), F.size(F.filter("__cuts", lambda c: c < position))
    )
    return joined.withColumn(SEGMENT, segment).drop("__cuts")


def _segment_edges(cut: DataFrame, spec: GroupSpec) -> DataFrame:
    """One row per hot segment with what its rows need from the other segments."""
    hot_rows = cut.where(F.col(SEGMENT).isNotNull())
    # Structs compare with NULL first; the leading flag puts missing keys last.
    rank = F.struct(*[F.struct(F.isnull(c), F.col(c)) for c in spec.order]) if spec.order else None
    parts: dict[str, Column] = {"__n": F.count(F.lit(1))}
    if spec.previous:
        parts["__last_row"] = F.max_by(F.struct(*spec.previous), rank)
    if spec.following:
        parts["__first_row"] = F.min_by(F.struct(*spec.following), rank)
    for name in spec.fill:
        known = F.when(F.col(name).isNotNull(), rank)
        parts[f"__last_{name}"] = F.max_by(F.col(name), known)
        parts[f"__first_{name}"] = F.min_by(F.col(name), known)
    for name, total in spec.totals.items():
        parts[f"__part_{name}"] = total.part
    segments = hot_rows.groupBy(*spec.keys, SEGMENT).agg(*[c.alias(n) for n, c in parts.items()])

    whole = Window.partitionBy(*spec.keys)
    ordered = whole.orderBy(SEGMENT)
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    everything = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried: list[Column] = [F.lit(True).alias("__hot")]
    if spec.previous:
        carried.append(F.lag("__last_row").over(ordered).alias("__previous_edge"))
    if spec.following:
        carried.append(F.lead("__first_row").over(ordered).alias("__following_edge"))
    for name in spec.fill:
        carried.append(F.last(f"__last_{name}", ignorenulls=True).over(earlier).alias(f"__earlier_{name}"))
        carried.append(F.first(f"__first_{name}", ignorenulls=True).over(everything).alias(f"__any_{name}"))
    for name, total in spec.totals.items():
        carried.append(total.combine(f"__part_{name}").over(whole).alias(f"__all_{name}"))
    return segments.select(*spec.keys, SEGMENT, *carried)


def _finish(df: DataFrame, columns: list[str], spec: GroupSpec, segmented: bool = False) -> DataFrame:
    """Project the helper columns to the requested output."""
    out = {c: F.col(c) for c in columns}
    for name in spec.fill:
        sources = [f"__before_{name}"]
        sources += [f"__earlier_{name}", f"__any_{name}"] if segmented else []
        out[name] = F.coalesce(*sources, f"__first_{name}")
    for side, names in (("previous", spec.previous), ("following", spec.following)):
        row = F.col(f"__{side}") if names else None
        if names and segmented:
            row = F.coalesce(row, F.col(f"__{side}_edge"))
        for name in names:
            out[f"{side}_{name}"] = row[name]
    for name in spec.totals:
        local = F.col(f"__total_{name}")
        out[name] = F.when(F.col("__hot"), F.col(f"__all_{name}")).otherwise(local) if segmented else local
    return df.select(*[c.alias(n) for n, c in out.items()])
