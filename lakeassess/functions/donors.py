"""Fill missing values of a visit from its few known ones, without ordering all rows.

The rows that know a value, its donors, are few next to the rows that want one. Each
visit's donors become one sorted array, joined to the visit's rows, and every row
finds its donor by halving. Rows are neither sorted nor framed by a window, so a
visit with a third of all rows is an ordinary skewed join, which adaptive execution
splits. Where a visit has more donors than one array should hold, they are cut into
consecutive blocks of bounded size and the block joins the key.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ROW_ID
from ..sources.storage import keep
from .missing import matching_join

#: Most donors of one array: two to the power of this.
BLOCK_BITS = 14


def _cuts(donors: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """Of each crowded visit, the first ``row_id`` of every block of its donors.

    Donors get places in the order of a range exchange, so no task orders a visit
    alone; the array has one entry per block.
    """
    crowded = donors.groupBy(*keys).count().where(F.col("count") > 1 << bits).select(*keys)
    order = [*keys, ROW_ID]
    placed = matching_join(donors, crowded, keys, "left_semi").repartitionByRange(*order).sortWithinPartitions(*order)
    block = F.shiftright(F.monotonically_increasing_id(), bits)
    first = placed.select(*order, block.alias("__part")).groupBy(*keys, "__part").agg(F.min(ROW_ID).alias("__first"))
    return first.groupBy(*keys).agg(F.sort_array(F.collect_list("__first")).alias("__cuts"))


def _count_up_to(donors: Column, row_id: Column) -> Column:
    """Donors whose ``row_id`` is at most a row's own."""
    steps = F.sequence(F.ceil(F.log2(F.size(donors) + 1)).cast("int"), F.lit(0), F.lit(-1))

    def further(at: Column, k: Column) -> Column:
        to = at + F.pow(F.lit(2), k).cast("int")
        return F.when(F.get(donors, to - 1)[ROW_ID] <= row_id, to).otherwise(at)

    return F.aggregate(steps, F.lit(0), further)


def _lists(donors: DataFrame, keys: list[str], names: list[str], marks: Iterable[str] = ()) -> DataFrame:
    """One row per group: a sorted array of the donors of each name, and the marks."""

    def known(name: str) -> Column:
        each = F.when(F.col(name).isNotNull(), F.struct(F.col(ROW_ID), F.col(name).alias("value")))
        return F.sort_array(F.collect_list(each)).alias(f"__own_{name}")

    return donors.groupBy(*keys).agg(*[known(n) for n in names], *[F.some(n).alias(n) for n in marks])


def _take(rows: DataFrame, name: str) -> DataFrame:
    """Fill ``name`` from the row's array of donors, and drop that."""
    own = F.col(f"__own_{name}")
    at = F.when(F.size(own) == 1, F.lit(0)).otherwise(F.greatest(_count_up_to(own, F.col(ROW_ID)) - 1, F.lit(0)))
    return rows.withColumn(name, F.coalesce(name, F.get(own, at)["value"])).drop(own)


def fill_all_from_donors(
    df: DataFrame,
    keys: list[str],
    known: dict[str, Column],
    marks: dict[str, Column] | None = None,
    donating: Column | None = None,
    bits: int = BLOCK_BITS,
) -> DataFrame:
    """Add each name of ``known``: its own value, or else the last one before the row in
    the group of ``keys``, or else the first one after it; order is that of ``row_id``.

    ``marks`` adds whether some donor of the group meets a condition, from the same record
    of the group; NULL where it has none. Donors are the rows of ``donating``, by default those that
    know any of the values. Null keys form groups. Groups without a known value stay
    without. Rows of one ``row_id`` may take each other's value.
    """
    names, marks = list(known), marks or {}
    rows = df.withColumns(known)
    if donating is None:
        donating = reduce(lambda a, b: a | b, [F.col(n).isNotNull() for n in names])
    met = [c.alias(n) for n, c in marks.items()]
    donors = keep(rows.where(donating).select(*keys, ROW_ID, *names, *met), "donors")
    sizes = donors.groupBy(*keys).agg(*[F.count(n).alias(n) for n in names])
    crowded = sizes.agg(*[F.max(n).alias(n) for n in names]).head()
    plain = [n for n in names if (crowded[n] or 0) <= 1 << bits]
    if plain or marks:
        rows = matching_join(rows, _lists(donors, keys, plain, marks), keys, "left")
    for name in names:
        if name in plain:
            rows = _take(rows, name)
        else:
            rows = _take_from_blocks(rows, donors.where(F.col(name).isNotNull()).select(*keys, ROW_ID, name), keys, name, bits)
    return rows


def _take_from_blocks(rows: DataFrame, donors: DataFrame, keys: list[str], name: str, bits: int) -> DataFrame:
    """Fill ``name`` where a group has more donors than one array should hold."""
    cuts = keep(_cuts(donors, keys, bits), "donor-cuts")
    # A row before all donors looks into the first block.
    block = F.coalesce(F.greatest(F.size(F.filter("__cuts", lambda c: c <= F.col(ROW_ID))), F.lit(1)), F.lit(1))
    rows, donors = (matching_join(d, cuts, keys, "left").withColumn("__block", block).drop("__cuts") for d in (rows, donors))
    on = [*keys, "__block"]
    return _take(matching_join(rows, _lists(donors, on, [name]), on, "left"), name).drop("__block")


def fill_from_donors(df: DataFrame, keys: list[str], known: Column, name: str, bits: int = BLOCK_BITS) -> DataFrame:
    """Add ``name`` alone, by the rule of ``fill_all_from_donors``."""
    return fill_all_from_donors(df, keys, {name: known}, bits=bits)
