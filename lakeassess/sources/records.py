"""Records of CSV files whose quoted cells may run over several lines.

Files are read line by line in parallel blocks, so a line does not know whether a
quoted cell is open where it begins. What a line does to that state is one of four
things: keep it, close it, open it, turn it over. Within a block the state before a
line follows from the last line that closed or opened and the turns since. A block
as a whole does one of the four as well, so the state at its beginning follows from
the blocks before it, from a table of one row per block.

Text is neither shuffled nor written for it: the task that reads a block joins its lines
to records, batch by batch. Only the first and the last record of a block, which may go on
in its neighbours, are put together by an exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ROW_ID
from .storage import keep

#: Most lines of one record: beyond it a quote was never closed.
RECORD_LINES = 100_000

# A quoted text without its first quote; cells that are complete.
_INSIDE = '[^"]*+(?:""[^"]*+)*+'
_CELLS = f'^(?:(?:"{_INSIDE}"[^,]*+|[^",][^,]*+)?+,)*+'
_OPEN_AT_END = f'{_CELLS}"{_INSIDE}$'
_TO_CLOSE = f'^{_INSIDE}"[^,]*+'

# What a task reads in one go: a block of a file, or the part of it that the task holds.
PIECE = ["__file", "__block", "__part"]


def opens(line: Column) -> Column:
    """Whether a line that begins outside a quoted cell ends inside one."""
    return F.coalesce(line.contains('"') & line.rlike(_OPEN_AT_END), F.lit(False))


def stays_open(line: Column) -> Column:
    """Whether a line that begins inside a quoted cell ends inside one."""
    closed = F.concat(F.lit("x"), F.regexp_replace(line, _TO_CLOSE, ""))
    return F.when(line.contains('"') & line.rlike(_TO_CLOSE), closed.rlike(_OPEN_AT_END)).otherwise(True)


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold lines of one piece each."""
    keys = [batch.column(name).to_numpy(zero_copy_only=False) for name in PIECE]
    changes = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    cuts = [0, *(np.flatnonzero(changes) + 1).tolist(), batch.num_rows]
    for start, stop in zip(cuts, cuts[1:]):
        if stop > start:
            yield batch.slice(start, stop - start)


def _after(batch: pa.RecordBatch, inside: bool) -> np.ndarray:
    """The state after each line, of lines that begin in the state ``inside``."""
    opened = batch.column("__opens").to_numpy(zero_copy_only=False).astype(bool)
    stays = batch.column("__stays").to_numpy(zero_copy_only=False).astype(bool)
    turns = np.cumsum(opened & ~stays)
    last = np.maximum.accumulate(np.where(opened == stays, np.arange(len(turns)), -1))
    fixed = last >= 0
    state = np.where(fixed, opened[last], inside)
    return state ^ ((turns - np.where(fixed, turns[last], 0)) % 2 == 1)


def _key(batch: pa.RecordBatch) -> tuple:
    return tuple(batch.column(name)[0].as_py() for name in PIECE)


def _starts(after: np.ndarray, inside: bool) -> np.ndarray:
    """Places of the lines that begin a record."""
    return np.flatnonzero(~np.concatenate([[inside], after[:-1]]))


# A piece by the state it begins in, 0 outside and 1 inside a quoted cell: the state it ends
# in, and the lines that begin its first and its last record.
_SUMMARY = "first bigint, " + ", ".join(f"ends_{s} boolean, first_{s} bigint, last_{s} bigint" for s in (0, 1))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, row, schema = None, {}, None
    for batch in batches:
        for part in _pieces(batch):
            if _key(part) != key:
                if row:
                    yield pa.RecordBatch.from_pylist([row], schema=schema)
                key, ids = _key(part), pa.int64()
                own = [("first", ids)] + [(f"{n}_{s}", t) for s in "01" for n, t in (("ends", pa.bool_()), ("first", ids), ("last", ids))]
                schema = pa.schema([*[part.schema.field(n) for n in PIECE], *[pa.field(n, t) for n, t in own]])
                row = dict(zip(PIECE, key), first=part.column(ROW_ID)[0].as_py(), ends_0=False, ends_1=True)
            for s in "01":
                after = _after(part, row[f"ends_{s}"])
                starts = _starts(after, row[f"ends_{s}"])
                if len(starts):
                    row.setdefault(f"first_{s}", part.column(ROW_ID)[int(starts[0])].as_py())
                    row[f"last_{s}"] = part.column(ROW_ID)[int(starts[-1])].as_py()
                row[f"ends_{s}"] = bool(after[-1])
    if row:
        yield pa.RecordBatch.from_pylist([row], schema=schema)


def _whole(batches: Iterator[pa.RecordBatch], names: list[str], most: int) -> Iterator[pa.RecordBatch]:
    """The records that begin and end in one piece; no more is held than the last one begun."""
    key, inside, held = None, False, []

    def bounded(lines: int) -> None:
        if lines > most:
            raise ValueError("A quoted cell is never closed")

    def joined(first: pa.RecordBatch, values: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([values if n == "value" else first.column(n) for n in names], names=names)

    def last() -> pa.RecordBatch:
        text = "\n".join(v for b in held for v in b.column("value").to_pylist())
        return joined(held[0].slice(0, 1), pa.array([text], held[0].column("value").type))

    for batch in batches:
        for part in _pieces(batch):
            if _key(part) != key:
                if held and not inside:
                    yield last()
                key, inside, held = _key(part), part.column("__begins")[0].as_py(), []
                if inside is None:
                    raise ValueError("The files were split in another way when read again")
            after = _after(part, inside)
            starts, inside = _starts(after, inside), bool(after[-1])
            head = int(starts[0]) if len(starts) else part.num_rows
            if held and head:
                held.append(part.slice(0, head))
                bounded(sum(b.num_rows for b in held))
            if not len(starts):
                continue
            if held:
                yield last()
            # The last record may go on in the next batch or the next piece.
            bounds = starts if inside else np.append(starts, part.num_rows)
            held = [part.slice(int(bounds[-1]))] if inside else []
            bounded(np.diff(np.append(starts, part.num_rows)).max())
            if len(bounds) > 1:
                values = part.column("value").slice(head, int(bounds[-1]) - head)
                lists = pa.ListArray.from_arrays(pa.array(bounds - head, pa.int32()), values)
                yield joined(part.take(pa.array(bounds[:-1])), pc.binary_join(lists, "\n"))
    if held and not inside:
        yield last()


def records(lines: DataFrame) -> DataFrame:
    """Join lines to records. ``lines`` has value, ``row_id`` rising along each file,
    ``__file`` and ``__block``, the place of the line's block in its file. The lines of a
    block follow each other in a partition.

    A record takes the ``row_id`` and the other columns of its first line. One of more
    than ``RECORD_LINES`` lines raises: its quote was never closed.
    """
    most, names = RECORD_LINES, lines.columns
    parts = lines.withColumn("__part", F.spark_partition_id())
    stated = parts.withColumns({"__opens": opens(F.col("value")), "__stays": stays_open(F.col("value"))})
    keys = ", ".join(f"`{c}` {kind}" for c, kind in parts.dtypes if c in PIECE)
    narrow = stated.select(*PIECE, ROW_ID, "__opens", "__stays")
    pieces = keep(narrow.mapInArrow(_summaries, f"{keys}, {_SUMMARY}"), "csv-pieces")

    # A piece begins in the state of the last one before it that fixes it, turned by those since.
    before = Window.partitionBy("__file").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("turn", (F.col("ends_0") & ~F.col("ends_1")).cast("int"))
    pieces = pieces.withColumn("turns", F.coalesce(F.sum("turn").over(before), F.lit(0)))
    fixes = F.when(F.col("ends_0") == F.col("ends_1"), F.struct(F.col("ends_0").alias("open"), "turns"))
    pieces = pieces.withColumn("fixed", F.last(fixes, ignorenulls=True).over(before))
    since = F.col("turns") - F.coalesce("fixed.turns", F.lit(0))
    pieces = pieces.withColumn("__begins", F.coalesce("fixed.open", F.lit(False)) != (since % 2 == 1))
    pieces = pieces.withColumns({
        f"__{n}": F.when(F.col("__begins"), F.col(f"{n}_1")).otherwise(F.col(f"{n}_0")) for n in ("ends", "first", "last")
    })
    carried = F.last("__last", ignorenulls=True).over(before)
    pieces = pieces.select(*PIECE, "first", "__begins", "__ends", "__first", "__last", carried.alias("__carried"))

    # One row per block, which the driver has planned one by one. Without the hint an
    # exchange may part the lines of a block.
    placed = stated.join(F.broadcast(pieces.select(*PIECE, "__begins")), PIECE, "left")
    kinds = ", ".join(f"`{c}` {kind}" for c, kind in lines.dtypes)
    whole = placed.mapInArrow(lambda batches: _whole(batches, names, most), kinds)

    # Lines of a record begun in an earlier piece, or going on in a later one.
    row, borders = F.col(ROW_ID), parts.join(F.broadcast(pieces.where("__begins or __ends")), PIECE)
    earlier = F.col("__begins") & (F.col("__first").isNull() | (row < F.col("__first")))
    later = F.col("__ends") & (row >= F.col("__last"))
    borders = borders.withColumn("__record", F.when(earlier, F.col("__carried")).when(later, F.col("__last")))
    runaway = row - F.when(earlier, F.col("first")).otherwise(F.col("__last")) >= most
    never = F.raise_error(F.lit("A quoted cell is never closed"))
    borders = borders.where("__record is not null").withColumn("value", F.when(runaway, never).otherwise(F.col("value")))
    others = [c for c in names if c not in ("value", "__file", ROW_ID)]
    texts = F.array_sort(F.collect_list(F.struct(ROW_ID, "value")))
    crossing = borders.groupBy("__file", "__record").agg(
        F.when(F.count(F.lit(1)) > most, never).otherwise(F.array_join(F.transform(texts, lambda t: t["value"]), "\n")).alias("value"),
        *[F.min_by(c, ROW_ID).alias(c) for c in others],
    )
    return whole.unionByName(crossing.withColumnRenamed("__record", ROW_ID).select(*names))
