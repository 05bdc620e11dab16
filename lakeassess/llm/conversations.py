"""Repair of conversation structure by run-length dynamic programming.

A row becomes a symbol: its role's initial and its fault. Equal consecutive
symbols collapse to runs. A symbol is a min-plus matrix over the four states of
the role grammar ``(s?(ua)+)?``; a run advances through cached binary powers of
its matrix, and walking forward again unrolls the choices for the audit.

Matrices of consecutive rows multiply, so a conversation of any length is cut
into segments of bounded length: each gives its matrix, a backward pass over
the segments' matrices gives the cost of what follows each, every segment then
unrolls for all four states it may start in, and a forward pass picks. Rows move
as keys and hashes for this; texts move once, to be put together again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import stored

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
REROLE = INSERT = TRUNCATED = 3
DELETE = 4
#: Rows of a segment: two to the power of this.
SEGMENT_BITS = 16

#: States: nothing written, after system, after user, after assistant.
STATES = range(4)
_NEXT = (2, 2, 3, 2)  # state after writing the role that must follow
_EXPECTED = ("user", "user", "assistant", "user")
_INFINITE = 1 << 60
#: Cost of ending in each state: an open pair is closed by inserts.
FINISH = (0, 2 * INSERT, INSERT, 0)
_TAIL = ("", "II", "I", "")
#: A symbol is 2 * role + truncated, or this one, which must go.
GONE = 8
_ROLES = "sua"

Vector = tuple[int, ...]


def symbol(role: str, truncated: bool) -> int:
    at = _ROLES.find(role[:1]) if role else -1
    return 2 * (at if at >= 0 else 3) + bool(truncated)


@lru_cache(None)
def options(state: int, of: int) -> tuple[tuple[str, int, int], ...]:
    """(letter, cost, next state) of what a row can become, letters in order."""
    found = [("D", DELETE, state)]
    if of != GONE:
        role, more = of // 2, TRUNCATED * (of % 2)
        to = {0: 1 if state == 0 else None, 1: 2 if _NEXT[state] == 2 else None, 2: 3 if _NEXT[state] == 3 else None}.get(role)
        if to is not None:
            found.append(("K", more, to))
        if to != _NEXT[state]:
            found.append(("R", REROLE + more, _NEXT[state]))
    return tuple(found)


def _times(matrix: tuple[Vector, ...], vector: Vector) -> Vector:
    return tuple(min(min(a + b for a, b in zip(row, vector)), _INFINITE) for row in matrix)


@lru_cache(None)
def power(of: int, k: int) -> tuple[Vector, ...]:
    """Min-plus matrix of 2^k rows of one symbol, inserts before each row included."""
    if k:
        half = power(of, k - 1)
        columns = [_times(half, tuple(row[q] for row in half)) for q in STATES]
        return tuple(tuple(columns[q][p] for q in STATES) for p in STATES)
    rows = []
    for state in STATES:
        row, at, spent = [_INFINITE] * 4, state, 0
        for _ in STATES:
            for _, cost, to in options(at, of):
                row[to] = min(row[to], spent + cost)
            at, spent = _NEXT[at], spent + INSERT
        rows.append(tuple(row))
    return tuple(rows)


def _level(vector: Vector) -> tuple[Vector, int]:
    """A vector as differences to its least value, of which there are few."""
    least = min(vector)
    return tuple(v - least if v < _INFINITE else _INFINITE for v in vector), least


@lru_cache(1 << 18)
def _advance(of: int, length: int, after: Vector) -> tuple[Vector, int]:
    for k in range(length.bit_length()):
        if length >> k & 1:
            after = _times(power(of, k), after)
    return _level(after)


def before(runs: list[tuple[int, int]], after: Vector) -> Vector:
    """Cost to go before runs of (symbol, length), given the cost after them."""
    level, base = _level(after)
    for of, length in reversed(runs):
        level, more = _advance(of, length, level)
        base += more
    return tuple(v + base if v < _INFINITE else _INFINITE for v in level)


@lru_cache(1 << 16)
def _choice(of: int, state: int, after: Vector) -> tuple[str, int]:
    """ASCII-least letters of one row at least cost, and the state behind it."""
    here, letters = _times(power(of, 0), after), ""
    while True:
        best = here[state]
        for letter, cost, to in options(state, of):
            if letter < "I" and cost + after[to] == best:
                return letters + letter, to
        if INSERT + here[_NEXT[state]] == best:
            letters, state = letters + "I", _NEXT[state]
            continue
        for letter, cost, to in options(state, of):
            if cost + after[to] == best:
                return letters + letter, to


def unroll(runs: list[tuple[int, int]], state: int, after: Vector) -> tuple[str, int]:
    """Letters for all rows of the runs, and the state behind them."""
    level, ends = _level(after)[0], []
    for of, length in reversed(runs):
        ends.append(level)
        level = _advance(of, length, level)[0]
    letters = []
    for (of, length), end in zip(runs, reversed(ends)):
        if of == GONE:  # nothing can be won by inserting before a row that goes
            letters.append("D" * length)
            continue
        steps = [end]
        for _ in range(length - 1):
            steps.append(_advance(of, 1, steps[-1])[0])
        for level in reversed(steps):
            some, state = _choice(of, state, level)
            letters.append(some)
    return "".join(letters), state


def damage(conversations: DataFrame) -> DataFrame:
    """Faults planted by a checksum of ``conv_id:turn``, nulls read as one space.

    Of 20 remainders 0 drops the row (``copies`` 0), 1 empties its text, 2 removes
    its ``.!?``, 3 repeats it (``copies`` 2), 4 makes its role user.
    """
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")))
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = rows.withColumn("__what", F.crc32(key) % 20)
    what = F.col("__what")
    return rows.select(
        "conv_id",
        "turn",
        F.when(what == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(what == 1, "").when(what == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(what == 0, 0).when(what == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _checked(rows: DataFrame) -> DataFrame:
    """Rows with ``digest`` of the text, ``blank`` and ``truncated``; nulls are one space."""
    copies = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    rows = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        copies.alias("copies"),
    )
    bare = F.rtrim("text", F.lit(SPACES))
    return rows.select(
        "*",
        F.substring(F.unhex(F.sha2("text", 256)), 1, 16).alias("digest"),
        (bare == "").alias("blank"),
        (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("truncated"),
    )


def _in_order() -> list[Column]:
    return [F.asc_nulls_first(c) for c in ("turn", "role", "digest")]


_SEGMENT = (
    "conv_id bigint, segment bigint, first string, last string, illegal bigint, low bigint, high bigint, turns bigint, "
    "blank bigint, duplicate bigint, truncated bigint, runs array<bigint>, matrix array<bigint>"
)


def _groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Consecutive rows of equal keys, as a stream; read each group before the next."""
    rows = (row for batch in batches for row in batch.to_pylist())
    row = next(rows, None)
    while row is not None:
        key = tuple(row[k] for k in keys)

        def group() -> Iterator[dict]:
            nonlocal row
            while row is not None and tuple(row[k] for k in keys) == key:
                yield row
                row = next(rows, None)

        own = group()
        yield key, own
        for _ in own:
            pass


def _legal(first: str, second: str) -> bool:
    return first + second in ("su", "ua", "au")


def _segments(batches: Iterator[pa.RecordBatch], schema: str = _SEGMENT) -> Iterator[pa.RecordBatch]:
    """A row per (conv_id, segment): counts, runs and min-plus matrix.

    Rows come by place, each preceded by a mark where it is the first of its role
    and text.
    """
    held: list[tuple] = []
    for (conv, segment), rows in _groups(batches, "conv_id", "segment"):
        runs: list[list[int]] = []
        first = last = low = high = None
        illegal = turns = blank = duplicate = truncated = 0
        marked = None

        def put(of: int, count: int) -> None:
            if not count:
                return
            if runs and runs[-1][0] == of:
                runs[-1][1] += count
            else:
                runs.append([of, count])

        for row in rows:
            if row["role"] is None:
                marked = row["place"]
                continue
            copies, initial, turn = row["copies"], row["role"][:1], row["turn"]
            if first is None:
                first = initial
            else:
                illegal += not _legal(last, initial)
            illegal += (copies - 1) * (not _legal(initial, initial))
            last = initial
            if turn is not None:
                low = turn if low is None else low
                turns += turn != high
                high = turn
            new = marked == row["place"]
            if row["blank"]:
                blank += copies
                put(GONE, copies)
            else:
                duplicate += copies - new
                truncated += bool(new and row["truncated"])
                put(symbol(initial, row["truncated"]), int(new))
                put(GONE, copies - new)
        columns = [before(runs, tuple(0 if p == q else _INFINITE for p in STATES)) for q in STATES]
        packed = [length * 16 + of for of, length in runs]
        held.append((conv, segment, first, last, illegal, low, high, turns, blank, duplicate, truncated, packed, [c for v in columns for c in v]))
        if len(held) == 4096:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


_TYPES = {"bigint": pa.int64(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "int": pa.int32()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [p.split() for p in schema.split(", ")]
    columns = [pa.array(values, _TYPES[kind]) for values, (_, kind) in zip(zip(*rows), fields)]
    return pa.RecordBatch.from_arrays(columns, [name for name, _ in fields])


_AFTER = "conv_id bigint, segment bigint, runs array<bigint>, after array<bigint>, part string"
_TOTALS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of a conversation, last first: the cost after each, and at the first
    segment the conversation's totals."""
    for (conv,), rows in _groups(batches, "conv_id"):
        after, later, held = FINISH, None, None
        blank = duplicate = truncated = illegal = turns = 0
        low = high = None
        for row in rows:
            if held:
                yield _batch([(*held, None)], _AFTER)
            held = (conv, row["segment"], row["runs"], list(after))
            matrix = [row["matrix"][4 * q : 4 * q + 4] for q in STATES]
            after = tuple(min(matrix[q][p] + after[q] for q in STATES) for p in STATES)
            blank, duplicate, truncated = blank + row["blank"], duplicate + row["duplicate"], truncated + row["truncated"]
            illegal += row["illegal"] + (later is not None and not _legal(row["last"], later["first"]))
            turns += row["turns"]
            if row["turns"]:
                turns -= low == row["high"]  # the turn goes on in the segment behind
                low, high = row["low"], row["high"] if high is None else high
            later = row
        gaps = high - low + 1 - turns if turns else 0
        totals = (gaps, blank, duplicate, truncated, illegal, after[0])
        yield _batch([(*held, ",".join(map(str, totals)))], _AFTER)


_PATHS = "conv_id bigint, segment bigint, ends array<bigint>, audits array<string>, part string"


def _unrolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and end state of each segment for each state it may start in."""
    for batch in batches:
        held = []
        for row in batch.to_pylist():
            runs = [(r % 16, r // 16) for r in row["runs"]]
            # The first segment starts with nothing written.
            starts = [0] if row["part"] is not None else STATES
            paths = [unroll(runs, state, tuple(row["after"])) for state in starts]
            held.append((row["conv_id"], row["segment"], [p[1] for p in paths], [p[0] for p in paths], row["part"]))
        if held:
            yield _batch(held, _PATHS)


_PLAN = "conv_id bigint, audit string, " + ", ".join(f"{n} bigint" for n in _TOTALS)


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = []
    for (conv,), rows in _groups(batches, "conv_id"):
        state, audit, totals = 0, [], []
        for row in rows:
            if row["part"] is not None:
                totals = [int(n) for n in row["part"].split(",")]
            audit.append(row["audits"][state])
            state = row["ends"][state]
        held.append((conv, "".join(audit) + _TAIL[state], *totals))
        if len(held) == 4096:
            yield _batch(held, _PLAN)
            held = []
    if held:
        yield _batch(held, _PLAN)


def plan_repairs(rows: DataFrame) -> DataFrame:
    """A row per conv_id: audit, gaps, blank, duplicate, truncated, illegal, cost.

    ``rows`` has conv_id, turn, role, text and maybe ``copies``, how often a row
    stands there. Rows go by turn, nulls first; rows of one turn by role and a
    digest of the text. Null role and text are one space; null conv_ids form a
    conversation. Equal rows are combined before they move.
    """
    keys = ["conv_id", "turn", "role", "digest"]
    compact = _checked(rows).where("copies > 0").groupBy(*keys, "blank", "truncated").agg(F.sum("copies").alias("copies"))
    placed = (
        compact.repartitionByRange(F.asc_nulls_first("conv_id"), *_in_order())
        .sortWithinPartitions(F.asc_nulls_first("conv_id"), *_in_order())
        .withColumn("place", F.monotonically_increasing_id())
    )
    placed = stored(placed, "placed")
    first = placed.groupBy("conv_id", "role", "digest").agg(F.min("place").alias("place")).select("conv_id", "place")
    both = placed.drop("digest").unionByName(first, allowMissingColumns=True).withColumn("segment", F.shiftright("place", SEGMENT_BITS))
    segments = (
        both.repartition("conv_id", "segment")
        .sortWithinPartitions("conv_id", "segment", "place", F.asc_nulls_first("role"))
        .mapInArrow(_segments, _SEGMENT)
    )
    after = segments.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("segment")).mapInArrow(_backward, _AFTER)
    paths = after.repartition("conv_id", "segment").mapInArrow(_unrolled, _PATHS)
    return paths.repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(_forward, _PLAN)


def _written(audit: str, rows: Iterator[dict]) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired conversation."""
    at = state = 0
    for row in rows:
        for _ in range(row["copies"]):
            while audit[at] == "I":
                yield _EXPECTED[state], ""
                at, state = at + 1, _NEXT[state]
            letter, at = audit[at], at + 1
            if letter == "R":
                yield _EXPECTED[state], row["text"]
                state = _NEXT[state]
            elif letter == "K":
                yield row["role"], row["text"]
                state = 1 + _ROLES.index(row["role"][0])
    for _ in audit[at:]:
        yield _EXPECTED[state], ""
        state = _NEXT[state]


def _with_plans(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Each conversation's plan and, behind it, its rows in order. Rows without
    copies are kept once, so that their conversation is known."""
    texts = _checked(rows).drop("blank", "truncated")
    both = texts.where("copies > 0").unionByName(texts.where("copies = 0").select("conv_id", "copies").distinct(), allowMissingColumns=True)
    both = both.unionByName(plans, allowMissingColumns=True)
    order = ["conv_id", F.asc_nulls_last("audit"), *_in_order()]
    return both.repartition("conv_id").sortWithinPartitions(*order)


_DIGEST = "conv_id bigint, " + ", ".join(f"{n} bigint" for n in _TOTALS) + ", audit string, repaired_sha256 string"


def digests(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Plans with the SHA-256 of each repaired conversation, rows as ``role:text``.

    A digest is taken over texts in order, so one task streams a conversation,
    holding one batch at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for (conv,), group in _groups(batches, "conv_id"):
            plan = next(group)
            own = (row for row in group if row["copies"])
            sha, between = hashlib.sha256(), ""
            if plan["audit"] is not None:
                for role, text in _written(plan["audit"], own):
                    sha.update(f"{between}{role}:{text}".encode())
                    between = "\n"
            held.append((conv, *(plan[n] or 0 for n in _TOTALS), plan["audit"] or "", sha.hexdigest()))
            if len(held) == 1024:
                yield _batch(held, _DIGEST)
                held = []
        if held:
            yield _batch(held, _DIGEST)

    return _with_plans(rows, plans).mapInArrow(run, _DIGEST)


_REPAIRED = "conv_id bigint, place bigint, role string, text string"


def repaired(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Rows (conv_id, place, role, text) of the repaired conversations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for (conv,), group in _groups(batches, "conv_id"):
            plan = next(group)
            own = (row for row in group if row["copies"])
            if plan["audit"] is not None:
                for place, (role, text) in enumerate(_written(plan["audit"], own)):
                    held.append((conv, place, role, text))
                    if len(held) == 1024:
                        yield _batch(held, _REPAIRED)
                        held = []
        if held:
            yield _batch(held, _REPAIRED)

    return _with_plans(rows, plans).mapInArrow(run, _REPAIRED)


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty tables give an empty result."""
    rows = damage(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return digests(rows, plan_repairs(rows))
