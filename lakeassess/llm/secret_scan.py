"""Secret scans: fixed patterns, and character models of random strings.

Three patterns find declared secrets. Other long runs of key characters are
compared under two first-order Markov models of characters, one of random
strings, one of ordinary identifiers; a run whose log-likelihood ratio is high is
a secret too. Both models are counts of character pairs over the whole corpus:
random strings are the values the patterns found, ordinary ones all other runs of
12 characters or more that don't mix letters and digits. Runs that do are left
unlabelled.

All of it is native expressions: no Python runs on the executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds in order, and their patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
ASSIGN_LENGTH = 6
ACCESS_LENGTH = 20
HEX_LENGTH = 24

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{12,}"
MIXED = r"[A-Za-z].*[0-9]|[0-9].*[A-Za-z]"
#: Runs this long, of so many different characters, are scored.
SCORE_LENGTH = 20
SCORE_DISTINCT = 8
#: Least log-likelihood ratio of a secret, in nats: the odds against a run being one.
THRESHOLD = 10.0
#: Share of the uniform model mixed into each model.
UNIFORM_RANDOM = 0.5
UNIFORM_ORDINARY = 0.05
#: Pairs of the uniform model added to the counts after each character.
PSEUDO = 20

SPAN = "struct<start:int,kind:int,end:int>"
VALUED = "struct<start:int,kind:int,end:int,value:string>"
_NONE = "array()"
#: Matches taken together.
SLICE = 256


def _found(text: Column, pattern: str, shape, kind: str, present: str | None = None) -> Column:
    """Array of ``shape(match, start, end)`` for all matches that ``shape`` gives a value.

    Starts come from the lengths of what lies between matches. Appending to a list
    copies it, so matches are taken in slices, and the time of one text grows with
    its length. ``present`` is a quicker pattern every text with a wanted match has.
    """
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    empty = F.expr(_NONE).cast(f"array<{kind}>")

    def step(seen: Column, x: Column) -> Column:
        start = seen["at"] + F.char_length(x["0"])
        end = start + F.char_length(x["1"])
        value = shape(x["1"], start, end)
        out = F.when(value.isNotNull(), F.concat(seen["out"], F.array(value))).otherwise(seen["out"])
        return F.when(x["1"].isNull(), seen).otherwise(F.struct(end.alias("at"), out.alias("out")))

    pairs = F.transform(zipped, lambda z: F.struct(z["gap"].alias("0"), z["match"].alias("1")))

    def length(pair: Column) -> Column:
        return F.char_length(pair["0"]) + F.coalesce(F.char_length(pair["1"]), F.lit(0))

    def slices(all_: Column) -> Column:
        last = F.greatest(F.lit(0), F.floor((F.size(all_) - 1) / SLICE).cast("int"))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(all_, i * SLICE + 1, SLICE))

    def starts(parts: Column) -> Column:
        return F.aggregate(
            parts,
            F.struct(F.lit(0).alias("at"), F.expr(_NONE).cast("array<int>").alias("out")),
            lambda seen, part: F.struct(
                (seen["at"] + F.aggregate(part, F.lit(0), lambda sum_, x: sum_ + length(x))).alias("at"),
                F.concat(seen["out"], F.array(seen["at"])).alias("out"),
            ),
            lambda seen: seen["out"],
        )

    def of_slice(part: Column, start: Column) -> Column:
        return F.aggregate(part, F.struct(start.alias("at"), empty.alias("out")), step, lambda seen: seen["out"])

    # A lambda's variable is computed once, where an expression would be once a call.
    parts = F.transform(F.array(pairs), slices)
    all_ = F.flatten(F.flatten(F.transform(parts, lambda p: F.zip_with(p, starts(p), of_slice))))
    return F.when(text.rlike(present or pattern), all_).otherwise(empty)


def _span(kind: str, wanted, value=None):
    number = KINDS.index(kind)

    def shape(match: Column, start: Column, end: Column) -> Column:
        parts = [start.alias("start"), F.lit(number).alias("kind"), end.alias("end")]
        return F.when(wanted(match), F.struct(*parts, *([value(match).alias("value")] if value else [])))

    return shape


def base_spans(text: Column) -> Column:
    """Spans of the three patterns, by start, then kind; leftmost per kind, without overlap."""
    return _base(text, SPAN)


def _base(text: Column, kind: str, whole=None, assigned=None) -> Column:
    """``base_spans``, with the value of each span where functions of a match are given."""
    assign = _found(text, ASSIGN, _span("assign", lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_LENGTH, assigned), kind)
    access = _found(text, ACCESS, _span("access", lambda m: F.char_length(m) >= ACCESS_LENGTH, whole), kind)
    hex_ = _found(text, HEX, _span("hex", lambda m: F.char_length(m) >= HEX_LENGTH, whole), kind, "[0-9a-f]{%d}" % HEX_LENGTH)
    return F.array_sort(F.concat(assign, access, hex_))


def _runs(text: Column) -> Column:
    """Runs of key characters: struct of start, end and the run."""
    return _found(
        text,
        RUN,
        lambda m, start, end: F.struct(start.alias("start"), end.alias("end"), m.alias("run")),
        "struct<start:int,end:int,run:string>",
    )


def _apart(runs: Column, spans: Column) -> Column:
    """Runs that no span overlaps. Spans of one kind lie apart and in order, so the last
    that starts before a run ends tells, found by halving."""
    kinds = F.struct(*(F.filter(spans, lambda s, k=k: s["kind"] == k).alias(kind) for k, kind in enumerate(KINDS[:3])))

    def overlapped(run: Column, own: Column) -> Column:
        count = F.size(own)
        steps = F.sequence(F.ceil(F.log2(count + 1)).cast("int"), F.lit(0), F.lit(-1))

        def further(at: Column, k: Column) -> Column:
            to = at + F.pow(F.lit(2), k).cast("int")
            return F.when(F.get(own, to - 1)["start"] < run["end"], to).otherwise(at)

        last = F.get(own, F.aggregate(steps, F.lit(0), further) - 1)
        return F.coalesce(last["end"] > run["start"], F.lit(False))

    def kept(by: Column) -> Column:
        return F.filter(runs, lambda r: ~(overlapped(r, by["assign"]) | overlapped(r, by["access"]) | overlapped(r, by["hex"])))

    return F.when(F.size(spans) == 0, runs).otherwise(F.flatten(F.transform(F.array(kinds), kept)))


@dataclass(frozen=True)
class RunModel:
    """Log-likelihood ratio, random against ordinary, of every pair of characters."""

    ratios: tuple[float, ...]

    def column(self) -> Column:
        # One literal that Catalyst folds to an array once.
        return F.split(F.lit(",".join(f"{r:.4f}" for r in self.ratios)), ",").cast("array<double>")

    def score(self, run: Column) -> Column:
        """Log-likelihood ratio of a run: the sum over its pairs of characters."""
        size, ratios = len(ALPHABET), self.column()

        def code(i: Column, add: int) -> Column:
            return F.instr(F.lit(ALPHABET), F.substring(run, i + add, 1))

        return F.aggregate(
            F.sequence(F.lit(1), F.char_length(run) - 1),
            F.lit(0.0),
            lambda seen, i: seen + F.element_at(ratios, (code(i, 0) - 1) * size + code(i, 1)),
        )


def fit_runs(docs: DataFrame) -> RunModel:
    """Count character pairs of random and ordinary runs in all texts.

    What reaches the driver are counts of at most 2 x 68 x 68 pairs. Without any
    random or ordinary run the uniform model stands in.
    """
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    text, base = F.col("text"), F.col("base")
    found = _base(text, VALUED, lambda m: m, lambda m: F.regexp_extract(m, ASSIGN, 2))
    rows = rows.withColumn("base", found)

    runs = F.concat(
        F.transform(base, lambda s: F.struct(F.lit(1).alias("random"), s["value"].alias("run"))),
        F.transform(F.filter(_apart(_runs(text), base), lambda r: ~r["run"].rlike(MIXED)), lambda r: F.struct(F.lit(0).alias("random"), r["run"].alias("run"))),
    )
    each = rows.select(F.explode(runs).alias("r")).select("r.*")
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.char_length("run") - 1), lambda i: F.substring(F.col("run"), i, 2)))
    counted = each.select("random", pair.alias("pair")).groupBy("random", "pair").count()
    counts = {(r["random"], r["pair"]): r["count"] for r in counted.collect()}

    size = len(ALPHABET)

    def share(kind: int, uniform: float) -> dict[str, float]:
        out = {}
        for a in ALPHABET:
            total = sum(counts.get((kind, a + b), 0) for b in ALPHABET)
            for b in ALPHABET:
                learned = (counts.get((kind, a + b), 0) + PSEUDO / size) / (total + PSEUDO)
                out[a + b] = (1 - uniform) * learned + uniform / size
        return out

    random, ordinary = share(1, UNIFORM_RANDOM), share(0, UNIFORM_ORDINARY)
    return RunModel(tuple(math.log(random[a + b] / ordinary[a + b]) for a in ALPHABET for b in ALPHABET))


def find_secrets(docs: DataFrame, model: RunModel, threshold: float = THRESHOLD) -> DataFrame:
    """Add ``base_spans`` and ``spans``: arrays of (start, kind, end), kind an index of KINDS.

    Positions count code points, the end is exclusive. ``spans`` has the base
    spans and those the models add, by start, then kind. Null and empty texts have
    none. Columns with the new names are replaced; no shuffle.
    """
    rows = docs.drop("base_spans", "spans", "__runs").withColumn("base_spans", base_spans(F.coalesce(docs["text"], F.lit(""))))
    long = F.filter(
        _runs(F.coalesce(F.col("text"), F.lit(""))), lambda r: F.char_length(r["run"]) >= SCORE_LENGTH
    )
    rows = rows.withColumn("__runs", _apart(long, F.col("base_spans")))
    secret = F.filter(
        F.col("__runs"),
        lambda r: (F.size(F.array_distinct(F.split(r["run"], ""))) >= SCORE_DISTINCT) & (model.score(r["run"]) >= threshold),
    )
    added = F.transform(secret, lambda r: F.struct(r["start"], F.lit(KINDS.index("random")).alias("kind"), r["end"]))
    return rows.withColumn("spans", F.array_sort(F.concat("base_spans", added.cast(f"array<{SPAN}>")))).drop("__runs")


def as_text(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(docs: DataFrame, model: RunModel, mark: str = "[SECRET]") -> DataFrame:
    """Replace every secret in ``text`` by a mark; other columns and texts stay."""
    rows = find_secrets(docs, model)
    text = F.col("text")

    def step(seen: Column, s: Column) -> Column:
        gap = F.substring(text, seen["at"] + 1, s["start"] - seen["at"])
        fresh = F.struct(s["end"].alias("at"), F.concat(seen["out"], gap, F.lit(mark)).alias("out"))
        longer = F.struct(F.greatest(seen["at"], s["end"]).alias("at"), seen["out"].alias("out"))
        return F.when(s["start"] >= seen["at"], fresh).otherwise(longer)

    cleaned = F.aggregate(
        F.col("spans"),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        step,
        lambda seen: F.concat(seen["out"], F.substring(text, seen["at"] + 1, F.char_length(text))),
    )
    return rows.withColumn("text", F.when(F.size("spans") > 0, cleaned).otherwise(text)).drop("spans", "base_spans")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_secrets(docs, fit_runs(docs))

    def number(kind: int) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return found.select("doc_id", *map(number, range(3)), F.sha2(as_text(F.col("base_spans")), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))
