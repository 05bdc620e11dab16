"""Repair of conversations against enumeration of all edits, on damaged fixtures."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from lakeassess.llm import conversations as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
LEGAL = re.compile("(s?(ua)+)?")


def edits(rows, most_inserts=3):
    """Least (cost, audit) over all edits of (role, kind) rows, kind in '', 'gone', 'cut'."""

    @lru_cache(None)
    def rest(i, roles, inserts):
        if not LEGAL.match(roles) or not re.fullmatch("s?(ua)*u?", roles):
            return None
        found = []
        if i == len(rows):
            if LEGAL.fullmatch(roles):
                found.append((0, ""))
        else:
            role, kind = rows[i]
            found.append(_put(rest(i + 1, roles, 0), 4, "D"))
            if kind != "gone":
                more = 3 if kind == "cut" else 0
                found.append(_put(rest(i + 1, roles + (role[:1] or " "), 0), more, "K"))
                found += [_put(rest(i + 1, roles + to, 0), 3 + more, "R") for to in "ua"]
        if inserts < most_inserts:
            found += [_put(rest(i, roles + to, inserts + 1), 3, "I") for to in "ua"]
        return min((f for f in found if f), default=None)

    return rest(0, "", 0)


def _put(found, cost, letter):
    return found and (found[0] + cost, letter + found[1])


def expected(rows):
    """The contract's columns of one conversation's damaged rows, in order."""
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    kinds, seen = [], set()
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        kinds.append("gone" if not bare else "dup" if (role, text) in seen else "" if bare[-1] in ".!?" else "cut")
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit = edits(tuple((r, "gone" if k == "dup" else k) for (_, r, _), k in zip(rows, kinds)))
    out, left, state = [], list(rows), ""
    for letter in audit:
        if letter == "I":
            role, text = ("assistant" if state == "u" else "user"), ""
        else:
            _, role, text = left.pop(0)
            if letter == "D":
                continue
            if letter == "R":
                role = "assistant" if state == "u" else "user"
        state = role[0]
        out.append(f"{role}:{text}")
    sha = hashlib.sha256("\n".join(out).encode()).hexdigest()
    return (gaps, kinds.count("gone"), kinds.count("dup"), kinds.count("cut"), illegal, cost, audit, sha)


def damaged(rows):
    by_conv = {}
    for conv, turn, role, text in rows:
        own = by_conv.setdefault(conv, [])
        what = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        role = "user" if what == 4 else role
        own += [(turn, role, text)] * (0 if what == 0 else 2 if what == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest())
    return {conv: sorted(own, key=order) for conv, own in by_conv.items()}


def columns(row):
    return tuple(row[n] for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))


TEXTS = ["One.", "Two!", "Three", "Four?", "", " \t", None, " ", "Six. ", "seven.\n", "é"]
ROLES = ["user", "assistant", "system", "tool", "", None, "unknown"]


def made(seed, convs, longest):
    r = random.Random(seed)
    rows = []
    for conv in [None, *range(convs)]:
        for turn in range(r.randint(1, longest)):
            turn = None if r.random() < 0.1 else turn * r.choice([1, 1, 1, 2])
            rows.append((conv, turn, r.choice(ROLES[:3]) if r.random() < 0.8 else r.choice(ROLES), r.choice(TEXTS)))
    return rows


def run(spark, rows):
    df = C.damage(spark.createDataFrame(rows, SCHEMA))
    return {row["conv_id"]: columns(row) for row in C.digests(df, C.plan_repairs(df)).collect()}


@pytest.mark.parametrize("bits", [16, 0, 1])
def test_against_all_edits(spark, monkeypatch, bits):
    """Also with segments of one and two places, so that matrices are chained."""
    monkeypatch.setattr(C, "SEGMENT_BITS", bits)
    rows = made(bits, 60, 6)
    own = damaged(rows)
    found = run(spark, rows)
    assert found.keys() == own.keys()
    for conv, those in own.items():
        want = expected(those) if those else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
        assert found[conv] == want, (conv, those)


def test_long_runs_advance_by_powers():
    r = random.Random(7)
    for _ in range(200):
        runs = [(r.randrange(9), r.randint(1, 40)) for _ in range(r.randint(1, 6))]
        after = C.FINISH
        for of, length in reversed(runs):
            for _ in range(length):
                after = C._times(C.power(of, 0), after)
        assert C.before(runs, C.FINISH) == after
        audit, state = C.unroll(runs, 0, C.FINISH)
        assert sum(c != "I" for c in audit) == sum(n for _, n in runs)


def test_small_choices():
    for rows in [[("user", "")], [("system", "")], [("assistant", "cut")], [("user", "")] * 3, [("user", "cut"), ("user", ""), ("assistant", "gone")]]:
        runs = [(C.GONE if kind == "gone" else C.symbol(role, kind == "cut"), 1) for role, kind in rows]
        audit, state = C.unroll(runs, 0, C.FINISH)
        assert (C.before(runs, C.FINISH)[0], audit + C._TAIL[state]) == edits(tuple(rows))


def test_repeated_rows_of_one_turn_count_as_copies(spark):
    rows = [(5, 1, "user", "Same text.")] * 50 + [(5, 2, "assistant", "Answer.")]
    df = spark.createDataFrame(rows, SCHEMA)
    found = C.plan_repairs(df).collect()[0]
    assert (found["duplicate"], found["audit"], found["gaps"]) == (49, "K" + "D" * 49 + "K", 0)
    out = C.repaired(df, C.plan_repairs(df)).orderBy("place").collect()
    assert [(r["role"], r["text"]) for r in out] == [("user", "Same text."), ("assistant", "Answer.")]


def test_very_long_text_and_extra_columns(spark):
    rows = [(1, 0, "user", "word " * 400_000 + "end."), (1, 1, "assistant", "x")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("copies", F.lit(1)).withColumn("digest", F.lit("a")).withColumn("blank", F.lit(1))
    assert C.plan_repairs(df).collect()[0]["audit"] == "KK"


def test_empty_table_and_query(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert C.op11_conversations(spark, str(tmp_path)).collect() == []
    rows = made(3, 20, 5)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/b/conversations.parquet")
    found = C.op11_conversations(spark, f"{tmp_path}/b")
    assert found.count() == len({r[0] for r in rows})
