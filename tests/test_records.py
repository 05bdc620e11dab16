"""CSV cells over several lines, against Python's reader, in files of several blocks."""

import csv
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lakeassess.sources.records import opens, records, stays_open
from lakeassess.sources.tables import read_table


def written(path, rows, titles=()):
    with open(path, "w", newline="", encoding="utf-8") as file:
        for title in titles:
            file.write(title + "\n")
        csv.writer(file, lineterminator="\n").writerows(rows)


def made(seed, n):
    r = random.Random(seed)
    parts = ["a", "b,c", '"', "\n", "", "é", " ", '""', "\n\n", ",", "x y", '",', ',"']
    return [[f"k{i}", "".join(r.choice(parts) for _ in range(r.randint(0, 6))), r.choice(["", "1.5", "z"])] for i in range(n)]


def found(table, names):
    return sorted(tuple(r[n] or "" for n in names) for r in table.collect())


@pytest.mark.parametrize("block", [None, 64, 1000])
def test_against_pythons_reader(spark, tmp_path, block):
    rows = made(1, 300)
    written(tmp_path / "a.csv", [["Key", "Free\ntext", "Value"], *rows], ['a title with a "quote', ""])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    if block:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        table = read_table(spark, str(tmp_path / "a.csv"), 3)
        got = found(table, ["key", "free_text", "value"])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == sorted(map(tuple, rows))


def test_only_files_with_such_cells_are_joined(spark, tmp_path):
    written(tmp_path / "a.csv", [["k", "t"], ["1", 'one\n"two"'], ["2", "plain"]])
    written(tmp_path / "b.csv", [["t", "k"], ['5" pipe', "3"], ["x", "4"]])
    table = read_table(spark, str(tmp_path), 1, "csv")
    assert found(table, ["k", "t"]) == [("1", 'one\n"two"'), ("2", "plain"), ("3", '5" pipe'), ("4", "x")]
    assert len({r.row_id for r in table.collect()}) == 4


def test_quotes_inside_plain_cells_open_nothing(spark):
    lines = ['a,b', '"a",b', 'a,"b', 'a,5" pipe', '"a ""b"" c","d', '""', '"', 'x"', 'x",y', 'x","y', '"x","', 'x""', "", 'a"",""b', '"a"b,"']
    rows = spark.createDataFrame([(x,) for x in lines], "v string").select("v", opens(F.col("v")), stays_open(F.col("v"))).collect()
    want = {x for x in lines if len(list(csv.reader([f"{x}\n", 'tail"\n', "end\n"]))) == 2}
    assert {r[0] for r in rows if r[1]} == want
    want = {x for x in lines if len(list(csv.reader([f'"{x}\n', 'tail"\n', "end\n"]))) == 2}
    assert {r[0] for r in rows if r[2]} == want


def test_number_of_jobs_does_not_follow_the_files(spark, tmp_path):
    counts = []
    for n in (2, 12):
        folder = tmp_path / str(n)
        folder.mkdir()
        for i in range(n):
            written(folder / f"{i}.csv", [["k", "t"], [str(i), "x\ny"]])
        group = f"jobs-{n}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            assert read_table(spark, str(folder), 1, "csv").count() == n
            counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[0] == counts[1]


def test_a_quote_never_closed_raises(spark, monkeypatch):
    monkeypatch.setattr("lakeassess.sources.records.RECORD_LINES", 20)
    lines = [(i, 'a,"b' if i == 3 else "c", "f", 0) for i in range(60)]
    with pytest.raises(Exception, match="never closed"):
        records(spark.createDataFrame(lines, "row_id bigint, value string, __file string, __block bigint")).collect()


@pytest.mark.parametrize("lines", [1, 3, 7])
def test_records_over_several_batches_and_blocks(spark, tmp_path, lines):
    rows = made(lines, 120)
    written(tmp_path / "a.csv", [["Key", "Text", "Value"], *rows])
    old = {n: spark.conf.get(n) for n in ("spark.sql.files.maxPartitionBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    for name, value in zip(old, ("500", str(lines))):
        spark.conf.set(name, value)
    try:
        table = read_table(spark, str(tmp_path / "a.csv"), 1)
        got, ids = found(table, ["key", "text", "value"]), [r.row_id for r in table.collect()]
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)
    assert got == sorted(map(tuple, rows))
    assert len(set(ids)) == len(ids)


def test_text_is_neither_written_nor_moved(spark, tmp_path):
    """What is written beside the files, and moved inside them, does not grow with their text."""
    r = random.Random(5)
    rows = [[str(i), "\n".join("".join(r.choices("abcdefghij", k=60)) for _ in range(3))] for i in range(3000)]
    written(tmp_path / "a.csv", [["k", "t"], *rows])
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.rglob("*.parquet"))
    table = read_table(spark, str(tmp_path / "a.csv"))
    assert table.count() == 3000
    kept = sum(f.stat().st_size for f in set(shared.rglob("*.parquet")) - before if f.is_file())
    assert kept < (tmp_path / "a.csv").stat().st_size / 20
    largest = table.where("length(t) = 182").groupBy(F.spark_partition_id()).count().agg(F.max("count")).head()[0]
    assert largest == 3000  # one block: read and joined by one task, without an exchange
