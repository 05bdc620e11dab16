import gzip

import pytest

from lakeassess.llm.store import shared_path
from lakeassess.llm.warc import Record, digest, member, read_warc, record_bytes, salvage, write_warc

SCHEMA = "page_id bigint, url string, html string"


def archive(n=8, packed=True):
    records = [record_bytes(i, f"http://x/{i}", b"<p>%d</p>" % i * (i + 1), None) for i in range(n)]
    return [member(r) if packed else r for r in records]


def names(content):
    return [i.headers["warc-record-id"] if isinstance(i, Record) else i for i in salvage(content)]


@pytest.mark.parametrize("packed", [True, False])
def test_whole_archive(packed):
    parts = archive(packed=packed)
    assert names(b"".join(parts)) == [f"<urn:page:{i}>" for i in range(8)]


@pytest.mark.parametrize("packed", [True, False])
def test_damage_costs_only_the_record_it_hits(packed):
    parts = archive(packed=packed)
    parts[3] = parts[3][:-8] + bytes([parts[3][-8] ^ 255]) + parts[3][-7:]
    parts[5] = b"?" + parts[5][1:]
    parts[6] += b"junk \x1f\x8b\x08 WARC/1.1 junk"
    parts[7] = parts[7][:-9]
    found = names(b"".join(parts))
    at = [sum(map(len, parts[:i])) for i in range(9)]
    kept = [x for x in found if isinstance(x, str)]
    gaps = [x for x in found if not isinstance(x, str)]
    assert kept == [f"<urn:page:{i}>" for i in (0, 1, 2, 4, 6)]
    assert gaps == [(at[3], at[4]), (at[5], at[6]), (at[7] - len(b"junk \x1f\x8b\x08 WARC/1.1 junk"), at[8])]


def test_payload_digest_is_checked():
    good = record_bytes(1, "u", b"payload", None)
    assert names(good) == ["<urn:page:1>"]
    assert names(good.replace(b"payload", b"pay1oad")) == [(0, len(good))]


def test_empty_and_foreign_files():
    assert names(b"") == []
    assert names(b"not an archive") == [(0, 14)]
    assert names(member(b"")) == []


def test_round_trip(spark):
    rows = [(5, "u", "same"), (2, "u", "same"), (9, None, "same"), (3, "u", None), (4, "u", ""), (7, "u", "é😀"), (None, "u", "same"), (None, "u", "own"), (2, "u", "same")]
    path = shared_path(spark, "test-warc")
    write_warc(spark.createDataFrame(rows, SCHEMA).repartition(3), path)
    found = read_warc(spark, path, payload=True)
    assert found.where("quarantined").count() == 0
    got = [(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in found.collect()]
    same = (4, digest(b"same"))
    wanted = [
        (2, "response", None, *same),
        (2, "response", None, *same),
        (5, "revisit", 2, *same),
        (9, "revisit", 2, *same),
        (None, "revisit", 2, *same),
        (None, "response", None, 3, digest(b"own")),
        (3, "response", None, 0, digest(b"")),
        (4, "revisit", 3, 0, digest(b"")),
        (7, "response", None, 6, digest("é😀".encode())),
    ]
    assert sorted(map(str, got)) == sorted(map(str, wanted))
    payloads = {r["page_id"]: r["payload"] for r in found.where("record_type = 'response'").collect()}
    assert bytes(payloads[7]) == "é😀".encode()


def test_small_payloads_are_never_revisits(spark):
    path = shared_path(spark, "test-warc")
    write_warc(spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], SCHEMA), path, least_bytes=3)
    kinds = {r["page_id"]: r["record_type"] for r in read_warc(spark, path).collect()}
    assert kinds == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_archives_are_plain_gzip(spark):
    import glob

    path = shared_path(spark, "test-warc")
    write_warc(spark.createDataFrame([(i, "u", f"page {i}") for i in range(20)], SCHEMA), path)
    text = b"".join(gzip.open(f).read() for f in glob.glob(path.removeprefix("file:") + "/part-*"))
    assert text.count(b"WARC-Type: response") == 20


def test_empty_table(spark):
    path = shared_path(spark, "test-warc")
    write_warc(spark.createDataFrame([], SCHEMA), path)
    assert read_warc(spark, path).count() == 0


def test_damaged_record_in_a_member_of_many():
    parts = archive(5, packed=False)
    whole = b"".join(parts)
    parts[2] = parts[2].replace(b"<p>2</p>", b"<p>x</p>", 1)
    one = member(b"".join(parts))
    a = sum(map(len, parts[:2]))
    ids = [f"<urn:page:{i}>" for i in range(5)]
    assert names(member(whole)) == ids
    assert names(one + member(parts[0])) == [*ids[:2], (0, len(one), a, a + len(parts[2])), *ids[3:], ids[0]]


@pytest.mark.parametrize("level", [0, 6])
def test_member_of_many_cut_or_with_a_wrong_checksum(level):
    parts = archive(40, packed=False)
    one, other = member(b"".join(parts), level), member(parts[0])
    ids = [f"<urn:page:{i}>" for i in range(40)]
    wrong = one[:-8] + bytes([one[-8] ^ 255]) + one[-7:]
    kept = [x for x in names(wrong + other) if isinstance(x, str)]
    # Stored uncompressed, the last record shows as a plain one too; none comes twice.
    assert kept == [*ids[: 40 if level == 0 else 39], ids[0]]
    for tail, more in ((b"", []), (other, ids[:1])):
        found = names(one[:-20] + tail)
        kept = [x for x in found if isinstance(x, str)]
        assert kept in ([*ids[:38], *more], [*ids[:39], *more]) and (0, len(one) - 20) in found


def test_files_follow_bytes(spark, tmp_path):
    import random

    path = f"file:{tmp_path}/sized"
    r = random.Random(5)
    pages = [(i, "u", r.randbytes(r.choice([0, 10, 3000])).hex() + f" {i}") for i in range(300)]
    write_warc(spark.createDataFrame(pages, SCHEMA).coalesce(1), path, row_bytes=4000)
    files = list((tmp_path / "sized").glob("part-*"))
    largest = max(len(member(record_bytes(i, "u", html.encode(), None))) for i, _, html in pages)
    assert len(files) > 4 and max(f.stat().st_size for f in files) <= 16 * (4000 + largest + 20)
    rows = read_warc(spark, path, payload=True).collect()
    assert not any(x["quarantined"] for x in rows)
    assert sorted((x["page_id"], x["payload"].decode()) for x in rows) == [(i, html) for i, _, html in pages]
