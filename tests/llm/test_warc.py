"""Archives written and read back, with marks inside payloads, in ranges of every size."""

import base64
import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from peakloom.llm import queries, warc
from tests.llm import fixtures
from tests.parity import compare

SCHEMA = "page_id long, url string, html string"
FALSE = "\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def pages():
    out = [(i, f"http://h/{i}", f"<p>page {i} " + "x" * (37 * i % 900) + "</p>") for i in range(60)]
    out += [(100, "http://h/WARC/1.1\r\nx", FALSE + "tail"), (101, None, FALSE * 40), (102, "u", "\r\nWARC/1." * 30 + "\r"), (103, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\n")]
    out += [(104, "u", "\r\nWARC/1.1\r\nContent-Length: 999999999\r\n\r\n"), (105, "u", "\r\nWARC/1.1\r\nContent-Length: x\r\n\r\n"), (106, "u", "ß日本\n" * 50), (107, "u", "\r\n\r\n")]
    out += [(200 + k, "u", "same\r\nWARC/1.1\r\n") for k in range(30)] + [(230, "u", "same\r\nWARC/1.1\r\n")] * 3 + [(199, "u", "same\r\nWARC/1.1\r\n")] * 2
    out += [(300, "u", ""), (301, "u", None), (None, "u", "null id"), (None, "u", "null id"), (None, "u", "same\r\nWARC/1.1\r\n"), (302, "u", "L" * 200_000)]
    return out


def wanted(rows, least=0):
    body = lambda r: (r[2] or "").encode()
    first = {}
    for r in rows:
        if r[0] is not None and len(body(r)) >= least:
            first[body(r)] = min(r[0], first.get(body(r), r[0]))
    return sorted(
        ((r[0], len(body(r)), base64.b32encode(hashlib.sha1(body(r)).digest()).decode(), *(("response", None) if first.get(body(r), r[0]) == r[0] else ("revisit", first[body(r)]))) for r in rows),
        key=repr,
    )


def listed(records):
    return sorted(((None if r[0] is None else int(r[0]), r[1], r[2], r[3], None if r[4] is None else int(r[4])) for r in warc.inventory(records).collect()), key=repr)


@pytest.mark.parametrize(("size", "longest"), [("128m", 10**6), ("4000", 10**6), ("257", 3000), ("61", 120)])
def test_round_trip(spark, tmp_path, size, longest):
    """Ranges down to a few bytes: marks and records lie across their borders, and payloads over many of them."""
    rows = [r for r in pages() if len(r[2] or "") < longest]
    warc.write_archives(spark.createDataFrame(rows, SCHEMA).withColumn("sha", F.lit(1)).coalesce(2), f"{tmp_path}/a")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = warc.read_archives(spark, f"{tmp_path}/a").collect()
        found = spark.createDataFrame(got, "file string, offset long, type string, id string, uri string, refers_to string, digest string, payload_length long, content binary")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert listed(found) == wanted(rows)
    texts = {r["id"]: bytes(r["content"]).decode() for r in got if r["type"] == "response"}
    assert all(texts[f"<urn:page:{i}>"] == (t or "") for i, _, t in rows if i is not None and not 200 <= i <= 230 and i != 301)
    assert {r["uri"] for r in got if r["id"] == "<urn:page:100>"} == {"http://h/WARC/1.1%0D%0Ax"} and {r["uri"] for r in got if r["id"] == "<urn:page:101>"} <= {None}
    raw = {f: open(f.removeprefix("file:"), "rb").read() for f in {r["file"] for r in got}}
    for r in got:  # each offset is where a record starts, and its digest is that of the payload
        assert raw[r["file"]][r["offset"] :].startswith(b"WARC/1.1\r\nWARC-Type: " + r["type"].encode())
        assert r["type"] == "revisit" or r["digest"] == base64.b32encode(hashlib.sha1(r["content"]).digest()).decode()


def test_small_payloads_and_big_copies(spark, tmp_path, monkeypatch):
    """Below the least size all are responses; without a broadcast the salted join gives the same."""
    df = spark.createDataFrame(pages(), SCHEMA)
    monkeypatch.setattr(warc, "bounded_broadcast", lambda df: df)
    warc.write_archives(df, f"{tmp_path}/a", least=18)
    assert listed(warc.read_archives(spark, f"{tmp_path}/a")) == wanted(pages(), 18)


def test_files_of_others(spark, tmp_path):
    """Another version, header case and order, bytes that are no UTF-8, no final line ends; damaged files."""
    one = b"WARC/1.0\r\ncontent-length:  4\r\nWARC-TYPE:resource\r\nWARC-Target-URI: http://x/\xc3\xa9\r\n\r\n\xff\xfe\r\n\r\n\r\n"
    two = b"WARC/1.1\r\nWARC-Type: metadata\r\nX: WARC/1.1\r\n WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "good.warc").write_bytes(one + two + one)
    (tmp_path / "a" / "empty.warc").write_bytes(b"")
    rows = warc.read_archives(spark, f"{tmp_path}/a").orderBy("offset").collect()
    assert [(r["offset"], r["type"], bytes(r["content"]), r["uri"]) for r in rows] == [
        (0, "resource", b"\xff\xfe\r\n", "http://x/é"), (len(one), "metadata", b"", None), (len(one + two), "resource", b"\xff\xfe\r\n", "http://x/é")
    ]
    (tmp_path / "a" / "cut.warc").write_bytes(one + two[:-7])
    (tmp_path / "a" / "junk.warc").write_bytes(b"junk\r\n" + one)
    with pytest.raises(ValueError, match="2 archives break off"):
        warc.read_archives(spark, f"{tmp_path}/a")
    left = warc.read_archives(spark, f"{tmp_path}/a", strict=False)
    assert sorted((r["file"].rsplit("/", 1)[1], r["offset"]) for r in left.collect()) == [("cut.warc", 0), ("good.warc", 0), ("good.warc", len(one)), ("good.warc", len(one + two))]


def test_long_chains(spark):
    """Pointer jumping reaches what a walk reaches, over many links and several files."""
    links = [("a", k * 10, (k + 1) * 10) for k in range(77)] + [("a", 5, 15), ("a", 15, 30), ("b", 0, 7), ("b", 9, 11), ("c", 3, 4)]
    got = warc._chained(spark.createDataFrame(links, "file string, at long, leaves long")).collect()
    assert sorted(map(tuple, got)) == [("a", k * 10) for k in range(77)] + [("b", 0)]


def test_like_sql(spark, tmp_path):
    df = spark.createDataFrame([r for k, r in enumerate(pages()) if k not in (98, 99)], SCHEMA).dropDuplicates(["page_id", "html"])
    df = df.where("page_id is not null").selectExpr("*", *[f"'z' as {c}" for c in ["id", "sha", "of", "first", "again", "digest", "size", "value", "file", "block", "`a.b`"]])
    folder = fixtures.saved(spark, tmp_path, df, "pages")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{folder}/pages.parquet/*.parquet'")
    compare(queries.op13_warc(spark, folder), con, queries.oracle_sql()["op13_warc"])
    assert queries.op13_warc(spark, fixtures.saved(spark, tmp_path / "e", df.limit(0), "pages")).count() == 0
