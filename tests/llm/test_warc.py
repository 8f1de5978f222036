"""WARC archives against plain Python: revisits, magic and forged records inside payloads, records over many blocks."""

import base64
import hashlib

import duckdb
import pytest

from siltstone.llm import queries, warc

SCHEMA = "page_id long, url string, html string, file string, sha1 int, place string"
FORGED = warc.MAGIC + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:666:1>\r\nContent-Length: 5\r\n\r\nhello" + warc.GAP


def rows():
    out = [
        (1, "http://a", "x"), (2, "http://b", "x"), (2, "http://b", "x"), (3, None, None), (4, "u\r\nContent-Length: 3", ""), (5, "http://c", "pre " + warc.MAGIC + " post"),
        (6, "http://d", "Ü é " + FORGED + "tail"), (7, "h", FORGED * 3), (8, "h", warc.MAGIC * 50 + "é" * 100), (None, "n", "nil"), (None, "n", "nil"), (9, "z", "nil2" * 5000 + FORGED),
        (10, "q", warc.GAP), (11, "q", "trail" + warc.MAGIC), (12, "q", warc.GAP + warc.MAGIC + warc.GAP), (13, None, "<html>" + "long text " * 30_000),
    ]
    return out + [(100 + i, "http://k", f"page {i % 60} " * 40 + (warc.MAGIC if i % 3 == 0 else "")) for i in range(90)]


def plainly(rows):
    payloads = [(p, (h or "").encode()) for p, _, h in rows]
    first: dict = {}
    for p, b in payloads:
        first[b] = min(first.get(b, (True, 0)), (p is None, p or 0))
    out, met = [], set()
    for p, b in payloads:
        response = (p is None, p or 0) == first[b] and b not in met
        if response:
            met.add(b)
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if response else "revisit", None if response or first[b][0] else first[b][1]))
    return sorted(out, key=str)


def through(spark, pages, least=0, **more):
    found = warc.resolved(warc.read(spark, warc.write(pages, least=least), **more))
    return found.select(warc.page_of("record_id").cast("long").alias("page_id"), "payload_bytes", "digest", "warc_type", warc.page_of("refers_to_id").cast("long"))


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*r, "file", 1, "place") for r in rows()], SCHEMA).repartition(3, "page_id")


@pytest.mark.parametrize("block", ["134217728", "3000"])
def test_round_trip(spark, pages, block):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    kept = [spark.conf.get(n) for n in names]
    path = warc.write(pages)
    try:
        for n, v in zip(names, (block, "0")):
            spark.conf.set(n, v)
        found = warc.resolved(warc.read(spark, path))
        got = told(found.select(warc.page_of("record_id").cast("long"), "payload_bytes", "digest", "warc_type", warc.page_of("refers_to_id").cast("long")))
    finally:
        for n, v in zip(names, kept):
            spark.conf.set(n, v)
    assert got == plainly(rows())


def test_payloads_come_back(spark, pages):
    found = warc.read(spark, warc.write(pages), payload=True).filter("warc_type = 'response'")
    got = {bytes(r["payload"]) for r in found.collect()}
    assert got == {(h or "").encode() for _, _, h in rows()}


def test_small_payloads_are_all_responses(spark, pages):
    got = told(through(spark, pages, least=2))
    assert [r[3] for r in got if r[1] < 2] == ["response"] * sum(len((h or "").encode()) < 2 for _, _, h in rows())


def test_no_pages(spark):
    assert through(spark, spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_cut_file_and_a_foreign_one(spark, tmp_path):
    one = "WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <urn:x:1>\r\nContent-Type: text/plain\r\ncontent-length:  7\r\n\r\nabc\r\n\r\n\r\n\r\n"
    (tmp_path / "whole.warc").write_bytes(one.encode() * 2)
    (tmp_path / "cut.warc").write_bytes((one + one[:-6]).encode())
    (tmp_path / "not.warc").write_bytes(("junk " + one).encode())
    got = warc.read(spark, f"file://{tmp_path}", payload=True).collect()
    assert sorted((r["file"].rsplit("/", 1)[1], r["offset"], bytes(r["payload"])) for r in got) == [("cut.warc", 0, b"abc\r\n\r\n"), ("whole.warc", 0, b"abc\r\n\r\n"), ("whole.warc", len(one), b"abc\r\n\r\n")]


def test_query_agrees_with_sql(spark):
    at = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{at}/pages.parquet'")
    want = con.execute("SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM (" + queries.ORACLE["op11_warc"] + ")").fetchall()
    got = queries.op11_warc(spark, at).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert told(got) == sorted(want, key=str)
