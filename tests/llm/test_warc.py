"""WARC archives: exact round trip, revisits, pushed filters, skipped payloads, compression and damage."""

import base64
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from meterflow.llm import warc

PAGES = "page_id long, url string, html string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def pages():
    nested = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n"
    rows = [(i, f"http://e.com/{i}", f"<p>página {i}\r\n\r\n{nested if i % 7 == 0 else ''}</p>") for i in range(60)]
    rows += [(100 + i, f"http://copy.org/{i}", "the same page 漢字") for i in range(300)]
    rows += [(500, None, None), (501, "http://x", ""), (502, "a b\tc\r\nWARC-Type: metadata", None), (503, "long", "x\r\n" * 700_000)]
    rows += [(600, "twice", "twice"), (600, "twice", "twice"), (None, "no id", "twice"), (None, "n1", "only nameless"), (None, "n2", "only nameless")]
    return rows


def expected(rows):
    least = {}
    for page, _, html in rows:
        if page is not None:
            least[html or ""] = min(page, least.get(html or "", page))
    out = []
    for page, _, html in rows:
        first = least.get(html or "")
        again = first is not None and first != page
        out.append((page, len((html or "").encode()), digest(html), "revisit" if again else "response", first if again else None))
    return out


def number(name):
    return F.regexp_extract(name, "^urn:row:(.+)$", 1).try_cast("long").alias(name)


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_round_trip(spark, tmp_path, compression):
    rows = pages()
    path = f"{tmp_path}/archive"
    warc.write_warc(spark.createDataFrame(rows, PAGES).repartition(4), path, compression=compression, file_records=50)
    read = warc.read_warc(spark, path, partition_bytes=100_000)
    found = read.select(number("record_id"), "payload_length", "payload_digest", "record_type", number("refers_to")).collect()
    assert sorted(map(tuple, found), key=str) == sorted(expected(rows), key=str)
    held = {(r.record_id, bytes(r.payload)) for r in read.where("record_type = 'response'").collect()}
    assert held == {(f"urn:row:{'' if r[0] is None else r[0]}", (r[2] or "").encode()) for r, e in zip(rows, expected(rows)) if e[3] == "response"}
    assert read.where("record_type = 'revisit' and payload is not null").count() == 0
    assert read.where("record_id = 'urn:row:502'").first().uri == "a%20b%09c%0D%0AWARC-Type:%20metadata"
    assert warc.read_warc(spark, path).rdd.getNumPartitions() == 1  # small files share a partition


def test_small_payloads_are_no_revisits(spark, tmp_path):
    rows = [(1, "a", "xy"), (2, "b", "xy"), (3, "c", "longer"), (4, "d", "longer")]
    warc.write_warc(spark.createDataFrame(rows, PAGES), f"{tmp_path}/a", least_bytes=3)
    found = {tuple(r) for r in warc.read_warc(spark, f"{tmp_path}/a").select(number("record_id"), "record_type").collect()}
    assert found == {(1, "response"), (2, "response"), (3, "response"), (4, "revisit")}


def test_filters_reach_the_reader(spark, tmp_path):
    warc.write_warc(spark.createDataFrame(pages(), PAGES), f"{tmp_path}/a")
    read = warc.read_warc(spark, f"{tmp_path}/a", payload=False)
    some = read.where("record_type = 'revisit' and uri like 'http://copy.org/1%' and content_length < 1000000")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Scan" in plan and "Filter (" not in plan and "Filter[" not in plan, plan
    assert some.count() == 111
    assert read.where("payload is not null").count() == 0
    assert read.where("uri is null").count() == 1 and read.where("not (record_type in ('revisit', 'metadata'))").count() == read.where("record_type <> 'revisit'").count()


class Counting(io.BytesIO):
    read_bytes = 0

    def read(self, size=-1):
        data = super().read(size)
        self.read_bytes += len(data)
        return data

    def readline(self, size=-1):
        data = super().readline(size)
        self.read_bytes += len(data)
        return data


def record(kind, block, extra=""):
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x:{kind}>\r\n{extra}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_unwanted_blocks_are_stepped_over():
    http = b"HTTP/1.1 200 OK\r\nContent-Length: 100000\r\n\r\n" + b"b" * 100_000
    data = record("warcinfo", b"i" * 100_000) + record("response", http, "Content-Type: application/http\r\n") + record("resource", b"r" * 100_000, "X-Note: one\r\n two\r\nX-Note: three\r\n")
    for seekable in (True, False):
        every = lambda row: True
        rows = list(warc.read_records(Counting(data), every, True, seekable))
        assert [r["record_type"] for r in rows] == ["warcinfo", "response", "resource"]
        assert [len(r["payload"]) for r in rows] == [100_000] * 3 and rows[1]["payload_length"] == 100_000
        assert rows[2]["headers"]["x-note"] == "one two, three"
    file = Counting(data)
    kept = list(warc.read_records(file, lambda row: row["record_type"] == "response", False, True))
    assert len(kept) == 1 and kept[0]["payload"] is None and kept[0]["payload_length"] == 100_000
    assert file.read_bytes < 1000


def test_members_and_damage(spark, tmp_path):
    parts = [record("resource", f"body {i}".encode()) for i in range(5)]
    (tmp_path / "m.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    found = warc.read_warc(spark, f"{tmp_path}/m.warc.gz").collect()
    assert sorted(bytes(r.payload) for r in found) == [f"body {i}".encode() for i in range(5)]
    for k, bad in enumerate([b"no archive\r\n\r\n", parts[0][:-9], b"WARC/1.0\r\nWARC-Type: x\r\n\r\nabc", b"WARC/1.0\r\nContent-Length: 3"]):
        with pytest.raises(warc.DamagedArchive):
            list(warc.read_records(io.BytesIO(bad), lambda row: True, True, True))
        (tmp_path / f"bad{k}").write_bytes(bad)
    with pytest.raises(Exception, match="DamagedArchive"):
        warc.read_warc(spark, f"{tmp_path}/bad0").collect()


def test_nothing(spark, tmp_path):
    warc.write_warc(spark.createDataFrame([], PAGES), f"{tmp_path}/none")
    assert warc.read_warc(spark, f"{tmp_path}/none").count() == 0


def test_clashing_names(spark, tmp_path):
    rows = spark.createDataFrame([(1, "u", "p", 5, 6, 7), (2, "u", "p", 5, 6, 7)], "id long, uri string, payload string, block int, again int, _warc_first int")
    warc.write_warc(rows, f"{tmp_path}/c", "id", "uri", "payload")
    assert {r.record_type for r in warc.read_warc(spark, f"{tmp_path}/c").collect()} == {"response", "revisit"}


def test_packing():
    files = [("a", 5), ("b", 5), ("c", 100), ("d", 1)]
    assert [p.paths for p in warc.packed(files, 10)] == [["a", "b"], ["c"], ["d"]]
