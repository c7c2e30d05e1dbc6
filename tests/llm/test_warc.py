import gzip
import hashlib
import io
import json
import zipfile

import pytest

from sumfold.llm import warc_zip


def back(pages, tmp_path, **options):
    packages = warc_zip.write(pages, f"file://{tmp_path}/wacz", **options)
    return packages, warc_zip.read(packages, range_bytes=300)


def test_round_trip(spark, tmp_path):
    big = "<p>" + "ä" * 100
    rows = [(5, "http://a", big), (3, "http://b", big), (9, None, big), (4, "u\r\nX: y", "small"), (6, "u", "small"), (7, "u", None), (8, "u", ""), (3, "again", big), (None, "n", big), (10, "u", "other" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS digest", "1 AS refers_to").repartition(2)
    packages, records = back(pages, tmp_path, package_bytes=200)
    assert packages.count() > 1
    found = records.collect()
    assert len(found) == len(rows)
    by = {(r["page_id"], r["url"]): r for r in found}
    assert {r["record_type"] for r in found if r["page_id"] in (3, 4, 6, 7, 8, 10)} == {"response"}
    assert [by[i, u]["refers_to"] for i, u in ((5, "http://a"), (9, None), (None, "n"))] == [3, 3, 3]
    assert bytes(by[10, "u"]["payload"]).decode() == "other" * 5000
    out = {(r["page_id"], r["payload_bytes"]): r for r in warc_zip.report(records).collect()}
    assert out[5, len(big.encode())]["payload_digest"] == hashlib.sha256(big.encode()).hexdigest()
    assert out[7, 0]["payload_digest"] == hashlib.sha256(b"").hexdigest()


def foreign_record(kind, body, uri="http://x.org/a", http=True):
    body = b"HTTP/1.1 200 OK\r\nServer: s\r\n\r\n" + body if http else body
    head = f"WARC/1.0\r\nwarc-type: {kind}\r\nWARC-Record-ID: <urn:uuid:1-2>\r\nWARC-Target-URI: {uri}\r\nWARC-Payload-Digest: sha1:ABC\r\n"
    head += f"Content-Type: application/{'http; msgtype=response' if http else 'warc-fields'}\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def test_packages_of_others(spark, tmp_path):
    info, one, two, three = foreign_record("warcinfo", b"software: s", http=False), foreign_record("response", b"first"), foreign_record("response", b"second" * 400_000), foreign_record("response", "dritte é".encode())
    a, b, c = gzip.compress(info) + gzip.compress(one) + gzip.compress(two), info + three, gzip.compress(one) + gzip.compress(three)
    lines = [f'org,x)/a 20240101 {json.dumps({"url": "http://x.org/a", "filename": "c.warc.gz", "offset": len(gzip.compress(one)), "length": str(len(gzip.compress(three)))})}']
    with zipfile.ZipFile(tmp_path / "other.wacz", "w", zipfile.ZIP_STORED) as z:
        for name, data in (("datapackage.json", b"{}"), ("archive/a.warc.gz", a), ("archive/b.warc", b), ("archive/c.warc.gz", c), ("pages/pages.jsonl", b"{}")):
            z.writestr(name, data)
        z.writestr("indexes/index.cdx.gz", gzip.compress("\n".join(['!meta 0 {"format": "cdxj-gzip"}', *lines]).encode()))
    found = warc_zip.read(spark.createDataFrame([(str(tmp_path / "other.wacz"),)], "path string")).collect()
    # of c only what the index names
    assert sorted(bytes(r["payload"]) for r in found) == sorted([b"first", b"second" * 400_000, "dritte é".encode(), "dritte é".encode()])
    assert {(r["page_id"], r["url"], r["record_type"], r["payload_digest"]) for r in found} == {(None, "http://x.org/a", "response", "sha1:ABC")}


def test_index_lines_and_stores(spark, tmp_path):
    packages, _ = back(spark.createDataFrame([(1, "http://b.example.com:80/P q?x", "h"), (2, None, "i")], "page_id long, url string, html string").coalesce(1), tmp_path)
    with zipfile.ZipFile(packages.first()["path"].removeprefix("file://")) as z:
        lines = z.read("indexes/index.cdxj").decode().splitlines()
    assert [x.split(" ", 2)[:2] for x in lines] == [[")/", "20240101000000"], ["com,example,b:80)/p%20q?x", "20240101000000"]]
    with pytest.raises(ValueError, match="cannot be kept"):
        warc_zip.write(spark.createDataFrame([], "page_id long, url string, html string"), "viewfs://store/x")


def test_no_pages(spark, tmp_path):
    packages, records = back(spark.createDataFrame([], "page_id long, url string, html string"), tmp_path)
    assert packages.count() == 0 and records.count() == 0


def test_directory_with_zip64(monkeypatch):
    for limit in (zipfile.ZIP64_LIMIT, 10):
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 0xFFFF if limit > 10 else 1)
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            z.writestr("one", b"first member")
            z.writestr("two", b"second member, longer")
            z.comment = b"a remark"
        raw = out.getvalue()
        read = lambda at, n: raw[at : at + n]  # noqa: B023, E731
        members = warc_zip.directory(read, len(raw))
        assert {k: v[:2] for k, v in members.items()} == {"one": (0, 12), "two": (0, 21)}
        for name, text in (("one", b"first member"), ("two", b"second member, longer")):
            at = warc_zip.data_start(read, members[name][2])
            assert raw[at : at + len(text)] == text
    with pytest.raises(ValueError):
        warc_zip.directory(lambda at, n: b"no archive"[at : at + n], 10)
