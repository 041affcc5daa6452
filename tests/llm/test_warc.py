"""Packages: read by the standard library, read back, duplicates, damage, ZIP64."""

import base64
import gzip
import hashlib
import io
import zipfile

import pyarrow.fs as pafs
import pytest

from tallowgrid.llm import warc

SCHEMA = "page_id long, url string, html string"


def expected(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        f = first.get(h or "")
        ref = f if f is not None and i != f else None
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if ref is None else "revisit", ref))
    return sorted(map(str, out))


ROWS = [(1, "http://a/ü x\r\nEvil: 1", "<p>é</p>"), (2, None, None), (3, "http://b", ""), (4, "http://c", "<p>é</p>"), (0, "http://d", "<p>é</p>"), (5, "u", "x" * 200_000), (5, "u", "x" * 200_000), (None, "n", "<p>é</p>"), (6, "u", "\r\n\r\n tricky \r\n\r\n")]


def test_reading_back(spark):
    pages = spark.createDataFrame(ROWS, SCHEMA).withColumn("sha1", warc.F.lit("clash")).withColumn("payload", warc.F.lit(1))
    for force in (False, True):
        manifest = warc.write_archives(pages, records_each=2, force64=force)
        assert manifest.agg({"records": "sum"}).first()[0] == len(ROWS)
        got = warc.read_archives(manifest, with_payload=True).collect()
        shown = [tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got]
        assert sorted(map(str, shown)) == expected(ROWS)
        assert all((r["payload"] is None) == (r["record_type"] == "revisit") for r in got)
        assert all(r["payload"].decode() == {i: h or "" for i, _, h in ROWS}[r["page_id"]] for r in got if r["payload"] is not None)
    by_salt = warc.read_archives(warc.write_archives(pages, broadcast_rows=0)).collect()
    assert sorted(str(tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))) for r in by_salt) == expected(ROWS)
    small = warc.read_archives(warc.write_archives(pages, least=100)).collect()
    assert sum(r["record_type"] == "revisit" for r in small) == 0
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_packages_are_zip_files_of_stored_members(spark):
    pages = spark.createDataFrame(ROWS, SCHEMA).coalesce(1)
    for force in (False, True):
        path = warc.write_archives(pages, force64=force).first()["path"].removeprefix("file://")
        with zipfile.ZipFile(path) as z:
            assert z.testzip() is None and z.namelist() == [warc.DATA_MEMBER, warc.INDEX_MEMBER]
            assert all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
            records = gzip.decompress(z.read(warc.DATA_MEMBER))
        assert records.count(b"WARC/1.1\r\n") == len(ROWS)
        assert b"\r\nEvil:" not in records


def test_many_rows_of_one_payload(spark):
    pages = spark.range(10_000).selectExpr("id + 3 AS page_id", "'u' AS url", "CAST(IF(id % 100 = 0, id, NULL) AS STRING) AS html")
    got = warc.read_archives(warc.write_archives(pages))
    assert got.where("record_type = 'revisit'").count() == 9900 - 1
    assert {r["refers_to"] for r in got.where("refers_to IS NOT NULL").select("refers_to").distinct().collect()} == {4}


def reader(tmp_path, content):
    (tmp_path / "z.zip").write_bytes(content)
    return warc.StoredZipReader(pafs.LocalFileSystem().open_input_file(str(tmp_path / "z.zip")))


def test_packages_of_other_writers(tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a/é.txt", b"0123456789")
        with z.open(zipfile.ZipInfo("b"), "w", force_zip64=True) as f:
            f.write(b"wide")
        z.writestr(zipfile.ZipInfo("c"), b"packed" * 50, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment PK\x05\x06 with a signature in it, long enough to mislead"
    r = reader(tmp_path, out.getvalue())
    assert r.read("a/é.txt", 3, 4) == b"3456" and r.read("b") == b"wide"
    raw = bytearray(out.getvalue())
    raw[raw.index(b"wide")] ^= 1
    with pytest.raises(ValueError, match="CRC"):
        reader(tmp_path, bytes(raw)).read("b")
    with pytest.raises(ValueError, match="not stored"):
        r.read("c")
    with pytest.raises(ValueError, match="outside"):
        r.read("b", 2, 3)
    with pytest.raises(ValueError, match="central"):
        reader(tmp_path, b"nothing" * 10)


def test_records():
    raw = warc.record(7, "http://x", b"body", warc.digest(b"body"), None)
    fields, http, payload = warc.parse(raw)
    assert payload == b"body" and fields["warc-type"] == "response" and http["content-length"] == "4"
    with pytest.raises(ValueError, match="short"):
        warc.parse(raw[:-20])
