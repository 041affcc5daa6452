"""WARC archives in ZIP packages: a writer, and a reader that never extracts.

A package has two stored members: ``archive/data.warc.gz``, one gzip member for each record, and
``indexes/index.cdxj``, a line for each record with its place. Being stored, members are read in
place: the central directory gives their offsets, the index gives a record's, and one range read gives
the record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallowgrid.llm.common import bound_batches, lean, materialise, new_folder, open_fs

DATA_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
#: Fixed values of the ZIP format: signatures, and the structures after them.
LOCAL, CENTRAL, END, END64, LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
_LOCAL = struct.Struct("<IHHHHHIIIHH")
_CENTRAL = struct.Struct("<IHHHHHHIIIHHHHHII")
_END = struct.Struct("<IHHHHIIH")
_END64 = struct.Struct("<IQHHIIQQQQ")
_LOCATOR64 = struct.Struct("<IIQI")
_BIG16, _BIG32 = 0xFFFF, 0xFFFFFFFF
#: Shares in which pages of one digest are dealt where digests are too many to be broadcast.
SALTS = 16
#: A fixed date, so that a package written again has the same bytes.
_DATE = "2020-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None) -> bytes:
    """One WARC 1.1 record: a response with its payload, or a revisit that names an equal payload.

    A revisit keeps the HTTP header, whose Content-Length is the payload's, and leaves the payload out.
    """
    urn = lambda i: f"<urn:page:{'none' if i is None else i}>"
    target = quote(url, safe="%/:?#[]@!$&'()*+,;=~-._") if url else f"urn:page:{'none' if page_id is None else page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Target-URI: {target}", f"WARC-Date: {_DATE}", f"WARC-Record-ID: {urn(page_id)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{sha1}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]):
        raise ValueError("a record is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}, payload


# --- ZIP ---------------------------------------------------------------------------------------


class StoredZipWriter:
    """Writes stored members in one pass; sizes follow the data, in ZIP64 form wherever needed.

    ``force64`` writes the ZIP64 records for small packages too.
    """

    def __init__(self, out, force64: bool = False):
        self.out, self.at, self.members, self.force64 = out, 0, [], force64

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        self.name, self.start, self.crc, self.size = name.encode(), self.at, 0, 0
        # Bit 3: sizes follow the data; the ZIP64 field says they have eight bytes.
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._write(_LOCAL.pack(LOCAL, 45, 0x0808, 0, 0, 0x21, 0, _BIG32, _BIG32, len(self.name), len(extra)) + self.name + extra)

    def write(self, data: bytes) -> int:
        """Returns where in the member the data starts."""
        at = self.size
        self.crc = zlib.crc32(data, self.crc)
        self.size += len(data)
        self._write(data)
        return at

    def end(self) -> None:
        self._write(struct.pack("<IIQQ", 0x08074B50, self.crc, self.size, self.size))
        self.members.append((self.name, self.start, self.crc, self.size))

    def close(self) -> None:
        start = self.at
        for name, at, crc, size in self.members:
            big = self.force64 or max(size, at) >= _BIG32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if big else b""
            shown = (_BIG32, _BIG32) if big else (size, at)
            self._write(_CENTRAL.pack(CENTRAL, 45, 45, 0x0808, 0, 0, 0x21, crc, shown[0], shown[0], len(name), len(extra), 0, 0, 0, 0, shown[1]) + name + extra)
        length, n, end = self.at - start, len(self.members), self.at
        big = self.force64 or n >= _BIG16 or max(start, length) >= _BIG32
        if big:
            self._write(_END64.pack(END64, 44, 45, 45, 0, 0, n, n, length, start) + _LOCATOR64.pack(LOCATOR64, 0, end, 1))
        self._write(_END.pack(END, 0, 0, _BIG16 if big else n, _BIG16 if big else n, _BIG32 if big else length, _BIG32 if big else start, 0))


class StoredZipReader:
    """Members of a package by its central directory; ``read`` is a range read within a member."""

    def __init__(self, file):
        self.file, size = file, file.size()
        tail = file.read_at(min(size, _END.size + 65535), max(0, size - _END.size - 65535))
        for k in range(len(tail) - _END.size, -1, -1):  # a comment may follow, and may hold the signature
            if tail[k : k + 4] == struct.pack("<I", END) and k + _END.size + struct.unpack_from("<H", tail, k + 20)[0] == len(tail):
                break
        else:
            raise ValueError("no end of central directory")
        _, _, _, _, n, length, start, _ = _END.unpack_from(tail, k)
        at = size - len(tail) + k
        if at >= _LOCATOR64.size and (n == _BIG16 or length == _BIG32 or start == _BIG32):
            magic, _, end64, _ = _LOCATOR64.unpack(file.read_at(_LOCATOR64.size, at - _LOCATOR64.size))
            if magic == LOCATOR64:
                magic, *_, n, length, start = _END64.unpack(file.read_at(_END64.size, end64))
                if magic != END64:
                    raise ValueError("damaged ZIP64 record")
        directory, self.members, k = file.read_at(length, start), {}, 0
        for _ in range(n):
            magic, _, _, _, method, _, _, crc, packed, full, names, extras, comments, _, _, _, offset = _CENTRAL.unpack_from(directory, k)
            if magic != CENTRAL:
                raise ValueError("damaged central directory")
            k += _CENTRAL.size
            name = directory[k : k + names].decode("utf-8")
            packed, full, offset = self._wide(directory[k + names : k + names + extras], packed, full, offset)
            k += names + extras + comments
            self.members[name] = (method, offset, packed, full, crc)
        self.starts: dict[str, int] = {}

    @staticmethod
    def _wide(extra: bytes, packed: int, full: int, offset: int) -> tuple[int, int, int]:
        """Values that the ZIP64 field holds in place of those that don't fit."""
        k = 0
        while k + 4 <= len(extra):
            kind, length = struct.unpack_from("<HH", extra, k)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, k + 4))
                full = next(wide) if full == _BIG32 else full
                packed = next(wide) if packed == _BIG32 else packed
                offset = next(wide) if offset == _BIG32 else offset
            k += 4 + length
        return packed, full, offset

    def read(self, name: str, at: int = 0, length: int | None = None) -> bytes:
        """A range of a stored member; a member read whole is checked against the directory's CRC."""
        method, offset, packed, _, crc = self.members[name]
        if method:
            raise ValueError(f"{name} is not stored")
        if name not in self.starts:
            head = _LOCAL.unpack(self.file.read_at(_LOCAL.size, offset))
            if head[0] != LOCAL:
                raise ValueError(f"{name}: no local header")
            self.starts[name] = offset + _LOCAL.size + head[9] + head[10]
        length = packed - at if length is None else length
        if at < 0 or at + length > packed:
            raise ValueError(f"{name}: range outside the member")
        data = self.file.read_at(length, self.starts[name] + at)
        if len(data) == packed and zlib.crc32(data) != crc:
            raise ValueError(f"{name}: its CRC differs from the directory's")
        return data


# --- packages of pages -------------------------------------------------------------------------


def write_archives(pages: DataFrame, folder: str | None = None, records_each: int = 5000, bytes_each: int = 256 << 20, least: int = 0, force64: bool = False, broadcast_rows: int = 500_000) -> DataFrame:
    """Write a record for each page into packages; one row a package: path, records.

    Of rows with equal payloads of at least ``least`` bytes, the smallest page_id is the response;
    others refer to it. Null html is an empty payload; whole pages are written, however long. Rows without
    a page_id, and further rows with the smallest page_id, are responses too unless a smaller id exists.
    No rows give no package; further columns, whatever their names, are not read. Only digests and ids are
    grouped. Up to ``broadcast_rows`` repeated payloads are broadcast and no page is shuffled; beyond, pages
    are dealt by digest and one of SALTS salts.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"))
    sha1 = F.unhex(F.sha1("payload"))
    firsts = rows.where(F.length("payload") >= least).groupBy(sha1.alias("sha1")).agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    # A row for each payload that repeats; payloads themselves are never dealt by a digest that many share.
    firsts = materialise(firsts.where((F.col("n") > 1) & F.col("first").isNotNull()).select("sha1", "first"), "warc-firsts")
    if firsts.count() <= broadcast_rows:
        joined = rows.withColumn("sha1", sha1).join(F.broadcast(firsts), "sha1", "left")
    else:
        salted = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("sha1", sha1).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["sha1", "salt"], "left")
    rows = joined.select("page_id", "url", "payload", F.when((F.col("page_id") != F.col("first")) | F.col("page_id").isNull(), F.col("first")).alias("refers_to"))
    bound_batches(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number, fs = None, 0, None
        for batch in batches:
            for k in range(batch.num_rows):
                if own is None:
                    uri = f"{folder}/pages-{TaskContext.get().partitionId():06d}-{number:04d}-{uuid.uuid4().hex}.zip"
                    fs, path = open_fs(uri)
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(path)
                    own, index, number = StoredZipWriter(out, force64), [], number + 1
                    own.begin(DATA_MEMBER)
                page_id, url, payload, refers_to = (batch.column(c)[k].as_py() for c in range(4))
                sha1 = digest(payload)
                packed = gzip.compress(record(page_id, url, payload, sha1, refers_to), 3, mtime=0)
                at = own.write(packed)
                index.append(json.dumps({"page_id": page_id, "digest": sha1, "offset": at, "length": len(packed)}))
                if len(index) >= records_each or own.size >= bytes_each:
                    yield finish(uri, out, own, index)
                    own = None
        if own is not None:
            yield finish(uri, out, own, index)

    def finish(uri: str, out, own: StoredZipWriter, index: list[str]) -> pa.RecordBatch:
        own.end()
        own.begin(INDEX_MEMBER)
        own.write("".join(f"{x}\n" for x in index).encode())
        own.end()
        own.close()
        out.close()
        return pa.RecordBatch.from_pydict({"path": [uri], "records": [len(index)]}, schema=pa.schema([("path", pa.string()), ("records", pa.int64())]))

    return materialise(rows.mapInArrow(lean(write), "path string, records long"), "warc-manifest")


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """Records of packages: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    A package is one task's work and records are read one by one, so memory is bounded by a record and
    an index. A response's payload is checked against its digest. ``with_payload`` adds the payload, null
    for revisits. No packages give no rows.
    """
    spark = manifest.sparkSession
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    names = [x.split()[0] for x in schema.split(", ")]
    arrow = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]]) for n, x in zip(names, schema.split(", "), strict=True)])
    number = lambda urn: None if urn in (None, "<urn:page:none>") else int(urn[len("<urn:page:") : -1])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = open_fs(path)
                with fs.open_input_file(name) as file:
                    zipped, rows = StoredZipReader(file), []
                    for line in zipped.read(INDEX_MEMBER).splitlines():
                        entry = json.loads(line)
                        raw = gzip.decompress(zipped.read(DATA_MEMBER, entry["offset"], entry["length"]))
                        warc, http, payload = parse(raw)
                        sha1, kind = warc["warc-payload-digest"].removeprefix("sha1:"), warc["warc-type"]
                        if kind == "response" and digest(payload) != sha1:
                            raise ValueError(f"{path}: the payload of {warc['warc-record-id']} differs from its digest")
                        row = (number(warc["warc-record-id"]), warc["warc-target-uri"], int(http["content-length"]), sha1, kind, number(warc.get("warc-refers-to")))
                        rows.append((*row, payload if kind == "response" else None) if with_payload else row)
                        if len(rows) >= (64 if with_payload else 4096):
                            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=arrow)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=arrow)

    paths = manifest.select("path")
    n = max(1, min(paths.count(), 10_000))
    return paths.repartition(n).mapInArrow(lean(read), schema)


#: DuckDB SQL of what reading back gives; base32 is spelt out from the digest's bits.
ORACLE_SQL = """
WITH p AS (
 SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
bits AS (
 SELECT DISTINCT hex, list_reduce(list_transform(range(1, 41), lambda i: lpad(bin(('0x' || hex[i])::INTEGER), 4, '0')), lambda a, b: a || b) AS b FROM p),
digests AS (
 SELECT hex, list_reduce(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 +
  16 * (b[5 * i + 1])::INTEGER + 8 * (b[5 * i + 2])::INTEGER + 4 * (b[5 * i + 3])::INTEGER + 2 * (b[5 * i + 4])::INTEGER + (b[5 * i + 5])::INTEGER]), lambda a, b: a || b) AS payload_digest FROM bits),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
 CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f JOIN digests USING (hex)
"""
