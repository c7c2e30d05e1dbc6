"""WARC records in ZIP packages: written by partitions, read by ranges, never extracted.

A package is a ZIP file with stored members: ``archive/*.warc.gz``, whose records are gzip
members of their own (or ``*.warc``), and ``indexes/*.cdxj``, ``*.cdx`` or either as ``.gz``, a line for each record: a key, a time, and JSON with the
archive's file name, the record's offset and length. The reader fetches a package's tail, walks the end record (and the ZIP64 one where sizes
or counts ask for it) and the central directory, finds the stored members, reads the indexes and
then only the ranges of the records, many packages and ranges at a time. An archive that no index names is walked
from record to record. Packages of others can be read too: records that are neither responses, revisits nor resources are passed over, a
page id is what our own record ids hold, else null.

Of records with equal payloads of ``least`` bytes or more, that with the smallest page id is a
response and the others revisit it.

Defined cases: a null html is an empty payload; rows of equal page id and payload are alike (all
responses or all revisits); a null page id is kept and refers to others like any, but only null ones
have none to refer to; a null url leaves its header out; an empty table gives no package; other
columns are ignored; a very long payload is written and read whole, by one task.
"""

from __future__ import annotations

import gzip
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumfold.llm.common import written

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_GATHERED = ("response", "revisit", "resource")
MANIFEST = "path string, bytes long, records long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _fs(path: str):
    """The file system of a path, and the path there. Hadoop's names of S3 are taken for S3's own."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    scheme, _, rest = path.partition("://")
    try:
        return fs.FileSystem.from_uri(f"s3://{rest}" if scheme in ("s3a", "s3n") else path)
    except (OSError, ValueError) as e:
        raise ValueError(f"packages cannot be kept at {path}: local folders, file, s3, s3a, gs, abfs and (with libhdfs) hdfs are known") from e


def _safe(value: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record, compressed by itself. A revisit has the HTTP head without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    head += [] if url is None else [f"WARC-Target-URI: {_safe(url)}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}"]
    head += [] if refers_to is None else [f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {_REVISIT}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    z = zlib.compressobj(6, wbits=31)
    return z.compress("\r\n".join(head).encode() + body + b"\r\n\r\n") + z.flush()


def surt(url: str) -> str:
    """A URL's key in an index: host reversed, then the path; without white space."""
    rest = _safe(url.partition("://")[2] or url).lower()
    host, slash, path = rest.partition("/")
    name, _, port = host.partition(":")
    return ",".join(reversed(name.split("."))) + (f":{port}" if port else "") + ")/" + path


def parsed(raw: bytes) -> tuple | None:
    """A row of ``RECORDS`` from one record, compressed or plain; None for other kinds of records."""
    text = zlib.decompress(raw, wbits=31) if raw[:2] == b"\x1f\x8b" else raw
    head, _, rest = text.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
    kind = fields.get("warc-type")
    if kind not in _GATHERED:
        return None
    payload = rest[: int(fields["content-length"])]
    size = len(payload)
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = payload.partition(b"\r\n\r\n")
        said = [x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        size = int(said[0]) if said and kind == "revisit" else len(payload)

    def page(name: str) -> int | None:
        urn = fields.get(name, "").strip("<>")
        number = urn.removeprefix("urn:x-page:")
        return int(number) if urn != number and number.lstrip("-").isdigit() else None

    return page("warc-record-id"), fields.get("warc-target-uri"), kind, page("warc-refers-to"), size, fields.get("warc-payload-digest", "").removeprefix("sha256:"), None if kind == "revisit" else payload


class _Package:
    """A ZIP file being written: the records' member first, the index after it."""

    def __init__(self, path: str):
        system, at = _fs(path)
        self.path, self.out = path, system.open_output_stream(at)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
        self.index: list[str] = []
        self.at = 0

    def add(self, url: str | None, digest: str, stamp: str, raw: bytes) -> None:
        self.member.write(raw)
        place = {"url": url or "", "digest": f"sha256:{digest}", "mime": "text/html", "status": "200", "offset": str(self.at), "length": str(len(raw)), "filename": ARCHIVE.partition("/")[2]}
        self.index.append(f"{surt(url or '')} {stamp} {json.dumps(place)}")
        self.at += len(raw)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(f"{x}\n" for x in sorted(self.index)))
        self.zip.close()
        self.out.close()
        return self.path, self.at, len(self.index)


def labelled(pages: DataFrame, least: int = 100) -> DataFrame:
    """``pages`` (page_id, url, html) with their payload's digest and the page they revisit."""
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    narrow = pages.where(F.octet_length("html") >= least).select("page_id", "digest")
    # partial counts per task keep a payload of very many pages from meeting in one place
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = narrow.join(first, "digest").where("NOT page_id <=> refers_to").distinct()
    revisits = revisits.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "refers_to")
    return pages.join(revisits, F.expr("page_id <=> p AND digest = d"), "left").drop("p", "d")


def write(pages: DataFrame, folder: str, least: int = 100, package_bytes: int = 256 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each page to packages in ``folder``; their paths, sizes and counts."""

    _fs(folder)  # an unknown kind of store fails here
    stamp = "".join(c for c in date if c.isdigit())

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, package, done = TaskContext.get(), 0, None, []
        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if package is None:
                    # the attempt's number keeps a task that runs again from meeting its earlier files
                    package, n = _Package(f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{n}.wacz"), n + 1
                package.add(url, digest, stamp, record(page_id, url, html.encode(), digest, refers_to, date))
                if package.at >= package_bytes:
                    done, package = [*done, package.close()], None
        if package is not None:
            done.append(package.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.string(), pa.int64(), pa.int64()))], names=["path", "bytes", "records"])

    rows = labelled(pages, least).select("page_id", "url", "html", "digest", "refers_to")
    if "://" not in folder:
        from pathlib import Path

        Path(folder.removeprefix("file:")).mkdir(parents=True, exist_ok=True)
    elif folder.startswith("file://"):
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(folder)
        system.create_dir(at, recursive=True)
    return written(rows.mapInArrow(put, MANIFEST), "packages")


def directory(read, size: int) -> dict[str, tuple[int, int, int]]:
    """Members of a ZIP file of ``size`` bytes: method, stored size, and where the local header is.

    ``read(offset, length)`` gives bytes of the file.
    """
    tail_at = max(0, size - 22 - 65535 - 20)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("not a ZIP file: no end record")
    count, length, at = struct.unpack_from("<HII", tail, end + 10)
    if count == 0xFFFF or 0xFFFFFFFF in (length, at):
        where = tail.rfind(b"PK\x06\x07", 0, end)
        if where < 0:
            raise ValueError("the ZIP64 locator is missing")
        (end64,) = struct.unpack_from("<Q", tail, where + 8)
        record64 = read(end64, 56)
        if record64[:4] != b"PK\x06\x06":
            raise ValueError("the ZIP64 end record is missing")
        count, length, at = struct.unpack_from("<QQQ", record64, 32)
    central, members, p = read(at, length), {}, 0
    for _ in range(count):
        if central[p : p + 4] != b"PK\x01\x02":
            raise ValueError("the central directory is damaged")
        method, (stored, plain), (n, extra, note), header = struct.unpack_from("<H", central, p + 10)[0], struct.unpack_from("<II", central, p + 20), struct.unpack_from("<HHH", central, p + 28), struct.unpack_from("<I", central, p + 42)[0]
        name, q, stop = central[p + 46 : p + 46 + n].decode(), p + 46 + n, p + 46 + n + extra
        while q + 4 <= stop:
            kind, width = struct.unpack_from("<HH", central, q)
            if kind == 1:  # the sizes and the offset that did not fit, in this order
                wide = iter(struct.unpack_from(f"<{width // 8}Q", central, q + 4))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                stored = next(wide) if stored == 0xFFFFFFFF else stored
                header = next(wide) if header == 0xFFFFFFFF else header
            q += 4 + width
        members[name] = method, stored, header
        p = stop + note
    return members


def data_start(read, header: int) -> int:
    """Where a member's bytes begin: after its local header, whose extra fields are its own."""
    local = read(header, 30)
    if local[:4] != b"PK\x03\x04":
        raise ValueError("a local header is missing")
    return header + 30 + sum(struct.unpack_from("<HH", local, 26))


def places(get, members: dict[str, tuple[int, int, int]], path: str) -> Iterator[tuple[int, list[int]]]:
    """(offset in the file, lengths) of runs of records that follow each other, from the indexes or else from the records."""
    archives = {n: m for n, m in members.items() if n.startswith("archive/") and n.endswith((".warc.gz", ".warc"))}
    for name, m in archives.items():
        if m[0] != zipfile.ZIP_STORED:
            raise ValueError(f"{name} in {path} is not stored")
    found: dict[str, set[tuple[int, int]]] = {}
    for name, (method, size, header) in members.items():
        if not name.startswith("indexes/") or not name.removesuffix(".gz").endswith((".cdxj", ".cdx")):
            continue
        data = get(data_start(get, header), size)
        data = zlib.decompress(data, wbits=-15) if method == zipfile.ZIP_DEFLATED else data
        data = gzip.decompress(data) if name.endswith(".gz") else data
        for line in data.decode().splitlines():
            if "{" in line and not line.startswith("!"):
                x = json.loads(line[line.index("{") :])
                if {"filename", "offset", "length"} <= x.keys():
                    found.setdefault(f"archive/{x['filename'].rpartition('/')[2]}", set()).add((int(x["offset"]), int(x["length"])))
    for name, (_, size, header) in archives.items():
        start = data_start(get, header)
        runs = sorted(found[name]) if name in found else walked(get, start, size, name.endswith(".gz"))
        begin, end, lengths = 0, 0, []
        for at, length in runs:
            if lengths and at != end:
                yield start + begin, lengths
                lengths = []
            begin = begin if lengths else at
            end = at + length
            lengths.append(length)
        if lengths:
            yield start + begin, lengths


def walked(get, start: int, size: int, packed: bool, step: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(offset, length) of an archive's records, read one after another."""
    at = 0
    while at < size:
        if packed:
            z, n = zlib.decompressobj(wbits=31), 0
            while not z.eof:
                block = get(start + at + n, min(step, size - at - n))
                if not block:
                    raise ValueError("an archive ends within a record")
                z.decompress(block)
                n += len(block) - len(z.unused_data)
        else:
            block = get(start + at, min(step, size - at))
            head, _, _ = block.partition(b"\r\n\r\n")
            body = next(int(x.partition(b":")[2]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
            n = len(head) + 4 + body + 4
        yield at, n
        at += n


def read(packages: DataFrame, range_bytes: int = 4 << 20) -> DataFrame:
    """Rows of ``RECORDS`` of all packages in ``packages`` (path)."""

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, where = _fs(path)
                rows = []
                with system.open_input_file(where) as f:
                    get = lambda offset, length: f.read_at(length, offset)  # noqa: E731, B023
                    for at, lengths in places(get, directory(get, f.size()), path):
                        lo = used = 0
                        for k, n in enumerate(lengths):
                            used += n
                            if used >= range_bytes or k + 1 == len(lengths):
                                rows.append((path, at, lengths[lo : k + 1]))
                                at, lo, used = at + used, k + 1, 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.list_(pa.int64())))], names=["path", "at", "lengths"])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        for batch in batches:
            for path, at, lengths in zip(*(c.to_pylist() for c in batch.columns)):
                system, where = _fs(path)
                with system.open_input_file(where) as f:
                    block = f.read_at(sum(lengths), at)
                rows, p = [], 0
                for n in lengths:
                    rows.append(parsed(block[p : p + n]))
                    p += n
                rows = [r for r in rows if r is not None]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[x.split()[0] for x in RECORDS.split(", ")])

    listed = packages.select("path").repartition("path").mapInArrow(ranges, "path string, at long, lengths array<long>")
    return listed.repartition("path", "at").mapInArrow(records, RECORDS)


def report(records: DataFrame) -> DataFrame:
    """Per record: length and digest of the full payload, as read where the record has it."""
    digest = F.when(F.col("record_type") != "revisit", F.sha2("payload", 256)).otherwise(F.col("payload_digest"))
    size = F.when(F.col("record_type") != "revisit", F.octet_length("payload")).otherwise(F.col("payload_bytes"))
    return records.select("page_id", size.cast("long").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")
