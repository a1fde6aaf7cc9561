"""Web archives in ZIP packages: WARC records, compressed one by one, that are read in place.

A package is a ZIP file whose members are stored, not compressed, so that a record lies in the package as it lies in the
member: `archive/data.warc.gz` (one gzip member a record), `indexes/index.cdx` (record id, offset and length, sorted by
id) and `datapackage.json`. A reader parses the ZIP directories, finds archive and index, and reads only the byte ranges of
the records that it wants; nothing is unpacked to disk.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain
from urllib.parse import quote, unquote

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tessera.llm.batches import release_memory, slices
from tessera.llm.sstable import _store_of, qualified
from tessera.scratch import materialise, row_keys, shared_dir
from tessera.session import spread

ARCHIVE, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdx", "datapackage.json"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: Compressed bytes after which a task starts its next package, and bytes of records that are read at once.
PACKAGE_BYTES, RANGE_BYTES = 128 << 20, 4 << 20
#: Fixed values of the ZIP format: signatures, sizes of the fixed parts, and the id of the ZIP64 field.
END, END64, LOCATOR, ENTRY, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
END_SIZE, END64_SIZE, LOCATOR_SIZE, ENTRY_SIZE, LOCAL_SIZE, COMMENT, ZIP64 = 22, 56, 20, 46, 30, 65535, 1


class Package:
    """Members of a ZIP file by name, as (place of their first byte, size), from its directories alone."""

    def __init__(self, file):
        self.file, end = file, file.seek(0, 2)
        tail = self.read(max(0, end - END_SIZE - COMMENT), min(end, END_SIZE + COMMENT))
        at = tail.rfind(END)
        while at >= 0 and at + END_SIZE + int.from_bytes(tail[at + 20 : at + 22], "little") != len(tail):
            at = tail.rfind(END, 0, at)  # these letters may stand in the comment, too
        if at < 0:
            raise ValueError("not a whole ZIP file")
        entries, size, start = struct.unpack_from("<HII", tail, at + 10)
        here = end - len(tail) + at
        if here >= LOCATOR_SIZE and (locator := self.read(here - LOCATOR_SIZE, LOCATOR_SIZE))[:4] == LOCATOR:
            whole = self.read(struct.unpack_from("<Q", locator, 8)[0], END64_SIZE)
            if whole[:4] != END64:
                raise ValueError("damaged ZIP64 directory")
            entries, size, start = struct.unpack_from("<QQQ", whole, 32)
        self.members: dict[str, tuple[int, int, int]] = {}
        directory, at = self.read(start, size), 0
        for _ in range(entries):
            if directory[at : at + 4] != ENTRY:
                raise ValueError("damaged ZIP directory")
            flags, method = struct.unpack_from("<HH", directory, at + 8)
            packed, plain, name, extra, comment = struct.unpack_from("<IIHHH", directory, at + 20)
            (place,) = struct.unpack_from("<I", directory, at + 42)
            at += ENTRY_SIZE
            label = directory[at : at + name].decode("utf-8" if flags & 0x800 else "cp437")
            plain, packed, place = _widened(directory[at + name : at + name + extra], plain, packed, place)
            self.members[label] = (place, packed, method)
            at += name + extra + comment

    def read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return bytes(self.file.read(size))

    def locate(self, name: str) -> tuple[int, int]:
        """Place and size of the bytes of a stored member."""
        place, size, method = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed; only stored members can be read in ranges")
        head = self.read(place, LOCAL_SIZE)
        if head[:4] != LOCAL:
            raise ValueError(f"{name} is not where the directory says")
        return place + LOCAL_SIZE + sum(struct.unpack_from("<HH", head, 26)), size

    def index(self) -> list[tuple[str, int, int]]:
        """(record id, offset in the archive, length), sorted by id; repeated ids follow one another."""
        lines = self.read(*self.locate(INDEX)).decode().splitlines()
        return [(key, int(offset), int(length)) for key, offset, length in (line.split(" ") for line in lines)]

    def get(self, record_id: str) -> dict | None:
        """The first record with this id, by binary search and one range read, or None."""
        index = self.index()
        at = bisect_left(index, (record_id, -1, -1))
        if at == len(index) or index[at][0] != record_id:
            return None
        return next(records(self.read(self.locate(ARCHIVE)[0] + index[at][1], index[at][2])))


def _widened(extra: bytes, *values: int) -> list[int]:
    """Sizes and place of an entry, those at their greatest value taken from the ZIP64 field, in order."""
    out, at, wide, most = list(values), 0, b"", 0xFFFFFFFF
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == ZIP64:
            wide = extra[at + 4 : at + 4 + size]
        at += 4 + size
    for i, value in enumerate(values):
        if value == most:
            (out[i],), wide = struct.unpack_from("<Q", wide), wide[8:]
    return out


def sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def id_of(page_id: int | None, row: str) -> str:
    """Record ids name the page and the row, since page ids may repeat."""
    return f"urn:page:{'' if page_id is None else page_id}:{row}"


def page_of(record_id: str) -> int | None:
    page = record_id.split(":")[2]
    return int(page) if page else None


def record(record_id: str, url: str | None, payload: bytes, refers_to: str | None = None, date: str = DATE) -> bytes:
    """One record, gzipped. A revisit keeps the head of the response, with the length of the payload, but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = {"WARC-Type": "revisit" if refers_to else "response", "WARC-Record-ID": f"<{record_id}>", "WARC-Date": date}
    if url is not None:
        head["WARC-Target-URI"] = quote(url, safe="!#$&'()*+,/:;=?@[]%-._~")
    if refers_to:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{refers_to}>", "WARC-Refers-To-Date": date, "WARC-Truncated": "length"}
    block = http if refers_to else http + payload
    head |= {"WARC-Payload-Digest": f"sha1:{sha1(payload)}", "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n") + pack.flush()


def _fields(lines: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines.decode("utf-8", "replace").split("\r\n")[1:])}


def records(data: bytes) -> Iterator[dict]:
    """The records of a run of gzip members: fields by lower-case name, `http` fields, `payload` (None for a revisit)."""
    while data:
        unpack = zlib.decompressobj(31)
        raw = unpack.decompress(data)
        if not unpack.eof:
            raise ValueError("a record is cut off")
        data = unpack.unused_data
        head, _, rest = raw.partition(b"\r\n\r\n")
        if not head.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        out = _fields(head)
        size = int(out["content-length"])
        block = rest[:size]
        if len(block) != size or rest[size:] != b"\r\n\r\n":
            raise ValueError("a record's length is wrong")
        http, _, payload = block.partition(b"\r\n\r\n")
        yield out | {"http": _fields(http), "payload": None if out["warc-type"] == "revisit" else payload}


def _write_package(fs, path: str, made: Iterator[tuple[str, bytes]]) -> int:
    """One package of records from `made` up to PACKAGE_BYTES; returns how many it took."""
    index, at = [], 0
    with fs.open_output_stream(path) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as package:
        with package.open(ARCHIVE, "w", force_zip64=True) as member:
            for key, data in made:
                member.write(data)
                index.append((key, at, len(data)))
                at += len(data)
                if at >= PACKAGE_BYTES:
                    break
        lines = "".join(f"{key} {offset} {length}\n" for key, offset, length in sorted(index)).encode()
        package.writestr(INDEX, lines)
        parts = [{"path": ARCHIVE, "bytes": at}, {"path": INDEX, "bytes": len(lines), "hash": f"sha256:{hashlib.sha256(lines).hexdigest()}"}]
        package.writestr(PACKAGE, json.dumps({"profile": "data-package", "resources": parts}))
    return len(index)


def revisits(rows: DataFrame, keys: list[str], least_bytes: int = 0) -> DataFrame:
    """(keys, first_page, first_row) for each row whose payload an earlier one has: that of the smallest page_id, null last."""
    narrow = materialise(rows.select(*keys, "page_id", F.octet_length("html").alias("size"), F.sha2(F.col("html").cast("binary"), 256).alias("content")))
    first = F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", *keys)).alias("first")
    groups = narrow.where(F.col("size") >= least_bytes).groupBy("content").agg(first, F.count(F.lit(1)).alias("rows")).where("rows > 1")
    later = narrow.join(groups, "content").where(F.struct(*keys) != F.struct(*(F.col(f"first.{k}") for k in keys)))
    return later.select(*keys, F.col("first.page_id").alias("first_page"), F.concat_ws("-", *(F.col(f"first.{k}") for k in keys)).alias("first_row"))


def write_packages(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = DATE) -> DataFrame:
    """Write all pages as packages under `folder` (which all executors reach); returns the manifest: uri, records.

    Rows are judged by themselves, so page ids may be null or repeat. Of equal payloads of `least_bytes` or more the row of
    the smallest page_id is the response (null last, then the place of the row), the others are revisits of it; shorter
    payloads are all responses. Payloads are equal if their SHA-256 is. Groups come from narrow rows and partial
    aggregates; the list of revisits is joined to the pages, which Spark broadcasts while it is small. Each task writes
    its rows to packages of its own, of bounded size and under names never used before; the manifest, a written table,
    names those of the attempts that ended well, and only they count. An empty table writes none.
    """
    spark = pages.sparkSession
    folder = qualified(spark, folder)
    rows, keys = row_keys(pages.select("page_id", "url", "html"))
    rows = rows.withColumn("html", F.coalesce("html", F.lit("")))
    todo = spread(rows).join(materialise(revisits(rows, keys, least_bytes)), keys, "left").withColumn("row", F.concat_ws("-", *keys)).drop(*keys)

    def run(batches):
        fs, base = _store_of(folder)
        fs.create_dir(base, recursive=True)
        task, attempt, number = TaskContext.get().partitionId(), uuid.uuid4().hex, 0

        def made() -> Iterator[tuple[str, bytes]]:
            names = ("page_id", "url", "html", "row", "first_page", "first_row")
            for batch in slices(batches, "html"):
                for page, url, html, row, first_page, first_row in zip(*(batch.column(c).to_pylist() for c in names)):
                    key = id_of(page, row)
                    yield key, record(key, url, html.encode(), None if first_row is None else id_of(first_page, first_row), date)

        source = made()
        ahead = next(source, None)
        while ahead is not None:
            path = f"part-{task:06d}-{number:04d}-{attempt}.wacz"
            took = _write_package(fs, f"{base}/{path}", chain([ahead], source))
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{path}"]), pa.array([took], pa.int64())], names=["uri", "records"])
            number, ahead = number + 1, next(source, None)

    return materialise(todo.mapInArrow(run, "uri string, records long"))


def record_ranges(manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(uri, at, size): runs of whole records in the packages, by their directories and indexes."""

    def run(batches):
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                fs, path = _store_of(uri)
                with fs.open_input_file(path) as file:
                    package = Package(file)
                    start, size = package.locate(ARCHIVE)
                    runs: list[list[int]] = []
                    for offset, length in sorted((o, n) for _, o, n in package.index()):
                        if offset + length > size:
                            raise ValueError("the index leaves the archive")
                        if runs and runs[-1][1] + length <= range_bytes and sum(runs[-1]) == start + offset:
                            runs[-1][1] += length
                        else:
                            runs.append([start + offset, length])
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(runs)), *(pa.array(x, pa.int64()) for x in zip(*runs))], names=["uri", "at", "size"])

    return manifest.select("uri").mapInArrow(run, "uri string, at long, size long")


def read_records(manifest: DataFrame) -> DataFrame:
    """One row per record of the packages: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    Ranges of records are dealt over all tasks, each read alone. A payload that does not have its digest or length is an error.
    """
    spark = manifest.sparkSession
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for uri, at, size in zip(*(batch.column(c).to_pylist() for c in ("uri", "at", "size"))):
                fs, path = _store_of(uri)
                with fs.open_input_file(path) as file:
                    file.seek(at)
                    data = bytes(file.read(size))
                rows = []
                for r in records(data):
                    size, digest = int(r["http"]["content-length"]), r["warc-payload-digest"].partition(":")[2]
                    if r["payload"] is not None and (len(r["payload"]), sha1(r["payload"])) != (size, digest):
                        raise ValueError("a payload is damaged")
                    refers = r.get("warc-refers-to")
                    url = r.get("warc-target-uri")
                    rows.append((page_of(r["warc-record-id"][1:-1]), url and unquote(url), size, digest, r["warc-type"], refers and page_of(refers[1:-1])))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)
            release_memory()

    ranges = materialise(record_ranges(manifest.repartition(max(1, min(manifest.count(), 4096)), "uri")))
    return ranges.repartition(max(1, spark.sparkContext.defaultParallelism), "uri", "at").mapInArrow(run, schema)


def archived_pages(pages: DataFrame, least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write pages as WARC records in ZIP packages and return what the packages hold, one row per page.

    page_id, payload_bytes, payload_digest (SHA-1 in base32, upper case), record_type (response or revisit), refers_to (the
    response's page_id for revisits; null if that page has none). A null html is an empty payload, a null url is left
    out. Repeated rows are revisits of the first of them. Other columns are not read; an empty table gives an empty result.
    `folder` is by default a new one in the session's shared folder.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/tessera-warc-{uuid.uuid4().hex}"
    return read_records(write_packages(pages, folder, least_bytes)).drop("url")
