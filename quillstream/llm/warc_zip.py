"""WARC records in ZIP packages: writing, and reading by range without extraction.

A package is a ZIP file whose members are stored, not deflated: ``archive/data.warc.gz``, WARC 1.1 records with one gzip
member each, and ``indexes/index.cdxj``, a line per record with its offset and length. The reader looks at the end of
the package for the central directory (by way of the ZIP64 records where there are any), finds where the stored members
begin, reads the index, and reads each record by its range.

Payloads of at least ``LEAST`` bytes that are equal are written once, as the response with the largest page_id; the
others are revisits that name it. Packages are written below a folder that all executors see, under the name of their
task's attempt; a package counts once the row that names it is there, so what a lost attempt leaves is never read.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.staging import map_arrow, new_folder, stage

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
LEAST = 1000
#: A package is closed when its data reach this size.
PACKAGE_BYTES = 32 << 20
#: Records that a task reads of a package at once.
BLOCK_RECORDS = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads that several pages have are broadcast up to so many; the pages of one are dealt over SALT tasks beyond.
BROADCAST, SALT = 50_000, 32


def record(page: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None) -> bytes:
    """A WARC record: a response with its payload, or a revisit without. The payload's size is given in both."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Target-URI: {quote(url, safe=':/?&=#%~+,;@!$()*')}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Refers-To-Target-URI: {quote(refers_url or '', safe=':/?&=#%~+,;@!$()*')}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Package:
    """A package being written to ``stream``; members are stored, ZIP64 records are used throughout."""

    def __init__(self, stream):
        self.zip = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(DATA, "w", force_zip64=True)
        self.index, self.size = [], 0

    def add(self, page: int | None, url: str, raw: bytes, digest: str) -> None:
        packed = gzip.compress(raw, 5, mtime=0)
        self.member.write(packed)
        self.index.append(f"{quote(url, safe='')} 20240101000000 " + json.dumps({"page": page, "offset": self.size, "length": len(packed), "digest": f"sha1:{digest}"}))
        self.size += len(packed)

    def close(self) -> None:
        self.member.close()
        self.zip.writestr(INDEX, "\n".join(self.index) + "\n")
        self.zip.close()


def directory(source, size: int) -> dict[str, tuple[int, int]]:
    """name -> (place of its first byte, length) of the stored members of a ZIP file of ``size`` bytes.

    ``source`` has seek and read. Reads the end record, the ZIP64 end record where the locator is there, the central
    directory with its ZIP64 fields, and each member's local header. Raises ValueError for compressed or encrypted ones.
    """

    def at(place: int, n: int) -> bytes:
        source.seek(place)
        return source.read(n)

    tail_at = max(0, size - 65557)
    tail = at(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("not a ZIP file")
    count, length, first = struct.unpack("<HII", tail[end + 10 : end + 20])
    locator = tail[max(0, end - 20) : end]
    if locator[:4] == b"PK\x06\x07":
        end64 = at(struct.unpack("<Q", locator[8:16])[0], 56)
        if end64[:4] != b"PK\x06\x06":
            raise ValueError("broken ZIP64 end record")
        count, length, first = struct.unpack("<QQQ", end64[32:56])
    entries, k, out = at(first, length), 0, {}
    for _ in range(count):
        if entries[k : k + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        flags, method = struct.unpack("<HH", entries[k + 8 : k + 12])
        packed, plain, n_name, n_extra, n_comment = struct.unpack("<IIHHH", entries[k + 20 : k + 34])
        local = struct.unpack("<I", entries[k + 42 : k + 46])[0]
        name = entries[k + 46 : k + 46 + n_name].decode("utf-8")
        extra = entries[k + 46 + n_name : k + 46 + n_name + n_extra]
        while len(extra) >= 4:
            tag, n = struct.unpack("<HH", extra[:4])
            if tag == 1:  # the 64-bit values of the fields that are full, in this order
                field = extra[4 : 4 + n]
                if plain == 0xFFFFFFFF:
                    plain, field = struct.unpack("<Q", field[:8])[0], field[8:]
                if packed == 0xFFFFFFFF:
                    packed, field = struct.unpack("<Q", field[:8])[0], field[8:]
                if local == 0xFFFFFFFF:
                    local = struct.unpack("<Q", field[:8])[0]
            extra = extra[4 + n :]
        if method or flags & 1 or packed != plain:
            raise ValueError(f"member {name} isn't stored")
        head = at(local, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("broken local header")
        out[name] = (local + 30 + sum(struct.unpack("<HH", head[26:30])), plain)
        k += 46 + n_name + n_extra + n_comment
    return out


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of a WARC record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return headers, rest[: int(headers["content-length"])].partition(b"\r\n\r\n")[2]


def index_blocks(source, size: int, records: int) -> Iterator[tuple[int, int, int, int]]:
    """(place of the archive, its length, place in the index, length there) of each run of ``records`` index lines."""
    members = directory(source, size)
    (first, length), (index, n) = members[DATA], members[INDEX]
    source.seek(index)
    at = taken = lines = 0
    while at < n:
        part = source.read(min(1 << 20, n - at))
        k = part.find(b"\n")
        while k >= 0:
            lines += 1
            if lines == records:
                yield first, length, index + taken, at + k + 1 - taken
                taken, lines = at + k + 1, 0
            k = part.find(b"\n", k + 1)
        at += len(part)
    if taken < n:
        yield first, length, index + taken, n - taken


def read_records(source, first: int, length: int, index: int, n: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and payload of each record that the index names between ``index`` and ``index + n``, by its range."""
    source.seek(index)
    for line in source.read(n).decode().splitlines():
        where = json.loads(line.split(" ", 2)[2])
        if where["offset"] + where["length"] > length:
            raise ValueError("the index points past its archive")
        source.seek(first + where["offset"])
        yield parse(zlib.decompress(source.read(where["length"]), 31))


def write_packages(pages: DataFrame, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write each row of ``pages`` (page_id, url, html) as a record; returns (path, records), a row per package.

    Other columns are ignored. Null html is an empty payload, null url an empty one; a null page_id stays null. Rows that
    repeat a page_id are written each; of equal payloads those of the largest page_id are all responses. An empty table
    gives no package.
    """
    spark = pages.sparkSession
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("n", F.octet_length("payload"))
    same = rows.where(F.col("n") >= LEAST).groupBy("digest", "n").agg(F.count("*").alias("copies"), F.max(F.struct("page_id", "url")).alias("last"))
    same = stage(same.where("copies > 1").selectExpr("digest as _digest", "n as _n", "last.page_id as _to", "last.url as _to_url"), "equal-payloads")
    if same.limit(BROADCAST + 1).count() <= BROADCAST:
        revisits, on = F.broadcast(same), (F.col("digest") == F.col("_digest")) & (F.col("n") == F.col("_n"))
    else:
        # what each page refers to is found without payloads, a common payload's pages dealt over SALT tasks, and then meets
        # the payloads by page
        names = rows.where(F.col("n") >= LEAST).select("page_id", "digest", "n", F.pmod(F.xxhash64("page_id"), F.lit(SALT)).alias("_salt")).distinct()
        salted = same.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
        found = names.join(salted, (F.col("digest") == F.col("_digest")) & (F.col("n") == F.col("_n")) & (names["_salt"] == salted["_salt"]))
        revisits = stage(found.select(F.col("page_id").alias("_page"), "_digest", "_n", "_to", "_to_url"), "revisits")
        on = F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")) & (F.col("n") == F.col("_n"))
    rows = rows.join(revisits, on, "left")
    rows = rows.selectExpr("page_id", "url", "payload", "digest", "if(page_id = _to, null, _to) as refers_to", "if(page_id = _to, null, _to_url) as refers_url")
    folder = new_folder(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        files, root = pafs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        part, package, stream, name = 0, None, None, ""

        def close() -> pa.RecordBatch:
            package.close()
            stream.close()
            return pa.record_batch([pa.array([f"{folder}/{name}"]), pa.array([len(package.index)], pa.int64())], ["path", "records"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to", "refers_url")), strict=True):
                if package is None:
                    name = f"part-{task.partitionId():06d}-{part:04d}-{task.taskAttemptId()}.wacz"
                    stream = files.open_output_stream(f"{root}/{name}")
                    package = Package(stream)
                package.add(row[0], row[1], record(*row), row[3])
                if package.size >= package_bytes:
                    yield close()
                    package, part = None, part + 1
        if package is not None:
            yield close()

    return stage(map_arrow(rows, write, "path string, records bigint"), "packages")


def _read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "actual_bytes", "actual_digest"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    page = lambda x: int(x[len("<urn:page:") : -1]) if x != "<urn:page:>" else None
    for batch in batches:
        for block in batch.to_pylist():
            files, inner = pafs.FileSystem.from_uri(block.pop("path"))
            rows = []
            with files.open_input_file(inner) as source:
                for h, payload in read_records(source, **block):
                    response = h["warc-type"] == "response"
                    rows.append((page(h["warc-record-id"]), h["warc-target-uri"], h["warc-type"], None if response else page(h["warc-refers-to"]), int(h["x-payload-length"]), h["warc-payload-digest"].removeprefix("sha1:"), len(payload) if response else None, hashlib.sha1(payload).hexdigest() if response else None))
            if rows:
                yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_packages(packages: DataFrame, block_records: int = BLOCK_RECORDS) -> DataFrame:
    """The records of the packages whose ``path`` is given, read in blocks of ``block_records`` by many tasks.

    page_id, record_type, refers_to, payload_digest and payload_bytes as the record states them, actual_digest and
    actual_bytes of the payload that was read (null for revisits), url.
    """
    spark = packages.sparkSession

    def list_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, inner = pafs.FileSystem.from_uri(path)
                with files.open_input_file(inner) as source:
                    rows = [(path, *x) for x in index_blocks(source, source.size(), block_records)]
                if rows:
                    yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), [pa.string(), *[pa.int64()] * 4], strict=True)], ["path", "first", "length", "index", "n"])

    tasks = lambda n: max(1, min(n, 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    listed = map_arrow(packages.select("path").repartition(tasks(packages.count()), "path"), list_blocks, "path string, first bigint, length bigint, index bigint, n bigint")
    blocks = stage(listed, "package-blocks")
    spread = blocks.repartition(tasks(blocks.count()), "path", "index")
    return map_arrow(spread, _read_blocks, "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, actual_bytes bigint, actual_digest string")


def archived(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, intact of each page, read back from packages."""
    records = read_packages(write_packages(pages))
    intact = F.coalesce((F.col("payload_bytes") == F.col("actual_bytes")) & (F.col("payload_digest") == F.col("actual_digest")), F.col("record_type") == "revisit")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", intact.alias("intact"))
