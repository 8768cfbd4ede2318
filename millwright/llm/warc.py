"""WARC archives and a two-level capture index.

Tasks write gzip members, one record each, to files of their own in the shared folder; the rows they
return name only files of attempts that succeeded. The index sorts captures by reversed-host URL key
into files of compressed blocks. A small table lists the index files by first key; every file ends
with a sparse directory of its blocks. A lookup searches the file list, then the directory, then the
block, and reads one byte range of an archive.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from millwright.session import scratch_path

from .files import RangeReader, locate
from .shared import map_arrow, written

LEAST_SHARED = 100
ARCHIVE_BYTES = 256 << 20
BLOCK_CAPTURES = 1000
FILE_CAPTURES = 500_000
READ_CAPTURES = 20_000
KEPT_BLOCKS = 8
CAPTURED = "1970-01-01T00:00:00Z"
NO_ID = -(2**63)

CAPTURE = StructType(
    [
        StructField("key", StringType()),
        StructField("page_id", LongType()),
        StructField("file", StringType()),
        StructField("offset", LongType()),
        StructField("length", LongType()),
    ]
)
INDEX_FILE = StructType(
    [
        StructField("first_key", StringType()),
        StructField("first_id", LongType()),
        StructField("file", StringType()),
        StructField("size", LongType()),
    ]
)
RECORD = StructType(
    [
        StructField("page_id", LongType()),
        StructField("url", StringType()),
        StructField("record_type", StringType()),
        StructField("refers_to", LongType()),
        StructField("payload_bytes", LongType()),
        StructField("payload_digest", StringType()),
        StructField("payload", BinaryType()),
    ]
)


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, then port, path and query; no scheme, no fragment."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url
    labels = ",".join(reversed(host.split("."))) if host else ""
    query = f"?{parts.query}" if parts.query else ""
    return f"{labels}{f':{port}' if port else ''}){parts.path or '/'}{query}"


def one_line(value: str) -> str:
    """A header value: what would end the line is percent-encoded."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def plain(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member: a response with its payload, or a revisit without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    lines.append(f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>")
    lines.append(f"WARC-Date: {CAPTURED}")
    if url is not None:
        lines.append("WARC-Target-URI: " + one_line(url))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    coder = zlib.compressobj(3, zlib.DEFLATED, 31)
    return coder.compress("\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + coder.flush()


def page_number(urn: str) -> int | None:
    number = urn.strip("<>").rpartition(":")[2]
    return int(number) if number else None


def parse(member: bytes) -> tuple:
    """(page_id, url, type, refers_to, payload length, digest, payload) of a record; a revisit has no payload."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(line[16:]) for line in http.decode().split("\r\n") if line.startswith("Content-Length: "))
    url = fields.get("WARC-Target-URI")
    page = page_number(fields["WARC-Record-ID"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "revisit":
        return page, url and plain(url), "revisit", page_number(fields["WARC-Refers-To"]), length, digest, None
    if len(payload) != length or hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"damaged record of page {page}")
    return page, plain(url) if url is not None else None, "response", None, length, digest, payload


def with_references(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): a record refers to the smallest id with its payload."""
    body = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = rows.where(F.length("payload") >= least)
    first = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("last > first")
    shared = (F.length("payload") >= least) & (F.col("page_id") > F.col("first"))
    return rows.join(first.drop("last"), "digest", "left").select("page_id", "url", "payload", "digest", F.when(shared, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_SHARED, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) below ``folder``; returns the captures.

    A null html is an empty payload. Of records with equal payloads of ``least`` bytes or more the one
    with the smallest page_id is a response, the others are revisits of it; rows that repeat that id
    are responses too, and rows without an id always are. Smaller payloads are always responses.
    """
    rows = with_references(pages, least)

    def run(batches):
        stream, uri, offset = None, None, 0
        for batch in batches:
            found = []
            for page_id, url, payload, digest, refers in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if stream is None or offset >= archive_bytes:
                    if stream:
                        stream.close()
                    uri, offset = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                    system, path = locate(uri)
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    stream = system.open_output_stream(path, compression=None)
                member = record(page_id, url, payload, digest, refers)
                stream.write(member)
                found.append((url_key(url), page_id, uri, offset, len(member)))
                offset += len(member)
            if found:
                yield [pa.array(c, t) for c, t in zip(zip(*found, strict=True), CAPTURE_ARROW, strict=True)]
        if stream:
            stream.close()

    return written(map_arrow(rows, run, CAPTURE), "warc-captures")


CAPTURE_ARROW = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]


def order_of(key: str | None, page_id: int | None) -> tuple[str, int]:
    """Captures sort by key, then page id; a missing id comes first."""
    return key or "", NO_ID if page_id is None else page_id


def write_index_file(captures: Iterator[tuple], folder: str, block: int) -> tuple | None:
    """Write sorted captures as compressed blocks, then the block directory and its length."""
    system = stream = uri = None
    directory, lines, offset, first = [], [], 0, None

    def flush():
        nonlocal offset
        data = zlib.compress("\n".join(lines).encode("utf-8", "surrogatepass"), 6)
        stream.write(data)
        directory.append([*start, offset, len(data)])
        offset += len(data)
        lines.clear()

    for capture in captures:
        if stream is None:
            uri = f"{folder}/{uuid.uuid4().hex}.cdx"
            system, path = locate(uri)
            system.create_dir(path.rpartition("/")[0], recursive=True)
            stream = system.open_output_stream(path, compression=None)
            first = order_of(*capture[:2])
        if not lines:
            start = order_of(*capture[:2])
        lines.append(json.dumps(capture))
        if len(lines) >= block:
            flush()
    if stream is None:
        return None
    if lines:
        flush()
    data = zlib.compress(json.dumps(directory).encode(), 6)
    stream.write(data + len(data).to_bytes(8, "little"))
    stream.close()
    return (*first, uri, offset + len(data) + 8)


def write_index(captures: DataFrame, folder: str, block: int = BLOCK_CAPTURES, file_captures: int = FILE_CAPTURES) -> DataFrame:
    """Sort ``captures`` into index files; returns one row per file, in (first_key, first_id)."""
    rows = captures.withColumns({"key": F.coalesce("key", F.lit("")), "__id": F.coalesce("page_id", F.lit(NO_ID))})
    files = max(1, -(-captures.count() // file_captures))
    ordered = rows.repartitionByRange(files, "key", "__id").sortWithinPartitions("key", "__id").drop("__id")

    def run(batches):
        captured = (c for b in batches for c in zip(*[x.to_pylist() for x in b.columns], strict=True))
        if row := write_index_file(captured, folder, block):
            yield [pa.array([x], t) for x, t in zip(row, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)]

    return written(map_arrow(ordered, run, INDEX_FILE), "warc-index")


class CaptureIndex:
    """Finds captures in index files by binary search; keeps a few blocks and the directories it used."""

    def __init__(self, files: list[tuple[str, int, str, int]], kept: int = KEPT_BLOCKS):
        self.files = sorted(files)
        self.starts = [(f[0], f[1]) for f in self.files]
        self.read = RangeReader()
        self.kept = kept
        self.directories: dict[str, tuple[list, list]] = {}
        self.blocks: dict[tuple[str, int], tuple[list, list]] = {}

    def directory(self, at: int) -> tuple[list, list]:
        _, _, uri, size = self.files[at]
        if uri not in self.directories:
            if len(self.directories) >= self.kept:
                self.directories.pop(next(iter(self.directories)))
            length = int.from_bytes(self.read(uri, size - 8, 8), "little")
            rows = json.loads(zlib.decompress(self.read(uri, size - 8 - length, length)))
            self.directories[uri] = [(r[0], r[1]) for r in rows], rows
        return self.directories[uri]

    def block(self, at: int, number: int) -> tuple[list, list]:
        uri = self.files[at][2]
        if (uri, number) not in self.blocks:
            if len(self.blocks) >= self.kept:
                self.blocks.pop(next(iter(self.blocks)))
            _, _, offset, length = self.directory(at)[1][number]
            lines = zlib.decompress(self.read(uri, offset, length)).decode("utf-8", "surrogatepass").split("\n")
            rows = [json.loads(line) for line in lines]
            self.blocks[uri, number] = [order_of(*r[:2]) for r in rows], rows
        return self.blocks[uri, number]

    def find(self, key: str, page_id: int | None = None, any_id: bool = False) -> Iterator[list]:
        """Captures of a key: those of one page id, or with ``any_id`` all."""
        low = (key, NO_ID) if any_id else order_of(key, page_id)
        at = max(0, bisect.bisect_left(self.starts, low) - 1)
        number = None
        while at < len(self.files):
            starts, _ = self.directory(at)
            if number is None:
                number = max(0, bisect.bisect_left(starts, low) - 1)
            while number < len(starts):
                orders, rows = self.block(at, number)
                for i in range(bisect.bisect_left(orders, low), len(rows)):
                    if orders[i][0] != key or not (any_id or orders[i] == low):
                        return
                    yield rows[i]
                number += 1
            at, number = at + 1, 0


def read_records(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """Records of the (key, page_id) rows of ``wanted``, found by the index and read by byte range.

    ``index`` has a row per index file, about one for ``FILE_CAPTURES`` captures, and goes to every
    task. Rows are spread by key, about ``READ_CAPTURES`` to a task, so neighbours share blocks. Repeated rows are read once each and
    give every record of their key and id once.
    """
    files = [(r["first_key"], r["first_id"], r["file"], r["size"]) for r in index.collect()]
    unique = wanted.select(F.coalesce("key", F.lit("")).alias("key"), F.col("page_id")).distinct()
    tasks = max(1, -(-wanted.count() // READ_CAPTURES))
    spread = unique.repartitionByRange(tasks, "key", "page_id").sortWithinPartitions("key", "page_id")
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def run(batches):
        known, archives = CaptureIndex(files), RangeReader()
        for batch in batches:
            found = []
            for key, page_id in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for _, _, uri, offset, length in known.find(key, page_id):
                    found.append(parse(archives(uri, offset, length)))
                    if len(found) >= 500:
                        yield [pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)]
                        found = []
            if found:
                yield [pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)]

    return map_arrow(spread, run, RECORD)


def archive_round_trip(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """Write ``pages`` as archives, index them, and read every capture back through the index.

    An empty table gives no records. Columns of ``pages`` other than page_id, url, html are not
    carried.
    """
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    captures = write_archives(pages, folder, least)
    return read_records(captures, write_index(captures, folder))
