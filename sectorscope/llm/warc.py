"""WARC archives as a PySpark data source, and the archive of a page table.

``spark.read.format("warc")`` plans partitions of whole files (files are rolled at a byte
limit when written, so a partition is bounded), and reads a record in two steps: the headers
first, then, only if the record passes every pushed filter and its block is wanted, the block.
Filters on ``record_type`` and on header columns are pushed down; so are ``types`` (option) and
whether the payload is needed (option ``payload``).  Each record is a gzip member of its own
with the classic ``sl`` extra field, which gives the member's compressed length, so the reader
seeks past a record that it does not want after inflating its first bytes.  Members without
that field (other writers) are inflated to their end but not kept; files may also be plain.

``df.write.format("warc")`` writes files under names that only the commit makes visible: a
task attempt writes a file of its own, and the driver's commit renames those of the attempts
that succeeded, so a lost executor or a repeated task leaves no double records.

:func:`archive_pages` turns pages into records.  Of pages with equal payloads of a minimum
size, that with the largest id is the response and the others are revisits of it, found by
a partially aggregated maximum per digest and one join on the digest, which adaptive execution
splits where a digest is hot.  Null html: empty payload.  Null id: kept, and response only if
its digest has no other; ids are told apart from null.  Rows repeated in id and html: each a
record, all of the same type.  Extra columns are ignored; an empty table gives no record.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualNullSafe,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    WriterCommitMessage,
)
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from sectorscope.sources.paths import shared_folder

VERSION = b"WARC/1.1"
FILE_BYTES = 64 << 20
PARTITION_BYTES = 128 << 20
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# Column of the data source -> header it holds.
HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "record_date": "WARC-Date",
    "target_uri": "WARC-Target-URI",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "page_id": "X-Page-Id",
    "refers_to_page": "X-Refers-To-Page-Id",
    "payload_length": "X-Payload-Length",
}
LONGS = {"page_id", "refers_to_page", "payload_length"}
SCHEMA = StructType(
    [StructField(c, LongType() if c in LONGS else StringType()) for c in HEADERS]
    + [StructField("content_length", LongType()), StructField("payload", BinaryType())]
)


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path; one without scheme, given to the source directly, is local."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def header_text(value: str) -> str:
    """A header value: control characters, blanks and ``%`` are percent-encoded."""
    return quote(value, safe="!#$&'()*+,/:;=?@[]~<>|{}^`\"\\")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(row: dict) -> bytes:
    """Headers and block of one record; a response holds an HTTP message, a revisit its head."""
    body = row["payload"] if row["payload"] is not None else b""
    block = b""
    if row["record_type"] in ("response", "revisit"):
        length = len(body) if row["record_type"] == "response" else row["payload_length"] or 0
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n"
        block = head.encode()
    if row["record_type"] != "revisit":
        block += body
    lines = [VERSION]
    for column, name in HEADERS.items():
        if row.get(column) is not None:
            lines.append(f"{name}: {header_text(str(row[column]))}".encode())
    if row["record_type"] == "revisit":
        lines.append(f"WARC-Profile: {REVISIT_PROFILE}".encode())
    if row["record_type"] in ("response", "revisit"):
        lines.append(b"Content-Type: application/http; msgtype=response")
    lines.append(b"Content-Length: %d" % len(block))
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 1) -> bytes:
    """A gzip member whose ``sl`` field holds its own and the plain length."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = packer.compress(data) + packer.flush()
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    extra_size = 4 + 8
    total = 10 + 2 + extra_size + len(body) + len(tail)
    extra = b"sl" + struct.pack("<HII", 8, total & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\x04\xff" + struct.pack("<H", len(extra)) + extra + body + tail


class _Member:
    """The plain bytes of one gzip member (or of a plain file), read as far as asked.

    Time and memory are in proportion to what is asked for.
    """

    STEP = 64 << 10
    # Most bytes that one step makes of well compressed input.
    MOST = 1 << 20

    def __init__(self, source):
        self.source, self.start = source, source.tell()
        self.plain, self.total, self.over = bytearray(), None, False
        self.inflater = None
        head = source.read(12)
        if head[:2] == b"\x1f\x8b":
            if head[3] & 4:
                (size,) = struct.unpack("<H", head[10:12])
                extra = source.read(size)
                while len(extra) >= 4:
                    (n,) = struct.unpack("<H", extra[2:4])
                    if extra[:2] == b"sl" and n >= 4:
                        self.total = struct.unpack("<I", extra[4:8])[0] or None
                    extra = extra[4 + n :]
            self.inflater = zlib.decompressobj(31)
        source.seek(self.start)

    def _more(self) -> bool:
        """Whether there was anything left to read."""
        if self.over:
            return False
        data = self.inflater.unconsumed_tail if self.inflater is not None else b""
        data = data or self.source.read(self.STEP)
        if not data:
            self.over = True
            return False
        if self.inflater is None:
            self.plain += data
        else:
            self.plain += self.inflater.decompress(data, self.MOST)
            if self.inflater.eof:
                self.source.seek(self.source.tell() - len(self.inflater.unused_data))
                self.over = True
        return True

    def head(self) -> bytes | None:
        """Up to the empty line after the headers; None at the end of the file."""
        seen = 0
        while (at := self.plain.find(b"\r\n\r\n", max(seen - 3, 0))) < 0:
            seen = len(self.plain)
            if not self._more():
                if self.plain.strip():
                    raise ValueError("A record without the end of its headers")
                return None
        return bytes(self.plain[: at + 4])

    def body(self, start: int, length: int) -> bytes:
        while len(self.plain) < start + length:
            if not self._more():
                raise ValueError("A record is shorter than its Content-Length")
        with memoryview(self.plain) as plain, plain[start : start + length] as part:
            return bytes(part)

    def leave(self, start: int, length: int) -> None:
        """Place the source at the next record, without inflating what is not needed."""
        if self.inflater is None:
            self.source.seek(self.start + start + length + 4)
        elif self.total is not None:
            self.source.seek(self.start + self.total)
        else:
            while not self.over:
                self.plain.clear()
                self._more()


def parse_head(head: bytes) -> dict[str, str]:
    """Header names in lower case -> values; folded lines are joined."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"Not a WARC record: {lines[0][:40]!r}")
    found, last = {}, None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:
            found[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            found[last] = value.strip()
    return found


def _value(column: str, headers: dict[str, str]):
    raw = headers.get(HEADERS[column].lower())
    if raw is None:
        return None
    if column in LONGS:
        return int(raw)
    return unquote(raw) if column == "target_uri" else raw


def read_records(source, tests: list[tuple[str, set]], want_payload: bool) -> Iterator[list]:
    """Values in the order of the schema.  ``tests``: columns and the values that pass."""
    while True:
        member = _Member(source)
        head = member.head()
        if head is None:
            return
        headers = parse_head(head)
        length, start = int(headers.get("content-length", "0")), len(head)
        values = {c: _value(c, headers) for c in HEADERS}
        if all(values[c] in allowed for c, allowed in tests):
            payload = None
            if want_payload and values["record_type"] != "revisit":
                payload = member.body(start, length)
                if headers.get("content-type", "").startswith("application/http"):
                    payload = payload[payload.find(b"\r\n\r\n") + 4 :]
            yield [*values.values(), length, payload]
        member.leave(start, length)


@dataclass
class WarcFiles(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.want_payload = options.get("payload", "true").lower() == "true"
        self.partition_bytes = int(options.get("partitionbytes", PARTITION_BYTES))
        self.tests: list[tuple[str, set]] = []
        if options.get("types"):
            self.tests.append(("record_type", set(options["types"].split(","))))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality and membership tests on header columns; the rest stays with Spark."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, (EqualTo, EqualNullSafe)):
                self.tests.append((column, {f.value}))
            elif column in HEADERS and isinstance(f, In):
                self.tests.append((column, set(f.value)))
            elif column == "record_type" and isinstance(f, IsNotNull):
                pass  # every record has a type
            else:
                yield f

    def partitions(self) -> list[WarcFiles]:
        """Whole files, small ones together up to ``partitionBytes``."""
        system, path = _open(self.path)
        found = system.get_file_info(pafs.FileSelector(path, recursive=True))
        files = sorted(
            (x.path, x.size) for x in found if x.type == pafs.FileType.File and x.path.endswith((".warc", ".warc.gz"))
        )
        groups, held, size = [], [], 0
        for name, n in files:
            if held and size + n > self.partition_bytes:
                groups.append(WarcFiles(held))
                held, size = [], 0
            held, size = [*held, name], size + n
        return [*groups, WarcFiles(held)] if held else groups or [WarcFiles([])]

    def read(self, partition: WarcFiles) -> Iterator[pa.RecordBatch]:
        system, _ = _open(self.path)
        types = [pa.int64() if c in LONGS else pa.string() for c in HEADERS] + [pa.int64(), pa.binary()]
        schema = pa.schema(list(zip(SCHEMA.names, types)))
        held, size = [], 0
        for name in partition.paths:
            with system.open_input_file(name) as raw, io.BufferedReader(_Raw(raw), 1 << 16) as source:
                for row in read_records(source, self.tests, self.want_payload):
                    held.append(row)
                    size += len(row[-1] or b"")
                    if len(held) == 2000 or size > 8 << 20:
                        yield _batch(held, schema)
                        held, size = [], 0
        if held:
            yield _batch(held, schema)


class _Raw(io.RawIOBase):
    """Lets Python's buffering work on a file of any file system."""

    def __init__(self, file):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        self.file.seek(offset, whence)
        return self.file.tell()

    def tell(self) -> int:
        return self.file.tell()

    def readinto(self, buffer) -> int:
        data = self.file.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


@dataclass
class WrittenFiles(WriterCommitMessage):
    paths: list[str]


class WarcWriter(DataSourceWriter):
    """Rows with any of the schema's columns but ``content_length``."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.file_bytes = int(options.get("filebytes", FILE_BYTES))
        self.level = int(options.get("level", 1))

    def write(self, rows: Iterator) -> WrittenFiles:
        system, base = _open(self.path)
        folder = f"{base.rstrip('/')}/_staged"
        system.create_dir(folder, recursive=True)
        task, paths, out, size = TaskContext.get().partitionId(), [], None, 0
        try:
            for row in rows:
                if out is None:
                    paths.append(f"{folder}/part-{task:06d}-{len(paths):04d}-{uuid.uuid4().hex}.warc.gz")
                    out, size = system.open_output_stream(paths[-1], compression=None), 0
                data = gzip_member(record_bytes(row.asDict()), self.level)
                out.write(data)
                size += len(data)
                if size >= self.file_bytes:
                    out.close()
                    out = None
        finally:
            if out is not None:
                out.close()
        return WrittenFiles(paths)

    def commit(self, messages: list[WrittenFiles | None]) -> None:
        system, base = _open(self.path)
        for message in messages:
            for path in message.paths if message else []:
                system.move(path, f"{base.rstrip('/')}/{path.rsplit('/', 1)[1]}")
        if system.get_file_info(f"{base.rstrip('/')}/_staged").type == pafs.FileType.Directory:
            system.delete_dir(f"{base.rstrip('/')}/_staged")  # with what failed attempts left

    def abort(self, messages: list[WrittenFiles | None]) -> None:
        system, base = _open(self.path)
        if system.get_file_info(f"{base.rstrip('/')}/_staged").type == pafs.FileType.Directory:
            system.delete_dir(f"{base.rstrip('/')}/_staged")


class WarcDataSource(DataSource):
    """Options: ``path``; reading: ``types`` (comma-separated), ``payload`` (true), ``partitionBytes``;
    writing: ``fileBytes``, ``level`` (of compression)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> StructType:
        return SCHEMA

    def _plain_options(self) -> dict[str, str]:
        return {k.lower(): v for k, v in self.options.items()}

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self._plain_options())

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self._plain_options())


def register(spark: SparkSession) -> None:
    """Make the format known and let Spark hand it filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def _record_id(page_id: Column, digest: Column) -> Column:
    """Record ids follow from page and digest, so that a repeated run writes the same ones."""
    raw = F.md5(F.concat(F.coalesce(page_id.cast("string"), F.lit("-")), F.lit(":"), digest))
    parts = [F.substring(raw, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def page_records(pages: DataFrame, min_revisit_bytes: int = 0, date: str = DATE) -> DataFrame:
    """A record for each page, with the columns that the writer takes."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(
        "page_id", F.col("url").alias("target_uri"), payload.alias("payload")
    ).withColumns({"payload_length": F.octet_length("payload").cast("long"), "_sha1": F.sha1("payload")})
    winners = (
        rows.where(F.col("payload_length") >= min_revisit_bytes)
        .groupBy("_sha1")
        .agg(F.max("page_id").alias("refers_to_page"))
    )
    rows = rows.join(winners, "_sha1", "left")
    large = F.col("payload_length") >= min_revisit_bytes
    response = ~large | F.col("page_id").eqNullSafe(F.col("refers_to_page"))
    refers = F.when(~response, F.col("refers_to_page"))
    return rows.select(
        _record_id(F.col("page_id"), F.col("_sha1")).alias("record_id"),
        F.when(response, "response").otherwise("revisit").alias("record_type"),
        F.lit(date).alias("record_date"),
        "target_uri",
        F.concat(F.lit("sha1:"), base32(F.col("_sha1"))).alias("payload_digest"),
        F.when(~response, _record_id(refers, F.col("_sha1"))).alias("refers_to"),
        "page_id",
        refers.alias("refers_to_page"),
        "payload_length",
        F.when(response, F.col("payload")).alias("payload"),
    )


def base32(hexadecimal: Column) -> Column:
    """Upper-case base32 of a digest of 160 bits in hexadecimal: 32 letters of 5 bits."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    groups = []
    for part in range(4):  # 40 bits: 10 hexadecimal digits, 8 letters
        bits = F.conv(F.substring(hexadecimal, 1 + 10 * part, 10), 16, 10).cast("long")
        groups += [
            F.substring(letters, (F.shiftright(bits, 35 - 5 * k).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1))
            for k in range(8)
        ]
    return F.concat(*groups)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark's own readers and writers give it.

    Tasks open it through ``pyarrow.fs``, which does not know the cluster's default file system.
    """
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    full = system.makeQualified(place).toString()
    _open(full)  # a file system that tasks cannot open fails here
    return full


def write_warc(records: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    register(records.sparkSession)
    path = qualified(records.sparkSession, path)
    records.write.format("warc").option("path", path).option("fileBytes", file_bytes).mode("append").save()


def read_warc(spark: SparkSession, path: str, payload: bool = True, types: list[str] | None = None) -> DataFrame:
    register(spark)
    reader = spark.read.format("warc").option("path", qualified(spark, path)).option("payload", str(payload).lower())
    return reader.option("types", ",".join(types)).load() if types else reader.load()


def archive_pages(pages: DataFrame, path: str | None = None, min_revisit_bytes: int = 0) -> DataFrame:
    """Write the pages to archives below ``path`` (a fresh shared folder by default) and read
    them back: the records, with payloads."""
    spark = pages.sparkSession
    path = path or shared_folder(spark, "warc")
    write_warc(page_records(pages, min_revisit_bytes), path)
    return read_warc(spark, path)
