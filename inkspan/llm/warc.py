"""WARC archives as a Python data source, and payload-deduplicated writing of pages.

Reading plans one partition for each archive file, takes record-type and header predicates from Spark's filters, parses a
record's header first and passes over the block of a record that is not wanted without decoding it. Writing gives each task
files of bounded size under hidden names, which the commit on the driver renames. Each record is a gzip member of its own,
whose header tells the packed length, so that a record is passed over without unpacking its block.
"""

from __future__ import annotations

import gzip
import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import importable, scratch, small_batches, table

SCHEMA = "page_id long, uri string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
#: Payloads of this many bytes or more are written once; an archive file is closed once it holds FILE_BYTES.
LEAST_SHARED, FILE_BYTES = 1000, 256 << 20
#: A gzip member's first bytes with an extra field, and that field: its length, the name of skip lengths, theirs, packed and unpacked length.
GZIP_EXTRA, SKIP_LENGTHS = b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff", struct.Struct("<H2sHII")
VERSION, PROFILE = b"WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The store that a path or address is in: this machine's shared mounts, or what Arrow can reach."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def record_bytes(row) -> bytes:
    """One record: WARC header, HTTP header, payload. A revisit has the headers alone, with its payload's length and digest."""
    revisit = row.record_type == "revisit"
    payload = b"" if revisit else bytes(row.payload or b"")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row.payload_bytes}\r\n\r\n".encode()
    uri = "".join((row.uri or "").split())
    name = f"uuid:{uuid.uuid4()}" if row.page_id is None else f"page:{row.page_id}"
    fields = [("WARC-Type", row.record_type), ("WARC-Record-ID", f"<urn:{name}>"), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{row.payload_digest}")]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{row.refers_to}>")]
    fields.append(("Content-Length", str(len(http) + len(payload))))
    head = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    return b"".join([VERSION, b"\r\n", head, b"\r\n", http, payload, b"\r\n\r\n"])


def packed(record: bytes) -> bytes:
    """The record as a gzip member that tells its packed length."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    n = len(record) & 0xFFFFFFFF
    return b"".join([GZIP_EXTRA, SKIP_LENGTHS.pack(SKIP_LENGTHS.size - 2, b"sl", 8, len(body), n), body, struct.pack("<II", zlib.crc32(record), n)])


def read_header(stream) -> dict[str, str] | None:
    """Named fields of the next record, names in lower case; None at the end."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no record where one should start: {line[:40]!r}")
    fields, last = {}, ""
    for line in iter(stream.readline, b""):
        text = line.rstrip(b"\r\n").decode("utf-8", "replace")
        if not text:
            break
        if text[0] in " \t" and last:
            fields[last] += " " + text.strip()
            continue
        name, _, value = text.partition(":")
        last = name.strip().lower()
        fields[last] = value.strip()
    return fields


def _number(address: str | None) -> int | None:
    tail = (address or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


@dataclass
class ArchivePartition(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    """Of the filters, equalities and lists on columns that the header alone tells are taken; Spark applies the rest."""

    HEADER = {"record_type", "page_id", "uri", "payload_digest", "refers_to"}

    def __init__(self, path: str, names: list[str]):
        self.path, self.names, self.wanted = path, names, {}

    def pushFilters(self, filters) -> Iterator:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in self.HEADER and isinstance(f, (EqualTo, In)):
                values = set(f.value) if isinstance(f, In) else {f.value}
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, root = file_system(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
        return [ArchivePartition(f.path) for f in sorted(found, key=lambda f: f.path) if f.base_name.endswith((".warc", ".warc.gz"))]

    def read(self, partition: ArchivePartition | None) -> Iterator[tuple]:
        if partition is None:  # of a folder without archives
            return
        fs, _ = file_system(self.path)
        with fs.open_input_file(partition.path) as file:
            stream = io.BufferedReader(_Raw(file), 1 << 20)
            yield from (read_packed if partition.path.endswith(".gz") else read_records)(stream, self.names, self.wanted)


def read_record(stream, fields: dict[str, str], names: list[str], wanted: dict[str, set]) -> tuple[tuple | None, int]:
    """The row of the record whose header was read, None if it is not wanted, and how many bytes of its block were not read."""
    row = {
        "page_id": _number(fields.get("warc-record-id")),
        "uri": fields.get("warc-target-uri"),
        "record_type": fields.get("warc-type"),
        "payload_digest": (fields.get("warc-payload-digest") or "").removeprefix("sha1:") or None,
        "refers_to": _number(fields.get("warc-refers-to")),
    }
    rest = int(fields.get("content-length") or 0)
    if not all(row[k] in values for k, values in wanted.items()):
        return None, rest
    if {"payload", "payload_bytes"} & set(names):
        taken, length = 0, None
        for line in iter(stream.readline, b""):
            taken += len(line)
            if line in (b"\r\n", b"\n"):
                break
            if line[:15].lower() == b"content-length:":
                length = int(line[15:])
        rest -= taken
        row["payload_bytes"] = rest if length is None else length
        if "payload" in names and row["record_type"] != "revisit":
            row["payload"] = stream.read(rest)
            rest = 0
    return tuple(row.get(n) for n in names), rest


def read_records(stream, names: list[str], wanted: dict[str, set]) -> Iterator[tuple]:
    while (fields := read_header(stream)) is not None:
        row, rest = read_record(stream, fields, names, wanted)
        if row is not None:
            yield row
        if rest:
            stream.seek(rest, 1)


def read_packed(stream, names: list[str], wanted: dict[str, set]) -> Iterator[tuple]:
    """Records of a gzip archive. A member that tells its packed length holds one record, and what is not wanted of it stays
    packed; from the first other member on, the archive is unpacked as one stream."""
    front = len(GZIP_EXTRA) + SKIP_LENGTHS.size
    while head := stream.read(front):
        told = SKIP_LENGTHS.unpack(head[len(GZIP_EXTRA) :]) if len(head) == front and head.startswith(GZIP_EXTRA[:4]) else None
        if told is None or told[:3] != (SKIP_LENGTHS.size - 2, b"sl", 8):
            stream.seek(-len(head), 1)
            yield from read_records(gzip.GzipFile(fileobj=stream), names, wanted)
            return
        block = _Member(stream, told[3])
        inside = io.BufferedReader(block, 1 << 14)
        if (fields := read_header(inside)) is not None:
            row, _ = read_record(inside, fields, names, wanted)
            if row is not None:
                yield row
        stream.seek(block.left + 8, 1)


class _Member(io.RawIOBase):
    """The unpacked bytes of one gzip member, of which ``left`` packed bytes were not read."""

    def __init__(self, stream, size: int):
        self.stream, self.left, self.unpacker = stream, size, zlib.decompressobj(-15)

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = b""
        while not data and not self.unpacker.eof and (self.left or self.unpacker.unconsumed_tail):
            taken = self.unpacker.unconsumed_tail or self.stream.read(min(self.left, 1 << 14))
            if not taken:
                raise EOFError("a gzip member ends before its packed length")
            if not self.unpacker.unconsumed_tail:
                self.left -= len(taken)
            data = self.unpacker.decompress(taken, len(buffer))
        buffer[: len(data)] = data
        return len(data)


class _Raw:
    """An Arrow file for Python's buffered reader, which asks for these methods."""

    closed = False

    def __init__(self, file):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def writable(self) -> bool:
        return False

    def readinto(self, buffer) -> int:
        data = self.file.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)

    def seek(self, offset: int, whence: int = 0) -> int:
        return self.file.seek(offset, whence)

    def tell(self) -> int:
        return self.file.tell()

    def flush(self) -> None:
        pass

    def close(self) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceWriter):
    def __init__(self, path: str, file_bytes: int, pack: bool):
        self.path, self.file_bytes, self.pack = path, file_bytes, pack
        fs, root = file_system(path)
        fs.create_dir(root, recursive=True)

    def write(self, iterator) -> Written:
        fs, root = file_system(self.path)
        files, out, held = [], None, 0
        for row in iterator:
            if out is None:
                files.append(f"{root}/.{uuid.uuid4().hex}")
                out, held = fs.open_output_stream(files[-1]), 0
            data = packed(record_bytes(row)) if self.pack else record_bytes(row)
            out.write(data)
            held += len(data)
            if held >= self.file_bytes:
                out.close()
                out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages) -> None:
        fs, root = file_system(self.path)
        for name in (f for m in messages if m is not None for f in m.files):
            fs.move(name, f"{root}/{name.rpartition('/')[2].lstrip('.')}.warc{'.gz' * self.pack}")

    def abort(self, messages) -> None:
        fs, _ = file_system(self.path)
        for name in (f for m in messages if m is not None for f in m.files):
            fs.delete_file(name)


class WarcSource(DataSource):
    """``warc``: option path names a folder of .warc and .warc.gz files; a schema of fewer columns leaves the others
    undecoded. Writing packs each record unless the option compression is none."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("filebytes", FILE_BYTES)), self.options.get("compression", "gzip") != "none")


def register(spark: SparkSession) -> None:
    importable(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def records(pages: DataFrame, least_shared: int = LEAST_SHARED) -> DataFrame:
    """A record for each page: of equal payloads of ``least_shared`` bytes or more the largest page_id is the response.

    A null html is the empty payload. A page without an id has a record under a made-up one, so that it is read back
    without an id; it revisits an equal payload of a page that has one, and is a response where there is none. Payloads
    are equal if their lengths, SHA-1 and SHA-256 are. Digests are counted before they are joined, so copies are combined
    before the shuffle; the pages' side of the join may be split where copies are many.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    held = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("uri"), payload.alias("payload"))
    held = held.withColumns({"payload_digest": F.sha1("payload"), "payload_bytes": F.length("payload").cast("long"), "wide": F.unhex(F.sha2("payload", 256))})
    equal = ["payload_digest", "payload_bytes", "wide"]
    shared = held.where(F.col("payload_bytes") >= least_shared).groupBy(equal).agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    joined = held.join(shared, equal, "left")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    kind, of = F.when(again, F.lit("revisit")).otherwise(F.lit("response")), F.when(again, F.col("first"))
    return joined.select("page_id", "uri", kind.alias("record_type"), "payload_digest", "payload_bytes", of.alias("refers_to"), F.when(~again, F.col("payload")).alias("payload"))


def archive(pages: DataFrame, path: str, least_shared: int = LEAST_SHARED, file_bytes: int = FILE_BYTES) -> None:
    """Write ``pages`` (page_id, url, html) as WARC files under ``path``. Repeated rows are written each; white space in an
    address is dropped; a payload of any length is one record; other columns are ignored; no pages give an empty folder."""
    spark = pages.sparkSession
    small_batches(spark)
    register(spark)
    records(pages, least_shared).write.format("warc").option("path", path).option("filebytes", file_bytes).mode("append").save()


def read_archive(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    register(spark)
    return spark.read.format("warc").schema(schema).option("path", path).load()


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written and read again: a response's length and digest are those of the payload that was read, a revisit's
    those that its header tells."""
    path = scratch(spark, "op10-warc")
    archive(table(spark, sf_dir, "pages"), path)
    read = read_archive(spark, path)
    own = F.col("record_type") == "response"
    return read.select(
        "page_id",
        F.when(own, F.length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(own, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
