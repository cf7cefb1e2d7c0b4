"""WARC archives as a Spark data source, and records that point to an equal payload."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from midmile.llm.common import bounded_batches
from midmile.runtime import stage

LEAST_REVISIT = 1000  # bytes; smaller payloads are stored again
PARTITION_BYTES = 64 << 20  # archive bytes read by a task, if several files fit
FILE_BYTES = 512 << 20  # a task starts another file beyond
_READ = 256 << 10

# Header names and record forms of WARC 1.1; the column that shows each header.
VERSION = b"WARC/1.1"
COLUMNS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "content_type": "Content-Type",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Not in the standard, which lets programs add headers: bytes of the payload that a revisit stands for.
PAYLOAD_BYTES = "X-Payload-Bytes"
SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, "
    "content_type string, content_length long, headers map<string, string>, payload binary"
)


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if re.match(r"\w[\w+.-]+:", path) else (pafs.LocalFileSystem(), path)


# --- writing


def _line(text: str) -> str:
    """A header's value: no line can be broken by it."""
    return re.sub(r"[\r\n]+\s*", " ", text)


def _record(headers: list[tuple[str, str | None]], content: bytes) -> bytes:
    lines = [VERSION] + [f"{k}: {_line(v)}".encode() for k, v in headers if v is not None]
    return b"\r\n".join([*lines, f"Content-Length: {len(content)}".encode(), b"", content, b"", b""])


def _member(data: bytes, level: int) -> bytes:
    """A gzip member whose extra field ``sl`` holds its own and the plain length, so that readers can step over it."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    tail = zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")
    length = 24 + len(body) + len(tail)
    known = max(length, len(data)) < 1 << 32  # else zeros: the reader unpacks to find the end
    sl = (length if known else 0).to_bytes(4, "little") + (len(data) if known else 0).to_bytes(4, "little")
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x0c\0sl\x08\0" + sl + body + tail


def response(record: dict) -> bytes:
    """The record of a row; its payload is stored as an HTTP response, or left out if it refers to another."""
    payload = record["payload"] or b""
    revisit = record["record_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [
        ("WARC-Type", record["record_type"]),
        ("WARC-Record-ID", record["record_id"]),
        ("WARC-Date", record["date"]),
        ("WARC-Target-URI", record["target_uri"]),
        ("WARC-Payload-Digest", record["payload_digest"]),
        ("WARC-Refers-To", record["refers_to"]),
        ("WARC-Profile", REVISIT_PROFILE if revisit else None),
        (PAYLOAD_BYTES, str(record["payload_bytes"]) if revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return _record(headers, http if revisit else http + payload)


@dataclass
class Written(WriterCommitMessage):
    files: list[str] = field(default_factory=list)


class WarcWriter(DataSourceArrowWriter):
    """Each task writes files under names of its own; those of a finished job are listed in one manifest.

    A repeated or lost task leaves files that no manifest lists, and readers pass over them.
    """

    def __init__(self, options: dict[str, str]):
        self.path, self.level, self.most = options["path"], int(options.get("level", "1")), int(options.get("filebytes", FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = _filesystem(self.path)
        fs.create_dir(folder, recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            columns = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            for k in range(batch.num_rows):
                if out is None or size > self.most:
                    if out:
                        out.close()
                    files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(f"{folder}/{files[-1]}", compression=None), 0
                member = _member(response({n: c[k].as_py() for n, c in columns.items()}), self.level)
                out.write(member)
                size += len(member)
        if out:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = _filesystem(self.path)
        fs.create_dir(folder, recursive=True)
        names = "\n".join(f for m in messages if m for f in m.files)
        with fs.open_output_stream(f"{folder}/_manifest-{uuid.uuid4().hex}") as out:
            out.write(names.encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, folder = _filesystem(self.path)
        for name in (f for m in messages if m for f in m.files):
            fs.delete_file(f"{folder}/{name}")


# --- reading


class _Source:
    """Bytes of a file from a place on, a bounded piece at a time."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.held = file, b""

    def more(self) -> bool:
        data = self.file.read(_READ)
        self.held += data
        return bool(data)

    def peek(self, n: int) -> bytes:
        while len(self.held) < n and self.more():
            pass
        return self.held[:n]

    def skip(self, n: int) -> None:
        if n > len(self.held):
            self.file.seek(self.file.tell() + n - len(self.held))
            self.held = b""
        else:
            self.held = self.held[n:]


class _Plain:
    """One record in a plain archive."""

    def __init__(self, source: _Source):
        self.source, self.left = source, None

    def head(self) -> bytes | None:
        while self.source.peek(2) == b"\r\n":
            self.source.skip(2)
        while (end := self.source.held.find(b"\r\n\r\n")) < 0:
            if not self.source.more():
                return None
        head = self.source.held[:end]
        self.source.skip(end + 4)
        return head

    def content(self, length: int) -> bytes:
        data = self.source.peek(length)
        self.source.skip(length)
        return data

    def leave(self, length: int) -> None:
        self.source.skip(length)


class _Packed(_Plain):
    """One record in a gzip member; what is not asked for is not unpacked if the member tells its length."""

    def __init__(self, source: _Source):
        super().__init__(source)
        start = source.peek(24)
        self.length = int.from_bytes(start[16:20], "little") if start[3:4] == b"\x04" and start[12:16] == b"sl\x08\0" else 0
        self.unpack, self.taken, self.data = zlib.decompressobj(31), 0, b""

    def _more(self) -> bool:
        if self.unpack.eof or not (self.source.held or self.source.more()):
            return False
        piece = self.source.held[:8192] if not self.data else self.source.held
        self.data += self.unpack.decompress(piece)
        used = len(piece) - len(self.unpack.unused_data)
        self.taken += used
        self.source.skip(used)
        return True

    def head(self) -> bytes | None:
        while (end := self.data.find(b"\r\n\r\n")) < 0:
            if not self._more():
                return None
        head, self.data = self.data[:end], self.data[end + 4 :]
        return head

    def content(self, length: int) -> bytes:
        parts, size = [self.data], len(self.data)
        self.data = b"-"
        while size < length and self._more():
            parts.append(self.data[1:])
            size += len(self.data) - 1
            self.data = b"-"
        data = b"".join(parts)[:length]
        self.leave(0)
        return data

    def leave(self, length: int) -> None:
        if self.length:
            self.source.skip(self.length - self.taken)
            return
        while not self.unpack.eof and self._more():
            self.data = b"-"


def records(file: pa.NativeFile, wanted, payload: bool) -> Iterator[tuple[dict[str, str], int, bytes | None]]:
    """(headers, content length, payload) of the records whose headers are ``wanted``, read first and alone."""
    source = _Source(file)
    while start := source.peek(2):
        record = _Packed(source) if start == b"\x1f\x8b" else _Plain(source)
        head = record.head()
        if head is None:
            return
        lines = head.decode("utf-8", "replace").split("\r\n")
        headers = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(headers.get("Content-Length", "0"))
        if not wanted(headers) or not payload:
            record.leave(length)
            if wanted(headers):
                yield headers, length, None
            continue
        content = record.content(length)
        if headers.get("Content-Type", "").startswith("application/http"):
            content = content.partition(b"\r\n\r\n")[2]
        yield headers, length, None if headers.get("WARC-Type") == "revisit" else content


@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    """Partitions are whole files, small ones together. Filters on header columns are checked before any payload."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.names = options["path"], schema.names
        self.schema, self.most = schema, int(options.get("partitionbytes", PARTITION_BYTES))
        self.filters: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = COLUMNS.get(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
            if name and isinstance(f, EqualTo):
                self.filters.append((name, "in", {f.value}))
            elif name and isinstance(f, In):
                self.filters.append((name, "in", set(f.value)))
            elif name and isinstance(f, StringStartsWith):
                self.filters.append((name, "starts", f.value))
            elif name and isinstance(f, IsNotNull):
                self.filters.append((name, "known", None))
            else:
                yield f

    def partitions(self) -> list[Files]:
        fs, folder = _filesystem(self.path)
        found = {f.base_name: f for f in fs.get_file_info(pafs.FileSelector(folder)) if f.type == pafs.FileType.File}
        manifests = [name for name in found if name.startswith("_manifest-")]
        names = sorted(n for n in found if re.search(r"\.warc(\.gz)?$", n))
        if manifests:
            listed = {x for m in manifests for x in fs.open_input_stream(f"{folder}/{m}").read().decode().split("\n")}
            names = [n for n in names if n in listed]
        parts, size = [], self.most + 1
        for name in names:
            if size + found[name].size > self.most:
                parts.append(Files([]))
                size = 0
            parts[-1].paths.append(f"{folder}/{name}")
            size += found[name].size
        return parts or [Files([])]

    def _wanted(self, headers: dict[str, str]) -> bool:
        for name, kind, value in self.filters:
            x = headers.get(name)
            if x is None or (kind == "in" and x not in value) or (kind == "starts" and not x.startswith(value)):
                return False
        return True

    def read(self, partition: Files) -> Iterator[tuple]:
        fs, _ = _filesystem(self.path)
        for path in partition.paths:
            with fs.open_input_file(path) as file:
                for headers, length, payload in records(file, self._wanted, "payload" in self.names):
                    row = {c: headers.get(h) for c, h in COLUMNS.items()} | {"content_length": length, "headers": headers, "payload": payload}
                    yield tuple(row[n] for n in self.names)


class WarcSource(DataSource):
    """``spark.read.format("warc")``; a schema without ``payload`` reads headers only."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are never overwritten; give a new path")
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of the archives below ``path``: the columns of ``SCHEMA``, without ``payload`` if it is not wanted."""
    register(spark)
    schema = SCHEMA if payload else SCHEMA.replace(", payload binary", "")
    return spark.read.format("warc").schema(schema).load(path)


def revisits(captures: DataFrame, id: str = "page_id", payload: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """Rows (id, digest, refers_to): captures whose payload of ``least`` bytes or more a larger id also has.

    Only ids and digests meet; equal digests are added up before the shuffle, so one payload
    that very many captures share is no burden. Rows that share the largest id are all kept
    as responses. Null payloads are empty, and so never refer; nor do null ids.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    small = captures.select(F.col(id).alias("id"), F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("n"))
    small = stage(small.where((F.col("n") >= least) & F.col("id").isNotNull()).select("id", "digest"), "digests")
    last = small.groupBy("digest").agg(F.max("id").alias("refers_to"), F.min("id").alias("first")).where("first < refers_to")
    return stage(small.join(last.drop("first"), "digest").where("id < refers_to").distinct(), "revisits")


def write(captures: DataFrame, path: str, id: str = "page_id", url: str = "url", payload: str = "html", date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record for every row: a response, or a revisit of the capture with an equal payload and the largest id.

    Null payloads are empty, null urls have no header, null ids get a random record id. Repeated
    rows are written again; an empty table writes an empty archive. Other columns are not read.
    """
    spark = captures.sparkSession
    register(spark)
    bounded_batches(spark)
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = captures.select(F.col(id).alias("id"), F.col(url).cast("string").alias("target_uri"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    rows = rows.join(revisits(captures, id, payload), ["id", "digest"], "left")
    urn = lambda c: F.concat(F.lit(f"<urn:x-{id}:"), F.col(c).cast("string"), F.lit(">"))
    base32 = F.concat(F.lit("sha1:"), _base32(F.sha1("payload")))
    known = F.col("refers_to").isNotNull()
    out = rows.select(
        F.when(known, "revisit").otherwise("response").alias("record_type"),
        F.coalesce(urn("id"), F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))).alias("record_id"),
        "target_uri",
        F.lit(date).alias("date"),
        F.when(known, urn("refers_to")).alias("refers_to"),
        base32.alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(~known, F.col("payload")).alias("payload"),
    )
    out.write.format("warc").mode("append").save(path)


def _base32(hex_text):
    """The 40 hex digits of a SHA-1 as 32 letters and digits of base 32: 5 hex digits make 4 of them."""
    parts = []
    for k in range(0, 40, 5):
        part = F.lpad(F.upper(F.conv(F.substring(hex_text, k + 1, 5), 16, 32)), 4, "0")
        parts.append(part)
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def hex_digest(column: str):
    """``sha1:`` and base 32 as bare lower-case hex."""
    plain = F.translate(F.substring_index(column, ":", -1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV")
    return F.lower(F.concat(*[F.lpad(F.conv(F.substring(plain, k + 1, 4), 32, 16), 5, "0") for k in range(0, 32, 4)]))
