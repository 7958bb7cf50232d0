"""WARC archives: a writer in DataFrame operations and a Python data source that reads them back.

Writing: a record is text (header, HTTP header, UTF-8 payload). Plain archives are written by Spark's text writer with the
line separator CRLF CRLF, which is how a WARC record ends. Gzipped ones are written by the data source: each record is a gzip
member of its own, whose extra field "sl" tells its length.
Reading: spark.read.format("warc").load(path). The source lists the files and packs them into partitions by size; it takes
over filters on header fields (record type, ids, target, digest, length); a record's header is read first, and the
payload of a record that the filters or payload=false leave out is skipped over, never decoded: in archives of such members
its compressed bytes are skipped too. Gzipped archives of other writers are inflated whole.
"""

from __future__ import annotations

import gzip
import io
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from recollect.llm._common import save

CRLF = "\r\n"
#: RFC 4648 base32 digits (fixed values).
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: The first bytes of a gzip member with an extra field, and its fixed rest: no time, unknown system (RFC 1952, fixed values).
MEMBER = b"\x1f\x8b\x08\x04"
SL = struct.Struct("<H2sHII")  # length of the extra field, "sl", 8, bytes of the member, bytes of the record
#: A payload is hot beyond COMMON copies and 1/HOT of all copies.
COMMON, HOT = 1000, 10_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "date": "WARC-Date", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "content_type": "Content-Type"}
SCHEMA = "record_type string, record_id string, date string, target_uri string, payload_digest string, refers_to string, content_type string, content_length long, payload_bytes long, payload binary, file string, offset long"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a binary column: 40 bits at a time, whose digits to the base of 32 are renamed."""
    part = lambda h, i: F.lpad(F.conv(F.substring(h, 10 * i + 1, 10), 16, 32), 8, "0")
    digits = F.transform(F.array(F.sha1(payload)), lambda h: F.concat(*(part(h, i) for i in range(4))))  # the hash is taken once
    return F.translate(digits.getItem(0), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """page_id, url, body, payload_bytes, payload_digest, record_type and refers_to of the records to write.

    Of records whose payloads are equal and have at least min_bytes bytes, the one with the smallest id is a response and
    the others are revisits of it; smaller payloads are all responses. Rows that repeat that smallest id are responses
    too; a null id is never the one referred to. A null body is an empty payload. Equality is that of the SHA-1 digest.
    Payloads that more than 1/HOT of all copies share are looked up in a broadcast table of fewer than HOT rows, so their
    pages never meet in one task. The repeated digests are found, and saved, when this is called.
    """
    body = F.coalesce(F.col(body_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("body"))
    rows = rows.withColumn("payload_bytes", F.octet_length("body").cast("long")).withColumn("payload_digest", base32_sha1(F.col("body").cast("binary")))
    first = rows.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
    first = save(first.filter("_n > 1"), "repeated")
    copies = first.agg(F.sum("_n")).first()[0] or 0
    common = F.col("_n") > F.greatest(F.lit(COMMON), F.lit(copies // HOT))  # so of fewer than HOT digests
    hot = first.filter(common).select("payload_digest", F.col("_first").alias("_hot"), F.lit(True).alias("_known"))
    out = rows.join(F.broadcast(hot), "payload_digest", "left")
    # copies of a hot payload are decided already and go to places of their own; no digest holds a blank
    place = F.when(F.col("_known").isNull(), F.col("payload_digest")).otherwise(F.concat_ws(" ", F.lit(""), F.xxhash64("page_id", "url")))
    rest = first.filter(~common).select(F.col("payload_digest").alias("_place"), "_first")
    out = out.withColumn("_place", place).join(rest, "_place", "left").withColumn("_first", F.coalesce("_hot", "_first")).drop("_hot", "_known", "_place")
    revisit = (F.col("payload_bytes") >= min_bytes) & F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return out.withColumn("record_type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))).withColumn("refers_to", F.when(revisit, F.col("_first"))).drop("_first")


def write_warc(records: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", records_per_file: int = 10_000, compression: str = "none") -> None:
    """Write the records of plan_records as WARC/1.1 files under path. Line breaks in a url are percent-encoded.

    compression: none, or gzip, which makes each record a gzip member that readers can skip. A task's files get their
    names when all tasks have ended, so a task that is run again leaves nothing twice.
    """
    if compression not in ("none", "gzip"):
        raise ValueError("compression is none or gzip")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    line = lambda name, value, when=None: F.concat(F.lit(name + ": "), value, F.lit(CRLF)) if when is None else F.when(when, F.concat(F.lit(name + ": "), value, F.lit(CRLF))).otherwise(F.lit(""))
    block_bytes = F.octet_length("_http") + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    head = F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", urn("page_id")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", url, F.col("url").isNotNull()),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Profile", F.lit(PROFILE), revisit),
        line("WARC-Refers-To", urn("refers_to"), revisit),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", block_bytes.cast("string")),
        F.lit(CRLF),
    )
    text = records.withColumn("_http", http).select(F.concat(head, F.col("_http"), F.when(revisit, F.lit("")).otherwise(F.col("body"))).alias("value"))
    if compression == "none":
        text.write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", records_per_file).text(path)
    else:
        records.sparkSession.dataSource.register(WarcSource)
        text.write.format("warc").mode("append").option("recordsperfile", records_per_file).save(path)


def gzip_member(record: bytes) -> bytes:
    """record as a gzip member whose extra field tells the lengths of both."""
    z = zlib.compressobj(6, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = z.compress(record) + z.flush()
    head = MEMBER + b"\0\0\0\0\0\xff"
    return head + SL.pack(12, b"sl", 8, len(head) + SL.size + len(body) + 8, len(record)) + body + struct.pack("<II", zlib.crc32(record), len(record))


def _member_length(raw: io.BufferedReader, at: int) -> int | None:
    """Bytes of the member at a place, if it is one of gzip_member's kind."""
    raw.seek(at)
    head = raw.read(10 + SL.size)
    if len(head) < 10 + SL.size or not head.startswith(MEMBER):
        return None
    extra, name, size, length, _ = SL.unpack(head[10:])
    return length if (extra, name, size) == (12, b"sl", 8) and length > len(head) else None


class _Member(io.RawIOBase):
    """What a gzip member holds, inflated no further than it is read."""

    def __init__(self, raw: io.BufferedReader, at: int, length: int):
        raw.seek(at)
        self.raw, self.left, self.given, self.z = raw, length, 0, zlib.decompressobj(16 + zlib.MAX_WBITS)

    def readable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.given

    def readinto(self, out) -> int:
        while not self.z.eof:
            data = self.z.unconsumed_tail
            if not data:
                data = self.raw.read(min(self.left, 4096))
                self.left -= len(data)
            plain = self.z.decompress(data, len(out))
            if plain:
                out[: len(plain)] = plain
                self.given += len(plain)
                return len(plain)
            if not data and not self.z.eof:
                raise EOFError("gzip member cut off")
        return 0


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Texts of records to files of gzip members: hidden ones, which the commit gives their names."""

    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("recordsperfile", 10_000))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _store(self.path)
        fs.create_dir(root, recursive=True)
        names, out, held = [], None, 0
        try:
            for batch in iterator:
                for value in batch.column(0):
                    if out is None or held == self.most:
                        if out is not None:
                            out.close()
                        names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        out, held = fs.open_output_stream(f"{root}/.{names[-1]}", compression=None), 0
                    out.write(gzip_member((value.as_py() or "").encode() + CRLF.encode() * 2))
                    held += 1
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _store(self.path)
        fs.create_dir(root, recursive=True)
        for name in (n for m in messages if m for n in m.names):
            fs.move(f"{root}/.{name}", f"{root}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = _store(self.path)
        for name in (n for m in messages if m for n in m.names):
            fs.delete_file(f"{root}/.{name}")


@dataclass
class Files(InputPartition):
    names: list[str]


_COMPARE = {EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, StringStartsWith: lambda a, b: a.startswith(b), StringEndsWith: lambda a, b: a.endswith(b), StringContains: lambda a, b: b in a}


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.target = int(options.get("partitionbytes", 16 << 20))
        self.strict = options.get("mode", "failfast").lower() != "permissive"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        fields = {*HEADERS, "content_length"}
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in fields and isinstance(f, IsNotNull):
                self.tests.append((name, "IsNotNull", None))
            elif name in fields and type(f) in _COMPARE:
                self.tests.append((name, type(f).__name__, list(f.value) if isinstance(f, In) else f.value))
            else:
                yield f

    def partitions(self) -> list[Files]:
        """Files (not hidden ones) in order of size, packed until about partitionbytes. A file is never cut: write more, smaller ones."""
        fs, root = _store(self.path)
        from pyarrow.fs import FileSelector, FileType

        info = fs.get_file_info(root)
        found = [info] if info.type == FileType.File else fs.get_file_info(FileSelector(root, recursive=True))
        found = sorted((x for x in found if x.type == FileType.File and x.size and not x.base_name.startswith(("_", "."))), key=lambda x: (-x.size, x.path))
        out, names, size = [], [], 0
        for x in found:
            if names and size + x.size > self.target:
                out.append(Files(names))
                names, size = [], 0
            names.append(x.path)
            size += x.size
        return [*out, Files(names)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = _store(self.path)
        compare = {k.__name__: f for k, f in _COMPARE.items()}
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in SCHEMA.split(", ")]
        rows: list[list] = [[] for _ in names]
        held = 0
        for name in partition.names:
            with fs.open_input_file(name) as raw:
                for record in self._records(raw, name, compare):
                    for col, value in zip(rows, record):
                        col.append(value)
                    held += len(record[9] or b"") + 200
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=names)
                        rows, held = [[] for _ in names], 0
        if rows[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=names)

    def _records(self, raw, name: str, compare: dict) -> Iterator[tuple]:
        """The records of a file that pass the tests."""
        if name.endswith(".gz"):
            end, members = raw.size(), io.BufferedReader(raw, 1 << 16)
            if _member_length(members, 0):
                yield from self._members(members, end, name, compare)
                return
            raw.seek(0)
        stream = io.BufferedReader(gzip.GzipFile(fileobj=raw) if name.endswith(".gz") else raw, 1 << 16)
        while (record := self._next(stream, name, compare)) is not None:
            if record:
                yield record

    def _members(self, raw: io.BufferedReader, end: int, name: str, compare: dict) -> Iterator[tuple]:
        """A record for each member; in permissive mode a broken one is passed over, and reading ends where no member begins."""
        at = 0
        while at < end:
            record, length = (), _member_length(raw, at)
            if length is None and not self.strict:
                return
            try:
                if length is None or at + length > end:
                    raise EOFError(f"no whole member at {at} of {name}")
                stream = io.BufferedReader(_Member(raw, at, length), 4096)
                record = self._record(stream, name, compare, at) or ()
                if record and record[9] is not None and stream.read(5) != b"\r\n\r\n":
                    raise ValueError(f"record of another length at {at} of {name}")
            except (ValueError, EOFError, OSError, zlib.error):
                if self.strict:
                    raise
                record = ()
            if record:
                yield record
            at += length

    def _next(self, stream: io.BufferedReader, name: str, compare: dict) -> tuple | None:
        """As _record(); a broken record or archive raises, or, in permissive mode, is passed over up to the next record there is."""
        try:
            return self._record(stream, name, compare)
        except (ValueError, EOFError, OSError, zlib.error):
            if self.strict:
                raise
        try:
            while line := stream.readline():
                if line.startswith(b"WARC/"):
                    stream.seek(-len(line), io.SEEK_CUR)
                    return ()
        except (EOFError, OSError, zlib.error):
            pass
        return None

    def _record(self, stream: io.BufferedReader, name: str, compare: dict, base: int = 0) -> tuple | None:
        """The next record; () if the tests leave it out; None at the end of the file. A member's rest needs no skipping."""
        offset = base + stream.tell()
        first = stream.readline()
        while first in (b"\r\n", b"\n"):
            offset = base + stream.tell()
            first = stream.readline()
        if not first:
            return None
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {offset} of {name}")
        head = _fields(stream)
        length = int(head.get("content-length", 0))
        if length < 0:
            raise ValueError(f"negative length at {offset} of {name}")
        values = {k: head.get(v.lower()) for k, v in HEADERS.items()} | {"content_length": length}
        for field, test, value in self.tests:
            have = values[field]
            if have is None or test != "IsNotNull" and not compare[test](have, value):
                if stream.seekable():
                    stream.seek(length, io.SEEK_CUR)
                return ()
        payload, size, begin = None, length, stream.tell()
        if (values["content_type"] or "").startswith("application/http"):
            stream.readline()
            http = _fields(stream)
            used = stream.tell() - begin
            size = int(http.get("content-length", length - used))
        else:
            used = 0
        if self.payload and values["record_type"] != "revisit":
            payload = stream.read(length - used)
            if len(payload) < length - used:
                raise EOFError(f"record cut off at {offset} of {name}")
        elif stream.seekable():
            stream.seek(length - used, io.SEEK_CUR)
        return (*values.values(), size, payload, name, offset)


def _fields(stream: io.BufferedReader) -> dict[str, str]:
    """Header fields up to the empty line, by lower-case name."""
    out: dict[str, str] = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        key, _, value = line.decode("utf-8", "replace").partition(":")
        out[key.strip().lower()] = value.strip()
    return out


def _store(path: str):
    from pyarrow.fs import FileSystem, LocalFileSystem

    if path.startswith("file:"):
        return LocalFileSystem(), "/" + path[5:].lstrip("/")
    return FileSystem.from_uri(path) if "://" in path else (LocalFileSystem(), path)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def read_warc(spark: SparkSession, path: str, payload: bool = True, mode: str = "failfast") -> DataFrame:
    """The records under path. Filters on header columns are pushed into the source; payload=False leaves payloads null.

    A record whose header is broken, or a file cut off or damaged, raises (failfast) or loses what can't be read (permissive).
    Switches on filter push-down to Python sources in the session.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("mode", mode).load(path)
