"""WARC as a PySpark Python data source.

Writing: a record per row, every record a gzip member of its own, in files of about file_mb each; a task writes
under a temporary name and renames at the end, so a lost executor's task leaves nothing that is read. Reading:
files are planned into partitions by size; a record's headers are parsed first, the pushed filters on the record's
type and on headers are tested on them, and only then, and only if payloads are asked for, is a payload decoded. Each
member has its own length in the extra field of its gzip header, as the format allows, so the reader seeks past the
rest of an unwanted one; members of other writers, without that field, are inflated and thrown away. Paths go
through pyarrow's filesystems, so any shared store that those open will do.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceArrowWriter, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

from quire.llm.common import new_folder, ship, spill

READ_SCHEMA = "record_id string, record_type string, target_uri string, warc_date string, page_id long, payload_bytes long, payload_digest string, refers_to long, payload binary"
WRITE_COLUMNS = ("page_id", "url", "payload", "record_type", "payload_bytes", "payload_digest", "refers_to")
PREFIX = "quire-"
HEADERS = {  # fixed values: names of the WARC format and of this source's extension headers
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "warc_date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "page_id": "X-Page-ID",
    "payload_bytes": "X-Payload-Length",
    "refers_to": "X-Refers-To-Page",
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LENGTH_FIELD = b"QL"
FIRST = 4096  # bytes that are inflated at once while headers are looked for
DATE = "1970-01-01T00:00:00Z"
NUMBERS = ("page_id", "payload_bytes", "refers_to")


def filesystem(path: str):
    """(filesystem, path in it) of a URI or an absolute path."""
    if "://" not in path and path.startswith("file:"):
        path = path.removeprefix("file:")
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"/{path}")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def one_line(value: str) -> str:
    """A header's value can't hold line ends or per cent signs of its own: both are percent-encoded."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def whole_line(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(row: dict) -> bytes:
    """One record, uncompressed. A revisit has no payload, but all headers of the response that it refers to."""
    payload = row["payload"] if row["record_type"] != "revisit" else b""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{row["page_id"]}:{row["url"]}')}>",
        f"WARC-Date: {DATE}",
        "Content-Type: application/octet-stream",
        f"WARC-Payload-Digest: sha1:{row['payload_digest']}",
        f"X-Payload-Length: {row['payload_bytes']}",
    ]
    if row["url"] is not None:
        lines.append(f"WARC-Target-URI: {one_line(row['url'])}")
    if row["page_id"] is not None:
        lines.append(f"X-Page-ID: {row['page_id']}")
    if row["record_type"] == "revisit":
        lines += [f"WARC-Profile: {REVISIT}", f"X-Refers-To-Page: {row['refers_to']}"]
    head = "\r\n".join([*lines, f"Content-Length: {len(payload)}"])
    return head.encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    """data as a gzip member that has its own length, 8 bytes, in the extra subfield LENGTH_FIELD of its header."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    head = struct.pack("<4sIBBH2sHQ", b"\x1f\x8b\x08\x04", 0, 0, 255, 12, LENGTH_FIELD, 8, 24 + len(body) + 8)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def member_length(head: bytes) -> int | None:
    """The length that a member's header states in LENGTH_FIELD, if its first bytes hold it."""
    if len(head) < 12 or head[:3] != b"\x1f\x8b\x08" or not head[3] & 4:
        return None
    at, end = 12, 12 + int.from_bytes(head[10:12], "little")
    while at + 4 <= min(end, len(head)):
        size = int.from_bytes(head[at + 2 : at + 4], "little")
        if head[at : at + 2] == LENGTH_FIELD and size == 8 and at + 12 <= len(head):
            return int.from_bytes(head[at + 4 : at + 12], "little")
        at += 4 + size
    return None


@dataclass
class Done(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.limit, self.level = options["path"], int(options.get("file_mb", 64)) << 20, int(options.get("level", 1))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Done:
        fs, folder = filesystem(self.path)
        fs.create_dir(folder, recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            columns = [batch.column(c) for c in WRITE_COLUMNS]
            for i in range(batch.num_rows):
                if out is None:
                    files.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(f"{folder}/_{files[-1]}", compression=None), 0
                row = {c: x[i].as_py() for c, x in zip(WRITE_COLUMNS, columns, strict=True)}
                data = member(record(row), self.level)
                out.write(data)
                size += len(data)
                if size >= self.limit:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Done(files)

    def commit(self, messages) -> None:
        """Only files of tasks that the driver took count: they get their final names."""
        fs, folder = filesystem(self.path)
        fs.create_dir(folder, recursive=True)
        for m in messages:
            for f in m.files if m else ():
                fs.move(f"{folder}/_{f}", f"{folder}/{PREFIX}{f}")

    def abort(self, messages) -> None:
        fs, folder = filesystem(self.path)
        for m in messages:
            for f in m.files if m else ():
                fs.delete_file(f"{folder}/_{f}")


@dataclass
class Files(InputPartition):
    paths: list


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.pack = int(options.get("partition_mb", 32)) << 20
        self.wanted: list[tuple[str, set]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) else None
            if isinstance(f, EqualTo) and name in HEADERS:
                self.wanted.append((name, {f.value}))
            elif isinstance(f, In) and name in HEADERS:
                self.wanted.append((name, set(f.value)))
            elif isinstance(f, IsNotNull) and name in HEADERS:
                self.wanted.append((name, None))
            else:
                yield f

    def partitions(self) -> list[Files]:
        """Files in order of name, packed up to partition_mb; a file is never cut, as members can't be found from the middle."""
        fs, folder = filesystem(self.path)
        found = fs.get_file_info(pafs.FileSelector(folder, recursive=True, allow_not_found=True))
        out, size = [], self.pack
        for f in sorted((f for f in found if f.is_file and f.base_name.endswith((".warc.gz", ".warc")) and not f.base_name.startswith(("_", "."))), key=lambda f: f.path):
            if size + f.size > self.pack:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(f.path)
            size += f.size
        return out or [Files([])]

    def passes(self, row: dict) -> bool:
        return all(row[name] is not None if values is None else row[name] in values for name, values in self.wanted)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(self.path)
        names = [*HEADERS, "payload"]
        order = [x.split()[0] for x in READ_SCHEMA.split(", ")]
        kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
        rows: list[dict] = []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in order], names=order)

        for path in partition.paths:
            with fs.open_input_file(path) as raw:
                for row in records(Stream(raw, path.endswith(".gz")), self.payload, self.passes):
                    rows.append({c: row[c] for c in names})
                    size += len(row["payload"] or b"") + 200
                    if size >= 4 << 20:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()


class Stream:
    """Bytes of a file of gzip members, or of a plain one, read as far as needed. inflated counts the bytes that were inflated."""

    def __init__(self, raw, gz: bool):
        self.raw, self.gz, self.data, self.rest = raw, gz, bytearray(), b""
        self.inflate, self.end, self.at, self.inflated = None, None, 0, 0

    def chunk(self) -> bytes:
        """The bytes that come next; self.at is the place in the file behind them."""
        out = self.rest
        if not out:
            out = self.raw.read(1 << 18)
            self.at += len(out)
        self.rest = b""
        return out

    def more(self, most: int = 1 << 20) -> bool:
        """Append up to most bytes, or, of a plain file, a chunk."""
        chunk = self.chunk()
        if not chunk:
            if self.inflate is not None:
                raise EOFError("a WARC file ends inside a gzip member")
            return False
        if not self.gz:
            self.data += chunk
            return True
        if self.inflate is None:
            while len(chunk) < 24 and (further := self.raw.read(1 << 18)):
                self.at += len(further)
                chunk += further
            length = member_length(chunk[: 1 << 12])
            self.end = None if length is None else self.at - len(chunk) + length
            self.inflate = zlib.decompressobj(31)
        out = self.inflate.decompress(chunk, most)
        self.inflated += len(out)
        self.data += out
        if self.inflate.eof:
            self.rest, self.inflate = self.inflate.unused_data, None
        else:
            self.rest = self.inflate.unconsumed_tail
        return True

    def head(self) -> bytes | None:
        """Up to the blank line, or None at the end."""
        at = 0
        while (end := self.data.find(b"\r\n\r\n", max(0, at - 3))) < 0:
            at = len(self.data)
            if not self.more(FIRST):
                if bytes(self.data).strip():
                    raise EOFError("a WARC file ends inside a header")
                return None
        out = bytes(self.data[:end])
        del self.data[: end + 4]
        return out

    def take(self, n: int) -> bytes:
        """The next n bytes."""
        while len(self.data) < n:
            if not self.more():
                raise EOFError("a WARC file ends inside a payload")
        out = bytes(self.data[:n])
        del self.data[:n]
        return out

    def skip(self, n: int) -> None:
        """Pass over the n bytes that end the record: by a seek if its member is unfinished and states its length, else in pieces."""
        if self.inflate is not None and self.end is not None and n > len(self.data):
            start = self.at - len(self.rest)
            if self.end < start:
                raise ValueError("a gzip member states a wrong length")
            if self.end <= self.at:
                self.rest = self.rest[self.end - start :]
            else:
                self.raw.seek(self.end)
                self.rest, self.at = b"", self.end
            self.data, self.inflate = bytearray(), None
            return
        while n:
            if not self.data and not self.more():
                raise EOFError("a WARC file ends inside a payload")
            gone = min(n, len(self.data))
            del self.data[:gone]
            n -= gone


def fields_of(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; bytes that aren't UTF-8 are replaced."""
    pairs = (x.split(":", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in x)
    return {k.strip().lower(): v.strip(" \t") for k, v in pairs}


def records(stream: Stream, payload: bool, passes) -> Iterator[dict]:
    """The records that pass, headers first. A record without Content-Length is taken to have no payload."""
    while (head := stream.head()) is not None:
        head = head.lstrip(b"\r\n")
        if not head.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {head[:40]!r}")
        fields = fields_of(head)
        row = {c: fields.get(name.lower()) for c, name in HEADERS.items()}
        for c in NUMBERS:
            row[c] = int(row[c]) if row[c] is not None else None
        row["payload_digest"] = (row["payload_digest"] or "").removeprefix("sha1:") or None
        row["target_uri"] = whole_line(row["target_uri"]) if row["target_uri"] is not None else None
        wanted = passes(row)
        size = int(fields.get("content-length", 0))
        if wanted and payload:
            row["payload"] = stream.take(size)
            stream.skip(4)
        else:
            row["payload"] = None
            stream.skip(size + 4)
        if wanted:
            yield row


class WarcDataSource(DataSource):
    """format("warc"): options path, payload (false: headers alone), partition_mb; for writing file_mb and level."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: every 5 hex digits are 4 of base 32."""
    digits = F.sha1(payload)
    each = [F.lpad(F.upper(F.conv(F.substring(digits, at, 5), 16, 32)), 4, "0") for at in range(1, 41, 5)]
    return F.translate(F.concat(*each), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def archive(pages: DataFrame, path: str, smallest: int = 0, **options) -> None:
    """Write pages(page_id, url, html) as records. Of equal payloads of at least smallest bytes, the smallest page_id's is the response, the others revisit it.

    A null html is an empty payload. Rows with a null page_id are responses of their own, and nothing refers to them;
    of rows that share the smallest page_id all are responses. Digests alone are grouped; a payload is shuffled only
    where the table of revisits is too large to be broadcast.
    """
    register(pages.sparkSession)
    payload = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload"))
    marks = spill(rows.where("page_id IS NOT NULL").select("page_id", F.octet_length("payload").alias("n"), F.sha1("payload").alias("sha")), "warc-digests")
    first = marks.where(F.col("n") >= smallest).groupBy("sha").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    first = first.where("first != last")
    again = marks.where(F.col("n") >= smallest).join(first, "sha").where("page_id != first").select("page_id", "sha", F.col("first").alias("refers_to")).distinct()
    again = spill(again, "warc-revisits").withColumnRenamed("sha", "again_sha").withColumnRenamed("page_id", "again_id")
    on = (F.col("page_id") == F.col("again_id")) & (F.sha1("payload") == F.col("again_sha"))
    if again.limit(1).count():
        rows = rows.join(again, on, "left")
    else:
        rows = rows.withColumn("refers_to", F.lit(None).cast("long"))
    out = rows.select(
        "page_id",
        "url",
        F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b"")).alias("payload"),
        F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
        F.col("refers_to").cast("long").alias("refers_to"),
    )
    out.write.format("warc").mode("append").options(path=path, **options).save()


def read_archive(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(path=path, **options).load()


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive pages in the shared folder, read the archives back and report each page; a response's bytes and digest are those of the payload that was read."""
    spark = pages.sparkSession
    path = new_folder(spark, "warc")
    archive(pages, path)
    found = read_archive(spark, path)
    full = F.col("record_type") == "response"
    return found.select(
        "page_id",
        F.when(full, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(full, base32_sha1(F.col("payload"))).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


ORACLE = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS n, sha1(h) AS d FROM p),
f AS (SELECT d, min(page_id) AS low FROM s GROUP BY d),
v AS (SELECT page_id, n, low, list_transform(range(8), lambda i: CAST('0x' || substr(d, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT)) AS g FROM s JOIN f USING (d))
SELECT page_id, n AS payload_bytes, list_aggregate(list_transform(g, lambda x: list_aggregate(list_transform([15, 10, 5, 0], lambda b:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((x >> b) & 31) + 1 AS BIGINT), 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id != low THEN low END AS refers_to FROM v"""
