"""WARC archives: a PySpark Python data source that reads and writes them.

Reading plans one partition a file, parses a record's headers first, and
goes on to its payload only if the pushed-down predicates (record type and
other header columns) hold and the payload is wanted; otherwise the payload
is skipped by a seek, in compressed files too if the member states its
length (the gzip extra field ``sl``).  Writing is two-phased: tasks write
hidden files, the commit gives them their names, so a repeated or lost task
leaves no trace.

``archive`` writes a response record for each page and revisit records for
repeated payloads.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from ._util import durable, fresh_path

NAME = "lociframe_warc"
SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_length long, headers map<string,string>, payload binary"
#: Columns that come straight from a header, on which predicates are pushed down.
HEADER_OF = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def _open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _digest(value: str | None) -> str | None:
    return value.partition(":")[2] if value and ":" in value else value


# -- records -----------------------------------------------------------------


def build_record(row: dict, date: str) -> bytes:
    """One record as bytes.  A record with a payload holds an HTTP response, others only its head."""
    payload = row.get("payload")
    block = b"" if payload is None else HTTP % len(payload) + payload
    head = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", date)]
    head += [(name, row[key]) for name, key in (("WARC-Target-URI", "target_uri"), ("WARC-Refers-To", "refers_to")) if row.get(key) is not None]
    if row.get("payload_digest") is not None:
        head.append(("WARC-Payload-Digest", f"sha256:{row['payload_digest']}"))
    if row["record_type"] == "revisit":
        head.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    if row.get("payload_length") is not None:
        head.append(("X-Payload-Length", str(row["payload_length"])))
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {''.join(c if c >= ' ' else f'%{ord(c):02X}' for c in v)}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(record: bytes, level: int = 1) -> bytes:
    """A gzip member whose extra field ``sl`` states its packed and plain length, so that readers can skip it."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(record) + z.flush()
    size = 10 + 2 + 12 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(record) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def _parse_head(head: bytes) -> dict[str, str]:
    out, last = {}, None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in " \t" and line.strip() and last:  # a folded header
            out[last] += " " + line.strip()
            continue
        k, colon, v = line.partition(":")
        if colon:
            last = k.strip().lower()
            out[last] = v.strip()
    return out


def _http_body(block: bytes, headers: dict[str, str]) -> bytes:
    if block.startswith(b"HTTP/"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def plain_records(f, wanted, want_payload, size: int):
    """(headers, payload or None) of each wanted record of an uncompressed file; other blocks are skipped by a seek."""
    at, buffer = 0, b""
    while at < size:
        f.seek(at)
        buffer = f.read(min(4096, size - at))
        while (cut := buffer.find(b"\r\n\r\n")) < 0 and at + len(buffer) < size:
            buffer += f.read(min(65536, size - at - len(buffer)))
        if cut < 0:
            if buffer.strip():
                raise ValueError(f"no end of a record's head at byte {at}")
            return
        if not buffer.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = _parse_head(buffer[:cut])
        n, start = int(headers["content-length"]), cut + 4
        if wanted(headers):
            payload = None
            if n and want_payload(headers):
                block = buffer[start : start + n]
                if len(block) < n:
                    block += f.read(n - len(block))
                if len(block) < n:
                    raise ValueError(f"record at byte {at} is cut off")
                payload = _http_body(block, headers)
            yield headers, payload
        at += start + n + 4


def gzip_records(f, wanted, want_payload, size: int):
    """The same for a file of one gzip member a record.  A member is inflated up to its head; the rest only if it is wanted or states no length."""
    at = 0
    while at < size:
        f.seek(at)
        first = f.read(min(16384, size - at))
        if first[:2] != b"\x1f\x8b":
            raise ValueError(f"no gzip member at byte {at}")
        skip = None
        if first[3] & 4:
            (n,) = struct.unpack_from("<H", first, 10)
            extra = first[12 : 12 + n]
            while len(extra) >= 4:
                (m,) = struct.unpack_from("<H", extra, 2)
                if extra[:2] == b"sl" and m == 8:
                    (skip,) = struct.unpack_from("<I", extra, 4)
                extra = extra[4 + m :]
        z, read = zlib.decompressobj(31), len(first)
        plain = z.decompress(first, 8192)
        pending = z.unconsumed_tail
        while b"\r\n\r\n" not in plain and not z.eof:
            if not pending:
                pending = f.read(65536)
                read += len(pending)
                if not pending:
                    raise ValueError(f"gzip member at byte {at} is cut off")
            plain += z.decompress(pending, 65536)
            pending = z.unconsumed_tail
        head, _, rest = plain.partition(b"\r\n\r\n")
        headers = _parse_head(head)
        n, ok = int(headers["content-length"]), wanted(headers)
        need = ok and n and want_payload(headers)
        if need or skip is None:
            parts, got = [rest], len(rest)
            while not z.eof:
                if not pending:
                    pending = f.read(1 << 18)
                    read += len(pending)
                    if not pending:
                        raise ValueError(f"gzip member at byte {at} is cut off")
                more = z.decompress(pending)
                pending = z.unconsumed_tail
                if need:
                    parts.append(more)
                got += len(more)
            skip = read - len(z.unused_data) if skip is None else skip
        if ok:
            yield headers, _http_body(b"".join(parts)[:n], headers) if need else None
        at += skip


# -- the data source ---------------------------------------------------------


@dataclass
class FilePartition(InputPartition):
    path: str
    size: int


class WarcSource(DataSource):
    """``spark.read.format("lociframe_warc").option("payloads", ...).load(folder)``.

    Options: ``path``; ``payloads`` (read: "all", "none" or record types
    separated by commas; default all); ``compression`` (write: "none" or
    "gzip"); ``date`` (write: WARC-Date); ``file_bytes`` (write: a new file is
    begun beyond).
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(dict(self.options), overwrite)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = {k.lower(): v for k, v in options.items()}
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in HEADER_OF and isinstance(f, EqualTo | EqualNullSafe) and isinstance(f.value, str):
                self.tests.append((name, "in", frozenset([f.value])))
            elif name in HEADER_OF and isinstance(f, In):
                self.tests.append((name, "in", frozenset(f.value)))
            elif name in HEADER_OF and isinstance(f, StringStartsWith):
                self.tests.append((name, "starts", f.value))
            elif name in HEADER_OF and isinstance(f, IsNotNull):
                self.tests.append((name, "there", None))
            else:
                yield f

    def partitions(self):
        fs, path = _open_fs(self.options["path"])
        infos = fs.get_file_info(pafs.FileSelector(path, recursive=True))
        files = sorted((i for i in infos if i.type == pafs.FileType.File and not i.base_name.startswith(("_", ".")) and i.base_name.endswith((".warc", ".warc.gz"))), key=lambda i: i.path)
        return [FilePartition(i.path, i.size) for i in files]

    def _holds(self, headers: dict[str, str]) -> bool:
        for name, kind, value in self.tests:
            v = headers.get(HEADER_OF[name])
            v = _digest(v) if name == "payload_digest" else v
            if v is None or (kind == "in" and v not in value) or (kind == "starts" and not v.startswith(value)):
                return False
        return True

    def read(self, partition: FilePartition):
        if partition is None:  # a folder without archives
            return
        wish = self.options.get("payloads", "all")
        types = set(wish.split(","))
        want = (lambda h: True) if wish == "all" else (lambda h: h.get("warc-type") in types)
        fs, _ = _open_fs(self.options["path"])
        schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
        records = gzip_records if partition.path.endswith(".gz") else plain_records
        rows, held = [], 0
        with fs.open_input_file(partition.path) as raw:
            f = io.BufferedReader(raw, 1 << 16) if not hasattr(raw, "seek") else raw
            for h, payload in records(f, self._holds, want, partition.size):
                length = int(h["x-payload-length"]) if h.get("x-payload-length", "").isdigit() else None if payload is None else len(payload)
                rows.append((h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-refers-to"), _digest(h.get("warc-payload-digest")), length, list(h.items()), payload))
                held += len(payload or b"") + 600
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.options = {k.lower(): v for k, v in options.items()}
        self.overwrite, self.run = overwrite, uuid.uuid4().hex

    def write(self, iterator):
        fs, path = _open_fs(self.options["path"])
        fs.create_dir(path, recursive=True)
        zipped = self.options.get("compression", "none") == "gzip"
        limit = int(self.options.get("file_bytes", 256 << 20))
        date = self.options.get("date", "1970-01-01T00:00:00Z")
        task = TaskContext.get()
        stem = f"{self.run}-{task.partitionId():06d}-{task.taskAttemptId()}" if task else f"{self.run}-0-{uuid.uuid4().hex}"
        files, out, n = [], None, 0
        for batch in iterator:
            names = batch.schema.names
            for values in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                record = build_record(dict(zip(names, values, strict=True)), date)
                record = gzip_member(record) if zipped else record
                if out is None or n + len(record) > limit:
                    if out is not None:
                        out.close()
                    files.append(f"_{stem}-{len(files):04d}.warc" + ".gz" * zipped)
                    out, n = fs.open_output_stream(f"{path}/{files[-1]}", compression=None, buffer_size=1 << 20), 0
                out.write(record)
                n += len(record)
        if out is not None:
            out.close()
        return Written(files)

    def _clean(self, keep: str | None) -> None:
        fs, path = _open_fs(self.options["path"])
        if fs.get_file_info(path).type == pafs.FileType.NotFound:
            return
        for i in fs.get_file_info(pafs.FileSelector(path)):
            mine = i.base_name.startswith(f"_{self.run}")
            old = keep and self.overwrite and not i.base_name.startswith((keep, "_"))
            if i.type == pafs.FileType.File and (mine or old):
                fs.delete_file(i.path)

    def commit(self, messages) -> None:
        fs, path = _open_fs(self.options["path"])
        fs.create_dir(path, recursive=True)
        for m in messages:
            for f in m.files if m else ():
                fs.move(f"{path}/{f}", f"{path}/part-{f[1:]}")
        self._clean(f"part-{self.run}")

    def abort(self, messages) -> None:
        self._clean(None)


def register(spark: SparkSession) -> None:
    """Make the format known to a session and let Spark hand filters to Python sources."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, payloads: str = "all") -> DataFrame:
    register(spark)
    return spark.read.format(NAME).option("payloads", payloads).load(path)


def write(records: DataFrame, path: str, compression: str = "none", mode: str = "append") -> None:
    register(records.sparkSession)
    records.write.format(NAME).option("compression", compression).mode(mode).save(path)


# -- pages to archives -------------------------------------------------------

BROADCAST_ROWS = 200_000  # of (digest, id): about 20 MB


def page_records(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """A record for each page: payload the html in UTF-8 (null: empty).

    Of records with equal payloads of at least ``least_bytes`` bytes, that
    with the smallest page_id is a response and others revisit it; smaller
    payloads are all responses.  A null page_id counts as the largest; rows
    that share the smallest page_id are all responses.  Only digests are
    shuffled; the table of repeated digests is broadcast if it is small and
    joined by digest otherwise.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"), F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b"")).alias("payload"))
    base = base.withColumn("payload_length", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    repeated = base.where(F.col("payload_length") >= least_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    repeated = durable(repeated.select(F.col("payload_digest").alias("digest"), "first"), "repeated")
    few = repeated.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = base.join(F.broadcast(repeated) if few else repeated, F.col("payload_digest") == F.col("digest"), "left")
    again = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    return joined.select(
        urn(F.col("page_id")).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.when(again, urn(F.col("first"))).alias("refers_to"),
        "payload_digest",
        "payload_length",
        F.when(~again, F.col("payload")).alias("payload"),
    )


def archive(pages: DataFrame, path: str | None = None, compression: str = "none") -> str:
    """Write the records of ``pages`` to WARC files under ``path`` (default: a fresh shared folder); returns it."""
    path = path or fresh_path(pages.sparkSession, "warc")
    write(page_records(pages), path, compression)
    return path


def page_of(column: str):
    """The page_id in a record id; null for a page without one."""
    return F.expr(f"try_cast(regexp_extract({column}, '^<urn:page:(-?[0-9]+)>$', 1) as bigint)")
