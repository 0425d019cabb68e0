"""Operator 9, WARC: a PySpark Python data source that writes and reads WARC archives.

Writing: each task writes gzip members, one per record, into a file of its own; the driver's
commit lists the files of the tasks that count in a manifest, so a task that ran twice leaves
nothing readable behind. Reading: the manifest's files, cut into byte ranges at record borders
kept in it, are the partitions; without a manifest every .warc and .warc.gz file below the path is one
(plain, or gzip members of any writer). Equality and IN filters on all columns that headers tell are
pushed down. Headers are parsed first; a record that isn't wanted is skipped, by the length in its own
gzip header where there is one, and so is the payload of every record with ``payload`` = false. With
``verify`` = true payloads are compared with their digests.

Defined results: a null html is the empty payload. Rows repeated in full (same id, same payload)
are all responses, since none has a smaller id. A null page_id never is the response of others
and, if its payload has a response elsewhere, revisits it. An empty table makes an archive of
no records. Only page_id, url and html are read, so other columns cannot clash. Urls that aren't plain URIs are
percent-encoded in WARC-Target-URI and kept as they are in a header of their own. Records of other writers have
no page_id; their payload is the HTTP body of application/http blocks and the whole block of others, and its
length is null where only the payload tells it and ``payload`` is false. An archive that ends inside a record raises.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from dataclasses import dataclass
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    WriterCommitMessage,
)

from .common import bounded_batches, scratch, small, written

SCHEMA = (
    "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, "
    "record_id string, date string, payload binary"
)
MANIFEST = "_manifest.json"
#: Bytes of archive that one reading task gets, and the spacing of the borders kept for that.
SPLIT = 32 << 20
#: Characters that a URI may hold as they are.
URI = "!#$%&'()*+,/:;=?@[]~"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def opened(path: str):
    """(filesystem, path) of a local path or a URI."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def record(page_id, url, html: bytes, kind: str, digest: str, refers_to, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One record: headers, then for a response the HTTP block with the payload; a revisit has the HTTP head only."""
    uri = "about:blank" if url is None else quote(url, safe=URI)
    head = HTTP % len(html)
    block = head + (html if kind == "response" else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        *([] if uri == url else [f"X-Target: {json.dumps(url)}"]),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(html)}",
    ]
    if kind == "revisit":
        lines += [
            f"WARC-Refers-To: <urn:page:{refers_to}>",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@dataclass
class Part(WriterCommitMessage):
    file: str | None
    size: int
    records: int
    borders: list


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.date = path, datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(self, batches):
        name, size, records, borders, out = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0, [0], None
        fs, folder = opened(self.path)
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    if out is None:
                        fs.create_dir(folder, recursive=True)
                        out = fs.open_output_stream(f"{folder}/{name}", compression=None)
                    html = row["payload"] or b""
                    raw = record(row["page_id"], row["url"], html, row["record_type"], row["payload_digest"], row["refers_to"], self.date)
                    data = member(raw)
                    if size - borders[-1] >= SPLIT // 4:
                        borders.append(size)
                    out.write(data)
                    size += len(data)
                    records += 1
        finally:
            if out is not None:
                out.close()
        return Part(name if out is not None else None, size, records, borders)

    def commit(self, messages):
        fs, folder = opened(self.path)
        fs.create_dir(folder, recursive=True)
        files = [{"file": m.file, "size": m.size, "records": m.records, "borders": m.borders} for m in messages if m and m.file]
        with fs.open_output_stream(f"{folder}/{MANIFEST}") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages):
        fs, folder = opened(self.path)
        for m in messages:
            if m and m.file:
                fs.delete_file(f"{folder}/{m.file}")


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, verify: bool):
        self.path, self.payload, self.verify, self.values = path, payload, verify, {}

    def pushFilters(self, filters):
        for f in filters:
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            name = f.attribute[0] if values is not None and len(f.attribute) == 1 else None
            if name in TOLD:
                self.values[name] = self.values.get(name, set(values)) & set(values)
            else:
                yield f

    def partitions(self):
        fs, folder = opened(self.path)
        if fs.get_file_info(f"{folder}/{MANIFEST}").type == pafs.FileType.NotFound:
            found = fs.get_file_info(pafs.FileSelector(folder, recursive=True)) if fs.get_file_info(folder).type == pafs.FileType.Directory else [fs.get_file_info(folder)]
            names = [(f.path, f.size) for f in found if f.type == pafs.FileType.File and f.path.endswith((".warc", ".warc.gz"))]
            return [Range(name, 0, size) for name, size in sorted(names)] or [Range("", 0, 0)]
        with fs.open_input_stream(f"{folder}/{MANIFEST}") as file:
            files = json.loads(file.read())
        found = []
        for f in files:
            start = 0
            for border in [*f["borders"][1:], f["size"]]:
                if border - start >= SPLIT or border == f["size"]:
                    found.append(Range(f"{folder}/{f['file']}", start, border))
                    start = border
        return found or [Range("", 0, 0)]

    def read(self, part):
        fs, _ = opened(self.path)
        if not part.file:
            return
        columns: dict[str, list] = {k: [] for k in SCHEMA_NAMES}
        held = 0
        with fs.open_input_file(part.file) as file:
            for row in records(file, part.start, part.end, self.wanted, self.payload, self.verify):
                for k, v in zip(SCHEMA_NAMES, row, strict=True):
                    columns[k].append(v)
                held += 200 + len(row[-1] or b"")
                if held >= 8 << 20:
                    yield pa.RecordBatch.from_pydict(columns, schema=ARROW)
                    columns, held = {k: [] for k in SCHEMA_NAMES}, 0
        if columns["page_id"]:
            yield pa.RecordBatch.from_pydict(columns, schema=ARROW)

    def wanted(self, told: dict) -> bool:
        # a length that headers don't tell can't be judged here
        return all(told[k] in values or (k == "payload_bytes" and told[k] is None) for k, values in self.values.items())


def _page(urn: str):
    at = urn[len("<urn:page:") : -1] if urn.startswith("<urn:page:") else ""
    return int(at) if at else None


def _told(head: bytes) -> dict:
    """What a record's headers tell: the columns of TOLD, and ``length``, ``http`` under names of their own."""
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record: {version[:40]!r}")
    fields: dict[str, str] = {}
    for line in lines:
        if line[:1] in (" ", "\t") and fields:  # a folded line
            last = next(reversed(fields))
            fields[last] += " " + line.strip()
        else:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
    http = fields.get("content-type", "").lower().startswith("application/http")
    length = int(fields["content-length"])
    size = fields.get("x-payload-length")
    return {
        "page_id": _page(fields.get("warc-record-id", "")),
        "url": json.loads(fields["x-target"]) if "x-target" in fields else fields.get("warc-target-uri", "").strip("<>") or None,
        "record_type": fields["warc-type"],
        "payload_bytes": int(size) if size else None if http else length,
        "payload_digest": fields["warc-payload-digest"].rpartition(":")[2] if "warc-payload-digest" in fields else None,
        "refers_to": _page(fields.get("warc-refers-to", "")),
        "record_id": fields.get("warc-record-id"),
        "date": fields.get("warc-date"),
        "length": length,
        "http": http,
    }


def _row(told: dict, block: bytes | None, payload: bool, verify: bool):
    """A row of SCHEMA; ``block`` is None where nobody asked for it."""
    body = None
    if block is not None and told["record_type"] != "revisit":
        body = block[block.find(b"\r\n\r\n") + 4 :] if told["http"] and b"\r\n\r\n" in block else block
        if told["payload_bytes"] is None:
            told["payload_bytes"] = len(body)
        if verify and (told["payload_digest"] or digest_of(body), told["payload_bytes"]) != (digest_of(body), len(body)):
            raise ValueError(f"payload of {told['record_id']} differs from its digest")
    return (*[told[k] for k in TOLD], body if payload else None)


def member(raw: bytes) -> bytes:
    """``raw`` as one gzip member whose extra field "sl" tells its packed and unpacked length, so that a reader can skip it."""
    pack = zlib.compressobj(4, zlib.DEFLATED, -15)
    data = pack.compress(raw) + pack.flush()
    total = 12 + 12 + len(data) + 8
    extra = b"sl" + struct.pack("<HII", 8, total, len(raw))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + data + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


class Plain:
    """The bytes of a file from ``start``, inflated over gzip members where they are packed."""

    def __init__(self, file, start: int, end: int):
        self.file, self.at, self.end, self.held = file, start, end, b""
        file.seek(start)
        self.packed = file.read(2) == b"\x1f\x8b"
        file.seek(start)
        self.unpack = None

    def more(self) -> bool:
        if self.unpack is not None and self.unpack.eof:
            data = self.unpack.unused_data
            self.unpack = None
        else:
            data = b""
        if not data:
            data = self.file.read(min(1 << 20, self.end - self.file.tell()))
        if not data:
            if self.unpack is not None:
                raise ValueError("the archive ends inside a record")
            return False
        if self.packed:
            self.unpack = self.unpack or zlib.decompressobj(31)
            data = self.unpack.decompress(data)
        self.held += data
        return True

    def until(self, mark: bytes):
        """The bytes before ``mark``, which is passed, without blank lines before them; None at the end."""
        while not (rest := self.held.lstrip(b"\r\n")) and self.more():
            pass
        self.held = rest or self.held.lstrip(b"\r\n")
        while (found := self.held.find(mark)) < 0:
            if not self.more():
                if self.held.strip(b"\r\n"):
                    raise ValueError("the archive ends inside a record")
                return None
        out, self.held = self.held[:found], self.held[found + len(mark) :]
        return out

    def take(self, n: int, keep: bool):
        """The next ``n`` bytes, or None where nobody keeps them; those of a file that isn't packed are jumped over."""
        if not keep and not self.packed and n > len(self.held):
            if self.file.tell() + n - len(self.held) > self.end:
                raise ValueError("the archive ends inside a record")
            self.file.seek(n - len(self.held), 1)
            self.held = b""
            return None
        out = []
        while n:
            if not self.held and not self.more():
                raise ValueError("the archive ends inside a record")
            piece, self.held = self.held[:n], self.held[n:]
            n -= len(piece)
            if keep:
                out.append(piece)
        return b"".join(out) if keep else None


def records(file, start: int, end: int, wanted, payload: bool, verify: bool = False):
    """Rows of the records in start..end: headers first, and what isn't wanted is skipped."""
    file.seek(start)
    begin = file.read(24)
    if begin[:4] == b"\x1f\x8b\x08\x04" and begin[12:14] == b"sl":
        yield from _members(file, start, end, wanted, payload, verify)
        return
    plain = Plain(file, start, end)
    while (head := plain.until(b"\r\n\r\n")) is not None:
        told = _told(head)
        keep = wanted(told) and (payload or verify)
        block = plain.take(told["length"], keep)
        if wanted(told):
            yield _row(told, block, payload, verify)


def _members(file, start: int, end: int, wanted, payload: bool, verify: bool):
    """Rows of members that tell their length: a member that isn't wanted is skipped without being inflated."""
    at = start
    while at < end:
        file.seek(at)
        begin = file.read(24)
        if begin[:4] != b"\x1f\x8b\x08\x04" or begin[12:14] != b"sl":
            raise ValueError(f"no record with its length at {at}")
        total = struct.unpack("<I", begin[16:20])[0]
        unpack, head, left = zlib.decompressobj(-15), b"", total - 32
        while (split := head.find(b"\r\n\r\n")) < 0:
            data = file.read(min(2048, left))
            if not data:
                raise ValueError("the archive ends inside a record")
            left -= len(data)
            head += unpack.decompress(data)
        told = _told(head[:split])
        at += total
        if wanted(told):
            block = None
            if payload or verify:
                block = (head[split + 4 :] + unpack.decompress(file.read(left)) + unpack.flush())[: told["length"]]
            yield _row(told, block, payload, verify)


ARROW = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("date", pa.string()), ("payload", pa.binary())]
)
SCHEMA_NAMES = ARROW.names
#: What headers tell.
TOLD = tuple(SCHEMA_NAMES[:-1])


class WarcSource(DataSource):
    """``spark.read.format("warc").option("payload", "false").load(path)`` and ``df.write.format("warc").mode("append").save(path)``."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false", self.options.get("verify", "false").lower() == "true")

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload):
    """Bare upper-case base32 of the SHA-1 of a binary column: 32 digits of 5 bits, from hex pieces of 20 bits."""
    pieces = [F.conv(F.substring(F.sha1(payload), 5 * k + 1, 5), 16, 10).cast("int") for k in range(8)]
    return F.concat(*[F.substring(F.lit(_B32), F.shiftright(p, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for p in pieces for s in (15, 10, 5, 0)])


def to_records(pages: DataFrame, least: int = 0) -> DataFrame:
    """Rows of SCHEMA: of equal payloads of at least ``least`` bytes the largest page_id is the response, the others revisit it."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("payload"))
    rows = rows.withColumn("payload_digest", base32_sha1(F.col("payload"))).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    # only payloads that occur more than once: two numbers a payload are shuffled, no payload, and those few meet the rows by broadcast
    key = F.sha1("payload")
    several = rows.filter(F.col("payload_bytes") >= least).groupBy(key.alias("_key")).agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null")
    several = small(written(several.select("_key", "first"), "warc-several"))
    joined = rows.withColumn("_own", key).join(several, (F.col("_own") == F.col("_key")) & (F.col("payload_bytes") >= least), "left")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return joined.select(
        "page_id",
        "url",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        "payload_bytes",
        "payload_digest",
        F.when(again, F.col("first")).alias("refers_to"),
        F.lit(None).cast("string").alias("record_id"),
        F.lit(None).cast("string").alias("date"),
        "payload",
    )


def archived(pages: DataFrame, path: str | None = None, least: int = 0) -> str:
    """Writes ``pages`` as an archive below ``path`` (a new folder in the shared one by default) and returns its path."""
    spark = pages.sparkSession
    register(spark)
    path = path or f"{scratch(spark)}/rangeweave/warc-{uuid.uuid4().hex}"
    with bounded_batches(spark):
        to_records(pages, least).write.format("warc").mode("append").save(path)
    return path
