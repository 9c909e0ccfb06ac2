"""WARC archives: a Python data source that writes and reads ``.warc`` / ``.warc.gz`` files.

Reading.  ``partitions`` plans the files of the archive (those that the manifest of a finished
write lists; all ``.warc*`` files otherwise), the largest first, in groups of about
``group_bytes``.  Predicates on record_type, record_id, target_uri, payload_digest and refers_to
are pushed down: a record's header block is parsed first, and the payload of an unwanted record
is skipped by its length (of the gzip member, if its header tells it; by Content-Length in plain
files) without inflating or decoding it.  ``payload`` chooses what is done with wanted ones:
``keep`` returns the bytes, ``digest`` only hashes them, ``skip`` leaves them alone.

Writing.  Each task writes one file after another of about ``file_bytes``, one gzip member per
record, under names of its own; the driver's commit writes the manifest that makes them visible,
so files of lost or repeated attempts are never read.

Paths are opened with ``pyarrow.fs`` (``file:``, ``hdfs:``, ``s3:`` ...), so the archive lies in
a folder that all executors see.

Null uri, date and digest are left out of the record and read back as null; a null payload is
empty; an archive without files gives no rows.  Line breaks in header values become blanks.
"""
from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, In,
                                    InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage)

SCHEMA = ("record_id string, record_type string, target_uri string, warc_date string, refers_to string, "
          "payload_digest string, payload_bytes long, payload binary")
_MANIFEST = "_manifest.json"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: column -> header field
_FIELDS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri",
           "warc_date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
_WRAPPED = ("record_id", "refers_to")


def open_fs(path: str):
    """(filesystem, path inside it); a plain path is a local one."""
    return pafs.FileSystem.from_uri(path if ":" in path else "file://" + path)


# --- one record -----------------------------------------------------------------------------

def record_bytes(row: dict) -> bytes:
    """A response or resource (with payload) or a revisit (header of the original only)."""
    kind, payload = row["record_type"], row.get("payload") or b""
    size = row["payload_bytes"] if row.get("payload_bytes") is not None else len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http if kind == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{row['record_id']}>"]
    for column, field in (("target_uri", "WARC-Target-URI"), ("warc_date", "WARC-Date")):
        if row.get(column) is not None:
            lines.append(f"{field}: {' '.join(row[column].splitlines())}")
    if row.get("refers_to") is not None:
        lines.append(f"WARC-Refers-To: <{row['refers_to']}>")
    if kind == "revisit":
        lines.append(f"WARC-Profile: {_PROFILE}")
    if row.get("payload_digest") is not None:
        lines.append(f"WARC-Payload-Digest: sha256:{row['payload_digest']}")
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + body + b"\r\n\r\n"


def gzip_member(raw: bytes, level: int = 4) -> bytes:
    """A gzip member whose ``sl`` extra field tells its packed and unpacked length."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    packed = c.compress(raw) + c.flush()
    total = 10 + 2 + 12 + len(packed) + 8
    if max(total, len(raw)) >= 1 << 32:
        head = b"\x1f\x8b\x08\x00" + bytes(5) + b"\xff"
    else:
        head = b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H2sHII", 12, b"sl", 8, total, len(raw))
    return head + packed + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def parse_headers(block: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    last = None
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, _, value = line.partition(":")
            last = last.strip().lower()
            out[last] = value.strip()
    return out


def columns_of(headers: dict[str, str]) -> dict[str, str | None]:
    row = {c: headers.get(f) for c, f in _FIELDS.items()}
    for c in _WRAPPED:
        if row[c] and row[c][0] == "<" and row[c][-1] == ">":
            row[c] = row[c][1:-1]
    if row["payload_digest"]:
        row["payload_digest"] = row["payload_digest"].rpartition(":")[2]
    return row


class _Member:
    """The unpacked stream of one gzip member, inflated only as far as it is asked for."""

    def __init__(self, file):
        self.file, self.start = file, file.tell()
        head = file.read(10)
        if head[:3] != b"\x1f\x8b\x08":
            raise ValueError("not a gzip member")
        self.size = None
        if head[3] & 4:
            extra = file.read(struct.unpack("<H", file.read(2))[0])
            while len(extra) >= 4:
                name, n = extra[:2], struct.unpack("<H", extra[2:4])[0]
                if name == b"sl" and n == 8:
                    self.size = struct.unpack("<I", extra[4:8])[0]
                extra = extra[4 + n:]
        for flag in (8, 16):                      # file name, comment
            if head[3] & flag:
                while file.read(1) not in (b"\0", b""):
                    pass
        if head[3] & 2:
            file.read(2)
        self.inflate, self.have = zlib.decompressobj(-15), b""

    def _more(self) -> bool:
        if self.inflate.eof:
            return False
        chunk = self.file.read(1 << 16)
        if not chunk:
            return False
        self.have += self.inflate.decompress(chunk)
        return True

    def until(self, mark: bytes) -> bytes:
        while mark not in self.have and self._more():
            pass
        got, found, self.have = self.have.partition(mark)
        if not found:
            raise ValueError("a record's header does not end")
        return got

    def take(self, n: int) -> bytes:
        parts, size = [self.have], len(self.have)
        self.have = b""
        while size < n and not self.inflate.eof:
            chunk = self.file.read(1 << 20)
            if not chunk:
                break
            parts.append(self.inflate.decompress(chunk))
            size += len(parts[-1])
        got = b"".join(parts)
        self.have = got[n:]
        return got[:n]

    def close(self) -> None:
        """Goes to the next member: by its length if known, else by inflating the rest."""
        if self.size is not None:
            self.file.seek(self.start + self.size)
            return
        self.have = b""
        while not self.inflate.eof and self._more():
            self.have = b""
        self.file.seek(self.file.tell() - len(self.inflate.unused_data) + 8)


class _Plain:
    """A record of a plain file."""

    def __init__(self, file):
        self.file = file
        self.left = 0

    def until(self, mark: bytes) -> bytes:
        have = b""
        start = self.file.tell()
        while mark not in have:
            chunk = self.file.read(1 << 12)
            if not chunk:
                raise ValueError("a record's header does not end")
            have += chunk
        got = have.partition(mark)[0]
        self.file.seek(start + len(got) + len(mark))
        return got

    def body(self, n: int) -> None:
        self.end = self.file.tell() + n + 4

    def take(self, n: int) -> bytes:
        return self.file.read(n)

    def close(self) -> None:
        self.file.seek(self.end)


def records(file, size: int, wanted, payload: str):
    """Rows of one archive file that ``wanted`` accepts."""
    magic = file.read(2)
    file.seek(0)
    packed = magic == b"\x1f\x8b"
    while file.tell() < size:
        rec = _Member(file) if packed else _Plain(file)
        headers = parse_headers(rec.until(b"\r\n\r\n"))
        length = int(headers.get("content-length", 0))
        if not packed:
            rec.body(length)
        row = columns_of(headers)
        if wanted(row):
            row["payload_bytes"], row["payload"] = None, None
            http = headers.get("content-type", "").startswith("application/http")
            if row["record_type"] == "revisit":
                inner = parse_headers(rec.take(length))
                row["payload_bytes"] = int(inner["content-length"]) if "content-length" in inner else None
            elif payload != "skip":
                data = rec.take(length)
                if http:
                    data = data.partition(b"\r\n\r\n")[2]
                row["payload_bytes"] = len(data)
                row["payload_digest"] = hashlib.sha256(data).hexdigest()
                row["payload"] = data if payload == "keep" else None
            elif http:
                row["payload_bytes"] = int(parse_headers(rec.until(b"\r\n\r\n")).get("content-length", 0))
            else:
                row["payload_bytes"] = length
            yield row
        rec.close()


# --- the data source ------------------------------------------------------------------------

@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]]


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "keep")
        self.group_bytes = int(options.get("group_bytes", 64 << 20))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column not in _FIELDS or (column == "payload_digest" and self.payload != "skip"):
                yield f
            elif isinstance(f, (EqualTo, EqualNullSafe)):
                self.tests.append((column, "in", (f.value,)))
            elif isinstance(f, In):
                self.tests.append((column, "in", tuple(f.value)))
            elif isinstance(f, StringStartsWith):
                self.tests.append((column, "starts", f.value))
            elif isinstance(f, IsNotNull):
                self.tests.append((column, "given", None))
            else:
                yield f

    def wanted(self, row: dict) -> bool:
        for column, kind, value in self.tests:
            got = row[column]
            if not (got in value if kind == "in" else got is not None and (kind == "given" or got.startswith(value))):
                return False
        return True

    def partitions(self):
        fs, root = open_fs(self.path)
        listed = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        files = {i.path.rpartition("/")[2]: i for i in listed if i.type == pafs.FileType.File}
        names = [n for n in files if n.endswith((".warc", ".warc.gz"))]
        if _MANIFEST in files:
            with fs.open_input_stream(files[_MANIFEST].path) as f:
                names = json.loads(f.read())["files"]
        groups: list[Files] = []
        room = 0
        for n in sorted(names, key=lambda n: (-files[n].size, n)):
            if not groups or files[n].size > room:
                groups.append(Files([]))
                room = self.group_bytes
            groups[-1].files.append((files[n].path, files[n].size))
            room -= files[n].size
        return groups or [Files([])]

    def read(self, partition: Files):
        fs, _ = open_fs(self.path)
        rows, held = [], 0
        for path, size in partition.files:
            with fs.open_input_file(path) as f:
                for row in records(f, size, self.wanted, self.payload):
                    rows.append(row)
                    held += 200 + len(row["payload"] or b"")
                    if held > 8 << 20 or len(rows) >= 10_000:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)


_ARROW = pa.schema([(c, pa.string()) for c in ("record_id", "record_type", "target_uri", "warc_date", "refers_to",
                                               "payload_digest")]
                   + [("payload_bytes", pa.int64()), ("payload", pa.binary())])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_ARROW)


class WarcWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"]
        self.file_bytes = int(options.get("file_bytes", 64 << 20))
        self.packed = options.get("gzip", "true").lower() == "true"
        self.overwrite = overwrite

    def write(self, iterator):
        fs, root = open_fs(self.path)
        fs.create_dir(root, recursive=True)
        names: list[str] = []
        out, left = None, 0
        for row in iterator:
            raw = record_bytes(row.asDict())
            data = gzip_member(raw) if self.packed else raw
            if out is None or left <= 0:
                if out is not None:
                    out.close()
                names.append(f"{uuid.uuid4().hex}.warc" + ".gz" * self.packed)
                out, left = fs.open_output_stream(f"{root}/{names[-1]}", compression=None), self.file_bytes
            out.write(data)
            left -= len(data)
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages):
        fs, root = open_fs(self.path)
        fs.create_dir(root, recursive=True)
        names = [n for m in messages if m is not None for n in m.files]
        at = f"{root}/{_MANIFEST}"
        if not self.overwrite and fs.get_file_info(at).type == pafs.FileType.File:
            with fs.open_input_stream(at) as f:
                names += json.loads(f.read())["files"]
        with fs.open_output_stream(at + ".new") as f:
            f.write(json.dumps({"files": sorted(names)}).encode())
        fs.move(at + ".new", at)

    def abort(self, messages):
        fs, root = open_fs(self.path)
        for m in messages:
            for n in m.files if m is not None else []:
                fs.delete_file(f"{root}/{n}")


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options), overwrite)


def read_warc(spark: SparkSession, path: str, payload: str = "keep") -> DataFrame:
    """Records of an archive folder.  Sets ``spark.sql.python.filterPushdown.enabled`` in the
    session: Spark refuses sources that take predicates while it is off."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", payload).load(path)


def write_warc(records_df: DataFrame, path: str, mode: str = "append", **options) -> None:
    records_df.sparkSession.dataSource.register(WarcSource)
    records_df.write.format("warc").options(**options).mode(mode).save(path)


def page_records(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Record rows of pages(page_id, url, html).

    Of pages with equal payloads of at least ``min_bytes`` the one with the smallest page_id is
    a response and the others are revisits of it; shorter ones are all responses.  Null page_ids
    are never the smallest unless a payload has no other; rows that repeat the smallest page_id
    are responses too."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("payload_digest", F.sha2("payload", 256))
    p = p.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    repeated = (p.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest")
                .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    p = p.join(repeated, "payload_digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    urn = lambda c: F.concat(F.lit("urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")))
    return p.select(
        urn("page_id").alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"), F.lit("1970-01-01T00:00:00Z").alias("warc_date"),
        F.when(revisit, urn("first")).alias("refers_to"), "payload_digest", "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"))
