"""A Spark data source for WARC files (`format("warc")`), reader and writer.

The writer puts each record into a gzip member of its own, whose extra field
tells the member's length (subfield `sl`), so that a reader can step over a
record after its headers.  Each task writes files of its own; the commit lists
them, with offsets at which they may be split, in a manifest, so that files of
failed or repeated attempts are never read.

The reader plans partitions of whole files, or of ranges between a manifest's
offsets; takes filters on record type and header fields; parses the headers of
a record first; and neither inflates nor decodes the block of a record that
the filters reject, or of any record if `payload` isn't asked for.

Paths are those of pyarrow's file systems (local, s3, gs, hdfs); driver and
executors must reach them alike.  This module needs only the standard library
and pyarrow, and is sent to the workers as it is.
"""

from __future__ import annotations

import datetime
import json
import struct
import sys
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds

CHUNK = 64 << 10
MANIFEST = "_manifest.json"
#: Bytes of a written file, between its offsets for splitting, and of a planned partition.
FILE_BYTES, SPLIT_BYTES = 1 << 30, 32 << 20
#: Bytes of headers of a record at most; beyond it the file is no WARC file.
MAX_HEADERS = 1 << 20

SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, content_type string, content_length long, payload_digest string, "
    "payload_bytes long, refers_to string, headers map<string,string>, payload binary, file string, offset long"
)
#: Columns that are header fields.
FIELDS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "content_type": "Content-Type",
    "content_length": "Content-Length", "payload_digest": "WARC-Payload-Digest", "payload_bytes": "X-Payload-Bytes", "refers_to": "WARC-Refers-To",
}
NUMBERS = ("content_length", "payload_bytes")
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


# -- records -----------------------------------------------------------------


def record_bytes(fields: dict[str, str], block: bytes) -> bytes:
    """A WARC/1.1 record; line breaks in a field's value are escaped."""
    clean = lambda v: v.replace("\r", "%0D").replace("\n", "%0A")
    head = "".join(f"{name}: {clean(value)}\r\n" for name, value in fields.items() if value is not None)
    return b"WARC/1.1\r\n" + head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def member(record: bytes, level: int = 6) -> bytes:
    """A gzip member that tells its length, as far as 32 bits hold it."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = deflate.compress(record) + deflate.flush()
    tail = struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    size = 10 + 2 + 12 + len(body) + len(tail)
    if max(size, len(record)) >> 32:
        return struct.pack("<4BIBB", 31, 139, 8, 0, 0, 0, 255) + body + tail
    return struct.pack("<4BIBB", 31, 139, 8, 4, 0, 0, 255) + struct.pack("<H2sHII", 12, b"sl", 8, size, len(record)) + body + tail


def http_block(payload: bytes | None, size: int) -> bytes:
    """An HTTP response; without payload its head alone, as a revisit holds it."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    return head if payload is None else head + payload


def payload_of(block: bytes, fields: dict[str, str]) -> bytes:
    """The block without the head of an HTTP message."""
    if not fields.get("content-type", "").lower().replace(" ", "").startswith("application/http"):
        return block
    end = block.find(b"\r\n\r\n")
    return block[end + 4 :] if end >= 0 else b""


class Records:
    """The records of a file from `start` to `stop`, headers first.

    `wanted(fields)` is asked with the header fields (names in lower case);
    a record that it rejects is stepped over.  `blocks`: whether blocks are
    read at all.  `inflated` counts the bytes that were decompressed.
    """

    def __init__(self, file, compressed: bool, wanted: Callable[[dict], bool] = lambda f: True, blocks: bool = True, start: int = 0, stop: int | None = None):
        self.file, self.compressed, self.wanted, self.blocks, self.stop = file, compressed, wanted, blocks, stop
        self.raw, self.held, self.inflate, self.inflated = b"", bytearray(), None, 0
        self.member, self.member_size = start, None
        self.at = start  # of the byte after `raw`
        file.seek(start)

    def _read(self) -> bytes:
        chunk = self.file.read(CHUNK)
        self.at += len(chunk)
        return chunk

    def _more(self) -> bool:
        """Get more bytes of records; False at the end of the file."""
        if not self.compressed:
            chunk = self._read()
            self.held += chunk
            return bool(chunk)
        while True:
            if self.inflate is None:
                while len(self.raw) < 24 and (more := self._read()):
                    self.raw += more
                if not self.raw:
                    return False
                self.member, self.member_size = self.at - len(self.raw), None
                if self.raw[3:4] == b"\x04" and self.raw[12:16] == b"sl\x08\x00":
                    self.member_size = struct.unpack("<I", self.raw[16:20])[0]
                self.inflate = zlib.decompressobj(31)
            out = self.inflate.decompress(self.raw, CHUNK)  # may have more to give without input
            self.raw = self.inflate.unconsumed_tail
            ended = self.inflate.eof
            if ended:
                self.raw, self.inflate = self.inflate.unused_data, None
            self.held += out
            self.inflated += len(out)
            if out or ended:  # a caller may stop between two members
                return True
            self.raw = self._read()
            if not self.raw:
                return False

    def _skip(self, size: int) -> None:
        """Step over `size` bytes, the rest of a record."""
        while size > len(self.held):
            size -= len(self.held)
            self.held.clear()
            if not self.compressed:
                self.at += size
                self.file.seek(self.at)
                return
            if self.member_size is not None and self.inflate is not None:
                self.at = self.member + self.member_size
                self.file.seek(self.at)
                self.raw, self.inflate = b"", None
                return
            if not self._more():
                return
        del self.held[:size]

    def _take(self, size: int) -> bytes:
        while len(self.held) < size and self._more():
            pass
        out = bytes(self.held[:size])
        del self.held[:size]
        return out

    def __iter__(self) -> Iterator[tuple[int, dict[str, str], bytes | None]]:
        """(offset, fields, block or None) of the wanted records; offset: of the record, or of its gzip member."""
        while True:
            while self.held[:1] in (b"\r", b"\n"):
                del self.held[:1]
            if not self.held:
                begins = self.at - len(self.raw)
                if self.stop is not None and begins >= self.stop and self.inflate is None:
                    return
                if not self._more():
                    return
                continue
            offset = self.member if self.compressed else self.at - len(self.held)
            while (end := self.held.find(b"\r\n\r\n")) < 0:
                if len(self.held) > MAX_HEADERS or not self._more():
                    raise ValueError(f"no WARC record at byte {offset}")
            head = bytes(self.held[:end]).decode("utf-8", "replace").split("\r\n")
            if not head[0].startswith("WARC/"):
                raise ValueError(f"no WARC record at byte {offset}")
            fields: dict[str, str] = {}
            last = None
            for line in head[1:]:
                name, colon, value = line.partition(":")
                if line[:1] in (" ", "\t") and last:  # a folded line
                    fields[last] += " " + line.strip()
                elif colon:
                    last = name.strip().lower()
                    fields[last] = value.strip()
            del self.held[: end + 4]
            size = int(fields.get("content-length", 0))
            if not self.wanted(fields):
                self._skip(size + 4)
            elif self.blocks:
                yield offset, fields, self._take(size)
                self._skip(4)
            else:
                yield offset, fields, None
                self._skip(size + 4)


# -- filters -----------------------------------------------------------------


def _value(fields: dict[str, str], column: str):
    value = fields.get(FIELDS[column].lower())
    if value is None or column not in NUMBERS:
        return value
    return int(value) if value.isdigit() else None


_COMPARED = {
    ds.EqualTo: lambda a, b: a == b, ds.GreaterThan: lambda a, b: a > b, ds.GreaterThanOrEqual: lambda a, b: a >= b, ds.LessThan: lambda a, b: a < b,
    ds.LessThanOrEqual: lambda a, b: a <= b, ds.In: lambda a, b: a in b, ds.StringStartsWith: lambda a, b: a.startswith(b),
    ds.StringEndsWith: lambda a, b: a.endswith(b), ds.StringContains: lambda a, b: b in a,
}


def supported(f: ds.Filter) -> bool:
    if isinstance(f, ds.Not):
        return supported(f.child)
    return type(f) in (*_COMPARED, ds.EqualNullSafe, ds.IsNull, ds.IsNotNull) and len(f.attribute) == 1 and f.attribute[0] in FIELDS


def holds(f: ds.Filter, fields: dict[str, str]) -> bool | None:
    """What SQL says of a filter on header fields: None where it is null."""
    if isinstance(f, ds.Not):
        said = holds(f.child, fields)
        return None if said is None else not said
    value = _value(fields, f.attribute[0])
    if isinstance(f, ds.IsNull):
        return value is None
    if isinstance(f, ds.IsNotNull):
        return value is not None
    if isinstance(f, ds.EqualNullSafe):
        return value == f.value
    if value is None or f.value is None:
        return None
    if isinstance(f, ds.In):
        known = [v for v in f.value if v is not None]
        return True if value in known else None if len(known) < len(f.value) else False
    return _COMPARED[type(f)](value, f.value)


# -- reader ------------------------------------------------------------------


@dataclass
class FileRange(ds.InputPartition):
    """Parts (path, start, stop) of files; stop None: to the end."""

    parts: list[tuple[str, int, int | None]]


def plan(path: str, target: int) -> list[FileRange]:
    """Partitions of about `target` bytes: small files together, large ones at the manifest's offsets."""
    store, root = _opened(path)
    info = store.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        files = [(root, info.size, [])]
    elif store.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.File:
        with store.open_input_file(f"{root}/{MANIFEST}") as file:
            files = [(f"{root}/{f['name']}", f["bytes"], f["offsets"]) for f in json.loads(file.read())["files"]]
    else:
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        files = [(f.path, f.size, []) for f in found if f.type == fs.FileType.File and f.path.endswith((".warc", ".warc.gz"))]
    out, parts, held = [], [], 0
    for name, size, offsets in sorted(files):
        cuts = [0, *offsets, None]
        for start, stop in zip(cuts, cuts[1:]):
            length = (size if stop is None else stop) - start
            if parts and held + length > target:
                out.append(FileRange(parts))
                parts, held = [], 0
            parts.append((name, start, stop))
            held += length
    return [*out, FileRange(parts)] if parts else out


class WarcReader(ds.DataSourceReader):
    def __init__(self, schema, path: str, target: int):
        self.schema, self.path, self.target, self.filters = schema, path, target, []

    def pushFilters(self, filters):
        for f in filters:
            if supported(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        return plan(self.path, self.target) or [FileRange([])]

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        names, schema = [f.name for f in self.schema], to_arrow_schema(self.schema)
        store, _ = _opened(self.path)
        wanted = lambda fields: all(holds(f, fields) for f in self.filters)
        rows, held = [], 0
        for name, start, stop in partition.parts:
            with store.open_input_file(name) as file:
                for offset, fields, block in Records(file, name.endswith(".gz"), wanted, "payload" in names, start, stop):
                    row = {c: _value(fields, c) for c in names if c in FIELDS}
                    if block is not None:
                        row["payload"] = payload_of(block, fields)
                        held += len(block)
                    row |= {"headers": list(fields.items()), "file": name, "offset": offset}
                    rows.append({c: row.get(c) for c in names})
                    if len(rows) >= 1000 or held >= 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


# -- writer ------------------------------------------------------------------


@dataclass
class Written(ds.WriterCommitMessage):
    files: list[dict]


class WarcWriter(ds.DataSourceArrowWriter):
    """Columns of SCHEMA by name; `payload` null writes a revisit's head, `headers` are further fields."""

    def __init__(self, path: str, overwrite: bool, level: int):
        self.path, self.overwrite, self.level = path, overwrite, level
        self.date = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def _record(self, row: dict) -> bytes:
        payload, size = row.get("payload"), row.get("payload_bytes")
        size = len(payload or b"") if size is None else size
        kind = row.get("record_type") or ("revisit" if payload is None else "response")
        fields = {
            "WARC-Type": kind, "WARC-Record-ID": row.get("record_id") or f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": row.get("date") or self.date,
            "WARC-Target-URI": row.get("target_uri"), "WARC-Payload-Digest": row.get("payload_digest"), "X-Payload-Bytes": str(size),
            "WARC-Refers-To": row.get("refers_to"), "WARC-Profile": IDENTICAL if kind == "revisit" else None, "Content-Type": "application/http; msgtype=response",
        }
        return record_bytes(fields | dict(row.get("headers") or ()), http_block(payload, size))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _opened(self.path)
        store.create_dir(root, recursive=True)
        files: list[dict] = []
        file = None
        part = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        for batch in iterator:
            for row in batch.to_pylist():
                if file is None:
                    name = f"{part}-{len(files):03d}.warc.gz"
                    file, at = store.open_output_stream(f"{root}/{name}", compression=None), 0
                    files.append({"name": name, "bytes": 0, "records": 0, "offsets": []})
                out = member(self._record(row), self.level)
                if at - (files[-1]["offsets"] or [0])[-1] >= SPLIT_BYTES:
                    files[-1]["offsets"].append(at)
                file.write(out)
                at += len(out)
                files[-1]["records"] += 1
                files[-1]["bytes"] = at
                if at >= FILE_BYTES:
                    file.close()
                    file = None
        if file is not None:
            file.close()
        return Written(files)

    def commit(self, messages) -> None:
        store, root = _opened(self.path)
        store.create_dir(root, recursive=True)
        path, files = f"{root}/{MANIFEST}", [f for m in messages if m is not None for f in m.files]
        if not self.overwrite and store.get_file_info(path).type == fs.FileType.File:
            with store.open_input_file(path) as file:
                files = json.loads(file.read())["files"] + files
        with store.open_output_stream(f"{path}.new") as file:
            file.write(json.dumps({"files": files}).encode())
        store.move(f"{path}.new", path)

    def abort(self, messages) -> None:
        store, root = _opened(self.path)
        for f in (f for m in messages if m is not None for f in m.files):
            store.delete_file(f"{root}/{f['name']}")


class WarcSource(ds.DataSource):
    """Options: path; level of compression (6); target bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(schema, self.options["path"], int(self.options.get("target", SPLIT_BYTES)))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite, int(self.options.get("level", 6)))


def register(spark: SparkSession) -> None:
    """Make `format("warc")` known to the session and let it push filters down."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
