"""WARC archives as a Spark data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``."""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

#: What a record's header holds; payload_digest is bare lower-case hex, payload_bytes the full payload's size.
HEADER = "record_id string, record_type string, target_uri string, record_date timestamp, payload_digest string, payload_bytes long, refers_to string"
SCHEMA = HEADER + ", payload binary"
#: Payloads from this size on are stored once.
MIN_SHARED_BYTES = 1_000
#: A file is closed at this size, and files are read together up to it.
FILE_BYTES = 64 << 20
BATCH_BYTES, BATCH_ROWS = 8 << 20, 1_000
#: The most bytes of a record that are inflated to find the end of its header, at a time.
HEAD_BYTES = 4_096
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def member(block: bytes) -> bytes:
    """A gzip member whose extra field ``sl`` has the lengths of the member and of its content, so that readers can skip it."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(block) + deflate.flush()
    extra = b"sl" + struct.pack("<HII", 8, 24 + len(body) + 8, len(block))
    return b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(block), len(block) & 0xFFFFFFFF)


def record(row: dict) -> bytes:
    """A WARC/1.1 response or revisit record with an HTTP block; a revisit has the HTTP header alone."""
    kind = row["record_type"] or "response"
    payload = row["payload"] or b""
    size = row["payload_bytes"] if row["payload_bytes"] is not None else len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind != "revisit" else b"")
    when = row["record_date"] or datetime(1970, 1, 1, tzinfo=UTC)
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{row['record_id'] or ''}>"), ("WARC-Date", when.strftime("%Y-%m-%dT%H:%M:%SZ"))]
    if row["target_uri"] is not None:
        fields.append(("WARC-Target-URI", " ".join(row["target_uri"].split())))
    if row["payload_digest"] is not None:
        fields.append(("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"))
    if kind == "revisit":
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{row['refers_to'] or ''}>")]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if ":" in x)}


def _date(text: str | None) -> datetime | None:
    """A WARC date; null if it is none."""
    try:
        return datetime.fromisoformat(text) if text else None
    except ValueError:
        return None


def _number(text: str | None) -> int:
    return int(text) if text and text.isdigit() else 0


def _bare(uri: str | None) -> str | None:
    return (uri.strip("<>") or None) if uri is not None else None


def parse_header(head: bytes, http: bytes) -> dict:
    """The columns of ``HEADER`` from a record's two headers."""
    w, h = _fields(head), _fields(http)
    digest, when, size = w.get("warc-payload-digest"), w.get("warc-date"), (h if http else w).get("content-length", "")
    return {
        "record_id": _bare(w.get("warc-record-id")),
        "record_type": w.get("warc-type"),
        "target_uri": w.get("warc-target-uri"),
        "record_date": _date(when),
        "payload_digest": digest.rpartition(":")[2].lower() if digest else None,
        "payload_bytes": int(size) if size.isdigit() else None,
        "refers_to": _bare(w.get("warc-refers-to")),
    }


#: The type of a record that its file's end cuts off.
CUT = "cut"
TESTS = {
    EqualTo: lambda f, x: x is not None and x == f.value,
    EqualNullSafe: lambda f, x: x == f.value,
    In: lambda f, x: x is not None and x in f.value,
    IsNull: lambda f, x: x is None,
    IsNotNull: lambda f, x: x is not None,
    StringStartsWith: lambda f, x: x is not None and x.startswith(f.value),
    StringEndsWith: lambda f, x: x is not None and x.endswith(f.value),
    StringContains: lambda f, x: x is not None and f.value in x,
}
FILTERED = {"record_id", "record_type", "target_uri", "payload_digest", "payload_bytes", "refers_to"}


class Stream:
    """Bytes that come in parts: what is held of them is no more than was asked for and the rest of one part."""

    def __init__(self, parts: Iterator[bytes]) -> None:
        self.parts, self.held = parts, bytearray()

    def fill(self) -> bool:
        part = next(self.parts, b"")
        self.held += part
        return bool(part)

    def pass_over(self, chars: bytes = b"\r\n\0") -> None:
        """Take away line ends and padding, as far as they go."""
        while True:
            left = self.held.lstrip(chars)
            taken, self.held = len(self.held), left
            if left or not (taken and self.fill() or self.fill()):
                return

    def find(self, mark: bytes, most: int | None = None) -> int:
        """Where a mark ends, within the next ``most`` bytes if given; -1 if there is none."""
        while (at := self.held.find(mark, 0, most)) < 0:
            if most is not None and len(self.held) >= most or not self.fill():
                return -1
        return at + len(mark)

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self.fill():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def skip(self, n: int) -> int:
        """Take n bytes away without holding them; how many were missing."""
        while n > len(self.held):
            n -= len(self.held)
            self.held.clear()
            if not self.fill():
                return n
        del self.held[:n]
        return 0


def _one(s: Stream, keep, payloads: bool) -> tuple[dict | None, bool, int, int, int]:
    """The record that a stream stands at: its row if it is kept, whether it is cut off, its block's size, the bytes of its own header, and the bytes of its block not read yet.

    A payload is taken if the row is kept and payloads are wanted, else it is left to the caller to skip.
    """
    end = s.find(b"\r\n\r\n")
    whole = end >= 0
    head = s.take(end) if whole else s.take(len(s.held))
    fields = _fields(head)
    size = _number(fields.get("content-length")) if whole else 0
    kind, http = fields.get("content-type", "").lower(), b""
    while not kind and len(s.held) < min(5, size) and s.fill():
        pass
    if size and (kind.startswith("application/http") or not kind and s.held[:5] == b"HTTP/"):
        at = s.find(b"\r\n\r\n", size)
        http = s.take(at if at >= 0 else size)
        whole = whole and (at >= 0 or len(http) == size)
    row, rest = parse_header(head, http), size - len(http)
    if not whole:
        row["record_type"] = CUT
    wanted = keep(row)
    if wanted and payloads:
        body = s.take(rest) if whole else b""
        if len(body) < rest:
            whole, row["record_type"] = False, CUT
            wanted = keep(row)
        rest = 0
        row["payload"] = None if row["record_type"] in ("revisit", CUT) else body
    return (row if wanted else None), not whole, size, len(head), rest


class Member:
    """A gzip member at a file's current position; ``after``, where the next one starts, is known at once only if ``sl`` tells it."""

    def __init__(self, f: io.BufferedReader) -> None:
        self.f, start = f, f.tell()
        self.after = self.inflated = None
        self.cut = False
        head = f.read(10)
        flags = head[3] if len(head) == 10 else 0
        self.cut = len(head) < 10
        if flags & 4:
            (size,) = struct.unpack("<H", f.read(2).ljust(2, b"\0"))
            extra, at = f.read(size), 0
            while at + 4 <= len(extra):
                (n,) = struct.unpack_from("<H", extra, at + 2)
                if extra[at : at + 2] == b"sl" and n == 8 and at + 12 <= len(extra):
                    packed, self.inflated = struct.unpack_from("<II", extra, at + 4)
                    self.after = start + packed
                at += 4 + n
        for _ in range(bool(flags & 8) + bool(flags & 16)):  # a file name, a comment
            while f.read(1) not in (b"\0", b""):
                pass
        if flags & 2:  # a checksum of this header
            f.read(2)
        self.body = f.tell()

    def parts(self) -> Iterator[bytes]:
        """The content, inflated piece by piece as far as it is asked for; ``cut`` tells that the file ends before it does."""
        inflate, taken = zlib.decompressobj(-15), 0
        while not inflate.eof and not self.cut:
            raw = inflate.unconsumed_tail
            if not raw:
                raw = self.f.read(HEAD_BYTES)
                taken += len(raw)
                if not raw:
                    self.cut = True
                    return
            if out := inflate.decompress(raw, HEAD_BYTES):
                yield out
        if self.after is None:
            self.after = self.body + taken - len(inflate.unused_data) + 8


def _members_records(member: Member, keep, payloads: bool) -> Iterator[dict]:
    """All records of a member; where ``sl`` says that it holds the first one alone, it is not inflated further than is asked for."""
    s = Stream(member.parts())
    while True:
        s.pass_over()
        if not s.held:
            return
        if s.held[:5] != b"WARC/"[: len(s.held)]:
            raise ValueError(f"no WARC record in the member before byte {member.body}")
        row, cut, size, head, rest = _one(s, keep, payloads)
        alone = member.inflated is not None and head + size + 4 >= member.inflated
        if not cut and not alone:
            if s.skip(rest):  # cut off in a payload that nobody asked for
                cut = True
                if row is not None:
                    row["record_type"] = CUT
                    row = row if keep(row) else None
        if row is not None:
            yield row
        if cut or alone:
            return


def records(f: io.BufferedReader, keep, payloads: bool) -> Iterator[dict]:
    """A file's records that ``keep`` accepts by their header; other payloads are skipped, not decoded.

    Members of a gzip file may hold any number of records, one of each or all of the file. Line ends and zero bytes
    between records and after the last one are passed over. Where the file ends inside a record, that one has the type
    ``cut``, what its header tells and no payload, and ends the file; in a payload that is skipped this is not looked for
    if the next record's place is known without reading it.
    """
    at = 0
    while True:
        f.seek(at)
        magic = f.peek(5)[:5]
        if not magic:
            return
        if magic[:1] in (b"\r", b"\n", b"\0"):
            while (part := f.read(HEAD_BYTES)) and not (left := part.lstrip(b"\r\n\0")):
                at += len(part)
            if not part:
                return
            at += len(part) - len(left)
        elif magic[:2] == b"\x1f\x8b"[: len(magic)]:
            member = Member(f)
            yield from _members_records(member, keep, payloads)
            if member.cut:
                return
            at = member.after
        elif magic == b"WARC/"[: len(magic)]:
            s = Stream(iter(lambda: f.read(HEAD_BYTES), b""))
            row, cut, size, head, _ = _one(s, keep, payloads)
            if row is not None:
                yield row
            if cut:
                return
            at += head + size
        else:
            raise ValueError(f"no WARC record at byte {at}")


@dataclass
class Files(InputPartition):
    paths: list[str]

    def __init__(self, paths: list[str]) -> None:
        super().__init__(paths)
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, tasks: int) -> None:
        self.path, self.schema, self.tasks, self.filters = path, schema, tasks, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if type(f) in TESTS and len(f.attribute) == 1 and f.attribute[0] in FILTERED:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Whole files, of a folder and those in it or the one that is named; small ones together, but in as many groups as tasks can run at once."""
        store, root = fs.FileSystem.from_uri(self.path)
        named = store.get_file_info(root)
        found = [named] if named.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        below = len(root.rstrip("/")) + 1
        files = sorted((x for x in found if x.type == fs.FileType.File and (x is named or not any(part[:1] in "._" for part in x.path[below:].split("/")))), key=lambda x: x.path)
        most = min(FILE_BYTES, sum(x.size for x in files) // max(1, self.tasks) + 1)
        groups: list[list[str]] = []
        filled = most
        for info in files:
            if filled + info.size > most:
                groups.append([])
                filled = 0
            groups[-1].append(info.path)
            filled += info.size
        return [Files(g) for g in groups]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        names, payloads = self.schema.names, "payload" in self.schema.names
        tests = [(f.attribute[0], f, TESTS[type(f)]) for f in self.filters]
        schema = to_arrow_schema(self.schema)

        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{k: r.get(k) for k in names} for r in rows], schema=schema)

        store, _ = fs.FileSystem.from_uri(self.path)
        rows, size = [], 0
        for path in partition.paths if partition else ():
            with store.open_input_file(path) as raw, io.BufferedReader(raw, 1 << 20) as f:
                for row in records(f, lambda r: all(t(f, r[k]) for k, f, t in tests), payloads):
                    rows.append(row)
                    size += len(row.get("payload") or b"")
                    if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield batch(rows)
                        rows, size = [], 0
        if rows:
            yield batch(rows)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Tasks write hidden files of unique names; the commit shows them, so that attempts that failed leave nothing to read."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        for batch in iterator:
            for k in range(batch.num_rows):
                if out is None or size >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = store.open_output_stream(f"{root}/.{names[-1]}", compression=None), 0
                data = member(record(batch.slice(k, 1).to_pylist()[0]))
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        new = [n for m in messages if m for n in m.names]
        if self.overwrite:
            for info in store.get_file_info(fs.FileSelector(root)):
                if info.type == fs.FileType.File and info.base_name.lstrip(".") not in new:
                    store.delete_file(info.path)
        for n in new:
            store.move(f"{root}/.{n}", f"{root}/{n}")

    def abort(self, messages: list[Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        for n in (n for m in messages if m for n in m.names):
            if store.get_file_info(f"{root}/.{n}").type == fs.FileType.File:
                store.delete_file(f"{root}/.{n}")


class WarcDataSource(DataSource):
    """Reads WARC files, gzipped by record or plain; without the column ``payload`` in the schema no payload is decoded."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema, int(self.options.get("tasks", 1)))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the file or under the folder ``path``; filters on header columns are applied before a payload is decoded.

    For these filters it turns ``spark.sql.python.filterPushdown.enabled`` on in the session, and leaves it on: the
    plan is made when the result is used. A record that its file's end cuts off has the type ``cut`` (see ``records``).
    """
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").schema(SCHEMA if payloads else HEADER).option("tasks", spark.sparkContext.defaultParallelism).load(path)


def write_warc(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Write rows of ``SCHEMA`` (missing columns are null) as gzipped WARC files."""
    rows.sparkSession.dataSource.register(WarcDataSource)
    want = StructType.fromDDL(SCHEMA)
    cols = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want]
    rows.select(*cols).write.format("warc").mode(mode).save(path)


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_SHARED_BYTES) -> DataFrame:
    """Pages as records: of equal payloads of at least ``min_bytes`` the one with the largest id is kept, others refer to it.

    A null html is an empty payload. Ids become ``urn:page:<id>``, a null id ``urn:page:``; it is smaller than
    any other. Rows that share the largest id all keep their payload. Other columns are not read.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    shared = rows.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.count("*").alias("n"), F.max("id").alias("keeper")).filter("n > 1").select(F.col("payload_digest").alias("digest"), "keeper")
    at = (F.col("payload_digest") == F.col("digest")) & (F.col("payload_bytes") >= min_bytes)
    both = rows.join(shared, at, "left")
    revisit = F.col("digest").isNotNull() & ~F.col("id").eqNullSafe(F.col("keeper"))

    def urn(c: str) -> Column:
        return F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))

    return both.select(
        urn("id").alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.lit(None).cast("timestamp").alias("record_date"),
        "payload_digest",
        "payload_bytes",
        F.when(revisit, urn("keeper")).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def page_of(column: str) -> Column:
    """The page id in a record's id."""
    return F.regexp_extract(column, r"^urn:page:(-?\d+)$", 1).try_cast("long")
