"""WARC files as a Python data source, and a writer for pages.

Files are planned as byte ranges; a range owns the records that begin in it. Record types and header equalities that a
query asks for are pushed into the reader, which looks at a record's WARC header first, decides, and then skips the
payload of a record that isn't wanted by its Content-Length, without decoding it; payloads aren't decoded either when
no payload column is read. Plain and gzip files (one member a record) are read; a gzip file is one partition.

As a name for paths: a file, a folder (all .warc and .warc.gz files in it) or a comma-separated list; local paths and
those that pyarrow's file systems know.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith

from corpusloom.llm import common

#: Bytes of a partition of a plain file; rows of a batch that the reader returns; bytes of such a batch, about.
SPLIT_BYTES, BATCH_ROWS, BATCH_BYTES = 32 << 20, 4096, 8 << 20

#: Columns that come from WARC headers, and the header of each. These can be pushed down.
HEADERS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "content_type": "content-type",
    "digest": "warc-payload-digest",
}
SCHEMA = "record_type string, record_id string, target_uri string, date string, content_type string, digest string, content_length long, headers map<string,string>, http_status int, http_headers map<string,string>, payload binary, file string, offset long"
_PAYLOAD = ("http_status", "http_headers", "payload")


@dataclass
class FileRange(InputPartition):
    path: str
    start: int
    end: int | None


def _files(path: str) -> list[tuple[pafs.FileSystem, str, str, int]]:
    """(file system, path there, URI, size) of the files, sorted by URI."""
    out = []
    for one in path.split(","):
        one = one.strip()
        if not one:
            continue
        fs, there = pafs.FileSystem.from_uri(one) if "://" in one or one.startswith("file:") else (pafs.LocalFileSystem(), one)
        prefix = one[: len(one) - len(there)] if one.endswith(there) else ""
        info = fs.get_file_info(there)
        if info.type == pafs.FileType.Directory:
            infos = fs.get_file_info(pafs.FileSelector(there, recursive=True))
            found = [i for i in infos if i.type == pafs.FileType.File and i.path.endswith((".warc", ".warc.gz"))]
        elif info.type == pafs.FileType.File:
            found = [info]
        else:
            raise FileNotFoundError(one)
        out += [(fs, i.path, prefix + i.path, i.size) for i in found]
    return sorted(out, key=lambda x: x[2])


class Wanted:
    """The pushed predicates: header -> allowed values or a beginning."""

    def __init__(self):
        self.values: dict[str, set[str]] = {}
        self.starts: list[tuple[str, str]] = []

    def add(self, f: Filter) -> bool:
        name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
        header = HEADERS.get(name)
        if header is None:
            return False
        if isinstance(f, EqualTo) and isinstance(f.value, str):
            new = {f.value}
        elif isinstance(f, In) and all(isinstance(v, str) for v in f.value):
            new = set(f.value)
        elif isinstance(f, StringStartsWith):
            self.starts.append((header, f.value))
            return True
        elif isinstance(f, IsNotNull):
            self.starts.append((header, ""))
            return True
        else:
            return False
        self.values[header] = self.values[header] & new if header in self.values else new
        return True

    def __call__(self, headers: dict[str, str]) -> bool:
        return all(headers.get(h) in vs for h, vs in self.values.items()) and all(h in headers and headers[h].startswith(s) for h, s in self.starts)


def parse_headers(block: bytes) -> dict[str, str]:
    """Names in lower case; folded lines are joined; of repeated names the first counts."""
    out: dict[str, str] = {}
    last = None
    for line in block.decode("utf-8", "replace").split("\n"):
        line = line.rstrip("\r")
        if line[:1] in " \t" and line.strip() and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            k, _, v = line.partition(":")
            last = k.strip().lower()
            out.setdefault(last, v.strip())
    return out


class _Plain:
    """A window over a plain file that is read forward; skipping seeks."""

    def __init__(self, f, size: int, at: int):
        self.f, self.size, self.at, self.buffer, self.begin = f, size, at, b"", at
        self.decoded = 0

    def _fill(self, n: int) -> None:
        have = len(self.buffer) - (self.at - self.begin)
        if have < n:
            rest = self.buffer[self.at - self.begin :] if 0 <= self.at - self.begin <= len(self.buffer) else b""
            self.f.seek(self.at + len(rest))
            self.buffer, self.begin = rest + self.f.read(max(n - len(rest), 1 << 16)), self.at

    def find(self, what: bytes, limit: int | None = None) -> int:
        """Position of `what` at or after the current place; -1 if there is none that begins before `limit`."""
        look = 0
        step = 1 << 16
        while True:
            self._fill(look + step)
            base = self.at - self.begin
            i = self.buffer.find(what, base + look)
            if i >= 0:
                return self.begin + i if limit is None or self.begin + i < limit else -1
            have = len(self.buffer) - base
            if have < look + step:
                return -1
            look = max(0, have - len(what) + 1)
            if limit is not None and self.at + look >= limit:
                return -1

    def take(self, n: int) -> bytes:
        self._fill(n)
        base = self.at - self.begin
        self.at += n
        return self.buffer[base : base + n]

    def skip(self, n: int) -> None:
        self.at += n
        if self.at - self.begin > len(self.buffer):
            self.buffer, self.begin = b"", self.at


def _plain_records(f, size: int, start: int, end: int, wanted, payload: bool) -> Iterator[tuple[dict[str, str], bytes | None, int]]:
    w = _Plain(f, size, start)
    if start:
        # The first record that begins in this range; the line break before it may lie in the range before.
        w.at = start - 1
        i = w.find(b"\nWARC/1.", end - 1)
        while i >= 0:
            w.at = i + 1
            # A real record, not a payload that quotes one: its header has a type and a length.
            j = w.find(b"\r\n\r\n")
            if j >= 0 and j - w.at < 1 << 16:
                head = parse_headers(w.take(j - w.at)[8:])
                w.at = i + 1
                if "warc-type" in head and head.get("content-length", "").isdigit():
                    break
            w.at = i + 1
            i = w.find(b"\nWARC/1.", end - 1)
        if i < 0:
            return
    while w.at < end:
        at = w.at
        j = w.find(b"\r\n\r\n")
        if j < 0:
            return
        line, _, block = w.take(j - at).partition(b"\r\n")
        if not line.lstrip().startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        w.skip(4)
        headers = parse_headers(block)
        n = int(headers.get("content-length", "0"))
        if wanted(headers):
            body = w.take(n) if payload else None
            if not payload:
                w.skip(n)
            yield headers, body, at
        else:
            w.skip(n)
        # Two line breaks follow a record; be lenient about their number.
        while w.at < size and w.take(1) in (b"\r", b"\n"):
            pass
        if w.at < size:
            w.at -= 1


def _gzip_records(f, wanted, payload: bool) -> Iterator[tuple[dict[str, str], bytes | None, int]]:
    """One member a record. The header is inflated first; the rest of an unwanted member is passed over in small pieces that are not kept."""
    raw, at = b"", 0
    while True:
        if not raw:
            raw = f.read(1 << 16)
            if not raw:
                return
        z, out, head, start = zlib.decompressobj(31), b"", None, at
        keep = True
        while not z.eof:
            if not raw:
                raw = f.read(1 << 16)
                if not raw:
                    raise EOFError("gzip member is cut off")
            before = len(raw)
            got = z.decompress(raw, 1 << 14 if head is None else 1 << 18)
            raw_next = z.unused_data if z.eof else z.unconsumed_tail
            at += before - len(raw_next)
            raw = raw_next
            if keep:
                out += got
            if head is None and (j := out.find(b"\r\n\r\n")) >= 0:
                head = parse_headers(out[:j].partition(b"\r\n")[2])
                out = out[j + 4 :]
                keep = payload and wanted(head)
                if not keep:
                    out = b""
        if head is not None and wanted(head):
            yield head, out[: int(head.get("content-length", "0"))] if payload else None, start


def split_http(block: bytes) -> tuple[int | None, dict[str, str] | None, bytes]:
    """Status, headers and body of an HTTP response; a block of another kind is all body."""
    if not block.startswith(b"HTTP/"):
        return None, None, block
    head, gap, body = block.partition(b"\r\n\r\n")
    line, _, rest = head.partition(b"\r\n")
    parts = line.split()
    status = int(parts[1]) if len(parts) > 1 and parts[1].isdigit() else None
    return status, parse_headers(rest), body if gap else b""


class WarcReader(DataSourceReader):
    def __init__(self, schema, options):
        self.names = [f.name for f in schema.fields]
        self.path = options.get("path", "")
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.wanted = Wanted()
        self.payload = any(n in _PAYLOAD for n in self.names) and options.get("payload", "true").lower() != "false"

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if not self.wanted.add(f):
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for _, _, uri, size in _files(self.path):
            if uri.endswith(".gz"):
                out.append(FileRange(uri, 0, None))
            else:
                out += [FileRange(uri, a, min(a + self.split, size)) for a in range(0, size, self.split)]
        return out or [FileRange("", 0, 0)]

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        ((fs, path, uri, size),) = _files(partition.path)
        rows: list[tuple] = []
        bytes_ = 0
        with fs.open_input_file(path) as f:
            records = _gzip_records(f, self.wanted, self.payload) if partition.end is None else _plain_records(f, size, partition.start, partition.end, self.wanted, self.payload)
            for headers, body, at in records:
                status, http, content = split_http(body) if body is not None and headers.get("warc-type") == "response" else (None, None, body)
                rows.append((headers, status, http, content, uri, at))
                bytes_ += len(content or b"")
                if len(rows) >= BATCH_ROWS or bytes_ >= BATCH_BYTES:
                    yield self.batch(rows)
                    rows, bytes_ = [], 0
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        text_map = pa.map_(pa.string(), pa.string())
        columns = []
        for name in self.names:
            if name in HEADERS:
                columns.append(pa.array([r[0].get(HEADERS[name]) for r in rows], pa.string()))
            elif name == "content_length":
                columns.append(pa.array([int(r[0]["content-length"]) if r[0].get("content-length", "").isdigit() else None for r in rows], pa.int64()))
            elif name == "headers":
                columns.append(pa.array([list(r[0].items()) for r in rows], text_map))
            elif name == "http_status":
                columns.append(pa.array([r[1] for r in rows], pa.int32()))
            elif name == "http_headers":
                columns.append(pa.array([None if r[2] is None else list(r[2].items()) for r in rows], text_map))
            elif name == "payload":
                columns.append(pa.array([r[3] for r in rows], pa.binary()))
            elif name == "file":
                columns.append(pa.array([r[4] for r in rows], pa.string()))
            elif name == "offset":
                columns.append(pa.array([r[5] for r in rows], pa.int64()))
            else:
                raise ValueError(f"unknown column {name}")
        return pa.record_batch(columns, names=self.names)


class WarcDataSource(DataSource):
    """spark.read.format("warc").load(path). Give a schema with fewer columns to leave payloads undecoded."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(schema, self.options)


def read_warc(spark: SparkSession, path: str, columns: Sequence[str] | None = None, **options) -> DataFrame:
    """The records of WARC files, of all kinds, with the named columns only; unknown names raise.

    Header columns are null where a record lacks the header; an empty file or folder gives no row; repeated records
    are listed each; an empty payload is empty, not null. Records that are cut off raise, and so does a damaged gzip
    member; one without a Content-Length is read as empty. There are no ties: records come in the order of their files.
    Payloads of any length are read whole.
    """
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("warc")
    if columns is not None:
        kinds = dict(x.strip().split(" ", 1) for x in SCHEMA.split(", "))
        reader = reader.schema(", ".join(f"{c} {kinds[c]}" for c in columns))
    return reader.options(**{k: str(v) for k, v in options.items()}).load(path)


def record(kind: str, uri: str | None, block: bytes, record_id: str, date: str = "2020-01-01T00:00:00Z", content_type: str = "application/http; msgtype=response", more: dict[str, str] | None = None) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record_id}>", f"WARC-Date: {date}"]
    if uri is not None:
        head.append("WARC-Target-URI: " + uri.replace("\r", " ").replace("\n", " "))
    head += [f"{k}: {v}" for k, v in (more or {}).items()] + [f"Content-Type: {content_type}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_records(page_id, url: str | None, html: str | None) -> bytes:
    """A request and a response record of a page; the page's id is a header of the response. A null url has no target header; a null html no response."""
    key = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}|{url}")
    out = record("request", url, b"GET / HTTP/1.1\r\n\r\n", str(key), content_type="application/http; msgtype=request", more={"X-Page-Id": str(page_id)})
    if html is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + html.encode()
        out += record("response", url, block, str(uuid.uuid5(key, "response")), more={"X-Page-Id": str(page_id)})
    return out


def write_pages(pages: DataFrame, folder: str, compress: bool = False) -> None:
    """Writes the pages as WARC files in `folder`, one for each partition, each begun with a warcinfo record. A task that is run again writes the same file anew; it is renamed into place when whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, there = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
        fs.create_dir(there, recursive=True)
        name = f"{there}/part-{task.partitionId():05d}.warc" + ".gz" * compress
        attempt = f"{there}/_attempt-{task.taskAttemptId()}"

        def put(f, data: bytes) -> None:
            if compress:
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = z.compress(data) + z.flush()
            f.write(data)

        n = 0
        with fs.open_output_stream(attempt, compression=None) as f:
            put(f, record("warcinfo", None, b"software: corpusloom\r\n", str(uuid.UUID(int=task.partitionId())), content_type="application/warc-fields"))
            for batch in batches:
                for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                    data = page_records(page_id, url, html)
                    if compress:
                        at = data.find(b"WARC/1.1", 8)
                        for piece in (data[:at], data[at:]) if at > 0 else (data,):
                            put(f, piece)
                    else:
                        f.write(data)
                    n += 1
        fs.move(attempt, name)
        yield pa.record_batch([pa.array([n], pa.int64())], names=["n"])

    pages.select("page_id", "url", "html").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written as WARC and read again through the data source: only responses, whose type is pushed down."""
    folder = f"{common.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_pages(common.table(spark, sf_dir, "pages"), folder)
    responses = read_warc(spark, folder, ["record_type", "target_uri", "headers", "http_status", "payload"]).filter("record_type = 'response'")
    html = F.decode("payload", "UTF-8")
    return responses.select(F.col("headers").getItem("x-page-id").cast("long").alias("page_id"), F.col("target_uri").alias("url"), F.col("http_status").cast("long").alias("status"), html.alias("html"))


QUERIES = {"op7_warc": op7_warc}
ORACLE = {"op7_warc": "SELECT page_id, url, CAST(200 AS BIGINT) AS status, html FROM pages WHERE html IS NOT NULL"}
