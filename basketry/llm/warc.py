"""WARC archives as a PySpark Python data source, format "warc".

Reading: one partition for each group of files of about SPLIT bytes. Filters on record_type,
target_uri, record_id, refers_to and payload_digest are pushed into the reader, which parses a record's
header first and passes over the payload of a record that it does not want: by seeking in plain
files, and without keeping or decoding it in compressed ones. With the option payload=false no payload
is decoded at all. Files are plain (.warc) or compressed record by record (.warc.gz).

Writing: each task writes a file under a name of its own; when all are done the driver lists the files of the tasks
that count in a manifest of this write, and readers go by the manifests of all writes. What lost or repeated
tasks leave is never read. Mode overwrite takes away the files of earlier writes once its own manifest is there. Records without an id
get one, and all have a WARC-Date: that of the option "date", or of the write's begin.
"""

from __future__ import annotations

import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from ..session import checkpoint_dir
from .common import cut, ready, table

MANIFEST, SPLIT, CHUNK, ROWS = re.compile(r"_warc_files-[0-9a-f]+\.json"), 128 << 20, 1 << 16, 500
#: What a revisit with the payload of an earlier record conforms to.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Result columns that a filter may be pushed down on, and the header of each.
PUSHED = {"record_type": "warc-type", "target_uri": "warc-target-uri", "record_id": "warc-record-id", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
READ = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, headers map<string,string>, payload binary"
WRITE = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload binary, headers map<string,string>"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and plain path of a URI or local path."""
    path = re.sub(r"^file:/+", "/", path)
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


def manifests(fs: pafs.FileSystem, path: str) -> list[str]:
    """The manifests of all writes to a folder."""
    return [f.path for f in fs.get_file_info(pafs.FileSelector(path)) if MANIFEST.fullmatch(f.base_name)]


def listed(fs: pafs.FileSystem, manifest: str) -> list[str]:
    with fs.open_input_stream(manifest) as f:
        return json.loads(f.read())


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


class _Plain:
    """A plain file: reads, and passes over by seeking."""

    def __init__(self, file):
        self.file = io.BufferedReader(file, CHUNK) if isinstance(file, io.RawIOBase) else file

    def header(self) -> bytes:
        return _until_blank(self.file.read, self._back)

    def _back(self, n: int) -> None:
        self.file.seek(-n, 1)

    def take(self, n: int) -> bytes:
        return self.file.read(n)

    def skip(self, n: int) -> None:
        self.file.seek(n, 1)


class _Zipped:
    """A file of gzip members, decompressed a chunk at a time."""

    def __init__(self, file):
        self.file, self.raw, self.buffer, self.unzip = file, b"", b"", None

    def _more(self) -> bytes:
        while True:
            if self.unzip is None or self.unzip.eof:
                rest = self.unzip.unused_data if self.unzip else self.raw
                rest = rest or self.file.read(CHUNK)
                if not rest:
                    return b""
                self.unzip, self.raw = zlib.decompressobj(31), rest
            else:
                self.raw = self.unzip.unconsumed_tail or self.file.read(CHUNK)
                if not self.raw:
                    return b""
            if out := self.unzip.decompress(self.raw, CHUNK):
                return out

    def _read(self, n: int) -> bytes:
        parts, have = [self.buffer], len(self.buffer)
        while have < n and (more := self._more()):
            parts.append(more)
            have += len(more)
        whole = b"".join(parts)
        self.buffer = whole[n:]
        return whole[:n]

    def _back(self, n: int) -> None:
        raise NotImplementedError

    def header(self) -> bytes:
        while (at := self.buffer.find(b"\r\n\r\n")) < 0:
            if not (more := self._more()):
                out, self.buffer = self.buffer, b""
                return out
            self.buffer += more
        out, self.buffer = self.buffer[:at], self.buffer[at + 4 :]
        return out

    def take(self, n: int) -> bytes:
        return self._read(n)

    def skip(self, n: int) -> None:
        n -= len(self.buffer)
        if n < 0:
            self.buffer = self.buffer[n:]
            return
        self.buffer = b""
        while n > 0 and (more := self._more()):
            if len(more) > n:
                self.buffer = more[n:]
            n -= len(more)


def _until_blank(read, back) -> bytes:
    have = b""
    while (at := have.find(b"\r\n\r\n")) < 0:
        if not (more := read(1024)):
            return have
        have += more
    if extra := len(have) - at - 4:
        back(extra)
    return have[:at]


def records(file, zipped: bool, wanted, payloads: bool = True) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(header fields in lower case, payload) of the wanted records of a file; a response's payload goes without its HTTP header."""
    source = (_Zipped if zipped else _Plain)(file)
    while True:
        head = source.header().lstrip(b"\r\n")
        if not head:
            return
        first, *lines = head.decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {first[:80]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        n = int(fields.get("content-length", 0))
        if payloads and wanted(fields):
            body = source.take(n)
            if len(body) < n:
                raise EOFError(f"a record ends after {len(body)} of {n} bytes")
            if fields.get("content-type", "").startswith("application/http"):
                body = body.partition(b"\r\n\r\n")[2]
            yield fields, body
        else:
            source.skip(n)
            if not payloads and wanted(fields):
                yield fields, None
        source.skip(4)


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.payloads = options["path"], str(options.get("payload", "true")).lower() != "false"
        self.split = int(options.get("splitBytes", SPLIT))
        self.wants: list[tuple[str, tuple]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in PUSHED:
                values = f.value if isinstance(f, In) else (f.value,)
                self.wants.append((PUSHED[f.attribute[0]], tuple(values)))
            else:
                yield f

    def partitions(self):
        fs, path = store(self.path)
        info = fs.get_file_info(path)
        if info.type == pafs.FileType.File:
            found = [info]
        elif lists := manifests(fs, path):
            names = sorted({n for m in lists for n in listed(fs, m)})
            found = fs.get_file_info([f"{path}/{n}" for n in names]) if names else []
        else:
            found = [f for f in fs.get_file_info(pafs.FileSelector(path, recursive=True)) if re.search(r"\.warc(\.gz)?$", f.path)]
        groups, size = [[]], 0
        for f in sorted(found, key=lambda f: f.path):
            if groups[-1] and size + f.size > self.split:
                groups.append([])
                size = 0
            groups[-1].append(f.path)
            size += f.size
        return [Files(tuple(g)) for g in groups]

    def read(self, partition: Files):
        fs, _ = store(self.path)

        def wanted(fields: dict[str, str]) -> bool:
            return all(fields.get(h) in values for h, values in self.wants)

        schema = pa.schema([(n, pa.string()) for n in PUSHED] + [("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
        order = ["record_type", "record_id", "target_uri", "refers_to", "payload_digest"]
        schema = pa.schema([*(schema.field(n) for n in order), schema.field("headers"), schema.field("payload")])
        rows: list[tuple] = []
        held = 0
        for path in partition.paths:
            zipped = path.endswith(".gz")
            with (fs.open_input_stream(path, compression=None) if zipped else fs.open_input_file(path)) as f:
                for fields, body in records(f, zipped, wanted, self.payloads):
                    rows.append((*(fields.get(PUSHED[n]) for n in order), list(fields.items()), body))
                    held += len(body or b"")
                    if len(rows) >= ROWS or held > 16 << 20:
                        yield _batch(rows, schema)
                        rows, held = [], 0
        if rows:
            yield _batch(rows, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool = False):
        self.path, self.zipped, self.overwrite = options["path"], str(options.get("compression", "gzip")).lower() == "gzip", overwrite
        self.date = options.get("date") or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(self, iterator):
        fs, path = store(self.path)
        fs.create_dir(path, recursive=True)
        name, out = f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.zipped, None
        for batch in iterator:
            for row in batch.to_pylist():
                out = out or fs.open_output_stream(f"{path}/{name}", compression=None)
                out.write(self._record(row))
        if out is None:
            return Written(None)
        out.close()
        return Written(name)

    def _record(self, row: dict) -> bytes:
        body = row["payload"] or b""
        response = row["record_type"] == "response"
        body = HTTP + body if response else body
        fields = {
            "WARC-Type": row["record_type"],
            "WARC-Record-ID": row["record_id"] or f"<urn:uuid:{uuid.uuid4()}>",
            "WARC-Date": self.date,
            "WARC-Target-URI": row["target_uri"],
            "WARC-Refers-To": row["refers_to"],
            "WARC-Payload-Digest": row["payload_digest"],
            "WARC-Profile": PROFILE if row["record_type"] == "revisit" else None,
            "Content-Type": "application/http; msgtype=response" if response else None,
        } | dict(row["headers"] or [])
        lines = [f"{k}: {re.sub(r'[\r\n]+', ' ', v)}" for k, v in fields.items() if v is not None]
        record = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(body)}"]).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
        if not self.zipped:
            return record
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        return z.compress(record) + z.flush()

    def commit(self, messages):
        fs, path = store(self.path)
        fs.create_dir(path, recursive=True)
        earlier = manifests(fs, path) if self.overwrite else []
        with fs.open_output_stream(f"{path}/_warc_files-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps(sorted(m.name for m in messages if m and m.name)).encode())
        for m in earlier:
            names = listed(fs, m)
            fs.delete_file(m)
            for n in names:
                fs.delete_file(f"{path}/{n}")

    def abort(self, messages):
        fs, path = store(self.path)
        for m in messages:
            if m and m.name:
                fs.delete_file(f"{path}/{m.name}")


class WarcSource(DataSource):
    """spark.read.format("warc").load(path) and df.write.format("warc").mode("append").save(path)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return READ

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def archive(pages: DataFrame, path: str, least: int = 100) -> None:
    """Write a record per page under path: of equal payloads of at least least bytes the smallest page_id's is a response, others revisit it.

    A null html is an empty payload. Smaller payloads are all responses, as are all of pages without a page_id, which get a
    record id of their own. Rows that repeat a page_id each give a record, none of them revisits its own. The payload's size and the
    url go into header fields, so that a revisit tells them without a payload. Payloads of any length are kept whole. An empty
    table writes an archive without records. Other columns are passed over.
    """
    register(ready(pages.sparkSession))
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", body.alias("payload")).withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload"))
    first = cut(rows.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first")))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    again = F.coalesce(F.col("page_id") != F.col("first"), F.lit(False))
    out = rows.join(first, "digest", "left").select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        urn("page_id").alias("record_id"),
        F.coalesce("url", F.lit("")).alias("target_uri"),
        F.when(again, urn("first")).alias("refers_to"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.when(~again, F.col("payload")).alias("payload"),
        F.create_map(F.lit("WARC-Payload-Length"), F.col("bytes").cast("string")).alias("headers"),
    )
    out.write.format("warc").mode("append").save(path)


def op6_warc(spark, sf_dir):
    """Archives pages, reads the archive back (responses with, revisits without decoding payloads) and tells what it holds.

    A null html is an empty payload; of equal payloads the smallest page_id's is the response; a page without page_id has a null one and is a
    response; repeated rows are each told; an empty table gives no rows.
    """
    pages = table(ready(spark), sf_dir, "pages")
    path = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    archive(pages, path)
    kind = pages.schema["page_id"].dataType.simpleString()
    page = lambda c: F.regexp_extract(c, r"urn:page:(-?\d+)", 1)
    load = spark.read.format("warc")
    whole = load.load(path).where("record_type = 'response'").select(
        page("record_id").try_cast(kind).alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
        "record_type",
        F.lit(None).cast(kind).alias("refers_to"),
    )
    again = load.option("payload", "false").load(path).where("record_type = 'revisit'").select(
        page("record_id").try_cast(kind).alias("page_id"),
        F.element_at("headers", "warc-payload-length").cast("long").alias("payload_bytes"),
        F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"),
        "record_type",
        page("refers_to").try_cast(kind).alias("refers_to"),
    )
    out = cut(whole.unionByName(again))
    fs, plain = store(path)
    fs.delete_dir(plain)
    return out


OP6_SQL = """
    WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
    FROM f"""
