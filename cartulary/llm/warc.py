"""WARC archives: writing pages, reading records, and assembling transactions.

Every capture is a request, a response (or a revisit of an equal payload) and a
metadata record.  The request and the metadata name the response in
WARC-Concurrent-To; captures are put together by joining records on it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm import textbuf
from cartulary.llm.workspace import Workspace, lean

#: Payloads of fewer bytes are always responses.
LEAST_REVISIT = 0
#: Bytes after which a task begins a new archive.
ARCHIVE_BYTES = 64 << 20
#: Groups of equal payloads (a digest and an id) that are broadcast at most; beyond, they are joined by a shuffle.
BROADCAST_GROUPS = 500_000
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD = "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, date string, payload_digest string, payload_bytes long, page_id long, http_status int, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(kind: str, page_id: int | None, url: str | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(repr((kind, page_id, url, payload_digest)).encode('utf-8', 'surrogatepass')).digest()[:16])}>"


def _record(kind: str, own: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", f"WARC-Date: {DATE}", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def _line(value: str | None) -> str:
    """A header value: no line breaks."""
    return " ".join((value or "").split())


def capture(page_id: int | None, url: str | None, payload: bytes, response_page: int | None, response_url: str | None) -> bytes:
    """The three records of a page; response_page is set if another page's response has this payload."""
    own = digest(payload)
    revisit = response_page is not None
    main = record_id("capture", page_id, url, own)
    uri = ("WARC-Target-URI", _line(url))
    status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    http = [uri, ("WARC-Payload-Digest", f"sha1:{own}"), ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        first = _record("revisit", main, [*http, ("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id("capture", response_page, response_url, own))], status)
    else:
        first = _record("response", main, http, status + payload)
    request = _record("request", record_id("request", page_id, url, own), [uri, ("WARC-Concurrent-To", main), ("Content-Type", "application/http; msgtype=request")], f"GET {_line(url) or '/'} HTTP/1.1\r\n\r\n".encode())
    about = _record("metadata", record_id("metadata", page_id, url, own), [uri, ("WARC-Concurrent-To", main), ("Content-Type", "application/warc-fields")], f"page-id: {'' if page_id is None else page_id}\r\n".encode())
    return first + request + about


def write(pages: DataFrame, work: Workspace, least: int = LEAST_REVISIT) -> DataFrame:
    """Writes archives into the shared folder; returns the manifest of those that finished tasks wrote: path, n_bytes, n_pages.

    A task that is run again writes new files under new names; files of lost or
    repeated attempts are in no manifest, so they are never read.
    """
    folder = f"{work.root}/archives"
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("sha", F.sha1("payload"))
    large = F.octet_length("payload") >= least
    groups = own.where(large).groupBy("sha").agg(F.max(F.struct("page_id", "url")).alias("last"), F.count("*").alias("n")).where("n > 1").select("sha", "last")
    groups = work.table("groups", groups)
    if groups.count() <= BROADCAST_GROUPS:
        groups = F.broadcast(groups)
    last = F.col("last.page_id")
    # A revisit is another page than the one with the largest id; pages without an id are responses.
    marked = own.join(groups, "sha", "left").withColumn("to", F.when(large & (F.col("page_id") < last), F.col("last")))
    marked = marked.select("page_id", "url", "payload", F.col("to.page_id").alias("to_page"), F.col("to.url").alias("to_url"))

    @textbuf.frugal
    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs

        system, base = pyarrow.fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        path, out, size, n = "", None, 0, 0

        def finished() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], ["path", "n_bytes", "n_pages"])

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "to_page", "to_url"))):
                page_id, url, payload, to_page, to_url = (v.as_py() for v in row)
                if out is None:
                    path, size, n = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(path, compression=None)
                raw = capture(page_id, url, payload, to_page, to_url)
                out.write(raw)
                size, n = size + len(raw), n + 1
                if size >= ARCHIVE_BYTES:
                    yield finished()
                    out = None
        if out is not None:
            yield finished()

    return work.table("manifest", marked.mapInArrow(store, "path string, n_bytes long, n_pages long"))


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-cased names) and block of each record of a gzipped archive; one record is in memory at a time."""
    unpack, raw, rest = zlib.decompressobj(31), b"", b""
    while True:
        if not rest:
            rest = stream.read(1 << 20)
            if not rest:
                break
        raw += unpack.decompress(rest)
        rest = b""
        if unpack.eof:
            rest, unpack = unpack.unused_data, zlib.decompressobj(31)
            head, _, block = raw.partition(b"\r\n\r\n")
            fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
            length = int(fields["content-length"])
            if len(block) < length:
                raise ValueError(f"record {fields.get('warc-record-id')} is cut short")
            yield fields, block[:length]
            raw = b""
    if raw:
        raise ValueError("archive ends within a record")


def records(manifest: DataFrame, work: Workspace, payloads: bool = False) -> DataFrame:
    """A row per record of the archives.  Digests of responses are computed from the bytes read and must agree with the header."""
    root = work.root

    @textbuf.frugal
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs

        system, _ = pyarrow.fs.FileSystem.from_uri(root)
        schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("page_id", pa.int64()), ("http_status", pa.int32()), ("payload", pa.binary())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with system.open_input_stream(path, compression=None) as stream:
                    for f, block in parse(stream):
                        kind, page, length, status, payload = f["warc-type"], None, None, None, None
                        declared = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
                        if kind in ("response", "revisit"):
                            head, _, payload = block.partition(b"\r\n\r\n")
                            status = int(head.split(b" ", 2)[1])
                        if kind == "response":
                            length = len(payload)
                            if digest(payload) != declared:
                                raise ValueError(f"payload of {f['warc-record-id']} does not have its digest")
                        elif kind == "metadata":
                            text = block.decode().partition("page-id:")[2].strip()
                            page = int(text) if text else None
                        rows.append((f["warc-record-id"], kind, f.get("warc-concurrent-to"), f.get("warc-refers-to"), f.get("warc-target-uri"), f.get("warc-date"), declared, length, page, status, payload if payloads and kind == "response" else None))
                        held += len(block)
                        if len(rows) >= 4096 or held >= 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    # Archives are dealt out one by one: there are about as many as tasks that wrote them.
    return manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(read, _RECORD)


def transactions(found: DataFrame) -> DataFrame:
    """A nested row per capture: page_id and its request, response (or revisit) and metadata records.

    A request or metadata record that is missing is null; records that name no
    capture are left out.  Equal records, of repeated rows, are one.
    """
    small = [c for c in found.columns if c != "payload"]
    kept = found.dropDuplicates(["record_id"])
    main = kept.where(F.col("record_type").isin("response", "revisit"))
    side = lambda kind: kept.where(F.col("record_type") == kind).where("concurrent_to is not null").dropDuplicates(["concurrent_to"]).select(F.col("concurrent_to").alias("record_id"), F.struct(*[c for c in small if c != "concurrent_to"]).alias(kind))
    joined = main.join(side("request"), "record_id", "left").join(side("metadata"), "record_id", "left")
    return joined.select("record_id", F.col("metadata.page_id").alias("page_id"), "request", F.struct(*[F.col(c) for c in found.columns]).alias("response"), "metadata")


def captures(pages: DataFrame, *, least: int = LEAST_REVISIT, payloads: bool = False) -> DataFrame:
    """Writes pages into archives, reads them back and assembles transactions; see transactions().

    Null html is an empty payload, a null url an empty target.  Of pages with equal
    payloads of at least so many bytes the one with the largest page_id is the
    response, the others revisit it; a page without an id is a response.  Repeated
    rows (page_id, url and html) are one capture.  An empty table gives no rows.
    """
    work = Workspace(pages.sparkSession, "warc")
    found = records(write(lean(pages), work, least), work, payloads)
    # Archives are read once where only headers are kept, which are small.
    return transactions(found if payloads else work.table("records", found))


def digests(pages: DataFrame, *, least: int = LEAST_REVISIT) -> DataFrame:
    """A row per capture: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    work = Workspace(pages.sparkSession, "warc")
    nested = work.table("captures", captures(pages, least=least).select("record_id", "page_id", F.col("response.record_type").alias("record_type"), F.col("response.refers_to").alias("target"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.payload_bytes").alias("n")))
    # One response may be the target of a large share of all revisits: the join is on its id, and its large side can be split.
    targets = nested.where("record_type = 'response'").select(F.col("record_id").alias("target"), F.col("page_id").alias("refers_to"), F.col("n").alias("target_n"))
    return nested.join(targets, "target", "left").select("page_id", F.coalesce("n", "target_n").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
