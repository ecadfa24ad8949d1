"""WARC archives: a writer with one gzip member per record and a sequential reader.

Archives lie in a folder that all executors share and are opened by its file system, streaming both ways. A file's name
holds the task attempt, and the list of files comes from the attempts that ended well, so a task that runs again does
no harm. The reader inflates member by member, frames each record by Content-Length, and checks the payload digest."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, tidy, utf8, written

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"
_CHUNK = 1 << 16


def _open(uri: str, write: bool = False):
    from pyarrow.fs import FileSystem

    fs, path = FileSystem.from_uri(uri)
    if write:
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        return fs.open_output_stream(path, compression=None)
    return fs.open_input_stream(path, compression=None)


def _name(page_id: int) -> str:
    return f"<urn:page:{page_id}>"


def _line(value: str) -> str:
    """A header's value on one line: control characters percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes, refers_to) -> bytes:
    """One WARC record, not yet compressed; a revisit carries the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {_DATE}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: {_name(page_id)}")
    if url:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _writer(folder: str, level: int, most_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        out, path, size, files = None, "", 0, 0
        done: list[tuple[str, int]] = []
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if out is None:
                    path = f"{folder}/part-{task.partitionId():06d}-{files:04d}-{task.taskAttemptId()}.warc.gz"
                    out, size, files = _open(path, write=True), 0, files + 1
                gz = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = gz.compress(record(page_id, url, html, refers_to)) + gz.flush()
                out.write(member)
                size += len(member)
                if size >= most_bytes:
                    out.close()
                    out = None
                    done.append((path, size))
        if out is not None:
            out.close()
            done.append((path, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done], pa.int64())], names=["path", "bytes"])

    return run


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, level: int = 6, most_bytes: int = 1 << 30) -> DataFrame:
    """pages(page_id, url, html) -> (path, bytes): the archives in `folder`, written when this is called.

    Of pages with equal payloads of `least_bytes` or more the one with the largest page_id is a response and the others
    revisit it; rows that repeat that page_id are responses too. Null html is an empty payload, a null url is left out, a
    null page_id counts as least and is left out; an empty table gives no file."""
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), utf8("html").alias("html"))
    rows = rows.withColumn("payload_key", F.sha1("html"))
    # only one small row for each payload that occurs more than once takes part in the join
    shared = rows.where(F.length("html") >= least_bytes).groupBy("payload_key").agg(F.count("*").alias("n"), F.max("page_id").alias("last"))
    shared = shared.where("n > 1 and last is not null").select("payload_key", "last")
    # the join deals pages by payload; a payload that very many pages share is split by the adaptive skew join
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    rows = rows.join(shared, "payload_key", "left").select("page_id", "url", "html", refers.alias("refers_to"))
    return written(rows.mapInArrow(tidy(_writer(folder, level, most_bytes)), "path string, bytes long"), "archives")


def members(source) -> Iterator[Iterator[bytes]]:
    """The gzip members of a stream in turn, each as an iterator of inflated chunks; read one to its end before the next."""
    held = b""

    def inflate() -> Iterator[bytes]:
        nonlocal held
        z = zlib.decompressobj(31)
        while not z.eof:
            data = held or source.read(_CHUNK)
            if not data:
                raise ValueError("the archive ends within a gzip member")
            # what one call may inflate is bounded; the rest waits in unconsumed_tail
            out = z.decompress(data, _CHUNK)
            held = z.unused_data if z.eof else z.unconsumed_tail
            if out:
                yield out

    while held or (held := source.read(_CHUNK)):
        yield inflate()


def read_record(chunks: Iterator[bytes]) -> dict:
    """One record from its member: headers, payload (None for a revisit), and whether its digest is right."""
    buffer = bytearray()

    def until(mark: bytes) -> bytes:
        while (at := buffer.find(mark)) < 0:
            part = next(chunks, b"")
            if not part:
                raise ValueError("a record ends within its header")
            buffer.extend(part)
        head = bytes(buffer[:at])
        del buffer[: at + len(mark)]
        return head

    lines = until(b"\r\n\r\n").decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC record")
    head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    length = int(head["content-length"])
    while len(buffer) < length + 4:
        part = next(chunks, b"")
        if not part:
            raise ValueError("a record is shorter than its Content-Length")
        buffer.extend(part)
    if next(chunks, b"") or bytes(buffer[length:]) != b"\r\n\r\n":
        raise ValueError("a record is longer than its Content-Length")
    http, _, payload = bytes(buffer[:length]).partition(b"\r\n\r\n")
    size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    stated = head["warc-payload-digest"].partition(":")[2]
    revisit = head["warc-type"] == "revisit"
    own = lambda k: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", head.get(k, ""))) else None
    return {
        "page_id": own("warc-record-id"), "url": head.get("warc-target-uri"), "record_type": head["warc-type"],
        "refers_to": own("warc-refers-to"), "payload_bytes": size, "payload_digest": stated, "payload": None if revisit else payload,
        "valid": revisit or (digest(payload) == stated and len(payload) == size),
    }


_READ = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("valid", pa.bool_()),
])


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for batch in batches:
        for path in batch.column(0).to_pylist():
            with _open(path) as source:
                for member in members(source):
                    rows.append(read_record(member))
                    held += len(rows[-1]["payload"] or b"")
                    if len(rows) >= 1000 or held >= 1 << 23:
                        yield pa.RecordBatch.from_pylist(rows, schema=_READ)
                        rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=_READ)


def read_archives(archives: DataFrame) -> DataFrame:
    """(path) of archives -> a row for each record: page_id, url, record_type, refers_to, payload_bytes and payload_digest
    (both of the full payload, also for revisits), payload (null for revisits), valid (the digest agrees)."""
    n = max(1, archives.count())
    return archives.select("path").repartition(n).mapInArrow(
        tidy(_reader), "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, valid boolean"
    )
