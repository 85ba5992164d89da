"""WARC archives: writing with revisit records, and a sequential reader that checks what it reads."""

import base64
import hashlib
import io
import os
import uuid
import zlib
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import Scratch

#: Fixed by the format.
VERSION = b"WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes read from an archive at a time, and bytes of payload after which a new archive begins.
READ, ROLL = 1 << 16, 64 << 20


def sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, ordinal: str, url: str | None, payload: bytes, original=None, revisit: bool = False) -> bytes:
    """One record in a gzip member of its own. A revisit has the payload's digest and length but not its bytes."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (b"" if revisit else payload)
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}:{ordinal}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": "".join((url or "urn:none").split()),
        "WARC-Payload-Digest": f"sha1:{sha1(payload)}",
        "WARC-Block-Digest": f"sha1:{sha1(block)}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if revisit:
        fields |= {"WARC-Profile": REVISIT, "WARC-Refers-To": f"<urn:page:{original}>"}
    head = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields.items()) + b"\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def members(file) -> "iter":
    """The content of each gzip member of a file, in turn; the file is read a part at a time."""
    data = file.read(READ)
    while data:
        unpack, parts = zlib.decompressobj(31), []
        while True:
            parts.append(unpack.decompress(data))
            if unpack.eof:
                data = unpack.unused_data or file.read(READ)
                break
            data = file.read(READ)
            if not data:
                raise ValueError("the archive ends within a gzip member")
        yield b"".join(parts)


def read(file) -> "iter":
    """(fields, block) of each record, framed by its content length; digests that don't match raise ValueError."""
    for content in members(file):
        stream = io.BytesIO(content)
        if stream.readline().strip() != VERSION:
            raise ValueError("a record begins without its version")
        fields: dict[str, str] = {}
        while line := stream.readline().rstrip(b"\r\n"):
            name, _, value = line.partition(b":")
            fields[name.decode().lower()] = value.strip().decode()
        block = stream.read(int(fields["content-length"]))
        if len(block) != int(fields["content-length"]) or stream.read() != b"\r\n\r\n":
            raise ValueError(f"{fields.get('warc-record-id')}: its length is not its content-length")
        if fields.get("warc-block-digest", f"sha1:{sha1(block)}") != f"sha1:{sha1(block)}":
            raise ValueError(f"{fields.get('warc-record-id')}: its block digest differs")
        if fields["warc-type"] == "response" and fields["warc-payload-digest"] != f"sha1:{sha1(block.partition(b'\r\n\r\n')[2])}":
            raise ValueError(f"{fields.get('warc-record-id')}: its payload digest differs")
        yield fields, block


def opened(uri: str, mode: str):
    """A file of any file system that Arrow or this machine opens; the folder must be shared by all executors."""
    at = urlparse(uri)
    if at.scheme in ("", "file"):
        if mode == "wb":
            os.makedirs(os.path.dirname(at.path), exist_ok=True)
        return open(at.path, mode)
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    if mode == "wb":
        system.create_dir(os.path.dirname(path), recursive=True)
    return system.open_output_stream(path) if mode == "wb" else system.open_input_stream(path)


def write(pages: DataFrame, folder: str) -> DataFrame:
    """(path, records): archives of pages(page_id, url, html) in a shared folder.

    Of rows of equal payloads, those of the largest page_id are responses and the others revisits. Each row goes to the task of its payload by a
    join that Spark splits where a payload is very common. An attempt writes archives of its own name; only those
    of attempts that end are listed, so a task that is run again leaves no record twice.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.unhex(F.sha1(payload)).alias("digest"))
    lead = rows.groupBy("digest").agg(F.max("page_id").alias("original"))
    marked = rows.join(lead, "digest").select("page_id", "url", "payload", "original")

    def run(batches):
        name, file, records, size, k = uuid.uuid4().hex, None, 0, 0, 0
        done = []
        for batch in batches:
            for i in range(len(batch)):
                page_id, url, payload, original = (c[i].as_py() for c in batch.columns)
                if file is None:
                    path = f"{folder}/{name}-{k:05d}.warc.gz"
                    file, records, size, k = opened(path, "wb"), 0, 0, k + 1
                file.write(record(page_id, f"{name}-{k}-{records}", url, payload, original, original is not None and page_id != original))
                records, size = records + 1, size + len(payload)
                if size >= ROLL:
                    file.close()
                    done.append((path, records))
                    file = None
        if file is not None:
            file.close()
            done.append((path, records))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["path", "records"])

    return marked.mapInArrow(run, "path string, records long")


def listed(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record of the archives named in `path`."""

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with opened(path, "rb") as file:
                    for fields, block in read(file):
                        page = fields["warc-record-id"].split(":")[2]
                        refers = fields.get("warc-refers-to", "").rpartition(":")[2].rstrip(">")
                        http, _, _ = block.partition(b"\r\n\r\n")
                        length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        rows.append((int(page) if page else None, length, fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"], int(refers) if refers else None))
                columns = list(zip(*rows)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return archives.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write a record for each row of pages, then read the archives back: one row per record; see write() and listed().

    Defined cases: a null html is an empty payload, and empty payloads are equal to each other; a null url is urn:none; rows of a payload's largest
    page_id, if repeated, are all responses; a null page_id is a revisit of the largest of its payload, or a response if none has an id; an empty
    table gives no archives and no rows; other columns are not looked at. Archives are in the shared folder until the driver ends.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark)
    archives = scratch.save(write(pages, f"{scratch.root}/archives"), "listed")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return listed(archives.select("path").repartition(parts))
