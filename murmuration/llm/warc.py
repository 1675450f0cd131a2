"""WARC archives: writing one gzip member per record, and a sequential reader.

An archive is a run of gzip members, each one record: a header block, an empty line, a
content block of Content-Length bytes, and two line ends. The reader inflates one member
at a time in bounded steps, frames the block by its declared length and checks both digests.
Payloads that occur more than once are stored once; later records are revisits.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.llm import shared

STEP = 1 << 16
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
FIELDS = ("page_id", "url", "payload", "digest", "refers_to", "refers_url")
ARCHIVES = "archive string, content binary"
RECORDS = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "archive string, offset long, digest_ok boolean, payload binary"
)


def plan_records(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, url, payload, digest, refers_to (the smallest page_id of a payload of `least` bytes or more, for the others) and refers_url, its url.

    A null html is an empty payload. Rows with a null page_id are responses and nothing refers to
    them; a page_id that repeats with the same payload is one response as often as it occurs.
    Only digests that occur under several ids are joined back; adaptive execution splits a hot one.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    first = (
        rows.where(F.octet_length("payload") >= least)
        .where("page_id is not null")
        .groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("first"), F.max("page_id").alias("last"))
        .where("first.page_id < last").select("digest", "first")
    )
    later = F.col("first.page_id") < F.col("page_id")
    refers = [F.when(later, F.col("first.page_id")).alias("refers_to"), F.when(later, F.col("first.url")).alias("refers_url")]
    return rows.join(first, "digest", "left").select("page_id", "url", "payload", "digest", *refers)


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None, name: str) -> bytes:
    """One gzip member; `name` is that of this record and no other. Targets are urls with line ends removed."""
    head = HTTP % len(payload)
    block = head if refers_to is not None else head + payload
    target = lambda u: "".join(u.splitlines())
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target(url)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To-Target-URI", target(refers_url or "")), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page-Id", str(refers_to))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(text.encode("utf-8") + block + b"\r\n\r\n") + press.flush()


def write_archives(records: DataFrame, roll: int = 8 << 20) -> DataFrame:
    """(archive, content): every partition's records in archives that are closed at `roll` bytes.

    An archive is named by this call, its partition and its place there, so equal rows never share a name, and a task that runs
    again gives the same names. Repeated rows are records of their own. An empty table gives no archive.
    """
    call = uuid.uuid4().hex[:12]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        parts: list[bytes] = []
        size = number = 0
        name = lambda: f"pages-{call}-{task:06d}-{number:06d}.warc.gz"

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"archive": [name()], "content": [b"".join(parts)]}, schema=pa.schema([("archive", pa.string()), ("content", pa.binary())]))

        for batch in batches:
            for i in range(batch.num_rows):
                row = (batch.column(c)[i].as_py() for c in FIELDS)
                parts.append(record(*row, name=f"{name()}/{len(parts)}"))
                size += len(parts[-1])
                if size >= roll:
                    yield closed()
                    parts, size, number = [], 0, number + 1
        if parts:
            yield closed()

    return records.select(*FIELDS).mapInArrow(write, ARCHIVES)


def save_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Writes every archive as a .warc.gz file into a folder that driver and executors share, and returns (archive, bytes, path).

    The driver leaves a mark in the folder, and a task that doesn't see it fails instead of writing to a disk of its own. A file appears under its
    name only when it is whole, so a task that runs again replaces it. Null contents are empty files, archives of one name
    overwrite each other, extra columns are left out, an empty frame writes nothing. Read back by `saved_archives`.
    """
    mark = os.path.join(folder, f".shared-{uuid.uuid4().hex}")
    os.makedirs(folder, exist_ok=True)
    with open(mark, "wb"):
        pass

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not os.path.exists(mark):
            raise FileNotFoundError(f"{folder} isn't a folder that the driver and all executors share")
        for batch in batches:
            for name, content in zip(batch.column("archive").to_pylist(), batch.column("content")):
                path, part = os.path.join(folder, name), os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
                with open(part, "wb") as f:
                    f.write(content.as_buffer() if content.is_valid else b"")
                os.replace(part, path)
                yield pa.RecordBatch.from_pydict({"archive": [name], "bytes": [os.path.getsize(path)], "path": [path]})

    return archives.select("archive", "content").mapInArrow(save, "archive string, bytes long, path string")


def saved_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(archive, content) of the .warc.gz files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")


def members(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, fields, block) of every record, one gzip member after the other, inflated in steps.

    Raises ValueError for a member that is cut off, a bad header or a block that ends early.
    """
    at, view = 0, memoryview(content)
    while at < len(view):
        inflate, start, held, fields, need = zlib.decompressobj(31), at, bytearray(), None, 0
        while not inflate.eof:
            if at >= len(view):
                raise ValueError(f"the member at {start} is cut off")
            step = view[at : at + STEP]
            held += inflate.decompress(step)
            at += len(step) - len(inflate.unused_data)
            if fields is None and (end := held.find(b"\r\n\r\n")) >= 0:
                first, *lines = bytes(held[:end]).decode("utf-8").split("\r\n")
                if not first.startswith("WARC/"):
                    raise ValueError(f"no record at {start}")
                fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
                need = int(fields["content-length"])
                del held[: end + 4]
        if fields is None or len(held) < need + 4 or held[need:] != b"\r\n\r\n":
            raise ValueError(f"the record at {start} has no block of {need} bytes")
        yield start, fields, bytes(held[:need])


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of archives given as (archive, content), for instance from `saved_archives`.

    A response's payload is what follows the HTTP header. A revisit has no payload; its length is
    the one that its HTTP header declares. `digest_ok`: the digests agree with what was read.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("digest_ok", pa.bool_()), ("payload", pa.binary())])
        for batch in batches:
            for name, content in zip(batch.column("archive").to_pylist(), batch.column("content")):
                rows, size = [], 0
                for offset, f, block in members(content.as_py() or b""):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    declared = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    kind, digest = f["warc-type"], f["warc-payload-digest"].partition(":")[2]
                    good = f["warc-block-digest"] == f"sha256:{hashlib.sha256(block).hexdigest()}"
                    if kind == "response":
                        digest_read = hashlib.sha256(payload).hexdigest()
                        good, digest, declared = good and digest_read == digest, digest_read, len(payload)
                    number = lambda k: int(f[k]) if k in f else None  # noqa: E731, B023
                    rows.append((number("x-page-id"), f["warc-target-uri"], declared, digest, kind, number("x-refers-to-page-id"), name, offset, good, payload if kind == "response" else None))
                    size += len(payload)
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return archives.select("archive", "content").mapInArrow(read, RECORDS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = shared.materialize(write_archives(plan_records(shared.table(spark, sf_dir, "pages"))))
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")
