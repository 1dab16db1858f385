"""WARC archives: a writer with revisit records and a sequential reader.

Each record is a gzip member of its own. The reader takes an archive as a stream
of byte blocks, inflates one member after the other, frames each record by its
header and Content-Length, and checks the digests that the header states.

Of pages with equal payloads (equal SHA-1 and length) the one with the largest id
is written as a response and the others as revisits of it; payloads under
``least_bytes`` are all responses. Pages that share payload and largest id, and
pages of a group without any id, are all responses. A null payload is written as
an empty one. Control characters in addresses are percent-encoded; without an
address the record has no target.

Archives are written in the shared folder, one a task, first under a temporary
name, so a task that runs again replaces its own archive. The folder is resolved
on the driver as Spark would, so one without a scheme is in the default file
system; tasks open it through Arrow's file systems (local, HDFS, S3, Azure,
Google). The list of archives is written as a table before anything is read.

Very long payloads are one record like any other; repeated rows are a record
each. Columns other than those named are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.shared import fresh_path, stored
from chronoloom.storage import qualified

LEAST_BYTES = 0
BLOCK, STEP = 1 << 20, 1 << 12
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

_control = re.compile(r"[\x00-\x20\x7f]")


class WarcError(ValueError):
    """An archive that isn't framed as its headers say, or whose digest differs."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_id(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def record(page_id, url: str | None, payload: bytes, refers_to, refers_url: str | None) -> bytes:
    """One gzip member that holds a response record, or a revisit record if ``refers_to`` is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    safe = lambda u: _control.sub(lambda m: f"%{ord(m[0]):02X}", u)
    header = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {safe(url)}"] if url else []),
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        *([f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"] if refers_to is not None else []),
        *([f"WARC-Refers-To-Target-URI: {safe(refers_url)}"] if refers_to is not None and refers_url else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(header).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


def members(blocks: Callable[[], bytes]) -> Iterator[bytes]:
    """Inflated gzip members of a stream; ``blocks`` gives its next bytes, or none at its end. Blocks are fed in small steps, so that what follows a small member is not copied for it."""
    block, at = memoryview(blocks()), 0
    while len(block):
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if at == len(block):
                block, at = memoryview(blocks()), 0
                if not len(block):
                    raise WarcError("the archive ends inside a gzip member")
            step = block[at : at + STEP]
            parts.append(inflate.decompress(step))
            at += len(step) - len(inflate.unused_data)
        yield b"".join(parts)
        if at == len(block):
            block, at = memoryview(blocks()), 0


def parse(member: bytes) -> dict:
    """Record of a member: header fields in lower case, page_id, record_type, refers_to, payload bytes and digest, payload (none for a revisit)."""
    head, found, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise WarcError("a gzip member that does not begin with a WARC header")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = int(fields["content-length"])
    block = rest[:length]
    if len(block) != length or rest[length:] != b"\r\n\r\n":
        raise WarcError(f"{fields.get('warc-record-id')}: Content-Length does not frame the record")
    if (stated := fields.get("warc-block-digest")) and stated != f"sha1:{base32_sha1(block)}":
        raise WarcError(f"{fields.get('warc-record-id')}: the block's digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != size or base32_sha1(payload) != stated):
        raise WarcError(f"{fields.get('warc-record-id')}: the payload's digest or length differs")
    return {"page_id": _page_id(fields.get("warc-record-id")), "record_type": kind, "refers_to": _page_id(fields.get("warc-refers-to")), "payload_bytes": size, "payload_digest": stated, "payload": payload if kind == "response" else None, "fields": fields}


#: Schemes of Hadoop's file systems whose names differ here.
SCHEMES = {"s3a": "s3", "s3n": "s3", "viewfs": "hdfs", "gcs": "gs"}


def located(folder: str) -> str:
    """URI of a folder for the tasks' own file access; a folder without a scheme is refused, as it would be each machine's own."""
    scheme, found, rest = folder.partition(":")
    if not found or "/" in scheme:
        raise ValueError(f"{folder}: give the archives' folder with its scheme")
    return f"file:///{rest.lstrip('/')}" if scheme == "file" else f"{SCHEMES.get(scheme, scheme)}:{rest}"


def _open(folder: str):
    """File system and path of a folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(located(folder))


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _open(folder)
        name = f"{path}/{TaskContext.get().partitionId():06d}.warc.gz"
        draft, n = f"{name}.{uuid.uuid4().hex}", 0
        files.create_dir(path)
        with files.open_output_stream(draft, compression=None) as to:
            for batch in batches:
                for r in batch.to_pylist():
                    to.write(record(r["page_id"], r["url"], (r["html"] or "").encode(), r["refers_to"], r["refers_url"]))
                    n += 1
        files.move(draft, name)
        yield pa.RecordBatch.from_pydict({"archive": [name.rpartition("/")[2]], "n_records": [n]}, pa.schema([("archive", pa.string()), ("n_records", pa.int64())]))

    return write


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write archives under ``folder``; returns their names and numbers of records."""
    folder = qualified(pages.sparkSession, folder)
    own = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    full = F.coalesce("html", F.lit("")).cast("binary")
    keyed = own.select("*", F.sha1(full).alias("digest"), F.octet_length(full).alias("bytes"))
    # pre-aggregated before the shuffle; only payloads that occur again are joined to the pages
    groups = keyed.where(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(F.max("page_id").alias("first"), F.max_by("url", "page_id").alias("first_url"), F.count("*").alias("n")).where("n > 1").drop("n")
    # written, so that adaptive execution may split the join where a payload has very many pages
    groups = stored(groups, "warc-payloads")
    joined = keyed.join(groups, ["digest", "bytes"], "left")
    other = ~F.col("first").eqNullSafe(F.col("page_id")) & F.col("first").isNotNull()
    rows = joined.select("page_id", "url", "html", F.when(other, F.col("first")).alias("refers_to"), F.when(other, F.col("first_url")).alias("refers_url"))
    return stored(rows.mapInArrow(_writer(folder), "archive string, n_records bigint"), "warc-archives")


def read(archives: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """Records of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to and, if asked for, payload."""
    fields = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), *([("payload", pa.binary())] if with_payload else [])]
    schema, folder = pa.schema(fields), qualified(archives.sparkSession, folder)

    def read_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _open(folder)
        for batch in batches:
            for name, expected in zip(batch["archive"].to_pylist(), batch["n_records"].to_pylist(), strict=True):
                held, size, n = [], 0, 0
                with files.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for member in members(lambda: stream.read(BLOCK)):
                        r = parse(member)
                        held.append({k: r[k] for k, _ in fields})
                        n += 1
                        size += 200 + len(member) * with_payload
                        if size > 8 * BLOCK:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                if n != expected:
                    raise WarcError(f"{name}: {n} records instead of {expected}")
                yield pa.RecordBatch.from_pylist(held, schema)

    ddl = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * with_payload
    # a task for each archive: the list is small in bytes, so a number is given that adaptive execution keeps
    return archives.repartition(max(1, archives.count())).mapInArrow(read_all, ddl)


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write all pages and read the archives back: one row per page."""
    folder = fresh_path(pages.sparkSession, "warc")
    return read(write(pages, folder, key, url, html), folder, with_payload=False)
