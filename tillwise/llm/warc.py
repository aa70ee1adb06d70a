"""WARC archives: writing, and sequential reading.

Every record is one gzip member. The reader goes through an archive from its
start: it feeds chunks to an incremental zlib decompressor, frames the header
block by its empty line and the record block by ``Content-Length``, starts anew
at each member's end, and checks block and payload digests. It holds one record
and one chunk at a time, whatever the size of the archive.

Of records with equal payloads the one with the largest identifier is written as
a response, the others as revisits of it; payloads below ``smallest`` bytes are
always responses.

Archives are written to the shared folder by any file system that pyarrow
opens. A task writes archives of about ``ARCHIVE_BYTES`` under names of its own
attempt, and reports them in a table. Only archives in that table are read, so
what a lost executor leaves behind is not.

Defined cases: a NULL payload counts as empty. A NULL URL is written as
``about:blank``. Records with a NULL identifier have none in the archive; they
come after all others when the response of a payload is chosen. If rows repeat
the largest identifier of a payload, one of them is the response and the others
revisit it. An empty table gives no archives and an empty result. Other columns
are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillwise.llm.runtime import scratch, ship, stored
from tillwise.plans.sales import totals_apart

ARCHIVE_BYTES = 256 << 20

_CHUNK = 1 << 18
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"
_ID = "urn:x-page:"


class WarcError(ValueError):
    """An archive that does not hold what it says."""


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        """The HTTP body of a response."""
        return self.block.partition(b"\r\n\r\n")[2]


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as one gzip member."""
    lines = ["WARC/1.1", *(f"{name}: {value}" for name, value in headers), f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 16 + zlib.MAX_WBITS)
    return packer.compress("\r\n".join(lines).encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def _safe(url: str | None) -> str:
    """A URL on one header line."""
    return re.sub(r"\s", lambda found: "%{:02X}".format(ord(found[0]) & 0xFF), url) if url else "about:blank"


def pack(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member with the response or revisit record of a page."""
    record_id = f"<{_ID}{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"
    common = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id),
        ("WARC-Date", _DATE),
        ("WARC-Target-URI", _safe(url)),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("X-Payload-Length", str(len(payload))),
    ]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    if revisit:
        common.append(("WARC-Profile", _PROFILE))
        if refers_to is not None:
            common.append(("WARC-Refers-To", f"<{_ID}{refers_to}>"))
    common += [("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", "application/http; msgtype=response")]
    return _member(common, block)


def read_records(stream) -> Iterator[Record]:
    """Records of an archive, in order. ``stream`` needs ``read(size)`` only."""
    held, chunk, begun = bytearray(), b"", False
    unpack = zlib.decompressobj(16 + zlib.MAX_WBITS)

    def more() -> bool:
        """Decompress a little of the present member; False at its end."""
        nonlocal chunk, begun
        if unpack.eof:
            return False
        if not chunk:
            chunk = stream.read(_CHUNK)
            if not chunk:
                return False
        begun = True
        held.extend(unpack.decompress(chunk, _CHUNK))
        chunk = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
        return True

    while True:
        while (edge := held.find(b"\r\n\r\n")) < 0 and more():
            pass
        if edge < 0:
            if begun:
                raise WarcError("the archive ends within a header")
            return
        version, *lines = held[:edge].decode().split("\r\n")
        if not version.startswith("WARC/1."):
            raise WarcError(f"not a WARC record: {version[:40]!r}")
        headers = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
        length = int(headers["content-length"])
        while len(held) < edge + 4 + length + 4 and more():
            pass
        block, tail = bytes(held[edge + 4 : edge + 4 + length]), bytes(held[edge + 4 + length :])
        while more():
            tail += bytes(held[edge + 4 + length + len(tail) :])
        if len(block) != length or tail != b"\r\n\r\n" or not unpack.eof:
            raise WarcError(f"record {headers.get('warc-record-id')} is not one member of {length} bytes")
        if headers.get("warc-block-digest") not in (None, f"sha1:{digest(block)}"):
            raise WarcError(f"record {headers.get('warc-record-id')}: block digest differs")
        record = Record(headers, block)
        if headers["warc-type"] == "response" and headers.get("warc-payload-digest") not in (None, f"sha1:{digest(record.payload)}"):
            raise WarcError(f"record {headers.get('warc-record-id')}: payload digest differs")
        yield record
        held, begun, unpack = bytearray(), False, zlib.decompressobj(16 + zlib.MAX_WBITS)


def _roles(pages: DataFrame, smallest: int) -> DataFrame:
    """``page_id, url, payload, revisit, refers_to`` per page.

    Which identifier answers for a payload is settled on narrow rows; the answers are
    shuffled apart, so that the many rows of one payload can be split in the join. The
    payloads move once, by payload and identifier, so that a payload with very many
    copies is spread.
    """
    keyed = pages.withColumns({"key": F.sha2("payload", 256), "size": F.octet_length("payload")})
    narrow = stored(keyed.groupBy("key", "page_id").agg(F.first("size").alias("size")), "payload-keys")
    answers = totals_apart(narrow, ["key"], F.max("page_id").alias("answer"))
    verdicts = narrow.join(answers, "key").select(
        "key",
        F.coalesce("page_id", F.lit(0)).alias("id"),
        F.col("page_id").isNull().alias("no_id"),
        "answer",
        (F.col("size") >= smallest).alias("shared"),
    )
    repeat = F.row_number().over(Window.partitionBy("key", "id", "no_id").orderBy("url"))
    known = keyed.withColumns({"id": F.coalesce("page_id", F.lit(0)), "no_id": F.col("page_id").isNull()})
    first = F.col("page_id").eqNullSafe(F.col("answer")) & (F.col("repeat") == 1)
    return (
        known.join(verdicts, ["key", "id", "no_id"])
        .withColumn("repeat", repeat)
        .select(
            "page_id",
            "url",
            "payload",
            (F.col("shared") & ~first).alias("revisit"),
            F.when(F.col("shared") & ~first, F.col("answer")).alias("refers_to"),
        )
    )


def _open(path: str):
    """File system and path within it; plain paths are local."""
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _uri(path: str) -> str:
    """A path of the shared folder as pyarrow spells it (Hadoop's names of the S3 scheme are one to it)."""
    return re.sub(r"^s3[an]://", "s3://", re.sub(r"^file:/(?=[^/])", "file:///", path))


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", smallest: int = 0
) -> DataFrame:
    """Write a record per row into ``folder``; ``path, records`` of each archive, as a stored table."""
    ship(pages.sparkSession)
    rows = _roles(
        pages.select(
            F.col(id_col).cast("long").alias("page_id"),
            F.col(url_col).alias("url"),
            F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"),
        ),
        smallest,
    )
    folder = _uri(folder)
    system, inside = _open(folder)
    system.create_dir(inside, recursive=True)

    def run(batches):
        target, base = _open(folder)
        path, out, records = "", None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path, records = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = target.open_output_stream(f"{base}/{path}", compression=None)
                out.write(pack(row["page_id"], row["url"], row["payload"], row["refers_to"], row["revisit"]))
                records += 1
                if out.tell() >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{path}"], "records": pa.array([records], pa.int64())})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{path}"], "records": pa.array([records], pa.int64())})

    return stored(rows.mapInArrow(run, "path string, records long"), "archives")


def _number(header: str | None) -> int | None:
    found = re.fullmatch(rf"<{_ID}(-?\d+)>", header or "")
    return int(found[1]) if found else None


def read_archives(archives: DataFrame) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload`` per record.

    ``archives``: ``path, records``; a different number of records in an archive is an error.
    ``payload`` is NULL in revisits.
    """
    spark: SparkSession = ship(archives.sparkSession)
    schema = (
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
        "refers_to long, payload binary"
    )
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def run(batches):
        for batch in batches:
            for path, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, inside = _open(path)
                rows, size, seen = [], 0, 0
                with system.open_input_stream(inside, compression=None) as stream:
                    for record in read_records(stream):
                        head, seen = record.headers, seen + 1
                        kind = head["warc-type"]
                        payload = record.payload if kind == "response" else None
                        length = len(payload) if payload is not None else int(head["x-payload-length"])
                        rows.append((
                            _number(head["warc-record-id"]), head["warc-target-uri"], length,
                            head["warc-payload-digest"].removeprefix("sha1:"), kind,
                            _number(head.get("warc-refers-to")), payload,
                        ))
                        size += len(record.block)
                        if size >= 4 << 20 or len(rows) >= 4096:
                            yield flush(rows)
                            rows, size = [], 0
                if rows:
                    yield flush(rows)
                if seen != records:
                    raise WarcError(f"{path} has {seen} records instead of {records}")

    count = archives.count()
    spread = archives.repartition(max(1, min(count, 4 * spark.sparkContext.defaultParallelism)))
    return spread.mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read these back, without the payloads."""
    archives = write_archives(pages, scratch(pages.sparkSession, "warc"))
    return read_archives(archives).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
