"""WARC: archives with an index first, and reads that coalesce sorted byte ranges.

Writing returns one index row per record (file, offset, length, URL, digest). Reading starts
from index rows: they are sorted by file and offset, neighbouring ranges become one read, and
the records are cut out of what was read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import file_system, folder, partitions_for, select, stored

#: A file is closed when it has this many bytes, so that what one file holds is bounded.
FILE_BYTES = 64_000_000
#: Records at most so far apart are read together, up to so many bytes in one read.
GAP_BYTES = 64_000
READ_BYTES = 8_000_000
#: Every record has this date, so that archives of the same pages are equal.
DATE = "2024-01-01T00:00:00Z"

INDEX = pa.schema([
    ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
    ("url", pa.string()), ("payload_digest", pa.string()), ("record_type", pa.string()),
])
RECORD = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
    ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
])
_KIND = {"int64": "long", "string": "string", "binary": "binary"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"`{f.name}` {_KIND[str(f.type)]}" for f in schema)


def resolved(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, sha1, n_bytes and keeper: the page whose record holds the payload (null: its own)."""
    narrow = select(pages, "page_id", "url", "html")
    narrow = narrow.select(narrow.page_id.cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    narrow = narrow.withColumns({"sha1": F.unhex(F.sha1("html")), "n_bytes": F.octet_length("html").cast("long")})
    # Counted per payload before the shuffle, so that a payload of a third of all pages is a few rows here.
    shared = (
        narrow.select("page_id", "sha1", "n_bytes")
        .filter(F.col("n_bytes") >= min_bytes)
        .groupBy("sha1")
        .agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    return narrow.join(shared, "sha1", "left")


def _header(fields: list[tuple[str, object]]) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, keeper: int | None) -> tuple[str, bytes]:
    """Type and bytes of one record: a response with the payload, or a revisit of ``keeper`` without it."""
    kind = "response" if keeper is None or keeper == page_id else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    fields: list[tuple[str, object]] = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else re.sub(r"[\r\n]+", " ", url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Payload-Length", len(payload)),
    ]
    if kind == "revisit":
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", f"<urn:page:{keeper}>"),
        ]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block))]
    return kind, _header(fields) + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES, level: int = 3) -> DataFrame:
    """Write a record for every row of ``pages`` (page_id, url, html) to gzipped WARC files under ``path``.

    Of rows with equal payloads of ``min_bytes`` or more, those with the largest page_id become
    response records and the others revisit them; smaller payloads are all responses. A null html is an
    empty payload, a null url leaves the target out, a null page_id counts as smaller than any other.
    Repeated rows get a record each. An empty table writes no file.

    Returns the index, stored in the shared folder: page_id, file, offset, length, url, payload_digest,
    record_type. A task that runs again writes files of another name; only those of the attempt that
    succeeded are in the index.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(path)
        fs.create_dir(root, recursive=True)
        rows: list[tuple] = []
        out, name, at = None, "", 0
        for batch in batches:
            for page_id, url, html, sha1, keeper in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if out is None:
                    name, at = f"{root}/{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(name, compression=None)
                digest = base64.b32encode(sha1).decode()
                kind, raw = record(page_id, url, html.encode(), digest, keeper)
                pack = zlib.compressobj(level, wbits=31)
                member = pack.compress(raw) + pack.flush()
                out.write(member)
                rows.append((page_id, name.rsplit("/", 1)[1], at, len(member), url, digest, kind))
                at += len(member)
                if at >= file_bytes:
                    out.close()
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), INDEX)], schema=INDEX)
                    out, rows = None, []
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), INDEX)], schema=INDEX)

    ready = resolved(pages, min_bytes).select("page_id", "url", "html", "sha1", "keeper")
    return stored(ready.mapInArrow(run, _ddl(INDEX)), "warc-index")


def parse(member: bytes) -> dict:
    """Fields of one gzipped record."""
    raw = zlib.decompress(member, wbits=31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else None
    number = lambda text: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", text or "")) else None
    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"],
        "refers_to": number(fields.get("WARC-Refers-To")), "payload": payload,
        "payload_bytes": int(fields["WARC-Payload-Length"]), "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
    }


def read_records(index: DataFrame, path: str, gap: int = GAP_BYTES, most: int = READ_BYTES) -> DataFrame:
    """Read the records that ``index`` rows (file, offset, length) point at.

    Ranges of one file at most ``gap`` bytes apart are read at once, up to ``most`` bytes (a longer record
    is one read). Responses are checked: a payload that does not have the length and SHA-1 of its header
    raises. Returns page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload (null for
    revisits), file, offset, length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(path)
        opened, handle = None, None

        def fetch(file: str, low: int, ranges: list[tuple[int, int]]) -> pa.RecordBatch:
            nonlocal opened, handle
            if opened != file:
                opened, handle = file, fs.open_input_file(f"{root}/{file}")
            end = max(o + n for o, n in ranges)
            data = handle.read_at(end - low, low)
            rows = []
            for offset, length in ranges:
                got = parse(data[offset - low : offset - low + length])
                if got["record_type"] == "response":
                    sha1 = base64.b32encode(hashlib.sha1(got["payload"]).digest()).decode()
                    if sha1 != got["payload_digest"] or len(got["payload"]) != got["payload_bytes"]:
                        raise ValueError(f"{file} at {offset}: the payload differs from its header")
                rows.append(got | {"file": file, "offset": offset, "length": length})
            return pa.RecordBatch.from_pylist(rows, schema=RECORD)

        file, low, high, ranges = "", 0, 0, []
        for batch in batches:
            for f, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if ranges and (f != file or offset > high + gap or offset + length - low > most):
                    yield fetch(file, low, ranges)
                    ranges = []
                if not ranges:
                    file, low, high = f, offset, 0
                ranges.append((offset, length))
                high = max(high, offset + length)
        if ranges:
            yield fetch(file, low, ranges)

    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = partitions_for(total, 4 * READ_BYTES, index.sparkSession.sparkContext.defaultParallelism)
    ranges = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset")
    return ranges.sortWithinPartitions("file", "offset").mapInArrow(run, _ddl(RECORD))


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to new archives in the shared folder and read all records back."""
    path = folder(pages.sparkSession, "warc")
    return read_records(write_archives(pages, path, min_bytes), path)
