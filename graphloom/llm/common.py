"""Shared helpers: columnar word tables, hashes and tables in the shared folder.

Texts reach Python as Arrow string columns. ``blocks`` cuts a column into runs of whole
documents of a few megabytes and lays each out as one byte array, so that words, lines and
hashes are found by array operations instead of one Python object per word.
"""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.session import shared_dir

#: Whole documents are put together until a block has this many bytes (a longer document is a block of its own).
BLOCK_BYTES = 1_000_000
#: Rows of a column that are copied together.
_SLICE = 1_000
#: The blank bytes of ``[\x20\x09-\x0D]``; no UTF-8 sequence of a larger character contains them.
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: A fixed random number for every byte value.
_BYTES = np.random.default_rng(20240229).integers(1, _MASK, 256, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finisher of MurmurHash3)."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def _powers(base: int, n: int, known: dict[int, np.ndarray]) -> np.ndarray:
    have = known.get(base)
    if have is None or len(have) < n:
        row = np.full(max(n, 1 << 16), base, np.uint64)
        row[0] = 1
        with np.errstate(over="ignore"):
            known[base] = have = np.cumprod(row, dtype=np.uint64)
    return have[:n]


_KNOWN: dict[int, np.ndarray] = {}


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = BLOCK_BYTES) -> np.ndarray:
    """64-bit hash of each byte span; spans are in order and do not overlap."""
    out = np.zeros(len(starts), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            low = int(starts[at])
            to = max(at + 1, int(np.searchsorted(ends, low + block, "right")))
            high = int(ends[to - 1])
            n = high - low
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTES[data[low:high]] * _powers(_BASE, n, _KNOWN), out=total[1:])
            s, e = starts[at:to] - low, ends[at:to] - low
            h = (total[e] - total[s]) * _powers(_INVERSE, n + 1, _KNOWN)[s]
            out[at:to] = mix(h + (e - s).astype(np.uint64))
            at = to
    return out


class Block:
    """Some whole documents: their bytes, and where each starts and ends in them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first
        self.n = len(offsets) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of every word ``[^\\x20\\x09-\\x0D]+``."""
        blank = BLANK[self.data]
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.offsets] = True
        solid = ~blank
        before = np.concatenate(([True], blank[:-1])) if len(blank) else blank
        after = np.concatenate((blank[1:], [True])) if len(blank) else blank
        starts = np.flatnonzero(solid & (before | edge[:-1]))
        ends = np.flatnonzero(solid & (after | edge[1:])) + 1
        return starts, ends, np.searchsorted(self.offsets, starts, "right") - 1

    def per_document(self, marks: np.ndarray) -> np.ndarray:
        """Sum of a number per byte over each document."""
        total = np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def text(self, i: int) -> str:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes().decode("utf-8", "replace")


def blocks(column: pa.Array, lower: bool = False, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a string column into blocks; null texts count as empty."""
    for low in range(0, len(column), _SLICE):
        rows = column.slice(low, _SLICE)
        if isinstance(rows, pa.ChunkedArray):
            rows = rows.combine_chunks()
        rows = pa.concat_arrays([rows.cast(pa.large_string()).fill_null("")])  # starts at offset 0
        n = len(rows)
        offsets = np.frombuffer(rows.buffers()[1], np.int64, n + 1 + rows.offset)[rows.offset :]
        buffer = rows.buffers()[2]
        data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
        at = 0
        while at < n:
            to = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1))
            part = data[offsets[at] : offsets[to]]
            yield Block(LOWER[part] if lower else part, offsets[at : to + 1] - offsets[at], low + at)
            at = to
    trim()


def trim() -> None:
    """Give memory that is free back to the system: workers are kept between stages, and executors are small."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


#: malloc_trim, where the C library has it.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def windows(hashes: np.ndarray, docs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``width`` words inside one document, and the index of its first word."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(docs[:n] == docs[width - 1 :])
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            out *= np.uint64(_BASE)
            out += hashes[j : j + n]
    return mix(out)[first], first


def _position(df: DataFrame, column: str) -> int:
    """Place of a column: the one of that very name, or else the first that differs in case only."""
    if column in df.columns:
        return df.columns.index(column)
    return [c.lower() for c in df.columns].index(column.lower())


def select(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns. Found by place, so that others may have names that clash with these or with each other."""
    place = {c: _position(df, c) for c in columns}
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).select(*[F.col(f"c{p}").alias(c) for c, p in place.items()])


def placed(df: DataFrame, *columns: str) -> tuple[DataFrame, list[str]]:
    """All columns renamed to their places (c0, c1, …), and the places of the named ones."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), [f"c{_position(df, c)}" for c in columns]


def ddl_of(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def judged(documents: DataFrame, judge: Callable[[pa.Array], Iterator[tuple[int, pa.Array]]], kind: str) -> tuple[DataFrame, list[str]]:
    """All rows and columns (renamed to their places) with a column ``verdict`` that ``judge`` gives from the text.

    ``judge`` yields, run by run, how many rows it judged and their verdicts. Returns the places of doc_id and text as well.
    """
    named, at = placed(documents, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = 0
            for n, verdict in judge(batch.column(batch.num_columns - 1)):
                part = batch.slice(low, n)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], verdict], names=[*part.schema.names[:-1], "verdict"])
                low += n

    ready = named.withColumn("judged", F.col(at[1]))
    return ready.mapInArrow(run, f"{ddl_of(named)}, verdict {kind}"), at


def marked(documents: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows of ``marks`` (doc_id, mark) that mark a document, once each; no text is read."""
    known = select(documents, "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"))
    named = marks.select(F.col("doc_id").cast("long").alias("doc_id"), "mark").filter("mark is not null").distinct()
    return named.join(known, "doc_id", "left_semi")


def sampled(documents: DataFrame, marks: DataFrame, most: dict, most_bytes: int = 32_000_000) -> pa.Table:
    """mark and text of at most ``most[mark]`` documents of each mark, taken by the hash of their ids.

    The ids of the sample are as many as ``most`` says at any size of the tables, so they are broadcast and
    no text is shuffled; the driver gets the texts of the sample. Texts above an eighth of ``most_bytes`` are
    no part of it, and it ends, in the order of the hash, before the texts together have more than ``most_bytes``.
    """
    taken = None
    for mark, n in most.items():
        ids = marks.filter(F.col("mark") == mark).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        taken = ids if taken is None else taken.union(ids)
    if taken is None:
        return pa.table({"mark": pa.array([], pa.string()), "text": pa.array([], pa.string())})
    texts = select(documents, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    found = texts.filter(F.octet_length("text") <= most_bytes // 8).join(F.broadcast(taken), "doc_id")
    # A doc_id may be in many rows; the sample stays as large as it was to be.
    first = found.withColumn("place", F.xxhash64("doc_id", "text")).orderBy("place", "doc_id").limit(sum(most.values()))
    so_far = Window.orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return first.withColumn("held", F.sum(F.octet_length("text")).over(so_far)).filter(F.col("held") <= most_bytes).select("mark", "text").toArrow()


def folder(spark: SparkSession, name: str) -> str:
    """A new folder name in the folder that all executors share."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: its lineage ends there.

    Written by two tasks for each core, which take the partitions in turn: a table of many small
    partitions becomes few files.
    """
    spark = df.sparkSession
    path = folder(spark, name)
    df.coalesce(2 * spark.sparkContext.defaultParallelism).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(uri: str):
    """File system and path of a URI, for files that tasks write and read themselves."""
    from pyarrow import fs

    uri = re.sub(r"^file:/+", "file:///", uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    return fs.FileSystem.from_uri(uri)


#: Rows that a task hands to Python at once: texts are long, and a batch is held on both sides.
ARROW_ROWS = 1_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table, in a session whose Arrow batches suit long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions_for(rows: int, each: int, least: int = 1, most: int = 100_000) -> int:
    return max(least, min(most, -(-rows // max(each, 1))))
