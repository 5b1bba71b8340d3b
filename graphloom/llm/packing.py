"""Best-fit packing: best-two-fit over the histogram of lengths.

A bin depends only on which lengths are left, so equal bins are made many at a time from the
counts per length, of which there are no more than tokens in a sequence. Where each piece goes
follows from its rank among the pieces of its length.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import select, stored
from graphloom.llm.tokens import Encoder

CAPACITY = 2048
_CHUNK = 1_024

PIECES = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
    ("ids_crc32", pa.int64()), ("part", pa.int64()), ("place", pa.int64()),
])
PACKED = pa.schema(list(PIECES)[:5] + [pa.field("sequence_id", pa.int64()), pa.field("offset", pa.int64())])


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Fill bins of ``capacity`` from ``counts[length]`` items: (bins, [(length, items of it in each bin)]).

    A bin takes the longest item left, then the longest that fits its gap, and so on. If a gap stays,
    its shortest item gives way to the two items left whose sum fits the widened gap most tightly and
    is more than it was; that repeats while it helps.
    """
    left = counts.astype(np.int64).copy()
    left[0] = 0
    out = []
    top = len(left) - 1
    while True:
        while top > 0 and not left[top]:
            top -= 1
        if not top:
            return out
        used: dict[int, int] = {}
        gap = _fill(left, used, capacity, top)
        while gap:
            short = min(used)
            pair = _pair(left, used, short, gap + short)
            if pair is None:
                break
            used[short] -= 1
            if not used[short]:
                del used[short]
            for length in pair:
                used[length] = used.get(length, 0) + 1
            gap = gap + short - sum(pair)
        bins = min(int(left[length]) // k for length, k in used.items())
        for length, k in used.items():
            left[length] -= bins * k
        out.append((bins, sorted(used.items(), reverse=True)))


def _fill(left: np.ndarray, used: dict[int, int], gap: int, top: int) -> int:
    """Take the longest items that fit, as many of each as fit."""
    lengths = np.flatnonzero(left[: min(gap, top) + 1])
    while gap and len(lengths):
        at = int(np.searchsorted(lengths, gap, "right")) - 1
        if at < 0:
            break
        length = int(lengths[at])
        k = min(int(left[length]), gap // length)
        used[length] = k
        gap -= k * length
        lengths = lengths[:at]
    return gap


def _pair(left: np.ndarray, used: dict[int, int], short: int, room: int) -> tuple[int, int] | None:
    """Two lengths left with the largest sum in (short, room]."""
    spare = left[: room + 1].copy()
    for length, k in used.items():
        if length <= room:
            spare[length] -= k
    lengths = np.flatnonzero(spare > 0)
    lengths = lengths[lengths < room]
    if not len(lengths):
        return None
    # For each length the longest partner that still fits; a partner of its own length needs two items.
    at = np.searchsorted(lengths, room - lengths, "right") - 1
    ok = at >= 0
    first, second = lengths[ok], lengths[at[ok]]
    alone = (first == second) & (spare[first] < 2)
    shorter = at[ok] - 1
    second = np.where(alone, np.where(shorter >= 0, lengths[np.maximum(shorter, 0)], -room), second)
    if not len(first):
        return None
    best = int(np.argmax(first + second))
    if first[best] + second[best] <= short:
        return None
    return int(first[best]), int(second[best])


class Slots:
    """Where the pieces of a length go: runs of ranks, the first sequence of each run and the offset there."""

    def __init__(self, patterns: list[tuple[int, list[tuple[int, int]]]]):
        taken: dict[int, int] = {}
        rows, sequence = [], 0
        for bins, items in patterns:
            offset = 0
            for length, k in items:
                low = taken.get(length, 0)
                rows.append((length, low, sequence, k, offset))
                taken[length] = low + bins * k
                offset += length * k
            sequence += bins
        self.sequences = sequence
        rows.sort()
        self.length, self.low, self.sequence, self.each, self.offset = np.array(rows, np.int64).reshape(-1, 5).T

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.searchsorted(self.length, length, "left")
        last = np.searchsorted(self.length, length, "right")
        at = np.zeros(len(length), np.int64)
        order = np.lexsort((rank, length))
        # Ranks of one length ascend, so its run is found by one search per length.
        for lo, hi, rows in _runs(length[order], order):
            f, e = first[order[lo]], last[order[lo]]
            at[rows] = f + np.searchsorted(self.low[f:e], rank[rows], "right") - 1
        inside = rank - self.low[at]
        return self.sequence[at] + inside // self.each[at], self.offset[at] + (inside % self.each[at]) * length


def _runs(values: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    if len(values):
        edges = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1], [True])))
        for lo, hi in zip(edges[:-1], edges[1:]):
            yield lo, hi, order[lo:hi]


def pieces(documents: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document, with part and place: the rank among pieces of equal length in a part of the table.

    A part is what one call reads, named by a random number: a task that takes several partitions in turn
    makes a call, and so a part, of each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder.of(tokenizer), uuid.uuid4().int >> 65
        end = end_id.to_bytes(4, "little")
        seen = [0] * (capacity + 1)
        for batch in batches:
            for at in range(0, batch.num_rows, _CHUNK):
                ids_of = batch.column(0).slice(at, _CHUNK).to_pylist()
                texts = [t or "" for t in batch.column(1).slice(at, _CHUNK).to_pylist()]
                rows: list[tuple] = []
                for doc_id, ids in zip(ids_of, encoder.encode(texts)):
                    ids = memoryview(ids + end)
                    for k, low in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[low : low + 4 * capacity]
                        n = len(own) // 4
                        rows.append((doc_id, k, low // 4, n, zlib.crc32(own), part, seen[n]))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PIECES)], schema=PIECES)
        encoder.forget()

    narrow = select(documents, "doc_id", "text")
    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, place long"
    return narrow.withColumn("doc_id", narrow.doc_id.cast("long")).mapInArrow(run, ddl)


def pack(documents: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    A document is its ids and ``end_id``; only longer ones are cut, into pieces of ``capacity`` tokens.
    Returns per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty texts
    are one piece with the end id alone. Repeated rows and null doc_ids are packed like others. An empty
    table gives an empty result. Other columns are ignored. The pieces are written to the shared folder,
    so ranks do not change when a task runs again; the driver sees at most ``capacity`` counts.
    """
    laid = stored(pieces(documents, tokenizer, end_id, capacity), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in laid.groupBy("length").count().collect():
        counts[length] = n
    slots = Slots(best_two_fit(counts, capacity))
    by_part = laid.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = laid.join(bases, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("place")).alias("rank")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
                sequence, offset = slots.place(length, rank)
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], schema=PACKED)

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(place, ddl)
