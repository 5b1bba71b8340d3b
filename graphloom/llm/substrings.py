"""Substring dedup: seed and extend.

Seeds are winnowed anchors: in every window of ``threshold`` words the ``seed`` words with the least
hash are its anchor, so two equal windows have equal anchors at equal places. Only windows whose
anchor occurs in more than one place are looked at again. Extending both ways from an anchor, over all
its occurrences at once, is done on hashes of the windows around it: the longest match of two
occurrences is the union of the equal windows, so maximal repeats come out without forming pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import Block, blocks, ddl_of, hash_spans, placed, select, stored, windows

THRESHOLD = 35
SEED = 8
#: A position is a first word and a number of windows in one long: the number has so many bits.
_BITS = 8


def _word_table(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    start, end, doc = block.words()
    return start, end, doc, hash_spans(block.data, start, end)


def _anchors(words: np.ndarray, docs: np.ndarray, threshold: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each anchor, and the first and number of the windows that it is the anchor of."""
    seeds, at = windows(words, docs, seed)
    span = threshold - seed + 1
    full = np.zeros(len(words), np.uint64)
    full[at] = seeds
    n = len(words) - threshold + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return np.zeros(0, np.uint64), none, none
    first = np.flatnonzero(docs[:n] == docs[threshold - 1 :])
    if not len(first):
        return np.zeros(0, np.uint64), none, none
    view = np.lib.stride_tricks.sliding_window_view(full, span)
    place = np.concatenate([view[first[i : i + 200_000]].argmin(axis=1) for i in range(0, len(first), 200_000)]) + first
    # Windows in a row with the same anchor are one range; a range is short enough for its bits.
    new = np.ones(len(first), bool)
    new[1:] = (place[1:] != place[:-1]) | (docs[first[1:]] != docs[first[:-1]])
    run = np.flatnonzero(new)
    return full[place[run]], first[run], np.diff(np.concatenate((run, [len(first)])))


def _keyed(documents: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), key (equal texts have equal keys and are one text from here on) and the other columns by place."""
    named, (doc_id, text) = placed(documents, "doc_id", "text")
    others = [c for c in named.columns if c not in (doc_id, text)]
    filled = named.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"), *others)
    return filled.select("doc_id", "text", F.xxhash64("text").alias("key"), *others)


def anchors(keyed: DataFrame, threshold: int, seed: int) -> DataFrame:
    """anchor, key and span (first window and number of windows) of every anchor of every text."""
    if seed >= threshold or threshold - seed + 1 >= 1 << _BITS:
        raise ValueError(f"the seed is shorter than the threshold, by less than {1 << _BITS} words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("anchor", pa.int64()), ("key", pa.int64()), ("span", pa.int64())])
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for block in blocks(batch.column(1)):
                _, _, doc, words = _word_table(block)
                anchor, first, n = _anchors(words, doc, threshold, seed)
                own = doc[first]
                place = first - np.searchsorted(doc, own)  # within its document
                span = (place << _BITS) + n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(keys[block.first + own]), pa.array(span)], schema=schema
                )

    return keyed.select("key", "text").mapInArrow(run, "anchor long, key long, span long")


def _repeated(places: DataFrame, hashed: str, *place: str) -> DataFrame:
    """Hashes that occur in two places or more. Counted before the shuffle, so that a hot hash is a few rows."""
    spot = F.xxhash64(*place)
    return places.groupBy(hashed).agg(F.min(spot).alias("a"), F.max(spot).alias("b")).filter("a <> b").select(hashed)


def _compressed(keyed: DataFrame) -> DataFrame:
    """doc_id, key, packed (the text, compressed) and the other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            packed = pa.array([pack.compress(t.encode()) for t in batch.column(1).to_pylist()], pa.binary())
            names = ["doc_id", "key", "packed", *batch.schema.names[3:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), packed, *batch.columns[3:]], names=names)

    others = keyed.drop("doc_id", "text", "key")
    return keyed.mapInArrow(run, ", ".join(["doc_id long, key long, packed binary", *([ddl_of(others)] if others.columns else [])]))


def _unpacked(batches: Iterator[pa.RecordBatch], column: int, chunk: int = 256) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for at in range(0, batch.num_rows, chunk):
            part = batch.slice(at, chunk)
            yield part, pa.array([unpack.decompress(p).decode() for p in part.column(column).to_pylist()], pa.large_string())


def _classes(keyed: DataFrame) -> DataFrame:
    """Of every text: key, first_id (the least doc_id that has it) and copied (whether it occurs more than once)."""
    found = keyed.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    return found.select("key", "first_id", (F.col("n") > 1).alias("copied"))


def repeated_windows(keyed: DataFrame, packed: DataFrame, classes: DataFrame, threshold: int, seed: int) -> DataFrame:
    """key and starts: of each text, the first words of its windows that also start anywhere else.

    Windows of equal texts are told once here, from the row with the least doc_id.
    """
    laid = stored(anchors(keyed, threshold, seed), "anchors")
    # What is met again is written first, so that a hot anchor or window is split over tasks by the join.
    seeds = laid.join(stored(_repeated(laid, "anchor", "key", "span"), "repeated-anchors"), "anchor", "left_semi")
    # Sets, because equal texts have equal spans; a set is no longer than its text.
    spans = seeds.groupBy("key").agg(F.collect_set("span").alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("hash", pa.int64()), ("key", pa.int64()), ("start", pa.int32())])
        for part, texts in _unpacked(batches, 2):
            keys = part.column(1).to_numpy()
            spans = part.column(3)
            offsets, flat = spans.offsets.to_numpy(), spans.values.to_numpy()
            for block in blocks(texts):
                _, _, doc, words = _word_table(block)
                hashes, first = windows(words, doc, threshold)
                low, high = offsets[block.first], offsets[block.first + block.n]
                span = flat[low:high]
                own = np.repeat(np.arange(block.n), np.diff(offsets[block.first : block.first + block.n + 1]))
                n = span & ((1 << _BITS) - 1)
                opens = np.searchsorted(doc, own) + (span >> _BITS)
                each = np.repeat(opens - np.cumsum(n) + n, n) + np.arange(n.sum())
                of = np.repeat(own, n)
                start = each - np.searchsorted(doc, of)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[np.searchsorted(first, each)].view(np.int64)), pa.array(keys[block.first + of]),
                     pa.array(start.astype(np.int32))], schema=schema,
                )

    around = packed.join(spans.join(classes, "key"), "key").filter(F.col("doc_id").eqNullSafe(F.col("first_id")))
    around = around.select("doc_id", "key", "packed", "spans")
    found = stored(around.mapInArrow(run, "hash long, key long, start int"), "windows")
    marked = found.join(stored(_repeated(found, "hash", "key", "start"), "repeated-windows"), "hash", "left_semi")
    return marked.groupBy("key").agg(F.collect_set("start").alias("starts"))


def remove_repeats(documents: DataFrame, threshold: int = THRESHOLD, seed: int = SEED) -> DataFrame:
    """Remove every word that is in a run of ``threshold`` words which also occurs anywhere else.

    Words are ``[^\\x20\\x09-\\x0D]+``. Every occurrence goes, the first as well, whether the other is in the
    same document or not; windows are judged on the input. Returns per input row: doc_id, n_words,
    n_removed, kept_sha256 (of the kept words joined by one space) and text: the text without the removed
    words and without the blanks after them.

    Null and empty texts have no words; texts under ``threshold`` words lose none. Repeated rows are copies
    of each other, so they lose all words if they have a window. Null doc_ids are allowed, other columns
    ignored; an empty table gives an empty result.
    """
    return _judged(_keyed(select(documents, "doc_id", "text")), threshold, seed)


def without_repeats(documents: DataFrame, threshold: int = THRESHOLD, seed: int = SEED) -> DataFrame:
    """All columns of ``documents`` with their texts as ``remove_repeats`` leaves them, and n_chars of the new text.

    Documents that lose all their words are left out; those without any word stay as they are, null texts null.
    """
    named, (doc_id, text) = placed(documents, "doc_id", "text")
    absent = f"c{len(named.columns)}"
    keyed = _keyed(named.withColumn(absent, F.col(text).isNull()).toDF(*documents.columns, "absent"))
    left = _judged(keyed, threshold, seed).filter("n_words = 0 or n_removed < n_words")
    columns = {doc_id: F.col("doc_id"), text: F.when(~F.col(absent), F.col("text"))}
    if "n_chars" in documents.columns:
        own = f"c{documents.columns.index('n_chars')}"
        counted = F.char_length("text").cast(documents.schema["n_chars"].dataType)
        columns[own] = F.when(F.col("n_words") == 0, F.col(own)).otherwise(counted)
    return left.select(*[columns.get(c, F.col(c)).alias(c) for c in named.columns]).toDF(*documents.columns)


def _judged(keyed: DataFrame, threshold: int, seed: int) -> DataFrame:
    """What ``remove_repeats`` returns, and the other columns of ``keyed``."""
    others = [c for c in keyed.columns if c not in ("doc_id", "text", "key")]
    packed = _compressed(keyed)
    classes = stored(_classes(keyed), "texts")
    starts = repeated_windows(keyed, packed, classes, threshold, seed)
    marks = classes.filter("copied").select("key", "copied").join(starts, "key", "full")
    told = packed.join(marks, "key", "left")
    ready = told.select("doc_id", "key", "packed", "starts", F.coalesce("copied", F.lit(False)).alias("copied"), *others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "text", *others]
        for part, texts in _unpacked(batches, 2):
            lists = part.column(3).fill_null([])
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            copied = part.column(4).to_numpy(zero_copy_only=False)
            rows = []
            for block in blocks(texts):
                start, end, doc = block.words()
                edge = np.searchsorted(doc, np.arange(block.n + 1))
                raw = block.data.tobytes()
                for i in range(block.n):
                    k = block.first + i
                    lo, n = edge[i], int(edge[i + 1] - edge[i])
                    gone = np.zeros(n, bool)
                    if copied[k] and n >= threshold:
                        gone[:] = True
                    elif offsets[k + 1] > offsets[k]:
                        cover = np.zeros(n + 1, np.int64)
                        at = flat[offsets[k] : offsets[k + 1]]
                        np.add.at(cover, at, 1)
                        np.add.at(cover, at + threshold, -1)
                        gone = np.cumsum(cover)[:-1] > 0
                    rows.append((n, int(gone.sum()), *_kept(raw, block, i, start[lo : lo + n], end[lo : lo + n], gone)))
            n, removed, digest, text = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest), pa.array(text, pa.string()), *part.columns[5:]],
                names=names,
            )

    ddl = "doc_id long, n_words long, n_removed long, kept_sha256 string, text string"
    return ready.mapInArrow(run, ", ".join([ddl, *([ddl_of(ready.select(*others))] if others else [])]))


def _kept(raw: bytes, block: Block, i: int, start: np.ndarray, end: np.ndarray, gone: np.ndarray) -> tuple[str, str]:
    """SHA-256 of the kept words joined by a space, and the text with its kept parts as they were."""
    whole = raw[block.offsets[i] : block.offsets[i + 1]]
    if not gone.any():
        return hashlib.sha256(b" ".join(whole.split())).hexdigest(), whole.decode()
    stay = ~gone
    # Runs of kept words: from the first word of a run to where the next removed word starts.
    opens = np.flatnonzero(stay & np.concatenate(([True], gone[:-1])))
    shuts = np.flatnonzero(stay & np.concatenate((gone[1:], [True])))
    after = np.append(start[1:], block.offsets[i + 1])
    parts = [raw[start[a] : after[b]] for a, b in zip(opens, shuts)]
    words = b"".join(parts).split()
    return hashlib.sha256(b" ".join(words)).hexdigest(), b"".join(parts).decode()
