"""Document fingerprints: I-Match over a lexicon of medium inverse document frequency.

Document frequencies are counted over all texts. The lexicon has the terms whose share of documents
lies in a band; its size has a bound that does not depend on the number of documents, and it is sent
to all tasks. A fingerprint hashes the sorted distinct lexicon terms of a text, once for each of
several random subsets of the lexicon.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import blocks, hash_spans, mix, partitions_for, select, stored

_ODD = np.random.default_rng(77).integers(1 << 32, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Bands:
    """Lexicon and subsets.

    Terms in ``low_share`` to ``high_share`` of all documents (idf from ln 1/high_share to ln 1/low_share),
    and in two documents at least, form the lexicon. Where that could be more than ``max_terms`` terms, the
    lower end rises: no more than (distinct terms of all documents) / d terms are in d documents. There are
    ``subsets`` random subsets; the share of the lexicon in them falls evenly, in powers of two, from
    2^-``first_power`` to 2^-``last_power``, so that small and large changes both show.
    """

    low_share: float = 0.0005
    high_share: float = 0.2
    max_terms: int = 500_000
    subsets: int = 32
    first_power: float = 3.0
    last_power: float = 10.0

    def limits(self) -> np.ndarray:
        powers = np.linspace(self.first_power, self.last_power, self.subsets)
        return (2.0 ** (64 - powers)).astype(np.uint64)


def _terms(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each block: first row, rows, and the distinct (document, term) pairs, sorted."""
    for block in blocks(column, lower=True):
        start, end, doc = block.words()
        term = hash_spans(block.data, start, end)
        order = np.lexsort((term, doc))
        term, doc = term[order], doc[order]
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
        yield block.first, block.n, doc[new], term[new]


def document_frequencies(documents: DataFrame) -> DataFrame:
    """term (64-bit hash of a word, A-Z in lower case) and n, the documents with it, counted over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("term", pa.int64()), ("n", pa.int64())])

        def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            terms = np.concatenate([p[0] for p in parts])
            counts = np.concatenate([p[1] for p in parts])
            distinct, where = np.unique(terms, return_inverse=True)
            return distinct, np.bincount(where, weights=counts).astype(np.int64)

        # Counts are put together within the task before they are shuffled.
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for batch in batches:
            for _, _, _, term in _terms(batch.column(0)):
                distinct, n = np.unique(term, return_counts=True)
                parts.append((distinct, n))
                held += len(distinct)
                if held > 2_000_000:
                    parts = [summed(parts)]
                    held = len(parts[0][0])
                    if held > 1_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(parts[0][0].view(np.int64)), pa.array(parts[0][1])], schema=schema)
                        parts, held = [], 0
        if parts:
            terms, n = summed(parts)
            yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n)], schema=schema)

    found = select(documents, "text").mapInArrow(run, "term long, n long")
    return found.groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(documents: DataFrame, bands: Bands = Bands()) -> np.ndarray:
    """Sorted hashes of the lexicon's terms: ``bands.max_terms`` at most."""
    # Written once: the total and the band are both read from it.
    counts = stored(document_frequencies(documents), "frequencies")
    n_docs = documents.count()
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    low = max(2.0, bands.low_share * n_docs, total / bands.max_terms)
    kept = counts.filter((F.col("n") >= low) & (F.col("n") <= max(2.0, bands.high_share * n_docs)))
    return np.sort(kept.select("term").toArrow()["term"].to_numpy().view(np.uint64))


def fingerprint_rows(texts: pa.Array, words: np.ndarray, bands: Bands) -> np.ndarray:
    """Hashes (documents × subsets, unsigned 32-bit; 0 where a text has no term of the subset).

    A text without any lexicon term has the hash of all its distinct terms in every place.
    """
    n, limits = len(texts), bands.limits()
    out = np.zeros((n, bands.subsets), np.uint32)
    for first, rows, doc, term in _terms(texts):
        at = np.searchsorted(words, term)
        known = np.zeros(len(term), bool)
        inside = at < len(words)
        known[inside] = words[at[inside]] == term[inside]
        none = np.bincount(doc[known], minlength=rows) == 0
        part = np.zeros((rows, bands.subsets), np.uint32)
        own_doc, own = doc[known], mix(term[known])
        for r in range(bands.subsets):
            with np.errstate(over="ignore"):
                chosen = own * _ODD[r] < limits[r]
            part[:, r] = _listed(own_doc[chosen], own[chosen], rows)
        part[none] = _listed(doc, term, rows, empty=1)[none][:, None]
        out[first : first + rows] = part
    return out


def _listed(doc: np.ndarray, term: np.ndarray, rows: int, empty: int = 0) -> np.ndarray:
    """32-bit hash of each document's sorted list of distinct terms, never 0; ``empty`` for an empty list."""
    edge = np.searchsorted(doc, np.arange(rows + 1))
    rank = np.arange(len(doc)) - edge[doc]
    with np.errstate(over="ignore"):
        # Terms come sorted; each is hashed with its place in the list.
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(term + mix(rank.astype(np.uint64) + np.uint64(1))), dtype=np.uint64)))
        sums = total[edge[1:]] - total[edge[:-1]]
    h = (mix(sums + np.uint64(1)) >> np.uint64(32)).astype(np.uint32)
    h[h == 0] = 1
    h[edge[1:] == edge[:-1]] = empty
    return h


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of subsets with equal hashes among those where either text has a term; 1 where both have none."""
    either = ((a != 0) | (b != 0)).sum(axis=1)
    equal = ((a == b) & (a != 0)).sum(axis=1)
    return np.where(either == 0, 1.0, equal / np.maximum(either, 1))


def _hex(rows: np.ndarray) -> pa.Array:
    raw = rows.astype(">u4").tobytes()
    width = rows.shape[1] * 4
    return pa.array([raw[i : i + width].hex() for i in range(0, len(raw), width)], pa.string())


def fingerprints(documents: DataFrame, words: np.ndarray, bands: Bands = Bands()) -> DataFrame:
    """doc_id and fingerprint of every row; null texts count as empty. Equal texts have equal fingerprints."""
    sent = documents.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _hex(fingerprint_rows(batch.column(1), sent.value, bands))], schema=schema)

    narrow = select(documents, "doc_id", "text")
    return narrow.withColumn("doc_id", narrow.doc_id.cast("long")).mapInArrow(run, "doc_id long, fingerprint string")


NEIGHBOURS = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])

#: Documents of one run of the order; at most so many runs.
RUN_DOCS = 5_000
MOST_RUNS = 20_000
_FIRST = -(1 << 63)
_CHUNK_CHARS = 1_500_000


def with_next(documents: DataFrame) -> DataFrame:
    """Rows dealt into runs of ascending doc_id, each followed by the first row of the next run.

    Returns run, follows (0: of this run, 1: the row after it), key, tie, doc_id and packed (the text,
    compressed). Runs begin at ids that occur, so the row after a run is known without sorting all rows.
    Null ids come first; equal ids are in the order of their texts' hash. The last run is followed by the
    first row of all. Sort by run, follows, key, tie.
    """
    narrow = select(documents, "doc_id", "text")
    keyed = narrow.select(
        narrow.doc_id.cast("long").alias("doc_id"), "text",
        F.coalesce(narrow.doc_id.cast("long"), F.lit(_FIRST)).alias("key"),
    )
    n, first = keyed.agg(F.count(F.lit(1)), F.min("key")).first()
    runs = partitions_for(n, RUN_DOCS, 1, MOST_RUNS)
    shares = [k / runs for k in range(1, runs)]
    found = keyed.agg(F.percentile_approx("key", shares, max(10_000, 5 * runs))).first()[0] if shares and n else []
    starts = np.array(sorted({first, *found}) if n else [_FIRST], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1)
        schema = pa.schema([("run", pa.int64()), ("follows", pa.int32()), ("key", pa.int64()), ("tie", pa.int64()), ("doc_id", pa.int64()), ("packed", pa.binary())])
        for batch in batches:
            ids, key = batch.column(0), batch.column(2).to_numpy()
            packed = [pack.compress((t or "").encode()) for t in batch.column(1).to_pylist()]
            own = np.searchsorted(starts, key, "right") - 1
            opens = np.flatnonzero(starts[own] == key)  # these rows also follow the run before theirs
            rows = np.concatenate((np.arange(len(key)), opens))
            to = np.concatenate((own, (own[opens] - 1) % len(starts)))
            follows = np.concatenate((np.zeros(len(key), np.int32), np.ones(len(opens), np.int32)))
            tie = batch.column(3).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(to), pa.array(follows), pa.array(key[rows]), pa.array(tie[rows]), ids.take(pa.array(rows)),
                 pa.array([packed[i] for i in rows.tolist()], pa.binary())], schema=schema,
            )

    ddl = "run long, follows int, key long, tie long, doc_id long, packed binary"
    dealt = keyed.select("doc_id", "text", "key", F.xxhash64("text").alias("tie")).mapInArrow(run, ddl)
    return dealt.repartition("run").sortWithinPartitions("run", "follows", "key", "tie")


def compare_neighbours(documents: DataFrame, words: np.ndarray, bands: Bands = Bands()) -> DataFrame:
    """Fingerprint every document, its edited text and its next document.

    The edited text is the document with its last floor(n_chars/2) code points replaced by the first as
    many (or all) of the next document in ascending order of doc_id; the first document follows the last.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    Null texts count as empty. A single document is its own next. Rows with equal ids follow each other
    in the order of their texts' hash; null ids come first. An empty table gives an empty result. Other
    columns are ignored.
    """
    sent = documents.sparkSession.sparkContext.broadcast(words)

    def judged(ids: list, texts: list[str]) -> pa.RecordBatch:
        """Results for all texts but the last, which is only the next of the one before."""
        own = fingerprint_rows(pa.array(texts, pa.large_string()), sent.value, bands)
        edited = [t[: len(t) - len(t) // 2] + after[: len(t) // 2] for t, after in zip(texts, texts[1:])]
        changed = fingerprint_rows(pa.array(edited, pa.large_string()), sent.value, bands)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[:-1], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()),
             pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()), _hex(own[:-1]), _hex(changed),
             pa.array(likeness(own[:-1], changed)), pa.array(likeness(own[:-1], own[1:]))], schema=NEIGHBOURS,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        now, ids, texts, held, closed = None, [], [], 0, False
        for batch in batches:
            for k, follows, doc_id, packed in zip(*(batch.column(i).to_pylist() for i in (0, 1, 4, 5))):
                if k != now:
                    now, ids, texts, held, closed = k, [], [], 0, False
                if closed:
                    continue  # further rows of the id that opens the next run
                ids.append(doc_id)
                texts.append(unpack.decompress(packed).decode())
                held += len(texts[-1])
                closed = follows == 1
                if (closed or held > _CHUNK_CHARS) and len(texts) > 1:
                    yield judged(ids, texts)
                    ids, texts = ids[-1:], texts[-1:]
                    held = len(texts[0])

    ddl = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(documents).mapInArrow(run, ddl)
