"""Token-ID output: Parquet list columns that can be read in part, and flat files without an index.

``write_parquet`` lays documents out by ascending id, one file per range, with row groups of a set
number of tokens and a page index; ``read_parquet`` opens only the row groups and columns asked for.
``write_flat`` writes bare ids with an end id after each document, and ``scan_flat`` counts the
tokens of every document of such files from their bytes alone.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import file_system, folder, partitions_for, select, stored
from graphloom.llm.tokens import Encoder

GROUP_TOKENS = 1_000_000
PAGE_BYTES = 64_000
READ_TOKENS = 4_000_000
#: Stored documents of this size make one file.
RANGE_BYTES = 64_000_000
BLOCK_BYTES = 4_000_000
_CHUNK = 1_024

FILE = pa.schema([
    ("doc_id", pa.int64()), ("start_in_file", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())),
])
MANIFEST_DDL = (
    "file string, part int, row_group int, first_id long, last_id long, n_docs long, n_tokens long"
)
MANIFEST = pa.schema([
    ("file", pa.string()), ("part", pa.int32()), ("row_group", pa.int32()), ("first_id", pa.int64()),
    ("last_id", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()),
])


def _ranges(documents: DataFrame, range_bytes: int) -> int:
    """Two ranges a core, or more where the session's shuffles have more partitions and a range would exceed ``range_bytes``.

    A worker learns words anew in every range, so ranges are not smaller than that. The size is the planner's estimate.
    """
    spark = documents.sparkSession
    least = 2 * spark.sparkContext.defaultParallelism
    size = int(str(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, min(size // range_bytes, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def in_order(documents: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id and text in ascending order of doc_id over range partitions; equal ids in the order of their texts' hash.

    part is the number of the range, whatever task reads it.
    """
    narrow = select(documents, "doc_id", "text")
    narrow = narrow.select(narrow.doc_id.cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    ordered = narrow.repartitionByRange(_ranges(documents, range_bytes), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    return ordered.select("doc_id", "text", F.spark_partition_id().alias("part"))


def _encoded(batches: Iterator[pa.RecordBatch], encoder: Encoder, end: bytes) -> Iterator[tuple[list, list[bytes]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, _CHUNK):
            texts = [t or "" for t in batch.column(1).slice(at, _CHUNK).to_pylist()]
            yield batch.column(0).slice(at, _CHUNK).to_pylist(), [ids + end for ids in encoder.encode(texts)]
    encoder.forget()


def write_parquet(
    documents: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = 0,
    encoding: str = "dictionary",
    group_tokens: int = GROUP_TOKENS,
    page_bytes: int = PAGE_BYTES,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """Write the ids of every document, ``end_id`` after each, to Parquet files under ``path``.

    Files hold doc_id, start_in_file (ids of the file before the document), n_tokens and ids, in ascending
    order of doc_id over all files. ``encoding`` of ids is "dictionary" or "delta" (DELTA_BINARY_PACKED).
    A row group is closed when it has ``group_tokens`` ids; pages have about ``page_bytes`` and an index.

    Null and empty texts have the end id alone. Null doc_ids come first. Rows with equal ids are ordered
    by text. Other columns are ignored. An empty table writes no file.

    Returns the manifest, stored in the shared folder: one row per row group with file, part (order of the
    files), row_group, first_id, last_id, n_docs, n_tokens. A task that runs again writes a file of another
    name; only that of the attempt that succeeded is in the manifest.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError("encoding is dictionary or delta")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, name = Encoder.of(tokenizer), -1, ""
        fs, root = file_system(path)
        chosen = {"use_dictionary": ["ids.list.element"]} if encoding == "dictionary" else {
            "use_dictionary": False, "column_encoding": {"ids.list.element": "DELTA_BINARY_PACKED"}}
        writer, rows, pending = None, [], []
        waiting = before = 0

        def numbered() -> Iterator[pa.RecordBatch]:
            nonlocal part, name
            for batch in batches:
                if batch.num_rows and part < 0:  # a call reads one range
                    part = batch.column(2)[0].as_py()
                    name = f"part-{part:06d}-{uuid.uuid4().hex}.parquet"
                yield batch

        def flush() -> None:
            nonlocal writer, pending, waiting, before
            if writer is None:
                fs.create_dir(root, recursive=True)
                writer = pq.ParquetWriter(
                    f"{root}/{name}", FILE, filesystem=fs, compression="zstd", compression_level=1,
                    write_page_index=True, data_page_size=page_bytes, **chosen,
                )
            lengths = np.array([len(ids) // 4 for _, ids in pending], np.int64)
            starts = before + np.cumsum(lengths) - lengths
            flat = np.frombuffer(b"".join(ids for _, ids in pending), np.int32)
            offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            docs = [d for d, _ in pending]
            writer.write_table(
                pa.Table.from_arrays([pa.array(docs, pa.int64()), pa.array(starts), pa.array(lengths), lists], schema=FILE),
                row_group_size=len(pending),
            )
            known = [d for d in docs if d is not None]
            rows.append((name, part, len(rows), min(known, default=None), max(known, default=None), len(docs), int(lengths.sum())))
            before += int(lengths.sum())
            pending, waiting = [], 0

        for docs, encoded in _encoded(numbered(), encoder, end_id.to_bytes(4, "little")):
            for pair in zip(docs, encoded):
                pending.append(pair)
                waiting += len(pair[1]) // 4
                if waiting >= group_tokens:
                    flush()
        if pending:
            flush()
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), MANIFEST)], schema=MANIFEST)

    return stored(in_order(documents, range_bytes).mapInArrow(run, MANIFEST_DDL), "token-manifest")


def with_bases(manifest: DataFrame) -> DataFrame:
    """The manifest and base: the ids of all files before a row's file. One row per row group passes one window."""
    files = manifest.groupBy("file", "part").agg(F.sum("n_tokens").alias("in_file"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select("file", F.coalesce(F.sum("in_file").over(earlier), F.lit(0)).alias("base"))
    return manifest.join(bases, "file")


def _read(
    manifest: DataFrame,
    path: str,
    first_id: int | None,
    last_id: int | None,
    shown: Callable[[pa.Table], pa.Table],
    ddl: str,
    columns: Sequence[str] = ("doc_id", "start", "n_tokens", "ids"),
) -> DataFrame:
    """What ``shown`` makes of the wanted columns of the row groups that can hold the wanted ids.

    No other column's bytes are read, but for doc_id where ids are asked for by range.
    """
    ranged = first_id is not None or last_id is not None
    stored_as = {"start": "start_in_file"}
    held = [stored_as.get(c, c) for c in dict.fromkeys([*(["doc_id"] if ranged else []), *columns])]
    wanted = with_bases(manifest)
    if first_id is not None:
        wanted = wanted.filter(F.col("last_id") >= first_id)
    if last_id is not None:
        wanted = wanted.filter(F.col("first_id") <= last_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(path)
        for batch in batches:
            for file, group, base in zip(*(batch.column(i).to_pylist() for i in range(3))):
                with fs.open_input_file(f"{root}/{file}") as f:
                    table = pq.ParquetFile(f).read_row_group(group, columns=held)
                if first_id is not None:
                    table = table.filter(pc.field("doc_id") >= first_id)
                if last_id is not None:
                    table = table.filter(pc.field("doc_id") <= last_id)
                taken = {c: pc.add(table["start_in_file"], base) if c == "start" else table[c] for c in columns}
                yield from shown(pa.table(taken)).to_batches()

    total = wanted.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    tasks = partitions_for(total, READ_TOKENS, manifest.sparkSession.sparkContext.defaultParallelism)
    dealt = wanted.select("file", "row_group", "base").repartitionByRange(tasks, "file", "row_group")
    return dealt.mapInArrow(run, ddl)


_READ = {"doc_id": "long", "start": "long", "n_tokens": "long", "ids": "array<int>"}


def read_parquet(
    manifest: DataFrame,
    path: str,
    first_id: int | None = None,
    last_id: int | None = None,
    columns: Sequence[str] = ("doc_id", "start", "n_tokens", "ids"),
) -> DataFrame:
    """``columns`` of the documents with an id from ``first_id`` to ``last_id`` (all, if both are None).

    Only row groups that can hold such ids are opened, and of them only the columns asked for: lengths and
    places come from a few bytes a document, without its ids. start counts the ids of all documents before.
    Rows without a doc_id are in no range, but among all; repeated ids are read as often as they were written;
    an empty manifest gives no row. An unknown column raises ValueError.
    """
    if unknown := [c for c in columns if c not in _READ]:
        raise ValueError(f"no such columns: {unknown}")
    ddl = ", ".join(f"{c} {_READ[c]}" for c in columns)
    return _read(manifest, path, first_id, last_id, lambda table: table, ddl, columns)


def read_digests(manifest: DataFrame, path: str, first_id: int | None = None, last_id: int | None = None) -> DataFrame:
    """The same documents by doc_id, start, n_tokens and ids_crc32; the ids stay where they are read.

    n_tokens is the length of the list that was read, not what the column of that name says.
    """

    def digested(table: pa.Table) -> pa.Table:
        lists = table["ids"].combine_chunks()
        offsets = lists.offsets.to_numpy()
        flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        counted = pa.array(np.diff(offsets).astype(np.int64))
        return pa.table({"doc_id": table["doc_id"], "start": table["start"], "n_tokens": counted, "ids_crc32": pa.array(crc, pa.int64())})

    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return _read(manifest, path, first_id, last_id, digested, ddl, ("doc_id", "start", "ids"))


# Flat files


def write_flat(documents: DataFrame, path: str, tokenizer: str, end_id: int, width: int = 2) -> DataFrame:
    """Write ids as bare little-endian unsigned numbers of ``width`` bytes (2 or 4), ``end_id`` after each document.

    Documents are written where they are read, in the order of the table. Strings of special tokens in a
    text are encoded as ordinary text, so ``end_id`` occurs at ends only; an id that does not fit raises.
    Returns, stored in the shared folder, which document is where: file, n_bytes (of the file),
    ordinal (from 0 in its file), doc_id. Null and empty texts have the end id alone; repeated rows and null
    doc_ids are written like others; other columns are ignored; an empty table writes no file.
    """
    if width not in (2, 4):
        raise ValueError("width is 2 or 4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer, True)
        fs, root = file_system(path)
        name = f"part-{uuid.uuid4().hex}.bin"
        out, written, n = None, [], 0
        for docs, encoded in _encoded(batches, encoder, end_id.to_bytes(4, "little")):
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
            ids = np.frombuffer(b"".join(encoded), "<u4")
            if width == 2 and ids.max(initial=0) >= 1 << 16:
                raise ValueError(f"id {ids.max()} does not fit into two bytes")
            out.write(ids.astype(f"<u{width}").tobytes())
            n += width * len(ids)
            written += docs
        if out is not None:
            out.close()
            schema = pa.schema([("file", pa.string()), ("n_bytes", pa.int64()), ("ordinal", pa.int64()), ("doc_id", pa.int64())])
            for at in range(0, len(written), 50_000):
                ids = written[at : at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(ids)), pa.array([n] * len(ids), pa.int64()),
                     pa.array(np.arange(at, at + len(ids))), pa.array(ids, pa.int64())], schema=schema,
                )

    narrow = select(documents, "doc_id", "text")
    ddl = "file string, n_bytes long, ordinal long, doc_id long"
    return stored(narrow.withColumn("doc_id", narrow.doc_id.cast("long")).mapInArrow(run, ddl), "flat-files")


def scan_flat(files: DataFrame, path: str, end_id: int, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Count the tokens of every document in flat files (``files``: file, n_bytes), from their bytes alone.

    Blocks of ``block_bytes`` are searched for ``end_id`` on their own. A prefix scan over the blocks of a
    file gives how many ends lie before a block and where the last of them was, which numbers a block's
    documents and joins the piece at its start to the blocks before it. Ids after the last end of a file
    are a document without an end (``ended`` false).

    Returns file, ordinal (from 0 in its file), start (ids of the file before it), n_tokens (with the end
    id), ended. An empty file has no row; consecutive ends are documents of one token.
    """
    block_bytes = max(width, block_bytes - block_bytes % width)
    in_block = block_bytes // width

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(path)
        schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("ends", pa.list_(pa.int64())), ("last", pa.int64()), ("n", pa.int64())])
        for batch in batches:
            for file, n_bytes, block in zip(*(batch.column(i).to_pylist() for i in range(3))):
                low = block * in_block
                with fs.open_input_file(f"{root}/{file}") as f:
                    ids = np.frombuffer(f.read_at(min(block_bytes, n_bytes - block * block_bytes), block * block_bytes), f"<u{width}")
                ends = np.flatnonzero(ids == end_id) + (low + 1)
                high = low + len(ids)
                # An unended rest counts as one more end, at the end of the file.
                if high * width >= n_bytes and (not len(ends) or ends[-1] != high):
                    ends = np.append(ends, high)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([block], pa.int64()), pa.array([ends], pa.list_(pa.int64())),
                     pa.array([ends[-1] if len(ends) else None], pa.int64()), pa.array([len(ends)], pa.int64())], schema=schema,
                )

    spark = files.sparkSession
    last_block = F.floor((F.col("n_bytes") - 1) / block_bytes).cast("long")
    listed = files.select("file", "n_bytes").filter("n_bytes > 0")
    blocks = listed.select("file", "n_bytes", F.explode(F.sequence(F.lit(0).cast("long"), last_block)).alias("block"))
    total = listed.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    tasks = partitions_for(total, 4 * block_bytes, spark.sparkContext.defaultParallelism)
    dealt = blocks.repartitionByRange(tasks, "file", "block")
    found = stored(dealt.mapInArrow(search, "file string, block long, ends array<long>, last long, n long"), "flat-ends")

    # The prefix scan sees numbers per block only, never the ends themselves.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = found.select(
        "file", "block",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("docs_before"),
        F.coalesce(F.max("last").over(before), F.lit(0)).alias("open_since"),
    )
    sizes = listed.select("file", (F.col("n_bytes") / width).cast("long").alias("n_ids"))
    rows = found.select("file", "block", "ends").join(carried, ["file", "block"])
    rows = rows.select("file", "docs_before", F.array_insert(F.col("ends"), 1, F.col("open_since")).alias("edges"))
    spans = F.arrays_zip(F.slice("edges", 1, F.greatest(F.size("edges") - 1, F.lit(0))), F.slice("edges", 2, F.size("edges")))
    each = rows.select("file", "docs_before", F.posexplode(spans).alias("k", "span"))
    out = each.select(
        "file", (F.col("docs_before") + F.col("k")).alias("ordinal"), F.col("span.0").alias("start"),
        (F.col("span.1") - F.col("span.0")).alias("n_tokens"), F.col("span.1").alias("end"),
    )
    # Whether a file's last document was ended is known from its last id.
    unended = _unended(listed, path, end_id, width)
    joined = out.join(sizes.join(unended, "file"), "file")
    return joined.select("file", "ordinal", "start", "n_tokens", ((F.col("end") < F.col("n_ids")) | ~F.col("open_tail")).alias("ended"))


def _unended(files: DataFrame, path: str, end_id: int, width: int) -> DataFrame:
    schema = pa.schema([("file", pa.string()), ("open_tail", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(path)
        for batch in batches:
            names, open_tail = batch.column(0).to_pylist(), []
            for file, n_bytes in zip(names, batch.column(1).to_pylist()):
                with fs.open_input_file(f"{root}/{file}") as f:
                    open_tail.append(int.from_bytes(f.read_at(width, n_bytes - width), "little") != end_id)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(open_tail)], schema=schema)

    return files.mapInArrow(run, "file string, open_tail boolean")


def count_tokens(documents: DataFrame, tokenizer: str, end_id: int, width: int = 2) -> DataFrame:
    """Write ``documents`` to flat files, scan them, and name the documents again: doc_id, file, ordinal, start, n_tokens.

    (file, ordinal) is a key: every row of ``documents`` is one row here, repeated rows and rows without a doc_id
    too. start counts the ids of its file before the document. Null and empty texts have one token, the end id;
    other columns are ignored; an empty table gives an empty one.
    """
    path = folder(documents.sparkSession, "flat")
    written = write_flat(documents, path, tokenizer, end_id, width)
    files = written.groupBy("file").agg(F.max("n_bytes").alias("n_bytes"))
    counted = scan_flat(files, path, end_id, width)
    named = written.select("file", "ordinal", "doc_id").join(counted, ["file", "ordinal"])
    return named.select("doc_id", "file", "ordinal", "start", "n_tokens")
