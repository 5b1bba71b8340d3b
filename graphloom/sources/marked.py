"""Row tables whose rows are deleted by marks: a bitmap of the deleted rows per file, and compaction of worn files only.

A deletion writes no row again. It reads the key columns, finds the places of the rows that go (file and row number, which
Parquet readers give) and stores one bit a row, in bitmaps of ``SPAN`` rows. A log says which files a version has and
where the marks of each are; a version is committed by one new file of this log, so a step that fails leaves the table as it was,
and every version can be read while its files are there. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from graphloom.functions import fixed
from graphloom.operators.spread import join_lookup
from graphloom.session import cut

#: Rows that one bitmap of the built-in bitmap functions covers.
SPAN = 32_768
_ENTRY = "file string, n_rows long, n_deleted long, held boolean, marks string"
_LOG = f"version long, {_ENTRY}"
_MARKS = "file string, span long, bits binary"


def _placed(rows: DataFrame) -> DataFrame:
    """Rows with the place of each: ``__file`` (folder and name) and ``__row`` (from 0 in its file)."""
    return rows.withColumns(
        {"__file": F.regexp_extract("_metadata.file_path", r"([^/]+/[^/]+)$", 1), "__row": F.col("_metadata.row_index")}
    )


def _span(row: Column) -> Column:
    return F.floor(row / SPAN).cast("long")


def _marked(bits: Column, row: Column) -> Column:
    """Whether the bit of a row is set; null without a bitmap."""
    at = (row % SPAN).cast("int")
    byte = F.conv(F.hex(F.substring(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, at % 8) == 1


def _log(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest entry of every file that a version holds."""
    entries = spark.read.schema(_LOG).parquet(f"{path}/log")
    if version is not None:
        entries = entries.where(F.col("version") <= version)
    newest = entries.groupBy("file").agg(F.max_by(F.struct("n_rows", "n_deleted", "held", "marks"), "version").alias("last"))
    return newest.select("file", "last.*").where("held").drop("held")


def versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(r[0] for r in spark.read.schema(_LOG).parquet(f"{path}/log").select("version").distinct().collect())


def _commit(entries: DataFrame, path: str, version: int) -> int:
    """Write the one file of the log that makes a version; its entry without a file says so where no file changed."""
    spark = entries.sparkSession
    one = spark.createDataFrame([("", 0, 0, False, None)], _ENTRY)
    ready = entries.select(*one.columns).unionByName(one).withColumn("version", F.lit(version).cast("long"))
    ready.coalesce(1).write.mode("append").parquet(f"{path}/log")
    return version


def _files(spark: SparkSession, path: str, entries: list) -> DataFrame:
    return _placed(spark.read.parquet(*[f"{path}/data/{e.file}" for e in entries]))


def _write(rows: DataFrame, path: str) -> DataFrame:
    """Write rows to a new folder; the log entries of its files. Files without rows have none."""
    folder = uuid.uuid4().hex
    rows.write.parquet(f"{path}/data/{folder}")
    found = rows.sparkSession.read.parquet(f"{path}/data/{folder}")
    counted = _placed(found).groupBy(F.col("__file").alias("file")).agg(F.count(F.lit(1)).alias("n_rows"))
    fresh = {"n_deleted": F.lit(0).cast("long"), "held": F.lit(True), "marks": F.lit(None).cast("string")}
    return counted.withColumns(fresh)


def create(rows: DataFrame, path: str) -> int:
    """Version 0, in the files that the partitions of ``rows`` make: laid out by document, few files hold a document's rows."""
    entries = _write(rows, path)
    rows.limit(0).write.parquet(f"{path}/none")
    return _commit(entries, path, 0)


def append(rows: DataFrame, path: str) -> int:
    """Add files of new rows; returns the new version."""
    return _commit(_write(rows, path), path, versions(rows.sparkSession, path)[-1] + 1)


def _bitmaps(spark: SparkSession, worn: list) -> DataFrame:
    """The bitmaps that count for files with marks: a file's older ones lie in other folders."""
    current = spark.createDataFrame([(e.file, e.marks.rsplit("/", 1)[-1]) for e in worn], "file string, folder string")
    stored = spark.read.schema(_MARKS).parquet(*sorted({e.marks for e in worn}))
    named = stored.withColumn("folder", F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1))
    return named.join(F.broadcast(current), ["file", "folder"], "left_semi").drop("folder")


def _alive(spark: SparkSession, path: str, entries: list) -> DataFrame:
    """Rows not marked, with their places. Files without marks are read as they are; only rows of the others meet bitmaps."""
    plain, worn = [e for e in entries if e.marks is None], [e for e in entries if e.marks is not None]
    whole = _files(spark, path, plain) if plain else None
    if not worn:
        return whole
    rows = _files(spark, path, worn)
    bitmaps = _bitmaps(spark, worn).withColumnsRenamed({"file": "__file", "span": "__span"})
    met = join_lookup(rows.withColumn("__span", _span(F.col("__row"))), bitmaps, ["__file", "__span"], "left")
    kept = met.where(~F.coalesce(_marked(F.col("bits"), F.col("__row")), F.lit(False))).drop("__span", "bits")
    return kept if whole is None else whole.unionByName(kept, allowMissingColumns=True)


def _entries(spark: SparkSession, path: str, version: int | None = None) -> list:
    """One entry a file: what a reader of as many files needs in the driver anyway."""
    if version is not None and version not in versions(spark, path):
        raise AnalysisException(f"{path} has no version {version}")
    return _log(spark, path, version).orderBy("file").collect()


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows that are left, or that were at a version."""
    entries = _entries(spark, path, version)
    if not entries:
        return spark.read.parquet(f"{path}/none")
    return _alive(spark, path, entries).drop("__file", "__row")


def delete(gone: DataFrame, path: str, keys: Sequence[str] = ("doc_id",)) -> tuple[int, int]:
    """Mark the rows whose keys are in ``gone``; returns the version and how many rows were marked now.

    Null keys match none; keys without rows are passed over. Where no row goes, there is no new version. No file of rows is
    written; the bitmaps of the files that lose rows are written anew, all of a file in one folder.
    """
    spark = gone.sparkSession
    version = versions(spark, path)[-1]
    entries = _entries(spark, path)
    if not entries:
        return version, 0
    rows = _alive(spark, path, entries).select(*keys, "__file", "__row")
    found = join_lookup(rows, gone.select(*keys).distinct().withColumn("__gone", F.lit(True)), list(keys))
    bit = F.col("__row") + 1  # the built-in functions count rows from 1
    new = cut(
        found.groupBy(F.col("__file").alias("file"), _span(F.col("__row")).alias("span"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    )
    lost = new.groupBy("file").agg(F.sum(F.bitmap_count("bits")).alias("lost"))
    now = {r.file: r.lost for r in lost.collect()}  # one entry a file
    if not now:
        return version, 0
    folder = f"{path}/marks/{uuid.uuid4().hex}"
    earlier = [e for e in entries if e.file in now and e.marks is not None]
    if earlier:
        both = new.unionByName(_bitmaps(spark, earlier))
        new = both.groupBy("file", "span").agg(F.bitmap_or_agg("bits").alias("bits"))
    new.repartition("file").write.parquet(folder)
    marked = [(e.file, e.n_rows, e.n_deleted + now[e.file], True, folder) for e in entries if e.file in now]
    changed = spark.createDataFrame(marked, _ENTRY)
    return _commit(changed, path, version + 1), sum(now.values())


def report(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One row a file: file, n_rows, n_deleted and their share."""
    shares = (F.col("n_deleted") / F.greatest("n_rows", F.lit(1))).alias("share")
    if version is not None and version not in versions(spark, path):
        raise AnalysisException(f"{path} has no version {version}")
    return _log(spark, path, version).select("file", "n_rows", "n_deleted", shares)


def compact(spark: SparkSession, path: str, share: float = fixed.REBUILD_SHARE, order: Sequence[str] = ("doc_id", "idx")) -> dict[str, int]:
    """Write the rows left of files with more than ``share`` deleted to new files; the other files stay as they are.

    Returns version, files (rewritten), kept (files left alone), before, after and removed (rows of the rewritten files).
    Rows keep their numbers, so what refers to them stays right; ``vectors.compact`` renumbers a whole store.
    """
    entries = _entries(spark, path)
    version = versions(spark, path)[-1]
    worn = [e for e in entries if e.n_deleted > share * e.n_rows]
    before, removed = sum(e.n_rows for e in worn), sum(e.n_deleted for e in worn)
    out = {"version": version, "files": len(worn), "kept": len(entries) - len(worn), "before": before, "after": before - removed, "removed": removed}
    if not worn:
        return out
    gone = spark.createDataFrame([(e.file, e.n_rows, e.n_deleted, False, None) for e in worn], _ENTRY)
    if out["after"]:
        left = _alive(spark, path, worn).drop("__file", "__row")
        parts = max(1, -(-out["after"] * len(worn) // before))  # files stay about as large as they were
        written = _write(left.repartitionByRange(parts, *order).sortWithinPartitions(*order), path)
        gone = gone.unionByName(written)
    return out | {"version": _commit(gone, path, version + 1)}
