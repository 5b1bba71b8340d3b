"""Keyed tables that are changed by upserts: every version can be read, and a merge rewrites only the buckets it touches.

Rows lie in buckets by the hash of their keys, a folder for each. A log table says which folder a bucket has since which
version; a version is committed by one new file of this log, so that a merge that fails leaves the table as it was. One
writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from graphloom.session import cut
from graphloom.sources.store import upsert

_LOG = "version long, bucket int, folder string, keys array<string>, buckets int"


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, version: int, keys: Sequence[str], buckets: int, touched: list[int]) -> None:
    """Write the rows of the touched buckets, then the one file of the log that makes them a version."""
    folder = f"{path}/data/{uuid.uuid4().hex}"
    placed = cut(rows.withColumn("__bucket", _bucket(keys, buckets)))
    placed.repartition("__bucket").write.partitionBy("__bucket").parquet(folder)
    filled = {r[0] for r in placed.select("__bucket").distinct().collect()}
    if not filled.issuperset(touched):  # buckets without rows keep the columns
        rows.limit(0).write.parquet(f"{folder}/none")
    entries = [(version, b, f"{folder}/__bucket={b}" if b in filled else f"{folder}/none", list(keys), buckets) for b in touched]
    rows.sparkSession.createDataFrame(entries, _LOG).coalesce(1).write.mode("append").parquet(f"{path}/log")


def _log(spark: SparkSession, path: str, version: int | None = None) -> list:
    """The newest entry of each bucket up to a version: as many rows as the table has buckets."""
    entries = spark.read.schema(_LOG).parquet(f"{path}/log")
    if version is not None:
        entries = entries.where(F.col("version") <= version)
    newest = entries.groupBy("bucket").agg(F.max("version").alias("version"))
    return entries.join(F.broadcast(newest), ["bucket", "version"]).collect()


def _rows(spark: SparkSession, folders: list[str]) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(*folders)


def create(rows: DataFrame, path: str, keys: Sequence[str], buckets: int = 64) -> None:
    """Version 0 of a table. Keys are distinct; a row without a key value is a key of its own kind."""
    kept = cut(rows)
    touched = [r[0] for r in kept.select(_bucket(keys, buckets)).distinct().collect()]
    _write(kept, path, 0, keys, buckets, touched or [0])


def versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(r[0] for r in spark.read.schema(_LOG).parquet(f"{path}/log").select("version").distinct().collect())


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as it is, or as it was at a version."""
    entries = _log(spark, path, version)
    if not entries:
        raise AnalysisException(f"{path} has no version {version}")
    return _rows(spark, sorted({e.folder for e in entries}))


def merge(new: DataFrame, path: str, remove: DataFrame | None = None) -> tuple[int, int]:
    """Remove keys, then upsert rows by the table's keys; returns the new version and how many buckets were rewritten.

    Fields given in ``new`` win, others keep their stored value, as in ``store.upsert``; null keys match none.
    ``remove`` has the keys of rows to take out. Without rows in either there is no new version.
    """
    spark = new.sparkSession
    entries = _log(spark, path)
    keys, buckets, version = entries[0]["keys"], entries[0].buckets, max(e.version for e in entries)
    new = cut(new)
    changed = new.select(*keys) if remove is None else new.select(*keys).unionByName(remove.select(*keys))
    touched = [r[0] for r in changed.select(_bucket(keys, buckets)).distinct().collect()]  # bounded by the number of buckets
    if not touched:
        return version, 0
    at = {e.bucket: e.folder for e in entries}
    held = sorted({at[b] for b in touched if b in at})
    # Columns of the whole table, also where the touched buckets are new.
    old = _rows(spark, held) if held else _rows(spark, [entries[0].folder]).limit(0)
    if remove is not None:
        old = old.join(remove.select(*keys).distinct(), list(keys), "left_anti")
    _write(upsert(old, new, keys), path, version + 1, keys, buckets, touched)
    return version + 1, len(touched)
