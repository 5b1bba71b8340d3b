"""Deletion by bitmaps and compaction of worn files."""

from __future__ import annotations

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from graphloom.sources import marked


def files(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/data/*/*.parquet")}


def rows_of(df):
    return sorted((r.idx, r.doc_id, r.x) for r in df.collect())


def table(spark, n, parts, start=0):
    rows = spark.range(start, start + n, 1, parts)
    return rows.select(F.col("id").alias("idx"), F.concat(F.lit("d"), F.col("id") % 50).alias("doc_id"), F.array("id").alias("x"))


def test_marks_equal_filters(spark, tmp_path):
    """Random deletions in files of several bitmaps, read at every version."""
    path, rng = str(tmp_path / "t"), random.Random(3)
    marked.create(table(spark, 90_000, 2), path)
    left, want = set(range(90_000)), [set(range(90_000))]
    written = files(path)
    for n in (1, 700, 40_000):
        gone = set(rng.sample(range(90_000), n)) | {0, 32_767, 32_768, 44_999, 89_999}
        version, count = marked.delete(spark.createDataFrame([(i,) for i in gone] + [(None,), (10**6,)], "idx long"), path, ["idx"])
        assert count == len(left & gone) and version == len(want)
        left = left - gone
        want.append(left)
    assert files(path) == written
    for version, rows in enumerate(want):
        assert {r.idx for r in marked.read(spark, path, version).select("idx").collect()} == rows
    told = marked.report(spark, path).collect()
    assert sum(r.n_rows - r.n_deleted for r in told) == len(left)
    assert marked.delete(spark.createDataFrame([(0,), (None,)], "idx long"), path, ["idx"]) == (3, 0)


def test_only_worn_files_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    laid = table(spark, 2_000, 4).repartitionByRange(8, "doc_id", "idx")
    marked.create(laid, path)
    marked.append(table(spark, 100, 1, 2_000), path)
    marked.delete(spark.createDataFrame([("d1",), ("d10",)], "doc_id string"), path)
    was, before = files(path), rows_of(marked.read(spark, path))
    worn = [r.file for r in marked.report(spark, path).collect() if r.share > 0.2]
    assert 0 < len(worn) < 8
    got = marked.compact(spark, path, order=["doc_id", "idx"])
    assert got["files"] == len(worn) and got["removed"] == got["before"] - got["after"] > 0
    assert rows_of(marked.read(spark, path)) == before == [r for r in rows_of(table(spark, 2_100, 1)) if r[1] not in ("d1", "d10")]
    assert was.items() <= files(path).items()
    held = {r.file for r in marked.report(spark, path).collect()}
    kept = {r.file for r in marked.report(spark, path, 2).collect()} - set(worn)
    assert kept <= held and not held & set(worn)
    assert marked.compact(spark, path)["files"] == 0 and rows_of(marked.read(spark, path, 2)) == before
    # Rows that were moved can be deleted again.
    assert marked.delete(spark.createDataFrame([("d11",)], "doc_id string"), path)[1] == 42
    assert rows_of(marked.read(spark, path)) == [r for r in before if r[1] != "d11"]


def test_failed_steps_and_empty_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    marked.create(table(spark, 0, 1), path)
    gone = spark.createDataFrame([("d1",)], "doc_id string")
    assert marked.read(spark, path).columns == ["idx", "doc_id", "x"] and marked.read(spark, path).count() == 0
    assert marked.delete(gone, path) == (0, 0) and marked.compact(spark, path)["version"] == 0
    assert marked.append(table(spark, 100, 2), path) == 1
    with pytest.raises(Exception, match="lost"):
        marked.append(table(spark, 10, 1).withColumn("idx", F.raise_error(F.lit("lost")).cast("long")), path)
    with pytest.raises(Exception, match="lost"):
        marked.delete(gone.select(F.when(F.col("doc_id") > "", F.raise_error(F.lit("lost")).cast("string")).alias("doc_id")), path)
    assert marked.versions(spark, path) == [0, 1] and marked.read(spark, path).count() == 100
    assert marked.delete(table(spark, 100, 1).select("doc_id"), path) == (2, 100)
    assert marked.read(spark, path).count() == 0
    assert marked.compact(spark, path)["after"] == 0
    assert marked.read(spark, path).count() == 0 and marked.read(spark, path, 1).count() == 100
    with pytest.raises(Exception, match="no version"):
        marked.read(spark, path, 9)
