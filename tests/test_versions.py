"""Versioned tables and model calls that survive failures."""

from __future__ import annotations

import glob
import os

import pytest
from pyspark.sql import functions as F

from graphloom.operators import inference
from graphloom.sources import versions


def rows_of(df):
    return sorted(map(tuple, df.select("k", "a", *[c for c in df.columns if c not in ("k", "a")]).collect()))


def test_merges_rewrite_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    base = spark.range(200).select(F.col("id").alias("k"), (F.col("id") * 2).alias("a"))
    versions.create(base, path, ["k"], 32)
    before = set(glob.glob(f"{path}/data/*/*/*.parquet"))
    assert versions.merge(spark.createDataFrame([(3, -1), (500, 7)], "k long, a long"), path)[0] == 1
    version, rewritten = versions.merge(spark.createDataFrame([(3, -2, "x")], "k long, a long, b string"), path)
    assert (version, rewritten) == (2, 1) and before <= set(glob.glob(f"{path}/data/*/*/*.parquet"))
    want = {k: 2 * k for k in range(200)}
    assert rows_of(versions.read(spark, path, 0)) == sorted(want.items())
    assert rows_of(versions.read(spark, path, 1)) == sorted((want | {3: -1, 500: 7}).items())
    now = {r.k: (r.a, r.b) for r in versions.read(spark, path).collect()}
    assert now == {k: (a, None) for k, a in (want | {500: 7}).items()} | {3: (-2, "x")}


def test_failed_merges_leave_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.create(spark.createDataFrame([(1, 1), (2, 2)], "k long, a long"), path, ["k"], 4)
    bad = spark.createDataFrame([(1, 5)], "k long, a long").withColumn("a", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        versions.merge(bad, path)
    assert versions.versions(spark, path) == [0] and rows_of(versions.read(spark, path)) == [(1, 1), (2, 2)]
    nothing = spark.createDataFrame([], "k long, a long")
    assert versions.merge(nothing, path) == (0, 0)
    assert versions.merge(nothing, path, remove=spark.createDataFrame([(1,), (9,)], "k long"))[0] == 1
    assert rows_of(versions.read(spark, path)) == [(2, 2)]
    empty = str(tmp_path / "e")
    versions.create(nothing, empty, ["k"], 4)
    assert versions.read(spark, empty).count() == 0
    versions.merge(spark.createDataFrame([(7, 7)], "k long, a long"), empty)
    assert rows_of(versions.read(spark, empty)) == [(7, 7)]


def test_answered_prompts_are_not_asked_again(spark, tmp_path):
    calls, broken = str(tmp_path / "calls"), str(tmp_path / "broken")
    os.makedirs(calls)
    open(broken, "w").close()

    def model(prompts):
        import os
        import uuid

        if os.path.exists(broken) and any(p.endswith("3") for p in prompts):
            raise ValueError("out of order")
        for p in prompts:
            with open(f"{calls}/{p}-{uuid.uuid4().hex}", "w"):
                pass
        return [p.upper() for p in prompts]

    frame = spark.createDataFrame([(i, f"p{i % 40}" if i % 9 else None) for i in range(120)], "id long, prompt string")
    options = {"batch": 4, "retries": 0, "pause": 0.0, "error": "why"}
    path = str(tmp_path / "replies")
    first = inference.run_model_once(frame, model, path, "m", **options).collect()
    assert {r.prompt for r in first if r.why} == {f"p{i}" for i in (3, 13, 23, 33)}
    assert all(r.reply == "" for r in first if r.why) and all(r.reply is None for r in first if r.prompt is None)
    os.remove(broken)
    again = inference.run_model_once(frame, model, path, "m", **options).collect()
    assert len(again) == 120 and all(r.why is None and r.reply == (r.prompt and r.prompt.upper()) for r in again)
    asked = [os.path.basename(f).rsplit("-", 1)[0] for f in glob.glob(f"{calls}/*")]
    assert sorted(asked) == sorted(f"p{i}" for i in range(40))
    inference.run_model_once(frame, model, path, "other", **options).count()
    assert len(glob.glob(f"{calls}/*")) == 80
