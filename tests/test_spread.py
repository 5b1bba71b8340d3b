"""Numbering, hot keys and bounded windows against plain forms."""

import os

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.operators import spread
from graphloom.session import kept


def test_dense_index(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = [(r["k"], r["idx"]) for r in spread.dense_index(df, ["k"], "idx", 5).collect()]
    assert sorted(got) == [(k, k + 5) for k in range(1000)]


def test_join_lookup_equals_join(spark):
    left = spark.range(500).select("id", F.when(F.col("id") < 300, 0).otherwise(F.col("id") % 7).alias("k"))
    right = spark.range(5).select(F.col("id").cast("int").alias("k"), (F.col("id") * 10).alias("v"))
    for how in ("inner", "left"):
        got = sorted(map(str, spread.join_lookup(left, right, ["k"], how).select("id", "k", "v").collect()))
        assert got == sorted(map(str, left.join(right, "k", how).select("id", "k", "v").collect()))


def test_hot_key_is_split_and_maps_are_allowed(spark):
    """One key with most rows: adaptive execution cuts it, because nothing but the join shuffles."""
    sizes = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k) for k in sizes}
    try:
        for k, v in sizes.items():
            spark.conf.set(k, v)
        rows = spark.range(0, 200_000, 1, 8).select(
            F.when(F.col("id") % 10 < 8, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), "id",
            F.create_map(F.lit("a"), F.col("id")).alias("m"),
        )
        names = spark.range(1).select(F.lit("hot").alias("k"), F.lit(1).alias("v")).union(spark.range(1000).select(F.col("id").cast("string"), F.lit(2)))
        joined = spread.join_lookup(rows, names, ["k"])
        assert joined.count() == 160_000 + 200
        joined.select("id", "v").write.format("noop").mode("overwrite").save()
        done = joined.select("id", "v")
        done.collect()
        assert "skew=true" in done._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def conversations(spark):
    return spark.range(400).select(
        F.when(F.col("id") < 250, 1).otherwise(F.col("id") % 9 + 2).alias("c"),
        F.col("id").alias("t"),
        F.when(F.col("id") % 11 == 0, F.concat(F.lit("u"), "id")).alias("u"),
    )


def test_segments_see_over_their_borders(spark):
    df = conversations(spark)
    w = Window.partitionBy("c").orderBy("t").rowsBetween(-3, -1)
    want = {(r["c"], r["t"]): r["h"] for r in df.withColumn("h", F.collect_list("t").over(w)).collect()}
    w = Window.partitionBy("seg", "c").orderBy("pos").rowsBetween(-3, -1)
    cut_up = spread.segments(df, ["c"], ["t"], 3, segment_rows=8)
    got = cut_up.withColumn("h", F.collect_list("t").over(w)).where("NOT halo")
    assert {(r["c"], r["t"]): r["h"] for r in got.collect()} == want
    assert cut_up.groupBy("seg", "c").count().agg(F.max("count")).first()[0] <= 11


def test_running_last_goes_back_any_distance(spark, monkeypatch):
    monkeypatch.setattr(spread, "SEGMENT_ROWS", 5)
    df = conversations(spark)
    w = Window.partitionBy("c").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    want = {(r["c"], r["t"]): r["l"] for r in df.withColumn("l", F.last("u", True).over(w)).collect()}
    got = {(r["c"], r["t"]): r["l"] for r in spread.running_last(df, ["c"], ["t"], F.col("u"), "l").collect()}
    assert got == want


def test_kept_tables_are_whole_and_compressed(spark):
    """Tables with texts are written in compressed columns, of the same rows and types; those without a type are cut."""
    rows = [(i, f"text {i % 5} " * 200, [i, None], None if i % 3 else {"a": i}) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, t string, l array<long>, m map<string,long>").repartition(3)
    out = kept(df)
    files = out.inputFiles()
    assert files and all(f.endswith(".zstd.parquet") for f in files)
    assert out.schema == df.schema and sorted(map(str, out.collect())) == sorted(map(str, df.collect()))
    assert sum(os.path.getsize(f.split("file:")[1].replace("///", "/")) for f in files) < 50_000
    assert kept(df.withColumn("none", F.lit(None))).count() == 500 and kept(df.limit(0)).count() == 0
    assert all(f.endswith(".zstd.parquet") for f in spread.dense_index(df, ["id"]).inputFiles())
