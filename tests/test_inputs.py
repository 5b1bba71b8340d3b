"""Supplied tables as streams and as appended files."""

import glob

from pyspark.sql import functions as F

from catalog.inputs import Inputs
from graphloom.sources import store


def test_a_stream_reads_a_file_and_a_folder(spark, tmp_path):
    rows = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    rows.repartition(3).write.parquet(str(tmp_path / "folder" / "documents.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    (tmp_path / "file").mkdir()
    (part,) = glob.glob(str(tmp_path / "one" / "part-*.parquet"))
    (tmp_path / "file" / "documents.parquet").write_bytes(open(part, "rb").read())
    rows.coalesce(1).write.parquet(str(tmp_path / "file" / "events.parquet"))  # another table beside it
    for kind in ("folder", "file"):
        out = str(tmp_path / f"out-{kind}")
        stream = Inputs(spark, str(tmp_path / kind)).stream("documents")
        written = stream.writeStream.option("checkpointLocation", f"{out}-state").trigger(availableNow=True)
        written.format("parquet").start(out).awaitTermination()
        assert sorted(r.doc_id for r in spark.read.parquet(out).collect()) == list(range(40))


def test_an_append_writes_files_by_size_not_by_tenant(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(0, 4_000, 1, 16).select(F.when(F.col("id") % 2 == 0, F.col("id") % 1_000).alias("user_id"), "id")
    store.append(rows, path)
    store.append(rows.where("id < 100"), path)
    assert 2 <= len(glob.glob(f"{path}/**/part-*", recursive=True)) <= 40
    back = spark.read.parquet(path)
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect() + rows.where("id < 100").collect()))
    assert back.where("user_id = 998").count() == 4


def test_supplier_files_are_written_by_many_tasks_and_whole(spark, tmp_path, monkeypatch):
    from catalog import text

    monkeypatch.setattr(text, "_folder", lambda i: str(tmp_path / "files"))
    rows = [(k, f"S{k}", k % 25) for k in range(60)] + [(59, "S59", 59 % 25), (60, None, 4)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int").coalesce(1).write.parquet(str(tmp_path / "sf" / "supplier.parquet"))
    got = text.text_files(Inputs(spark, str(tmp_path / "sf"))).collect()
    said = [f"supplier S{k}\nin nation {k % 25}\n" for k in range(60)]
    # A supplier that comes twice is one file; one without a name has an empty line.
    assert sorted(r.text for r in got) == sorted([*said[:59], said[59] * 2, "\n"])
    assert {r.file_type for r in got} == {"TXT"}
    tasks = {p.rsplit("part-", 1)[1][:5] for p in glob.glob(str(tmp_path / "files" / "**" / "part-*"), recursive=True)}
    assert len(tasks) > 4
    assert not glob.glob(str(tmp_path / "files" / "s_suppkey=*"))
