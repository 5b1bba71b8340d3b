"""Kept states against rebuilds, and a stream that links to current documents only."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from graphloom.functions.encoders import HashingEncoder
from graphloom.operators import graph, revision

SCHEMA = "doc_id string, node_id string, type string, n_sources long"


def test_any_changes_equal_a_rebuild(spark):
    rng = random.Random(4)
    key = lambda: f"k{int(rng.expovariate(0.4))}"

    def document(d, version):
        return [(f"d{d:03d}", k, f"t{version}", rng.randrange(9)) for k in sorted({key() for _ in range(4)})]

    live = {d: document(d, 0) for d in range(40)}
    state = revision.start(spark.createDataFrame([r for rows in live.values() for r in rows], SCHEMA), ["node_id"])
    for version in range(1, 7):
        gone = rng.sample(range(60), 9)
        if version in (2, 4):
            gone = sorted(live)[-12:]  # the last documents of most keys
        new = {d: document(d, version) for d in rng.sample(range(60), 5 if version % 2 else 0)}
        for d in gone:
            live.pop(d, None)
        live |= new
        ids = spark.createDataFrame([(f"d{d:03d}",) for d in gone], "doc_id string")
        fresh = spark.createDataFrame([r for rows in new.values() for r in rows], SCHEMA)
        state, report = revision.revise(state, ids, fresh if new else None)
        rows = [r for held in live.values() for r in held]
        want = graph.merge_documents(spark.createDataFrame(rows, SCHEMA), ["node_id"])
        columns = ["node_id", "type", "n_sources", "n_docs"]
        assert sorted(map(tuple, revision.merged(state).select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
        r = report.first()
        assert r.looked_up <= r.touched
    nothing, report = revision.revise(state)
    assert report.first().touched == 0 and nothing.counts.count() == state.counts.count()


def test_one_loss_is_answered_from_the_state(spark):
    rows = [(f"d{d}", "hub", f"t{d}", d) for d in range(9)]
    state = revision.start(spark.createDataFrame(rows, SCHEMA), ["node_id"])
    for lost, looked_up in (("d8", 0), ("d3", 0), ("d7", 1)):
        state, report = revision.revise(state, spark.createDataFrame([(lost,)], "doc_id string"))
        assert report.first().looked_up == looked_up
    (r,) = revision.merged(state).collect()
    assert (r.type, r.n_docs) == ("t6", 6)


def test_stream_links_to_current_versions(spark, tmp_path):
    from catalog.ingestion import SETTINGS, name_model
    from graphloom.streaming import documents

    schema = "doc_id string, text string, file_path string"
    out, source = str(tmp_path / "out"), str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(source)
    texts = [
        [("a", "Alphabeta leads."), ("b", "Gammadelta stays.")],
        [("a", "Something else entirely.")],  # Alphabeta is said by no document any more
        [("c", "Alphabetas and Gammadeltas meet.")],
    ]
    for batch in texts:
        frame = spark.createDataFrame([(d, t, f"{d}.txt") for d, t in batch], schema)
        frame.coalesce(1).write.mode("append").parquet(source)
        documents.ingest_stream(stream, out, name_model, HashingEncoder(8), SETTINGS).awaitTermination()
    names = {r.entity_name for r in documents.read_table(spark, out, "entities").where("doc_id = 'c'").collect()}
    assert "Alphabetas" in names and "Gammadelta" in names and "Alphabeta" not in names
    stored = documents.numbered_vectors(spark, out)
    ids = sorted(r.idx for r in stored.select("idx").collect())
    assert ids == list(range(len(ids)))
    assert stored.where("doc_id = 'a' AND NOT deleted").select(F.countDistinct("doc_id")).first()[0] == 1
