"""Vectors, questions, retrieval, dialogue, feedback, streams and the registry."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.functions import questions as q
from graphloom.functions.encoders import HashingEncoder
from graphloom.operators import dialogue as d
from graphloom.operators import feedback as f
from graphloom.operators import inference
from graphloom.operators import retrieval as r
from graphloom.operators import vectors as v


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8)).round(3)
    x[100:200] = x[100]  # a quarter are copies
    rows = [(k, f"d{k % 5}", "CHUNK", k % 9 == 0, row.tolist()) for k, row in enumerate(x)]
    store = spark.createDataFrame(rows, "idx long, doc_id string, entity_type string, deleted boolean, embedding array<double>")
    return x, store, store.where("idx < 30 OR idx = 150").select(F.col("idx").alias("qid"), "embedding")


@pytest.mark.parametrize("block", [4096, 7])
def test_nearest_is_exact_in_any_block_size(cloud, block):
    x, store, queries = cloud
    got = {}
    for row in v.nearest(store, queries, 6, block).orderBy("place").collect():
        got.setdefault(row["qid"], []).append(row["idx"])
    for n in [*range(30), 150]:
        gaps = ((x - x[n]) ** 2).sum(axis=1)
        assert got[n] == np.lexsort((np.arange(400), gaps))[:6].tolist()


def test_filtered_search_and_cells(cloud):
    x, store, queries = cloud
    rows = v.search(store, queries, 5, documents=["d1"]).collect()
    assert len(rows) == 31 * 5 and {n["idx"] % 5 for n in rows} == {1} and all(n["idx"] % 9 for n in rows)
    cells, centres = v.build_cells(store, 8)
    exact = {(n["qid"], n["idx"]) for n in v.nearest(store, queries, 5).collect()}
    near = {(n["qid"], n["idx"]) for n in v.nearest_in_cells(cells, centres, queries, 5, probes=4).collect()}
    assert len(exact & near) / len(exact) > 0.8
    assert {(n["qid"], n["idx"]) for n in v.nearest_in_cells(cells, centres, queries, 5, probes=8).collect()} == exact


def test_store_upkeep(spark):
    store = spark.range(10).select(F.col("id").alias("idx"), F.concat(F.lit("d"), F.floor(F.col("id") / 2)).alias("doc_id"), F.lit(False).alias("deleted"))
    docs = lambda *n: spark.createDataFrame([(x,) for x in n], "doc_id string")
    assert not v.statistics(v.soft_delete(store, docs("d0")), 8).first()["needs_rebuild"]
    gone = v.soft_delete(store, docs("d0", "d3"))
    assert v.statistics(gone, 8).first()["needs_rebuild"]
    new, report = v.compact(gone)
    assert sorted(n["idx"] for n in new.collect()) == list(range(6)) and tuple(report.first()) == (10, 6, 4)
    more = v.append_vectors(store, docs("x", "y").withColumn("order", F.lit(1)))
    assert sorted(n["idx"] for n in more.collect()) == list(range(12))


def test_encode_gives_unit_vectors(spark):
    rows = inference.encode(spark.createDataFrame([("a b c",), ("",)], "text string"), HashingEncoder(16)).collect()
    assert abs(sum(x * x for x in rows[0]["embedding"]) - 1) < 1e-6 and not any(rows[1]["embedding"])


def test_model_failures_are_retried_and_isolated(spark):
    def model(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("no")
        return [p.upper() for p in prompts]

    df = spark.createDataFrame([("a",), ("bad",), (None,), ("c",)], "prompt string").coalesce(1)
    got = [x["reply"] for x in inference.run_model(df, model, pause=0.0).collect()]
    assert got == ["A", "", None, "C"]


def test_models_see_small_parts_of_a_large_batch(spark):
    # What a worker made for a batch of Arrow was as large as the batch; now its replies go on after some prompts.
    df = spark.range(3_000).coalesce(1).select(F.when(F.col("id") % 7 > 0, F.concat(F.lit("p"), "id")).alias("prompt"), "id")
    parts = inference.run_model(df, lambda prompts: [p.upper() for p in prompts], batch=4, parallel=8, error="why")
    told = parts.collect()
    assert [(r.id, r.reply, r.why) for r in told] == [(k, f"P{k}" if k % 7 else None, None) for k in range(3_000)]
    seen = []
    for rows in inference._slices(iter([pa.RecordBatch.from_pydict({"t": ["x" * 1_000] * 100})]), 30):
        seen.append(rows.num_rows)
    assert seen == [30, 30, 30, 10]
    long = pa.RecordBatch.from_pydict({"t": ["x" * inference.SLICE_BYTES] * 3})
    assert [r.num_rows for r in inference._slices(iter([long]), 30)] == [1, 1, 1]
    vectors = inference.encode(df, HashingEncoder(8), "prompt").collect()
    assert [r.id for r in vectors] == list(range(3_000)) and all(len(r.embedding) == 8 for r in vectors)


def test_gleaning_asks_only_open_answers(spark):
    def model(prompts):
        return ["more <|COMPLETE|>" if p.startswith("Some records") else ("done <|COMPLETE|>" if "short" in p else "open") for p in prompts]

    df = spark.createDataFrame([("1", "short"), ("2", "long")], "chunk_id string, content string")
    got = {x["chunk_id"]: x["result"] for x in inference.extract_records(df, model).collect()}
    assert got == {"1": "done <|COMPLETE|>", "2": "open\nmore <|COMPLETE|>"}


def test_summaries_see_every_description(spark):
    listed = spark.range(120).select(F.lit("k").alias("key"), "id", F.col("id").alias("ord"), F.concat(F.lit("<"), "id", F.lit(">")).alias("description")).drop("id")
    merged = spark.createDataFrame([("k", "joined", 120), ("few", "two", 2)], "key string, description string, n_descriptions long")

    def model(prompts):
        import re
        return [" ".join(re.findall(r"<\d+>", p)) for p in prompts]

    out = {x["key"]: x["description"] for x in inference.summarise_descriptions(merged, listed, ["key"], model, 10_000).collect()}
    assert out["few"] == "two" and {f"<{n}>" for n in range(120)} == set(out["k"].split())


def test_question_analysis(spark):
    texts = ["what is better", "compare a and b", "explain it", "why", "tại sao", "hello"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [x[0] for x in df.select(q.intent(F.col("t"))).collect()] == ["fact", "comparison", "summary", "reasoning", "reasoning", "fact"]
    one = lambda text, e: spark.createDataFrame([(text,)], "t string").select(e(F.col("t"))).first()[0]
    assert one("what is the role of ai in data systems", q.keywords) == ["what", "role", "data", "systems"]
    assert one("ceo of company", q.expansions) == ["ceo of company", "chief executive officer", "president"]
    assert one("explain", q.expansions) == ["explain"]
    assert len(one("explain", lambda c: q.expansions(c, whole_words=False))) == 3


def test_question_entities(spark):
    names = spark.createDataFrame([(1, "OpenAI"), (2, "Knowledge Graph"), (3, "abc")], "ord long, entity_name string")
    asked = spark.createDataFrame([("a", "Does openai use a knowledge graphs store"), ("b", "the knowlege graph?"), ("c", "Ask Bob Smith")], "qid string, question string")
    got = {}
    for row in r.question_entities(asked, names).orderBy("qid", "place").collect():
        got.setdefault(row["qid"], []).append(row["entity"])
    assert got == {"a": ["OpenAI", "Knowledge Graph"], "b": ["Knowledge Graph"], "c": ["Ask Bob Smith"]}


def test_reranking(spark):
    hits = spark.createDataFrame([("q", "1", 0.5, "xx aa bb" + "." * 92), ("q", "2", 0.5, "aa bb" + "." * 995), ("q", "3", 0.9, "aa bb" + "." * 995)],
                                 "qid string, chunk_id string, score double, content string")
    ents = spark.createDataFrame([("q", "AA"), ("q", "bb")], "qid string, entity string")
    got = {x["chunk_id"]: (round(x["score"], 6), x["rank"]) for x in r.rerank_chunks(hits, ents).collect()}
    assert got == {"1": (0.8, 3), "2": (0.9, 2), "3": (1.0, 1)}
    ctx = spark.createDataFrame([("q", "Foo", 0.4, 1), ("p", "Foo", 0.4, 3)], "qid string, seed string, score double, n_relationships int")
    asked = spark.createDataFrame([("q", "what is foo"), ("p", "what is FOO")], "qid string, question string")
    assert {x["qid"]: round(x["score"], 6) for x in r.rerank_contexts(ctx, asked).collect()} == {"q": 0.8, "p": 0.9}


def test_history_window(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"m{k}") for k in range(6)]
    msgs = spark.createDataFrame(rows, "conversation_id int, turn int, role string, content string")
    got = {x["turn"]: [m["content"] for m in x["history"]] for x in d.history(msgs, 1).collect()}
    assert got[0] == [] and got[1] == ["m0"] and got[5] == ["m3", "m4"]
    asked = {x["turn"]: x["question"] for x in d.answered_questions(msgs).collect()}
    assert asked == {1: "m0", 3: "m2", 5: "m4"}


def test_accepting_a_rewrite(spark):
    long_ = " ".join(["w"] * 51)
    df = spark.createDataFrame([("q", ' "better" '), ("q", ""), ("q", long_)], "q string, a string")
    assert [x[0] for x in df.select(d.accept_rewrite(F.col("q"), F.col("a"))).collect()] == ["better", "q", "q"]


def test_feedback_statistics(spark):
    df = spark.createDataFrame([(5, None), (4, 3), (None, 4)], "rating int, relevancy_score int").withColumns(
        {"faithfulness_score": F.lit(None).cast("int"), "response_time_ms": F.lit(None).cast("double"), "auto_evaluated": F.lit(False)})
    row = f.statistics(df).first()
    assert (row["avg_rating"], row["avg_relevancy"], row["avg_faithfulness"]) == (4.5, 3.5, 0.0)
    assert [x["n"] for x in f.rating_histogram(df).orderBy("rating").collect()] == [0, 0, 0, 1, 1]
    assert f.satisfaction(df).first()["satisfaction"] == 90.0


def test_judgements(spark):
    replies = ['{"score": 4, "reason": "ok"}', '```json\n{"score": 5}\n```', '{"score": 7}', '{"score": 4.0}', '{"score": "4"}', "none", '{"score": 4, "reason": "a } b"}']
    score, reason = f.parse_judgement(F.col("x"))
    rows = spark.createDataFrame([(x,) for x in replies], "x string").select(score.alias("s"), reason.alias("r")).collect()
    assert [x["s"] for x in rows] == [4, 5, 3, 3, 3, 3, 3] and rows[0]["r"] == "ok" and rows[1]["r"] == f.NO_REASON


SMALL = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    from catalog.ingestion import SETTINGS, _documents, name_model
    from catalog.inputs import Inputs
    from graphloom.operators import graph
    from graphloom.plans.ingest import ingest
    from graphloom.streaming import documents

    docs = Inputs(spark, SMALL).documents.where("length(text) < 600")
    docs.repartitionByRange(2, "doc_id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    documents.ingest_stream(_documents(stream), out, name_model, HashingEncoder(8), SETTINGS, link=False).awaitTermination()
    batch = ingest(_documents(docs), name_model, HashingEncoder(8), None, SETTINGS)
    nodes, edges = documents.current_graph(spark, out)
    same = lambda a, b: sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(b.columns)).collect()))
    assert same(nodes, graph.merge_documents(batch.nodes, ["node_id"]))
    assert same(edges, graph.merge_documents(batch.edges, ["source", "target"]))
    stored = documents.numbered_vectors(spark, out)
    assert sorted(x["idx"] for x in stored.select("idx").collect()) == list(range(batch.vectors.count()))
    # A document that comes again replaces what there was of it; its new vectors are numbered on.
    first = docs.orderBy("doc_id").limit(1).withColumn("text", F.lit("Alpha meets Beta. ALPHA leaves Gamma."))
    first.write.mode("append").parquet(str(tmp_path / "in"))
    documents.ingest_stream(_documents(stream), out, name_model, HashingEncoder(8), SETTINGS, link=False).awaitTermination()
    now = docs.join(first.select("doc_id"), "doc_id", "left_anti").unionByName(first)
    again = ingest(_documents(now), name_model, HashingEncoder(8), None, SETTINGS)
    nodes, edges = documents.current_graph(spark, out)
    assert same(nodes, graph.merge_documents(again.nodes, ["node_id"]))
    assert same(edges, graph.merge_documents(again.edges, ["source", "target"]))
    stored = documents.numbered_vectors(spark, out)
    ids = sorted(x["idx"] for x in stored.select("idx").collect())
    assert ids == list(range(len(ids))) and stored.where("NOT deleted").count() == again.vectors.count()


def test_ingestion_ignores_case(spark):
    from catalog.ingestion import SETTINGS
    from graphloom.functions.encoders import HashingEncoder
    from graphloom.plans.ingest import ingest

    def model(prompts):
        line = "entity<|#|>{}<|#|>concept<|#|>{} of the text<|#|>4"
        out = [line.format("Alpha", "beginning"), line.format("ALPHA", "first part"), line.format("beta", "second part")]
        out += ["relation<|#|>alpha<|#|>BETA<|#|>next<|#|>one and two", "relation<|#|>Alpha<|#|>Beta<|#|>next<|#|>one and two", "relation<|#|>Alpha<|#|>Delta<|#|>x<|#|>no such end"]
        return ["\n".join([*out, "<|COMPLETE|>"]) for _ in prompts]

    docs = spark.createDataFrame([("1", "some text", "a.txt")], "doc_id string, text string, file_path string")
    made = ingest(docs, model, HashingEncoder(8), None, SETTINGS, summary_model=lambda ps: ["short" for _ in ps])
    assert {(r.entity_name, r.n_descriptions) for r in made.entities.collect()} == {("Alpha", 2), ("beta", 1)}
    assert [(r.source_id, r.target_id, r.n_rows) for r in made.relationships.collect()] == [("Alpha", "beta", 2)]
    assert [(r.target_id, r.reason) for r in made.rejected.collect()] == [("Delta", "target missing")]
    assert {r.node_id for r in made.nodes.collect()} == {"Alpha", "beta"} and made.edges.count() == 1
    assert made.vectors.where("id LIKE 'entity%'").count() == 2


def test_registry():
    from __spark_entry__ import oracle_sql, queries

    names = queries()
    assert set(oracle_sql()) <= set(names) and len(names) > 125
    # The training-data operators are there together or not at all.
    assert len([n for n in names if n == "pipeline" or n.startswith("op")]) in (0, 14)


def test_nothing_else_imports_the_training_data_operators():
    from pathlib import Path

    import graphloom

    root = Path(graphloom.__file__).parent
    for path in [*root.rglob("*.py"), *(root.parent / "catalog").rglob("*.py")]:
        if "llm" not in path.relative_to(root.parent).parts:
            assert "llm" not in path.read_text(), path


def test_plans(spark):
    from catalog.inputs import Inputs
    from graphloom.operators import records

    i = Inputs(spark, SMALL)
    plan = records.validate_relationships(i.fx_relationships, i.fx_entities)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    picked = i.lineitem.where("l_quantity > 40").select("l_orderkey")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,40.0)]" in picked
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in picked
