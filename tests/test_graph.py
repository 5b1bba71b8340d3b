"""Graph tables and walks: hand-worked numbers and properties."""

from pyspark.sql import functions as F

from graphloom.operators import graph as g
from graphloom.operators import traverse as t

REL = "doc_id string, ord int, source_id string, target_id string, keywords string, description string, weight double, chunk_id string"
ENT = "doc_id string, ord int, entity_name string, entity_type string, description string, chunk_id string"


def rels(spark, *pairs):
    rows = [("d", k, a, b, kw, "text", w, f"c{k}") for k, (a, b, w, kw) in enumerate(pairs)]
    return spark.createDataFrame(rows, REL)


def chain(spark, names):
    return spark.createDataFrame(list(zip(names, names[1:])), "source string, target string")


def test_strength_is_summed_or_averaged(spark):
    r = rels(spark, ("A", "B", 1.0, "x, y"), ("A", "B", 3.0, "y,,z "))
    assert g.build_edges(r).first()["strength"] == 4.0
    row = g.summarised_edges(r, strength="avg").first()
    assert (row["strength"], row["n_keywords"], row["n_chunks"], row["description"]) == (2.0, 3, 2, "text")
    assert g.build_edges(r).first()["n_descriptions"] == 1
    assert sorted(x["keyword"] for x in g.edge_keywords(r).collect()) == ["x", "y", "z"]


def test_statistics(spark):
    nodes = spark.createDataFrame([("A",), ("B",), ("C",)], "node_id string")
    row = g.statistics(nodes, chain(spark, "ABC")).first()
    assert abs(row["avg_degree"] - 4 / 3) < 1e-12 and abs(row["density"] - 1 / 3) < 1e-12
    assert g.statistics(nodes.limit(1), chain(spark, "AB").limit(0)).first()["density"] == 0


def test_deleting_a_document(spark):
    links = spark.createDataFrame([("n1", "d1"), ("n1", "d2"), ("n2", "d1"), ("n3", "d2")], "node_id string, doc_id string")
    left, fate = g.shrink_links(links, ["node_id"], spark.createDataFrame([("d1",)], "doc_id string"))
    assert {tuple(r) for r in fate.collect()} == {("n1", "updated"), ("n2", "deleted")}
    assert {tuple(r) for r in left.select("node_id", "doc_id").collect()} == {("n1", "d2"), ("n3", "d2")}


def test_delete_then_rebuild_equals_never_inserted(spark):
    rows = [(f"d{k % 3}", k, f"E{k % 5}", "t", f"text {k % 4}", f"c{k}") for k in range(30)]
    ents = spark.createDataFrame(rows, ENT)
    one = spark.createDataFrame([("d1",)], "doc_id string")
    kept = ents.join(one, "doc_id", "left_anti")
    synced = g.sync_nodes(ents).join(one, "doc_id", "left_anti")
    assert sorted(map(str, g.merge_documents(synced, ["node_id"]).collect())) == sorted(map(str, g.rebuild_nodes(kept).collect()))


def test_edge_importance(spark):
    edges = spark.createDataFrame(
        [("a", "b", 1.0, "x" * 60, 3), ("c", "d", 2.0, "x" * 30, 2), ("e", "f", 1.0, "x" * 10, 0)],
        "source string, target string, strength double, description string, n_keywords int")
    kw = spark.createDataFrame([("c", "d", "a"), ("c", "d", "b")], "source string, target string, keyword string")
    plain = {r["source"]: r["importance"] for r in t.edge_scores(edges).collect()}
    assert [round(plain[s], 9) for s in "ace"] == [1.38, 2.42, 1.0]
    asked = {r["source"]: r["importance"] for r in t.edge_scores(edges, kw, ["A", ""]).collect()}
    assert [round(asked[s], 9) for s in "ace"] == [1.38, 2.904, 1.0]


def test_context_score(spark):
    seeds = spark.createDataFrame([("q", "s")], "qid string, seed string")
    nodes = spark.createDataFrame([("s", "t", "d")], "node_id string, type string, description string")

    def score(extra):
        found = [("q", "s", 1, 1, 1.38), ("q", "s", 1, 2, 2.42)] + [("q", "s", 2, k, 9.0) for k in range(extra)]
        df = spark.createDataFrame(found, "qid string, seed string, hop int, place int, importance double")
        return round(t.contexts(seeds, nodes, df).first()["score"], 9)

    assert (score(2), score(4)) == (0.76, 1.0)
    none = spark.createDataFrame([], "qid string, seed string, hop int, place int, importance double")
    assert t.contexts(seeds, nodes, none).first()["score"] == 0.0


def test_subgraph(spark):
    nodes = spark.createDataFrame([(n,) for n in "ABCD"], "node_id string")
    start = spark.createDataFrame([("q", "A")], "qid string, node_id string")
    for radius, names, links in ((0, "A", 0), (1, "AB", 1), (2, "ABC", 2)):
        reached, inside = t.subgraph(start, nodes, chain(spark, "ABCD"), radius)
        assert sorted(r["node_id"] for r in reached.collect()) == list(names) and inside.count() == links


def breadth_first(adj, start, hops, most):
    """Plain search with neighbours in name order."""
    queue, seen, out = [[start]], {start}, []
    for path in queue:
        if len(path) <= hops:
            for n in sorted(adj.get(path[-1], ())):
                if n not in seen:
                    seen.add(n)
                    queue.append([*path, n])
                    out.append([*path, n])
    return out[:most]


def test_paths(spark):
    start = spark.createDataFrame([("q", 0, "A")], "qid string, ord int, start string")
    got = [r["path"] for r in t.paths(start, chain(spark, "ABCDE")).orderBy("place").collect()]
    assert got == [list("AB"), list("ABC"), list("ABCD")]


def test_paths_match_a_plain_search(spark):
    import random
    r = random.Random(4)
    pairs = {(f"n{r.randrange(40)}", f"n{r.randrange(40)}") for _ in range(55)} | {("n0", f"h{k}") for k in range(30)}
    adj = {}
    for a, b in pairs:
        if a != b:
            adj.setdefault(a, set()).add(b)
    edges = spark.createDataFrame(sorted(pairs), "source string, target string")
    starts = [(f"q{k}", 0, f"n{k}") for k in range(40)]
    got = {}
    for row in t.paths(spark.createDataFrame(starts, "qid string, ord int, start string"), edges).orderBy("place").collect():
        got.setdefault(row["qid"], []).append(row["path"])
    assert got == {q: p for q, _, s in starts if (p := breadth_first(adj, s, 3, 5))}


def test_view_subset_bounds(spark):
    nodes = spark.range(10).select(F.col("id").cast("string").alias("node_id"), F.lit("t").alias("type"))
    edges = spark.range(9).select(F.col("id").cast("string").alias("source"), (F.col("id") + 1).cast("string").alias("target"), F.col("id").cast("double").alias("strength"))
    shown, inside = g.view_subset(nodes, edges, edges.select("source", "target", F.lit("k").alias("keyword")), 4, None, ["k"], 1.0)
    assert shown.count() == 4 and sorted(r["source"] for r in inside.collect()) == ["1", "2"]


def test_descriptions_are_whole_in_the_link_table(spark):
    rows = [("A", "t", f"text {k} " + "x" * 300, "c", k) for k in range(5)] * 2
    entities = spark.createDataFrame(rows, "entity_name string, entity_type string, description string, chunk_id string, ord long")
    said = g.node_descriptions(entities).collect()
    assert {r["description"] for r in said} == {r[2] for r in rows} and g.build_nodes(entities).first()["n_descriptions"] == 5
    assert len(g.summarised_nodes(entities).first()["description"]) == g.DESCRIPTION_CHARS


def test_rows_without_a_user_survive_a_tenant(spark):
    table = spark.createDataFrame([("7",), ("8",), (None,)], "user_id string")
    out = g.delete_tenant({"t": table}, "7")
    assert {r["user_id"] for r in out["t"].collect()} == {"8", None} and out["report"].first()["n"] == 1


def test_edges_are_dealt_once(spark):
    """Counts and text of an edge are made where its relationships are; an edge without a name at one end counts nothing but chunks."""
    rows = [(1, "d", "a", "b", "x, y", "one", 2.0, "c1"), (2, "d", "a", "b", "y", "two", None, "c2"), (3, "d", "a", "b", "", "one", 3.0, "c1"),
            (None, "d", "a", "b", None, "nought", 2.0, None), (5, "d", None, "b", "x", "lost", 1.0, "c1")]
    r = spark.createDataFrame(
        rows, "ord long, doc_id string, source_id string, target_id string, keywords string, description string, weight double, chunk_id string")
    got = {x["source"]: tuple(x)[3:] for x in g.sync_edges(r).collect()}
    assert got == {"a": ("nought; one; two", 2.0, 2, 2), None: ("", 1.0, 0, 1)}
    built = {x["source"]: tuple(x)[2:] for x in g.build_edges(r).collect()}
    assert built == {"a": (8.0, 2, 3, 2), None: (1.0, 0, 0, 1)}
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert shuffles(g.sync_edges(r)) == 2 and shuffles(g.build_edges(r)) == 1
