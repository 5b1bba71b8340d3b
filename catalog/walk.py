"""GRF10–GRF17: edge importance, seeds, neighbours, context scores, subgraphs, paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query
from catalog.graph import NODES, PAIR, edge_sql
from catalog.inputs import DERIVED, with_
from graphloom.operators import graph as g
from graphloom.operators import traverse as t
from graphloom.session import cut

# The part graph with its surroundings: nation → supplier → part and supplier → nation.
DERIVED["fx_walk"] = """
    SELECT doc_id, ord, source_id, target_id, keywords, description, weight, chunk_id FROM fx_relationships
    UNION ALL
    SELECT 'd0', 3000000000 + s_suppkey, n_name, s_name, 'location', concat('nation of the supplier ', s_name, ' and of others, by address'), 2.0, concat('n', s_suppkey)
    FROM supplier JOIN nation ON s_nationkey = n_nationkey
    UNION ALL
    SELECT 'd0', 4000000000 + s_suppkey, s_name, n_name, 'address, location', 'based in the nation', 9.0, concat('n', s_suppkey)
    FROM supplier JOIN nation ON s_nationkey = n_nationkey"""
DERIVED["fx_walk_entities"] = """
    SELECT doc_id, ord, entity_name, entity_type, description, chunk_id FROM fx_entities
    UNION ALL
    SELECT 'd0', 5000000000 + n_nationkey, n_name, 'location', concat('nation in region ', n_regionkey), concat('n', n_nationkey) FROM nation"""
# One question per nation, about the nation and all of its suppliers.
DERIVED["fx_seeds"] = """
    SELECT n_name AS qid, n_name AS seed FROM nation
    UNION ALL SELECT n_name, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey"""

IMPORTANCE = """
    scored AS (SELECT source_id, target_id, strength,
        strength * CASE WHEN length(description) > 50 THEN 1.2::DOUBLE WHEN length(description) > 20 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END
                 * CASE WHEN n_keywords >= 3 THEN 1.15::DOUBLE WHEN n_keywords >= 2 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END AS importance
        FROM edges)"""
WALK = f"{edge_sql('fx_walk', PAIR, 'avg')}, {IMPORTANCE}"


def walk_edges(i):
    """Scored edges; importance is rounded so that both engines rank ties alike."""
    edges = t.edge_scores(g.summarised_edges(i.fx_walk, strength="avg"))
    return cut(edges.withColumn("importance", F.round("importance", 6)))


@query("grf10_edge_importance", with_(f"""WITH {edge_sql('fx_relationships', PAIR, 'sum')}, {IMPORTANCE},
    hits AS (SELECT source_id, target_id, count(*) AS matches FROM ekw
             WHERE contains(lower(keyword), 'econ') OR contains('econ', lower(keyword)) OR contains(lower(keyword), 'brand#1')
                OR contains('brand#1', lower(keyword)) GROUP BY ALL)
    SELECT source_id AS source, target_id AS target, round(importance * (1 + 0.2::DOUBLE * coalesce(matches, 0)), 6) AS importance
    FROM scored LEFT JOIN hits USING (source_id, target_id)"""))
def edge_importance(i):
    rels = i.fx_relationships
    scored = t.edge_scores(g.summarised_edges(rels, strength="sum"), g.edge_keywords(rels), ["Econ", "brand#1", ""])
    return scored.select("source", "target", F.round("importance", 6).alias("importance"))


ASKED = """
    SELECT DISTINCT split_part(p_name, ' ', 2) AS qid, split_part(p_name, ' ', 2) AS entity FROM part
    UNION ALL SELECT DISTINCT p_brand, concat('A ', p_name, ' of ', p_brand) FROM part
    UNION ALL SELECT n_name, 'r' FROM nation"""


@query("grf11_seeds", with_(f"""WITH asked AS ({ASKED}), n AS (SELECT DISTINCT entity_name AS seed FROM fx_entities)
    SELECT DISTINCT qid, seed FROM asked JOIN n ON contains(lower(seed), lower(entity)) OR contains(lower(entity), lower(seed))"""))
def seeds(i):
    nodes = i.fx_entities.select(F.col("entity_name").alias("node_id")).distinct()
    return t.find_seeds(i.sql(ASKED), nodes)


HOPS = f"""WITH {WALK},
    e AS (SELECT source_id AS source, target_id AS target, strength, round(importance, 6) AS importance FROM scored),
    h1 AS (SELECT s.qid, s.seed, e.source AS via, e.target, e.strength, e.importance,
                  row_number() OVER (PARTITION BY s.qid, s.seed ORDER BY importance DESC, target, source) AS place
           FROM fx_seeds s JOIN e ON e.source = s.seed
           WHERE e.strength >= 1 AND NOT EXISTS (SELECT 1 FROM fx_seeds x WHERE x.qid = s.qid AND x.seed = e.target AND x.seed < s.seed)
           QUALIFY place <= 5),
    h2 AS (SELECT h.qid, h.seed, e.source AS via, e.target, e.strength, e.importance,
                  row_number() OVER (PARTITION BY h.qid, h.seed ORDER BY e.importance DESC, e.target, e.source) AS place2
           FROM h1 h JOIN e ON e.source = h.target
           WHERE e.target <> h.seed AND NOT EXISTS (SELECT 1 FROM fx_seeds x WHERE x.qid = h.qid AND x.seed = e.target AND x.seed < h.seed)
           QUALIFY place2 <= 5),
    both_hops AS (SELECT *, 1 AS hop FROM h1 UNION ALL SELECT *, 2 FROM h2)"""


def found(i, hops):
    return t.neighbours(i.fx_seeds, walk_edges(i), hops, 5, 1.0)


def _shown(df):
    return df.withColumns({"strength": F.round("strength", 6), "importance": F.round("importance", 6), "place": F.col("place").cast("long")})


@query("grf12_neighbours", with_(f"""{HOPS} SELECT qid, seed, 1 AS hop, place, via, target, round(strength, 6) AS strength, importance FROM h1"""))
def neighbours(i):
    return _shown(found(i, 1))


@query("grf13_second_hop", with_(f"""{HOPS} SELECT qid, seed, hop, place, via, target, round(strength, 6) AS strength, importance FROM both_hops"""))
def second_hop(i):
    return _shown(found(i, 2))


@query("grf14_graph_context", with_(f"""{HOPS}, {NODES.replace('fx_entities', 'fx_walk_entities')},
    sums AS (SELECT qid, seed, avg(importance) FILTER (WHERE hop = 1) AS average, count(*) FILTER (WHERE hop = 1) AS n_relationships, count(*) AS n_neighbours
             FROM both_hops GROUP BY ALL)
    SELECT qid, seed, type, description, coalesce(n_relationships, 0) AS n_relationships, coalesce(n_neighbours, 0) AS n_neighbours,
           round(least(1.0::DOUBLE, coalesce(average * (n_neighbours / 10.0::DOUBLE), 0)), 6) AS score
    FROM fx_seeds s JOIN nodes n ON n.node_id = s.seed LEFT JOIN sums USING (qid, seed)"""))
def graph_context(i):
    df = t.contexts(i.fx_seeds, g.summarised_nodes(i.fx_walk_entities), found(i, 2))
    return df.withColumn("score", F.round("score", 6))


TREE_NODES = "SELECT DISTINCT unnest([source, target]) AS node_id FROM fx_tree"
REACH = """WITH RECURSIVE reach AS (
        SELECT r_name AS qid, r_name AS node_id, 0 AS hop FROM region
        UNION SELECT qid, target, hop + 1 FROM reach JOIN fx_tree ON source = node_id WHERE hop < 2),
    r AS (SELECT DISTINCT qid, node_id FROM reach)"""


def _tree_nodes(i):
    return i.fx_tree.select(F.explode(F.array("source", "target")).alias("node_id")).distinct()


def _subgraph(i):
    starts = i.region.select(F.col("r_name").alias("qid"), F.col("r_name").alias("node_id"))
    return t.subgraph(starts, _tree_nodes(i), i.fx_tree, radius=2)


@query("grf15_subgraph_nodes", with_(f"{REACH} SELECT qid, node_id FROM r"))
def subgraph_nodes(i):
    return _subgraph(i)[0]


@query("grf15_subgraph_edges", with_(f"""{REACH} SELECT a.qid, f.source, f.target FROM fx_tree f
    JOIN r a ON a.node_id = f.source JOIN r b ON b.node_id = f.target AND b.qid = a.qid"""))
def subgraph_edges(i):
    return _subgraph(i)[1]


# One question per region that starts at the region, then at each of its nations.
STARTS = """SELECT r_name AS qid, 0 AS ord, r_name AS start FROM region
    UNION ALL SELECT r_name, 1 + n_nationkey, n_name FROM region JOIN nation ON r_regionkey = n_regionkey"""


@query("grf16_paths", with_(f"""WITH RECURSIVE starts AS ({STARTS}),
    adj AS (SELECT DISTINCT source, target FROM (SELECT source, target FROM fx_tree UNION ALL SELECT DISTINCT source_id, target_id FROM fx_walk)),
    walk AS (SELECT qid, ord, start, start AS node, [start] AS path FROM starts
             UNION ALL SELECT qid, ord, start, target, list_append(path, target) FROM walk JOIN adj ON source = node
             WHERE len(path) < 4 AND NOT list_contains(path, target)),
    first AS (SELECT qid, ord, start, node, arg_min(path, (len(path), path)) AS path FROM walk WHERE len(path) > 1 GROUP BY ALL),
    five AS (SELECT *, row_number() OVER (PARTITION BY qid, ord, start ORDER BY len(path), path) AS p FROM first QUALIFY p <= 5)
    SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY ord, len(path), path) AS INTEGER) AS place, start,
           array_to_string(path, ' → ') AS path, CAST(len(path) AS INTEGER) AS length
    FROM five QUALIFY place <= 5"""))
def paths(i):
    edges = i.fx_tree.select("source", "target").union(i.fx_walk.select("source_id", "target_id"))
    return t.paths(i.sql(STARTS), edges).withColumn("path", F.array_join("path", " → "))


@query("grf17_neighbourhood", with_("""
    WITH u AS (SELECT source AS a, target AS b FROM fx_tree UNION SELECT target, source FROM fx_tree),
    hops AS (SELECT n_name AS qid, n_name AS node_id, 0 AS hop FROM nation
             UNION ALL SELECT n_name, b, 1 FROM nation JOIN u ON a = n_name
             UNION ALL SELECT n_name, v.b, 2 FROM nation JOIN u ON u.a = n_name JOIN u v ON v.a = u.b)
    SELECT qid, node_id, CAST(min(hop) AS INTEGER) AS hop FROM hops GROUP BY ALL"""))
def neighbourhood(i):
    chosen = i.nation.select(F.col("n_name").alias("qid"), F.col("n_name").alias("node_id"))
    return t.neighbourhood(chosen, i.fx_tree)
