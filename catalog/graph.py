"""GRF1–GRF9 and GRF18–GRF23: graph building, maintenance, statistics and browsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query
from catalog.inputs import with_
from graphloom.operators import graph as g
from graphloom.operators import revision
from graphloom.session import cut

NODES = """
    firsts AS (SELECT entity_name, description, min(ord) AS o FROM fx_entities GROUP BY ALL),
    texts AS (SELECT entity_name, left(string_agg(description, '; ' ORDER BY o), 500) AS description FROM firsts GROUP BY ALL),
    nodes AS (SELECT entity_name AS node_id, arg_min(entity_type, ord) AS type, any_value(t.description) AS description,
                     count(DISTINCT chunk_id) AS n_sources
              FROM fx_entities e JOIN texts t USING (entity_name) GROUP BY entity_name)"""


def edge_sql(rel: str, keys: str, strength: str) -> str:
    """WITH entries ending in ``edges`` for the given grouping keys."""
    return f"""
    efirsts AS (SELECT {keys}, description, min(ord) AS o FROM {rel} GROUP BY ALL),
    etexts AS (SELECT {keys}, left(string_agg(description, '; ' ORDER BY o, description), 500) AS description FROM efirsts GROUP BY ALL),
    ekw AS (SELECT DISTINCT {keys}, trim(k) AS keyword FROM (SELECT {keys}, unnest(string_split(keywords, ',')) AS k FROM {rel}) WHERE trim(k) <> ''),
    ekn AS (SELECT {keys}, count(*) AS n_keywords FROM ekw GROUP BY ALL),
    edges AS (SELECT {keys}, t.description, r.strength, n_keywords, r.n_chunks FROM
                (SELECT {keys}, {strength}(weight) AS strength, count(DISTINCT chunk_id) AS n_chunks FROM {rel} GROUP BY ALL) r
                JOIN etexts t USING ({keys}) JOIN ekn USING ({keys}))"""


LOWER_RELS = """
    rels AS (SELECT * FROM fx_relationships
             WHERE source_id IN (SELECT entity_name FROM fx_entities)
               AND target_id IN (SELECT entity_name FROM fx_entities) AND source_id <> target_id)"""

PAIR = "source_id, target_id"


@query("grf1_nodes", with_("""
    SELECT entity_name AS node_id, coalesce(arg_min(entity_type, ord) FILTER (WHERE entity_type <> ''), 'UNKNOWN') AS type,
           count(DISTINCT description) FILTER (WHERE description <> '') AS n_descriptions, count(DISTINCT chunk_id) AS n_sources
    FROM fx_entities GROUP BY entity_name"""))
def nodes(i):
    return g.build_nodes(i.fx_entities)


@query("grf1_node_descriptions", with_("""
    SELECT entity_name AS node_id, description, min(ord) AS ord FROM fx_entities WHERE description <> '' GROUP BY ALL"""))
def node_descriptions(i):
    """Whole descriptions: together far more than the short form of a node holds."""
    return g.node_descriptions(i.fx_entities)


@query("grf4_summarised_nodes", with_(f"WITH {NODES} SELECT * FROM nodes"))
def summarised_nodes(i):
    return g.summarised_nodes(i.fx_entities)


@query("grf1_node_sources", with_("SELECT DISTINCT entity_name AS node_id, chunk_id AS source FROM fx_entities"))
def node_sources(i):
    return g.node_sources(i.fx_entities)


def _connected(i):
    return g.connected(i.fx_relationships, i.fx_entities.select(F.col("entity_name").alias("node_id")))


@query("grf2_edges", with_(f"""WITH {LOWER_RELS}, {edge_sql('rels', PAIR, 'sum')}
    SELECT source_id AS source, target_id AS target, round(strength, 6) AS strength, n_keywords,
           (SELECT count(*) FROM efirsts f WHERE f.source_id = edges.source_id AND f.target_id = edges.target_id) AS n_descriptions, n_chunks
    FROM edges"""))
def edges(i):
    return g.build_edges(cut(_connected(i)), strength="sum").withColumn("strength", F.round("strength", 6))


@query("grf2_edge_descriptions", with_(f"""WITH {LOWER_RELS}
    SELECT source_id AS source, target_id AS target, description, min(ord) AS ord FROM rels WHERE description <> '' GROUP BY ALL"""))
def edge_descriptions(i):
    return g.edge_descriptions(_connected(i))


@query("grf4_summarised_edges", with_(f"""WITH {LOWER_RELS}, {edge_sql('rels', PAIR, 'sum')}
    SELECT source_id AS source, target_id AS target, description, round(strength, 6) AS strength, n_keywords, n_chunks FROM edges"""))
def summarised_edges(i):
    return g.summarised_edges(cut(_connected(i)), strength="sum").withColumn("strength", F.round("strength", 6))


@query("grf2_edge_keywords", with_(f"""WITH {LOWER_RELS}, {edge_sql('rels', PAIR, 'sum')}
    SELECT source_id AS source, target_id AS target, keyword FROM ekw"""))
def edge_keywords(i):
    return g.edge_keywords(g.connected(i.fx_relationships, g.summarised_nodes(i.fx_entities)))


@query("grf2_edge_chunks", with_(f"""WITH {LOWER_RELS}
    SELECT DISTINCT source_id AS source, target_id AS target, chunk_id AS chunk FROM rels"""))
def edge_chunks(i):
    return g.edge_chunks(g.connected(i.fx_relationships, g.summarised_nodes(i.fx_entities)))


@query("grf3_statistics", with_("""
    WITH n AS (SELECT count(DISTINCT entity_name) AS n FROM fx_entities),
         m AS (SELECT count(*) AS m FROM (SELECT DISTINCT source_id, target_id FROM fx_relationships))
    SELECT n AS n_nodes, m AS n_edges, round(2.0 * m / n, 6) AS avg_degree,
           round(CAST(m AS DOUBLE) / (CAST(n AS DOUBLE) * (n - 1)), 6) AS density FROM n, m"""))
def statistics(i):
    df = g.statistics(g.summarised_nodes(i.fx_entities), g.summarised_edges(i.fx_relationships))
    return df.withColumns({c: F.round(c, 6) for c in ("avg_degree", "density")})


@query("grf3_type_counts", with_("""
    SELECT type, count(*) AS n FROM (SELECT entity_name, arg_min(entity_type, ord) AS type FROM fx_entities GROUP BY ALL) GROUP BY ALL"""))
def type_counts(i):
    return g.type_counts(g.summarised_nodes(i.fx_entities))


DOC_NODES = """
    dfirsts AS (SELECT doc_id, entity_name, description, min(ord) AS o FROM fx_entities GROUP BY ALL),
    dtexts AS (SELECT doc_id, entity_name, left(string_agg(description, '; ' ORDER BY o), 500) AS description FROM dfirsts GROUP BY ALL),
    dnodes AS (SELECT doc_id, entity_name AS node_id, arg_min(entity_type, ord) AS type, any_value(t.description) AS description,
                      count(DISTINCT chunk_id) AS n_sources
               FROM fx_entities e JOIN dtexts t USING (doc_id, entity_name) GROUP BY doc_id, entity_name)"""
DOC_PAIR = "doc_id, source_id, target_id"


@query("grf4_sync_nodes", with_(f"WITH {DOC_NODES} SELECT * FROM dnodes"))
def sync_nodes(i):
    return g.sync_nodes(i.fx_entities)


@query("grf4_sync_edges", with_(f"""WITH {edge_sql('fx_relationships', DOC_PAIR, 'avg')}
    SELECT doc_id, source_id AS source, target_id AS target, description, round(strength, 6) AS strength, n_keywords, n_chunks FROM edges"""))
def sync_edges(i):
    return g.sync_edges(i.fx_relationships).withColumn("strength", F.round("strength", 6))


@query("grf5_rebuild_nodes", with_(f"""WITH {DOC_NODES}
    SELECT node_id, arg_max(type, doc_id) AS type, arg_max(description, doc_id) AS description,
           arg_max(n_sources, doc_id) AS n_sources, count(*) AS n_docs FROM dnodes GROUP BY node_id"""))
def rebuild_nodes(i):
    return g.rebuild_nodes(i.fx_entities)


@query("grf5_rebuild_edges", with_(f"""WITH {edge_sql('fx_relationships', DOC_PAIR, 'avg')}
    SELECT source_id AS source, target_id AS target, arg_max(description, doc_id) AS description,
           round(arg_max(strength, doc_id), 6) AS strength, arg_max(n_keywords, doc_id) AS n_keywords,
           arg_max(n_chunks, doc_id) AS n_chunks, count(*) AS n_docs FROM edges GROUP BY source_id, target_id"""))
def rebuild_edges(i):
    return g.rebuild_edges(i.fx_relationships).withColumn("strength", F.round("strength", 6))


@query("grf5_node_documents", with_("SELECT DISTINCT entity_name AS node_id, doc_id FROM fx_entities"))
def node_documents(i):
    return g.node_documents(i.fx_entities)


@query("grf6_read_nodes", with_(f"""WITH {NODES}
    SELECT node_id, coalesce(nullif(type, 'product'), 'unknown') AS type, description, n_sources FROM nodes"""))
def read_nodes(i):
    """Node types left empty on purpose read as ``unknown``."""
    raw = g.summarised_nodes(i.fx_entities).withColumn("type", F.nullif("type", F.lit("product")))
    return g.read_graph(raw, g.summarised_edges(i.fx_relationships))[0]


def _tables(i):
    ents, rels = i.fx_entities, i.fx_relationships
    return {
        "documents": ents.select("doc_id").unionByName(rels.select("doc_id")).distinct(),
        "chunks": ents.select("doc_id", "chunk_id").distinct(),
        "entities": ents,
        "relationships": rels,
        "nodes": ents.select(F.col("entity_name").alias("node_id")).distinct(),
        "edges": g.edge_documents(rels).select("source", "target").distinct(),
        "node_docs": g.node_documents(ents),
        "edge_docs": g.edge_documents(rels),
    }


def _gone(i):
    """Documents to delete: those of the suppliers of nation 3."""
    return i.sql("SELECT DISTINCT concat('d', s_suppkey % 50) AS doc_id FROM supplier WHERE s_nationkey = 3")


GONE = """
    gone AS (SELECT DISTINCT concat('d', s_suppkey % 50) AS doc_id FROM supplier WHERE s_nationkey = 3),
    nd AS (SELECT DISTINCT entity_name, doc_id FROM fx_entities),
    ed AS (SELECT DISTINCT source_id, target_id, doc_id FROM fx_relationships),
    nf AS (SELECT entity_name, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM gone)) AS lost, count(*) AS had FROM nd GROUP BY ALL),
    ef AS (SELECT source_id, target_id, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM gone)) AS lost, count(*) AS had FROM ed GROUP BY ALL)"""


@query("grf7_delete_report", with_(f"""WITH {GONE}
    SELECT 'documents' AS item, count(*) AS n FROM (SELECT doc_id FROM fx_entities UNION SELECT doc_id FROM fx_relationships) WHERE doc_id IN (FROM gone)
    UNION ALL SELECT 'chunks', count(*) FROM (SELECT DISTINCT doc_id, chunk_id FROM fx_entities) WHERE doc_id IN (FROM gone)
    UNION ALL SELECT 'entities', count(*) FROM fx_entities WHERE doc_id IN (FROM gone)
    UNION ALL SELECT 'relationships', count(*) FROM fx_relationships WHERE doc_id IN (FROM gone)
    UNION ALL SELECT 'nodes_deleted', count(*) FROM nf WHERE lost = had
    UNION ALL SELECT 'nodes_updated', count(*) FROM nf WHERE lost > 0 AND lost < had
    UNION ALL SELECT 'edges_deleted', count(*) FROM ef WHERE lost = had
    UNION ALL SELECT 'edges_updated', count(*) FROM ef WHERE lost > 0 AND lost < had"""))
def delete_report(i):
    return g.delete_documents(_tables(i), _gone(i))["report"]


@query("grf7_delete_nodes_left", with_(f"""WITH {GONE}
    SELECT entity_name AS node_id, had - lost AS n_docs FROM nf WHERE lost < had"""))
def delete_nodes_left(i):
    out = g.delete_documents(_tables(i), _gone(i))
    left = out["node_docs"].groupBy("node_id").agg(F.count(F.lit(1)).alias("n_docs"))
    return out["nodes"].join(left, "node_id")


@query("grf7_delete_edges_left", with_(f"""WITH {GONE}
    SELECT source_id AS source, target_id AS target, had - lost AS n_docs FROM ef WHERE lost < had"""))
def delete_edges_left(i):
    out = g.delete_documents(_tables(i), _gone(i))
    left = out["edge_docs"].groupBy("source", "target").agg(F.count(F.lit(1)).alias("n_docs"))
    return out["edges"].join(left, ["source", "target"])


STAYS = "WHERE doc_id NOT IN (SELECT concat('d', s_suppkey % 50) FROM supplier WHERE s_nationkey = 3)"


@query("grf7_recomputed_nodes", with_(f"""WITH {DOC_NODES}
    SELECT node_id, arg_max(type, doc_id) AS type, arg_max(description, doc_id) AS description,
           arg_max(n_sources, doc_id) AS n_sources, count(*) AS n_docs FROM dnodes {STAYS} GROUP BY node_id"""))
def recomputed_nodes(i):
    """Shared nodes fall back to the last document left: the same as a rebuild."""
    state = revision.start(g.sync_nodes(i.fx_entities), ["node_id"])
    return g.delete_documents(_tables(i), _gone(i), {"nodes": state})["nodes"]


@query("grf7_recomputed_edges", with_(f"""WITH {edge_sql('fx_relationships', DOC_PAIR, 'avg')}
    SELECT source_id AS source, target_id AS target, arg_max(description, doc_id) AS description,
           round(arg_max(strength, doc_id), 6) AS strength, arg_max(n_keywords, doc_id) AS n_keywords,
           arg_max(n_chunks, doc_id) AS n_chunks, count(*) AS n_docs FROM edges {STAYS} GROUP BY source_id, target_id"""))
def recomputed_edges(i):
    state = revision.start(g.sync_edges(i.fx_relationships), ["source", "target"])
    out = g.delete_documents(_tables(i), _gone(i), {"edges": state})["edges"]
    return out.withColumn("strength", F.round("strength", 6))


@query("grf5_replaced_nodes", with_(f"""WITH {DOC_NODES},
    now AS (FROM dnodes {STAYS} UNION ALL SELECT doc_id, node_id, type, concat('again ', description), n_sources FROM dnodes WHERE doc_id = 'd7' AND n_sources = 1)
    SELECT node_id, arg_max(type, doc_id) AS type, arg_max(description, doc_id) AS description,
           arg_max(n_sources, doc_id) AS n_sources, count(*) AS n_docs
    FROM now WHERE doc_id <> 'd7' OR description LIKE 'again %' GROUP BY node_id"""))
def replaced_nodes(i):
    """Two changes of a kept state: documents go, then one document comes again with other rows."""
    rows = g.sync_nodes(i.fx_entities)
    state, _ = revision.revise(revision.start(rows, ["node_id"]), _gone(i))
    again = rows.where("doc_id = 'd7' AND n_sources = 1").withColumn("description", F.concat(F.lit("again "), "description"))
    return revision.merged(revision.revise(state, new=again)[0])


@query("grf8_delete_tenant", with_("""
    SELECT 'feedbacks' AS item, count(*) AS n FROM fx_feedback WHERE user_id = 7
    UNION ALL SELECT 'login_logs', count(*) FROM fx_login_logs WHERE user_id = 7
    UNION ALL SELECT 'conversations', count(*) FROM fx_conversations WHERE user_id = 7"""))
def delete_tenant(i):
    tables = {"feedbacks": i.fx_feedback, "login_logs": i.fx_login_logs, "conversations": i.fx_conversations}
    return g.delete_tenant(tables, "7")["report"]


@query("grf18_select_nodes", with_(f"WITH {NODES} SELECT node_id FROM nodes WHERE type IN ('organization', 'product')"))
def select_nodes(i):
    return g.select_nodes(g.summarised_nodes(i.fx_entities), "type", ["organization", "product"])


@query("grf18_select_endpoints", with_("""
    SELECT DISTINCT unnest([source_id, target_id]) AS node_id FROM fx_relationships WHERE chunk_id IN ('c1', 'c2', 'c3')"""))
def select_endpoints(i):
    return g.select_endpoints(g.edge_chunks(i.fx_relationships), "chunk", ["c1", "c2", "c3"])


@query("grf19_keyword_counts", with_(f"WITH {edge_sql('fx_relationships', PAIR, 'avg')} SELECT keyword, count(*) AS n FROM ekw GROUP BY ALL"))
def keyword_counts(i):
    return g.keyword_counts(g.edge_keywords(i.fx_relationships))


@query("grf19_strength_summary", with_(f"""WITH {edge_sql('fx_relationships', PAIR, 'avg')}
    SELECT (SELECT count(*) FROM edges) AS n_edges, (SELECT round(avg(strength), 6) FROM edges) AS avg_strength,
           (SELECT count(DISTINCT keyword) FROM ekw) AS n_keywords"""))
def strength_summary(i):
    rels = i.fx_relationships
    df = g.strength_summary(g.summarised_edges(rels, strength="avg"), g.edge_keywords(rels))
    return df.withColumn("avg_strength", F.round("avg_strength", 6))


DEGREES = "deg AS (SELECT node_id, count(*) AS degree FROM (SELECT unnest([source_id, target_id]) AS node_id FROM (SELECT DISTINCT source_id, target_id FROM fx_relationships)) GROUP BY ALL)"


@query("grf20_search_nodes", with_(f"""WITH {NODES}, {DEGREES}
    SELECT node_id, type, CAST(CASE WHEN contains(lower(node_id), 'ring') THEN 10 ELSE 0 END + CASE WHEN contains(lower(description), 'ring') THEN 5 ELSE 0 END
           + CASE WHEN contains(lower(type), 'ring') THEN 3 ELSE 0 END AS INTEGER) AS score, coalesce(degree, 0) AS degree,
           CAST(row_number() OVER (ORDER BY score DESC, node_id) AS INTEGER) AS place
    FROM nodes LEFT JOIN deg USING (node_id) WHERE score > 0 ORDER BY score DESC, node_id LIMIT 20"""))
def search_nodes(i):
    return g.search_nodes(g.summarised_nodes(i.fx_entities), g.summarised_edges(i.fx_relationships), "Ring")


@query("grf21_browse_nodes", with_(f"""WITH {NODES}, {DEGREES}
    SELECT node_id, type, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN deg USING (node_id)
    WHERE contains(lower(node_id), 'e') AND type = 'organization' ORDER BY degree DESC, node_id LIMIT 50"""))
def browse_nodes(i):
    return g.browse_nodes(g.summarised_nodes(i.fx_entities), g.summarised_edges(i.fx_relationships), "E", "organization")


@query("grf22_browse_edges", with_(f"""WITH {edge_sql('fx_relationships', PAIR, 'sum')},
    best AS (SELECT source_id, target_id, strength, CAST(row_number() OVER (ORDER BY round(strength, 6) DESC, source_id, target_id) AS INTEGER) AS place FROM edges
             WHERE strength >= 3 AND (source_id, target_id) IN (SELECT (source_id, target_id) FROM ekw WHERE keyword = 'bulk')
             QUALIFY place <= 50)
    SELECT any_value(place) AS place, source_id AS source, target_id AS target, string_agg(keyword, ',' ORDER BY keyword) AS keywords,
           round(any_value(strength), 6) AS strength,
           CASE WHEN any_value(strength) >= 5 THEN 'strong' WHEN any_value(strength) >= 3 THEN 'medium' ELSE 'weak' END AS class
    FROM best JOIN ekw USING (source_id, target_id) GROUP BY source_id, target_id"""))
def browse_edges(i):
    rels = i.fx_relationships
    edges_ = g.summarised_edges(rels, strength="sum")
    edges_ = edges_.withColumn("strength", F.round("strength", 6))
    return g.browse_edges(edges_, g.edge_keywords(rels), "bulk", 3.0)


@query("grf23_view_subset", with_(f"""WITH {NODES}, {edge_sql('fx_relationships', PAIR, 'sum')},
    shown AS (SELECT node_id FROM nodes WHERE type IN ('organization', 'product') ORDER BY node_id LIMIT 200)
    SELECT source_id AS source, target_id AS target, round(strength, 6) AS strength FROM edges
    WHERE source_id IN (FROM shown) AND target_id IN (FROM shown) AND strength >= 2
      AND (source_id, target_id) IN (SELECT (source_id, target_id) FROM ekw WHERE keyword IN ('bulk', 'economy'))"""))
def view_subset(i):
    rels = i.fx_relationships
    _, inside = g.view_subset(
        g.summarised_nodes(i.fx_entities), g.summarised_edges(rels), g.edge_keywords(rels),
        200, ["organization", "product"], ["bulk", "economy"], 2.0,
    )
    return inside.select("source", "target", F.round("strength", 6).alias("strength"))
