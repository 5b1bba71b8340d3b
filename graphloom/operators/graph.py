"""Knowledge graph tables: building, per-document sync, rebuild, deletion, statistics, browsing.

The graph is kept in narrow tables. A node or edge row holds what has a bounded
size (type, a description of at most 500 characters, strength, counts). The sets
that grow with the data (sources and documents of a node, keywords, chunks and
documents of an edge) are link tables with one row per member, because a set
belonging to a hub does not fit in a row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import join_firsts, joined_text, keyword_list
from graphloom.operators import revision
from graphloom.operators.spread import join_lookup
from graphloom.session import cut

DESCRIPTION_CHARS = 500


# ---------------------------------------------------------------- building


def build_nodes(entities: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """One node per entity name (and scope): first type, numbers of distinct descriptions and sources.

    The descriptions themselves are rows of ``node_descriptions``, whole and uncut.
    """
    keys = [*scope, "entity_name"]
    typed = F.when(F.col("entity_type") != "", F.struct(F.col("ord").alias("at"), F.col("entity_type").alias("type")))
    facts = entities.groupBy(*keys).agg(
        F.coalesce(F.min(typed)["type"], F.lit("UNKNOWN")).alias("type"),
        F.countDistinct("chunk_id").alias("n_sources"),
    )
    said = node_descriptions(entities, scope).groupBy(*scope, "node_id").agg(F.count(F.lit(1)).alias("n_descriptions"))
    named = facts.withColumnRenamed("entity_name", "node_id")
    return named.join(said, [*scope, "node_id"], "left").select(
        *scope, "node_id", "type", F.coalesce("n_descriptions", F.lit(0)).cast("long").alias("n_descriptions"), "n_sources"
    )


def node_descriptions(entities: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Link table node → distinct description, whole, with the ord of its first appearance."""
    named = entities.withColumnRenamed("entity_name", "node_id")
    return _descriptions(named, [*scope, "node_id"])


def _descriptions(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.where("description <> ''").groupBy(*keys, "description").agg(F.min("ord").alias("ord"))


def summarised_nodes(entities: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Nodes as the per-document sync keeps them: the joined descriptions cut to ``DESCRIPTION_CHARS``."""
    keys = [*scope, "entity_name"]
    texts = joined_text(entities, keys, "description", "ord", DESCRIPTION_CHARS).withColumnRenamed("entity_name", "node_id")
    return build_nodes(entities, scope).join(texts, [*scope, "node_id"], "left").select(
        *scope, "node_id", "type", F.coalesce("description", F.lit("")).alias("description"), "n_sources"
    )


def node_sources(entities: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Link table node → chunk."""
    return entities.select(*scope, F.col("entity_name").alias("node_id"), F.col("chunk_id").alias("source")).where(
        F.col("source").isNotNull() & (F.col("source") != "")
    ).distinct()


def connected(relationships: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relationships between two known, different nodes."""
    known = nodes.select(F.col("node_id")).distinct()
    kept = relationships.where(F.col("source_id") != F.col("target_id"))
    for end in ("source_id", "target_id"):
        kept = join_lookup(kept, known.withColumnRenamed("node_id", end), [end])
    return kept


def build_edges(relationships: DataFrame, scope: Sequence[str] = (), strength: str = "sum") -> DataFrame:
    """One edge per directed pair (and scope); ``strength`` is the sum or the average of the weights.

    Descriptions and keywords are counted; they are rows of ``edge_descriptions`` and ``edge_keywords``.
    """
    described = F.col("description")
    said = F.when(described != "", described)
    return _edge_facts(relationships, scope, strength, {"n_descriptions": F.array(said)})


def _by_edge(relationships: DataFrame, scope: Sequence[str], *columns: str | Column) -> DataFrame:
    """Relationships dealt by edge, so that nothing made of them in this layout is shuffled once more."""
    ends = [*scope, "source", "target"]
    named = relationships.withColumnsRenamed({"source_id": "source", "target_id": "target"})
    return named.select(*ends, *columns).repartition(*ends)


def _edge_facts(relationships: DataFrame, scope: Sequence[str], strength: str, counted: dict[str, Column] | None = None) -> DataFrame:
    """Strength and numbers of distinct keywords, chunks and elements of the arrays ``counted`` of each edge.

    An edge meets its distinct values as rows, so its task holds no set of them. Values other than chunks are counted where
    both ends (and the scope) are named.
    """
    ends = [*scope, "source", "target"]
    weight = F.coalesce(F.col("weight"), F.lit(1.0)).cast("double").alias("weight")
    arrays = {"n_keywords": keyword_list(F.col("keywords"))} | (counted or {})
    dealt = _by_edge(relationships, scope, weight, "chunk_id", *[a.alias(c) for c, a in arrays.items()])

    def rows_of(kind: int, values: Column, weight: Column) -> Column:
        return F.transform(
            values, lambda v: F.struct(F.lit(kind).alias("kind"), v.cast("string").alias("value"), weight.alias("weight"))
        )

    listed = [rows_of(k, F.col(c), F.lit(None).cast("double")) for k, c in enumerate(arrays, 1)]
    values = dealt.select(*ends, F.inline(F.concat(rows_of(0, F.array("chunk_id"), F.col("weight")), *listed)))
    distinct = values.groupBy(*ends, "kind", "value").agg(F.sum("weight").alias("weight"), F.count("weight").alias("n"))
    named = reduce(and_, (F.col(c).isNotNull() for c in ends))
    found = lambda k: F.count(F.when((F.col("kind") == k) & F.col("value").isNotNull(), 1))
    total = {"sum": F.sum("weight"), "avg": F.sum("weight") / F.sum("n")}[strength]
    return distinct.groupBy(*ends).agg(
        total.alias("strength"),
        *[F.when(named, found(k)).otherwise(0).cast("long").alias(c) for k, c in enumerate(arrays, 1)],
        found(0).alias("n_chunks"),
    ).select(*ends, "strength", *arrays, "n_chunks")


def edge_descriptions(relationships: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Link table edge → distinct description, whole, with the ord of its first appearance."""
    named = relationships.withColumnsRenamed({"source_id": "source", "target_id": "target"})
    return _descriptions(named, [*scope, "source", "target"])


def summarised_edges(relationships: DataFrame, scope: Sequence[str] = (), strength: str = "sum") -> DataFrame:
    """Edges as the per-document sync keeps them: the joined descriptions cut to ``DESCRIPTION_CHARS``."""
    ends = [*scope, "source", "target"]
    rows = _by_edge(relationships, scope, "description", "ord").where("description <> ''")
    # As the least of all, a null ord counts as the first one.
    first = F.when(F.count("ord") == F.count(F.lit(1)), F.min("ord")).alias("at")
    said = rows.groupBy(*ends, "description").agg(first)
    text = F.struct("at", F.left("description", F.lit(DESCRIPTION_CHARS)).alias("text"))
    texts = join_firsts(said.select(*ends, text.alias("__first")), ends, DESCRIPTION_CHARS, "description")
    return _edge_facts(relationships, scope, strength).join(texts, ends, "left").select(
        *ends, F.coalesce("description", F.lit("")).alias("description"), "strength", "n_keywords", "n_chunks"
    )


def edge_keywords(relationships: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Link table edge → keyword, keywords trimmed."""
    return relationships.select(
        *scope,
        F.col("source_id").alias("source"),
        F.col("target_id").alias("target"),
        F.explode(keyword_list(F.col("keywords"))).alias("keyword"),
    ).distinct()


def edge_chunks(relationships: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Link table edge → chunk."""
    return relationships.where(F.coalesce("chunk_id", F.lit("")) != "").select(
        *scope, F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.col("chunk_id").alias("chunk")
    ).distinct()


def keyword_text(edges: DataFrame, keywords: DataFrame) -> DataFrame:
    """Add the sorted keyword string to a small selection of edges, for display."""
    ends = ["source", "target"]
    wanted = edges.select(*ends).distinct()
    text = (
        keywords.join(wanted, ends, "left_semi")
        .groupBy(*ends)
        .agg(F.array_join(F.array_sort(F.collect_set("keyword")), ",").alias("keywords"))
    )
    return edges.join(text, ends, "left").withColumn("keywords", F.coalesce("keywords", F.lit("")))


# ------------------------------------------------- per document, rebuild, read


def sync_nodes(entities: DataFrame) -> DataFrame:
    """Nodes of every document in one pass."""
    return summarised_nodes(entities, scope=["doc_id"])


def sync_edges(relationships: DataFrame) -> DataFrame:
    """Edges of every document in one pass; strength is the average weight."""
    return summarised_edges(relationships, scope=["doc_id"], strength="avg")


def merge_documents(per_document: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per-document rows to one row per key: attributes of the last document, number of documents."""
    values = [c for c in per_document.columns if c not in {*keys, "doc_id"}]
    return (
        per_document.groupBy(*keys)
        .agg(
            F.max(F.struct("doc_id", *values)).alias("__last"),
            F.count(F.lit(1)).alias("n_docs"),
        )
        .select(*keys, *[F.col(f"__last.{v}").alias(v) for v in values], "n_docs")
    )


def rebuild_nodes(entities: DataFrame) -> DataFrame:
    """All documents synced in doc_id order: the last one sets the attributes."""
    return merge_documents(sync_nodes(entities), ["node_id"])


def rebuild_edges(relationships: DataFrame) -> DataFrame:
    return merge_documents(sync_edges(relationships), ["source", "target"])


def node_documents(entities: DataFrame) -> DataFrame:
    """Link table node → document."""
    return entities.select(F.col("entity_name").alias("node_id"), "doc_id").distinct()


def edge_documents(relationships: DataFrame) -> DataFrame:
    """Link table edge → document."""
    return relationships.select(
        F.col("source_id").alias("source"), F.col("target_id").alias("target"), "doc_id"
    ).distinct()


def read_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with the defaults a reader may rely on."""
    return (
        nodes.withColumns(
            {"type": F.coalesce("type", F.lit("unknown")), "description": F.coalesce("description", F.lit(""))}
        ),
        edges.withColumns(
            {"strength": F.coalesce("strength", F.lit(1.0)), "description": F.coalesce("description", F.lit(""))}
        ),
    )


# ---------------------------------------------------------------- deletion


def shrink_links(links: DataFrame, keys: Sequence[str], documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove documents from a link table; also say what happens to each key touched.

    Returns the remaining links and (keys…, action) where action is ``deleted``
    when no document is left for the key and ``updated`` otherwise.
    """
    gone = documents.select("doc_id").distinct().withColumn("__gone", F.lit(1))
    marked = join_lookup(links, gone, ["doc_id"], "left")
    fate = (
        marked.groupBy(*keys)
        .agg(F.count("__gone").alias("lost"), F.count(F.lit(1)).alias("had"))
        .where(F.col("lost") > 0)
        .select(*keys, F.when(F.col("lost") == F.col("had"), "deleted").otherwise("updated").alias("action"))
    )
    return marked.where(F.col("__gone").isNull()).drop("__gone"), fate


def delete_documents(
    tables: dict[str, DataFrame], documents: DataFrame, recompute: dict[str, revision.Revisions] | None = None
) -> dict[str, DataFrame]:
    """Cascade delete of a set of documents.

    ``tables`` has documents, chunks, entities, relationships (each with doc_id),
    nodes, edges, node_docs and edge_docs. The result has the same tables without
    the documents, and ``report`` (item, n). Attributes of shared nodes and edges stay as they are, unless
    ``recompute`` has their states (``nodes``, ``edges``): then they are those of the last document left.
    """
    gone = documents.select("doc_id").distinct()
    out: dict[str, DataFrame] = {}
    counts = []
    for name in ("documents", "chunks", "entities", "relationships"):
        out[name] = tables[name].join(gone, "doc_id", "left_anti")
        counts.append(
            tables[name].join(gone, "doc_id", "left_semi").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("item"), "n")
        )
    for name, links, keys in (("nodes", "node_docs", ["node_id"]), ("edges", "edge_docs", ["source", "target"])):
        out[links], fate = shrink_links(tables[links], keys, gone)
        dead = fate.where(F.col("action") == "deleted").select(*keys)
        out[name] = tables[name].join(dead, keys, "left_anti")
        for action in ("deleted", "updated"):
            counts.append(
                fate.where(F.col("action") == action)
                .agg(F.count(F.lit(1)).alias("n"))
                .select(F.lit(f"{name}_{action}").alias("item"), "n")
            )
    for name, state in (recompute or {}).items():
        out[name] = revision.merged(revision.revise(state, gone)[0])
    report = counts[0]
    for part in counts[1:]:
        report = report.unionByName(part)
    out["report"] = report
    return out


def delete_tenant(tables: dict[str, DataFrame], user_id: str) -> dict[str, DataFrame]:
    """Drop every row of one user from every table; ``report`` counts them per table. Rows without a user stay."""
    out = {name: df.where(~F.col("user_id").eqNullSafe(user_id)) for name, df in tables.items()}
    report = None
    for name, df in tables.items():
        part = df.where(F.col("user_id") == user_id).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("item"), "n"
        )
        report = part if report is None else report.unionByName(part)
    out["report"] = report
    return out


# -------------------------------------------------------------- statistics


def degrees(edges: DataFrame) -> DataFrame:
    """Edges per node, both directions; counted before the shuffle, so hubs are cheap."""
    return (
        edges.select(F.explode(F.array("source", "target")).alias("node_id"))
        .where("node_id IS NOT NULL")
        .groupBy("node_id")
        .agg(F.count(F.lit(1)).alias("degree"))
    )


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node and edge counts, average degree and density, one row."""
    n = nodes.agg(F.count(F.lit(1)).alias("n_nodes")).withColumn("k", F.lit(0))
    m = edges.agg(F.count(F.lit(1)).alias("n_edges")).withColumn("k", F.lit(0))
    v, e = F.col("n_nodes").cast("double"), F.col("n_edges").cast("double")
    return n.join(m, "k").select(
        "n_nodes",
        "n_edges",
        (2 * e / F.greatest(v, F.lit(1.0))).alias("avg_degree"),
        F.when(v > 1, e / (v * (v - 1))).otherwise(0.0).alias("density"),
    )


def type_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def keyword_counts(keywords: DataFrame) -> DataFrame:
    """How many edges carry each keyword."""
    return keywords.groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))


def strength_summary(edges: DataFrame, keywords: DataFrame) -> DataFrame:
    """Edges, distinct keywords and average strength, one row."""
    a = edges.agg(
        F.count(F.lit(1)).alias("n_edges"),
        F.coalesce(F.avg(F.coalesce("strength", F.lit(1.0))), F.lit(0.0)).alias("avg_strength"),
    ).withColumn("k", F.lit(0))
    b = keywords.agg(F.countDistinct("keyword").alias("n_keywords")).withColumn("k", F.lit(0))
    return a.join(b, "k").drop("k")


# ---------------------------------------------------------------- browsing


def select_nodes(nodes: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    return nodes.where(F.col(column).cast("string").isin(list(values))).select("node_id")


def select_endpoints(edges: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Both ends of the edges whose property has one of the values."""
    return (
        edges.where(F.col(column).cast("string").isin(list(values)))
        .select(F.explode(F.array("source", "target")).alias("node_id"))
        .distinct()
    )


def search_nodes(nodes: DataFrame, edges: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Nodes naming ``text``: 10 for the name, 5 for the description, 3 for the type."""
    q = text.lower()

    def hit(c: str, points: int) -> Column:
        return F.when(F.lower(F.coalesce(c, F.lit(""))).contains(q), points).otherwise(0)

    score = hit("node_id", 10) + hit("description", 5) + hit("type", 3)
    best = _first(nodes.withColumn("score", score).where("score > 0"), limit, F.desc("score"), "node_id")
    # At most ``limit`` ids: only their edges are counted.
    own = degrees(_touching(edges, best.select("node_id")))
    return best.join(own, "node_id", "left").select("place", "node_id", "type", "score", F.coalesce("degree", F.lit(0)).alias("degree"))


def _first(rows: DataFrame, limit: int, *order: str | Column) -> DataFrame:
    """The first ``limit`` rows in order, with their ``place``: a later join does not keep the order itself."""
    top = rows.orderBy(*order).limit(limit)
    return cut(top.withColumn("place", F.row_number().over(Window.orderBy(*order))))


def _touching(edges: DataFrame, few: DataFrame) -> DataFrame:
    """Ends of edges that are among a few nodes, as edges of one end."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("node_id")).join(F.broadcast(few), "node_id", "left_semi")
    return ends.select(F.col("node_id").alias("source"), F.lit(None).cast("string").alias("target"))


def browse_nodes(
    nodes: DataFrame, edges: DataFrame, name_part: str = "", type_: str | None = None, limit: int = 50
) -> DataFrame:
    """Best connected nodes by name part and type."""
    found = nodes
    if name_part:
        found = found.where(F.lower("node_id").contains(name_part.lower()))
    if type_ is not None:
        found = found.where(F.col("type") == type_)
    return _with_degree(found, edges).orderBy(F.desc("degree"), "node_id").limit(limit).select("node_id", "type", "degree")


def _with_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(degrees(edges), "node_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def strength_class(strength: Column) -> Column:
    return F.when(strength >= 5, "strong").when(strength >= 3, "medium").otherwise("weak")


def browse_edges(
    edges: DataFrame, keywords: DataFrame, keyword: str | None = None, min_strength: float = 0.0, limit: int = 50
) -> DataFrame:
    """Strongest edges, optionally only those carrying a keyword."""
    found = edges.where(F.col("strength") >= min_strength)
    if keyword is not None:
        found = found.join(keywords.where(F.col("keyword") == keyword), ["source", "target"], "left_semi")
    best = _first(found, limit, F.desc("strength"), "source", "target")
    return keyword_text(best, keywords).select(
        "place", "source", "target", "keywords", "strength", strength_class(F.col("strength")).alias("class")
    )


def view_subset(
    nodes: DataFrame,
    edges: DataFrame,
    keywords: DataFrame,
    max_nodes: int = 100,
    types: Sequence[str] | None = None,
    wanted: Sequence[str] | None = None,
    min_strength: float = 0.0,
) -> tuple[DataFrame, DataFrame]:
    """The first ``max_nodes`` nodes of the chosen types and the chosen edges among them."""
    shown = nodes if types is None else nodes.where(F.col("type").isin(list(types)))
    shown = shown.orderBy("node_id").limit(max_nodes)
    # At most max_nodes ids: small by construction.
    ids = F.broadcast(shown.select("node_id"))
    inside = edges.where(F.col("strength") >= min_strength)
    for end in ("source", "target"):
        inside = inside.join(ids, inside[end] == ids["node_id"], "left_semi")
    if wanted is not None:
        picked = keywords.where(F.col("keyword").isin(list(wanted)))
        inside = inside.join(picked, ["source", "target"], "left_semi")
    return shown, inside
