"""Walking the graph for a batch of questions: seeds, neighbours, context scores, paths.

Every function takes all questions at once. Hubs are handled by ranking the edges
of a node before they are joined to questions, so a question never meets more
edges of a node than its answer can show.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.matching import containment_join
from graphloom.operators.spread import join_lookup
from graphloom.session import cut


def edge_scores(edges: DataFrame, keywords: DataFrame | None = None, wanted: Sequence[str] = ()) -> DataFrame:
    """Importance of an edge: strength, raised by a long description, several keywords, wanted keywords."""
    long_text = (
        F.when(F.length("description") > 50, 1.2).when(F.length("description") > 20, 1.1).otherwise(1.0)
    )
    several = F.when(F.col("n_keywords") >= 3, 1.15).when(F.col("n_keywords") >= 2, 1.1).otherwise(1.0)
    score = F.col("strength") * long_text * several
    wanted = [w.lower() for w in wanted if w]
    if not wanted:
        return edges.withColumn("importance", score)
    word = F.lower("keyword")
    hit = F.lit(False)
    for w in wanted:
        hit = hit | word.contains(w) | F.contains(F.lit(w), word)
    matches = keywords.where(hit).groupBy("source", "target").agg(F.count(F.lit(1)).alias("matches"))
    return (
        edges.join(matches, ["source", "target"], "left")
        .withColumn("importance", score * (1 + 0.2 * F.coalesce("matches", F.lit(0))))
        .drop("matches")
    )


def find_seeds(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes named by a question: (qid, entity) meets a node when either name contains the other, ignoring case."""
    entities = asked.select(F.lower("entity").alias("entity")).distinct()
    names = nodes.select("node_id", F.lower("node_id").alias("name"))
    inside = containment_join(entities.withColumn("low", F.col("entity")), names, "entity", "low", "node_id", "name")
    around = containment_join(names, entities.withColumn("low", F.col("entity")), "node_id", "name", "entity", "low")
    pairs = inside.select("entity", "node_id").union(around.select("entity", "node_id")).distinct()
    return (
        join_lookup(asked.select("qid", F.lower("entity").alias("entity")), pairs, ["entity"])
        .select("qid", F.col("node_id").alias("seed"))
        .distinct()
    )


def _best_edges(frontier: DataFrame, edges: DataFrame, seeds: DataFrame, limit: int) -> DataFrame:
    """Edges of the frontier nodes that can still be among the best ``limit`` of some question.

    A question leaves out no targets but its own seeds, so of each node the best ``limit`` edges and as many
    more as the largest of its questions has seeds are enough, however many questions meet there.
    """
    own = seeds.select("qid", "seed").distinct().groupBy("qid").agg(F.count(F.lit(1)).alias("n_seeds"))
    starts = frontier.join(own, "qid", "left").groupBy("via").agg(F.coalesce(F.max("n_seeds"), F.lit(0)).alias("spare"))
    near = join_lookup(edges, starts.withColumnRenamed("via", "source"), ["source"])
    by_source = Window.partitionBy("source").orderBy(F.desc("importance"), "target")
    ranked = near.withColumn("place", F.row_number().over(by_source))
    return ranked.where(F.col("place") <= limit + F.col("spare")).drop("place", "spare")


def _hop(frontier: DataFrame, edges: DataFrame, seeds: DataFrame, limit: int, hop: int) -> DataFrame:
    """Best ``limit`` edges per (question, seed) leaving the frontier (qid, seed, via)."""
    best = _best_edges(frontier, edges, seeds, limit)
    met = join_lookup(best.withColumnRenamed("source", "via"), frontier, ["via"])
    # Seeds are worked through in name order; one already done is not a neighbour any more.
    earlier = seeds.select("qid", F.col("seed").alias("target")).withColumn("is_seed", F.lit(True))
    met = join_lookup(met, earlier, ["qid", "target"], "left").where(
        F.col("is_seed").isNull() | (F.col("target") >= F.col("seed"))
    )
    if hop > 1:
        met = met.where(F.col("target") != F.col("seed"))
    place = Window.partitionBy("qid", "seed").orderBy(F.desc("importance"), "target", "via")
    return (
        met.withColumn("place", F.row_number().over(place))
        .where(F.col("place") <= limit)
        .select("qid", "seed", F.lit(hop).alias("hop"), "place", "via", "target", "strength", "importance")
    )


def neighbours(
    seeds: DataFrame, edges: DataFrame, hops: int = 1, limit: int = 5, min_strength: float = 0.0
) -> DataFrame:
    """Best neighbours of every (qid, seed); the second hop starts from those kept in the first.

    ``edges`` carries ``importance`` (see ``edge_scores``). The minimum strength
    applies to the first hop only.
    """
    first = _hop(
        seeds.withColumn("via", F.col("seed")), edges.where(F.col("strength") >= min_strength), seeds, limit, 1
    )
    if hops < 2:
        return first
    first = cut(first)  # both the second hop and the result read it
    second = _hop(first.select("qid", "seed", F.col("target").alias("via")), edges, seeds, limit, 2)
    return first.unionByName(second)


def contexts(seeds: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """One row per (qid, seed): how well its neighbourhood answers; 0 without relationships."""
    sums = found.groupBy("qid", "seed").agg(
        F.avg(F.when(F.col("hop") == 1, F.col("importance"))).alias("average"),
        F.count(F.when(F.col("hop") == 1, 1)).alias("n_relationships"),
        F.count(F.lit(1)).alias("n_neighbours"),
    )
    about = nodes.select(F.col("node_id").alias("seed"), "type", "description")
    # Without relationships there is no average; `least` would skip the missing value, so it becomes 0 first.
    score = F.least(F.lit(1.0), F.coalesce(F.col("average") * (F.col("n_neighbours") / F.lit(10.0)), F.lit(0.0)))
    return (
        join_lookup(seeds, about, ["seed"])
        .join(sums, ["qid", "seed"], "left")
        .select(
            "qid",
            "seed",
            "type",
            "description",
            F.coalesce("n_relationships", F.lit(0)).alias("n_relationships"),
            F.coalesce("n_neighbours", F.lit(0)).alias("n_neighbours"),
            score.alias("score"),
        )
    )


def subgraph(
    starts: DataFrame, nodes: DataFrame, edges: DataFrame, radius: int = 1
) -> tuple[DataFrame, DataFrame]:
    """Nodes within ``radius`` directed hops of each question's starts, and the edges among them.

    ``starts`` is (qid, node_id). Reached sets are cut after every hop.
    """
    known = nodes.select("node_id").distinct()
    reached = cut(starts.select("qid", "node_id").distinct().join(known, "node_id", "left_semi"))
    frontier = reached
    for _ in range(radius):
        step = (
            join_lookup(edges.select(F.col("source").alias("node_id"), "target"), frontier, ["node_id"])
            .select("qid", F.col("target").alias("node_id"))
            .distinct()
        )
        step = join_lookup(step, known, ["node_id"])
        frontier = cut(step.join(reached, ["qid", "node_id"], "left_anti").select("qid", "node_id"))
        reached = reached.unionByName(frontier)
    ends = reached.withColumnRenamed("node_id", "target").withColumn("there", F.lit(True))
    links = join_lookup(edges.select("source", "target"), reached.withColumnRenamed("node_id", "source"), ["source"])
    return reached, join_lookup(links, ends, ["qid", "target"]).select("qid", "source", "target")


def paths(starts: DataFrame, edges: DataFrame, max_hops: int = 3, max_paths: int = 5) -> DataFrame:
    """Shortest paths from each question's starts, ``max_paths`` per question.

    ``starts`` is (qid, ord, start). Starts are used in ``ord`` order, nodes are
    reached breadth first, ties follow the names along the path. A start that has
    found ``max_paths`` nodes is finished, so at most that many nodes per start are
    ever carried on, and at most twice as many edges of any node can matter.
    """
    adjacency = edges.select("source", "target").where(F.col("source") != F.col("target")).distinct()
    frontier = starts.select("qid", "ord", "start").distinct().select(
        "qid", "ord", "start", F.col("start").alias("node"), F.array("start").alias("path"), F.lit(0).alias("had")
    )
    seen = frontier.select("qid", "ord", "start", "node", "path")
    found = None
    key = ["qid", "ord", "start"]
    for _ in range(max_hops):
        sources = frontier.select(F.col("node").alias("source")).distinct()
        lean = (
            join_lookup(adjacency, sources, ["source"])
            .withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("target")))
            .where(F.col("place") <= 2 * max_paths)
            .select(F.col("source").alias("node"), "target")
        )
        step = (
            frontier.join(lean, "node")
            .select(*key, F.col("target").alias("node"), F.concat("path", F.array("target")).alias("path"), "had")
            .groupBy(*key, "node", "had")
            .agg(F.min("path").alias("path"))
            .join(seen.select(*key, "node"), [*key, "node"], "left_anti")
        )
        ranked = step.withColumn(
            "place", F.row_number().over(Window.partitionBy(*key).orderBy("path"))
        ).where(F.col("place") <= max_paths)
        new = cut(ranked.where(F.col("place") + F.col("had") <= max_paths).drop("place"))
        found = new if found is None else found.unionByName(new)
        seen = seen.unionByName(new.select(*key, "node", "path"))
        have = new.groupBy(*key).agg(F.count(F.lit(1)).alias("more"))
        frontier = (
            new.join(have, key)
            .withColumn("had", (F.col("had") + F.col("more")).cast("int"))
            .where(F.col("had") < max_paths)
            .drop("more")
        )
    length = F.size("path")
    order = Window.partitionBy("qid").orderBy("ord", length, "path")
    return (
        found.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= max_paths)
        .select("qid", "place", "start", "path", length.alias("length"))
    )


def path_keywords(found: DataFrame, keywords: DataFrame) -> DataFrame:
    """Keywords of every edge on a path: (qid, place, step, keyword)."""
    steps = found.select("qid", "place", "path", F.explode(F.sequence(F.lit(1), F.size("path") - 1)).alias("step")).select(
        "qid", "place", "step",
        F.element_at("path", F.col("step")).alias("source"),
        F.element_at("path", F.col("step") + 1).alias("target"),
    )
    return steps.join(keywords, ["source", "target"]).select("qid", "place", "step", "source", "target", "keyword")


def neighbourhood(chosen: DataFrame, edges: DataFrame, degree: int = 2) -> DataFrame:
    """Nodes within ``degree`` undirected steps of each chosen node, with their distance."""
    both = edges.select("source", "target").union(edges.select("target", "source")).distinct()
    reached = chosen.select("qid", "node_id").distinct().withColumn("hop", F.lit(0))
    frontier = reached
    for hop in range(1, degree + 1):
        step = (
            join_lookup(both.withColumnRenamed("source", "node_id"), frontier.select("qid", "node_id"), ["node_id"])
            .select("qid", F.col("target").alias("node_id"))
            .distinct()
        )
        frontier = cut(
            step.join(reached, ["qid", "node_id"], "left_anti").select("qid", "node_id", F.lit(hop).alias("hop"))
        )
        reached = reached.unionByName(frontier)
    return reached
