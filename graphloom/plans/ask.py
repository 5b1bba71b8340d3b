"""Answering a batch of questions: analyse, search vectors and graph, merge, rerank, write the context."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import retrieval, traverse, vectors
from graphloom.operators.inference import Encoder, encode
from graphloom.session import cut


@dataclass
class Mode:
    """Which branches run. ``use_analysis`` leaves it to each question's own mode as well."""

    use_global: bool = True
    use_local: bool = True
    use_multi_hop: bool = False
    expand_query: bool = False
    rerank: bool = True
    use_analysis: bool = False

    @classmethod
    def forced(cls, name: str) -> Mode:
        """``vector``, ``graph`` or ``hybrid``."""
        return cls(use_global={"vector": True, "graph": False, "hybrid": True}[name], use_local={"vector": False, "graph": True, "hybrid": True}[name])


@dataclass
class Answerable:
    """Everything found for the questions.

    ``chunks`` and ``contexts`` are the best of each question, ``counts`` what there was before that limit;
    the ranked tables hold all, the answer's context is written from them.
    """

    analysed: DataFrame
    chunks: DataFrame
    contexts: DataFrame
    counts: DataFrame
    ranked_chunks: DataFrame
    ranked_contexts: DataFrame
    neighbours: DataFrame
    paths: DataFrame | None
    texts: DataFrame


def _only(rows: DataFrame, on: bool, asked: DataFrame | None) -> DataFrame:
    """Rows of the questions that a branch works for; an empty local table if it is off, which costs no scan."""
    if not on:
        return rows.sparkSession.createDataFrame([], rows.schema)
    return rows if asked is None else rows.join(asked, "qid", "left_semi")


def retrieve(
    questions: DataFrame,
    names: DataFrame,
    store: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    encoder: Encoder,
    top_k: int = 10,
    mode: Mode | None = None,
) -> Answerable:
    """Both branches for every question.

    ``questions`` (qid, question); ``names`` (ord, entity_name); ``store`` the vector
    store with ``content``; ``edges`` scored by ``traverse.edge_scores``. What several
    later steps read (entities, hits, seeds, neighbours) is written once.
    """
    mode = mode or Mode()
    entities = cut(retrieval.question_entities(questions, names))
    analysed = retrieval.analyse(questions, entities)
    texts = retrieval.expand(questions) if mode.expand_query else questions.select(
        "qid", F.lit(0).alias("branch"), F.col("question").alias("text")
    )
    by_mode = {}
    if mode.use_analysis:
        analysed = cut(analysed)
        by_mode = {m: analysed.where(F.col("mode").isin(m, "hybrid")).select("qid") for m in ("vector", "graph")}
    searched = _only(texts, mode.use_global, by_mode.get("vector"))
    asked = encode(searched, encoder, "text").select(F.struct("qid", "branch").alias("qid"), "embedding")
    asked = asked.select(F.to_json("qid").alias("qid"), "embedding")
    keys = searched.select(F.to_json(F.struct("qid", "branch")).alias("key"), "qid", "branch")
    chunks = cut(retrieval.merge_chunks(hits_by_branch(vectors.search(store, asked, top_k), keys, store)))
    local = _only(entities, mode.use_local, by_mode.get("graph"))
    seeds = cut(traverse.find_seeds(local.select("qid", "entity"), nodes))
    found = cut(traverse.neighbours(seeds, edges, 2, top_k))
    contexts = traverse.contexts(seeds, nodes, found)
    paths = None
    if mode.use_multi_hop:
        starts = entities.select("qid", F.col("place").alias("ord"), F.col("entity").alias("start"))
        paths = traverse.paths(starts, edges)
    if mode.rerank:
        chunks = retrieval.rerank_chunks(chunks, entities)
        contexts = retrieval.rerank_contexts(contexts, questions)
    else:
        chunks, contexts = plain_ranks(chunks, contexts)
    chunks, contexts = cut(chunks), cut(contexts)
    counts = retrieval.result_counts(questions, chunks, contexts, paths, texts)
    best_chunks, best_contexts = retrieval.limit_results(chunks, contexts, top_k)
    return Answerable(analysed, best_chunks, best_contexts, counts, chunks, contexts, found, paths, texts)


def hits_by_branch(found: DataFrame, keys: DataFrame, store: DataFrame) -> DataFrame:
    """Neighbours of (question, branch) with the stored text: (qid, branch, place, chunk_id, score, filename, content)."""
    about = store.select("idx", "chunk_id", "filename", "content")
    return (
        vectors.scored_chunks(found.withColumnRenamed("qid", "key"), about.withColumn("embedding", F.lit(0)).withColumn("deleted", F.lit(0)))
        .join(keys, "key")
        .select("qid", "branch", "place", "chunk_id", "score", "filename", "content")
    )


def plain_ranks(chunks: DataFrame, contexts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ranks without reranking: retrieval order for chunks, score for contexts."""
    from pyspark.sql import Window

    by_order = Window.partitionBy("qid").orderBy("branch", "place")
    by_score = Window.partitionBy("qid").orderBy(F.desc("score"), "seed")
    return (
        chunks.withColumn("rank", F.row_number().over(by_order)),
        contexts.withColumn("rank", F.row_number().over(by_score)),
    )


def context(result: Answerable, keywords: DataFrame) -> DataFrame:
    """(qid, context) ready for the answering model."""
    relations = retrieval.relation_lines(result.neighbours, keywords)
    return retrieval.context_text(result.analysed, result.ranked_chunks, result.ranked_contexts, relations, result.paths)
