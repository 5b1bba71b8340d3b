"""Vector store: texts to embed, unit vectors, exact and approximate neighbours, deletion, compaction."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions import fixed
from graphloom.operators.inference import Encoder, encode
from graphloom.operators.spread import dense_index, join_lookup
from graphloom.session import cut

QUERY_BLOCK = 4096
VECTOR_BLOCK = 8192
#: Packed questions of this size are sent to all executors.
SENT_BYTES = 16_000_000
#: Questions whose candidates a task holds before it hands them on.
HELD_QUESTIONS = 50_000
#: Parts of a question's candidates that are ranked by themselves first.
RANK_PARTS = 16


# ------------------------------------------------------------------ texts


def texts_to_embed(chunks: DataFrame, entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """One row per vector to be made: (id, text, chunk_id, entity_type), and doc_id where all three tables have it."""
    empty = F.lit("")
    own = ["doc_id"] if all("doc_id" in t.columns for t in (chunks, entities, relationships)) else []
    a = chunks.select(*own, F.col("chunk_id").alias("id"), F.col("content").alias("text"), "chunk_id", F.lit("CHUNK").alias("entity_type"))
    b = entities.select(
        *own,
        F.concat(F.lit("entity_"), "entity_name").alias("id"),
        F.concat("entity_name", F.lit(" ("), "entity_type", F.lit("): "), F.coalesce("description", empty)).alias("text"),
        "chunk_id",
        "entity_type",
    )
    c = relationships.select(
        *own,
        F.concat(F.lit("rel_"), "source_id", F.lit("_"), "target_id", F.lit("_"), F.coalesce("chunk_id", empty)).alias("id"),
        F.concat(
            "source_id", F.lit(" -> "), "target_id", F.lit(": "), F.coalesce("description", empty),
            F.lit(" ["), F.coalesce("keywords", empty), F.lit("]"),
        ).alias("text"),
        "chunk_id",
        F.lit("RELATIONSHIP").alias("entity_type"),
    )
    return a.unionByName(b).unionByName(c)


def unit_vectors(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Scale every vector to length one; a zero vector stays as it is."""
    length = F.sqrt(F.aggregate(column, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    scaled = F.transform(column, lambda x: (x.cast("double") / length).cast("float"))
    return df.withColumn(column, F.when(length > 0, scaled).otherwise(F.col(column)))


def right_size(df: DataFrame, dim: int = fixed.EMBEDDING_DIM, column: str = "embedding") -> DataFrame:
    """Rows whose vector has exactly ``dim`` numbers."""
    return df.where(F.size(column) == dim)


# ------------------------------------------------------------------ store


def append_vectors(store: DataFrame, new: DataFrame, order: Sequence[str] = ("doc_id", "order")) -> DataFrame:
    """Append rows with ids that continue densely after the largest id in the store."""
    last = store.agg(F.max("idx")).first()[0]
    numbered = dense_index(new, list(order), "idx", start=0 if last is None else last + 1)
    numbered = numbered.withColumn("deleted", F.lit(False))
    return store.unionByName(numbered, allowMissingColumns=True)


def soft_delete(store: DataFrame, documents: DataFrame) -> DataFrame:
    """Mark the vectors of the given documents as deleted."""
    gone = documents.select("doc_id").distinct().withColumn("__gone", F.lit(True))
    return (
        join_lookup(store, gone, ["doc_id"], "left")
        .withColumn("deleted", F.col("deleted") | F.coalesce("__gone", F.lit(False)))
        .drop("__gone")
    )


def statistics(store: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """Totals, deleted share, documents and whether the store should be compacted, one row."""
    total, dead = F.count(F.lit(1)), F.count(F.when(F.col("deleted"), 1))
    return store.agg(
        total.alias("total"),
        (total - dead).alias("active"),
        dead.alias("deleted"),
        F.coalesce(dead / total, F.lit(0.0)).alias("deleted_share"),
        F.countDistinct(F.when(~F.col("deleted"), F.col("doc_id"))).alias("documents"),
        F.lit(dim).alias("dimension"),
        (dead > total * fixed.REBUILD_SHARE).alias("needs_rebuild"),
    )


def compact(store: DataFrame, order: Sequence[str] = ("doc_id", "idx")) -> tuple[DataFrame, DataFrame]:
    """(store without deleted rows, renumbered densely in document order; before/after/removed)."""
    alive = store.where(~F.col("deleted"))
    new = dense_index(alive, list(order), "new_idx").withColumn("idx", F.col("new_idx")).drop("new_idx")
    report = store.agg(
        F.count(F.lit(1)).alias("before"),
        F.count(F.when(~F.col("deleted"), 1)).alias("after"),
        F.count(F.when(F.col("deleted"), 1)).alias("removed"),
    )
    return new, report


def document_map(store: DataFrame) -> DataFrame:
    """Per document: vectors and the id range they cover."""
    return store.where(~F.col("deleted")).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_vectors"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx")
    )


# ----------------------------------------------------------------- search


def _closest(x: np.ndarray, ids: np.ndarray, asked: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each asked vector the k smallest squared distances to rows of x, ties by id.

    A matrix product finds who can be among the best; their distances are then
    computed exactly, so equal vectors get equal distances.
    """
    size = (x * x).sum(axis=1)
    for start in range(0, len(asked), 256):
        block = asked[start : start + 256]
        rough = size[:, None] - 2.0 * (x @ block.T) + (block * block).sum(axis=1)
        bound = np.partition(rough, k - 1, axis=0)[k - 1] if len(x) > k else np.full(len(block), np.inf)
        for n, q in enumerate(block):
            keep = np.flatnonzero(rough[:, n] <= bound[n] + 1e-9)
            exact = ((x[keep] - q) ** 2).sum(axis=1)
            order = np.lexsort((ids[keep], exact))[:k]
            yield exact[order], ids[keep][order]


def _packed(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Vectors put together, up to ``size`` of one partition in a row: ``cell`` (if there is one), ``keys`` and ``matrix``."""
    by_cell = "cell" in rows.columns
    fields = [T.StructField("keys", T.ArrayType(rows.schema[key].dataType)), T.StructField("matrix", T.BinaryType())]
    schema = T.StructType(([T.StructField("cell", T.LongType())] if by_cell else []) + fields)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for cell, own in frame.groupby("cell", sort=False) if by_cell else [(None, frame)]:
                for at in range(0, len(own), size):
                    part = own.iloc[at : at + size]
                    matrix = np.stack(part["embedding"].to_numpy()).astype(np.float64).tobytes()
                    row = {"keys": [part[key].tolist()], "matrix": [matrix]}
                    yield pd.DataFrame({"cell": [int(cell)], **row} if by_cell else row)

    columns = [key, "embedding", *(["cell"] if by_cell else [])]
    return rows.select(*columns).mapInPandas(work, schema)


def _met(pairs: DataFrame, k: int, qid_type: T.DataType) -> DataFrame:
    """The best ``k`` of every question in each partition of packed pairs (keys, matrix, qids, asked)."""
    schema = T.StructType(
        [T.StructField("qid", qid_type), T.StructField("idx", T.LongType()), T.StructField("distance", T.DoubleType())]
    )

    def told(best: dict) -> pd.DataFrame:
        n = [len(d) for d, _ in best.values()]
        return pd.DataFrame(
            {"qid": [q for q, c in zip(best, n) for _ in range(c)], "idx": np.concatenate([i for _, i in best.values()]),
             "distance": np.concatenate([d for d, _ in best.values()])}
        )

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict = {}
        for frame in frames:
            for keys, matrix, qids, asked in zip(frame["keys"], frame["matrix"], frame["qids"], frame["asked"]):
                x = np.frombuffer(matrix).reshape(len(keys), -1)
                q = np.frombuffer(asked).reshape(len(qids), -1)
                for name, (d, i) in zip(qids, _closest(x, np.asarray(keys), q, k)):
                    if name in best:
                        d, i = np.concatenate([best[name][0], d]), np.concatenate([best[name][1], i])
                        order = np.lexsort((i, d))[:k]
                        d, i = d[order], i[order]
                    best[name] = (d, i)
                if len(best) > HELD_QUESTIONS:
                    yield told(best)
                    best = {}
        if best:
            yield told(best)

    return pairs.select("keys", "matrix", "qids", "asked").mapInPandas(work, schema)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` per question: first of each of a few parts of its candidates, then of what is left."""
    part = F.pmod(F.xxhash64("idx"), F.lit(RANK_PARTS))
    for keys in (["qid", "__part"], ["qid"]):
        place = Window.partitionBy(*keys).orderBy("distance", "idx")
        found = (found.withColumn("__part", part) if len(keys) > 1 else found.drop("__part")).withColumn("place", F.row_number().over(place))
        found = found.where(F.col("place") <= k)
    return found.withColumn("similarity", 1.0 / (1.0 + F.col("distance")))


def _asked(queries: DataFrame, block: int) -> DataFrame:
    return cut(_packed(queries, "qid", block).withColumnsRenamed({"keys": "qids", "matrix": "asked"}))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = QUERY_BLOCK) -> DataFrame:
    """Exact k nearest vectors per query by squared distance: (qid, idx, distance, place, similarity).

    Queries (qid, embedding) and vectors are packed into blocks where they are, and every block of queries meets
    every block of vectors: a stated set of questions against all rows, with nothing of either on the driver. Queries
    of ``SENT_BYTES`` at most are sent to all vectors; more are joined by the numbers of their blocks to the vectors,
    which are packed and written once. A task keeps k candidates per query, and these are ranked in two levels.
    ``proximity.nearest_in_blocks`` gives the same from an index without a meeting of all blocks.
    """
    asked = _asked(queries.select("qid", "embedding"), block)
    held = _packed(vectors.select("idx", "embedding"), "idx", VECTOR_BLOCK)
    size = asked.agg(F.sum(F.length("asked"))).first()[0] or 0
    if size <= SENT_BYTES:
        pairs = held.join(F.broadcast(asked))
    else:
        numbered = cut(asked.withColumn("__n", F.monotonically_increasing_id()))
        numbers = [r[0] for r in numbered.select("__n").collect()]  # one for each block of queries
        pairs = cut(held).withColumn("__n", F.explode(F.lit(numbers))).join(numbered, "__n")
    return _ranked(_met(pairs, k, queries.schema["qid"].dataType), k)


def search(
    store: DataFrame,
    queries: DataFrame,
    k: int = 5,
    documents: Sequence[str] | None = None,
    kinds: Sequence[str] | None = None,
    min_score: float = 0.0,
    skip_deleted: bool = True,
    overfetch: int | None = None,
) -> DataFrame:
    """Neighbours among the wanted rows of the store.

    Rows are filtered before ranking, so k results come back whenever they exist.
    With ``overfetch=m`` the best k·m of all rows are ranked first and filtered
    afterwards, which can return fewer.
    """
    wanted = F.lit(True)
    if skip_deleted:
        wanted = wanted & ~F.col("deleted")
    if documents is not None:
        wanted = wanted & F.col("doc_id").isin(list(documents))
    if kinds is not None:
        wanted = wanted & F.col("entity_type").isin(list(kinds))
    if overfetch is None:
        found = nearest(store.where(wanted), queries, k)
    else:
        pool = nearest(store, queries, k * overfetch).drop("place")
        found = _ranked(join_lookup(pool, store.where(wanted).select("idx"), ["idx"]), k)
    return found.where(F.col("similarity") >= min_score)


def scored_chunks(found: DataFrame, store: DataFrame) -> DataFrame:
    """Attach the stored columns to neighbours."""
    about = store.drop("embedding", "deleted")
    return join_lookup(about, found, ["idx"]).withColumn("score", F.col("similarity"))


def search_text(store: DataFrame, questions: DataFrame, encoder: Encoder, k: int = 5, **filters) -> DataFrame:
    """Encode question texts (qid, question) and search."""
    queries = encode(questions.select("qid", "question"), encoder, "question").select("qid", "embedding")
    return search(store, queries, k, **filters)


# ------------------------------------------------------------ approximate


def build_cells(vectors: DataFrame, n_cells: int, seed: int = 7) -> tuple[DataFrame, np.ndarray]:
    """(vectors with the nearest of ``n_cells`` centres as ``cell``, the centres).

    Centres are learnt from all rows; the assigned vectors are written once.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    points = vectors.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
    model = KMeans(k=n_cells, seed=seed, maxIter=10, predictionCol="cell").fit(points.select("features"))
    return cut(model.transform(points).drop("features")), np.array(model.clusterCenters())


def nearest_in_cells(
    vectors: DataFrame, centres: np.ndarray, queries: DataFrame, k: int = 5, probes: int = 4, block: int = QUERY_BLOCK
) -> DataFrame:
    """Approximate neighbours: only the ``probes`` cells nearest to a query are looked through.

    Queries find their cells on the executors and meet the vectors by an equal join on the cell, which
    adaptive execution splits where a cell is large.
    """
    schema = T.StructType([*queries.select("qid", "embedding").schema, T.StructField("cell", T.LongType())])
    shared = queries.sparkSession.sparkContext.broadcast(centres)

    def probed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mid = shared.value
        size = (mid * mid).sum(axis=1)
        for frame in frames:
            for at in range(0, len(frame), 1024):
                part = frame.iloc[at : at + 1024]
                if len(part):
                    q = np.stack(part["embedding"].to_numpy()).astype(np.float64)
                    near = np.argsort(size - 2.0 * (q @ mid.T), axis=1, kind="stable")[:, :probes]
                    yield part.loc[part.index.repeat(near.shape[1])].assign(cell=near.ravel().astype(np.int64))

    asked = _asked(queries.select("qid", "embedding").mapInPandas(probed, schema), block)
    held = _packed(vectors.select("idx", "embedding", F.col("cell").cast("long").alias("cell")), "idx", VECTOR_BLOCK)
    return _ranked(_met(held.join(asked, "cell"), k, queries.schema["qid"].dataType), k)
