"""VEC1–VEC12: embedding texts, vector store and neighbour search."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.base import query
from catalog.inputs import CRC_STEPS, DERIVED, crc_sql, with_
from graphloom.functions import fixed
from graphloom.functions.encoders import HashingEncoder
from graphloom.operators import proximity as p
from graphloom.operators import vectors as v
from graphloom.operators.inference import encode
from graphloom.session import cut, shared_dir
from graphloom.sources import marked

# Asked vectors: the mean vector of each label over the whole table.
CENTRES = """
    parts AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings),
    means AS (SELECT label, p, avg(x::DOUBLE) AS x FROM parts GROUP BY ALL),
    asked AS (SELECT concat('label', label) AS qid, list(x ORDER BY p) AS q FROM means GROUP BY label)"""


def centres(i):
    parts = i.embeddings.select("label", F.posexplode("embedding").alias("p", "x"))
    means = parts.groupBy("label", "p").agg(F.avg(F.col("x").cast("double")).alias("x"))
    listed = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("p", "x")))["x"].alias("embedding"))
    return listed.select(F.concat(F.lit("label"), "label").alias("qid"), "embedding")


def knn_sql(where: str = "true", k: int = 5) -> str:
    return f"""{CENTRES},
    d AS (SELECT qid, idx, list_sum(list_transform(list_zip(embedding, q), lambda z: (z[1]::DOUBLE - z[2]) * (z[1]::DOUBLE - z[2]))) AS distance
          FROM fx_vectors, asked WHERE {where}),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY distance, idx) AS INTEGER) AS place FROM d QUALIFY place <= {k})"""


def reversed_(i):
    """Questions that are no vectors of the store: every 20th vector, its numbers in reverse order."""
    return i.fx_vectors.where("idx % 20 = 0").select(F.col("idx").alias("qid"), F.reverse("embedding").alias("embedding"))


SHOW = "SELECT qid, idx, round(distance, 6) AS distance, place, round(1 / (1 + distance), 6) AS similarity FROM r"


def shown(df):
    return df.select("qid", "idx", F.round("distance", 6).alias("distance"), "place", F.round("similarity", 6).alias("similarity"))


@query("vec1_texts", with_("""
    SELECT concat('doc_', doc_id) AS id, text, concat('doc_', doc_id) AS chunk_id, 'CHUNK' AS entity_type FROM documents
    UNION ALL SELECT concat('entity_', entity_name), concat(entity_name, ' (', entity_type, '): ', description), chunk_id, entity_type FROM fx_entities
    UNION ALL SELECT concat('rel_', source_id, '_', target_id, '_', chunk_id), concat(source_id, ' -> ', target_id, ': ', description, ' [', keywords, ']'), chunk_id, 'RELATIONSHIP' FROM fx_relationships"""))
def texts(i):
    chunks = i.documents.select(F.concat(F.lit("doc_"), "doc_id").alias("chunk_id"), F.col("text").alias("content"))
    return v.texts_to_embed(chunks, i.fx_entities, i.fx_relationships)


ENCODED = f"""{CRC_STEPS},
    said AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[^\\s\\x{{A0}}]+')) AS w FROM documents) GROUP BY ALL),
    codes AS (SELECT w, {crc_sql("w")} AS code FROM (SELECT DISTINCT w FROM said), crc),
    sums AS (SELECT doc_id, code % 64 AS p, sum(CASE WHEN (code >> 16) & 1 = 1 THEN n ELSE -n END) AS x FROM said JOIN codes USING (w) GROUP BY ALL),
    coded AS (SELECT doc_id, p, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS x FROM sums WHERE x <> 0)"""


@query("vec2_encoded", f"WITH {ENCODED} SELECT doc_id, CAST(p AS INTEGER) AS p, round(CAST(x AS FLOAT)::DOUBLE, 5) AS x FROM coded")
def encoded(i):
    """Whole documents encoded by the hashing encoder."""
    out = encode(i.dealt("documents").select("doc_id", "text"), HashingEncoder(64))
    numbers = out.select("doc_id", F.posexplode("embedding").alias("p", "x")).where("x <> 0")
    return numbers.withColumn("x", F.round(F.col("x").cast("double"), 5))


@query("vec3_unit", """
    SELECT vec_id, CAST(unnest(generate_series(1, len(embedding))) AS INTEGER) AS p,
           round(CAST(unnest(list_transform(embedding, lambda x: CAST(x * 3 / sqrt(list_sum(list_transform(embedding, lambda y: (y * 3)::DOUBLE * (y * 3)::DOUBLE))) AS FLOAT)))::DOUBLE AS DOUBLE), 6) AS x
    FROM embeddings WHERE len(embedding) = 64""")
def unit(i):
    scaled = i.embeddings.withColumn("embedding", F.transform("embedding", lambda x: x * F.lit(3).cast("float")))
    out = v.unit_vectors(v.right_size(scaled, 64))
    return out.select("vec_id", F.posexplode("embedding").alias("p", "x")).select(
        "vec_id", (F.col("p") + 1).alias("p"), F.round(F.col("x").cast("double"), 6).alias("x")
    )


@query("vec4_append", with_("""
    SELECT idx, doc_id, entity_type, deleted FROM fx_vectors
    UNION ALL SELECT (SELECT max(idx) FROM fx_vectors) + row_number() OVER (ORDER BY label, vec_id), concat('new', label), 'CHUNK', false FROM embeddings"""))
def append(i):
    new = i.embeddings.select(
        F.concat(F.lit("new"), "label").alias("doc_id"), F.col("vec_id").alias("order"), F.lit("CHUNK").alias("entity_type"), "embedding", "label"
    )
    return v.append_vectors(i.fx_vectors, new, ["label", "order"]).select("idx", "doc_id", "entity_type", "deleted")


@query("vec5_nearest", with_(f"WITH {knn_sql()} {SHOW}"))
def nearest(i):
    return shown(v.nearest(i.fx_vectors, centres(i), 5))


@query("vec5_pruned", with_(f"WITH {knn_sql()} {SHOW}"))
def pruned(i):
    """The same from blocks of an index, visited only where a neighbour can be."""
    return shown(p.nearest_in_blocks(p.index_blocks(i.fx_vectors, 8, block_rows=32), centres(i), 5)[0])


@query("vec5_visited", "SELECT count(*) AS questions, true AS some_left_alone FROM documents WHERE doc_id % 20 = 0")
def visited(i):
    """Whether exact search for every 20th encoded document leaves pairs of questions and blocks alone."""
    encoded = cut(encode(i.dealt("documents").select("doc_id", "text"), HashingEncoder(64)).select(F.col("doc_id").alias("idx"), "embedding"))
    asked = encoded.where("idx % 20 = 0").select(F.col("idx").alias("qid"), "embedding")
    report = p.nearest_in_blocks(p.index_blocks(encoded, 16, block_rows=32), asked, 3)[1]
    return report.select("questions", (F.col("visited") < F.col("pairs")).alias("some_left_alone"))


FILTERED = "NOT deleted AND doc_id IN ('doc1', 'doc2', 'doc5') AND entity_type IN ('CHUNK', 'ENTITY')"


@query("vec6_rings", with_(f"WITH {knn_sql(FILTERED, 4)} {SHOW}"))
def rings(i):
    """Filtered search: blocks are visited until no unvisited one can hold a nearer row that passes the filter."""
    index = p.index_blocks(i.fx_vectors, 8, block_rows=32).where(F.expr(FILTERED))
    return shown(p.nearest_in_blocks(index, centres(i), 4)[0])


@query("vec6_filtered", with_(f"""WITH {knn_sql("NOT deleted AND doc_id IN ('doc1', 'doc2', 'doc5') AND entity_type IN ('CHUNK', 'ENTITY')", 4)} {SHOW} WHERE similarity >= 0.45"""))
def filtered(i):
    return shown(v.search(i.fx_vectors, centres(i), 4, ["doc1", "doc2", "doc5"], ["CHUNK", "ENTITY"], 0.45)).where("similarity >= 0.45")


@query("vec6_overfetch", with_(f"""WITH {knn_sql('true', 20)},
    f AS (SELECT r.* EXCLUDE (place), CAST(row_number() OVER (PARTITION BY qid ORDER BY distance, idx) AS INTEGER) AS p2
          FROM r JOIN fx_vectors USING (idx) WHERE NOT deleted AND doc_id IN ('doc1', 'doc2', 'doc5') QUALIFY p2 <= 4)
    SELECT qid, idx, round(distance, 6) AS distance, p2 AS place, round(1 / (1 + distance), 6) AS similarity FROM f"""))
def overfetch(i):
    return shown(v.search(i.fx_vectors, centres(i), 4, ["doc1", "doc2", "doc5"], overfetch=5))


@query("vec7_cells")
def cells(i):
    """Approximate neighbours from 4 of 16 cells."""
    store, mid = v.build_cells(i.fx_vectors, 16)
    return shown(v.nearest_in_cells(store, mid, centres(i), 5, probes=4))


@query("vec7_graph")
def graph(i):
    """Approximate neighbours of every 20th vector, its own reversed, from the graph of neighbours."""
    found, _ = p.search_links(i.fx_vectors, p.build_links(i.fx_vectors), reversed_(i), 5)
    return shown(found)


@query("vec7_recall", with_("""SELECT 5 * count(*) AS wanted, true AS nine_of_ten, true AS fewer_distances FROM fx_vectors WHERE idx % 20 = 0"""))
def recall(i):
    """Whether the graph finds nine of ten exact neighbours, and takes fewer distances than the exact search."""
    found, report = p.search_links(i.fx_vectors, p.build_links(i.fx_vectors), reversed_(i), 5)
    exact = v.nearest(i.fx_vectors, reversed_(i), 5).select("qid", "idx")
    hits = exact.join(found.select("qid", "idx", F.lit(1).alias("hit")), ["qid", "idx"], "left")
    counted = hits.agg(F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("found"))
    return counted.crossJoin(F.broadcast(report)).select(
        "wanted", (F.col("found") >= 0.9 * F.col("wanted")).alias("nine_of_ten"),
        (F.col("distances") < F.col("questions") * F.col("vectors")).alias("fewer_distances"),
    )


@query("vec7_all_cells", with_(f"WITH {knn_sql()} {SHOW}"))
def all_cells(i):
    """With every cell probed the approximate search is exact."""
    store, mid = v.build_cells(i.fx_vectors, 16)
    return shown(v.nearest_in_cells(store, mid, centres(i), 5, probes=16))


# Documents to delete: labels whose events outweigh the average, here the two largest labels by vector count.
GONE = "SELECT doc_id FROM (SELECT doc_id, count(*) AS n FROM fx_vectors GROUP BY doc_id) ORDER BY n DESC, doc_id LIMIT 2"


def _deleted(i):
    return v.soft_delete(i.fx_vectors, i.sql(GONE))


@query("vec8_soft_delete", with_(f"WITH g AS ({GONE}) SELECT idx, doc_id, deleted OR doc_id IN (FROM g) AS deleted FROM fx_vectors"))
def soft_delete(i):
    return _deleted(i).select("idx", "doc_id", "deleted")


def _marked(i):
    """The store in files laid out by document, two deletions one after the other marked in them."""
    path = f"{shared_dir(i.spark)}/{uuid.uuid4().hex}"
    store = i.fx_vectors.select("idx", "doc_id", "entity_type", "deleted")
    marked.create(store.repartitionByRange(12, "doc_id", "idx").sortWithinPartitions("doc_id", "idx"), path)
    marked.delete(store.where("deleted"), path, ["idx"])
    marked.delete(i.sql(GONE), path)
    return path


@query("vec8_marked_rows", with_(f"""WITH g AS ({GONE}), s AS (SELECT *, CASE WHEN deleted THEN 1 WHEN doc_id IN (FROM g) THEN 2 END AS gone FROM fx_vectors)
    SELECT version, idx, doc_id, entity_type FROM s, (VALUES (0), (1), (2)) v(version) WHERE gone IS NULL OR gone > version"""))
def marked_rows(i):
    """All versions of a store whose rows are deleted by bitmaps."""
    path = _marked(i)
    parts = [marked.read(i.spark, path, n).select(F.lit(n).alias("version"), "idx", "doc_id", "entity_type") for n in marked.versions(i.spark, path)]
    return reduce(DataFrame.unionByName, parts)


@query("vec9_worn_files", with_(f"""WITH g AS ({GONE}), s AS (SELECT deleted OR doc_id IN (FROM g) AS dead FROM fx_vectors)
    SELECT count(*) FILTER (WHERE NOT dead) AS rows_left, true AS same_rows, true AS none_worn, true AS others_kept FROM s"""))
def worn_files(i):
    """Compaction of the files that lost more than a fifth: the rows that are left, and whether the other files kept their names."""
    path = _marked(i)
    before = cut(marked.read(i.spark, path))
    was = cut(marked.report(i.spark, path))
    version = marked.compact(i.spark, path)["version"]
    after, now = marked.read(i.spark, path, version), marked.report(i.spark, path, version)
    lost = was.where(f"share <= {fixed.REBUILD_SHARE}").join(now, "file", "left_anti")
    differ = before.exceptAll(after).unionByName(after.exceptAll(before))
    counts = after.agg(F.count(F.lit(1)).alias("rows_left"))
    return counts.select(
        "rows_left", F.lit(differ.isEmpty()).alias("same_rows"),
        F.lit(now.where(f"share > {fixed.REBUILD_SHARE}").isEmpty()).alias("none_worn"), F.lit(lost.isEmpty()).alias("others_kept"),
    )


@query("vec9_compacted", with_(f"""WITH g AS ({GONE})
    SELECT row_number() OVER (ORDER BY doc_id, idx) - 1 AS idx, doc_id, entity_type FROM fx_vectors WHERE NOT deleted AND doc_id NOT IN (FROM g)"""))
def compacted(i):
    return v.compact(_deleted(i))[0].select("idx", "doc_id", "entity_type")


@query("vec9_report", with_(f"""WITH g AS ({GONE}), s AS (SELECT deleted OR doc_id IN (FROM g) AS dead FROM fx_vectors)
    SELECT count(*) AS before, count(*) FILTER (WHERE NOT dead) AS after, count(*) FILTER (WHERE dead) AS removed FROM s"""))
def compact_report(i):
    return v.compact(_deleted(i))[1]


@query("vec10_statistics", with_(f"""WITH g AS ({GONE}), s AS (SELECT doc_id, deleted OR doc_id IN (FROM g) AS dead FROM fx_vectors)
    SELECT count(*) AS total, count(*) FILTER (WHERE NOT dead) AS active, count(*) FILTER (WHERE dead) AS deleted,
           round(count(*) FILTER (WHERE dead) / count(*)::DOUBLE, 6) AS deleted_share,
           count(DISTINCT CASE WHEN NOT dead THEN doc_id END) AS documents, 64::INTEGER AS dimension,
           count(*) FILTER (WHERE dead) > 0.2 * count(*) AS needs_rebuild FROM s"""))
def statistics(i):
    return v.statistics(_deleted(i), 64).withColumn("deleted_share", F.round("deleted_share", 6))


@query("vec11_document_map", with_("""SELECT doc_id, count(*) AS n_vectors, min(idx) AS first_idx, max(idx) AS last_idx
    FROM fx_vectors WHERE NOT deleted GROUP BY doc_id"""))
def document_map(i):
    return v.document_map(i.fx_vectors)


def coded_sql(name: str, key: str, text: str, table: str) -> str:
    """WITH entries up to ``name`` (key, p, x): unit vectors of the hashing encoder with 64 numbers, without zeros."""
    return f"""{name}_w AS (SELECT k, w, count(*) AS n FROM (SELECT {key} AS k, unnest(regexp_extract_all(lower({text}), '[^\\s\\x{{A0}}]+')) AS w FROM {table}) GROUP BY ALL),
    {name}_c AS (SELECT w, {crc_sql("w")} AS code FROM (SELECT DISTINCT w FROM {name}_w), crc),
    {name}_s AS (SELECT k, code % 64 AS p, sum(CASE WHEN (code >> 16) & 1 = 1 THEN n ELSE -n END) AS x FROM {name}_w JOIN {name}_c USING (w) GROUP BY ALL),
    {name} AS (SELECT k, p, CAST(x / sqrt(sum(x * x) OVER (PARTITION BY k)) AS FLOAT)::DOUBLE AS x FROM {name}_s WHERE x <> 0)"""


@query("vec12_search_text", with_(f"""WITH {CRC_STEPS}, {coded_sql("dv", "doc_id", "text", "documents")}, {coded_sql("qv", "qid", "question", "fx_questions")},
    ds AS (SELECT doc_id, coalesce(sum(x * x), 0) AS size FROM documents LEFT JOIN dv ON k = doc_id GROUP BY doc_id),
    qs AS (SELECT qid, coalesce(sum(x * x), 0) AS size FROM fx_questions LEFT JOIN qv ON k = qid GROUP BY qid),
    dots AS (SELECT q.k AS qid, d.k AS doc_id, sum(q.x * d.x) AS dot FROM qv q JOIN dv d USING (p) GROUP BY ALL),
    far AS (SELECT qid, doc_id, ds.size + qs.size - 2 * coalesce(dot, 0) AS distance FROM ds CROSS JOIN qs LEFT JOIN dots USING (qid, doc_id)),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(distance, 9), doc_id) AS INTEGER) AS place FROM far QUALIFY place <= 3)
    SELECT qid, place, doc_id AS idx, concat('doc', doc_id) AS doc_id, round(1 / (1 + distance), 6) AS score FROM r"""))
def search_text(i):
    """Nearest documents of every user turn, by the hashing encoder."""
    store = encode(
        i.dealt("documents").select(F.col("doc_id").alias("idx"), F.concat(F.lit("doc"), "doc_id").alias("doc_id"), F.lit("CHUNK").alias("entity_type"),
                           F.lit(False).alias("deleted"), F.col("text")), HashingEncoder(64)
    )
    found = v.search_text(store.drop("text"), i.fx_questions, HashingEncoder(64), 3)
    return v.scored_chunks(found, store.select("idx", "doc_id", "entity_type")).select(
        "qid", "place", "idx", "doc_id", F.round("score", 6).alias("score")
    )
