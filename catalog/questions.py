"""RET1–RET13: question analysis, dual retrieval, reranking and context text."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query
from catalog.graph import NODES
from catalog.links import near, ratio_sql
from catalog.records import spotted_sql
from catalog.inputs import DERIVED, with_
from catalog.vectors import CENTRES, centres
from catalog.walk import HOPS, found, walk_edges
from graphloom.functions import fixed
from graphloom.functions import questions as q
from graphloom.functions.encoders import HashingEncoder
from graphloom.operators import graph as g
from graphloom.operators import retrieval as r
from graphloom.operators import traverse as t
from graphloom.operators import vectors as v
from graphloom.plans import ask
from graphloom.session import cut

# All questions: the user turns and the generated questions about parts.
DERIVED["fx_asked"] = """
    SELECT concat('t', qid) AS qid, question FROM fx_questions UNION ALL SELECT qid, question FROM fx_part_questions"""
EDGE = r"[^\p{L}\p{N}_]"


def word_sql(column: str, phrases: list[str]) -> str:
    return rf"regexp_matches({column}, '(^|{EDGE})({'|'.join(phrases)})($|{EDGE})')"


INTENT = "CASE " + " ".join(f"WHEN {word_sql('lower(question)', p)} THEN '{n}'" for n, p in fixed.INTENTS) + " ELSE 'fact' END"


@query("ret1_intent", with_(f"SELECT qid, {INTENT} AS intent FROM fx_asked"))
def intent(i):
    return i.fx_asked.select("qid", q.intent(F.col("question")).alias("intent"))


STOP = ", ".join(f"'{w}'" for w in fixed.QUESTION_STOP_WORDS)


@query("ret2_keywords", with_(rf"""WITH w AS (SELECT qid, list_filter(regexp_extract_all(lower(question), '[\p{{L}}\p{{N}}_]+'),
        lambda t: length(t) > 2 AND NOT list_contains([{STOP}], t))[1:10] AS k FROM fx_asked)
    SELECT qid, CAST(unnest(generate_series(0, len(k) - 1)) AS INTEGER) AS p, unnest(k) AS keyword FROM w"""))
def keywords(i):
    return i.fx_asked.select("qid", F.posexplode(q.keywords(F.col("question"))).alias("p", "keyword"))


KNOWN = """SELECT DISTINCT qid, lower(entity_name) AS low FROM fx_asked JOIN (SELECT DISTINCT entity_name FROM fx_entities) ON contains(lower(question), lower(entity_name))"""


@query("ret3_known_entities", with_(KNOWN))
def known(i):
    return r.known_entities(i.fx_asked, i.fx_entities).select("qid", "low")


@query("ret4_question_entities", with_(rf"""WITH RECURSIVE dict AS (SELECT lower(entity_name) AS low, min(ord) AS ord, arg_max(entity_name, (ord, entity_name)) AS entity FROM fx_entities GROUP BY 1),
    known AS ({KNOWN}),
    words AS (SELECT qid, list_filter(regexp_split_to_array(question, '\s+'), lambda x: x <> '') AS w FROM fx_asked),
    starts AS (SELECT qid, w, unnest(range(0, len(w))) AS i FROM words),
    runs AS (SELECT qid, w, i, unnest(range(1, least(3, len(w) - i) + 1)) AS n FROM starts),
    spoken AS (SELECT qid, i, n, lower(array_to_string(list_slice(w, i + 1, i + n), ' ')) AS phrase FROM runs),
    open_ AS (SELECT s.* FROM spoken s LEFT JOIN known k ON k.qid = s.qid AND k.low = s.phrase WHERE k.qid IS NULL),
    {ratio_sql(f"SELECT a, b FROM (SELECT DISTINCT phrase AS a FROM open_ WHERE phrase <> ''), (SELECT low AS b FROM dict WHERE length(low) >= 4) WHERE {near(0.9)}")},
    close AS (SELECT a AS phrase, arg_min(entity, (ord, low)) AS entity FROM ratios JOIN dict ON b = low WHERE score > 0.9 GROUP BY a),
    named AS (SELECT qid, 0 AS level, ord AS pos, 0::BIGINT AS n, entity FROM known JOIN dict USING (low)
        UNION ALL SELECT qid, 1, i, n, entity FROM open_ JOIN close USING (phrase)),
    {spotted_sql('qid', 'question', 'fx_asked')},
    every AS (FROM named UNION ALL SELECT qid, 2, place, 0, entity FROM spotted WHERE qid NOT IN (SELECT qid FROM named)),
    firsts AS (SELECT qid, entity, min({{'level': level, 'pos': pos, 'n': n}}) AS f FROM every GROUP BY ALL)
    SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY f, entity) AS INTEGER) AS place, entity FROM firsts QUALIFY place <= 5"""))
def question_entities(i):
    return r.question_entities(i.fx_asked, i.fx_entities)


@query("ret5_mode", with_(f"""WITH a AS (SELECT qid, {INTENT} AS intent FROM fx_asked), k AS (SELECT DISTINCT qid FROM ({KNOWN}))
    SELECT qid, intent, CASE WHEN qid IN (FROM k) OR intent IN ('reasoning', 'comparison') THEN 'hybrid' ELSE 'vector' END AS mode,
           CASE intent WHEN 'summary' THEN 10 WHEN 'comparison' THEN 8 ELSE 5 END AS top_k FROM a"""))
def mode(i):
    has = r.known_entities(i.fx_asked, i.fx_entities).select("qid").distinct().withColumn("has", F.lit(True))
    asked = i.fx_asked.join(has, "qid", "left").withColumn("intent", q.intent(F.col("question")))
    return asked.select(
        "qid", "intent", q.retrieval_mode(F.col("intent"), F.coalesce("has", F.lit(False))).alias("mode"), q.wanted_chunks(F.col("intent")).alias("top_k")
    )


def expand_sql(hit) -> str:
    whens = " ".join(f"WHEN {hit(t_)} THEN [question, '{s[0]}', '{s[1]}']" for t_, s in fixed.SYNONYMS)
    return f"""WITH x AS (SELECT qid, CASE {whens} ELSE [question] END AS texts FROM fx_asked)
        SELECT qid, CAST(unnest(generate_series(0, len(texts) - 1)) AS INTEGER) AS branch, unnest(texts) AS text FROM x"""


@query("ret6_expanded", with_(expand_sql(lambda term: word_sql("lower(question)", [term]))))
def expanded(i):
    return r.expand(i.fx_asked)


@query("ret6_expanded_inside_words", with_(expand_sql(lambda term: f"contains(lower(question), '{term}')")))
def expanded_inside(i):
    return r.expand(i.fx_asked, whole_words=False)


# Dual retrieval for the questions about nations: the vectors asked for are the label means.
DERIVED["fx_nation_questions"] = "SELECT n_name AS qid, concat('What is made in ', n_name) AS question FROM nation"
VECTOR_BRANCH = f"""{CENTRES},
    vd AS (SELECT replace(qid, 'label', 'NATION_') AS qid, idx, list_sum(list_transform(list_zip(embedding, q), lambda z: (z[1]::DOUBLE - z[2]) * (z[1]::DOUBLE - z[2]))) AS distance
           FROM fx_vectors, asked WHERE NOT deleted),
    vb AS (SELECT qid, idx, round(1 / (1 + distance), 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY distance, idx) AS vplace FROM vd QUALIFY vplace <= 5)"""
GRAPH_BRANCH = f"""{HOPS}, {NODES.replace('fx_entities', 'fx_walk_entities')},
    sums AS (SELECT qid, seed, avg(importance) FILTER (WHERE hop = 1) AS average, count(*) FILTER (WHERE hop = 1) AS n_relationships, count(*) AS n_neighbours
             FROM both_hops GROUP BY ALL),
    ctx AS (SELECT qid, seed, type, description, coalesce(n_relationships, 0) AS n_relationships, coalesce(n_neighbours, 0) AS n_neighbours,
                   least(1.0::DOUBLE, coalesce(average * (n_neighbours / 10.0::DOUBLE), 0)) AS score
            FROM fx_seeds s JOIN nodes n ON n.node_id = s.seed LEFT JOIN sums USING (qid, seed))"""


def _vector_branch(i):
    asked = _centres(i).withColumn("qid", F.regexp_replace("qid", "label", "NATION_"))
    return v.search(i.fx_vectors, asked, 5)


def _centres(i):
    return centres(i)


@query("ret7_dual", with_(f"""{GRAPH_BRANCH}, {VECTOR_BRANCH}
    SELECT qid, 'chunk' AS kind, CAST(idx AS VARCHAR) AS item, score FROM vb
    UNION ALL SELECT qid, 'entity', seed, round(score, 6) FROM ctx"""))
def dual(i):
    chunks = _vector_branch(i).select("qid", F.lit("chunk").alias("kind"), F.col("idx").cast("string").alias("item"), F.round("similarity", 6).alias("score"))
    ctx = t.contexts(i.fx_seeds, g.summarised_nodes(i.fx_walk_entities), found(i, 2))
    return chunks.unionByName(ctx.select("qid", F.lit("entity").alias("kind"), F.col("seed").alias("item"), F.round("score", 6).alias("score")))


# Hits of three branches: for each nation, the order lines of its suppliers.
DERIVED["fx_hits"] = """
    SELECT n_name AS qid, CAST(l_linenumber % 3 AS INTEGER) AS branch, l_orderkey * 10 + l_linenumber AS place, concat('c', l_orderkey) AS chunk_id,
           l_discount * 5 AS score, concat('file_', l_returnflag, '.txt') AS filename,
           concat(upper(p_name), ' of ', p_brand, ' ', p_type, repeat(concat(' ', l_returnflag, l_linestatus), CAST(l_quantity AS INTEGER))) AS content
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey"""
DERIVED["fx_hit_entities"] = """
    SELECT DISTINCT n_name AS qid, p_name AS entity FROM part JOIN nation ON n_nationkey = p_size % 25
    WHERE p_name LIKE '%ring' OR p_name LIKE 'old%'"""
MERGED = """m AS (SELECT qid, chunk_id, unnest(arg_min({'branch': branch, 'place': place, 'score': score, 'filename': filename, 'content': content},
                  (branch, place, score, filename, content))) FROM fx_hits GROUP BY qid, chunk_id)"""
RERANKED = f"""{MERGED},
    rr AS (SELECT qid, chunk_id, filename, content, round(least(1.0::DOUBLE, score + 0.1::DOUBLE * (SELECT count(*) FROM fx_hit_entities e WHERE e.qid = m.qid AND contains(lower(content), lower(entity)))
                  + least(length(content) / 1000.0::DOUBLE, 0.2::DOUBLE)), 9) AS score FROM m),
    rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM rr)"""


@query("ret8_merged", with_(f"WITH {MERGED} SELECT qid, chunk_id, branch, place, score FROM m"))
def merged(i):
    return r.merge_chunks(i.fx_hits).select("qid", "chunk_id", "branch", "place", "score")


def _reranked(i):
    return r.rerank_chunks(r.merge_chunks(i.fx_hits), i.fx_hit_entities)


@query("ret9_reranked_chunks", with_(f"WITH {RERANKED} SELECT qid, chunk_id, rank, round(score, 6) AS score FROM rk"))
def reranked(i):
    return _reranked(i).select("qid", "chunk_id", "rank", F.round("score", 6).alias("score"))


CTX_RANKED = """
    cr AS (SELECT qid, seed, type, description, n_relationships, n_neighbours,
                  round(least(1.0::DOUBLE, score * 0.3::DOUBLE + CASE WHEN contains(lower(concat('What is made in ', qid)), lower(seed)) THEN 0.3::DOUBLE ELSE 0 END
                        + least(n_relationships / 10.0::DOUBLE, 0.2::DOUBLE)), 9) AS score FROM ctx),
    ck AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, seed) AS INTEGER) AS rank FROM cr)"""


def _contexts(i):
    """Contexts of the nation questions, scores scaled down so that few reach the cap."""
    near = cut_found(i)
    ctx = t.contexts(i.fx_seeds, g.summarised_nodes(i.fx_walk_entities), near).withColumn("score", F.col("score") * 0.3)
    return near, r.rerank_contexts(ctx, i.fx_nation_questions)


def cut_found(i):
    return cut(found(i, 2))


@query("ret10_reranked_contexts", with_(f"{GRAPH_BRANCH}, {CTX_RANKED} SELECT qid, seed, rank, round(score, 6) AS score FROM ck"))
def reranked_contexts(i):
    return _contexts(i)[1].select("qid", "seed", "rank", F.round("score", 6).alias("score"))


@query("ret11_limited", with_(f"""{GRAPH_BRANCH}, {CTX_RANKED}, {RERANKED}
    SELECT qid, 'chunk' AS kind, chunk_id AS item, rank FROM rk WHERE rank <= 5
    UNION ALL SELECT qid, 'entity', seed, rank FROM ck WHERE rank <= 2"""))
def limited(i):
    chunks, ctx = r.limit_results(_reranked(i), _contexts(i)[1], 5)
    return chunks.select("qid", F.lit("chunk").alias("kind"), F.col("chunk_id").alias("item"), "rank").unionByName(
        ctx.select("qid", F.lit("entity").alias("kind"), F.col("seed").alias("item"), "rank")
    )


@query("ret11_counts", with_(f"""WITH {RERANKED}
    SELECT n_name AS qid, (SELECT count(*) FROM rk WHERE rk.qid = n_name) AS num_chunks, (SELECT count(*) FROM fx_seeds s WHERE s.qid = n_name) AS num_entities,
           0::BIGINT AS num_paths, 1::BIGINT AS expanded_queries FROM nation"""))
def counts(i):
    asked = i.fx_nation_questions
    return r.result_counts(asked, r.merge_chunks(i.fx_hits), i.fx_seeds, None, r.expand(asked))


@query("ret12_chunk_block", with_(f"""WITH {RERANKED}
    SELECT qid, string_agg(concat('[', rank, '] **Score: ', printf('%.3f', score + 1e-9), '** | ', filename, chr(10), left(content, 200), '...', chr(10)), chr(10) ORDER BY rank) AS chunk_text
    FROM rk WHERE rank <= 7 GROUP BY qid"""))
def chunk_block(i):
    return r.chunk_block(_reranked(i))


@query("ret12_context_block", with_(f"""{GRAPH_BRANCH}, {CTX_RANKED},
    kws AS (SELECT source_id, target_id, string_agg(keyword, ',' ORDER BY keyword) AS kw FROM ekw GROUP BY ALL),
    lines AS (SELECT qid, seed, string_agg(concat('       • ', kw, ' → ', target, ' [', kw, ']'), chr(10) ORDER BY place) AS rel
              FROM h1 JOIN kws ON source_id = seed AND target_id = target WHERE place <= 3 GROUP BY ALL)
    SELECT qid, string_agg(concat('[', rank, '] **', seed, '** (', type, ')', chr(10), '     ', left(description, 150),
           CASE WHEN rel IS NOT NULL THEN concat(chr(10), '     Relationships:', chr(10), rel) ELSE '' END, chr(10)), chr(10) ORDER BY rank) AS graph_text
    FROM ck LEFT JOIN lines USING (qid, seed) WHERE rank <= 7 GROUP BY qid"""))
def context_block(i):
    near, ctx = _contexts(i)
    return r.context_block(ctx, r.relation_lines(near, g.edge_keywords(i.fx_walk)))


RET13 = f"""{GRAPH_BRANCH}, {CTX_RANKED},
    kws AS (SELECT source_id, target_id, string_agg(keyword, ',' ORDER BY keyword) AS kw FROM ekw GROUP BY ALL),
    lines AS (SELECT qid, seed, string_agg(concat('     • ', seed, ' → ', target, ' [', kw, '] (strength: ', printf('%.2f', h1.strength + 1e-9), '): ', left(e.description, 80)), chr(10) ORDER BY place) AS rel
              FROM h1 JOIN kws ON kws.source_id = seed AND kws.target_id = target JOIN edges e ON e.source_id = seed AND e.target_id = target GROUP BY ALL),
    near AS (SELECT qid, seed, target, row_number() OVER (PARTITION BY qid, seed ORDER BY hop, place) AS nth FROM both_hops QUALIFY nth <= 3),
    names AS (SELECT qid, seed, string_agg(target, ', ' ORDER BY nth) AS names FROM near GROUP BY ALL)
    SELECT qid, seed, rank AS place, concat('**', seed, '** (', type, ')', chr(10), '    ', description,
           CASE WHEN rel IS NOT NULL THEN concat(chr(10), '    Relationships:', chr(10), rel) ELSE '' END,
           CASE WHEN n_neighbours > n_relationships THEN concat(chr(10), '    ', n_neighbours - n_relationships, ' more connections: ', names, '...') ELSE '' END) AS text
    FROM ck LEFT JOIN lines USING (qid, seed) LEFT JOIN names USING (qid, seed)"""


@query("ret13_graph_text", with_(RET13))
def graph_text(i):
    near, ctx = _contexts(i)
    edges = g.summarised_edges(i.fx_walk, strength="avg").select("source", "target", "description")
    return r.graph_text(ctx, near, edges, g.edge_keywords(i.fx_walk))


@query("ret13_context", with_(f"""WITH blocks AS (FROM ({RET13}))
    SELECT qid, concat('{fixed.GRAPH_CONTEXT_TITLE}', chr(10), chr(10), string_agg(concat(place, '. ', text), chr(10) || chr(10) ORDER BY place), chr(10)) AS context
    FROM blocks GROUP BY qid"""))
def graph_context(i):
    """The same as one text a question."""
    return r.graph_context(graph_text(i))


@query("ret12_full_context")
def full_context(i):
    """Questions about parts answered end to end with the hashing encoder over all documents."""
    from graphloom.operators.inference import encode

    docs = i.dealt("documents").select(
        F.col("doc_id").alias("idx"), F.concat(F.lit("d"), "doc_id").alias("doc_id"), F.concat(F.lit("c"), "doc_id").alias("chunk_id"),
        F.concat("source", F.lit(".txt")).alias("filename"), F.lit("CHUNK").alias("entity_type"), F.lit(False).alias("deleted"), F.col("text").alias("content"),
    )
    store = cut(encode(docs, HashingEncoder(64), "content"))
    result = ask.retrieve(
        i.fx_part_questions, i.fx_entities, store, cut(g.summarised_nodes(i.fx_entities)), walk_edges(i), HashingEncoder(64), 5, ask.Mode(expand_query=True)
    )
    return ask.context(result, g.edge_keywords(i.fx_walk))
