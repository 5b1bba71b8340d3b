"""Model tables derived from the supplied tables.

Each is one SELECT that Spark and DuckDB read alike: the query gets it as a
DataFrame, the checking SQL as a WITH entry (see ``with_``).
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

DERIVED = {
    "fx_entities": """
        SELECT concat('d', p_partkey % 50) AS doc_id, p_partkey AS ord,
               CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS entity_name,
               CASE WHEN p_size > 25 THEN 'equipment' ELSE 'product' END AS entity_type,
               concat('part of brand ', p_brand, ' and type ', p_type) AS description,
               concat('c', p_partkey) AS chunk_id
        FROM part
        UNION ALL
        SELECT concat('d', s_suppkey % 50), 1000000000 + s_suppkey, s_name, 'organization',
               concat('supplier based in nation ', s_nationkey), concat('s', s_suppkey)
        FROM supplier""",
    "fx_relationships": """
        SELECT concat('d', l_orderkey % 50) AS doc_id, l_orderkey * 10 + l_linenumber AS ord,
               s_name AS source_id, p_name AS target_id,
               concat(lower(p_type), ', ', p_brand, CASE WHEN l_linenumber % 2 = 0 THEN ', bulk' ELSE '' END) AS keywords,
               concat('returned ', l_returnflag, ' with status ', l_linestatus) AS description,
               l_quantity / 10 AS weight, concat('c', l_orderkey) AS chunk_id
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey""",
    "fx_tree": """
        SELECT r_name AS source, n_name AS target FROM region JOIN nation ON r_regionkey = n_regionkey
        UNION ALL SELECT n_name, s_name FROM nation JOIN supplier ON n_nationkey = s_nationkey
        UNION ALL SELECT n_name, c_name FROM nation JOIN customer ON n_nationkey = c_nationkey""",
    "fx_vectors": """
        SELECT vec_id AS idx, concat('doc', label) AS doc_id,
               CASE vec_id % 5 WHEN 0 THEN 'RELATIONSHIP' WHEN 1 THEN 'ENTITY' ELSE 'CHUNK' END AS entity_type,
               vec_id % 10 = 0 AS deleted, embedding
        FROM embeddings""",
    "fx_feedback": """
        SELECT user_id, concat('conv_', user_id % 20) AS conversation_id, event_id % 7 AS message_index,
               CASE WHEN event_type = 'purchase' THEN 1 + event_id % 5 END AS rating,
               CASE WHEN event_type = 'error' THEN 1 + event_id % 6 END AS relevancy_score,
               CASE WHEN event_type = 'error' THEN 1 + event_id % 5 END AS faithfulness_score,
               value AS response_time_ms, event_type = 'error' AS auto_evaluated, ts AS created_at, event_id
        FROM events WHERE event_type IN ('purchase', 'error')""",
    "fx_login_logs": """
        SELECT user_id, ts AS created_at, event_id FROM events WHERE event_type = 'signup'""",
    "fx_users": """
        SELECT user_id, concat('user_', user_id) AS username,
               CASE WHEN user_id % 10 = 0 THEN 'admin' ELSE 'user' END AS role
        FROM events GROUP BY user_id""",
    "fx_conversations": """
        SELECT user_id, concat('conv_', event_id) AS conversation_id, ts AS created_at, ts AS updated_at
        FROM events WHERE event_type = 'click'""",
    "fx_user_messages": """
        SELECT concat('conv_', c.event_id) AS conversation_id, v.event_id AS message_id, v.ts AS created_at
        FROM events v JOIN events c
          ON v.user_id = c.user_id AND v.event_type = 'view' AND c.event_type = 'click'
         AND date_trunc('hour', v.ts) = date_trunc('hour', c.ts)""",
    "fx_messages": """
        SELECT conv_id AS conversation_id, turn, role, text AS content FROM conversations WHERE role <> 'system'""",
    "fx_model_output": """
        SELECT p_partkey AS ord, concat('c', p_partkey) AS chunk_id,
               concat('entity<|#|>', p_name, '<|#|>', p_type, '<|#|>part made by ', p_brand, '<|#|>', p_size, chr(10),
                      'entity<|#|>"', p_brand, '"<|#|>Organization<|#|>brand  of <the> part/', chr(10),
                      'entity<|#|>', p_size, '<|#|>metric<|#|>size of the part', chr(10),
                      'relation<|#|>', p_name, '<|#|>', p_brand, '<|#|>made by, ', lower(p_type), '<|#|>brand of the part', chr(10),
                      'relation<|#|>', p_name, '<|#|>', p_name, '<|#|>same<|#|>a part and itself', chr(10),
                      CASE WHEN p_size > 10 THEN '<|COMPLETE|>' ELSE 'entity<|#|>cut off' END) AS result
        FROM part""",
    # Questions: every user turn.
    "fx_questions": """
        SELECT conv_id * 1000 + turn AS qid, text AS question FROM conversations WHERE role = 'user'""",
    # Questions about parts; the question is its own id.
    "fx_part_questions": """
        SELECT question AS qid, question FROM (
        SELECT DISTINCT concat(CASE WHEN p_size <= 10 THEN 'What is the ' WHEN p_size <= 20 THEN 'Compare the '
                                    WHEN p_size <= 30 THEN 'Please explain the ' WHEN p_size <= 40 THEN 'Tell me why the '
                                    ELSE 'Does any company develop ' END,
                               p_name, ' of ', p_brand, ' in an AI system') AS question
        FROM part) t""",
    # Parsed elements of documents: order lines.
    "fx_elements": """
        SELECT concat('o', o_orderkey) AS doc_id, l_linenumber AS idx,
               CASE l_linenumber % 7 WHEN 1 THEN 'title' WHEN 2 THEN 'h3' WHEN 3 THEN 'list_item' WHEN 4 THEN 'code'
                    WHEN 5 THEN 'quote' WHEN 6 THEN 'unheard_of' ELSE 'paragraph' END AS label,
               CASE WHEN l_quantity < 3 THEN '  ' ELSE concat(' ', l_returnflag, chr(10), l_shipdate, ' ') END AS text
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
}


class Inputs:
    """Lazy access to supplied and derived tables by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(os.path.join(self.sf_dir, f"{name}.parquet"))
        if name in DERIVED:
            return self.sql(DERIVED[name])
        raise AttributeError(name)

    def stream(self, name: str) -> DataFrame:
        """A supplied table as a file stream, be it one file or a folder of files."""
        # By a pattern: a stream takes the path of a single file only as one.
        path = os.path.join(self.sf_dir, f"{{{name}.parquet}}")
        return self.spark.readStream.schema(getattr(self, name).schema).parquet(path)

    def dealt(self, name: str) -> DataFrame:
        """A supplied table for Python-heavy steps: dealt out when its files give fewer tasks than there are cores."""
        df = getattr(self, name)
        cores = self.spark.sparkContext.defaultParallelism
        return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)

    def sql(self, text: str) -> DataFrame:
        """Run SQL over supplied and derived tables without registering views."""
        used = sorted({w for w in re.findall(r"(?:FROM|JOIN)\s+(\w+)", text) if w in TABLES or w in DERIVED})
        marked = re.sub(
            r"(FROM|JOIN)\s+(\w+)", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in used else m[0], text.replace("{", "{{").replace("}", "}}")
        )
        return self.spark.sql(marked, **{name: getattr(self, name) for name in used})


def with_(body: str) -> str:
    """Prefix DuckDB SQL with the derived tables it names."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\b(fx_\w+)", text):
            if name in DERIVED and name not in needed:
                visit(DERIVED[name])
                needed.append(name)

    visit(body)
    ctes = ", ".join(f"{n} AS ({DERIVED[n]})" for n in needed)
    body = body.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes}, {body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH"):
        return f"WITH {ctes}, {body[4:]}"
    return f"WITH {ctes} {body}"


#: WITH entry ``crc``: the 256 steps of crc32 as one list, for SQL engines without it.
CRC_STEPS = """crc AS (SELECT list(v ORDER BY i) AS steps FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(i)))"""


def crc_sql(text: str) -> str:
    """DuckDB expression for the crc32 of a string's UTF-8; needs ``crc`` in the FROM clause."""
    byte = f"('0x' || substr(hex(encode({text})), 2 * j + 1, 2))::BIGINT"
    listed = f"list_transform(range(0, strlen({text})), lambda j: {byte})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {listed}), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295)"
