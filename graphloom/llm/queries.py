"""One query per numbered operator, over whole tables, and its DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import fingerprints, mixing, packing, pagetext, partenum, quality, substrings, tokenfiles, toxicity, turns, variants, warc
from graphloom.llm.common import folder, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql:
            SQL[name] = sql.strip()
        return run

    return register


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file, which every worker has installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


@_query("op1_string_kernel")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    model = toxicity.train(documents, toxicity.training_marks(read_table(spark, sf_dir, "labels")))
    scored = toxicity.score(documents, model)
    return scored.select("doc_id", toxicity.held_out(scored.doc_id).alias("held_out"), "score", "predicted", "worst")


#: Target weights of the domains that the labels tell apart.
TARGETS = {"good": 0.9, "low_quality": 0.08, "toxic": 0.02}


@_query("op2_soft_mixing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    marks = mixing.label_domains(read_table(spark, sf_dir, "labels"))
    return mixing.document_rates(documents, marks, TARGETS, upper=4.0)


@_query("op3_best_two_fit")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@_query("op4_token_files")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "tokens")
    manifest = tokenfiles.write_parquet(read_table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"))
    return tokenfiles.read_digests(manifest, path)


@_query("op5_imatch")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    return fingerprints.compare_neighbours(documents, fingerprints.lexicon(documents))


@_query("op6_line_cleaning")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean_lines(read_table(spark, sf_dir, "documents"), with_text=False)


@_query("op7_partenum")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.near_duplicates(read_table(spark, sf_dir, "documents"))


@_query("op8_separator_scan")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.count_tokens(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 50256)


@_query(
    "op9_substrings",
    """
    WITH w AS (
        SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents
    ), s AS (
        SELECT doc_id, i, array_to_string(list_slice(words, i, i + 34), ' ') AS g
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w)
    ), r AS (SELECT doc_id, list(i) AS starts FROM s WHERE g IN (SELECT g FROM s GROUP BY g HAVING count(*) > 1) GROUP BY doc_id),
    gone AS (
        SELECT w.doc_id, words, list_sort(list_distinct(flatten(list_transform(coalesce(starts, []), lambda i: range(i, i + 35))))) AS gone
        FROM w LEFT JOIN r ON w.doc_id = r.doc_id
    )
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
           sha256(coalesce(array_to_string(list_select(words, list_where(range(1, len(words) + 1), list_transform(
               range(1, len(words) + 1), lambda i: NOT list_contains(gone, i)))), ' '), '')) AS kept_sha256
    FROM gone
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(read_table(spark, sf_dir, "documents")).drop("text")


@_query(
    "op10_warc",
    """
    WITH p AS (
        SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
    ), k AS (SELECT hex, max(page_id) AS keeper FROM p GROUP BY hex)
    SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
           array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               CAST(1 + ((CAST(concat('0x', substr(p.hex, CAST(1 + 5 * (i // 4) AS BIGINT), 5)) AS INTEGER)
                    >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS BIGINT), 1)), '') AS payload_digest,
           CASE WHEN page_id IS NOT DISTINCT FROM keeper THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
    FROM p JOIN k ON p.hex = k.hex
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(read_table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Words one edit apart share what is left of them without one letter: at the same place, or with a word itself.
_VARIANTS = """
    WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS steps FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(i))),
    runs AS (SELECT run, concat(doc_id, ':', run) AS key, count(*) AS k FROM (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS run FROM documents
    ) WHERE length(run) >= 7 GROUP BY ALL),
    hashed AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT,
            list_transform(range(0, strlen(key)), lambda j: ('0x' || substr(hex(encode(key)), 2 * j + 1, 2))::BIGINT)),
            lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM runs, crc),
    words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (
        SELECT k, CASE WHEN h % 31 = 0 THEN concat(left(run, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word FROM hashed
    ) WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
    cuts AS (SELECT word, n, i, concat(left(word, i), substr(word, i + 2)) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)),
    near AS (
        SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
        UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON c.rest = w.word
        UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON c.rest = w.word
    ),
    best AS (SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near FROM near
             QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) = 1),
    forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n
              FROM words LEFT JOIN best USING (word)),
    walk AS (SELECT word, word AS here, 0 AS step FROM forms UNION ALL SELECT walk.word, forms.form, step + 1 FROM walk JOIN forms ON forms.word = walk.here WHERE forms.form IS NOT NULL),
    roots AS (SELECT word, arg_max(here, step) AS root FROM walk GROUP BY word)
    SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""


@_query("op11_variants", _VARIANTS)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(variants.damaged_words(read_table(spark, sf_dir, "documents")))


@_query("op12_page_text")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagetext.main_text(read_table(spark, sf_dir, "pages"))


@_query("op13_turn_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair_damaged(read_table(spark, sf_dir, "conversations"))
