"""SRC3–SRC11 and CHK1–CHK11: files, parsed documents and chunking."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.base import query
from catalog.inputs import DERIVED, with_
from graphloom.functions import fixed, markup
from graphloom.functions.pieces import ChunkSettings
from graphloom.functions.text import token_count
from graphloom.operators import chunking as c
from graphloom.operators import tables
from graphloom.session import shared_dir
from graphloom.sources import files, store

ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def unescape_sql(x: str) -> str:
    for a, b in ENTITIES:
        x = f"replace({x}, '{a}', '{b}')"
    return x


HTML_SQL = rf"""
    WITH bare AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>', '<x>', 'g'), '(?s)<!--.*?-->', '<x>', 'g') AS h FROM pages),
    nodes AS (SELECT page_id, unnest(regexp_split_to_array(h, '<[/!a-zA-Z][^>]*>')) AS t, generate_subscripts(regexp_split_to_array(h, '<[/!a-zA-Z][^>]*>'), 1) AS n FROM bare),
    clean AS (SELECT page_id, n, regexp_replace({unescape_sql('t')}, '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g') AS t FROM nodes)
    SELECT page_id, string_agg(t, chr(10) ORDER BY n) AS text FROM clean WHERE t <> '' GROUP BY page_id"""


@query("src3_html_text", HTML_SQL)
def html_text(i):
    return files.parse_column(i.dealt("pages").select("page_id", "html"), "html", markup.html_text)


@query("src4_xml_text", "SELECT o_orderkey, concat(o_orderstatus, chr(10), 'by ', o_custkey, ' & co', chr(10), o_orderpriority) AS text FROM orders")
def xml_text(i):
    xml = i.sql("""SELECT o_orderkey, concat('<order id="1"> ', o_orderstatus, ' <a><b> by ', o_custkey, ' &amp; co</b> ', o_orderpriority, ' </a></order>') AS xml FROM orders""")
    return files.parse_column(xml, "xml", markup.xml_text)


@query("src5_json_text", """SELECT event_id, concat('{', chr(10), '  "k": ', props::JSON->>'$.k', chr(10), '}') AS text FROM events""")
def json_text(i):
    return files.parse_column(i.events.select("event_id", "props"), "props", markup.json_text)


@query("src6_row_lines", "SELECT p_partkey, concat_ws(' | ', p_partkey, p_name, p_brand, p_type, p_size, p_retailprice) AS line FROM part")
def row_lines(i):
    return files.row_lines(i.part, i.part.columns).select("p_partkey", "line")


# Parsed documents: the elements of an order, in one row.
LABELS = ["title", "h3", "list_item", "code", "quote", "unheard_of", "paragraph"]
ORDER_ELEMENTS = """
    SELECT o_orderkey AS doc_id, array(named_struct('label', 'title', 'text', concat(' ', o_orderpriority, ' ')), named_struct('label', 'h3', 'text', o_orderstatus),
        named_struct('label', 'list_item', 'text', '  '), named_struct('label', 'code', 'text', cast(o_custkey AS string)),
        named_struct('label', 'quote', 'text', concat('to ', o_custkey, chr(10), 'from ', o_orderkey)), named_struct('label', 'unheard_of', 'text', o_orderstatus)) AS elements FROM orders"""


@query("src7_elements_text", """SELECT o_orderkey AS doc_id, concat('# ', o_orderpriority, chr(10), chr(10), '### ', o_orderstatus, chr(10), chr(10), '```', chr(10), o_custkey, chr(10), '```',
    chr(10), chr(10), '> to ', o_custkey, chr(10), '> from ', o_orderkey, chr(10), chr(10), o_orderstatus, chr(10)) AS text FROM orders""")
def elements_text(i):
    return i.sql(ORDER_ELEMENTS).select("doc_id", files.elements_text(F.col("elements")).alias("text"))


FORM_SQL = "CASE label " + " ".join(
    f"WHEN '{k}' THEN concat('{v.split('{}')[0]}', t, '{v.split('{}')[1]}')" for k, v in {**fixed.ELEMENT_FORMS, "table": fixed.TABLE_FORM}.items() if k not in fixed.QUOTED_ELEMENTS
) + " ELSE CASE WHEN label IN ('quote', 'block_quote', 'blockquote') THEN concat('> ', replace(t, chr(10), concat(chr(10), '> '))) ELSE t END END"
ALL_LABELS = [*fixed.ELEMENT_FORMS, "table", "unheard_of"]


@query("src7_element_markdown", rf"""WITH l AS (SELECT unnest([{', '.join(f"'{x}'" for x in ALL_LABELS)}]) AS label, unnest(range(0, {len(ALL_LABELS)})) AS n),
    e AS (SELECT doc_id, label, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents JOIN l ON n = doc_id % {len(ALL_LABELS)})
    SELECT doc_id, label, {FORM_SQL} AS markdown FROM e""")
def element_markdown(i):
    """Every document as one element; the labels take turns."""
    labels = F.array(*[F.lit(x) for x in ALL_LABELS])
    label = F.element_at(labels, (F.pmod("doc_id", F.lit(len(ALL_LABELS))) + 1).cast("int"))
    return i.documents.select("doc_id", label.alias("label"), "text").select(
        "doc_id", "label", files.element_markdown(F.col("label"), F.col("text")).alias("markdown")
    )


@query("src7_elements_table", with_(rf"""WITH e AS (SELECT doc_id, idx, label, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM fx_elements),
    f AS (SELECT doc_id, string_agg({FORM_SQL}, concat(chr(10), chr(10)) ORDER BY idx, label, text) AS body FROM e WHERE t <> '' GROUP BY doc_id)
    SELECT d.doc_id, CASE WHEN body IS NULL THEN '' ELSE concat(body, chr(10)) END AS text FROM (SELECT DISTINCT doc_id FROM e) d LEFT JOIN f ON d.doc_id = f.doc_id"""))
def elements_table(i):
    return files.elements_documents(i.fx_elements)


def _folder(i) -> str:
    return f"{shared_dir(i.spark)}/files-{uuid.uuid4().hex}"


#: Tasks move their own files to the folder, which is new for each run; else the driver moves all of them one by one.
COMMIT = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


def _many_files(suppliers):
    """Suppliers in several parts a core: making a file takes longer than writing to it, so no task is to make them all."""
    return suppliers.repartition(4 * suppliers.sparkSession.sparkContext.defaultParallelism, "s_suppkey")


SUPPLIER_TEXT = "concat('supplier ', s_name, chr(10), 'in nation ', s_nationkey)"


@query("src1_text_files", f"SELECT concat({SUPPLIER_TEXT}, chr(10)) AS text, 'TXT' AS file_type FROM supplier")
def text_files(i):
    """A text file for every supplier, written to the shared folder and read back."""
    path = _folder(i)
    texts = i.sql(f"SELECT s_suppkey, coalesce({SUPPLIER_TEXT}, '') AS value FROM supplier")
    whole = texts.groupBy("s_suppkey").agg(F.array_join(F.collect_list("value"), "\n").alias("value"))
    # A file a row, all in one folder: a folder for each takes longer to write and to list.
    _many_files(whole).select("value").write.options(**COMMIT).option("maxRecordsPerFile", 1).text(path)
    return files.read_documents(i.spark, path).select("text", "file_type")


@query("src2_routed_files", f"""SELECT s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN 'TXT' ELSE 'JSON' END AS file_type,
    CASE WHEN s_nationkey % 2 = 0 THEN concat({SUPPLIER_TEXT}, chr(10)) ELSE concat('{{', chr(10), '  "name": "', s_name, '",', chr(10), '  "nation": ', s_nationkey, chr(10), '}}') END AS text
    FROM supplier""")
def routed_files(i):
    """Suppliers as text or JSON files, side by side: each goes to the parser of its suffix."""
    path = _folder(i)
    texts = i.sql(f"SELECT s_suppkey, {SUPPLIER_TEXT} AS value FROM supplier WHERE s_nationkey % 2 = 0")
    records = i.sql("SELECT s_suppkey, s_name AS name, s_nationkey AS nation FROM supplier WHERE s_nationkey % 2 = 1")
    _many_files(texts).write.options(**COMMIT).partitionBy("s_suppkey").text(path)
    _many_files(records).write.options(**COMMIT).mode("append").partitionBy("s_suppkey").json(path)
    read = files.read_documents(i.spark, path)
    return read.select(F.regexp_extract("file_path", "s_suppkey=([0-9]+)", 1).cast("long").alias("s_suppkey"), "file_type", "text")


@query("src8_metadata", """
    SELECT doc_id, 'title' AS key, CASE WHEN lang = 'en' THEN concat('about ', lang) ELSE source END AS value FROM documents
    UNION ALL SELECT doc_id, 'author', concat(source, ', ', lang) FROM documents UNION ALL SELECT doc_id, 'lang', lang FROM documents""")
def metadata(i):
    attributes = i.sql("""SELECT doc_id, map('title', array(CASE WHEN lang = 'en' THEN 'about en' ELSE '' END), 'name', array(source), 'authors', array(source, lang),
        'lang', array(lang), 'note', array('')) AS a FROM documents""")
    return attributes.select("doc_id", F.explode(files.document_metadata(F.col("a"))).alias("key", "value"))


UPLOADS = """SELECT page_id, url AS filename, length(html) * 1000 AS length, ts AS uploaded_at FROM pages JOIN events ON event_id = page_id"""


@query("src9_uploads", r"""SELECT page_id, concat(strftime(ts, '%Y%m%d_%H%M%S'), '_', regexp_replace(url, '[^\p{L}\p{N}._\- ]', '', 'g')) AS stored_as,
    concat(strftime(ts, '%Y%m%d_%H%M%S'), '_', url) AS doc_id, length(html) * 1000 <= 1500000 AS accepted FROM pages JOIN events ON event_id = page_id""")
def uploads(i):
    return files.judged_uploads(i.sql(UPLOADS), 1_500_000).select("page_id", "stored_as", "doc_id", "accepted")


STORED = """SELECT user_id, conversation_id, message_index, arg_max(rating, (created_at, event_id)) AS rating, arg_max(relevancy_score, (created_at, event_id)) AS relevancy_score
    FROM fx_feedback WHERE {0} GROUP BY ALL"""


@query("src11_upsert", with_(f"""WITH a AS ({STORED.format("created_at < TIMESTAMP '2024-01-16'")}), b AS ({STORED.format("created_at >= TIMESTAMP '2024-01-16'")})
    SELECT user_id, conversation_id, message_index, coalesce(b.rating, a.rating) AS rating, coalesce(b.relevancy_score, a.relevancy_score) AS relevancy_score
    FROM a FULL JOIN b USING (user_id, conversation_id, message_index)"""))
def upsert(i):
    from graphloom.operators.feedback import KEY, merge_evaluations

    half = F.col("created_at") < F.lit("2024-01-16").cast("timestamp_ntz")
    columns = [*KEY, "rating", "relevancy_score"]
    old, new = (merge_evaluations(i.fx_feedback.where(w)).select(*columns) for w in (half, ~half))
    return store.upsert(old, new, KEY)


@query("src11_add_links", with_("SELECT DISTINCT entity_name AS node_id, doc_id FROM fx_entities UNION SELECT source_id, doc_id FROM fx_relationships"))
def add_links(i):
    from graphloom.operators.graph import node_documents

    return store.add_links(node_documents(i.fx_entities), i.fx_relationships.select(F.col("source_id").alias("node_id"), "doc_id"))


# ------------------------------------------------------------- chunking


@query("chk1_tokens", r"SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS tokens FROM documents")
def tokens(i):
    return i.documents.select("doc_id", token_count(F.col("text")).alias("tokens"))


# Documents with a heading line before every fifth line.
HEADED = r"array_to_string(list_transform(string_split(text, chr(10)), lambda l, p: CASE WHEN (p - 1) % 5 = 0 THEN concat(repeat('#', CAST(1 + (p - 1) // 5 % 3 AS BIGINT)), ' Part ', p - 1, chr(10), l) ELSE l END), chr(10))"
LINES = f"""
    doc AS (SELECT doc_id, {HEADED} AS text FROM documents),
    ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS line_no FROM doc),
    hd AS (SELECT doc_id, line_no, CAST(length(regexp_extract(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), '^(#{{1,6}}) .*$', 1)) AS INTEGER) AS level,
                  regexp_replace(regexp_extract(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), '^#{{1,6}} (.*)$', 1), '^\\s+|\\s+$', '', 'g') AS title FROM ln)"""


def headed(i, documents=None):
    number = lambda p: F.floor(p / 5) % 3 + 1
    lines = F.transform(
        F.split("text", "\n"),
        lambda line, p: F.when(p % 5 == 0, F.concat(F.repeat(F.lit("#"), number(p).cast("int")), F.lit(" Part "), p.cast("string"), F.lit("\n"), line)).otherwise(line),
    )
    return (documents or i.documents).withColumn("text", F.array_join(lines, "\n"))


@query("chk2_headings", f"WITH {LINES} SELECT doc_id, line_no, level, title FROM hd WHERE level > 0")
def headings(i):
    return c.heading_lines(headed(i))


LEVELS = range(1, 7)
LAST = ", ".join(
    f"max(CASE WHEN level = {k} THEN line_no END) OVER w AS h{k}, arg_max(CASE WHEN level = {k} THEN title END, CASE WHEN level = {k} THEN line_no END) OVER w AS t{k}" for k in LEVELS
)
LIVE = ", ".join(
    f"CASE WHEN h{k} IS NOT NULL AND h{k} > coalesce(greatest({', '.join(['-1'] + [f'h{m}' for m in range(1, k)])}), -1) THEN t{k} END" for k in LEVELS
)


@query("chk3_sections", f"""WITH {LINES}, lt AS (SELECT doc_id, line_no, {LAST} FROM hd WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT doc_id, line_no, coalesce(nullif(concat_ws(' > ', {LIVE}), ''), 'ROOT') AS section FROM lt""")
def sections(i):
    return c.line_sections(headed(i, i.dealt("documents")).select("doc_id", "text"))


@query("chk4_chunks")
def chunks(i):
    return _chunks(i).select("doc_id", "order", "content", "tokens", "section", "file_type")


def _chunks(i):
    docs = headed(i, i.dealt("documents")).withColumn("file_path", F.concat("source", F.lit(".txt")))
    return c.chunk_documents(docs, ChunkSettings(200, 20))


@query("chk5_windows", r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents),
    p AS (SELECT doc_id, w, CAST(unnest(range(0, CAST(greatest(1, ceil((len(w) - 10) / 40.0)) AS BIGINT))) AS INTEGER) AS part FROM t)
    SELECT doc_id, part, array_to_string(w[part * 40 + 1 : part * 40 + 50], ' ') AS content FROM p""")
def windows(i):
    return c.token_windows(i.documents, 50, 10)


TABLE_TEXT = """SELECT o_orderkey AS doc_id, concat('about ', o_custkey, chr(10), CASE WHEN o_orderstatus = 'F' THEN '' ELSE concat('| a | b |', chr(10), CASE WHEN o_orderstatus = 'P' THEN '|   |   |' ELSE '|:--|--:|' END,
    chr(10), repeat(concat('| ', o_orderpriority, ' | 2 |', chr(10)), CAST(o_custkey % 7 AS INTEGER))) END, CASE WHEN o_custkey % 2 = 0 THEN 'end' ELSE '' END) AS text FROM orders"""


@query("chk6_table_span", f"""WITH t AS ({TABLE_TEXT}), n AS (SELECT doc_id, text, o_custkey % 7 AS r, o_custkey FROM t JOIN orders ON o_orderkey = doc_id WHERE o_orderstatus = 'O')
    SELECT doc_id, 1::INTEGER AS first, CAST(3 + r AS INTEGER) AS after FROM n""")
def table_span(i):
    return i.sql(TABLE_TEXT).select("doc_id", c.table_span(F.col("text")).alias("t")).where("t IS NOT NULL").select("doc_id", "t.first", "t.after")


def blocks_sql(rows: str, room: str) -> str:
    """WITH entries up to ``blocks`` (doc_id, n, row, blk) for ``lines`` (doc_id, n, row, c words): a row starts a block where it no longer fits."""
    return f"""lines AS ({rows}),
    filled(doc_id, n, used, blk) AS (SELECT doc_id, n, c, 0 FROM lines WHERE n = 1
        UNION ALL SELECT l.doc_id, l.n, CASE WHEN f.used + l.c > {room} THEN l.c ELSE f.used + l.c END, CASE WHEN f.used + l.c > {room} THEN f.blk + 1 ELSE f.blk END
        FROM filled f JOIN lines l ON l.doc_id = f.doc_id AND l.n = f.n + 1),
    blocks AS (SELECT doc_id, blk, n, row FROM filled JOIN lines USING (doc_id, n))"""


# Blocks of more than 60 words are cut into windows of 60 that overlap by 6.
CHK7 = r"""WITH RECURSIVE """ + blocks_sql(
    r"""SELECT doc_id, n, row, len(regexp_extract_all(row, '\S+')) AS c, 57 - len(regexp_extract_all(source, '\S+')) AS room FROM
        (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS row, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)""",
    "l.room",
) + r""",
    t AS (SELECT doc_id, blk, regexp_replace(concat(any_value(source), chr(10), chr(10), 'a | b', chr(10), string_agg(row, chr(10) ORDER BY n)), '\s+$', '') AS body
          FROM blocks JOIN documents USING (doc_id) GROUP BY ALL),
    w AS (SELECT doc_id, blk, body, regexp_extract_all(body, '\S+\s*') AS toks FROM t),
    p AS (SELECT doc_id, blk, body, toks, unnest(range(0, CASE WHEN len(toks) <= 60 THEN 1 ELSE CAST(1 + ceil((len(toks) - 60) / 54.0) AS BIGINT) END)) AS piece FROM w)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY blk, piece) - 1 AS INTEGER) AS part,
           CASE WHEN len(toks) <= 60 THEN body ELSE regexp_replace(array_to_string(list_slice(toks, piece * 54 + 1, piece * 54 + 60), ''), '\s+$', '') END AS content FROM p"""


@query("chk7_packed_rows", CHK7)
def packed_rows(i):
    tables = i.dealt("documents").select("doc_id", F.lit("a | b").alias("header"), F.split("text", "\n").alias("rows"), F.col("source").alias("prefix"))
    return c.packed_rows(tables, ChunkSettings(60, 6))


@query("chk7_packed_tables", CHK7)
def packed_tables(i):
    """The same for tables whose rows are rows of a table, in any partitions."""
    docs = i.dealt("documents")
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("row_no", "row"))
    return tables.packed_tables(rows, docs.select("doc_id", F.lit("a | b").alias("header"), F.col("source").alias("prefix")), ChunkSettings(60, 6))


PART_LINE = "concat_ws(' | ', p_partkey, p_name, p_brand, p_type, p_size, p_retailprice)"
PART_HEADER = "p_partkey | p_name | p_brand | p_type | p_size | p_retailprice"


@query("src6_packed_table", "WITH RECURSIVE " + blocks_sql(
    rf"SELECT 'part' AS doc_id, row_number() OVER (ORDER BY p_partkey) AS n, {PART_LINE} AS row, len(regexp_extract_all({PART_LINE}, '\S+')) AS c FROM part", "48"
) + f""" SELECT doc_id, CAST(blk AS INTEGER) AS part, concat('Parts', chr(10), chr(10), '{PART_HEADER}', chr(10), string_agg(row, chr(10) ORDER BY n)) AS content
    FROM blocks GROUP BY doc_id, blk""")
def packed_table(i):
    """One table of all parts, from its rows to blocks under its header."""
    lines = files.row_lines(i.part, i.part.columns).select(F.lit("part").alias("doc_id"), F.col("p_partkey").alias("row_no"), F.col("line").alias("row"))
    top = i.spark.createDataFrame([("part", " | ".join(i.part.columns), "Parts")], "doc_id string, header string, prefix string")
    return tables.packed_tables(lines, top, ChunkSettings(60, 6))


@query("chk8_breadcrumbs", """SELECT doc_id, concat('**[SECTION] ', source, CASE WHEN n_chars % 4 > 1 THEN concat(' — part ', doc_id % 3, '/', n_chars % 4) ELSE '' END, '**', chr(10), chr(10), text) AS content FROM documents""")
def breadcrumbs(i):
    part, parts = F.pmod("doc_id", F.lit(3)), F.pmod("n_chars", F.lit(4))
    return i.documents.select("doc_id", c.with_breadcrumb(F.col("source"), F.col("text"), part, parts).alias("content"))


@query("chk9_merged", r"""WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \n]')) AS w, generate_subscripts(regexp_split_to_array(text, '[ \n]'), 1) AS n FROM documents),
    g AS (SELECT *, sum(CASE WHEN n = 1 OR length(regexp_replace(w, '^\s+|\s+$', '', 'g')) >= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS grp FROM p)
    SELECT doc_id, CAST(grp - 1 AS INTEGER) AS part, string_agg(w, chr(10) ORDER BY n) AS content FROM g GROUP BY doc_id, grp""")
def merged(i):
    """Words of a document as pieces, short ones joined to the word before."""
    return i.documents.select("doc_id", F.posexplode(c.merge_tiny(F.split("text", r"[ \n]"))).alias("part", "content"))


@query("chk10_retention", r"""WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '\S+') AS w FROM documents),
    p AS (SELECT doc_id, w, unnest(range(0, CAST(greatest(1, ceil((len(w) - 10) / 40.0)) AS BIGINT))) AS part FROM t),
    o AS (SELECT doc_id, count(*) AS n_chunks, CAST(sum(length(array_to_string(w[part * 40 + 1 : part * 40 + 50], ' '))) AS BIGINT) AS chars_out, CAST(sum(len(w[part * 40 + 1 : part * 40 + 50])) AS BIGINT) AS tokens_out FROM p GROUP BY doc_id)
    SELECT doc_id, length(text) AS chars_in, len(w) AS tokens_in, n_chunks, chars_out, tokens_out, chars_out / greatest(length(text), 1)::DOUBLE < 0.95 AS lossy FROM t JOIN o USING (doc_id)""")
def retention(i):
    parts = c.token_windows(i.documents, 50, 10).withColumn("tokens", token_count(F.col("content")))
    return c.retention(i.documents, parts)


TRACES = " + ".join(f"(length(text) - length(replace(text, '{m}', ''))) / {len(m)}" for m in fixed.MOJIBAKE)


@query("chk11_sound", rf"SELECT doc_id FROM documents WHERE regexp_replace(text, '^\s+|\s+$', '', 'g') <> '' AND length(text) >= 10 AND {TRACES} <= length(text) * 0.1")
def sound(i):
    return i.documents.where(c.is_sound(F.col("text"))).select("doc_id")
