"""EXT3–EXT16: parsing, cleaning, deduplication and validation of extracted records."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query
from catalog.inputs import with_
from graphloom.functions import fixed
from graphloom.functions.text import clean_field, is_good_entity
from graphloom.operators import records as r

STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def clean_sql(c: str) -> str:
    s = STRIP.format(c)
    s = f'''regexp_replace(regexp_replace({s}, '^"+|"+$', '', 'g'), '^''+|''+$', '', 'g')'''
    return rf"trim(regexp_replace(regexp_replace({s}, '[<>|/\\]', '', 'g'), '\s+', ' ', 'g'))"


def good_sql(name: str, description: str) -> str:
    stop = ", ".join(f"'{w}'" for w in fixed.ENTITY_STOP_WORDS_EN + fixed.ENTITY_STOP_WORDS_VI)
    return rf"""(length({name}) >= 2 AND lower({STRIP.format(name)}) NOT IN ({stop})
        AND NOT regexp_matches({STRIP.format(name)}, '^\p{{Nd}}+$') AND length({STRIP.format(description)}) >= 10
        AND regexp_matches({name}, '[a-zA-Z0-9À-ỹ]'))"""


LINES = rf"""
    raw AS (SELECT chunk_id, ord, unnest(string_split(result, chr(10))) AS line, generate_subscripts(string_split(result, chr(10)), 1) - 1 AS line_no
            FROM fx_model_output),
    lines AS (SELECT chunk_id, ord, CAST(line_no AS INTEGER) AS line_no, string_split({STRIP.format('line')}, '<|#|>') AS f FROM raw
              WHERE NOT contains(line, '<|COMPLETE|>')),
    types AS (SELECT unnest([{', '.join(f"'{t}'" for t in fixed.ENTITY_TYPES)}]) AS type),
    ents AS (SELECT chunk_id, ord, line_no, {clean_sql('f[2]')} AS entity_name,
                    CASE WHEN lower({clean_sql('f[3]')}) IN (SELECT type FROM types) THEN lower({clean_sql('f[3]')}) ELSE 'other' END AS entity_type,
                    {clean_sql('f[4]')} AS description,
                    CASE WHEN TRY_CAST({clean_sql('f[5]')} AS INTEGER) IS NULL THEN 3 ELSE greatest(1, least(5, TRY_CAST({clean_sql('f[5]')} AS INTEGER))) END AS confidence
             FROM lines WHERE len(f) >= 4 AND contains(lower(f[1]), 'entity'))"""


@query("ext3_entities", with_(f"""WITH {LINES} SELECT * FROM ents
    WHERE entity_name <> '' AND description <> '' AND {good_sql('entity_name', 'description')}"""))
def entities(i):
    return r.parse_entities(i.fx_model_output)


@query("ext4_relationships", with_(f"""WITH {LINES},
    rels AS (SELECT chunk_id, ord, line_no, {clean_sql('f[2]')} AS source_id, {clean_sql('f[3]')} AS target_id, {clean_sql('f[4]')} AS keywords,
                    {clean_sql('f[5]')} AS description, 1.0::DOUBLE AS weight
             FROM lines WHERE len(f) >= 5 AND NOT contains(lower(f[1]), 'entity') AND contains(lower(f[1]), 'relation'))
    SELECT * FROM rels WHERE source_id <> '' AND target_id <> '' AND source_id <> target_id"""))
def relationships(i):
    return r.parse_relationships(i.fx_model_output)


@query("ext5_clean_field", f"SELECT doc_id, {clean_sql('text')} AS cleaned FROM documents")
def clean(i):
    return i.documents.select("doc_id", clean_field(F.col("text")).alias("cleaned"))


WORDS = r"SELECT doc_id, w, text FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\s+')) AS w, text FROM documents)"


@query("ext6_good_entities", f"WITH w AS ({WORDS}) SELECT w, count(*) AS n FROM w WHERE {good_sql('w', 'text')} GROUP BY ALL")
def good_entities(i):
    """Every word of every document as an entity name, the whole text as its description."""
    named = i.documents.select(F.explode(F.split("text", r"\s+")).alias("w"), "text")
    return named.where(is_good_entity(F.col("w"), F.col("text"))).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


FACTS = """
    k AS (SELECT *, lower(trim(entity_name)) AS key FROM fx_entities),
    d AS (SELECT key, lower(description) AS folded, arg_min(description, ord) AS description, min(ord) AS o FROM k GROUP BY ALL),
    t AS (SELECT key, left(string_agg(description, '; ' ORDER BY o), 500) AS merged, count(*) AS n_descriptions FROM d GROUP BY ALL)"""


@query("ext7_dedup_entities", with_(f"""WITH {FACTS}
    SELECT key, arg_min(entity_name, ord) AS entity_name, arg_min(entity_type, ord) AS entity_type,
           CASE WHEN count(*) = 1 THEN arg_min(description, ord) ELSE any_value(merged) END AS description,
           count(*) AS n_rows, any_value(n_descriptions) AS n_descriptions, count(DISTINCT chunk_id) AS n_sources
    FROM k JOIN t USING (key) GROUP BY key"""))
def dedup_entities(i):
    return r.dedup_entities(i.fx_entities)


@query("ext7_entity_sources", with_("SELECT DISTINCT lower(trim(entity_name)) AS key, chunk_id FROM fx_entities"))
def entity_sources(i):
    return r.entity_sources(i.fx_entities)


VALID = """
    s AS (SELECT lower(entity_name) AS low, arg_max(entity_name, ord) AS spelled FROM fx_entities GROUP BY ALL),
    v AS (SELECT r.* REPLACE (a.spelled AS source_id, b.spelled AS target_id) FROM fx_relationships r
          JOIN s a ON a.low = lower(source_id) JOIN s b ON b.low = lower(target_id) WHERE a.spelled <> b.spelled)"""


@query("ext9_validated", with_(f"WITH {VALID} SELECT * FROM v"))
def validated(i):
    return r.validate_relationships(i.fx_relationships, i.fx_entities)


# Entities of the smaller suppliers only, so that some relationships lose their source.
SOME = "SELECT * FROM fx_entities WHERE entity_name NOT IN (SELECT s_name FROM supplier WHERE s_acctbal < 1000)"


def _some(i):
    poor = i.supplier.where("s_acctbal < 1000").select(F.col("s_name").alias("entity_name"))
    return i.fx_entities.join(poor, "entity_name", "left_anti")


@query("ext10_rejected", with_(f"""WITH e AS ({SOME}), n AS (SELECT DISTINCT entity_name FROM e)
    SELECT *, CASE WHEN source_id NOT IN (FROM n) THEN 'source missing' WHEN target_id NOT IN (FROM n) THEN 'target missing' ELSE 'self-loop' END AS reason
    FROM fx_relationships WHERE source_id NOT IN (FROM n) OR target_id NOT IN (FROM n) OR source_id = target_id"""))
def rejected(i):
    return r.split_relationships(i.fx_relationships, _some(i))[1]


@query("ext11_dedup_relationships", with_(f"""WITH
    d AS (SELECT source_id, target_id, lower(description) AS folded, arg_min(description, (ord, description)) AS description, min(ord) AS o
          FROM fx_relationships GROUP BY ALL),
    t AS (SELECT source_id, target_id, left(string_agg(description, '; ' ORDER BY o, description), 400) AS merged, count(*) AS n_descriptions FROM d GROUP BY ALL),
    kw AS (SELECT source_id, target_id, keyword FROM (SELECT DISTINCT source_id, target_id, trim(unnest(string_split(keywords, ','))) AS keyword FROM fx_relationships)
           QUALIFY row_number() OVER (PARTITION BY source_id, target_id ORDER BY keyword) <= 5),
    kt AS (SELECT source_id, target_id, string_agg(keyword, ', ' ORDER BY keyword) AS kept FROM kw GROUP BY ALL)
    SELECT source_id, target_id,
           CASE WHEN count(*) = 1 THEN any_value(keywords) ELSE any_value(kept) END AS keywords,
           CASE WHEN count(*) = 1 THEN any_value(description) ELSE any_value(merged) END AS description,
           arg_min(weight, (ord, keywords, description, weight)) AS weight,
           count(*) AS n_rows, any_value(n_descriptions) AS n_descriptions, count(DISTINCT chunk_id) AS n_sources
    FROM fx_relationships JOIN t USING (source_id, target_id) JOIN kt USING (source_id, target_id) GROUP BY source_id, target_id"""))
def dedup_relationships(i):
    return r.dedup_relationships(i.fx_relationships)


@query("ext12_statistics", with_("""
    SELECT *, round(1 - unique_entities / greatest(total_entities, 1)::DOUBLE, 6) AS dedup_ratio FROM (
    SELECT (SELECT count(*) FROM fx_entities) AS total_entities, (SELECT count(DISTINCT entity_name) FROM fx_entities) AS unique_entities,
           (SELECT count(*) FROM fx_relationships) AS total_relationships,
           (SELECT count(*) FROM (SELECT DISTINCT source_id, target_id FROM fx_relationships)) AS unique_pairs)"""))
def statistics(i):
    return r.extraction_statistics(i.fx_entities, i.fx_relationships).withColumn("dedup_ratio", F.round("dedup_ratio", 6))


@query("ext12_type_counts", with_("SELECT entity_type, count(*) AS n FROM fx_entities GROUP BY ALL"))
def type_counts(i):
    return r.entity_type_counts(i.fx_entities)


@query("ext13_orphans", with_(f"""WITH n AS (SELECT DISTINCT entity_name FROM ({SOME}))
    SELECT * FROM fx_relationships WHERE source_id NOT IN (FROM n) OR target_id NOT IN (FROM n)"""))
def orphans(i):
    return r.orphaned_relationships(i.fx_relationships, _some(i))


@query("ext13_clean_report", with_(f"""WITH n AS (SELECT DISTINCT entity_name FROM ({SOME}))
    SELECT count(*) AS total, count(*) FILTER (WHERE source_id NOT IN (FROM n) OR target_id NOT IN (FROM n)) AS orphaned, 0::BIGINT AS deleted
    FROM fx_relationships"""))
def clean_report(i):
    return r.clean_orphans(i.fx_relationships, _some(i), dry_run=True)[1]


@query("ext14_edge_check", with_(f"""WITH n AS (SELECT DISTINCT entity_name FROM ({SOME})),
    e AS (SELECT DISTINCT source_id AS source, target_id AS target FROM fx_relationships)
    SELECT source, target, CASE WHEN source NOT IN (FROM n) THEN 'source' WHEN target NOT IN (FROM n) THEN 'target' END AS missing FROM e"""))
def edge_check(i):
    edges = i.fx_relationships.select(F.col("source_id").alias("source"), F.col("target_id").alias("target")).distinct()
    return r.validate_edges(edges, _some(i).select(F.col("entity_name").alias("node_id")))


@query("ext15_existing", with_("""SELECT DISTINCT p_name AS entity_name FROM part WHERE p_name IN (SELECT entity_name FROM fx_entities)
    UNION ALL SELECT c_name FROM customer WHERE c_name IN (SELECT entity_name FROM fx_entities)"""))
def existing(i):
    asked = i.sql("SELECT DISTINCT p_name AS entity_name FROM part UNION ALL SELECT c_name FROM customer")
    return r.existing_names(asked, i.fx_entities)


def spotted_sql(key: str, text: str, table: str) -> str:
    """WITH entries up to ``spotted`` (key, place, entity): title-case runs and acronyms, longest first, five at most."""
    return rf"""st AS (SELECT {key}, {text} AS t, regexp_replace({text}, '[À-ɏ]', '_', 'g') AS plain FROM {table}),
    se AS (SELECT DISTINCT {key}, unnest(list_concat(regexp_extract_all(plain, '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b'), regexp_extract_all(t, '{"|".join(fixed.ACRONYMS)}'))) AS entity FROM st),
    spotted AS (SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY -length(entity), entity) - 1 AS INTEGER) AS place, entity FROM se QUALIFY place < 5)"""


@query("ext16_spotted", f"WITH {spotted_sql('doc_id', 'text', 'documents')} SELECT * FROM spotted")
def spotted(i):
    """Entity mentions spotted in whole documents."""
    found = i.documents.select("doc_id", F.posexplode(r.spot_entities(F.col("text"))).alias("place", "entity"))
    return found


@query("ext16_acronyms", r"""SELECT qid, unnest(list_sort(list_distinct(regexp_extract_all(question, '(GPT|API|LLM|RAG|AI|ML|DL)')))) AS entity
    FROM (SELECT doc_id AS qid, upper(text) AS question FROM documents)""")
def acronyms(i):
    """Acronyms in documents in upper case, where no title-case word occurs."""
    spotted_ = r.spot_entities(F.upper("text"), limit=len(fixed.ACRONYMS))
    return i.documents.select(F.col("doc_id").alias("qid"), F.explode(spotted_).alias("entity"))
