"""Model output to clean entity and relationship rows: parsing, quality, dedup, validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import fixed
from graphloom.functions.text import clean_field, first_text, is_good_entity, join_firsts, keyword_list, strip
from graphloom.operators.spread import join_lookup

ENTITY_CHARS = 500
RELATION_CHARS = 400
KEYWORDS_KEPT = 5


# ----------------------------------------------------------------- parsing


def _others(output: DataFrame) -> list[str]:
    return [c for c in output.columns if c not in ("chunk_id", "ord", "result")]


def record_lines(output: DataFrame) -> DataFrame:
    """Delimited record lines of model output (chunk_id, ord, result): one row per line with its fields.

    Other columns of the output, such as its document, stay with every line.
    """
    # Split inside the generator: a filter on the fields of a line does not split it once more.
    parted = F.transform(
        F.split("result", "\n"), lambda x: F.struct(x.contains(fixed.DONE_MARK).alias("done"), F.split(strip(x), r"<\|#\|>").alias("field"))
    )
    lines = output.select("chunk_id", "ord", *_others(output), F.posexplode(parted).alias("line_no", "line"))
    return (
        lines.where(~F.col("line.done") & (F.size("line.field") >= 4))
        .select("chunk_id", "ord", *_others(output), "line_no", "line.field")
        .withColumn("kind", F.lower(strip(F.col("field")[0])))
    )


def _cleaned(lines: DataFrame, kept: list[str], fields: dict[str, Column]) -> DataFrame:
    """Record lines with cleaned fields by name. A generator keeps the filters above from cleaning each field again."""
    cells = F.struct(*[clean_field(c).alias(name) for name, c in fields.items()])
    return lines.select("chunk_id", "ord", "line_no", *kept, F.inline(F.array(cells)))


def _is_entity(kind: Column) -> Column:
    return kind.contains("entity")


def parse_entities(output: DataFrame, check_quality: bool = True) -> DataFrame:
    """Entity rows; confidence defaults to 3 and stays within 1–5, unknown types become ``other``."""
    field = F.col("field")
    fifth = F.when(F.size(field) >= 5, F.get(field, 4))
    lines = _cleaned(
        record_lines(output).where(_is_entity(F.col("kind"))),
        _others(output),
        {"entity_name": field[1], "__type": field[2], "description": field[3], "__fifth": fifth},
    )
    type_, given = F.lower("__type"), F.expr("try_cast(__fifth AS INT)")
    rows = lines.select(
        "chunk_id",
        "ord",
        "line_no",
        "entity_name",
        F.when(type_.isin(fixed.ENTITY_TYPES), type_).otherwise("other").alias("entity_type"),
        "description",
        F.when(given.isNull(), 3).otherwise(F.greatest(F.lit(1), F.least(F.lit(5), given))).alias("confidence"),
        *_others(output),
    ).where("entity_name <> '' AND description <> ''")
    return rows.where(is_good_entity(F.col("entity_name"), F.col("description"))) if check_quality else rows


def parse_relationships(output: DataFrame) -> DataFrame:
    """Relationship rows: five fields, both ends named and different, weight 1."""
    field = F.col("field")
    named = F.col("kind").contains("relation") & (F.size("field") >= 5)
    lines = _cleaned(
        record_lines(output).where(~_is_entity(F.col("kind")) & named),
        _others(output),
        {"source_id": field[1], "target_id": field[2], "keywords": field[3], "description": F.get(field, 4)},
    )
    return lines.select(
        "chunk_id", "ord", "line_no", "source_id", "target_id", "keywords", "description", F.lit(1.0).alias("weight"), *_others(output)
    ).where("source_id <> '' AND target_id <> '' AND source_id <> target_id")


def good_entities(entities: DataFrame) -> DataFrame:
    return entities.where(is_good_entity(F.col("entity_name"), F.col("description")))


# ------------------------------------------------------------------- dedup


def _merge(rows: DataFrame, keys: list[str], values: list[str], chars: int) -> DataFrame:
    """Per key: first row's values, merged description, numbers of rows, distinct descriptions and sources.

    Equal descriptions are merged first, with partial sums, so that everything but
    the sources is worked out from one row per key and distinct description.
    """
    said = rows.groupBy(*keys, F.lower("description").alias("__same")).agg(
        F.min(F.struct(*dict.fromkeys(["ord", *values]))).alias("row"),
        F.min(first_text("description", "ord", chars)).alias("__first"),
        F.count(F.lit(1)).alias("n"),
    )
    facts = said.groupBy(*keys).agg(
        F.min("row").alias("first"), F.sum("n").alias("n_rows"), F.count("__same").alias("n_descriptions")
    )
    merged = join_firsts(said.where("`__same` <> ''"), keys, chars, "merged")
    sources = rows.select(*keys, "chunk_id").distinct().groupBy(*keys).agg(F.count("chunk_id").alias("n_sources"))
    return facts.join(merged, keys, "left").join(sources, keys)


def name_key(name: str = "entity_name") -> Column:
    return F.lower(F.trim(name))


def dedup_entities(entities: DataFrame, scope: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """One row per case-insensitive name (and scope): first spelling and type, distinct descriptions, source count.

    A name that occurs once keeps its whole description. ``keep`` names more columns of the first row to keep.
    """
    keyed = entities.withColumn("key", name_key())
    merged = _merge(keyed, [*scope, "key"], ["entity_name", "entity_type", "description", *keep], ENTITY_CHARS)
    return merged.select(
        *scope,
        "key",
        *[F.col(f"first.{c}").alias(c) for c in keep],
        F.col("first.entity_name").alias("entity_name"),
        F.col("first.entity_type").alias("entity_type"),
        F.when(F.col("n_rows") == 1, F.col("first.description")).otherwise(F.col("merged")).alias("description"),
        "n_rows",
        "n_descriptions",
        "n_sources",
    )


def one_spelling(entities: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """All rows, each under the first spelling and type of its name (and scope), ignoring case."""
    keyed = entities.withColumn("__key", name_key())
    firsts = keyed.groupBy(*scope, "__key").agg(F.min(F.struct("ord", "entity_name", "entity_type")).alias("__first"))
    told = join_lookup(keyed, firsts, [*scope, "__key"])
    changed = {c: F.col(f"__first.{c}").alias(c) for c in ("entity_name", "entity_type")}
    return told.select(*[changed.get(c, F.col(c)) for c in entities.columns])


def spelled_ends(relationships: DataFrame, entities: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """All rows; ends that name an entity (of the scope), ignoring case, in its spelling."""
    spelling = entities.groupBy(*scope, name_key().alias("__low")).agg(F.min("entity_name").alias("__spelled"))
    out = relationships
    for end in ("source_id", "target_id"):
        out = join_lookup(out.withColumn("__low", name_key(end)), spelling, [*scope, "__low"], "left")
        out = out.withColumn(end, F.coalesce("__spelled", end)).drop("__low", "__spelled")
    return out.select(*relationships.columns)


def entity_sources(entities: DataFrame) -> DataFrame:
    """Link table: deduplicated entity → chunk it was found in."""
    return entities.select(F.lower(F.trim("entity_name")).alias("key"), "chunk_id").distinct()


def distinct_descriptions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Link table: key → distinct description, with the place of its first appearance."""
    return rows.groupBy(*keys, F.lower("description").alias("folded")).agg(
        F.min(F.struct("ord", "description")).alias("first")
    ).select(*keys, F.col("first.ord").alias("ord"), F.col("first.description").alias("description"))


def dedup_relationships(relationships: DataFrame, scope: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """One row per directed pair (and scope): distinct descriptions, the first five keywords in order, first weight, source count."""
    keys = [*scope, "source_id", "target_id"]
    merged = _merge(relationships, keys, ["keywords", "description", "weight", *keep], RELATION_CHARS)
    kept = (
        relationships.select(*keys, F.explode(keyword_list(F.col("keywords"))).alias("keyword"))
        .distinct()
        .withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("keyword")))
        .where(F.col("place") <= KEYWORDS_KEPT)
        .groupBy(*keys)
        .agg(F.array_join(F.array_sort(F.collect_list("keyword")), ", ").alias("kept"))
    )
    once = F.col("n_rows") == 1
    return (
        merged.join(kept, keys, "left")
        .select(
            *keys,
            *[F.col(f"first.{c}").alias(c) for c in keep],
            F.when(once, F.col("first.keywords")).otherwise(F.coalesce("kept", F.lit(""))).alias("keywords"),
            F.when(once, F.col("first.description")).otherwise(F.col("merged")).alias("description"),
            F.col("first.weight").alias("weight"),
            "n_rows",
            "n_descriptions",
            "n_sources",
        )
    )


def extraction_statistics(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Totals, distinct counts and share of repeated entity rows, one row."""
    e = entities.agg(
        F.count(F.lit(1)).alias("total_entities"), F.countDistinct("entity_name").alias("unique_entities")
    ).withColumn("k", F.lit(0))
    r = relationships.agg(
        F.count(F.lit(1)).alias("total_relationships"), F.countDistinct("source_id", "target_id").alias("unique_pairs")
    ).withColumn("k", F.lit(0))
    return (
        e.join(r, "k")
        .drop("k")
        .withColumn(
            "dedup_ratio",
            1 - F.col("unique_entities") / F.greatest(F.col("total_entities"), F.lit(1)).cast("double"),
        )
    )


def entity_type_counts(entities: DataFrame) -> DataFrame:
    return entities.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))


# -------------------------------------------------------------- validation


def validate_relationships(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """Keep relationships whose ends both name an entity, ignoring case; ends take the entity's spelling.

    Where several spellings of one name exist, the last one in order is used.
    """
    spelling = entities.groupBy(F.lower("entity_name").alias("low")).agg(
        F.max(F.struct("ord", "entity_name"))["entity_name"].alias("spelled")
    )
    out = relationships
    for end in ("source_id", "target_id"):
        names = spelling.withColumnsRenamed({"low": f"{end}_low", "spelled": f"{end}_spelled"})
        out = join_lookup(out.withColumn(f"{end}_low", F.lower(end)), names, [f"{end}_low"])
        out = out.withColumn(end, F.col(f"{end}_spelled")).drop(f"{end}_low", f"{end}_spelled")
    return out.where(F.col("source_id") != F.col("target_id")).select(*relationships.columns)


def _end_flags(relationships: DataFrame, entities: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    known = entities.select(*scope, F.col("entity_name").alias("name")).distinct()
    out = relationships
    for end in ("source_id", "target_id"):
        flag = known.select(*scope, F.col("name").alias(end), F.lit(True).alias(f"{end}_known"))
        out = join_lookup(out, flag, [*scope, end], "left")
    return out


def split_relationships(relationships: DataFrame, entities: DataFrame, scope: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with ``reason``) by exact names (of the scope): source missing, then target missing, then self-loop."""
    flagged = _end_flags(relationships, entities, scope).withColumn(
        "reason",
        F.when(F.col("source_id_known").isNull(), "source missing")
        .when(F.col("target_id_known").isNull(), "target missing")
        .when(F.col("source_id") == F.col("target_id"), "self-loop"),
    )
    flagged = flagged.drop("source_id_known", "target_id_known")
    return flagged.where("reason IS NULL").drop("reason"), flagged.where("reason IS NOT NULL")


def orphaned_relationships(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """Relationships with an end that names no entity."""
    flagged = _end_flags(relationships, entities)
    lost = F.col("source_id_known").isNull() | F.col("target_id_known").isNull()
    return flagged.where(lost).drop("source_id_known", "target_id_known")


def clean_orphans(relationships: DataFrame, entities: DataFrame, dry_run: bool = True) -> tuple[DataFrame, DataFrame]:
    """(relationships after the clean-up, report); a dry run reports and changes nothing."""
    flagged = _end_flags(relationships, entities)
    lost = F.col("source_id_known").isNull() | F.col("target_id_known").isNull()
    report = flagged.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(lost, 1)).alias("orphaned"),
        F.count(F.when(lost, 1) if not dry_run else F.lit(None)).alias("deleted"),
    )
    kept = relationships if dry_run else flagged.where(~lost).drop("source_id_known", "target_id_known")
    return kept, report


def validate_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the missing end named: ``source``, ``target`` or null when valid."""
    known = nodes.select("node_id").distinct()
    out = edges
    for end in ("source", "target"):
        flag = known.select(F.col("node_id").alias(end), F.lit(True).alias(f"{end}_known"))
        out = join_lookup(out, flag, [end], "left")
    return out.withColumn(
        "missing", F.when(F.col("source_known").isNull(), "source").when(F.col("target_known").isNull(), "target")
    ).drop("source_known", "target_known")


def existing_names(names: DataFrame, entities: DataFrame) -> DataFrame:
    """The names that are entities, exact spelling."""
    return names.join(entities.select("entity_name").distinct(), "entity_name", "left_semi")


# --------------------------------------------------------------- spotting


def spot_entities(text: Column, limit: int = 5) -> Column:
    """Title-case runs and known acronyms in a text, longest first, at most ``limit``."""
    runs = F.regexp_extract_all(text, F.lit(f"(?U)({fixed.TITLE_CASE_RUN})"), 1)
    acronyms = F.regexp_extract_all(text, F.lit("(" + "|".join(fixed.ACRONYMS) + ")"), 1)
    keyed = F.transform(
        F.array_union(runs, acronyms), lambda e: F.struct((-F.length(e)).alias("minus"), e.alias("entity"))
    )
    return F.slice(F.array_sort(keyed), 1, limit)["entity"]
