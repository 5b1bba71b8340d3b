"""Files to text, and the text forms of parsed documents and tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions import fixed, markup
from graphloom.functions.text import strip

Parser = Callable[[str], str]


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def decode_text(content: Column) -> Column:
    """UTF-8, or Latin-1 where the bytes are not valid UTF-8; line ends become ``\\n``."""
    as_text = F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(as_text, "\r\n?", "\n")


def _files(spark: SparkSession, path: str, suffixes: Sequence[str]) -> DataFrame:
    ends = [e for s in suffixes for e in (s, s.upper())]
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.{" + ",".join(ends) + "}")
        .option("recursiveFileLookup", "true")
        .load(path)
    )


def read_documents(
    spark: SparkSession,
    path: str,
    parsers: dict[str, Parser] | None = None,
    binary_parsers: dict[str, Callable[[bytes], str]] | None = None,
) -> DataFrame:
    """(file_path, file_type, text) of every readable file below ``path``.

    Plain text is decoded without leaving the JVM; HTML, XML, JSON and CSV go through
    Python in Arrow batches. Other suffixes are not read unless a parser over bytes is
    given for them; files without text are left out.
    """
    parsers = markup.PARSERS if parsers is None else parsers
    columns = [F.col("path").alias("file_path"), F.upper(suffix(F.col("path"))).alias("file_type")]
    plain = _files(spark, path, fixed.TEXT_SUFFIXES).select(*columns, decode_text(F.col("content")).alias("text"))
    marked = _files(spark, path, list(parsers)).select(*columns, decode_text(F.col("content")).alias("text"))
    out = plain.unionByName(parse_marked(marked, parsers))
    if binary_parsers:
        raw = _files(spark, path, list(binary_parsers)).select(*columns, F.col("content").alias("text"))
        out = out.unionByName(parse_marked(raw, binary_parsers))
    return out.where(F.trim("text") != "")


def parse_marked(files: DataFrame, parsers: dict[str, Callable]) -> DataFrame:
    """Apply the parser of each file's type to its content; a file its parser fails on gives an empty text."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("file_path", "file_type", "text")])

    def parse(kind: str, content) -> str:
        try:
            return parsers[kind.lower()](content)
        except Exception:
            return ""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(text=[parse(k, c) for k, c in zip(frame["file_type"], frame["text"])])

    return files.select("file_path", "file_type", "text").mapInPandas(work, schema)


def parse_column(df: DataFrame, column: str, parser: Parser, out: str = "text") -> DataFrame:
    """Replace a markup column by its text."""
    kept = [f for f in df.schema.fields if f.name != column]
    schema = T.StructType([*kept, T.StructField(out, T.StringType())])

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.drop(columns=[column]).assign(**{out: [parser(x or "") for x in frame[column]]})

    return df.mapInPandas(work, schema)


def row_lines(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of a table as ``a | b | c`` lines; missing values are empty. Adds ``line``."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return table.withColumn("line", F.concat_ws(" | ", *cells))


# ------------------------------------------------------ parsed documents


def _lookup(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def element_markdown(label: Column, text: Column) -> Column:
    """Markdown of one document element; an unknown label leaves the text as it is."""
    forms = {k: v.split("{}") for k, v in {**fixed.ELEMENT_FORMS, "table": fixed.TABLE_FORM}.items()}
    before = F.coalesce(_lookup({k: v[0] for k, v in forms.items()})[label], F.lit(""))
    after = F.coalesce(_lookup({k: v[1] for k, v in forms.items()})[label], F.lit(""))
    body = strip(text)
    quoted = F.regexp_replace(body, "(?dm)^", "> ")
    return F.when(label.isin(fixed.QUOTED_ELEMENTS), quoted).otherwise(F.concat(before, body, after))


def elements_text(elements: Column) -> Column:
    """Markdown text of a document from its array of (label, text); blank elements are skipped."""
    kept = F.filter(elements, lambda e: strip(F.coalesce(e["text"], F.lit(""))) != "")
    parts = F.transform(kept, lambda e: element_markdown(e["label"], e["text"]))
    return F.when(F.size(parts) > 0, F.concat(F.array_join(parts, "\n\n"), F.lit("\n"))).otherwise("")


def elements_documents(elements: DataFrame) -> DataFrame:
    """(doc_id, text): Markdown of documents given as a table (doc_id, idx, label, text) of their elements."""
    listed = F.array_sort(F.collect_list(F.struct("idx", "label", "text")))
    return elements.groupBy("doc_id").agg(listed.alias("elements")).select("doc_id", elements_text(F.col("elements")).alias("text"))


def document_metadata(attributes: Column) -> Column:
    """Known fields by their first non-empty alias, then every other non-empty attribute.

    ``attributes`` is a map from name to list of strings; lists are joined by ``, ``.
    """
    def value(name: str) -> Column:
        joined = F.array_join(F.coalesce(attributes[name], F.array().cast("array<string>")), ", ")
        return F.when(joined != "", joined)

    known = F.map_filter(
        F.create_map(*[x for k, names in fixed.METADATA_ALIASES.items() for x in (F.lit(k), F.coalesce(*[value(n) for n in names]))]),
        lambda k, v: v.isNotNull(),
    )
    spent = [n for names in fixed.METADATA_ALIASES.values() for n in names]
    rest = F.map_filter(
        F.transform_values(attributes, lambda k, v: F.array_join(v, ", ")), lambda k, v: ~k.isin(spent) & (v != "")
    )
    return F.map_concat(known, rest)


# --------------------------------------------------------------- uploads


def safe_name(name: Column) -> Column:
    """Letters, digits, dot, underscore, minus and blank only."""
    return F.regexp_replace(name, r"[^\p{L}\p{N}._\- ]", "")


def stored_name(name: Column, at: Column) -> Column:
    return F.concat(F.date_format(at, "yyyyMMdd_HHmmss"), F.lit("_"), safe_name(name))


def judged_uploads(uploads: DataFrame, max_bytes: int = fixed.MAX_UPLOAD_BYTES) -> DataFrame:
    """Every upload (filename, uploaded_at, length) with stored name, document id and whether it is ``accepted`` by size."""
    name = stored_name(F.col("filename"), F.col("uploaded_at"))
    doc_id = F.concat(F.date_format("uploaded_at", "yyyyMMdd_HHmmss"), F.lit("_"), F.col("filename"))
    accepted = F.coalesce(F.col("length") <= max_bytes, F.lit(False))
    return uploads.withColumns({"stored_as": name, "doc_id": doc_id, "accepted": accepted})
