"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a table that is
written as Parquet and read again as the next stage's ``docs``. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import mixing, packing, partenum, substrings, toxicity
from graphloom.llm.common import folder, placed, read_table, stored
from graphloom.llm.queries import TARGETS, vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string kernel machine does not reject."""
    model = toxicity.train(docs, toxicity.training_marks(read_table(spark, sf_dir, "labels")))
    return toxicity.accepted(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows linked by likeness one: that of the least doc_id, nulls last, then of the least hash of its text.

    Rows are told apart by a stored number, so rows that share a doc_id, or have none, are as many documents.
    Rows without words link with nothing and stay.
    """
    named, (doc_id, text) = placed(docs, "doc_id", "text")
    rows = stored(named.withColumns({"row": F.monotonically_increasing_id(), "tie": F.xxhash64(text)}), "rows")
    groups = stored(partenum.near_duplicates(rows.select(F.col("row").alias("doc_id"), F.col(text).alias("text"))), "groups")
    keys = rows.select("row", F.col(doc_id).cast("long").alias("id"), "tie")
    member = groups.select(F.col("doc_id").alias("row"), "component_id").join(keys, "row")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tie", "row"))
    kept = member.groupBy("component_id").agg(first.alias("first")).select("first.row")
    return rows.join(kept, "row", "left_semi").select(*named.columns).toDF(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur more than once; documents of nothing else go."""
    return substrings.without_repeats(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least, and more often where its domains have less than their target weight."""
    marks = mixing.label_domains(read_table(spark, sf_dir, "labels"))
    return mixing.mixed(docs, marks, TARGETS, lower=1.0, upper=4.0, total=None)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("soft_mixing", mix_domains),
    ("best_two_fit", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the table ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained models and token ids cannot be said in SQL; the stages are tested against plain versions.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
SQL: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
