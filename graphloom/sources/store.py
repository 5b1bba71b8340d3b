"""Tables on shared storage: appends, upserts, export, vector store files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ("user_id",)) -> None:
    """Bulk insert, laid out by tenant: the rows of a tenant lie side by side, so that a filter skips what others have.

    Files are as large as Spark makes partitions, however many tenants there are; a large tenant has several.
    """
    df.hint("rebalance", *partition_by).sortWithinPartitions(*partition_by).write.mode("append").parquet(path)


def upsert(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full-row version of a keyed ``set``: fields given in ``new`` win, others keep their stored value.

    Fields that only ``new`` has are added, null for rows that it does not name. Both sides are unique on
    the keys. The result is a new version of the table; write it beside the old one, never over the files
    it is read from.
    """
    a, b = stored.alias("a"), new.alias("b")
    values = [F.coalesce(f"b.{c}", f"a.{c}").alias(c) if c in new.columns else F.col(f"a.{c}") for c in stored.columns if c not in keys]
    added = [F.col(f"b.{c}") for c in new.columns if c not in stored.columns]
    return a.join(b, list(keys), "full").select(*keys, *values, *added)


def add_links(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Link-table version of adding to a set."""
    return stored.unionByName(new.select(*stored.columns)).distinct()


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header line, one file per partition."""
    df.write.mode("overwrite").option("header", "true").csv(path)


def save_vectors(store: DataFrame, path: str) -> None:
    """Vector store as Parquet, laid out by document so that document filters prune files."""
    store.repartitionByRange("doc_id", "idx").sortWithinPartitions("doc_id", "idx").write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
