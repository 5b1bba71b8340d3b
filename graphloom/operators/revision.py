"""Merged rows that follow documents which go, come or are replaced, without a rebuild.

A key's attributes are those of its last document. Beside the live rows of all documents a state keeps, per key, how
many documents have it and the rows of its last two. A change that takes the last document away falls back to the one
before it; only keys that lost both are looked up among the live rows again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import cut

#: Rows of a key that are kept, and parts of a key's documents that are ranked by themselves first.
KEPT, PARTS = 2, 16


@dataclass(frozen=True)
class Revisions:
    """``rows``: (doc_id, keys, values), one per key and document. ``last``: up to two of them per key. ``counts``: (keys, n_docs)."""

    keys: tuple[str, ...]
    rows: DataFrame
    last: DataFrame
    counts: DataFrame


def _last(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of each key's last documents: first of each of a few parts of them, so that no key is ranked by one task alone."""
    named = rows.withColumn("__part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))
    for by in ([*keys, "__part"], [*keys]):
        place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("doc_id").desc()))
        named = named.withColumn("__place", place).where(F.col("__place") <= KEPT)
    return named.drop("__part", "__place")


def start(rows: DataFrame, keys: Sequence[str]) -> Revisions:
    """State of per-document rows; a document has a key once, and neither is null."""
    kept = cut(rows)
    return Revisions(tuple(keys), kept, cut(_last(kept, keys)), cut(kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_docs"))))


def merged(state: Revisions) -> DataFrame:
    """One row per key: the attributes of its last document and the number of documents."""
    keys = list(state.keys)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("doc_id").desc()))  # two rows at most
    top = state.last.withColumn("__place", place).where("__place = 1").drop("__place", "doc_id")
    return top.join(state.counts, keys)


def revise(state: Revisions, gone: DataFrame | None = None, new: DataFrame | None = None) -> tuple[Revisions, DataFrame]:
    """State without the documents ``gone`` (doc_id) and with the rows ``new``, and one row (touched, looked_up) of keys.

    A document in both is replaced. Documents that were not there are ignored; ``new`` rows of documents that are there
    and not in ``gone`` replace them as well.
    """
    keys = list(state.keys)
    columns = state.rows.columns
    new = cut((state.rows.limit(0) if new is None else new).select(*columns))
    leaving = new.select("doc_id").distinct()
    leaving = cut(leaving if gone is None else leaving.union(gone.select("doc_id")).distinct())
    lost = cut(state.rows.join(leaving, "doc_id", "left_semi").select(*keys))
    rows = cut(state.rows.join(leaving, "doc_id", "left_anti").select(*columns).unionByName(new))
    touched = lost.distinct().union(new.select(*keys)).distinct()

    signed = lost.withColumns({"was": F.lit(-1), "n": F.lit(-1)}).unionByName(new.select(*keys).withColumns({"was": F.lit(0), "n": F.lit(1)}))
    changes = signed.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("was").alias("was"))
    # Old documents that are left of a touched key, and of them those whose rows are known.
    held = state.last.join(leaving, "doc_id", "left_anti").join(touched, keys, "left_semi")
    known = held.groupBy(*keys).agg(F.count(F.lit(1)).alias("known"), F.min("doc_id").alias("from"))
    fate = cut(
        changes.join(state.counts, keys, "left").join(known, keys, "left").select(
            *keys,
            (F.coalesce("n_docs", F.lit(0)) + F.col("n")).alias("n_docs"),
            (F.coalesce("n_docs", F.lit(0)) + F.col("was")).alias("left"),
            F.coalesce("known", F.lit(0)).alias("known"),
            "from",
        )
    )
    looked_up = fate.where("left > 0 AND known = 0").select(*keys)
    # What is known of a key begins at its oldest kept document, unless that is all there is: older news stay among the rows.
    begins = fate.where("left > known AND known > 0").select(*keys, "from")
    fresh = new.join(begins, keys, "left").where("from IS NULL OR doc_id > from").join(looked_up, keys, "left_anti").select(*columns)
    again = rows.join(looked_up, keys, "left_semi")
    changed = _last(held.select(*columns).unionByName(fresh).unionByName(again.select(*columns)), keys).select(*columns)
    last = cut(state.last.join(touched, keys, "left_anti").select(*columns).unionByName(changed))
    counts = state.counts.join(fate.select(*keys), keys, "left_anti").unionByName(fate.where("n_docs > 0").select(*keys, "n_docs"))
    report = fate.agg(F.count(F.lit(1)).alias("touched"), F.count(F.when((F.col("left") > 0) & (F.col("known") == 0), 1)).alias("looked_up"))
    return Revisions(state.keys, rows, last, cut(counts)), report
