"""Sticky-header blocks of tables of any length.

Greedy packing looks at everything before, but all that it remembers between two rows is how full the current
block is. So a run of rows is a function from that number to the number after it (and how many blocks it starts),
found for every run by itself; runs are composed in order, and each then packs its rows from where it is entered.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions import pieces
from graphloom.functions.pieces import ChunkSettings
from graphloom.functions.text import strip, token_count
from graphloom.operators.spread import dense_index
from graphloom.session import kept

#: Rows of a run.
RUN_ROWS = 16_384


def _next(total: np.ndarray, room: int) -> np.ndarray:
    """For a block that starts at each row, the row that starts the one after it."""
    first = np.arange(len(total) - 1)
    return np.maximum(first + 1, np.searchsorted(total, total[:-1] + room, "right") - 1)


def _entered(total: np.ndarray, room: int) -> np.ndarray:
    """First row that does not fit, for a block entered with 0 … room + 1 words in it (room + 1: nothing fits)."""
    full = np.arange(room + 2)
    fits = np.searchsorted(total, total[0] + room - full, "right") - 1
    return np.where(full > room, 0, np.maximum(fits, 0))


def transfer(costs: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Words in the last block after the rows, and blocks started by them, for every number of words they may find there."""
    room = max(room, -1)
    n, total = len(costs), np.concatenate([[0], np.cumsum(costs)])
    after, used, started = _next(total, room), np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    for i in range(n - 1, -1, -1):
        if after[i] >= n:
            used[i], started[i] = min(total[n] - total[i], room + 1), 1
        else:
            used[i], started[i] = used[after[i]], started[after[i]] + 1
    first = _entered(total, room)
    whole = first >= n
    return np.where(whole, np.arange(room + 2) + total[n], used[first]), np.where(whole, 0, started[first])


def starts(costs: np.ndarray, room: int, full: int) -> np.ndarray:
    """Which rows start a block, if the first finds ``full`` words in the block before it."""
    room = max(room, -1)
    total = np.concatenate([[0], np.cumsum(costs)])
    after, out = _next(total, room), np.zeros(len(costs), bool)
    at = int(_entered(total, room)[full])
    while at < len(costs):
        out[at] = True
        at = int(after[at])
    return out


def table_blocks(rows: DataFrame, tables: DataFrame, max_tokens: int) -> DataFrame:
    """(doc_id, row_no, row, block): rows (doc_id, row_no, row) with the number of their block, from 0.

    A block has as many rows as fit beside the words of the prefix and header of its table (doc_id, header, prefix)
    within ``max_tokens``, one at least. Null rows are empty lines; (doc_id, row_no) is distinct and not null; rows of
    unknown tables are left out. A table may have any number of rows in any partitions.
    """
    top = token_count(F.concat_ws("\n", F.coalesce("prefix", F.lit("")), F.coalesce("header", F.lit(""))))
    rooms = tables.select("doc_id", (F.lit(max_tokens) - top).cast("int").alias("room"))
    lines = rows.select("doc_id", "row_no", F.coalesce("row", F.lit("")).alias("row"))
    numbered = dense_index(lines, ["doc_id", "row_no"], "pos").withColumn("run", F.floor(F.col("pos") / RUN_ROWS).cast("long"))
    laid = kept(numbered.withColumn("cost", token_count(F.col("row")).cast("long")).join(rooms, "doc_id"))
    kind = laid.schema["doc_id"].dataType
    doc = T.StructField("doc_id", kind)
    longs = lambda *names: [T.StructField(n, T.LongType()) for n in names]

    def told(part: pd.DataFrame) -> pd.DataFrame:
        """What the first and the last table of a run do to a block; tables between them lie in the run whole."""
        part = part.sort_values("pos")
        edges = {part["doc_id"].iloc[0], part["doc_id"].iloc[-1]}
        found = [(doc, *transfer(own["cost"].to_numpy(), int(own["room"].iloc[0]))) for doc, own in part.groupby("doc_id", sort=False) if doc in edges]
        return pd.DataFrame(found, columns=["doc_id", "after", "started"]).assign(run=part["run"].iloc[0])[["doc_id", "run", "after", "started"]]

    runs_schema = T.StructType([doc, *longs("run"), T.StructField("after", T.ArrayType(T.LongType())), T.StructField("started", T.ArrayType(T.LongType()))])
    runs = laid.select("doc_id", "run", "pos", "cost", "room").groupBy("run").applyInPandas(told, runs_schema)

    def composed(part: pd.DataFrame) -> pd.DataFrame:
        """Where each run of a table is entered: one row for ``RUN_ROWS`` of its rows."""
        part = part.sort_values("run")
        full, before, entries = len(part["after"].iloc[0]) - 1, 0, []  # nothing fits before the first block
        for out, started in zip(part["after"], part["started"]):
            entries.append((full, before))
            full, before = int(out[full]), before + int(started[full])
        return part[["doc_id", "run"]].assign(full=[e[0] for e in entries], before=[e[1] for e in entries])

    entries = runs.groupBy("doc_id").applyInPandas(composed, T.StructType([doc, *longs("run", "full", "before")]))

    def packed(part: pd.DataFrame) -> pd.DataFrame:
        part, blocks = part.sort_values("pos"), []
        for _, own in part.groupby("doc_id", sort=False):
            room, full, before = int(own["room"].iloc[0]), own["full"].iloc[0], own["before"].iloc[0]
            new = starts(own["cost"].to_numpy(), room, max(room, -1) + 1 if pd.isna(full) else int(full))
            blocks.append((0 if pd.isna(before) else int(before)) + np.cumsum(new) - 1)
        return part[["doc_id", "row_no", "row"]].assign(block=np.concatenate(blocks))

    out_schema = T.StructType([doc, T.StructField("row_no", rows.schema["row_no"].dataType), T.StructField("row", T.StringType()), *longs("block")])
    return laid.join(entries, ["doc_id", "run"], "left").groupBy("run").applyInPandas(packed, out_schema)


def packed_tables(rows: DataFrame, tables: DataFrame, settings: ChunkSettings = ChunkSettings()) -> DataFrame:
    """(doc_id, part, content): blocks of tables under prefix and header, as ``chunking.packed_rows`` gives for tables that fit in a row.

    Tables without rows are their prefix and header alone; a block that is still too long is cut into windows.
    """
    top = F.concat_ws("\n\n", F.nullif("prefix", F.lit("")), F.nullif("header", F.lit("")))
    blocks = table_blocks(rows, tables, settings.max_tokens)
    # A block is bounded by its words; only empty lines come without number.
    bodies = blocks.groupBy("doc_id", "block").agg(F.array_sort(F.collect_list(F.struct("row_no", "row")))["row"].alias("lines"))
    joined = tables.select("doc_id", top.alias("top")).join(bodies, "doc_id", "left")
    text = strip(F.when(F.col("lines").isNull(), F.col("top")).otherwise(F.array_join(F.concat(F.array("top"), "lines"), "\n")))

    @F.pandas_udf("array<string>")
    def cut_up(content: pd.Series) -> pd.Series:
        return content.map(lambda t: pieces.within(t, settings, pieces.count_words))

    cut_to = joined.select("doc_id", F.coalesce("block", F.lit(0)).alias("block"), F.posexplode(cut_up(text)).alias("piece", "content"))
    numbered = dense_index(cut_to, ["doc_id", "block", "piece"], "n")
    first = numbered.groupBy("doc_id").agg(F.min("n").alias("first"))
    return numbered.join(first, "doc_id").select("doc_id", (F.col("n") - F.col("first")).cast("int").alias("part"), "content")
