"""Physical helpers: hot join keys, dense numbering and bounded ordered windows.

Three problems recur in every operator of this package, because one entity,
document or conversation may hold a large share of all rows:

* a join whose left side repeats one key very often (``join_lookup``),
* numbering rows densely in a global order without a one-task window
  (``dense_index``),
* looking back over the previous rows of one key (``segments``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import kept

SEGMENT_ROWS = 65_536


def join_lookup(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join ``left``, which may repeat a key very often, to ``right``; columns of the left first.

    Both sides are shuffled on the keys by the join itself and by nothing before it: only then can adaptive
    execution cut a hot key of the left into pieces of the size set by
    ``spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes`` and give each piece the rows of the
    right, in as many tasks as the key needs. No column is hashed but the keys, so maps may be among them.
    """
    on = list(on)
    added = [] if how in ("left_semi", "left_anti") else [c for c in right.columns if c not in on]
    return left.join(right, on, how).select(*left.columns, *added)


def dense_index(df: DataFrame, order: Sequence[str | Column], name: str = "idx", start: int = 0) -> DataFrame:
    """Add 0, 1, 2, … in the given (unique) order, without sorting everything in one task.

    Rows are range-partitioned and sorted once and written to the shared folder;
    the number of a row is its place in its partition plus the rows in earlier
    partitions. The per-partition offsets are one row per partition.
    """
    laid = kept(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("__place", F.monotonically_increasing_id())
    )
    # monotonically_increasing_id keeps the partition in the upper bits, the row below bit 33.
    part = F.shiftright("__place", 33)
    within = F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    offsets = (
        laid.groupBy(part.alias("__part"))
        .agg(F.count(F.lit(1)).alias("__rows"))
        .withColumn(
            "__before",
            F.coalesce(
                F.sum("__rows").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
        .select("__part", "__before")
    )
    return (
        laid.withColumn("__part", part)
        .join(F.broadcast(offsets), "__part")
        .withColumn(name, F.lit(start) + F.col("__before") + within)
        .drop("__part", "__before", "__place")
    )


def segments(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    lookback: int,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Prepare windows over the previous ``lookback`` rows of a key of any size.

    Adds ``seg`` (partition windows by ``seg`` and the key), ``pos`` (order by it)
    and ``halo`` (rows repeated from the segment before; drop them afterwards).
    A segment holds at most ``segment_rows + lookback`` rows of a key.
    """
    size = max(segment_rows, lookback)
    numbered = dense_index(df, [*key, *order], "pos")
    seg = F.floor(F.col("pos") / size).cast("long")
    tail = F.pmod(F.col("pos"), F.lit(size)) >= size - lookback
    copies = F.when(tail, F.array(seg, seg + 1)).otherwise(F.array(seg))
    return (
        numbered.withColumn("__home", seg)
        .withColumn("seg", F.explode(copies))
        .withColumn("halo", F.col("seg") != F.col("__home"))
        .drop("__home")
    )


def running_last(df: DataFrame, key: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Last non-null ``value`` in strictly earlier rows of the key, however far back."""
    numbered = dense_index(df, [*key, *order], "pos").withColumn("seg", F.floor(F.col("pos") / SEGMENT_ROWS))
    numbered = numbered.withColumn("__v", value)
    inside = Window.partitionBy("seg", *key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    local = numbered.withColumn("__near", F.last("__v", ignorenulls=True).over(inside))
    # One row per key and segment carries the latest value over to the segments after it.
    ends = numbered.groupBy(*key, "seg").agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col("pos"))).alias("__end"))
    across = Window.partitionBy(*key).orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("__far", F.last("__end", ignorenulls=True).over(across)).drop("__end")
    return (
        local.join(carried, [*key, "seg"], "left")
        .withColumn(name, F.coalesce("__near", "__far"))
        .drop("__v", "__near", "__far", "seg", "pos")
    )
