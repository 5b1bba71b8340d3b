"""Live daily counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def daily_counts(events: DataFrame, time: str = "created_at", lateness: str = "1 day") -> DataFrame:
    """Events per calendar day of a stream; days older than the watermark are closed and dropped from state."""
    return (
        events.withColumn(time, F.col(time).cast("timestamp"))
        .withWatermark(time, lateness)
        .groupBy(F.window(time, "1 day"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n")
    )


def write_counts(counts: DataFrame, path: str) -> StreamingQuery:
    """Write changed days after every batch; a batch that is repeated replaces its own folder."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data/batch={batch_id}")

    return (
        counts.writeStream.outputMode("update")
        .option("checkpointLocation", f"{path}/state")
        .trigger(availableNow=True)
        .foreachBatch(save)
        .start()
    )


def read_counts(spark, path: str) -> DataFrame:
    """The latest count of every day."""
    schema = "day string, n long, batch int"
    return spark.read.schema(schema).parquet(f"{path}/data").groupBy("day").agg(F.max_by("n", "batch").alias("n"))
