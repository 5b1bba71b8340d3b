"""Dashboards: user activity, daily logins, storage and document reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _in_period(rows: DataFrame, start=None, end=None) -> DataFrame:
    if start is not None:
        rows = rows.where(F.col("created_at") >= F.lit(start).cast("timestamp_ntz"))
    return rows if end is None else rows.where(F.col("created_at") <= F.lit(end).cast("timestamp_ntz"))


def user_activity(
    users: DataFrame, logins: DataFrame, conversations: DataFrame, messages: DataFrame, start, end
) -> DataFrame:
    """Per user, also without any activity: conversations, messages and logins in the period, last login.

    Each fact is counted per user first, so the joins meet one row per user.
    """
    begin, until = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    c = conversations.where(F.col("created_at") >= begin).groupBy("user_id").agg(F.count(F.lit(1)).alias("conversations"))
    per_conversation = messages.where(F.col("created_at") >= begin).groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n"))
    m = (
        conversations.select("user_id", "conversation_id")
        .join(per_conversation, "conversation_id")
        .groupBy("user_id")
        .agg(F.sum("n").alias("messages"))
    )
    seen = logins.where(F.col("created_at").between(begin, until)).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("logins"), F.max("created_at").alias("last_login")
    )
    out = users
    for part in (c, m, seen):
        out = out.join(part, "user_id", "left")
    return out.select(
        "user_id", "username", "role", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("conversations", "messages", "logins")], "last_login"
    )


def daily_logins(logins: DataFrame, start: str, days: int) -> DataFrame:
    """Logins for every day of the period, zeros included (``days`` + 1 rows)."""
    first = F.to_date(F.lit(start))
    calendar = logins.sparkSession.range(1).select(F.explode(F.sequence(first, F.date_add(first, days))).alias("day"))
    until = F.date_add(first, days + 1)
    inside = logins.where((F.col("created_at") >= first.cast("timestamp_ntz")) & (F.col("created_at") < until.cast("timestamp_ntz")))
    counted = inside.groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return calendar.join(counted, "day", "left").select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("n", F.lit(0)).alias("n")
    )


def totals(activity: DataFrame, logins: DataFrame, start, end) -> DataFrame:
    """Users, their conversations and messages, and all logins of the period, those of unknown users included."""
    own = activity.agg(
        F.count(F.lit(1)).alias("users"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("conversations", "messages")]
    )
    counted = _in_period(logins, start, end).agg(F.count(F.lit(1)).alias("logins"))
    # One row each.
    return own.withColumn("k", F.lit(0)).join(counted.withColumn("k", F.lit(0)), "k").select("users", "logins", "conversations", "messages")


def activity_table(activity: DataFrame) -> DataFrame:
    """For display and export: most logins first, ``Never`` without a login."""
    return activity.select(
        "username",
        "role",
        "logins",
        F.coalesce(F.date_format("last_login", "yyyy-MM-dd HH:mm"), F.lit("Never")).alias("last_login"),
        F.col("conversations").alias("chats"),
        "messages",
    ).orderBy(F.desc("logins"), "username")


def recent_logins(
    logins: DataFrame, users: DataFrame, username: str | None = None, limit: int = 10, start=None, end=None,
    order: Sequence[str] = ("created_at", "event_id"),
) -> DataFrame:
    """Newest logins of the period, of all users or of one; columns of ``order`` that the table lacks are left out."""
    named = _in_period(logins, start, end)
    if username is not None:
        named = named.join(users.where(F.col("username") == username).select("user_id"), "user_id", "left_semi")
    top = named.orderBy(*[F.desc(c) for c in order if c in logins.columns], "user_id").limit(limit)
    return top.join(users, "user_id", "left").select(
        F.coalesce("username", F.lit("Unknown")).alias("username"),
        F.coalesce("role", F.lit("N/A")).alias("role"),
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("at"),
    )


def storage_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("item"), "n")
        out = part if out is None else out.unionByName(part)
    return out


STATS = ["chunks", "entities", "relationships", "graph_nodes", "graph_edges", "embeddings"]


def document_statistics(documents: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """Per document: rows in each table of ``parts`` (keyed by doc_id) and whether it was completed."""
    out = documents
    for name in STATS:
        counted = parts[name].groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))
        out = out.join(counted, "doc_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out.withColumn("status", F.when((F.col("chunks") > 0) & (F.col("embeddings") > 0), "completed").otherwise("failed"))


def document_list(documents: DataFrame, limit: int | None = None) -> DataFrame:
    """Documents with their numbers, newest first."""
    shown = documents.select(
        "doc_id", "filename", F.date_format("uploaded_at", "yyyy-MM-dd HH:mm").alias("uploaded_at"),
        F.coalesce("status", F.lit("unknown")).alias("status"), *[F.coalesce(c, F.lit(0)).alias(c) for c in STATS],
    ).orderBy(F.desc("uploaded_at"), "doc_id")
    return shown if limit is None else shown.limit(limit)
