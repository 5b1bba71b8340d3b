"""Conversations and messages: listing, history windows, rewriting, titles, question–answer pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import clip, strip, token_count
from graphloom.operators.inference import Model, run_model
from graphloom.operators.spread import join_lookup, running_last, segments

KEY = ["conversation_id"]


def list_conversations(conversations: DataFrame, user_id=None, skip: int = 0, limit: int = 50) -> DataFrame:
    """Newest first."""
    rows = conversations if user_id is None else conversations.where(F.col("user_id") == user_id)
    return rows.orderBy(F.desc("updated_at"), "conversation_id").offset(skip).limit(limit)


def list_messages(messages: DataFrame, conversation_id, skip: int = 0, limit: int = 100) -> DataFrame:
    """Messages of one conversation in order."""
    return messages.where(F.col("conversation_id") == conversation_id).orderBy("turn").offset(skip).limit(limit)


def recent_messages(messages: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` messages of every conversation."""
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("turn")))
    return messages.withColumn("from_end", place).where(F.col("from_end") <= n).drop("from_end")


def history(messages: DataFrame, max_turns: int = 5) -> DataFrame:
    """Before every message: the previous ``2·max_turns`` messages as ``history`` (array of role, content)."""
    return _look_back(messages, F.struct("role", "content"), "history", max_turns)


def _look_back(messages: DataFrame, value: Column, name: str, max_turns: int) -> DataFrame:
    """Add an array of ``value`` over the previous ``2·max_turns`` messages."""
    back = 2 * max_turns
    w = Window.partitionBy("seg", *KEY).orderBy("pos").rowsBetween(-back, -1)
    return (
        segments(messages.withColumn(name, value), KEY, ["turn"], back)
        .withColumn(name, F.collect_list(name).over(w))
        .where(~F.col("halo"))
        .drop("seg", "pos", "halo")
    )


def spoken(role: Column, content: Column, chars: int) -> Column:
    """``User:``/``Assistant:`` line, content cut to ``chars``."""
    return F.concat(F.when(role == "user", "User: ").otherwise("Assistant: "), clip(content, chars))


def history_text(messages: DataFrame, max_turns: int = 5, chars: int = 200, heading: str | None = None) -> DataFrame:
    """Before every message: the history as text lines; empty without history."""
    # Messages are cut before they are gathered, so a message is copied whole no more than once.
    told = _look_back(messages, spoken(F.col("role"), F.col("content"), chars), "__lines", max_turns)
    lines = F.col("__lines")
    if heading is not None:
        lines = F.when(F.size(lines) > 0, F.concat(F.array(F.lit(heading)), lines)).otherwise(lines)
    return told.withColumn("history_text", F.array_join(lines, "\n")).drop("__lines")


def rewrite_candidates(messages: DataFrame, max_turns: int = 5, max_words: int = 10) -> DataFrame:
    """User messages short enough to need their history, with it."""
    return history_text(messages, max_turns).where(
        (F.col("role") == "user") & (F.col("history_text") != "") & (token_count(F.col("content")) <= max_words)
    )


def accept_rewrite(original: Column, reply: Column, max_words: int = 50) -> Column:
    """The reply without outer quotes if it is not empty and short enough, else the original."""
    bare = F.regexp_replace(strip(reply), r"""^["']+|["']+$""", "")
    return F.when((bare != "") & (token_count(bare) <= max_words), bare).otherwise(original)


def rewrite_questions(messages: DataFrame, model: Model, max_turns: int = 5, **options) -> DataFrame:
    """User messages with ``question``: rewritten to stand alone where a short message has a history."""
    rows = history_text(messages, max_turns).where(F.col("role") == "user")
    needed = (F.col("history_text") != "") & (token_count(F.col("content")) <= 10)
    prompt = F.concat(
        F.lit("Rewrite the question so that it can be understood without the conversation. Replace pronouns by what they\n"
              "stand for, add missing context, stay short, and repeat the question unchanged if it is already clear.\n\nConversation:\n"),
        "history_text", F.lit("\n\nQuestion: "), "content", F.lit("\n\nRewritten question:"),
    )
    asked = run_model(rows.withColumn("prompt", F.when(needed, prompt)), model, "prompt", "reply", **options)
    return asked.withColumn("question", accept_rewrite(F.col("content"), F.coalesce("reply", F.lit("")))).drop("prompt", "reply", "history_text")


def summaries(messages: DataFrame) -> DataFrame:
    """Per conversation: messages, turns, last user text and last assistant text."""
    last = lambda role: F.max_by("content", F.when(F.col("role") == role, F.col("turn")))
    return messages.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.floor(F.count(F.lit(1)) / 2).alias("turns"),
        last("user").alias("last_user"),
        last("assistant").alias("last_assistant"),
    )


def title_contexts(messages: DataFrame, n: int = 4, chars: int = 100) -> DataFrame:
    """Per conversation: the first ``n`` messages, ``chars`` characters each."""
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy("turn"))
    line = F.concat(F.initcap("role"), F.lit(": "), F.left("content", F.lit(chars)))
    return (
        messages.withColumn("place", place)
        .where(F.col("place") <= n)
        .groupBy(*KEY)
        .agg(F.array_join(F.array_sort(F.collect_list(F.struct("place", line.alias("line"))))["line"], "\n").alias("context"))
    )


def titles(messages: DataFrame, model: Model, **options) -> DataFrame:
    """(conversation_id, title): a model title of 1 to 100 characters, else null."""
    prompt = F.concat(
        F.lit("Give this conversation a short title of at most 50 characters.\n\n"), "context", F.lit("\n\nTitle:")
    )
    asked = run_model(title_contexts(messages).withColumn("prompt", prompt), model, "prompt", "reply", **options)
    bare = strip(F.regexp_replace(strip(F.col("reply")), r"""^["']+|["']+$""", ""))
    return asked.select(*KEY, F.when((bare != "") & (F.length(bare) <= 100), bare).alias("title"))


def user_statistics(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Per user: conversations, messages and the conversation updated last."""
    per_conversation = messages.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    joined = conversations.join(per_conversation, KEY, "left")
    recent = F.max(F.struct("updated_at", "conversation_id"))
    return joined.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("conversations"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("messages"),
        recent["conversation_id"].alias("recent_conversation"),
    )


def answered_questions(messages: DataFrame) -> DataFrame:
    """Every assistant message with the nearest earlier user message, however far back."""
    asked = F.when(F.col("role") == "user", F.col("content"))
    return running_last(messages, KEY, ["turn"], asked, "question").where(F.col("role") == "assistant").withColumnRenamed(
        "content", "answer"
    )


def answer_prompts(messages: DataFrame, contexts: DataFrame, max_turns: int = 5) -> DataFrame:
    """Full prompt of every user message: history, retrieved context, question.

    ``contexts`` is (conversation_id, turn, context).
    """
    rows = history(messages, max_turns).where(F.col("role") == "user").join(contexts, [*KEY, "turn"], "left")
    said = F.transform(
        "history", lambda m: F.concat(F.when(m["role"] == "user", "User: ").otherwise("Assistant: "), m["content"])
    )
    ask = F.concat(F.lit("\n"), F.coalesce("context", F.lit("")), F.lit("\n\nQuestion: "), "content", F.lit("\n"))
    prompt = F.when(
        F.size("history") > 0, F.concat(F.array_join(said, "\n\n"), F.lit("\n\nUser: "), ask)
    ).otherwise(ask)
    return rows.withColumn("prompt", prompt).select(*KEY, "turn", "prompt")


def append_messages(
    conversations: DataFrame, messages: DataFrame, new: DataFrame, keys: Sequence[str] = ("conversation_id",)
) -> tuple[DataFrame, DataFrame]:
    """Add messages and bring the counters and times of their conversations up to date."""
    bump = new.groupBy(*keys).agg(F.count(F.lit(1)).alias("more"), F.max("created_at").alias("latest"))
    updated = (
        conversations.join(bump, list(keys), "left")
        .withColumn("message_count", F.coalesce("message_count", F.lit(0)) + F.coalesce("more", F.lit(0)))
        .withColumn("updated_at", F.greatest("updated_at", "latest"))
        .drop("more", "latest")
    )
    return updated, messages.unionByName(new)


def delete_conversations(conversations: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the given conversations."""
    ids = gone.select("conversation_id").distinct()
    flag = ids.withColumn("__gone", F.lit(True))
    kept = join_lookup(messages, flag, KEY, "left").where("__gone IS NULL").drop("__gone")
    return conversations.join(ids, KEY, "left_anti"), kept
