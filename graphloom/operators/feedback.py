"""Feedback and answer evaluation: validation, upserts, judging, statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import fixed
from graphloom.functions.text import clip, strip
from graphloom.operators.inference import Model, run_model

KEY = ["user_id", "conversation_id", "message_index"]
SCORES = ["rating", "relevancy_score", "faithfulness_score"]
TEXTS = ["feedback_text", "relevancy_reason", "faithfulness_reason"]
#: Columns that tell which of two rows is the later one; those that a table lacks are left out.
ORDER = ("created_at", "event_id")
NO_REASON = "No reason given"


def valid_scores() -> Column:
    """Every score is missing or within 1–5."""
    ok = F.lit(True)
    for c in SCORES:
        ok = ok & (F.col(c).isNull() | F.col(c).between(1, 5))
    return ok


def split_feedback(feedback: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected)."""
    return feedback.where(valid_scores()), feedback.where(~valid_scores())


def _moment(feedback: DataFrame, order: Sequence[str]) -> Column:
    """When a row was written, with every column of ``order`` that the table has."""
    return F.struct(*[c for c in order if c in feedback.columns])


def _newest(feedback: DataFrame, order: Sequence[str]) -> list[Column]:
    """Newest first; rows of one moment in the order of their keys."""
    return [*[F.desc(c) for c in order if c in feedback.columns], *[F.asc(c) for c in KEY if c in feedback.columns]]


def latest_feedback(feedback: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """Last write per user, conversation and message; ``order`` tells which is last."""
    values = [c for c in feedback.columns if c not in KEY]
    last = F.max_by(F.struct(*values), F.struct(_moment(feedback, order), *values))
    return feedback.groupBy(*KEY).agg(last.alias("last")).select(*KEY, "last.*")


def _given(feedback: DataFrame) -> list[str]:
    return [c for c in (*SCORES, "response_time_ms", *TEXTS) if c in feedback.columns]


def merge_evaluations(feedback: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """Manual and automatic evaluation of one message together: the last value given for each score, time, text and reason."""
    at = _moment(feedback, order)
    return feedback.groupBy(*KEY).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(at, c))).alias(c) for c in _given(feedback)],
        F.max("auto_evaluated").alias("auto_evaluated"),
    )


def merge_with_existing(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert evaluations into stored ones; a field missing in the new row keeps its stored value.

    A message that was evaluated automatically once stays marked so.
    """
    a, b = existing.alias("a"), new.alias("b")

    def either(c: str) -> Column:
        sides = [F.col(f"{t}.{c}") for t, df in (("b", new), ("a", existing)) if c in df.columns]
        return F.coalesce(*sides).alias(c)

    fields = [c for c in (*SCORES, "response_time_ms", *TEXTS) if c in {*existing.columns, *new.columns}]
    marked = F.coalesce("a.auto_evaluated", F.lit(False)) | F.coalesce("b.auto_evaluated", F.lit(False))
    return a.join(b, KEY, "full").select(*KEY, *[either(c) for c in fields], marked.alias("auto_evaluated"))


def statistics(feedback: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Count, averages (0 when nothing was rated), automatic evaluations; one row, or one per group."""
    average = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 2)
    return feedback.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total"),
        average("rating").alias("avg_rating"),
        average("relevancy_score").alias("avg_relevancy"),
        average("faithfulness_score").alias("avg_faithfulness"),
        average("response_time_ms").alias("avg_response_time"),
        F.count(F.when(F.col("auto_evaluated"), 1)).alias("auto_evaluated"),
    )


def rating_histogram(feedback: DataFrame) -> DataFrame:
    """Ratings 1–5 with their counts, zeros included."""
    n = feedback.where("rating IS NOT NULL").groupBy(F.col("rating").cast("long").alias("rating")).agg(F.count(F.lit(1)).alias("n"))
    scale = feedback.sparkSession.range(1, 6).select(F.col("id").alias("rating"))
    return scale.join(n, "rating", "left").select("rating", F.coalesce("n", F.lit(0)).alias("n"))


def list_feedback(feedback: DataFrame, user_id=None, skip: int = 0, limit: int = 50, order: Sequence[str] = ORDER) -> DataFrame:
    """Newest first."""
    rows = feedback if user_id is None else feedback.where(F.col("user_id") == user_id)
    return rows.orderBy(*_newest(feedback, order)).offset(skip).limit(limit)


def satisfaction(feedback: DataFrame) -> DataFrame:
    """Ratings over all users: total feedback, mean rating and satisfaction in percent, one row."""
    mean = F.coalesce(F.avg("rating"), F.lit(0.0))
    return feedback.agg(F.count(F.lit(1)).alias("total"), mean.alias("mean_rating"), (mean / 5 * 100).alias("satisfaction"))


def recent_feedback(
    feedback: DataFrame, users: DataFrame, per_user: int = 10, limit: int = 20, order: Sequence[str] = ORDER
) -> DataFrame:
    """The newest ``per_user`` of each user, of those the newest ``limit``, of those the rated ones."""
    newest = _newest(feedback, order)
    mine = F.row_number().over(Window.partitionBy("user_id").orderBy(*newest))
    shown = feedback.withColumn("place", mine).where(F.col("place") <= per_user).drop("place").orderBy(*newest).limit(limit)
    named = shown.where("rating IS NOT NULL").join(users.select("user_id", "username"), "user_id", "left")
    return named.withColumn("username", F.coalesce("username", F.lit("Unknown")))


# ---------------------------------------------------------------- judging


def judge_context(chunks: DataFrame) -> DataFrame:
    """(qid, context): the first three retrieved chunks as ``[file]: content``."""
    text = F.concat(F.lit("["), "filename", F.lit("]: "), "content")
    return chunks.where(F.col("rank") <= 3).groupBy("qid").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("rank", text.alias("text"))))["text"], "\n\n").alias("context")
    )


def judge_prompts(answers: DataFrame, context_chars: int = 2000) -> DataFrame:
    """Prompts for relevancy (question, answer) and faithfulness (answer, context)."""
    form = F.lit('\n\nReply with JSON only: {"score": <1-5>, "reason": "<one sentence>"}')
    relevancy = F.concat(
        F.lit("Grade from 1 (off topic) to 5 (direct, complete and correct) how well the answer fits the question.\n\nQuestion: "),
        "question", F.lit("\n\nAnswer: "), "answer", form,
    )
    faithfulness = F.concat(
        F.lit("Grade from 1 (contradicts the sources) to 5 (everything is in the sources) how faithful the answer is.\n\nSources:\n"),
        clip(F.coalesce("context", F.lit("")), context_chars), F.lit("\n\nAnswer:\n"), "answer", form,
    )
    return answers.withColumns({"relevancy_prompt": relevancy, "faithfulness_prompt": faithfulness})


def parse_judgement(reply: Column) -> tuple[Column, Column]:
    """(score, reason) from a judge's reply; a score that is no whole number from 1 to 5 counts as 3."""
    fenced = F.regexp_extract(reply, fixed.FENCED_JSON, 1)
    body = F.when(fenced != "", fenced).otherwise(reply)
    value = F.try_parse_json(F.regexp_extract(body, fixed.FIRST_OBJECT, 0))
    score = F.when(
        F.schema_of_variant(F.try_variant_get(value, "$.score", "variant")) == "BIGINT",
        F.try_variant_get(value, "$.score", "int"),
    )
    reason = F.try_variant_get(value, "$.reason", "string")
    return (
        F.when(score.between(1, 5), score).otherwise(F.lit(3)),
        F.when(F.coalesce(strip(reason), F.lit("")) != "", reason).otherwise(F.lit(NO_REASON)),
    )


def evaluate(answers: DataFrame, model: Model, **options) -> DataFrame:
    """Judge every answer (question, answer, context, response_time_ms) for relevancy and faithfulness."""
    rows = judge_prompts(answers)
    for name in ("relevancy", "faithfulness"):
        rows = run_model(rows, model, f"{name}_prompt", f"{name}_reply", **options)
        score, reason = parse_judgement(F.col(f"{name}_reply"))
        rows = rows.withColumns({f"{name}_score": score, f"{name}_reason": reason}).drop(f"{name}_prompt", f"{name}_reply")
    return rows.withColumns(
        {"response_time_ms": F.round("response_time_ms", 2), "auto_evaluated": F.lit(True)}
    )
