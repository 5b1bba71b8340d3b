"""CNV1–CNV10 and GRF9: conversations and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query
from catalog.inputs import with_
from graphloom.operators import dialogue as d

ISO = "yyyy-MM-dd HH:mm:ss"


@query("cnv1_conversations", with_("""SELECT user_id, conversation_id, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at
    FROM fx_conversations ORDER BY fx_conversations.updated_at DESC, conversation_id OFFSET 10 LIMIT 25"""))
def conversations(i):
    return d.list_conversations(i.fx_conversations, skip=10, limit=25).select("user_id", "conversation_id", F.date_format("updated_at", ISO).alias("updated_at"))


@query("cnv2_messages", with_("SELECT * FROM fx_messages WHERE conversation_id = 3 ORDER BY turn OFFSET 1 LIMIT 4"))
def messages(i):
    return d.list_messages(i.fx_messages, 3, 1, 4)


@query("cnv2_recent", with_("SELECT * FROM fx_messages QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY turn DESC) <= 3"))
def recent(i):
    return d.recent_messages(i.fx_messages, 3)


HISTORY = "OVER (PARTITION BY conversation_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)"


@query("cnv3_history", with_(f"""WITH h AS (SELECT conversation_id, turn, list(concat(role, '|', content)) {HISTORY} AS h FROM fx_messages)
    SELECT conversation_id, turn, coalesce(array_to_string(h, chr(10)), '') AS history FROM h"""))
def history(i):
    return d.history(i.fx_messages, 2).select(
        "conversation_id", "turn", F.array_join(F.transform("history", lambda m: F.concat(m["role"], F.lit("|"), m["content"])), "\n").alias("history")
    )


def said(chars: int) -> str:
    return f"concat(CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END, CASE WHEN length(content) > {chars} THEN concat(left(content, {chars}), '...') ELSE content END)"


@query("cnv4_history_text", with_(f"""SELECT conversation_id, turn, role, content, coalesce(array_to_string(list({said(200)}) {HISTORY}, chr(10)), '') AS history_text FROM fx_messages"""))
def history_text(i):
    return d.history_text(i.fx_messages, 2)


@query("cnv4_prompt_history", with_(f"""WITH h AS (SELECT conversation_id, turn, array_to_string(list({said(150)}) {HISTORY}, chr(10)) AS h FROM fx_messages)
    SELECT conversation_id, turn, CASE WHEN h IS NULL THEN '' ELSE concat('Previous conversation:', chr(10), h) END AS history_text FROM h"""))
def prompt_history(i):
    return d.history_text(i.fx_messages, 2, 150, "Previous conversation:").select("conversation_id", "turn", "history_text")


@query("cnv5_rewrite_candidates", with_(r"""WITH h AS (SELECT *, count(*) OVER (PARTITION BY conversation_id ORDER BY turn ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS n FROM fx_messages)
    SELECT conversation_id, turn, content FROM h WHERE role = 'user' AND n > 0 AND len(regexp_extract_all(content, '\S+')) <= 10"""))
def rewrite_candidates(i):
    return d.rewrite_candidates(i.fx_messages).select("conversation_id", "turn", "content")


def echo(prompts: list[str]) -> list[str]:
    """Stand-in model: the last line that holds text, in quotes."""
    return ['"' + [line for line in p.split("\n") if line.strip()][-2] + '"' for p in prompts]


# The stand-in model answers with the last line that holds text before the prompt's own last line.
BARE = """regexp_replace(regexp_replace({line}, '^\\s+|\\s+$', '', 'g'), '^["'']+|["'']+$', '', 'g')"""
LAST_LINE = "list_last(list_filter(string_split({text}, chr(10)), lambda l: regexp_matches(l, '\\S')))"


@query("cnv5_rewritten", with_(rf"""WITH h AS (SELECT *, count(*) OVER (PARTITION BY conversation_id ORDER BY turn ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS n FROM fx_messages),
    q AS (SELECT conversation_id, turn, content, n > 0 AND len(regexp_extract_all(content, '\S+')) <= 10 AS needed,
                 {BARE.format(line=LAST_LINE.format(text="concat('Question: ', content)"))} AS bare FROM h WHERE role = 'user')
    SELECT conversation_id, turn, CASE WHEN needed AND bare <> '' THEN bare ELSE content END AS question FROM q"""))
def rewritten(i):
    return d.rewrite_questions(i.fx_messages, echo).select("conversation_id", "turn", "question")


@query("cnv6_summaries", with_("""SELECT conversation_id, count(*) AS n_messages, count(*) // 2 AS turns,
    arg_max(content, turn) FILTER (WHERE role = 'user') AS last_user, arg_max(content, turn) FILTER (WHERE role = 'assistant') AS last_assistant
    FROM fx_messages GROUP BY conversation_id"""))
def summaries(i):
    return d.summaries(i.fx_messages)


@query("cnv7_title_contexts", with_("""WITH f AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY turn) AS p FROM fx_messages QUALIFY p <= 4)
    SELECT conversation_id, string_agg(concat(upper(left(role, 1)), substr(role, 2), ': ', left(content, 100)), chr(10) ORDER BY p) AS context FROM f GROUP BY conversation_id"""))
def title_contexts(i):
    return d.title_contexts(i.fx_messages)


@query("cnv7_titles", with_(rf"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY turn) AS p FROM fx_messages QUALIFY p <= 4),
    c AS (SELECT conversation_id, string_agg(concat(upper(left(role, 1)), substr(role, 2), ': ', left(content, 100)), chr(10) ORDER BY p) AS context FROM f GROUP BY conversation_id),
    b AS (SELECT conversation_id, {BARE.format(line=BARE.format(line=LAST_LINE.format(text="context")))} AS bare FROM c)
    SELECT conversation_id, CASE WHEN bare <> '' AND length(bare) <= 100 THEN bare END AS title FROM b"""))
def titles(i):
    return d.titles(i.fx_messages, echo)


@query("cnv8_user_statistics", with_("""WITH n AS (SELECT conversation_id, count(*) AS n FROM fx_user_messages GROUP BY ALL)
    SELECT user_id, count(*) AS conversations, CAST(coalesce(sum(n), 0) AS BIGINT) AS messages, arg_max(conversation_id, (updated_at, conversation_id)) AS recent_conversation
    FROM fx_conversations LEFT JOIN n USING (conversation_id) GROUP BY user_id"""))
def user_statistics(i):
    return d.user_statistics(i.fx_conversations, i.fx_user_messages)


@query("cnv9_answered", with_("""WITH a AS (SELECT conversation_id, turn, role, content AS answer,
        last_value(CASE WHEN role = 'user' THEN content END IGNORE NULLS) OVER (PARTITION BY conversation_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS question
    FROM fx_messages) SELECT conversation_id, turn, question, answer FROM a WHERE role = 'assistant'"""))
def answered(i):
    return d.answered_questions(i.fx_messages).select("conversation_id", "turn", "question", "answer")


@query("cnv10_prompts", with_(f"""WITH h AS (SELECT conversation_id, turn, role, content, array_to_string(list(concat(CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END, content)) {HISTORY}, chr(10) || chr(10)) AS h FROM fx_messages),
    s AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS context FROM conversations WHERE role = 'system' GROUP BY conv_id)
    SELECT conversation_id, turn, concat(CASE WHEN h IS NULL THEN '' ELSE concat(h, chr(10), chr(10), 'User: ') END, chr(10), coalesce(context, ''), chr(10), chr(10), 'Question: ', content, chr(10)) AS prompt
    FROM h LEFT JOIN s ON conv_id = conversation_id WHERE role = 'user'"""))
def prompts(i):
    """The system message of a conversation stands in for the retrieved context."""
    system = i.conversations.where("role = 'system'").groupBy(F.col("conv_id").alias("conversation_id")).agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("turn", "text")))["text"], "\n").alias("context")
    )
    contexts = i.fx_messages.select("conversation_id", "turn").join(system, "conversation_id")
    return d.answer_prompts(i.fx_messages, contexts, 2)


@query("src10_append_messages", with_("""WITH n AS (SELECT conversation_id, count(*) AS more, max(created_at) AS latest FROM fx_user_messages GROUP BY ALL)
    SELECT conversation_id, coalesce(more, 0) AS message_count, strftime(greatest(updated_at, latest), '%Y-%m-%d %H:%M:%S') AS updated_at
    FROM fx_conversations LEFT JOIN n USING (conversation_id)"""))
def append_messages(i):
    stored = i.fx_conversations.withColumn("message_count", F.lit(0).cast("long"))
    updated, _ = d.append_messages(stored, i.fx_user_messages.where("false"), i.fx_user_messages)
    return updated.select("conversation_id", "message_count", F.date_format("updated_at", ISO).alias("updated_at"))


@query("grf9_delete_conversations", with_("""SELECT conversation_id, count(*) AS n FROM fx_messages
    WHERE conversation_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system') GROUP BY ALL"""))
def delete_conversations(i):
    """Conversations with a system message are deleted."""
    gone = i.conversations.where("role = 'system'").select(F.col("conv_id").alias("conversation_id"))
    stored = i.fx_messages.select("conversation_id").distinct()
    kept, left = d.delete_conversations(stored, i.fx_messages, gone)
    return kept.join(left.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n")), "conversation_id")
