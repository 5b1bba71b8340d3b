"""EVL1–EVL9 and ANL1–ANL10: feedback, judging and dashboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query
from catalog.inputs import DERIVED, with_
from catalog.questions import RERANKED, _reranked
from graphloom.operators import activity as a
from graphloom.operators import feedback as f

OK = "(rating IS NULL OR rating BETWEEN 1 AND 5) AND (relevancy_score IS NULL OR relevancy_score BETWEEN 1 AND 5) AND (faithfulness_score IS NULL OR faithfulness_score BETWEEN 1 AND 5)"
ISO = "yyyy-MM-dd HH:mm:ss"


@query("evl1_accepted", with_(f"SELECT event_id, rating, relevancy_score FROM fx_feedback WHERE {OK}"))
def accepted(i):
    return f.split_feedback(i.fx_feedback)[0].select("event_id", "rating", "relevancy_score")


@query("evl1_rejected", with_(f"SELECT event_id, rating, relevancy_score FROM fx_feedback WHERE NOT ({OK})"))
def rejected(i):
    return f.split_feedback(i.fx_feedback)[1].select("event_id", "rating", "relevancy_score")


LATEST = """latest AS (SELECT * FROM fx_feedback QUALIFY row_number() OVER (PARTITION BY user_id, conversation_id, message_index ORDER BY created_at DESC, event_id DESC) = 1)"""


@query("evl2_latest", with_(f"WITH {LATEST} SELECT user_id, conversation_id, message_index, rating, relevancy_score, event_id FROM latest"))
def latest(i):
    return f.latest_feedback(i.fx_feedback).select("user_id", "conversation_id", "message_index", "rating", "relevancy_score", "event_id")


@query("evl3_merged", with_("""SELECT user_id, conversation_id, message_index,
    arg_max(rating, (created_at, event_id)) AS rating, arg_max(relevancy_score, (created_at, event_id)) AS relevancy_score,
    arg_max(faithfulness_score, (created_at, event_id)) AS faithfulness_score, arg_max(response_time_ms, (created_at, event_id)) AS response_time_ms,
    bool_or(auto_evaluated) AS auto_evaluated FROM fx_feedback GROUP BY user_id, conversation_id, message_index"""))
def merged(i):
    return f.merge_evaluations(i.fx_feedback)


@query("evl3_upserted", with_("""WITH a AS (SELECT user_id, conversation_id, message_index, arg_max(rating, (created_at, event_id)) AS rating FROM fx_feedback WHERE NOT auto_evaluated GROUP BY ALL),
    b AS (SELECT user_id, conversation_id, message_index, arg_max(relevancy_score, (created_at, event_id)) AS relevancy_score FROM fx_feedback WHERE auto_evaluated GROUP BY ALL)
    SELECT user_id, conversation_id, message_index, rating, relevancy_score, relevancy_score IS NOT NULL AS auto_evaluated FROM a FULL JOIN b USING (user_id, conversation_id, message_index)"""))
def upserted(i):
    """Automatic evaluations written over stored manual ratings."""
    stored = f.merge_evaluations(i.fx_feedback.where("NOT auto_evaluated"))
    new = f.merge_evaluations(i.fx_feedback.where("auto_evaluated"))
    return f.merge_with_existing(stored, new).select("user_id", "conversation_id", "message_index", "rating", "relevancy_score", "auto_evaluated")


STATS = """count(*) AS total, round(coalesce(avg(rating), 0), 2) AS avg_rating, round(coalesce(avg(relevancy_score), 0), 2) AS avg_relevancy,
    round(coalesce(avg(faithfulness_score), 0), 2) AS avg_faithfulness, round(coalesce(avg(response_time_ms), 0), 2) AS avg_response_time,
    count(*) FILTER (WHERE auto_evaluated) AS auto_evaluated"""


@query("evl4_statistics", with_(f"SELECT {STATS} FROM fx_feedback"))
def statistics(i):
    return f.statistics(i.fx_feedback)


@query("evl4_by_user", with_(f"SELECT user_id, {STATS} FROM fx_feedback GROUP BY user_id"))
def by_user(i):
    return f.statistics(i.fx_feedback, ["user_id"])


@query("evl4_histogram", with_("SELECT r AS rating, (SELECT count(*) FROM fx_feedback WHERE rating = r) AS n FROM range(1, 6) t(r)"))
def histogram(i):
    return f.rating_histogram(i.fx_feedback)


@query("evl5_listed", with_("SELECT event_id, user_id, rating FROM fx_feedback ORDER BY created_at DESC, event_id DESC OFFSET 5 LIMIT 40"))
def listed(i):
    return f.list_feedback(i.fx_feedback, skip=5, limit=40).select("event_id", "user_id", "rating")


def _answers(i):
    """User turns answered by the next turn, judged against the conversation's own system text."""
    from graphloom.operators.dialogue import answered_questions

    return answered_questions(i.fx_messages).select(
        "conversation_id", "turn", "question", "answer", F.concat("answer", F.lit("\n"), "question").alias("context"),
        (F.length("answer") / 7.0).alias("response_time_ms"),
    ).where("question IS NOT NULL")


def grade(prompts: list[str]) -> list[str]:
    """Stand-in judge: a score from the length of the prompt, now and then malformed."""
    forms = ['{{"score": {s}, "reason": "fine"}}', 'Sure:\n```json\n{{"score": {s}, "reason": ""}}\n```', '{{"score": "{s}"}}', "no idea {s}"]
    return [forms[len(p) % 4].format(s=len(p) % 7) for p in prompts]


JUDGED = """
    a AS (SELECT conversation_id, turn, role, content AS answer,
        last_value(CASE WHEN role = 'user' THEN content END IGNORE NULLS) OVER (PARTITION BY conversation_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS question
        FROM fx_messages),
    asked AS (SELECT conversation_id, turn, question, answer, concat(answer, chr(10), question) AS context FROM a WHERE role = 'assistant' AND question IS NOT NULL),
    form AS (SELECT concat(chr(10), chr(10), 'Reply with JSON only: {"score": <1-5>, "reason": "<one sentence>"}') AS form),
    prompts AS (SELECT conversation_id, turn, answer,
        concat('Grade from 1 (off topic) to 5 (direct, complete and correct) how well the answer fits the question.', chr(10), chr(10), 'Question: ', question,
               chr(10), chr(10), 'Answer: ', answer, form) AS relevancy_prompt,
        concat('Grade from 1 (contradicts the sources) to 5 (everything is in the sources) how faithful the answer is.', chr(10), chr(10), 'Sources:', chr(10),
               CASE WHEN length(context) > 2000 THEN concat(left(context, 2000), '...') ELSE context END, chr(10), chr(10), 'Answer:', chr(10), answer, form) AS faithfulness_prompt
        FROM asked, form)"""


def graded(prompt: str) -> str:
    """Score that ``parse_judgement`` takes from the stand-in judge's reply to a prompt."""
    return f"CAST(CASE WHEN length({prompt}) % 4 < 2 AND length({prompt}) % 7 BETWEEN 1 AND 5 THEN length({prompt}) % 7 ELSE 3 END AS INTEGER)"


@query("evl6_prompts", with_(f"WITH {JUDGED} SELECT conversation_id, turn, relevancy_prompt, faithfulness_prompt FROM prompts"))
def judge_prompts(i):
    return f.judge_prompts(_answers(i)).select("conversation_id", "turn", "relevancy_prompt", "faithfulness_prompt")


# Judge replies of many shapes, one per part.
DERIVED["fx_replies"] = """
    SELECT p_partkey AS id, p_size % 7 AS given, p_type, CASE
        WHEN p_type = 'ECONOMY' THEN concat('{"score": ', p_size % 7, ', "reason": "', p_name, '"}')
        WHEN p_type = 'SMALL' THEN concat('Here it is:', chr(10), '```json', chr(10), '{"score": ', p_size % 7, ', "reason": "', p_name, '"}', chr(10), '```')
        WHEN p_type = 'LARGE' THEN concat('{"score": "', p_size % 7, '", "reason": ""}')
        WHEN p_type = 'PROMO' THEN concat('{"score": ', p_size % 7, '.0, "reason": "', p_name, '"}')
        ELSE concat('I would say ', p_size % 7) END AS reply FROM part"""


@query("evl7_parsed", with_(f"""SELECT id, CAST(CASE WHEN p_type IN ('ECONOMY', 'SMALL') AND given BETWEEN 1 AND 5 THEN given ELSE 3 END AS INTEGER) AS score,
    CASE WHEN p_type IN ('ECONOMY', 'SMALL', 'PROMO') THEN json_extract_string(regexp_extract(reply, '\\{{[^}}]*\\}}'), '$.reason') ELSE '{f.NO_REASON}' END AS reason FROM fx_replies"""))
def parsed(i):
    score, reason = f.parse_judgement(F.col("reply"))
    return i.fx_replies.select("id", score.alias("score"), reason.alias("reason"))


@query("evl8_evaluated", with_(f"""WITH {JUDGED} SELECT conversation_id, turn, {graded('relevancy_prompt')} AS relevancy_score,
    {graded('faithfulness_prompt')} AS faithfulness_score, round(length(answer) / 7.0::DOUBLE, 2) AS response_time_ms, true AS auto_evaluated FROM prompts"""))
def evaluated(i):
    return f.evaluate(_answers(i), grade).select("conversation_id", "turn", "relevancy_score", "faithfulness_score", "response_time_ms", "auto_evaluated")


@query("evl9_judge_context", with_(f"""WITH {RERANKED} SELECT qid, string_agg(concat('[', filename, ']: ', content), chr(10) || chr(10) ORDER BY rank) AS context
    FROM rk WHERE rank <= 3 GROUP BY qid"""))
def judge_context(i):
    return f.judge_context(_reranked(i))


START, END, DAYS = "2024-01-08 00:00:00", "2024-01-28 00:00:00", 20
ACTIVITY = f"""
    c AS (SELECT user_id, count(*) AS conversations FROM fx_conversations WHERE created_at >= TIMESTAMP '{START}' GROUP BY ALL),
    m AS (SELECT user_id, count(*) AS messages FROM fx_conversations JOIN fx_user_messages v USING (conversation_id) WHERE v.created_at >= TIMESTAMP '{START}' GROUP BY ALL),
    l AS (SELECT user_id, count(*) AS logins, max(created_at) AS last_login FROM fx_login_logs WHERE created_at BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}' GROUP BY ALL),
    act AS (SELECT user_id, username, role, coalesce(conversations, 0) AS conversations, coalesce(messages, 0) AS messages, coalesce(logins, 0) AS logins, last_login
            FROM fx_users LEFT JOIN c USING (user_id) LEFT JOIN m USING (user_id) LEFT JOIN l USING (user_id))"""


def _activity(i):
    return a.user_activity(i.fx_users, i.fx_login_logs, i.fx_conversations, i.fx_user_messages, START, END)


@query("anl1_activity", with_(f"WITH {ACTIVITY} SELECT * REPLACE (strftime(last_login, '%Y-%m-%d %H:%M:%S') AS last_login) FROM act"))
def activity(i):
    return _activity(i).withColumn("last_login", F.date_format("last_login", ISO))


@query("anl2_daily_logins", with_(f"""SELECT strftime(d, '%Y-%m-%d') AS day, (SELECT count(*) FROM fx_login_logs WHERE CAST(created_at AS DATE) = CAST(d AS DATE)) AS n
    FROM range(TIMESTAMP '2023-12-28', TIMESTAMP '2024-02-06', INTERVAL 1 DAY) t(d)"""))
def daily(i):
    return a.daily_logins(i.fx_login_logs, "2023-12-28", 39)


@query("anl3_totals", with_(f"""WITH {ACTIVITY} SELECT count(*) AS users,
    (SELECT count(*) FROM fx_login_logs WHERE created_at BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}') AS logins, CAST(sum(conversations) AS BIGINT) AS conversations,
    CAST(sum(messages) AS BIGINT) AS messages FROM act"""))
def totals(i):
    return a.totals(_activity(i), i.fx_login_logs, START, END)


@query("anl4_table", with_(f"""WITH {ACTIVITY} SELECT username, role, logins, coalesce(strftime(last_login, '%Y-%m-%d %H:%M'), 'Never') AS last_login,
    conversations AS chats, messages FROM act"""))
def table(i):
    return a.activity_table(_activity(i))


@query("anl5_recent_logins", with_("""SELECT username, role, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS at FROM fx_login_logs JOIN fx_users USING (user_id)
    ORDER BY created_at DESC, event_id DESC LIMIT 25""").replace(" AS at ", ' AS "at" '))
def recent_logins(i):
    return a.recent_logins(i.fx_login_logs, i.fx_users, limit=25)


@query("anl5_logins_of_period", with_(f"""SELECT username, role, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS at FROM fx_login_logs JOIN fx_users USING (user_id)
    WHERE created_at BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}' ORDER BY created_at DESC, event_id DESC LIMIT 25""").replace(" AS at ", ' AS "at" '))
def logins_of_period(i):
    return a.recent_logins(i.fx_login_logs, i.fx_users, limit=25, start=START, end=END)


@query("anl5_logins_of_user", with_("""SELECT username, role, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS at FROM fx_login_logs JOIN fx_users USING (user_id)
    WHERE username = 'user_7' ORDER BY created_at DESC, event_id DESC LIMIT 10""").replace(" AS at ", ' AS "at" '))
def logins_of_user(i):
    return a.recent_logins(i.fx_login_logs, i.fx_users, "user_7", 10)


@query("anl6_satisfaction", with_("SELECT count(*) AS total, round(avg(rating), 6) AS mean_rating, round(avg(rating) / 5 * 100, 6) AS satisfaction FROM fx_feedback"))
def satisfaction(i):
    return f.satisfaction(i.fx_feedback).withColumns({c: F.round(c, 6) for c in ("mean_rating", "satisfaction")})


@query("anl7_recent_feedback", with_("""WITH ten AS (SELECT * FROM fx_feedback QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, event_id DESC) <= 10),
    top AS (SELECT * FROM ten ORDER BY created_at DESC, event_id DESC LIMIT 50)
    SELECT event_id, rating, username FROM top JOIN fx_users USING (user_id) WHERE rating IS NOT NULL"""))
def recent_feedback(i):
    return f.recent_feedback(i.fx_feedback, i.fx_users, 10, 50).select("event_id", "rating", "username")


@query("anl8_storage", with_("""SELECT 'documents' AS item, count(*) AS n FROM documents UNION ALL SELECT 'entities', count(*) FROM fx_entities
    UNION ALL SELECT 'relationships', count(*) FROM fx_relationships UNION ALL SELECT 'embeddings', count(*) FROM fx_vectors"""))
def storage(i):
    return a.storage_counts({"documents": i.documents, "entities": i.fx_entities, "relationships": i.fx_relationships, "embeddings": i.fx_vectors})


# One document per order; its lines stand for chunks, entities and so on by return flag.
DERIVED["fx_documents"] = """
    SELECT o_orderkey AS doc_id, concat('order_', o_orderkey, '.txt') AS filename, o_orderdate AS uploaded_at FROM orders"""
PARTS = {"chunks": "true", "entities": "l_returnflag = 'A'", "relationships": "l_returnflag = 'N'", "graph_nodes": "l_linestatus = 'O'",
         "graph_edges": "l_linestatus = 'F'", "embeddings": "l_quantity > 40"}
DOC_STATS = "d AS (SELECT doc_id, filename, strftime(uploaded_at, '%Y-%m-%d %H:%M') AS uploaded_at, " + ", ".join(
    f"count(*) FILTER (WHERE l_orderkey IS NOT NULL AND {w}) AS {n}" for n, w in PARTS.items()
) + " FROM fx_documents LEFT JOIN lineitem ON l_orderkey = doc_id GROUP BY ALL)"


def _document_stats(i):
    parts = {n: i.lineitem.where(w).select(F.col("l_orderkey").alias("doc_id")) for n, w in PARTS.items()}
    return a.document_statistics(i.fx_documents, parts)


@query("anl9_documents", with_(f"""WITH {DOC_STATS} SELECT *, CASE WHEN chunks > 0 AND embeddings > 0 THEN 'completed' ELSE 'failed' END AS status
    FROM d """))
def documents(i):
    return a.document_list(_document_stats(i))


@query("anl10_document_stats", with_(f"""WITH {DOC_STATS} SELECT * EXCLUDE (filename, uploaded_at), CASE WHEN chunks > 0 AND embeddings > 0 THEN 'completed' ELSE 'failed' END AS status FROM d"""))
def document_stats(i):
    return _document_stats(i).drop("filename", "uploaded_at")
