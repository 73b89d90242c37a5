"""Registered cascade queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wellspring.operators import cascade as C
from wellspring.operators.journal import journal_merge
from wellspring.operators.settings import settings_merge
from wellspring.operators.tokens import token_ledger
from wellspring.plans.registry import register

# The requests of each user applied one by one to the list of session names and to every label named.
RENAME_SQL = """
todo AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS k FROM rename_requests),
labels AS (SELECT user_id, list(DISTINCT l) AS orig FROM (
  SELECT user_id, old_name AS l FROM rename_requests UNION ALL SELECT user_id, new_name FROM rename_requests) GROUP BY user_id),
steps AS (
 SELECT l.user_id, CAST(0 AS BIGINT) AS k, coalesce((SELECT list(session_name) FROM sessions s WHERE s.user_id = l.user_id), []) AS names,
  orig, orig AS cur, CAST(NULL AS BIGINT) AS bad FROM labels l
 UNION ALL
 SELECT s.user_id, t.k,
  CASE WHEN reject THEN names ELSE list_transform(names, lambda x: CASE WHEN x = t.old_name THEN t.new_name ELSE x END) END,
  orig, CASE WHEN reject THEN cur ELSE list_transform(cur, lambda x: CASE WHEN x = t.old_name THEN t.new_name ELSE x END) END,
  CASE WHEN reject THEN t.seq END
 FROM (SELECT s.*, t.seq, t.old_name, t.new_name, t.old_name <> t.new_name AND list_contains(names, t.old_name) AND list_contains(names, t.new_name) AS reject
       FROM steps s JOIN todo t ON t.user_id = s.user_id AND t.k = s.k + 1) s JOIN todo t ON t.user_id = s.user_id AND t.seq = s.seq),
judged AS (SELECT t.seq, t.user_id, t.old_name, t.new_name, 'name_exists' AS reason FROM steps s JOIN todo t ON t.user_id = s.user_id AND t.seq = s.bad),
ok AS (SELECT user_id, old_name, new_name FROM (
  SELECT user_id, unnest(orig) AS old_name, unnest(cur) AS new_name FROM steps s
  WHERE k = (SELECT max(k) FROM steps z WHERE z.user_id = s.user_id)) WHERE old_name <> new_name)"""


def _rename(fx):
    return C.rename_cascade(fx.sessions, fx.messages, fx.summaries, fx.rename_requests)


@register("rename_cascade", "H6", ["sessions", "messages", "summaries", "rename_requests"], """
SELECT m.id, m.user_id, coalesce(ok.new_name, m.session) AS session, m.role, m.timestamp, m.archive
FROM messages m LEFT JOIN ok ON ok.user_id = m.user_id AND ok.old_name = m.session
""", ctes=RENAME_SQL, recursive=True)
def _rename_cascade(fx):
    return _rename(fx)["messages"].select("id", "user_id", "session", "role", "timestamp", "archive")


@register("rename_cascade_sessions", "H6", ["sessions", "rename_requests"], """
SELECT s.user_id, coalesce(ok.new_name, s.session_name) AS session_name, s.persona, s.start_date, s.current
FROM sessions s LEFT JOIN ok ON ok.user_id = s.user_id AND ok.old_name = s.session_name
""", ctes=RENAME_SQL, recursive=True)
def _rename_cascade_sessions(fx):
    return C.rename_cascade(fx.sessions, fx.messages, fx.summaries, fx.rename_requests)["sessions"]


@register("rename_cascade_summaries", "H6", ["sessions", "summaries", "rename_requests"], """
SELECT s.user_id, coalesce(ok.new_name, s.session) AS session, s.summary, s.last_message_id
FROM summaries s LEFT JOIN ok ON ok.user_id = s.user_id AND ok.old_name = s.session
""", ctes=RENAME_SQL, recursive=True)
def _rename_cascade_summaries(fx):
    return C.rename_cascade(fx.sessions, fx.messages, fx.summaries, fx.rename_requests)["summaries"]


@register("rename_rejects", "H6", ["sessions", "rename_requests"],
          "SELECT seq, user_id, old_name, new_name, reason FROM judged", ctes=RENAME_SQL, recursive=True)
def _rename_rejects(fx):
    return C.rename_cascade(fx.sessions, fx.messages, fx.summaries, fx.rename_requests)["rejects"]


def _persona(fx):
    return C.persona_merge(fx.sessions, fx.persona_requests, fx.sessions.select("persona"))


@register("persona_merge", "H7/Q2", ["sessions", "persona_requests"], """
SELECT s.user_id, s.session_name, coalesce(p.persona, s.persona) AS persona, s.start_date, s.current
FROM sessions s LEFT JOIN (
 SELECT user_id, session_name, arg_max(persona, seq) AS persona FROM persona_requests
 WHERE persona IN (SELECT persona FROM sessions) GROUP BY user_id, session_name) p
ON p.user_id = s.user_id AND p.session_name = s.session_name
""")
def _persona_merge(fx):
    return _persona(fx)["sessions"]


@register("persona_rejects", "H7/Q2", ["sessions", "persona_requests"], """
SELECT * FROM persona_requests WHERE persona NOT IN (SELECT persona FROM sessions)
""")
def _persona_rejects(fx):
    return _persona(fx)["rejects"]


@register("archive_open", "H8/T16", ["messages", "archive_requests"], """
SELECT m.id, m.user_id, m.message, m.role, m.timestamp,
 CASE WHEN f.user_id IS NOT NULL AND NOT m.archive THEN true ELSE m.archive END AS archive,
 CASE WHEN f.user_id IS NOT NULL AND NOT m.archive THEN coalesce(f.new_name, m.session) ELSE m.session END AS session
FROM messages m LEFT JOIN (
 SELECT user_id, arg_min(struct_pack(n := new_name), seq).n AS new_name FROM archive_requests GROUP BY user_id) f
ON f.user_id = m.user_id
""")
def _archive_open(fx):
    return C.archive_open(fx.messages, fx.archive_requests)


@register("delete_open", "H9/T17", ["messages", "archive_requests"], """
SELECT m.* FROM messages m
WHERE m.archive OR m.user_id NOT IN (SELECT user_id FROM archive_requests)
""")
def _delete_open(fx):
    return C.delete_open(fx.messages, fx.archive_requests)


@register("delete_session_cascade", "H10", ["messages", "session_deletes"], """
SELECT m.id, m.user_id, m.session FROM messages m
WHERE NOT EXISTS (SELECT 1 FROM session_deletes d WHERE d.user_id = m.user_id AND d.session_name = m.session)
""")
def _delete_session_cascade(fx):
    out = C.delete_session_cascade(fx.sessions, fx.messages, fx.summaries, fx.session_deletes)
    return out["messages"].select("id", "user_id", "session")


@register("delete_session_sessions", "H10", ["sessions", "session_deletes"], """
SELECT s.* FROM sessions s
WHERE NOT EXISTS (SELECT 1 FROM session_deletes d WHERE d.user_id = s.user_id AND d.session_name = s.session_name)
""")
def _delete_session_sessions(fx):
    return C.delete_session_cascade(fx.sessions, fx.messages, fx.summaries, fx.session_deletes)["sessions"]


@register("clear_history", "H11/T19", ["messages", "summaries", "erase_requests"], """
SELECT 'messages' AS table_name, count(*) AS rows_left FROM messages WHERE user_id NOT IN (SELECT user_id FROM erase_requests)
UNION ALL
SELECT 'summaries', count(*) FROM summaries WHERE user_id NOT IN (SELECT user_id FROM erase_requests)
""")
def _clear_history(fx):
    out = C.clear_history(fx.messages, fx.summaries, fx.erase_requests)
    return (out["messages"].agg(F.count("*").alias("rows_left")).select(F.lit("messages").alias("table_name"), "rows_left")
            .unionByName(out["summaries"].agg(F.count("*").alias("rows_left"))
                         .select(F.lit("summaries").alias("table_name"), "rows_left")))


@register("erase_users", "H12/T18", ["users", "messages", "summaries", "sessions", "settings_log", "journal_log",
                                     "token_log", "subscription_log", "erase_requests"], """
SELECT t AS "table", before AS rows_before, after AS rows_after, before - after AS removed FROM (
 SELECT 'users' AS t, (SELECT count(*) FROM users) AS before, (SELECT count(*) FROM users WHERE id NOT IN (SELECT user_id FROM erase_requests)) AS after
 UNION ALL SELECT 'conversations', (SELECT count(*) FROM messages), (SELECT count(*) FROM messages WHERE user_id NOT IN (SELECT user_id FROM erase_requests))
 UNION ALL SELECT 'summaries', (SELECT count(*) FROM summaries), (SELECT count(*) FROM summaries WHERE user_id NOT IN (SELECT user_id FROM erase_requests))
 UNION ALL SELECT 'sessions', (SELECT count(*) FROM sessions), (SELECT count(*) FROM sessions WHERE user_id NOT IN (SELECT user_id FROM erase_requests))
 UNION ALL SELECT 'user_settings', (SELECT count(*) FROM st), (SELECT count(*) FROM st WHERE user_id NOT IN (SELECT user_id FROM erase_requests))
 UNION ALL SELECT 'journals', (SELECT count(*) FROM jn), (SELECT count(*) FROM jn WHERE user_id NOT IN (SELECT user_id FROM erase_requests))
 UNION ALL SELECT 'token_usage', (SELECT count(*) FROM tu), (SELECT count(*) FROM tu WHERE user_id NOT IN (SELECT user_id FROM erase_requests))
 UNION ALL SELECT 'subscriptions', (SELECT count(*) FROM subscription_log), (SELECT count(*) FROM subscription_log WHERE user_id NOT IN (SELECT user_id FROM erase_requests))
) x
""", ctes="""
st AS (SELECT DISTINCT user_id, setting_key FROM settings_log),
jn AS (SELECT DISTINCT user_id, entry_date FROM journal_log),
tu AS (SELECT DISTINCT user_id, strftime(ts, '%m%y') AS m FROM token_log)""")
def _erase_users(fx):
    tables = {
        "users": fx.users, "conversations": fx.messages, "summaries": fx.summaries, "sessions": fx.sessions,
        "user_settings": settings_merge(fx.settings_log), "journals": journal_merge(None, fx.journal_log),
        "token_usage": token_ledger(fx.token_log),
        "subscriptions": fx.subscription_log.withColumnRenamed("seq", "id"),
    }
    return C.erase_users(tables, fx.erase_requests)["report"]


@register("delete_session_summaries", "H10", ["summaries", "session_deletes"], """
SELECT s.* FROM summaries s
WHERE NOT EXISTS (SELECT 1 FROM session_deletes d WHERE d.user_id = s.user_id AND d.session_name = s.session)
""")
def _delete_session_summaries(fx):
    return C.delete_session_cascade(fx.sessions, fx.messages, fx.summaries, fx.session_deletes)["summaries"]


@register("clear_history_messages", "H11/T19", ["messages", "erase_requests"], """
SELECT id, user_id, session, role FROM messages WHERE user_id NOT IN (SELECT user_id FROM erase_requests)
""")
def _clear_history_messages(fx):
    kept = C.clear_history(fx.messages, fx.summaries, fx.erase_requests)["messages"]
    return kept.select("id", "user_id", "session", "role")


@register("erase_payments", "H12/T18", ["subscription_log", "payments", "erase_requests"], """
SELECT p.id, p.subscription_id, p.status FROM payments p
WHERE p.subscription_id IN (SELECT seq FROM subscription_log WHERE user_id NOT IN (SELECT user_id FROM erase_requests))
""")
def _erase_payments(fx):
    subs = fx.subscription_log.withColumnRenamed("seq", "id")
    return C.erase_users({"subscriptions": subs}, fx.erase_requests, fx.payments)["payment_status"].select(
        "id", "subscription_id", "status")
