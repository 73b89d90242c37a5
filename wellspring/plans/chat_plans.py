"""Registered chat queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wellspring.operators import chat
from wellspring.plans.registry import register


# Messages summed up per session first, then put beside the sessions that are not current.
HISTORY_SQL = """
seen AS (SELECT user_id, session AS session_name, max(timestamp) AS newest, count(*) AS n FROM messages GROUP BY user_id, session),
past AS (SELECT * FROM sessions WHERE NOT current)"""


@register("chat_history", "D1/F1", ["sessions", "messages"], """
SELECT past.user_id, past.session_name, past.persona AS type, past.start_date, seen.newest AS last_message,
 coalesce(seen.n, 0) AS message_count,
 CAST(row_number() OVER (PARTITION BY past.user_id ORDER BY seen.newest DESC NULLS LAST, past.session_name) AS INTEGER) AS position
FROM past LEFT JOIN seen USING (user_id, session_name)
""", ctes=HISTORY_SQL)
def _chat_history(fx):
    return chat.chat_history(fx.sessions, fx.messages)


@register("session_messages_left", "C1", ["sessions", "messages"], """
SELECT s.user_id, s.session_name, s.persona, c.id AS message_id, c.role, c.timestamp
FROM sessions s LEFT JOIN messages c ON s.user_id = c.user_id AND s.session_name = c.session
""")
def _session_messages_left(fx):
    return chat.session_messages_left(fx.sessions, fx.messages)


@register("current_sessions", "B4", ["sessions"], """
SELECT user_id, session_name, persona FROM sessions WHERE current
""")
def _current_sessions(fx):
    return chat.current_sessions(fx.sessions)


@register("session_detail", "B5", ["sessions", "switch_log"], """
SELECT k.user_id, k.session_name, s.persona, s.current
FROM (SELECT user_id, session_name FROM switch_log WHERE action = 'restore') k
LEFT JOIN sessions s ON s.user_id = k.user_id AND s.session_name = k.session_name
""")
def _session_detail(fx):
    keys = fx.switch_log.filter(F.col("action") == "restore")
    return chat.session_detail(fx.sessions, keys)


@register("chat_threads", "B6/F2", ["messages"], """
SELECT user_id, session, id, role, message AS content, timestamp,
 CAST(row_number() OVER (PARTITION BY user_id, session ORDER BY timestamp, id) AS INTEGER) AS position
FROM messages
""")
def _chat_threads(fx):
    return chat.chat_threads(fx.messages)


@register("first_messages", "E1/F2/F3", ["messages"], """
SELECT * FROM (
 SELECT user_id, session, id, role, message, timestamp,
  CAST(row_number() OVER (PARTITION BY user_id, session ORDER BY timestamp, id) AS INTEGER) AS position
 FROM messages) t WHERE position <= 4
""")
def _first_messages(fx):
    # n = 4: fixture sessions hold at most 8 messages, so the page limit shows.
    return chat.first_messages(fx.messages, n=4)


@register("latest_summary", "D5/F3", ["sessions", "summaries"], """
SELECT s.user_id, s.session_name AS session, l.summary, CAST(coalesce(l.last_message_id, 0) AS BIGINT) AS last_message_id
FROM sessions s LEFT JOIN (
 SELECT user_id, session, arg_max(summary, last_message_id) AS summary, max(last_message_id) AS last_message_id
 FROM summaries GROUP BY user_id, session) l
ON l.user_id = s.user_id AND l.session = s.session_name
""")
def _latest_summary(fx):
    return chat.latest_summary(fx.summaries, fx.sessions)


@register("messages_after_checkpoint", "B7/C3", ["messages", "summaries"], """
SELECT m.user_id, m.session, m.id, m.role, m.message AS content, m.timestamp,
 CAST(coalesce((SELECT max(s.last_message_id) FROM summaries s WHERE s.user_id = m.user_id AND s.session = m.session), 0) AS BIGINT) AS checkpoint
FROM messages m
WHERE m.id > coalesce((SELECT max(s.last_message_id) FROM summaries s WHERE s.user_id = m.user_id AND s.session = m.session), 0)
""")
def _messages_after_checkpoint(fx):
    return chat.messages_after_checkpoint(fx.messages, fx.summaries)


@register("restorable_sessions", "C7", ["sessions", "switch_log"], """
SELECT r.seq, r.user_id, r.ts, r.action, r.session_name, r.persona,
 EXISTS (SELECT 1 FROM sessions s WHERE s.user_id = r.user_id AND s.session_name = r.session_name) AS restorable
FROM switch_log r WHERE r.action = 'restore'
""")
def _restorable_sessions(fx):
    restores = fx.switch_log.filter(F.col("action") == "restore")
    return chat.restorable_sessions(fx.sessions, restores)


@register("current_from_log", "E4", ["sessions", "switch_log"], """
SELECT a.user_id, a.session_name, a.persona, a.start_date,
 CASE WHEN w.winner IS NULL THEN a.current ELSE a.session_name = w.winner END AS current
FROM all_sessions a LEFT JOIN winners w ON w.user_id = a.user_id
""", ctes="""
creates AS (SELECT * FROM switch_log WHERE action = 'create'),
valid_restores AS (
 SELECT r.* FROM switch_log r WHERE r.action = 'restore' AND (
  EXISTS (SELECT 1 FROM sessions s WHERE s.user_id = r.user_id AND s.session_name = r.session_name)
  OR EXISTS (SELECT 1 FROM creates c WHERE c.user_id = r.user_id AND c.session_name = r.session_name AND (c.ts < r.ts OR c.ts = r.ts AND c.seq < r.seq)))),
switches AS (SELECT seq, user_id, ts, session_name FROM creates UNION ALL SELECT seq, user_id, ts, session_name FROM valid_restores),
winners AS (SELECT user_id, session_name AS winner FROM (
 SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, seq DESC) AS rn FROM switches) t WHERE rn = 1),
all_sessions AS (SELECT user_id, session_name, persona, start_date, current FROM sessions
 UNION ALL SELECT user_id, session_name, persona, ts AS start_date, false AS current FROM creates)
""")
def _current_from_log(fx):
    return chat.current_from_log(fx.sessions, fx.switch_log)


@register("session_names", "E7", ["switch_log"], """
SELECT seq, user_id, ts, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, seq) AS INTEGER) AS counter,
 concat('session-', CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, seq) AS VARCHAR)) AS default_name
FROM switch_log WHERE action = 'create'
""")
def _session_names(fx):
    return chat.session_names(fx.switch_log)


@register("session_names_base", "E7", ["switch_log", "counter_settings"], """
SELECT seq, user_id, ts, counter, concat('session-', CAST(counter AS VARCHAR)) AS default_name FROM (
 SELECT l.seq, l.user_id, l.ts, CAST(row_number() OVER (PARTITION BY l.user_id ORDER BY l.ts, l.seq) - 1
  + coalesce((SELECT CAST(c.setting_value AS INTEGER) FROM counter_settings c WHERE c.user_id = l.user_id AND c.setting_key = 'session_counter'), 1) AS INTEGER) AS counter
 FROM switch_log l WHERE l.action = 'create') n
""")
def _session_names_base(fx):
    stored = fx.counter_settings.filter("setting_key = 'session_counter'")
    return chat.session_names(fx.switch_log, stored.select("user_id", F.col("setting_value").alias("session_counter")))


@register("global_stats", "D2", ["messages", "users"], """
SELECT (SELECT count(*) FROM messages) AS conversations, (SELECT count(*) FROM users) AS users
""")
def _global_stats(fx):
    return chat.global_stats(fx.messages, fx.users)


@register("thread_labels", "B15", ["messages"], """
SELECT id, user_id, session, role, CASE WHEN role = 'user' THEN 'You' ELSE 'Assistant' END AS label FROM messages
""")
def _thread_labels(fx):
    return chat.thread_labels(fx.messages)


@register("current_flag_check", "D8", ["faulty_sessions"], """
SELECT user_id, CAST(sum(CAST(current AS INTEGER)) AS BIGINT) AS current_count, count(*) AS session_count
FROM faulty_sessions GROUP BY user_id HAVING sum(CAST(current AS INTEGER)) <> 1
""")
def _current_flag_check(fx):
    return chat.current_flag_check(fx.faulty_sessions)
