"""Registered prompt/response queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wellspring.fixed_values import PERSONAS
from wellspring.functions.dates import daypart
from wellspring.functions.routing import model_route
from wellspring.functions.text import all_but_last
from wellspring.operators import prompts as P
from wellspring.operators.journal import journal_merge, journals_by_days, reflections_by_days
from wellspring.operators.settings import effective_settings, persona_table, settings_merge
from wellspring.operators.tokens import token_ledger
from wellspring.plans.journal_plans import REFLECTION_SQL, TAGGED_SQL
from wellspring.plans.registry import register
from wellspring.plans.settings_plans import DEFAULTS_SQL, MERGED_SQL
from wellspring.session import materialize
from wellspring.sources.fixtures import AS_OF
from wellspring.sources.requests import parse_chat_requests

THRESHOLD = 4   # fixture sessions hold at most 8 messages


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


PERSONAS_SQL = "personas AS (SELECT * FROM (VALUES " + ", ".join(
    f"({_q(p)}, {_q(t)})" for p, t in PERSONAS) + ") p(persona, prompt))"

def intro_sql(p: str = "") -> str:
    """K1 in SQL; ``p`` is an optional table alias prefix such as ``u.``."""
    return (f"('My name is ' || coalesce({p}username, 'None') || '.'"
            f" || CASE WHEN {p}age IS NOT NULL AND {p}age <> 0 THEN ' I am ' || CAST({p}age AS VARCHAR) || ' years old.' ELSE '' END"
            f" || CASE WHEN {p}sex IS NOT NULL AND {p}sex <> '' THEN ' I am ' || lower({p}sex) || '.' ELSE '' END"
            f" || CASE WHEN {p}bio IS NOT NULL AND {p}bio <> '' THEN ' A bit about me: ' || {p}bio ELSE '' END)")


TURNS_SQL = """
turns AS (
 SELECT request_id, user_id, json_extract_string(body, '$.session_name') AS session,
  json_extract_string(body, '$.session_type') AS persona,
  json_extract_string(body, '$.messages[' || CAST(json_array_length(json_extract(body, '$.messages')) - 1 AS VARCHAR) || '].content') AS user_input
 FROM chat_bodies
 WHERE json_valid(body) AND coalesce(json_array_length(json_extract(body, '$.messages')) > 0, false)
  AND coalesce(json_extract_string(body, '$.session_name') <> '', false))"""


def _turns(fx):
    parsed = parse_chat_requests(fx.chat_bodies)
    ok = parsed.filter((F.size("messages") > 0) & (F.col("session_name") != ""))
    return ok.select("request_id", "user_id", F.col("session_name").alias("session"),
                     F.col("session_type").alias("persona"), "user_input",
                     all_but_last("messages").alias("history"))


@register("profile_intro", "K1/I5", ["users"], f"SELECT id AS user_id, {intro_sql()} AS intro FROM users")
def _profile_intro(fx):
    return P.profile_intro(fx.users)


@register("prompt_join", "C4/A9", ["sessions"], """
SELECT s.persona, s.user_id, s.session_name, p.prompt FROM sessions s LEFT JOIN personas p ON p.persona = s.persona
""", ctes=PERSONAS_SQL)
def _prompt_join(fx):
    return P.prompt_join(fx.sessions.select("user_id", "session_name", "persona"), persona_table(fx.spark))


@register("chat_requests", "K2/K3/F5/T4-T6", ["chat_bodies", "summaries", "messages", "users"], f"""
SELECT t.request_id, CAST(0 AS INTEGER) AS part, CAST(0 AS BIGINT) AS pos, 'system' AS role,
 'Summary so far: ' || sm.summary AS content
FROM turns t JOIN sm ON sm.request_id = t.request_id
UNION ALL
SELECT t.request_id, 2, m.id, m.role, m.message
FROM turns t JOIN sm ON sm.request_id = t.request_id
JOIN messages m ON m.user_id = t.user_id AND m.session = t.session AND m.role <> 'system'
 AND m.id > sm.checkpoint AND m.id < t.request_id
UNION ALL
SELECT t.request_id, 0, 0, 'system', p.prompt
FROM turns t LEFT JOIN personas p ON p.persona = t.persona WHERE t.request_id NOT IN (SELECT request_id FROM sm)
UNION ALL
SELECT t.request_id, 1, 0, 'system', {intro_sql('u.')}
FROM turns t JOIN users u ON u.id = t.user_id WHERE t.request_id NOT IN (SELECT request_id FROM sm)
UNION ALL
SELECT request_id, 2, i, json_extract_string(body, '$.messages[' || i || '].role'), json_extract_string(body, '$.messages[' || i || '].content')
FROM (SELECT request_id, body, unnest(range(CAST(json_array_length(json_extract(body, '$.messages')) AS BIGINT) - 1)) AS i
 FROM turns JOIN chat_bodies USING (request_id)) h WHERE request_id NOT IN (SELECT request_id FROM sm)
UNION ALL
SELECT request_id, 3, 0, 'user', user_input FROM turns
""", ctes=PERSONAS_SQL + "," + TURNS_SQL + """,
sm AS (SELECT t.request_id, arg_max(s.summary, s.last_message_id) AS summary, max(s.last_message_id) AS checkpoint
 FROM turns t JOIN summaries s ON s.user_id = t.user_id AND s.session = t.session AND s.last_message_id < t.request_id
 GROUP BY t.request_id)""")
def _chat_requests(fx):
    return P.chat_requests(_turns(fx), fx.messages, fx.summaries, persona_table(fx.spark), fx.users)


TRIGGER_SQL = f"""
init AS (SELECT user_id, session, max(last_message_id) AS ck FROM summaries GROUP BY user_id, session),
o AS (SELECT m.user_id, m.session, m.id, m.role, coalesce(i.ck, 0) AS ck0,
  row_number() OVER (PARTITION BY m.user_id, m.session ORDER BY m.id) AS n
 FROM messages m LEFT JOIN init i ON i.user_id = m.user_id AND i.session = m.session WHERE m.role <> 'system'),
r AS (
 SELECT user_id, session, n, id, role, ck0 AS ck_before, 0 AS recent,
  role = 'user' AND 0 >= {THRESHOLD} AS trig, ck0 AS ck, CASE WHEN id > ck0 THEN 1 ELSE 0 END AS pending, id AS last_id
 FROM o WHERE n = 1
 UNION ALL
 SELECT o.user_id, o.session, o.n, o.id, o.role, r.ck AS ck_before, r.pending AS recent,
  o.role = 'user' AND r.pending >= {THRESHOLD} AS trig,
  CASE WHEN o.role = 'user' AND r.pending >= {THRESHOLD} THEN r.last_id ELSE r.ck END AS ck,
  CASE WHEN o.role = 'user' AND r.pending >= {THRESHOLD} THEN 1 ELSE r.pending + CASE WHEN o.id > r.ck THEN 1 ELSE 0 END END AS pending,
  o.id AS last_id
 FROM r JOIN o ON o.user_id = r.user_id AND o.session = r.session AND o.n = r.n + 1),
triggers AS (SELECT user_id, session, id AS turn_id, CAST(recent AS BIGINT) AS recent, trig AS triggered,
  CAST(ck_before AS BIGINT) AS checkpoint_before, CAST(ck AS BIGINT) AS checkpoint_after FROM r WHERE role = 'user')"""


def _triggers(fx):
    return P.summary_triggers(fx.messages, fx.summaries, threshold=THRESHOLD, mode="max_id")


@register("summary_triggers", "J4/T2/T4", ["messages", "summaries"], "SELECT * FROM triggers",
          ctes=TRIGGER_SQL, recursive=True)
def _summary_triggers(fx):
    return _triggers(fx)


# Count mode: a trigger moves the checkpoint by the number of messages, so it lags behind the ids.
COUNT_SQL = TRIGGER_SQL.split("r AS (")[0] + f"""r AS (
 SELECT user_id, session, n, id, role, ck0 AS ck_before, CAST(0 AS BIGINT) AS recent, false AS trig, ck0 AS ck, [id] AS ids FROM o WHERE n = 1
 UNION ALL
 SELECT o.user_id, o.session, o.n, o.id, o.role, p.ck, p.pending, o.role = 'user' AND p.pending >= {THRESHOLD},
  CASE WHEN o.role = 'user' AND p.pending >= {THRESHOLD} THEN p.ck + p.pending ELSE p.ck END, list_append(p.ids, o.id)
 FROM (SELECT *, CAST(len(list_filter(ids, lambda x: x > ck)) AS BIGINT) AS pending FROM r) p
 JOIN o ON o.user_id = p.user_id AND o.session = p.session AND o.n = p.n + 1)"""


@register("summary_triggers_count", "J4/T2", ["messages", "summaries"], """
SELECT user_id, session, id AS turn_id, recent, trig AS triggered, CAST(ck_before AS BIGINT) AS checkpoint_before,
 CAST(ck AS BIGINT) AS checkpoint_after FROM r WHERE role = 'user'
""", ctes=COUNT_SQL, recursive=True)
def _summary_triggers_count(fx):
    return P.summary_triggers(fx.messages, fx.summaries, threshold=THRESHOLD, mode="count")


REQUESTS_SQL = """
SELECT turn_id AS request_id, CAST(0 AS INTEGER) AS part, CAST(0 AS BIGINT) AS pos, 'system' AS role,
 CASE WHEN prev IS NULL OR prev = '' THEN 'Summarise the following conversation in 1–2 sentences, focusing on the user''s emotional themes.'
  ELSE 'The previous summary was: "' || prev || '". Update or extend it based on the following new messages.' END AS content
FROM tp
UNION ALL
SELECT t.turn_id, 2, m.id, m.role, m.message FROM tp t JOIN messages m
 ON m.user_id = t.user_id AND m.session = t.session AND m.role <> 'system' AND m.id > t.checkpoint_before AND m.id < t.turn_id
UNION ALL
SELECT turn_id, 3, 0, 'system', 'Provide a concise updated summary.' FROM tp
"""

TP_SQL = """,
tp AS (SELECT t.*, CASE WHEN lag(t.turn_id) OVER (PARTITION BY t.user_id, t.session ORDER BY t.turn_id) IS NOT NULL
  THEN '@summary:' || CAST(lag(t.turn_id) OVER (PARTITION BY t.user_id, t.session ORDER BY t.turn_id) AS VARCHAR)
  ELSE (SELECT arg_max(s.summary, s.last_message_id) FROM summaries s WHERE s.user_id = t.user_id AND s.session = t.session) END AS prev
 FROM triggers t WHERE t.triggered)"""


@register("summary_requests", "K4", ["messages", "summaries"], REQUESTS_SQL, ctes=TRIGGER_SQL + TP_SQL, recursive=True)
def _summary_requests(fx):
    # The trigger table is a fold's output read by two branches: written once.
    return P.summary_requests(materialize(_triggers(fx)), fx.messages, fx.summaries)


@register("summary_requests_count", "K4/T2", ["messages", "summaries"], REQUESTS_SQL, ctes=COUNT_SQL + """,
counted AS (SELECT user_id, session, id AS turn_id, trig AS triggered, CAST(ck_before AS BIGINT) AS checkpoint_before FROM r WHERE role = 'user')"""
          + TP_SQL.replace("FROM triggers t", "FROM counted t"), recursive=True)
def _summary_requests_count(fx):
    triggers = P.summary_triggers(fx.messages, fx.summaries, threshold=THRESHOLD, mode="count")
    return P.summary_requests(materialize(triggers), fx.messages, fx.summaries, mode="count")


@register("reflection_requests", "K5", ["journal_log"], f"""
SELECT k.user_id, k.days, CASE WHEN r.text IS NULL THEN 'empty' ELSE 'request' END AS kind,
 CASE WHEN r.text IS NULL THEN 'No journal entries found for this period.'
  ELSE 'You are a gentle, empathetic mental health assistant who summarizes journals with care and insight.' END AS system,
 CASE WHEN r.text IS NOT NULL THEN 'Summarize the following journal entries and offer a gentle reflection:' || chr(10) || chr(10) || r.text END AS "user"
FROM (SELECT DISTINCT user_id, days FROM tagged) k LEFT JOIN reflection r ON r.user_id = k.user_id AND r.days = k.days
""", ctes=TAGGED_SQL + "," + REFLECTION_SQL)
def _reflection_requests(fx):
    journals = journal_merge(None, fx.journal_log)
    return P.reflection_requests(reflections_by_days(journals, AS_OF), journals_by_days(journals, AS_OF).select("user_id", "days"))


@register("ingest_responses", "K6", ["responses"], """
SELECT request_id, 0 AS turn_order, user_id, session, 'user' AS role, user_input AS message, ts AS timestamp, false AS archive FROM responses
UNION ALL
SELECT request_id, 1, user_id, session, 'assistant', reply, ts, false FROM responses
""")
def _ingest_responses(fx):
    return P.ingest_responses(fx.responses)["messages"]


@register("ingest_tokens", "K6/D3/J5", ["responses"], """
SELECT user_id, strftime(ts, '%m%y') AS month_year, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS tokens,
 min(ts) AS created_at, max(ts) AS updated_at FROM responses GROUP BY user_id, strftime(ts, '%m%y')
""")
def _ingest_tokens(fx):
    return token_ledger(P.ingest_responses(fx.responses)["tokens"])


@register("model_route", "I12", ["users", "settings_log"], """
SELECT CASE WHEN starts_with(v, 'claude') THEN 'claude' WHEN starts_with(v, 'ollama:') THEN 'ollama'
  WHEN starts_with(v, 'gpt-') THEN 'openai' ELSE 'unsupported' END AS route, count(*) AS users
FROM (SELECT u.id, coalesce((SELECT s.setting_value FROM merged s WHERE s.user_id = u.id AND s.setting_key = 'model'),
  (SELECT d.v FROM defaults d WHERE d.k = 'model')) AS v FROM users u) x
GROUP BY 1
""", ctes=MERGED_SQL + ",\n" + DEFAULTS_SQL)
def _model_route(fx):
    eff = effective_settings(fx.users, settings_merge(fx.settings_log)).filter(F.col("setting_key") == "model")
    return eff.groupBy(model_route("setting_value").alias("route")).agg(F.count("*").alias("users"))


@register("daypart", "I11", ["messages"], """
SELECT CASE WHEN hour(timestamp) >= 5 AND hour(timestamp) < 12 THEN 'morning'
  WHEN hour(timestamp) >= 12 AND hour(timestamp) < 18 THEN 'afternoon' ELSE 'evening' END AS daypart,
 count(*) AS messages FROM messages GROUP BY 1
""")
def _daypart(fx):
    return fx.messages.groupBy(daypart("timestamp").alias("daypart")).agg(F.count("*").alias("messages"))


@register("casual_requests", "K3/T38", ["chat_bodies", "users"], f"""
SELECT t.request_id, CAST(0 AS INTEGER) AS part, CAST(0 AS BIGINT) AS pos, 'system' AS role, p.prompt AS content
FROM turns t LEFT JOIN personas p ON p.persona = 'Casual Chat'
UNION ALL
SELECT t.request_id, 1, 0, 'system', {intro_sql('u.')} FROM turns t JOIN users u ON u.id = t.user_id
UNION ALL
SELECT request_id, 2, i, json_extract_string(body, '$.messages[' || i || '].role'), json_extract_string(body, '$.messages[' || i || '].content')
FROM (SELECT request_id, body, unnest(range(CAST(json_array_length(json_extract(body, '$.messages')) AS BIGINT) - 1)) AS i
 FROM turns JOIN chat_bodies USING (request_id)) h
UNION ALL
SELECT request_id, 3, 0, 'user', user_input FROM turns
""", ctes=PERSONAS_SQL + "," + TURNS_SQL)
def _casual_requests(fx):
    return P.chat_requests(_turns(fx), fx.messages, fx.summaries, persona_table(fx.spark), fx.users, casual=True)


@register("ingest_casual", "K6/T38", ["responses"], """
SELECT request_id, 0 AS turn_order, user_id, 'Casual' AS session, 'user' AS role, user_input AS message, ts AS timestamp,
 false AS archive FROM responses
UNION ALL
SELECT request_id, 1, user_id, 'Casual', 'assistant', reply, ts, false FROM responses
""")
def _ingest_casual(fx):
    return P.ingest_responses(fx.responses, casual=True)["messages"]


@register("summary_triggers_split", "J4 hot sessions", ["messages", "summaries"], "SELECT * FROM triggers",
          ctes=TRIGGER_SQL, recursive=True)
def _summary_triggers_split(fx):
    # The form for hot sessions (pointer doubling) on every session.
    return P.summary_triggers_parallel(fx.messages, fx.summaries, threshold=THRESHOLD)
