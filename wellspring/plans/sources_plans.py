"""Registered source/sink and small-function queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wellspring import schemas
from wellspring.functions.text import capitalize, last_n, truthy_or
from wellspring.operators import accounts as A
from wellspring.operators.chat import chat_history, dedup_messages
from wellspring.operators.accounts import subscription_history
from wellspring.operators.journal import insights_report, journal_merge
from wellspring.operators.settings import settings_merge
from wellspring.operators.tokens import token_ledger
from wellspring.plans.accounts_plans import ISSUES_SQL, _issues_table
from wellspring.plans.accounts_plans import SUBS_SQL
from wellspring.plans.chat_plans import HISTORY_SQL
from wellspring.plans.journal_plans import (JOURNALS_SQL, MOOD_SERIES_SQL, REFLECTION_SQL, TEST_THEMES,
                                            THEME_COUNTS_SQL)
from wellspring.plans.settings_plans import MERGED_SQL
from wellspring.sources.fixtures import AS_OF
from wellspring.plans.registry import register
from wellspring.sources.requests import parse_chat_requests
from wellspring.sources.sinks import append_messages, append_summaries, json_rows
from wellspring.session import checkpoint_dir, shared_path
from wellspring.sources.tables import conform, scan_table

LAPSE_AS_OF = "2024-01-31 00:00:00"
SUMMARY_AS_OF = "2024-01-31 12:00:00"


@register("scan_users", "A1", ["users"], """
SELECT id, username, email, CAST(NULL AS VARCHAR) AS password, CAST(NULL AS VARCHAR) AS email_token, verified,
 CAST(NULL AS VARCHAR) AS reset_token, CAST(NULL AS TIMESTAMP) AS reset_token_expires, age, sex, occupation, bio FROM users
""")
def _scan_users(fx):
    return conform(fx.users, schemas.USERS)


@register("scan_conversations", "A1", ["messages"], """
SELECT id, user_id, message, role, timestamp, archive, session FROM messages
""")
def _scan_conversations(fx):
    return conform(fx.messages, schemas.CONVERSATIONS)


@register("scan_journals", "A1", ["journal_log"], """
SELECT CAST(NULL AS BIGINT) AS id, user_id, entry_date, entry, mood, created_at, updated_at FROM journals
""", ctes=JOURNALS_SQL, dates=["entry_date"])
def _scan_journals(fx):
    return conform(journal_merge(None, fx.journal_log), schemas.JOURNALS)


@register("history_json", "A6", ["sessions", "messages"], """
SELECT user_id, to_json(struct_pack(session_name := session_name, type := type,
  start_date := strftime(start_date, '%Y-%m-%dT%H:%M:%S'), last_message := strftime(last_message, '%Y-%m-%dT%H:%M:%S'),
  message_count := message_count)) AS json
FROM (SELECT past.user_id, past.session_name, past.persona AS type, past.start_date, seen.newest AS last_message, coalesce(seen.n, 0) AS message_count
 FROM past LEFT JOIN seen USING (user_id, session_name)) h
""", ctes=HISTORY_SQL)
def _history_json(fx):
    h = chat_history(fx.sessions, fx.messages)
    return json_rows(h, ["session_name", "type", "start_date", "last_message", "message_count"], ["user_id"])


@register("parse_chat_requests", "A7/I15", ["chat_bodies"], """
SELECT request_id, user_id, body IS NOT NULL AS parsed,
 coalesce(CAST(json_array_length(json_extract(body, '$.messages')) AS INTEGER), 0) AS n_messages,
 json_extract_string(body, '$.session_name') AS session_name,
 json_extract_string(body, '$.session_type') AS session_type,
 CASE WHEN json_array_length(json_extract(body, '$.messages')) > 0 THEN
  json_extract_string(body, '$.messages[' || CAST(json_array_length(json_extract(body, '$.messages')) - 1 AS VARCHAR) || '].content') END AS user_input
FROM (SELECT request_id, user_id, CASE WHEN json_valid(body) THEN body END AS body FROM chat_bodies) b
""")
def _parse_chat_requests(fx):
    p = parse_chat_requests(fx.chat_bodies)
    return p.select("request_id", "user_id", "parsed", F.size("messages").alias("n_messages"),
                    "session_name", "session_type", "user_input")


@register("lapsed_tokens", "J6", ["reset_requests", "users", "reset_redemptions"], f"""
SELECT i.* FROM issues i
WHERE i.expires <= TIMESTAMP '{LAPSE_AS_OF}' AND i.token NOT IN (SELECT token FROM ok_tokens)
""", ctes=ISSUES_SQL + """,
known AS (SELECT r.seq, r.ts, r.token, i.user_id, i.expires FROM reset_redemptions r JOIN issues i ON i.token = r.token),
cand AS (
 SELECT k.seq, k.token,
  (SELECT i.token FROM issues i WHERE i.user_id = k.user_id AND i.issued_at <= k.ts ORDER BY i.issued_at DESC, i.seq DESC LIMIT 1) = k.token
  AND k.expires > k.ts AS cand
 FROM known k),
ok_tokens AS (SELECT DISTINCT token FROM cand WHERE cand)""", recursive=True)
def _lapsed_tokens(fx):
    issues = _issues_table(fx)
    red = A.reset_redeem(issues, fx.reset_redemptions)
    return A.lapsed_tokens(issues, red, LAPSE_AS_OF)


@register("ingest_dedup", "J7", ["messages"], "SELECT * FROM messages")
def _ingest_dedup(fx):
    m = fx.messages
    redelivered = m.filter(F.col("role") == "user")
    return dedup_messages(m.unionByName(redelivered))


@register("mood_labels", "I4/I13/I15", ["journal_log"], """
SELECT user_id, entry_date, upper(mood[1]) || lower(mood[2:]) AS mood_label, upper(coalesce(mood, '')) AS mood_upper,
 coalesce(nullif(entry, ''), '(no entry)') AS entry_or_default,
 array_to_string((string_split(coalesce(entry, ''), chr(10)))[-2:], '|') AS last_lines
FROM journals
""", ctes=JOURNALS_SQL, dates=["entry_date"])
def _mood_labels(fx):
    j = journal_merge(None, fx.journal_log)
    return j.select("user_id", "entry_date", capitalize("mood").alias("mood_label"),
                    F.upper(F.coalesce("mood", F.lit(""))).alias("mood_upper"),
                    truthy_or("entry", "(no entry)").alias("entry_or_default"),
                    F.array_join(last_n(F.split(F.coalesce("entry", F.lit("")), "\n", -1), 2), "|").alias("last_lines"))


@register("scan_sessions", "A1", ["sessions"], """
SELECT CAST(NULL AS BIGINT) AS id, user_id, session_name, persona, start_date, current FROM sessions
""")
def _scan_sessions(fx):
    return conform(fx.sessions, schemas.SESSIONS)


@register("scan_summaries", "A1", ["summaries"], """
SELECT CAST(NULL AS BIGINT) AS id, user_id, session, summary, last_message_id, CAST(NULL AS TIMESTAMP) AS created_at
FROM summaries
""")
def _scan_summaries(fx):
    return conform(fx.summaries, schemas.SUMMARIES)


@register("scan_user_settings", "A1", ["settings_log"], "SELECT * FROM merged", ctes=MERGED_SQL)
def _scan_user_settings(fx):
    return conform(settings_merge(fx.settings_log), schemas.USER_SETTINGS)


@register("scan_subscriptions", "A1", ["subscription_log"], """
SELECT seq AS id, user_id, plan_type, billing_cycle, start_date, end_date, is_active, created_at, updated_at FROM subs
""", ctes=SUBS_SQL)
def _scan_subscriptions(fx):
    return conform(subscription_history(fx.subscription_log).withColumnRenamed("seq", "id"), schemas.SUBSCRIPTIONS)


@register("scan_token_usage", "A1/T1", ["token_log"], """
SELECT CAST(NULL AS BIGINT) AS id, user_id, strftime(ts, '%m%y') AS month_year, CAST(sum(total_tokens) AS BIGINT) AS tokens,
 min(ts) AS created_at, max(ts) AS updated_at FROM token_log GROUP BY user_id, strftime(ts, '%m%y')
""")
def _scan_token_usage(fx):
    return conform(token_ledger(fx.token_log), schemas.TOKEN_USAGE)


@register("insights_json", "A6/K7", ["journal_log"], """
SELECT k.user_id, k.days, to_json(struct_pack(themes := coalesce(th.themes, ''),
  reflection := coalesce(r.text, 'No journal entries found for this period.'),
  mood_points := CAST(coalesce(m.points, 0) AS BIGINT), mean_score := m.mean_score)) AS json
FROM (SELECT DISTINCT user_id, days FROM tagged) k
LEFT JOIN (SELECT user_id, days, string_agg(theme, ', ' ORDER BY rank) AS themes FROM top_themes GROUP BY user_id, days) th
 ON th.user_id = k.user_id AND th.days = k.days
LEFT JOIN reflection r ON r.user_id = k.user_id AND r.days = k.days
LEFT JOIN (SELECT user_id, days, count(*) AS points, round(avg(score), 6) AS mean_score FROM mood_series GROUP BY user_id, days) m
 ON m.user_id = k.user_id AND m.days = k.days
""", ctes=THEME_COUNTS_SQL + "," + REFLECTION_SQL + "," + MOOD_SERIES_SQL)
def _insights_json(fx):
    rep = insights_report(journal_merge(None, fx.journal_log), AS_OF, TEST_THEMES)
    return json_rows(rep, ["themes", "reflection", "mood_points", "mean_score"], ["user_id", "days"])


@register("scan_user_tokens", "A1", ["token_log"], """
SELECT CAST(NULL AS BIGINT) AS id, user_id, strftime(ts, '%m%y') AS token_month, CAST(sum(total_tokens) AS BIGINT) AS month_tokens
FROM token_log GROUP BY user_id, strftime(ts, '%m%y')
""")
def _scan_user_tokens(fx):
    ledger = token_ledger(fx.token_log).withColumnsRenamed({"month_year": "token_month", "tokens": "month_tokens"})
    return _through_parquet(fx, conform(ledger, schemas.USER_TOKENS), "user_tokens")


@register("scan_session_types", "A1", ["sessions"], """
SELECT CAST(NULL AS BIGINT) AS id, persona, CAST(NULL AS VARCHAR) AS prompt FROM (SELECT DISTINCT persona FROM sessions) s
""")
def _scan_session_types(fx):
    return _through_parquet(fx, conform(fx.sessions.select("persona").distinct(), schemas.SESSION_TYPES), "session_types")


@register("scan_payment_status", "A1", ["payments"], """
SELECT id, subscription_id, status, CAST(NULL AS VARCHAR) AS payment_method, last_payment_date, CAST(NULL AS DATE) AS next_billing_date FROM payments
""", dates=["last_payment_date", "next_billing_date"])
def _scan_payment_status(fx):
    return _through_parquet(fx, conform(fx.payments, schemas.PAYMENT_STATUS), "payment_status")


def _through_parquet(fx, df, name):
    """The table written to the shared folder and read back by its declared schema."""
    path = f"{checkpoint_dir(fx.spark).rstrip('/')}/tables/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return scan_table(fx.spark, path, name)


@register("append_messages", "A4", ["messages"], """
SELECT id, user_id, message, role, timestamp, archive, session, strftime(timestamp, '%Y-%m-%d') AS message_date FROM messages
""")
def _append_messages(fx):
    # Two appends, as two ingest runs make them; then a typed scan of the whole table.
    path = shared_path(fx.spark, "messages")
    for part in (fx.messages.filter("role = 'user'"), fx.messages.filter("role <> 'user'")):
        append_messages(part, path)
    return scan_table(fx.spark, path, "conversations").withColumn("message_date", F.col("message_date").cast("string"))


@register("append_summaries", "A5", ["summaries", "messages"], f"""
SELECT s.user_id, s.session, s.summary, s.last_message_id, coalesce(m.timestamp, TIMESTAMP '{SUMMARY_AS_OF}') AS created_at,
 strftime(coalesce(m.timestamp, TIMESTAMP '{SUMMARY_AS_OF}'), '%Y-%m-%d') AS created_date
FROM summaries s LEFT JOIN messages m ON m.id = s.last_message_id AND m.archive
""")
def _append_summaries(fx):
    path = shared_path(fx.spark, "summaries")
    made = fx.messages.filter("archive").select(F.col("id").alias("last_message_id"), F.col("timestamp").alias("created_at"))
    append_summaries(fx.summaries.join(made, "last_message_id", "left"), path, SUMMARY_AS_OF)
    return scan_table(fx.spark, path, "summaries").drop("id").withColumn("created_date", F.col("created_date").cast("string"))
