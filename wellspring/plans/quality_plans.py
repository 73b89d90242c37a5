"""Registered quality-rule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wellspring.fixed_values import BILLING_CYCLES, PAYMENT_STATUSES, PERSONAS, PLANS, ROLES
from wellspring.operators import quality as Q
from wellspring.operators.journal import journal_merge
from wellspring.operators.settings import persona_table
from wellspring.operators.tokens import token_ledger
from wellspring.plans.registry import register
from wellspring.sources.requests import parse_chat_requests

_PERSONA_VALUES = ", ".join("('" + p.replace("'", "''") + "')" for p, _ in PERSONAS)


@register("email_check", "Q1/T20", ["signups"], r"""
SELECT seq, email, coalesce(regexp_matches(email, '^[^@]+@[^@]+\.[^@]+'), false) AS email_ok FROM signups
""")
def _email_check(fx):
    return Q.email_check(fx.signups.select("seq", "email"))


@register("domain_check", "Q2", ["signups"], """
SELECT seq, plan, coalesce(plan IN ('basic', 'professional', 'premium'), false) AS plan_ok FROM signups
""")
def _domain_check(fx):
    return Q.domain_check(fx.signups.select("seq", "plan"), "plan", PLANS)


@register("domain_check_payments", "Q2", ["payments"], """
SELECT id, status, billing_cycle, status IN ('pending', 'paid', 'failed') AS status_ok, billing_cycle IN ('monthly', 'yearly') AS billing_cycle_ok FROM payments
""")
def _domain_check_payments(fx):
    checked = Q.domain_check(fx.payments.select("id", "status", "billing_cycle"), "status", PAYMENT_STATUSES)
    return Q.domain_check(checked, "billing_cycle", BILLING_CYCLES)


@register("domain_check_roles", "Q2", ["messages"], """
SELECT id, role, role IN ('user', 'assistant', 'system') AS role_ok FROM messages
""")
def _domain_check_roles(fx):
    return Q.domain_check(fx.messages.select("id", "role"), "role", ROLES)


@register("required_check", "Q3/A7", ["chat_bodies"], """
SELECT request_id,
 concat_ws(',', CASE WHEN NOT coalesce(json_array_length(json_extract(body, '$.messages')) > 0, false) THEN 'messages' END,
  CASE WHEN NOT coalesce(json_extract_string(body, '$.session_name') <> '', false) THEN 'session_name' END) AS failed
FROM (SELECT request_id, CASE WHEN json_valid(body) THEN body END AS body FROM chat_bodies) b
WHERE NOT (coalesce(json_array_length(json_extract(body, '$.messages')) > 0, false)
  AND coalesce(json_extract_string(body, '$.session_name') <> '', false))
""")
def _required_check(fx):
    parsed = parse_chat_requests(fx.chat_bodies)
    _clean, rejects = Q.required_check(parsed, {
        "messages": F.size("messages") > 0,
        "session_name": F.col("session_name") != "",
    })
    return rejects.select("request_id", F.array_join("failed", ",").alias("failed"))


@register("unique_check", "Q4", ["signups"], """
SELECT lower(email) AS email_n, count(*) AS rows, min(seq) AS kept_seq FROM signups GROUP BY lower(email) HAVING count(*) > 1
""")
def _unique_check(fx):
    return Q.unique_check(fx.signups.withColumn("email_n", F.lower("email")), ["email_n"], "seq")


@register("fk_orphans", "C9/Q5", ["users", "messages", "sessions", "journal_log", "token_log", "subscription_log",
                                   "erase_requests", "payments"], f"""
SELECT 'conversations' AS child, 'user_id' AS "column", CAST(user_id AS VARCHAR) AS value, count(*) AS rows
 FROM messages WHERE user_id NOT IN (SELECT id FROM kept) GROUP BY user_id
UNION ALL SELECT 'journals', 'user_id', CAST(user_id AS VARCHAR), count(*)
 FROM (SELECT DISTINCT user_id, entry_date FROM journal_log) j WHERE user_id NOT IN (SELECT id FROM kept) GROUP BY user_id
UNION ALL SELECT 'sessions', 'user_id', CAST(user_id AS VARCHAR), count(*)
 FROM sessions WHERE user_id NOT IN (SELECT id FROM kept) GROUP BY user_id
UNION ALL SELECT 'sessions', 'persona', persona, count(*)
 FROM sessions WHERE persona NOT IN (SELECT p FROM (VALUES {_PERSONA_VALUES}) v(p)) GROUP BY persona
UNION ALL SELECT 'subscriptions', 'user_id', CAST(user_id AS VARCHAR), count(*)
 FROM subscription_log WHERE user_id NOT IN (SELECT id FROM kept) GROUP BY user_id
UNION ALL SELECT 'payment_status', 'subscription_id', CAST(subscription_id AS VARCHAR), count(*)
 FROM payments WHERE subscription_id NOT IN (SELECT seq FROM subscription_log) GROUP BY subscription_id
UNION ALL SELECT 'token_usage', 'user_id', CAST(user_id AS VARCHAR), count(*)
 FROM (SELECT DISTINCT user_id, strftime(ts, '%m%y') FROM token_log) t WHERE user_id NOT IN (SELECT id FROM kept) GROUP BY user_id
""", ctes="kept AS (SELECT * FROM users WHERE id NOT IN (SELECT user_id FROM erase_requests))")
def _fk_orphans(fx):
    # Orphans left when only the users table is cut by the erase requests (no cascade).
    kept = fx.users.join(fx.erase_requests.withColumnRenamed("user_id", "id"), "id", "left_anti")
    # Both merges are by user and more, so logs dealt out by user need no further shuffle there.
    tables = {
        "users": kept, "conversations": fx.messages, "sessions": fx.sessions,
        "journals": journal_merge(None, Q.by_key(fx.journal_log, "user_id")), "subscriptions": fx.subscription_log.withColumnRenamed("seq", "id"), "payment_status": fx.payments,
        "token_usage": token_ledger(Q.by_key(fx.token_log, "user_id")), "session_types": persona_table(fx.spark),
    }
    return Q.fk_orphans(tables)


DATE_TEXT_SQL = """
SELECT event_id AS seq, CASE event_id % 4 WHEN 0 THEN 'invalid-date'
 WHEN 1 THEN concat(CAST(year(ts) AS VARCHAR), '-', CAST(month(ts) AS VARCHAR), '-', CAST(day(ts) AS VARCHAR))
 WHEN 2 THEN concat(CAST(year(ts) AS VARCHAR), '-', CAST(month(ts) AS VARCHAR), '-', CAST(day(ts) + 15 AS VARCHAR))
 ELSE concat(CAST(year(ts) AS VARCHAR), '-0', CAST(month(ts) AS VARCHAR), '-', CAST(day(ts) AS VARCHAR), 'x') END AS date_text
FROM events"""


@register("date_check", "Q6", [], rf"""
SELECT seq, date_text, CASE WHEN regexp_matches(date_text, '^\d{{4}}-\d{{1,2}}-\d{{1,2}}$')
 THEN CAST(try_strptime(date_text, '%Y-%m-%d') AS DATE) END AS date_text_date
FROM ({DATE_TEXT_SQL}) d
""", dates=["date_text_date"])
def _date_check(fx):
    e = fx.tables.events
    d = F.col("ts")
    text = (F.when(F.col("event_id") % 4 == 0, F.lit("invalid-date"))
            .when(F.col("event_id") % 4 == 1, F.concat_ws("-", F.year(d).cast("string"), F.month(d).cast("string"),
                                                          F.dayofmonth(d).cast("string")))
            .when(F.col("event_id") % 4 == 2, F.concat_ws("-", F.year(d).cast("string"), F.month(d).cast("string"),
                                                          (F.dayofmonth(d) + 15).cast("string")))
            .otherwise(F.concat(F.year(d).cast("string"), F.lit("-0"), F.month(d).cast("string"), F.lit("-"),
                                F.dayofmonth(d).cast("string"), F.lit("x"))))
    return Q.date_check(e.select(F.col("event_id").alias("seq"), text.alias("date_text")), "date_text")


@register("bot_check", "Q7", ["reset_requests"], """
SELECT seq, nickname, nickname IS NOT NULL AND nickname <> '' AS is_bot FROM reset_requests
""")
def _bot_check(fx):
    return Q.bot_check(fx.reset_requests.select("seq", "nickname"))


ACCESS_SQL = """
audited AS (
 SELECT seq, path, method, authenticated,
  CASE WHEN starts_with(path, '/static/') THEN 'static' WHEN needs THEN 'protected' ELSE 'public' END AS path_class,
  CASE WHEN needs AND NOT authenticated AND method <> 'OPTIONS' AND starts_with(path, '/api/') THEN '401'
   WHEN needs AND NOT authenticated AND method <> 'OPTIONS' THEN 'redirect' ELSE 'pass' END AS outcome
 FROM (SELECT *, path IN ('/profile', '/settings', '/journal', '/api/chat', '/insights')
   OR (path NOT IN ('/', '/signin', '/signup_with_plan', '/subscribe', '/verify_email', '/resend_verification',
        '/forgot_password', '/reset_password', '/about', '/terms', '/privacy', '/faq', '/contact', '/debug')
       AND NOT starts_with(path, '/static/') AND NOT starts_with(path, '/api/public/')) AS needs
  FROM access_log) a)"""


@register("access_audit", "Q8", ["access_log"], "SELECT * FROM audited", ctes=ACCESS_SQL)
def _access_audit(fx):
    return Q.access_audit(fx.access_log.select("seq", "path", "method", "authenticated"))


@register("access_summary", "Q8", ["access_log"],
          "SELECT path_class, outcome, count(*) AS requests FROM audited GROUP BY path_class, outcome", ctes=ACCESS_SQL)
def _access_summary(fx):
    return Q.access_summary(Q.access_audit(fx.access_log))
