"""Registered account queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wellspring import schemas
from wellspring.operators import accounts as A
from wellspring.plans.limits_plans import FUNNEL_CTES, funnel
from wellspring.plans.registry import register
from wellspring.session import materialize
from wellspring.sources.tables import conform

CLEANUP_AS_OF = "2024-01-15 00:00:00"

SUBS_SQL = """
subs AS (
 SELECT seq, user_id, plan_type, CASE WHEN plan_type <> 'basic' THEN 'monthly' END AS billing_cycle,
  ts AS start_date, CAST(NULL AS TIMESTAMP) AS end_date,
  lead(ts) OVER (PARTITION BY user_id ORDER BY ts, seq) IS NULL AS is_active, ts AS created_at,
  coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, seq), ts) AS updated_at
 FROM subscription_log)"""

SIGNUP_SQL = r"""
s AS (SELECT *, lower(email) AS email_n,
  coalesce(username <> '', false) AND coalesce(email <> '', false) AND coalesce(password <> '', false)
   AND coalesce(plan <> '', false) AS present,
  coalesce(nickname <> '', false) AS bot FROM signups),
s2 AS (SELECT s.*, EXISTS (SELECT 1 FROM users u WHERE u.email = s.email_n) AS ex,
  coalesce(regexp_matches(s.email_n, '^[^@]+@[^@]+\.[^@]+'), false) AS valid_email,
  plan IN ('basic', 'professional', 'premium') AS plan_ok FROM s),
fc AS (SELECT email_n, min(seq) AS first_seq FROM s2 WHERE present AND valid_email AND plan_ok AND NOT ex AND NOT bot
  GROUP BY email_n),
outcomes AS (
 SELECT s2.seq, s2.ts, s2.email_n, s2.plan, s2.username, s2.email_token,
  CASE WHEN NOT present THEN 'missing_fields' WHEN NOT valid_email THEN 'invalid_email' WHEN NOT plan_ok THEN 'invalid_plan'
   WHEN ex OR s2.seq > fc.first_seq THEN 'email_registered' WHEN bot THEN 'bot' ELSE 'created' END AS outcome
 FROM s2 LEFT JOIN fc ON fc.email_n = s2.email_n)"""

ISSUES_SQL = FUNNEL_CTES + """,
issues AS (SELECT f.seq, u.id AS user_id, concat('rst', CAST(f.seq AS VARCHAR)) AS token, f.ts AS issued_at,
  f.ts + INTERVAL 1 HOUR AS expires FROM funnel f JOIN users u ON u.email = f.email WHERE f.outcome = 'sent')"""

STATE_SQL = ISSUES_SQL + """,
state AS (SELECT user_id, p.token AS reset_token, p.expires AS reset_token_expires
  FROM (SELECT user_id, arg_max(struct_pack(token := token, expires := expires), struct_pack(t := issued_at, s := seq)) AS p FROM issues GROUP BY user_id) t)"""

# Redemptions judged one by one in time order: the token must be the newest issued, unexpired and unused.
REDEEM_SQL = """,
known AS (SELECT r.seq, r.ts, r.token, i.user_id, i.expires FROM reset_redemptions r JOIN issues i ON i.token = r.token),
cand AS (
 SELECT k.seq, k.ts, k.token,
  (SELECT i.token FROM issues i WHERE i.user_id = k.user_id AND i.issued_at <= k.ts ORDER BY i.issued_at DESC, i.seq DESC LIMIT 1) = k.token
  AND k.expires > k.ts AS cand
 FROM known k),
used AS (SELECT token, seq FROM cand WHERE cand QUALIFY row_number() OVER (PARTITION BY token ORDER BY ts, seq) = 1)"""

CLEARED_SQL = STATE_SQL + REDEEM_SQL + """,
cleared AS (SELECT s.user_id, CASE WHEN u.token IS NULL THEN s.reset_token END AS reset_token,
  CASE WHEN u.token IS NULL THEN s.reset_token_expires END AS reset_token_expires
  FROM state s LEFT JOIN used u ON u.token = s.reset_token)"""


def _issues(fx):
    sent = (funnel(fx).filter(F.col("outcome") == "sent")
            .select("seq", "ts", "email", F.concat(F.lit("rst"), F.col("seq").cast("string")).alias("token")))
    return A.reset_issue(sent, fx.users)


def _issues_table(fx):
    # The issue log is the output of two folds and is read by several branches
    # (token lookup, interleaving, anti join): written once to the checkpoint folder.
    return materialize(_issues(fx))


@register("users_by_id", "B1", ["users", "token_log"], """
SELECT k.user_id, u.username, u.email FROM (SELECT DISTINCT user_id FROM token_log) k LEFT JOIN users u ON u.id = k.user_id
""")
def _users_by_id(fx):
    return A.users_by_id(fx.users, fx.token_log.select("user_id").distinct())


@register("users_by_id_full", "B1", ["users", "token_log"], """
SELECT k.user_id, u.username, u.email, u.verified, u.age, u.sex, u.occupation, u.bio
FROM (SELECT DISTINCT user_id FROM token_log) k LEFT JOIN users u ON u.id = k.user_id
""")
def _users_by_id_full(fx):
    stored = conform(fx.users.withColumn("password", F.lit("hash")), schemas.USERS)
    return A.user_rows(stored, fx.token_log.select("user_id").distinct())


@register("users_by_email", "B2/B3/I1", ["users", "reset_requests"], r"""
SELECT r.seq, r.email, u.id AS user_id, u.username, u.age, u.sex, u.bio, u.verified, u.id IS NOT NULL AS registered
FROM (SELECT seq, lower(regexp_replace(email_raw, '^\s+|\s+$', '', 'g')) AS email FROM reset_requests) r
LEFT JOIN users u ON u.email = r.email
""")
def _users_by_email(fx):
    out = A.users_by_email(fx.users, fx.reset_requests)
    return out.select("seq", "email", "user_id", "username", "age", "sex", "bio", "verified", "registered")


@register("subscription_history", "E5/E6", ["subscription_log"], "SELECT * FROM subs", ctes=SUBS_SQL)
def _subscription_history(fx):
    return A.subscription_history(fx.subscription_log)


@register("users_active_subscription", "C2/T15", ["users", "subscription_log"], """
SELECT u.id, u.username, u.email, u.verified, s.plan_type, s.billing_cycle, s.end_date, s.is_active
FROM users u LEFT JOIN (SELECT * FROM subs WHERE is_active) s ON s.user_id = u.id
""", ctes=SUBS_SQL)
def _users_active_subscription(fx):
    return A.users_active_subscription(fx.users, A.subscription_history(fx.subscription_log))


@register("profile_merge", "H5", ["users", "profile_log"], """
SELECT u.id, u.email, u.verified,
 CASE WHEN p.id IS NULL THEN u.username ELSE p.n.username END AS username,
 CASE WHEN p.id IS NULL THEN u.age ELSE p.n.age END AS age,
 CASE WHEN p.id IS NULL THEN u.sex ELSE p.n.sex END AS sex,
 CASE WHEN p.id IS NULL THEN u.occupation ELSE p.n.occupation END AS occupation,
 CASE WHEN p.id IS NULL THEN u.bio ELSE p.n.bio END AS bio
FROM users u LEFT JOIN (
 SELECT id, arg_max(struct_pack(username := username, age := age, sex := sex, occupation := occupation, bio := bio), seq) AS n
 FROM profile_log GROUP BY id) p ON p.id = u.id
""")
def _profile_merge(fx):
    return A.profile_merge(fx.users, fx.profile_log)


@register("signup_fanout", "H13/Q1-Q4/Q7", ["users", "signups"],
          "SELECT seq, ts, email_n, plan, outcome FROM outcomes", ctes=SIGNUP_SQL)
def _signup_fanout(fx):
    return A.signup_fanout(fx.signups, fx.users)["outcomes"]


@register("signup_users", "H13", ["users", "signups"], """
SELECT (SELECT max(id) FROM users) + o.seq AS id, o.username, o.email_n AS email, o.email_token, false AS verified, o.ts
FROM outcomes o WHERE o.outcome = 'created'
""", ctes=SIGNUP_SQL)
def _signup_users(fx):
    return A.signup_fanout(fx.signups, fx.users)["users"]


@register("signup_subscriptions", "H13/T14", ["users", "signups"], """
SELECT (SELECT max(id) FROM users) + o.seq AS user_id, o.email_n AS email, k.n, k.plan_type, k.billing_cycle, k.is_active,
 o.ts AS created_at
FROM outcomes o, LATERAL (SELECT 1 AS n, 'basic' AS plan_type, CAST(NULL AS VARCHAR) AS billing_cycle, false AS is_active
  UNION ALL SELECT 2, o.plan, CASE WHEN o.plan <> 'basic' THEN 'monthly' END, true) k
WHERE o.outcome = 'created'
""", ctes=SIGNUP_SQL)
def _signup_subscriptions(fx):
    return A.signup_fanout(fx.signups, fx.users)["subscriptions"]


@register("signup_settings", "H13", ["users", "signups"], """
SELECT (SELECT max(id) FROM users) + o.seq AS user_id, o.email_n AS email, k.setting_key, k.setting_value, o.ts AS updated_at
FROM outcomes o, (VALUES ('model', 'gpt-3.5-turbo'), ('typing_delay', '1000'), ('voice', 'en-US'), ('msg_retention', '50'),
  ('theme', 'default'), ('summary_count', '100')) k(setting_key, setting_value)
WHERE o.outcome = 'created'
""", ctes=SIGNUP_SQL)
def _signup_settings(fx):
    return A.signup_fanout(fx.signups, fx.users)["settings"]


@register("verify_merge", "H14/T26", ["users_tokens", "verify_clicks"], """
SELECT c.seq, c.ts, c.token, u.user_id,
 CASE WHEN u.user_id IS NULL THEN 'unknown' WHEN u.was_verified THEN 'already_verified'
  WHEN c.seq = f.first_seq THEN 'verified' ELSE 'unknown' END AS outcome
FROM verify_clicks c
LEFT JOIN (SELECT email_token AS token, id AS user_id, verified AS was_verified FROM users_tokens WHERE email_token IS NOT NULL) u
 ON u.token = c.token
LEFT JOIN (SELECT token, min(seq) AS first_seq FROM verify_clicks GROUP BY token) f ON f.token = c.token
""")
def _verify_merge(fx):
    return A.verify_merge(fx.users_tokens, fx.verify_clicks)["outcomes"]


@register("verify_users", "H14", ["users_tokens", "verify_clicks"], """
SELECT u.id, u.email, u.verified OR d.token IS NOT NULL AS verified,
 CASE WHEN d.token IS NOT NULL THEN NULL ELSE u.email_token END AS email_token
FROM users_tokens u LEFT JOIN (SELECT DISTINCT c.token FROM verify_clicks c) d
 ON d.token = u.email_token AND NOT u.verified
""")
def _verify_users(fx):
    return A.verify_merge(fx.users_tokens, fx.verify_clicks)["users"]


@register("resend_merge", "H15", ["users_tokens", "resend_requests"], r"""
SELECT r.seq, r.ts, r.email, u.id AS user_id,
 CASE WHEN r.email = '' THEN 'missing' WHEN u.id IS NULL THEN 'no_account' WHEN u.verified THEN 'already_verified' ELSE 'sent' END AS outcome
FROM (SELECT seq, ts, lower(regexp_replace(email_raw, '^\s+|\s+$', '', 'g')) AS email FROM resend_requests) r
LEFT JOIN users_tokens u ON u.email = r.email
""")
def _resend_merge(fx):
    return A.resend_merge(fx.users_tokens, fx.resend_requests)["outcomes"]


@register("resend_users", "H15", ["users_tokens", "resend_requests"], r"""
SELECT u.id, u.email, u.verified, coalesce(t.tok, u.email_token) AS email_token
FROM users_tokens u LEFT JOIN (
 SELECT uu.id, arg_max(r.token, r.seq) AS tok
 FROM (SELECT seq, token, lower(regexp_replace(email_raw, '^\s+|\s+$', '', 'g')) AS email FROM resend_requests) r
 JOIN users_tokens uu ON uu.email = r.email WHERE r.email <> '' AND NOT uu.verified GROUP BY uu.id) t ON t.id = u.id
""")
def _resend_users(fx):
    return A.resend_merge(fx.users_tokens, fx.resend_requests)["users"]


@register("reset_issue", "H16", ["reset_requests", "users"], "SELECT * FROM issues", ctes=ISSUES_SQL, recursive=True)
def _reset_issue(fx):
    return _issues(fx)


@register("reset_redeem", "H17/T25", ["reset_requests", "users", "reset_redemptions"], """
SELECT r.seq, r.ts, r.token, u.seq IS NOT NULL AS redeemed FROM reset_redemptions r LEFT JOIN used u ON u.seq = r.seq
""", ctes=ISSUES_SQL + REDEEM_SQL, recursive=True)
def _reset_redeem(fx):
    return A.reset_redeem(_issues_table(fx), fx.reset_redemptions)


def _state(fx):
    issues = _issues_table(fx)
    return A.reset_state(issues, A.reset_redeem(issues, fx.reset_redemptions))


@register("reset_cleanup", "H18", ["reset_requests", "users", "reset_redemptions"], f"""
SELECT user_id, CASE WHEN reset_token_expires < TIMESTAMP '{CLEANUP_AS_OF}' THEN NULL ELSE reset_token END AS reset_token,
 CASE WHEN reset_token_expires < TIMESTAMP '{CLEANUP_AS_OF}' THEN NULL ELSE reset_token_expires END AS reset_token_expires
FROM cleared
""", ctes=CLEARED_SQL, recursive=True)
def _reset_cleanup(fx):
    return A.reset_cleanup(_state(fx), CLEANUP_AS_OF)[0]


@register("expired_token_count", "D7", ["reset_requests", "users", "reset_redemptions"], f"""
SELECT count(*) FILTER (WHERE reset_token_expires < TIMESTAMP '{CLEANUP_AS_OF}') AS affected FROM cleared
""", ctes=CLEARED_SQL, recursive=True)
def _expired_token_count(fx):
    return A.reset_cleanup(_state(fx), CLEANUP_AS_OF)[1]
