"""Registered token-ledger queries."""

from __future__ import annotations

from wellspring.operators import tokens as TK
from wellspring.plans.registry import register
from wellspring.sources.fixtures import halves

MONTH = "0396"


@register("token_ledger", "D3/H4/H19", ["token_log"], """
SELECT user_id, strftime(ts, '%m%y') AS month_year, CAST(sum(total_tokens) AS BIGINT) AS tokens,
 min(ts) AS created_at, max(ts) AS updated_at
FROM token_log GROUP BY user_id, strftime(ts, '%m%y')
""")
def _token_ledger(fx):
    return TK.token_ledger(fx.token_log)


@register("token_ledger_base", "D3/H4", ["token_log"], """
SELECT user_id, strftime(ts, '%m%y') AS month_year, CAST(sum(total_tokens) AS BIGINT) AS tokens,
 min(ts) AS created_at, max(ts) AS updated_at
FROM token_log GROUP BY user_id, strftime(ts, '%m%y')
""")
def _token_ledger_base(fx):
    first, second = halves(fx.token_log, "request_id")
    return TK.token_ledger(second, TK.token_ledger(first))


@register("token_running_total", "E8", ["token_log"], """
SELECT request_id, user_id, strftime(ts, '%m%y') AS month_year, ts, total_tokens AS tokens,
 CAST(sum(total_tokens) OVER (PARTITION BY user_id, strftime(ts, '%m%y') ORDER BY ts, request_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running_tokens
FROM token_log
""")
def _token_running_total(fx):
    return TK.token_running_total(fx.token_log)


@register("monthly_tokens", "B14", ["users", "token_log"], f"""
SELECT u.id AS user_id, '{MONTH}' AS month_year, CAST(coalesce(l.tokens, 0) AS BIGINT) AS tokens
FROM users u LEFT JOIN (
 SELECT user_id, sum(total_tokens) AS tokens FROM token_log WHERE strftime(ts, '%m%y') = '{MONTH}' GROUP BY user_id) l
ON l.user_id = u.id
""")
def _monthly_tokens(fx):
    return TK.monthly_tokens(fx.users, TK.token_ledger(fx.token_log), MONTH)
