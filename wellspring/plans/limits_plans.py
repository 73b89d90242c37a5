"""Registered limiter and reset-funnel queries.

The oracle is a recursive CTE that replays each key's requests one by one
(the plain sequential definition), independent of the Spark fold.
"""

from __future__ import annotations

from wellspring.operators import limits as L
from wellspring.plans.registry import register

MAX_REQ = 3
WINDOW_MIN = 1440          # the default 15 minutes denies nothing in the test data
WINDOW_US = WINDOW_MIN * 60 * 1_000_000


def fold_sql(name: str, source: str) -> str:
    """Recursive replay over ``source``(k, seq, t, n): allowed flag and retry seconds."""
    return f"""
{name} AS (
 SELECT k, seq, n, true AS ok, [t] AS l, CAST(NULL AS BIGINT) AS retry FROM {source} WHERE n = 1
 UNION ALL
 SELECT k, seq, n, len(l) < {MAX_REQ} AS ok,
  CASE WHEN len(l) < {MAX_REQ} THEN list_append(l, t) ELSE l END AS l,
  CASE WHEN len(l) < {MAX_REQ} THEN NULL ELSE CAST(({WINDOW_US} - (t - l[1])) // 1000000 AS BIGINT) END AS retry
 FROM (SELECT o.k, o.seq, o.n, o.t, list_filter({name}.l, lambda x: o.t - x <= {WINDOW_US}) AS l
       FROM {name} JOIN {source} o ON o.k = {name}.k AND o.n = {name}.n + 1) s)"""


FUNNEL_CTES = r"""
req AS (SELECT seq, ts, ip, lower(regexp_replace(email_raw, '^\s+|\s+$', '', 'g')) AS email,
  coalesce(nickname <> '', false) AS bot FROM reset_requests),
o1 AS (SELECT ip AS k, seq, epoch_us(ts) AS t, row_number() OVER (PARTITION BY ip ORDER BY ts, seq) AS n FROM req WHERE NOT bot),
""" + fold_sql("r1", "o1") + r""",
o2 AS (SELECT q.email AS k, q.seq, epoch_us(q.ts) AS t, row_number() OVER (PARTITION BY q.email ORDER BY q.ts, q.seq) AS n
  FROM req q JOIN r1 ON r1.seq = q.seq WHERE r1.ok),
""" + fold_sql("r2", "o2") + r""",
funnel AS (
 SELECT q.seq, q.ts, q.ip, q.email,
  CASE WHEN q.bot THEN 'bot' WHEN NOT r1.ok THEN 'ip_limited' WHEN NOT r2.ok THEN 'email_limited'
   WHEN NOT regexp_matches(q.email, '^[^@]+@[^@]+\.[^@]+') THEN 'invalid_email'
   WHEN q.email NOT IN (SELECT email FROM users) THEN 'unknown_user' ELSE 'sent' END AS outcome,
  CASE WHEN q.bot THEN NULL WHEN NOT r1.ok THEN r1.retry // 60 WHEN NOT r2.ok THEN r2.retry // 60 END AS retry_minutes
 FROM req q LEFT JOIN r1 ON r1.seq = q.seq LEFT JOIN r2 ON r2.seq = q.seq)"""


def funnel(fx):
    return L.reset_funnel(fx.reset_requests, fx.users, MAX_REQ, WINDOW_MIN)


@register("rate_limit", "J1", ["reset_requests"], "SELECT seq, k AS ip, ok AS allowed, retry AS retry_after_s FROM r",
          ctes="o AS (SELECT ip AS k, seq, epoch_us(ts) AS t, row_number() OVER (PARTITION BY ip ORDER BY ts, seq) AS n "
               "FROM reset_requests)," + fold_sql("r", "o"), recursive=True)
def _rate_limit(fx):
    return L.rate_limit(fx.reset_requests, "ip", MAX_REQ, WINDOW_MIN).select("seq", "ip", "allowed", "retry_after_s")


@register("reset_funnel", "J2/I14", ["reset_requests", "users"], "SELECT * FROM funnel", ctes=FUNNEL_CTES, recursive=True)
def _reset_funnel(fx):
    return funnel(fx)


@register("reset_funnel_counts", "J2", ["reset_requests", "users"],
          "SELECT outcome, count(*) AS requests FROM funnel GROUP BY outcome", ctes=FUNNEL_CTES, recursive=True)
def _reset_funnel_counts(fx):
    from pyspark.sql import functions as F
    return funnel(fx).groupBy("outcome").agg(F.count("*").alias("requests"))
