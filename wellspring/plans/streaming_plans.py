"""Registered streaming queries: the live forms run with ``availableNow`` over
the driver's parquet files and must equal the batch results, so they share
the batch oracles (J1, J2, J3, J5, J6, J7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wellspring.plans.accounts_plans import ISSUES_SQL, REDEEM_SQL, _issues
from wellspring.plans.limits_plans import FUNNEL_CTES, MAX_REQ, WINDOW_MIN, fold_sql
from wellspring.plans.registry import register
from wellspring.plans.safety_plans import CHAT_CRISIS, CHAT_LIST, HOTLINE_EXPR, HOTLINES_SQL, PREFIX
from wellspring.session import shared_path
from wellspring.streaming import ordered as O
from wellspring.streaming import streams as S

# Batch oracles reused verbatim (streaming must give the batch answer).
_RATE_SQL = "SELECT seq, k AS ip, ok AS allowed, retry AS retry_after_s FROM r"
_RATE_CTES = ("o AS (SELECT ip AS k, seq, epoch_us(ts) AS t, row_number() OVER (PARTITION BY ip ORDER BY ts, seq) AS n "
              "FROM reset_requests)," + fold_sql("r", "o"))


def _events(fx):
    return S.file_stream(fx.spark, fx.tables.sf_dir, "events")


@register("stream_rate_limit", "J1 live", ["reset_requests"], _RATE_SQL, ctes=_RATE_CTES, recursive=True)
def _stream_rate_limit(fx):
    requests = fx.view("reset_requests", events=_events(fx))
    live = S.stream_rate_limit(requests, "ip", MAX_REQ, WINDOW_MIN)
    return S.run_available_now(fx.spark, live).select("seq", "ip", "allowed", "retry_after_s")


def _beaten(fx, stream):
    """The stream with a heartbeat a day after the last event, so that it answers every row."""
    return O.with_heartbeat(stream, fx.tables.table("events").agg(F.max("ts") + F.expr("INTERVAL 1 DAY")).scalar())


@register("stream_reset_funnel", "J2 live", ["reset_requests", "users"], "SELECT * FROM funnel", ctes=FUNNEL_CTES, recursive=True)
def _stream_reset_funnel(fx):
    requests = _beaten(fx, fx.view("reset_requests", events=_events(fx)))
    live = O.stream_reset_funnel(requests, fx.users, MAX_REQ, WINDOW_MIN)
    return S.run_available_now(fx.spark, live, provider=S.ROCKSDB)


@register("stream_lapsed_tokens", "J6 live", ["reset_requests", "users", "reset_redemptions"],
          "SELECT i.seq, i.user_id, i.token, i.issued_at, i.expires FROM issues i WHERE i.token NOT IN (SELECT token FROM used)",
          ctes=ISSUES_SQL + REDEEM_SQL, recursive=True)
def _stream_lapsed_tokens(fx):
    # The issue log as the batch job appends it; both logs are read as streams.
    log = shared_path(fx.spark, "issues")
    _issues(fx).write.parquet(log)
    issues = fx.spark.readStream.schema(fx.spark.read.parquet(log).schema).parquet(log)
    redemptions = _beaten(fx, fx.view("reset_redemptions", events=_events(fx)))
    return S.run_available_now(fx.spark, O.stream_lapsed_tokens(issues, redemptions), provider=S.ROCKSDB)


@register("stream_crisis_alerts", "J3 live", ["messages", "user_country"], rf"""
SELECT * FROM (SELECT m.id, m.user_id, array_to_string(list_filter({CHAT_LIST}, lambda k: contains(lower(m.message), k)), '|') AS matched,
 {HOTLINE_EXPR} AS hotline, '{PREFIX}' || {HOTLINE_EXPR} AS response
FROM messages m LEFT JOIN user_country c ON c.user_id = m.user_id
WHERE m.role = 'user') x WHERE matched <> ''
""", ctes=HOTLINES_SQL)
def _stream_crisis_alerts(fx):
    messages = fx.view("messages", events=_events(fx))
    live = S.stream_crisis_alerts(messages, fx.user_country, CHAT_CRISIS)
    return S.run_available_now(fx.spark, live.select("id", "user_id", "matched", "hotline", "response"))


@register("stream_token_totals", "J5 live", ["token_log"], """
SELECT user_id, strftime(ts, '%m%y') AS month_year, CAST(sum(total_tokens) AS BIGINT) AS tokens
FROM token_log GROUP BY user_id, strftime(ts, '%m%y')
""")
def _stream_token_totals(fx):
    orders = S.file_stream(fx.spark, fx.tables.sf_dir, "orders")
    live = S.stream_token_totals(fx.view("token_log", orders=orders))
    return S.run_available_now(fx.spark, live, mode="update", keys=["user_id", "month_year"])


@register("stream_dedup", "J7 live", ["messages"], "SELECT id, user_id, message, role, timestamp, archive, session FROM messages")
def _stream_dedup(fx):
    messages = fx.view("messages", events=_events(fx))
    redelivered = messages.filter(F.col("role") == "user")
    live = S.stream_dedup(messages.unionByName(redelivered))
    return S.run_available_now(fx.spark, live)

