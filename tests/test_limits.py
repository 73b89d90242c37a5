"""Limiter traps (T22-T24) and fold = plain sequential replay across Arrow batch edges."""

import datetime as dt
import random
from collections import deque

from conftest import ts

from wellspring.operators import limits as L

REQ = "seq bigint, ts timestamp_ntz, ip string"


def test_exactly_one_window_later_still_counts_and_denials_are_free(spark):
    t0 = dt.datetime(2024, 1, 1)
    w = dt.timedelta(minutes=15)
    data = [(1, t0, "a"), (2, t0 + dt.timedelta(minutes=1), "a"), (3, t0 + dt.timedelta(minutes=2), "a"),
            (4, t0 + dt.timedelta(minutes=3), "a"),          # denied: 3 allowed in window
            (5, t0 + w, "a"),                                # exactly one window after #1: #1 still counts
            (6, t0 + w + dt.timedelta(microseconds=1), "a")]  # #1 evicted now; the denial #4 never counted
    out = L.rate_limit(spark.createDataFrame(data, REQ), "ip", 3, 15)
    got = {r["seq"]: (r["allowed"], r["retry_after_s"]) for r in out.collect()}
    assert [got[i][0] for i in range(1, 7)] == [True, True, True, False, False, True]
    assert got[4][1] == 12 * 60          # 15 min window - 3 min elapsed since #1
    assert got[5][1] == 0


def _plain(reqs, max_requests, window_us):
    state, out = {}, {}
    for seq, t, key in sorted(reqs, key=lambda r: (r[2], r[1], r[0])):
        q = state.setdefault(key, deque())
        tu = int(t.timestamp() * 1_000_000)
        while q and tu - q[0] > window_us:
            q.popleft()
        if len(q) >= max_requests:
            out[seq] = False
        else:
            q.append(tu)
            out[seq] = True
    return out


def test_fold_matches_plain_replay_with_tiny_arrow_batches(spark):
    rnd = random.Random(7)
    t0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    reqs = [(i, (t0 + dt.timedelta(seconds=rnd.randint(0, 7200))).replace(tzinfo=None),
             rnd.choice(["hot", "hot", "hot", "b", "c"])) for i in range(600)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = L.rate_limit(spark.createDataFrame(reqs, REQ), "ip", 3, 10)
        got = {r["seq"]: r["allowed"] for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = _plain([(s, t.replace(tzinfo=dt.timezone.utc), k) for s, t, k in reqs], 3, 10 * 60 * 1_000_000)
    assert got == want


def test_funnel_order_bot_ip_email_pattern_user(spark):
    t0 = ts("2024-01-01 00:00:00")
    reqs = spark.createDataFrame([
        (1, t0, "1.1.1.1", " A@x.com ", "bot_value"),
        (2, t0, "1.1.1.1", "a@x.com", None),
        (3, t0, "1.1.1.1", "a@x.com", None),
        (4, t0, "1.1.1.1", "bad-address", None),
        (5, t0, "1.1.1.1", "a@x.com", None),              # IP quota used by #2-#4
        (6, t0, "2.2.2.2", "A@X.com", None),              # email quota: #2, #3 only (2 allowed)
        (7, t0, "2.2.2.2", "ghost@x.com", None),
    ], "seq bigint, ts timestamp_ntz, ip string, email_raw string, nickname string")
    users = spark.createDataFrame([("a@x.com",)], "email string")
    out = {r["seq"]: r["outcome"] for r in L.reset_funnel(reqs, users, 3, 15).collect()}
    assert out == {1: "bot", 2: "sent", 3: "sent", 4: "invalid_email", 5: "ip_limited",
                   6: "sent", 7: "unknown_user"}


def _requests(seed, n, seconds, start=dt.datetime(2024, 1, 1)):
    rnd = random.Random(seed)
    return [(i, start + dt.timedelta(seconds=rnd.choice([rnd.randint(0, seconds), rnd.randint(0, 60)])), "hot") for i in range(n)]


def test_saturated_and_bursty_keys_equal_the_plain_replay(spark):
    # Continuous traffic without an idle window, bursts with gaps, many requests at one time, few requests.
    saturated = _requests(1, 1500, 6 * 3600)
    bursts = [(2000 + 50 * b + i, dt.datetime(2024, 2, 1) + dt.timedelta(hours=3 * b, seconds=17 * i % 1200), "burst")
              for b in range(12) for i in range(25)]
    at_once = [(5000 + i, dt.datetime(2024, 3, 1, 0, 0, i // 40), "at once") for i in range(200)]
    few = [(6000 + i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=20 * i), None) for i in range(9)]
    reqs = saturated + bursts + at_once + few
    df = spark.createDataFrame(reqs, REQ)
    for limit, minutes in ((3, 60), (1, 15), (7, 5)):
        got = {r["seq"]: r["allowed"] for r in L.rate_limit(df, "ip", limit, minutes).collect()}
        assert got == _plain([(s, t.replace(tzinfo=dt.timezone.utc), k or "") for s, t, k in reqs], limit, minutes * 60 * 1_000_000)


def test_retry_seconds_equal_the_plain_replay(spark):
    reqs = _requests(5, 400, 4 * 3600)
    got = {r["seq"]: r["retry_after_s"] for r in L.rate_limit(spark.createDataFrame(reqs, REQ), "ip", 3, 30).collect()}
    log, want = L.SlidingLog(3, 30 * 60 * 1_000_000), {}
    for seq, t, _ in sorted(reqs, key=lambda r: (r[1], r[0])):
        want[seq] = log.offer(int(t.replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000))
    assert got == want and any(want.values())


def test_a_hot_keys_requests_are_judged_by_many_tasks(spark):
    """Rows go by (key, chunk) only; no exchange of rows is by the key alone."""
    df = L.rate_limit(spark.createDataFrame(_requests(2, 50, 3600), REQ), "ip", 3, 60)
    plan = df._jdf.queryExecution().executedPlan().toString()
    by_key = [line for line in plan.splitlines() if "hashpartitioning(ip#" in line and "_c#" not in line]
    assert len(by_key) == 1 and "REPARTITION_BY_COL" in by_key[0]  # the packed chunks


def test_requests_without_a_time_are_not_judged(spark):
    got = L.rate_limit(spark.createDataFrame([(1, None, "a"), (2, dt.datetime(2024, 1, 1), "a")], REQ), "ip", 1, 1).collect()
    assert {r["seq"]: (r["allowed"], r["retry_after_s"]) for r in got} == {1: (None, None), 2: (True, None)}


def test_limiter_is_independent_of_session_time_zone(spark):
    # 01:30 and 03:10 on the US DST change day: 100 wall-clock minutes apart
    # (what the data and the oracle say), only 40 real minutes in New York time.
    reqs = spark.createDataFrame([(1, dt.datetime(2024, 3, 10, 1, 30), "k"), (2, dt.datetime(2024, 3, 10, 3, 10), "k")],
                                 REQ)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = {r["seq"]: r["allowed"] for r in L.rate_limit(reqs, "ip", 1, 60).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == {1: True, 2: True}
