"""Account traps: reset-token expiry (T25), single use, signup fan-out (T14), verification."""

from conftest import rows, ts

from wellspring.operators import accounts as A


def _issues(spark):
    return spark.createDataFrame([
        (1, 7, "t1", ts("2024-01-01 10:00:00"), ts("2024-01-01 11:00:00")),
        (2, 7, "t2", ts("2024-01-01 10:30:00"), ts("2024-01-01 11:30:00")),
        (3, 8, "t3", ts("2024-01-01 10:00:00"), ts("2024-01-01 11:00:00")),
    ], "seq bigint, user_id bigint, token string, issued_at timestamp_ntz, expires timestamp_ntz")


def test_redeem_newest_unused_strictly_before_expiry(spark):
    red = spark.createDataFrame([
        (10, ts("2024-01-01 10:40:00"), "t1"),   # superseded by t2
        (11, ts("2024-01-01 10:45:00"), "t2"),   # ok
        (12, ts("2024-01-01 10:50:00"), "t2"),   # already used
        (13, ts("2024-01-01 11:00:00"), "t3"),   # exactly at expiry: refused
        (14, ts("2024-01-01 10:00:00"), "zz"),   # unknown
    ], "seq bigint, ts timestamp_ntz, token string")
    got = {r["seq"]: r["redeemed"] for r in A.reset_redeem(_issues(spark), red).collect()}
    assert got == {10: False, 11: True, 12: False, 13: False, 14: False}


def test_cleanup_keeps_token_expiring_exactly_now(spark):
    state = A.reset_state(_issues(spark))
    cleaned, count = A.reset_cleanup(state, "2024-01-01 11:00:00")
    assert count.collect()[0]["affected"] == 0
    cleaned, count = A.reset_cleanup(state, "2024-01-01 11:00:01")
    assert count.collect()[0]["affected"] == 1   # user 8 (t3); user 7 holds t2 until 11:30
    assert rows(cleaned.filter("reset_token IS NULL"), "user_id") == [(8,)]


def test_redeemed_token_is_cleared_and_time_beats_number(spark):
    red = spark.createDataFrame([
        (21, ts("2024-01-01 10:40:00"), "t2"),   # later, although numbered first
        (22, ts("2024-01-01 10:35:00"), "t2"),
    ], "seq bigint, ts timestamp_ntz, token string")
    done = A.reset_redeem(_issues(spark), red)
    assert {r["seq"]: r["redeemed"] for r in done.collect()} == {21: False, 22: True}
    state = A.reset_state(_issues(spark), done)
    _, count = A.reset_cleanup(state, "2024-01-02 00:00:00")
    assert count.collect()[0]["affected"] == 1   # t3; t2 was cleared on redemption


def test_renames_run_in_order(spark):
    from wellspring.operators import cascade as C
    sessions = spark.createDataFrame([(1, n) for n in "abcde"], "user_id bigint, session_name string")
    messages = spark.createDataFrame([(1, n) for n in ["a", "b", "c", "d", "e", "gone", None]], "user_id bigint, session string")
    todo = [(1, "a", "x"), (2, "b", "x"), (3, "a", "y"), (4, "c", "c"), (5, "x", "z"), (6, "b", "x"), (7, "d", "e"), (8, "gone", "w")]
    renames = spark.createDataFrame([(k, 1, o, n) for k, o, n in todo], "seq bigint, user_id bigint, old_name string, new_name string")
    out = C.rename_cascade(sessions, messages, messages, renames)
    assert sorted(r.session_name for r in out["sessions"].collect()) == ["c", "d", "e", "x", "z"]
    assert sorted((r.session or "") for r in out["messages"].collect()) == ["", "c", "d", "e", "w", "x", "z"]
    assert sorted(r.seq for r in out["rejects"].collect()) == [2, 7]


def test_renames_of_a_hot_user_equal_a_replay_and_spread_over_tasks(spark):
    import random

    from wellspring.operators import cascade as C
    rnd = random.Random(4)
    todo, have = [], []
    for g in range(60):  # groups of names that share nothing; user 1 holds most
        user, names = (1 if g < 50 else g), [f"g{g}-{k}" for k in range(5)]
        have += [(user, n) for n in names if rnd.random() < 0.5]
        todo += [(user, rnd.choice(names), rnd.choice(names)) for _ in range(rnd.randint(1, 12))]
    rnd.shuffle(todo)
    todo = [(k, *x) for k, x in enumerate(todo)]
    exists, now, bad = set(have), {(u, n): {n} for _, u, *o in todo for n in o}, set()
    for seq, u, old, new in todo:
        if old == new:
            continue
        if (u, old) in exists and (u, new) in exists:
            bad.add(seq)
            continue
        if (u, old) in exists:
            exists ^= {(u, old), (u, new)}
        moved = now.pop((u, old), set())
        now.setdefault((u, new), set()).update(moved)
    labels = sorted({(u, n) for _, u, *o in todo for n in o})
    ends = {(u, first): n for (u, n), firsts in now.items() for first in firsts}
    sessions = spark.createDataFrame(have, "user_id bigint, session_name string")
    messages = spark.createDataFrame([(*x, x[1]) for x in labels], "user_id bigint, session string, first string")
    renames = spark.createDataFrame(todo, "seq bigint, user_id bigint, old_name string, new_name string")
    keys = {"spark.sql.execution.arrow.maxRecordsPerBatch": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        out = C.rename_cascade(sessions, messages, messages, renames)
        assert {(r.user_id, r.first): r.session for r in out["messages"].collect()} == {x: ends[x] for x in labels}
        assert sorted((r.user_id, r.session_name) for r in out["sessions"].collect()) == sorted(exists)
        rejects = out["rejects"].selectExpr("seq", "user_id", "spark_partition_id() as task").collect()
        assert sorted(r.seq for r in rejects) == sorted(bad) and len(bad) > 20
        assert len({r.task for r in rejects if r.user_id == 1}) > 1
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_signup_makes_two_subscriptions_and_six_settings(spark):
    users = spark.createDataFrame([(1, "old@x.com")], "id bigint, email string")
    signups = spark.createDataFrame([
        (5, ts("2024-01-01 00:00:00"), "ann", "Ann@X.com", "h", "basic", "tok", None),
        (6, ts("2024-01-01 00:00:01"), "ann2", "ann@x.com", "h", "premium", "tok2", None),   # same address
        (7, ts("2024-01-01 00:00:02"), "old", "OLD@x.com", "h", "basic", "tok3", None),      # registered
        (8, ts("2024-01-01 00:00:03"), "bot", "b@x.com", "h", "basic", "tok4", "bot_value"),
        (9, ts("2024-01-01 00:00:04"), "b", "b@x.com", "h", "gold", "tok5", None),          # bad plan
    ], "seq bigint, ts timestamp_ntz, username string, email string, password string, plan string, "
       "email_token string, nickname string")
    out = A.signup_fanout(signups, users)
    assert {r["seq"]: r["outcome"] for r in out["outcomes"].collect()} == {
        5: "created", 6: "email_registered", 7: "email_registered", 8: "bot", 9: "invalid_plan"}
    subs = rows(out["subscriptions"], "user_id", "n", "plan_type", "is_active")
    assert subs == [(6, 1, "basic", False), (6, 2, "basic", True)]
    assert out["settings"].count() == 6


def test_verification_link_clicked_twice(spark):
    users = spark.createDataFrame([(1, "a@x", False, "tok"), (2, "b@x", True, None)],
                                  "id bigint, email string, verified boolean, email_token string")
    clicks = spark.createDataFrame([(1, ts("2024-01-01 00:00:00"), "tok"), (2, ts("2024-01-01 00:01:00"), "tok")],
                                   "seq bigint, ts timestamp_ntz, token string")
    out = A.verify_merge(users, clicks)
    assert {r["seq"]: r["outcome"] for r in out["outcomes"].collect()} == {1: "verified", 2: "unknown"}
    assert rows(out["users"], "id", "verified", "email_token") == [(1, True, None), (2, True, None)]


def test_subscription_history_one_active(spark):
    log = spark.createDataFrame([(1, 1, "basic", ts("2024-01-01 00:00:00")),
                                 (2, 1, "premium", ts("2024-01-02 00:00:00"))],
                                "seq bigint, user_id bigint, plan_type string, ts timestamp_ntz")
    got = rows(A.subscription_history(log), "plan_type", "billing_cycle", "is_active", "updated_at")
    assert got == [("basic", None, False, ts("2024-01-02 00:00:00")),
                   ("premium", "monthly", True, ts("2024-01-02 00:00:00"))]
