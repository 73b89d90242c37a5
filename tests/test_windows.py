"""Two-level (chunked) windows equal the plain windows, hot key and nulls included."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from wellspring.functions.windows import chunked_last_value, chunked_next, chunked_row_number
from wellspring.operators import prompts as P


def _data(spark, with_nulls=False):
    rnd = random.Random(3)
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(800):
        user = 0 if i % 3 else rnd.randint(1, 20)           # user 0 holds two thirds
        t = t0 + dt.timedelta(minutes=rnd.randint(0, 60 * 24 * 5))
        if with_nulls and i % 17 == 0:
            t = None
        rows.append((i, user, t))
    return spark.createDataFrame(rows, "seq bigint, user_id bigint, ts timestamp_ntz")


def test_chunked_row_number_ascending(spark):
    df = _data(spark)
    plain = df.withColumn("p", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "seq")))
    got = chunked_row_number(df, ["user_id"], [F.col("ts"), F.col("seq")], "ts", unit="hour", name="c")
    j = plain.join(got, ["seq"]).filter(F.col("p") != F.col("c"))
    assert j.count() == 0 and got.count() == 800


def test_chunked_row_number_descending_nulls_last(spark):
    df = _data(spark, with_nulls=True)
    order = [F.col("ts").desc_nulls_last(), F.col("seq").asc()]
    plain = df.withColumn("p", F.row_number().over(Window.partitionBy("user_id").orderBy(*order)))
    got = chunked_row_number(df, ["user_id"], order, "ts", unit="day", descending=True, nulls_last=True, name="c")
    assert plain.join(got, ["seq"]).filter(F.col("p") != F.col("c")).count() == 0


def test_chunked_next_equals_lead(spark):
    df = _data(spark)
    plain = df.withColumn("p", F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "seq")))
    got = chunked_next(df, ["user_id"], "ts", "seq", "ts", unit="hour", name="c")
    bad = plain.join(got, ["seq"]).filter(~F.col("p").eqNullSafe(F.col("c")))
    assert bad.count() == 0 and got.count() == 800


def test_chunked_last_value_equals_last_ignorenulls(spark):
    df = _data(spark).withColumn("v", F.when(F.col("seq") % 7 == 0, F.col("seq").cast("string")))
    w = Window.partitionBy("user_id").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    plain = df.withColumn("p", F.last("v", ignorenulls=True).over(w))
    got = chunked_last_value(df, ["user_id"], ["ts", "seq"], "ts", "v", unit="hour", name="c")
    assert plain.join(got, ["seq"]).filter(~F.col("p").eqNullSafe(F.col("c"))).count() == 0
    assert got.count() == 800


def test_asof_mark_equals_brute_force(spark):
    from wellspring.functions.windows import asof_mark
    rnd = random.Random(5)
    rows = [(u, i) for i in range(1, 1500) for u in ([0] if i % 3 else [rnd.randint(1, 5)])]
    marks = [(u, rnd.randint(1, 1500)) for u in range(6) for _ in range(25)]
    r = spark.createDataFrame(rows, "user_id bigint, id bigint")
    m = spark.createDataFrame(marks, "user_id bigint, mark bigint")
    got = {(x["user_id"], x["id"]): x["last"] for x in
           asof_mark(r, m, ["user_id"], "id", "mark", name="last", width=100).collect()}
    want = {}
    for u, i in rows:
        cands = [v for uu, v in marks if uu == u and v <= i]
        want[(u, i)] = max(cands) if cands else None
    assert got == want


def test_summary_requests_segments_equal_range_join(spark):
    from wellspring.operators import prompts as P
    msgs = spark.createDataFrame(
        [(k, 1, "s", "user" if k % 2 else "assistant", f"m{k}") for k in range(1, 41)],
        "id bigint, user_id bigint, session string, role string, message string")
    trig = P.summary_triggers(msgs, threshold=4)
    got = sorted(tuple(r) for r in P.summary_requests(trig, msgs).filter("part = 2")
                 .select("request_id", "pos").collect())
    t = [r for r in trig.collect() if r["triggered"]]
    want = sorted((r["turn_id"], k) for r in t for k in range(1, 41) if r["checkpoint_before"] < k < r["turn_id"])
    assert len(t) > 3 and got == want


def test_chunked_windows_keep_null_keys(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from wellspring.functions import windows as W
    from wellspring.operators.tokens import token_running_total
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, None if i % 3 == 0 else f"s{i % 2}", t0 + dt.timedelta(hours=7 * i) if i % 5 else None,
                                 i if i % 4 == 0 else None) for i in range(40)],
                               "id bigint, session string, ts timestamp_ntz, v bigint")
    w = Window.partitionBy("session").orderBy(F.col("ts").asc_nulls_last(), "id")
    got = W.chunked_row_number(df, ["session"], [F.col("ts").asc_nulls_last(), F.col("id")], "ts")
    assert {r.id: r.position for r in got.collect()} == {r.id: r.p for r in df.withColumn("p", F.row_number().over(w)).collect()}
    timed = df.filter("ts is not null")
    w = Window.partitionBy("session").orderBy("ts", "id")
    got = W.chunked_next(timed, ["session"], "ts", "id", "id")
    assert {r.id: r.next_value for r in got.collect()} == {r.id: r.n for r in timed.withColumn("n", F.lead("id").over(w)).collect()}
    got = W.chunked_last_value(timed, ["session"], ["ts", "id"], "ts", "v")
    w = w.rowsBetween(Window.unboundedPreceding, 0)
    assert {r.id: r.last_value for r in got.collect()} == {
        r.id: r.x for r in timed.withColumn("x", F.last("v", ignorenulls=True).over(w)).collect()}
    log = spark.createDataFrame([(1, 1, None, 5), (2, None, t0, 7), (3, 1, None, 2), (4, 1, t0, 1)],
                                "request_id bigint, user_id bigint, ts timestamp_ntz, total_tokens bigint")
    assert sorted((r.request_id, r.running_tokens) for r in token_running_total(log).collect()) == [(1, 5), (2, 7), (3, 7), (4, 1)]


def test_parallel_summary_triggers_equal_fold(spark):
    from wellspring.operators import prompts as P
    rnd = random.Random(9)
    rows_, sums = [], []
    for sess in range(6):
        n = rnd.randint(5, 60)
        for k in range(1, n + 1):
            role = rnd.choice(["user", "user", "assistant", "system"])
            rows_.append((sess * 1000 + k, sess % 2, f"s{sess}", role, "m"))
        if sess % 3 == 0:
            sums.append((sess % 2, f"s{sess}", "x", sess * 1000 + rnd.randint(1, 10)))
    msgs = spark.createDataFrame(rows_, "id bigint, user_id bigint, session string, role string, message string")
    summ = spark.createDataFrame(sums, "user_id bigint, session string, summary string, last_message_id bigint")
    for t in (3, 4, 7):
        fold = P.summary_triggers(msgs, summ, threshold=t)
        par = P.summary_triggers_parallel(msgs, summ, threshold=t)
        cols = fold.columns
        a = sorted(tuple(r) for r in fold.select(*cols).collect())
        b = sorted(tuple(r) for r in par.select(*cols).collect())
        assert a == b, t


def test_hot_session_split_equals_fold(spark):
    from wellspring.operators import prompts as P
    rows_ = [(k, 1, "hot", "user" if k % 2 else "assistant", "m") for k in range(1, 120)] + \
            [(1000 + k, 2, "cold", "user" if k % 3 else "assistant", "m") for k in range(1, 20)]
    msgs = spark.createDataFrame(rows_, "id bigint, user_id bigint, session string, role string, message string")
    a = sorted(tuple(r) for r in P.summary_triggers(msgs, threshold=5).collect())
    b = sorted(tuple(r) for r in P.summary_triggers_parallel(msgs, threshold=5).collect())
    assert a == b and len(a) > 60


def test_summary_triggers_and_requests_of_null_sessions(spark):
    from wellspring.operators import prompts as P
    rows_ = [(k, 1, None if k % 3 else "s", "user" if k % 2 else "assistant", f"m{k}") for k in range(1, 90)] + \
            [(100 + k, 2, None, "user" if k % 4 else "assistant", "m") for k in range(1, 30)]
    msgs = spark.createDataFrame(rows_, "id bigint, user_id bigint, session string, role string, message string")
    summ = spark.createDataFrame([(1, None, "so far", 7), (1, "s", "x", 9)],
                                 "user_id bigint, session string, summary string, last_message_id bigint")
    named = lambda df: df.fillna("none", ["session"])
    for sm in (None, summ):
        fold = P.summary_triggers(msgs, sm, threshold=4)
        want = sorted(tuple(r) for r in P.summary_triggers(named(msgs), sm and named(sm), threshold=4).collect())
        for df in (fold, P.summary_triggers_parallel(msgs, sm, threshold=4)):
            assert sorted(tuple(r) for r in named(df).collect()) == want
        assert {r.session for r in fold.filter("triggered").collect()} == {None, "s"}
        for mode in ("max_id", "count"):
            trig = P.summary_triggers(msgs, sm, threshold=4, mode=mode)
            got = P.summary_requests(trig, msgs, sm, mode=mode)
            want_req = P.summary_requests(named(trig), named(msgs), sm and named(sm), mode=mode)
            assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want_req.collect())


def test_chunked_rank_in_dst_gap_with_local_session_zone(spark):
    # 02:30 does not exist on 2024-03-10 in New York; wall-clock order must hold anyway.
    df = spark.createDataFrame([(1, 0, dt.datetime(2024, 3, 10, 2, 30)), (2, 0, dt.datetime(2024, 3, 10, 3, 10)),
                                (3, 0, dt.datetime(2024, 3, 10, 1, 50))], "seq bigint, user_id bigint, ts timestamp_ntz")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = {r["seq"]: r["c"] for r in chunked_row_number(df, ["user_id"], [F.col("ts")], "ts", unit="hour",
                                                             name="c").collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == {3: 1, 1: 2, 2: 3}


def _plain_triggers(ids, roles, threshold, mode, checkpoint):
    out, kept, last = [], [], 0
    for i, role in zip(ids, roles):
        if role == "user":
            recent, before = len(kept), checkpoint
            if recent >= threshold:
                checkpoint = last if mode == "max_id" else checkpoint + recent
                kept = [x for x in kept if x > checkpoint]
            out.append((i, recent, recent >= threshold, before, checkpoint))
        if i > checkpoint:
            kept.append(i)
        last = i
    return out


def test_trigger_run_equals_the_message_by_message_fold():
    rnd = random.Random(12)
    for trial in range(400):
        mode, threshold = rnd.choice(["max_id", "count"]), rnd.randint(1, 6)
        ids = sorted(rnd.sample(range(1, rnd.choice([60, 400])), rnd.randint(1, 50)))
        roles = [rnd.choice(["user", "assistant"]) for _ in ids]
        c0 = rnd.choice([0, 0, ids[len(ids) // 2], 10_000])
        run, got, at = P.TriggerRun(threshold, mode, c0), [], 0
        while at < len(ids):
            n = rnd.randint(1, 9)
            part, user = np.array(ids[at:at + n]), np.array([r == "user" for r in roles[at:at + n]])
            recent, fired, before, after = run.turns(part, user)
            got += list(zip(part[user].tolist(), recent.tolist(), fired.tolist(), before.tolist(), after.tolist()))
            at += n
        assert got == _plain_triggers(ids, roles, threshold, mode, c0), trial


def test_count_mode_requests_hold_their_windows_only(spark):
    """Overlapping windows over a long session: each body row lies in its trigger's window."""
    rnd = random.Random(3)
    data = [(i, 1, f"m{i}", rnd.choice(["user", "assistant", "system"]), None, False, rnd.choice(["s", "s", None])) for i in range(1, 400)]
    msgs = spark.createDataFrame(data, "id bigint, user_id bigint, message string, role string, timestamp timestamp_ntz, archive boolean, session string")
    trig = P.summary_triggers(msgs, threshold=5, mode="count")
    got = sorted((r.request_id, r.pos) for r in P.summary_requests(trig, msgs, mode="count").filter("part = 2").collect())
    want = sorted((t.turn_id, d[0]) for t in trig.filter("triggered").collect() for d in data
                  if d[6] == t.session and d[3] != "system" and t.checkpoint_before < d[0] < t.turn_id)
    assert got == want and len(want) > 500


def test_chat_requests_of_null_sessions(spark):
    """A null session has its summary and history like any other."""
    turns = [(10 * k, 1, "s", "CBT", f"t{k}") for k in range(1, 6)]
    msgs = [(i, 1, f"m{i}", "user" if i % 2 else "assistant", None, False, "s") for i in range(1, 60)]
    sums = [(1, "s", "first", 5), (1, "s", "second", 25)]
    T = "request_id bigint, user_id bigint, session string, persona string, user_input string"
    M = "id bigint, user_id bigint, message string, role string, timestamp timestamp_ntz, archive boolean, session string"
    S = "user_id bigint, session string, summary string, last_message_id bigint"
    types = spark.createDataFrame([("CBT", "be kind")], "persona string, prompt string")
    got = []
    for name in ("s", None):
        named = lambda rows_, at: [tuple(name if k == at else v for k, v in enumerate(r)) for r in rows_]  # noqa: B023, E731
        df = P.chat_requests(spark.createDataFrame(named(turns, 2), T), spark.createDataFrame(named(msgs, 6), M),
                             spark.createDataFrame(named(sums, 1), S), types)
        got.append(sorted(tuple(r) for r in df.collect()))
    assert got[0] == got[1] and len(got[0]) > 30
