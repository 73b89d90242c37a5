"""J2 and J6 live: several micro-batches, rows out of order, late rows, silent sources."""

import datetime as dt
import os
import random
import tempfile

import pandas as pd
import pytest
from conftest import rows, ts
from pyspark.sql import functions as F

from wellspring.operators import accounts as A
from wellspring.operators import limits as L
from wellspring.streaming import ordered as O
from wellspring.streaming import streams as S

REQ = "seq bigint, ts timestamp_ntz, ip string, email_raw string, nickname string"
ISSUE = "seq bigint, user_id bigint, token string, issued_at timestamp_ntz, expires timestamp_ntz"
RED = "seq bigint, ts timestamp_ntz, token string"
T0 = dt.datetime(2024, 1, 1)


def stream_of(spark, parts, schema, per_trigger=1):
    """A file stream that brings each list of rows as a file, in that order."""
    base = tempfile.mkdtemp(prefix="ws-ordered-", dir="/tmp")
    for k, part in enumerate(parts):
        folder = f"{base}/f{k}"
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(folder)
        for f in os.listdir(folder):  # file streams go by modification time
            os.utime(f"{folder}/{f}", (1_700_000_000 + 10 * k,) * 2)
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", "true").parquet(base))


def requests(n, seed, minutes=600):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        raw = rnd.choice([f"  User{rnd.randint(0, 6)}@X.com ", "bad-address", None, "ghost@x.com"])
        ip = rnd.choice(["hot", "hot", "hot", f"ip{rnd.randint(0, 3)}", None])
        out.append((i, T0 + dt.timedelta(minutes=rnd.randint(0, minutes), seconds=rnd.choice([0, 0, 30]), microseconds=rnd.choice([0, 1])), ip, raw,
                    rnd.choice([None, None, "", "bot_value"])))
    return out


def dealt(rows_, delay_minutes, files, seed):
    """Rows in the order in which they arrive, each up to ``delay_minutes`` after its time, cut into files."""
    rnd = random.Random(seed)
    arriving = sorted(rows_, key=lambda r: (r[1] + dt.timedelta(minutes=rnd.uniform(0, delay_minutes)), r[0]))
    size = -(-len(rows_) // files)
    return [arriving[a:a + size] for a in range(0, len(rows_), size)]


@pytest.fixture
def users(spark):
    return spark.createDataFrame([(f"user{i}@x.com",) for i in range(5)], "email string")


def live_funnel(spark, parts, users, **how):
    stream = O.with_heartbeat(stream_of(spark, parts, REQ), "2024-02-01 00:00:00")
    return S.run_available_now(spark, O.stream_reset_funnel(stream, users, 3, 15, **how), provider=S.ROCKSDB)


def test_live_funnel_equals_the_batch_for_rows_out_of_order(spark, users):
    data = requests(400, 1)
    parts = dealt(data, 55, 5, 2)
    assert any(a[1] > b[1] for p, q in zip(parts, parts[1:]) for a in p for b in q)  # order is mixed across files
    # The heartbeat's file comes with the first trigger: a second stream would wait, so the data leads here.
    stream = stream_of(spark, parts, REQ)
    got = S.run_available_now(spark, O.stream_reset_funnel(stream, users, 3, 15, watermark="60 minutes"), provider=S.ROCKSDB)
    want = L.reset_funnel(spark.createDataFrame(data, REQ), users, 3, 15)
    found = {r["seq"]: tuple(r) for r in got.select(*want.columns).collect()}
    # Without heartbeats what is newer than the watermark still waits; all else is answered as in the batch.
    until = max(r[1] for r in data) - dt.timedelta(minutes=60)
    for r in want.collect():
        if r["seq"] in found:
            assert found[r["seq"]] == tuple(r)
        else:
            assert r["ts"] > until
    assert len(found) > 300


def test_heartbeats_release_what_waits(spark, users):
    data = requests(150, 3)
    got = live_funnel(spark, [data], users)
    want = L.reset_funnel(spark.createDataFrame(data, REQ), users, 3, 15)
    assert rows(got, *want.columns) == rows(want, *want.columns)


def test_late_requests_are_dropped_and_found(spark, users):
    """A row behind the watermark uses no quota; the batch rerun of the rest agrees."""
    early = [(i, T0 + dt.timedelta(minutes=i), "a", "user1@x.com", None) for i in range(6)]
    later = [(100 + i, T0 + dt.timedelta(hours=3, minutes=i), "a", "user1@x.com", None) for i in range(6)]
    passing = [(150, T0 + dt.timedelta(hours=6), "z", "ghost@x.com", None)]  # a further batch: late is what the last watermark passed
    late = [(200, T0 + dt.timedelta(minutes=2, seconds=1), "a", "user1@x.com", None)]
    end = [(300, T0 + dt.timedelta(hours=9), "z", "ghost@x.com", None), (301, T0 + dt.timedelta(hours=10), "z", "ghost@x.com", None)]
    stream = stream_of(spark, [early, later, passing, late + end], REQ)
    got = S.run_available_now(spark, O.stream_reset_funnel(stream, users, 3, 15, watermark="10 minutes"), provider=S.ROCKSDB)
    batch = spark.createDataFrame(early + later + passing + late + end, REQ)
    missing = S.late_rows(batch, got, ["seq"])
    assert rows(missing, "seq") == [(200,), (301,)]  # late; still within the watermark
    on_time = L.reset_funnel(spark.createDataFrame(early + later + passing + end, REQ), users, 3, 15).filter("seq <> 301")
    assert rows(got, *on_time.columns) == rows(on_time, *on_time.columns)


def tokens(seed, n=60):
    rnd = random.Random(seed)
    issues = []
    for i in range(n):
        at = T0 + dt.timedelta(minutes=rnd.randint(0, 400))
        issues.append((i, rnd.randint(1, 8), f"t{i}", at, at + dt.timedelta(hours=1)))
    reds = []
    for j in range(2 * n):
        i = rnd.randint(0, n - 1)
        shift = rnd.choice([0, 1, 30, 59, 60, 61, 90, -5])  # on issue, in time, at expiry (strict), after it, before issue
        reds.append((1000 + j, issues[i][3] + dt.timedelta(minutes=shift), rnd.choice([f"t{i}", f"t{i}", f"t{i}", "unknown"])))
    return issues, reds


@pytest.mark.parametrize("seed", [1, 2])
def test_live_lapsed_tokens_equal_the_batch(spark, seed):
    issues, reds = tokens(seed)
    i = stream_of(spark, dealt([(s, a, u, t, e) for s, u, t, a, e in issues], 0, 3, 4),
                  "seq bigint, issued_at timestamp_ntz, user_id bigint, token string, expires timestamp_ntz", 3)
    r = O.with_heartbeat(stream_of(spark, dealt(reds, 20, 3, 5), RED, 3), "2024-02-01 00:00:00")
    got = S.run_available_now(spark, O.stream_lapsed_tokens(i, r, watermark="30 minutes"), provider=S.ROCKSDB)
    bi, br = spark.createDataFrame(issues, ISSUE), spark.createDataFrame(reds, RED)
    redeemed = A.reset_redeem(bi, br)
    want = A.lapsed_tokens(bi, redeemed, "2024-02-01 00:00:00")
    assert 0 < redeemed.filter("redeemed").count() < len(issues)
    assert rows(got, *want.columns) == rows(want, *want.columns)


def test_superseded_and_strictly_expired_tokens_lapse(spark):
    hour = dt.timedelta(hours=1)
    issues = [(1, 7, "old", T0, T0 + hour), (2, 7, "new", T0 + hour / 2, T0 + 3 * hour / 2), (3, 8, "edge", T0, T0 + hour), (4, 9, "used", T0, T0 + hour)]
    reds = [(10, T0 + dt.timedelta(minutes=40), "old"), (11, T0 + hour, "edge"), (12, T0 + hour - dt.timedelta(microseconds=1), "used"),
            (13, T0 + hour - dt.timedelta(microseconds=1), "used")]
    i = stream_of(spark, [issues], ISSUE)
    r = O.with_heartbeat(stream_of(spark, [reds], RED), "2024-01-02 00:00:00")
    got = S.run_available_now(spark, O.stream_lapsed_tokens(i, r), provider=S.ROCKSDB)
    assert rows(got, "token", "expires") == [("edge", ts("2024-01-01 01:00:00")), ("new", ts("2024-01-01 01:30:00")), ("old", ts("2024-01-01 01:00:00"))]


def test_live_funnel_is_independent_of_the_session_time_zone(spark, users):
    data = [(1, dt.datetime(2024, 3, 10, 1, 50), "k", "user1@x.com", None), (2, dt.datetime(2024, 3, 10, 3, 2), "k", "user1@x.com", None)]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        stream = O.with_heartbeat(stream_of(spark, [data], REQ), "2024-03-20 00:00:00")
        got = S.run_available_now(spark, O.stream_reset_funnel(stream, users, 1, 60), provider=S.ROCKSDB)
        assert rows(got, "seq", "ts", "outcome") == [(1, data[0][1], "sent"), (2, data[1][1], "sent")]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_state_store_of_the_session_stays(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stream = spark.readStream.schema(RED).parquet(tempfile.mkdtemp(prefix="ws-ordered-", dir="/tmp"))
    assert S.run_available_now(spark, stream.filter(F.col("seq") > 0), provider=S.ROCKSDB).count() == 0
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


class Handle:
    """State of one bucket in plain objects; ``ops`` counts the writes and timers."""

    def __init__(self):
        self.ops, self.timers, self.kept = 0, [], {}

    def registerTimer(self, ms):  # noqa: N802 - Spark's name
        self.ops += 1
        self.timers.append(ms)

    def state(self, name, empty):
        handle, kept = self, self.kept

        class State:
            def exists(self):
                return bool(kept.get(name))

            def get(self):
                return iter(kept[name]) if empty is list else kept[name]

            def clear(self):
                kept.pop(name, None)

            def update(self, value):
                handle.ops += 1
                kept[name] = value

            def put(self, values):
                handle.ops += len(values)
                kept[name] = list(values)

            def appendList(self, values):  # noqa: N802
                handle.ops += len(values)
                kept.setdefault(name, []).extend(values)

            def appendValue(self, value):  # noqa: N802
                self.appendList([value])

            def keys(self):
                return iter(list(kept.get(name, {})))

            def getValue(self, key):  # noqa: N802
                return kept[name][key]

            def updateValue(self, key, value):  # noqa: N802
                handle.ops += 1
                kept.setdefault(name, {})[key] = value

            def removeKey(self, key):  # noqa: N802
                del kept[name][key]
        return State()

    def getMapState(self, name, key, value):  # noqa: N802
        return self.state(name, dict)

    def getListState(self, name, value):  # noqa: N802
        return self.state(name, list)

    def getValueState(self, name, value):  # noqa: N802
        return self.state(name, tuple)


class Timers:
    def __init__(self, now_us):
        self.now_us = now_us

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.now_us // 1000


def test_state_operations_do_not_grow_with_the_keys():
    """A call takes up a bucket's many IPs, addresses or users: a few packed values, not one or more a key."""
    handle, n = Handle(), 3000
    first = O.IpLimit(1, 60_000_000)
    first.init(handle)
    asked = pd.DataFrame({"seq": range(n), "t": [(n - i) * 1000 for i in range(n)], "ip": [f"ip{i % 1000}" for i in range(n)],
                          "email": [f"user{i}@x.com" for i in range(n)], "bot": False})
    assert list(first.handleInputRows((0,), iter([asked[:1000], asked[1000:]]), Timers(0))) == []
    out = pd.concat(first.handleExpiredTimer((0,), Timers(10_000_000_000), None))
    assert handle.ops <= 6 and sorted(out["seq"]) == list(range(n))
    assert set(out[out["ip_ok"].astype(bool)]["seq"]) == set(range(2000, 3000))  # the earliest of each IP

    handle = Handle()
    second = O.EmailLimit(1, 60_000_000)
    second.init(handle)
    assert pd.concat(second.handleInputRows((0,), iter([out]), Timers(0)))["email_ok"].sum() == 1000
    assert handle.ops <= 2

    handle = Handle()
    lapse = O.TokenLapse()
    lapse.init(handle)
    issues = pd.DataFrame({"kind": 0, "seq": range(n), "t": range(n), "token": [f"t{i}" for i in range(n)], "user_id": range(n), "expires": 5_000_000})
    used = issues[:10].assign(kind=1, t=4_000_000)
    list(lapse.handleInputRows((0,), iter([issues, used]), Timers(0)))
    assert list(lapse.handleExpiredTimer((0,), Timers(4_500_000), None)) == []
    gone = pd.concat(lapse.handleExpiredTimer((0,), Timers(5_000_000), None))
    assert sorted(gone["seq"]) == list(range(10, n)) and handle.ops <= 8 and "open" not in handle.kept


def test_waiting_rows_come_in_order_and_in_parts(monkeypatch):
    """Pieces that overlap in time are merged; a bucket's rows are never held all at once."""
    monkeypatch.setattr(O, "SORT_ROWS", 50)
    monkeypatch.setattr(O, "PIECE_ROWS", 10)
    rnd, handle = random.Random(5), Handle()
    waiting = O.IpLimit(3, 1)
    waiting.init(handle)
    data = [(rnd.randint(0, 500), i) for i in range(1000)]
    frames = [pd.DataFrame([(t, s, "a", None) for t, s in data[a:a + 40]], columns=["t", "seq", "ip", "email"]) for a in range(0, 1000, 40)]
    waiting.wait(O._gathered(frames))
    parts = [list(zip(p.column("t").to_pylist(), p.column("seq").to_pylist())) for p in waiting.due(300)]
    later = [list(zip(p.column("t").to_pylist(), p.column("seq").to_pylist())) for p in waiting.due(1000)]
    assert sum(parts, []) == sorted(r for r in data if r[0] <= 300) and sum(later, []) == sorted(r for r in data if r[0] > 300)
    assert len(parts) > 1 and max(map(len, parts + later)) < 500 and not handle.kept.get("pending")
