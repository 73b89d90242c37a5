"""Live operators whose answer depends on the order of events (J2 funnel, J6 lapsed tokens).

Micro-batches bring rows in any order, so a first stage keeps what arrives in
state until the watermark passes it and then takes it up in (time, seq)
order; nothing older can come any more (Spark drops it as late, and
:func:`wellspring.streaming.streams.late_rows` finds it).  A second stage, by
another key, gets the first one's rows in the batch whose watermark released
them: all of them lie between two watermarks, so sorting a batch's rows is
enough there.  Both stages run in one query.  Answers equal the batch forms
for every row up to the watermark; a source that falls silent is moved on by
heartbeats (:func:`with_heartbeat`), as no watermark moves without rows.

Both stages group by buckets of keys (``BUCKETS``, by hash): a call, a timer and
a state operation cost some hundred times what a row costs, so a bucket's many
keys share them.  Rows wait packed as Arrow, in pieces sorted by time, and are
released as far as no unread piece begins earlier, so a task never holds all
rows of a bucket that has many.

Times are microseconds of the wall clock, read as UTC for the watermark.
State lives in RocksDB (``transformWithStateInPandas`` needs it) and ends with
event-time timers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from wellspring.fixed_values import RESET_MAX_REQUESTS, RESET_WINDOW_MINUTES
from wellspring.functions.dates import epoch_micros
from wellspring.functions.text import normalise_email
from wellspring.operators.limits import SlidingLog, funnel_outcomes
from wellspring.session import shared_path

#: Buckets of keys that a stage groups by.
BUCKETS = 512
#: Rows sorted at a time, and rows of a piece of them that waits in state.
SORT_ROWS, PIECE_ROWS = 100_000, 20_000
#: ``seq`` of a heartbeat.
BEAT = -1


def with_heartbeat(rows: DataFrame, at: Column | str, ts_col: str = "ts", seq_col: str = "seq") -> DataFrame:
    """The stream ``rows`` with a stream of heartbeats that has one row with time ``at``, all other
    columns null.  A deployment lets a clock write such rows while a source is silent."""
    spark = rows.sparkSession
    path = shared_path(spark, "heartbeat")
    value = F.to_timestamp_ntz(F.lit(at)) if isinstance(at, str) else at
    beat = spark.range(1).select(*[value.cast(f.dataType).alias(f.name) if f.name == ts_col else
                                   F.lit(BEAT if f.name == seq_col else None).cast(f.dataType).alias(f.name) for f in rows.schema.fields])
    beat.write.parquet(path)
    return rows.unionByName(spark.readStream.schema(rows.schema).parquet(path))


def _clock(df: DataFrame, ts_col: str, watermark: str) -> DataFrame:
    """Adds ``t`` (microseconds) and the watermarked event time ``event_time``."""
    return (df.withColumn("t", epoch_micros(ts_col)).withColumn("event_time", F.timestamp_micros("t"))
            .withWatermark("event_time", watermark))


def _wall(t: str) -> Column:
    return F.expr(f"timestampadd(MICROSECOND, {t}, TIMESTAMP_NTZ'1970-01-01 00:00:00')")


def _times(t) -> pd.Series:
    return pd.to_datetime(pd.Series(t, dtype="int64"), unit="us", utc=True)


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets))


def _packed(rows: pd.DataFrame | pa.Table, schema: pa.Schema) -> bytes:
    table = rows if isinstance(rows, pa.Table) else pa.Table.from_pandas(rows[schema.names], schema, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(pieces: Iterable[bytes], schema: pa.Schema) -> pa.Table:
    return pa.concat_tables([schema.empty_table(), *(pa.ipc.open_stream(p).read_all() for p in pieces)])


def _gathered(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The frames of a call without heartbeats, joined up to ``SORT_ROWS`` rows."""
    held, n = [], 0
    for pdf in frames:
        held.append(pdf[pdf["seq"] != BEAT])
        n += len(held[-1])
        if n >= SORT_ROWS:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)


class Ordered(StatefulProcessor):
    """Keeps a bucket's rows until the watermark passes them, then hands them on in the order of ``order``."""

    #: The columns kept of a row, and those that give the order (``t`` first).
    kept = pa.schema([])
    order: list[str] = ["t", "seq"]

    @property
    def _by(self) -> list[tuple[str, str]]:
        return [(c, "ascending") for c in self.order]

    def init(self, handle) -> None:
        self.handle = handle
        # By the time of their first row, and a number.
        self.pending = handle.getMapState("pending", "t bigint, n bigint", "rows binary")
        self.pieces = handle.getValueState("pieces", "n bigint")

    def close(self) -> None:
        pass

    def wait(self, frames: Iterable[pd.DataFrame]) -> None:
        firsts = [self._keep(pa.Table.from_pandas(rows[self.kept.names], self.kept, preserve_index=False).sort_by(self._by))
                  for rows in frames if len(rows)]
        if firsts:
            self.wake(min(firsts))

    def _keep(self, rows: pa.Table) -> int:
        """Store sorted rows; the time of the first."""
        n, times = self.pieces.get()[0] if self.pieces.exists() else 0, rows.column("t")
        for at in range(0, rows.num_rows, PIECE_ROWS):
            self.pending.updateValue((times[at].as_py(), n), (_packed(rows.slice(at, PIECE_ROWS), self.kept),))
            n += 1
        self.pieces.update((n,))
        return times[0].as_py()

    def wake(self, t: int) -> None:
        """A timer for when the watermark has passed time ``t``."""
        self.handle.registerTimer(-(-t // 1000))

    def due(self, now: int) -> Iterator[pa.Table]:
        """The rows up to the watermark ``now``, in order over all tables given; the rest waits on."""
        places = sorted(tuple(k) for k in self.pending.keys())
        passed = [k for k in places if k[0] <= now]
        held, wait = self.kept.empty_table(), [k[0] for k in places[len(passed):][:1]]
        for place, following in zip(passed, [*passed[1:], None]):
            held = pa.concat_tables([held, _unpacked([self.pending.getValue(place)[0]], self.kept)])
            self.pending.removeKey(place)
            if following is None or held.num_rows >= SORT_ROWS:
                held = held.sort_by(self._by)
                until = now if following is None else following[0] - 1  # the next piece may hold rows from there on
                ready = int(np.searchsorted(held.column("t").to_numpy(), until, "right"))
                if ready:
                    yield held.slice(0, ready)
                held = held.slice(ready)
        if held.num_rows:
            wait.append(self._keep(held))
        if wait:
            self.wake(min(wait))
        elif places:
            self.pieces.clear()


def _now(timer_values) -> int:
    return timer_values.getCurrentWatermarkInMs() * 1000


class _LimitState:
    """The sliding logs of a bucket's keys, packed into one value; a log counts for a window."""

    def __init__(self, handle, max_requests: int, window_us: int):
        self.state = handle.getValueState("allowed", "rows binary")
        self.schema = pa.schema([("key", pa.string()), ("t", pa.int64())])
        self.max_requests, self.window_us = max_requests, window_us

    def open(self) -> dict[str | None, SlidingLog]:
        logs: dict[str | None, SlidingLog] = {}
        if self.state.exists():
            held = _unpacked([self.state.get()[0]], self.schema)
            for key, t in zip(held.column("key").to_pylist(), held.column("t").to_pylist()):
                self.log(logs, key).times.append(t)
        return logs

    def log(self, logs: dict, key: str | None) -> SlidingLog:
        found = logs.get(key)
        if found is None:
            found = logs[key] = SlidingLog(self.max_requests, self.window_us)
        return found

    def offer(self, logs: dict, keys: list, times: list) -> list[int | None]:
        """Requests in order: null if allowed, else the seconds to wait."""
        return [self.log(logs, k).offer(t) for k, t in zip(keys, times)]

    def store(self, logs: dict, now: int) -> int | None:
        """Write back the logs that still count; until when the last of them does."""
        rows = [(k, t) for k, log in logs.items() if log.times and log.times[-1] + self.window_us >= now for t in log.times]
        if not rows:
            self.state.clear()
            return None
        keys, times = zip(*rows)
        self.state.update((_packed(pa.table([pa.array(keys, pa.string()), pa.array(times, pa.int64())], schema=self.schema), self.schema),))
        return max(times) + self.window_us + 1


_JUDGED = "seq bigint, t bigint, ip string, email string, bot boolean, ip_ok boolean, ip_retry bigint, event_time timestamp"


class IpLimit(Ordered):
    """First stage of the funnel: the requests of a bucket of IPs in order; bots go on at once and use no quota."""

    kept = pa.schema([("t", pa.int64()), ("seq", pa.int64()), ("ip", pa.string()), ("email", pa.string())])

    def __init__(self, max_requests: int, window_us: int):
        self.max_requests, self.window_us = max_requests, window_us

    def init(self, handle) -> None:
        super().init(handle)
        self.limit = _LimitState(handle, self.max_requests, self.window_us)

    @staticmethod
    def _out(rows: pd.DataFrame, bot: bool, ok: list, retry: list) -> pd.DataFrame:
        out = rows[["seq", "t", "ip", "email"]].reset_index(drop=True)
        return out.assign(bot=bot, ip_ok=pd.Series(ok, dtype="boolean"), ip_retry=pd.Series(retry, dtype="Int64"), event_time=_times(out["t"]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        bots = []

        def humans():
            for pdf in _gathered(rows):
                bots.append(pdf[pdf["bot"]])
                yield pdf[~pdf["bot"]]
        self.wait(humans())
        for pdf in bots:
            if len(pdf):
                yield self._out(pdf, True, [None] * len(pdf), [None] * len(pdf))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, logs = _now(timerValues), self.limit.open()
        for table in self.due(now):
            waits = self.limit.offer(logs, table.column("ip").to_pylist(), table.column("t").to_pylist())
            yield self._out(table.to_pandas(), False, [w is None for w in waits], waits)
        until = self.limit.store(logs, now)
        if until is not None:
            self.wake(until)


class EmailLimit(StatefulProcessor):
    """Second stage: the requests of a bucket of addresses that the first let through; others pass."""

    def __init__(self, max_requests: int, window_us: int):
        self.max_requests, self.window_us = max_requests, window_us

    def init(self, handle) -> None:
        self.handle = handle
        self.limit = _LimitState(handle, self.max_requests, self.window_us)

    def close(self) -> None:
        pass

    @staticmethod
    def _out(rows: pd.DataFrame, ok: list, retry: list) -> pd.DataFrame:
        out = rows[["seq", "t", "ip", "email", "bot", "ip_ok", "ip_retry"]].reset_index(drop=True)
        return out.assign(ip_ok=out["ip_ok"].astype("boolean"), ip_retry=out["ip_retry"].astype("Int64"),
                          email_ok=pd.Series(ok, dtype="boolean"), email_retry=pd.Series(retry, dtype="Int64"))

    def _store(self, logs: dict, now: int) -> None:
        until = self.limit.store(logs, now)
        if until is not None:
            self.handle.registerTimer(-(-until // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        asking = []
        for pdf in rows:
            asks = pdf["ip_ok"].astype("boolean").fillna(False).astype(bool)
            asking.append(pdf[asks])
            if not asks.all():
                passing = pdf[~asks]
                yield self._out(passing, [None] * len(passing), [None] * len(passing))
        pdf = pd.concat(asking, ignore_index=True).sort_values(["t", "seq"], kind="stable", ignore_index=True)
        if len(pdf):
            logs = self.limit.open()
            waits = self.limit.offer(logs, pdf["email"].tolist(), pdf["t"].tolist())
            self._store(logs, _now(timerValues))
            yield self._out(pdf, [w is None for w in waits], waits)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self._store(self.limit.open(), _now(timerValues))
        return iter(())


def stream_reset_funnel(requests: DataFrame, users: DataFrame, max_requests: int = RESET_MAX_REQUESTS,
                        window_minutes: float = RESET_WINDOW_MINUTES, watermark: str = "10 minutes",
                        buckets: int = BUCKETS) -> DataFrame:
    """J2 live: :func:`wellspring.operators.limits.reset_funnel` over a stream of requests.

    Two chained stateful stages, by ``buckets`` of IPs and of addresses, then a join with the
    users known when the batch runs.  An IP's requests wait in state for the
    length of ``watermark``; both logs hold ``max_requests`` times a key.  Requests without a time aren't answered.
    """
    window_us = int(round(window_minutes * 60 * 1_000_000))
    r = requests.select("seq", "ts", "ip", normalise_email("email_raw").alias("email"),
                        (F.col("nickname").isNotNull() & (F.col("nickname") != "")).alias("bot"))
    r = _clock(r, "ts", watermark).select("seq", "t", "ip", "email", "bot", "event_time").where("event_time is not null")
    by_ip = r.withColumn("bucket", bucket_of("ip", buckets)).groupBy("bucket").transformWithStateInPandas(
        IpLimit(max_requests, window_us), _JUDGED, "Append", "EventTime", eventTimeColumnName="event_time")
    by_email = by_ip.withColumn("bucket", bucket_of("email", buckets)).groupBy("bucket").transformWithStateInPandas(
        EmailLimit(max_requests, window_us), "seq bigint, t bigint, ip string, email string, bot boolean, ip_ok boolean, "
        "ip_retry bigint, email_ok boolean, email_retry bigint", "Append", "EventTime")
    return funnel_outcomes(by_email.withColumn("ts", _wall("t")), users)


_EVENT = "kind int, seq bigint, t bigint, token string, user_id bigint, expires bigint, event_time timestamp"


class TokenOwner(Ordered):
    """Gives redemptions the user and expiry of their token once their time has come; issues go on at once."""

    kept = pa.schema([("t", pa.int64()), ("seq", pa.int64()), ("token", pa.string())])
    owned = pa.schema([("token", pa.string()), ("user_id", pa.int64()), ("expires", pa.int64())])

    def init(self, handle) -> None:
        super().init(handle)
        self.issued = handle.getListState("issued", "rows binary")

    @staticmethod
    def _out(kind: int, rows: pd.DataFrame) -> pd.DataFrame:
        out = rows[["seq", "t", "token", "user_id", "expires"]].reset_index(drop=True)
        return out.assign(kind=np.int32(kind), event_time=_times(out["t"]))[["kind", "seq", "t", "token", "user_id", "expires", "event_time"]]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, out = None, []

        def redemptions():
            for pdf in _gathered(rows):
                if (pdf["kind"] == 0).any():
                    out.append(pdf[pdf["kind"] == 0])
                yield pdf[pdf["kind"] == 1]
        self.wait(redemptions())
        for issues in out:
            self.issued.appendValue((_packed(issues, self.owned),))
            latest = int(issues["expires"].max())
            last = latest if last is None else max(last, latest)
            yield self._out(0, issues)
        if last is not None:
            self.wake(last)  # from then on no redemption of these can succeed

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = _now(timerValues)
        known = _unpacked((r[0] for r in self.issued.get()) if self.issued.exists() else (), self.owned)
        tokens, users, expiries = (known.column(c).to_pylist() for c in self.owned.names)
        owner = {token: (user, expires) for token, user, expires in zip(tokens, users, expiries) if token is not None}
        for table in self.due(now):
            found = [(t, seq, token, *owner[token]) for t, seq, token in zip(*(table.column(c).to_pylist() for c in ("t", "seq", "token")))
                     if token in owner and t < owner[token][1]]
            if found:
                yield self._out(1, pd.DataFrame(found, columns=["t", "seq", "token", "user_id", "expires"]))
        valid = known.filter(pa.array([e > now for e in expiries], pa.bool_()))
        if valid.num_rows and valid.num_rows < known.num_rows:
            self.issued.put([(_packed(valid, self.owned),)])
        elif known.num_rows and not valid.num_rows:
            self.issued.clear()


class TokenLapse(Ordered):
    """The issues and redemptions of a bucket of users in order; a token not redeemed is released when it expires."""

    kept = pa.schema([("t", pa.int64()), ("kind", pa.int32()), ("seq", pa.int64()), ("token", pa.string()), ("user_id", pa.int64()),
                      ("expires", pa.int64())])
    order = ["t", "kind", "seq"]  # issues come before redemptions of the same time
    held = pa.schema([("user_id", pa.int64()), ("newest", pa.string()), ("token", pa.string()), ("expires", pa.int64()), ("seq", pa.int64()),
                      ("issued", pa.int64())])

    def init(self, handle) -> None:
        super().init(handle)
        self.open = handle.getValueState("open", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.wait(_gathered(rows))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = _now(timerValues)
        newest: dict[int, str] = {}
        open_: dict[tuple[int, str], list[tuple]] = {}  # (user, token): its issues
        if self.open.exists():
            for user, new, token, *issue in zip(*_unpacked([self.open.get()[0]], self.held).to_pydict().values()):
                newest[user] = new
                open_.setdefault((user, token), []).append(tuple(issue))
        for table in self.due(now):
            for t, kind, seq, token, user, expires in zip(*table.to_pydict().values()):
                if kind == 0:
                    newest[user] = token
                    open_.setdefault((user, token), []).append((expires, seq, t))
                elif token == newest.get(user) and t < expires:  # its first success uses it up
                    open_.pop((user, token), None)
            yield from self._lapsed(open_, t)
        yield from self._lapsed(open_, now)
        rows = [(user, newest.get(user), token, *issue) for (user, token), issues in open_.items() for issue in issues]
        if rows:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), self.held)]
            self.open.update((_packed(pa.table(columns, schema=self.held), self.held),))
            self.wake(min(r[3] for r in rows))
        else:  # no token is left that a redemption could name
            self.open.clear()

    @staticmethod
    def _lapsed(open_: dict, now: int) -> Iterator[pd.DataFrame]:
        """Takes out the issues that have expired at ``now``."""
        out = []
        for (user, token), issues in list(open_.items()):
            over = [i for i in issues if i[0] <= now]
            if over:
                out += [(seq, user, token, issued, expires) for expires, seq, issued in over]
                if len(over) < len(issues):
                    open_[user, token] = [i for i in issues if i[0] > now]
                else:
                    del open_[user, token]
        if out:
            yield pd.DataFrame(out, columns=["seq", "user_id", "token", "issued", "expires_t"])


def stream_lapsed_tokens(issues: DataFrame, redemptions: DataFrame, watermark: str = "10 minutes",
                         buckets: int = BUCKETS) -> DataFrame:
    """J6 live: reset tokens that expire unused, each released when the watermark passes its expiry.

    By the rule of :func:`wellspring.operators.accounts.reset_redeem`: a
    redemption uses a token up iff it is its user's newest at that time and not
    yet expired (strict), so a superseded token lapses whatever is tried with
    it.  A first stage, by ``buckets`` of tokens, finds the user of each redemption; a
    second, by as many of users, keeps a user's newest token and those not yet expired.
    ``issues``: (seq, user_id, token, issued_at, expires); ``redemptions``: (seq, ts, token).
    """
    i = issues.select(F.lit(0).alias("kind"), "seq", F.col("issued_at").alias("ts"), "token", "user_id", epoch_micros("expires").alias("expires"))
    r = redemptions.select(F.lit(1).alias("kind"), "seq", "ts", "token", F.lit(None).cast("bigint").alias("user_id"),
                           F.lit(None).cast("bigint").alias("expires"))
    events = _clock(i.unionByName(r), "ts", watermark).drop("ts").where("event_time is not null").fillna(BEAT, ["user_id", "expires"])
    events = events.withColumn("bucket", bucket_of("token", buckets))
    owned = events.groupBy("bucket").transformWithStateInPandas(TokenOwner(), _EVENT, "Append", "EventTime", eventTimeColumnName="event_time")
    lapsed = owned.withColumn("bucket", bucket_of("user_id", buckets)).groupBy("bucket").transformWithStateInPandas(
        TokenLapse(), "seq bigint, user_id bigint, token string, issued bigint, expires_t bigint", "Append", "EventTime")
    return lapsed.select("seq", "user_id", "token", _wall("issued").alias("issued_at"), _wall("expires_t").alias("expires"))
