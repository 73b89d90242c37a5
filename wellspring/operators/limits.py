"""Sliding-log rate limits (J1) and the password-reset funnel.

The limiter is order dependent: a request counts only if it was allowed, so
the state of a key is the list of its last (at most ``max_requests``) allowed
times.  Seen from outside, a chunk of a key's requests is a function from the
state at its start to the state at its end, and its sorted times are all that
the function needs: a full state skips to the first request after its oldest
time leaves the window, found by binary search.

So the work is cut in three.  Tasks pack each (key, time chunk)'s times, one
row a chunk.  A key's chunks are then run through in order, a few searches
each, which gives every chunk its entry state and the requests it allows.
Last, requests meet their chunk's row in an equi-join and are judged where
they are, in built-in expressions.  A hot key (one shared IP holding a third of
all requests, with or without idle times) is thus read, packed and judged by
many tasks; what one task does for it alone is to stream its packed times (16
bytes a request) past a state of ``max_requests`` times.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.fixed_values import RESET_MAX_REQUESTS, RESET_WINDOW_MINUTES
from wellspring.functions.dates import epoch_micros
from wellspring.functions.text import is_valid_email, normalise_email

#: Time chunks of one window, which bound the requests packed into one row.
CHUNKS_PER_WINDOW = 16


class SlidingLog:
    """The last ``max_requests`` allowed times of one key."""

    def __init__(self, max_requests: int, window_us: int, times=()):
        self.max_requests, self.window_us = max_requests, window_us
        self.times: deque = deque(times, maxlen=max(max_requests, 1))

    def full_until(self) -> int | None:
        """The last time at which a further request is denied (null: none is)."""
        if len(self.times) < self.max_requests:
            return None
        # Strict: exactly one window later the oldest still counts.
        return self.times[0] + self.window_us

    def offer(self, t: int) -> int | None:
        """Take a request (times don't fall): null if allowed, else the seconds to wait."""
        until = self.full_until()
        if until is None or t > until:
            self.times.append(t)
            return None
        return (until - t) // 1_000_000

    def take(self, times: np.ndarray) -> list[int]:
        """Which of a chunk's sorted times are allowed."""
        taken, i = [], 0
        if self.max_requests < 1:
            return taken
        while i < len(times):
            until = self.full_until()
            if until is not None and times[i] <= until:  # denied requests are not recorded
                i += int(np.searchsorted(times[i:], until, "right"))
                continue
            self.times.append(int(times[i]))
            taken.append(i)
            i += 1
        return taken


def _run(key: str, max_requests: int, window_us: int):
    """A key's chunks in order: the state each begins with and the requests it allows."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, log = object(), None
        for batch in batches:
            sizes = batch.column("_reqs").value_lengths().to_numpy()
            flat = batch.column("_reqs").flatten()
            times, seqs = (flat.field(c).to_numpy() for c in ("t", "s"))
            ends = np.cumsum(sizes)
            entry, taken, counts = [], [], []
            for k, a, b in zip(batch.column(key).to_pylist(), ends - sizes, ends):
                if k != at:
                    at, log = k, SlidingLog(max_requests, window_us)
                entry.append(list(log.times))
                found = log.take(times[a:b])
                taken += [int(a) + i for i in found]
                counts.append(len(found))
            where = np.array(taken, np.int64)
            allowed = pa.StructArray.from_arrays([pa.array(times[where]), pa.array(seqs[where])], names=["t", "s"])
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), batch.column("_c"), pa.array(entry, pa.list_(pa.int64())), pa.ListArray.from_arrays(offsets, allowed)],
                names=[key, "_c", "_entry", "_taken"])
    return scan


def rate_limit(requests: DataFrame, key: str, max_requests: int = RESET_MAX_REQUESTS,
               window_minutes: float = RESET_WINDOW_MINUTES, ts_col: str = "ts",
               seq_col: str = "seq", eligible: str | None = None,
               allowed_col: str = "allowed", retry_col: str = "retry_after_s") -> DataFrame:
    """Allow a request if fewer than ``max_requests`` *allowed* requests of the
    same key lie within ``window_minutes`` before it (eviction is strict, T22).

    Adds ``allowed`` and ``retry_after_s`` (the original's remaining time in
    whole seconds for denied requests, null when allowed).  Order within a key
    is (ts, seq).  With ``eligible`` (a boolean column), other rows pass
    through untouched with nulls and do not use quota, so chained limits run
    as one pass each without splitting and re-unioning the input; so do
    requests without a time.  A null key is a key.
    """
    window_us = int(round(window_minutes * 60 * 1_000_000))
    chunk_us = max(1, window_us // CHUNKS_PER_WINDOW)
    src = requests.withColumn("_t", epoch_micros(ts_col))
    counts = F.col("_t").isNotNull() if eligible is None else F.col("_t").isNotNull() & F.coalesce(F.col(eligible), F.lit(False))
    src = src.withColumn("_c", F.when(counts, F.floor(F.col("_t") / F.lit(chunk_us)).cast("bigint")))
    packed = (src.filter("_c is not null").groupBy(key, "_c")
              .agg(F.array_sort(F.collect_list(F.struct(F.col("_t").alias("t"), F.col(seq_col).cast("bigint").alias("s")))).alias("_reqs")))
    kind = src.schema[key].dataType.simpleString()
    chunks = (packed.repartition(key).sortWithinPartitions(key, "_c")
              .mapInArrow(_run(key, max_requests, window_us),
                          f"`{key}` {kind}, _c bigint, _entry array<bigint>, _taken array<struct<t: bigint, s: bigint>>"))
    # Rows that count meet their chunk; the others' null chunk meets nothing.
    keys = chunks.withColumnsRenamed({key: "_k", "_c": "_kc"})
    joined = src.join(keys, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_c") == F.col("_kc")), "left").drop("_k", "_kc")
    own = F.struct(F.col("_t").alias("t"), F.col(seq_col).cast("bigint").alias("s"))
    allowed = F.when(F.col("_c").isNotNull(), F.array_contains("_taken", own))
    before = F.concat("_entry", F.transform(F.filter("_taken", lambda x: x < own), lambda x: x["t"]))
    oldest = F.try_element_at(before, F.lit(-max(max_requests, 1)))
    retry = F.floor((F.lit(window_us) - F.col("_t") + oldest) / F.lit(1_000_000)).cast("bigint")
    return (joined.withColumn(allowed_col, allowed)
            .withColumn(retry_col, F.when(~F.col(allowed_col), retry))
            .drop("_t", "_c", "_entry", "_taken"))


def reset_funnel(requests: DataFrame, users: DataFrame, max_requests: int = RESET_MAX_REQUESTS,
                 window_minutes: float = RESET_WINDOW_MINUTES) -> DataFrame:
    """Honeypot -> IP limit -> email limit -> email pattern -> known user.

    Emails are ``strip().lower()``-ed (T21).  Bots never reach the limiter; the
    email limit sees only requests the IP limit allowed (T23); malformed
    addresses still use quota (T24).  ``outcome`` is one of ``bot``,
    ``ip_limited``, ``email_limited``, ``invalid_email``, ``unknown_user``,
    ``sent``; ``retry_minutes`` is the wait shown for limited requests.
    Each limit packs its times by chunk, runs the chunks and joins them back.
    """
    r = requests.select("seq", "ts", "ip", normalise_email("email_raw").alias("email"),
                        (F.col("nickname").isNotNull() & (F.col("nickname") != "")).alias("bot"))
    r = r.withColumn("_human", ~F.col("bot"))
    by_ip = rate_limit(r, "ip", max_requests, window_minutes, eligible="_human", allowed_col="ip_ok", retry_col="ip_retry")
    by_email = rate_limit(by_ip, "email", max_requests, window_minutes, eligible="ip_ok",
                          allowed_col="email_ok", retry_col="email_retry")
    return funnel_outcomes(by_email, users)


def funnel_outcomes(judged: DataFrame, users: DataFrame) -> DataFrame:
    """The funnel's answer to requests that both limits have judged (batch and live)."""
    known = users.select("email", F.lit(True).alias("_known"))
    j = judged.join(known, "email", "left")
    outcome = (F.when(F.col("bot"), F.lit("bot"))
               .when(~F.col("ip_ok"), F.lit("ip_limited"))
               .when(~F.col("email_ok"), F.lit("email_limited"))
               .when(~is_valid_email("email"), F.lit("invalid_email"))
               .when(F.col("_known").isNull(), F.lit("unknown_user"))
               .otherwise(F.lit("sent")))
    retry = F.floor(F.coalesce("ip_retry", "email_retry") / 60).cast("bigint")
    return j.select("seq", "ts", "ip", "email", outcome.alias("outcome"), retry.alias("retry_minutes"))
