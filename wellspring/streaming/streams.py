"""Structured Streaming forms of the live operators (J1, J3, J5, J7; J2 and J6 in ``ordered``).

Sources are file streams (parquet) read with a fixed schema; sinks are
append/update/complete sinks chosen per operator.  Checkpoints go under the
session's shared checkpoint folder (``spark.checkpoint.dir``), so a restarted
query resumes from its last committed micro-batch.

Ordering: within a micro-batch each key's rows are sorted by (ts, seq) before
the fold; across micro-batches the state carries the allowed times.  Rows
that arrive in a later micro-batch but are older than the watermark are not
silently dropped: :func:`late_rows` finds them for a batch re-run.
"""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wellspring.fixed_values import CRISIS_KEYWORDS, RESET_MAX_REQUESTS, RESET_WINDOW_MINUTES
from wellspring.functions.dates import epoch_micros
from wellspring.functions.joins import null_safe_join
from wellspring.operators.safety import crisis_alerts
from wellspring.operators.tokens import token_increments
from wellspring.session import checkpoint_dir
from wellspring.sources.versioned import complete_versions, latest_snapshot, rewrite_partitions


def file_stream(spark: SparkSession, folder: str, name: str, schema: T.StructType | None = None,
                max_files_per_trigger: int = 1) -> DataFrame:
    """A parquet file stream over ``folder`` limited to files named ``name*.parquet``."""
    if schema is None:
        schema = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet").schema
    return (spark.readStream.schema(schema)
            .option("maxFilesPerTrigger", max_files_per_trigger)
            .option("pathGlobFilter", f"{name}*.parquet")
            .parquet(folder))


def _limit_state_fn(key_col: str, max_requests: int, window_us: int, out_cols: list[str]):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = deque(state.get[0]) if state.exists else deque()
        # One key's rows of this micro-batch (bounded by the trigger size), in (ts, seq) order.
        pdf = pd.concat(list(pdfs), ignore_index=True).sort_values(["_t", "seq"], kind="stable")
        ts = pdf["_t"].to_numpy(dtype=np.int64)
        allowed = np.zeros(len(pdf), dtype=bool)
        retry = np.zeros(len(pdf), dtype=np.int64)
        for i, t in enumerate(ts):
            while times and t - times[0] > window_us:
                times.popleft()
            if len(times) >= max_requests:
                elapsed = t - times[0]
                retry[i] = 0 if elapsed >= window_us else (window_us - elapsed) // 1_000_000
            else:
                allowed[i] = True
                times.append(int(t))
        state.update((list(times),))
        # Idle keys expire one window after their newest request (event time).
        state.setTimeoutTimestamp(int(pdf["_tw"].max() // 1000 + window_us // 1000 + 1))
        out = pdf[out_cols].copy()
        out["allowed"] = allowed
        out["retry_after_s"] = pd.array(retry, dtype="Int64")
        out.loc[allowed, "retry_after_s"] = pd.NA
        yield out
    return fn


def stream_rate_limit(requests: DataFrame, key: str, max_requests: int = RESET_MAX_REQUESTS,
                      window_minutes: float = RESET_WINDOW_MINUTES, watermark: str = "1 day") -> DataFrame:
    """J1 live: ``applyInPandasWithState`` keyed by ``key``; the state is the
    key's last (at most ``max_requests``) allowed times; an event-time timeout
    drops keys idle for a whole window.  Output (seq, key, ts, allowed,
    retry_after_s) in append mode."""
    window_us = int(round(window_minutes * 60 * 1_000_000))
    src = (requests.select("seq", key, "ts")
           .withColumn("_ts", F.col("ts").cast("timestamp"))
           .withColumn("_t", epoch_micros("ts"))
           .withColumn("_tw", F.unix_micros("_ts"))     # the watermark's clock, for the state timeout
           .withWatermark("_ts", watermark))
    out_cols = ["seq", key, "ts"]
    out_schema = T.StructType([src.schema[c] for c in out_cols]
                              + [T.StructField("allowed", T.BooleanType()),
                                 T.StructField("retry_after_s", T.LongType())])
    state_schema = T.StructType([T.StructField("times", T.ArrayType(T.LongType()))])
    return (src.groupBy(key)
            .applyInPandasWithState(_limit_state_fn(key, max_requests, window_us, out_cols),
                                    out_schema, state_schema, "append", GroupStateTimeout.EventTimeTimeout))


def stream_crisis_alerts(messages: DataFrame, user_country: DataFrame,
                         keywords: list[str] = CRISIS_KEYWORDS) -> DataFrame:
    """J3 live: stateless filter over the message stream joined to the static
    country table (stream-static join), appended as alerts."""
    return crisis_alerts(messages, user_country, keywords)


def stream_token_totals(log: DataFrame) -> DataFrame:
    """J5 live: running (user, MMyy) token totals; run in update mode and
    merge each micro-batch into the months that it touches (:func:`snapshot_merge`)."""
    return (token_increments(log).groupBy("user_id", "month_year")
            .agg(F.sum("tokens").cast("bigint").alias("tokens")))


def stream_dedup(messages: DataFrame, watermark: str = "1 hour", ts_col: str = "timestamp") -> DataFrame:
    """J7 live: drop re-delivered message ids within the watermark."""
    return (messages.withColumn("_ts", F.col(ts_col).cast("timestamp")).withWatermark("_ts", watermark)
            .dropDuplicatesWithinWatermark(["id"]).drop("_ts"))


def late_rows(batch: DataFrame, emitted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the file source the stream never emitted (older than the
    watermark when they arrived): a batch anti join, written to a ``late``
    table by the caller instead of being lost."""
    return batch.join(emitted.select(*keys), keys, "left_anti")


def snapshot_merge(path: str, keys: list[str], partition: str | None = None):
    """``foreachBatch`` writer for update-mode aggregates: a keyed table under ``path``,
    partitioned by ``partition`` (one of the keys; default: the last).

    A micro-batch rewrites only the partitions that it touches (see
    :mod:`wellspring.sources.versioned`): their live rows less the batch's keys,
    plus the batch.  A retried batch rewrites the same version from the same input
    (exactly once).
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            rewrite_partitions(
                path, partition or keys[-1], batch_id, batch,
                lambda old: null_safe_join(old, batch.select(*keys), keys, "left_anti").unionByName(batch), batch.schema)
        finally:
            batch.unpersist()
    return write


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available_now(spark: SparkSession, df: DataFrame, mode: str = "append",
                      keys: list[str] | None = None, provider: str | None = None) -> DataFrame:
    """Run a streaming DataFrame over everything available (``availableNow``)
    into parquet under the shared checkpoint folder and return it as a batch
    DataFrame.  Append mode uses the file sink (exactly-once via its commit
    log); complete/update modes write each micro-batch's result with
    ``foreachBatch`` as a version of its own (the last complete one is the answer).
    ``provider`` names the query's state store (``ROCKSDB`` for the operators of
    :mod:`wellspring.streaming.ordered`); the session's own stays as it is."""
    name = "ws_" + uuid.uuid4().hex[:12]
    base = f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}"
    out = f"{base}/data"
    w = df.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        w = w.format("parquet").option("path", out).outputMode("append")
    elif mode == "update" and keys:
        w = w.outputMode("update").foreachBatch(snapshot_merge(out, keys))
    else:
        w = w.outputMode(mode).foreachBatch(lambda batch, no: batch.write.mode("overwrite").parquet(f"{out}/v={no}"))
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, provider or before)
    try:
        q = w.start()  # takes a copy of the session's settings
    finally:
        spark.conf.set(_PROVIDER, before)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    if mode == "update" and keys:
        return latest_snapshot(spark, out, df.schema, keys[-1])
    if mode != "append":
        done = complete_versions(spark, out)
        return spark.read.schema(df.schema).parquet(f"{out}/v={max(done)}") if done else spark.createDataFrame([], df.schema)
    try:
        return spark.read.schema(df.schema).parquet(out)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # any other read error is the caller's to see
            raise
        return spark.createDataFrame([], df.schema)  # no micro-batch produced output
