"""Token ledger: additive monthly totals, running totals and lookups.

T1: the application writes one ledger and reads another; here there is one
ledger, ``token_usage(user_id, month_year, tokens, created_at, updated_at)``.
Increments are ``(request_id, user_id, ts, total_tokens)`` rows.

Scale: the ledger is one hash aggregate with partial sums, so a user with a
third of all requests is combined map-side.  The running total splits each
(user, month) into time chunks: chunk sums are aggregated first, their prefix
offsets computed over the small chunk table, and rows are numbered only
within a chunk, so no single task has to order a hot user's whole month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wellspring.functions.dates import month_key
from wellspring.functions.joins import null_safe_join


def token_increments(log: DataFrame) -> DataFrame:
    """Increment rows keyed by the ``MMyy`` month of their timestamp."""
    return log.select("user_id", month_key("ts").alias("month_year"),
                      F.col("total_tokens").cast("bigint").alias("tokens"), "ts")


def token_ledger(log: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """D3/H4: base ledger plus increments, summed by (user, month).

    ``created_at`` is the earliest and ``updated_at`` the latest contributing
    time (the base row keeps its own times).
    """
    inc = token_increments(log).select("user_id", "month_year", "tokens",
                                       F.col("ts").alias("c_ts"), F.col("ts").alias("u_ts"))
    if base is not None:
        inc = base.select("user_id", "month_year", F.col("tokens").cast("bigint"),
                          F.col("created_at").alias("c_ts"), F.col("updated_at").alias("u_ts")).unionByName(inc)
    return (inc.groupBy("user_id", "month_year")
            .agg(F.sum("tokens").cast("bigint").alias("tokens"),
                 F.min("c_ts").alias("created_at"), F.max("u_ts").alias("updated_at")))


def token_running_total(log: DataFrame, chunk: str = "hour") -> DataFrame:
    """Running token total per (user, month) in (ts, request_id) order.

    Two-level prefix sum: ``offset`` = sum of all earlier chunks of the
    (user, month), then a window inside each chunk.  Rows without a time or
    user stay: a null month is a month of its own.
    """
    inc = log.select("request_id", "user_id", month_key("ts").alias("month_year"),
                     F.col("total_tokens").cast("bigint").alias("tokens"), "ts",
                     F.date_trunc(chunk, "ts").alias("chunk"))
    key = ["user_id", "month_year"]
    chunks = inc.groupBy(*key, "chunk").agg(F.sum("tokens").alias("chunk_tokens"))
    wc = Window.partitionBy(*key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunks.select(*key, "chunk", F.coalesce(F.sum("chunk_tokens").over(wc), F.lit(0)).alias("offset"))
    wr = Window.partitionBy(*key, "chunk").orderBy("ts", "request_id").rowsBetween(Window.unboundedPreceding, 0)
    within = inc.withColumn("within", F.sum("tokens").over(wr))
    return (null_safe_join(within, offsets, [*key, "chunk"])
            .select("request_id", *key, "ts", "tokens",
                    (F.col("offset") + F.col("within")).cast("bigint").alias("running_tokens")))


def monthly_tokens(users: DataFrame, ledger: DataFrame, month_year: str) -> DataFrame:
    """Every user's token count for one ``MMyy`` month, 0 when missing."""
    m = ledger.filter(F.col("month_year") == month_year).select("user_id", "tokens")
    return (users.select(F.col("id").alias("user_id"))
            .join(m, "user_id", "left")
            .select("user_id", F.lit(month_year).alias("month_year"),
                    F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens")))
