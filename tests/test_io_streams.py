"""Sinks (A4, A5), typed scans (A1) and live forms over several micro-batches."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from conftest import rows, ts

from wellspring import schemas
from wellspring.sources.sinks import append_messages, append_summaries
from wellspring.sources.tables import conform, scan_table
from wellspring.sources.versioned import latest_snapshot
from wellspring.streaming import streams as S

MSG = "id bigint, user_id bigint, message string, role string, timestamp timestamp_ntz, archive boolean, session string"


def test_append_messages_partitions_by_day_and_scans_typed(spark):
    out = tempfile.mkdtemp(prefix="ws-sink-", dir="/tmp")
    m = spark.createDataFrame([(1, 1, "a", "user", ts("2024-01-01 10:00:00"), False, "s"),
                               (2, 1, "b", "assistant", ts("2024-01-02 10:00:00"), False, "s")], MSG)
    append_messages(m, out)
    append_messages(m.withColumn("id", F.col("id") + 10), out)
    assert sorted(d for d in os.listdir(out) if d.startswith("message_date=")) == [
        "message_date=2024-01-01", "message_date=2024-01-02"]
    back = scan_table(spark, out, "conversations")
    # Declared columns keep their declared types; the partition column is appended.
    assert back.columns == [f.name for f in schemas.CONVERSATIONS.fields] + ["message_date"]
    assert [f.dataType for f in back.schema.fields[:-1]] == [f.dataType for f in schemas.CONVERSATIONS.fields]
    assert back.count() == 4
    pruned = spark.read.parquet(out).filter(F.col("message_date") == dt.date(2024, 1, 2))
    assert "PartitionFilters: [isnotnull(message_date" in pruned._jdf.queryExecution().executedPlan().toString()


def test_append_summaries(spark):
    out = tempfile.mkdtemp(prefix="ws-sum-", dir="/tmp")
    s = spark.createDataFrame([(1, "s", "x", 4, ts("2024-01-03 00:00:00"))],
                              "user_id bigint, session string, summary string, last_message_id bigint, "
                              "created_at timestamp_ntz")
    append_summaries(s, out)
    assert spark.read.parquet(out).count() == 1


def test_conform_adds_typed_nulls_and_drops_extras(spark):
    df = spark.createDataFrame([(1, "n", "x")], "id bigint, username string, junk string")
    c = conform(df, schemas.USERS)
    assert c.columns == [f.name for f in schemas.USERS.fields]
    assert c.collect()[0]["password"] is None


def test_stream_token_totals_complete_mode(spark):
    base = tempfile.mkdtemp(prefix="ws-j5-", dir="/tmp")
    log = spark.createDataFrame([(1, 7, ts("2024-05-01 00:00:00"), 10), (2, 7, ts("2024-05-02 00:00:00"), 5),
                                 (3, 8, ts("2024-06-01 00:00:00"), 1)],
                                "request_id bigint, user_id bigint, ts timestamp_ntz, total_tokens bigint")
    log.write.parquet(f"{base}/log")
    live = S.stream_token_totals(spark.readStream.schema(log.schema).parquet(f"{base}/log"))
    out = S.run_available_now(spark, live, mode="complete")
    assert rows(out, "user_id", "month_year", "tokens") == [(7, "0524", 15), (8, "0624", 1)]


def test_stream_token_totals_update_mode_snapshots_over_several_batches(spark):
    base = tempfile.mkdtemp(prefix="ws-j5u-", dir="/tmp")
    schema = "request_id bigint, user_id bigint, ts timestamp_ntz, total_tokens bigint"
    for k, rows_ in enumerate([[(1, 7, ts("2024-05-01 00:00:00"), 10)],
                               [(2, 7, ts("2024-05-02 00:00:00"), 5), (3, 8, ts("2024-06-01 00:00:00"), 1)],
                               [(4, 8, ts("2024-06-03 00:00:00"), 2)]]):
        spark.createDataFrame(rows_, schema).write.parquet(f"{base}/log/part{k}")
    src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
           .option("recursiveFileLookup", "true").parquet(f"{base}/log"))
    out = S.run_available_now(spark, S.stream_token_totals(src), mode="update", keys=["user_id", "month_year"])
    assert rows(out, "user_id", "month_year", "tokens") == [(7, "0524", 15), (8, "0624", 3)]


def test_late_rows_are_found_not_lost(spark):
    base = tempfile.mkdtemp(prefix="ws-late-", dir="/tmp")
    t0 = dt.datetime(2024, 1, 2)
    on_time = [(1, 1, "a", "user", t0, False, "s"), (2, 1, "b", "user", t0 + dt.timedelta(hours=3), False, "s")]
    late = [(3, 1, "c", "user", t0 - dt.timedelta(days=1), False, "s")]       # far behind the watermark
    spark.createDataFrame(on_time, MSG).write.parquet(f"{base}/in/f1")
    spark.createDataFrame(late, MSG).write.parquet(f"{base}/in/f2")
    src = (spark.readStream.schema(MSG).option("maxFilesPerTrigger", 1)
           .option("recursiveFileLookup", "true").parquet(f"{base}/in"))
    emitted = S.run_available_now(spark, S.stream_dedup(src, watermark="1 hour"))
    batch = spark.read.schema(MSG).option("recursiveFileLookup", "true").parquet(f"{base}/in")
    missing = S.late_rows(batch, emitted, ["id"])
    assert rows(emitted, "id") == [(1,), (2,)]
    assert rows(missing, "id") == [(3,)]


def test_snapshots_rewrite_only_the_touched_partitions(spark, tmp_path):
    """Per batch: the months it touches, whole; a retried batch changes nothing; what is no longer live goes."""
    schema = "user_id bigint, month_year string, tokens bigint"
    path = str(tmp_path / "snap")
    merge = S.snapshot_merge(path, ["user_id", "month_year"])
    frame = lambda rows_: spark.createDataFrame(rows_, schema)
    merge(frame([(u, m, 1) for u in range(50) for m in ("0124", "0224", "0324", None)]), 0)
    merge(frame([(1, "0124", 7), (99, "0124", 3)]), 1)
    assert sorted(os.listdir(f"{path}/data/v=1"))[-1:] == ["month_year=0124"] and len([d for d in os.listdir(f"{path}/data/v=1") if "=" in d]) == 1
    merge(frame([(1, "0124", 7), (99, "0124", 3)]), 1)  # the same batch again
    merge(frame([(2, "0224", 5), (None, "0424", 4), (3, None, 8)]), 2)
    merge(frame([]), 3)
    merge(frame([(None, "0424", 6)]), 4)
    got = latest_snapshot(spark, path, frame([]).schema, "month_year")
    want = {(u, m): 1 for u in range(50) for m in ("0124", "0224", "0324", None)}
    want |= {(1, "0124"): 7, (99, "0124"): 3, (2, "0224"): 5, (None, "0424"): 6, (3, None): 8}
    assert {(r.user_id, r.month_year): r.tokens for r in got.collect()} == want and got.count() == len(want)
    assert got.schema == frame([]).schema
    left = {v: sorted(d for d in os.listdir(f"{path}/data/{v}") if "=" in d) for v in sorted(os.listdir(f"{path}/data"))}
    assert left["v=0"] == ["month_year=0324"] and left["v=1"] == ["month_year=0124"]
    assert sorted(os.listdir(f"{path}/manifest")) == ["v=2", "v=4"]
