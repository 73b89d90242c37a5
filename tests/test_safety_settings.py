"""Safety (T27, T28), email pattern (T20), settings (T13, T37) and prompts."""

from pyspark.sql import functions as F

from conftest import rows, ts

from wellspring.functions.text import is_valid_email
from wellspring.operators import chat
from wellspring.operators import prompts as P
from wellspring.operators import safety as S
from wellspring.operators import settings as ST
from wellspring.sources.sinks import append_summaries


def test_typographic_apostrophe_missed_unless_normalised(spark):
    m = spark.createDataFrame([(1, 1, "user", "I can’t go on"), (2, 2, "user", "I can't go on")],
                              "id bigint, user_id bigint, role string, message string")
    assert rows(S.crisis_alerts(m), "id") == [(2,)]
    assert rows(S.crisis_alerts(m, normalize_quotes=True), "id") == [(1,), (2,)]


def test_hotlines_and_short_numbers(spark):
    c = spark.createDataFrame([(1, "us"), (2, "CA"), (3, "ZZ"), (4, None)], "user_id bigint, country string")
    m = spark.createDataFrame([(i, i, "user", "I want to die") for i in range(1, 5)],
                              "id bigint, user_id bigint, role string, message string")
    got = {r["user_id"]: (r["hotline"], r["phone"], r["marker"]) for r in S.crisis_alerts(m, c).collect()}
    assert got[1] == ("988", None, True)                       # too short for the phone pattern
    assert got[2] == ("1-833-456-4566", "1-833-456-4566", True)
    assert got[3][0] == "N/A" and got[4][0] == "a local support number"


def test_email_pattern_is_anchored_at_start_only(spark):
    df = spark.createDataFrame([("a@b.c@d",), ("invalid-email-format",), ("x@y.z",)], "e string")
    assert rows(df.select("e", is_valid_email("e").alias("ok")), "e", "ok") == [
        ("a@b.c@d", True), ("invalid-email-format", False), ("x@y.z", True)]


def test_properties_rename_compares_unstripped_key(spark):
    lines = spark.createDataFrame([(1, 1, "msg_retention=5"), (2, 1, "msg_retention =7"), (2, 2, "# c"),
                                   (2, 3, ""), (2, 4, "voice=en=US"), (3, 1, "noequals")],
                                  "tenant bigint, line_no bigint, value string")
    props, rejects = ST.parse_properties(lines)
    assert rows(props, "tenant", "key", "value") == [(1, "summary_count", "5"), (2, "msg_retention", "7"),
                                                     (2, "voice", "en=US")]
    assert rejects.count() == 1


def test_settings_none_text_only_when_requested(spark):
    log = spark.createDataFrame([(1, 1, "voice", None, ts("2024-01-01 00:00:00"))],
                                "seq bigint, user_id bigint, setting_key string, setting_value string, ts timestamp_ntz")
    assert ST.settings_merge(log).count() == 0
    assert rows(ST.settings_merge(log, skip_nulls=False), "setting_value") == [("None",)]


def test_effective_settings_override_wins(spark):
    users = spark.createDataFrame([(1,), (2,)], "id bigint")
    ov = spark.createDataFrame([(1, "model", "claude-x"), (1, "extra", "v")],
                               "user_id bigint, setting_key string, setting_value string")
    eff = {(r["user_id"], r["setting_key"]): r["setting_value"] for r in ST.effective_settings(users, ov).collect()}
    assert eff[(1, "model")] == "claude-x" and eff[(2, "model")] == "gpt-4o"
    assert eff[(1, "extra")] == "v" and eff[(2, "summary_count")] == "100"


def test_profile_intro_drops_zero_age(spark):
    u = spark.createDataFrame([(1, "Ann", 0, "Female", "")], "id bigint, username string, age int, sex string, bio string")
    assert P.profile_intro(u).collect()[0]["intro"] == "My name is Ann. I am female."


def test_summary_trigger_modes(spark):
    msgs = spark.createDataFrame(
        [(k, 1, "s", "user" if k % 2 else "assistant") for k in range(1, 11)],
        "id bigint, user_id bigint, session string, role string").withColumn("message", F.lit("m"))
    got = [(r["turn_id"], r["triggered"], r["checkpoint_after"])
           for r in P.summary_triggers(msgs, threshold=4).orderBy("turn_id").collect()]
    # turns at ids 1,3,5,7,9; stored before turn 5 are ids 1-4 -> trigger, checkpoint 4.
    assert got == [(1, False, 0), (3, False, 0), (5, True, 4), (7, False, 4), (9, True, 8)]
    cnt = [(r["turn_id"], r["triggered"]) for r in
           P.summary_triggers(msgs, threshold=4, mode="count").orderBy("turn_id").collect()]
    assert cnt == [(1, False), (3, False), (5, True), (7, False), (9, True)]


def test_casual_chat_uses_casual_prompt_and_no_summary(spark):
    from wellspring.operators.settings import persona_table
    turns = spark.createDataFrame([(11, 1, "Casual", "CBT", "hi")],
                                  "request_id bigint, user_id bigint, session string, persona string, user_input string")
    msgs = spark.createDataFrame([(5, 1, "old", "user", "Casual")],
                                 "id bigint, user_id bigint, message string, role string, session string")
    sums = spark.createDataFrame([(1, "Casual", "sum", 5)],
                                 "user_id bigint, session string, summary string, last_message_id bigint")
    out = P.chat_requests(turns, msgs, sums, persona_table(spark), None, casual=True).orderBy("part").collect()
    assert [(r["part"], r["role"]) for r in out] == [(0, "system"), (3, "user")]
    assert out[0]["content"].startswith("You are a friendly, empathetic companion.")


def test_unique_check_with_case_and_accent_insensitive_collation(spark):
    from wellspring.operators.quality import unique_check
    df = spark.createDataFrame([(1, "Élan@x.com"), (2, "elan@x.com"), (3, "other@x.com")], "seq bigint, email string")
    assert unique_check(df, ["email"], "seq").count() == 0                      # binary: all distinct
    dup = unique_check(df, ["email"], "seq", collation="UNICODE_CI_AI").collect()
    assert len(dup) == 1 and dup[0]["rows"] == 2 and dup[0]["kept_seq"] == 1


def test_properties_files_are_read_in_line_order_however_they_are_split(spark, tmp_path):
    lines = [(t, n, f"key{n % 5}={t}-{n}") for t in (1, 2) for n in range(3000)]
    lines += [(1, 3000, "no separator"), (1, 3001, "# comment"), (1, 3002, None), (2, 3000, "msg_retention=7"), (2, 3001, "a=b\nc=d")]
    path = str(tmp_path / "props")
    ST.write_properties(spark.createDataFrame(lines, "tenant bigint, line_no bigint, value string"), path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 4
        props, rejects = ST.read_properties(spark, path, "/tenant=([0-9]+)/")
        got = {(r["tenant"], r["key"]): r["value"] for r in props.collect()}
        bad = [(r["tenant"], r["line"]) for r in rejects.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    last = {(str(t), f"key{k}"): f"{t}-{2995 + k}" for t in (1, 2) for k in range(5)}
    assert got == last | {("2", "summary_count"): "7", ("2", "a"): "b c=d"}
    assert bad == [("1", "no separator")]
    by_file, _ = ST.read_properties(spark, path)
    assert by_file.select("file").distinct().count() == 2


def test_session_names_start_at_the_stored_counter(spark):
    log = spark.createDataFrame([(i, u, ts("2024-01-01 00:00:00"), "create", None, None) for i, u in enumerate([1, 1, 2, 3, 4, 4, 4])],
                                "seq bigint, user_id bigint, ts timestamp_ntz, action string, session_name string, persona string")
    counters = spark.createDataFrame([(1, "5"), (3, None), (4, "x")], "user_id bigint, session_counter string")
    got = [r["default_name"] for r in chat.session_names(log, counters).orderBy("seq").collect()]
    assert got == ["session-5", "session-6", "session-1", "session-1", "session-1", "session-2", "session-3"]


def test_summaries_without_a_time_get_the_appends(spark, tmp_path):
    s = spark.createDataFrame([(1, "s", "x", 4)], "user_id bigint, session string, summary string, last_message_id bigint")
    append_summaries(s, str(tmp_path / "s"), as_of="2024-01-05 10:00:00")
    row = spark.read.parquet(str(tmp_path / "s")).first()
    assert row["created_at"] == ts("2024-01-05 10:00:00") and str(row["created_date"]) == "2024-01-05"


def test_orphan_keys_are_dealt_to_a_given_number_of_tasks(spark):
    """AQE would merge the shuffles of keys, which compress well, into a few tasks."""
    from wellspring.operators import quality as Q
    users = spark.range(0, 1000)
    messages = spark.range(0, 3000).select(F.when(F.col("id") % 3 == 0, F.lit(5000)).when(F.col("id") % 3 == 1, F.col("id")).alias("user_id"))
    got = Q.fk_orphans({"users": users, "conversations": messages}, [("conversations", ["user_id"], "users", ["id"])])
    assert got.rdd.getNumPartitions() >= 64
    want = [("conversations", "user_id", "5000", 1000)] + [("conversations", "user_id", str(i), 1) for i in range(1000, 3000) if i % 3 == 1]
    assert rows(got, "child", "column", "value", "rows") == sorted(want, key=repr)
