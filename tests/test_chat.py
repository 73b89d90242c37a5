"""Chat operators on hand-written tables (cases from the application's own tests)."""

from conftest import rows, ts

from wellspring.operators import chat

SESS = "user_id bigint, session_name string, persona string, start_date timestamp_ntz, current boolean"
MSG = "id bigint, user_id bigint, message string, role string, timestamp timestamp_ntz, archive boolean, session string"


def _history_case(spark):
    sessions = spark.createDataFrame([
        (1, "s1", "CBT", ts("2024-01-01 10:00:00"), False),
        (1, "s2", "Life Coach", ts("2024-01-02 10:00:00"), True),
        (1, "empty", "DBT", ts("2024-01-03 10:00:00"), False),
        (2, "s1", "CBT", ts("2024-01-01 10:00:00"), True),
    ], SESS)
    messages = spark.createDataFrame([
        (1, 1, "Hello", "user", ts("2024-01-01 10:00:01"), False, "s1"),
        (2, 1, "Hi there!", "assistant", ts("2024-01-01 10:00:01"), False, "s1"),
        (3, 1, "x", "user", ts("2024-01-02 10:00:01"), False, "s2"),
        (4, 1, "y", "assistant", ts("2024-01-02 10:00:02"), False, "s2"),
    ], MSG)
    return sessions, messages


def test_history_only_non_current_with_zero_counts(spark):
    sessions, messages = _history_case(spark)
    h = chat.chat_history(sessions, messages)
    got = rows(h, "user_id", "session_name", "type", "message_count", "position")
    # s2 is current and hidden; the empty session counts 0 and sorts last (nulls last).
    assert got == [(1, "empty", "DBT", 0, 2), (1, "s1", "CBT", 2, 1)]


def test_thread_order_breaks_timestamp_ties_by_id(spark):
    _, messages = _history_case(spark)
    t = chat.chat_threads(messages).filter("session = 's1'")
    assert [r["content"] for r in t.orderBy("position").collect()] == ["Hello", "Hi there!"]


def test_first_messages_limit_is_per_session(spark):
    _, messages = _history_case(spark)
    got = rows(chat.first_messages(messages, n=1), "session", "id")
    assert got == [("s1", 1), ("s2", 3)]


def test_latest_summary_and_missing_checkpoint(spark):
    sessions, _ = _history_case(spark)
    summaries = spark.createDataFrame([(1, "s1", "old", 2), (1, "s1", "new", 4)],
                                      "user_id bigint, session string, summary string, last_message_id bigint")
    got = rows(chat.latest_summary(summaries, sessions), "user_id", "session", "summary", "last_message_id")
    assert (1, "s1", "new", 4) in got
    assert (1, "empty", None, 0) in got


def test_messages_after_checkpoint(spark):
    _, messages = _history_case(spark)
    summaries = spark.createDataFrame([(1, "s1", "sum", 1)],
                                      "user_id bigint, session string, summary string, last_message_id bigint")
    got = rows(chat.messages_after_checkpoint(messages, summaries), "id", "checkpoint")
    assert got == [(2, 1), (3, 0), (4, 0)]


def test_restore_unknown_session_changes_nothing(spark):
    sessions, _ = _history_case(spark)
    log = spark.createDataFrame([
        (10, 1, ts("2024-02-01 00:00:00"), "restore", "nope", None),
        (11, 2, ts("2024-02-01 00:00:00"), "restore", "s1", None),
        (12, 1, ts("2024-02-02 00:00:00"), "restore", "s1", None),
    ], "seq bigint, user_id bigint, ts timestamp_ntz, action string, session_name string, persona string")
    out = chat.current_from_log(sessions, log)
    cur = rows(out.filter("current"), "user_id", "session_name")
    assert cur == [(1, "s1"), (2, "s1")]
    assert chat.current_flag_check(out).count() == 0


def test_create_then_restore_in_same_log(spark):
    sessions, _ = _history_case(spark)
    log = spark.createDataFrame([
        (1, 2, ts("2024-02-01 00:00:00"), "create", "fresh", "CBT"),
        (2, 2, ts("2024-02-02 00:00:00"), "restore", "s1", None),
        (3, 2, ts("2024-02-03 00:00:00"), "restore", "fresh", None),
    ], "seq bigint, user_id bigint, ts timestamp_ntz, action string, session_name string, persona string")
    out = chat.current_from_log(sessions, log)
    assert rows(out.filter("current AND user_id = 2"), "session_name") == [("fresh",)]


def test_global_stats(spark):
    sessions, messages = _history_case(spark)
    users = spark.createDataFrame([(1,), (2,), (3,)], "id bigint")
    r = chat.global_stats(messages, users).collect()[0]
    assert (r["conversations"], r["users"]) == (4, 3)
