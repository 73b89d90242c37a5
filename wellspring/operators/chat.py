"""Chat sessions, threads, checkpoints and history for all users at once.

Tables (column names as in the application):
  sessions(user_id, session_name, persona, start_date, current)
  messages(id, user_id, message, role, timestamp, archive, session)
  summaries(user_id, session, summary, last_message_id[, id])

Scale notes: message text is dropped before every shuffle that does not need
it; per-session aggregates are partial (map-side) before the exchange, so a
user or session holding a third of all messages shuffles one row per map task.
Rankings use ``row_number`` over (user, session) windows; where only the top
``n`` rows are kept Spark inserts a group limit below the exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wellspring.fixed_values import SESSION_NAME_PREFIX, SESSION_PAGE_SIZE
from wellspring.functions.windows import chunked_row_number


def _msg_order():
    # Order by timestamp with id as tie-break (second precision gives ties).
    return [F.col("timestamp").asc(), F.col("id").asc()]


def session_message_stats(messages: DataFrame) -> DataFrame:
    """(user_id, session) -> last_message, message_count; partial aggregate, no text."""
    return (messages.select("user_id", "session", "id", "timestamp")
            .groupBy("user_id", F.col("session").alias("session_name"))
            .agg(F.max("timestamp").alias("last_message"), F.count("id").alias("message_count")))


def session_messages_left(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Every session with each of its messages; empty sessions keep one row of nulls."""
    m = messages.select("user_id", F.col("session").alias("session_name"),
                        F.col("id").alias("message_id"), "role", "timestamp")
    return (sessions.select("user_id", "session_name", "persona")
            .join(m, ["user_id", "session_name"], "left"))


def chat_history(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Per non-current session its persona (as ``type``), start date, latest
    message time and message count (0 for empty sessions), ranked latest-first
    per user with empty sessions last (T9); ties broken by name.

    The reference's DISTINCT has no effect (T10) and is not applied.
    """
    stats = session_message_stats(messages)
    hist = (sessions.filter(~F.col("current"))
            .select("user_id", "session_name", F.col("persona").alias("type"), "start_date")
            .join(stats, ["user_id", "session_name"], "left")
            .withColumn("message_count", F.coalesce("message_count", F.lit(0)).cast("bigint")))
    # Rank per user in two levels (day chunks of last_message), so a user with
    # a third of all sessions is not ordered by one task.
    return chunked_row_number(hist, ["user_id"], [F.col("last_message").desc_nulls_last(),
                                                  F.col("session_name").asc()],
                              "last_message", unit="day", descending=True, nulls_last=True)


def current_sessions(sessions: DataFrame) -> DataFrame:
    """The current session (name, persona) of each user."""
    return sessions.filter(F.col("current")).select("user_id", "session_name", "persona")


def session_detail(sessions: DataFrame, keys: DataFrame) -> DataFrame:
    """Detail of each requested (user_id, session_name); unknown keys give nulls."""
    s = sessions.select("user_id", "session_name", "persona", "current")
    return keys.select("user_id", "session_name").join(s, ["user_id", "session_name"], "left")


def chat_threads(messages: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Full threads in order, ``message`` renamed to ``content``, with position."""
    m = messages
    if keys is not None:
        m = m.join(keys.select("user_id", F.col("session_name").alias("session")),
                   ["user_id", "session"], "left_semi")
    m = m.select("user_id", "session", "id", "role", F.col("message").alias("content"), "timestamp")
    return chunked_row_number(m, ["user_id", "session"], _msg_order(), "timestamp", unit="hour")


def first_messages(messages: DataFrame, n: int = SESSION_PAGE_SIZE) -> DataFrame:
    """The oldest ``n`` messages of every session (T7), ordered by (timestamp, id).

    ``row_number() <= n`` lets Spark apply a per-group limit before the shuffle.
    """
    w = Window.partitionBy("user_id", "session").orderBy(*_msg_order())
    ranked = messages.select("user_id", "session", "id", "role", "message", "timestamp",
                             F.row_number().over(w).alias("position"))
    return ranked.filter(F.col("position") <= n)


def latest_summary(summaries: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Latest summary and checkpoint per (user, session) by last_message_id.

    One grouped ``max_by`` (sorted, as its value is text) replaces the two ``LIMIT 1`` lookups.
    With ``sessions`` given, every session is returned and missing ones get
    summary null and checkpoint 0.
    """
    order = F.struct("last_message_id", "id") if "id" in summaries.columns else F.col("last_message_id")
    latest = (summaries.groupBy("user_id", "session")
              .agg(F.max_by(F.struct("summary", "last_message_id"), order).alias("s"))
              .select("user_id", "session", "s.summary", "s.last_message_id"))
    if sessions is None:
        return latest
    keys = sessions.select("user_id", F.col("session_name").alias("session"))
    return (keys.join(latest, ["user_id", "session"], "left")
            .withColumn("last_message_id", F.coalesce("last_message_id", F.lit(0)).cast("bigint")))


def messages_after_checkpoint(messages: DataFrame, summaries: DataFrame) -> DataFrame:
    """Messages newer than their session's latest summary checkpoint (0 if none).

    Equi-join on (user_id, session) with the residual ``id > checkpoint``; the
    checkpoint side has one row per summarised session.
    """
    ck = (summaries.groupBy("user_id", "session")
          .agg(F.max("last_message_id").alias("checkpoint")))
    m = messages.select("user_id", "session", "id", "role", F.col("message").alias("content"), "timestamp")
    return (m.join(ck, ["user_id", "session"], "left")
            .withColumn("checkpoint", F.coalesce("checkpoint", F.lit(0)).cast("bigint"))
            .filter(F.col("id") > F.col("checkpoint")))


def restorable_sessions(sessions: DataFrame, restores: DataFrame) -> DataFrame:
    """Restore requests flagged by whether the named session exists (semi/anti join)."""
    # One left join against the distinct keys (a semi and an anti join in one
    # pass); both sides shuffle on the same keys, so the distinct's exchange is reused.
    s = sessions.select("user_id", "session_name").distinct().withColumn("found", F.lit(True))
    return (restores.join(s, ["user_id", "session_name"], "left")
            .withColumn("restorable", F.coalesce("found", F.lit(False))).drop("found"))


def current_from_log(sessions: DataFrame, switch_log: DataFrame) -> DataFrame:
    """Sessions after a log of creates and restores, with exactly one current per user.

    A create adds a session and makes it current; a restore makes an existing
    session current (unknown names change nothing, C7).  A name exists when it
    is in ``sessions`` or was created earlier in the log.  The winner per user
    is ``max_by`` over (ts, seq) of the valid switches; "earlier" is by (ts, seq) too.
    """
    log = switch_log.select("seq", "user_id", "ts", "action", "session_name", "persona")
    creates = log.filter(F.col("action") == "create")
    restores = log.filter(F.col("action") == "restore")
    made = F.struct(F.col("ts").alias("t"), F.col("seq").alias("s"))
    known_before = (sessions.select("user_id", "session_name", F.lit(None).alias("made"))
                    .unionByName(creates.select("user_id", "session_name", made.alias("made")))
                    .groupBy("user_id", "session_name")
                    .agg(F.min("made").alias("made"), F.max(F.col("made").isNull()).alias("in_base")))
    valid_restores = (restores.join(known_before, ["user_id", "session_name"], "inner")
                      .filter(F.col("in_base") | (F.col("made") < made))
                      .select("seq", "user_id", "ts", "session_name"))
    switches = creates.select("seq", "user_id", "ts", "session_name").unionByName(valid_restores)
    winner = (switches.groupBy("user_id")
              .agg(F.max_by("session_name", F.struct("ts", "seq")).alias("winner")))
    all_sessions = (sessions.select("user_id", "session_name", "persona", "start_date", "current")
                    .unionByName(creates.select("user_id", "session_name", "persona",
                                                F.col("ts").alias("start_date"),
                                                F.lit(False).alias("current"))))
    out = all_sessions.join(winner, "user_id", "left")
    return out.select("user_id", "session_name", "persona", "start_date",
                      F.when(F.col("winner").isNull(), F.col("current"))
                      .otherwise(F.col("session_name") == F.col("winner")).alias("current"))


def session_names(switch_log: DataFrame, counters: DataFrame | None = None) -> DataFrame:
    """Default name ``session-N`` of each session creation in (ts, seq) order.

    The counter stored for a user (``counters``: user_id, session_counter as
    number or text, one row a user) is itself the next name's number and rises
    afterwards; it starts at 1 where none is stored, or none that is a number."""
    creates = switch_log.filter(F.col("action") == "create").select("seq", "user_id", "ts")
    n = chunked_row_number(creates, ["user_id"], [F.col("ts"), F.col("seq")], "ts", unit="day", name="counter")
    if counters is not None:
        stored = counters.select("user_id", F.col("session_counter").try_cast("int").alias("_from"))
        n = n.join(stored, "user_id", "left").withColumn("counter", F.col("counter") + F.coalesce("_from", F.lit(1)) - 1)
    return n.select("seq", "user_id", "ts", "counter",
                    F.concat(F.lit(SESSION_NAME_PREFIX), F.col("counter").cast("string")).alias("default_name"))


def global_stats(messages: DataFrame, users: DataFrame) -> DataFrame:
    """One row with the number of conversation rows and of users.

    A union of two key-only projections and one aggregate: no cross join.
    """
    tagged = (messages.select(F.lit(1).alias("k"))
              .unionByName(users.select(F.lit(2).alias("k"))))
    return tagged.agg(F.count_if(F.col("k") == 1).alias("conversations"),
                      F.count_if(F.col("k") == 2).alias("users"))


def thread_labels(messages: DataFrame, assistant_label: str = "Assistant") -> DataFrame:
    """Sender label per message: ``You`` for user rows, the assistant's name otherwise."""
    return messages.select("id", "user_id", "session", "role",
                           F.when(F.col("role") == "user", F.lit("You"))
                           .otherwise(F.lit(assistant_label)).alias("label"))


def current_flag_check(sessions: DataFrame) -> DataFrame:
    """Users whose number of current sessions is not exactly one."""
    return (sessions.groupBy("user_id")
            .agg(F.sum(F.col("current").cast("int")).cast("bigint").alias("current_count"),
                 F.count("*").alias("session_count"))
            .filter(F.col("current_count") != 1))


def dedup_messages(messages: DataFrame) -> DataFrame:
    """J7 (batch form): one row per message id (re-delivered rows dropped)."""
    return messages.dropDuplicates(["id"])
