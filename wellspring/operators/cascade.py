"""Bulk changes over several tables: rename, persona change, archive, deletes,
clear and erase (H6-H12).  Each takes the current tables and a request table
and returns new DataFrames; the caller writes them to new paths and publishes
them together (no half-applied change).

Request tables are joined, not broadcast: a batch of requests is not assumed
small, so AQE picks broadcast or shuffle at runtime from actual sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.functions.graph import components
from wellspring.functions.joins import null_safe_join
from wellspring.session import materialize


def _flag(df: DataFrame, cols: list[str], name: str = "_hit") -> DataFrame:
    return df.select(*cols).distinct().withColumn(name, F.lit(True))


_REPLAYED = "user_id bigint, old_name string, new_name string, seq bigint, reason string"
_OUT_ROWS = 10_000


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Renames in order, connected ones one after another.  Each names per side
    whether a session has the name at first, and the last ``seq`` that mentions
    it.  Gives a row per label that ends elsewhere and one, with ``seq``, per
    rejected request."""
    live: dict = {}  # (user, name) -> whether a session has it now, first names of the labels that stand there
    ending: set = set()  # those whose last mention is at the present seq
    out, at = [], None

    def ended() -> list:
        gone = [(key, live.pop(key)[1]) for key in ending]
        ending.clear()
        return [(user, first, name, None, None) for (user, name), firsts in gone for first in firsts if first != name]

    def packed(rows: list) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
        for k in range(0, len(rows), _OUT_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k:k + _OUT_ROWS]), kinds)],
                                             names=["user_id", "old_name", "new_name", "seq", "reason"])

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("part", "seq", "user_id", "old_name", "new_name", "old_there",
                                                      "new_there", "old_last", "new_last")]
        for part, seq, user, old, new, old_there, new_there, old_last, new_last in zip(*cols):
            if at != (part, seq):
                out += ended()
                at = part, seq
                if len(out) >= _OUT_ROWS:
                    yield from packed(out)
                    out = []
            source = live.setdefault((user, old), [old_there, [old]])
            target = live.setdefault((user, new), [new_there, [new]])
            if source[0] and target[0]:
                out.append((user, old, new, seq, "name_exists"))
            else:
                if source[0]:
                    source[0], target[0] = False, True
                some, more = sorted((source[1], target[1]), key=len)
                more += some
                source[1], target[1] = [], more
            ending.update((user, name) for name, last in ((old, old_last), (new, new_last)) if last == seq)
    yield from packed(out + ended())


def rename_cascade(sessions: DataFrame, messages: DataFrame, summaries: DataFrame,
                   renames: DataFrame) -> dict[str, DataFrame]:
    """H6: rename (user_id, old_name) -> new_name in sessions, messages and summaries.

    Requests of a user run one after another by ``seq``.  One whose source
    exists and whose new name is another existing session's would break the
    unique key (user_id, session_name); in the original that raises, so it
    changes nothing and goes to ``rejects``.  A rename to its own name changes
    nothing.  An unknown source renames no session but the labels of messages
    and summaries that carry it.

    Requests affect each other only through names they share, so those of a user
    are cut into connected components of names, which tasks replay in parallel.
    They stream in batches; a task keeps the names between their first and last
    mention, with the labels that stand there.
    """
    r = (renames.filter("user_id is not null and not old_name <=> new_name")
         .select("seq", "user_id", "old_name", "new_name").withColumn("_a", F.xxhash64("user_id", "old_name")))
    # Equal hashes of different names only put their requests into one task.
    linked = components(r.select(F.col("_a").alias("a"), F.xxhash64("user_id", "new_name").alias("b")))
    todo = r.join(linked, F.col("_a") == F.col("v"), "left").withColumn("part", F.coalesce("component", "_a")).drop("_a", "v", "component")
    there = sessions.select("user_id", F.col("session_name").alias("name")).distinct().withColumn("there", F.lit(True))
    named = (r.select("user_id", "seq", F.explode(F.array("old_name", "new_name")).alias("name"))
             .groupBy("user_id", "name").agg(F.max("seq").alias("last"))
             .join(there, ["user_id", "name"], "left").withColumn("there", F.coalesce("there", F.lit(False))))
    for side in ("old", "new"):
        todo = null_safe_join(todo, named.withColumnsRenamed({c: f"{side}_{c}" for c in ("name", "last", "there")}),
                              ["user_id", f"{side}_name"])
    todo = todo.repartition("part").sortWithinPartitions("part", "seq", "old_name", "new_name")
    replayed = materialize(todo.mapInArrow(_replay, _REPLAYED))  # read by the four results
    moved = replayed.filter(F.col("reason").isNull()).select("user_id", "old_name", "new_name")
    rejects = replayed.filter(F.col("reason").isNotNull()).select("seq", "user_id", "old_name", "new_name", "reason")

    def apply(df: DataFrame, col: str, names: DataFrame) -> DataFrame:
        m = names.withColumnRenamed("old_name", col)
        return (df.join(m, ["user_id", col], "left")
                .withColumn(col, F.coalesce("new_name", col)).drop("new_name").select(*df.columns))

    return {"sessions": apply(sessions, "session_name", moved), "messages": apply(messages, "session", moved),
            "summaries": apply(summaries, "session", moved), "rejects": rejects}


def persona_merge(sessions: DataFrame, requests: DataFrame, session_types: DataFrame) -> dict[str, DataFrame]:
    """H7 + Q2: change the persona of (user_id, session_name); unknown personas are rejected.

    Of several valid requests for one session the last by ``seq`` wins.
    """
    known = _flag(session_types, ["persona"], "_known")
    judged = requests.join(known, "persona", "left")
    rejects = judged.filter(F.col("_known").isNull()).drop("_known")
    valid = judged.filter(F.col("_known").isNotNull())
    last = valid.groupBy("user_id", "session_name").agg(F.max_by("persona", "seq").alias("_new"))
    out = (sessions.join(last, ["user_id", "session_name"], "left")
           .withColumn("persona", F.coalesce("_new", "persona")).drop("_new").select(*sessions.columns))
    return {"sessions": out, "rejects": rejects}


def archive_open(messages: DataFrame, requests: DataFrame) -> DataFrame:
    """Archive every open message of a requesting user and, when the
    request names a session, move those messages to it (from every session).

    Only a user's first request (by seq) finds open messages; later ones find
    none, so the first request's name is the one applied.
    """
    first = (requests.groupBy("user_id")
             .agg(F.min_by(F.struct("new_name"), "seq").alias("_r"))
             .select("user_id", F.col("_r.new_name").alias("_name"), F.lit(True).alias("_req")))
    j = messages.join(first, "user_id", "left")
    hit = F.col("_req").isNotNull() & ~F.col("archive")
    return (j.withColumn("session", F.when(hit, F.coalesce("_name", "session")).otherwise(F.col("session")))
            .withColumn("archive", F.when(hit, F.lit(True)).otherwise(F.col("archive")))
            .select(*messages.columns))


def delete_open(messages: DataFrame, users: DataFrame) -> DataFrame:
    """Delete every unarchived message of the requesting users (all sessions)."""
    req = _flag(users, ["user_id"])
    return (messages.join(req, "user_id", "left")
            .filter(F.col("_hit").isNull() | F.col("archive")).select(*messages.columns))


def delete_session_cascade(sessions: DataFrame, messages: DataFrame, summaries: DataFrame,
                           deletes: DataFrame) -> dict[str, DataFrame]:
    """Delete (user_id, session_name) from sessions, messages and summaries;
    unknown names change nothing."""
    d = deletes.select("user_id", "session_name").distinct()
    return {"sessions": sessions.join(d, ["user_id", "session_name"], "left_anti"),
            "messages": messages.join(d.withColumnRenamed("session_name", "session"), ["user_id", "session"],
                                      "left_anti"),
            "summaries": summaries.join(d.withColumnRenamed("session_name", "session"), ["user_id", "session"],
                                        "left_anti")}


def clear_history(messages: DataFrame, summaries: DataFrame, users: DataFrame) -> dict[str, DataFrame]:
    """Delete all messages and summaries of the users; sessions are kept."""
    u = users.select("user_id").distinct()
    return {"messages": messages.join(u, "user_id", "left_anti"),
            "summaries": summaries.join(u, "user_id", "left_anti")}


def erase_users(tables: dict[str, DataFrame], ids: DataFrame,
                payment_status: DataFrame | None = None) -> dict[str, DataFrame]:
    """Remove the users from every table keyed by user (``users`` by
    ``id``), including the token tables the original leaves behind, and
    payment rows whose subscription is gone.  Adds ``report``: rows before,
    after and removed per table (one small aggregate per table).
    """
    u = ids.select("user_id").distinct()
    out: dict[str, DataFrame] = {}
    for name, df in tables.items():
        key = "id" if name == "users" else "user_id"
        out[name] = df.join(u.withColumnRenamed("user_id", key), key, "left_anti")
    if payment_status is not None and "subscriptions" in out:
        alive = out["subscriptions"].select(F.col("id").alias("subscription_id"))
        out["payment_status"] = payment_status.join(alive, "subscription_id", "left_semi")
        tables = {**tables, "payment_status": payment_status}
    # Report: one pass per table (left join to the id flag, then count and
    # count_if), unioned; each table is read once for it.
    flag = u.withColumn("_gone", F.lit(True))
    parts = []
    for name, df in tables.items():
        key = "id" if name == "users" else ("subscription_id" if name == "payment_status" else "user_id")
        if name == "payment_status":
            alive = out["subscriptions"].select(F.col("id").alias("subscription_id"), F.lit(True).alias("_alive"))
            j = df.join(alive, "subscription_id", "left").withColumn("_gone", F.col("_alive").isNull())
        else:
            j = df.join(flag.withColumnRenamed("user_id", key), key, "left")
        parts.append(j.agg(F.count(F.lit(1)).alias("rows_before"),
                           F.count_if(F.col("_gone").isNull() | ~F.col("_gone")).alias("rows_after"))
                     .select(F.lit(name).alias("table"), "rows_before", "rows_after"))
    report = parts[0]
    for p in parts[1:]:
        report = report.unionByName(p)
    out["report"] = report.withColumn("removed", F.col("rows_before") - F.col("rows_after"))
    return out
