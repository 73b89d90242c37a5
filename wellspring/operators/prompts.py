"""Prompt and response tables around the language model.
The model call itself is not built; these operators prepare its input rows
and ingest its output rows for all users at once.

Message arrays are emitted as rows (request_id, part, pos, role, content), so
no list is collected per session: ``part`` orders the sections (0 system
prompt or summary, 1 profile, 2 history, 3 the new user message) and ``pos``
orders rows inside a section (the message id for history).  The history of a
turn is a range join on (user_id, session) with ``checkpoint < id < turn``:
its size is exactly the prompt payload.

The summary trigger (J4) is order dependent: sessions are packed into chunks
of sorted ids, and a session's chunks run past its checkpoint in order.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellspring.fixed_values import (CASUAL_PERSONA, CASUAL_SESSION, INTRO_AGE, INTRO_BIO, INTRO_NAME, INTRO_SEX,
                                     REFLECTION_EMPTY_TEXT, REFLECTION_SYSTEM_TEXT, REFLECTION_USER_TEXT,
                                     SUMMARY_CLOSE_TEXT, SUMMARY_FIRST_TEXT, SUMMARY_SO_FAR_TEXT,
                                     SUMMARY_TRIGGER_DEFAULT, SUMMARY_UPDATE_TEXT)
from wellspring.functions.dates import month_key
from wellspring.functions.joins import null_safe_join
from wellspring.session import materialize
from wellspring.functions.windows import asof_mark, chunked_row_number

_MSG_ARRAY = "array<struct<part:int,pos:bigint,role:string,content:string>>"


def _fmt(template: str, **cols: Column) -> Column:
    """Fill a ``{name}`` template with column values (None prints as ``None``)."""
    parts, rest = [], template
    while "{" in rest:
        pre, tail = rest.split("{", 1)
        name, rest = tail.split("}", 1)
        parts += [F.lit(pre), F.coalesce(cols[name].cast("string"), F.lit("None"))]
    parts.append(F.lit(rest))
    return F.concat(*parts)


def profile_intro_col(username="username", age="age", sex="sex", bio="bio") -> Column:
    """K1: 'My name is X.' plus the age, sex (lower-cased) and bio parts when truthy
    (an age of 0 and empty strings are dropped, as Python's ``if`` would)."""
    u, a, s, b = (F.col(x) if isinstance(x, str) else x for x in (username, age, sex, bio))
    return F.concat(
        _fmt(INTRO_NAME, username=u),
        F.when(a.isNotNull() & (a != 0), _fmt(INTRO_AGE, age=a)).otherwise(F.lit("")),
        F.when(s.isNotNull() & (s != ""), _fmt(INTRO_SEX, sex=F.lower(s))).otherwise(F.lit("")),
        F.when(b.isNotNull() & (b != ""), _fmt(INTRO_BIO, bio=b)).otherwise(F.lit("")))


def profile_intro(users: DataFrame) -> DataFrame:
    """K1 over the users table."""
    return users.select(F.col("id").alias("user_id"), profile_intro_col().alias("intro"))


def prompt_join(df: DataFrame, session_types: DataFrame, persona_col: str = "persona") -> DataFrame:
    """Attach the persona's system prompt; unknown personas get null.

    The persona dimension has one row per persona; whether it is broadcast is
    left to Spark's own size check.
    """
    p = session_types.select(F.col("persona").alias(persona_col), "prompt")
    return df.join(p, persona_col, "left")


def summary_as_of(turns: DataFrame, summaries: DataFrame) -> DataFrame:
    """Latest summary of each turn's session stored before the turn (checkpoint < turn id).

    The checkpoint is an as-of lookup (no turn x summary pairs); its text is
    then an equi-join on (user, session, checkpoint), in which a null session is one.
    """
    k = turns.select("request_id", "user_id", "session", (F.col("request_id") - 1).alias("_below"))
    ck = asof_mark(k, summaries, ["user_id", "session"], "_below", "last_message_id", name="checkpoint") \
        .filter(F.col("checkpoint").isNotNull()).drop("_below")
    texts = (summaries.groupBy("user_id", "session", F.col("last_message_id").alias("checkpoint"))
             .agg((F.max_by("summary", "id") if "id" in summaries.columns else F.max("summary")).alias("summary")))
    return null_safe_join(ck, texts, ["user_id", "session", "checkpoint"]).select("request_id", "summary", "checkpoint")


def _msg(part: int, pos: Column, role, content: Column) -> Column:
    r = F.lit(role) if isinstance(role, str) else role
    return F.struct(F.lit(part).alias("part"), pos.cast("bigint").alias("pos"), r.alias("role"),
                    content.cast("string").alias("content"))


def chat_requests(turns: DataFrame, messages: DataFrame, summaries: DataFrame, session_types: DataFrame,
                  users: DataFrame | None = None, casual: bool = False) -> DataFrame:
    """K3 (T4-T6): the message rows sent to the model for each chat turn.

    ``turns``: (request_id, user_id, session, persona, user_input[, history]);
    ``request_id`` is the id the user message gets, so stored messages of the
    turn are those with a smaller id.  With a summary: [summary so far] +
    stored messages after its checkpoint.  Without: [persona prompt] +
    [profile] + client history (empty for the web client, T6).  Then the new
    user message.  The persona prompt and profile are dropped on the summary
    path (T5).

    Plan: each turn is enriched once (summary as-of, size-checked prompt join, profile
    intro) and all its fixed rows come out of one ``explode``; only the stored
    history is a second branch (the range join on the session).

    ``casual=True`` is the casual chat (T38): always the casual persona's
    prompt, never a summary.
    """
    if casual:
        # One fixed persona: its prompt is a scalar subquery, not a join.
        prompt = (session_types.filter(F.col("persona") == CASUAL_PERSONA)
                  .agg(F.max("prompt")).scalar())
        t = (turns.withColumn("persona", F.lit(CASUAL_PERSONA)).withColumn("prompt", prompt)
             .withColumn("summary", F.lit(None).cast("string")).withColumn("checkpoint", F.lit(None).cast("bigint")))
    else:
        t = prompt_join(turns.join(summary_as_of(turns, summaries), "request_id", "left"), session_types)
    if users is not None:
        t = t.join(profile_intro(users), "user_id", "left")
    else:
        t = t.withColumn("intro", F.lit(None).cast("string"))
    if not casual:
        t = materialize(t)  # parsed, looked up and joined once for its two branches
    has = F.col("summary").isNotNull()
    zero = F.lit(0)
    fixed = F.array(
        F.when(has, _msg(0, zero, "system", _fmt(SUMMARY_SO_FAR_TEXT, summary=F.col("summary")))),
        F.when(~has, _msg(0, zero, "system", F.col("prompt"))),
        F.when(~has & F.col("intro").isNotNull(), _msg(1, zero, "system", F.col("intro"))),
        _msg(3, zero, "user", F.col("user_input")))
    if "history" in turns.columns:
        client = F.when(~has, F.transform(F.coalesce("history", F.array()), lambda x, i: _msg(2, i, x["role"],
                                                                                             x["content"])))
        items = F.concat(fixed, F.coalesce(client, F.array().cast(_MSG_ARRAY)))
    else:
        items = fixed
    rows = (t.select("request_id", F.explode(F.filter(items, lambda x: x.isNotNull())).alias("r"))
            .select("request_id", "r.part", "r.pos", "r.role", "r.content"))
    # Stored history: each message is tagged with its checkpoint segment (the
    # latest summary checkpoint below its id, an as-of lookup), and joined to
    # the turns of that segment only, so a long session never pairs every
    # turn with every message.
    m = messages.filter(F.col("role") != "system").select(
        "user_id", "session", F.col("id").alias("mid"), "role", F.col("message").alias("content"),
        (F.col("id") - 1).alias("_below"))
    if casual:
        return rows
    m = asof_mark(m, summaries, ["user_id", "session"], "_below", "last_message_id", name="checkpoint")
    stored = (null_safe_join(t.filter(has).select("request_id", "user_id", "session", "checkpoint"),
                             m.drop("_below").filter("checkpoint is not null"), ["user_id", "session", "checkpoint"])
              .filter(F.col("mid") < F.col("request_id"))
              .select("request_id", F.lit(2).alias("part"), F.col("mid").alias("pos"), "role", "content"))
    return rows.unionByName(stored)


class TriggerRun:
    """The summary checkpoint of one session while its stored messages go by in chunks of sorted ids.

    Of what went by, only the ids above the checkpoint are held, as arrays, and
    only in ``count`` mode, where the checkpoint lags behind the ids; it never
    falls, so they are dropped from the front.
    """

    def __init__(self, threshold: int, mode: str, checkpoint: int):
        self.threshold, self.mode, self.checkpoint = threshold, mode, checkpoint
        self.above = 0  # messages that went by above the checkpoint
        self.last = 0
        self.held: deque = deque()
        self.held_n = 0

    def _move(self, checkpoint: int, seen: np.ndarray) -> None:
        self.checkpoint = checkpoint
        if self.mode == "max_id":
            self.above = 0
            return
        while self.held and self.held[0][-1] <= checkpoint:
            self.held_n -= len(self.held.popleft())
        if self.held:
            gone = int(np.searchsorted(self.held[0], checkpoint, "right"))
            self.held[0] = self.held[0][gone:]
            self.held_n -= gone
        self.above = self.held_n + len(seen) - int(np.searchsorted(seen, checkpoint, "right"))

    def turns(self, ids: np.ndarray, user: np.ndarray) -> list[np.ndarray]:
        """Per user turn of the chunk: pending messages, fired, checkpoint before and after."""
        at = np.flatnonzero(user)  # places of the turns
        recent, fired = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
        before, after = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        k = start = 0  # the next turn; the chunk's messages before ``start`` are in ``above``
        while True:
            first = max(start, int(np.searchsorted(ids, self.checkpoint, "right")))
            # The first turn with enough messages above the checkpoint before it.
            need = first + max(0, self.threshold - self.above) if self.above < self.threshold else 0
            hit = max(k, int(np.searchsorted(at, need)))
            upto = min(hit + 1, len(at))
            recent[k:upto] = self.above + np.maximum(0, at[k:upto] - first)
            before[k:upto] = after[k:upto] = self.checkpoint
            if hit >= len(at):
                self.above += max(0, len(ids) - first)
                break
            place = int(at[hit])
            fired[hit] = True
            # Corrected: the newest summarised id.  As the original does: plus the number of messages.
            newest = int(ids[place - 1]) if place else self.last
            self._move(newest if self.mode == "max_id" else self.checkpoint + int(recent[hit]), ids[:place])
            after[hit] = self.checkpoint
            k, start = hit + 1, place
        if self.mode != "max_id" and len(ids) and ids[-1] > self.checkpoint:
            self.held.append(ids[np.searchsorted(ids, self.checkpoint, "right"):])
            self.held_n += len(self.held[-1])
        self.last = int(ids[-1]) if len(ids) else self.last
        return [recent, fired, before, after]


def _run_sessions(threshold: int, mode: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, session = object(), None
        for batch in batches:
            sizes = batch.column("_rows").value_lengths().to_numpy()
            flat = batch.column("_rows").flatten()
            ids, user = flat.field("id").to_numpy(), flat.field("user").to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            out = []
            for key, c0, a, b in zip(zip(batch.column("user_id").to_pylist(), batch.column("session").to_pylist()),
                                     batch.column("init_checkpoint").to_pylist(), ends - sizes, ends):
                if key != at:
                    at, session = key, TriggerRun(threshold, mode, c0)
                out.append(session.turns(ids[a:b], user[a:b]))
            turns = np.flatnonzero(user)
            row = pa.array(np.repeat(np.arange(len(sizes)), sizes)[turns])
            recent, fired, before, after = (pa.array(np.concatenate(c)) for c in zip(*out)) if out else [pa.array([])] * 4
            if len(turns):
                yield pa.RecordBatch.from_arrays([batch.column("user_id").take(row), batch.column("session").take(row), pa.array(ids[turns]),
                                                  recent, fired, before, after], names=TRIGGER_SCHEMA.fieldNames())
    return run


TRIGGER_SCHEMA = T.StructType([
    T.StructField("user_id", T.LongType()), T.StructField("session", T.StringType()),
    T.StructField("turn_id", T.LongType()), T.StructField("recent", T.LongType()),
    T.StructField("triggered", T.BooleanType()), T.StructField("checkpoint_before", T.LongType()),
    T.StructField("checkpoint_after", T.LongType())])
#: Positions of a session that meet a summary window in one join key.
WINDOW_BUCKET = 64
#: Width of the id ranges whose rows of a session are packed into one row.
ID_CHUNK = 1 << 16


def summary_triggers(messages: DataFrame, summaries: DataFrame | None = None,
                     threshold: int = SUMMARY_TRIGGER_DEFAULT, mode: str = "max_id") -> DataFrame:
    """For every user turn, whether at least ``threshold`` stored messages
    lie after the session's checkpoint (then a summary is made and the
    checkpoint moves).  System rows are not stored by the application and are
    excluded, rows without an id too.  ``mode='max_id'`` moves the checkpoint to the newest summarised
    id (corrected); ``mode='count'`` adds the message count to it (T2, as the
    original does, which lags behind the real ids).

    The initial checkpoint is the session's latest stored summary (0 if none).
    Tasks pack a session's rows by id range; the packed ranges of a session run
    past its checkpoint in order, with a few binary searches a trigger
    (:class:`TriggerRun`).  Where one session holds a large share of all rows,
    :func:`summary_triggers_parallel` gives the rows of ``max_id`` mode with
    every session split over tasks.
    """
    m = messages.filter("role <> 'system' and id is not null").select(
        "user_id", "session", F.floor(F.col("id") / F.lit(ID_CHUNK)).cast("bigint").alias("_c"), F.col("id").cast("bigint").alias("id"),
        (F.col("role") == "user").alias("user"))
    packed = m.groupBy("user_id", "session", "_c").agg(F.array_sort(F.collect_list(F.struct("id", "user"))).alias("_rows"))
    if summaries is not None:
        ck = summaries.groupBy("user_id", "session").agg(F.max("last_message_id").alias("init_checkpoint"))
        packed = null_safe_join(packed, ck, ["user_id", "session"], "left")
    else:
        packed = packed.withColumn("init_checkpoint", F.lit(None).cast("bigint"))
    packed = packed.withColumn("init_checkpoint", F.coalesce("init_checkpoint", F.lit(0)).cast("bigint"))
    ordered = packed.repartition("user_id", "session").sortWithinPartitions("user_id", "session", "_c")
    return ordered.mapInArrow(_run_sessions(threshold, mode), TRIGGER_SCHEMA)


def summary_requests(triggers: DataFrame, messages: DataFrame, summaries: DataFrame | None = None,
                     mode: str = "max_id") -> DataFrame:
    """K4: the summary request of each trigger: first or update wording, the
    summarised messages, the closing instruction.  ``triggers`` are those of
    :func:`summary_triggers` over the same messages in the same ``mode``.

    The previous summary text is the stored one for a session's first trigger;
    after that it is the model's own output, so the update wording carries the
    reference ``@summary:<turn_id>`` of the trigger that produced it.
    """
    t = triggers.filter("triggered").select("user_id", "session", "turn_id", "checkpoint_before")
    t = t.withColumn("prev_turn", F.lag("turn_id").over(Window.partitionBy("user_id", "session").orderBy("turn_id")))
    if summaries is not None:
        stored = (summaries.groupBy("user_id", "session")
                  .agg(F.max_by("summary", "last_message_id").alias("stored")))
        t = null_safe_join(t, stored, ["user_id", "session"], "left")
    else:
        t = t.withColumn("stored", F.lit(None).cast("string"))
    prev = F.when(F.col("prev_turn").isNotNull(), F.concat(F.lit("@summary:"), F.col("prev_turn").cast("string"))) \
        .otherwise(F.col("stored"))
    head = F.when(prev.isNull() | (prev == ""), F.lit(SUMMARY_FIRST_TEXT)).otherwise(
        _fmt(SUMMARY_UPDATE_TEXT, previous=prev))
    # Header and closing rows of each trigger come from one explode.
    fixed = (t.select(F.col("turn_id").alias("request_id"),
                      F.explode(F.array(_msg(0, F.lit(0), "system", head),
                                        _msg(3, F.lit(0), "system", F.lit(SUMMARY_CLOSE_TEXT)))).alias("r"))
             .select("request_id", "r.part", "r.pos", "r.role", "r.content"))
    m = messages.filter(F.col("role") != "system").select(
        "user_id", "session", F.col("id").alias("mid"), "role", F.col("message").alias("content"))
    tw = t.select("user_id", "session", "turn_id", "checkpoint_before", "prev_turn")
    if mode == "max_id":
        # Trigger windows are disjoint: a message belongs to the first trigger
        # after the latest trigger at or below its id (as-of lookup), so each
        # message meets exactly one trigger instead of all of its session's.
        m = asof_mark(m, triggers.filter("triggered"), ["user_id", "session"], "mid", "turn_id", name="_pt")
        j = null_safe_join(tw.withColumn("_pt", F.coalesce("prev_turn", F.lit(-1))),
                           m.withColumn("_pt", F.coalesce("_pt", F.lit(-1))), ["user_id", "session", "_pt"])
        j = j.filter((F.col("mid") > F.col("checkpoint_before")) & (F.col("mid") < F.col("turn_id")))
    else:
        # Count-mode checkpoints lag, so windows overlap.  A trigger's window is the
        # ``recent`` positions before its turn; windows and messages meet in buckets of positions.
        m = chunked_row_number(m, ["user_id", "session"], [F.col("mid")], "mid", unit=ID_CHUNK, name="_pos")
        place = m.select("user_id", "session", F.col("mid").alias("turn_id"), F.col("_pos").cast("bigint").alias("_end"))
        w = null_safe_join(triggers.filter("triggered").select("user_id", "session", "turn_id", "recent"), place,
                           ["user_id", "session", "turn_id"])
        first, end = F.col("_end") - F.col("recent"), F.col("_end") - 1
        bucket = lambda x: F.floor(x / F.lit(WINDOW_BUCKET)).cast("bigint")
        w = w.filter("recent > 0").select("user_id", "session", "turn_id", first.alias("_first"), end.alias("_last"),
                                          F.explode(F.sequence(bucket(first), bucket(end))).alias("_b"))
        j = null_safe_join(w, m.withColumn("_b", bucket(F.col("_pos"))), ["user_id", "session", "_b"])
        j = j.filter(F.col("_pos").between(F.col("_first"), F.col("_last")))
    body = j.select(F.col("turn_id").alias("request_id"), F.lit(2).alias("part"), F.col("mid").alias("pos"), "role", "content")
    return fixed.unionByName(body)


def reflection_requests(reflections: DataFrame, keys: DataFrame) -> DataFrame:
    """K5: per (user, window) either the fixed no-entries text, or the system and
    user messages asking for a reflection on the joined entries (D6)."""
    j = keys.select("user_id", "days").distinct().join(reflections.select("user_id", "days", "text"),
                                                      ["user_id", "days"], "left")
    return j.select("user_id", "days",
                    F.when(F.col("text").isNull(), F.lit("empty")).otherwise(F.lit("request")).alias("kind"),
                    F.when(F.col("text").isNull(), F.lit(REFLECTION_EMPTY_TEXT))
                    .otherwise(F.lit(REFLECTION_SYSTEM_TEXT)).alias("system"),
                    F.when(F.col("text").isNotNull(), _fmt(REFLECTION_USER_TEXT, entries=F.col("text"))).alias("user"))


def ingest_responses(responses: DataFrame, casual: bool = False) -> dict[str, DataFrame]:
    """K6 (T38 with ``casual``): each model response gives a user row, an
    assistant row and a token increment.

    ``responses``: (request_id, user_id, session, ts, user_input, reply,
    prompt_tokens, completion_tokens).  Returns ``messages`` (natural key
    request_id + turn_order) and ``tokens`` (the D3 increment log).
    """
    session = F.lit(CASUAL_SESSION) if casual else F.col("session")
    rows = responses.select(
        "request_id", "user_id", session.alias("session"), "ts",
        F.explode(F.array(
            F.struct(F.lit(0).alias("turn_order"), F.lit("user").alias("role"), F.col("user_input").alias("message")),
            F.struct(F.lit(1).alias("turn_order"), F.lit("assistant").alias("role"), F.col("reply").alias("message"))))
        .alias("m"))
    messages = rows.select("request_id", "m.turn_order", "user_id", "session", "m.role", "m.message",
                           F.col("ts").alias("timestamp"), F.lit(False).alias("archive"))
    tokens = responses.select("request_id", "user_id", "ts",
                              (F.col("prompt_tokens") + F.col("completion_tokens")).cast("bigint").alias("total_tokens"),
                              month_key("ts").alias("month_year"))
    return {"messages": messages, "tokens": tokens}



def summary_triggers_parallel(messages: DataFrame, summaries: DataFrame | None = None,
                              threshold: int = SUMMARY_TRIGGER_DEFAULT) -> DataFrame:
    """J4 in ``max_id`` mode without a per-session sequential pass (for hot sessions).

    With p the position of a stored (non-system) row in its session and q0 the
    first position after the initial checkpoint, the triggers form a chain:
    r1 = U(q0 + T), r(k+1) = U(r(k) + T), where U(x) is the first user turn at
    position >= x.  U is an as-of lookup; the chain is followed by pointer
    doubling (each round joins the jump table with itself and extends the
    reached set, until no jump is left), so every step is an equi-join and work
    is O(n log n) with no task holding a whole session.  Turn outputs then follow from the
    nearest trigger below each turn.  Equal to :func:`summary_triggers`; a null
    session is a session of its own in both.
    """
    m = messages.filter(F.col("role") != "system").select("user_id", "session", "id", "role")
    key = ["user_id", "session"]
    if summaries is not None:
        ck = summaries.groupBy(*key).agg(F.max("last_message_id").alias("c0"))
        m = null_safe_join(m, ck, key, "left")
    else:
        m = m.withColumn("c0", F.lit(None).cast("bigint"))
    m = m.withColumn("c0", F.coalesce("c0", F.lit(0)).cast("bigint"))
    m = chunked_row_number(m, key, [F.col("id")], "id", unit=1_000_000, name="pos").withColumn("pos", F.col("pos").cast("bigint"))
    m = materialize(m)  # read by five branches below
    q0 = (m.groupBy(*key).agg((F.count_if(F.col("id") <= F.col("c0")) + 1).cast("bigint").alias("q0"),
                              F.max("pos").alias("n")))
    users = m.filter(F.col("role") == "user").select(*key, "pos")
    # U(x): smallest user position >= x, as the largest of the negated positions <= -x.
    marks = users.select(*key, (-F.col("pos")).alias("neg"))

    def first_user_at_or_after(df: DataFrame, x: str, name: str) -> DataFrame:
        got = asof_mark(df.withColumn("_negx", -F.col(x)), marks, key, "_negx", "neg", name="_u", width=1_000_000)
        return got.withColumn(name, -F.col("_u")).drop("_negx", "_u")

    jump = first_user_at_or_after(users.withColumn("_x", F.col("pos") + threshold), "_x", "to").drop("_x")
    jump = materialize(jump.filter(F.col("to").isNotNull()))
    start = first_user_at_or_after(q0.withColumn("_x", F.col("q0") + threshold), "_x", "pos") \
        .filter(F.col("pos").isNotNull()).select(*key, "pos")
    reached = start
    while not jump.isEmpty():
        step = null_safe_join(reached, jump, [*key, "pos"]).select(*key, F.col("to").alias("pos"))
        # Both tables are read twice per round (their plans would double), so
        # each round's result is checkpointed.
        reached = materialize(reached.unionByName(step).distinct())
        then = jump.select(*key, F.col("pos").alias("to"), F.col("to").alias("_then"))
        jump = materialize(null_safe_join(jump, then, [*key, "to"]).select(*key, "pos", F.col("_then").alias("to")))
    trig = reached.withColumn("_t", F.lit(True))
    # id at position p - 1 (the newest stored id before a turn): a shifted equi-join.
    prev_id = m.select(*key, (F.col("pos") + 1).alias("pos"), F.col("id").alias("_prev_id"))
    # Each trigger's checkpoint is the id just before it.
    tp = (null_safe_join(trig, prev_id, [*key, "pos"], "left")
          .select(*key, F.col("pos").alias("last_t"), F.col("_prev_id").alias("tck")))
    turns = null_safe_join(m.filter(F.col("role") == "user").select(*key, "pos", "id", "c0"), q0.select(*key, "q0"), key)
    turns = null_safe_join(turns, trig, [*key, "pos"], "left")
    turns = null_safe_join(turns, prev_id, [*key, "pos"], "left")
    # The latest trigger strictly below each turn (as-of), then its checkpoint.
    turns = asof_mark(turns.withColumn("_below", F.col("pos") - 1), tp.select(*key, "last_t"), key, "_below",
                      "last_t", name="last_t", width=1_000_000)
    turns = null_safe_join(turns, tp, [*key, "last_t"], "left")
    base = F.coalesce(F.col("last_t"), F.col("q0"))
    recent = F.when(F.col("pos") > base, F.col("pos") - base).otherwise(F.lit(0))
    before = F.coalesce(F.col("tck"), F.col("c0"))
    fired = F.col("_t").isNotNull()
    return turns.select(
        "user_id", "session", F.col("id").alias("turn_id"), recent.cast("bigint").alias("recent"),
        fired.alias("triggered"), before.cast("bigint").alias("checkpoint_before"),
        F.when(fired, F.col("_prev_id")).otherwise(before).cast("bigint").alias("checkpoint_after"))
