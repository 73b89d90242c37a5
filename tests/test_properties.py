"""SURVEY 5(c)/(d): merges do not depend on input row order; operators accept
empty tables, nulls and duplicate keys."""

import datetime as dt
import random

from pyspark.sql import functions as F

from conftest import SMOKE

from wellspring.operators import accounts as A
from wellspring.operators import chat, journal, limits, prompts, tokens
from wellspring.operators import settings as ST
from wellspring.sources.fixtures import Fixtures


def _same(a, b):
    ka = sorted(map(repr, a.collect()))
    kb = sorted(map(repr, b.select(*a.columns).collect()))
    return ka == kb


def _scrambled(df, seed):
    return df.orderBy(F.rand(seed)).repartition(7)


def test_merges_are_independent_of_input_order(spark):
    fx = Fixtures(spark, SMOKE)
    for seed in (1, 2):
        assert _same(journal.journal_merge(None, fx.journal_log),
                     journal.journal_merge(None, _scrambled(fx.journal_log, seed)))
        assert _same(ST.settings_merge(fx.settings_log), ST.settings_merge(_scrambled(fx.settings_log, seed)))
        assert _same(tokens.token_ledger(fx.token_log), tokens.token_ledger(_scrambled(fx.token_log, seed)))
        assert _same(A.profile_merge(fx.users, fx.profile_log),
                     A.profile_merge(fx.users, _scrambled(fx.profile_log, seed)))
        assert _same(tokens.token_running_total(fx.token_log),
                     tokens.token_running_total(_scrambled(fx.token_log, seed)))


def test_folds_are_independent_of_input_order(spark):
    fx = Fixtures(spark, SMOKE)
    base = limits.rate_limit(fx.reset_requests, "ip", 3, 1440)
    assert _same(base, limits.rate_limit(_scrambled(fx.reset_requests, 3), "ip", 3, 1440))
    trig = prompts.summary_triggers(fx.messages, fx.summaries, threshold=4)
    assert _same(trig, prompts.summary_triggers(_scrambled(fx.messages, 4), fx.summaries, threshold=4))


def test_empty_inputs(spark):
    fx = Fixtures(spark, SMOKE)
    none = F.lit(False)
    assert chat.chat_history(fx.sessions.filter(none), fx.messages.filter(none)).count() == 0
    assert journal.journal_merge(None, fx.journal_log.filter(none)).count() == 0
    assert limits.rate_limit(fx.reset_requests.filter(none), "ip", 3, 15).count() == 0
    assert limits.reset_funnel(fx.reset_requests.filter(none), fx.users, 3, 15).count() == 0
    assert prompts.summary_triggers(fx.messages.filter(none), fx.summaries.filter(none), threshold=4).count() == 0
    assert tokens.token_running_total(fx.token_log.filter(none)).count() == 0
    # Empty change logs leave the base table as it is.
    assert chat.current_from_log(fx.sessions, fx.switch_log.filter(none)).filter("current").count() == \
        fx.sessions.filter("current").count()


def test_nulls_and_duplicate_keys(spark):
    t = dt.datetime(2024, 1, 1)
    # Duplicate (user, key) writes: last seq wins; a null user_id stays its own group.
    log = spark.createDataFrame([(1, 1, "voice", "a", t), (2, 1, "voice", "b", t), (3, None, "voice", "c", t)],
                                "seq bigint, user_id bigint, setting_key string, setting_value string, ts timestamp_ntz")
    got = {r["user_id"]: r["setting_value"] for r in ST.settings_merge(log).collect()}
    assert got == {1: "b", None: "c"}
    # Requests with null timestamps or keys do not break the limiter.
    rnd = random.Random(0)
    reqs = spark.createDataFrame([(i, t + dt.timedelta(minutes=rnd.randint(0, 30)), None if i % 5 == 0 else "k")
                                  for i in range(20)], "seq bigint, ts timestamp_ntz, ip string")
    assert limits.rate_limit(reqs, "ip", 3, 15).count() == 20
