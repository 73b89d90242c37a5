"""Accounts: lookups, subscriptions, profile edits, signups, verification and
password-reset tokens (B1-B3, C2, D7, E5, E6, H5, H13-H18).

Tokens and passwords are opaque input strings; nothing here generates or
hashes them, and password/token columns are never selected into lookups.

Scale: every change log is applied with one keyed aggregate (``max_by`` on
the sequence number) or one per-user ordered window; request tables of any
size are joined, never broadcast unless tiny by construction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspring.fixed_values import NEW_USER_SETTINGS, PLANS, RESET_TOKEN_HOURS
from wellspring.functions.text import is_valid_email, normalise_email
from wellspring.functions.windows import chunked_last_value, chunked_next

_PROFILE_COLS = ["username", "age", "sex", "occupation", "bio"]


def users_by_id(users: DataFrame, keys: DataFrame, key_col: str = "user_id") -> DataFrame:
    """B1: narrow user row (id, username, email) for each requested id; unknown ids give nulls."""
    u = users.select(F.col("id").alias(key_col), "username", "email")
    return keys.select(key_col).join(u, key_col, "left")


#: Columns of a user's row that no lookup gives out.
SECRETS = ("password", "email_token", "reset_token", "reset_token_expires")


def user_rows(users: DataFrame, keys: DataFrame, key_col: str = "user_id") -> DataFrame:
    """B1: the whole user row for each requested id, without passwords and tokens; unknown ids give nulls."""
    u = users.drop(*SECRETS).withColumnRenamed("id", key_col)
    return keys.select(key_col).join(u, key_col, "left")


def users_by_email(users: DataFrame, requests: DataFrame, email_col: str = "email_raw",
                   strip: bool = True) -> DataFrame:
    """Profile and verification view by normalised email (I1), plus ``registered``."""
    req = requests.withColumn("email", normalise_email(email_col, strip=strip))
    u = users.select("email", F.col("id").alias("user_id"), "username", "age", "sex", "bio", "verified",
                     F.lit(True).alias("_hit"))
    out = req.join(u, "email", "left")
    return out.withColumn("registered", F.coalesce("_hit", F.lit(False))).drop("_hit")


def billing_cycle(plan) -> Column:
    """``monthly`` unless the plan is ``basic`` (then null)."""
    p = F.col(plan) if isinstance(plan, str) else plan
    return F.when(p != "basic", F.lit("monthly"))


def subscription_history(plan_log: DataFrame) -> DataFrame:
    """E5: each plan choice opens a subscription and closes the user's previous one.

    Exactly one active row per user (the last in (ts, seq) order); a closed
    row's ``updated_at`` is the next row's start; ``end_date`` is never set,
    as in the original.
    """
    # lead(ts) per user in two levels (day chunks), so a hot user is not one task.
    led = chunked_next(plan_log.select("seq", "user_id", "plan_type", "ts"), ["user_id"], "ts", "seq", "ts",
                       unit="day", name="_next")
    nxt = F.col("_next")
    return led.select(
        "seq", "user_id", "plan_type", billing_cycle("plan_type").alias("billing_cycle"),
        F.col("ts").alias("start_date"), F.lit(None).cast("timestamp_ntz").alias("end_date"),
        nxt.isNull().alias("is_active"), F.col("ts").alias("created_at"),
        F.coalesce(nxt, F.col("ts")).alias("updated_at"))


def users_active_subscription(users: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Every user with their active subscription (nulls when none);
    the ``is_active`` predicate is applied to the right side before the left join."""
    act = subscriptions.filter(F.col("is_active")).select(
        F.col("user_id").alias("id"), "plan_type", "billing_cycle", "end_date", "is_active")
    return users.select("id", "username", "email", "verified").join(act, "id", "left")


def profile_merge(users: DataFrame, profile_log: DataFrame) -> DataFrame:
    """H5: the latest edit per user replaces all five profile columns, nulls included
    (a whole-struct swap, not ``coalesce``, which would keep old values)."""
    last = (profile_log.groupBy("id")
            .agg(F.max_by(F.struct(*_PROFILE_COLS), "seq").alias("new")))
    j = users.join(last, "id", "left")
    cols = [F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in _PROFILE_COLS]
    keep = [c for c in users.columns if c not in _PROFILE_COLS]
    return j.select(*keep, *cols)


def signup_fanout(signups: DataFrame, users: DataFrame) -> dict[str, DataFrame]:
    """H13 with Q1-Q4, Q7: validated signups -> new users, their six settings and
    their subscriptions (T14: ``basic`` first, then the chosen plan, which
    deactivates it).

    Checks in order: all fields present (Q3), email pattern (Q1), plan in the
    domain (Q2; the original only checks it on the form page), email not
    registered and first in the batch (Q4), honeypot empty (Q7).  Signup
    lower-cases the email without stripping (T21).  New ids are
    ``max(existing id) + seq``: unique and deterministic without a global sort.
    Returns ``outcomes``, ``users``, ``settings`` and ``subscriptions``.
    """
    s = signups.withColumn("email_n", F.lower("email"))
    truthy = [F.col(c).isNotNull() & (F.col(c) != "") for c in ("username", "email", "password", "plan")]
    all_present = truthy[0] & truthy[1] & truthy[2] & truthy[3]
    existing = users.select(F.col("email").alias("email_n"), F.lit(True).alias("_exists"))
    s = s.join(existing, "email_n", "left")
    valid = all_present & is_valid_email("email_n") & F.col("plan").isin(*PLANS)
    bot = F.col("nickname").isNotNull() & (F.col("nickname") != "")
    # Within the batch an address is taken by its first signup that is created,
    # i.e. passes every check; later signups with it fail the registered check.
    first_created = (s.filter(valid & F.col("_exists").isNull() & ~bot)
                     .groupBy("email_n").agg(F.min("seq").alias("_first")))
    s = s.join(first_created, "email_n", "left")
    outcome = (F.when(~all_present, F.lit("missing_fields"))
               .when(~is_valid_email("email_n"), F.lit("invalid_email"))
               .when(~F.col("plan").isin(*PLANS), F.lit("invalid_plan"))
               .when(F.col("_exists").isNotNull() | (F.col("seq") > F.col("_first")), F.lit("email_registered"))
               .when(bot, F.lit("bot"))
               .otherwise(F.lit("created")))
    outcomes = s.select("seq", "ts", "email_n", "plan", outcome.alias("outcome"))
    # The id base is a scalar subquery (one aggregate, evaluated once; no join).
    base = users.agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint")).scalar()
    ok = s.filter(outcome == "created").withColumn("_base", base)
    new_users = ok.select((F.col("_base") + F.col("seq")).alias("id"), "username", F.col("email_n").alias("email"),
                          F.col("email_token"), F.lit(False).alias("verified"), "ts")
    defaults = F.array(*[F.struct(F.lit(k).alias("setting_key"), F.lit(v).alias("setting_value"))
                         for k, v in NEW_USER_SETTINGS])
    settings = new_users.select(F.col("id").alias("user_id"), "email", F.explode(defaults).alias("s"), "ts") \
        .select("user_id", "email", "s.setting_key", "s.setting_value", F.col("ts").alias("updated_at"))
    subs = ok.select((F.col("_base") + F.col("seq")).alias("user_id"), F.col("email_n").alias("email"), "ts",
                     F.explode(F.array(
                         F.struct(F.lit(1).alias("n"), F.lit("basic").alias("plan_type"),
                                  F.lit(None).cast("string").alias("billing_cycle"), F.lit(False).alias("is_active")),
                         F.struct(F.lit(2).alias("n"), F.col("plan").alias("plan_type"),
                                  billing_cycle("plan").alias("billing_cycle"), F.lit(True).alias("is_active"))))
                     .alias("s")).select("user_id", "email", "s.n", "s.plan_type", "s.billing_cycle",
                                         "s.is_active", F.col("ts").alias("created_at"))
    return {"outcomes": outcomes, "users": new_users, "settings": settings, "subscriptions": subs}


def verify_merge(users: DataFrame, clicks: DataFrame) -> dict[str, DataFrame]:
    """Verification clicks against open tokens.

    The first click on a user's open token verifies the user and clears the
    token; any later click on it finds no user (``unknown``).  A click whose
    user is already verified but still holds the token reports
    ``already_verified``.  Returns ``outcomes`` per click and updated ``users``.
    """
    u = users.filter(F.col("email_token").isNotNull()).select(
        F.col("email_token").alias("token"), F.col("id").alias("user_id"), F.col("verified").alias("was_verified"))
    first = clicks.groupBy("token").agg(F.min("seq").alias("first_seq"))
    c = clicks.join(u, "token", "left").join(first, "token", "left")
    # An already-verified holder keeps the token (no update), so every click reports it.
    outcome = (F.when(F.col("user_id").isNull(), F.lit("unknown"))
               .when(F.col("was_verified"), F.lit("already_verified"))
               .when(F.col("seq") == F.col("first_seq"), F.lit("verified"))
               .otherwise(F.lit("unknown")))
    outcomes = c.select("seq", "ts", "token", "user_id", outcome.alias("outcome"))
    done = outcomes.filter(F.col("outcome") == "verified").select(F.col("user_id").alias("id"),
                                                                   F.lit(True).alias("_v"))
    new_users = (users.join(done, "id", "left")
                 .withColumn("verified", F.when(F.col("_v"), F.lit(True)).otherwise(F.col("verified")))
                 .withColumn("email_token", F.when(F.col("_v"), F.lit(None)).otherwise(F.col("email_token")))
                 .drop("_v"))
    return {"outcomes": outcomes, "users": new_users}


def resend_merge(users: DataFrame, requests: DataFrame) -> dict[str, DataFrame]:
    """Re-issue verification tokens.

    Email is ``strip().lower()``-ed; outcomes ``missing``, ``no_account``,
    ``already_verified`` or ``sent``; each user's last sent token replaces the
    stored one.  Returns ``outcomes`` and updated ``users``.
    """
    r = requests.withColumn("email", normalise_email("email_raw"))
    u = users.select("email", F.col("id").alias("user_id"), F.col("verified").alias("_verified"))
    j = r.join(u, "email", "left")
    outcome = (F.when(F.col("email") == "", F.lit("missing"))
               .when(F.col("user_id").isNull(), F.lit("no_account"))
               .when(F.col("_verified"), F.lit("already_verified"))
               .otherwise(F.lit("sent")))
    outcomes = j.select("seq", "ts", "email", "user_id", outcome.alias("outcome"), "token")
    last = (outcomes.filter(F.col("outcome") == "sent").groupBy("user_id")
            .agg(F.max_by("token", "seq").alias("_tok")).withColumnRenamed("user_id", "id"))
    new_users = (users.join(last, "id", "left")
                 .withColumn("email_token", F.coalesce("_tok", "email_token")).drop("_tok"))
    return {"outcomes": outcomes.drop("token"), "users": new_users}


def reset_issue(sent: DataFrame, users: DataFrame) -> DataFrame:
    """Reset tokens issued to known users: expiry = issue time + 1 hour.

    ``sent`` is (seq, ts, email, token) of requests that passed the funnel;
    unknown emails are dropped by a semi join.  Every issue is kept (the token
    log); :func:`reset_state` gives the stored token, last per user.
    """
    u = users.select("email", F.col("id").alias("user_id"))
    return (sent.join(u, "email", "inner")
            .select("seq", "user_id", "token", F.col("ts").alias("issued_at"),
                    (F.col("ts") + F.expr(f"INTERVAL {RESET_TOKEN_HOURS} HOURS")).alias("expires")))


def reset_state(issues: DataFrame, redemptions: DataFrame | None = None) -> DataFrame:
    """Stored reset token per user after all issues and redemptions.

    The last issue in (issued_at, seq) order wins; a successful redemption
    (``redemptions`` is :func:`reset_redeem` output) clears token and expiry.
    Only the newest token can be redeemed, so the stored one is cleared iff it
    was redeemed itself.
    """
    last = (issues.groupBy("user_id")
            .agg(F.max_by(F.struct("token", "expires"), F.struct("issued_at", "seq")).alias("t"))
            .select("user_id", F.col("t.token").alias("reset_token"), F.col("t.expires").alias("reset_token_expires")))
    if redemptions is None:
        return last
    used = redemptions.filter("redeemed").select(F.col("token").alias("reset_token"), F.lit(True).alias("_used")).distinct()
    keep = F.col("_used").isNull()
    return last.join(used, "reset_token", "left").select(
        "user_id", F.when(keep, F.col("reset_token")).alias("reset_token"),
        F.when(keep, F.col("reset_token_expires")).alias("reset_token_expires"))


def reset_redeem(issues: DataFrame, redemptions: DataFrame) -> DataFrame:
    """A redemption succeeds iff its token is the user's newest token
    issued before it, not yet used, and ``expires > redemption time`` (strict);
    events are in (ts, seq) order, issues before redemptions of the same time.

    Issues and redemptions of a user are interleaved in time order; the
    current token at each redemption is ``last(token, ignorenulls)`` over the
    user's issues.  Single use: only the first qualifying redemption of a
    token succeeds.  Unknown tokens fail.
    """
    tok = issues.select("token", "user_id", "expires")
    red = redemptions.join(tok, "token", "left")
    known = red.filter(F.col("user_id").isNotNull())
    events = (issues.select("user_id", F.col("issued_at").alias("ts"), F.lit(0).alias("kind"),
                            F.col("seq"), F.col("token").alias("issued_token"),
                            F.lit(None).cast("string").alias("token"), F.lit(None).cast("timestamp_ntz").alias("expires"))
              .unionByName(known.select("user_id", "ts", F.lit(1).alias("kind"), "seq",
                                        F.lit(None).cast("string").alias("issued_token"), "token", "expires")))
    # Current token = last issue up to the redemption, per user, in two levels
    # (day chunks) so a user with a third of all events is not one task.
    cur = chunked_last_value(events, ["user_id"], ["ts", "kind", "seq"], "ts", "issued_token",
                             unit="day", name="current").filter(F.col("kind") == 1)
    cand = cur.withColumn("cand", (F.col("current") == F.col("token")) & (F.col("expires") > F.col("ts")))
    firsts = (cand.filter("cand").groupBy("token").agg(F.min_by("seq", F.struct("ts", "seq")).alias("first_ok")))
    judged = cand.join(firsts, "token", "left").select(
        "seq", (F.col("cand") & (F.col("seq") == F.col("first_ok"))).alias("ok"))
    return (redemptions.select("seq", "ts", "token").join(judged, "seq", "left")
            .select("seq", "ts", "token", F.coalesce("ok", F.lit(False)).alias("redeemed")))


def reset_cleanup(state: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """Clear tokens with ``expires < as_of`` (equality is kept, T25);
    returns the cleaned state and a one-row affected count."""
    expired = F.col("reset_token_expires") < F.to_timestamp_ntz(F.lit(as_of))
    cleaned = state.select("user_id",
                           F.when(expired, F.lit(None)).otherwise(F.col("reset_token")).alias("reset_token"),
                           F.when(expired, F.lit(None)).otherwise(F.col("reset_token_expires"))
                           .alias("reset_token_expires"))
    count = state.agg(F.count_if(expired).alias("affected"))
    return cleaned, count


def lapsed_tokens(issues: DataFrame, redemptions: DataFrame, as_of: str) -> DataFrame:
    """J6 (batch form): reset tokens that expired unused by ``as_of``: issues
    with no successful redemption (anti join on the token) whose expiry is at
    or before ``as_of``.  ``redemptions`` is :func:`reset_redeem` output."""
    used = redemptions.filter("redeemed").select("token").distinct()
    return (issues.join(used, "token", "left_anti")
            .filter(F.col("expires") <= F.to_timestamp_ntz(F.lit(as_of))))
