"""Declared schemas of the eleven application tables, plus keys and domains.

Spark does not enforce keys; ``KEYS`` and ``FOREIGN_KEYS`` feed the quality
operators (unique-key and orphan checks).
"""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()
_TS, _D = T.TimestampNTZType(), T.DateType()


def _struct(*cols):
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


USERS = _struct(("id", _L), ("username", _S), ("email", _S), ("password", _S), ("email_token", _S),
                ("verified", _B), ("reset_token", _S), ("reset_token_expires", _TS),
                ("age", _I), ("sex", _S), ("occupation", _S), ("bio", _S))
CONVERSATIONS = _struct(("id", _L), ("user_id", _L), ("message", _S), ("role", _S),
                        ("timestamp", _TS), ("archive", _B), ("session", _S))
JOURNALS = _struct(("id", _L), ("user_id", _L), ("entry_date", _D), ("entry", _S), ("mood", _S),
                   ("created_at", _TS), ("updated_at", _TS))
USER_TOKENS = _struct(("id", _L), ("user_id", _L), ("token_month", _S), ("month_tokens", _L))
SESSION_TYPES = _struct(("id", _L), ("persona", _S), ("prompt", _S))
SESSIONS = _struct(("id", _L), ("user_id", _L), ("session_name", _S), ("persona", _S),
                   ("start_date", _TS), ("current", _B))
USER_SETTINGS = _struct(("user_id", _L), ("setting_key", _S), ("setting_value", _S), ("updated_at", _TS))
SUMMARIES = _struct(("id", _L), ("user_id", _L), ("session", _S), ("summary", _S),
                    ("last_message_id", _L), ("created_at", _TS))
SUBSCRIPTIONS = _struct(("id", _L), ("user_id", _L), ("plan_type", _S), ("billing_cycle", _S),
                        ("start_date", _TS), ("end_date", _TS), ("is_active", _B),
                        ("created_at", _TS), ("updated_at", _TS))
PAYMENT_STATUS = _struct(("id", _L), ("subscription_id", _L), ("status", _S), ("payment_method", _S),
                         ("last_payment_date", _D), ("next_billing_date", _D))
TOKEN_USAGE = _struct(("id", _L), ("user_id", _L), ("month_year", _S), ("tokens", _L),
                      ("created_at", _TS), ("updated_at", _TS))

TABLES: dict[str, T.StructType] = {
    "users": USERS, "conversations": CONVERSATIONS, "journals": JOURNALS, "user_tokens": USER_TOKENS,
    "session_types": SESSION_TYPES, "sessions": SESSIONS, "user_settings": USER_SETTINGS,
    "summaries": SUMMARIES, "subscriptions": SUBSCRIPTIONS, "payment_status": PAYMENT_STATUS,
    "token_usage": TOKEN_USAGE,
}

# Primary and unique keys per table.
KEYS: dict[str, list[list[str]]] = {
    "users": [["id"], ["email"]],
    "conversations": [["id"]],
    "journals": [["id"], ["user_id", "entry_date"]],
    "user_tokens": [["id"], ["user_id", "token_month"]],
    "session_types": [["id"], ["persona"]],
    "sessions": [["id"], ["user_id", "session_name"]],
    "user_settings": [["user_id", "setting_key"]],
    "summaries": [["id"]],
    "subscriptions": [["id"]],
    "payment_status": [["id"]],
    "token_usage": [["id"], ["user_id", "month_year"]],
}

# (child table, child columns, parent table, parent columns)
FOREIGN_KEYS: list[tuple[str, list[str], str, list[str]]] = [
    ("conversations", ["user_id"], "users", ["id"]),
    ("journals", ["user_id"], "users", ["id"]),
    ("sessions", ["user_id"], "users", ["id"]),
    ("sessions", ["persona"], "session_types", ["persona"]),
    ("subscriptions", ["user_id"], "users", ["id"]),
    ("payment_status", ["subscription_id"], "subscriptions", ["id"]),
    ("token_usage", ["user_id"], "users", ["id"]),
]
