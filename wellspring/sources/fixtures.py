"""Stand-in application tables derived from the driver's parquet tables.

Each view is one SQL text with ``{table}`` placeholders.  Spark runs it with
the driver tables bound as DataFrames (``spark.sql(text, customer=df)``), the
DuckDB oracle runs the same text as a CTE over its pre-registered views, so
both engines start from identical rows.  Every view grows with the driver
tables; none is a fixed literal input.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspring.sources.tables import DriverTables

AS_OF = "2024-01-30"

FIXTURES: dict[str, str] = {
    # users (from customer)
    "users": """
SELECT c_custkey AS id, c_name AS username, concat('user', CAST(c_custkey AS STRING), '@example.com') AS email,
 c_custkey % 7 <> 0 AS verified, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(18 + c_custkey % 60 AS INT) END AS age,
 CASE c_custkey % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' END AS sex, c_mktsegment AS occupation,
 CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE concat('I like ', lower(c_mktsegment)) END AS bio FROM {customer}
""",
    # messages: the application's conversations table
    "messages": """
SELECT c.conv_id * 100 + c.turn + 1 AS id, CAST(floor(c.conv_id / 6) AS BIGINT) AS user_id, c.text AS message, c.role AS role, e.ts AS timestamp,
 e.event_type = 'view' AS archive, concat('session-', CAST(c.conv_id AS STRING)) AS session
 FROM {conversations} c JOIN {events} e ON e.event_id = c.conv_id * 8 + c.turn
""",
    "sessions": """
WITH k AS (SELECT conv_id, concat('session-', CAST(conv_id AS STRING)) AS session_name, conv_id * 8 AS eid FROM {conversations} WHERE turn = 0
 UNION ALL SELECT event_id AS conv_id, concat('empty-', CAST(event_id AS STRING)) AS session_name, event_id AS eid FROM {events} WHERE event_type = 'signup' AND event_id % 17 = 0)
 SELECT CAST(floor(conv_id / 6) AS BIGINT) AS user_id, session_name, e.ts AS start_date,
 CASE conv_id % 6 WHEN 0 THEN 'CBT' WHEN 1 THEN 'DEMO' WHEN 2 THEN 'DBT' WHEN 3 THEN 'Reflective' WHEN 4 THEN 'Casual Chat' ELSE 'Life Coach' END AS persona,
 row_number() OVER (PARTITION BY CAST(floor(conv_id / 6) AS BIGINT) ORDER BY e.ts DESC, session_name DESC) = 1 AS current
 FROM k JOIN {events} e ON e.event_id = k.eid
""",
    # Sessions as a faulty writer leaves them: one current session per persona, not per user.
    "faulty_sessions": """
SELECT user_id, session_name, row_number() OVER (PARTITION BY user_id, persona ORDER BY start_date DESC, session_name DESC) = 1 AS current
 FROM (SELECT CAST(floor(c.conv_id / 6) AS BIGINT) AS user_id, concat('session-', CAST(c.conv_id AS STRING)) AS session_name,
  CASE c.conv_id % 6 WHEN 0 THEN 'DBT' ELSE 'CBT' END AS persona, e.ts AS start_date
  FROM {conversations} c JOIN {events} e ON e.event_id = c.conv_id * 8 WHERE c.turn = 0) s
""",
    # Payments of the subscription log, some of subscriptions that were never made, some with a status outside its domain.
    "payments": """
SELECT event_id AS id, CASE WHEN event_type = 'error' THEN -event_id ELSE event_id END AS subscription_id,
 CASE event_type WHEN 'purchase' THEN 'paid' WHEN 'signup' THEN 'failed' WHEN 'error' THEN 'refunded' ELSE 'pending' END AS status,
 CASE WHEN event_type = 'view' THEN 'weekly' WHEN event_type = 'click' THEN 'yearly' ELSE 'monthly' END AS billing_cycle,
 CAST(ts AS DATE) AS last_payment_date FROM {events}
""",
    "journal_log": """
SELECT e.event_id AS seq, e.user_id, CAST(e.ts AS DATE) AS entry_date, e.ts,
 CASE WHEN e.event_type = 'view' THEN d.text END AS entry,
 CASE e.event_type WHEN 'click' THEN 'happy' WHEN 'purchase' THEN 'neutral' WHEN 'error' THEN 'angry'
   WHEN 'signup' THEN CASE WHEN e.event_id % 3 = 0 THEN 'sad' WHEN e.event_id % 3 = 1 THEN 'anxious' ELSE 'tired-5' END END AS mood
 FROM (SELECT *, event_id % (SELECT max(doc_id) + 1 FROM {documents}) AS text_id FROM {events}) e
 LEFT JOIN {documents} d ON d.doc_id = e.text_id
""",
    "token_log": """
SELECT o_orderkey AS request_id, o_custkey AS user_id, o_orderdate AS ts, CAST(floor(o_totalprice) AS BIGINT) AS total_tokens FROM {orders}
""",
    "settings_log": """
SELECT event_id AS seq, user_id, CASE event_id % 6 WHEN 0 THEN 'model' WHEN 1 THEN 'typing_delay' WHEN 2 THEN 'voice' WHEN 3 THEN 'msg_retention' WHEN 4 THEN 'theme' ELSE 'summary_count' END AS setting_key,
 regexp_extract(props, '[0-9]+', 0) AS setting_value, ts FROM {events}
""",
    "subscription_log": """
SELECT event_id AS seq, user_id, CASE WHEN value < 20 THEN 'basic' WHEN value < 60 THEN 'professional' ELSE 'premium' END AS plan_type, ts FROM {events} WHERE event_type = 'purchase'
""",
    "reset_requests": """
SELECT event_id AS seq, ts, CASE WHEN event_type = 'click' THEN '10.0.0.1' ELSE concat('10.1.', CAST(user_id AS STRING)) END AS ip,
 CASE WHEN regexp_extract(props, '[0-9]+', 0) = '13' THEN 'invalid-email-format' WHEN regexp_extract(props, '[0-9]+', 0) = '14' THEN concat('ghost', CAST(user_id AS STRING), '@example.com') ELSE concat('  User', CAST(user_id AS STRING), '@Example.com ') END AS email_raw,
 CASE WHEN regexp_extract(props, '[0-9]+', 0) = '7' THEN 'bot_value' END AS nickname FROM {events}
""",
    "summaries": """
SELECT CAST(floor(c.conv_id / 6) AS BIGINT) AS user_id, concat('session-', CAST(c.conv_id AS STRING)) AS session, c.text AS summary, c.conv_id * 100 + c.turn + 1 AS last_message_id
 FROM {conversations} c JOIN {events} e ON e.event_id = c.conv_id * 8 + c.turn WHERE c.role = 'assistant' AND e.event_type IN ('click', 'purchase')
""",
    "user_country": """
SELECT c_custkey AS user_id, CASE c_nationkey % 13 WHEN 0 THEN 'us' WHEN 1 THEN 'AU' WHEN 2 THEN 'CA' WHEN 3 THEN 'UK' WHEN 4 THEN 'FR' WHEN 5 THEN 'DE' WHEN 6 THEN 'JP' WHEN 7 THEN 'IN' WHEN 8 THEN 'NZ' WHEN 9 THEN 'SG' WHEN 10 THEN 'IE' WHEN 11 THEN 'ZZ' END AS country FROM {customer}
""",
    # --- further change logs and request tables (same rule: derived from the driver tables) ---
    # Session switches: creates add a new name, restores name a session that may or may not exist.
    "switch_log": """
SELECT seq, CASE WHEN event_type = 'view' AND value > 90 THEN user_id ELSE CAST(floor(conv_id / 6) AS BIGINT) END AS user_id, ts,
 CASE WHEN event_type IN ('click', 'view') THEN 'restore' ELSE 'create' END AS action,
 CASE WHEN event_type IN ('click', 'view') THEN concat('session-', CAST(conv_id AS STRING))
      ELSE concat('new-', CAST(seq AS STRING)) END AS session_name,
 CASE seq % 3 WHEN 0 THEN 'CBT' WHEN 1 THEN 'DBT' ELSE 'Life Coach' END AS persona
 FROM (SELECT event_id AS seq, user_id, ts, event_type, value, event_id % (SELECT max(conv_id) + 1 FROM {conversations}) AS conv_id FROM {events}
  WHERE event_type <> 'error') e
""",
    # Session renames in request order: clashes with existing names, renames to the own name,
    # a second rename of the same source, chains in either order, shared targets, unknown sources.
    "rename_requests": """
SELECT conv_id * 8 + 4 AS seq, CAST(floor(conv_id / 6) AS BIGINT) AS user_id, concat('session-', CAST(conv_id AS STRING)) AS old_name,
 CASE WHEN conv_id % 11 = 0 THEN concat('session-', CAST(conv_id + 1 AS STRING)) WHEN conv_id % 13 = 0 THEN concat('session-', CAST(conv_id AS STRING))
  WHEN conv_id % 7 = 0 THEN 'shared' ELSE concat('renamed-', CAST(conv_id AS STRING)) END AS new_name
 FROM {conversations} WHERE turn = 0
UNION ALL
SELECT event_id + CASE WHEN event_type = 'click' THEN 5 ELSE 3 END AS seq, CAST(floor(floor(event_id / 8) / 6) AS BIGINT) AS user_id,
 CASE WHEN event_type = 'view' THEN concat('session-', CAST(event_id / 8 AS STRING)) ELSE concat('renamed-', CAST(event_id / 8 AS STRING)) END AS old_name,
 concat('again-', CAST(event_id / 8 AS STRING)) AS new_name
 FROM (SELECT conv_id * 8 AS event_id FROM {conversations} WHERE turn = 0) c JOIN {events} USING (event_id) WHERE event_type <> 'purchase'
""".replace("event_id / 8", "CAST(floor(event_id / 8) AS BIGINT)"),
    # Persona changes in request order, several for a session, with unknown personas that must be rejected.
    "persona_requests": """
SELECT conv_id * 8 + turn AS seq, CAST(floor(conv_id / 6) AS BIGINT) AS user_id, concat('session-', CAST(conv_id AS STRING)) AS session_name,
 CASE (conv_id + turn * 3) % 8 WHEN 0 THEN 'DBT' WHEN 2 THEN 'InvalidType' WHEN 4 THEN 'Reflective' ELSE 'CBT' END AS persona
 FROM {conversations}
""",
    # Sessions to delete; some names are unknown.
    "session_deletes": """
SELECT CAST(floor(c.conv_id / 6) AS BIGINT) AS user_id, concat(CASE WHEN e.event_type = 'signup' THEN 'unknown-' ELSE 'session-' END, CAST(c.conv_id AS STRING)) AS session_name
 FROM {conversations} c JOIN {events} e ON e.event_id = c.conv_id * 8 + c.turn WHERE c.turn = 0 AND e.event_type <> 'view'
""",
    # Users to erase.
    "erase_requests": """
SELECT c_custkey AS user_id FROM {customer} WHERE c_mktsegment = 'AUTOMOBILE'
""",
    # Profile edits: every column is overwritten, nulls included; several edits per user.
    "profile_log": """
SELECT event_id AS seq, user_id AS id, ts, concat('name-', CAST(event_id AS STRING)) AS username,
 CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(20 + event_id % 50 AS INT) END AS age,
 CASE event_id % 3 WHEN 0 THEN 'Female' WHEN 1 THEN 'Male' END AS sex,
 CASE WHEN event_id % 2 = 0 THEN 'teacher' END AS occupation,
 CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat('bio ', CAST(event_id AS STRING)) END AS bio
 FROM {events} WHERE event_type = 'click'
""",
    # Signup form posts: some bots, bad addresses, missing fields, duplicate and existing emails.
    "signups": """
SELECT event_id AS seq, ts, concat('new', CAST(user_id + 100000 * (event_id % 2) AS STRING)) AS username,
 CASE WHEN event_id % 23 = 0 THEN 'not-an-email' WHEN event_id % 29 = 0 THEN concat('user', CAST(user_id AS STRING), '@example.com')
      ELSE concat('New', CAST(user_id AS STRING), '_', CAST(event_id % 3 AS STRING), '@Mail.org') END AS email,
 CASE WHEN event_id % 31 = 0 THEN NULL ELSE concat('tok', CAST(event_id AS STRING)) END AS password,
 CASE WHEN value < 30 THEN 'basic' WHEN value < 65 THEN 'professional' WHEN value < 97 THEN 'premium' ELSE 'gold' END AS plan,
 concat('etok', CAST(event_id AS STRING)) AS email_token,
 CASE WHEN event_id % 37 = 0 THEN 'bot_value' END AS nickname
 FROM {events} WHERE event_type = 'signup'
""",
    # Verification-link clicks: tokens are the users' open tokens, some unknown, some clicked twice.
    "verify_clicks": """
SELECT event_id AS seq, ts, CASE WHEN event_id % 9 = 0 THEN concat('bogus', CAST(event_id AS STRING))
 ELSE concat('etok-', CAST(user_id AS STRING)) END AS token FROM {events} WHERE event_type = 'view'
""",
    # Stored settings with the session counter: some users have a number, some a null, some no row.
    "counter_settings": """
SELECT c_custkey AS user_id, 'session_counter' AS setting_key, CASE WHEN c_custkey % 5 <> 0 THEN CAST(1 + c_custkey % 9 AS STRING) END AS setting_value
 FROM {customer} WHERE c_custkey % 3 <> 0
UNION ALL SELECT c_custkey AS user_id, 'theme' AS setting_key, 'dark' AS setting_value FROM {customer} WHERE c_custkey % 2 = 0
""",
    # Users table with open verification tokens (unverified users only).
    "users_tokens": """
SELECT c_custkey AS id, concat('user', CAST(c_custkey AS STRING), '@example.com') AS email, c_custkey % 7 <> 0 AS verified,
 CASE WHEN c_custkey % 7 = 0 THEN concat('etok-', CAST(c_custkey AS STRING)) END AS email_token FROM {customer}
""",
    # Resend-verification posts by email address.
    "resend_requests": """
SELECT event_id AS seq, ts, CASE WHEN event_id % 13 = 0 THEN '' WHEN event_id % 11 = 0 THEN concat('ghost', CAST(user_id AS STRING), '@example.com')
 ELSE concat(' User', CAST(user_id AS STRING), '@example.com') END AS email_raw,
 concat('rtok', CAST(event_id AS STRING)) AS token FROM {events} WHERE event_type = 'error'
""",
    # Password-reset redemptions: a token named after a reset request (seq), redeemed
    # 0-99 minutes later; some tokens are bogus, some are redeemed twice, the later
    # number five minutes before the earlier one.
    "reset_redemptions": """
SELECT event_id * 2 AS seq, ts + (event_id % 100) * INTERVAL 1 MINUTE AS ts,
 CASE WHEN event_id % 10 = 0 THEN 'bogus' ELSE concat('rst', CAST(event_id AS STRING)) END AS token
 FROM {events} WHERE event_type IN ('click', 'view', 'purchase')
UNION ALL
SELECT event_id * 2 + 1 AS seq, ts + (event_id % 100 - 5) * INTERVAL 1 MINUTE AS ts, concat('rst', CAST(event_id AS STRING)) AS token
 FROM {events} WHERE event_type = 'click'
""",
    # Journal delete requests.
    "journal_deletes": """
SELECT event_id AS seq, user_id, CAST(ts AS DATE) AS entry_date, ts FROM {events} WHERE event_type = 'purchase' AND value < 25
""",
    # Archive requests (new-chat): a name re-labels every open message of the user.
    "archive_requests": """
SELECT c_custkey AS seq, CAST(floor(c_custkey / 9) AS BIGINT) AS user_id, CASE WHEN c_custkey % 2 = 0 THEN concat('archived-', CAST(c_custkey AS STRING)) END AS new_name
 FROM {customer} WHERE c_mktsegment IN ('MACHINERY', 'HOUSEHOLD')
""",
    # Request log for the access gate.
    "access_log": """
SELECT event_id AS seq, ts, CASE event_id % 12 WHEN 0 THEN '/' WHEN 1 THEN '/profile' WHEN 2 THEN '/api/chat' WHEN 3 THEN '/static/app.js'
 WHEN 4 THEN '/api/public/x' WHEN 5 THEN '/insights' WHEN 6 THEN '/api/chat_history' WHEN 7 THEN '/signin' WHEN 8 THEN '/journal_calendar'
 WHEN 9 THEN '/faq' WHEN 10 THEN '/api/session_types' ELSE '/home' END AS path,
 CASE WHEN event_id % 5 = 0 THEN 'OPTIONS' ELSE 'GET' END AS method, user_id % 3 <> 0 AS authenticated FROM {events}
""",
    # Chat request bodies as JSON text (client payload); some are malformed or miss fields.
    "chat_bodies": """
SELECT c.conv_id * 100 + c.turn + 1 AS request_id, CAST(floor(c.conv_id / 6) AS BIGINT) AS user_id, e.ts,
 CASE WHEN c.turn = 7 THEN concat(chr(123), '"messages": [')
  WHEN c.turn = 5 THEN concat(chr(123), '"messages": [], "session_name": "session-', CAST(c.conv_id AS STRING), '"', chr(125))
  WHEN c.turn = 3 THEN concat(chr(123), '"messages": [', chr(123), '"role": "user", "content": "first ', CAST(c.conv_id AS STRING), '"', chr(125), ', ',
   chr(123), '"role": "assistant", "content": "second"', chr(125), ', ', chr(123), '"role": "user", "content": "turn ', CAST(c.turn AS STRING), '"', chr(125),
   '], "session_name": "session-', CAST(c.conv_id AS STRING), '", "session_type": "DBT"', chr(125))
  ELSE concat(chr(123), '"messages": [', chr(123), '"role": "user", "content": "turn ', CAST(c.turn AS STRING), '"', chr(125),
   '], "session_name": "session-', CAST(c.conv_id AS STRING), '", "session_type": "CBT"', chr(125)) END AS body
 FROM {conversations} c JOIN {events} e ON e.event_id = c.conv_id * 8 + c.turn WHERE c.role = 'user'
""",
    # Model responses for chat turns (user message + reply + token counts).
    "responses": """
SELECT c.conv_id * 100 + c.turn + 1 AS request_id, CAST(floor(c.conv_id / 6) AS BIGINT) AS user_id, concat('session-', CAST(c.conv_id AS STRING)) AS session,
 e.ts, c.text AS user_input, concat('Reply to turn ', CAST(c.turn AS STRING)) AS reply,
 CAST(10 + c.turn AS BIGINT) AS prompt_tokens, CAST(20 + length(c.text) % 50 AS BIGINT) AS completion_tokens
 FROM {conversations} c JOIN {events} e ON e.event_id = c.conv_id * 8 + c.turn WHERE c.role = 'user'
""",
    # Properties files as text lines (one file per tenant): comments, blanks, renamed key, lines that don't load.
    "property_lines": """
SELECT CAST(event_id % 7 AS BIGINT) AS tenant, event_id AS line_no,
 CASE WHEN event_id % 31 = 7 THEN concat('broken line ', CAST(event_id AS STRING)) ELSE CASE event_id % 9 WHEN 0 THEN '# comment' WHEN 1 THEN '' WHEN 2 THEN concat('model=gpt-', CAST(event_id % 5 AS STRING))
  WHEN 3 THEN concat(' msg_retention = ', CAST(event_id % 90 AS STRING)) WHEN 4 THEN concat('typing_delay=', CAST(event_id % 1000 AS STRING))
  WHEN 5 THEN concat('msg_retention =', CAST(event_id % 70 AS STRING)) WHEN 6 THEN 'voice=en=US'
  WHEN 7 THEN concat('   theme = t', CAST(event_id % 4 AS STRING), '  ') ELSE concat('summary_count=', CAST(event_id % 200 AS STRING)) END END AS value
 FROM {events}
""",
}


def fixture_sql_duckdb(name: str) -> str:
    """The fixture text for DuckDB: placeholders become the registered view names."""
    return re.sub(r"\{(\w+)\}", r"\1", FIXTURES[name]).strip()


def with_fixtures(names: list[str], body: str, ctes: str = "", recursive: bool = False) -> str:
    """An oracle statement: the named fixture views as CTEs, optional extra CTEs, then ``body``."""
    parts = [f"{n} AS ({fixture_sql_duckdb(n)})" for n in names]
    if ctes.strip():
        parts.append(ctes.strip())
    if not parts:
        return body.strip()
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(parts) + "\n" + body.strip()


def halves(log: DataFrame, order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """A change log cut in two at the middle of its order."""
    middle = log.agg(F.expr(f"max({order}) / 2")).scalar()
    return log.filter(F.col(order) <= middle), log.filter(F.col(order) > middle)


class Fixtures:
    """Spark DataFrames for the fixture views over one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.tables = DriverTables(spark, sf_dir)

    def view(self, name: str, **overrides: DataFrame) -> DataFrame:
        """The fixture view; ``overrides`` replace driver tables (e.g. a stream of ``events``)."""
        text = FIXTURES[name]
        needed = set(re.findall(r"\{(\w+)\}", text))
        return self.spark.sql(text, **{t: overrides[t] if t in overrides else self.tables.table(t) for t in needed})

    def __getattr__(self, name: str) -> DataFrame:
        if name in FIXTURES:
            return self.view(name)
        raise AttributeError(name)
