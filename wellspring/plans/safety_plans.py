"""Registered safety queries."""

from __future__ import annotations

from wellspring.fixed_values import CRISIS_RESPONSE_PREFIX, HOTLINES
from wellspring.operators import safety as S
from wellspring.plans.registry import register

# Crisis phrases that occur in the test text (the application's defaults do not).
CHAT_CRISIS = ["worthless", "that the", "hate", "with"]
DOC_CRISIS = ["worthless", "trash", "pathetic", "loser"]

HOTLINES_SQL = "hotlines AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{h}')" for c, h in HOTLINES) + \
    ") h(country, hotline))"
HOTLINE_EXPR = ("CASE WHEN c.country IS NULL THEN 'a local support number' "
                "ELSE coalesce((SELECT h.hotline FROM hotlines h WHERE h.country = upper(c.country)), 'N/A') END")
PREFIX = CRISIS_RESPONSE_PREFIX.replace("'", "''")
CHAT_LIST = "[" + ", ".join(f"'{k}'" for k in CHAT_CRISIS) + "]"


@register("user_hotlines", "C6/A8", ["user_country"], f"""
SELECT c.user_id, c.country, {HOTLINE_EXPR} AS hotline FROM user_country c
""", ctes=HOTLINES_SQL)
def _user_hotlines(fx):
    return S.user_hotlines(fx.user_country)


@register("crisis_alerts", "J3/I2/I17/T27/T28", ["messages", "user_country"], rf"""
SELECT id, user_id, matched, hotline, response, contains(lower(response), 'if you''re in crisis') AS marker,
 CASE WHEN regexp_extract(response, '(\+?\d[\d\s\-().]{{7,}})', 1) = '' THEN NULL
  ELSE regexp_replace(regexp_extract(response, '(\+?\d[\d\s\-().]{{7,}})', 1), '\s+', '', 'g') END AS phone
FROM (
 SELECT m.id, m.user_id, array_to_string(list_filter({CHAT_LIST}, lambda k: contains(lower(m.message), k)), '|') AS matched, {HOTLINE_EXPR} AS hotline,
  '{PREFIX}' || {HOTLINE_EXPR} AS response
 FROM messages m LEFT JOIN user_country c ON c.user_id = m.user_id
 WHERE m.role = 'user') x WHERE matched <> ''
""", ctes=HOTLINES_SQL)
def _crisis_alerts(fx):
    out = S.crisis_alerts(fx.messages, fx.user_country, CHAT_CRISIS)
    return out.select("id", "user_id", "matched", "hotline", "response", "marker", "phone")


@register("crisis_documents", "J3/I2", [], """
SELECT doc_id, array_to_string(list_filter(['worthless', 'trash', 'pathetic', 'loser'], lambda k: contains(lower(text), k)), '|') AS matched
FROM documents
WHERE len(list_filter(['worthless', 'trash', 'pathetic', 'loser'], lambda k: contains(lower(text), k))) > 0
""")
def _crisis_documents(fx):
    docs = fx.tables.documents.select("doc_id", "text")
    return S.crisis_alerts(docs, None, DOC_CRISIS, text_col="text").select("doc_id", "matched")


@register("phone_extract", "I3/T28", [], r"""
SELECT doc_id, regexp_replace(regexp_extract(text, '(\+?\d[\d\s\-().]{7,})', 1), '\s+', '', 'g') AS phone
FROM documents WHERE regexp_extract(text, '(\+?\d[\d\s\-().]{7,})', 1) <> ''
""")
def _phone_extract(fx):
    return S.phone_numbers(fx.tables.documents.select("doc_id", "text")).select("doc_id", "phone")
