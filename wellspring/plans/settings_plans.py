"""Registered settings and persona queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wellspring.fixed_values import APP_DEFAULTS, PERSONAS
from wellspring.operators import settings as ST
from wellspring.plans.registry import register
from wellspring.session import shared_path
from wellspring.sources.fixtures import halves

MERGED_SQL = """
merged AS (
 SELECT user_id, setting_key, arg_max(setting_value, seq) AS setting_value, arg_max(ts, seq) AS updated_at
 FROM settings_log WHERE setting_value IS NOT NULL GROUP BY user_id, setting_key)"""

DEFAULTS_SQL = "defaults AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in APP_DEFAULTS) + ") d(k, v))"

FORM_LOG_SQL = """
form_log AS (SELECT seq, user_id, setting_key, CASE WHEN setting_value LIKE '%0' THEN NULL ELSE setting_value END AS setting_value, ts
 FROM settings_log)"""


def _form_log(fx):
    # The form posts a missing field as null: values ending in 0 stand for those.
    log = fx.settings_log
    return log.withColumn("setting_value", F.when(F.col("setting_value").endswith("0"), F.lit(None))
                          .otherwise(F.col("setting_value")))


def _session_types(fx):
    return fx.sessions.select("persona").distinct()


@register("settings_merge", "H3", ["settings_log"], "SELECT * FROM merged", ctes=MERGED_SQL)
def _settings_merge(fx):
    return ST.settings_merge(fx.settings_log)


@register("settings_merge_base", "H3", ["settings_log"], "SELECT * FROM merged", ctes=MERGED_SQL)
def _settings_merge_base(fx):
    first, second = halves(fx.settings_log)
    return ST.settings_merge(second, ST.settings_merge(first))


@register("effective_settings", "C5/I16", ["users", "settings_log"], """
SELECT p.user_id, p.setting_key, coalesce(s.setting_value, d.v, CASE WHEN p.setting_key = 'summary_count' THEN '100' END) AS setting_value
FROM pairs p LEFT JOIN merged s ON s.user_id = p.user_id AND s.setting_key = p.setting_key
LEFT JOIN defaults d ON d.k = p.setting_key
""", ctes=MERGED_SQL + ",\n" + DEFAULTS_SQL + """,
pairs AS (SELECT u.id AS user_id, d.k AS setting_key FROM users u CROSS JOIN defaults d
 UNION SELECT u.id AS user_id, 'summary_count' AS setting_key FROM users u
 UNION SELECT s.user_id, s.setting_key FROM merged s WHERE s.user_id IN (SELECT id FROM users))""")
def _effective_settings(fx):
    return ST.effective_settings(fx.users, ST.settings_merge(fx.settings_log))


@register("settings_none_audit", "Q9/T13", ["settings_log"], """
SELECT setting_key, count(*) AS rows, count(DISTINCT user_id) AS users
FROM (SELECT user_id, setting_key, arg_max(coalesce(setting_value, 'None'), seq) AS setting_value
      FROM form_log GROUP BY user_id, setting_key) t
WHERE setting_value = 'None' GROUP BY setting_key
""", ctes=FORM_LOG_SQL)
def _settings_none_audit(fx):
    return ST.settings_none_audit(ST.settings_merge(_form_log(fx), skip_nulls=False))


PROPERTIES_SQL = r"""
l AS (SELECT tenant, line_no, regexp_replace(value, '^\s+|\s+$', '', 'g') AS line FROM property_lines),
f AS (SELECT * FROM l WHERE line <> '' AND NOT starts_with(line, '#') AND strpos(line, '=') > 0),
kv AS (SELECT tenant, line_no,
  CASE WHEN substr(line, 1, strpos(line, '=') - 1) = 'msg_retention' THEN 'summary_count'
       ELSE regexp_replace(substr(line, 1, strpos(line, '=') - 1), '^\s+|\s+$', '', 'g') END AS key,
  regexp_replace(substr(line, strpos(line, '=') + 1), '^\s+|\s+$', '', 'g') AS value FROM f)"""


def _property_files(fx):
    """One file per tenant in the shared folder, read back by path."""
    path = shared_path(fx.spark, "properties")
    ST.write_properties(fx.property_lines, path)
    return ST.read_properties(fx.spark, path, "/tenant=([^/]+)/")


@register("read_properties", "A3/T37", ["property_lines"], """
SELECT tenant, key, arg_max(value, line_no) AS value FROM kv GROUP BY tenant, key
""", ctes=PROPERTIES_SQL)
def _read_properties(fx):
    props, _rejects = _property_files(fx)
    return props.withColumn("tenant", F.col("tenant").cast("bigint"))


@register("read_properties_rejects", "A3", ["property_lines"], """
SELECT tenant, line FROM l WHERE line <> '' AND NOT starts_with(line, '#') AND strpos(line, '=') = 0
""", ctes=PROPERTIES_SQL)
def _read_properties_rejects(fx):
    _props, rejects = _property_files(fx)
    return rejects.select(F.col("tenant").cast("bigint").alias("tenant"), "line")


@register("persona_list", "B12", ["sessions"], """
SELECT persona, CAST(row_number() OVER (ORDER BY persona) AS INTEGER) AS position FROM (SELECT DISTINCT persona FROM sessions) t
""")
def _persona_list(fx):
    return ST.persona_list(_session_types(fx))


@register("persona_picker", "B13/T31", ["sessions"], """
SELECT persona, lower(persona) = 'cbt' AS is_default FROM (SELECT DISTINCT persona FROM sessions) t
WHERE lower(persona) NOT IN ('demo', 'casual')
""")
def _persona_picker(fx):
    return ST.persona_picker(_session_types(fx))


STORED_TYPES_SQL = """
stored AS (SELECT CAST(length(persona) AS BIGINT) AS id, persona, concat('You are ', persona) AS prompt FROM (SELECT DISTINCT persona FROM sessions) t)"""


def _stored_types(fx):
    types = _session_types(fx)
    return types.select(F.length("persona").cast("bigint").alias("id"), "persona", F.concat(F.lit("You are "), F.col("persona")).alias("prompt"))


@register("seed_personas", "A2", ["sessions"], "SELECT id, persona, prompt FROM stored", ctes=STORED_TYPES_SQL)
def _seed_personas(fx):
    return ST.seed_personas(_stored_types(fx), ST.persona_table(fx.spark))


@register("seed_personas_empty", "A2", ["sessions"], """
SELECT id, persona, prompt FROM (VALUES """ + ", ".join(
    "({}, '{}', '{}')".format(i, *(t.replace("'", "''") for t in row)) for i, row in enumerate(PERSONAS, 1)) + """) p(id, persona, prompt)
WHERE NOT EXISTS (SELECT 1 FROM stored WHERE persona = 'none such')
""", ctes=STORED_TYPES_SQL)
def _seed_personas_empty(fx):
    # No session has this persona, so the stored table is empty and is seeded.
    return ST.seed_personas(_stored_types(fx).filter("persona = 'none such'"), ST.persona_table(fx.spark))
