"""Registered journal queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wellspring.functions import dates as D
from wellspring.operators import journal as J
from wellspring.plans.registry import register
from wellspring.session import shared_path
from wellspring.sources.fixtures import AS_OF, halves

# Keywords that occur in the test prose (the application's defaults do not).
TEST_THEMES = ["work", "worthless", "idiot", "with", "that"]

JOURNALS_SQL = """
journals AS (
 SELECT user_id, entry_date,
  arg_max(entry, seq) FILTER (WHERE entry IS NOT NULL) AS entry,
  arg_max(mood, seq) FILTER (WHERE mood IS NOT NULL) AS mood,
  arg_min(ts, seq) AS created_at,
  CASE WHEN max(seq) FILTER (WHERE entry IS NOT NULL OR mood IS NOT NULL) > min(seq)
       THEN arg_max(ts, seq) FILTER (WHERE entry IS NOT NULL OR mood IS NOT NULL)
       ELSE arg_min(ts, seq) END AS updated_at
 FROM journal_log GROUP BY user_id, entry_date)"""

TAGGED_SQL = JOURNALS_SQL + f""",
tagged AS (
 SELECT j.user_id, j.entry_date, j.entry, j.mood, w.days
 FROM journals j JOIN (VALUES (7), (30), (90)) w(days) ON j.entry_date >= DATE '{AS_OF}' - w.days)"""

KEYWORDS_SQL = "(VALUES " + ", ".join(f"('{k}', {i})" for i, k in enumerate(TEST_THEMES)) + ") kw(keyword, keyword_pos)"

THEME_COUNTS_SQL = TAGGED_SQL + f""",
theme_counts AS (
 SELECT t.user_id, t.days, kw.keyword, count(*) AS entries, kw.keyword_pos
 FROM tagged t JOIN {KEYWORDS_SQL} ON contains(lower(coalesce(t.entry, '')), kw.keyword)
 GROUP BY t.user_id, t.days, kw.keyword, kw.keyword_pos),
top_themes AS (
 SELECT user_id, days,
  CAST(row_number() OVER (PARTITION BY user_id, days ORDER BY entries DESC, keyword_pos) AS INTEGER) AS rank,
  upper(keyword[1]) || lower(keyword[2:]) AS theme, entries
 FROM theme_counts)"""

REFLECTION_SQL = """
reflection AS (
 SELECT user_id, days, CAST(count(*) AS INTEGER) AS n_entries, string_agg(entry, chr(10) ORDER BY entry_date) AS text
 FROM (SELECT *, row_number() OVER (PARTITION BY user_id, days ORDER BY entry_date DESC) AS rn
       FROM tagged WHERE entry IS NOT NULL AND entry <> '') t
 WHERE rn <= 10 GROUP BY user_id, days)"""

MOOD_SERIES_SQL = """
mood_series AS (
 SELECT user_id, days, entry_date, mood,
  CAST(CASE mood WHEN 'happy' THEN 2 WHEN 'neutral' THEN 1 WHEN 'sad' THEN 0 WHEN 'anxious' THEN 0.5 WHEN 'angry' THEN -1 ELSE 1 END AS DOUBLE) AS score,
  CASE mood WHEN 'happy' THEN '😊' WHEN 'neutral' THEN '😐' WHEN 'sad' THEN '😟' WHEN 'anxious' THEN '😕' WHEN 'angry' THEN '😠' ELSE '❓' END AS icon
 FROM tagged WHERE mood IS NOT NULL AND mood <> '')"""


def _journals(fx):
    return J.journal_merge(None, fx.journal_log)


def _tagged(fx):
    return J.journals_by_days(_journals(fx), AS_OF)


@register("journal_merge", "H1", ["journal_log"], "SELECT * FROM journals", ctes=JOURNALS_SQL, dates=["entry_date"])
def _journal_merge(fx):
    return _journals(fx)


@register("journal_merge_base", "H1", ["journal_log"], "SELECT * FROM journals", ctes=JOURNALS_SQL, dates=["entry_date"])
def _journal_merge_base(fx):
    # The first half of the log makes a table, the second is merged into it.
    first, second = halves(fx.journal_log)
    return J.journal_merge(J.journal_merge(None, first), second)


@register("journal_apply", "H1", ["journal_log"], "SELECT * FROM journals", ctes=JOURNALS_SQL, dates=["entry_date"])
def _journal_apply(fx):
    # Two logs applied one after the other to a stored table.
    path = shared_path(fx.spark, "journals")
    for log in halves(fx.journal_log):
        J.journal_apply(path, log)
    return J.journal_table(fx.spark, path).drop("month")


@register("journal_merge_deletes", "H2", ["journal_log", "journal_deletes"], """
SELECT user_id, entry_date,
  arg_max(entry, seq) FILTER (WHERE entry IS NOT NULL) AS entry,
  arg_max(mood, seq) FILTER (WHERE mood IS NOT NULL) AS mood,
  arg_min(ts, seq) AS created_at,
  CASE WHEN max(seq) FILTER (WHERE entry IS NOT NULL OR mood IS NOT NULL) > min(seq)
       THEN arg_max(ts, seq) FILTER (WHERE entry IS NOT NULL OR mood IS NOT NULL)
       ELSE arg_min(ts, seq) END AS updated_at
FROM live GROUP BY user_id, entry_date
""", dates=["entry_date"], ctes="""
live AS (SELECT l.* FROM journal_log l
 WHERE l.seq > coalesce((SELECT max(d.seq) FROM journal_deletes d WHERE d.user_id = l.user_id AND d.entry_date = l.entry_date), -1))
""")
def _journal_merge_deletes(fx):
    return J.journal_merge(None, fx.journal_log, fx.journal_deletes)


@register("journal_lookup", "B8", ["journal_log", "journal_deletes"], """
SELECT k.user_id, k.entry_date, CASE WHEN j.user_id IS NULL THEN '' ELSE j.entry END AS entry, j.mood
FROM journal_deletes k LEFT JOIN journals j ON j.user_id = k.user_id AND j.entry_date = k.entry_date
""", ctes=JOURNALS_SQL, dates=["entry_date"])
def _journal_lookup(fx):
    return J.journal_lookup(_journals(fx), fx.journal_deletes)


@register("journal_dates", "B9", ["journal_log"], """
SELECT user_id, strftime(entry_date, '%Y-%m-%d') AS entry_date FROM journals
""", ctes=JOURNALS_SQL)
def _journal_dates(fx):
    return J.journal_dates(_journals(fx))


@register("journals_by_days", "B10", ["journal_log"], "SELECT user_id, entry_date, entry, mood, days FROM tagged",
          ctes=TAGGED_SQL, dates=["entry_date"])
def _journals_by_days(fx):
    return _tagged(fx)


@register("mood_series", "B11/I9/I10", ["journal_log"], "SELECT * FROM mood_series",
          ctes=TAGGED_SQL + "," + MOOD_SERIES_SQL, dates=["entry_date"])
def _mood_series(fx):
    return J.mood_series(_tagged(fx))


@register("mood_trailing", "J8", ["journal_log"], """
SELECT user_id, days, count(*) AS points, round(avg(score), 6) AS mean_score FROM mood_series GROUP BY user_id, days
""", ctes=TAGGED_SQL + "," + MOOD_SERIES_SQL)
def _mood_trailing(fx):
    return J.mood_trailing(_tagged(fx))


@register("theme_counts", "D4", ["journal_log"], "SELECT * FROM theme_counts", ctes=THEME_COUNTS_SQL)
def _theme_counts(fx):
    return J.themes_by_days(_journals(fx), AS_OF, TEST_THEMES)


@register("top_themes", "E2", ["journal_log"], "SELECT * FROM top_themes", ctes=THEME_COUNTS_SQL)
def _top_themes(fx):
    return J.top_themes(J.themes_by_days(_journals(fx), AS_OF, TEST_THEMES))


@register("reflection_text", "D6/E3", ["journal_log"], "SELECT * FROM reflection", ctes=TAGGED_SQL + "," + REFLECTION_SQL)
def _reflection_text(fx):
    return J.reflections_by_days(_journals(fx), AS_OF)


@register("journal_calendar", "C8/I8", ["journal_log"], """
SELECT m.user_id, CAST(g.day AS DATE) AS day, m.month,
 CAST(dayofweek(m.month) AS INTEGER) AS leading_blanks, CAST(day(last_day(m.month)) AS INTEGER) AS days_in_month,
 EXISTS (SELECT 1 FROM journals j WHERE j.user_id = m.user_id AND j.entry_date = CAST(g.day AS DATE)) AS has_entry
FROM (SELECT DISTINCT user_id, CAST(date_trunc('month', entry_date) AS DATE) AS month FROM journals) m,
 LATERAL (SELECT unnest(generate_series(CAST(m.month AS TIMESTAMP), CAST(last_day(m.month) AS TIMESTAMP), INTERVAL 1 DAY)) AS day) g
""", ctes=JOURNALS_SQL, dates=["day", "month"])
def _journal_calendar(fx):
    return J.journal_calendar(_journals(fx))


@register("insights_report", "K7", ["journal_log"], f"""
SELECT k.user_id, k.days, coalesce(th.themes, '') AS themes,
 coalesce(r.text, 'No journal entries found for this period.') AS reflection,
 coalesce(m.points, 0) AS mood_points, m.mean_score
FROM (SELECT DISTINCT user_id, days FROM tagged) k
LEFT JOIN (SELECT user_id, days, string_agg(theme, ', ' ORDER BY rank) AS themes FROM top_themes GROUP BY user_id, days) th
 ON th.user_id = k.user_id AND th.days = k.days
LEFT JOIN reflection r ON r.user_id = k.user_id AND r.days = k.days
LEFT JOIN (SELECT user_id, days, count(*) AS points, round(avg(score), 6) AS mean_score FROM mood_series GROUP BY user_id, days) m
 ON m.user_id = k.user_id AND m.days = k.days
""", ctes=THEME_COUNTS_SQL + "," + REFLECTION_SQL + "," + MOOD_SERIES_SQL)
def _insights_report(fx):
    return J.insights_report(_journals(fx), AS_OF, TEST_THEMES)


@register("journal_neighbours", "I6/I7", ["journal_log"], """
SELECT user_id, strftime(entry_date, '%Y-%m-%d') AS iso, strftime(entry_date - 1, '%Y-%m-%d') AS prev_date,
 strftime(entry_date + 1, '%Y-%m-%d') AS next_date, strftime(entry_date, '%B %d, %Y') AS long_date,
 strftime(entry_date, '%d/%m') AS day_month, strftime(entry_date, '%d/%m/%y') AS short_date,
 strftime(entry_date, '%m%y') AS month_key
FROM journals
""", ctes=JOURNALS_SQL)
def _journal_neighbours(fx):
    j = _journals(fx)
    return j.select("user_id", D.fmt("entry_date", "iso").alias("iso"),
                    D.fmt(D.previous_day("entry_date"), "iso").alias("prev_date"),
                    D.fmt(D.next_day("entry_date"), "iso").alias("next_date"),
                    D.fmt("entry_date", "long").alias("long_date"),
                    D.fmt("entry_date", "day_month").alias("day_month"),
                    D.fmt("entry_date", "short").alias("short_date"),
                    D.month_key("entry_date").alias("month_key"))


__all__ = ["F"]
