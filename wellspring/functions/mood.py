"""Mood score and icon."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wellspring.fixed_values import MOOD_ICON_DEFAULT, MOOD_ICONS, MOOD_SCORE_DEFAULT, MOOD_SCORES


def _lookup(x, pairs, default) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    m = F.create_map(*[v for k, s in pairs for v in (F.lit(k), F.lit(s))])
    return F.coalesce(m[c], F.lit(default))


def mood_score(x) -> Column:
    """happy 2, neutral 1, anxious 0.5, sad 0, angry -1; anything else 1."""
    return _lookup(x, MOOD_SCORES, MOOD_SCORE_DEFAULT).cast("double")


def mood_icon(x) -> Column:
    """Emoji for the five known moods, a question mark otherwise."""
    return _lookup(x, MOOD_ICONS, MOOD_ICON_DEFAULT)
