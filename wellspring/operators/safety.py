"""Safety: hotline per user, crisis alerts over messages, phone numbers in replies
(C6, J3, I3, I17, A8).

The hotline table is a fixed dimension (one row per supported country), so it
is a literal map inside the expression: no join and no shuffle.  Keyword
matching is ``exists`` over a literal keyword array, evaluated in codegen on
the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspring.fixed_values import (CRISIS_KEYWORDS, CRISIS_RESPONSE_PREFIX, HOTLINE_FALLBACK, HOTLINE_UNKNOWN,
                                     HOTLINES)
from wellspring.functions.text import contains_any, has_crisis_marker, matching_keywords, normalise_quotes, \
    phone_extract


def hotline_table(spark: SparkSession) -> DataFrame:
    """The hotline dimension as a DataFrame (country, hotline)."""
    return spark.createDataFrame(HOTLINES, "country string, hotline string")


def hotline_for(country) -> Column:
    """Upper-cased country -> hotline; unknown -> ``N/A``; no country -> the generic text."""
    c = F.col(country) if isinstance(country, str) else country
    m = F.create_map(*[F.lit(x) for kv in HOTLINES for x in kv])
    return F.when(c.isNull(), F.lit(HOTLINE_FALLBACK)).otherwise(F.coalesce(m[F.upper(c)], F.lit(HOTLINE_UNKNOWN)))


def user_hotlines(user_country: DataFrame) -> DataFrame:
    """Hotline per user from the stored country code."""
    return user_country.select("user_id", "country", hotline_for("country").alias("hotline"))


def crisis_alerts(messages: DataFrame, user_country: DataFrame | None = None,
                  keywords: list[str] = CRISIS_KEYWORDS, normalize_quotes: bool = False,
                  text_col: str = "message") -> DataFrame:
    """User messages containing any crisis phrase (plain substring of the
    lower-cased text), with the matched phrases, the user's hotline and the
    reply text the application would show.  ``normalize_quotes`` also matches
    typographic apostrophes (off by default, as in the original)."""
    text = F.col(text_col)
    if normalize_quotes:
        text = normalise_quotes(text)
    m = messages.filter(F.col("role") == "user") if "role" in messages.columns else messages
    hits = (m.withColumn("_t", text).filter(contains_any("_t", keywords))
            .withColumn("matched", F.array_join(matching_keywords("_t", keywords), "|")).drop("_t"))
    if user_country is not None:
        hits = hits.join(user_country.select("user_id", "country"), "user_id", "left")
    else:
        hits = hits.withColumn("country", F.lit(None).cast("string"))
    response = F.concat(F.lit(CRISIS_RESPONSE_PREFIX), hotline_for("country"))
    return (hits.withColumn("hotline", hotline_for("country"))
            .withColumn("response", response)
            .withColumn("marker", has_crisis_marker(response))
            .withColumn("phone", phone_extract(response)))


def phone_numbers(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The first phone-number-like run of each text, whitespace removed (rows without one are dropped)."""
    return df.withColumn("phone", phone_extract(text_col)).filter(F.col("phone").isNotNull())
