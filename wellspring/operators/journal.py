"""Journals: partial upserts, deletes, windows, themes, reflections, mood series.

Tables:
  journals(user_id, entry_date, entry, mood, created_at, updated_at)
  journal log(seq, user_id, entry_date, ts, entry, mood): one save per row;
      ``None`` leaves a field alone, ``''`` overwrites it (T12).
  deletes(seq, user_id, entry_date)

Scale notes: merges are one grouped aggregate on (user_id, entry_date), sorted as its values are text, with
partial aggregation, so a user with a third of all changes is combined map-side.
Windows are tagged once with ``explode`` over the (7, 30, 90) list instead of
three scans.  Per-(user, window) lists are bounded by the keyword list or by
``k`` (a group limit below the shuffle), never by the number of entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellspring.fixed_values import INSIGHT_WINDOWS, REFLECTION_EMPTY_TEXT, REFLECTION_LAST_N, THEME_KEYWORDS
from wellspring.functions.dates import days_in_month, leading_blanks
from wellspring.functions.mood import mood_icon, mood_score
from wellspring.functions.text import capitalize, matching_keywords
from wellspring.sources.versioned import latest_snapshot, next_version, rewrite_partitions

_KEY = ["user_id", "entry_date"]
#: Columns of the stored journal table, with its partition.
JOURNAL_TABLE = T.StructType([
    T.StructField("user_id", T.LongType()), T.StructField("entry_date", T.DateType()), T.StructField("entry", T.StringType()),
    T.StructField("mood", T.StringType()), T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()), T.StructField("month", T.StringType())])


def _last_set(col: str) -> Column:
    # Last non-null value by seq: rows whose value is null get a null ordering,
    # which max_by skips (the FILTER of the SQL form).
    return F.max_by(F.col(col), F.when(F.col(col).isNotNull(), F.col("seq")))


def journal_merge(base: DataFrame | None, log: DataFrame, deletes: DataFrame | None = None) -> DataFrame:
    """H1 (+H2 with ``deletes``): apply a log of partial saves to the journal table.

    Per (user, date): ``entry`` and ``mood`` are each the last non-null value
    (base row first); a save with both fields null still creates the row.
    ``created_at`` is the time of the first save (or the base value);
    ``updated_at`` moves only when a later save sets a field (T12, H19).
    With ``deletes``, only changes after the key's last delete count, so a
    delete after the last save removes the row.
    """
    changes = log.select("seq", *_KEY, "entry", "mood",
                         F.col("ts").alias("c_ts"), F.col("ts").alias("u_ts"))
    if base is not None:
        b = base.select(F.lit(-1).cast("bigint").alias("seq"), *_KEY, "entry", "mood",
                        F.col("created_at").alias("c_ts"), F.col("updated_at").alias("u_ts"))
        changes = b.unionByName(changes)
    if deletes is not None:
        last_del = deletes.groupBy(*_KEY).agg(F.max("seq").alias("del_seq"))
        changes = (changes.join(last_del, _KEY, "left")
                   .filter(F.col("del_seq").isNull() | (F.col("seq") > F.col("del_seq")))
                   .drop("del_seq"))
    touched = F.col("entry").isNotNull() | F.col("mood").isNotNull()
    agg = changes.groupBy(*_KEY).agg(
        _last_set("entry").alias("entry"),
        _last_set("mood").alias("mood"),
        F.min_by("c_ts", "seq").alias("created_at"),
        F.min_by("u_ts", "seq").alias("first_u"),
        F.min("seq").alias("first_seq"),
        F.max_by(F.col("u_ts"), F.when(touched, F.col("seq"))).alias("last_u"),
        F.max(F.when(touched, F.col("seq"))).alias("last_touch_seq"),
    )
    return agg.select(*_KEY, "entry", "mood", "created_at",
                      F.when(F.col("last_touch_seq") > F.col("first_seq"), F.col("last_u"))
                      .otherwise(F.col("first_u")).alias("updated_at"))


def journal_apply(path: str, log: DataFrame, deletes: DataFrame | None = None) -> None:
    """H1/H2 on a stored table: apply a log (and deletes) to the journals under ``path``,
    partitioned by month; months that no change names are neither read nor rewritten."""
    spark = log.sparkSession
    month = F.date_format("entry_date", "yyyy-MM").alias("month")
    change = log.select(month) if deletes is None else log.select(month).unionByName(deletes.select(month))

    def merge(old: DataFrame) -> DataFrame:
        merged = journal_merge(old, log, deletes)
        return merged.withColumn("month", month)
    rewrite_partitions(path, "month", next_version(spark, path), change, merge, JOURNAL_TABLE)


def journal_table(spark: SparkSession, path: str) -> DataFrame:
    """The live rows of a table that :func:`journal_apply` keeps."""
    return latest_snapshot(spark, path, JOURNAL_TABLE, "month")


def journal_lookup(journals: DataFrame, keys: DataFrame) -> DataFrame:
    """Entry and mood for each requested (user, date); a missing row gives
    text ``''`` and mood null, a stored null text stays null."""
    j = journals.select(*_KEY, "entry", "mood", F.lit(True).alias("_found"))
    out = keys.select(*_KEY).join(j, _KEY, "left")
    return out.select(*_KEY, F.when(F.col("_found").isNull(), F.lit("")).otherwise(F.col("entry")).alias("entry"),
                      "mood")


def journal_dates(journals: DataFrame) -> DataFrame:
    """Dates with an entry as ``YYYY-MM-DD`` text."""
    return journals.select("user_id", F.date_format("entry_date", "yyyy-MM-dd").alias("entry_date"))


def journals_by_days(journals: DataFrame, as_of: str, days: list[int] = INSIGHT_WINDOWS) -> DataFrame:
    """Tag each entry with every trailing window it falls in (one pass).

    ``entry_date >= as_of - d`` with no upper bound (T11), so a window of d
    days spans d + 1 calendar days.
    """
    arr = F.array(*[F.lit(d) for d in days])
    asof = F.to_date(F.lit(as_of))
    tagged = journals.select(
        "user_id", "entry_date", "entry", "mood",
        F.explode(F.filter(arr, lambda d: F.col("entry_date") >= F.date_sub(asof, d))).alias("days"))
    return tagged


def mood_series(tagged: DataFrame) -> DataFrame:
    """B11 + I9 + I10: truthy moods only (null and '' dropped), with score and icon."""
    return (tagged.filter(F.col("mood").isNotNull() & (F.col("mood") != ""))
            .select("user_id", "days", "entry_date", "mood",
                    mood_score("mood").alias("score"), mood_icon("mood").alias("icon")))


def mood_trailing(tagged: DataFrame) -> DataFrame:
    """J8 (extension: the application only plots the points): mean mood score
    and point count per user and trailing window."""
    s = mood_series(tagged)
    return (s.groupBy("user_id", "days")
            .agg(F.count("*").alias("points"), F.round(F.avg("score"), 6).alias("mean_score")))


def theme_counts(tagged: DataFrame, keywords: list[str] = THEME_KEYWORDS) -> DataFrame:
    """Number of entries containing each keyword, per user and window.

    Substring match on the lower-cased text, once per entry per keyword (T29);
    only matching keywords are exploded, so nothing crosses entries with
    keywords on the wire.  Zero counts do not appear.
    """
    pos = F.create_map(*[v for i, k in enumerate(keywords) for v in (F.lit(k), F.lit(i))])
    hits = tagged.select("user_id", "days", F.explode(matching_keywords("entry", keywords)).alias("keyword"))
    return (hits.groupBy("user_id", "days", "keyword").agg(F.count("*").alias("entries"))
            .withColumn("keyword_pos", pos[F.col("keyword")]))


def top_themes(counts: DataFrame) -> DataFrame:
    """Themes per (user, window) ranked by count desc, ties in declared
    keyword order, capitalised.  The list per group is bounded by the keyword
    list, so it is collected and sorted inside the aggregate (no window)."""
    ranked = (counts.groupBy("user_id", "days")
              .agg(F.sort_array(F.collect_list(F.struct((-F.col("entries")).alias("neg"),
                                                          F.col("keyword_pos"), F.col("keyword"),
                                                          F.col("entries")))).alias("r")))
    return ranked.select("user_id", "days", F.posexplode("r").alias("rank0", "t")).select(
        "user_id", "days", (F.col("rank0") + 1).alias("rank"),
        capitalize("t.keyword").alias("theme"), F.col("t.entries").alias("entries"))


def reflection_text(tagged: DataFrame, k: int = REFLECTION_LAST_N) -> DataFrame:
    """The last ``k`` non-empty entries of each (user, window), joined by a
    newline in date order.  ``row_number() <= k`` is limited per group before
    the shuffle; the collected list holds at most ``k`` items."""
    w = Window.partitionBy("user_id", "days").orderBy(F.col("entry_date").desc())
    last = (tagged.filter(F.col("entry").isNotNull() & (F.col("entry") != ""))
            .withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k))
    return (last.groupBy("user_id", "days")
            .agg(F.array_sort(F.collect_list(F.struct("entry_date", "entry"))).alias("e"))
            .select("user_id", "days", F.size("e").alias("n_entries"),
                    F.array_join(F.transform("e", lambda x: x["entry"]), "\n").alias("text")))


def journal_calendar(journals: DataFrame) -> DataFrame:
    """C8 + I8: a day spine for every (user, month) that has an entry, each day
    flagged when it has one; with the month grid's leading blanks and length."""
    months = journals.select("user_id", F.trunc("entry_date", "month").alias("month")).distinct()
    spine = months.select("user_id", "month",
                          F.explode(F.sequence("month", F.last_day("month"))).alias("day"),
                          leading_blanks("month").alias("leading_blanks"),
                          days_in_month("month").alias("days_in_month"))
    have = journals.select("user_id", F.col("entry_date").alias("day"), F.lit(True).alias("has_entry"))
    return (spine.join(have, ["user_id", "day"], "left")
            .withColumn("has_entry", F.coalesce("has_entry", F.lit(False))))


def _smallest_window(journals: DataFrame, as_of: str, days: list[int]) -> DataFrame:
    """Entries within the widest window, with ``_w``, the smallest that holds them.

    All windows end alike (B10 has no upper bound), so an entry lies in ``_w`` and in
    every wider one: work is done once per entry and handed on to those at the end."""
    windows = F.array(*[F.lit(d) for d in sorted(days)])
    asof = F.to_date(F.lit(as_of))
    near = journals.select("user_id", "entry_date", "entry", "mood").filter(F.col("entry_date") >= F.date_sub(asof, max(days)))
    return near.withColumn("_w", F.element_at(F.filter(windows, lambda d: F.col("entry_date") >= F.date_sub(asof, d)), 1))


def _wider(days: list[int]) -> Column:
    return F.explode(F.filter(F.array(*[F.lit(d) for d in sorted(days)]), lambda d: d >= F.col("_w"))).alias("days")


def themes_by_days(journals: DataFrame, as_of: str, keywords: list[str] = THEME_KEYWORDS,
                   days: list[int] = INSIGHT_WINDOWS) -> DataFrame:
    """D4 over all windows in one pass: :func:`theme_counts` of :func:`journals_by_days`.

    Each text is searched once; counts per smallest window are summed up into the wider ones."""
    pos = F.create_map(*[v for i, k in enumerate(keywords) for v in (F.lit(k), F.lit(i))])
    hits = _smallest_window(journals, as_of, days).select("user_id", "_w", F.explode(matching_keywords("entry", keywords)).alias("keyword"))
    counts = hits.groupBy("user_id", "_w", "keyword").agg(F.count("*").alias("n")).select("user_id", "keyword", "n", _wider(days))
    return (counts.groupBy("user_id", "days", "keyword").agg(F.sum("n").alias("entries"))
            .withColumn("keyword_pos", pos[F.col("keyword")]))


def _last_entries(journals: DataFrame, as_of: str, days: list[int], k: int) -> DataFrame:
    """Per user the last ``k`` non-empty entries in date order (``_e``) and the smallest window that holds one.

    A window's last ``k`` entries are those of the user's last ``k`` that lie in it, so
    ``k`` texts a user are exchanged, whatever the number of windows."""
    w = Window.partitionBy("user_id").orderBy(F.col("entry_date").desc())
    last = (_smallest_window(journals, as_of, days).filter(F.col("entry").isNotNull() & (F.col("entry") != ""))
            .select("user_id", "entry_date", "entry", "_w", F.row_number().over(w).alias("rn")).filter(F.col("rn") <= k))
    return last.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("entry_date", "entry", "_w"))).alias("_e"), F.min("_w").alias("_w"))


def _of_window(column: str = "_e") -> Column:
    return F.filter(column, lambda x: x["_w"] <= F.col("days"))


def reflections_by_days(journals: DataFrame, as_of: str, days: list[int] = INSIGHT_WINDOWS, k: int = REFLECTION_LAST_N) -> DataFrame:
    """D6 over all windows in one pass: :func:`reflection_text` of :func:`journals_by_days`."""
    cut = _last_entries(journals, as_of, days, k).select("user_id", "_e", _wider(days)).withColumn("_e", _of_window())
    return cut.select("user_id", "days", F.size("_e").alias("n_entries"),
                      F.array_join(F.transform("_e", lambda x: x["entry"]), "\n").alias("text"))


def insights_report(journals: DataFrame, as_of: str, keywords: list[str] = THEME_KEYWORDS,
                    days: list[int] = INSIGHT_WINDOWS, k: int = REFLECTION_LAST_N) -> DataFrame:
    """K7: per (user, window) the ranked themes, the reflection text (or the
    fixed no-entries text) and the mood-series size and mean.

    One hash aggregate on (user, smallest window) computes every keyword's entry
    count (one conditional sum per keyword; the list is small and fixed) and the
    mood statistics, summed up into the wider windows; the last ``k`` entries a
    user are the only other branch.
    """
    low = F.lower(F.coalesce(F.col("entry"), F.lit("")))
    score = F.when(F.col("mood").isNotNull() & (F.col("mood") != ""), mood_score("mood"))
    names = [f"_k{i}" for i in range(len(keywords))]
    sums = [F.sum(F.contains(F.col("_low"), F.lit(kw)).cast("int")).alias(name) for name, kw in zip(names, keywords)]
    sums += [F.count_if(F.col("mood").isNotNull() & (F.col("mood") != "")).alias("mood_points"), F.count(score).alias("_n"), F.sum(score).alias("_s")]
    stats = _smallest_window(journals, as_of, days).withColumn("_low", low).groupBy("user_id", "_w").agg(*sums)
    stats = stats.select("user_id", _wider(days), *names, "mood_points", "_n", "_s").groupBy("user_id", "days").agg(
        *[F.sum(c).alias(c) for c in (*names, "mood_points", "_n", "_s")])
    ranked = F.array_sort(F.filter(F.array(*[
        F.struct((-F.col(name)).alias("neg"), F.lit(i).alias("pos"), F.lit(kw).alias("kw"))
        for i, (name, kw) in enumerate(zip(names, keywords))]), lambda x: x["neg"] < 0))
    themes = F.array_join(F.transform(ranked, lambda x: capitalize(x["kw"])), ", ")
    mean = F.round(F.col("_s") / F.when(F.col("_n") > 0, F.col("_n")), 6)
    # Joined by user, where the texts lie already; a window's are cut from them afterwards.
    out = stats.select("user_id", "days", themes.alias("themes"), "mood_points", mean.alias("mean_score")).join(
        _last_entries(journals, as_of, days, k).select("user_id", "_e"), "user_id", "left")
    text = F.array_join(F.transform(_of_window(), lambda x: x["entry"]), "\n")
    return out.select("user_id", "days", "themes",
                      F.when(F.size(_of_window()) > 0, text).otherwise(F.lit(REFLECTION_EMPTY_TEXT)).alias("reflection"),
                      F.col("mood_points").cast("bigint").alias("mood_points"), "mean_score")
