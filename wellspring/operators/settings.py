"""Settings: upserts, defaults overlaid by overrides, audits, properties files,
persona dimension views (A3, B12, B13, C5, H3, Q9).

Tables:
  user_settings(user_id, setting_key, setting_value, updated_at)
  settings log(seq, user_id, setting_key, setting_value, ts)

Scale: the upsert is one grouped aggregate on (user, key), sorted as its values are text.  Effective settings
fold each user's overrides into one small map (bounded by the number of
setting keys) and overlay it on the literal defaults map, so no table is
crossed with the defaults.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspring.fixed_values import (APP_DEFAULTS, PERSONAS, PICKER_DEFAULT, PICKER_HIDDEN, PROPERTIES_RENAME,
                                     SUMMARY_COUNT_FALLBACK)
from wellspring.functions.text import py_strip


def settings_merge(log: DataFrame, base: DataFrame | None = None, skip_nulls: bool = True) -> DataFrame:
    """H3: last write wins per (user, key), values kept as text.

    T13 (corrected): a null value is a missing form field and is skipped;
    ``skip_nulls=False`` writes the text ``'None'`` like the original form.
    ``updated_at`` is the time of the winning write (H19).
    """
    ch = log.select("seq", "user_id", "setting_key",
                    F.col("setting_value").cast("string").alias("setting_value"), "ts")
    if skip_nulls:
        ch = ch.filter(F.col("setting_value").isNotNull())
    else:
        ch = ch.withColumn("setting_value", F.coalesce("setting_value", F.lit("None")))
    if base is not None:
        ch = base.select(F.lit(-1).cast("bigint").alias("seq"), "user_id", "setting_key", "setting_value",
                         F.col("updated_at").alias("ts")).unionByName(ch)
    return (ch.groupBy("user_id", "setting_key")
            .agg(F.max_by(F.struct("setting_value", "ts"), "seq").alias("w"))
            .select("user_id", "setting_key", "w.setting_value", F.col("w.ts").alias("updated_at")))


def defaults_map(defaults: list[tuple[str, str]] = APP_DEFAULTS):
    return F.create_map(*[F.lit(x) for kv in defaults for x in kv])


def effective_settings(users: DataFrame, overrides: DataFrame,
                       defaults: list[tuple[str, str]] = APP_DEFAULTS) -> DataFrame:
    """App defaults overlaid by each user's stored values (override wins),
    plus ``summary_count`` = 100 when neither has it; one row per (user, key)."""
    per_user = (overrides.groupBy("user_id")
                .agg(F.map_from_entries(F.collect_list(F.struct("setting_key", "setting_value"))).alias("o")))
    # Overrides win: defaults whose key the user has are filtered out first, so
    # map_concat never sees a duplicate key (no session-wide dedup policy needed).
    o = F.coalesce(F.col("o"), F.create_map().cast("map<string,string>"))
    merged = (users.select(F.col("id").alias("user_id"))
              .join(per_user, "user_id", "left")
              .select("user_id", F.map_concat(F.map_filter(defaults_map(defaults),
                                                           lambda k, v: ~F.map_contains_key(o, k)), o).alias("m")))
    filled = merged.select("user_id", F.when(~F.map_contains_key("m", F.lit("summary_count")),
                                             F.map_concat("m", F.create_map(F.lit("summary_count"),
                                                                             F.lit(SUMMARY_COUNT_FALLBACK))))
                           .otherwise(F.col("m")).alias("m"))
    return filled.select("user_id", F.explode("m").alias("setting_key", "setting_value"))


def settings_none_audit(settings: DataFrame) -> DataFrame:
    """Q9: stored values that are the text ``None`` (T13), counted by key."""
    return (settings.filter(F.col("setting_value") == "None")
            .groupBy("setting_key").agg(F.count("*").alias("rows"),
                                        F.countDistinct("user_id").alias("users")))


def parse_properties(lines: DataFrame, group_cols: list[str] | None = None,
                     order_col: str = "line_no") -> tuple[DataFrame, DataFrame]:
    """A3: ``key=value`` lines per file -> (properties, rejects).

    Lines are stripped (Python whitespace); blanks and ``#`` comments are
    skipped; the split is on the first ``=``.  The key is compared with
    ``msg_retention`` *before* it is stripped (T37), then key and value are
    stripped.  Later lines win.  Lines without ``=`` (a load error in the
    original) go to the reject table.
    """
    group_cols = group_cols or ["tenant"]
    ln = lines.select(*group_cols, order_col, py_strip(F.col("value")).alias("line"))
    ln = ln.filter((F.col("line") != "") & ~F.startswith("line", F.lit("#")))
    parts = ln.withColumn("p", F.split("line", "=", 2))
    rejects = parts.filter(F.size("p") < 2).select(*group_cols, order_col, "line")
    kv = parts.filter(F.size("p") == 2).select(
        *group_cols, order_col,
        F.when(F.col("p")[0] == PROPERTIES_RENAME[0], F.lit(PROPERTIES_RENAME[1]))
        .otherwise(py_strip(F.col("p")[0])).alias("key"),
        py_strip(F.col("p")[1]).alias("value"))
    props = (kv.groupBy(*group_cols, "key").agg(F.max_by("value", order_col).alias("value")))
    return props, rejects


def write_properties(lines: DataFrame, path: str, group_col: str = "tenant", order_col: str = "line_no") -> None:
    """A3: one properties file per group, ``path/<group_col>=<group>/part-*``, its lines in order.

    A line holds no line feed; a null one is empty."""
    text = F.coalesce(F.replace(F.col("value"), F.lit("\n"), F.lit(" ")), F.lit(""))
    (lines.select(group_col, order_col, text.alias("value")).repartition(group_col)
     .sortWithinPartitions(group_col, order_col).select(group_col, "value").write.partitionBy(group_col).text(path))


def read_properties(spark: SparkSession, paths: list[str] | str, key_pattern: str | None = None,
                    key_name: str = "tenant") -> tuple[DataFrame, DataFrame]:
    """A3 source: many properties files at once -> (properties, lines that don't load).

    The group is the file's path, or with ``key_pattern`` the pattern's first
    group in it, as ``key_name``.  Lines go by their place in the file: the start of
    the split that holds them, then their order in it, so a file may be split.
    """
    df = spark.read.option("recursiveFileLookup", "true").text(paths).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    key = F.col("file") if key_pattern is None else F.regexp_extract("file", key_pattern, 1).alias(key_name)
    df = df.select(key, "value", F.struct("start", F.monotonically_increasing_id().alias("line")).alias("place"))
    return parse_properties(df, [df.columns[0]], "place")


def persona_table(spark: SparkSession) -> DataFrame:
    """A9/A2 seed rows: (id, persona, prompt) from the fixed list."""
    rows = [F.struct(F.lit(i + 1).cast("long").alias("id"), F.lit(p).alias("persona"), F.lit(t).alias("prompt"))
            for i, (p, t) in enumerate(PERSONAS)]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def persona_list(session_types: DataFrame) -> DataFrame:
    """Persona names in sorted order with their position.

    The persona dimension is small by construction (one row per persona), so
    its names are sorted inside one aggregate; no global window is used.
    """
    return (session_types.agg(F.sort_array(F.collect_set("persona")).alias("p"))
            .select(F.posexplode("p").alias("pos", "persona"))
            .select("persona", (F.col("pos") + 1).alias("position")))


def seed_personas(existing: DataFrame, seed: DataFrame) -> DataFrame:
    """A2: the seed rows only when ``existing`` is empty, else ``existing`` unchanged.

    The emptiness test is an EXISTS subquery (no count action, no join).
    """
    seeded = seed.filter(~existing.exists())
    return existing.select(*seed.columns).unionByName(seeded)


def persona_picker(session_types: DataFrame) -> DataFrame:
    """Personas the picker shows (``demo``/``casual`` hidden by exact lower-case
    name, so ``Casual Chat`` stays, T31) with the default (``cbt``) flagged."""
    low = F.lower("persona")
    return (session_types.filter(~low.isin(*PICKER_HIDDEN))
            .select("persona", (low == PICKER_DEFAULT).alias("is_default")))
