"""Mixing sources to target weights, in DataFrame operations only.

Word counts are summed per source; sources share ``total`` times all words by
weight, held at ``cap`` times a source's own words with the excess reshared;
the repetition rate of a source is its target over its words.  Each document is
emitted floor(rate) times plus one copy when its hash, as a number in [0, 1),
lies under the rate's fraction.

The share is a water level: sources sorted by cap over weight are full one after
another, so ``level = (total - caps of the full ones) / weights of the rest``
with the smallest set of full sources that leaves none above its cap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wellspring.llm.common import free_name, stored

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
TOTAL, CAP = 1.5, 2.0
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """``(source, source_size, target)`` from rows ``(source, size)``.

    The windows run over one row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    per = per.withColumn("w", weight.cast("long"))
    order = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    per = (per.withColumn("full_size", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
           .withColumn("full_w", F.coalesce(F.sum("w").over(before), F.lit(0)))
           .withColumn("all_size", F.sum("source_size").over(whole))
           .withColumn("all_w", F.sum("w").over(whole))
           .withColumn("level", (F.lit(total) * F.col("all_size") - F.lit(cap) * F.col("full_size"))
                       / (F.col("all_w") - F.col("full_w")))
           .withColumn("open", F.lit(cap) * F.col("source_size") >= F.col("level") * F.col("w")))
    # The first source that its share doesn't fill sets the level of all that follow.
    level = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(whole)
    per = per.withColumn("at", level)
    target = F.least(F.lit(cap) * F.col("source_size"),
                     F.coalesce(F.col("at") * F.col("w"), F.lit(cap) * F.col("source_size")))
    return per.select("source", "source_size", target.alias("target"))


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A document's number in [0, 1): 52 bits of the MD5 of seed and id."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights=WEIGHTS, total: float = TOTAL, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """``(doc_id, size, source_size, target, copies, taken)`` per row of ``docs``.

    A null source is a source of its own, last in order; a null or empty text
    has size 0 and takes no words; rows that repeat an id are decided alike.  A
    source without words has target 0 and copies 0.  An empty table gives an
    empty result.  The word counts are written once to the shared folder.
    """
    sizes = stored(docs.select(docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{source_col}`"].alias("source"),
                               word_count(docs[f"`{text_col}`"]).alias("size")), "sizes")
    return _copies(sizes, source_targets(sizes, weights, total, cap), seed).select(
        "doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def _copies(rows: DataFrame, targets: DataFrame, seed: str) -> DataFrame:
    """``rows`` with their source's figures and ``copies``: join on the source, null with null."""
    right = targets.select(F.concat(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")), F.lit("")).alias("k"),
                           "source_size", "target")
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + (uniform(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("long")
    return (rows.withColumn("source_key", key).join(right, F.col("source_key") == F.col("k"))
            .withColumn("copies", copies))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, total: float = TOTAL, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as the mix takes it,
    with ``copy_no`` from 1 (where a column is called so, its name gives way to a free one)."""
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    rows = docs.select(docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{source_col}`"].alias("source"), row.alias("row"))
    sizes = docs.select(docs[f"`{source_col}`"].alias("source"), word_count(docs[f"`{text_col}`"]).alias("size"))
    mixed = _copies(rows, stored(source_targets(sizes, weights, total, cap), "targets"), seed).where("copies > 0")
    no = "copy_no" if free_name(docs, "copy_no") == "copy_no" else free_name(docs, "mix_copy_no")
    return mixed.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias(no)).select("row.*", no)


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3, 1, 2][1 + (row_number() OVER (ORDER BY source COLLATE "binary" ASC NULLS LAST) - 1) % 3] AS w
  FROM sizes GROUP BY source),
walk AS (
  SELECT *,
    (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE
      - 2.0::DOUBLE * coalesce(sum(source_size) OVER before, 0)::DOUBLE)
    / (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::DOUBLE AS level,
    row_number() OVER ranked AS r
  FROM per
  WINDOW ranked AS (ORDER BY source_size::DOUBLE / w, source ASC NULLS LAST),
         before AS (ORDER BY source_size::DOUBLE / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
filled AS (SELECT arg_min(level, r) AS lvl FROM walk WHERE 2.0::DOUBLE * source_size >= level * w),
targets AS (
  SELECT source, source_size,
         least(2.0::DOUBLE * source_size, coalesce((SELECT lvl FROM filled) * w, 2.0::DOUBLE * source_size)) AS target
  FROM walk),
rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         ('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM sizes d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
copied AS (SELECT *, floor(rate)::BIGINT + (u < rate - floor(rate))::BIGINT AS copies FROM rated)
SELECT doc_id, size, source_size, target, copies, size * copies AS taken FROM copied
"""
