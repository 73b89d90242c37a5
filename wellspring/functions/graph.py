"""Connected components of links, in joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.functions.joins import rekey
from wellspring.session import stored


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected links ``(a, b)`` of longs: a row
    ``(v, component)`` per linked vertex, component being its smallest vertex.

    Large-star and small-star rounds: each hands a vertex's neighbours on to the
    smallest of them until every vertex hangs on its component's smallest.  A
    round is joins and grouped minima over the links; nothing is collected but
    the two numbers that tell whether the links still change.  Links are
    written to the shared folder after each round.
    """
    state = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state = stored(state, "links")
    seen = _fingerprint(state)
    while True:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(
            rekey(F.col("u")).alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("k")).select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(rekey(F.col("u")).alias("k"), "m")
        small = large.join(low, F.col("u") == F.col("k")).select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                              F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        state = stored(small.where("u <> v").distinct(), "links")
        now = _fingerprint(state)
        if now == seen:
            break
        seen = now
    tops = state.select(F.col("v")).distinct().select("v", F.col("v").alias("component"))
    return state.select(F.col("u").alias("v"), F.col("v").alias("component")).unionByName(tops)


def _fingerprint(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"),
                    F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]
