"""Skew-safe ordered windows: ranks and next-values computed in two levels.

A plain ``row_number() over (partition by user order by ts)`` sends every row
of a user to one task; with one user holding a third of all rows that task
does a third of the work.  Here the order key is coarsened into chunks (an
order-preserving ``date_trunc``): rows are numbered only inside a
(partition, chunk) window, and each chunk's offset is a running sum over the
small per-chunk count table.  The result equals the plain window exactly,
because chunks never reorder rows; a null partition key is a partition of its
own, as in a plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wellspring.functions.dates import epoch_micros
from wellspring.functions.joins import null_safe_join

_LOW, _HIGH = -(2 ** 62), 2 ** 62


def _chunk_key(ts: str, unit, descending: bool, nulls_last: bool) -> Column:
    """Numeric chunk key that sorts (ascending) in the same order as ``ts``.

    ``unit`` is a ``date_trunc`` unit for timestamps, or an integer width for
    numeric order keys (ids)."""
    if isinstance(unit, int):
        k = F.floor(F.col(ts) / F.lit(unit)).cast("bigint")
    else:
        # Wall-clock (NTZ) arithmetic: order-preserving in every session time zone.
        k = F.floor(epoch_micros(F.date_trunc(unit, F.col(ts).cast("timestamp_ntz"))) / F.lit(1_000_000)).cast("bigint")
    if descending:
        k = -k
    return F.coalesce(k, F.lit(_HIGH if nulls_last else _LOW))


def chunked_row_number(df: DataFrame, partition: list[str], order: list[Column], ts: str,
                       unit: str = "day", descending: bool = False, nulls_last: bool = True,
                       name: str = "position") -> DataFrame:
    """``row_number() over (partition by partition order by order)`` where the
    first order key is the timestamp column ``ts`` (direction ``descending``,
    nulls ``nulls_last``); ``unit`` bounds the rows ordered by one task."""
    d = df.withColumn("_ck", _chunk_key(ts, unit, descending, nulls_last))
    counts = d.groupBy(*partition, "_ck").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*partition).orderBy("_ck").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*partition, "_ck", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inner = Window.partitionBy(*partition, "_ck").orderBy(*order)
    ranked = d.withColumn("_rn", F.row_number().over(inner))
    return (null_safe_join(ranked, offsets, [*partition, "_ck"])
            .withColumn(name, (F.col("_off") + F.col("_rn")).cast("int"))
            .drop("_ck", "_rn", "_off"))


def chunked_next(df: DataFrame, partition: list[str], ts: str, tie: str, value: str,
                 unit: str = "day", name: str = "next_value") -> DataFrame:
    """``lead(value) over (partition by partition order by ts, tie)`` in two
    levels: the lead inside each chunk, and for a chunk's last row the first
    value of the next non-empty chunk (a lead over the small chunk table)."""
    d = df.withColumn("_ck", _chunk_key(ts, unit, False, True))
    firsts = (d.groupBy(*partition, "_ck")
              .agg(F.min_by(F.col(value), F.struct(F.col(ts), F.col(tie))).alias("_first")))
    w_chunks = Window.partitionBy(*partition).orderBy("_ck")
    nxt_chunk = firsts.select(*partition, "_ck", F.lead("_first").over(w_chunks).alias("_next_chunk"))
    inner = Window.partitionBy(*partition, "_ck").orderBy(ts, tie)
    led = d.withColumn("_lead", F.lead(F.col(value)).over(inner)) \
        .withColumn("_is_last", F.lead(F.lit(1)).over(inner).isNull())
    return (null_safe_join(led, nxt_chunk, [*partition, "_ck"])
            .withColumn(name, F.when(F.col("_is_last"), F.col("_next_chunk")).otherwise(F.col("_lead")))
            .drop("_ck", "_lead", "_is_last", "_next_chunk"))


def chunked_last_value(df: DataFrame, partition: list[str], order: list[str], ts: str, value: str,
                       unit: str = "day", name: str = "last_value") -> DataFrame:
    """``last(value, ignorenulls) over (partition by partition order by order
    rows unbounded preceding)`` in two levels (``order[0]`` is the timestamp
    ``ts``): the last non-null inside the row's chunk so far, else the last
    non-null of all earlier chunks (a window over the small chunk table)."""
    d = df.withColumn("_ck", _chunk_key(ts, unit, False, True))
    # One aggregate per chunk: its last non-null value (null when it has none,
    # so chunks without values still receive the carry from before them).
    order_key = F.when(F.col(value).isNotNull(), F.struct(*[F.col(c) for c in order]))
    per_chunk = d.groupBy(*partition, "_ck").agg(F.max_by(F.col(value), order_key).alias("_v"))
    prev = Window.partitionBy(*partition).orderBy("_ck").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_chunk.select(*partition, "_ck", F.last("_v", ignorenulls=True).over(prev).alias("_carry"))
    inner = Window.partitionBy(*partition, "_ck").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = d.withColumn("_in", F.last(F.col(value), ignorenulls=True).over(inner))
    return (null_safe_join(within, carry, [*partition, "_ck"])
            .withColumn(name, F.coalesce("_in", "_carry")).drop("_ck", "_in", "_carry"))


def asof_mark(rows: DataFrame, marks: DataFrame, partition: list[str], key: str, mark: str,
              name: str = "mark", width: int = 10_000) -> DataFrame:
    """For each row, the largest ``mark`` value <= the row's ``key`` within its
    partition (null when none): an as-of lookup without pairing rows and marks.

    Rows and marks are interleaved in one ordered stream (marks first on ties)
    and the last mark seen is carried with :func:`chunked_last_value`, so the
    work is linear and a hot partition is split into id-range chunks.
    """
    r = rows.withColumn("_k", F.col(key)).withColumn("_is_mark", F.lit(0)).withColumn("_m", F.lit(None).cast("bigint"))
    m = (marks.select(*partition, F.col(mark).alias("_k")).distinct()
         .withColumn("_is_mark", F.lit(1)).withColumn("_m", F.col("_k")))
    for c in rows.columns:
        if c not in partition:
            m = m.withColumn(c, F.lit(None).cast(rows.schema[c].dataType))
    both = r.unionByName(m.select(*r.columns))
    # Order: key ascending, marks before rows at the same key (so "<=" holds).
    both = both.withColumn("_o", F.lit(1) - F.col("_is_mark"))
    got = chunked_last_value(both, partition, ["_k", "_o"], "_k", "_m", unit=width, name=name)
    return got.filter(F.col("_is_mark") == 0).drop("_k", "_is_mark", "_m", "_o")
