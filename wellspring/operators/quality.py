"""Table quality rules: reject table plus clean table.

Every rule is a column expression or one keyed aggregate/anti join; rows are
never dropped silently: each check returns the failing rows with a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellspring.fixed_values import PROTECTED_PATHS, PUBLIC_PATHS, PUBLIC_PREFIXES
from wellspring.functions.dates import parse_strict_date
from wellspring.functions.text import is_valid_email
from wellspring.schemas import FOREIGN_KEYS


def email_check(df: DataFrame, col: str = "email") -> DataFrame:
    """``email_ok`` per row (pattern anchored at the start only)."""
    return df.withColumn("email_ok", is_valid_email(col))


def domain_check(df: DataFrame, col: str, allowed: list[str] | DataFrame) -> DataFrame:
    """Q2: ``<col>_ok`` = value in the domain (a literal list, or a dimension
    table's single column joined as a small distinct set)."""
    if isinstance(allowed, list):
        return df.withColumn(f"{col}_ok", F.coalesce(F.col(col).isin(*allowed), F.lit(False)))
    dim = allowed.select(F.col(allowed.columns[0]).alias(col)).distinct().withColumn("_in", F.lit(True))
    return (df.join(dim, col, "left").withColumn(f"{col}_ok", F.col("_in").isNotNull()).drop("_in"))


def required_check(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Q3: ``failed`` = names of the rules (name -> condition that must hold) a
    row breaks; returns (clean, rejects) split on its size."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    tagged = df.withColumn("failed", failed)
    return (tagged.filter(F.size("failed") == 0).drop("failed"), tagged.filter(F.size("failed") > 0))


def unique_check(df: DataFrame, key: list[str], order: str | None = None,
                 collation: str | None = None) -> DataFrame:
    """Q4: keys that occur more than once, with their count (and the first
    ``order`` value, the row an insert would keep).

    T33: the original database compares text ignoring case and accents; pass
    ``collation="UNICODE_CI_AI"`` to group string keys the same way (binary
    comparison after normalising is the default).
    """
    aggs = [F.count("*").alias("rows")]
    if order:
        aggs.append(F.min(order).alias("kept_" + order))
    if collation:
        cols = [F.collate(F.col(k), collation).alias(k) if isinstance(df.schema[k].dataType, T.StringType)
                else F.col(k) for k in key]
        return df.groupBy(*cols).agg(*aggs).filter(F.col("rows") > 1)
    return df.groupBy(*key).agg(*aggs).filter(F.col("rows") > 1)


#: Tasks that the keys of one foreign key are dealt to, at least.
FK_TASKS = 64


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by key to a given number of tasks.  AQE merges the tasks of a shuffle by its
    compressed bytes, and keys compress so well that a few tasks would sort and hash them all; it
    leaves a number that is given as it is."""
    tasks = max(FK_TASKS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks, *keys)


def fk_orphans(tables: dict[str, DataFrame], fks=FOREIGN_KEYS) -> DataFrame:
    """Rows whose foreign key has no parent, per declared FK, as one table
    (child, column, value, rows).  Null keys are not orphans.  A child's keys are
    counted before they meet their parents, so a frequent key is one row of the join."""
    parts = []
    for child, ccols, parent, pcols in fks:
        if child not in tables or parent not in tables:
            raise ValueError(f"foreign key {child}.{ccols} -> {parent}: name both tables or leave the key out of fks")
        c = tables[child].select(*[F.col(x) for x in ccols]).filter(F.col(ccols[0]).isNotNull())
        p = tables[parent].select(*[F.col(pc).alias(cc) for pc, cc in zip(pcols, ccols)])
        counts = by_key(c, *ccols).groupBy(*ccols).agg(F.count("*").alias("rows"))
        orphan = (counts.join(by_key(p, *ccols).distinct(), ccols, "left_anti")
                  .select(F.lit(child).alias("child"), F.lit(",".join(ccols)).alias("column"),
                          F.concat_ws(",", *[F.col(x).cast("string") for x in ccols]).alias("value"), "rows"))
        parts.append(orphan)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def date_check(df: DataFrame, col: str) -> DataFrame:
    """Q6: ``<col>_date`` parsed from strict ``YYYY-M-D`` text (one-digit month and
    day allowed, as Python's ``%m``/``%d`` do); null when rejected."""
    return df.withColumn(f"{col}_date", parse_strict_date(col))


def bot_check(df: DataFrame, col: str = "nickname") -> DataFrame:
    """Q7: honeypot field filled -> ``is_bot``."""
    return df.withColumn("is_bot", F.col(col).isNotNull() & (F.col(col) != ""))


def access_audit(log: DataFrame) -> DataFrame:
    """Q8: class and outcome of each request of an access log.

    A path needs login when it is protected, or not public and not under a
    public prefix.  Unauthenticated non-OPTIONS requests that need login get
    ``401`` under ``/api/`` and ``redirect`` elsewhere; the rest ``pass``.
    """
    path = F.col("path")
    under_public_prefix = F.lit(False)
    for p in PUBLIC_PREFIXES:
        under_public_prefix = under_public_prefix | F.startswith(path, F.lit(p))
    needs = path.isin(*PROTECTED_PATHS) | (~path.isin(*PUBLIC_PATHS) & ~under_public_prefix)
    blocked = needs & ~F.col("authenticated") & (F.col("method") != "OPTIONS")
    cls = (F.when(F.startswith(path, F.lit("/static/")), F.lit("static"))
           .when(needs, F.lit("protected")).otherwise(F.lit("public")))
    outcome = (F.when(blocked & F.startswith(path, F.lit("/api/")), F.lit("401"))
               .when(blocked, F.lit("redirect")).otherwise(F.lit("pass")))
    return log.withColumn("path_class", cls).withColumn("outcome", outcome)


def access_summary(audited: DataFrame) -> DataFrame:
    """Q8: request counts by class and outcome."""
    return audited.groupBy("path_class", "outcome").agg(F.count("*").alias("requests"))
