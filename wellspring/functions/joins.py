"""Join helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which a null key meets a null key; the keys stand
    once, as the left side has them.  It hashes and sorts like a plain equi-join."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return left.join(renamed, cond, how).drop(*[f"_right_{k}" for k in keys])


def rekey(key: Column, kind: str = "long") -> Column:
    """The same key as a computed expression.  Joined on it, an aggregate gets an
    exchange of its own, so AQE can split the partition of a hot key on the
    other side (it leaves joins alone that reuse an aggregate's partitioning)."""
    if kind == "long":
        return key.bitwiseXOR(F.lit(0).cast("long"))
    return F.concat(key, F.lit(b"" if kind == "binary" else ""))
