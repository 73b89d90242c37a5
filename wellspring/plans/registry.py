"""Registered queries: each is a Spark plan over the fixture views plus the
equivalent DuckDB statement used as an independent oracle.

A plan takes ``Fixtures`` (DataFrames derived from the driver's tables) and
returns a DataFrame.  The oracle is the same fixture SQL as CTEs followed by a
plain SQL body; ``None`` marks operators that SQL cannot express (rows-only).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellspring.sources.fixtures import Fixtures, with_fixtures


@dataclass(frozen=True)
class Query:
    name: str
    plan: Callable[[Fixtures], DataFrame]
    oracle: str | None
    section: str

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return dates_as_text(self.plan(Fixtures(spark, sf_dir)))


def dates_as_text(df: DataFrame) -> DataFrame:
    """DATE columns as ISO ``yyyy-MM-dd`` text, so both engines hand the checker
    the same value (pandas turns DuckDB dates into midnight timestamps)."""
    if not any(isinstance(f.dataType, T.DateType) for f in df.schema.fields):
        return df
    return df.select(*[F.date_format(F.col(f.name), "yyyy-MM-dd").alias(f.name)
                       if isinstance(f.dataType, T.DateType) else F.col(f.name) for f in df.schema.fields])


REGISTRY: dict[str, Query] = {}


def register(name: str, section: str, fixtures: list[str] | None = None, sql: str | None = None,
             ctes: str = "", dates: list[str] | None = None, recursive: bool = False):
    """Decorator: register ``fn(fx) -> DataFrame`` under ``name`` with its oracle.

    ``dates`` names the DATE columns of the result; the oracle renders them as
    ISO text like the Spark side does.
    """

    def deco(fn: Callable[[Fixtures], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        body, extra = sql, ctes
        if sql is not None and dates:
            repl = ", ".join(f"strftime({d}, '%Y-%m-%d') AS {d}" for d in dates)
            extra = (ctes.strip() + ",\n" if ctes.strip() else "") + f"q__ AS ({sql.strip()})"
            body = f"SELECT * REPLACE ({repl}) FROM q__"
        oracle = with_fixtures(fixtures or [], body, extra, recursive) if sql is not None else None
        REGISTRY[name] = Query(name, fn, oracle, section)
        return fn

    return deco


def load_all() -> dict[str, Query]:
    """Import every plan module (each registers its queries) and return the registry."""
    from wellspring.plans import (  # noqa: F401
        accounts_plans, cascade_plans, chat_plans, journal_plans, limits_plans, prompts_plans,
        quality_plans, safety_plans, settings_plans, sources_plans, streaming_plans, tokens_plans,
    )
    return REGISTRY
