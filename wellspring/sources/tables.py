"""Typed scans (A1) and the driver's parquet tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellspring import schemas

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                 "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def scan_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Read one application table with its declared schema (no inference).

    Column pruning and filter pushdown to the parquet scan come from Catalyst.
    """
    return spark.read.schema(schemas.TABLES[name]).parquet(path)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select ``schema``'s columns in order, cast to the declared types.

    Columns the input lacks become typed nulls, extra columns are dropped.
    """
    have = set(df.columns)
    cols = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields]
    return df.select(*cols)


class DriverTables:
    """Lazy handles to ``{sf_dir}/{name}.parquet``; each property is one scan."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in DRIVER_TABLES:
            return self.table(name)
        raise AttributeError(name)

    @cached_property
    def names(self) -> list[str]:
        return list(DRIVER_TABLES)
