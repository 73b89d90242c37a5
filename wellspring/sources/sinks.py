"""Sinks: append writes for messages and summaries (A4, A5) and JSON row output.

Appends go to a new or existing parquet folder partitioned by day, so later
reads prune partitions by date.  Bulk changes (``operators.cascade``) are
written by the caller to a new folder and published together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def append_messages(messages: DataFrame, path: str) -> None:
    """A4: append message rows, partitioned by message date."""
    (messages.withColumn("message_date", F.to_date("timestamp"))
     .write.mode("append").partitionBy("message_date").parquet(path))


def append_summaries(summaries: DataFrame, path: str, as_of: str | None = None) -> None:
    """A5: append summary rows, partitioned by creation date.

    Rows without ``created_at`` were made at ``as_of``, one time for the whole append (default: now)."""
    now = F.localtimestamp() if as_of is None else F.to_timestamp_ntz(F.lit(as_of))
    made = F.coalesce(F.col("created_at"), now) if "created_at" in summaries.columns else now
    df = summaries.withColumn("created_at", made).withColumn("created_date", F.to_date("created_at"))
    df.write.mode("append").partitionBy("created_date").parquet(path)


def json_rows(df: DataFrame, cols: list[str], key_cols: list[str], name: str = "json") -> DataFrame:
    """One JSON object per row (``to_json(struct(..))``), nulls written as
    ``null``; timestamps and dates as ISO text (not the web date format)."""
    def iso(c: str) -> Column:
        t = df.schema[c].dataType
        if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c)
        if isinstance(t, T.DateType):
            return F.date_format(c, "yyyy-MM-dd").alias(c)
        return F.col(c)
    return df.select(*key_cols, F.to_json(F.struct(*[iso(c) for c in cols]),
                                          {"ignoreNullFields": "false"}).alias(name))
