"""JSON request-log source (A7): chat request bodies parsed with an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHAT_REQUEST = T.StructType([
    T.StructField("messages", T.ArrayType(T.StructType([
        T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))),
    T.StructField("session_name", T.StringType()),
    T.StructField("session_type", T.StringType()),
])


def parse_chat_requests(bodies: DataFrame, body_col: str = "body") -> DataFrame:
    """Parse ``body`` with ``from_json`` (permissive): malformed bodies keep their
    row with ``parsed = false`` and null fields, so the required-field check
    (Q3) reports them instead of dropping them.  Adds ``user_input`` = the last
    message's content (I15)."""
    # PERMISSIVE parsing keeps malformed text in a corrupt-record field; a
    # body is parsed when that field is empty.
    schema = T.StructType(CHAT_REQUEST.fields + [T.StructField("_corrupt", T.StringType())])
    p = F.from_json(F.col(body_col), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    out = bodies.withColumn("_p", p)
    return out.select(
        *[c for c in bodies.columns if c != body_col],
        (F.col(body_col).isNotNull() & F.col("_p._corrupt").isNull()).alias("parsed"),
        F.coalesce(F.col("_p.messages"), F.array().cast(CHAT_REQUEST["messages"].dataType)).alias("messages"),
        F.col("_p.session_name").alias("session_name"),
        F.col("_p.session_type").alias("session_type"),
        F.try_element_at(F.col("_p.messages"), F.lit(-1))["content"].alias("user_input"))
