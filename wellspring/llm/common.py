"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# General helpers of the library that the operators here use by these names.
from wellspring.functions.graph import components  # noqa: F401
from wellspring.functions.joins import rekey  # noqa: F401
from wellspring.session import shared_path, stored  # noqa: F401

#: Rows of whole texts that Spark hands to a Python worker at a time.
ARROW_ROWS = 500
#: Rows of an Arrow column turned into Python objects at a time.
SLICE = 256
#: Bytes of text after which a task hands its output batch on.
OUT_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the texts that a Python worker and its JVM hold at once: Arrow batches
    of ``ARROW_ROWS`` rows, unless the session already asks for smaller ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_rows(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with their texts as bytes (null: empty)."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            yield part, [t or b"" for t in part.column(text).to_pylist()]


def id_order(doc_id: Column, text: Column) -> Column:
    """A row's identity where ids may be null or repeated: a digest of its text."""
    return F.xxhash64(F.coalesce(text, F.lit(""))).alias("th")


#: Values of one row of a partial sum.
SUM_VALUES = 8192


def partial_sum(total: np.ndarray) -> pa.RecordBatch:
    """A task's share of a sum of arrays, in rows ``(block, part, data)`` for :func:`summed`."""
    flat = np.ascontiguousarray(total).reshape(-1)
    cuts = range(0, len(flat), SUM_VALUES)
    part = TaskContext.get().partitionId()
    return pa.RecordBatch.from_arrays(
        [pa.array(range(len(cuts)), pa.int32()), pa.array([part] * len(cuts), pa.int32()),
         pa.array([flat[a:a + SUM_VALUES].tobytes() for a in cuts], pa.binary())], names=["block", "part", "data"])


def summed(parts: DataFrame, dtype) -> np.ndarray:
    """The sum over all tasks of what they gave to :func:`partial_sum`, flat, in double
    precision and in the order of the tasks, so that reruns agree.  Rows stream
    through; the driver gets the sum alone."""
    def scan(batches):
        block, total = None, None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([total.tobytes()], pa.binary())],
                                              names=["block", "data"])
        for batch in batches:
            for b, data in zip(batch.column("block").to_pylist(), batch.column("data")):
                values = np.frombuffer(data.as_buffer(), dtype)
                if b != block:
                    if block is not None:
                        yield row()
                    block, total = b, np.zeros(len(values))
                total += values
        if block is not None:
            yield row()
    got = (parts.repartition("block").sortWithinPartitions("block", "part")
           .mapInArrow(scan, "block int, data binary").toArrow())
    rows = sorted(zip(got.column("block").to_pylist(), got.column("data").to_pylist()))
    return np.concatenate([np.frombuffer(data) for _, data in rows]) if rows else np.zeros(0)


PARTIAL_DDL = "block int, part int, data binary"
