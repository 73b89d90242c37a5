"""Training-corpus pipeline over ``documents``: five stages, each one of the operators of ``wellspring.llm``.

A stage takes ``(spark, docs, sf_dir)`` and returns what stays of ``docs``; its
rows are written as Parquet and read again as the next stage's ``docs``.  All
stages but the last return the columns of ``documents``; the last adds
``copy_no``, as the mix repeats documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wellspring.llm.common import stored
from wellspring.llm.decontaminate import clean
from wellspring.llm.line_dedup import like_input, line_dedup
from wellspring.llm.minhash import keep_one
from wellspring.llm.mixing import mix
from wellspring.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least ten documents hold go from each; ``n_chars`` follows the text."""
    return like_input(line_dedup(docs), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source mix takes them, numbered in ``copy_no``."""
    return mix(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", shared_lines),
    ("minhash", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixture),
]

#: A trained classifier decides in the first stage, which SQL can't express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
