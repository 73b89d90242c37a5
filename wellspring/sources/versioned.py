"""Partitioned tables in versions: a change rewrites the partitions that it touches.

A version's rows go to ``data/v=<version>/<partition>=<value>``; the manifest
``manifest/v=<version>`` names, per partition, the version that is live.  A
manifest counts once its ``_SUCCESS`` file stands, which the writer makes last,
so readers see all of a change or nothing, and a version written again from the
same input replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rewrite_partitions(path: str, part: str, version: int, change: DataFrame, apply: Callable[[DataFrame], DataFrame],
                       schema: T.StructType, keep: int = 2) -> None:
    """Rewrite the partitions that ``change`` has rows of: ``apply`` takes their live
    rows (of ``schema``) and returns those that replace them.  Folders that none of the last
    ``keep`` manifests names are deleted."""
    spark = change.sparkSession
    touched = [r[0] for r in change.select(part).distinct().collect()]  # one value a partition
    if not touched:
        return
    live = _manifest(spark, path, before=version)
    hit = F.col(part).isin([v for v in touched if v is not None]) | (F.col(part).isNull() if None in touched else F.lit(False))
    apply(_live_rows(spark, path, live, schema, part).filter(hit)).write.mode("overwrite").partitionBy(part).parquet(f"{path}/data/v={version}")
    # A partition that lost all its rows has no folder any more.
    names = {_folder(part, v) for v in touched}
    live = {name: v for name, v in live.items() if name not in names}
    live |= {name: version for name in _names(spark, f"{path}/data/v={version}/{part}=*")}
    rows = spark.createDataFrame(sorted(live.items()), "partition string, version bigint")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/v={version}")
    _prune(spark, path, keep)


def next_version(spark: SparkSession, path: str) -> int:
    return max(complete_versions(spark, f"{path}/manifest"), default=-1) + 1


def _folder(part: str, value) -> str:
    """The name of a partition's folder, for values of letters, digits, ``-`` and ``_``."""
    return f"{part}={'__HIVE_DEFAULT_PARTITION__' if value is None else value}"


def latest_snapshot(spark: SparkSession, path: str, schema: T.StructType, partition: str) -> DataFrame:
    """The live rows of a table that :func:`rewrite_partitions` keeps."""
    return _live_rows(spark, path, _manifest(spark, path), schema, partition)


def _manifest(spark: SparkSession, path: str, before: int | None = None) -> dict[str, int]:
    """The live version of each partition's folder (by the newest manifest, or the newest older than ``before``)."""
    done = [v for v in complete_versions(spark, f"{path}/manifest") if before is None or v < before]
    return _read_manifest(spark, path, max(done)) if done else {}


def _read_manifest(spark: SparkSession, path: str, version: int) -> dict[str, int]:
    return {r["partition"]: r["version"] for r in spark.read.parquet(f"{path}/manifest/v={version}").collect()}


def _live_rows(spark: SparkSession, path: str, live: dict[str, int], schema: T.StructType, part: str) -> DataFrame:
    rows = None
    for version in sorted(set(live.values())):
        base = f"{path}/data/v={version}"
        folders = [f"{base}/{name}" for name, v in sorted(live.items()) if v == version]
        # The schema is given, so that a partition's name isn't taken for a number.
        more = spark.read.schema(schema).option("basePath", base).parquet(*folders).select(*schema.fieldNames())
        rows = more if rows is None else rows.unionByName(more)
    return spark.createDataFrame([], schema) if rows is None else rows


def _prune(spark: SparkSession, path: str, keep: int) -> None:
    """Delete manifests older than the last ``keep`` and the folders that no manifest left names."""
    versions = sorted(complete_versions(spark, f"{path}/manifest"))
    named = {(v, name) for m in versions[-keep:] for name, v in _read_manifest(spark, path, m).items()}
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def delete(folder: str) -> None:
        target = jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(conf).delete(target, True)
    for m in versions[:-keep]:
        delete(f"{path}/manifest/v={m}")
    for version in _names(spark, f"{path}/data/v=*"):
        v = int(version.removeprefix("v="))
        for name in _names(spark, f"{path}/data/{version}/*=*"):
            if v <= versions[-1] and (v, name) not in named:
                delete(f"{path}/data/{version}/{name}")


def _names(spark: SparkSession, pattern: str) -> list[str]:
    """Names of the files and folders that a pattern finds."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    status = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(found)
    return [f.getPath().getName() for f in status or []]


def complete_versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions whose write ended (one small file name each)."""
    done = [v for v in _names(spark, f"{path}/v=*") if _names(spark, f"{path}/{v}/_SUCCESS")]
    return [int(v.removeprefix("v=")) for v in done]
