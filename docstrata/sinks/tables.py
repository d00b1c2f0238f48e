"""Idempotent writes: content-addressed, insert-if-absent, keyed, append-only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.functions.identifiers import storage_path
from docstrata.operators.queues import missing


def addressed(docs: DataFrame, content: str, ending: str) -> DataFrame:
    """One row for each distinct content: (sha256, path, content)."""
    digest = docs.select(F.sha2(F.col(content).cast("binary"), 256).alias("sha256"), F.col(content).cast("binary").alias("content"))
    return digest.dropDuplicates(["sha256"]).select("sha256", storage_path(F.col("sha256"), ending).alias("path"), "content")


def archive(docs: DataFrame, content: str, ending: str, folder: str) -> None:
    """Add the contents that the archive table lacks, dealt by the first byte of their digest."""
    rows = addressed(docs, content, ending).withColumn("shard", F.substring("sha256", 1, 2))
    append_missing(rows, folder, ["sha256"], partition_by=["shard"])


def integrity(archived: DataFrame) -> DataFrame:
    """(path, state): verified where the name promises the content's digest, else corrupt."""
    promised = F.regexp_extract("path", r"([0-9a-f]{64})", 1)
    return archived.select("path", F.when(F.sha2("content", 256) == promised, "verified").otherwise("corrupt").alias("state"))


def append_missing(rows: DataFrame, folder: str, keys: list[str], partition_by: list[str] | None = None) -> None:
    """Append the rows whose keys are new; what is there is never changed. Safe to repeat."""
    spark = rows.sparkSession
    known = read_or_none(spark, folder)
    new = rows.dropDuplicates(keys) if known is None else missing(rows.dropDuplicates(keys), known, *keys)
    new.write.mode("append").partitionBy(*(partition_by or [])).parquet(folder)


def merged(stored: DataFrame, changes: DataFrame, *keys: str) -> DataFrame:
    """``stored`` with the rows of ``changes`` in place of those with their keys."""
    return missing(stored, changes, *keys).unionByName(changes)


def read_or_none(spark: SparkSession, folder: str) -> DataFrame | None:
    """The table in a folder, or None where there is none yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.parquet(folder)


def by_version(stored: DataFrame, is_stale: Callable[[], object], compute: Callable[[DataFrame], DataFrame], *keys: str) -> DataFrame:
    """Recompute only the stale rows and put them in place of the old ones."""
    return merged(stored, compute(stored.filter(is_stale())), *keys)
