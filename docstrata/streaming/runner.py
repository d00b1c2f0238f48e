"""The incremental run: whatever is new or stale goes through the stages, batch by batch."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from docstrata.operators.queues import missing
from docstrata.sinks.tables import append_missing, read_or_none


def run_available(spark: SparkSession, source: str, schema: str, folder: str, marks: str, stages: list[Callable[[DataFrame], DataFrame]], keys: list[str]) -> StreamingQuery:
    """Take all files that are new in ``source`` through ``stages`` into the table at ``folder``.

    The stream's checkpoint at ``marks`` remembers which files were done, and a batch that is
    run again after a failure adds only the rows that are missing.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        for stage in stages:
            batch = stage(batch)
        append_missing(batch, folder, keys)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", marks).trigger(availableNow=True).start()


#: Files of one batch, so that a batch's lines of the ledger are few.
FILES_A_BATCH = 1000


def run_with_ledger(spark: SparkSession, source: str, path: str, schema: str | StructType, folder: str, marks: str, stages: list[Callable[[DataFrame], DataFrame]], files_a_batch: int = FILES_A_BATCH) -> StreamingQuery:
    """Take all files that are new in ``path`` through ``stages`` into the table at ``folder``, with a ledger beside it.

    A batch's rows are written first, in a folder of its own, and then its lines of the ledger:
    source, batch, each file with its rows as they were read, and rows and digest of what was
    written. Only what the ledger names is in the table (``committed``). A run that dies in
    between leaves rows that nobody sees, and the next one writes the batch anew in their place.
    The ledger, not the stream's ``marks``, says which files are done: with the marks lost, or put
    elsewhere for a backfill, the run goes on with the files that the ledger doesn't name.
    A file is named by its path; one that is written anew under its old name is not read again. Files
    without rows leave no line. Several sources may share a folder, one run of each at a time.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            read = batch.groupBy("__file").agg(F.count("*").alias("read"))
            ledger = read_or_none(spark, f"{folder}/ledger")
            if ledger is not None:
                read = missing(read, ledger.filter(F.col("source") == source).select(F.col("file").alias("__file")), "__file")
            files = read.collect()  # at most files_a_batch
            if not files:
                return
            names = [f["__file"] for f in files]
            rows = batch.filter(F.col("__file").isin(names)).drop("__file")
            for stage in stages:
                rows = stage(rows)
            name = batch_name(source, names)
            data = f"{folder}/data/batch={name}"
            rows.write.mode("overwrite").parquet(data)
            written = contents(spark.read.parquet(data)).first()
            lines = [(source, f["__file"], f["read"], written["rows"], written["digest"]) for f in files]
            commit(spark.createDataFrame(lines, "source string, file string, read long, rows long, digest string"), f"{folder}/ledger/batch={name}")
        finally:
            batch.unpersist()

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)
    named = stream.select("*", F.col("_metadata.file_path").alias("__file"))
    return named.writeStream.foreachBatch(each).option("checkpointLocation", marks).trigger(availableNow=True).start()


def batch_name(source: str, files: list[str]) -> str:
    """A name that follows from the source and the files, whatever their order: a batch that is run again has its old name."""
    return hashlib.sha256(json.dumps([source, *sorted(files)]).encode()).hexdigest()[:32]


def commit(lines: DataFrame, folder: str) -> None:
    """The lines of one batch as one file, so that all of them are there or none."""
    lines.coalesce(1).write.mode("overwrite").parquet(folder)


def contents(rows: DataFrame, *by: str) -> DataFrame:
    """(by..., rows, digest): the number of rows, and a digest of them all that doesn't depend on their order."""
    columns = [c for c in rows.columns if c not in by]
    one = F.xxhash64(*(F.struct(F.col(f"`{c}`").isNull(), f"`{c}`") for c in columns))
    summed = F.sum(F.pmod(one, F.lit(2_147_483_647)))  # a sum, as equal rows would cancel out in an exclusive or
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), F.concat_ws(":", F.hex(F.bit_xor(one)), F.coalesce(summed, F.lit(0)).cast("string")).alias("digest"))


def committed(spark: SparkSession, folder: str, source: str | None = None) -> DataFrame | None:
    """The rows of all batches that the ledger names (of one source), with ``batch``; None before the first."""
    ledger, data = read_or_none(spark, f"{folder}/ledger"), read_or_none(spark, f"{folder}/data")
    if ledger is None or data is None:
        return None
    lines = ledger if source is None else ledger.filter(F.col("source") == source)
    return data.join(lines.select("batch").distinct(), "batch", "left_semi")


def audited(spark: SparkSession, folder: str) -> DataFrame | None:
    """(batch, state, rows, found) of every batch: verified, changed (rows or digest are not those of
    the ledger), lost (the ledger names it, no rows are there) or unseen (rows without a line); None before the first."""
    ledger, data = read_or_none(spark, f"{folder}/ledger"), read_or_none(spark, f"{folder}/data")
    if ledger is None or data is None:
        return None
    lines = ledger.groupBy("batch").agg(F.max("rows").alias("rows"), F.max("digest").alias("digest"))
    found = contents(data, "batch").select("batch", F.col("rows").alias("found"), F.col("digest").alias("found_digest"))
    state = (
        F.when(F.col("rows").isNull(), "unseen").when((F.col("rows") > 0) & F.col("found").isNull(), "lost")
        .when((F.col("rows") == F.coalesce("found", F.lit(0))) & (F.col("rows") == 0) | (F.col("rows") == F.col("found")) & (F.col("digest") == F.col("found_digest")), "verified").otherwise("changed")
    )
    return lines.join(found, "batch", "full").select("batch", state.alias("state"), "rows", "found")
