"""Windows over event time, the same for batches and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _late(rows: DataFrame, at: str, lateness: str | None) -> DataFrame:
    return rows.withWatermark(at, lateness) if lateness else rows


def tumbling(rows: DataFrame, at: str, size: str, *by: str, lateness: str | None = None, **totals: Column) -> DataFrame:
    """Aggregates of each window; with ``lateness`` a stream drops what comes later than that."""
    grouped = _late(rows, at, lateness).groupBy(F.window(at, size), *by).agg(*(v.alias(k) for k, v in totals.items()))
    return grouped.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, *totals)


def sliding(rows: DataFrame, at: str, size: str, step: str, *by: str, lateness: str | None = None, **totals: Column) -> DataFrame:
    grouped = _late(rows, at, lateness).groupBy(F.window(at, size, step), *by).agg(*(v.alias(k) for k, v in totals.items()))
    return grouped.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, *totals)


def sessions(rows: DataFrame, at: str, gap: str, *by: str, lateness: str | None = None, **totals: Column) -> DataFrame:
    """A session ends ``gap`` after its last event."""
    grouped = _late(rows, at, lateness).groupBy(F.session_window(at, gap), *by).agg(*(v.alias(k) for k, v in totals.items()))
    return grouped.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *by, *totals)


def recent_count(by: str, at: str, seconds: int) -> Column:
    """How many of a key's rows lie within the last ``seconds``, this one included."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    return F.count("*").over(Window.partitionBy(by).orderBy(micros).rangeBetween(-seconds * 1_000_000, 0))
