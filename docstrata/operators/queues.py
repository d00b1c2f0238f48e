"""Work queues are queries: a predicate, an order and a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rank_of(value: Column, order: list[str]) -> Column:
    """Place of a value in a list; values that are not in it come last."""
    place = F.lit(len(order))
    for i, v in reversed(list(enumerate(order))):
        place = F.when(value == v, i).otherwise(place)
    return place


def next_batch(rows: DataFrame, key: str, after: int, size: int = 500) -> DataFrame:
    """Keyset pagination: the next rows by key, without an offset to count through."""
    return rows.filter(F.col(key) > after).orderBy(key).limit(size)


def budgeted(rows: DataFrame, order: list[Column], budget: int) -> tuple[DataFrame, DataFrame]:
    """(the first ``budget`` rows, one row with how many are taken and pending).

    The taken rows come from a top-k, so the queue is never sorted as a whole.
    """
    taken = rows.orderBy(*order).limit(budget)
    counts = rows.agg(F.count("*").alias("all")).select(F.least(F.col("all"), F.lit(budget).cast("long")).alias("taken"), F.greatest(F.col("all") - budget, F.lit(0).cast("long")).alias("pending"))
    return taken, counts


def never_tried_first(tried_at: Column, key: Column) -> list[Column]:
    """Order of a retry queue: nulls first, then the longest ago."""
    return [tried_at.asc_nulls_first(), key.asc()]


def missing(items: DataFrame, known: DataFrame, *keys: str) -> DataFrame:
    """Items whose keys are not known yet; null keys equal null keys."""
    named = known.select(*(F.col(k).alias(f"__k_{k}") for k in keys))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return items.join(named, same, "left_anti")


def open_days(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """Days of ``wanted`` (source, first, last) that no finished range of ``done`` covers: a backfill resumes there."""
    days = lambda r: r.filter("first <= last").select("source", F.explode(F.sequence("first", "last")).alias("day"))
    return days(wanted).distinct().join(days(done), ["source", "day"], "left_anti")


def seeded_order(key: Column, seed: str) -> Column:
    """A shuffled order that every engine reproduces: the digest of seed and key."""
    return F.sha2(F.concat(F.lit(seed), key.cast("string")), 256)


def stratified(rows: DataFrame, stratum: str, key: str, per_stratum: int, seed: str) -> DataFrame:
    """The first rows of each stratum in seeded order."""
    within = Window.partitionBy(stratum).orderBy(seeded_order(F.col(key), seed), key)
    return rows.withColumn("__n", F.row_number().over(within)).filter(F.col("__n") <= per_stratum).drop("__n")


def topped_up(rows: DataFrame, stratum: str, key: str, per_stratum: int, target: int, seed: str) -> DataFrame:
    """A stratified sample, filled up to ``target`` rows with the next ones in seeded order."""
    within = Window.partitionBy(stratum).orderBy(seeded_order(F.col(key), seed), key)
    placed = rows.withColumn("__n", F.row_number().over(within)).withColumn("__first", (F.col("__n") <= per_stratum).cast("int"))
    return placed.orderBy(F.col("__first").desc(), seeded_order(F.col(key), seed), key).limit(target).drop("__n", "__first")
