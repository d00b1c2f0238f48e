"""Coverage of regions: roll-ups, maps and bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rolled_up(rows: DataFrame, region: str, level: str, active: Column) -> DataFrame:
    """Counts by (region, level), by region and in total, in one roll-up.

    Rows without a region count in the total only. ``kind`` tells the three apart, as a null
    region is a value here.
    """
    rolled = rows.withColumn("__active", active).rollup(region, level).agg(F.count("*").alias("total"), F.count_if("__active").alias("active"), F.grouping_id().alias("__g"))
    kind = F.when(F.col("__g") == 0, "level").when(F.col("__g") == 1, "region").otherwise("total")
    return rolled.withColumn("kind", kind).filter(F.col(region).isNotNull() | (F.col("kind") == "total")).drop("__g")


def legible_counts(rows: DataFrame, region: str, unreadable: Column) -> DataFrame:
    """(region, rows, unreadable): rows without a region are a group of their own, with a null region."""
    return rows.groupBy(region).agg(F.count("*").alias("rows"), F.count_if(unreadable).alias("unreadable"))


def with_every_region(left: DataFrame, right: DataFrame, key: str, **defaults: object) -> DataFrame:
    """Full outer join on a key: regions known to either side appear; missing counts get defaults."""
    return left.join(right, key, "full").fillna(defaults)


def worst_state(rows: DataFrame, region: str, rank: Column, state: str, title: str, *order: Column | str) -> DataFrame:
    """Per region the state of the greatest rank, the first title in order, and the count."""
    return rows.groupBy(region).agg(F.max_by(state, rank).alias("worst"), F.min_by(title, F.struct(*order)).alias("first_title"), F.count("*").alias("alerts"))


#: The scope of what touches every region, and is drawn in none.
NATIONAL = "national"


def every_region(drawn: DataFrame, covered: DataFrame, alerts: DataFrame, rank: Column, state: str, title: str, *order: Column | str) -> DataFrame:
    """(region, name, known, watched, worst, first_title, alerts) of each region that any side knows.

    ``drawn`` is (region, name), ``covered`` (region, known, watched), and ``alerts`` has a list
    ``regions``. A region that is not drawn is named by its code; national and null scopes are left
    out. Null counts of a side that lacks the region are 0.
    """
    each = alerts.withColumn("region", F.explode("regions")).filter(F.col("region") != NATIONAL)
    worst = worst_state(each, "region", rank, state, title, *order)
    out = drawn.join(covered, "region", "full").join(worst, "region", "full")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("region", F.coalesce("name", "region").alias("name"), count("known"), count("watched"), "worst", "first_title", count("alerts"))


def silences(regions: DataFrame) -> DataFrame:
    """One row: regions that are watched and quiet, that nobody watches, and all of ``every_region``."""
    quiet = F.col("alerts") == 0
    return regions.agg(F.count_if(quiet & (F.col("watched") > 0)).alias("watched_and_quiet"), F.count_if(quiet & (F.col("watched") == 0)).alias("not_watched"), F.count("*").alias("regions"))


def banded(rows: DataFrame, band: Column, bands: list[str]) -> DataFrame:
    """Counts of each band, empty ones too, in their order."""
    spark = rows.sparkSession
    dim = spark.createDataFrame([(i, b) for i, b in enumerate(bands)], "place int, band string")
    counts = rows.groupBy(band.alias("band")).agg(F.count("*").alias("documents"))
    return dim.join(counts, "band", "left").select("place", "band", F.coalesce("documents", F.lit(0)).cast("long").alias("documents"))


def framework(has_first: Column, has_second: Column, verified_none: Column) -> Column:
    """both, first, second, none (verified) or null (not known)."""
    return F.when(verified_none, "none").when(has_first & has_second, "both").when(has_first, "first").when(has_second, "second")


def debt(known: Column, watched: Column) -> Column:
    return F.greatest(F.lit(0), known - watched)


#: Places of the ranking beside a map.
MOST_RANKED = 6


def ranking(regions: DataFrame, alerts: str, name: str, n: int = MOST_RANKED) -> DataFrame:
    """The ``n`` regions with the most alerts; those without any are left out.

    Equal numbers are ordered by name as Spanish does: ñ is a letter after n, accents and case
    decide between names that are otherwise equal. A null name comes last.
    """
    spanish = F.collate(F.col(name), "es")
    return regions.filter(F.col(alerts) > 0).orderBy(F.desc(alerts), spanish.asc_nulls_last()).limit(n)


def nested(levels: DataFrame, laws: DataFrame, region: str, level: str, law: str) -> DataFrame:
    """(region, levels, laws) in order of region: its levels (structs of their columns) by name, its laws in force by identifier.

    A region that only one side knows has an empty list of the other; rows without a region are left
    out. Levels and laws are those of one region.
    """
    fields = lambda rows, first: F.struct(first, *(c for c in rows.columns if c not in (region, first)))
    listed = lambda rows, first, name: rows.filter(F.col(region).isNotNull()).groupBy(region).agg(F.array_sort(F.collect_list(fields(rows, first))).alias(name))
    both = listed(levels, level, "levels").join(listed(laws, law, "laws"), region, "full")
    filled = lambda c: F.coalesce(c, F.array().cast(both.schema[c].dataType)).alias(c)
    return both.select(region, filled("levels"), filled("laws")).orderBy(region)
