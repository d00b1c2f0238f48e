"""Measurements over corpora: frequencies, percentiles, breakdowns, agreement with labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docstrata.lineage import cut


def nearest_rank(rows: DataFrame, value: str, q: float, *by: str) -> DataFrame:
    """The value at place min(int(q n), n - 1) of each group's sorted values.

    This is not percentile_disc. Only the values near the place are ordered, with or without
    groups, however large a group is.
    """
    if not by:
        return _nearest_rank_of_all(rows.filter(F.col(value).isNotNull()), value, q)
    return at_place(rows, value, lambda n: F.least(F.floor(F.lit(q) * n), n - 1), *by).withColumnRenamed("at_place", "at_rank")


def grouped_median(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """The median of each group: its middle value, or the mean of the two. Groups of nothing but nulls are left out."""
    low = at_place(rows, value, lambda n: F.floor((n - 1) / 2), *by).withColumnRenamed("at_place", "__low")
    high = at_place(rows, value, lambda n: F.floor(n / 2), *by).withColumnRenamed("at_place", "__high")
    same = F.lit(True)  # a null is a group
    for c in by:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"h.{c}"))
    return low.alias("l").join(high.alias("h"), same).select(*(F.col(f"l.{c}").alias(c) for c in by), ((F.col("__low") + F.col("__high")) / 2).alias("median"))


#: So many different values of one group may be ordered in one task.
MOST_ORDERED = 100_000


def at_place(rows: DataFrame, value: str, place: Callable[[Column], Column], *by: str, most: int = MOST_ORDERED) -> DataFrame:
    """(by..., at_place): of each group's sorted values the one at a place, counted from 0, of its number of values.

    Selection by ranges: every round, quantiles of each group's range with a known error bound
    the place, the values below are counted, and only those between go on, until no group has
    more than ``most`` different ones. Then these few are ordered. Counts are exact throughout,
    so a quantile that misses costs a round, not the result. Nulls have no place; NaN is the largest.
    """
    keys = [F.col(c).alias(f"__k{i}") for i, c in enumerate(by)]
    names = [f"__k{i}" for i in range(len(by))]
    some = rows.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    ends = some.groupBy(*names).agg(F.count("*").alias("__n"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
    ends = ends.select(*names, place(F.col("__n")).cast("long").alias("__at"), "__low", "__high", F.lit(0).cast("long").alias("__below"))

    def within(bounds: DataFrame) -> DataFrame:
        b = bounds.select(*(F.col(c).alias(f"__b{c}") for c in names), F.col("__low").alias("__blow"), F.col("__high").alias("__bhigh"), F.col("__at").alias("__bat"), F.col("__below").alias("__bbelow"))
        near = F.lit(True)
        for c in names:
            near = near & F.col(c).eqNullSafe(F.col(f"__b{c}"))
        return some.join(b, near).filter((F.col("__v") >= F.col("__blow")) & (F.col("__v") <= F.col("__bhigh")))

    before = None
    while True:
        inside = within(ends)
        many = inside.groupBy(*names).agg(F.approx_count_distinct("__v").alias("m")).agg(F.max("m")).first()[0] or 0
        if many <= most or before is not None and many >= before:
            break
        before = many
        left = (F.col("__bat") - F.col("__bbelow")).cast("double")
        sized = inside.groupBy(*names, "__bat", "__bbelow").agg(F.count("*").alias("__m"), F.percentile_approx("__v", F.array(*(F.lit(i / PIECES) for i in range(PIECES + 1))), F.lit(PIECES * 10)).alias("__cuts"))
        share = left / F.col("__m")
        i = lambda x: F.element_at("__cuts", (x + 1).cast("int"))
        pieces = sized.select(*names, "__bat", "__bbelow", i(F.greatest(F.lit(0), F.floor(share * PIECES) - 1)).alias("__c0"), i(F.least(F.lit(PIECES), F.ceil(share * PIECES) + 1)).alias("__c1"))
        new = pieces.select(*names, F.col("__bat").alias("__at"), F.col("__c0").alias("__low"), F.col("__c1").alias("__high"), F.col("__bbelow").alias("__old"))
        old = inside.alias("o").join(new.alias("n"), _named_same(names))
        counted = old.groupBy(*(F.col(f"n.{c}").alias(c) for c in names), "n.__at", "n.__low", "n.__high", "n.__old", "o.__blow", "o.__bhigh").agg(
            F.count_if(F.col("o.__v") < F.col("n.__low")).alias("__less"), F.count_if(F.col("o.__v") <= F.col("n.__high")).alias("__upto")
        )
        sure = (F.col("__old") + F.col("__less") <= F.col("__at")) & (F.col("__at") < F.col("__old") + F.col("__upto"))
        ends = cut(counted.select(
            *names, "__at", F.when(sure, F.col("__low")).otherwise(F.col("__blow")).alias("__low"), F.when(sure, F.col("__high")).otherwise(F.col("__bhigh")).alias("__high"),
            (F.col("__old") + F.when(sure, F.col("__less")).otherwise(0)).alias("__below"),
        ))  # a row for each group
    few = within(ends).groupBy(*names, "__v", "__bat", "__bbelow").agg(F.count("*").alias("__c"))
    up_to = Window.partitionBy(*names).orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = few.withColumn("__upto", F.sum("__c").over(up_to) + F.col("__bbelow")).filter(F.col("__upto") > F.col("__bat"))
    return placed.groupBy(*names).agg(F.min("__v").alias("at_place")).select(*(F.col(n).alias(c) for n, c in zip(names, by, strict=True)), "at_place")


#: Pieces that a round cuts a group's range into; it leaves a few of them, and the last round is one that leaves as many values.
PIECES = 256


def _named_same(names: list[str]) -> Column:
    out = F.lit(True)
    for c in names:
        out = out & F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    return out


#: Error of the quantiles that bound the values to be ordered.
_QUANTILE_ERROR = 1e-3


def _nearest_rank_of_all(rows: DataFrame, value: str, q: float) -> DataFrame:
    wide = [max(0.0, q - 3 * _QUANTILE_ERROR), min(1.0, q + 3 * _QUANTILE_ERROR)]
    low, high = rows.approxQuantile(value, wide, _QUANTILE_ERROR) or (None, None)
    sizes = rows.agg(F.count("*").alias("__n"), F.count_if(F.col(value) < F.lit(low)).alias("__below"))
    near = rows.filter(F.col(value).between(F.lit(low), F.lit(high))).groupBy(value).agg(F.count("*").alias("__c"))
    up_to = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # of the few values near the place
    placed = near.withColumn("__upto", F.sum("__c").over(up_to)).crossJoin(F.broadcast(sizes))  # one row of sizes
    place = F.least(F.floor(F.lit(q) * F.col("__n")), F.col("__n") - 1)
    return placed.filter(F.col("__upto") + F.col("__below") > place).agg(F.min(value).alias("at_rank"))


def document_frequency(rows: DataFrame, document: str, item: str, note: str | None = None, order: str | None = None) -> DataFrame:
    """(item, documents, note): in how many documents an item occurs, with its first note."""
    pairs = rows.filter(F.col(item).isNotNull()).groupBy(document, item).agg(*([F.min_by(note, order).alias("__note"), F.min(order).alias("__at")] if note else [F.lit(1).alias("__at")]))
    return pairs.groupBy(item).agg(F.count("*").alias("documents"), *([F.min_by("__note", "__at").alias(note)] if note else []))


def most_common(counts: DataFrame, item: str, n: int) -> DataFrame:
    """Top k by count; ties go to the smaller item."""
    return counts.orderBy(F.desc("documents"), item).limit(n)


def confusion(rows: DataFrame, expected: Column, found: Column, *by: str) -> DataFrame:
    """Counts of agreement between two booleans, with precision and recall."""
    e, f = expected, found
    counts = rows.groupBy(*by).agg(F.count("*").alias("cases"), F.count_if(e & f).alias("agreed"), F.count_if(~e & f).alias("only_found"), F.count_if(e & ~f).alias("only_expected"), F.count_if(~e & ~f).alias("neither"))
    ratio = lambda a, b: F.round(F.try_divide(F.col(a), F.col(a) + F.col(b)), 4)
    return counts.withColumn("precision", ratio("agreed", "only_found")).withColumn("recall", ratio("agreed", "only_expected"))


def breakdown(rows: DataFrame, **criteria: Column) -> DataFrame:
    """How many rows meet each criterion, any of them, and none; criteria may overlap."""
    any_of = F.lit(False)
    for c in criteria.values():
        any_of = any_of | c
    return rows.agg(*(F.count_if(c).alias(k) for k, c in criteria.items()), F.count_if(any_of).alias("any"), F.count_if(~any_of).alias("none"))


#: Distances are counted one by one up to here.
MOST_DISTANCE = 100_000


def criteria_distances(rows: DataFrame, distance: str, holds: Column, within: int, most: int = MOST_DISTANCE, **criteria: Column) -> DataFrame:
    """One row: how many rows each criterion rejects, how many hold, and the distances of all.

    Criteria may overlap; a null one rejects nothing. What they leave must be what the
    rule in use leaves: a row for which ``holds`` is not the opposite of "any criterion" stops the
    query, as the breakdown would measure something else. Distances are whole numbers from 0
    to ``most`` (another one stops the query too); a row without a distance counts in the criteria
    alone. Columns: rows, each criterion, hold, within (a distance of at most ``within``), nearest,
    median (exact, the lower whole number between two), farthest; without rows zeros and nulls.

    One pass counts by distance; what is left has at most ``most`` + 2 rows.
    """
    any_of = F.lit(False)
    for c in criteria.values():
        any_of = any_of | F.coalesce(c, F.lit(False))
    same = F.when(F.coalesce(holds, F.lit(False)) != any_of, F.coalesce(holds, F.lit(False))).otherwise(F.raise_error(F.lit("the criteria and the rule in use differ")).cast("boolean"))
    value = F.col(distance).cast("long")
    place = F.when(value.isNull() | (value.between(0, most) & (value == F.col(distance))), value).otherwise(F.raise_error(F.lit("a distance is out of bounds")).cast("long"))
    counts = {k: F.count_if(c) for k, c in criteria.items()}
    by_distance = rows.groupBy(place.alias("__d")).agg(F.count("*").alias("__n"), F.count_if(same).alias("__hold"), *(c.alias(f"__c_{k}") for k, c in counts.items()))
    upto = Window.orderBy(F.col("__d").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # of the few distances
    known = F.when(F.col("__d").isNotNull(), F.col("__n"))
    placed = by_distance.withColumns({"__upto": F.sum(known).over(upto), "__all": F.sum(known).over(Window.partitionBy())})
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    low, high = (F.min(F.when(F.col("__upto") > F.floor((F.col("__all") - less) / 2), F.col("__d"))) for less in (1, 0))
    return placed.agg(
        total("__n").alias("rows"), *(total(f"__c_{k}").alias(k) for k in criteria), total("__hold").alias("hold"), total(F.when(F.col("__d") <= within, F.col("__n"))).alias("within"),
        F.min("__d").alias("nearest"), F.floor((low + high) / 2).alias("median"), F.max("__d").alias("farthest"),
    )


def share(part: Column, whole: Column, places: int = 4) -> Column:
    """Rounded ratio; null for an empty whole."""
    return F.round(F.try_divide(part, whole), places)
