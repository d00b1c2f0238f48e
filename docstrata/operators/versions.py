"""Version chains: what a block said before and after each change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def chain(versions: DataFrame, key: str, order: list[Column | str], text: str, *carry: str) -> DataFrame:
    """``versions`` with previous_text and ordinal within each ``key``.

    The first version has no previous text: it is an insertion. Narrow windows over one
    chain; ``carry`` columns of the previous version come along as previous_<name>.
    """
    within = Window.partitionBy(key).orderBy(*order)
    empty = lambda c: F.nullif(F.col(c), F.lit(""))
    out = versions.withColumn("previous_text", F.lag(empty(text)).over(within)).withColumn("ordinal", F.row_number().over(within))
    for c in carry:
        out = out.withColumn(f"previous_{c}", F.lag(c).over(within))
    return out


def changes_by(chained: DataFrame, modifier: str) -> DataFrame:
    """Of each modifier's versions of a block, the last: what it changed there."""
    last = Window.partitionBy("block", modifier).orderBy(F.col("ordinal").desc())
    return chained.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n")


def change_kind(before: Column, after: Column) -> Column:
    """insertion, repeal, change, or pointer where both texts are missing; "" is missing."""
    a, b = F.nullif(before, F.lit("")), F.nullif(after, F.lit(""))
    return F.when(a.isNull() & b.isNull(), "pointer").when(a.isNull(), "insertion").when(b.isNull(), "repeal").otherwise("change")


def changes_as_of(alerts: DataFrame, changes: DataFrame, on: str, made: str, cut: str) -> DataFrame:
    """Alerts with the changes made up to their cut; a null cut takes all.

    The equality on ``on`` is what is shuffled, the inequality is checked in the join.
    """
    a, c = alerts.alias("a"), changes.alias("c")
    known = F.col(f"a.{cut}").isNull() | (F.col(f"c.{made}") <= F.col(f"a.{cut}"))
    return a.join(c, (F.col(f"a.{on}") == F.col(f"c.{on}")) & known).select("a.*", *(F.col(f"c.{x}") for x in changes.columns if x != on))


def latest_as_of(events: DataFrame, states: DataFrame, on: str, at: str, since: str) -> DataFrame:
    """Each event with the latest state not after it (null columns without one).

    Both are merged into one sequence per key and the last state is carried forward, so a
    key's pairs are never formed: one shuffle by key, one pass.
    """
    held = [c for c in states.columns if c not in (on,)]
    marks = states.select(on, F.col(since).alias("__at"), F.lit(0).alias("__kind"), F.struct(*held).alias("__state"), F.lit(None).cast(events.select(F.struct("*").alias("e")).schema["e"].dataType).alias("__event"))
    asked = events.select(on, F.col(at).alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast(marks.schema["__state"].dataType).alias("__state"), F.struct("*").alias("__event"))
    ties = F.to_json("__state")  # states of one moment: the greatest counts, whatever the order of the rows
    so_far = Window.partitionBy(on).orderBy("__at", "__kind", ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = marks.union(asked).withColumn("__last", F.last("__state", ignorenulls=True).over(so_far))
    return merged.filter("__kind = 1").select("__event.*", *(F.col(f"__last.{c}").alias(f"state_{c}") for c in held))


def carried_forward(rows: DataFrame, header: Column, order: list[Column | str], *within: Column | str) -> Column:
    """The last header at or before each row, reset where ``within`` changes."""
    return F.last(header, ignorenulls=True).over(Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def consumed_once(header: Column, order: list[Column | str], *within: Column | str) -> Column:
    """The header of the row just before: a title is used up by the first item after it."""
    return F.lag(header).over(Window.partitionBy(*within).orderBy(*order))
