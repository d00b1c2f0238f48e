"""The human gate: what is queued, what was decided, what may be published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docstrata.functions.text import cut_with_flag

WAITING, APPROVED, REJECTED = "waiting", "approved", "rejected"
MOST_NOTE = 2_000


def visible_sign(human: Column, rule: Column) -> Column:
    """A reviewer's sign where there is one, else the rule's. Null human is no sign, not neutral."""
    return F.coalesce(human, rule)


def may_enter(rule: Column, watched: Column, organs: Column) -> Column:
    """Only what a rule fired on, and that names a watched item or an organ, reaches a reviewer."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return rule.isNotNull() & ((size(watched) > 0) | (size(organs) > 0))


def enqueue(detections: DataFrame, queue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new queue rows, counters): detections without a queue row enter; those with one are counted."""
    both = detections.join(queue.select("detection_id", F.lit(True).alias("queued")).distinct(), "detection_id", "left").withColumn("queued", F.coalesce("queued", F.lit(False)))
    new = both.filter("not queued and admitted").select("detection_id", F.lit(WAITING).alias("state"))
    counters = both.agg(
        F.count("*").alias("seen"), F.count_if("queued").alias("already_queued"), F.count_if(F.expr("not queued and admitted")).alias("entered"), F.count_if(F.expr("not queued and not admitted")).alias("kept_out")
    )
    return new, counters


def decide(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """``queue`` (id, state, note, sign) after ``decisions`` (id, to, note, sign).

    Only waiting items change, so a decision can't be reopened or repeated. A decision to another
    state, or with a note over ``MOST_NOTE`` characters, is refused; of several for one item the
    first in the order of their values counts. The sign of a reviewer is set once: a later null
    or other sign leaves it.
    """
    fit = F.col("to").isin(APPROVED, REJECTED) & (F.length(F.coalesce("note", F.lit(""))) <= MOST_NOTE)
    d = decisions.filter(fit).groupBy("id").agg(F.min(F.struct("to", "note", "sign")).alias("d")).select("id", F.col("d.to").alias("d_to"), F.col("d.note").alias("d_note"), F.col("d.sign").alias("d_sign"))
    joined = queue.join(d, "id", "left")
    acts = (F.col("state") == WAITING) & F.col("d_to").isNotNull()
    return joined.select(
        "id",
        F.when(acts, F.col("d_to")).otherwise(F.col("state")).alias("state"),
        F.when(acts, F.col("d_note")).otherwise(F.col("note")).alias("note"),
        F.when(acts & F.col("sign").isNull(), F.col("d_sign")).otherwise(F.col("sign")).alias("sign"),
    )


def findings(reports: DataFrame, queue: DataFrame, alerts: DataFrame) -> DataFrame:
    """Reports that call for an alert, have corroborations, and were not published."""
    urgent = reports.filter((F.col("light") == "alert") & (F.size("corroborations") > 0))
    return urgent.join(queue, "queue_id").join(alerts.select("detection_id"), "detection_id", "left_anti")


def page(rows: DataFrame, order: list[Column], limit: int = 20, offset: int = 0, **wanted: object) -> DataFrame:
    """A page of an ordered result; 1 to 100 rows, from an offset of 0 or more.

    ``wanted`` holds optional filters, column=value; those that are None filter nothing.
    """
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("a page has 1 to 100 rows, and an offset of 0 or more")
    for column, value in wanted.items():
        rows = rows if value is None else rows.filter(F.col(column) == F.lit(value))
    return rows.orderBy(*order).offset(offset).limit(limit)


def first_per_group(rows: DataFrame, group: str, order: list[Column], n: int = 1) -> DataFrame:
    """The first rows of each group; row_number over the group, cut while it is ranked."""
    ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.filter(F.col("__n") <= n).drop("__n")


def public_alert(rows: DataFrame, most: int = 700) -> DataFrame:
    """What the public sees of an alert: the visible sign, whole spans only, a cut text that says so.

    ``rows`` has id, day, title, sign, human_sign, text, spans (array of start, finish, fragment).
    """
    whole = F.filter("spans", lambda s: s["start"].isNotNull() & s["finish"].isNotNull() & s["fragment"].isNotNull())
    shown = cut_with_flag(F.col("text"), most)
    empty = F.array().cast("array<struct<start:int,finish:int,fragment:string>>")
    return rows.select("id", "day", F.coalesce("title", F.lit("")).alias("title"), visible_sign(F.col("human_sign"), F.col("sign")).alias("sign"), shown["text"].alias("text"), shown["cut"].alias("cut"), F.coalesce(whole, empty).alias("spans"))


def public_finding(rows: DataFrame) -> DataFrame:
    """What the public sees of a finding: by the rule's own sign, without light and recommendation."""
    return rows.select("id", "day", "title", "sign", "summary", "refutation", "citations")
