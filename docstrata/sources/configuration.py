"""Configuration and labelled cases from JSON: strict, and checked before use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.config import MOST_LITERALS, Watched
from docstrata.functions.identifiers import valid_identifier

WATCHLIST_SCHEMA = "version string, items array<struct<identifier:string,scope:string,title:string,specific:boolean,kind:string,in_force:boolean>>"
CASE_SCHEMA = "identifier string, source string, published date, title string, expected_state string, expected_axes array<string>, sha256 string, notes string"
REPORT_SCHEMA = "identifier string, light string, summary string, recommendation string, refutation string, citations array<map<string,string>>, corroborations array<map<string,string>>"
STATES = ("relevant", "suspect", "discarded")
LIGHTS = ("alert", "look", "discard")


def watchlist(spark: SparkSession, path: str) -> tuple[str, list[Watched]]:
    """(version, entries); a missing version, bad or repeated ids, or no entries stop the load."""
    raw = spark.read.schema(WATCHLIST_SCHEMA).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    items = raw.select("version", F.inline("items"))
    faults = items.agg(F.count_if(~valid_identifier(F.col("identifier"), "watched")).alias("bad"), (F.count("*") - F.count_distinct("identifier")).alias("repeated"), F.count("*").alias("n"), F.min("version").alias("version")).first()
    if not faults["version"] or not faults["n"] or faults["n"] > MOST_LITERALS or faults["bad"] or faults["repeated"]:
        raise ValueError(f"the watchlist is not valid: {faults.asDict()}")
    rows = items.orderBy("identifier").collect()  # at most MOST_LITERALS
    return faults["version"], [Watched(r["identifier"], r["title"] or "", r["scope"] or "", bool(r["specific"]), r["in_force"] is not False, r["kind"]) for r in rows]


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Labelled cases, one file each; one bad file fails the load. ``relevant`` is derived."""
    rows = spark.read.schema(CASE_SCHEMA).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    good = F.col("identifier").isNotNull() & F.col("expected_state").isin(*STATES)
    state = F.when(good, F.col("expected_state")).otherwise(F.raise_error(F.concat(F.lit("bad case "), F.coalesce("identifier", F.lit("?")))))
    return rows.withColumn("expected_state", state).withColumn("relevant", F.col("expected_state").isin("relevant", "suspect"))


def reports(raw: DataFrame, queue: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stored reports after the import, one row of counters).

    ``raw`` has the report columns, ``queue`` (queue_id, identifier), ``stored`` (queue_id, ...).
    A report needs a known light and its three texts; one for an item that is not queued is
    counted; one for an item that has a report replaces it.
    """
    some = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    valid = F.coalesce(F.col("light").isin(*LIGHTS), F.lit(False)) & some("summary") & some("recommendation") & some("refutation")
    joined = raw.withColumn("valid", valid).join(queue.select("identifier", "queue_id"), "identifier", "left").join(stored.select("queue_id", F.lit(True).alias("had")), "queue_id", "left")
    new = joined.filter("valid and queue_id is not null")
    counters = joined.agg(
        F.count("*").alias("read"), F.count_if(F.expr("not valid")).alias("invalid"), F.count_if(F.expr("valid and queue_id is null")).alias("without_item"),
        F.count_if(F.expr("valid and queue_id is not null and had is null")).alias("created"), F.count_if(F.expr("valid and queue_id is not null and had")).alias("replaced"),
    )
    kept = stored.join(new.select("queue_id"), "queue_id", "left_anti")
    return kept.unionByName(new.select(*stored.columns)), counters
