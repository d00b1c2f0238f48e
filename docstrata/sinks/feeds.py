"""Feeds and JSON rows, rendered as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstrata.config import SETTINGS

#: Characters that XML text must escape, & first. Fixed values.
_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))


def escaped(text: Column) -> Column:
    text = F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")
    for character, entity in _ESCAPES:
        text = F.replace(text, F.lit(character), F.lit(entity))
    return text


def stamp(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def entry(identifier: Column, title: Column, at: Column, summary: Column, host: str, prefix: str = "") -> Column:
    tag = F.concat(F.lit(f"tag:{host},"), F.date_format(at, "yyyy-MM-dd"), F.lit(":"), identifier.cast("string"))
    return F.concat(
        F.lit("<entry><id>"), escaped(tag), F.lit("</id><title>"), escaped(F.concat(F.lit(prefix), title)), F.lit("</title><updated>"), stamp(at),
        F.lit('</updated><summary type="text">'), escaped(summary), F.lit("</summary></entry>"),
    )


def atom(rows: DataFrame, title: str, host: str, prefix: str = "", now: Column | None = None, most: int = SETTINGS.feed_entries) -> DataFrame:
    """One row ``feed``: the newest entries of (id, title, at, summary), newest first.

    An empty feed is still a feed: its time is ``now``.
    """
    newest = rows.orderBy(F.desc("at"), F.desc("id")).limit(most)
    lines = newest.select("at", "id", entry(F.col("id"), F.col("title"), F.col("at"), F.col("summary"), host, prefix).alias("entry"))
    whole = lines.agg(F.max("at").alias("updated"), F.reverse(F.array_sort(F.collect_list(F.struct("at", "id", "entry")))).alias("entries"))  # ``most`` entries
    head = F.concat(F.lit(f'<?xml version="1.0" encoding="utf-8"?><feed xmlns="http://www.w3.org/2005/Atom"><title>{title}</title><id>tag:{host},2026:feed</id><updated>'), stamp(F.coalesce("updated", (now if now is not None else F.current_timestamp()).cast("timestamp_ntz"))), F.lit("</updated>"))
    return whole.select(F.concat(head, F.array_join("entries.entry", ""), F.lit("</feed>")).alias("feed"))


def json_rows(rows: DataFrame, *key: str) -> DataFrame:
    """(key, json): each row as a JSON object without null fields."""
    return rows.select(*key, F.to_json(F.struct(*rows.columns)).alias("json"))


def frequency_index(counts: DataFrame, item: str, count: str) -> DataFrame:
    """One JSON object per item, for an index file."""
    return counts.select(item, F.to_json(F.struct(F.col(item), F.col(count))).alias("json"))
