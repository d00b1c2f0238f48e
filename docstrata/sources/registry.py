"""Sources by name: each has its reader, and all give one shape of items."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.sources import scanner, summaries

#: What every reader gives.
ITEM = ("day", "identifier", "title", "url", "good")
Reader = Callable[[DataFrame], DataFrame]


def gazette(raw: DataFrame) -> DataFrame:
    """Items at two depths; a repeated list gives each item once."""
    items = summaries.keep_first(summaries.nested_items(raw), "identifier", "section", F.col("heading").asc_nulls_first(), "title", within="day")
    return items.select("day", "identifier", "title", "url", F.lit(True).alias("good"))


def register(raw: DataFrame) -> DataFrame:
    """Flat registers; one of another day is marked."""
    return summaries.registers(raw).select("day", "identifier", "title", F.lit(None).cast("string").alias("url"), F.coalesce("good", F.lit(False)).alias("good"))


def open_data(raw: DataFrame) -> DataFrame:
    """Open-data rows; one without a control number or an address is marked."""
    return summaries.json_rows(raw).select("day", F.col("control").alias("identifier"), "title", "url", "good")


def page(raw: DataFrame) -> DataFrame:
    """Summary pages; an item without a title, or a page with too many items, is marked. The address follows from the identifier."""
    day = F.date_format("day", "yyyy/MM/dd")
    address = F.concat(F.lit("https://bocyl.jcyl.es/boletines/"), day, F.lit("/xml/"), "identifier", F.lit(".xml"))
    return scanner.page_items(raw).select("day", "identifier", "title", address.alias("url"), (F.col("state") == "good").alias("good"))


def deeds(raw: DataFrame) -> DataFrame:
    """Nested summaries that tell their day by identifiers; a summary that does not hold is marked as a whole."""
    return summaries.deeds(raw).select("day", "identifier", "title", "url", "good")


READERS: dict[str, Reader] = {"gazette": gazette, "register": register, "open_data": open_data, "page": page, "deeds": deeds}


def items(raw: DataFrame, readers: Mapping[str, Reader] = READERS) -> DataFrame:
    """(source, day, identifier, title, url, good) of all ``raw`` (source, day, content), each by its source's reader."""
    read = [reader(raw.filter(F.col("source") == name).select("day", "content")).select(F.lit(name).alias("source"), *ITEM) for name, reader in readers.items()]
    return reduce(DataFrame.unionByName, read)


def unknown(raw: DataFrame, readers: Mapping[str, Reader] = READERS) -> DataFrame:
    """Raw rows of sources without a reader, a null source too: to be looked at, not lost."""
    return raw.filter(~F.coalesce(F.col("source").isin(*readers), F.lit(False)))
