"""What the query modules share: reading tables, and SQL of functions that both engines have."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` on all cores where its files give fewer tasks than there are cores.

    A file with one row group is one task, however much work each row is. Large tables have
    more tasks than cores, and are left as they are: nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def sql_list(values: Iterable[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_normalised(text: str) -> str:
    """The same as functions.text.normalise; ñ is set aside, as strip_accents would take its tilde."""
    return f"trim(regexp_replace(replace(strip_accents(replace(lower({text}), 'ñ', chr(1))), chr(1), 'ñ'), '[^0-9a-zñ]+', ' ', 'g'))"


def sql_terms(normalised: str, terms: Iterable[str]) -> str:
    return f"list_filter({sql_list(terms)}, lambda t: contains(' ' || {normalised} || ' ', ' ' || t || ' '))"
