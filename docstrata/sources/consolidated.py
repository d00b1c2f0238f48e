"""Consolidated texts: every block with all its versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.functions.dates import compact_date
from docstrata.sources.summaries import safe_xml

SCHEMA = (
    "status struct<code:string>, data struct<texto:struct<bloque:array<struct<_id:string,_tipo:string,_titulo:string,"
    "version:array<struct<_id_norma:string,_fecha_vigencia:string,p:array<struct<_class:string,_VALUE:string>>>>>>>>"
)
EDITORIAL, FOOTNOTE = "nota_inicial", "nota_pie"


def block_versions(raw: DataFrame) -> DataFrame:
    """(key, block, title, place, modifier, in_force, text) of (key, content).

    Editorial blocks, versions that name no modifier, and footnotes are left out; a bad date
    is null. Quotations in blockquotes are not part of the schema, and so not of the text.
    """
    parsed = raw.select("key", F.from_xml(safe_xml(F.col("content")), SCHEMA)["data"]["texto"]["bloque"].alias("blocks"))
    blocks = parsed.select("key", F.explode(F.filter("blocks", lambda b: F.coalesce(b["_tipo"] != EDITORIAL, F.lit(True)))).alias("b"))
    named = F.filter("b.version", lambda v: F.coalesce(v["_id_norma"] != "", F.lit(False)))
    each = blocks.select("key", F.col("b._id").alias("block"), F.col("b._titulo").alias("title"), F.posexplode(named).alias("place", "v"))
    kept = F.filter("v.p", lambda p: F.coalesce(p["_class"] != FOOTNOTE, F.lit(True)))
    text = F.array_join(F.filter(F.transform(kept, lambda p: F.trim(p["_VALUE"])), lambda t: t != ""), " ")
    return each.select("key", "block", "title", "place", F.col("v._id_norma").alias("modifier"), compact_date(F.col("v._fecha_vigencia")).alias("in_force"), F.nullif(text, F.lit("")).alias("text"))
