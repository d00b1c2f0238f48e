"""Mixing sources to target weights with DataFrame functions only.

Every row gets a hash-random key. Within its source the rows are ordered by that key, a
distributed prefix sum of their sizes is taken, and the source is cut at its exact budget;
budgets above the source's own size repeat it for further epochs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docstrata.llm.common import BLANKS, checkpointed, running_totals, screened, text_key, words_in

KEY_BITS = 60
#: Rows of one source whose keys are sorted together; a larger source is split by key range.
ROWS_PER_RANGE = 4_096


def random_key(doc_id: Column, seed: str) -> Column:
    """60 hash bits of the seed and the id (null id: the seed alone): equal in every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, max_epochs: int) -> DataFrame:
    """Target of each source, from (source, source_size, source_rows).

    Sources take the weights in turn by code point order, null last, and divide ``share``
    times all sizes by weight. No target passes ``max_epochs`` times the source's size: what
    is above goes to the others by weight until none is above. With the sources sorted by
    (cap / weight), the level of that fill is the largest of
    (total - caps before) / (weights from here on), so two running totals give it exactly.
    """
    named = running_totals(sizes, [F.col("source").asc_nulls_last()], position=F.lit(1))
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("position") % len(weights) + 1).cast("int")).cast("long")
    capped = named.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs)
    order = [(F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    filled = checkpointed(running_totals(capped, order, caps_before=F.col("cap"), weight_before=F.col("weight")))
    whole = filled.agg(F.coalesce(F.sum("source_size") * F.lit(share), F.lit(0.0)).alias("total"), F.sum("weight").alias("all_weight"))
    level = filled.crossJoin(F.broadcast(whole)).agg(F.max((F.col("total") - F.col("caps_before")) / (F.col("all_weight") - F.col("weight_before"))).alias("level"))  # one row each
    return filled.crossJoin(F.broadcast(level)).select("source", "source_size", "source_rows", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")).alias("target"))


def mix(rows: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2, seed: str = "mix-1") -> DataFrame:
    """``rows`` (doc_id, size, source, others) with source_size, target and ``taken``.

    ``taken`` is how much of the row the mix takes, repeats counted: ``k * size`` for k whole
    epochs, plus what the last, partial epoch takes of it. Per source it sums to the whole
    part of the target. Null sources form one source, rows of size 0 take 0, an empty table
    gives an empty result, and ties of the key are ordered by doc_id and size; rows equal in
    all three are interchangeable. Extra columns are carried, unless named as a result is.
    """
    names = [c for c in rows.columns if c not in ("doc_id", "size", "source", "source_size", "target", "taken")]
    base = rows.select("doc_id", "size", "source", F.struct(*names, F.lit(0).alias("__none")).alias("__rest"))
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    targets = source_targets(sizes, weights, share, max_epochs)
    name = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    plan = checkpointed(targets.select(name.alias("__source"), "source_size", "target", F.ceil(F.col("source_rows") / ROWS_PER_RANGE).alias("__ranges")))

    keyed = base.withColumn("__source", name).withColumn("__key", random_key(F.col("doc_id"), seed))
    keyed = keyed.join(plan, "__source").withColumn("__range", F.floor(F.col("__key") / F.lit(float(1 << KEY_BITS)) * F.col("__ranges")))
    # A window over (source, range) would run where the join left its rows: a hot source in one task.
    keyed = keyed.repartition("__source", "__range")
    ranges = keyed.groupBy("__source", "__range").agg(F.sum("size").alias("__held"))
    earlier = Window.partitionBy("__source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = checkpointed(ranges.select("__source", "__range", F.coalesce(F.sum("__held").over(earlier), F.lit(0)).alias("__offset")))
    within = Window.partitionBy("__source", "__range").orderBy("__key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("__inner", F.coalesce(F.sum("size").over(within), F.lit(0))).join(offsets, ["__source", "__range"])

    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.floor("target") - epochs * F.col("source_size") - F.col("__offset") - F.col("__inner")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return placed.select("doc_id", "size", "source", "source_size", "target", taken.cast("long").alias("taken"), *(F.col("__rest")[n].alias(n) for n in names))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    narrow = checkpointed(docs.select("doc_id", words_in(F.col("text")).alias("size"), "source"))
    return mix(narrow).select("doc_id", "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents themselves, with the columns of ``docs``.

    A row is repeated for each epoch that takes all of it. Where a source's budget ends
    inside a document, a cut copy holds its first words, joined by one space, with n_chars
    (if there) to match. Documents without words take no budget: each stays once. The mix is
    decided on ids and sizes; texts are moved once, to meet their decision. Rows that share
    id, text and source are decided together, as they are interchangeable.
    """
    row = docs.select(F.struct(*docs.columns).alias("doc"))
    ids = row.select(F.col("doc.doc_id").alias("doc_id"), words_in(F.col("doc.text")).alias("size"), F.col("doc.source").alias("source"), text_key(F.col("doc.text")).alias("key"))
    decided = mix(checkpointed(ids), **options)
    whole = F.when(F.col("size") > 0, F.expr("div(taken, size)")).otherwise(F.lit(1))
    part = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(F.lit(0))  # of one row of a source at most
    plan = checkpointed(
        decided.groupBy("doc_id", "key", "source", "size")
        .agg(F.count("*").alias("rows"), F.sum(whole).cast("int").alias("whole"), F.sum(part).alias("part"))
        .withColumnsRenamed({"doc_id": "p_id", "key": "p_key", "source": "p_source", "size": "p_size"})
    )
    keyed = row.withColumn("key", text_key(F.col("doc.text")))
    marked = screened(keyed, F.col("key"), plan.filter("rows > 1").select(F.col("p_key").alias("key")))
    several = marked.filter("__hit").groupBy(F.col("doc.doc_id").alias("i"), "key", F.col("doc.source").alias("s")).agg(F.first("doc").alias("doc"))
    single = marked.filter("not __hit").select("doc", "key").union(several.select("doc", "key"))
    copies = F.concat(F.array_repeat("p_size", F.col("whole")), F.when(F.col("part") > 0, F.array("part")).otherwise(F.expr("array()").cast("array<bigint>")))
    same = F.col("doc.doc_id").eqNullSafe(F.col("p_id")) & (F.col("key") == F.col("p_key")) & F.col("doc.source").eqNullSafe(F.col("p_source"))
    out = single.join(plan, same).select("doc", F.col("p_size").alias("size"), F.explode(copies).alias("words"))
    cut = F.array_join(F.slice(F.filter(F.split(F.col("doc.text"), f"[{BLANKS}]+"), lambda w: w != ""), 1, F.col("words").cast("int")), " ")
    full = F.col("words") == F.col("size")
    new = out.select("doc", full.alias("full"), F.when(full, F.col("doc.text")).otherwise(cut).alias("text"))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("full"), F.col("doc.n_chars")).otherwise(F.length("text"))
    return new.select(*(changed.get(c, F.col("doc")[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 2 * source_size AS cap, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS BIGINT) AS weight FROM s),
f AS (SELECT *, coalesce(sum(cap) OVER o, 0) AS caps_before, coalesce(sum(weight) OVER o, 0) AS weight_before FROM w
      WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max((CAST(t AS DOUBLE) * 1.5::DOUBLE - CAST(caps_before AS DOUBLE)) / CAST(a - weight_before AS DOUBLE)) AS level
      FROM f, (SELECT sum(source_size) AS t, sum(weight) AS a FROM w)),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), weight * level) AS target FROM f, l),
p AS (SELECT d.*, source_size, target,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, floor(target) - epochs * source_size - before)) AS BIGINT) AS taken
FROM p"""
