"""Chat formatting: cumulative snapshots collapse into the longest conversation, then render.

Loggers write a conversation again after every turn, so many logged conversations are
prefixes of longer ones. Every turn gets a rolling hash of the turns up to it; a conversation
whose last hash is also found before the end of another one is a snapshot, and an anti-join
on (length, hash) removes it. Only maximal conversations are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docstrata.llm.common import checkpointed

#: Turns that are ordered together, and turns that one rendered part holds: they bound a
#: task's memory where one conversation holds a large share of all rows.
TURNS_PER_RANGE = 1024
TURNS_PER_PART = 256
OPEN, CLOSE = "<|", "|>"
END = "<|end|>"


def _name(conv_id: Column) -> Column:
    """Key of a conversation that is never null; a null id is a conversation like any other."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def _turn_hash(seed: int) -> Column:
    """Hash of a turn at its place; null and empty differ."""
    role, text = F.col("role"), F.col("text")
    return F.xxhash64(F.lit(seed), "place", role.isNull(), F.coalesce(role, F.lit("")), text.isNull(), F.coalesce(text, F.lit("")))


def rolled(turns: DataFrame) -> DataFrame:
    """(name, conv_id, place, role, text, h1, h2): turns numbered from 1, with their prefix hashes.

    Turns are ordered by turn (null last), role and text; rows equal in all of them count
    once. The hash of a prefix is the exclusive or of its turns' hashes, each of which
    depends on the place, so that it can be summed up range by range: first within ranges of
    turn numbers, then over the few ranges of a conversation.
    """
    kinds = {"conv_id": "long", "turn": "long", "role": "string", "text": "string"}
    base = turns.select(*(F.col(c).cast(k).alias(c) for c, k in kinds.items())).withColumn("name", _name(F.col("conv_id")))
    ranged = base.withColumn("range", F.coalesce(F.floor(F.col("turn") / TURNS_PER_RANGE), F.lit((1 << 63) - 1)))
    within = Window.partitionBy("name", "range").orderBy(F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last())
    up_to = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = F.struct("turn", "role", "text")
    counted = ranged.withColumn("again", F.coalesce(F.lag(same).over(within).eqNullSafe(same), F.lit(False)))
    counted = counted.filter("not again").withColumn("inner", F.row_number().over(within))
    before = Window.partitionBy("name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)

    sizes = counted.groupBy("name", "range").agg(F.max("inner").alias("n"))
    starts = checkpointed(sizes.select("name", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    placed = counted.join(starts, ["name", "range"]).withColumn("place", F.col("start") + F.col("inner"))
    hashed = placed.withColumn("t1", _turn_hash(1)).withColumn("t2", _turn_hash(2))
    sums = hashed.groupBy("name", "range").agg(F.bit_xor("t1").alias("s1"), F.bit_xor("t2").alias("s2"))
    ahead = checkpointed(sums.select("name", "range", *(F.coalesce(F.bit_xor(f"s{i}").over(before), F.lit(0)).cast("long").alias(f"a{i}") for i in (1, 2))))
    inner = hashed.withColumn("i1", F.bit_xor("t1").over(up_to)).withColumn("i2", F.bit_xor("t2").over(up_to)).join(ahead, ["name", "range"])
    return inner.select("name", "conv_id", "place", "role", "text", F.col("i1").bitwiseXOR(F.col("a1")).alias("h1"), F.col("i2").bitwiseXOR(F.col("a2")).alias("h2"))


def maximal(prefixes: DataFrame) -> DataFrame:
    """(name, n_turns, copies) of the conversations that no longer one begins with.

    ``prefixes`` has (name, conv_id, place, h1, h2). Of conversations with the same turns the
    one with the smallest id stays (null last); ``copies`` counts them. Prefixes are distinct
    before they are shuffled, so a first turn that very many conversations share is one row.
    """
    ends = prefixes.groupBy("name", "conv_id").agg(F.max(F.struct("place", "h1", "h2")).alias("end")).select("name", "conv_id", "end.*")
    groups = ends.groupBy("place", "h1", "h2").agg(F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id", "name")).alias("first"), F.count("*").alias("copies"))
    lengths = ends.select("name", F.col("place").alias("n"))
    proper = prefixes.join(lengths, "name").filter("place < n").select("place", "h1", "h2").distinct()
    kept = groups.join(proper, ["place", "h1", "h2"], "left_anti")
    return kept.select(F.col("first.name").alias("name"), F.col("place").alias("n_turns"), "copies")


def rendered_turn(role: Column, text: Column) -> Column:
    """One turn as text; markers inside it are broken up, so that none can be forged."""
    safe = lambda c: F.replace(c, F.lit(OPEN), F.lit("< |"))
    return F.concat(F.lit(OPEN), safe(F.coalesce(role, F.lit("unknown"))), F.lit(CLOSE + "\n"), safe(F.coalesce(text, F.lit(""))), F.lit(END + "\n"))


def collapse_and_render(turns: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, copies and rendered of each maximal conversation of ``turns``
    (conv_id, turn, role, text).

    A conversation of more than ``TURNS_PER_PART`` turns has several parts, in order from 0.
    Null roles render as unknown and null texts as empty; a null conv_id is one conversation.
    Repeated rows count once, an empty table gives an empty result, and further columns are
    ignored.
    """
    prefixes = checkpointed(rolled(turns))
    kept = checkpointed(maximal(prefixes.select("name", "conv_id", "place", "h1", "h2")))
    shown = prefixes.join(kept, "name").select(
        "name", "conv_id", "n_turns", "copies", "place",
        F.floor((F.col("place") - 1) / TURNS_PER_PART).alias("part"), rendered_turn(F.col("role"), F.col("text")).alias("line"),
    )
    parts = shown.groupBy("name", "part").agg(F.first("conv_id").alias("conv_id"), F.first("n_turns").alias("n_turns"), F.first("copies").alias("copies"), F.array_sort(F.collect_list(F.struct("place", "line"))).alias("lines"))
    return parts.select("conv_id", "part", "n_turns", "copies", F.array_join(F.col("lines.line"), "").alias("rendered"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_and_render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP2_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS LAST, text NULLS LAST) AS place FROM t),
c AS (SELECT conv_id, count(*) AS n_turns, list(struct_pack(r := role, t := text) ORDER BY place) AS said FROM p GROUP BY conv_id),
g AS (SELECT n_turns, said, min(conv_id) AS conv_id, count(*) AS copies FROM c GROUP BY n_turns, said),
m AS (SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM g l WHERE l.n_turns > g.n_turns AND l.said[1] IS NOT DISTINCT FROM g.said[1] AND l.said[1:g.n_turns] = g.said))
SELECT m.conv_id, (p.place - 1) // 256 AS part, m.n_turns, m.copies,
       string_agg('<|' || replace(coalesce(role, 'unknown'), '<|', '< |') || '|>' || chr(10) || replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10), '' ORDER BY place) AS rendered
FROM m JOIN p ON p.conv_id IS NOT DISTINCT FROM m.conv_id GROUP BY ALL"""
