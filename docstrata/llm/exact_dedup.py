"""Exact deduplication against immutable snapshots screened by static binary-fuse filters.

A snapshot never changes, so its filter is built once and stored beside it: its digests are
dealt into shards, and each shard's 8-bit, 3-wise binary-fuse filter is built in one task and
written as a row. An incoming batch is first grouped by digest on its own; then its distinct
digests are tested against the stored filters of every snapshot. Only the positives are joined
with that snapshot's exact buckets, and texts that share a bucket are compared byte by byte.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.llm.common import BLANKS, checkpointed, keep_rows, mixed, remove_folder, screened, shared_folder, text_key, written

#: Distinct digests that one filter shard holds about; it bounds a task's memory.
SHARD_KEYS = 100_000
FILTER_SCHEMA = "shard int, seed int, segment long, segments long, filter binary"


def normalised(text: Column) -> Column:
    """Text with every run of blanks as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{BLANKS}]+", " ")


# -- binary-fuse filter -------------------------------------------------------------------


def _places(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The three slots of each key, in neighbouring segments, and its 8-bit fingerprint."""
    h = mixed(keys, seed)
    first = ((h >> np.uint64(32)) * np.uint64(segment * segments)) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * segment)) ^ (h & mask)
    return np.stack([first, second, third]).astype(np.int64), ((h ^ (h >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """Filter over distinct unsigned 64-bit keys: (seed, segment length, segments, table).

    Keys are peeled in rounds: a slot that one key alone uses settles that key. The slots are
    then filled in the reverse order. A seed that leaves keys unpeeled is given up for the next.
    """
    keys = np.unique(keys)
    n = len(keys)
    segment = 1 << max(2, min(18, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * math.log(1_000_000) / math.log(max(n, 10)))
    for seed in range(1000):
        segments = max(1, math.ceil(n * factor * (1 + seed // 20 * 0.1) / segment) - 2)
        size = (segments + 2) * segment
        slots, prints = _places(keys, seed, segment, segments)
        count = np.bincount(slots.ravel(), minlength=size)
        owner = np.zeros(size, dtype=np.int64)  # xor of the keys that use a slot
        for row in slots:
            np.bitwise_xor.at(owner, row, np.arange(n))
        rounds, left, look = [], n, np.flatnonzero(count == 1)
        while len(look):
            key, at = np.unique(owner[look], return_index=True)
            rounds.append((key, look[at]))
            left -= len(key)
            touched = slots[:, key]
            np.subtract.at(count, touched.ravel(), 1)
            for row in touched:
                np.bitwise_xor.at(owner, row, key)
            look = np.unique(touched)
            look = look[count[look] == 1]
        if left == 0:
            table = np.zeros(size, dtype=np.uint8)
            for key, slot in reversed(rounds):
                table[slot] = 0
                table[slot] = prints[key] ^ np.bitwise_xor.reduce(table[slots[:, key]], axis=0)
            return seed, segment, segments, table.tobytes()
    raise RuntimeError("no seed peels these keys")


def might_hold(keys: np.ndarray, seed: int, segment: int, segments: int, table: bytes) -> np.ndarray:
    """False proves that a key is not in the snapshot; true may be wrong once in 256."""
    slots, prints = _places(keys, seed, segment, segments)
    return np.bitwise_xor.reduce(np.frombuffer(table, dtype=np.uint8)[slots], axis=0) == prints


def _key() -> Column:
    return F.xxhash64("digest")


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("shard"), F.col("digest")), F.lit(shards)).cast("int").alias("shard")


def build_filters(digests: DataFrame, shards: int) -> DataFrame:
    """One filter row per shard of the distinct ``digest`` values."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        seed, segment, segments, table = build_filter(pdf["key"].to_numpy().astype(np.int64).view(np.uint64))
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "seed": [seed], "segment": [segment], "segments": [segments], "filter": [table]})

    return digests.select(_shard(shards), _key().alias("key")).groupBy("shard").applyInPandas(build, FILTER_SCHEMA)


def screen(digests: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The distinct incoming ``digest`` values that their shard's filter doesn't rule out.

    Digests stream past the filter of their shard, which comes first in its sorted partition:
    a batch may be far larger than the snapshot.
    """

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, None
        for batch in batches:
            shards_here, digest = batch["shard"].to_numpy(), batch["digest"]
            keys, keep = batch["key"].to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), np.zeros(len(shards_here), dtype=bool)
            is_filter = digest.is_null().to_numpy(zero_copy_only=False)
            marks = np.flatnonzero(is_filter)
            for a, b in zip([0, *marks], [*marks, len(shards_here)]):
                if a < b and is_filter[a]:
                    shard, held = shards_here[a], [batch[c][int(a)].as_py() for c in ("seed", "segment", "segments", "filter")]
                    a += 1
                if held is not None:
                    mine = slice(a, b)
                    keep[mine] = might_hold(keys[mine], *held) & (shards_here[mine] == shard)
            yield pa.RecordBatch.from_arrays([digest.filter(pa.array(keep))], names=["digest"])

    incoming = digests.select(_shard(shards), _key().alias("key"), "digest")
    both = incoming.unionByName(filters.withColumn("key", F.lit(0).cast("long")), allowMissingColumns=True)
    ordered = both.repartition("shard").sortWithinPartitions("shard", F.col("digest").asc_nulls_first())
    return ordered.select("shard", "key", "digest", "seed", "segment", "segments", "filter").mapInArrow(probe, "digest string")


# -- stored snapshots ---------------------------------------------------------------------


def write_snapshot(groups: DataFrame, path: str) -> None:
    """Store a snapshot's ``groups`` (digest, first, rows) at ``path``: exact buckets, and their filters.

    It is written once and never changes; a path that exists is an error. No groups give a
    snapshot that holds nothing.
    """
    buckets = written(groups.select("digest", "first", "rows"), f"{path}/buckets")
    written(build_filters(buckets, max(1, math.ceil(buckets.count() / SHARD_KEYS))), f"{path}/filters")


def known(digests: DataFrame, path: str) -> DataFrame:
    """(digest, first, rows) of the distinct ``digests`` that the snapshot at ``path`` holds."""
    spark = digests.sparkSession
    buckets, filters = spark.read.parquet(f"{path}/buckets"), spark.read.schema(FILTER_SCHEMA).parquet(f"{path}/filters")
    shards = (filters.agg(F.max("shard")).first()[0] or 0) + 1
    return screen(digests.select("digest"), filters, shards).join(buckets, "digest")


# -- the operator -------------------------------------------------------------------------


def _grouped(rows: DataFrame) -> DataFrame:
    """Groups of one batch: the smallest id (null ids last, then the row) and the rows."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id"))
    return rows.groupBy("digest").agg(first.alias("first"), F.count("*").alias("rows"))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def group_copies(docs: DataFrame, in_snapshot: Column, digest: Callable[[Column], Column] = sha256) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): every row's id and digest, and every digest's first row and size.

    ``in_snapshot`` says which rows the immutable snapshot holds; the rest are the new batch.
    """
    rows = checkpointed(
        docs.select("doc_id", in_snapshot.alias("old"), text_key(F.col("text")).alias("key"), normalised(F.col("text")).alias("norm"))
        .select("doc_id", F.coalesce("old", F.lit(False)).alias("old"), "key", digest(F.col("norm")).alias("digest"), F.monotonically_increasing_id().alias("row_id"))
    )
    spark, path = docs.sparkSession, shared_folder(docs.sparkSession, "snapshot")
    new = checkpointed(_grouped(rows.filter("not old")))
    write_snapshot(_grouped(rows.filter("old")), path)
    old = spark.read.parquet(f"{path}/buckets")
    renamed = new.select("digest", F.col("first").alias("new_first"), F.col("rows").alias("new_rows"))
    both = checkpointed(known(new, path).join(renamed, "digest"))
    merged = both.select("digest", F.least("first", "new_first").alias("first"), (F.col("rows") + F.col("new_rows")).alias("rows"))
    groups = merged.union(old.join(both, "digest", "left_anti")).union(new.join(both, "digest", "left_anti"))
    kept = checkpointed(groups.select("digest", F.col("first.doc_id").alias("keep_id"), F.col("first.row_id").alias("keep_row"), F.col("rows").alias("group_size")))
    remove_folder(spark, path)
    return rows, kept


def dedup_batch(docs: DataFrame, snapshots: list[str], store: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, known and digest of each row of a batch (doc_id, text).

    ``snapshots`` are paths of earlier ``write_snapshot`` calls, whose filters are probed as they
    lie; a digest that several hold has the smallest of their first ids. A row whose text a
    snapshot holds is ``known`` and not kept; of the others the smallest doc_id of each group
    stays, null ids last. With ``store`` the batch's new groups become a snapshot there, so
    that the next batch finds them. Null text is empty; an empty batch gives an empty result.
    Texts are told apart by SHA-256 alone here, as a snapshot keeps no texts.
    """
    rows = checkpointed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), sha256(normalised(F.col("text"))).alias("digest"), F.monotonically_increasing_id().alias("row_id")))
    groups = checkpointed(_grouped(rows))
    none = groups.select("digest", F.col("first.doc_id").alias("keep_id"), F.col("rows").alias("held")).limit(0)
    found = none
    for path in snapshots:
        found = found.union(known(groups, path).select("digest", F.col("first.doc_id"), "rows"))
    found = checkpointed(found.groupBy("digest").agg(F.min("keep_id").alias("held_id"), F.sum("held").alias("held")))
    if store:
        write_snapshot(groups.join(found, "digest", "left_anti"), store)
    joined = rows.join(groups, "digest").join(found, "digest", "left")
    is_known = F.col("held").isNotNull()
    return joined.select(
        "doc_id", F.when(is_known, F.col("held_id")).otherwise(F.col("first.doc_id")).alias("keep_id"), (F.col("rows") + F.coalesce("held", F.lit(0))).alias("group_size"),
        (~is_known & (F.col("row_id") == F.col("first.row_id"))).alias("kept"), is_known.alias("known"), "digest",
    )


def _collide(docs: DataFrame, rows: DataFrame, groups: DataFrame, digest: Callable[[Column], Column]) -> bool:
    """Whether two texts of one bucket differ in a byte: the least and the greatest then do.

    Only texts of buckets with several rows are moved; a bitmap of their keys leaves the
    others where they are, and copies meet as partial minima before the shuffle.
    """
    repeated = groups.filter("group_size > 1").select("digest")
    keys = rows.join(repeated, "digest", "left_semi").select("key")
    maybe = screened(docs.select("text"), text_key(F.col("text")), keys).filter("__hit")
    texts = maybe.select(normalised(F.col("text")).alias("norm")).withColumn("digest", digest(F.col("norm")))
    ends = texts.groupBy("digest").agg(F.min("norm").alias("least"), F.max("norm").alias("most"))
    return bool(ends.filter("least != most").take(1))


def exact_dedup(docs: DataFrame, in_snapshot: Column, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest and text key of each row of ``docs`` (doc_id, text).

    Texts are equal when their normalised forms are the same bytes. Null text is empty, so
    null and blank texts form groups like any other (" " and "" differ). Of a group the row
    with the smallest doc_id stays, null ids last; of rows that also share that id, one stays.
    Other columns are ignored; an empty table gives an empty result. Should two texts with
    one digest differ, the texts themselves are grouped instead of their digests.
    """
    base = docs.select("doc_id", "text", in_snapshot.alias("__old"))
    rows, groups = group_copies(base, F.col("__old"), digest)
    shown = F.col("digest")
    if _collide(base, rows, groups, digest):
        rows, groups = group_copies(base, F.col("__old"), lambda text: text)
        shown = digest(F.col("digest"))
    out = rows.join(groups, "digest")
    return out.select("doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), shown.alias("digest"), "key")


def halves(docs: DataFrame) -> Column:
    """Rows up to the middle of the id range: the snapshot of a table that has no batches."""
    r = docs.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    return F.col("doc_id") <= F.lit(None if r["lo"] is None else (r["lo"] + r["hi"]) // 2)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_dedup(docs, halves(docs)).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def keep_first(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The rows of ``docs`` that exact_dedup keeps, with all their columns.

    Null texts are equal to each other and to empty ones; of repeated rows one stays; an empty
    table gives an empty one.
    """
    decided = exact_dedup(docs.select("doc_id", "text"), halves(docs), digest)
    return keep_rows(docs, checkpointed(decided.select("doc_id", "key", "kept")))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)"""
