"""SimHash near-duplicates through one-wildcard segment variants.

A fingerprint is cut into segments, so few that of two fingerprints that differ in ``distance``
bits at most, some segment differs in one bit at most (three segments of 64 bits for four
bits, where exact segments would take five). Every segment is indexed once for each of its
bits with that bit blanked out: segments that differ in at most one bit then share a variant
exactly. An equality join on the variants finds the pairs, and the join's condition verifies
the whole fingerprints.

Links are wanted for the groups that they connect, so a group of many near copies need not
give all its pairs. First the fingerprints of a variant are compared with one of them only,
which connects most of a dense group. The join then looks for links between different groups,
and keeps one for each group. Rounds go on among the groups that grew until none has a link to
another, so that no link between different groups is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.llm.common import checkpointed, mixed, salted_join, scratch, text_key
from docstrata.llm.components import components

SEED = 42
#: Shingles whose bits are counted at once, so that long documents need little memory.
SHINGLES_AT_ONCE = 65_280
#: Rows of bits that are added up as bytes without overflow.
_BYTE_ROWS = 255


@dataclass(frozen=True)
class Scheme:
    """Words in a shingle, 64-bit words in a fingerprint, bits that linked ones may differ in, segments."""

    shingle: int
    words: int
    distance: int
    segments: int

    def cuts(self) -> list[tuple[int, int]]:
        """(first bit, bits) of each segment; none crosses a 64-bit word."""
        each = -(-self.segments // self.words)
        edges = [64 * i // each for i in range(each + 1)]
        return [(64 * w + a, b - a) for w in range(self.words) for a, b in zip(edges, edges[1:])]


#: Links at 4 of 64 bits over shingles of four words; some of three segments differs in one bit at most.
FOUR_BITS = Scheme(shingle=4, words=1, distance=4, segments=3)


# -- fingerprints -------------------------------------------------------------------------


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes (rows of 64-bit words) have each bit."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(len(hashes), -1), axis=1, bitorder="little")
    whole = len(bits) // _BYTE_ROWS * _BYTE_ROWS
    sums = bits[:whole].reshape(-1, _BYTE_ROWS, bits.shape[1]).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return sums + bits[whole:].sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes, size: int = FOUR_BITS.shingle, words: int = 1) -> list[int]:
    """Signed 64-bit words of the fingerprint of UTF-8 text; all 0 when it has no words.

    The first word counts the bits of the shingles' XXH64; further ones those of its mixes.
    """
    import xxhash

    tokens = text.lower().split()  # bytes: A-Z alone change, and exactly the six blanks split
    if not tokens:
        return [0] * words
    k = min(size, len(tokens))
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(tokens) - k + 1].tolist()
    stops = ends[k - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64 * words, dtype=np.int64)
    for at in range(0, len(starts), SHINGLES_AT_ONCE):
        part = zip(starts[at : at + SHINGLES_AT_ONCE], stops[at : at + SHINGLES_AT_ONCE], strict=True)
        first = np.array([digest(joined[a:b], SEED) for a, b in part], dtype="<u8")
        ones += bit_counts(np.stack([first, *(mixed(first, i) for i in range(1, words))], axis=1))
    return np.packbits(ones * 2 > len(starts), bitorder="little").view("<i8").tolist()


def _names(words: int) -> list[str]:
    return [f"w{i}" for i in range(words)]


def fingerprints(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """(doc_id, key, row_id, w0, w1, ...) of every row: ``key`` tells apart texts that share a doc_id."""
    names = _names(scheme.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py() or b"", scheme.shingle, scheme.words) for t in batch["text"].cast(pa.binary())]
            columns = np.array(found, dtype=np.int64).reshape(-1, scheme.words).T
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["key"], batch["row_id"], *(pa.array(c) for c in columns)], names=["doc_id", "key", "row_id", *names])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), F.monotonically_increasing_id().alias("row_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id bigint, key bigint, row_id bigint, " + ", ".join(f"{n} bigint" for n in names))


# -- links --------------------------------------------------------------------------------


def _segment(first: int, bits: int) -> Column:
    return F.shiftrightunsigned(F.col(f"w{first // 64}"), first % 64).bitwiseAND(F.lit((1 << bits) - 1))


def variants(fps: DataFrame, scheme: Scheme) -> DataFrame:
    """``fps`` with ``variant``: for each bit of a segment, that bit's number and the segment without it.

    Spark's estimate knows nothing of the many rows for each fingerprint, so that joins are told to merge: by
    the size of ``fps`` alone it would broadcast all variants.
    """
    out = []
    for first, bits in scheme.cuts():
        for i in range(bits):
            out.append(_segment(first, bits).bitwiseAND(F.lit(((1 << bits) - 1) ^ (1 << i))) + F.lit((first + i) << 32))
    return fps.select("*", F.explode(F.array(*out)).alias("variant")).hint("merge")


def differing(scheme: Scheme) -> Column:
    return sum((F.bit_count(F.col(f"a.{w}").bitwiseXOR(F.col(f"b.{w}"))) for w in _names(scheme.words)), F.lit(0))


def _place_of(scheme: Scheme) -> Column:
    """The number of the one bit at which a pair is kept: of the first segment that differs in
    one bit at most, that bit, or the segment's first if it doesn't differ."""
    place = F.lit(None).cast("int")
    for first, bits in reversed(scheme.cuts()):
        x = F.shiftrightunsigned(F.col(f"a.w{first // 64}").bitwiseXOR(F.col(f"b.w{first // 64}")), first % 64).bitwiseAND(F.lit((1 << bits) - 1))
        place = F.when(F.bit_count(x) <= 1, F.lit(first) + F.when(x == 0, F.lit(0)).otherwise(F.bit_count(x - 1))).otherwise(place)
    return place


def links_to_first(fps: DataFrame, scheme: Scheme, more: Callable[[], Column] | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """(u, v): links of the ``fps`` (id, w0, ...) of a variant with the smallest id among them.

    A dense group of near copies shares variants, so these links alone, at most one for each
    fingerprint and variant, connect most of it. ``more`` is a further condition on a and b, over
    columns that are ``carried``.
    """
    names = [*_names(scheme.words), *carried]
    index = variants(fps.select("id", *names), scheme)
    first = F.min(F.struct("id", *names)).alias("first")
    several = index.groupBy("variant").agg(first, F.count("*").alias("n")).filter("n > 1").select("variant", "first.*")
    a, b = index.alias("a"), several.alias("b")
    linked = (F.col("a.variant") == F.col("b.variant")) & (F.col("a.id") != F.col("b.id")) & (differing(scheme) <= scheme.distance)
    return a.join(b, linked & more() if more else linked).select(F.col("a.id").alias("u"), F.col("b.id").alias("v")).distinct()


def cross_pairs(fps: DataFrame, scheme: Scheme, more: Callable[[], Column] | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """a and b: the pairs of ``fps`` (id, root, w0, ...) of different groups that link, each once.

    Where a group has several fingerprints of a variant, these need no comparing with each
    other: of every pair between groups, one is not in the variant's largest group, so that
    only the others are compared with all.
    """
    index = variants(fps.select("id", "root", *_names(scheme.words), *carried), scheme)
    dense = index.groupBy("variant", "root").agg(F.count("*").alias("n")).filter("n > 1")
    largest = dense.groupBy("variant").agg(F.max_by("root", F.struct("n", "root")).alias("largest"))
    a = index.join(largest, "variant", "left").filter(~F.col("root").eqNullSafe(F.col("largest"))).alias("a")
    b = index.alias("b")
    once = F.col("b.root").eqNullSafe(F.col("a.largest")) | (F.col("a.id") < F.col("b.id"))
    linked = (F.col("a.variant") == F.col("b.variant")) & (F.col("a.root") != F.col("b.root")) & once & (differing(scheme) <= scheme.distance)
    kept = F.shiftright(F.col("a.variant"), 32) == _place_of(scheme)  # a pair shares several variants; it counts in one
    return a.join(b, linked & kept & more() if more else linked & kept)


def nearest_groups(fps: DataFrame, scheme: Scheme) -> DataFrame:
    """(u, v): for each group ``u`` of ``fps`` (id, root, w0, ...) the smallest other group ``v`` that it links to.

    The least of a task's links is found before anything is shuffled.
    """
    both = F.array(F.struct(F.col("a.root").alias("u"), F.col("b.root").alias("v")), F.struct(F.col("b.root").alias("u"), F.col("a.root").alias("v")))
    return cross_pairs(fps, scheme).select(F.inline(both)).groupBy("u").agg(F.min("v").alias("v"))


def _merged(links: DataFrame) -> DataFrame:
    """(root, new_root) of every group that a link (u, v) touches."""
    found = components(links).select(F.col("node").alias("root"), F.col("root").alias("new_root"))
    return found.union(found.select("new_root", "new_root").distinct())


def connected(fps: DataFrame, scheme: Scheme) -> DataFrame:
    """(id, root) of the ``fps`` (id, w0, ...), by group; an id alone is its own root.

    Links to the first of each variant make the groups that the rounds begin with. Every round
    then at least halves the groups that still have links to others. A group without one
    takes no further part: its links can't change.
    """
    names = _names(scheme.words)
    with scratch(fps.sparkSession) as keep:  # tables: their jobs' shuffle files are dropped at once
        begun = _merged(keep(links_to_first(fps, scheme), "links"))
        active = checkpointed(fps.join(begun.withColumnRenamed("root", "id"), "id", "left").select("id", *names, F.coalesce("new_root", "id").alias("root")))
        settled = active.select("id", "root").limit(0)
        while True:
            merged = _merged(keep(nearest_groups(active, scheme), "links"))
            told = checkpointed(salted_join(active, merged, "root", "id", "left"))  # a group may hold a third of all
            settled = settled.union(told.filter("new_root is null").select("id", "root"))
            active = told.filter("new_root is not null").select("id", *names, F.col("new_root").alias("root"))
            if active.isEmpty():
                return settled


# -- the operator -------------------------------------------------------------------------


def near_groups(docs: DataFrame, scheme: Scheme = FOUR_BITS) -> DataFrame:
    """doc_id, key, row_id, w0..., root and component_id (smallest doc_id reachable over links) of every row.

    Rows with one fingerprint are collapsed before any pair is sought, so copies cost nothing
    however many there are. Null text is empty; texts without words share fingerprint 0, which
    links like any other. Null ids take part, and a component of nothing but null ids has a
    null id. Repeated rows stay repeated, an empty table gives an empty result, very long texts
    are read whole in parts of bounded size, and further columns are ignored.
    """
    names = _names(scheme.words)
    rows = checkpointed(fingerprints(docs, scheme))
    fps = checkpointed(rows.groupBy(*names).agg(F.min("doc_id").alias("least")).withColumn("id", F.monotonically_increasing_id()))
    roots = checkpointed(connected(fps.drop("least"), scheme))
    grouped = fps.join(roots, "id")
    first = grouped.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    several = salted_join(grouped, first.filter("n > 1").drop("n"), "root", "id").select(*names, "component_id", "root")
    alone = first.filter("n = 1").select(F.col("root").alias("id"))  # an id alone is its own root
    single = fps.join(alone, "id").select(*names, F.col("least").alias("component_id"), F.col("id").alias("root"))
    return rows.join(several.union(single), names).select("doc_id", "key", "row_id", *names, "component_id", "root")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("w0"), 16, "0")).alias("fingerprint"), "component_id")
