"""Near copies by SimHash candidates and exact verification.

SimHash fingerprints of 128 bits propose pairs: eight segments with one-bit wildcards meet in an
equality join, which also asks for few differing bits, for sizes that allow the similarity,
and for agreement of 512 MinHash bits (one bit for each permutation). These are loose. What
counts is the verification: both texts' sets of shingles are compared, and only a Jaccard
similarity of 0.8 or more is a link.

Groups are what links connect. A semi-join leaves the fingerprints that have any partner; most
have none. Of the others each is compared with the first of each of its variants, which
connects most of a dense group; then pairs between different groups are verified, first those
whose MinHash bits agree well, at last all, so that no proposed link between groups is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstrata.llm.common import checkpointed, keep_rows, mixed, salted_join, scratch, screened, text_key
from docstrata.llm.components import components
from docstrata.llm.simhash import SEED, Scheme, bit_counts, cross_pairs, differing, links_to_first, variants

#: Words in a shingle, and the share of all shingles that near copies have in common.
SHINGLE, SIMILARITY = 5, 0.8
#: Texts at that similarity differ in 19 of the 128 bits on average, and in over 30 in one of 300 cases.
PROPOSED = Scheme(shingle=SHINGLE, words=2, distance=30, segments=8)
#: MinHash bits; at the similarity a tenth of them differs, and over 69 in one of 300 cases. Rounds allow so many.
LANES, ROUNDS = 512, (50, 60, 69)
#: Shingles that are hashed at once.
AT_ONCE = 2048
_PRINT = ["w0", "w1"]
_SKETCH = [f"m{i}" for i in range(LANES // 64)]
_CARRIED = ("size", *_SKETCH)
_MULTIPLIERS = (mixed(np.arange(LANES, dtype=np.uint64), 7) | np.uint64(1)).astype(np.uint32)
_SHIFTS = mixed(np.arange(LANES, dtype=np.uint64), 8).astype(np.uint32)


def shingles(text: bytes, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of UTF-8 text (A-Z in lower case, repeats included), some at a time."""
    import xxhash

    tokens = text.lower().split()
    if not tokens:
        return
    k = min(size, len(tokens))
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(tokens) - k + 1].tolist()
    stops = ends[k - 1 :].tolist()
    for at in range(0, len(starts), AT_ONCE):
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + AT_ONCE], stops[at : at + AT_ONCE], strict=True)], dtype="<u8")


def sketch(text: bytes) -> tuple[list[int], list[int], int]:
    """Fingerprint words, MinHash words and number of different shingles; all 0 without words."""
    ones, least, n, parts = np.zeros(128, dtype=np.int64), np.full(LANES, 0xFFFFFFFF, dtype=np.uint32), 0, []
    for h in shingles(text):
        ones += bit_counts(np.stack([h, mixed(h, 1)], axis=1))
        low = h.astype(np.uint32)
        np.minimum(least, (low[:, None] * _MULTIPLIERS + _SHIFTS).min(axis=0), out=least)
        n += len(h)
        parts.append(low)
    if not n:
        return [0, 0], [0] * len(_SKETCH), 0
    bits = (mixed(least.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
    words = lambda b: np.packbits(b, bitorder="little").view("<i8").tolist()
    return words(ones * 2 > n), words(bits), len(np.unique(np.concatenate(parts)))


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, key, row_id, w0, w1, m0..., size) of every row."""
    names = [*_PRINT, *_SKETCH]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sketch(t.as_py() or b"") for t in batch["text"].cast(pa.binary())]
            columns = np.array([a + b for a, b, _ in found], dtype=np.int64).reshape(-1, len(names)).T
            sizes = pa.array([n for *_, n in found], pa.int32())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["key"], batch["row_id"], *(pa.array(c) for c in columns), sizes], names=["doc_id", "key", "row_id", *names, "size"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), F.monotonically_increasing_id().alias("row_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id bigint, key bigint, row_id bigint, " + ", ".join(f"{n} bigint" for n in names) + ", size int")


def _agreeing(over: int, most: int) -> Column:
    """Whether a and b may be similar, by their sizes and by differing MinHash bits, ``over`` one number and at ``most`` another."""
    smaller, larger = F.least("a.size", "b.size"), F.greatest("a.size", "b.size")
    apart = sum((F.bit_count(F.col(f"a.{m}").bitwiseXOR(F.col(f"b.{m}"))) for m in _SKETCH), F.lit(0))
    return (smaller >= larger * SIMILARITY) & (apart > over) & (apart <= most)


def jaccard(a: bytes, b: bytes) -> float:
    """Of two sets, as ascending 32-bit hashes; 1 for two empty ones."""
    x, y = np.frombuffer(a, dtype="<u4"), np.frombuffer(b, dtype="<u4")
    common = np.intersect1d(x, y, assume_unique=True).size
    return common / (len(x) + len(y) - common) if len(x) + len(y) else 1.0


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, shingles) of the texts with the ``wanted`` keys (id, key); a bitmap keeps other texts from being moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(np.concatenate([np.zeros(0, np.uint32), *(h.astype(np.uint32) for h in shingles(t.as_py() or b""))])).astype("<u4").tobytes() for t in batch["text"].cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(sets, pa.binary())], names=["id", "shingles"])

    texts = docs.select(text_key(F.col("text")).alias("key"), F.col("text").cast("string").alias("text"))
    hit = screened(texts, F.col("key"), wanted.select("key")).filter("__hit").select("key", "text")
    one = hit.groupBy("key").agg(F.first("text").alias("text"))  # copies collapse before they are moved
    return wanted.join(one, "key").select("id", "text").mapInArrow(run, "id bigint, shingles binary")


def verified(pairs: DataFrame, fps: DataFrame, docs: DataFrame, keep) -> DataFrame:
    """The ``pairs`` (u, v) of ``fps`` (id, key) whose texts have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [jaccard(a.as_py(), b.as_py()) >= SIMILARITY for a, b in zip(batch["a"], batch["b"], strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    ids = pairs.select(F.col("u").alias("id")).distinct().union(pairs.select("v").distinct()).distinct()  # partial in the tasks
    sets = keep(shingle_sets(docs, keep(fps.join(ids, "id").select("id", "key"), "ids")), "sets")
    first = pairs.join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("a")), "u")
    both = first.join(sets.select(F.col("id").alias("v"), F.col("shingles").alias("b")), "v")
    return both.select("u", "v", "a", "b").mapInArrow(run, "u bigint, v bigint")


def with_partners(fps: DataFrame) -> DataFrame:
    """The ``fps`` (id, w0, w1, ...) that share a variant with another one and differ in few bits."""
    index = variants(fps.select("id", *_PRINT), PROPOSED)
    a, b = index.alias("a"), index.alias("b")
    near = (F.col("a.variant") == F.col("b.variant")) & (F.col("a.id") != F.col("b.id")) & (differing(PROPOSED) <= PROPOSED.distance)
    return fps.join(a.join(b, near, "left_semi").select("id").distinct(), "id", "left_semi")


def _merged(grouped: DataFrame, links: DataFrame) -> DataFrame:
    """``grouped`` (id, root, ...) with new roots where ``links`` (u, v) of ids connect groups."""
    roots = lambda c: grouped.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root"))
    ends = salted_join(salted_join(links, roots("u"), "u", "v"), roots("v"), "v", "u")
    told = components(ends.select(F.col("u_root").alias("u"), F.col("v_root").alias("v"))).select(F.col("node").alias("root"), F.col("root").alias("least"))
    return salted_join(grouped, told, "root", "id", "left").withColumn("root", F.coalesce("least", "root")).drop("least")


def similar_groups(docs: DataFrame) -> DataFrame:
    """doc_id, key, row_id and root of every row: rows with one root are connected by verified links.

    Rows with one sketch are collapsed before any pair is sought. Null text is empty; texts
    without words are one group; a text of fewer than five words is one shingle. Null ids take
    part, repeated rows stay repeated, an empty table gives an empty result, very long texts
    are read whole, and further columns are ignored.
    """
    names = [*_PRINT, *_CARRIED]
    rows = checkpointed(sketches(docs))
    fps = checkpointed(rows.groupBy(*names).agg(F.min("key").alias("key")).withColumn("id", F.monotonically_increasing_id()))
    with scratch(docs.sparkSession) as keep:
        some = keep(with_partners(fps), "partners")
        grouped = some.withColumn("root", F.col("id"))
        begun = keep(links_to_first(some, PROPOSED, lambda: _agreeing(-1, ROUNDS[-1]), _CARRIED), "first")
        grouped = keep(_merged(grouped, keep(verified(begun, some, docs, keep), "links")), "groups")
        for over, most in zip((-1, *ROUNDS), ROUNDS, strict=False):  # what agreed better and is still apart was refuted
            across = cross_pairs(grouped, PROPOSED, lambda over=over, most=most: _agreeing(over, most), _CARRIED)
            pairs = keep(across.select(F.col("a.id").alias("u"), F.col("b.id").alias("v")), "across")
            grouped = keep(_merged(grouped, keep(verified(pairs, some, docs, keep), "links")), "groups")
        final = checkpointed(fps.select("id", *names).join(grouped.select("id", "root"), "id", "left").select(*names, F.coalesce("root", "id").alias("root")))
    return rows.join(final, names).select("doc_id", "key", "row_id", "root")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which one stays per group of near copies.

    The row with the smallest doc_id stays (null ids last, then any one row). Null texts are
    empty ones, and are near copies of each other; repeated rows are one group, and an
    empty table gives an empty result.
    """
    groups = checkpointed(similar_groups(docs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id")).alias("k")
    kept = groups.groupBy("root").agg(first).select(F.col("k.row_id").alias("row_id"), F.lit(True).alias("kept"))
    decided = groups.join(kept, "row_id", "left").select("doc_id", "key", F.coalesce("kept", F.lit(False)).alias("kept"))
    return keep_rows(docs, checkpointed(decided))
