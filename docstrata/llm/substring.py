"""Substring deduplication: repeated windows of words, found by rolling hashes.

Every window of ``size`` words gets a Rabin-Karp hash, rolled over strong hashes of its words,
and Spark counts the hashes: in buckets of the hash's range, as many as the words need. Where
a hash occurs again, the windows themselves are compared, by a 128-bit digest of their words.
Windows that also start earlier merge into maximal intervals, whose words are removed.

There are about as many windows as words, so hashes and places are shuffled as packed arrays:
one for each bucket of each slice of texts, with four bytes a hash and two to four a place.

Texts whose whole word sequence is repeated are collapsed to their first before that, as all
of their windows are then known to be repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.llm.common import (
    checkpointed,
    flat,
    keep_rows,
    remove_folder,
    rolling,
    running_totals,
    screened,
    shared_folder,
    slices,
    text_key,
    written,
)

WINDOW_WORDS = 20
#: Odd multiplier of the rolling hash over word hashes.
_BASE = 0xA0761D6478BD642F
#: Windows that a bucket of hashes has about. Within it hashes have 32 bits, so that one window in
#: some thousands meets another by chance, at any size of the corpus; words are compared after.
BUCKET_WINDOWS = 1 << 20
#: Places that one task matches with a bucket at least, before the bucket is dealt to several;
#: and buckets with more at most, as the bound grows with the words beyond.
TASK_PLACES, MOST_LARGE = 1 << 23, 100_000
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def word_hashes(words: Iterable[bytes], n: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)


# -- whole texts --------------------------------------------------------------------------


def sequences(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n_words, seq) of every row: seq is the SHA-256 of the space-joined words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests = [], []
            for text in batch["text"].cast(pa.binary()):
                words = (text.as_py() or b"").split()  # of bytes: at the six ASCII blanks
                counts.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["key"], pa.array(counts, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "key", "n_words", "seq"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id bigint, key bigint, n_words bigint, seq string")


# -- slices of texts ----------------------------------------------------------------------


def sliced(texts: DataFrame) -> DataFrame:
    """``texts`` (doc, doc_id, key, text) as rows of lists: whole texts of about ``SLICE_BYTES``
    together, ``packed`` into one compressed value, and their ``sizes`` in bytes."""
    lists = ["doc", "doc_id", "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = flat(batch["text"])
            for i, j in slices(offsets):
                ends = pa.array([0, j - i], pa.int32())
                columns = [pa.ListArray.from_arrays(ends, batch[c].slice(i, j - i)) for c in lists]
                columns += [pa.ListArray.from_arrays(ends, pa.array(np.diff(offsets[i : j + 1]))), pa.array([pa.compress(data[offsets[i] : offsets[j]].tobytes(), "zstd", asbytes=True)], pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array([name]), *columns], names=["slice", *lists, "sizes", "packed"])
                name += 1

    return texts.select(*lists, "text").mapInArrow(run, "slice bigint, doc array<bigint>, doc_id array<bigint>, key array<bigint>, sizes array<bigint>, packed binary")


def _texts(sizes: pa.ListScalar, packed: pa.BinaryScalar) -> list[bytes]:
    ends = np.cumsum([0, *sizes.values.to_pylist()]).tolist()
    whole = pa.decompress(packed.as_py(), ends[-1], "zstd", asbytes=True)
    return [whole[a:b] for a, b in zip(ends, ends[1:])]


def unsliced(slice_rows: DataFrame) -> DataFrame:
    """(doc, doc_id, key, text) of ``sliced`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                texts = pa.array(_texts(batch["sizes"][row], batch["packed"][row]), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*(batch[c][row].values for c in ("doc", "doc_id", "key")), texts], names=["doc", "doc_id", "key", "text"])

    return slice_rows.drop("slice").mapInArrow(run, "doc bigint, doc_id bigint, key bigint, text string")


def _words(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray]:
    """Words of each text of a slice, and how many are before it."""
    lists = [t.split() for t in texts]  # of bytes: at the six ASCII blanks
    return lists, np.cumsum([0, *map(len, lists)])


def _window_places(before: np.ndarray, size: int) -> np.ndarray:
    """The word at which each window of a slice begins."""
    n = np.maximum(np.diff(before) - size + 1, 0)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - before[:-1], n)


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values: the bytes of consecutive parts of an array, which end at ``ends``."""
    offsets = np.concatenate([[0], ends]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(column: pa.Array, kind: str) -> np.ndarray:
    return flat(column)[0].view(kind)


# -- windows ------------------------------------------------------------------------------


def window_hashes(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of every window of a slice."""
    lists, before = _words(texts)
    places = _window_places(before, size)
    return rolling(word_hashes(chain.from_iterable(lists), before[-1]), places, places + size, _BASE), places


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """By the upper half of a hash; the lower half is what is kept of it there."""
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)


def counted(slice_rows: DataFrame, size: int, buckets: int, task_places: int = TASK_PLACES) -> DataFrame:
    """(bucket, salts, repeated): the hashes, sorted and packed, that occur more than once in the corpus.

    A slice gives each of its hashes once, marked if it has it more often, so that a passage of
    very many documents is little to count. ``salts`` is into how many parts the bucket's
    places should be dealt.
    """

    def per_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sizes, packed in zip(batch["sizes"], batch["packed"], strict=True):
                hashes, times = np.unique(window_hashes(_texts(sizes, packed), size)[0], return_counts=True)
                bucket = _bucket(hashes, buckets)  # sorted, as the hashes are
                ends = np.flatnonzero(np.diff(bucket, append=buckets + 1)) + 1
                total = np.diff(np.concatenate([[0], np.cumsum(times)])[np.concatenate([[0], ends])])
                columns = [pa.array(bucket[ends - 1].astype(np.int64)), pa.array(total), _packed(hashes.astype("<u4"), ends), _packed((times > 1).astype(np.uint8), ends)]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "n", "hashes", "again"])

    def per_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, n, seen, repeated = None, 0, np.zeros(0, "<u4"), np.zeros(0, "<u4")
        for batch in batches:
            bucket, n = batch["bucket"][0].as_py(), n + pc.sum(batch["n"]).as_py()
            hashes = _unpacked(batch["hashes"], "<u4")
            met = np.sort(np.concatenate([seen, hashes]))
            same = np.flatnonzero(met[1:] == met[:-1])
            repeated = np.unique(np.concatenate([repeated, met[same], hashes[_unpacked(batch["again"], "u1") > 0]]))
            seen = np.delete(met, same)
        if len(repeated):
            yield pa.RecordBatch.from_arrays([pa.array([bucket]), pa.array([-(-n // task_places)], pa.int32()), pa.array([repeated.tobytes()])], names=["bucket", "salts", "repeated"])

    parts = slice_rows.select("sizes", "packed").mapInArrow(per_slice, "bucket bigint, n bigint, hashes binary, again binary")
    return parts.groupBy("bucket").applyInArrow(per_bucket, "bucket bigint, salts int, repeated binary")


def places_of(slice_rows: DataFrame, repeated: DataFrame, size: int, buckets: int) -> DataFrame:
    """(slice, places): packed places of the windows whose hash is ``repeated``, a few rows for each slice.

    A bucket's repeated hashes come before its places in sorted partitions, so the places are
    matched as they stream by, however many they are; large buckets are dealt to several tasks.
    """

    def per_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, sizes, packed in zip(batch["slice"], batch["sizes"], batch["packed"], strict=True):
                hashes, places = window_hashes(_texts(sizes, packed), size)
                bucket = _bucket(hashes, buckets)
                order = np.argsort(bucket, kind="stable")
                bucket, hashes, place = bucket[order], hashes[order], places[order]
                ends = np.flatnonzero(np.diff(bucket, append=buckets + 1)) + 1
                columns = [pa.array(bucket[ends - 1].astype(np.int64)), pa.array(np.full(len(ends), name.as_py(), np.int64)), _packed(hashes.astype("<u4"), ends), _packed(place.astype("<u2"), ends), _packed((place >> 16).astype("<u2"), ends)]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "slice", "hashes", "p_low", "p_high"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, table = None, np.zeros(0, "<u4")
        for batch in batches:
            names, found = [], []
            for row in range(batch.num_rows):
                own = (batch["bucket"][row].as_py(), batch["salt"][row].as_py())
                if batch["slice"][row].as_py() is None:
                    key, table = own, np.frombuffer(batch["repeated"][row].as_py(), "<u4")
                elif own == key:
                    hashes, p_low, p_high = (np.frombuffer(batch[c][row].as_py(), k) for c, k in (("hashes", "<u4"), ("p_low", "<u2"), ("p_high", "<u2")))
                    hit = table[np.minimum(np.searchsorted(table, hashes), len(table) - 1)] == hashes
                    if hit.any():
                        names.append(batch["slice"][row].as_py())
                        found.append((p_low[hit].astype("<u4") | (p_high[hit].astype("<u4") << np.uint32(16))).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(found, pa.binary())], names=["slice", "places"])

    parts = slice_rows.select("slice", "sizes", "packed").mapInArrow(per_slice, "bucket bigint, slice bigint, hashes binary, p_low binary, p_high binary")
    large = F.broadcast(repeated.filter("salts > 1").select("bucket", "salts"))  # MOST_LARGE rows at most
    salted = parts.join(large, "bucket", "left").withColumn("salt", F.pmod(F.xxhash64("slice"), F.coalesce("salts", F.lit(1)))).drop("salts")
    tables = repeated.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts").cast("long") - 1)).alias("salt"), "repeated")
    both = salted.unionByName(tables, allowMissingColumns=True)
    ordered = both.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", F.col("slice").asc_nulls_first())
    return ordered.mapInArrow(match, "slice bigint, places binary")


def window_digests(slice_rows: DataFrame, size: int) -> DataFrame:
    """(d1, d2, doc, start) of the windows at ``places`` (packed lists), over ``sliced`` rows with them.

    d1 and d2 are the 128 bits of the BLAKE2b digest of the window's words, joined by a space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, sizes, packed, places in zip(batch["doc"], batch["sizes"], batch["packed"], batch["places"], strict=True):
                lists, before = _words(_texts(sizes, packed))
                place = np.sort(_unpacked(places.values, "<u4").astype(np.int64))
                joined = b" ".join(chain.from_iterable(lists))
                lengths = np.fromiter(map(len, chain.from_iterable(lists)), np.int64, before[-1])
                ends = np.cumsum(lengths + 1) - 1
                first, last = (ends[place] - lengths[place]).tolist(), ends[place + size - 1].tolist()
                digest = np.frombuffer(b"".join(hashlib.blake2b(joined[a:b], digest_size=16).digest() for a, b in zip(first, last, strict=True)), np.int64)
                row = np.searchsorted(before, place, side="right") - 1
                columns = [pa.array(digest[::2]), pa.array(digest[1::2]), pa.array(docs.values.to_numpy()[row]), pa.array(place - before[row], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["d1", "d2", "doc", "start"])

    return slice_rows.select("doc", "sizes", "packed", "places").mapInArrow(run, "d1 bigint, d2 bigint, doc bigint, start int")


def later_windows(slice_rows: DataFrame, size: int, n_words: int, path: str) -> DataFrame:
    """(doc, starts), as a table at ``path``, of the windows whose word sequence also starts earlier in
    the ``sliced`` texts.

    Nothing is gathered but what one slice or one document holds. Repeated windows are joined
    with their first places in a join that adaptive execution can split where a passage is
    very common.
    """
    spark = slice_rows.sparkSession
    where, buckets = shared_folder(spark, "windows"), max(1, -(-n_words // BUCKET_WINDOWS))
    repeated = written(counted(slice_rows, size, buckets, max(TASK_PLACES, n_words // MOST_LARGE)), f"{where}-hashes")
    # Tables rather than checkpoints: their jobs' shuffle files are dropped at once.
    listed = written(places_of(slice_rows, repeated, size, buckets).groupBy("slice").agg(F.collect_list("places").alias("places")), f"{where}-places")  # of one slice
    remove_folder(spark, f"{where}-hashes")

    found = written(window_digests(slice_rows.join(listed, "slice"), size), where)
    first = found.groupBy("d1", "d2").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("times")).filter("times > 1").select("d1", "d2", "first")
    first = written(first, f"{where}-first")  # so that the join shuffles both sides anew, and may split a hot window
    late = found.join(first, ["d1", "d2"]).filter(F.struct("doc", "start") > F.col("first"))
    starts = written(late.groupBy("doc").agg(F.collect_list("start").alias("starts")), path)
    for name in (where, f"{where}-first", f"{where}-places"):
        remove_folder(spark, name)
    return starts


# -- removal ------------------------------------------------------------------------------


def covered(starts: np.ndarray, n_words: int, size: int) -> np.ndarray:
    """Which words the windows cover: the union of maximal intervals."""
    change = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + size, -1)
    return np.cumsum(change[:-1]) > 0


def _kept_words(text: bytes, starts: np.ndarray, size: int) -> tuple[bytes, int]:
    words = text.split()
    gone = covered(starts, len(words), size)
    return b" ".join(w for w, g in zip(words, gone, strict=True) if not g), int(gone.sum())


def _cut(texts: DataFrame, size: int, full: bool) -> DataFrame:
    """(id, k, n_removed, kept_sha256[, kept_text]) over (id, k, text, starts)."""
    names = ["id", "k", "n_removed", "kept_sha256", *(["kept_text"] if full else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, digests, kept = [], [], []
            for text, starts in zip(batch["text"].cast(pa.binary()), batch["starts"], strict=True):
                rest, n = _kept_words(text.as_py(), starts.values.to_numpy(), size)
                removed.append(n)
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest.decode())
            columns = [batch["id"], batch["k"], pa.array(removed, pa.int64()), pa.array(digests, pa.string()), *([pa.array(kept, pa.string())] if full else [])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return texts.mapInArrow(run, "id bigint, k bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * full)


def _with_order(firsts: DataFrame, unique: bool) -> DataFrame:
    """(doc, doc_id, key, text): ``doc`` orders the documents, by doc_id and null ids last.

    Where ids are unique they are that order. Otherwise rows are numbered by id and text key.
    """
    if unique:
        return firsts.select(F.col("doc_id").alias("doc"), "doc_id", "key", "text")
    keys = firsts.select("doc_id", "key")
    numbered = running_totals(keys, [F.col("doc_id").asc_nulls_last(), F.col("key")], doc=F.lit(1)).withColumnsRenamed({"doc_id": "id", "key": "k"})
    return checkpointed(firsts.join(numbered, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("k"))).select("doc", "doc_id", "key", "text"))


def substring_dedup(docs: DataFrame, size: int = WINDOW_WORDS, full: bool = False) -> DataFrame:
    """doc_id, key, n_words, n_removed and kept_sha256 of every row of ``docs`` (doc_id, text).

    A word goes if a window of ``size`` words covers it whose word sequence also starts
    earlier: in a smaller doc_id (null ids last, rows that share an id by text key), or in the
    same document before. Windows are judged on the input. Null text has no words, a text
    shorter than a window loses none, and of rows equal in id and text one counts as the
    first. Other columns are ignored and an empty table gives an empty result. With ``full``,
    kept_text holds the words that stay, where any were removed (otherwise it is null).
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = sequences(base).groupBy("doc_id", "key", "n_words", "seq").agg(F.count("*").alias("rows"))
    rows = checkpointed(rows)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    firsts = rows.groupBy("seq").agg(F.min(order).alias("first"))
    judged = checkpointed(rows.join(firsts, "seq").withColumn("is_first", order == F.col("first")).drop("first"))

    # Later copies of a whole sequence, and repeated rows, take no part in the search.
    copies = judged.select("doc_id", "key", F.col("is_first").alias("kept")).union(judged.filter("rows > 1").select("doc_id", "key", F.lit(False)))
    taking_part = keep_rows(base, checkpointed(copies)).select("doc_id", "text", text_key(F.col("text")).alias("key"))
    seen = judged.filter("is_first").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"), F.sum("n_words").alias("words")).first()
    spark, where = docs.sparkSession, shared_folder(docs.sparkSession, "slices")
    held = written(sliced(_with_order(taking_part.filter("text is not null"), seen["n"] == seen["ids"])), where)

    starts = later_windows(held, size, seen["words"] or 0, f"{where}-starts")
    texts = unsliced(held)
    cut = screened(texts, F.col("doc"), starts.select(F.col("doc").alias("key"))).filter("__hit").join(starts, "doc")
    changed = checkpointed(_cut(cut.select(F.col("doc_id").alias("id"), F.col("key").alias("k"), "text", "starts"), size, full))
    remove_folder(spark, where)
    remove_folder(spark, f"{where}-starts")

    names = ["n_removed", "kept_sha256", *(["kept_text"] if full else [])]
    out = judged.join(changed, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("k")), "left")
    out = out.select("doc_id", "key", "n_words", "seq", F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("copy"), "is_first", *names)
    copy = (~F.col("is_first") | (F.col("copy") > 1)) & (F.col("n_words") >= size)
    result = {
        "n_removed": F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        "kept_sha256": F.when(copy, F.lit(EMPTY_SHA256)).otherwise(F.coalesce("kept_sha256", "seq")).alias("kept_sha256"),
        "kept_text": F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text") if full else None,
    }
    return out.select("doc_id", "key", "n_words", *(result[n] for n in names))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
