"""Small helpers that the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docstrata.lineage import shared_top as _shared_top

#: Words are maximal runs of characters other than these blanks (space and U+0009 to U+000D).
BLANKS = r"\x20\x09-\x0D"
WORD = rf"[^{BLANKS}]+"

#: Settings of the jobs that write checkpoints and tables: a batch has at most so many rows and
#: about so many bytes (a single longer text is a batch of its own).
LEAN = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}

#: Numpy works on slices of a batch of about so many bytes, so that a worker's memory stays flat.
SLICE_BYTES = 1 << 20


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the cluster's shared folder.

    The shuffle files of the job that wrote it are of no more use then, so Spark is asked to
    drop them: they would otherwise fill the disks. The checkpoint's own files go with the
    DataFrame where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    _shared_top(df.sparkSession)
    with _lean(df.sparkSession):
        return df.checkpoint(eager=True)


@contextmanager
def _lean(spark: SparkSession) -> Iterator[None]:
    """Jobs drop their shuffle files when done, and Python workers get batches of bounded bytes."""
    before = {k: spark.conf.get(k) for k in LEAN}
    for k, v in LEAN.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a table, where driver and executors can see it."""
    return f"{_shared_top(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a compressed table at ``path``, read again: for rows too many to checkpoint."""
    spark = df.sparkSession
    with _lean(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables for the time of a block: the function writes a DataFrame under a name; all go at the end, also after an error."""
    folders: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        folders.append(shared_folder(spark, name))
        return written(df, folders[-1])

    try:
        yield keep
    finally:
        for folder in folders:
            remove_folder(spark, folder)


def shared_file(spark: SparkSession, name: str, data: bytes) -> str:
    """The path of a file of ``data`` in the shared folder, written by Spark's own file system unless it is there.

    ``name`` must depend on the data alone. The file stays as long as the folder does, so that
    executors that come later can fetch it.
    """
    path = f"{_shared_top(spark).rstrip('/')}/{name}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(at):
        out = store.create(at, True)
        for i in range(0, len(data), 1 << 20):
            out.write(bytearray(data[i : i + (1 << 20)]))
        out.close()
    return path


def remove_folder(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def words_in(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def text_key(text: Column) -> Column:
    """64-bit key that tells apart rows which share a doc_id; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def running_totals(df: DataFrame, order: list[Column], **values: Column) -> DataFrame:
    """Exclusive running totals of ``values`` over all rows in the given order.

    Rows are dealt out by range, each partition is summed alone, and only one row per
    partition goes through the window that turns the sums into offsets.
    """
    ranged = checkpointed(df.select("*", *(v.cast("long").alias(f"__v_{k}") for k, v in values.items())).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("__part")
        .agg(*(F.sum(f"__v_{k}").alias(f"__t_{k}") for k in values))
        .select("__part", *(F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__o_{k}") for k in values))
    )
    inner = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(offsets), "__part")  # one row per partition
    return out.select(*df.columns, *((F.col(f"__o_{k}") + F.coalesce(F.sum(f"__v_{k}").over(inner), F.lit(0))).alias(k) for k in values))


#: Into how many parts `salted_join` splits each key.
SALTS = 16


def salted_join(rows: DataFrame, table: DataFrame, key: str, row_id: str, how: str = "inner") -> DataFrame:
    """Inner or left join on ``key`` where one key may have a large share of ``rows``, and few rows of ``table``.

    Rows are dealt to ``SALTS`` parts of their key by their ``row_id``; each part meets a copy of
    the table's row. The copies, which Spark's estimate does not count, are never broadcast.
    """
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(row_id), F.lit(SALTS)).cast("int"))
    copied = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copied.hint("merge"), [key, "__salt"], how).drop("__salt")


# -- bounded bitmaps ----------------------------------------------------------------------

#: Bits of a screening bitmap (2 to this power: 1 MB) and of one of its pages.
SCREEN_BITS, PAGE_BITS = 23, 15


def screened(df: DataFrame, key: Column, keys: DataFrame, bits: int = SCREEN_BITS) -> DataFrame:
    """``df`` with ``__hit``: false proves that the row's ``key`` is not among ``keys`` (long key).

    The keys set bits of one bitmap whose size is fixed, however many they are: its pages (at
    most 2**(bits - 15) rows of 4 KB) are what is broadcast. A true hit may be wrong, so hits
    need an exact join; the point is that rows without a hit need no shuffle.
    """
    mask, page = F.lit((1 << bits) - 1), F.lit((1 << PAGE_BITS) - 1)
    bit = F.col("key").bitwiseAND(mask)
    pages = checkpointed(
        keys.select(F.shiftright(bit, PAGE_BITS).alias("__page"), bit.bitwiseAND(page).alias("b"))
        .groupBy("__page")
        .agg(F.bitmap_construct_agg("b").alias("__bits"))
    )
    at = F.col("__key").bitwiseAND(mask)
    placed = df.withColumn("__key", key).withColumn("__page", F.shiftright(at, PAGE_BITS))
    joined = placed.join(F.broadcast(pages), "__page", "left")  # a fixed number of pages
    within = at.bitwiseAND(page)
    byte = F.conv(F.hex(F.substring("__bits", F.shiftright(within, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    shift = F.element_at(F.array(*(F.lit(1 << i) for i in range(8))), (within % 8).cast("int") + 1)
    return joined.select(*df.columns, F.coalesce(byte.bitwiseAND(shift) != 0, F.lit(False)).alias("__hit"))


def keep_rows(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept by ``decided`` (doc_id, key, kept: a row for each row).

    Rows are matched by doc_id and text key. Most rows were not dropped, as a bitmap of the
    dropped keys proves without a shuffle; only the others are joined. Of rows that share both
    id and text, one stays if one is kept.
    """
    row = docs.select(F.struct(*docs.columns).alias("doc"))
    marked = screened(row, text_key(F.col("doc.text")), decided.filter("not kept").select("key"))
    kept = decided.filter("kept").select(F.col("doc_id").alias("id"), "key")
    maybe = marked.filter("__hit").select("doc", text_key(F.col("doc.text")).alias("doc_key"))
    held = maybe.join(kept, F.col("doc.doc_id").cast("long").eqNullSafe(F.col("id")) & (F.col("doc_key") == F.col("key")), "left_semi")
    once = held.groupBy(F.col("doc.doc_id").alias("id"), "doc_key").agg(F.first("doc").alias("doc"))
    return marked.filter("not __hit").select("doc.*").union(once.select("doc.*"))


# -- Arrow batches as flat bytes ----------------------------------------------------------


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column, and where each value begins and ends; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of values of about ``most`` bytes; one long value stays whole."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = j


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Well-mixed 64-bit hash of 64-bit values (the splitmix64 finaliser)."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64; the longest table so far is kept."""
    if len(_POWERS.get(base, ())) < n:
        out = np.full(max(n, SLICE_BYTES + 1), np.uint64(base))
        out[0] = 1
        _POWERS[base] = np.multiply.accumulate(out)
    return _POWERS[base][:n]


_POWERS: dict[int, np.ndarray] = {}


_BYTE_BASE = 0xD6E8FEB86659FD93


def rolling(values: np.ndarray, begins: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Rabin-Karp hash (modulo 2**64, then mixed) of each range of ``values``.

    Prefix sums of value times power give any range's hash by one subtraction; the inverse
    power moves it to position 0, so that equal ranges have equal hashes wherever they stand.
    """
    with np.errstate(over="ignore"):
        total = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(base, len(values)), out=total[1:])
        back = powers(pow(base, -1, 1 << 64), len(values) + 1)
        return mixed((total[ends] - total[begins]) * back[begins])


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end (bytes) of every word of the values, and the number of words before each value."""
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    before = np.empty(len(data), dtype=bool)
    if len(data):
        before[0] = False
        before[1:] = solid[:-1]
        before[offsets[:-1][offsets[:-1] < len(data)]] = False
    begins = np.flatnonzero(solid & ~before)
    after = np.empty(len(data), dtype=bool)
    if len(data):
        after[-1] = False
        after[:-1] = solid[1:]
        last = offsets[1:] - 1
        after[last[last >= 0]] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return begins, ends, np.searchsorted(begins, offsets)


def word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return rolling(data, begins, ends, _BYTE_BASE)
