"""Media columns: payloads stored as 8-bit samples in content-defined, deduplicated chunks.

A payload becomes a mono 8-bit WAV file. A rolling gear hash cuts its bytes where the content
says so, chunk digests are deduplicated by Spark joins, and a store holds every chunk once:
one row for each medium, with the ordered list of its chunks and the bytes of those that it
is the first to bring. Media are rebuilt from the store alone: from their own row and, for
chunks that others brought, by a join on the digest; every rebuilt medium is verified.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.llm.common import checkpointed, mixed, remove_folder, screened, shared_folder, written

BLOCK = 64
RATE = 8_000
#: Bytes of a chunk: at least, on average about, at most.
LEAST, MEAN_BITS, MOST = 512, 11, 16_384
HEADER = 44


# -- the stored form ----------------------------------------------------------------------


def payload_of(text: bytes) -> bytes:
    """The text's bytes with bytes 0 up to a positive multiple of 64."""
    return text + bytes(-len(text) % BLOCK or (0 if text else BLOCK))


def wav(payload: bytes) -> bytes:
    """RIFF/WAVE file of unsigned 8-bit mono samples: any byte is a sample, so nothing is lost."""
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 36 + len(payload), b"WAVE") + fmt + struct.pack("<4sI", b"data", len(payload)) + payload


def samples_of(media: bytes) -> bytes:
    """The samples of such a file, by its chunk headers."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at = 12
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def feature_of(samples: bytes) -> str:
    """Mean, root mean square and zero crossings of the samples around 128."""
    x = np.frombuffer(samples, dtype=np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"mean={x.sum() / len(x):.4f};rms={(int((x * x).sum()) / len(x)) ** 0.5:.4f};zero={crossings}"


# -- content-defined cuts -----------------------------------------------------------------


@lru_cache(maxsize=1)
def _gear() -> np.ndarray:
    return (mixed(np.arange(256, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """h[i] = 2 h[i-1] + gear[data[i]] modulo 2**32: a hash of the last 32 bytes.

    Sums over 2, 4, ... 32 bytes are each two shifted sums over half as many.
    """
    h, span = _gear()[data], 1
    while span < 32:
        h[span:] = h[span:] + (h[:-span] << np.uint32(span))
        span *= 2
    return h


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks: where the hash's top bits are zero, within the bounds on length."""
    if len(data) <= LEAST:
        return [len(data)]
    places = np.flatnonzero(gear_hashes(np.frombuffer(data, dtype=np.uint8)) >> np.uint32(32 - MEAN_BITS) == 0) + 1
    out, at = [], 0
    while at < len(data):
        i = int(np.searchsorted(places, at + LEAST))
        end = int(places[i]) if i < len(places) else len(data)
        at = min(end, at + MOST, len(data))
        out.append(at)
    return out


def chunks_of(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


# -- the store ----------------------------------------------------------------------------


def text_name(text: Column) -> Column:
    """SHA-256 of a text, as 32 bytes."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


def _listed(docs: DataFrame) -> DataFrame:
    """(doc_id, name, n_bytes, media_sha256, digests): what each row's medium is made of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, media_names, lists = [], [], []
            for text in batch["text"].cast(pa.binary()):
                data = text.as_py() or b""
                media = wav(payload_of(data))
                sizes.append(len(data))
                media_names.append(hashlib.sha256(media).digest())
                lists.append([hashlib.sha256(c).digest() for c in chunks_of(media)])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["name"], pa.array(sizes, pa.int64()), pa.array(media_names, pa.binary()), pa.array(lists, pa.list_(pa.binary()))],
                names=["doc_id", "name", "n_bytes", "media_sha256", "digests"],
            )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_name(F.col("text")).alias("name"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id bigint, name binary, n_bytes bigint, media_sha256 binary, digests array<binary>")


def _entries(media: DataFrame) -> DataFrame:
    """(media_sha256, digests, brought, own): a store row; ``own`` are the chunks at ``brought``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, lists, kept, own = [], [], [], []
            for text, foreign in zip(batch["text"].cast(pa.binary()), batch["foreign"], strict=True):
                data = wav(payload_of(text.as_py() or b""))
                parts, skip = chunks_of(data), set(foreign.as_py() or [])
                names.append(hashlib.sha256(data).digest())
                lists.append([hashlib.sha256(c).digest() for c in parts])
                kept.append([i for i in range(len(parts)) if i not in skip])
                own.append([parts[i] for i in kept[-1]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.binary()), pa.array(lists, pa.list_(pa.binary())), pa.array(kept, pa.list_(pa.int32())), pa.array(own, pa.list_(pa.binary()))],
                names=["media_sha256", "digests", "brought", "own"],
            )

    return media.mapInArrow(run, "media_sha256 binary, digests array<binary>, brought array<int>, own array<binary>")


def store_media(docs: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Write the chunk store of ``docs`` to ``path``; (rows, digests that several places share).

    Equal payloads are one medium. Of the media that hold a chunk, the one with the smallest
    SHA-256 brings it, at its first place there. Texts that occur once, and bring all their
    chunks, are stored where they are read: a bitmap of bounded size tells them for certain.
    Only the others are joined with what they lack.
    """
    rows = checkpointed(_listed(docs))
    media = checkpointed(rows.groupBy("media_sha256").agg(F.min("name").alias("lead"), F.count("*").alias("rows"), F.first("digests").alias("digests")))
    placed = media.select("media_sha256", F.posexplode("digests").alias("place", "digest"))
    bringer = placed.groupBy("digest").agg(F.min(F.struct("media_sha256", "place")).alias("bringer"), F.count("*").alias("uses"))
    shared = checkpointed(bringer.filter("uses > 1").select("digest", "bringer"))
    lacking = placed.join(shared, "digest").filter(F.struct("media_sha256", "place") != F.col("bringer")).groupBy("media_sha256").agg(F.collect_list("place").alias("foreign"))  # of one medium
    plan = checkpointed(media.join(lacking, "media_sha256", "left").select(F.col("lead").alias("name"), "media_sha256", "rows", "foreign"))

    odd = plan.filter("rows > 1 or foreign is not null").select("media_sha256")
    marked = screened(docs.select("text", text_name(F.col("text")).alias("name")), F.xxhash64("name"), rows.join(odd, "media_sha256", "left_semi").select(F.xxhash64("name").alias("key")))
    whole = marked.filter("not __hit").select("text", F.lit(None).cast("array<int>").alias("foreign"))
    joined = marked.filter("__hit").join(plan.select("name", "foreign"), "name")
    once = joined.groupBy("name").agg(F.first("text").alias("text"), F.first("foreign").alias("foreign")).select("text", "foreign")
    written(_entries(whole.union(once)), path)
    return rows, shared


def rebuilt(spark: SparkSession, path: str, shared: DataFrame) -> DataFrame:
    """(media_sha256, payload_bytes, payload_sha256, tail_crc32, media_bytes, feature) from the store.

    Rows that hold all their chunks are rebuilt where they are read. The others get what they
    lack by a join on the digest, gathered by medium.
    """
    store = spark.read.schema("media_sha256 binary, digests array<binary>, brought array<int>, own array<binary>").parquet(path)
    short = store.filter(F.size("brought") < F.size("digests"))
    missing = short.select("media_sha256", "brought", F.posexplode("digests").alias("place", "digest")).filter("not array_contains(brought, place)")
    brought = store.select(F.explode(F.arrays_zip(F.transform("brought", lambda p: F.element_at("digests", p + 1)).alias("digest"), F.col("own").alias("chunk"))).alias("c")).select("c.digest", "c.chunk")
    wanted = screened(brought, F.xxhash64("digest"), shared.select(F.xxhash64("digest").alias("key"))).filter("__hit").select("digest", "chunk")
    found = missing.join(wanted, "digest").groupBy("media_sha256").agg(F.collect_list(F.struct("place", "chunk")).alias("others"))  # of one medium
    none = F.lit(None).cast("array<struct<place:int,chunk:binary>>")
    whole = store.filter(F.size("brought") == F.size("digests")).select("*", none.alias("others"))
    return _read_back(whole.union(short.join(found, "media_sha256").select(*store.columns, "others")))


def _read_back(store: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for name, digests, brought, own, others in zip(*(batch[c] for c in ("media_sha256", "digests", "brought", "own", "others")), strict=True):
                parts = dict(zip(brought.as_py(), own.as_py(), strict=True))
                parts |= {o["place"]: o["chunk"] for o in others.as_py() or []}
                listed = digests.as_py()
                ordered = [parts[i] for i in range(len(listed))]
                if any(hashlib.sha256(c).digest() != d for c, d in zip(ordered, listed, strict=True)):
                    raise ValueError(f"a chunk of medium {name.as_py().hex()} is corrupt")
                media = b"".join(ordered)
                if hashlib.sha256(media).digest() != name.as_py():
                    raise ValueError(f"medium {name.as_py().hex()} can't be rebuilt")
                samples = samples_of(media)
                out.append((name.as_py(), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-BLOCK:]), len(media), feature_of(samples)))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["media_sha256", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "feature"])

    return store.mapInArrow(run, "media_sha256 binary, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, feature string")


def media_columns(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and
    feature of each row of ``docs`` (doc_id, text), from what was stored and read back.

    Null text is empty, and an empty payload is 64 bytes 0. Equal texts are one medium and get
    equal values. Long texts are many chunks. Repeated rows stay repeated, an empty table gives
    an empty result, and further columns are ignored. ``path`` names the store to write; a
    store of this call's own is removed once its results are kept.
    """
    spark = docs.sparkSession
    where = path or shared_folder(spark, "media")
    rows, shared = store_media(docs, where)
    found = checkpointed(rebuilt(spark, where, shared))
    if path is None:
        remove_folder(spark, where)
    return rows.join(found, "media_sha256").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", F.lower(F.hex("media_sha256")).alias("media_sha256"), "feature")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"))
