"""Packing tokenised documents into fixed-length sequences by cutting-stock column generation.

Documents longer than a sequence are cut into whole sequences and a remainder. The lengths of
all pieces form a histogram of at most ``capacity / grain`` classes, whatever the corpus size:
only this histogram reaches the driver, where a linear program over patterns (how many pieces
of each class share a sequence) is solved by column generation, a knapsack dynamic program
pricing new patterns. The patterns' uses are rounded down, first-fit decreasing over the few
pieces left over completes them, and pieces, ranked within their class in Spark, are assigned
to the patterns' slots by that rank.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docstrata.llm.common import checkpointed

CAPACITY = 2048
#: Lengths are rounded up to multiples of this in the linear program.
GRAIN = 8
#: The id that ends every document.
END_ID = 1
#: Pieces of a class that one task ranks about.
RANK_ROWS = 1_024

PIECES = "doc_id bigint, row_key bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


# -- tokens -------------------------------------------------------------------------------


@lru_cache(maxsize=2)
def _encoder(ranks: str, pattern: str, contract: str):
    """Encoder of the ids that ``contract``, a tokenizers file, gives without special tokens.

    Its added tokens have one id wherever their string stands in a text, and the text before
    and after is encoded by itself; all else are byte-pair merges by rank.
    """
    import tiktoken

    with open(ranks, "rb") as f:
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    with open(contract, encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    return partial(tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=merges, special_tokens=added).encode, allowed_special="all")


def public_vocabulary() -> tuple[str, str, str]:
    """Where byte_bpe_50k lies as ranks, its pattern, and the tokenizers file whose ids are meant.

    The ranks give the ids of byte_bpe_50k.json, four times as fast as the tokenizers library
    (the tests compare them over every character, added tokens and all standard texts).
    """
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.json")


def tokenised(docs: DataFrame, vocabulary: tuple[str, str, str] | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of each document: all but the last have ``capacity`` tokens."""
    where = vocabulary or public_vocabulary()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(*where)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, key, text in zip(batch["doc_id"].to_pylist(), batch["row_key"].to_pylist(), batch["text"], strict=True):
                ids = np.array([*encode(text.as_py() or ""), END_ID], dtype="<u4")
                for at in range(0, len(ids), capacity):
                    part = ids[at : at + capacity]
                    out.append((doc_id, key, at, len(part), zlib.crc32(part.tobytes()), len(ids)))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "row_key", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(pieces, PIECES)


# -- the linear program -------------------------------------------------------------------


def price(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Most valuable pattern: how many of each size 1..len(values) fit into ``capacity``.

    An unbounded knapsack over capacities; the best choice at each capacity is found over all
    sizes at once.
    """
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        k = min(c, len(values))
        got = best[c - k : c][::-1] + values[:k]  # size s leaves capacity c - s
        i = int(np.argmax(got))
        if got[i] > best[c - 1]:
            best[c], choice[c] = got[i], i + 1
        else:
            best[c] = best[c - 1]
    pattern, c = np.zeros(len(values), dtype=np.int64), capacity
    while c > 0:
        if choice[c]:
            pattern[choice[c] - 1] += 1
            c -= choice[c]
        else:
            c -= 1
    return float(best[capacity]), pattern


def inverse_of(matrix: np.ndarray) -> np.ndarray:
    """Inverse by Gauss-Jordan elimination with pivots, in one thread.

    LAPACK's threads can hang in a process that also hosts Spark's gateway.
    """
    n = len(matrix)
    work = np.hstack([matrix.astype(float), np.eye(n)])
    for i in range(n):
        pivot = i + int(np.argmax(np.abs(work[i:, i])))
        if pivot != i:
            work[[i, pivot]] = work[[pivot, i]]
        work[i] /= work[i, i]
        factors = work[:, i].copy()
        factors[i] = 0
        work -= np.outer(factors, work[i])
    return work[:, n:]


def solve(demand: np.ndarray, capacity: int, gap: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
    """Basic solution (patterns as columns, uses) of: least sequences that cover ``demand``.

    ``demand[s - 1]`` counts pieces of size s. The revised simplex method starts from one
    pattern for each size; its dual values price the next pattern. The uses divided by the
    best pattern's worth, and the pieces' total size, are lower bounds of the optimum: it
    stops within ``gap`` of the better one, or once no pattern improves the basis, beyond the
    precision of its numbers: as often as that takes. Demands are shifted by tiny distinct
    amounts, so that no step is empty and the method can't cycle.
    """
    sizes = np.flatnonzero(demand)
    n = len(sizes)
    need = demand[sizes] + 1e-6 * (np.arange(n) + 1)
    basis = np.diag([float(capacity // (s + 1)) for s in sizes])
    inverse = np.diag(1 / np.diag(basis)) if n else np.zeros((0, 0))
    uses = inverse @ need
    bound = float((need * (sizes + 1)).sum()) / capacity
    turn, marked = 0, np.inf
    while n:
        turn += 1
        duals = inverse.sum(axis=0)  # every pattern costs one sequence
        values = np.zeros(len(demand))
        values[sizes] = np.maximum(duals, 0)
        worth, pattern = price(values, capacity)
        bound = max(bound, uses.sum() / max(worth, 1.0))
        if worth <= 1 + gap or uses.sum() <= bound * (1 + gap):
            break
        column = pattern[sizes].astype(float)
        step = inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, uses / step, np.inf)
        out = int(np.argmin(ratio))
        basis[:, out] = column
        if turn % 100 == 0:
            inverse = inverse_of(basis)
            uses = inverse @ need
            if turn % 1000 == 0:
                if uses.sum() >= marked * (1 - 1e-9):
                    break  # a thousand columns brought nothing
                marked = uses.sum()
        else:
            moved = inverse[out] / step[out]
            inverse -= np.outer(step, moved)
            inverse[out] = moved
            uses -= step * ratio[out]
            uses[out] = ratio[out]
    full = np.zeros((len(demand), n), dtype=np.int64)
    full[sizes] = np.rint(basis).astype(np.int64)
    return full, np.maximum(uses, 0)


def patterns_for(demand: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns {size: pieces} and how often each is used; together exactly the demand."""
    columns, uses = solve(demand, capacity)
    left = demand.astype(np.int64).copy()
    chosen: list[tuple[dict[int, int], int]] = []
    for j in np.argsort(-uses):
        held = np.flatnonzero(columns[:, j])
        times = int(uses[j] + 1e-9)
        if len(held):
            times = min(times, int((left[held] // columns[held, j]).min()))
        if times > 0 and len(held):
            left[held] -= times * columns[held, j]
            chosen.append(({int(s) + 1: int(columns[s, j]) for s in held}, times))
    while left.any():  # first-fit decreasing on what rounding left: fewer sequences than patterns
        room, pattern = capacity, {}
        for s in np.flatnonzero(left)[::-1]:
            fit = min(int(left[s]), room // (int(s) + 1))
            if fit:
                pattern[int(s) + 1] = fit
                room -= fit * (int(s) + 1)
        times = min(int(left[s - 1]) // k for s, k in pattern.items())
        for s, k in pattern.items():
            left[s - 1] -= times * k
        chosen.append((pattern, times))
    return chosen


# -- the operator -------------------------------------------------------------------------


def pack(docs: DataFrame, capacity: int = CAPACITY, grain: int = GRAIN, vocabulary: tuple[str, str, str] | None = None) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with the sequence and offset each goes to.

    Null text is empty; every document ends with id 1, so an empty one is a piece of length 1.
    Very long documents become many pieces. Repeated rows are packed as often as they occur
    (``row_key`` tells them apart); an empty table gives an empty result; other columns are
    ignored. No sequence holds more than ``capacity`` tokens, and each is padded to it.
    """
    spark = docs.sparkSession
    pieces = checkpointed(tokenised(docs, vocabulary, capacity).withColumn("size", F.ceil(F.col("length") / grain).cast("int")))
    units = capacity // grain
    counts = {r["size"]: r["n"] for r in pieces.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most ``units`` rows
    demand = np.zeros(units, dtype=np.int64)
    for s, n in counts.items():
        demand[s - 1] = n

    # The slots of a class, in ranges of ranks: each pattern takes uses x pieces of them.
    taken, base, slots = dict.fromkeys(counts, 0), 0, []
    for pattern, times in patterns_for(demand, units):
        place = 0
        for s, k in sorted(pattern.items(), reverse=True):
            slots.append((s, taken[s], taken[s] + times * k, base, times, place))
            taken[s] += times * k
            place += k
        base += times
    slot = spark.createDataFrame(slots, "size int, lo bigint, hi bigint, first bigint, times bigint, place int")

    # Rank within a class: hash salts of bounded size, and what the salts before hold.
    order = F.xxhash64("doc_id", "row_key", "start")
    salts = {s: max(1, -(-n // RANK_ROWS)) for s, n in counts.items()}
    salt_of = spark.createDataFrame([(s, n) for s, n in salts.items()], "size int, salts bigint")
    salted = pieces.join(F.broadcast(salt_of), "size").withColumn("salt", F.pmod(order, F.col("salts")))  # a row per class
    held = salted.groupBy("size", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = checkpointed(held.select("size", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")))
    within = Window.partitionBy("size", "salt").orderBy("doc_id", "row_key", "start")
    ranked = salted.withColumn("r", F.row_number().over(within) - 1).join(offsets, ["size", "salt"]).withColumn("rank", F.col("ahead") + F.col("r"))

    s, p = slot.alias("s"), ranked.alias("p")
    hit = (F.col("p.size") == F.col("s.size")) & (F.col("p.rank") >= F.col("s.lo")) & (F.col("p.rank") < F.col("s.hi"))
    placed = p.join(F.broadcast(s), hit).select(  # a few slots per class, whatever the corpus
        "p.doc_id", "row_key", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first") + (F.col("rank") - F.col("lo")) % F.col("times")).alias("sequence_id"),
        (F.col("place") + F.expr("div(rank - lo, times)")).alias("place"),
    )
    inside = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long").alias("offset"), "row_key")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
