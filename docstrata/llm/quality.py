"""Quality classifier: naive Bayes features in a linear hinge-loss model.

Texts are sets of hashed n-grams: words, pairs of words, and pairs and triples of word shapes,
with levels of how often shapes and immediate repeats occur. Each indicator is scaled by its
class log-count ratio, the scaled vectors are brought to length one, and a linear support
vector machine over them is fitted by dual coordinate descent. A logistic curve, fitted on
rows that the machine has not seen, turns margins into scores.

The fit takes a bounded sample of labelled rows, drawn by hash, to the driver as n-gram
numbers; scoring reads every whole text where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.llm.common import checkpointed, flat, mixed, slices, split_words, word_hashes

FEATURE_BITS = 18
#: Labelled rows that the model is fitted on at most, and features of all of them together: a row
#: is taken whole or not at all, and a text has at most 2**FEATURE_BITS features.
FIT_ROWS, FIT_FEATURES = 6_000, 16_000_000
#: Share of them that the logistic curve is fitted on.
CURVE_SHARE = 0.25
#: The descent ends when no projected gradient is larger than the tolerance; the bound of epochs is not met in practice.
COST, TOLERANCE, EPOCHS = 1.0, 2e-3, 1_000
THRESHOLD = 0.3


# -- n-grams ------------------------------------------------------------------------------

#: Byte classes: small letters and bytes of other scripts, capitals, digits; others are themselves.
_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[97:123], _CLASS[128:], _CLASS[65:91], _CLASS[48:58] = 1, 1, 2, 3


def _named(kind: int, values: np.ndarray) -> np.ndarray:
    return (mixed(values, kind) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def _shapes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for the look of each word: its first byte, its last three, and its length."""
    last = [_CLASS[data[np.maximum(ends - k, begins)]] for k in (1, 2, 3)]
    size = np.minimum(np.log2(ends - begins + 1), 7).astype(np.uint64) // np.uint64(2)
    return _CLASS[data[begins]] | (last[0] << np.uint64(8)) | (last[1] << np.uint64(16)) | (last[2] << np.uint64(24)) | (size << np.uint64(32))


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, feature): the distinct features of each value, sorted by value."""
    begins, ends, before = split_words(data, offsets)
    n = np.diff(before)
    row = np.repeat(np.arange(len(n)), n)
    words, looks = word_hashes(data, begins, ends), _shapes(data, begins, ends)
    pair, triple = row[1:] == row[:-1], row[2:] == row[:-2]
    three = np.uint64(0x9E3779B97F4A7C15)
    looks2 = looks[:-1] * three + looks[1:]
    found = [
        (row, _named(1, words)),
        (row[1:][pair], _named(2, words[:-1][pair] * three + words[1:][pair])),
        (row[1:][pair], _named(3, looks2[pair])),
        (row[2:][triple], _named(4, (looks2[:-1] * three + looks[2:])[triple])),
    ]
    # Levels: the share of words with this look, and of words that repeat the one before.
    key, count = np.unique(row * (1 << 20) + (mixed(looks) >> np.uint64(44)).astype(np.int64), return_counts=True)
    owner = key >> 20
    level = np.ceil(8 * count / n[owner]).astype(np.int64)
    found.append((owner, _named(5, (((key & 0xFFFFF) << 4) | level).astype(np.uint64))))
    again = np.bincount(row[1:][pair & (words[1:] == words[:-1])], minlength=len(n))
    found.append((np.arange(len(n)), _named(6, np.ceil(8 * again / np.maximum(n, 1)).astype(np.uint64))))
    both = np.unique(np.concatenate([(r << FEATURE_BITS) | f for r, f in found]))
    return both >> FEATURE_BITS, both & ((1 << FEATURE_BITS) - 1)


# -- the model ----------------------------------------------------------------------------


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """log of (smoothed share of a feature in class 1 / in class 0)."""
    counts = np.ones((2, 1 << FEATURE_BITS))
    for features, label in zip(rows, y, strict=True):
        counts[int(label), features] += 1
    shares = counts / counts.sum(axis=1, keepdims=True)
    return np.log(shares[1] / shares[0])


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, epochs: int = EPOCHS, seed: int = 0) -> np.ndarray:
    """Weights (the bias last) of the L2-regularised hinge loss.

    Every row has a dual variable between 0 and its cost; each step sets one of them to its
    optimum with the others fixed, while w = sum(alpha * y * x) is kept up to date. It ends when
    no step could gain more than the tolerance allows.
    """
    w = np.zeros((1 << FEATURE_BITS) + 1)
    alpha, sign = np.zeros(len(rows)), np.where(y > 0, 1.0, -1.0)
    square = np.array([float(v @ v) + 1.0 for v in values])
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in random.permutation(len(rows)):
            gradient = sign[i] * (w[rows[i]] @ values[i] + w[-1]) - 1
            at_bound = alpha[i] <= 0 and gradient > 0 or alpha[i] >= cost[i] and gradient < 0
            worst = max(worst, 0.0 if at_bound else abs(gradient))
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[rows[i]] += step * sign[i] * values[i]
                w[-1] += step * sign[i]
        if worst < TOLERANCE:
            break
    return w


def logistic_curve(margins: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(slope, shift) of the curve through margins, with smoothed targets, by Newton steps."""
    positive, negative = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    slope, shift = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + shift, -30, 30)))
        d, h = target - p, np.maximum(p * (1 - p), 1e-9)
        a, b, c = (h * margins**2).sum() + 1e-3, (h * margins).sum(), h.sum() + 1e-3
        g1, g2 = (d * margins).sum() - 1e-3 * (slope - 1), d.sum() - 1e-3 * shift
        det = a * c - b * b
        slope, shift = slope + (c * g1 - b * g2) / det, shift + (a * g2 - b * g1) / det
    return float(max(slope, 1e-6)), float(shift)


def _scaled(rows: list[np.ndarray], ratios: np.ndarray) -> list[np.ndarray]:
    return [(ratios[r] / max(np.sqrt((ratios[r] ** 2).sum()), 1e-9)).astype(np.float32) for r in rows]


class Model:
    """Ratios, weights times ratios, bias, and the logistic curve: all that scoring needs."""

    def __init__(self, rows: list[np.ndarray], y: np.ndarray):
        self.squares = np.zeros(1 << FEATURE_BITS, dtype=np.float32)
        self.weights = np.zeros(1 << FEATURE_BITS, dtype=np.float32)
        share = float((y.sum() + 1) / (len(y) + 2))
        self.bias, self.slope, self.shift = 0.0, 0.0, float(np.log(share / (1 - share)))
        if len(set(y.tolist())) < 2:
            return  # without both classes the score is the share of class 1
        apart = np.random.default_rng(1).random(len(y)) < CURVE_SHARE
        if len(set(y[apart].tolist())) < 2 or len(set(y[~apart].tolist())) < 2:
            apart = np.zeros(len(y), dtype=bool)
        learn = np.flatnonzero(~apart)
        chosen = [rows[i] for i in learn]
        ratios = log_count_ratios(chosen, y[learn])
        weight = np.where(y[learn] > 0, 0.5 / y[learn].mean(), 0.5 / (1 - y[learn].mean()))
        w = dual_coordinate_descent(chosen, _scaled(chosen, ratios), y[learn], COST * weight)
        self.squares, self.weights, self.bias = (ratios**2).astype(np.float32), (w[:-1] * ratios).astype(np.float32), float(w[-1])
        check = np.flatnonzero(apart) if apart.any() else learn
        margins = np.array([self.weights[rows[i]].sum() / max(np.sqrt(self.squares[rows[i]].sum()), 1e-9) + self.bias for i in check])
        self.slope, self.shift = logistic_curve(margins, y[check])

    def scores(self, owner: np.ndarray, features: np.ndarray, n: int) -> np.ndarray:
        total = np.bincount(owner, self.weights[features], minlength=n)
        length = np.sqrt(np.bincount(owner, self.squares[features], minlength=n))
        return 1 / (1 + np.exp(-np.clip(self.slope * (total / np.maximum(length, 1e-9) + self.bias) + self.shift, -30, 30)))


# -- on Spark -----------------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 0 modulo 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _vectors(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch["text"])
            for i, j in slices(offsets):
                owner, features = ngrams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ends = np.searchsorted(owner, np.arange(j - i + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(features, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch["id"].slice(i, j - i), batch["label"].slice(i, j - i), lists], names=["id", "label", "features"])

    return texts.mapInArrow(run, "id bigint, label int, features array<int>")


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", fit_rows: int = FIT_ROWS) -> Model:
    """Model of ``labels`` (doc_id, target 0/1) over ``docs`` (doc_id, text).

    Rows without a label or id, and ids with contradicting labels, teach nothing; neither do
    held-out ids. Of the rest, the ``fit_rows`` ids with the smallest hashes are taken, and the
    smallest of the texts of an id that several rows share; of these as many as have
    ``FIT_FEATURES`` features together. Null text is empty, long texts teach whole, and empty
    tables give a model that scores 0.5.
    """
    one = labels.filter(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min(target).alias("label"), F.max(target).alias("most"))
    chosen = one.filter("label = most").select(F.col("doc_id").alias("id"), F.col("label").cast("int").alias("label")).orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))  # at most fit_rows ids
    once = texts.groupBy(F.col("id").cast("long").alias("id"), "label").agg(F.min("text").alias("text"))
    vectors = checkpointed(_vectors(once).withColumn("place", F.xxhash64("id")))
    sizes = vectors.select("place", "id", F.size("features").alias("n")).orderBy("place", "id").toPandas()  # at most fit_rows
    whole = sizes[sizes["n"].cumsum() <= FIT_FEATURES]
    got = vectors.join(F.broadcast(docs.sparkSession.createDataFrame([(int(i),) for i in whole["id"]], "id bigint")), "id").orderBy("place", "id").select("label", "features").toPandas()
    return Model([np.asarray(f, dtype=np.int32) for f in got["features"]], got["label"].to_numpy(dtype=np.int64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``docs`` (doc_id, text).

    Null text is empty; empty texts are scored like any other, by the level features that they
    still have. Texts of any length are read whole; repeated rows get equal scores; an empty
    table gives an empty result, and further columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch["text"])
            out = np.zeros(len(offsets) - 1)
            for i, j in slices(offsets):
                owner, features = ngrams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                out[i:j] = shared.value.scores(owner, features, j - i)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(out)], names=["doc_id", "score"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    scored = checkpointed(narrow.mapInArrow(run, "doc_id bigint, score double"))  # in batches of bounded bytes
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return score(docs, fit(docs, labels))
