"""Hard-negative mining over one-dimensional distance keys.

Inner products become distances: every vector gets one further component that brings all of
them to the same length, and an anchor has 0 there, so that a higher score is a smaller
distance. Each vector is filed under its nearest pivot; the index is a table sorted by (pivot,
distance to it), in blocks of consecutive rows. By the triangle inequality, whatever lies
within a radius of an anchor lies in one interval of distances for every pivot. A search scans
the blocks of those intervals, takes a larger radius and scans what that adds, until the last
row it asks for is within the radius that was scanned, or the radius passes the lowest score
that it takes. Bounds are floating point with a margin; scores are exact integers.

Anchors that are neighbours in the index are searched together, in groups of bounded size, so
that a block is read once for a group. Which blocks an interval meets is an equality join on
cells of the distance range.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docstrata.llm.common import checkpointed, running_totals

#: Rows of a block, and of a stretch of the index whose anchors are searched together.
BLOCK, STRETCH = 1024, 32_768
#: The pivots are fitted on so many rows at most, by hash; there are so many at most.
FIT_ROWS, MOST_PIVOTS = 4096, 128
#: Components are multiplied by this and rounded down; larger results than the limit are cut to it.
SCALE, LIMIT = 256.0, 1 << 26
#: Anchors have ids divisible by the first; where the second divides an id, the label moves on by one of ten.
ANCHOR, MOVED, LABELS = 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
#: A negative has from 50 to 95 hundredths of the positive's score.
LOW, HIGH = 50, 95
#: Cells of the distance range for each pivot; anchors whose scores are computed at once.
CELLS, AT_ONCE = 256, 256
NO_ID = (1 << 63) - 1
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def prepared(rows: DataFrame) -> DataFrame:
    """(row_id, id, label, vec): the rows that take part, as integers, with the moved labels."""
    vec = F.col("embedding").cast("array<double>")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    cut = F.transform(vec, lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(x * SCALE))).cast("int"))
    moved = F.when(F.col("vec_id") % MOVED == 0, (F.col("label").cast("long") + 1) % LABELS).otherwise(F.col("label").cast("long"))
    some = rows.filter(F.col("label").isNotNull() & vec.isNotNull() & finite)
    return some.select(F.monotonically_increasing_id().alias("row_id"), F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("id"), moved.alias("label"), cut.alias("vec"))


# -- the index ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Pivots:
    """The pivots (with the further component), the squared length all vectors are brought to, and the sample's rows."""

    points: np.ndarray
    square: float

    def distances(self, vectors: np.ndarray, further: np.ndarray) -> np.ndarray:
        """Of each vector, with its further component, to each pivot."""
        whole = np.concatenate([vectors, further[:, None]], axis=1)
        squares = (whole**2).sum(axis=1)[:, None] + (self.points**2).sum(axis=1)[None, :] - 2 * whole @ self.points.T
        return np.sqrt(np.maximum(squares, 0))

    def further(self, vectors: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.square - (vectors**2).sum(axis=1), 0))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows of one matrix; shorter ones are filled up with 0."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return values.reshape(-1, width).astype(np.float64)
    out = np.zeros((len(sizes), width))
    at = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[at] = values
    return out


def fit_pivots(rows: DataFrame, width: int, square: float, n: int) -> Pivots:
    """About the square root of the number of blocks, as the centres of a bounded sample by a few rounds of k-means."""
    sample = rows.orderBy(F.xxhash64("id"), "id", "row_id").select("vec").limit(FIT_ROWS).toArrow()
    vectors = _matrix(sample["vec"].combine_chunks(), width)
    base = Pivots(np.zeros((1, width + 1)), square)
    whole = np.concatenate([vectors, base.further(vectors)[:, None]], axis=1)
    k = int(min(MOST_PIVOTS, max(1, round((n / BLOCK) ** 0.5)), len(whole)))
    points = whole[np.linspace(0, len(whole) - 1, k).astype(int)]
    for _ in range(5):
        near = Pivots(points, square).distances(whole[:, :-1], whole[:, -1]).argmin(axis=1)
        points = np.array([whole[near == i].mean(axis=0) if (near == i).any() else points[i] for i in range(k)])
    return Pivots(points, square)


def filed(rows: DataFrame, pivots: Pivots, width: int) -> DataFrame:
    """``rows`` with (pivot, key): the nearest pivot and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch["vec"], width)
            far = pivots.distances(vectors, pivots.further(vectors))
            near = far.argmin(axis=1) if len(far) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(far[np.arange(len(far)), near])], names=[*batch.schema.names, "pivot", "key"])

    return rows.mapInArrow(run, "row_id bigint, id bigint, label bigint, vec array<int>, pivot int, key double")


def _cells(low: Column, high: Column, width: float) -> Column:
    """The cells of the distance range that an interval meets."""
    return F.sequence(F.floor(F.greatest(low, F.lit(0.0)) / width), F.floor(F.greatest(high, F.lit(0.0)) / width))


@dataclass
class Index:
    """Blocks (pivot, block, low, high, rows), the same without rows, and what a search needs to know."""

    ranked: DataFrame
    blocks: DataFrame
    spans: DataFrame
    pivots: Pivots
    width: int
    cell: float


def indexed(rows: DataFrame) -> Index | None:
    """The index over ``rows`` (see `prepared`); None if there are none."""
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    n, width, longest = rows.agg(F.count("*"), F.max(F.size("vec")), F.max(square)).first()
    if not n:
        return None
    pivots = fit_pivots(rows, width, float(longest), n)
    ranked = checkpointed(running_totals(filed(rows, pivots, width), [F.col(c) for c in ("pivot", "key", "id", "row_id")], rank=F.lit(1)))
    grouped = ranked.groupBy("pivot", F.floor(F.col("rank") / BLOCK).alias("block"))
    one = F.struct("id", "row_id", "label", "vec")
    blocks = checkpointed(grouped.agg(F.min("key").alias("low"), F.max("key").alias("high"), F.sort_array(F.collect_list(one)).alias("rows")))  # BLOCK rows at most
    spans = checkpointed(blocks.select("pivot", "block", "low", "high"))
    far = 2 * float(longest) ** 0.5 + 1  # no two points are further apart
    return Index(ranked, blocks, spans, pivots, width, far / CELLS)


# -- searching ----------------------------------------------------------------------------


def _first(scores: np.ndarray, allowed: np.ndarray, k: int) -> list[np.ndarray]:
    """Per row, the columns of its ``k`` highest allowed scores; of equal ones the first columns."""
    out, any_allowed = [], allowed.any(axis=1)
    for row, mask, some in zip(scores, allowed, any_allowed, strict=True):
        if not some:
            out.append(np.zeros(0, np.int64))
            continue
        at = np.flatnonzero(mask)
        if len(at) > k:
            values = row[at]
            least = np.partition(values, len(at) - k)[len(at) - k]
            above, tied = at[values > least], at[values == least]
            at = np.concatenate([above, tied[: k - len(above)]])
        out.append(at[np.argsort(-row[at], kind="stable")])
    return out


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products as integers: as doubles where they hold them, else as integers throughout."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    return (a @ b.T).astype(np.int64) if bound < 2.0**53 else a.astype(np.int64) @ b.astype(np.int64).T


_ASKS = "array<struct<ask:int,high:bigint,low:bigint,known:bigint>>"


def _scan(pairs: DataFrame, width: int, k: int, same: bool) -> DataFrame:
    """(row_id, ask, score, id, other_row): of each block and group of anchors, what may be among the first ``k`` of an ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchors, rows in zip(batch["anchors"], batch["rows"], strict=True):
                anchors, rows = anchors.values, rows.values  # structs, as columns
                theirs, ids, others, labels = _matrix(rows.field("vec"), width), rows.field("id").to_numpy(), rows.field("row_id").to_numpy(), rows.field("label").to_numpy()
                out: list[tuple[int, int, int, int, int]] = []
                for at in range(0, len(anchors), AT_ONCE):
                    part = anchors.slice(at, AT_ONCE)
                    scores = _scores(_matrix(pa.ListArray.from_arrays(*_relative(part, "vec")), width), theirs)
                    own = part.field("row_id").to_numpy()
                    fits = part.field("label").to_numpy()[:, None] == labels[None, :]
                    fits = fits & (own[:, None] != others[None, :]) if same else ~fits
                    asks = part.field("asks").to_pylist()
                    rows_of = [(i, a) for i, each in enumerate(asks) for a in each]
                    i = np.array([i for i, _ in rows_of], dtype=np.int64)
                    high, low, known = (np.array([a[c] for _, a in rows_of], dtype=np.int64) for c in ("high", "low", "known"))
                    for begin in range(0, len(i), AT_ONCE):
                        cut = slice(begin, begin + AT_ONCE)
                        s = scores[i[cut]]
                        allowed = fits[i[cut]] & (s <= high[cut, None]) & (s >= np.maximum(low[cut], known[cut])[:, None])
                        for j, best in enumerate(_first(s, allowed, k)):
                            ask = rows_of[begin + j][1]["ask"]
                            out += [(int(own[i[begin + j]]), ask, int(s[j, x]), int(ids[x]), int(others[x])) for x in best]
                columns = list(zip(*out, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:])], names=["row_id", "ask", "score", "id", "other_row"])

    return pairs.select("anchors", "rows").mapInArrow(run, "row_id bigint, ask int, score bigint, id bigint, other_row bigint")


def _relative(part: pa.StructArray, name: str) -> tuple[pa.Array, pa.Array]:
    """Offsets from 0 and values of a list field of a slice of structs."""
    column = part.field(name)
    offsets = column.offsets.to_numpy()
    return pa.array(offsets - offsets[0], pa.int32()), column.flatten()


def _intervals(groups: DataFrame, pivots: Pivots, width: int) -> DataFrame:
    """(group, pivot, low, high): the key interval of each pivot that the radii of a group's anchors reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, anchors in zip(batch["group"].to_pylist(), batch["anchors"], strict=True):
                anchors = anchors.values
                vectors, radius = _matrix(anchors.field("vec"), width), anchors.field("radius").to_numpy() * (1 + 1e-9) + 1e-3
                far = pivots.distances(vectors, np.zeros(len(vectors)))
                low, high = (far - radius[:, None]).min(axis=0), (far + radius[:, None]).max(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array([group] * len(low), pa.int64()), pa.array(np.arange(len(low), dtype=np.int32)), pa.array(low), pa.array(high)], names=["group", "pivot", "low", "high"])

    return groups.select("group", "anchors").mapInArrow(run, "group bigint, pivot int, low double, high double")


def _new_blocks(index: Index, now: DataFrame, before: DataFrame | None) -> DataFrame:
    """(group, pivot, block): blocks that meet an interval of ``now`` and none of ``before``.

    Both sides are dealt to the cells that they meet; a pair counts in the first cell they share.
    """
    cells = index.spans.select("pivot", "block", F.col("low").alias("from"), F.col("high").alias("to"), F.posexplode(_cells(F.col("low"), F.col("high"), index.cell)).alias("nth", "cell"))
    top = F.least(F.col("high"), F.lit(index.cell * CELLS))
    asked = now.filter((F.col("high") >= 0) & (F.col("low") <= top)).select("group", "pivot", "low", "high", F.posexplode(_cells(F.col("low"), top, index.cell)).alias("mth", "cell"))
    met = asked.join(cells, ["pivot", "cell"]).filter("from <= high and to >= low and (nth = 0 or mth = 0)").select("group", "pivot", "block", "from", "to")
    if before is None:
        return met.select("group", "pivot", "block")
    old = before.select("group", "pivot", F.col("low").alias("was_low"), F.col("high").alias("was_high"))
    return met.join(old, ["group", "pivot"], "left").filter("was_low is null or not (from <= was_high and to >= was_low)").select("group", "pivot", "block")


def _radius(score: Column, index: Index) -> Column:
    """Of the distance range, where rows of a score lie."""
    return F.sqrt(F.greatest(F.lit(0.0), F.col("square") + F.lit(index.pivots.square) - 2 * score))


def search(index: Index, asks: DataFrame, k: int, same: bool) -> DataFrame:
    """(row_id, ask, score, id, other_row, rank): the first ``k`` rows for each ask, by score, then id.

    ``asks`` (group, row_id, label, vec, square, ask, high, low) are anchors, each with one or more
    ranges of scores; rows of the same label are searched, or of others.
    """
    whole = F.sqrt("square") + F.lit(index.pivots.square**0.5)  # reaches every row
    reach = F.least(whole, F.when(F.col("low") == _LEAST, whole).otherwise(_radius(F.col("low"), index)))
    begun = F.when(F.col("high") == _MOST, _radius(F.lit(0.4) * F.col("square"), index)).otherwise(_radius(F.col("high"), index) * 1.02)
    open_ = checkpointed(asks.withColumn("reach", reach).withColumn("known", F.lit(_LEAST)).withColumn("radius", F.least("reach", begun)))
    found, before = None, None
    best = Window.partitionBy("row_id", "ask").orderBy(F.col("score").desc(), "id", "other_row")
    while True:
        one = open_.groupBy("group", "row_id", "label", "vec").agg(F.max("radius").alias("radius"), F.collect_list(F.struct("ask", "high", "low", "known")).alias("asks"))
        groups = checkpointed(one.groupBy("group").agg(F.collect_list(F.struct("row_id", "label", "vec", "radius", F.col("asks").cast(_ASKS).alias("asks"))).alias("anchors")))  # anchors of one stretch at most
        now = checkpointed(_intervals(groups, index.pivots, index.width))
        pairs = _new_blocks(index, now, before).join(groups, "group").join(index.blocks.select("pivot", "block", "rows"), ["pivot", "block"])
        hits = _scan(pairs, index.width, k, same)
        hits = (hits if found is None else found.drop("rank").union(hits)).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        found = checkpointed(hits)
        kth = found.filter(F.col("rank") == k).select("row_id", "ask", F.col("score").alias("kth"))
        told = open_.drop("known").join(kth, ["row_id", "ask"], "left").withColumn("need", F.least("reach", F.when(F.col("kth").isNotNull(), _radius(F.col("kth"), index)).otherwise(F.col("reach"))))
        wider = F.when(F.col("kth").isNotNull(), F.col("need")).otherwise(F.least("reach", F.col("radius") * 1.5 + 1))
        open_ = checkpointed(told.filter(F.col("need") > F.col("radius")).withColumn("radius", wider).withColumn("known", F.coalesce("kth", F.lit(_LEAST))).drop("kth", "need"))
        if open_.isEmpty():
            return found
        before = now.join(before.select("group", "pivot", F.col("low").alias("l"), F.col("high").alias("h")), ["group", "pivot"], "left").select("group", "pivot", F.least("low", "l").alias("low"), F.greatest("high", "h").alias("high")) if before is not None else now
        before = checkpointed(before)


# -- the operator -------------------------------------------------------------------------


def _divided(a: Column, b: int) -> Column:
    """a / b rounded down, in integers."""
    return (a - F.pmod(a, F.lit(b))) / b


def hard_negatives(rows: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for ``rows`` (vec_id, embedding, label).

    Rows with a null label or vector, or a null or non-finite component take no part. A null
    vec_id is no anchor, keeps its label and comes last among equal scores. Repeated rows are
    different rows; vectors of different lengths are filled up with 0, and an empty vector has
    score 0 with all. Rounded components beyond 2**26 are cut to it, so that scores fit a long.
    An empty table gives an empty result and further columns are ignored.
    """
    ready = checkpointed(prepared(rows))
    index = indexed(ready)
    if index is None:
        return ready.select(*(F.col("id").alias(c) for c in ("anchor_id", "positive_id")), F.lit(1).alias("rank"), *(F.col("id").alias(c) for c in ("negative_id", "positive_score", "negative_score")))
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    anchors = checkpointed(index.ranked.filter((F.col("id") % ANCHOR == 0) & (F.col("id") != NO_ID)).select(F.floor(F.col("rank") / STRETCH).alias("group"), "row_id", "id", "label", "vec", square.alias("square")))
    whole = anchors.drop("id").select("*", F.lit(0).alias("ask"), F.lit(_MOST).alias("high"), F.lit(_LEAST).alias("low"))
    positives = search(index, whole, POSITIVES, same=True).select("row_id", F.col("rank").alias("ask"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    positives = checkpointed(positives)
    some = positives.filter("positive_score >= 0")  # below 0 no score is both
    high, low = _divided(HIGH * F.col("positive_score"), 100), -_divided(-LOW * F.col("positive_score"), 100)
    asks = anchors.drop("id").join(some, "row_id").select("group", "row_id", "label", "vec", "square", "ask", high.cast("long").alias("high"), low.cast("long").alias("low"))
    negatives = search(index, asks, NEGATIVES, same=False).select("row_id", "ask", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = positives.join(anchors.select("row_id", F.col("id").alias("anchor_id")), "row_id").join(negatives, ["row_id", "ask"])
    back = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return named.select("anchor_id", back("positive_id"), "rank", back("negative_id"), "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


OP11_SQL = f"""
WITH valid AS (
  SELECT row_number() OVER () AS row_id, vec_id,
         CASE WHEN vec_id % {MOVED} = 0 THEN (label::BIGINT + 1) % {LABELS} ELSE label::BIGINT END AS label,
         list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS vec
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.row_id AS anchor_row, a.vec_id AS anchor_id, b.row_id, b.vec_id, a.label = b.label AS same,
         list_inner_product(a.vec, b.vec)::BIGINT AS score
  FROM valid a JOIN valid b ON a.vec_id % {ANCHOR} = 0 AND a.row_id != b.row_id
), positives AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_row ORDER BY score DESC, vec_id) <= {POSITIVES}
), ranked AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_row, p.row_id ORDER BY n.score DESC, n.vec_id) AS rank
  FROM positives p JOIN scored n ON n.anchor_row = p.anchor_row AND NOT n.same
   AND 100 * n.score BETWEEN {LOW} * p.score AND {HIGH} * p.score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= {NEGATIVES}
"""
