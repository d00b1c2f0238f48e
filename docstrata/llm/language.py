"""Language identification by Bayesian fusion of text, markup, address and host evidence.

The posterior of a language is proportional to
``P(text | language) * P(declared | language) * P(suffix | language) * P(language | host)``.

* Text likelihoods come from hashed byte trigrams, fitted on a bounded sample of the rows that
  declare each language.
* How far a declaration or an address suffix can be trusted is measured on the corpus: one
  grouped aggregation counts them against what the texts alone say.
* The prior of a host is smoothed towards its domain's, and that towards the corpus's, by
  grouped aggregations over all rows; a row's own vote is left out of its prior.

So many text models are kept as there is room for. The languages with the fewest texts beyond
them share one, and a row that it explains best is in the language it declares.

The class ``und`` has uniform trigrams: texts that no fitted language explains go there. A
language whose declaring rows have no trigrams at all explains no text; rows without trigrams
can still be in it, by their other evidence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.llm.common import checkpointed, flat, screened, slices

GRAM_BITS = 16
#: Rows that the text model is fitted on, about, in equal parts for each language but not under
#: ``LEAST_FIT_ROWS`` for any; the rest of the corpus is scored, not fitted.
FIT_ROWS, LEAST_FIT_ROWS = 10_000, 200
#: Languages with a text model of their own, those with the most texts; the others share one. A model is 256 KB.
MOST_MODELS = 128
#: The name of the class that those share, while rows are scored.
SHARED = ""
#: Log-likelihood of any trigram under a language without fitted text: no text is in it.
UNFITTED = -1e6
UNKNOWN = "und"
#: Trigrams overlap and repeat, so each counts less than an independent one. How much less is
#: measured: the weight under which held-out rows of the fit sample are likeliest, of these.
WEIGHTS = [2.0**-k for k in range(11)]
#: Of the drawn rows one in so many measures that weight; the others make the table.
HELD_OUT = 5
#: Pseudo-counts: of a host towards its domain, of a domain towards the corpus, of a key's table.
HOST_WEIGHT, DOMAIN_WEIGHT, KEY_WEIGHT = 10.0, 50.0, 1.0
#: Share of rows that may be in a language that was never declared.
UNKNOWN_PRIOR = 1e-3
#: A row is kept when its language is known with at least this probability.
LEAST_PROBABILITY = 0.5

EVIDENCE = ["declared", "suffix", "host", "domain"]


# -- trigrams -----------------------------------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashed trigram that begins at each byte but the last two; letters count in lower case."""
    low = _LOWER[data]
    if len(low) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)  # U+00C0 to U+00DE
        low[1:][capital] += 32
    x = low.astype(np.uint32)
    x = x[:-2] | (x[1:-1] << np.uint32(8)) | (x[2:] << np.uint32(16))
    return ((x * np.uint32(2654435761)) >> np.uint32(32 - GRAM_BITS)).astype(np.int32)


def _gram_counts(rows: DataFrame, languages: list[str]) -> np.ndarray:
    """Trigrams of each language: languages x 2**GRAM_BITS, summed in Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            data, offsets = flat(batch["text"])
            which = batch["language"].to_numpy(zero_copy_only=False)
            for i, language in enumerate(which):
                part = data[offsets[i] : offsets[i + 1]]
                if len(part) > 2:
                    mine = total.setdefault(int(language), np.zeros(1 << GRAM_BITS, dtype=np.int64))
                    mine += np.bincount(gram_hashes(part), minlength=1 << GRAM_BITS)
        for language, counts in total.items():
            gram = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), language), pa.int32()), pa.array(gram, pa.int32()), pa.array(counts[gram], pa.int64())], names=["language", "gram", "n"])

    labelled = rows.select((F.array_position(F.array(*(F.lit(x) for x in languages)), F.col("class")).cast("int") - 1).alias("language"), "text")
    sums = labelled.mapInArrow(count, "language int, gram int, n bigint").groupBy("language", "gram").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((len(languages), 1 << GRAM_BITS))  # at most languages x 2**GRAM_BITS sums, whatever the corpus
    out[sums["language"].to_numpy(), sums["gram"].to_numpy()] = sums["n"].to_numpy()
    return out


def best_weight(scores: np.ndarray, declared: np.ndarray) -> float:
    """The weight under which the declared languages of held-out rows are likeliest.

    ``scores`` are log-likelihoods by row and language. A row's declaration may be wrong, as
    often as the best score says otherwise; ties go to the larger weight, and without rows
    every trigram counts in full.
    """
    if not len(scores):
        return 1.0
    wrong = np.clip((scores.argmax(axis=1) != declared).mean(), 1e-3, 0.5)
    above = scores - scores.max(axis=1, keepdims=True)

    def likelihood(weight: float) -> float:
        p = np.exp(weight * above)
        given = p[np.arange(len(p)), declared] / p.sum(axis=1)
        return float(np.log((1 - wrong) * given + wrong / scores.shape[1]).sum())

    return max(WEIGHTS, key=likelihood)


def classes(by_language: DataFrame, most: int = MOST_MODELS) -> dict[str, tuple[int, int | None]]:
    """(texts, least place) of each class, by name: the languages with the most texts, and what the others share.

    ``by_language`` (declared, n, least) may be long; at most ``most`` and one rows leave it.
    """
    own = by_language.orderBy(F.col("n").desc(), "declared").limit(most).collect()
    found = {r["declared"]: (r["n"], r["least"]) for r in own}
    rest = by_language.filter(~F.col("declared").isin(list(found))).agg(F.count("*"), F.sum("n"), F.min("least")).first() if found else (0,)
    return {**dict(sorted(found.items())), **({SHARED: tuple(rest[1:])} if rest[0] else {})}


def class_of(languages: list[str]) -> Column:
    """The class of a row's declaration; null without one."""
    named = F.col("declared").isin([x for x in languages if x != SHARED])
    return F.when(named, F.col("declared")).when(F.col("declared").isNotNull() & F.lit(SHARED in languages), F.lit(SHARED))


def drawn_texts(rows: DataFrame, found: dict[str, tuple[int, int | None]], fit_rows: int) -> DataFrame:
    """(class, declared, text, apart): the texts that a model is fitted on, each once for a class; ``apart`` ones measure.

    Texts are drawn by a hash of their own, so that all copies are drawn or none; then copies
    collapse, before they are moved. About ``fit_rows`` are left, however many copies there are.
    """
    quota = max(LEAST_FIT_ROWS, fit_rows // len(found))
    last = {name: max(least + 1, round(min(1.0, quota / n) * (1 << 20))) for name, (n, least) in found.items() if n}
    table = lambda values: F.element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), F.col("class"))
    some = rows.filter(F.octet_length("text") > 2).select(class_of(list(found)).alias("class"), "declared", "text", _place().alias("place"))
    if not last:
        return some.select("class", "declared", "text", F.lit(False).alias("apart")).limit(0)
    some = some.filter(F.col("place") < table(last))
    once = some.groupBy("class", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.first("declared").alias("declared"), F.first("place").alias("place"))
    apart = (F.col("place") % HELD_OUT == 0) & (F.col("place") > table({name: least for name, (n, least) in found.items() if n}))
    return once.select("class", "declared", "text", apart.alias("apart"))


def _place() -> Column:
    return F.pmod(F.xxhash64(F.lit("fit"), "text"), F.lit(1 << 20))


def fit(rows: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, weighted log-likelihood of each trigram under each), ``und`` last.

    Every declared language has a table, its own or the shared one. Its texts are drawn by a
    hash, and the text with the least hash is always drawn, so that a class with texts has a
    table. Of the texts drawn, one in ``HELD_OUT`` measures what a trigram is worth instead. A
    null or blank declaration is none; without declared rows only ``und`` is left.
    """
    spelled = F.octet_length("text") > 2  # texts that have a trigram
    counted = rows.filter("declared is not null").groupBy("declared")
    texts = F.approx_count_distinct(F.when(spelled, F.xxhash64("text")))
    found = classes(checkpointed(counted.agg(texts.alias("n"), F.min(F.when(spelled, _place())).alias("least"))))
    languages = list(found)
    table = np.full((len(languages) + 1, 1 << GRAM_BITS), -np.log(1 << GRAM_BITS), dtype=np.float32)
    if languages:
        drawn = checkpointed(drawn_texts(rows, found, fit_rows))
        counts = _gram_counts(drawn.filter("not apart"), languages)
        smooth = counts + 0.5 * counts.mean(axis=1, keepdims=True) / 100 + 1e-3
        table[:-1] = np.log(smooth / smooth.sum(axis=1, keepdims=True))
        table[:-1][counts.sum(axis=1) == 0] = UNFITTED
        held = score_texts(drawn.filter("apart").select("class", "text"), table).toArrow()  # a fifth of about fit_rows texts
        scores = held["text_score"].combine_chunks().values.to_numpy().reshape(-1, len(table))
        fitted = counts.sum(axis=1) > 0
        place = {x: i for i, x in enumerate(languages)}
        table[:-1][fitted] *= (weight := best_weight(scores, np.array([place[x] for x in held["class"].to_pylist()], dtype=np.int64)))
        table[-1] *= weight
    return [*languages, UNKNOWN], table


def score_texts(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """``rows`` with ``text_score`` (array of log-likelihoods) in place of ``text``."""
    others = [c for c in rows.columns if c != "text"]
    model = rows.sparkSession.sparkContext.broadcast(table)  # 256 KB for each of at most MOST_MODELS and two classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch["text"])
            scores = np.zeros((len(offsets) - 1, len(model.value)))
            for i, j in slices(offsets):
                at = offsets[i : j + 1] - offsets[i]
                grams = gram_hashes(data[offsets[i] : offsets[j]])
                n = np.maximum(np.diff(at) - 2, 0)
                begin, end = np.minimum(at[:-1], len(grams)), np.minimum(at[:-1] + n, len(grams))
                for k, likelihood in enumerate(model.value):
                    total = np.concatenate([[0.0], np.cumsum(likelihood[grams], dtype=np.float64)])
                    scores[i:j, k] = total[end] - total[begin]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(scores) + 1) * scores.shape[1], pa.int32()), pa.array(scores.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in others), lists], names=[*others, "text_score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.select(*others, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"{kinds}, text_score array<double>")


# -- fusion -------------------------------------------------------------------------------


def _counts_by(scored: DataFrame, n: int, *keys: str) -> DataFrame:
    """For each key, how many rows the text alone puts into each language."""
    votes = scored.groupBy(*keys).agg(*(F.sum((F.col("vote") == i).cast("double")).alias(f"n{i}") for i in range(n)))
    return votes.select(*keys, F.array(*(f"n{i}" for i in range(n))).alias(f"{keys[-1]}_votes"))


def _table(column: pa.Array, n: int) -> np.ndarray:
    """Lists of n numbers as rows; 0 where there is none."""
    out = np.zeros((len(column), n))
    out[column.is_valid().to_numpy(zero_copy_only=False)] = column.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
    return out


def _smoothed(votes: np.ndarray, own: np.ndarray, towards: np.ndarray, weight: float) -> np.ndarray:
    """(votes without the row's own + weight * towards) / their sum."""
    mass = votes - own + weight * towards
    return mass / mass.sum(axis=1, keepdims=True)


def posterior(text: np.ndarray, vote: np.ndarray, votes: dict[str, np.ndarray], has: dict[str, np.ndarray], counts: np.ndarray, keys: dict[str, int], prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(language, its probability) of each row, from log-likelihoods of the text and the votes of its keys.

    A row's own vote is left out of every count. Of equally likely languages the first is taken.
    """
    own = np.zeros_like(text)
    own[np.arange(len(vote)), vote] = 1.0

    def likelihood(key: str) -> np.ndarray:
        """log P(key | language), over as many values as the key has; nothing where the row lacks it."""
        known = np.maximum(votes[key] - own, 0.0) + KEY_WEIGHT
        return np.where(has[key][:, None], np.log(known / (counts + keys[key] * KEY_WEIGHT)), 0.0)

    domain = np.where(has["domain"][:, None], _smoothed(votes["domain"], own, prior, DOMAIN_WEIGHT), prior)
    host = np.where((has["domain"] & has["host"])[:, None], _smoothed(votes["host"], own, domain, HOST_WEIGHT), domain)
    fused = text + np.log(np.maximum(host, 1e-9)) + likelihood("declared") + likelihood("suffix")
    best = fused.argmax(axis=1)
    return best, 1.0 / np.exp(fused - fused.max(axis=1, keepdims=True)).sum(axis=1)


def fuse(scored: DataFrame, languages: list[str], unfitted: list[str]) -> DataFrame:
    """``scored`` with language, probability, text_language and kept, without text_score.

    A row that declares an ``unfitted`` language, of which no row has a trigram, votes for it. A
    row of the shared class is in the language it declares, if that is one without a model.
    """
    n = len(languages)
    best = F.array_position("text_score", F.array_max("text_score"))
    if unfitted:
        mine = class_of(languages)
        best = F.when(mine.isin(unfitted), F.array_position(F.array(*(F.lit(x) for x in languages)), mine)).otherwise(best)
    voted = checkpointed(scored.withColumn("vote", best.cast("int") - 1))
    total = voted.agg(*(F.sum((F.col("vote") == i).cast("double")).alias(f"n{i}") for i in range(n))).first()
    counts = np.array([total[i] or 0.0 for i in range(n)])
    prior = (counts + 1) / (counts + 1).sum()
    prior[-1] = min(prior[-1], UNKNOWN_PRIOR)
    prior /= prior.sum()

    joined, sizes = voted, {}
    for keys in (["declared"], ["suffix"], ["domain"], ["domain", "host"]):
        by_key = checkpointed(_counts_by(voted.filter(" and ".join(f"{k} is not null" for k in keys)), n, *keys).withColumnsRenamed({k: f"k_{k}" for k in keys}))
        sizes[keys[-1]] = by_key.count()
        same = [F.col(k) == F.col(f"k_{k}") for k in keys]
        joined = joined.join(by_key, same, "left").drop(*(f"k_{k}" for k in keys))
    others = [c for c in scored.columns if c != "text_score"]
    names = pa.array(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vote = batch["vote"].to_numpy()
            votes = {k: _table(batch[f"{k}_votes"], n) for k in EVIDENCE}
            has = {k: batch[k].is_valid().to_numpy(zero_copy_only=False) for k in EVIDENCE}
            language, probability = posterior(_table(batch["text_score"], n), vote, votes, has, counts, sizes, prior)
            columns = [*(batch[c] for c in others), names.take(pa.array(language)), pa.array(probability), names.take(pa.array(vote))]
            yield pa.RecordBatch.from_arrays(columns, names=[*others, "language", "probability", "text_language"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scored.schema if f.name in others)
    found = joined.mapInArrow(run, f"{kinds}, language string, probability double, text_language string")
    own = F.when(F.col("declared").isin(languages), F.lit(UNKNOWN)).otherwise(F.coalesce("declared", F.lit(UNKNOWN)))
    for c in ("language", "text_language"):
        found = found.withColumn(c, F.when(F.col(c) == SHARED, own).otherwise(F.col(c)))
    return found.withColumn("kept", (F.col("language") != UNKNOWN) & (F.col("probability") >= LEAST_PROBABILITY))


def identify(rows: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``rows`` (ids, text, declared, suffix, host, domain) with language, probability,
    text_language and kept, without their text.

    Any evidence may be null and then says nothing; null and very short texts have no
    trigrams, so the other evidence decides. Long texts count whole: each trigram as much as
    in a short one. Every declared language is known, however rare: those beyond ``MOST_MODELS``
    share a model. Ties go to the language that comes first by code point. Rows of any number may share a host: they meet as partial
    counts. Repeated rows are scored alike, an empty table gives an empty result, and further
    columns are carried.
    """
    languages, table = fit(rows, fit_rows)
    unfitted = [x for x, row in zip(languages, table, strict=True) if row[0] == UNFITTED]
    return checkpointed(fuse(checkpointed(score_texts(rows, table)), languages, unfitted))


# -- evidence from tables -----------------------------------------------------------------


def from_documents(docs: DataFrame) -> DataFrame:
    """Evidence of ``documents``: the lang column declares, the source stands for the host."""
    declared = F.lower(F.nullif(F.trim("lang"), F.lit("")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), F.col("text").cast("string").alias("text"), declared.alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").alias("host"), F.lit("documents").alias("domain"))


def from_pages(pages: DataFrame) -> DataFrame:
    """Evidence of ``pages``: the lang attribute of html, the end of the host with a leading
    language in the path, and the host with its domain."""
    html = F.coalesce("html", F.lit(""))
    declared = F.lower(F.nullif(F.regexp_extract(html, r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([a-z]{2,3})", 1), F.lit("")))
    host = F.lower(F.nullif(F.regexp_extract("url", r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    path = F.lower(F.regexp_extract("url", r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]+/([a-z]{2})(?:[/?#]|$)", 1))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>", " ")
    return pages.select(
        F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), text.alias("text"), declared.alias("declared"),
        F.when(host.isNotNull(), F.concat(F.substring_index(host, ".", -1), F.lit("/"), path)).alias("suffix"), host.alias("host"), F.substring_index(host, ".", -2).alias("domain"),
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and every page, each with the evidence that its table offers."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = identify(from_documents(docs).union(from_pages(pages)))
    return found.select("doc_id", "page_id", "language", "probability", "text_language", "declared", "kept")


def keep_identified(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose language is known, with all their columns.

    Null and empty texts are judged by lang and source; a row with no evidence is of the
    corpus's commonest language by its prior. Repeated rows are all kept or all dropped, and
    an empty table gives an empty one.
    """
    whole = docs.select(F.struct(*docs.columns).alias("doc"))
    carried = whole.select("doc", F.col("doc.text").alias("text"), F.col("doc.lang").alias("lang"), F.col("doc.source").alias("source"), F.xxhash64("doc.doc_id", "doc.text", "doc.lang", "doc.source").alias("doc_id"))
    rejected = identify(from_documents(carried), **options).filter("not kept")
    dropped = checkpointed(rejected.select(F.col("doc_id").alias("key")).distinct())
    marked = screened(carried, F.col("doc_id"), dropped)
    left = marked.filter("__hit").join(dropped, F.col("doc_id") == F.col("key"), "left_anti")
    return marked.filter("not __hit").select("doc.*").union(left.select("doc.*"))
