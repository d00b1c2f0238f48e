"""Spelling variants by an even-partition pigeonhole join.

A word is cut into two halves. Of two words that differ by one inserted, deleted or replaced
character, the shorter one's first half begins the other, or its second half ends the other:
one edit can't touch both. The halves of all words are indexed by (length, which half, text);
every word probes with the matching substrings of its own, shifted by one at the end where
it is one longer, for words of its length and of one less. An equality join finds the
candidates, each once, and its condition verifies the edit.

Where many words share a half, the same partition is applied once more to their other half,
so that candidates of such a group share three quarters of a word.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.llm.common import checkpointed, scratch

#: Shortest words, fewest occurrences, and how much more frequent a word's form must be.
LEAST_SIZE, LEAST_COUNT, TIMES = 7, 2, 10
#: One in so many (document, run) pairs loses a character.
ONE_IN = 31
#: A half that more words share than this is joined by its finer partition.
CROWDED = 256

_RUN = re.compile("[a-zÀ-ÿ]+")


# -- words --------------------------------------------------------------------------------


def mistyped(name: bytes, run: str) -> str:
    """The run as a document has it: where its hash says so, one code point is missing."""
    h = zlib.crc32(name + run.encode())
    if h % ONE_IN:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n): the words of ``docs`` (doc_id, text) and how often each occurs.

    Runs are counted within each batch of rows before anything is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[str] = Counter()
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary()), strict=True):
                name = b":" if doc_id is None else b"%d:" % doc_id
                for word, k in Counter(_RUN.findall((text.as_py() or b"").lower().decode("utf-8", "replace"))).items():  # bytes: A-Z alone change
                    if len(word) >= LEAST_SIZE and len(word := mistyped(name, word)) >= LEAST_SIZE:
                        counts[word] += k
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = narrow.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= LEAST_COUNT)


# -- near words ---------------------------------------------------------------------------


def _halves(text: Column, size: Column) -> tuple[Column, Column]:
    """The two segments of a text of ``size`` code points; the second has the odd one."""
    half = F.floor(size / 2).cast("int")
    return F.substring(text, F.lit(1), half), F.substring(text, half + 1, size)


def _shifted(text: Column, size: Column) -> tuple[Column, Column]:
    """What meets the two segments of texts of ``size``: the text is as long, or one longer."""
    half = F.floor(size / 2).cast("int")
    return F.substring(text, F.lit(1), half), F.substring(text, half + 1 + F.length(text) - size, size)


def _segments(words: DataFrame, size: Column, cut) -> DataFrame:
    """A row for each half of a word: (word, size, half, segment, rest), rest being what the segment leaves."""
    first, second = cut(F.col("word"), size)
    begin = F.struct(F.lit(0).alias("half"), first.alias("segment"), F.substring("word", F.length(first) + 1, F.length("word")).alias("rest"))
    end = F.struct(F.lit(1).alias("half"), second.alias("segment"), F.substring("word", F.lit(1), F.length("word") - F.length(second)).alias("rest"))
    return words.select("word", size.alias("size"), F.inline(F.array(begin, end)))


#: What a segment is joined by.
_KEY = ["size", "half", "segment"]


def _keyed(rows: DataFrame, many: DataFrame, cut) -> DataFrame:
    """``rows`` by their segment, and where that is crowded also by a half (1 or 2) of the rest."""
    half = F.floor(F.col("size") / 2).cast("int")
    left = F.when(F.col("half") == 0, F.col("size") - half).otherwise(half)  # of an indexed word
    first, second = cut(F.col("rest"), left)
    kind = lambda i, text: F.struct(F.lit(i).alias("quarter"), text.alias("piece"))
    pieces = F.when(F.col("fine"), F.array(kind(1, first), kind(2, second))).otherwise(F.array(kind(0, F.lit(""))))
    return rows.join(many, _KEY, "left").select("word", *_KEY, "rest", left.alias("left"), F.inline(pieces))


def near_pairs(words: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(word, other): pairs of ``words`` (word) that differ by exactly one edit, each once, the shorter or smaller first."""
    size = F.length("word")
    index = _segments(words, size, _halves)
    probes = _segments(words, size, _shifted).union(_segments(words, size - 1, _shifted))
    many = checkpointed(index.groupBy(*_KEY).agg(F.count("*").alias("m")).filter(F.col("m") > crowded).select(*_KEY, F.lit(True).alias("fine")))
    a, b = _keyed(index, many, _halves).alias("a"), _keyed(probes, many, _shifted).alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*_KEY, "quarter", "piece")]
    word, other = F.col("a.word"), F.col("b.word")
    ordered = (F.length(word) < F.length(other)) | (word < other)
    begins = lambda x, y, n: F.substring(x, F.lit(1), n) == F.substring(y, F.lit(1), n)
    # a pair that both halves (or both halves of the rest) find counts at the first one
    once = ((F.col("a.half") == 0) | ~begins(word, other, F.floor(F.col("a.size") / 2).cast("int"))) & (
        (F.col("a.quarter") < 2) | ~begins(F.col("a.rest"), F.col("b.rest"), F.floor(F.col("a.left") / 2).cast("int"))
    )
    edit = F.levenshtein(word, other, 1) == 1
    return a.join(b, [*same, ordered, once, edit]).select(word.alias("word"), other.alias("other"))


# -- forms --------------------------------------------------------------------------------


def rooted(links: DataFrame) -> DataFrame:
    """(word, root) of every word that has a form, by doubling its steps; ``links`` (word, form) have no cycle."""
    now = checkpointed(links.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        told = checkpointed(now.join(further, "root", "left"))
        now = told.select("word", F.coalesce("further", "root").alias("root"))
        if told.filter("further is not null").isEmpty():
            return now


def spelling_variants(docs: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of ``docs`` (doc_id, text).

    A word's form is its most frequent near word (ties: the smallest by code points), if that is
    at least ten times as frequent; forms grow tenfold with every step, so that following them
    ends. Null and empty texts have no words; a null id is an empty one in the hash; repeated
    rows count each; very long texts are read whole; an empty table gives an empty result and
    further columns are ignored.
    """
    with scratch(docs.sparkSession) as keep:
        words = keep(count_words(docs), "words")
        pairs = keep(near_pairs(words.select("word"), crowded), "near")
        both = pairs.union(pairs.select("other", "word"))
        counted = both.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
        best = counted.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
        fits = -F.col("best.less") >= TIMES * F.col("n")
        near = F.coalesce("n_near", F.lit(0)).alias("n_near")
        form, form_n = F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")
        formed = checkpointed(words.join(best, "word", "left").select("word", "n", near, form, form_n))
    roots = rooted(formed.filter("form is not null").select("word", "form"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
