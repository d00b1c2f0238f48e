"""Extraction by a model: a pluggable function from prompts to answers, strictly validated."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstrata.config import SETTINGS
from docstrata.functions.text import delimited, outer_json

ANSWER_KEYS = ("affected", "organ", "scope", "articles")
ARTICLE_KEYS = ("identifier", "before", "after")
#: Articles of an answer, characters of an article's text and of any other field.
MOST_ARTICLES, MOST_TEXT, MOST_FIELD = 50, 20_000, 500
SCOPES = ("state", "region", "local")
#: Characters that a piece of a text shares with the one before, so that a mention across the cut stays whole.
OVERLAP = 200


def prompts(docs: DataFrame, most: int = SETTINGS.model_characters) -> DataFrame:
    """``docs`` with prompt (the start of the text between marks) and full_length."""
    return docs.withColumn("prompt", delimited(F.substring(F.coalesce("text", F.lit("")), 1, most))).withColumn("full_length", F.length("text"))


def piece_prompts(docs: DataFrame, most: int = SETTINGS.model_characters, overlap: int = OVERLAP) -> DataFrame:
    """``docs`` with a row for each piece of the text: piece (its place), prompt and full_length.

    The pieces cover the whole text, in order; a null or empty text has one empty piece.
    """
    text = F.coalesce("text", F.lit(""))
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - most) / (most - overlap))).cast("int")
    places = docs.select("*", F.length("text").alias("full_length"), F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    return places.withColumn("prompt", delimited(F.substring(text, F.col("piece") * (most - overlap) + 1, F.lit(most))))


def merged(answered: DataFrame, *by: str) -> DataFrame:
    """One row for each document of ``answered`` (by, piece, x: validated answer).

    ``valid_pieces`` counts the valid answers, and ``answers`` are they, by place. ``x`` is their
    union: affected, organ and scope of the first answer that names them, and every article once.
    It is null if no answer is valid.
    """
    given = F.array_sort(F.collect_list(F.when(F.col("x").isNotNull(), F.struct("piece", "x"))))
    rows = answered.groupBy(*by).agg(F.transform(given, lambda g: g["x"]).alias("answers"))
    first = lambda name: F.get(F.filter(F.transform("answers", lambda a: a[name]), lambda v: v.isNotNull()), F.lit(0)).alias(name)
    articles = F.array_distinct(F.flatten(F.filter(F.transform("answers", lambda a: a["articles"]), lambda v: v.isNotNull()))).alias("articles")
    union = F.when(F.size("answers") > 0, F.struct(first("affected"), first("organ"), first("scope"), articles))
    return rows.select(*by, F.size("answers").alias("valid_pieces"), "answers", union.alias("x"))


def ask(rows: DataFrame, provider: Callable[[str], str]) -> DataFrame:
    """``rows`` with ``answer``; a provider that fails gives null, not a failed job."""

    def one(prompt: str) -> str | None:
        try:
            return provider(prompt)
        except (OSError, ValueError):
            return None

    @F.pandas_udf("string")
    def answers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(one)

    return rows.withColumn("answer", answers("prompt"))


def validated(answer: Column) -> Column:
    """The answer as a struct, or null: it must be one JSON object that keeps the schema.

    The answer is parsed once, to a variant, and walked: only the known keys, in articles too;
    texts are texts, of bounded length; a known scope, whatever its case; a bounded list of
    articles, each with an identifier. Blanks around a text go, an empty text is null. A key that
    stands twice in one object refuses the answer, as it has no one value.
    """
    parsed = F.try_parse_json(outer_json(answer))
    return F.get(F.transform(F.filter(F.array(parsed), lambda v: v.isNotNull()), _checked_answer), F.lit(0))


def _entries(v: Column) -> Column:
    """The fields of an object by key; null for anything else."""
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), F.try_variant_get(v, "$", "map<string,variant>"))


def _known(fields: Column, keys: tuple[str, ...]) -> Column:
    return F.size(F.array_except(F.map_keys(fields), F.array(*(F.lit(k) for k in keys)))) == 0


def _text(v: Column) -> Column:
    """The text of a variant without blanks around it; null for nothing or an empty one."""
    return F.nullif(F.regexp_replace(F.try_variant_get(v, "$", "string"), r"(?U)^\s+|\s+\z", ""), F.lit(""))


def _bounded(v: Column, most: int) -> Column:
    """Whether a variant is nothing or a text of at most ``most`` characters."""
    is_text = (F.schema_of_variant(v) == "STRING") & (F.coalesce(F.length(_text(v)), F.lit(0)) <= most)
    return v.isNull() | F.is_variant_null(v) | F.coalesce(is_text, F.lit(False))


def _good_article(article: Column) -> Column:
    fields = _entries(article)
    named = _bounded(fields["identifier"], MOST_FIELD) & _text(fields["identifier"]).isNotNull()
    good = _known(fields, ARTICLE_KEYS) & named & _bounded(fields["before"], MOST_TEXT) & _bounded(fields["after"], MOST_TEXT)
    return F.coalesce(good, F.lit(False))


def _checked_answer(answer: Column) -> Column:
    fields = _entries(answer)
    given = fields["articles"]
    listed = F.when(F.schema_of_variant(given).startswith("ARRAY"), F.try_variant_get(given, "$", "array<variant>"))
    articles = F.when(given.isNull(), F.array().cast("array<variant>")).otherwise(listed)
    scope = F.lower(_text(fields["scope"]))
    no_scope = fields["scope"].isNull() | F.is_variant_null(fields["scope"])
    good = _known(fields, ANSWER_KEYS) & _bounded(fields["affected"], MOST_FIELD) & _bounded(fields["organ"], MOST_FIELD)
    good = good & (no_scope | (_bounded(fields["scope"], MOST_FIELD) & F.coalesce(scope.isin(*SCOPES), F.lit(False))))
    good = good & articles.isNotNull() & (F.size(articles) <= MOST_ARTICLES) & F.forall(articles, _good_article)
    each = lambda a: F.struct(*(_text(_entries(a)[k]).alias(k) for k in ARTICLE_KEYS))
    return F.when(F.coalesce(good, F.lit(False)), F.struct(_text(fields["affected"]).alias("affected"), _text(fields["organ"]).alias("organ"), scope.alias("scope"), F.transform(articles, each).alias("articles")))


def pointers(extraction: Column) -> Column:
    """Ids of articles without either text: they only point at what changed."""
    only = F.filter(extraction["articles"], lambda a: a["before"].isNull() & a["after"].isNull() & a["identifier"].isNotNull())
    return F.coalesce(F.transform(only, lambda a: a["identifier"]), F.array().cast("array<string>"))


class Scripted:
    """A provider for tests: the answer of the first key that the prompt holds."""

    def __init__(self, answers: dict[str, str], otherwise: str = "{}"):
        self.answers, self.otherwise = answers, otherwise

    def __call__(self, prompt: str) -> str:
        return next((a for k, a in self.answers.items() if k in prompt), self.otherwise)
