"""Two-axis prefilter: which documents deserve a closer look.

The lexical axis finds terms, the referential axis finds citations of watched items. One
CASE expression decides the state; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstrata.config import MANY_DIRECT, Lexicon, Versions
from docstrata.functions.text import normalise, only_context, terms_present

RELEVANT, SUSPECT, DISCARDED, PENDING, UNREADABLE = "relevant", "suspect", "discarded", "pending", "unreadable"
QUEUED = (RELEVANT, SUSPECT)
LEXICAL, REFERENTIAL = "lexical", "referential"


def evaluate(docs: DataFrame, lexicon: Lexicon, many_direct: int = MANY_DIRECT) -> DataFrame:
    """``docs`` (title, body, organ, unreadable, touched: array of watched ids) with state,
    terms, axes and n_direct.

    The text is the body, or the title where there is no body (null; an empty body is a
    body), followed by the organ. The first rule that fits decides: unreadable; a watched item
    is touched; no terms; only a title; no direct term; many direct terms. Terms and axes are
    emptied where a document is discarded or pending, n_direct is always told.
    """
    has_body = F.col("body").isNotNull()
    text = F.concat(F.coalesce("body", "title", F.lit("")), F.lit(" "), F.coalesce("organ", F.lit("")))
    found = docs.withColumn("__found", terms_present(normalise(text), list(lexicon.terms)))
    direct = F.array_intersect("__found", F.array(*(F.lit(t) for t in lexicon.direct)))
    touched = F.size(F.coalesce("touched", F.array().cast("array<string>"))) > 0
    n_direct = F.size(direct)
    none = F.size("__found") == 0
    state = (
        F.when(F.coalesce("unreadable", F.lit(False)), UNREADABLE)
        .when(touched, RELEVANT)
        .when(none, F.when(has_body, DISCARDED).otherwise(PENDING))
        .when(~has_body, F.when(n_direct > 0, RELEVANT).otherwise(SUSPECT))
        .when(n_direct == 0, DISCARDED)
        .when(n_direct >= many_direct, RELEVANT)
        .otherwise(SUSPECT)
    )
    axes = F.array_compact(F.array(F.when(~none, F.lit(LEXICAL)), F.when(touched, F.lit(REFERENTIAL))))
    decided = found.withColumn("state", state).withColumn("__axes", axes).withColumn("n_direct", n_direct)
    empty = F.col("state").isin(DISCARDED, PENDING)
    nothing = F.array().cast("array<string>")
    return (
        decided.withColumn("context_only", only_context(F.col("__found"), list(lexicon.context)))
        .withColumn("terms", F.when(empty, nothing).otherwise(F.col("__found")))
        .withColumn("axes", F.when(empty, nothing).otherwise(F.col("__axes")))
        .drop("__found", "__axes")
    )


def queued(state: Column) -> Column:
    return state.isin(*QUEUED)


def funnel(evaluated: DataFrame, *by: str) -> DataFrame:
    """Counts by state and axis, in one pass of conditional counts."""
    states = (RELEVANT, SUSPECT, DISCARDED, PENDING, UNREADABLE)
    return evaluated.groupBy(*by).agg(
        F.count("*").alias("documents"),
        *(F.count_if(F.col("state") == s).alias(s) for s in states),
        F.count_if(F.array_contains("axes", LEXICAL)).alias("lexical"),
        F.count_if(F.array_contains("axes", REFERENTIAL)).alias("referential"),
        F.count_if("context_only").alias("context_only"),
        F.count_if(F.col("body").isNotNull()).alias("full_text"),
    )


def stale(versions: Versions) -> Column:
    """Whether a row (evaluated_at, lexicon_version, watchlist_version, text_version, has_body)
    must be evaluated again. Each null is spelt out: null <> x is null, not true."""
    differs = lambda column, now: F.col(column).isNull() | (F.col(column) != now)
    return (
        F.col("evaluated_at").isNull()
        | differs("lexicon_version", versions.lexicon)
        | differs("watchlist_version", versions.watchlist)
        | (F.col("has_body") & differs("text_version", versions.text))
    )


def stale_rules(versions: Versions) -> Column:
    """Whether a queued, readable row (state, rules_version, text_version) must be classified again."""
    return queued(F.col("state")) & (F.col("rules_version").isNull() | (F.col("rules_version") != versions.rules) | F.coalesce(F.col("text_version") != versions.text, F.lit(False)))
