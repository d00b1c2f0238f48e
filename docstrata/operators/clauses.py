"""Clauses with evidence: sentences in which a construction meets its companion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstrata.config import ClausePattern
from docstrata.functions.text import contains_term, normalise

#: Where a sentence ends: a blank after closing punctuation, before a capital or a quotation.
BOUNDARY = r"(?<=[.;:»”\"\)])\s+(?=[«\"“(]|[A-ZÁÉÍÓÚÑ])"
#: Longest evidence; of a longer sentence it is a piece around each match.
LONGEST, MOST_EVIDENCE = 1000, 50


def sentences(text: Column) -> Column:
    """Array of (start, finish, fragment) in code points, from the lengths of what is split."""
    pieces = F.split(text, BOUNDARY, -1)
    gaps = F.regexp_extract_all(text, F.lit(BOUNDARY), F.lit(0))
    zipped = F.arrays_zip(pieces.alias("piece"), gaps.alias("gap"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,finish:int,fragment:string>>").alias("out"))

    def step(state: Column, z: Column) -> Column:
        end = state["at"] + F.length(z["piece"])
        one = F.struct(state["at"].alias("start"), end.alias("finish"), z["piece"].alias("fragment"))
        return F.struct((end + F.coalesce(F.length(z["gap"]), F.lit(0))).alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    return F.aggregate(zipped, empty, step)["out"]


def _windows(fragment: Column, pattern: str) -> Column:
    """Array of (first, last): a piece of ``LONGEST`` code points around each match, within the fragment."""
    found, between = F.regexp_extract_all(fragment, F.lit(pattern), F.lit(0)), F.split(fragment, pattern, -1)
    size = lambda parts, n: F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0), lambda total, x: total + F.length(x))

    def window(match: Column, i: Column) -> Column:
        at, margin = size(between, i + 1) + size(found, i), F.floor((LONGEST - F.length(match)) / 2).cast("int")
        return F.struct(F.greatest(F.lit(0), at - margin).alias("first"), F.least(F.length(fragment), at + F.length(match) + margin).alias("last"))

    return F.transform(found, window)


def clauses(docs: DataFrame, *patterns: ClausePattern) -> DataFrame:
    """(doc_id, family, place, start, finish, fragment) of each clause of ``docs`` (doc_id, text), for all ``patterns`` in one pass.

    A sentence counts if the construction and the companion are both in it. Of one longer
    than ``LONGEST`` a piece around each construction is taken, if the companion is in that
    piece. Evidence with the same range counts once, and a document gives ``MOST_EVIDENCE``
    of a family at most, which is what the feature promises its readers.
    """
    whole = F.array(F.struct(F.lit(0).alias("first"), F.length("fragment").alias("last")))
    built, companion = (lambda p: f"(?iu){p.construction}"), (lambda p: f"(?iu){p.companion}")
    hints = F.array_compact(F.array(*(F.when(F.col("text").rlike(built(p)) & F.col("text").rlike(companion(p)), F.lit(p.name)) for p in patterns)))  # cheap, before any splitting
    hinted = docs.select("doc_id", "text", F.explode(F.array(hints)).alias("hints")).filter(F.size("hints") > 0)  # a generator: the filter does not repeat the hints
    each = hinted.select("doc_id", "hints", F.inline(sentences(F.col("text"))))

    def pieces(p: ClausePattern) -> Column:
        ranges = F.when(F.length("fragment") > LONGEST, _windows(F.col("fragment"), built(p))).otherwise(whole)
        cut = lambda w: F.substring(F.col("fragment"), w["first"] + 1, w["last"] - w["first"])
        row = lambda w: F.struct(F.lit(p.name).alias("family"), (F.col("start") + w["first"]).alias("start"), (F.col("start") + w["last"]).alias("finish"), cut(w).alias("fragment"))
        told = F.filter(F.transform(ranges, row), lambda x: x["fragment"].rlike(companion(p)))
        return F.when(F.array_contains("hints", p.name) & F.col("fragment").rlike(built(p)), told)

    found = F.flatten(F.array_compact(F.array(*(pieces(p) for p in patterns))))
    ranged = each.select("doc_id", F.inline(found)).distinct()
    listed = ranged.groupBy("doc_id", "family").agg(F.slice(F.array_sort(F.collect_list(F.struct("start", "finish", "fragment"))), 1, MOST_EVIDENCE).alias("evidence"))
    return listed.select("doc_id", "family", F.posexplode("evidence").alias("place", "e")).select("doc_id", "family", "place", "e.*")


def clause_at(text: Column, position: Column) -> Column:
    """The sentence (start, finish, fragment) that holds a position."""
    return F.element_at(F.filter(sentences(text), lambda s: (s["start"] <= position) & (position < s["finish"])), 1)


def names_organ(organ: str, terms: tuple[str, ...]) -> Column:
    """Whether a ``fragment`` names an organ and a direct term."""
    low = normalise(F.col("fragment"))
    named = F.lit(False)
    for t in terms:
        named = named | contains_term(low, F.lit(t))
    return F.col("fragment").rlike(f"(?iu){organ}") & named


def of_organ(evidence: DataFrame, organ: str, terms: tuple[str, ...]) -> DataFrame:
    """Evidence that names an organ and a direct term in the same clause."""
    return evidence.filter(names_organ(organ, terms))


def verified(text: Column, start: Column, finish: Column, fragment: Column) -> Column:
    """Whether the text really has the fragment at these code points."""
    return F.coalesce(F.substring(text, (start + 1).cast("int"), (finish - start).cast("int")) == fragment, F.lit(False))
