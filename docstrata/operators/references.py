"""References between documents: what a text cites, and with which verb."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstrata.config import CITES, MODIFYING, VERB_FORMS
from docstrata.functions.text import around, citation_key, long_citation
from docstrata.operators.citation_index import find_citations, find_phrases, items_of

#: Characters before a citation in which its verb is looked for, and of a snippet's margins.
REACH, MARGIN = 200, 80


def with_touched(docs: DataFrame, watched: DataFrame) -> DataFrame:
    """``docs`` with ``touched``: the ids, as text, of the watched passages (item_id, text) that each row holds verbatim."""
    return find_phrases(docs, watched).withColumn("touched", items_of(F.col("found"))).drop("found")


def cited_passages(docs: DataFrame, watched: DataFrame) -> DataFrame:
    """(doc_id, item_id): documents that hold a watched passage verbatim, once for each row and passage."""
    held = with_touched(docs.select("doc_id", "text"), watched)
    return held.select("doc_id", F.explode("touched").alias("item_id")).withColumn("item_id", F.col("item_id").cast(watched.schema["item_id"].dataType))


def watched_citations(docs: DataFrame, watched: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, citation, verb, snippet) of every citation of a watched title.

    ``watched`` (item_id, title) are documents by their titles: what is sought is the long citation
    that a title begins with, wherever it stands, with any case, accents and blanks, but not as
    the end of a decree-law's. Titles without a long citation are not sought: the short form
    belongs to too many. ``docs`` has doc_id and text, and may have a title of its own.
    """
    title = F.col("title") if "title" in docs.columns else None
    entries = watched.select("item_id", citation_key(long_citation(F.col("title"))).alias("text"))
    found = find_citations(docs, entries)
    each = found.select("doc_id", "text", *([title] if title is not None else []), F.explode_outer("found").alias("f")).select("*", "f.*")  # none is empty; a filter on it would work it out a second time
    citation = F.substring("text", F.col("start") + 1, F.col("finish") - F.col("start"))
    before = F.substring("text", F.greatest(F.lit(1), F.col("start") + 1 - REACH), F.least(F.col("start"), F.lit(REACH)))
    told = each.withColumn("citation", citation).withColumn("before", before)  # the verb names it once for each form
    return told.select(
        "doc_id", F.col("item").cast(watched.schema["item_id"].dataType).alias("item_id"), "start", "citation",
        governing_verb(F.col("before"), title, F.col("citation")).alias("verb"), around(F.col("text"), F.col("start"), F.col("finish"), MARGIN).alias("snippet"),
    )


#: What stands before a verb that belongs to the name of a document ("Order 5, by which is amended ...").
NAMING = r"by which\s{1,3}"
#: Abbreviations whose full stop closes no sentence.
ABBREVIATIONS = ("art", "arts", "no", "nos", "sec", "secs", "par", "app", "cap", "pp", "mr", "mrs")


def verb_occurrences(window: Column, named: bool = False) -> Column:
    """Array of (at, verb, size, rank): the last place of each verb form in a piece of text, by place.

    A form is a whole word to its end: "amends" is not found in "amendsit". Forms in the name of
    a document (after ``NAMING``) are found only if ``named``.
    """
    low = F.lower(window)

    def last_at(form: str) -> Column:
        pattern = f"(?s)^(.*){'' if named else f'(?<!{NAMING})'}{form}(?![\\p{{L}}\\p{{N}}_])"
        return F.when(F.contains(low, F.lit(form)) & low.rlike(pattern), F.length(F.regexp_extract(low, pattern, 1)))

    found = F.array(*(F.struct(last_at(form).alias("at"), F.lit(verb).alias("verb"), F.lit(len(form)).alias("size"), F.lit(-i).alias("rank")) for i, (form, verb) in enumerate(VERB_FORMS)))
    return F.array_sort(F.filter(found, lambda f: f["at"].isNotNull()))


#: Why a verb does not reach a citation over the text between them.
REJECTS = {
    "closed": lambda rest: F.regexp_replace(rest, rf"(?i)\b(?:{'|'.join(ABBREVIATIONS)})\.", "").rlike(r"[.;:]\s+\p{Lu}"),
    "quoted": lambda rest: rest.rlike('[:"«“]'),
    "other": lambda rest: rest.rlike(r"(?i)\b(?:act|law|decree|order|regulation)\s+\d+/\d{4}"),
    "connector": lambda rest: rest.rlike(r"(?i)\b(?:pursuant to|in accordance with|referred to in|provided for in|under the terms of)\s*$"),
}


def governs(rest: Column) -> Column:
    """Whether a verb reaches a citation over the text between them.

    It does not when a sentence ends there (an abbreviation's full stop ends none), a quotation
    mark or a colon stands there, another numbered item comes in between, or a connector such as "pursuant to" makes
    the citation a mere reference.
    """
    return ~reduce(or_, (reject(rest) for reject in REJECTS.values()))


def verbs_before(docs: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, place, verb, rest, distance, governing): of every match of ``pattern`` all verbs within reach, the
    text between, its length, and which verb the citation gets."""
    mentions = citation_mentions(docs, pattern, keep=("before",))
    each = mentions.select("doc_id", "place", F.col("verb").alias("governing"), F.right("before", F.lit(REACH)).alias("window"))
    found = each.select("*", F.explode(verb_occurrences(F.col("window"))).alias("f"))
    rest = F.substring("window", (F.col("f.at") + F.col("f.size") + 1).cast("int"), F.lit(REACH))
    return found.select("doc_id", "place", F.col("f.verb").alias("verb"), rest.alias("rest"), F.length(rest).alias("distance"), "governing")


def own_title(title: Column, citation: Column) -> Column:
    """Whether the document's own title says what it does, and to the item cited: then a verb in a name counts."""
    key = citation_key(title)
    return F.coalesce(key.rlike(NAMING) & (F.trim(citation) != "") & F.contains(key, citation_key(citation)), F.lit(False))


def governing_verb(before: Column, title: Column | None = None, citation: Column | None = None) -> Column:
    """The last verb form before a citation that governs it; CITES without one.

    A verb in the name of another document doesn't count. One in the name of the document
    itself does, where its ``title`` names the ``citation``.
    """
    window = F.right(before, F.lit(REACH))
    rest = lambda f: F.substring(window, (f["at"] + f["size"] + 1).cast("int"), F.lit(REACH))
    found = verb_occurrences(window)
    if title is not None and citation is not None:
        found = F.when(own_title(title, citation), verb_occurrences(window, named=True)).otherwise(found)
    last = F.aggregate(F.reverse(found), F.lit(None).cast("string"), lambda verb, f: F.when(verb.isNotNull(), verb).when(governs(rest(f)), f["verb"]))  # each is judged once at most
    return F.coalesce(last, F.lit(CITES))


def citation_mentions(docs: DataFrame, pattern: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, place, start, citation, key, verb, snippet) of every match of ``pattern``; ``before``, the text within reach before it, where it is to be kept.

    ``docs`` has doc_id and text, and may have a title, which lets the document's own name tell its verb.
    Offsets are code points: the text is split at the citations and lengths are summed, as
    regular expressions count UTF-16 units.
    """
    title = F.col("title") if "title" in docs.columns else None
    parts = docs.select("doc_id", "text", *([title] if title is not None else []), F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(1)).alias("found"), F.split("text", pattern, -1).alias("between"))
    each = parts.filter(F.size("found") > 0).select("*", F.posexplode("found").alias("place", "citation"))
    ahead = F.aggregate(F.slice("between", F.lit(1), F.col("place") + 1), F.lit(0), lambda s, x: s + F.length(x))
    earlier = F.aggregate(F.slice("found", F.lit(1), F.col("place")), F.lit(0), lambda s, x: s + F.length(x))
    placed = each.withColumn("start", ahead + earlier)
    if "before" in keep:
        placed = placed.withColumn("before", F.right(F.substring("text", F.lit(1), F.col("start")), F.lit(REACH)))
    return placed.select(
        "doc_id", "place", "start", "citation", citation_key(F.col("citation")).alias("key"),
        governing_verb(F.substring("text", F.lit(1), F.col("start")), title, F.col("citation")).alias("verb"),
        around(F.col("text"), F.col("start"), F.col("start") + F.length("citation"), MARGIN).alias("snippet"), *keep,
    )


def strongest(mentions: DataFrame) -> DataFrame:
    """One row per document and key: its first mention with a verb of its own, else its first."""
    order = F.struct((F.col("verb") == CITES).alias("weak"), "place")
    best = mentions.groupBy("doc_id", "key").agg(F.min_by(F.struct("verb", "snippet", "start"), order).alias("best"), F.count("*").alias("mentions"))
    return best.select("doc_id", "key", "best.verb", "best.start", "best.snippet", "mentions")


def modifying_edges(references: DataFrame, watched: DataFrame) -> DataFrame:
    """References (doc_id, key, verb) that modify a watched item (key): verb filter, then a semi-join."""
    return references.filter(F.col("verb").isin(*MODIFYING)).join(watched.select("key").distinct(), "key", "left_semi")
