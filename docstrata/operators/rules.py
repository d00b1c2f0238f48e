"""The rule catalogue: prioritised rules over evidence and references; the first that fires wins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstrata.config import MODIFYING, Versions
from docstrata.functions.text import bound, precept_numbers

SETBACK, UNCLEAR, NEUTRAL, ADVANCE = "setback", "unclear", "neutral", "advance"


@dataclass(frozen=True)
class Rule:
    """A condition over the columns of ``facts``, and the verdict it gives."""

    identifier: str
    condition: Column
    verdict: Column | str
    severity: Column | int
    confidence: float


def catalogue() -> list[Rule]:
    """In order of priority. ``facts`` has arrays of watched ids and counts of evidence:
    suppressed, suppressed_specific, repealed, modified (ids), n_suppressions, n_organ."""
    some = lambda c: F.size(c) > 0
    specific = some("suppressed_specific")
    return [
        Rule("SUP-1", (F.col("n_suppressions") > 0) & some("suppressed"), F.when(specific, SETBACK).otherwise(UNCLEAR), F.when(specific, 4).otherwise(3), 0.8),
        Rule("REP-1", (F.col("n_repeals") > 0) & some("repealed"), UNCLEAR, 4, 0.5),
        Rule("MOD-1", (F.col("n_modifications") > 0) & some("modified"), UNCLEAR, 3, 0.5),
        Rule("SUP-3", F.col("n_organ") > 0, UNCLEAR, 3, 0.4),
        Rule("SUP-2", F.col("n_suppressions") > 0, UNCLEAR, 2, 0.4),
    ]


def classify(facts: DataFrame, rules: list[Rule]) -> DataFrame:
    """``facts`` with rule, verdict, severity and confidence.

    All are null where no rule fires, which is not the same as a neutral verdict. Texts
    without evidence of any family fire none.
    """
    column = lambda v: v if isinstance(v, Column) else F.lit(v)
    any_evidence = (F.col("n_suppressions") + F.col("n_repeals") + F.col("n_modifications")) > 0
    fired = F.coalesce(*(F.when(r.condition & any_evidence, F.struct(F.lit(r.identifier).alias("rule"), column(r.verdict).alias("verdict"), column(r.severity).alias("severity"), F.lit(r.confidence).alias("confidence"))) for r in rules))
    return facts.withColumn("__v", fired).select("*", "__v.rule", "__v.verdict", "__v.severity", "__v.confidence").drop("__v")


def touched(references: DataFrame, watched: DataFrame, suppresses: str) -> DataFrame:
    """Per document the watched keys that it modifies: sorted lists modified, suppressed, suppressed_specific and repealed.

    ``references`` has (doc_id, key, verb, text), ``watched`` (key, specific). Suppressed are those whose
    own reference declares it, by the pattern ``suppresses``; repealed those with that verb itself.
    The lists hold one document's keys.
    """
    known = references.filter(F.col("verb").isin(*MODIFYING)).join(watched.groupBy("key").agg(F.max("specific").alias("specific")), "key")
    declared = F.coalesce(F.col("text").rlike(suppresses), F.lit(False))
    keys = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("key"))))
    return known.groupBy("doc_id").agg(
        F.array_sort(F.collect_set("key")).alias("modified"), keys(declared).alias("suppressed"), keys(declared & F.col("specific")).alias("suppressed_specific"), keys(F.col("verb") == "REPEALS").alias("repealed")
    )


def own_changes(changes: DataFrame, edges: DataFrame, kind: str = "modified") -> DataFrame:
    """The ``changes`` (doc_id, key, ...) to watched keys that their document touches, as ``touched`` lists them."""
    return changes.join(edges.select("doc_id", F.explode(kind).alias("key")), ["doc_id", "key"], "left_semi")


def lost_terms(before: Column, after: Column) -> Column:
    """Terms of the text before that the text after lacks, sorted."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_except(F.coalesce(before, none), F.coalesce(after, none)))


def ordered_distinct(lists: Column) -> Column:
    """One list of all values in order of first appearance."""
    return F.array_distinct(F.flatten(lists))


def corroborated(pointers: Column, evidence: Column) -> Column:
    """Struct of two lists: pointers that share a precept number with some evidence, and the others."""
    numbers = F.flatten(F.transform(evidence, precept_numbers))
    shares = lambda p: F.arrays_overlap(precept_numbers(p), numbers)
    return F.struct(F.filter(pointers, lambda p: F.coalesce(shares(p), F.lit(False))).alias("confirmed"), F.filter(pointers, lambda p: ~F.coalesce(shares(p), F.lit(False))).alias("unconfirmed"))


def obsolete(now: DataFrame, before: DataFrame) -> DataFrame:
    """(id, old_rule, alerted) of rows that had a rule and have none now; ``alerted`` warns of those already published."""
    return before.filter("rule is not null").join(now.select("id", F.col("rule").alias("new_rule")), "id", "left").filter("new_rule is null").select("id", F.col("rule").alias("old_rule"), F.coalesce("alerted", F.lit(False)).alias("alerted"))


#: What the evidence of a verdict holds, always all of it: a reader must be able to tell nothing from unknown.
EVIDENCE = (
    "rule string, rules_version string, text_version string, lexicon_version string, derivation string, watched array<string>, organs array<string>, "
    "spans array<struct<start:int,finish:int,fragment:string>>, confirmed array<string>, unconfirmed array<string>, lost array<string>, changed bigint, classified_at string"
)


def with_evidence(verdicts: DataFrame, now: Column, versions: Versions = Versions()) -> DataFrame:
    """``verdicts`` with ``evidence``, JSON that lets a third party refute a verdict without this code.

    It has the keys of ``EVIDENCE``, null ones too. Lists and counts that ``verdicts`` has (watched, organs, spans,
    confirmed, unconfirmed, lost, changed) are taken, missing or null ones are empty and 0. Offsets mean
    something only with the version and the derivation of the text that they were measured on, hence those stand
    beside them. Rows without a rule have no evidence.
    """
    types = {f.name: f.dataType for f in verdicts.sparkSession.createDataFrame([], EVIDENCE).schema}
    told = {"rules_version": versions.rules, "text_version": versions.text, "lexicon_version": versions.lexicon}
    given = lambda c: F.col(c) if c in verdicts.columns else F.lit(None)

    def value(name: str) -> Column:
        if name in told:
            return F.lit(told[name])
        if name == "classified_at":
            return F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss")
        typed = given(name).cast(types[name])
        if name == "changed":
            return F.coalesce(typed, F.lit(0).cast("bigint"))
        return typed if name in ("rule", "derivation") else F.coalesce(typed, F.array().cast(types[name]))

    whole = F.to_json(F.struct(*(value(name).alias(name) for name in types)), {"ignoreNullFields": "false"})
    return verdicts.withColumn("evidence", F.when(F.col("rule").isNotNull(), whole))


def evidence_read(evidence: Column) -> Column:
    """Evidence as a struct; spans that lack an end or the fragment are dropped."""
    whole = lambda read: F.filter(read["spans"], lambda s: s["start"].isNotNull() & s["finish"].isNotNull() & s["fragment"].isNotNull())
    return bound(F.from_json(evidence, EVIDENCE), lambda read: read.withField("spans", whole(read)))
