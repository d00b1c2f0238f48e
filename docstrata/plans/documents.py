"""Queries over documents: prefilter, lexicon, clauses, citations, anchors, archive, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.config import CODE, LEXICON, LICENSE, SECRET, SETTINGS, ClausePattern
from docstrata.functions.identifiers import storage_path
from docstrata.functions.text import around, cut_with_flag, delimited, normalise, only_context, precept_numbers, short_hash, terms_present
from docstrata.lineage import cut
from docstrata.operators import anchors, clauses, extraction, gate, measure, prefilter, queues, references, rules
from docstrata.plans.common import spread, sql_list, sql_normalised, sql_terms, table

_DIRECT, _CONTEXT = list(LEXICON.direct), list(LEXICON.context)


def _evaluated(spark: SparkSession, d: str) -> DataFrame:
    """Documents as the prefilter takes them: short ones have only a title, tiny ones can't be read."""
    docs = spread(table(spark, d, "documents"))
    shaped = references.with_touched(docs, table(spark, d, "benchmark")).select(
        "doc_id", "lang", "source", F.element_at(F.split("text", "\n", 2), 1).alias("title"), F.when(F.col("n_chars") >= 200, F.col("text")).alias("body"),
        F.col("source").alias("organ"), (F.col("n_chars") < 10).alias("unreadable"), "touched", "n_chars",
    )
    return prefilter.evaluate(shaped, LEXICON)


_EVALUATED_SQL = f"""
WITH hits AS (SELECT doc_id, count(*) AS n FROM documents d JOIN benchmark b ON b.text <> '' AND contains(d.text, b.text) GROUP BY doc_id),
shaped AS (SELECT d.doc_id, lang, source, split_part(text, chr(10), 1) AS title, CASE WHEN n_chars >= 200 THEN text END AS body, n_chars < 10 AS unreadable,
                  coalesce(hits.n, 0) > 0 AS touched FROM documents d LEFT JOIN hits USING (doc_id)),
normed AS (SELECT *, {sql_normalised("coalesce(body, title, '') || ' ' || coalesce(source, '')")} AS n FROM shaped),
found AS (SELECT *, {sql_terms("n", LEXICON.terms)} AS found FROM normed),
direct AS (SELECT *, len(list_filter(found, lambda t: list_contains({sql_list(_DIRECT)}, t))) AS n_direct FROM found),
stated AS (SELECT *, CASE WHEN unreadable THEN 'unreadable' WHEN touched THEN 'relevant'
  WHEN len(found) = 0 THEN CASE WHEN body IS NOT NULL THEN 'discarded' ELSE 'pending' END
  WHEN body IS NULL THEN CASE WHEN n_direct > 0 THEN 'relevant' ELSE 'suspect' END
  WHEN n_direct = 0 THEN 'discarded' WHEN n_direct >= 8 THEN 'relevant' ELSE 'suspect' END AS state FROM direct),
evaluated AS (SELECT *, len(found) > 0 AND n_direct = 0 AS context_only,
  CASE WHEN state IN ('discarded', 'pending') THEN '' ELSE array_to_string(found, ',') END AS terms,
  CASE WHEN state IN ('discarded', 'pending') THEN '' ELSE concat_ws(',', CASE WHEN len(found) > 0 THEN 'lexical' END, CASE WHEN touched THEN 'referential' END) END AS axes FROM stated)"""


def prefilter_rows(spark: SparkSession, d: str) -> DataFrame:
    return _evaluated(spark, d).select("doc_id", "state", F.array_join("terms", ",").alias("terms"), F.array_join("axes", ",").alias("axes"), F.col("n_direct").cast("long").alias("n_direct"))


def prefilter_funnel(spark: SparkSession, d: str) -> DataFrame:
    return prefilter.funnel(_evaluated(spark, d), "lang")


def _with_terms(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents")).withColumn("found", terms_present(normalise(F.col("text")), list(LEXICON.terms)))


def lexicon_hits_ranked(spark: SparkSession, d: str) -> DataFrame:
    """In how many documents each term occurs, and in how many it is the only one."""
    each = _with_terms(spark, d).select("doc_id", F.size("found").alias("n"), F.explode("found").alias("term"))
    return each.groupBy("term").agg(F.count("*").alias("documents"), F.count_if(F.col("n") == 1).alias("rescued")).orderBy(F.desc("documents"), "term")


def context_noise_split(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of documents by what kind of terms they have, with the context terms met."""
    kind = F.when(F.size("found") == 0, "none").when(only_context(F.col("found"), _CONTEXT), "context").otherwise("direct")
    context = F.size(F.array_intersect("found", F.array(*map(F.lit, _CONTEXT)))).cast("long")
    rows = cut(_with_terms(spark, d).select(kind.alias("kind"), F.length("text").cast("long").alias("chars"), context.alias("context")))  # narrow, and read several times
    sizes = rows.groupBy("kind").agg(F.count("*").alias("documents"), F.round(F.avg("chars"), 3).alias("mean_chars"), F.max("chars").alias("max_chars"), F.sum("context").alias("context_terms"))
    sizes = sizes.join(measure.grouped_median(rows, "chars", "kind").withColumnRenamed("median", "median_chars"), "kind")
    return sizes.join(measure.nearest_rank(rows, "chars", 0.95, "kind").withColumnRenamed("at_rank", "p95_chars"), "kind")


def _versions(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the versions under which they were last evaluated, taken from the labels."""
    labels = table(spark, d, "labels").select("doc_id", "quality", "toxic")
    return table(spark, d, "documents").join(labels, "doc_id", "left").select(
        "doc_id", F.when(F.col("quality").isNotNull(), F.lit("2026-01-01")).alias("evaluated_at"),
        F.when(F.col("quality") == 1, F.lit("2026.1")).when(F.col("quality") == 0, F.lit("2025.9")).alias("lexicon_version"), F.lit("2026.1").alias("watchlist_version"),
        F.when(F.col("toxic") == 0, F.lit("2026.1")).alias("text_version"), (F.col("n_chars") >= 200).alias("has_body"),
        F.when(F.col("n_chars") >= 2000, "relevant").when(F.col("n_chars") >= 500, "suspect").otherwise("discarded").alias("state"),
        F.when(F.col("toxic") == 0, F.when(F.col("quality") == 1, F.lit("2026.1")).otherwise(F.lit("2025.9"))).alias("rules_version"),
    )


_VERSIONS_SQL = """
WITH v AS (SELECT d.doc_id, CASE WHEN quality IS NOT NULL THEN '2026-01-01' END AS evaluated_at, CASE quality WHEN 1 THEN '2026.1' WHEN 0 THEN '2025.9' END AS lexicon_version,
  '2026.1' AS watchlist_version, CASE WHEN toxic = 0 THEN '2026.1' END AS text_version, n_chars >= 200 AS has_body,
  CASE WHEN n_chars >= 2000 THEN 'relevant' WHEN n_chars >= 500 THEN 'suspect' ELSE 'discarded' END AS state,
  CASE WHEN toxic = 0 THEN CASE WHEN quality = 1 THEN '2026.1' ELSE '2025.9' END END AS rules_version
  FROM documents d LEFT JOIN labels USING (doc_id))"""


def stale_queue(spark: SparkSession, d: str) -> DataFrame:
    return _versions(spark, d).filter(prefilter.stale(SETTINGS.versions)).select("doc_id")


def stale_queue_rules(spark: SparkSession, d: str) -> DataFrame:
    return _versions(spark, d).filter(prefilter.stale_rules(SETTINGS.versions)).select("doc_id", "state")


def keyset_batch(spark: SparkSession, d: str) -> DataFrame:
    """The page of 500 after doc_id 100: the limit is the feature."""
    return queues.next_batch(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id", 100, SETTINGS.batch)


# -- clauses and rules --------------------------------------------------------------------


def _clauses(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return clauses.clauses(docs, LICENSE, SECRET, CODE)


def clauses_license(spark: SparkSession, d: str) -> DataFrame:
    return clauses.clauses(spread(table(spark, d, "documents").select("doc_id", "text")), LICENSE)


def clause_span_verify(spark: SparkSession, d: str) -> DataFrame:
    """Every clause against the text it was taken from: violations must be 0."""
    texts = table(spark, d, "documents").select("doc_id", "text")
    held = _clauses(spark, d).join(texts, "doc_id")
    good = clauses.verified(F.col("text"), F.col("start"), F.col("finish"), F.col("fragment"))
    return held.groupBy("family").agg(F.count("*").alias("clauses"), F.count_if(~good).alias("violations"), F.max(F.col("finish") - F.col("start")).alias("longest"))


def rule_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts over documents: license clauses stand for suppressions, secrets for repeals, shouting for changes."""
    found = _clauses(spark, d)
    organ = clauses.names_organ(r"\bsrc\d|\bGNU\b|\bApache\b", ("the", "under", "license"))
    families = found.groupBy("doc_id").agg(F.count_if(F.col("family") == "license").alias("n_suppressions"), F.count_if(F.col("family") == "secret").alias("n_repeals"), F.count_if(F.col("family") == "shouted").alias("n_modifications"), F.count_if(organ).alias("n_organ"))
    watched = table(spark, d, "benchmark").select("item_id", (F.length("text") >= 250).alias("specific"), "text")
    cited = references.cited_passages(spread(table(spark, d, "documents")), watched).join(watched.drop("text"), "item_id")
    ids = cited.groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("suppressed"), F.array_sort(F.collect_set(F.when(F.col("specific"), F.col("item_id")))).alias("suppressed_specific"))
    facts = families.join(ids, "doc_id", "left")
    none = F.array().cast("array<bigint>")
    facts = facts.withColumns({c: F.coalesce(c, none) for c in ("suppressed", "suppressed_specific")}).withColumns({"repealed": F.col("suppressed"), "modified": F.col("suppressed")})
    return rules.classify(facts, rules.catalogue()).select("doc_id", "n_suppressions", "n_repeals", "n_modifications", "rule", "verdict", "severity", "confidence")


def candidate_rule(spark: SparkSession, d: str) -> DataFrame:
    """What a candidate rule would add: shouting with a number, in cited documents or not, where the catalogue is silent."""
    fires = F.col("text").rlike(r"[A-Z]{3,}!!") & (F.size(precept_numbers(F.col("text"))) > 0)
    docs = spread(table(spark, d, "documents")).select("doc_id", "lang", fires.alias("fires"))
    verdicts = rule_catalogue(spark, d).filter("rule is not null").select("doc_id", F.lit(True).alias("ruled"))
    cited = citation_edges(spark, d).select("doc_id").distinct().withColumn("cited", F.lit(True))
    rows = docs.join(verdicts, "doc_id", "left").join(cited, "doc_id", "left")
    silent = F.col("ruled").isNull()
    return rows.groupBy("lang").agg(F.count_if("fires").alias("fires"), F.count_if(F.col("fires") & silent).alias("new"), F.count_if(F.col("fires") & silent & F.col("cited").isNotNull()).alias("new_and_cited"), F.count("*").alias("documents"))


def alerts_public(spark: SparkSession, d: str) -> DataFrame:
    """The public view of documents with clauses: whole spans, cut texts."""
    spans = _clauses(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "finish", "fragment"))).alias("spans"))  # of one document
    rows = table(spark, d, "documents").join(spans, "doc_id").select(F.col("doc_id").alias("id"), F.lit("2026-01-05").alias("day"), "source", "text", "spans", F.lit(None).cast("string").alias("human_sign"), F.lit("unclear").alias("sign"), F.col("source").alias("title"))
    return gate.public_alert(rows).select("id", "title", "sign", "cut", F.size("spans").alias("spans"), F.length("text").alias("chars"))


# -- citations and anchors ----------------------------------------------------------------


def citation_edges(spark: SparkSession, d: str) -> DataFrame:
    return references.cited_passages(spread(table(spark, d, "documents")), table(spark, d, "benchmark"))


_CITED = r"(?:MIT License|Apache License|GNU General Public License|Creative Commons)"


def citation_strongest(spark: SparkSession, d: str) -> DataFrame:
    return references.strongest(references.citation_mentions(spread(table(spark, d, "documents").select("doc_id", "text")), _CITED))


def verb_window(spark: SparkSession, d: str) -> DataFrame:
    """How often each verb governs a citation, and how many of those edges modify something."""
    mentions = references.citation_mentions(spread(table(spark, d, "documents").select("doc_id", "text")), _CITED)
    return mentions.groupBy("key", "verb").agg(F.count("*").alias("mentions"), F.count_distinct("doc_id").alias("documents"))


def verb_criteria(spark: SparkSession, d: str) -> DataFrame:
    """Of all verbs within reach of a citation, what keeps them from governing it, and how far they stand; checked against the rule in use."""
    verbs = references.verbs_before(spread(table(spark, d, "documents").select("doc_id", "text")), _CITED)
    return measure.criteria_distances(verbs, "distance", references.governs(F.col("rest")), 60, **{k: reject(F.col("rest")) for k, reject in references.REJECTS.items()})


def _anchored(spark: SparkSession, d: str) -> DataFrame:
    """Cited passages with their place; only texts that cite something meet the passages."""
    watched = table(spark, d, "benchmark")
    items = watched.select(F.col("item_id").cast("string").alias("touched_id"), "item_id", F.col("text").alias("quote"))
    docs = references.with_touched(spread(table(spark, d, "documents").select("doc_id", "text")), watched)
    citing = docs.filter(F.size("touched") > 0).select("doc_id", "text", F.explode("touched").alias("touched_id"))
    return citing.join(items, "touched_id").withColumn("at", anchors.anchored(F.col("text"), F.col("quote")))


def snippet_context(spark: SparkSession, d: str) -> DataFrame:
    return _anchored(spark, d).select("doc_id", "item_id", around(F.col("text"), F.col("at.start"), F.col("at.finish"), references.MARGIN).alias("snippet"))


def anchor_passages(spark: SparkSession, d: str) -> DataFrame:
    good = clauses.verified(F.col("text"), F.col("at.start"), F.col("at.finish"), F.col("at.fragment"))
    return _anchored(spark, d).select("doc_id", "item_id", F.col("at.start").cast("long").alias("start"), F.col("at.finish").cast("long").alias("finish"), good.alias("verified"))


def anchor_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """Quotes whose blanks were doubled still find their place."""
    rows = _anchored(spark, d).withColumn("loose", anchors.anchored(F.col("text"), F.replace("quote", F.lit(" "), F.lit(" \n "))))
    return rows.select("doc_id", "item_id", F.col("loose.start").cast("long").alias("start"), F.col("loose.finish").cast("long").alias("finish"))


def corroborate_pointers(spark: SparkSession, d: str) -> DataFrame:
    """Cited passages and clauses of the same document that share a precept number."""
    evidence = _clauses(spark, d).groupBy("doc_id").agg(F.collect_list("fragment").alias("evidence"))
    quoted = _anchored(spark, d).groupBy("doc_id").agg(F.collect_list("quote").alias("pointers"))
    both = evidence.join(quoted, "doc_id", "left").withColumn("pointers", F.coalesce("pointers", F.array().cast("array<string>")))
    out = both.withColumn("c", rules.corroborated(F.col("pointers"), F.col("evidence")))
    numbers = F.array_sort(F.array_distinct(F.flatten(F.transform("evidence", precept_numbers))))
    return out.select("doc_id", F.size("c.confirmed").alias("confirmed"), F.size("c.unconfirmed").alias("unconfirmed"), F.array_join(numbers, ",").alias("numbers"))


# -- archive, samples, measures -----------------------------------------------------------


def archive_paths(spark: SparkSession, d: str) -> DataFrame:
    digest = F.sha2(F.col("text"), 256)
    return table(spark, d, "documents").select("doc_id", digest.alias("sha256"), storage_path(digest, ".txt").alias("path"), short_hash(digest).alias("short"))


def dedupe_content(spark: SparkSession, d: str) -> DataFrame:
    """One row for each distinct content: its first document and how often it was archived."""
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return _evaluated(spark, d).join(table(spark, d, "labels"), "doc_id")


def confusion_signals(spark: SparkSession, d: str) -> DataFrame:
    """Queue decisions against labelled quality, by language."""
    return measure.confusion(_labelled(spark, d), F.col("quality") == 1, prefilter.queued(F.col("state")), "lang")


def census_vs_sample(spark: SparkSession, d: str) -> DataFrame:
    """The same measures over everything and over a stratified sample."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", F.contains(F.lower("text"), F.lit("license")).alias("license"))
    sample = queues.stratified(docs, "source", "doc_id", 10, "census-1")
    both = docs.withColumn("population", F.lit("census")).unionByName(sample.withColumn("population", F.lit("sample")))
    return both.groupBy("population").agg(F.count("*").alias("documents"), F.count_if("license").alias("licenses"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"), F.count_distinct("source").alias("sources"), F.count_if(F.col("lang") == "en").alias("english"))


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return queues.stratified(table(spark, d, "documents").select("doc_id", "lang", "source"), "lang", "doc_id", 25, "seed-42")


def sample_topped_up(spark: SparkSession, d: str) -> DataFrame:
    return queues.topped_up(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 5, 150, "seed-42")


def measure_ratio(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.groupBy("source").agg(measure.share(F.count_if(F.col("n_chars") > 2000), F.count("*")).alias("long_share"), F.count("*").alias("documents"))


def search_accent_insensitive(spark: SparkSession, d: str) -> DataFrame:
    """Any of three fields holds the needle, whatever its accents and case."""
    plain = lambda c: normalise(F.coalesce(c, F.lit("")))
    hit = F.contains(plain(F.col("text")), F.lit("cion")) | F.contains(plain(F.col("source")), F.lit("cion")) | F.contains(plain(F.col("lang")), F.lit("cion"))
    return spread(table(spark, d, "documents")).filter(hit).select("doc_id", "lang")


def positional_zip(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a document paired by position with their lengths."""
    lines = F.split("text", "\n", -1)
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.arrays_zip(lines.alias("line"), F.transform(lines, F.length).alias("size"))).alias("place", "z")).select("doc_id", "place", F.col("z.size").cast("long").alias("size"), F.md5("z.line").alias("line_md5"))


def crop_for_model(spark: SparkSession, d: str) -> DataFrame:
    cut = cut_with_flag(F.col("text"), SETTINGS.shown_characters)
    return table(spark, d, "documents").select("doc_id", F.md5(cut["text"]).alias("shown_md5"), cut["cut"].alias("cut"), F.length("text").cast("long").alias("full_length"), F.length(F.substring("text", 1, SETTINGS.model_characters)).cast("long").alias("model_length"), F.md5(delimited(F.substring("text", 1, SETTINGS.model_characters))).alias("prompt_md5"))


def llm_extract_scripted(spark: SparkSession, d: str) -> DataFrame:
    """Extraction through the provider interface, with scripted answers: each whole text is
    asked about in pieces, and a document's answers are merged."""
    answers = {
        "MIT License": 'Sure: {"affected": "MIT", "organ": "", "scope": "state", "articles": [{"identifier": "1", "before": "", "after": null}, {"identifier": "2", "before": "a", "after": "b"}]} done',
        "Apache": '{"affected": "Apache", "scope": "region", "articles": []}',
        "GNU": '{"affected": "GNU", "scope": "planet"}',
        "password": '{"affected": "x", "unexpected": 1}',
    }
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    asked = extraction.ask(extraction.piece_prompts(docs).drop("text"), extraction.Scripted(answers, "no answer"))
    got = extraction.merged(asked.withColumn("x", extraction.validated(F.col("answer"))), "doc_id", "full_length")
    all_affected = F.array_distinct(F.filter(F.transform("answers", lambda a: a["affected"]), lambda v: v.isNotNull()))
    return got.select("doc_id", "full_length", F.col("x").isNotNull().alias("valid"), "x.affected", "x.scope", F.size(extraction.pointers(F.col("x"))).alias("pointers"), "valid_pieces", all_affected.alias("all_affected"))


QUERIES = {
    f.__name__: f
    for f in (
        prefilter_rows, prefilter_funnel, lexicon_hits_ranked, context_noise_split, stale_queue, stale_queue_rules, keyset_batch, clauses_license, clause_span_verify,
        rule_catalogue, candidate_rule, alerts_public, citation_edges, citation_strongest, verb_window, verb_criteria, snippet_context, anchor_passages, anchor_collapsed, corroborate_pointers, archive_paths,
        dedupe_content, confusion_signals, census_vs_sample, stratified_sample, sample_topped_up, measure_ratio, search_accent_insensitive, positional_zip, crop_for_model, llm_extract_scripted,
    )
}

_N = sql_normalised("coalesce(text, '')")
_EDGES = "e AS (SELECT d.doc_id, b.item_id, d.text, b.text AS quote, strpos(d.text, b.text) - 1 AS start FROM documents d JOIN benchmark b ON b.text <> '' AND contains(d.text, b.text))"


def _sql_family(pattern: ClausePattern) -> str:
    """Clauses of one family. RE2 has no look-behind: the boundary keeps its neighbours in
    groups, and is marked twice, as one may begin where the last ended."""
    construction, companion = f"(?i){pattern.construction}", f"(?i){pattern.companion}"
    boundary, marked = r"""'([.;:»”"\)])(\s+)([«"“(A-ZÁÉÍÓÚÑ])'""", r"'\1' || chr(1) || '\2' || chr(2) || '\3'"
    gap = r"chr(1) || '\s+' || chr(2)"
    return f"""(WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(text, {boundary}, {marked}, 'g'), {boundary}, {marked}, 'g') AS m FROM documents
  WHERE regexp_matches(text, '{construction}') AND regexp_matches(text, '{companion}')),
p AS (SELECT doc_id, string_split_regex(m, {gap}) AS pieces, regexp_extract_all(m, {gap}) AS gaps FROM t),
x AS (SELECT doc_id, pieces, gaps, unnest(range(1, len(pieces) + 1)) AS i FROM p),
s AS (SELECT doc_id, coalesce(list_sum(list_transform(pieces[1:i - 1], lambda e: length(e))), 0) + coalesce(list_sum(list_transform(gaps[1:i - 1], lambda e: length(e) - 2)), 0) AS start, pieces[i] AS fragment FROM x),
f AS (SELECT *, regexp_extract_all(fragment, '{construction}') AS found, string_split_regex(fragment, '{construction}') AS between FROM s WHERE regexp_matches(fragment, '{construction}')),
k AS (SELECT doc_id, start, fragment, found, between, unnest(range(1, len(found) + 1)) AS i FROM f WHERE length(fragment) > 1000),
h AS (SELECT doc_id, start, fragment, length(found[i]) AS size, list_sum(list_transform(between[1:i], lambda e: length(e))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda e: length(e))), 0) AS place FROM k),
w AS (SELECT doc_id, start, fragment, 0 AS first, length(fragment) AS last FROM f WHERE length(fragment) <= 1000
  UNION ALL SELECT doc_id, start, fragment, greatest(0, place - (1000 - size) // 2), least(length(fragment), place + size + (1000 - size) // 2) FROM h),
z AS (SELECT doc_id, CAST(start + first AS INTEGER) AS start, CAST(start + last AS INTEGER) AS finish, substr(fragment, CAST(first + 1 AS BIGINT), CAST(last - first AS BIGINT)) AS fragment FROM w),
d AS (SELECT DISTINCT * FROM z WHERE regexp_matches(fragment, '{companion}'))
SELECT doc_id, '{pattern.name}' AS family, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start, finish) - 1 AS INTEGER) AS place, start, finish, fragment FROM d QUALIFY place < 50)"""


_CLAUSES_SQL = "c AS (" + " UNION ALL ".join(f"SELECT * FROM {_sql_family(p)}" for p in (LICENSE, SECRET, CODE)) + ")"


def _sql_numbers(text: str) -> str:
    """Precept numbers. RE2 knows ASCII word boundaries only, so other letters become ones that it knows."""
    return f"regexp_extract_all(regexp_replace({text}, '[À-ɏ]', '_', 'g'), " + r"'\b(?:\d{1,4}|[IVXLC]{1,7})\b')"


_CITED_SQL = "e AS (SELECT d.doc_id, b.item_id, b.text AS quote FROM documents d JOIN benchmark b ON b.text <> '' AND contains(d.text, b.text))"
_ORGAN_SQL = r"regexp_matches(fragment, '(?i)\bsrc\d|\bGNU\b|\bApache\b') AND (" + " OR ".join(f"contains(' ' || {sql_normalised('fragment')} || ' ', ' {t} ')" for t in ("the", "under", "license")) + ")"
_VERDICTS_SQL = f"""{_CLAUSES_SQL}, {_CITED_SQL},
n AS (SELECT doc_id, count(*) FILTER (family = 'license') AS n_suppressions, count(*) FILTER (family = 'secret') AS n_repeals, count(*) FILTER (family = 'shouted') AS n_modifications, count(*) FILTER ({_ORGAN_SQL}) AS n_organ FROM c GROUP BY doc_id),
q AS (SELECT doc_id, true AS cited, bool_or(length(quote) >= 250) AS specific FROM e GROUP BY doc_id),
r AS (SELECT n.*, CASE WHEN n_suppressions > 0 AND coalesce(cited, false) THEN 'SUP-1' WHEN n_repeals > 0 AND coalesce(cited, false) THEN 'REP-1' WHEN n_modifications > 0 AND coalesce(cited, false) THEN 'MOD-1'
  WHEN n_organ > 0 THEN 'SUP-3' WHEN n_suppressions > 0 THEN 'SUP-2' END AS rule, coalesce(specific, false) AS specific FROM n LEFT JOIN q USING (doc_id))"""

SQL = {
    "clauses_license": f"SELECT * FROM {_sql_family(LICENSE)}",
    "clause_span_verify": f"WITH {_CLAUSES_SQL} SELECT family, count(*) AS clauses, CAST(0 AS BIGINT) AS violations, max(finish - start) AS longest FROM c GROUP BY family",
    "rule_catalogue": f"""WITH {_VERDICTS_SQL} SELECT doc_id, n_suppressions, n_repeals, n_modifications, rule, CASE WHEN rule = 'SUP-1' AND specific THEN 'setback' WHEN rule IS NOT NULL THEN 'unclear' END AS verdict,
  CASE rule WHEN 'SUP-1' THEN CASE WHEN specific THEN 4 ELSE 3 END WHEN 'REP-1' THEN 4 WHEN 'MOD-1' THEN 3 WHEN 'SUP-3' THEN 3 WHEN 'SUP-2' THEN 2 END AS severity,
  CAST(CASE rule WHEN 'SUP-1' THEN 0.8 WHEN 'REP-1' THEN 0.5 WHEN 'MOD-1' THEN 0.5 WHEN 'SUP-3' THEN 0.4 WHEN 'SUP-2' THEN 0.4 END AS DOUBLE) AS confidence FROM r""",
    "candidate_rule": f"""WITH {_VERDICTS_SQL}, x AS (SELECT lang, regexp_matches(text, '[A-Z]{{3,}}!!') AND len({_sql_numbers('text')}) > 0 AS fires, r.rule IS NULL AS silent, q.cited IS NOT NULL AS cited
  FROM documents d LEFT JOIN r USING (doc_id) LEFT JOIN q USING (doc_id))
SELECT lang, count(*) FILTER (fires) AS fires, count(*) FILTER (fires AND silent) AS new, count(*) FILTER (fires AND silent AND cited) AS new_and_cited, count(*) AS documents FROM x GROUP BY lang""",
    "alerts_public": f"""WITH {_CLAUSES_SQL}, n AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS spans FROM c GROUP BY doc_id)
SELECT doc_id AS id, source AS title, 'unclear' AS sign, length(text) > 700 AS cut, spans, CAST(length(CASE WHEN length(text) > 700 THEN rtrim(substr(text, 1, 700), ' ') || ' […]' ELSE text END) AS INTEGER) AS chars FROM n JOIN documents USING (doc_id)""",
    "corroborate_pointers": f"""WITH {_CLAUSES_SQL}, {_CITED_SQL},
g AS (SELECT doc_id, list_sort(list_distinct(flatten(list({_sql_numbers('fragment')})))) AS numbers FROM c GROUP BY doc_id),
k AS (SELECT g.doc_id, numbers, count(quote) FILTER (list_has_any(numbers, {_sql_numbers('quote')})) AS confirmed, count(quote) AS quotes FROM g LEFT JOIN e USING (doc_id) GROUP BY ALL)
SELECT doc_id, CAST(confirmed AS INTEGER) AS confirmed, CAST(quotes - confirmed AS INTEGER) AS unconfirmed, array_to_string(numbers, ',') AS numbers FROM k""",
    "prefilter_rows": f"{_EVALUATED_SQL} SELECT doc_id, state, terms, axes, CAST(n_direct AS BIGINT) AS n_direct FROM evaluated",
    "prefilter_funnel": f"""{_EVALUATED_SQL} SELECT lang, count(*) AS documents, count(*) FILTER (state = 'relevant') AS relevant, count(*) FILTER (state = 'suspect') AS suspect,
  count(*) FILTER (state = 'discarded') AS discarded, count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'unreadable') AS unreadable,
  count(*) FILTER (axes LIKE '%lexical%') AS lexical, count(*) FILTER (axes LIKE '%referential%') AS referential, count(*) FILTER (context_only) AS context_only,
  count(*) FILTER (body IS NOT NULL) AS full_text FROM evaluated GROUP BY lang""",
    "lexicon_hits_ranked": f"""WITH f AS (SELECT {sql_terms(_N, LEXICON.terms)} AS found FROM documents), x AS (SELECT len(found) AS n, unnest(found) AS term FROM f)
SELECT term, count(*) AS documents, count(*) FILTER (n = 1) AS rescued FROM x GROUP BY term ORDER BY documents DESC, term""",
    "context_noise_split": f"""WITH f AS (SELECT {sql_terms(_N, LEXICON.terms)} AS found, CAST(length(text) AS BIGINT) AS chars FROM documents),
k AS (SELECT *, len(list_filter(found, lambda t: list_contains({sql_list(_CONTEXT)}, t))) AS nc FROM f),
c AS (SELECT *, CASE WHEN len(found) = 0 THEN 'none' WHEN nc = len(found) THEN 'context' ELSE 'direct' END AS kind FROM k)
SELECT kind, count(*) AS documents, round(avg(chars), 3) AS mean_chars, median(chars) AS median_chars, max(chars) AS max_chars, CAST(sum(nc) AS BIGINT) AS context_terms,
  list_sort(list(chars))[CAST(least(floor(0.95 * count(*)), count(*) - 1) AS BIGINT) + 1] AS p95_chars FROM c GROUP BY kind""",
    "stale_queue": f"""{_VERSIONS_SQL} SELECT doc_id FROM v WHERE evaluated_at IS NULL OR lexicon_version IS DISTINCT FROM '2026.1' OR watchlist_version IS DISTINCT FROM '2026.1'
  OR (has_body AND text_version IS DISTINCT FROM '2026.1')""",
    "stale_queue_rules": f"""{_VERSIONS_SQL} SELECT doc_id, state FROM v WHERE state IN ('relevant', 'suspect') AND (rules_version IS DISTINCT FROM '2026.1' OR coalesce(text_version <> '2026.1', false))""",
    "keyset_batch": "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 500",
    "citation_edges": "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON b.text <> '' AND contains(d.text, b.text)",
    "snippet_context": f"WITH {_EDGES} SELECT doc_id, item_id, trim(substr(text, greatest(0, start - 80) + 1, start + length(quote) + 80 - greatest(0, start - 80)), ' ') AS snippet FROM e",
    "anchor_passages": f"WITH {_EDGES} SELECT doc_id, item_id, CAST(start AS BIGINT) AS start, CAST(start + length(quote) AS BIGINT) AS finish, substr(text, start + 1, length(quote)) = quote AS verified FROM e",
    "anchor_collapsed": f"WITH {_EDGES} SELECT doc_id, item_id, CAST(start AS BIGINT) AS start, CAST(start + length(quote) AS BIGINT) AS finish FROM e",
    "archive_paths": "SELECT doc_id, sha256(text) AS sha256, substr(sha256(text), 1, 2) || '/' || substr(sha256(text), 3, 2) || '/' || sha256(text) || '.txt' AS path, substr(sha256(text), 1, 8) || '…' || right(sha256(text), 6) AS short FROM documents",
    "dedupe_content": "SELECT sha256(text) AS sha256, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY 1",
    "confusion_signals": f"""{_EVALUATED_SQL}, x AS (SELECT lang, quality = 1 AS e, state IN ('relevant', 'suspect') AS f FROM evaluated JOIN labels USING (doc_id)),
c AS (SELECT lang, count(*) AS cases, count(*) FILTER (e AND f) AS agreed, count(*) FILTER (NOT e AND f) AS only_found, count(*) FILTER (e AND NOT f) AS only_expected, count(*) FILTER (NOT e AND NOT f) AS neither FROM x GROUP BY lang)
SELECT *, round(CAST(agreed AS DOUBLE) / nullif(agreed + only_found, 0), 4) AS precision, round(CAST(agreed AS DOUBLE) / nullif(agreed + only_expected, 0), 4) AS recall FROM c""",
    "census_vs_sample": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha256('census-1' || CAST(doc_id AS VARCHAR)), doc_id) AS n, contains(lower(text), 'license') AS license FROM documents),
b AS (SELECT 'census' AS population, * FROM r UNION ALL SELECT 'sample', * FROM r WHERE n <= 10)
SELECT population, count(*) AS documents, count(*) FILTER (license) AS licenses, CAST(sum(n_chars) AS BIGINT) AS chars, max(n_chars) AS longest, count(DISTINCT source) AS sources, count(*) FILTER (lang = 'en') AS english FROM b GROUP BY population""",
    "stratified_sample": "SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sha256('seed-42' || CAST(doc_id AS VARCHAR)), doc_id) <= 25",
    "sample_topped_up": """WITH r AS (SELECT doc_id, source, sha256('seed-42' || CAST(doc_id AS VARCHAR)) AS h, row_number() OVER (PARTITION BY source ORDER BY sha256('seed-42' || CAST(doc_id AS VARCHAR)), doc_id) AS n FROM documents)
SELECT doc_id, source FROM r ORDER BY (n <= 5) DESC, h, doc_id LIMIT 150""",
    "measure_ratio": "SELECT source, round(CAST(count(*) FILTER (n_chars > 2000) AS DOUBLE) / count(*), 4) AS long_share, count(*) AS documents FROM documents GROUP BY source",
    "search_accent_insensitive": f"SELECT doc_id, lang FROM documents WHERE contains({_N}, 'cion') OR contains({sql_normalised('source')}, 'cion') OR contains({sql_normalised('lang')}, 'cion')",
    "positional_zip": "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), x AS (SELECT doc_id, unnest(range(len(lines))) AS place, unnest(lines) AS line FROM l) SELECT doc_id, CAST(place AS INTEGER) AS place, CAST(length(line) AS BIGINT) AS size, md5(line) AS line_md5 FROM x",
    "crop_for_model": """SELECT doc_id, md5(CASE WHEN length(text) > 700 THEN rtrim(substr(text, 1, 700), ' ') || ' […]' ELSE text END) AS shown_md5, length(text) > 700 AS cut, CAST(length(text) AS BIGINT) AS full_length, CAST(length(substr(text, 1, 4000)) AS BIGINT) AS model_length,
  md5('<<<' || chr(10) || replace(replace(substr(text, 1, 4000), '<<<', '< < <'), '>>>', '> > >') || chr(10) || '>>>') AS prompt_md5 FROM documents""",
}
