"""Queries over what is watched: touched items and their changes, regions and silences, sources by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.operators import coverage, gate, references, rules
from docstrata.plans.common import table
from docstrata.plans.pages_events import _attribute, _element
from docstrata.plans.relations import _RANK_SQL, _orders, _parties, _rank
from docstrata.sources import registry, scanner, summaries

# -- touched items and their changes ------------------------------------------------------

#: An order is a document, a line its reference to a part: A repeals, R amends, N only cites.
_SUPPRESSES = r"(?i)\bsuppress(?:es|ed)?\b"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    verb = F.when(F.col("l_returnflag") == "A", "REPEALS").when(F.col("l_returnflag") == "R", "AMENDS").otherwise("CITES")
    text = F.when(F.col("l_linestatus") == "F", "art. 3; and SUPPRESSES art. 7").otherwise("art. 3")
    references = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("key"), verb.alias("verb"), text.alias("text"))
    watched = table(spark, d, "part").filter("p_size <= 10").select(F.col("p_partkey").alias("key"), (F.col("p_size") <= 3).alias("specific"))
    return rules.touched(references, watched, _SUPPRESSES)


def citation_index(spark: SparkSession, d: str) -> DataFrame:
    """A line is a document that names its part by a long citation, in its own spelling; the titles of small parts are watched.

    Returned lines repeal or amend; the others speak of a decree-law of the same number, which is another document.
    """
    parts = table(spark, d, "part").select("p_partkey", "p_size", F.concat(F.lit("Ley "), F.col("p_partkey").cast("string"), F.lit("/"), (F.lit(1950) + F.col("p_size")).cast("string")).alias("number"))
    watched = parts.filter("p_size <= 10").select(F.col("p_partkey").alias("item_id"), F.concat("number", F.lit(", de "), F.col("p_size").cast("string"), F.lit(" de mayo, de partes")).alias("title"))
    lines = table(spark, d, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    start = F.when(F.col("l_returnflag") == "A", "Art. 1. It repeals art. 2 of the ").when(F.col("l_returnflag") == "R", "It amends (").otherwise("It amends the Decreto ")
    cited = F.concat(F.when(F.col("l_linestatus") == "F", F.upper("number")).otherwise(F.col("number")), F.lit(", de\n "), F.col("p_size").cast("string"), F.lit("  de Mayo"))
    docs = lines.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("doc_id"), F.concat(start, cited, F.lit(") and ends.")).alias("text"))
    return references.watched_citations(docs, watched)


def _listed(name: str) -> Column:
    return F.array_join(F.transform(name, lambda k: k.cast("string")), ",").alias(name)


def touched_items(spark: SparkSession, d: str) -> DataFrame:
    """The watched parts of each order by what is done to them."""
    return _edges(spark, d).select("doc_id", *(_listed(c) for c in ("modified", "suppressed", "suppressed_specific", "repealed")))


def watched_changes(spark: SparkSession, d: str) -> DataFrame:
    """Changes to watched parts that their order touches: how many, and which words of the name they lose."""
    names = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.split("p_name", " ").alias("before"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("key"), "l_quantity")
    changes = lines.join(names, "key").withColumn("after", F.when(F.col("l_quantity") > 25, F.slice("before", 1, 1)).otherwise(F.col("before")))
    own = rules.own_changes(changes, _edges(spark, d)).withColumn("lost", rules.lost_terms(F.col("before"), F.col("after")))
    return own.groupBy("doc_id").agg(F.count("*").alias("changes"), F.sum(F.size("lost")).alias("lost"))


def gate_admissions(spark: SparkSession, d: str) -> DataFrame:
    """Orders by priority, and how many of them may reach a reviewer: a rule fired and a watched part is touched."""
    rows = _orders(spark, d).join(_edges(spark, d), F.col("o_orderkey") == F.col("doc_id"), "left")
    fired = F.when(F.col("o_orderstatus") != "P", F.lit("SUP-1"))
    admitted = gate.may_enter(fired, F.col("modified"), F.array().cast("array<string>"))
    return rows.groupBy("o_orderpriority").agg(F.count("*").alias("orders"), F.count_if(admitted).alias("admitted"))


def obsolete_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Orders that had a rule and have none now, with the warning for those that were alerted."""
    orders = _orders(spark, d)
    before = orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_totalprice") > 100000, F.col("o_orderpriority")).alias("rule"), F.when(F.col("o_orderstatus") == "O", F.lit(True)).alias("alerted"))
    now = orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_totalprice") > 200000, F.lit("SUP-1")).alias("rule"))
    return rules.obsolete(now, before)


def documents_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The first page of orders of one priority; the filter by status is open."""
    rows = _orders(spark, d).select("o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("day"), "o_orderpriority", "o_orderstatus")
    return gate.page(rows, [F.desc("day"), F.desc("o_orderkey")], limit=50, o_orderpriority="2-HIGH", o_orderstatus=None)


# -- regions ------------------------------------------------------------------------------


def coverage_legibility(spark: SparkSession, d: str) -> DataFrame:
    """Customers and those in debt by region; the ones of AFRICA have no region and are a group."""
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.when(F.col("r_name") != "AFRICA", F.col("r_name")).alias("region"), "c_acctbal")
    return coverage.legible_counts(rows, "region", F.col("c_acctbal") < 0)


def map_every_region(spark: SparkSession, d: str) -> DataFrame:
    """Nations drawn, covered by suppliers, or touched by waiting orders, whichever side knows them."""
    code = lambda c: F.concat(F.lit("N"), F.col(c).cast("string"))
    nation = table(spark, d, "nation")
    drawn = nation.filter("n_regionkey < 2").select(code("n_nationkey").alias("region"), F.col("n_name").alias("name"))
    suppliers = table(spark, d, "supplier").join(nation.filter("n_regionkey between 1 and 3"), F.col("s_nationkey") == F.col("n_nationkey"))
    covered = suppliers.groupBy(code("n_nationkey").alias("region")).agg(F.count("*").alias("known"), F.count_if(F.col("s_acctbal") > 5000).alias("watched"))
    waiting = _parties(spark, d).filter("o_orderstatus = 'P' and n_regionkey <> 1")
    scope = F.array(F.when(F.col("o_orderpriority") == "5-LOW", coverage.NATIONAL).otherwise(code("n_nationkey")))
    alerts = waiting.withColumns({"regions": scope, "title": F.col("o_orderkey").cast("string"), "place": -F.unix_micros(F.col("o_orderdate").cast("timestamp"))})
    return coverage.every_region(drawn, covered, alerts, -_rank(), "o_orderpriority", "title", "place", -F.col("o_orderkey"))


def map_silences(spark: SparkSession, d: str) -> DataFrame:
    return coverage.silences(map_every_region(spark, d))


# -- sources ------------------------------------------------------------------------------


def sources_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Customers as a gazette, order lines as registers, events as open data, pages of no known source; read and counted."""
    item = _element("item", _element("identificador", F.concat(F.lit("CUS-"), F.col("c_custkey").cast("string"))), _element("titulo", _attribute(F.col("c_name"))), _element("url_xml", F.lit("u")), _element("url_pdf", F.lit("p")))
    hundred = F.floor(F.col("c_custkey") / 100).alias("hundred")  # an issue holds a hundred customers
    day = F.date_add(F.lit("2026-01-01").cast("date"), (F.col("hundred") % 3000).cast("int"))
    packed = table(spark, d, "customer").groupBy(hundred).agg(F.array_join(F.collect_list(item), "").alias("all"))
    section = lambda n: F.concat(F.lit(f"<seccion codigo='{n}'><departamento><nombre>n</nombre>"), "all", F.lit("</departamento></seccion>"))
    summary = F.concat(F.lit("<response><status><code>200</code></status><data><sumario><metadatos><fecha_publicacion>"), F.date_format(day, "yyyyMMdd"), F.lit("</fecha_publicacion></metadatos><diario>"), section(1), section(2), F.lit("</diario></sumario></data></response>"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_linestatus").alias("s"))
    docn = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    one = _element("registro", _element("docn", docn), _element("fecha", F.when(F.col("s") == "F", F.lit("20260105")).otherwise("20260104")), _element("titulo", F.lit("line")))
    registers = lines.groupBy("l_orderkey").agg(F.concat(F.lit("<?xml version='1.0'?><documento>"), F.array_join(F.collect_list(one), ""), F.lit("</documento>")).alias("content"))
    row = F.to_json(F.array(F.struct(F.lpad(F.col("event_id").cast("string"), 10, "0").alias("control"), F.col("event_type").alias("title_es"), F.when(F.col("event_type") != "error", F.lit("https://x.example")).alias("url"))))
    fixed = F.lit("2026-01-05").cast("date").alias("day")
    raw = (
        packed.select(F.lit("gazette").alias("source"), day.alias("day"), summary.alias("content"))
        .unionByName(registers.select(F.lit("register").alias("source"), fixed, "content"))
        .unionByName(table(spark, d, "events").select(F.lit("open_data").alias("source"), F.to_date("ts").alias("day"), row.alias("content")))
        .unionByName(table(spark, d, "pages").select(F.when(F.col("page_id") % 2 == 0, F.lit("web")).alias("source"), fixed, F.col("html").alias("content")))
    )
    read = registry.items(raw).select("source", F.when(F.col("good"), "good").otherwise("quarantined").alias("state"), "identifier")
    lost = registry.unknown(raw).select(F.coalesce("source", F.lit("none")).alias("source"), F.lit("unknown").alias("state"), F.lit(None).cast("string").alias("identifier"))
    return read.union(lost).groupBy("source", "state").agg(F.count("*").alias("rows"), F.min("identifier").alias("first"))


def coverage_nested(spark: SparkSession, d: str) -> DataFrame:
    """Nations with their market segments as levels, by name, and their suppliers in credit as laws, by number."""
    levels = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("region"), F.col("c_mktsegment").alias("level")).agg(F.count("*").alias("known"), F.count_if(F.col("c_acctbal") > 0).alias("watched"))
    laws = table(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_nationkey").alias("region"), F.col("s_suppkey").alias("law"))
    rows = coverage.nested(levels, laws, "region", "level", "law")
    told = F.transform("levels", lambda x: F.concat_ws(":", x["level"], x["known"].cast("string"), x["watched"].cast("string")))
    return rows.select("region", F.array_join(told, ",").alias("levels"), F.array_join(F.transform("laws", lambda x: x["law"].cast("string")), ",").alias("laws"))


def verdict_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Orders as verdicts, their lines as spans, a returned one has no end: written as evidence, and read back with all its keys."""
    span = F.struct(F.col("l_linenumber").alias("start"), F.when(F.col("l_returnflag") != "A", F.col("l_partkey").cast("int")).alias("finish"), F.col("l_linestatus").alias("fragment"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(span)).alias("spans"), F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))).alias("watched"))  # of one order
    verdicts = _orders(spark, d).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "spans", "watched", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("rule"), F.lit("xml").alias("derivation"), F.col("o_orderdate").cast("timestamp_ntz").alias("at"))
    written = rules.with_evidence(verdicts, F.col("at"))
    read = written.withColumn("e", rules.evidence_read(F.col("evidence")))
    return read.select(
        "o_orderkey", "e.rule", "e.rules_version", "e.text_version", "e.lexicon_version", F.size("e.spans").cast("long").alias("spans"), F.size("e.watched").cast("long").alias("watched"), F.size("e.organs").cast("long").alias("organs"),
        F.array_join("e.watched", ",").alias("keys"), F.size(F.json_object_keys("evidence")).cast("long").alias("fields"), F.substring("e.classified_at", 1, 10).alias("day"),
    )


def page_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Orders as summary pages, a line an item: headings hold, titles are used up, links repeat and some are of another day."""
    number = (F.col("l_orderkey") * 100 + F.col("l_linenumber")).cast("string")
    lines = table(spark, d, "lineitem").repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("status"))
    day = F.date_add(F.lit("2026-01-01").cast("date"), (F.col("l_orderkey") % 300).cast("int"))
    link = F.concat(F.lit("<a href='BOCYL-D-"), F.date_format(day, "ddMMyyyy"), F.lit("-"), number, F.lit(".pdf'>"))
    title = F.when(F.col("flag") != "A", F.concat(F.lit("<p>The line with number "), F.col("l_linenumber").cast("string"), F.lit("</p>"))).otherwise("")
    section = F.when(F.col("status") == "O", F.concat(F.lit("<h3>Open &amp; <b>"), "flag", F.lit("</b></h3>"))).otherwise("")
    one = F.concat(section, title, F.lit("<a href='BOCYL-D-01012022-1.pdf'>"), link, F.lit("<!-- "), link, F.lit(" -->"))
    packed = lines.withColumn("x", one).groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "x"))), lambda e: e["x"]), "").alias("content"))
    return scanner.page_items(packed.select(day.alias("day"), "content")).select("identifier", "title", "section", "state")


def deed_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Orders as nested summaries of deeds, a line a deed, all twice; every tenth summary is of another day."""
    day = F.date_add(F.lit("2026-01-01").cast("date"), (F.col("l_orderkey") % 300).cast("int"))
    issue = F.concat(F.lit("BOCM-"), F.date_format(F.when(F.col("l_orderkey") % 10 == 0, F.date_add(day, 1)).otherwise(day), "yyyyMMdd"))
    keyed = table(spark, d, "lineitem").repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag")).select("*", day.alias("day"), issue.alias("issue"))
    identifier = F.concat("issue", F.lit("-"), (F.floor(F.col("l_orderkey") / 300) * 8 + F.col("l_linenumber")).cast("string"))
    one = _element("disposicion", _element("identificador", identifier), _element("titulo", F.concat(F.lit(" Line "), F.col("l_linenumber").cast("string"))), _element("url_xml", F.lit("u")))
    under = F.concat(F.lit("<organismo nombre='"), "flag", F.lit("'>"), one, F.lit("</organismo>"))
    packed = keyed.groupBy("l_orderkey", "day", "issue").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", under.alias("x")))), lambda e: e["x"]), "").alias("all"))
    section = lambda n: F.concat(F.lit(f"<seccion nombre='S{n}'><apartado nombre='H'>"), "all", F.lit("</apartado></seccion>"))
    content = F.concat(F.lit("<sumario><metadatos><identificador>"), "issue", F.lit("</identificador></metadatos><diario><secciones>"), section(1), section(2), F.lit("</secciones></diario></sumario>"))
    got = summaries.deeds(packed.select("day", content.alias("content")))
    return got.groupBy("good", "section", "heading", "organ").agg(F.count("*").alias("rows"), F.min("identifier").alias("first"))


def region_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The six nations with the most customers in debt, by Spanish names: equal numbers (here by tens) are ordered as Spanish orders ñ and accents."""
    name = F.translate(F.initcap("n_name"), "nai", "ñáí")
    nations = table(spark, d, "nation").select("n_nationkey", name.alias("name"))
    indebted = table(spark, d, "customer").filter("c_acctbal < 0").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.floor(F.count("*") / 10).alias("alerts"))
    return coverage.ranking(nations.join(indebted, "n_nationkey", "left").select("name", F.coalesce("alerts", F.lit(0)).alias("alerts")), "alerts", "name")


QUERIES = {
    f.__name__: f
    for f in (citation_index, touched_items, watched_changes, gate_admissions, obsolete_verdicts, documents_filtered, coverage_legibility, map_every_region, map_silences, coverage_nested, verdict_evidence, sources_by_name, page_summaries, deed_summaries, region_ranking)
}

_SQL_EDGES = """w AS (SELECT p_partkey AS key, p_size <= 3 AS specific FROM part WHERE p_size <= 10),
e AS (SELECT l_orderkey AS doc_id, key, specific, l_returnflag = 'A' AS repeals, l_linestatus = 'F' AS suppresses FROM lineitem JOIN w ON l_partkey = key WHERE l_returnflag IN ('A', 'R'))"""

_SQL_MAP = f"""n AS (SELECT 'N' || CAST(n_nationkey AS VARCHAR) AS region, * FROM nation),
c AS (SELECT region, count(*) AS known, count(*) FILTER (s_acctbal > 5000) AS watched FROM supplier JOIN n ON s_nationkey = n_nationkey WHERE n_regionkey BETWEEN 1 AND 3 GROUP BY 1),
a AS (SELECT region, arg_min(o_orderpriority, {_RANK_SQL}) AS worst, CAST(arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS VARCHAR) AS first_title, count(*) AS alerts
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN n ON c_nationkey = n_nationkey WHERE o_orderstatus = 'P' AND n_regionkey <> 1 AND o_orderpriority <> '5-LOW' GROUP BY 1),
m AS (SELECT region, coalesce(d.n_name, region) AS name, coalesce(known, 0) AS known, coalesce(watched, 0) AS watched, worst, first_title, coalesce(alerts, 0) AS alerts
  FROM (SELECT region FROM n WHERE n_regionkey < 2 UNION SELECT region FROM c UNION SELECT region FROM a) LEFT JOIN (SELECT * FROM n WHERE n_regionkey < 2) d USING (region) LEFT JOIN c USING (region) LEFT JOIN a USING (region))"""



_SQL_CITED = """SELECT l_orderkey * 8 + l_linenumber AS doc_id, p_partkey AS item_id, CAST(length(before) AS INTEGER) AS start, cited AS citation,
  CASE l_returnflag WHEN 'A' THEN 'REPEALS' ELSE 'AMENDS' END AS verb, right(before, 80) || cited || ') and ends.' AS snippet
FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 'Art. 1. It repeals art. 2 of the ' ELSE 'It amends (' END AS before,
             CASE l_linestatus WHEN 'F' THEN 'LEY ' ELSE 'Ley ' END || p_partkey || '/' || (1950 + p_size) || ', de' || chr(10) || ' ' || p_size || '  de Mayo' AS cited
      FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size <= 10 AND l_returnflag IN ('A', 'R'))"""

SQL = {
    "citation_index": _SQL_CITED,
    "touched_items": f"""WITH {_SQL_EDGES}, l AS (SELECT doc_id, {", ".join(f"list_sort(list(DISTINCT key) FILTER ({c})) AS {n}" for c, n in (("true", "modified"), ("suppresses", "suppressed"), ("suppresses AND specific", "suppressed_specific"), ("repeals", "repealed")))} FROM e GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(array_to_string({n}, ','), '') AS {n}" for n in ("modified", "suppressed", "suppressed_specific", "repealed"))} FROM l""",
    "watched_changes": f"""WITH {_SQL_EDGES}, x AS (SELECT l_orderkey AS doc_id, l_quantity, list_distinct(string_split(p_name, ' ')) AS words, string_split(p_name, ' ')[1] AS one FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE EXISTS (SELECT 1 FROM e WHERE e.doc_id = l_orderkey AND e.key = l_partkey))
SELECT doc_id, count(*) AS changes, CAST(sum(CASE WHEN l_quantity > 25 THEN len(list_filter(words, lambda v: v <> one)) ELSE 0 END) AS BIGINT) AS lost FROM x GROUP BY doc_id""",
    "gate_admissions": f"""WITH {_SQL_EDGES} SELECT o_orderpriority, count(*) AS orders, count(*) FILTER (o_orderstatus <> 'P' AND EXISTS (SELECT 1 FROM e WHERE e.doc_id = o_orderkey)) AS admitted FROM orders GROUP BY 1""",
    "obsolete_verdicts": "SELECT o_orderkey AS id, o_orderpriority AS old_rule, o_orderstatus = 'O' AS alerted FROM orders WHERE o_totalprice > 100000 AND NOT o_totalprice > 200000",
    "documents_filtered": "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, o_orderpriority, o_orderstatus FROM orders WHERE o_orderpriority = '2-HIGH' ORDER BY day DESC, o_orderkey DESC LIMIT 50",
    "coverage_legibility": """SELECT CASE WHEN r_name <> 'AFRICA' THEN r_name END AS region, count(*) AS rows, count(*) FILTER (c_acctbal < 0) AS unreadable
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""",
    "map_every_region": f"WITH {_SQL_MAP} SELECT * FROM m",
    "map_silences": f"WITH {_SQL_MAP} SELECT count(*) FILTER (alerts = 0 AND watched > 0) AS watched_and_quiet, count(*) FILTER (alerts = 0 AND watched = 0) AS not_watched, count(*) AS regions FROM m",
    "sources_by_name": """WITH l AS (SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS id, min(l_linestatus) AS s FROM lineitem GROUP BY l_orderkey, l_linenumber),
x AS (SELECT 'gazette' AS source, 'good' AS state, 'CUS-' || CAST(c_custkey AS VARCHAR) AS id FROM customer
  UNION ALL SELECT 'register', CASE WHEN s = 'F' THEN 'good' ELSE 'quarantined' END, id FROM l
  UNION ALL SELECT 'open_data', CASE WHEN event_type <> 'error' THEN 'good' ELSE 'quarantined' END, lpad(CAST(event_id AS VARCHAR), 10, '0') FROM events
  UNION ALL SELECT CASE WHEN page_id % 2 = 0 THEN 'web' ELSE 'none' END, 'unknown', NULL FROM pages)
SELECT source, state, count(*) AS rows, min(id) AS first FROM x GROUP BY source, state""",
    "coverage_nested": """WITH l AS (SELECT c_nationkey AS region, c_mktsegment AS level, c_mktsegment || ':' || count(*) || ':' || count(*) FILTER (c_acctbal > 0) AS told FROM customer GROUP BY c_nationkey, c_mktsegment),
x AS (SELECT region, string_agg(told, ',' ORDER BY level) AS levels FROM l GROUP BY 1), y AS (SELECT s_nationkey AS region, string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey) AS laws FROM supplier WHERE s_acctbal > 0 GROUP BY 1)
SELECT region, coalesce(levels, '') AS levels, coalesce(laws, '') AS laws FROM x FULL JOIN y USING (region) ORDER BY region""",
    "verdict_evidence": """WITH l AS (SELECT l_orderkey, count(*) FILTER (l_returnflag <> 'A') AS spans, count(DISTINCT l_suppkey) AS watched, array_to_string(list_sort(list(DISTINCT CAST(l_suppkey AS VARCHAR))), ',') AS keys FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN f THEN o_orderpriority END AS rule, CASE WHEN f THEN '2026.1' END AS rules_version, CASE WHEN f THEN '2026.1' END AS text_version, CASE WHEN f THEN '2026.1' END AS lexicon_version, CASE WHEN f THEN coalesce(spans, 0) END AS spans,
  CASE WHEN f THEN coalesce(watched, 0) END AS watched, CAST(CASE WHEN f THEN 0 END AS BIGINT) AS organs, CASE WHEN f THEN coalesce(keys, '') END AS keys, CAST(CASE WHEN f THEN 13 END AS BIGINT) AS fields, CASE WHEN f THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day
FROM (SELECT *, o_orderstatus <> 'P' AS f FROM orders) LEFT JOIN l ON o_orderkey = l_orderkey""",
    "page_summaries": """WITH l AS (SELECT l_orderkey AS o, l_linenumber AS n, min(l_returnflag) AS flag, min(l_linestatus) AS status FROM lineitem GROUP BY 1, 2)
SELECT 'BOCYL-D-' || strftime(DATE '2026-01-01' + CAST(o % 300 AS INTEGER), '%d%m%Y') || '-' || (o * 100 + n) AS identifier, CASE WHEN flag <> 'A' THEN 'The line with number ' || n END AS title,
  last_value(CASE WHEN status = 'O' THEN 'Open & ' || flag END IGNORE NULLS) OVER (PARTITION BY o ORDER BY n ROWS UNBOUNDED PRECEDING) AS section, CASE WHEN flag <> 'A' THEN 'good' ELSE 'untitled' END AS state FROM l""",
    "deed_summaries": """WITH l AS (SELECT l_orderkey AS o, l_linenumber AS n, min(l_returnflag) AS flag, DATE '2026-01-01' + CAST(l_orderkey % 300 AS INTEGER) AS day FROM lineitem GROUP BY 1, 2),
x AS (SELECT day, flag, 'BOCM-' || strftime(day, '%Y%m%d') || '-' || (o // 300 * 8 + n) AS id FROM l WHERE o % 10 <> 0),
y AS (SELECT DISTINCT o, 'BOCM-' || strftime(day + 1, '%Y%m%d') AS id FROM l WHERE o % 10 = 0)
SELECT true AS good, 'S1' AS section, 'H' AS heading, flag AS organ, count(*) AS rows, min(id) AS first FROM x GROUP BY flag
UNION ALL SELECT false, NULL, NULL, NULL, count(*), min(id) FROM y HAVING count(*) > 0""",
    "region_ranking": """WITH c AS (SELECT c_nationkey AS k, count(*) // 10 AS alerts FROM customer WHERE c_acctbal < 0 GROUP BY 1),
x AS (SELECT array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS plain, alerts FROM nation JOIN c ON n_nationkey = k WHERE alerts > 0)
SELECT translate(plain, 'nai', 'ñáí') AS name, alerts FROM x ORDER BY alerts DESC, replace(lower(plain), 'n', 'n~') LIMIT 6""",
}
