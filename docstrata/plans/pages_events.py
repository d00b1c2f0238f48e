"""Queries over pages, conversations and events: sources, bodies, version chains, stateful operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docstrata.config import LEXICON, Lexicon, Watched
from docstrata.functions.text import collapse, normalise, terms_present
from docstrata.lineage import cut, removed, shared_top
from docstrata.operators import measure, rules, versions
from docstrata.plans.common import spread, sql_list, sql_normalised, sql_terms, table
from docstrata.sources import bodies, consolidated, layouts, summaries
from docstrata.streaming import limiter, runner, windows

# -- sources ------------------------------------------------------------------------------


def _attribute(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))


def _element(tag: str, *inner: Column) -> Column:
    return F.concat(F.lit(f"<{tag}>"), *inner, F.lit(f"</{tag}>"))


def summary_nested_items(spark: SparkSession, d: str) -> DataFrame:
    """Customers packed into summaries of two depths, by nation and hundred, and read back once each."""
    customers = table(spark, d, "customer")
    item = lambda: _element("item", _element("identificador", F.concat(F.lit("CUS-"), F.col("c_custkey").cast("string"))), _element("titulo", _attribute(F.col("c_name"))), _element("url_xml", F.lit("u")), _element("url_pdf", F.lit("p")))
    direct = F.array_join(F.array_sort(F.collect_list(F.when(F.col("c_mktsegment") != "BUILDING", item()))), "")
    under = F.array_join(F.array_sort(F.collect_list(F.when(F.col("c_mktsegment") == "BUILDING", item()))), "")
    packed = customers.groupBy("c_nationkey", F.floor(F.col("c_custkey") / 100)).agg(direct.alias("direct"), under.alias("under"))
    body = F.concat(
        F.lit("<response><status><code>200</code></status><data><sumario><metadatos><fecha_publicacion>20260105</fecha_publicacion></metadatos><diario><seccion codigo='1'><departamento><nombre>n</nombre>"),
        "direct", F.lit("<epigrafe nombre='BUILDING'>"), "under", F.lit("</epigrafe></departamento></seccion><seccion codigo='2'><departamento>"), "direct", F.lit("</departamento></seccion></diario></sumario></data></response>"),
    )
    items = summaries.nested_items(packed.select(F.lit("2026-01-05").cast("date").alias("day"), body.alias("content"), "c_nationkey"))
    return summaries.keep_first(items, "identifier", "section", F.col("heading").asc_nulls_first()).select("identifier", "title", "section", F.coalesce("heading", F.lit("")).alias("heading"))


def summary_positional(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as flat registers, whose place in their answer is data; an answer is never a full one."""
    turns = table(spark, d, "conversations")
    register = _element("registro", _element("docn", F.col("turn").cast("string")), _element("fecha", F.lit("20260105")), _element("titulo", _attribute(F.col("text"))), _element("emisor", F.col("role")))
    whole = turns.withColumn("r", register).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "r"))), lambda x: x["r"]).alias("rs"))
    most = summaries.FULL_ANSWER - 1
    answers = whole.withColumn("n", F.explode(F.sequence(F.lit(0), F.floor((F.size("rs") - 1) / most).cast("int"))))
    packed = answers.select(F.array_join(F.slice("rs", F.col("n") * most + 1, F.lit(most)), "").alias("all"))
    raw = packed.select(F.lit("2026-01-05").cast("date").alias("day"), F.concat(F.lit("<?xml version='1.0'?><documento>"), "all", F.lit("</documento>")).alias("content"))
    read = summaries.registers(raw)
    return read.groupBy(F.col("place").cast("long").alias("place"), "department").agg(F.count("*").alias("registers"), F.count_if("good").alias("good"), F.sum(F.length("title").cast("long")).alias("title_chars"))


def xml_body_parse(spark: SparkSession, d: str) -> DataFrame:
    """Orders written as bodies with references, and parsed back."""
    orders = table(spark, d, "orders")
    reference = F.concat(F.lit("<anterior referencia='' ><palabra codigo='1'>x</palabra></anterior><anterior referencia='CUS-"), F.col("o_custkey").cast("string"), F.lit("'><palabra codigo='2'> modifica  a </palabra><texto>t</texto></anterior>"))
    content = F.concat(
        F.lit("<documento><metadatos><identificador>ORD-"), F.col("o_orderkey").cast("string"), F.lit("</identificador></metadatos><analisis><referencias><anteriores>"), reference,
        F.lit("</anteriores></referencias></analisis><texto><p> "), "o_orderpriority", F.lit(" </p><p></p><p>Total  "), F.col("o_orderstatus"), F.lit("</p></texto></documento>"),
    )
    content = F.when(F.col("o_orderkey") % 100 == 0, F.concat(F.lit("<!DOCTYPE documento [<!ENTITY x 'y'>]>"), content)).otherwise(content)
    read = bodies.xml_bodies(orders.select(F.col("o_orderkey").alias("key"), content.alias("content")))
    first = F.try_element_at("references", F.lit(1))
    return read.select("key", F.coalesce("identifier", F.lit("")).alias("identifier"), F.coalesce("text", F.lit("")).alias("text"), F.size("references").cast("long").alias("n_references"), first["identifier"].alias("cited"), first["verb"].alias("verb"))


def layout_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Orders written as bodies of every layout, with noise beside the text, and read by one walk; some are too deep."""
    orders = table(spark, d, "orders")
    text = F.concat(F.lit("<p> "), "o_orderpriority", F.lit(" </p><p>Total <b>"), "o_orderstatus", F.lit("</b></p>"))
    act = lambda inner: F.concat(F.lit(f"<akomaNtoso xmlns='{layouts.AKN}'><act><meta>noise</meta><body>"), inner, F.lit("</body></act></akomaNtoso>"))
    forms = [
        _element("documento", F.lit("<analisis><texto>noise</texto></analisis><texto>"), text, F.lit("</texto><texto>later</texto>")),
        act(text),
        _element("documento", _element("registro", F.lit("<titulo>noise</titulo>"), _element("texto", text))),
        _element("disposicion", _element("contenido", F.lit("<titulo>noise</titulo>"), _element("texto", text))),
        _element("DOCUMENTO", F.lit("<BOPVOrden>1</BOPVOrden><BOPVTitulo>noise</BOPVTitulo>"), _element("BOPVDetalle", text)),
        _element("otro", text),
        act(F.concat(F.lit('<content period="'), _attribute(F.replace(text, F.lit("Total "), F.lit("Total&nbsp;"))), F.lit('"/>'))),
    ]
    kind, content = F.col("o_orderkey") % len(forms), F.lit(None).cast("string")
    for i, form in enumerate(forms):
        content = F.when(kind == i, form).otherwise(content)
    content = F.when(F.col("o_orderkey") % 50 == 0, F.concat(F.repeat(F.lit("<x>"), F.lit(101)), content, F.repeat(F.lit("</x>"), F.lit(101)))).otherwise(content)
    return layouts.layout_texts(orders.select(F.col("o_orderkey").alias("key"), content.alias("content")))


def issues_by_number(spark: SparkSession, d: str) -> DataFrame:
    """Days with orders have one issue or two, numbered within the year; every day with shipments is asked for by bisection."""
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"), (F.col("o_orderkey") % 2).alias("half")).distinct()
    number = F.row_number().over(Window.partitionBy(F.year("day")).orderBy("day", "half"))  # of the days of a year
    asked = table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("day"))
    found = summaries.issues_by_number(days.select(number.alias("number"), "day"), asked)
    return found.select(F.col("day").cast("string").alias("day"), F.col("number").cast("long").alias("number"))


def consolidated_versions(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as consolidated texts: each turn a version of its block; changes by modifier."""
    turns = table(spark, d, "conversations")
    version = F.concat(F.lit("<version id_norma='"), "role", F.lit("' fecha_vigencia='"), F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), F.col("turn").cast("int")), "yyyyMMdd"), F.lit("'><p class='parrafo'>"), _attribute(F.col("text")), F.lit("</p><p class='nota_pie'>note</p></version>"))
    packed = turns.withColumn("v", version).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "v"))), lambda x: x["v"]), "").alias("all"))
    content = F.concat(F.lit("<response><data><texto><bloque id='a1' tipo='precepto' titulo='A'>"), "all", F.lit("</bloque><bloque id='n' tipo='nota_inicial'><version id_norma='x'><p>n</p></version></bloque></texto></data></response>"))
    read = consolidated.block_versions(packed.select(F.col("conv_id").alias("key"), content.alias("content")))
    chained = versions.chain(read.withColumn("block", F.concat_ws("/", "key", "block")), "block", ["place"], "text")
    last = versions.changes_by(chained, "modifier")
    return last.select("key", "modifier", F.col("ordinal").cast("long").alias("ordinal"), F.col("in_force").cast("string").alias("in_force"), versions.change_kind(F.col("previous_text"), F.col("text")).alias("kind"))


def body_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Documents and pages as bytes, each read by its own branch."""
    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("key"), F.col("text").cast("binary").alias("content"))
    pages = table(spark, d, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("key"), F.col("html").cast("binary").alias("content"))
    return bodies.dispatched(spread(docs).union(spread(pages))).groupBy("format", "derivation").agg(F.count("*").alias("bodies"))


def html_container_text(spark: SparkSession, d: str) -> DataFrame:
    """Texts of the declared containers, by the event parser."""
    return bodies.html_texts(spread(table(spark, d, "pages")), "page_id", "html").select("page_id", F.length("text").cast("long").alias("chars"), F.md5("text").alias("text_md5"))


def html_article_crop(spark: SparkSession, d: str) -> DataFrame:
    """The inner markup of well-formed articles, inside generated code."""
    inner = F.regexp_extract("html", r"(?is)<article\b[^>]*>(.*?)</article\s*>", 1)
    return table(spark, d, "pages").select("page_id", F.md5(inner).alias("inner_md5"), F.length(inner).cast("long").alias("chars"))


_TAGS = r"(?is)<(h1|title|li)\b[^>]*>([^<]*)<"


def html_links_forward_fill(spark: SparkSession, d: str) -> DataFrame:
    """Headings are carried forward to the list items after them."""
    rows = summaries.elements(table(spark, d, "pages").select(F.col("page_id").alias("key"), F.replace(F.replace("html", F.lit("<li><a"), F.lit("<li")), F.lit("<h1>"), F.lit("<h1 >")).alias("content")), _TAGS)
    held = rows.withColumn("heading", versions.carried_forward(rows, F.when(F.col("tag") != "li", F.col("value")), ["place"], "key"))
    return held.filter("tag = 'li'").groupBy(F.col("key").alias("page_id"), "heading").agg(F.count("*").alias("items"), F.min("value").alias("first_item"))


def url_parts(spark: SparkSession, d: str) -> DataFrame:
    part = lambda i: F.regexp_extract("url", r"^(https?)://([^/?#]+)/([a-z]{2})/(\d+)", i)
    return table(spark, d, "pages").select("page_id", part(1).alias("scheme"), part(2).alias("host"), part(3).alias("lang"), F.lpad(part(4), 6, "0").alias("number"))


def quarantine_split(spark: SparkSession, d: str) -> DataFrame:
    """Rows of both tables, good and quarantined, counted: nothing is lost."""
    pages = table(spark, d, "pages").select(F.lit("pages").alias("source"), F.col("url").rlike(r"^https://").alias("good"))
    events = table(spark, d, "events").select(F.lit("events").alias("source"), (F.get_json_object("props", "$.k").try_cast("int") < 90).alias("good"))
    good, bad = summaries.quarantined(pages.union(events), F.col("good"))
    return good.withColumn("state", F.lit("good")).union(bad.withColumn("state", F.lit("quarantined"))).groupBy("source", "state").agg(F.count("*").alias("rows"))


def json_props(spark: SparkSession, d: str) -> DataFrame:
    """Open-data rows made of the events' properties: dropped ones are counted by the filter before."""
    row = F.to_json(F.array(F.struct(F.lpad(F.get_json_object("props", "$.k"), 6, "0").alias("control"), F.lit(" ").alias("title_es"), F.col("event_type").alias("title"), F.lit("r").alias("rank"), F.when(F.col("event_type") != "error", F.lit("https://x.example")).alias("url"))))
    read = summaries.json_rows(table(spark, d, "events").select(F.to_date("ts").alias("day"), row.alias("content")))
    return read.groupBy("title", "good").agg(F.count("*").alias("rows"), F.sum(F.col("control").cast("long")).alias("control_sum"))


def positional_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Two script arrays of a calendar, paired by position: days and editions."""
    days = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("k"))
    script = F.concat(F.lit("var days = ["), F.array_join(F.transform("k", lambda x: F.concat(F.lit("'d"), x.cast("string"), F.lit("'"))), ","), F.lit("]; var links = ["), F.array_join(F.transform("k", lambda x: F.concat(F.lit('"l'), (x * 2).cast("string"), F.lit('"'))), ","), F.lit("];"))
    return summaries.paired_by_position(days.select("key", script.alias("content")), r"'d(\d+)'", r'"l(\d+)"').select("key", "place", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))


def flat_headers(spark: SparkSession, d: str) -> DataFrame:
    """Interleaved headers: sections reset subsections, titles are used up by the next number."""
    lines = table(spark, d, "lineitem").repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("status"))
    parts = F.concat(F.lit("<s>"), "flag", F.lit("</s>"), F.when(F.col("status") == "O", F.lit("<u>open</u>")).otherwise(""), F.lit("<t>title "), F.col("l_linenumber").cast("string"), F.lit("</t><n>"), F.col("l_linenumber").cast("string"), F.lit("</n><n>"), (F.col("l_linenumber") + 10).cast("string"), F.lit("</n>"))
    packed = lines.withColumn("x", parts).groupBy(F.col("l_orderkey").alias("key")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "x"))), lambda e: e["x"]), "").alias("content"))
    items = packed.select("key", F.inline(summaries.flat_list(summaries.element_list(F.col("content"), r"(?is)<([sutn])>(.*?)</[sutn]>"), "s", "u", "o", "t", "n")))
    return items.select("key", F.col("number").cast("long").alias("number"), "section", F.coalesce("subsection", F.lit("")).alias("subsection"), F.coalesce("title", F.lit("")).alias("title"))


def config_load_validate(spark: SparkSession, d: str) -> DataFrame:
    """The configuration as rows; building it checks it."""
    lexicon = Lexicon(LEXICON.direct, LEXICON.context, LEXICON.version)
    watched = [Watched("LAW-A-2020-1", "First"), Watched("LAW-B-2021-2", "Second", specific=False)]
    terms = [("term", t, t in lexicon.direct) for t in lexicon.terms]
    return spark.createDataFrame(terms + [("watched", w.identifier, w.specific) for w in watched], "kind string, value string, decides boolean")


# -- version chains -----------------------------------------------------------------------


def version_chain(spark: SparkSession, d: str) -> DataFrame:
    chained = versions.chain(table(spark, d, "conversations"), "conv_id", ["turn"], "text", "role")
    return chained.select("conv_id", "turn", F.col("ordinal").cast("long").alias("ordinal"), F.md5("previous_text").alias("previous_md5"), "previous_role", versions.change_kind(F.col("previous_text"), F.col("text")).alias("kind"))


def lost_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms that each turn lost against the one before, over a conversation, in order of loss."""
    found = table(spark, d, "conversations").withColumn("terms", terms_present(normalise(F.col("text")), list(LEXICON.terms)))
    within = Window.partitionBy("conv_id").orderBy("turn")
    lost = found.withColumn("lost", rules.lost_terms(F.lag("terms").over(within), F.col("terms")))
    gathered = lost.groupBy("conv_id").agg(rules.ordered_distinct(F.transform(F.array_sort(F.collect_list(F.struct("turn", "lost"))), lambda x: x["lost"])).alias("lost"))
    return gathered.select("conv_id", F.array_join("lost", ",").alias("lost"))


# -- events -------------------------------------------------------------------------------


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    stats = events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.max("value").alias("most"))
    middle = measure.grouped_median(events, "value", "event_type").select("event_type", F.round("median", 4).alias("median"))
    return stats.join(middle, "event_type").join(measure.nearest_rank(events, "value", 0.95, "event_type").withColumnRenamed("at_rank", "p95"), "event_type")


def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    """The value of a user's last purchase at or before each event."""
    events = table(spark, d, "events")
    held = versions.carried_forward(events, F.when(F.col("event_type") == "purchase", F.col("value")), ["ts", "event_id"], "user_id")
    before = versions.consumed_once(F.when(F.col("event_type") == "purchase", F.col("value")), ["ts", "event_id"], "user_id")
    return events.select("event_id", held.alias("last_purchase"), before.alias("just_before"))


def sliding_window_count(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    return events.select("event_id", "user_id", windows.recent_count("user_id", "ts", 3600).alias("last_hour"))


def rate_limiter(spark: SparkSession, d: str) -> DataFrame:
    return limiter.limited(table(spark, d, "events"), limit=3, window=3600.0)


def token_bucket(spark: SparkSession, d: str) -> DataFrame:
    return limiter.bucketed(table(spark, d, "events").filter("event_type = 'error'"), capacity=2.0, refill=1 / 86_400)


def ttl_sessions(spark: SparkSession, d: str) -> DataFrame:
    return limiter.with_sessions(table(spark, d, "events").filter("event_type = 'signup'"), ttl=86_400.0, most=2)


def bodies_checked(spark: SparkSession, d: str) -> DataFrame:
    """Orders as bodies of five sources and one without a check, some of them of another order or a page of an error: counted by what they are."""
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), F.pmod("o_orderkey", F.lit(1_000)).cast("int").alias("n"), F.pmod("o_custkey", F.lit(4)).alias("kind"), F.pmod("o_orderkey", F.lit(6)).alias("source"))
    told = F.col("n") + F.when(F.col("kind") == 1, 1).otherwise(0)  # what the body says
    on = F.date_add("day", F.when(F.col("kind") == 1, 1).otherwise(0))
    text = lambda c: c.cast("string")
    dated = lambda prefix, day, n, form="yyyyMMdd": F.concat(F.lit(prefix), F.date_format(day, form), F.lit("-"), text(n))
    xml = F.lit("<?xml version='1.0'?><documento>")
    made = (
        (F.concat(F.lit("BOA-"), text(F.col("n"))), F.concat(xml, _element("registro", _element("docn", text(told))), F.lit("</documento>"))),
        (dated("BOCM-", "day", F.col("n")), _element("documento", _element("metadatos", _element("identificador", dated("BOCM-", "day", told))))),
        (dated("BOCYL-D-", "day", F.col("n"), "ddMMyyyy"), F.concat(xml, _element("fechaPublicacion", F.date_format(on, "yyyy-MM-dd")), F.lit("</documento>"))),
        (dated("BOPV-D-", "day", F.col("n")), _element("documento", _element("BOPVOrden", text(told)))),
        (F.concat(F.lit("BON-D-2024-"), text(F.col("n")), F.lit("-1")), F.concat(F.lit("<h1>BOLETÍN N&ordm; "), text(told), F.lit("</h1> - 9 de enero de 2024 - <p>"))),
        (F.concat(F.lit("DOC-"), text(F.col("n"))), F.lit("<documento/>")),
    )
    chosen = lambda i: F.element_at(F.array(*(m[i] for m in made)), F.col("source").cast("int") + 1)
    name = F.when(F.col("kind") == 3, F.concat(chosen(0), F.lit("-x y"))).otherwise(chosen(0))
    rows = orders.select(name.alias("identifier"), F.when(F.col("kind") == 2, "<html><p>not found").otherwise(chosen(1)).alias("body"))
    return rows.groupBy(F.split_part("identifier", F.lit("-"), F.lit(1)).alias("prefix"), bodies.body_state(F.col("identifier"), F.col("body")).alias("state")).agg(F.count("*").alias("bodies"))


def ledgered_run(spark: SparkSession, d: str) -> DataFrame:
    """All events through the incremental run, twice, the second time without its marks: counted by type from what the ledger names."""
    folder = f"{shared_top(spark)}/ledger-{uuid.uuid4().hex}"
    schema = table(spark, d, "events").select("event_id", "event_type", "value").schema
    try:  # a stream takes one file by a pattern only
        for run in ("first", "second"):
            runner.run_with_ledger(spark, "events", f"{d}/events.parque[t]", schema, folder, f"{folder}/marks-{run}", []).awaitTermination()
        rows = runner.committed(spark, folder)
        empty = spark.createDataFrame([], schema)  # no file had a row
        counted = (empty if rows is None else rows).groupBy("event_type").agg(F.count("*").alias("events"), F.count_distinct("event_id").alias("ids"), F.max("value").alias("most"))
        return cut(counted)
    finally:
        removed(spark, folder)


def session_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that end six hours after their last event."""
    got = windows.sessions(table(spark, d, "events"), "ts", "6 hours", "user_id", events=F.count("*"), most=F.max("value"))
    return got.select("user_id", F.unix_micros(F.col("session_start").cast("timestamp")).alias("start_us"), "events", "most")


def tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    got = windows.tumbling(table(spark, d, "events"), "ts", "6 hours", "event_type", events=F.count("*"), most=F.max("value"))
    return got.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "events", "most")


def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    got = windows.sliding(table(spark, d, "events"), "ts", "12 hours", "6 hours", "event_type", events=F.count("*"))
    return got.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "events")


def display_formats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.date_format("ts", "dd/MM/yyyy").alias("day"), F.date_format("ts", "dd/MM/yyyy HH:mm").alias("moment"), F.format_string("%.2f %%", F.col("value")).alias("share"), collapse(F.col("event_type")).alias("label"))


QUERIES = {
    f.__name__: f
    for f in (
        summary_nested_items, summary_positional, layout_bodies, issues_by_number, xml_body_parse, consolidated_versions, body_dispatch, html_container_text, html_article_crop, html_links_forward_fill, url_parts, quarantine_split,
        json_props, positional_pairs, flat_headers, config_load_validate, version_chain, lost_terms, latency_percentiles, carry_forward, sliding_window_count, rate_limiter, token_bucket, ttl_sessions,
        bodies_checked, ledgered_run, session_gaps, tumbling_windows, sliding_windows, display_formats,
    )
}

SQL = {
    "summary_nested_items": """SELECT 'CUS-' || CAST(c_custkey AS VARCHAR) AS identifier, c_name AS title, '1' AS section, CASE WHEN c_mktsegment = 'BUILDING' THEN 'BUILDING' ELSE '' END AS heading FROM customer""",
    "summary_positional": """WITH p AS (SELECT (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) % 199 + 1 AS place, role AS department, CAST(length(trim(text, chr(10) || ' ')) AS BIGINT) AS n FROM conversations)
SELECT place, department, count(*) AS registers, count(*) AS good, CAST(sum(n) AS BIGINT) AS title_chars FROM p GROUP BY place, department""",
    "layout_bodies": """SELECT o_orderkey AS key, CASE WHEN o_orderkey % 50 <> 0 THEN ['text', 'act', 'register', 'content', 'siblings', 'everything', 'attribute'][o_orderkey % 7 + 1] END AS layout,
  CASE WHEN o_orderkey % 50 <> 0 THEN o_orderpriority || ' Total ' || o_orderstatus END AS text, CASE WHEN o_orderkey % 50 = 0 THEN 'depth' END AS refused FROM orders""",
    "issues_by_number": """WITH i AS (SELECT day, row_number() OVER (PARTITION BY year(day) ORDER BY day, half) AS number FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, o_orderkey % 2 AS half FROM orders))
SELECT CAST(a.day AS VARCHAR) AS day, number FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem) a LEFT JOIN i USING (day)""",
    "xml_body_parse": """SELECT o_orderkey AS key, CASE WHEN o_orderkey % 100 = 0 THEN '' ELSE 'ORD-' || CAST(o_orderkey AS VARCHAR) END AS identifier, CASE WHEN o_orderkey % 100 = 0 THEN '' ELSE o_orderpriority || ' Total  ' || o_orderstatus END AS text,
  CAST(CASE WHEN o_orderkey % 100 = 0 THEN 0 ELSE 1 END AS BIGINT) AS n_references, CASE WHEN o_orderkey % 100 <> 0 THEN 'CUS-' || CAST(o_custkey AS VARCHAR) END AS cited, CASE WHEN o_orderkey % 100 <> 0 THEN 'MODIFICA A' END AS verb FROM orders""",
    "consolidated_versions": """WITH p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ordinal FROM conversations)
SELECT conv_id AS key, role AS modifier, max(ordinal) AS ordinal, CAST(DATE '2026-01-01' + CAST(max(turn) AS INTEGER) AS VARCHAR) AS in_force, CASE WHEN max(ordinal) = 1 THEN 'insertion' ELSE 'change' END AS kind FROM p GROUP BY conv_id, role""",
    "body_dispatch": r"""WITH p AS (SELECT regexp_extract(html, '(?is)<article\b[^>]*>(.*?)</article\s*>', 1) AS i FROM pages),
t AS (SELECT trim(regexp_replace(regexp_replace(regexp_replace(i, '(?is)<(?:script|style)\b.*?</(?:script|style)\s*>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS x FROM p)
SELECT 'html' AS format, CASE WHEN length(x) >= 200 THEN 'text' ELSE 'unreadable' END AS derivation, count(*) AS bodies FROM t GROUP BY ALL
UNION ALL SELECT 'other', CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN 'unreadable' ELSE 'text' END, count(*) FROM documents GROUP BY ALL""",
    "html_article_crop": r"WITH x AS (SELECT page_id, regexp_extract(html, '(?is)<article\b[^>]*>(.*?)</article\s*>', 1) AS i FROM pages) SELECT page_id, md5(i) AS inner_md5, CAST(length(i) AS BIGINT) AS chars FROM x",
    "url_parts": r"SELECT page_id, regexp_extract(url, '^(https?)://([^/?#]+)/([a-z]{2})/(\d+)', 1) AS scheme, regexp_extract(url, '^(https?)://([^/?#]+)/([a-z]{2})/(\d+)', 2) AS host, regexp_extract(url, '^(https?)://([^/?#]+)/([a-z]{2})/(\d+)', 3) AS lang, lpad(regexp_extract(url, '^(https?)://([^/?#]+)/([a-z]{2})/(\d+)', 4), 6, '0') AS number FROM pages",
    "quarantine_split": """WITH x AS (SELECT 'pages' AS source, starts_with(url, 'https://') AS good FROM pages UNION ALL SELECT 'events', coalesce(try_cast(json_extract_string(props, '$.k') AS INTEGER) < 90, false) FROM events)
SELECT source, CASE WHEN good THEN 'good' ELSE 'quarantined' END AS state, count(*) AS rows FROM x GROUP BY ALL""",
    "json_props": """SELECT event_type AS title, event_type <> 'error' AS good, count(*) AS rows, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS control_sum FROM events GROUP BY ALL""",
    "positional_pairs": "SELECT o_custkey AS key, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS place, o_orderkey AS a, o_orderkey * 2 AS b FROM orders",
    "flat_headers": """WITH l AS (SELECT l_orderkey AS key, l_linenumber AS n, min(l_returnflag) AS section, min(l_linestatus) AS status FROM lineitem GROUP BY 1, 2)
SELECT key, CAST(n AS BIGINT) AS number, section, CASE WHEN status = 'O' THEN 'open' ELSE '' END AS subsection, 'title ' || CAST(n AS VARCHAR) AS title FROM l
UNION ALL SELECT key, CAST(n + 10 AS BIGINT), section, CASE WHEN status = 'O' THEN 'open' ELSE '' END, '' FROM l""",
    "config_load_validate": f"SELECT 'term' AS kind, t AS value, list_contains({sql_list(LEXICON.direct)}, t) AS decides FROM (SELECT unnest({sql_list(LEXICON.terms)}) AS t) UNION ALL SELECT 'watched', 'LAW-A-2020-1', true UNION ALL SELECT 'watched', 'LAW-B-2021-2', false",
    "version_chain": """WITH p AS (SELECT *, lag(nullif(text, '')) OVER w AS previous_text, lag(role) OVER w AS previous_role, row_number() OVER w AS ordinal FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, ordinal, md5(previous_text) AS previous_md5, previous_role, CASE WHEN previous_text IS NULL AND nullif(text, '') IS NULL THEN 'pointer' WHEN previous_text IS NULL THEN 'insertion' WHEN nullif(text, '') IS NULL THEN 'repeal' ELSE 'change' END AS kind FROM p""",
    "lost_terms": f"""WITH f AS (SELECT conv_id, turn, {sql_terms(sql_normalised("text"), LEXICON.terms)} AS terms FROM conversations),
l AS (SELECT *, list_sort(list_filter(coalesce(lag(terms) OVER (PARTITION BY conv_id ORDER BY turn), []), lambda t: NOT list_contains(terms, t))) AS lost FROM f),
x AS (SELECT conv_id, turn, unnest(lost) AS term, generate_subscripts(lost, 1) AS i FROM l),
m AS (SELECT conv_id, term, min(turn * 1000 + i) AS place FROM x GROUP BY conv_id, term)
SELECT c.conv_id, coalesce(string_agg(term, ',' ORDER BY place), '') AS lost FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN m USING (conv_id) GROUP BY c.conv_id""",
    "latency_percentiles": "SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, round(median(value), 4) AS median, max(value) AS most, list_sort(list(value))[CAST(least(floor(0.95 * count(*)), count(*) - 1) AS BIGINT) + 1] AS p95 FROM events GROUP BY event_type",
    "carry_forward": """WITH x AS (SELECT *, CASE WHEN event_type = 'purchase' THEN value END AS p FROM events)
SELECT event_id, last_value(p IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase, lag(p) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS just_before FROM x""",
    "sliding_window_count": "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS last_hour FROM events",
    "bodies_checked": """WITH x AS (SELECT ['BOA', 'BOCM', 'BOCYL', 'BOPV', 'BON', 'DOC'][o_orderkey % 6 + 1] AS prefix, o_custkey % 4 AS kind FROM orders)
SELECT prefix, CASE WHEN prefix = 'DOC' THEN NULL WHEN kind = 3 AND prefix <> 'BOA' THEN 'malformed' WHEN kind = 2 THEN 'unreadable' WHEN kind = 0 THEN 'right' ELSE 'another' END AS state, count(*) AS bodies FROM x GROUP BY ALL""",
    "ledgered_run": "SELECT event_type, count(*) AS events, count(DISTINCT event_id) AS ids, max(value) AS most FROM events GROUP BY event_type",
    "session_gaps": """WITH g AS (SELECT *, coalesce(ts - lag(ts) OVER w >= INTERVAL 6 HOURS, true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS events, max(value) AS most FROM s GROUP BY user_id, k""",
    "tumbling_windows": "SELECT strftime(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS events, max(value) AS most FROM events GROUP BY ALL",
    "sliding_windows": """WITH w AS (SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS b, event_type FROM events), x AS (SELECT b AS s, event_type FROM w UNION ALL SELECT b - INTERVAL 6 HOURS, event_type FROM w)
SELECT strftime(s, '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS events FROM x GROUP BY ALL""",
    "display_formats": "SELECT event_id, strftime(ts, '%d/%m/%Y') AS day, strftime(ts, '%d/%m/%Y %H:%M') AS moment, format('{:.2f} %', value) AS share, event_type AS label FROM events",
}
