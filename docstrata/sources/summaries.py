"""Daily summaries in their several layouts, all to one shape of items.

Every reader takes a DataFrame with a ``content`` string (and what it must agree with), never
opens files itself, and quarantines what is wrong instead of dropping it silently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docstrata.functions.dates import long_date
from docstrata.functions.text import bound, collapse, strip_tags, unescape

_ITEM = "identificador:string,titulo:string,url_xml:string,url_pdf:string"
NESTED_SCHEMA = (
    "status struct<code:string,text:string>, data struct<sumario:struct<metadatos:struct<fecha_publicacion:string>,diario:struct<sumario_diario:struct<identificador:string>,"
    f"seccion:array<struct<_codigo:string,_nombre:string,departamento:array<struct<_nombre:string,item:array<struct<{_ITEM}>>,epigrafe:array<struct<_nombre:string,item:array<struct<{_ITEM}>>>>>>>>>>>"
)
REGISTER_SCHEMA = "registro array<struct<docn:string,fecha:string,titulo:string,seccion:string,emisor:string,rango:string,texto:string>>"
#: Registers at which a source may have cut its answer.
FULL_ANSWER = 200
#: Items of one summary after repeats are removed.
MOST_ITEMS = 400


def safe_xml(content: Column) -> Column:
    """The content if it declares no document type and no entity; the XML functions expand them."""
    return F.when(~content.rlike(r"(?i)<!(?:DOCTYPE|ENTITY)"), content)


def checked(value: Column, good: Column, message: Column | str) -> Column:
    """``value``, or an error where it isn't good: a wrong summary must stop, not pass as empty."""
    return F.when(F.coalesce(good, F.lit(False)), value).otherwise(F.raise_error(message if isinstance(message, Column) else F.lit(message)))


def nested_items(raw: DataFrame) -> DataFrame:
    """Items at two depths, (day, content): under a department and under its headings.

    The status must be 200 and the date the one asked for; an empty summary is an error.
    """
    parsed = raw.select("day", F.from_xml(safe_xml(F.col("content")), NESTED_SCHEMA).alias("r"))
    summary = F.col("r.data.sumario")
    good = (F.col("r.status.code") == "200") & (summary["metadatos"]["fecha_publicacion"] == F.date_format("day", "yyyyMMdd"))
    sections = parsed.select("day", F.explode(checked(summary["diario"]["seccion"], good, "the summary is not the one of that day")).alias("s"))
    departments = sections.select("day", F.col("s._codigo").alias("section"), F.explode("s.departamento").alias("d"))
    none = F.array().cast(f"array<struct<heading:string,i:struct<{_ITEM}>>>")
    direct = F.coalesce(F.transform("d.item", lambda i: F.struct(F.lit(None).cast("string").alias("heading"), i.alias("i"))), none)
    under = F.coalesce(F.flatten(F.transform("d.epigrafe", lambda e: F.transform(e["item"], lambda i: F.struct(e["_nombre"].alias("heading"), i.alias("i"))))), none)
    items = departments.select("day", "section", F.col("d._nombre").alias("department"), F.explode(F.concat(direct, under)).alias("x"))
    return items.select("day", "section", "department", "x.heading", F.col("x.i.identificador").alias("identifier"), F.col("x.i.titulo").alias("title"), F.col("x.i.url_xml").alias("url"), F.col("x.i.url_pdf").alias("url_pdf"))


def registers(raw: DataFrame) -> DataFrame:
    """(day, place, identifier, title, department, good) of flat registers; their place is data, from 1.

    Content without an XML prologue means that nothing appeared that day. An answer of
    ``FULL_ANSWER`` registers may have been cut and is an error.
    """
    some = raw.filter(F.ltrim("content").startswith("<?xml"))
    parsed = some.select("day", F.from_xml(safe_xml(F.col("content")), REGISTER_SCHEMA)["registro"].alias("r"))
    whole = checked(F.col("r"), F.size("r") < FULL_ANSWER, "the answer may have been cut")
    each = parsed.select("day", F.posexplode(whole).alias("at", "x"))
    return each.select("day", (F.col("at") + 1).alias("place"), F.col("x.docn").alias("identifier"), F.trim("x.titulo").alias("title"), F.col("x.emisor").alias("department"), (F.col("x.fecha") == F.date_format("day", "yyyyMMdd")).alias("good"))


JSON_SCHEMA = "array<struct<control:string,title_es:string,title:string,rank:string,url:string>>"


def json_rows(raw: DataFrame, most: int = 200) -> DataFrame:
    """(day, control, title, rank, url, good, left_out) of open-data rows: bad control numbers and
    missing addresses are marked, not lost; the title falls back to the other language.

    Of an answer the first ``most`` rows are read; ``left_out`` says with each of them how many
    came after, so that a cut answer is seen.
    """
    answers = raw.select("day", F.from_json("content", JSON_SCHEMA).alias("all"))
    rows = answers.select("day", F.greatest(F.lit(0), F.size("all") - most).alias("left_out"), F.explode(F.slice("all", 1, most)).alias("r"))
    title = F.coalesce(F.nullif(F.trim("r.title_es"), F.lit("")), F.nullif(F.trim("r.title"), F.lit("")))
    good = F.coalesce(F.col("r.control").rlike(r"^\d{6,10}\z"), F.lit(False)) & F.coalesce(F.col("r.url") != "", F.lit(False))
    return rows.select("day", F.col("r.control").alias("control"), title.alias("title"), F.col("r.rank").alias("rank"), F.col("r.url").alias("url"), good.alias("good"), "left_out")


def quarantined(rows: DataFrame, good: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, rows to look at): nothing is lost without being counted."""
    sure = F.coalesce(good, F.lit(False))
    return rows.filter(sure), rows.filter(~sure)


def of_issue(items: DataFrame, identifier: str, day: str, most: int = MOST_ITEMS) -> DataFrame:
    """``items`` whose identifier bears their day's date; more than ``most`` of one day are an error.

    Identifiers look like ``ABCD-20260904-12``: the date in the middle is that of the issue.
    """
    own = items.filter(F.get(F.split(identifier, "-"), F.lit(1)) == F.date_format(day, "yyyyMMdd"))
    n = F.count("*").over(Window.partitionBy(day))
    return own.withColumn(identifier, checked(F.col(identifier), n <= most, "too many items for one issue"))


_DEED = "disposicion:array<struct<identificador:string,titulo:string,url_xml:string,url_pdf:string>>"
DEEDS_SCHEMA = f"metadatos struct<identificador:string,numero:string>, diario struct<secciones:struct<seccion:array<struct<_nombre:string,apartado:array<struct<_nombre:string,organismo:array<struct<_nombre:string,{_DEED}>>>>>>>>"


def deeds(raw: DataFrame, prefix: str = "BOCM", most: int = MOST_ITEMS) -> DataFrame:
    """(day, identifier, title, section, heading, organ, url, url_pdf, good) of nested summaries (day, content).

    The day is told by the identifiers, the summary's (``prefix-yyyymmdd``) and every item's
    (``prefix-yyyymmdd-n``), never by a date of its own. A summary of another day, with an item
    of another day, with an incomplete item, with none, or with over ``most`` different ones is not
    read in part: all it gives is one row that is not good, with the summary's identifier. Items
    that repeat are taken once, the first in document order.
    """
    parsed = raw.select("day", F.from_xml(safe_xml(F.col("content")), DEEDS_SCHEMA).alias("r"))
    none = F.array().cast("array<struct<identifier:string,title:string,section:string,heading:string,organ:string,url:string,url_pdf:string>>")

    def under(section: Column) -> Column:
        item = lambda a, o, i: F.struct(F.trim(i["identificador"]).alias("identifier"), F.trim(i["titulo"]).alias("title"), section["_nombre"].alias("section"), a["_nombre"].alias("heading"), o["_nombre"].alias("organ"), F.trim(i["url_xml"]).alias("url"), F.trim(i["url_pdf"]).alias("url_pdf"))
        of = lambda a, o: F.transform(o["disposicion"], lambda i: item(a, o, i))
        return F.flatten(F.filter(F.flatten(F.transform(F.filter(section["apartado"], lambda a: a["organismo"].isNotNull()), lambda a: F.transform(a["organismo"], lambda o: of(a, o)))), lambda x: x.isNotNull()))

    sections = F.filter(F.transform("r.diario.secciones.seccion", under), lambda x: x.isNotNull())
    name = F.concat_ws("-", F.lit(prefix), F.date_format("day", "yyyyMMdd"))
    listed = parsed.select("day", name.alias("issue"), F.trim("r.metadatos.identificador").alias("summary"), F.coalesce(F.flatten(sections), none).alias("all"))
    whole = lambda x: (F.substring_index(x["identifier"], "-", 2) == F.col("issue")) & x["identifier"].rlike(r"-\d{1,6}\z") & (x["title"] != "") & (x["url"] != "")
    good = (F.col("summary") == F.col("issue")) & F.forall("all", lambda x: F.coalesce(whole(x), F.lit(False))) & (F.size(F.array_distinct("all.identifier")).between(1, most))
    told = listed.select("day", "summary", F.coalesce(good, F.lit(False)).alias("good"), "all")
    placed = lambda x, i: F.struct(x["identifier"], i.alias("place"), F.substring(x["title"], 1, 2000).alias("title"), x["section"], x["heading"], x["organ"], x["url"], F.nullif(x["url_pdf"], F.lit("")).alias("url_pdf"))
    bad = F.struct(F.col("summary").alias("identifier"), F.lit(0).alias("place"), *(F.lit(None).cast("string").alias(c) for c in ("title", "section", "heading", "organ", "url", "url_pdf")))
    own = F.when(F.col("good"), _first_of_each(F.transform("all", placed), "identifier")).otherwise(F.array(bad))
    each = told.select("day", "good", F.inline(own), F.when(~F.col("good"), F.monotonically_increasing_id()).alias("alone"))  # a row that is not good repeats none
    within = Window.partitionBy("day", "identifier", "alone").orderBy("place")
    first = each.withColumn("__n", F.row_number().over(within)).filter("__n = 1")
    return first.select("day", "identifier", "title", "section", "heading", "organ", "url", "url_pdf", "good")


def keep_first(items: DataFrame, key: str, *order: Column | str, within: str | None = None) -> DataFrame:
    """One row per key: the first in order. Sources repeat their lists over and over."""
    keys = [key, *([within] if within else [])]
    return items.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def paired_by_position(raw: DataFrame, first: str, second: str) -> DataFrame:
    """(key, place, a, b) of two lists in ``content`` that belong together by position.

    Lists of different lengths are an error, as every pair after the gap would be wrong.
    """
    lists = raw.select("key", F.regexp_extract_all("content", F.lit(first), F.lit(1)).alias("a"), F.regexp_extract_all("content", F.lit(second), F.lit(1)).alias("b"))
    zipped = checked(F.arrays_zip("a", "b"), F.size("a") == F.size("b"), "the two lists differ in length")
    return lists.select("key", F.posexplode(zipped).alias("place", "z")).select("key", "place", "z.a", "z.b")


def element_list(content: Column, pattern: str) -> Column:
    """Array of (tag, value) of markup elements in document order, as `elements` gives them."""
    tags, values = (F.regexp_extract_all(content, F.lit(pattern), F.lit(i)) for i in (1, 2))
    zipped = F.arrays_zip(tags.alias("tag"), values.alias("value"))
    return F.transform(zipped, lambda e: F.struct(F.lower(e["tag"]).alias("tag"), collapse(unescape(strip_tags(e["value"]))).alias("value")))


def elements(raw: DataFrame, pattern: str) -> DataFrame:
    """(key, place, tag, value) of markup elements in document order.

    ``pattern`` has one group for the tag and one for the value. Values are cleaned: tags
    stripped, entities resolved, blanks collapsed.
    """
    return raw.select("key", F.posexplode(element_list(F.col("content"), pattern)).alias("place", "e")).select("key", "place", "e.tag", "e.value")


def _first_of_each(items: Column, key: str) -> Column:
    """Of an array of structs that begin with ``key`` and a place, the first of each key; sorted, not compared in pairs."""
    return bound(F.sort_array(items), lambda all_: F.filter(all_, lambda x, i: (i == 0) | ~F.get(all_, i - 1)[key].eqNullSafe(x[key])))


_FLAT = "struct<section:string,subsection:string,organ:string,title:string,out:array<struct<number:int,place:int,section:string,subsection:string,organ:string,title:string>>>"


def flat_list(listed: Column, section: str, subsection: str, organ: str, title: str, order: str) -> Column:
    """Array of (number, place, section, subsection, organ, title) from one document's headers, an array of (tag, value) in order.

    One walk that holds the headers and takes the title, so that no row of a document is sorted or shuffled.
    """

    def step(held: Column, e: Column) -> Column:
        is_a = lambda tag: e["tag"] == tag
        kept = lambda tag, name: F.when(is_a(tag), F.coalesce(e["value"], held[name])).otherwise(held[name]).alias(name)
        below = F.when(is_a(section), F.lit(None)).when(is_a(subsection), F.coalesce(e["value"], held["subsection"])).otherwise(held["subsection"])
        left = F.when(is_a(title), e["value"]).when(is_a(order), F.lit(None)).otherwise(held["title"])
        one = F.struct(e["value"].cast("int").alias("number"), F.size(held["out"]).alias("place"), held["section"], held["subsection"], held["organ"], held["title"])
        out = F.when(is_a(order) & e["value"].rlike(r"^\d{1,5}\z"), F.concat(held["out"], F.array(one))).otherwise(held["out"])
        return F.struct(kept(section, "section"), below.alias("subsection"), kept(organ, "organ"), left.alias("title"), out.alias("out"))

    nothing = F.lit(None).cast("string")
    start = F.struct(nothing.alias("section"), nothing.alias("subsection"), nothing.alias("organ"), nothing.alias("title"), F.array().alias("out")).cast(_FLAT)
    return _first_of_each(F.aggregate(listed, start, step, lambda held: held["out"]), "number")


def flat_items(rows: DataFrame, section: str, subsection: str, organ: str, title: str, order: str) -> DataFrame:
    """(key, number, section, subsection, organ, title) from interleaved headers (key, place, tag, value).

    Headers hold until the next of their kind; a new section resets its subsection; a title
    is used up by the first number after it. Of a number that repeats, the first counts.
    """
    lists = rows.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "tag", "value"))).alias("all"))  # of one document
    return lists.select("key", F.inline(flat_list(F.col("all"), section, subsection, organ, title, order))).drop("place")


def issue_header(content: Column) -> Column:
    """Struct (number, day, extra) of a header such as ``BOLETÍN Nº 12 - 9 de enero de 2024 - EXTRAORDINARIO``."""
    text = collapse(strip_tags(content))
    pattern = r"(?iu)BOLET[IÍ]N\s*N(?:&\w{1,8};|\S{0,3})\s*(\d{1,4})\s*-\s*(\d{1,2} de \p{L}+ de \d{4})(\s*-\s*EXTRAORDINARIO)?"
    number = F.regexp_extract(text, pattern, 1)
    return F.when(number != "", F.struct(number.cast("int").alias("number"), long_date(F.regexp_extract(text, pattern, 2)).alias("day"), (F.regexp_extract(text, pattern, 3) != "").alias("extra")))


def issues_of_day(issues: DataFrame, days: DataFrame) -> DataFrame:
    """(day, number): the issues (number, day) of the asked days; one day may have several, or none."""
    return days.join(issues, "day", "left").select("day", "number")


#: Issues of a year that a search by number can tell apart: two to the number of its rounds, less one.
MOST_ROUNDS = 16


def issues_by_number(issues: DataFrame, days: DataFrame, rounds: int = MOST_ROUNDS) -> DataFrame:
    """The same from a service that answers by (year, number) only: all days bisect in lockstep.

    The numbers of a year rise from 1 with the days, without gaps; a number that is not there is
    beyond the end. Every round is one join of the days' probes with the answers. Then each day
    walks on from its first issue while the next is of the same day. Days without an issue have
    a null number; repeated days are asked once.
    """
    by_number = issues.select(F.year("day").alias("year"), "number", F.col("day").alias("issued"))
    asked = days.select("day").filter("day is not null").distinct()
    state = asked.select("day", F.year("day").alias("year"), F.lit(1).alias("low"), F.lit(1 << rounds).alias("high"))
    for _ in range(rounds):  # low: everything before it is earlier than the day; high: from there on nothing is
        probes = state.withColumn("number", F.floor((F.col("low") + F.col("high")) / 2).cast("int"))
        told = probes.join(by_number, ["year", "number"], "left")
        earlier = F.coalesce(F.col("issued") < F.col("day"), F.lit(False)) & (F.col("low") < F.col("high"))
        state = told.select("day", "year", F.when(earlier, F.col("number") + 1).otherwise(F.col("low")).alias("low"), F.when(earlier | (F.col("low") >= F.col("high")), F.col("high")).otherwise(F.col("number")).alias("high"))
    same = lambda rows: rows.join(by_number, ["year", "number"]).filter("issued = day").select("day", "year", "number")
    found = step = same(state.select("day", "year", F.col("low").alias("number"))).cache()
    while not step.isEmpty():  # as often as a day has issues
        step = same(step.select("day", "year", (F.col("number") + 1).alias("number"))).cache()
        found = found.union(step)
    return asked.join(found.select("day", "number"), "day", "left")
