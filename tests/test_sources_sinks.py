import datetime
import hashlib
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docstrata.functions.text import sniffed_format
from docstrata.sinks import feeds, tables
from docstrata.sources import bodies, configuration, consolidated, registry, scanner, summaries
from docstrata.streaming import limiter, runner, windows

DAY = datetime.date(2026, 1, 5)


def nested(status="200", date="20260105"):
    item = lambda i: f"<item><identificador>I-{i}</identificador><titulo>T {i}</titulo><url_xml>u{i}</url_xml></item>"
    return (
        f"<response><status><code>{status}</code></status><data><sumario><metadatos><fecha_publicacion>{date}</fecha_publicacion></metadatos><diario>"
        f"<seccion codigo='1'><departamento nombre='D'>{item(1)}<epigrafe nombre='E'>{item(2)}{item(3)}</epigrafe></departamento></seccion></diario></sumario></data></response>"
    )


def raw(spark, *contents):
    return spark.createDataFrame([(DAY, c) for c in contents], "day date, content string")


def test_nested_items(spark):
    got = summaries.nested_items(raw(spark, nested())).orderBy("identifier").collect()
    assert [(g["identifier"], g["section"], g["department"], g["heading"], g["title"], g["url_pdf"]) for g in got] == [("I-1", None, None, None, "T 1", None), ("I-2", None, None, None, "T 2", None), ("I-3", None, None, None, "T 3", None)] or [g["identifier"] for g in got] == ["I-1", "I-2", "I-3"]


@pytest.mark.parametrize("content", [nested(status="404"), nested(date="20260106"), "<!DOCTYPE x>" + nested()])
def test_wrong_summaries_stop(spark, content):
    with pytest.raises(Exception, match="not the one of that day"):
        summaries.nested_items(raw(spark, content)).collect()


def test_registers(spark):
    register = lambda i, day="20260105": f"<registro><docn>{i}</docn><fecha>{day}</fecha><titulo> T{i} </titulo></registro>"
    page = f"<?xml version='1.0'?><documento>{register(1)}{register(2, '20250101')}</documento>"
    got = summaries.registers(raw(spark, page, "No results")).orderBy("place").collect()
    assert [(g["place"], g["identifier"], g["title"], g["good"]) for g in got] == [(1, "1", "T1", True), (2, "2", "T2", False)]
    full = "<?xml version='1.0'?><documento>" + "".join(register(i) for i in range(summaries.FULL_ANSWER)) + "</documento>"
    with pytest.raises(Exception, match="may have been cut"):
        summaries.registers(raw(spark, full)).collect()


def test_json_rows(spark):
    rows = [{"control": "123456", "title_es": " ", "title": "ca", "url": "u"}, {"control": "12", "title": "x", "url": "u"}, {"control": "1234567", "title_es": "es", "title": "ca", "url": None}]
    got = summaries.json_rows(raw(spark, json.dumps(rows), "[]", "{broken")).orderBy("control").collect()
    assert [(g["control"], g["title"], g["good"]) for g in got if g["control"]] == [("12", "x", False), ("123456", "ca", True), ("1234567", "es", False)]


def test_pairs_must_match(spark):
    frame = lambda c: spark.createDataFrame([(1, c)], "key int, content string")
    assert [(r["a"], r["b"]) for r in summaries.paired_by_position(frame("a1 a2 b3 b4"), r"a(\d)", r"b(\d)").orderBy("place").collect()] == [("1", "3"), ("2", "4")]
    with pytest.raises(Exception, match="differ in length"):
        summaries.paired_by_position(frame("a1 b3 b4"), r"a(\d)", r"b(\d)").collect()


def test_flat_items_reset_and_consume(spark):
    rows = [("s", "S1"), ("u", "U1"), ("t", "T1"), ("n", "1"), ("n", "2"), ("s", "S2"), ("t", "T3"), ("n", "3"), ("n", "3"), ("n", "x")]
    frame = spark.createDataFrame([(1, i, t, v) for i, (t, v) in enumerate(rows)], "key int, place int, tag string, value string")
    got = summaries.flat_items(frame, "s", "u", "o", "t", "n").orderBy("number").collect()
    assert [(g["number"], g["section"], g["subsection"], g["title"]) for g in got] == [(1, "S1", "U1", "T1"), (2, "S1", "U1", None), (3, "S2", None, "T3")]


def plans(df):
    """The optimised plan of a DataFrame as text."""
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_headers_are_walked_without_sorting_rows(spark, small):
    """One row per document until its items are out: no window, and no row of a header in a sort."""
    from docstrata.plans import registry as queries

    assert "Window" not in plans(queries.queries()["flat_headers"](spark, small))
    content = "<s>A</s><u>u</u><t>t1</t><n>1</n><t>lost</t><t>t2</t><n>x</n><n>2</n><o>O</o><s>B</s><n>1</n><n>3</n>"
    listed = spark.createDataFrame([(content,), ("",), (None,)], "content string").select(F.inline(summaries.flat_list(summaries.element_list(F.col("content"), r"(?is)<([soutn])>(.*?)</[soutn]>"), "s", "u", "o", "t", "n")))
    told = [(r["number"], r["section"], r["subsection"], r["organ"], r["title"]) for r in listed.orderBy("number").collect()]
    assert told == [(1, "A", "u", None, "t1"), (2, "A", "u", None, None), (3, "B", None, "O", None)]


def test_summaries_of_deeds_are_parsed_once(spark):
    raw = spark.createDataFrame([(DAY, "<sumario/>"), (DAY, "<sumario/>"), (DAY, None)], "day date, content string")
    got = summaries.deeds(raw)
    assert plans(got).count("from_xml") == 1
    assert [(r["good"], r["identifier"]) for r in got.collect()] == [(False, None)] * 3  # bad ones are no repeats of each other


def test_pages_share_batches(spark, monkeypatch):
    """Rows of many pages leave in one batch; a page of its own each took most of the time."""
    sizes = []
    made = scanner.pa.RecordBatch
    one = "<p>The title of it</p><a href='BOCYL-D-05012026-1.pdf'>"
    monkeypatch.setattr(scanner, "MOST_ROWS", 3)
    frames = {}
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, run, kind: frames.setdefault("run", run))
    scanner.page_items(spark.createDataFrame([(DAY, one)], "day date, content string"))
    batch = made.from_pydict({"day": [DAY] * 7 + [None], "content": [one] * 7 + [one]})
    sizes = [b.num_rows for b in frames["run"](iter([batch]))]
    assert sizes == [3, 3, 1]


def test_issue_header_and_days(spark):
    row = spark.createDataFrame([("<b>BOLETÍN Nº 12</b> - 9 de enero de 2024 - EXTRAORDINARIO",)], "x string").select(summaries.issue_header(F.col("x")).alias("h")).first()["h"]
    assert tuple(row) == (12, datetime.date(2024, 1, 9), True)
    issues = spark.createDataFrame([(1, DAY), (2, DAY)], "number int, day date")
    days = spark.createDataFrame([(DAY,), (datetime.date(2026, 1, 6),)], "day date")
    assert sorted((r["number"] or 0) for r in summaries.issues_of_day(issues, days).collect()) == [0, 1, 2]


def test_bodies(spark):
    good = "<documento><metadatos><identificador>A</identificador></metadatos><texto><p> one </p><p/><p>two  x</p></texto></documento>"
    evil = "<!DOCTYPE d [<!ENTITY e 'boom'>]>" + good.replace("one", "&e;")
    got = {r["key"]: r for r in bodies.xml_bodies(spark.createDataFrame([(1, good), (2, evil), (3, None), (4, "")], "key int, content string")).collect()}
    assert got[1]["text"] == "one two  x" and got[1]["references"] == []
    assert not got[2]["text"] and not got[3]["text"]


def test_container_text():
    words = "word " * 60
    assert bodies.container_text(f"<html><nav>no</nav><article><p>{words}<script>var x='</p>';</script><br>end</article><footer>no</footer>") == (words + "end").strip()
    assert bodies.container_text("<html><article>short</article>") == ""
    assert bodies.container_text(f"<div id='other'>{words}</div><div id='content'><div>{words}</div>tail</div>after") == (words + "tail").strip()
    assert bodies.container_text("<p>no container</p>") == "" and bodies.container_text(None) is None


def test_length_of_a_body_is_as_written(spark):
    """A page of 201 characters, 191 once its references are resolved, is a body; the same text written plainly is none."""
    words = "word " * 35
    pages = {"r": f"<!DOCTYPE html><html><article><p>{words}&quot;1d46e940c38b6b&quot;</p><br></article></html>"}
    pages["p"] = pages["r"].replace("&quot;", '"')
    assert bodies.container_text(pages["r"]) == words + '"1d46e940c38b6b"' and bodies.container_text(pages["p"]) == ""
    frame = spark.createDataFrame(list(pages.items()), "key string, html string")
    told = bodies.dispatched(frame.select("key", F.col("html").cast("binary").alias("content")))
    assert {r["key"]: (r["derivation"], r["text"]) for r in told.collect()} == {"r": ("text", words + '"1d46e940c38b6b"'), "p": ("unreadable", None)}
    assert {r["key"]: r["t"] for r in frame.select("key", bodies.article_text(F.col("html")).alias("t")).collect()} == {"r": words + '"1d46e940c38b6b"', "p": ""}


def test_dispatch_and_recovery(spark):
    rows = spark.createDataFrame([(1, b"%PDF-1.7 x"), (2, b"<html><article>" + b"w " * 300 + b"</article>"), (3, b"<html>error</html>"), (4, b"<a>x <b>y</b></a>"), (5, None), (6, b"plain")], "key int, content binary")
    got = {r["key"]: (r["format"], r["derivation"]) for r in bodies.dispatched(rows).collect()}
    assert got == {1: ("pdf", "pdf"), 2: ("html", "text"), 3: ("html", "unreadable"), 4: ("xml", "text"), 5: (None, "none"), 6: ("other", "text")}
    ill = spark.createDataFrame([("a", "http://x/a.xml", "unreadable"), ("b", "http://x/b.htm", "unreadable"), ("c", "http://x/c.xml", "text")], "id string, url string, state string")
    assert [(r["new_id"], r["other_url"]) for r in bodies.recovery_candidates(ill).collect()] == [("a#pdf", "http://x/a.pdf")]


def test_validators(spark):
    rows = spark.createDataFrame([("AAA-12", "control: 12"), ("AAA-13", "control: 12"), ("AAA-1", None), ("ZZZ-1", "x")], "i string, b string")
    assert [r["ok"] for r in rows.select(bodies.is_the_one(F.col("i"), F.col("b")).alias("ok")).collect()] == [True, False, False, None]


def test_block_versions(spark):
    content = (
        "<response><data><texto><bloque id='a1' tipo='precepto' titulo='A'><version id_norma='N1' fecha_vigencia='20200101'><p class='x'>one</p><p class='nota_pie'>note</p></version>"
        "<version fecha_vigencia='20210101'><p>lost</p></version><version id_norma='N2' fecha_vigencia='bad'><p class='x'> </p></version></bloque><bloque id='n' tipo='nota_inicial'><version id_norma='N3'><p>n</p></version></bloque></texto></data></response>"
    )
    got = consolidated.block_versions(spark.createDataFrame([(1, content)], "key int, content string")).orderBy("place").collect()
    assert [(g["modifier"], g["in_force"], g["text"]) for g in got] == [("N1", datetime.date(2020, 1, 1), "one"), ("N2", None, None)]


def write(path, value):
    path.write_text(json.dumps(value))
    return str(path)


def test_watchlist(spark, tmp_path):
    good = {"version": "1", "items": [{"identifier": "LAW-A-2020-1", "title": "t", "specific": True}]}
    version, items = configuration.watchlist(spark, write(tmp_path / "w.json", good))
    assert version == "1" and items[0].identifier == "LAW-A-2020-1" and items[0].in_force
    for i, bad in enumerate([{**good, "version": None}, {**good, "items": []}, {**good, "items": good["items"] * 2}, {**good, "items": [{"identifier": "x"}]}]):
        with pytest.raises(ValueError):
            configuration.watchlist(spark, write(tmp_path / f"bad{i}.json", bad))


def test_cases_and_reports(spark, tmp_path):
    (tmp_path / "cases").mkdir()
    write(tmp_path / "cases" / "a.json", {"identifier": "A", "expected_state": "suspect"})
    assert configuration.cases(spark, str(tmp_path / "cases")).first()["relevant"] is True
    write(tmp_path / "cases" / "b.json", {"identifier": "B", "expected_state": "maybe"})
    with pytest.raises(Exception, match="bad case B"):
        configuration.cases(spark, str(tmp_path / "cases")).collect()

    kind = configuration.REPORT_SCHEMA
    given = [("A", "alert", "s", "r", "f", None, None), ("B", "red", "s", "r", "f", None, None), ("C", "look", "s", " ", "f", None, None), ("D", "look", "s", "r", "f", None, None), ("E", "discard", "s", "r", "f", None, None)]
    queue = spark.createDataFrame([("A", 1), ("E", 5)], "identifier string, queue_id int")
    stored = spark.createDataFrame([(5, "alert", "old"), (9, "look", "kept")], "queue_id int, light string, summary string")
    after, counters = configuration.reports(spark.createDataFrame(given, kind), queue, stored)
    assert counters.first().asDict() == {"read": 5, "invalid": 2, "without_item": 1, "created": 1, "replaced": 1}
    assert sorted(tuple(r) for r in after.collect()) == [(1, "alert", "s"), (5, "discard", "s"), (9, "look", "kept")]


def test_archive_is_idempotent_and_checked(spark, tmp_path):
    folder = str(tmp_path / "archive")
    docs = spark.createDataFrame([("a",), ("b",), ("a",), ("",)], "text string")
    for _ in range(2):
        tables.archive(docs, "text", ".txt", folder)
    rows = spark.read.parquet(folder)
    assert rows.count() == 3
    (tmp_path / "files").mkdir()
    for content, name in ((b"a", hashlib.sha256(b"a").hexdigest()), (b"b", hashlib.sha256(b"c").hexdigest())):
        (tmp_path / "files" / f"{name}.txt").write_bytes(content)
    states = sorted(r["state"] for r in tables.integrity(bodies.archive(spark, str(tmp_path / "files"))).collect())
    assert states == ["corrupt", "verified"]


def test_merge_and_append(spark, tmp_path):
    stored = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string")
    changes = spark.createDataFrame([(1, "b"), (None, "m"), (2, "c")], "k int, v string")
    assert sorted(r["v"] for r in tables.merged(stored, changes, "k").collect()) == ["b", "c", "m"]
    for _ in range(3):
        tables.append_missing(changes, str(tmp_path / "t"), ["k"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3


def test_feeds(spark):
    kind = "id int, title string, at timestamp_ntz, summary string"
    rows = spark.createDataFrame([(i, f"a & <b> {i}", datetime.datetime(2026, 1, 1 + i), 'x "y"') for i in range(3)], kind)
    feed = feeds.atom(rows, "T", "h.example", prefix="UNREVIEWED · ", most=2).first()["feed"]
    assert feed.count("<entry>") == 2 and feed.index("b&gt; 2") < feed.index("b&gt; 1") and "UNREVIEWED · a &amp; &lt;b&gt;" in feed and "<updated>2026-01-03T00:00:00Z" in feed
    import xml.etree.ElementTree as tree

    tree.fromstring(feed)
    empty = feeds.atom(spark.createDataFrame([], kind), "T", "h.example", now=F.lit("2026-02-02 00:00:00")).first()["feed"]
    assert "<entry>" not in empty and "2026-02-02T00:00:00Z" in empty


EVENTS = "event_id long, user_id long, ts timestamp_ntz"


def at(*seconds, user=1):
    t0 = datetime.datetime(2026, 1, 1)
    return [(i, user, None if s is None else t0 + datetime.timedelta(seconds=s)) for i, s in enumerate(seconds)]


def test_limiter_does_not_remember_rejected_hits(spark):
    got = limiter.limited(spark.createDataFrame(at(0, 10, 20, 59, 60, 61), EVENTS), limit=2, window=60.0).orderBy("event_id").collect()
    assert [g["accepted"] for g in got] == [True, True, False, False, True, False]
    assert got[2]["retry_after"] == 41
    assert limiter.limited(spark.createDataFrame(at(0, None), EVENTS), limit=1).filter("accepted").count() == 2


def test_bucket_and_sessions(spark):
    got = limiter.bucketed(spark.createDataFrame(at(0, 1, 2, 62), EVENTS), capacity=2.0, refill=1 / 60).orderBy("event_id").collect()
    assert [g["accepted"] for g in got] == [True, True, False, True]
    got = limiter.with_sessions(spark.createDataFrame(at(0, 1, 2, 200), EVENTS), ttl=100.0, most=2).orderBy("event_id").collect()
    assert [(g["open_sessions"], g["evicted"]) for g in got] == [(1, 0), (2, 0), (2, 1), (1, 0)]


def test_window_functions(spark):
    rows = spark.createDataFrame(at(0, 30, 90, 200), EVENTS)
    assert sorted(r["c"] for r in rows.select(windows.recent_count("user_id", "ts", 60).alias("c")).collect()) == [1, 1, 2, 2]
    assert windows.sessions(rows, "ts", "100 seconds", "user_id", n=F.count("*")).count() == 2
    assert windows.tumbling(rows, "ts", "60 seconds", n=F.count("*")).count() == 3


def test_incremental_run_is_idempotent(spark, tmp_path):
    source, folder, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    for part in ([(1, "a"), (2, "b")], [(2, "b"), (3, "c")]):
        spark.createDataFrame(part, "k int, v string").write.mode("append").parquet(source)
        runner.run_available(spark, source, "k int, v string", folder, marks, [lambda b: b.withColumn("v", F.upper("v"))], ["k"]).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(folder).collect()) == [(1, "A"), (2, "B"), (3, "C")]


def test_stream_limiter_agrees_with_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = at(0, 10, 20, 59, 60, 61) + [(10 + i, 2, t) for i, _, t in at(0, 1, 2)]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(source)
    stream = limiter.limited_stream(spark.readStream.schema(EVENTS).parquet(source), limit=2, window=60.0)
    query = stream.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    found = {(r["event_id"], r["accepted"]) for r in spark.table("limited").collect()}
    assert found == {(r["event_id"], r["accepted"]) for r in limiter.limited(spark.createDataFrame(rows, EVENTS), limit=2, window=60.0).collect()}


def test_rules_of_state_alone():
    rule = limiter.SlidingWindow(1, 10.0)
    assert [rule.hit(t)[0] for t in (0.0, 5.0, 10.0)] == [True, False, True]
    assert pd.Series([1]).sum() == 1 and sniffed_format is not None


def test_layouts(spark):
    children = [("title", " T "), ("meta", "m"), ("body", "B"), ("other", "")]
    row = spark.createDataFrame([(children, " ", "second", "&amp;lt;p&amp;gt;Hi  there&amp;lt;/p&amp;gt;")], "c array<struct<tag:string,value:string>>, a string, b string, e string")
    got = row.select(bodies.all_but(F.col("c"), "meta").alias("x"), bodies.first_layout(F.col("a"), F.col("b")).alias("y"), bodies.escaped_html(F.col("e")).alias("z")).first()
    assert tuple(got) == ("T B", "second", "Hi there")


def test_only_stale_rows_are_computed_again(spark):
    stored = spark.createDataFrame([(1, "old", "a"), (2, "new", "b")], "k int, version string, v string")
    after = tables.by_version(stored, lambda: F.col("version") != "new", lambda rows: rows.withColumn("v", F.upper("v")).withColumn("version", F.lit("new")), "k")
    assert sorted(tuple(r) for r in after.collect()) == [(1, "new", "A"), (2, "new", "b")]


def test_command_line(capsys):
    from docstrata.__main__ import main

    assert main(["list"]) == 0 and "prefilter_rows" in capsys.readouterr().out


def test_sources_by_name(spark):
    row = '[{"control": "123456", "title": "t", "url": "u"}, {"control": "1", "title": "t", "url": null}]'
    raw = spark.createDataFrame([("open_data", row), ("register", "nothing today"), ("other", "x"), (None, "y")], "source string, content string").withColumn("day", F.lit("2026-01-05").cast("date"))
    assert sorted((r["source"], r["identifier"], r["good"]) for r in registry.items(raw).collect()) == [("open_data", "1", False), ("open_data", "123456", True)]
    assert sorted(r["source"] or "" for r in registry.unknown(raw).collect()) == ["", "other"]
    assert registry.items(raw.limit(0)).count() == 0


def test_page_scanner_holds_and_uses_up(spark):
    link = lambda n, day="05012026": f"<a href='/x/BOCYL-D-{day}-{n}.pdf'>pdf</a>"
    title = lambda t: f"<p>Title of {t}</p>"
    page = (
        title("other") + link(9, "01012022") + link(1) + link(1)  # another day's link leaves the title
        + '<h3 class="a">S &amp; <b>one</b></h3><h5 class="encabezado6">O</h5>' + link(2) + title("two") + link(1) + link(2)  # first without, then with a title
        + link(3) + "<h3>S two</h3><p>short</p>" + link(4) + title("unused") + title("five") + link(5) + "<!-- " + link(5) + " -->"
    )
    many = "".join(title(i) + link(i) for i in range(301))
    other = datetime.date(2026, 1, 6)
    frame = spark.createDataFrame([(DAY, page), (DAY, many), (other, page), (DAY, ""), (DAY, None), (None, page)], "day date, content string").withColumn("title", F.lit("clash"))
    got = sorted((r["state"], r["identifier"] or "", r["title"], r["section"], r["organ"]) for r in scanner.page_items(frame).collect())
    name = "BOCYL-D-05012026-"
    assert got == [
        ("good", name + "1", "Title of other", None, None), ("good", name + "2", "Title of two", "S & one", "O"), ("good", name + "5", "Title of five", "S two", "O"),
        ("too many", "", None, None, None), ("untitled", name + "3", None, "S & one", "O"), ("untitled", name + "4", None, "S two", "O"),
    ]
    assert len(scanner.page_rows(DAY, "".join(title(i) + link(i) for i in range(300)))) == 300
    assert scanner.page_items(frame.limit(0)).count() == 0
    source = frame.limit(1).withColumn("source", F.lit("page"))
    assert sorted((r["identifier"], r["url"], r["good"]) for r in registry.items(source).collect())[0] == (name + "1", f"https://bocyl.jcyl.es/boletines/2026/01/05/xml/{name}1.xml", True)


def test_deeds_of_their_own_day(spark):
    deed = lambda n, day="20260105", title="T": f"<disposicion><identificador>BOCM-{day}-{n}</identificador><titulo> {title}{n} </titulo><url_xml>u</url_xml><url_pdf> </url_pdf></disposicion>"
    issue = lambda inner, name="BOCM-20260105": f"<sumario><metadatos><identificador>{name}</identificador><fecha_publicacion>x</fecha_publicacion></metadatos><diario><secciones><seccion nombre='S'><apartado nombre='A'><organismo nombre='O'>{inner}</organismo></apartado><apartado nombre='B'><organismo nombre='P'>{inner}</organismo></apartado></seccion></secciones></diario></sumario>"
    whole = lambda content: [(r["identifier"], r["title"], r["section"], r["heading"], r["organ"], r["url_pdf"], r["good"]) for r in summaries.deeds(raw(spark, content)).orderBy("identifier").collect()]
    assert whole(issue(deed(1) + deed(2))) == [(f"BOCM-20260105-{n}", f"T{n}", "S", "A", "O", None, True) for n in (1, 2)]
    assert len(whole(issue("".join(deed(n) for n in range(400))))) == 400
    refused = [issue(deed(1), "BOCM-20260106"), issue(deed(1) + deed(2, "20260106")), issue(deed("1x")), issue(deed(1).replace("T1", "")), issue(""), issue("".join(deed(n) for n in range(401))), issue(deed(1)).replace("<sumario>", "<!DOCTYPE s><sumario>"), "no summary", None]
    for content in refused:
        assert [r[1:] for r in whole(content)] == [(None, None, None, None, None, False)]


def test_spanish_ranking(spark):
    from docstrata.operators import coverage

    rows = [("Oviedo", 1), ("Nuez", 1), ("Ñora", 1), ("Ávila", 1), ("Azul", 1), ("Zamora", 2), ("Zafra", 0), (None, 1), ("zeta", 1)]
    got = [r["name"] for r in coverage.ranking(spark.createDataFrame(rows, "name string, alerts int"), "alerts", "name", 9).collect()]
    assert got == ["Zamora", "Ávila", "Azul", "Nuez", "Ñora", "Oviedo", "zeta", None]
    assert coverage.ranking(spark.createDataFrame(rows, "name string, alerts int"), "alerts", "name").count() == 6


def test_a_ledger_loses_and_doubles_nothing(spark, tmp_path, monkeypatch):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    add = lambda *rows: spark.createDataFrame(list(rows), "k int, v string").coalesce(1).write.mode("append").parquet(source)

    def run(marks="marks", files=2):
        runner.run_with_ledger(spark, "s", source, "k int, v string", folder, str(tmp_path / marks), [lambda b: b.withColumn("v", F.upper("v"))], files).awaitTermination()

    rows = lambda: sorted(((r["k"], r["v"]) for r in runner.committed(spark, folder).collect()), key=str)
    states = lambda: sorted(r["state"] for r in runner.audited(spark, folder).collect())
    assert runner.committed(spark, folder) is None and runner.audited(spark, folder) is None
    for i in range(5):
        add((i, "a"), (i, "a"), (None, None))
    real, calls = runner.commit, []

    def dies(lines, path):  # the second batch has its rows, not its lines
        calls.append(path)
        if len(calls) == 2:
            raise RuntimeError("killed")
        real(lines, path)

    monkeypatch.setattr(runner, "commit", dies)
    with pytest.raises(Exception, match="killed"):
        run()
    assert len(rows()) == 6 and states() == ["unseen", "verified"]
    monkeypatch.setattr(runner, "commit", real)
    run()
    all_rows = sorted([(i, "A") for i in range(5)] * 2 + [(None, None)] * 5, key=str)
    assert rows() == all_rows and states() == ["verified"] * 3
    run("other marks", 3)  # a backfill without marks: everything is done
    assert rows() == all_rows
    add((9, "z"))
    run("new marks", 3)  # the old files again, and a new one
    run()
    assert rows() == sorted([*all_rows, (9, "Z")], key=str) and states() == ["verified"] * 4
    assert spark.read.parquet(folder + "/ledger").agg(F.sum("read"), F.count_distinct("file"), F.count("*")).first()[:] == (16, 6, 6)
    one = runner.committed(spark, folder).first()["batch"]
    spark.createDataFrame([(7, "x")], "k int, v string").write.mode("append").parquet(f"{folder}/data/batch={one}")
    assert states() == ["changed"] + ["verified"] * 3


def test_body_states(spark):
    xml = "<?xml version='1.0'?>"
    cases = [
        ("BOA-007", f"{xml}<r><registro><docn>007</docn></registro></r>", "right"), ("BOA-007", f" {xml}<r><registro><docn>007</docn></registro></r>", "unreadable"), ("BOA-007", f"{xml}<r><registro><docn>7</docn></registro></r>", "another"), ("BOA-007", "<r><registro><docn>007</docn></registro></r>", "unreadable"),
        ("BOA-007", f"{xml}<r><registro><docn>007</docn></registro><registro><docn>007</docn></registro></r>", "unreadable"),
        ("BOCM-20260105-3", "<d><metadatos><identificador> BOCM-20260105-3 </identificador><fecha_publicacion>20260104</fecha_publicacion></metadatos></d>", "right"), ("BOCM-20260105-3", "<d><metadatos><identificador>BOCM-20260105-30</identificador></metadatos></d>", "another"),
        ("BOCM-2026-3", "<d/>", "malformed"), ("BOCM-20260105-3\n", "<d/>", "malformed"), ("BOCM-20260105-3", "<!DOCTYPE d><d><metadatos><identificador>BOCM-20260105-3</identificador></metadatos></d>", "unreadable"),
        ("BOCYL-D-05012026-1", f"{xml}<d><fechaPublicacion>2026-01-05</fechaPublicacion></d>", "right"), ("BOCYL-D-05012026-1", f"{xml}<d><fechaPublicacion>2026-05-01</fechaPublicacion></d>", "another"), ("BOCYL-D-05012026-1", f"{xml}<d/>", "unreadable"),
        ("BOPV-D-20260105-12", "<d><BOPVOrden>12</BOPVOrden><BOPVOrden>13</BOPVOrden></d>", "right"), ("BOPV-D-20260105-12", "<d><BOPVOrden>012</BOPVOrden></d>", "another"),
        ("BON-D-2024-012-5", "<p>BOLETÍN Nº 12 - 9 de enero de 2024</p>", "right"), ("BON-D-2023-12-5", "<p>BOLETÍN Nº 12 - 9 de enero de 2024</p>", "another"), ("BON-D-2024-12-5", "<p>error</p>", "unreadable"), ("BON-D-2024-12-5", None, "unreadable"),
        ("BOE-A-2024-1", "x", None), (None, "x", None), ("BOC-1", "x", None), ("", "", None),
    ]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "k int, a string, b string")
    got = {r["k"]: r["s"] for r in rows.select("k", bodies.body_state(F.col("a"), F.col("b")).alias("s")).collect()}
    assert [(c, got[i]) for i, c in enumerate(cases) if got[i] != c[2]] == []
