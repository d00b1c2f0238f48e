import json
import random
import re

import pytest
from pyspark.sql import functions as F

from docstrata.config import CITES, CODE, LICENSE, SECRET, ClausePattern, Lexicon, Versions
from docstrata.functions.text import normalise
from docstrata.operators import anchors, citation_index, clauses, coverage, extraction, gate, measure, prefilter, queues, references, rules, versions

LEX = Lexicon(("gato", "perro"), ("the",), "1")


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), "id int, title string, body string, organ string, unreadable boolean, touched array<string>")


def test_prefilter_rules(spark):
    many = " ".join(["gato"])
    rows = docs(
        spark,
        (1, "gato", "x", "", True, None), (2, "t", "nothing", "", False, ["L"]), (3, "t", "nothing", "", False, None), (4, "nothing", None, "", False, None), (5, "gato", None, "", False, []),
        (6, "the", None, "", False, None), (7, "t", "the", "", None, None), (8, "t", many, "", False, None), (9, "t", "", "", False, None), (10, "t", "x", "Perro", False, None), (11, None, None, None, None, None),
    )
    got = {r["id"]: r for r in prefilter.evaluate(rows, LEX).collect()}
    assert [got[i]["state"] for i in range(1, 12)] == ["unreadable", "relevant", "discarded", "pending", "relevant", "suspect", "discarded", "suspect", "discarded", "suspect", "pending"]
    assert got[2]["axes"] == ["referential"] and got[7]["terms"] == [] and got[7]["n_direct"] == 0
    assert got[8]["terms"] == ["gato"] and got[10]["terms"] == ["perro"]
    assert prefilter.evaluate(rows, LEX, many_direct=1).filter("id = 8").first()["state"] == "relevant"


def test_prefilter_plan_has_no_shuffle(spark):
    plan = prefilter.evaluate(docs(spark, (1, "a", "b", "c", False, [])), LEX)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_stale_has_no_null_trap(spark):
    v = Versions("1", "1", "1", "1")
    rows = spark.createDataFrame([(1, "d", "1", "1", "1", True), (2, None, "1", "1", "1", True), (3, "d", None, "1", "1", True), (4, "d", "1", "0", "1", True), (5, "d", "1", "1", None, True), (6, "d", "1", "1", None, False)], "id int, evaluated_at string, lexicon_version string, watchlist_version string, text_version string, has_body boolean")
    assert sorted(r["id"] for r in rows.filter(prefilter.stale(v)).collect()) == [2, 3, 4, 5]


def test_sentences_cover_the_text_in_code_points(spark):
    s = "😀 Uno. Dos; «Tres» cuatro. 5 no. Ñandú."
    got = spark.createDataFrame([(s,)], "x string").select(clauses.sentences(F.col("x")).alias("s")).first()["s"]
    assert all(s[g["start"] : g["finish"]] == g["fragment"] for g in got)
    assert [g["fragment"] for g in got] == ["😀 Uno.", "Dos;", "«Tres» cuatro. 5 no.", "Ñandú."]


def test_every_construction_of_a_long_sentence_gets_a_window(spark):
    first, second = "it is released under nothing " + "x " * 1000, "and licensed under MIT terms " + "y " * 1000
    text = first + second + "licensed under Apache terms"
    got = sorted((r["start"], r["finish"], r["fragment"]) for r in clauses.clauses(spark.createDataFrame([(1, text)], "doc_id int, text string"), LICENSE).collect())
    wanted = []
    for m in re.finditer(r"(?i)\b(?:released|licensed)\s+under\b", text):
        margin = (clauses.LONGEST - len(m[0])) // 2
        a, b = max(0, m.start() - margin), min(len(text), m.end() + margin)
        if re.search(r"(?i)\bversion\s+\d|\bMIT\b|\bApache\b", text[a:b]):
            wanted.append((a, b, text[a:b]))
    assert got == wanted and len(got) == 2


def test_a_body_must_name_its_own_identifier(spark):
    from docstrata.sources.bodies import is_the_one

    rows = [("AAA-123", "control: 12", False), ("AAA-123", "control: 123", True), ("AAA-12", "control: 123", False), ("BBB-20240102-7", "fecha: 20240102", True), ("CCC-20240102-7", "identificador: CCC-20240102-7", True), ("CCC-20240102-71", "identificador: CCC-20240102-7", False), ("AAA-1", "nothing", False), ("XXX-1", "control: 1", None)]
    df = spark.createDataFrame(rows, "i string, b string, good boolean")
    assert all(r["good"] == r["got"] for r in df.withColumn("got", is_the_one(F.col("i"), F.col("b"))).collect())


def test_clauses_need_their_companion_in_the_same_sentence(spark):
    rows = spark.createDataFrame([(1, "Released under X. MIT here."), (2, "A. Released under the MIT terms. B."), (3, None), (4, ""), (5, "x" * 700 + " licensed under MIT " + "y" * 700)], "doc_id int, text string")
    got = {r["doc_id"]: r for r in clauses.clauses(rows, LICENSE).collect()}
    assert set(got) == {2, 5}
    assert got[2]["fragment"] == "Released under the MIT terms."
    assert got[5]["finish"] - got[5]["start"] <= clauses.LONGEST and "licensed under MIT" in got[5]["fragment"]


def test_evidence_is_counted_once_and_bounded(spark):
    text = " ".join(f"Is licensed under MIT {i}." for i in range(80))
    got = clauses.clauses(spark.createDataFrame([(1, text)], "doc_id int, text string"), LICENSE)
    assert got.count() == clauses.MOST_EVIDENCE and got.select("start").distinct().count() == clauses.MOST_EVIDENCE


def test_clause_at_and_organ(spark):
    rows = spark.createDataFrame([("Uno. Dos tres.",)], "x string").select(clauses.clause_at(F.col("x"), F.lit(6)).alias("c"))
    assert rows.first()["c"]["fragment"] == "Dos tres."
    evidence = spark.createDataFrame([("the board of cats",), ("the board",)], "fragment string")
    assert clauses.of_organ(evidence, "board", ("cats",)).count() == 1


@pytest.mark.parametrize(
    ("before", "verb"),
    [
        ("This text amends ", "AMENDS"), ("This text amends the act; it repeals ", "REPEALS"), ("It amends things. Then there is ", CITES), ("It amends law 3/2020 and ", CITES), ("It amends what follows, pursuant to ", CITES),
        ("nothing ", CITES), ("It amends " + "x" * 300, CITES), ("It repeals, and is amended by ", "AMENDS"), ("It repeals «the ", CITES),
    ],
)
def test_governing_verb(spark, before, verb):
    assert spark.createDataFrame([(before,)], "b string").select(references.governing_verb(F.col("b")).alias("v")).first()["v"] == verb


def test_verbs_in_names_and_other_words(spark):
    verb = lambda before, title=None, cited="MIT License": spark.createDataFrame([(before, title, cited)], "b string, t string, c string").select(references.governing_verb(F.col("b"), F.col("t"), F.col("c")).alias("v")).first()["v"]
    named = "Order 5, by which is amended the "
    assert verb(named) == CITES and verb(named, "ORDER 5, by which is amended the MIT  Licénse") == "AMENDS"
    assert verb(named, "Order 5, by which is amended another text") == CITES and verb(named, "On the MIT License") == CITES and verb(named, "by which", "") == CITES
    assert verb("It repeals parts; the order by which is amended the ") == "REPEALS"
    assert verb("It amends and amendsit the ") == "AMENDS" and verb("It amendsit the ") == CITES
    assert verb("It amends art. A of the ") == "AMENDS" and verb("It amends all. A of the ") == CITES
    assert verb(None) == CITES and verb("") == CITES


def test_mentions_and_strongest(spark):
    rows = spark.createDataFrame([(1, "😀 See the MIT License. It amends MIT License and repeals mit  license."), (2, "none"), (3, None)], "doc_id int, text string")
    mentions = references.citation_mentions(rows, r"(?i:mit\s+license)").orderBy("place").collect()
    assert [m["verb"] for m in mentions] == [CITES, "AMENDS", "REPEALS"]
    assert all(rows.first()["text"][m["start"] :].startswith(m["citation"]) for m in mentions)
    best = references.strongest(references.citation_mentions(rows, r"(?i:mit\s+license)")).collect()
    assert [(b["doc_id"], b["verb"], b["mentions"]) for b in best] == [(1, "AMENDS", 3)]


def test_the_number_of_passages_changes_no_citation(spark, monkeypatch):
    long, six = "The quick brown fox jumps over the lazy dog today", "one two three four five six"
    texts = [f'"{long}"', f"({long})", f"un{long}!", f"{long}, and", f"x {six}, y", f"x{six}y", f'"{six}"', "ab", "xaby", "a😀b", "two words", "(two words)", long.replace(" ", "  "), "", None, "é" * 40, "line\nbreak here"]
    passages = [long, six, "ab", "b", "😀", "two words", "wo word", "quick", "fox jumps over the lazy", " the lazy dog", "é" * 16, "é" * 33, "e\nb", "nowhere to be found in any of these few texts", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(100 + i, p) for i, p in enumerate(passages)], "item_id long, text string")
    plain = {(i, 100 + j) for i, t in enumerate(texts) for j, p in enumerate(passages) if t and p and p in t}
    touched = {i: sorted(str(k) for d, k in plain if d == i) for i in range(len(texts))}
    for most in (citation_index.MOST_PHRASES, 3):
        monkeypatch.setattr(citation_index, "MOST_PHRASES", most)
        got = [tuple(r) for r in references.cited_passages(docs, items).collect()]
        assert len(got) == len(set(got)) and set(got) == plain
        assert {r["doc_id"]: sorted(r["touched"]) for r in references.with_touched(docs, items).collect()} == touched
    assert "NestedLoop" not in references.cited_passages(docs, items)._jdf.queryExecution().executedPlan().toString()


def test_touched_needs_no_shuffle(spark):
    texts = spark.createDataFrame([(1, "zero one two"), (2, "three"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(10, "one two"), (11, "three"), (12, None)], "item_id long, text string")
    out = references.with_touched(texts, items)
    assert {r["doc_id"]: r["touched"] for r in out.collect()} == {1: ["10"], 2: ["11"], 3: []}
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_modifying_edges(spark):
    refs = spark.createDataFrame([(1, "a", "AMENDS"), (2, "a", "CITES"), (3, "b", "REPEALS")], "doc_id int, key string, verb string")
    assert [r["doc_id"] for r in references.modifying_edges(refs, spark.createDataFrame([("a",)], "key string")).collect()] == [1]


def facts(spark, **change):
    base = {"n_suppressions": 0, "n_repeals": 0, "n_modifications": 0, "n_organ": 0, "suppressed": [], "suppressed_specific": [], "repealed": [], "modified": []} | change
    kinds = ", ".join(f"{k} {'int' if isinstance(v, int) else 'array<int>'}" for k, v in base.items())
    return rules.classify(spark.createDataFrame([tuple(base.values())], kinds), rules.catalogue()).first()


def test_rules_in_order(spark):
    assert facts(spark)["rule"] is None and facts(spark, n_organ=1)["rule"] is None
    assert facts(spark, n_suppressions=1)["rule"] == "SUP-2"
    assert facts(spark, n_suppressions=1, n_organ=1)["rule"] == "SUP-3"
    assert facts(spark, n_modifications=1, modified=[1], n_organ=1)["rule"] == "MOD-1"
    assert facts(spark, n_repeals=1, repealed=[1], n_modifications=1, modified=[1])["rule"] == "REP-1"
    hit = facts(spark, n_suppressions=1, suppressed=[1], suppressed_specific=[1], n_repeals=1, repealed=[1])
    assert (hit["rule"], hit["verdict"], hit["severity"]) == ("SUP-1", "setback", 4)
    assert facts(spark, n_suppressions=1, suppressed=[1])["verdict"] == "unclear"


def test_obsolete_and_corroborated(spark):
    before = spark.createDataFrame([(1, "R", True), (2, "R", None), (3, None, None)], "id int, rule string, alerted boolean")
    now = spark.createDataFrame([(1, None), (2, "R")], "id int, rule string")
    assert [tuple(r) for r in rules.obsolete(now, before).collect()] == [(1, "R", True)]
    row = spark.createDataFrame([(["art. 5", "annex"], ["see 5 and X"])], "p array<string>, e array<string>").select(rules.corroborated(F.col("p"), F.col("e")).alias("c")).first()["c"]
    assert row["confirmed"] == ["art. 5"] and row["unconfirmed"] == ["annex"]


def test_chain_and_change_kinds(spark):
    rows = spark.createDataFrame([("b", 1, "x"), ("b", 2, ""), ("b", 3, "y"), ("c", 1, None)], "block string, v int, text string")
    got = versions.chain(rows, "block", ["v"], "text").withColumn("kind", versions.change_kind(F.col("previous_text"), F.col("text"))).orderBy("block", "v").collect()
    assert [g["kind"] for g in got] == ["insertion", "repeal", "insertion", "pointer"]
    assert [g["ordinal"] for g in got] == [1, 2, 3, 1]


def test_as_of(spark):
    alerts = spark.createDataFrame([(1, 10), (1, None), (2, 5)], "k int, cut int")
    changes = spark.createDataFrame([(1, 9, "a"), (1, 11, "b"), (2, 6, "c")], "k int, made int, what string")
    assert sorted(r["what"] for r in versions.changes_as_of(alerts, changes, "k", "made", "cut").collect()) == ["a", "a", "b"]
    events = spark.createDataFrame([(1, 10), (1, 11), (2, 5)], "k int, at int")
    latest = versions.latest_as_of(events, changes.withColumnRenamed("made", "since"), "k", "at", "since").orderBy("k", "at").collect()
    assert [r["state_what"] for r in latest] == ["a", "b", None]


@pytest.mark.parametrize(("text", "quote", "want"), [("ab cd ef", "cd", (3, 5)), ("😀 ab\n  cd ef", "ab cd", (2, 9)), ("x", "y", None), ("a.b", "a.b", (0, 3)), ("a  (b) \\E c", "(b) \\E c", (3, 11)), ("axb", "a.b", None), ("ab", "", None)])
def test_anchors(spark, text, quote, want):
    got = spark.createDataFrame([(text, quote)], "t string, q string").select(anchors.anchored(F.col("t"), F.col("q")).alias("a")).first()["a"]
    assert (None if got is None else (got["start"], got["finish"])) == want
    assert got is None or text[got["start"] : got["finish"]] == got["fragment"]


def test_gate(spark):
    queue = spark.createDataFrame([(1, "waiting", None, None), (2, "approved", "old", "setback"), (3, "waiting", None, "neutral"), (4, "waiting", None, None)], "id int, state string, note string, sign string")
    decisions = spark.createDataFrame([(1, "approved", "n" * 2000, "setback"), (1, "rejected", "a", None), (2, "rejected", "x", None), (3, "rejected", "y", "setback"), (4, "reopened", "z", None)], "id int, to string, note string, sign string")
    got = {r["id"]: r for r in gate.decide(queue, decisions).collect()}
    assert got[1]["state"] == "approved" and len(got[1]["note"]) == gate.MOST_NOTE and got[1]["sign"] == "setback"
    assert got[2]["state"] == "approved" and got[2]["note"] == "old"
    assert got[3]["state"] == "rejected" and got[3]["sign"] == "neutral"
    assert got[4]["state"] == "waiting"
    long = spark.createDataFrame([(1, "approved", "n" * 2001, None)], decisions.schema)
    assert {r["id"]: r["state"] for r in gate.decide(queue, long).collect()} == {1: "waiting", 2: "approved", 3: "waiting", 4: "waiting"}
    assert gate.decide(queue, decisions).count() == queue.count()
    again = {r["id"]: r for r in gate.decide(gate.decide(queue, decisions), decisions).collect()}
    assert again == got


def test_findings_and_pages(spark):
    reports = spark.createDataFrame([(1, "alert", ["c"]), (2, "alert", []), (3, "look", ["c"]), (4, "alert", ["c"])], "queue_id int, light string, corroborations array<string>")
    queue = spark.createDataFrame([(i, i * 10) for i in range(1, 5)], "queue_id int, detection_id int")
    alerts = spark.createDataFrame([(40,)], "detection_id int")
    assert [r["queue_id"] for r in gate.findings(reports, queue, alerts).collect()] == [1]
    assert [r["id"] for r in gate.page(spark.range(10), [F.desc("id")], 3, 2).collect()] == [7, 6, 5]
    for limit, offset in ((0, 0), (101, 0), (5, -1)):
        with pytest.raises(ValueError):
            gate.page(spark.range(3), [F.asc("id")], limit, offset)


def test_queues(spark):
    known = spark.createDataFrame([(1,), (None,)], "k int")
    assert [r["k"] for r in queues.missing(spark.createDataFrame([(1,), (2,), (None,)], "k int"), known, "k").collect()] == [2]
    taken, counts = queues.budgeted(spark.range(5), [F.asc("id")], 3)
    assert taken.count() == 3 and tuple(counts.first()) == (3, 2)
    sample = queues.stratified(spark.range(100).withColumn("s", F.col("id") % 3), "s", "id", 4, "x")
    assert sample.count() == 12 and sorted(r["id"] for r in sample.collect()) == sorted(r["id"] for r in sample.collect())


def test_nearest_rank(spark):
    values = [5, 1, 1, 9, 7, 3]
    rows = spark.createDataFrame([("a", v) for v in values] + [("a", None), ("b", 4)], "g string, v int")
    for q in (0.0, 0.5, 0.95, 1.0):
        got = {r["g"]: r["at_rank"] for r in measure.nearest_rank(rows, "v", q, "g").collect()}
        assert got == {"a": sorted(values)[min(int(q * 6), 5)], "b": 4}
    assert measure.nearest_rank(rows.select("v"), "v", 0.5).first()["at_rank"] == sorted([*values, 4])[3]


def test_coverage(spark):
    rows = spark.createDataFrame([("r", "x", 1), ("r", "y", 0), (None, "x", 1)], "region string, level string, on int")
    got = {(r["region"], r["level"], r["kind"]): (r["total"], r["active"]) for r in coverage.rolled_up(rows, "region", "level", F.col("on") == 1).collect()}
    assert got == {("r", "x", "level"): (1, 1), ("r", "y", "level"): (1, 0), ("r", None, "region"): (2, 1), (None, None, "total"): (3, 2)}
    bands = coverage.banded(spark.createDataFrame([("a",)], "b string"), F.col("b"), ["a", "z"]).orderBy("place").collect()
    assert [(b["band"], b["documents"]) for b in bands] == [("a", 1), ("z", 0)]


def test_extraction_is_strict(spark):
    answers = {
        "good": 'x {"affected": "L", "articles": [{"identifier": "1", "before": " ", "after": null}], "scope": "state"} y', "extra": '{"affected": "L", "more": 1}', "scope": '{"scope": "moon"}', "broken": '{"affected": ', "list": "[1]",
    }
    rows = spark.createDataFrame([(k,) for k in answers], "text string")
    got = {r["text"]: r for r in extraction.ask(extraction.prompts(rows), extraction.Scripted(answers)).withColumn("v", extraction.validated(F.col("answer"))).withColumn("p", extraction.pointers(F.col("v"))).collect()}
    assert got["good"]["v"]["affected"] == "L" and got["good"]["p"] == ["1"]
    assert all(got[k]["v"] is None for k in ("extra", "scope", "broken", "list"))


def test_answers_keep_a_strict_schema(spark):
    article = lambda **more: json.dumps({"articles": [{"identifier": "1", **more}]})
    good = {
        "empty": "{}", "nulls": '{"affected": null, "scope": null}', "blank": '{"organ": "\u00a0 \\t"}', "case": '{"scope": " STATE "}', "long": article(before="x" * 20_000), "around": article(after=" x\n"),
        "field": json.dumps({"affected": " " + "y" * 500}), "fifty": json.dumps({"articles": [{"identifier": str(i)} for i in range(50)]}),
    }
    bad = {
        "nested": article(severity="high"), "deep": article(before={"x": 1}), "number": '{"affected": 3}', "too long": article(after="x" * 20_001), "field": json.dumps({"organ": "y" * 501}), "none": '{"articles": null}', "object": '{"articles": {}}',
        "text": '{"articles": ["1"]}', "unnamed": '{"articles": [{"before": "x"}]}', "blank name": '{"articles": [{"identifier": " "}]}', "empty scope": '{"scope": ""}', "many": json.dumps({"articles": [{"identifier": str(i)} for i in range(51)]}),
        "twice": '{"affected": "a", "affected": "b"}', "second": json.dumps({"articles": [{"identifier": "1"}, {"identifier": "2", "x": 1}]}), "nothing": "", "bool": '{"scope": true}',
    }
    rows = [("good " + k, v) for k, v in good.items()] + [("bad " + k, v) for k, v in bad.items()] + [("bad null", None)]
    got = {r["k"]: r["v"] for r in spark.createDataFrame(rows, "k string, a string").select("k", extraction.validated(F.col("a")).alias("v")).collect()}
    assert [k for k, v in got.items() if k.startswith("good") != (v is not None)] == []
    assert got["good case"]["scope"] == "state" and got["good blank"]["organ"] is None and got["good around"]["articles"][0]["after"] == "x" and len(got["good fifty"]["articles"]) == 50
    assert got["good empty"]["articles"] == []


def test_extraction_reads_the_whole_text(spark, small):
    from docstrata.plans import registry

    article = lambda i: '{"affected": "%s", "scope": "state", "articles": [{"identifier": "%s"}]}' % (i, i)
    answers = {k: article(k) for k in ("HEAD KEY", "CUT KEY", "TAIL KEY")}
    texts = {1: "HEAD KEY" + "-" * 9000, 2: "-" * 3996 + "CUT KEY" + "-" * 9000, 3: "-" * 9000 + "TAIL KEY", 4: "HEAD KEY" + "-" * 9000 + "TAIL KEY", 5: "-" * 9000, 6: "", 7: None, 8: "-" * 3992 + "TAIL KEY", 9: "HEAD KEY" + "😀" * 8000 + "TAIL KEY"}
    rows = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    asked = extraction.ask(extraction.piece_prompts(rows), extraction.Scripted(answers, "none")).withColumn("x", extraction.validated(F.col("answer")))
    got = {r["doc_id"]: (r["full_length"], r["x"] and r["x"]["affected"], r["x"] and [a["identifier"] for a in r["x"]["articles"]]) for r in extraction.merged(asked, "doc_id", "full_length").collect()}
    plain = lambda t: [k for k in answers if k in (t or "")]
    assert got == {i: (None if t is None else len(t), *((plain(t)[0], plain(t)) if plain(t) else (None, None))) for i, t in texts.items()}

    found = {r["doc_id"]: r for r in registry.queries()["llm_extract_scripted"](spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(docs) and all(found[r["doc_id"]]["full_length"] == len(r["text"]) for r in docs)
    for r in docs:  # the two keys whose answers are valid; a piece answers by its first key
        pieces = [r["text"][at : at + 4000] for at in range(0, max(1, len(r["text"]) - extraction.OVERLAP), 4000 - extraction.OVERLAP)]
        named = ["MIT" if "MIT License" in p else "Apache" for p in pieces if "MIT License" in p or "Apache" in p]
        assert found[r["doc_id"]]["all_affected"] == list(dict.fromkeys(named)) and found[r["doc_id"]]["valid_pieces"] == len(named)


def test_a_failing_provider_fails_no_job(spark):
    def provider(prompt):
        raise ValueError(prompt)

    assert extraction.ask(extraction.prompts(spark.createDataFrame([("a",)], "text string")), provider).first()["answer"] is None


def test_pattern_names():
    with pytest.raises(ValueError):
        Lexicon((), ("a",), "1")
    with pytest.raises(ValueError):
        Lexicon(("a",), ("a",), "1")
    assert ClausePattern("n", "a", "b").name == "n" and normalise is not None


def test_public_views(spark):
    kind = "id int, day string, title string, sign string, human_sign string, text string, spans array<struct<start:int,finish:int,fragment:string>>"
    rows = spark.createDataFrame([(1, "d", None, "unclear", "neutral", "x" * 900, [(0, 1, "x"), (None, 2, "y")]), (2, "d", "t", "setback", None, None, None)], kind)
    got = {r["id"]: r for r in gate.public_alert(rows).collect()}
    assert got[1]["sign"] == "neutral" and got[1]["cut"] and len(got[1]["spans"]) == 1 and got[1]["title"] == ""
    assert got[2]["sign"] == "setback" and not got[2]["cut"] and got[2]["spans"] == []
    report = spark.createDataFrame([(1, "d", "t", "unclear", "s", "r", ["c"], "alert", "secret")], "id int, day string, title string, sign string, summary string, refutation string, citations array<string>, light string, recommendation string")
    assert not {"light", "recommendation"} & set(gate.public_finding(report).columns)


def test_only_named_items_enter_the_gate(spark):
    rows = spark.createDataFrame([(1, "R", ["w"], None), (2, "R", [], ["o"]), (3, "R", None, None), (4, None, ["w"], ["o"])], "id int, rule string, watched array<string>, organs array<string>")
    assert [r["id"] for r in rows.filter(gate.may_enter(F.col("rule"), F.col("watched"), F.col("organs"))).orderBy("id").collect()] == [1, 2]


def test_open_days(spark):
    kind = "source string, first date, last date"
    wanted = spark.sql("SELECT 'a' source, date'2026-01-01' first, date'2026-01-05' last UNION ALL SELECT 'b', date'2026-01-03', date'2026-01-01'")
    done = spark.sql("SELECT 'a' source, date'2026-01-02' first, date'2026-01-03' last")
    assert sorted(str(r["day"]) for r in queues.open_days(wanted, done).collect()) == ["2026-01-01", "2026-01-04", "2026-01-05"]
    assert queues.open_days(wanted, spark.createDataFrame([], kind)).count() == 5


def test_touched_and_own_changes(spark):
    references = spark.createDataFrame(
        [(1, "a", "AMENDS", "and SUPPRESSES art. 7"), (1, "a", "AMENDS", None), (1, "b", "REPEALS", ""), (1, "c", "CITES", "suppresses"), (2, "z", "AMENDS", ""), (3, None, "AMENDS", "")],
        "doc_id long, key string, verb string, text string",
    )
    watched = spark.createDataFrame([("a", True), ("a", False), ("b", None), ("c", True)], "key string, specific boolean")
    edges = rules.touched(references, watched, r"(?i)\bsuppresses\b")
    assert [tuple(r) for r in edges.collect()] == [(1, ["a", "b"], ["a"], ["a"], ["b"])]
    changes = spark.createDataFrame([(1, "a", 0), (1, "a", 0), (1, "c", 0), (2, "a", 0), (None, "a", 0)], "doc_id long, key string, modified int")
    assert [tuple(r) for r in rules.own_changes(changes, edges).collect()] == [(1, "a", 0), (1, "a", 0)]
    assert rules.touched(references.limit(0), watched, "x").count() == 0


def test_every_region_and_silences(spark):
    drawn = spark.createDataFrame([("N1", "One"), ("N2", "Two")], "region string, name string")
    covered = spark.createDataFrame([("N1", 2, 1), ("N3", 4, 0)], "region string, known int, watched int")
    alerts = spark.createDataFrame([(["N4", "N2"], 1, "low", "t1", 1), (["N2", "national", None], 3, "high", "t2", 2), (None, 1, "low", "t3", 3)], "regions array<string>, rank int, state string, title string, at int")
    found = coverage.every_region(drawn, covered, alerts, F.col("rank"), "state", "title", "at")
    assert sorted(tuple(r) for r in found.collect()) == [("N1", "One", 2, 1, None, None, 0), ("N2", "Two", 0, 0, "high", "t1", 2), ("N3", "N3", 4, 0, None, None, 0), ("N4", "N4", 0, 0, "low", "t1", 1)]
    assert tuple(coverage.silences(found).first()) == (1, 1, 4)


def test_optional_filters_and_null_groups(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, kind string")
    ids = lambda **wanted: [r["id"] for r in gate.page(rows, [F.desc("id")], **wanted).collect()]
    assert ids(kind=None) == [3, 2, 1] and ids(kind="a") == [1] and ids(kind="a", id=2) == []
    assert sorted((r["kind"] or "", r["rows"], r["unreadable"]) for r in coverage.legible_counts(rows, "kind", F.col("id") > 2).collect()) == [("", 1, 1), ("a", 1, 0), ("b", 1, 0)]


def test_criteria_distances(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(40) if rng.random() < 0.9 else None, rng.random() < 0.3, rng.random() < 0.3 if rng.random() < 0.9 else None) for _ in range(501)]
    for some in (rows, rows[:1], rows[:2], [r for r in rows if r[0] is None], []):
        frame = spark.createDataFrame(some, "d int, a boolean, b boolean")
        got = measure.criteria_distances(frame, "d", F.expr("not (coalesce(a, false) or coalesce(b, false))"), 10, a=F.col("a"), b=F.col("b")).first()
        known = sorted(r[0] for r in some if r[0] is not None)
        assert tuple(got)[:5] == (len(some), sum(r[1] for r in some), sum(bool(r[2]) for r in some), sum(not r[1] and not r[2] for r in some), sum(k <= 10 for k in known))
        assert tuple(got)[5:] == ((known[0], (known[(len(known) - 1) // 2] + known[len(known) // 2]) // 2, known[-1]) if known else (None, None, None))
    frame = spark.createDataFrame(rows, "d int, a boolean, b boolean")
    with pytest.raises(Exception, match="the rule in use differ"):  # one row of many
        measure.criteria_distances(frame.union(spark.createDataFrame([(1, False, True)], frame.schema)), "d", F.expr("not a and not coalesce(b and d <> 1, false)"), 10, a=F.col("a"), b=F.col("b")).collect()
    for far in (-1, 41):
        with pytest.raises(Exception, match="out of bounds"):
            measure.criteria_distances(spark.createDataFrame([(far, False)], "d int, a boolean"), "d", F.lit(True), 10, most=40, a=F.col("a")).collect()


def test_verbs_before_a_citation(spark):
    text = 'It amends the rules: it repeals "old" and amends art. 5 of the MIT License. Then it repeals the MIT License.'
    got = references.verbs_before(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string"), "MIT License").collect()
    assert {(r["place"], r["rest"].strip()[:6], r["governing"]) for r in got} >= {(0, "art. 5", "AMENDS"), (1, "the", "REPEALS")}
    assert all(r["distance"] == len(r["rest"]) for r in got)
    holding = [r for r in spark.createDataFrame(got).select("place", "verb", references.governs(F.col("rest")).alias("g"), F.array(*(F.when(x(F.col("rest")), k) for k, x in references.REJECTS.items())).alias("why")).collect()]
    assert all(r["g"] == (not any(r["why"])) for r in holding) and {r["place"] for r in holding if r["g"]} == {0, 1}


def test_clauses_of_several_families_in_one_pass(spark):
    """One scan and one splitting for all families, with the rows that each gives alone."""
    text = "It is licensed under the MIT License. The password: x1 is SECRET!! " + "x" * 1200 + " licensed under MIT. Licensed under nothing."
    rows = spark.createDataFrame([(1, text), (2, None), (3, "password: y2."), (4, "ABC!! licensed under Apache."), (5, "licensed under. MIT")], "doc_id int, text string")
    patterns = (LICENSE, SECRET, CODE)
    plain = lambda df: sorted(map(tuple, df.collect()))
    whole = clauses.clauses(rows, *patterns)
    assert plain(whole) == sorted(sum((plain(clauses.clauses(rows, p)) for p in patterns), [])) and {r["family"] for r in whole.collect()} == {"license", "secret", "shouted"}
    assert whole._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + whole._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") == 1


def test_evidence_is_parsed_once(spark):
    """Dropping spans from a parsed struct named the parse once for each of its fields."""
    read = spark.createDataFrame([("{}",)], "evidence string").select(rules.evidence_read(F.col("evidence")).alias("e")).select("e.*")
    assert read._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_evidence_has_all_its_keys(spark):
    span = "array<struct<start int, finish int, fragment string>>"
    rows = [("R", [(1, 2, "a"), (None, 2, "b"), (3, None, "c"), (3, 4, None), (5, 6, "ñ")], None), (None, [], ["x"]), ("S", None, ["2", "1"])]
    got = rules.with_evidence(spark.createDataFrame(rows, f"rule string, spans {span}, watched array<string>"), F.lit("2026-01-05 10:00:00").cast("timestamp_ntz"), Versions(rules="r", text="t", lexicon="l"))
    found = [r for r in got.withColumn("e", rules.evidence_read(F.col("evidence"))).collect()]
    assert [r["evidence"] is None for r in found] == [False, True, False]
    whole = json.loads(found[0]["evidence"])
    assert list(whole) == ["rule", "rules_version", "text_version", "lexicon_version", "derivation", "watched", "organs", "spans", "confirmed", "unconfirmed", "lost", "changed", "classified_at"]
    assert (whole["rules_version"], whole["text_version"], whole["lexicon_version"], whole["derivation"], whole["watched"], whole["changed"], whole["classified_at"]) == ("r", "t", "l", None, [], 0, "2026-01-05T10:00:00")
    assert [tuple(s) for s in found[0]["e"]["spans"]] == [(1, 2, "a"), (5, 6, "ñ")] and found[2]["e"]["spans"] == [] and found[2]["e"]["watched"] == ["2", "1"]


def test_nested_coverage(spark):
    levels = spark.createDataFrame([("B", "state", 1), ("A", "region", 2), ("A", "local", 3), (None, "local", 4)], "r string, level string, n int")
    laws = spark.createDataFrame([("A", "L-2"), ("A", "L-1"), ("C", "L-3"), (None, "L-4")], "r string, law string")
    got = [(r["r"], [tuple(x) for x in r["levels"]], [tuple(x) for x in r["laws"]]) for r in coverage.nested(levels, laws, "r", "level", "law").collect()]
    assert got == [("A", [("local", 3), ("region", 2)], [("L-1",), ("L-2",)]), ("B", [("state", 1)], []), ("C", [], [("L-3",)])]
    assert coverage.nested(levels.limit(0), laws.limit(0), "r", "level", "law").count() == 0
