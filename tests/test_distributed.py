"""Segmented scans, grouped selection, layouts and bisection against plain versions."""

import random
from datetime import date, datetime, timedelta

import pytest

from docstrata.operators import measure
from docstrata.sources import bodies, layouts, summaries
from docstrata.streaming import limiter

EVENTS = "event_id long, user_id long, ts timestamp"
START = datetime(2026, 1, 1)


def history(seed=3, n=1500):
    """One user has a third of all rows; some users and times are null, and times repeat."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        user = 1 if rng.random() < 0.34 else rng.choice([None, 2, 3, 4, 5, 6])
        at = None if rng.random() < 0.02 else START + timedelta(seconds=rng.choice((rng.randint(0, 40_000), 60 * rng.randint(0, 600))), milliseconds=rng.choice((0, 500)))
        rows.append((i, user, at))
    return rows


def plain_scan(rows, rule, step):
    by_user = {}
    for i, user, at in rows:
        if at is not None:
            by_user.setdefault(user, []).append((at, i))
    out = set()
    for user, events in by_user.items():
        state = rule()
        for at, i in sorted(events):
            out.add((i, user, *step(state, (at - datetime(1970, 1, 1)).total_seconds())))
    return out


@pytest.mark.parametrize("span", [600, 3600, 10**9])
def test_segments_change_no_result(spark, span, monkeypatch):
    monkeypatch.setattr(limiter.segmented, "__defaults__", (span,))
    rows = history()
    df = spark.createDataFrame(rows, EVENTS).repartition(3)
    timed = lambda got: {tuple(r) for r in got.collect()}
    unknown = {(i, u, True, 0) for i, u, at in rows if at is None}
    assert timed(limiter.limited(df, 3, 90.0)) == plain_scan(rows, lambda: limiter.SlidingWindow(3, 90.0), lambda r, at: r.hit(at)) | unknown
    assert timed(limiter.bucketed(df, 2.0, 1 / 100)) == plain_scan(rows, lambda: limiter.TokenBucket(2.0, 1 / 100), lambda r, at: (r.take(at), int(r.tokens * 1000) / 1000))
    assert timed(limiter.with_sessions(df, 200.0, 2)) == plain_scan(rows, lambda: limiter.Sessions(200.0, 2), lambda r, at: r.begin(at))


def test_a_hot_user_is_many_segments(spark):
    cut = limiter.segmented(spark.createDataFrame(history(), EVENTS).filter("ts is not null"), lambda pause: pause >= 90)
    counts = [r["count"] for r in cut.filter("user_id = 1").groupBy("segment").count().collect()]
    assert len(counts) > 50 and max(counts) < sum(counts) / 5
    assert limiter.limited(spark.createDataFrame([], EVENTS)).count() == 0


# -- selection ----------------------------------------------------------------------------


def values(seed=5, n=3000):
    rng = random.Random(seed)
    group = lambda: rng.choice(["a"] * 18 + ["b", None])
    return [(group(), rng.choice((None, float("-inf"), round(rng.gauss(0, 50), 2), 7.0, float(rng.randint(-3, 3))))) for _ in range(n)] + [("c", None), ("d", 1.5), ("d", None)]


@pytest.mark.parametrize("most", [measure.MOST_ORDERED, 20, 1])
def test_selection_equals_sorting(spark, most, monkeypatch):
    monkeypatch.setitem(measure.at_place.__kwdefaults__, "most", most)
    rows = values()
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    sorted_by = {}
    for g, v in rows:
        if v is not None:
            sorted_by.setdefault(g, []).append(v)
    sorted_by = {g: sorted(v) for g, v in sorted_by.items()}
    for q in (0.0, 0.37, 0.95, 1.0):
        got = {r["g"]: r["at_rank"] for r in measure.nearest_rank(df, "v", q, "g").collect()}
        assert got == {g: v[min(int(q * len(v)), len(v) - 1)] for g, v in sorted_by.items()}
    got = {r["g"]: r["median"] for r in measure.grouped_median(df, "v", "g").collect()}
    assert got == {g: (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2 for g, v in sorted_by.items()}


# -- layouts ------------------------------------------------------------------------------

AKN = layouts.AKN
BODIES = {
    f"<a xmlns='{AKN}'><act><body><content period='&lt;p&gt;A&amp;amp;nbsp;b&lt;/p&gt;'/></body></act></a>": ("attribute", "A b", None),
    "<d><analisis><texto>no</texto></analisis><texto> a <b>b</b><!-- c --> d</texto><texto>e</texto></d>": ("text", "a b d", None),
    "<d><texto/><registro><texto>x</texto></registro></d>": ("text", "", None),
    f"<a xmlns='{AKN}'><act><meta>m</meta><body><p>x</p></body></act></a>": ("act", "x", None),
    "<a><act><body>x</body></act></a>": ("everything", "x", None),
    "<d><registro><titulo>t</titulo><texto><p>x</p>y</texto></registro></d>": ("register", "x y", None),
    "<d><contenido><titulo>t</titulo><texto><p>x</p></texto></contenido></d>": ("content", "x", None),
    "<DOCUMENTO><BOPVOrden>1</BOPVOrden><BOPVTitulo>t</BOPVTitulo><New>n</New><BOPVDetalle>x</BOPVDetalle></DOCUMENTO>": ("siblings", "n x", None),
    "<DOCUMENTO><BOPVDetalle>x</BOPVDetalle></DOCUMENTO>": ("everything", "x", None),
    "<x>" * 100 + "deep" + "</x>" * 100: ("everything", "deep", None),
    "<x>" * 101 + "deep" + "</x>" * 101: (None, None, "depth"),
    "<!DOCTYPE d [<!ENTITY e 'x'>]><d>&e;</d>": (None, None, "declaration"),
    "<d><p>open</d>": (None, None, "malformed"),
    "": (None, None, "malformed"),
    " \n<?xml version='1.0' encoding='ISO-8859-1'?><d>ok</d>": ("everything", "ok", None),
}


def test_layouts(spark):
    rows = [(i, c) for i, c in enumerate([*BODIES, None])]
    got = {r["key"]: tuple(r)[1:] for r in layouts.layout_texts(spark.createDataFrame(rows, "key int, content string")).collect()}
    assert got == {**dict(enumerate(BODIES.values())), len(BODIES): (None, None, None)}


def test_too_many_elements(monkeypatch):
    monkeypatch.setattr(layouts, "MOST_ELEMENTS", 3)
    assert layouts.walked(b"<a><b/><c/></a>") == ("everything", "")
    with pytest.raises(layouts.Refused, match="elements"):
        layouts.walked(b"<a><b/><c/><d/></a>")
    monkeypatch.setattr(layouts, "MOST_BYTES", 5)
    with pytest.raises(layouts.Refused, match="size"):
        layouts.walked(b"<a></a>")


def test_dispatch_reads_every_container_and_layout(spark):
    words = "words that are shown " * 20
    rows = [(1, f"<html><div id='content'>{words}</div></html>"), (2, "<html><p>error</p></html>"), (3, "<d><analisis>no</analisis><texto>yes</texto></d>"), (4, "<x>" * 150 + "y" + "</x>" * 150), (5, "plain"), (6, None), (7, f"<html><main>{words}</main><article>short</article></html>")]
    got = {r["key"]: (r["derivation"], r["text"]) for r in bodies.dispatched(spark.createDataFrame(rows, "key int, content string").selectExpr("key", "cast(content as binary) content")).collect()}
    assert got == {1: ("text", words.strip()), 2: ("unreadable", None), 3: ("text", "yes"), 4: ("unreadable", None), 5: ("text", "plain"), 6: ("none", None), 7: ("unreadable", None)}


def test_deep_bodies_are_not_parsed(spark):
    body = lambda n: "<documento><texto>" + "<b>" * n + "</b>" * n + "<p>x</p></texto></documento>"
    got = {r["key"]: r["text"] for r in bodies.xml_bodies(spark.createDataFrame([(1, body(98)), (2, body(99)), (3, body(150))], "key int, content string")).collect()}
    assert (got[1], got[2] or "", got[3] or "") == ("x", "", "")


# -- issues by number ---------------------------------------------------------------------


def test_bisection_equals_the_join(spark):
    rng = random.Random(2)
    issues, number = [], {}
    for i in range(1500):
        day = date(2023, 1, 1) + timedelta(days=i)
        for _ in range(rng.choice((0, 0, 1, 1, 2, 4))):
            number[day.year] = number.get(day.year, 0) + 1
            issues.append((number[day.year], day))
    table = spark.createDataFrame(issues, "number int, day date")
    days = spark.createDataFrame([(date(2022, 6, 1) + timedelta(days=3 * i),) for i in range(700)] + [(None,), (date(2023, 1, 1),), (date(2023, 1, 1),)], "day date")
    asked = days.filter("day is not null").distinct()
    wanted = sorted(map(tuple, summaries.issues_of_day(table, asked).collect()), key=repr)
    assert sorted(map(tuple, summaries.issues_by_number(table, days).collect()), key=repr) == wanted and any(w[1] for w in wanted)


def test_identifiers_bear_the_date(spark):
    rows = spark.createDataFrame([("BOCM-20260904-1", date(2026, 9, 4)), ("BOCM-20260903-2", date(2026, 9, 4)), ("bad", date(2026, 9, 4)), (None, date(2026, 9, 4))], "identifier string, day date")
    assert [r["identifier"] for r in summaries.of_issue(rows, "identifier", "day").collect()] == ["BOCM-20260904-1"]
    many = spark.createDataFrame([(f"BOCM-20260904-{i}", date(2026, 9, 4)) for i in range(401)], "identifier string, day date")
    with pytest.raises(Exception, match="too many items"):
        summaries.of_issue(many, "identifier", "day").collect()


def test_cut_answers_are_seen(spark):
    import json

    answer = json.dumps([{"control": f"{i:07d}", "title": "t", "url": "u"} for i in range(250)])
    got = summaries.json_rows(spark.createDataFrame([(date(2026, 1, 1), answer), (date(2026, 1, 2), "[]")], "day date, content string"))
    assert got.count() == 200 and {r["left_out"] for r in got.collect()} == {50}
