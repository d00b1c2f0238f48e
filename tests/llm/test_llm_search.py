"""Hard negatives, spelling variants and URL rules against plain versions, and on edge tables."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from docstrata.llm import negatives, spelling, urls

# -- hard negatives -----------------------------------------------------------------------


def plain_negatives(rows):
    """Rows (vec_id, vector or None, label): every pair is scored."""
    ready = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        moved = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        ready.append((i, [int(max(-(1 << 26), min(1 << 26, np.floor(256 * float(x))))) for x in v], moved))
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for n, (a, vec, label) in enumerate(ready):
        if a is None or a % 50:
            continue
        scored = [(sum(x * y for x, y in zip(vec, v, strict=False)), i, k) for m, (i, v, k) in enumerate(ready) if m != n]
        positives = sorted((x for x in scored if x[2] == label), key=order)[:5]
        for p, positive, _ in positives:
            fitting = sorted((x for x in scored if x[2] != label and 50 * p <= 100 * x[0] <= 95 * p), key=order)[:3]
            out += [(a, positive, r, x[1], p, x[0]) for r, x in enumerate(fitting, 1)]
    return Counter(out)


VECTORS = "vec_id long, embedding array<float>, label int"


def found_negatives(spark, rows):
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "'own' AS row_id", "'own' AS key", "'own' AS id", "'own' AS score")
    got = negatives.hard_negatives(df.repartition(3))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return Counter(tuple(r) for r in got.collect())


def clustered(n, seed, dims=6, centres=12):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims))
    x = middle[rng.integers(0, centres, n)] + 0.3 * rng.normal(size=(n, dims))
    return [(i, [float(y) for y in np.float32(v)], int(k)) for i, (v, k) in enumerate(zip(x, rng.integers(0, 10, n), strict=True))]


@pytest.mark.parametrize("seed", [1, 2])
def test_negatives_equal_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 32)
    monkeypatch.setattr(negatives, "STRETCH", 300)
    rows = clustered(700, seed)
    wanted = plain_negatives(rows)
    assert found_negatives(spark, rows) == wanted and sum(wanted.values()) > 50


def test_negatives_on_nulls_ties_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 16)
    base = clustered(150, 3, dims=3)
    nan, inf = float("nan"), float("inf")
    odd = [(None, [1.0, 2.0, 3.0], 1), (None, [1.0, 2.0, 3.0], 2), (200, None, 1), (201, [1.0, None, 2.0], 1), (202, [nan, 0.0, 0.0], 1), (203, [inf, 0.0, 0.0], 1), (250, [0.5, 0.5, 0.5], None)]
    odd += [(300, [0.0, 0.0, 0.0], 3), (350, [], 3), (400, [3e5, -3e5, 1.0], 4), (401, [3e5, -2e5, 1.0], 4), (402, [2e5, -2e5, 1.0], 5), (450, [1.0], 6), (50, [1.0, 2.0, 3.0], 1)]
    rows = base + odd + base[:60] + [(500 + i, [1.0, 2.0, 3.0], i % 2) for i in range(60)]
    wanted = plain_negatives(rows)
    assert found_negatives(spark, rows) == wanted and any(k[1] is None or k[3] is None for k in wanted)


def test_negatives_of_empty_tables(spark):
    assert not found_negatives(spark, []) and not found_negatives(spark, [(50, None, 1)]) and not found_negatives(spark, [(50, [1.0], 1)])


def test_a_search_scans_part_of_the_index(spark, monkeypatch):
    """Far clusters are never scanned: the intervals leave their blocks out."""
    monkeypatch.setattr(negatives, "BLOCK", 16)
    monkeypatch.setattr(negatives, "STRETCH", 16)
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.cos(a)), float(np.sin(a))], 1 + i % 2) for i, a in enumerate(np.repeat(np.linspace(0, 2 * np.pi, 40, endpoint=False), 30) + 0.01 * rng.normal(size=1200))]
    index = negatives.indexed(negatives.checkpointed(negatives.prepared(spark.createDataFrame(rows, VECTORS))))
    near = index.ranked.selectExpr("floor(rank / 16) AS group", "row_id", "label", "vec", "array(named_struct('x', 1)) AS asks", "20.0D AS radius").groupBy("group").agg(negatives.F.collect_list(negatives.F.struct("row_id", "label", "vec", "radius", "asks")).alias("anchors"))
    spans = negatives._intervals(near, index.pivots, index.width)
    pairs = negatives._new_blocks(index, spans, None)
    groups, blocks = near.count(), index.spans.count()
    assert pairs.count() == pairs.distinct().count() < 0.3 * groups * blocks
    assert negatives._new_blocks(index, spans, spans).count() == 0


# -- spelling variants --------------------------------------------------------------------


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_words(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def plain_variants(docs):
    n = plain_words(docs)
    near = {w: set() for w in n}
    by_deletion = {}
    for w in n:  # words that differ by one edit share a deletion, or one is a deletion of the other
        for d in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by_deletion.setdefault(d, []).append(w)
    for group in by_deletion.values():
        for a in group:
            near[a].update(b for b in group if one_edit(a, b))
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out)


def found_variants(df, crowded=spelling.CROWDED):
    got = spelling.spelling_variants(df, crowded)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("crowded", [spelling.CROWDED, 0, 3])
def test_spelling_equals_a_plain_version(spark, small, duck, crowded):
    docs = duck.sql("SELECT doc_id, text FROM documents").fetchall()
    wanted = plain_variants(docs)
    assert found_variants(spark.read.parquet(f"{small}/documents.parquet"), crowded) == wanted
    assert sum(w[1] is not None for w in wanted) > 5


@pytest.mark.parametrize("crowded", [spelling.CROWDED, 0])
def test_every_near_pair_is_found_once(spark, crowded):
    rng = random.Random(4)
    words = {"".join(rng.choice("abÿ") for _ in range(rng.randint(7, 9))) for _ in range(500)} | {"x" * k for k in range(7, 16)}
    pairs = spelling.near_pairs(spark.createDataFrame([(w,) for w in words], "word string"), crowded).collect()
    found = [tuple(sorted(p)) for p in pairs]
    ordered = sorted(words)
    assert sorted(found) == [(a, b) for i, a in enumerate(ordered) for b in ordered[i + 1 :] if one_edit(a, b)]


def test_forms_are_followed_to_the_last(spark):
    links = [(f"w{i}", f"w{i + 1}") for i in range(11)] + [("v", "w5")]
    got = {r[0]: r[1] for r in spelling.rooted(spark.createDataFrame(links, "word string, form string")).collect()}
    assert got == {**{f"w{i}": "w11" for i in range(11)}, "v": "w11"}
    assert not spelling.rooted(spark.createDataFrame([], "word string, form string")).collect()


def test_spelling_on_edge_tables(spark, edge, edge_rows, none):
    assert found_variants(edge) == plain_variants([r[:2] for r in edge_rows])
    assert found_variants(none) == []


# -- URL rules ----------------------------------------------------------------------------


def plain_verdict(url, rules):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    raw = re.match("[^/?#]*", rest)[0]
    host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in raw), re.match("[^?#]*", rest[len(raw) :])[0]
    best = None
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        p = rule[len(h) :]
        if h and (host == h or host.endswith("." + h)) and path.startswith(p):
            key = (len(rule), len(h), rule, verdict == "block")
            best = max(best, key) if best else key
    return (host, path, best[2] if best else None, ("block" if best[3] else "allow") if best else "allow")


RULES = [*urls.RULES, ("block", "org"), ("block", "a.org/x"), ("allow", "org/x/yy"), ("block", "net/es/"), ("allow", "net/es/"), ("block", "ünï.de/é"), ("block", "/only/path"), ("allow", "b.a.org/")]
URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "https://example.com/en", "https://example.com/en/", "https://xexample.com/en/1", "ftp://net/es/", "x://a.net/fr/../", "http://a.net/frx", "http://org", "http://b.a.org/x", "http://c.org/x/yy/z", "http://a.org/x/yy/z", "http://a.org?x/y", "http://user@a.com:80/", "http://com", "http://com/", "://.com/", "http://com./", "a\nb://ünï.de/é\n/x", "http://ÜNÏ.de/é", "http://a.b.c.d.e.f.net/es/://q", "http://" + "a." * 3000 + "com/en/" + "p" * 30000, "http://example.com/" + "/" * 50]


@pytest.mark.parametrize("most", [urls.MOST_MAPPED, 0])
def test_urls_equal_a_plain_version(spark, most):
    rows = [(i if i % 5 else None, u) for i, u in enumerate(URLS + URLS[:9])]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'own' AS host", "'own' AS row_id", "'own' AS rule", "'own' AS digest")
    for rules in (RULES, []):
        got = urls.url_verdicts(df.repartition(3), urls.rule_table(spark, rules), most)
        assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((i, *plain_verdict(u, rules))) for i, u in rows)
        assert urls.url_verdicts(df.limit(0), urls.rule_table(spark, rules), most).count() == 0


def test_many_rules_both_ways(spark):
    rng = random.Random(3)
    part = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 3)))
    rules = [(rng.choice(("allow", "block")), f"{'.'.join(part() for _ in range(rng.randint(1, 3)))}/{part()}") for _ in range(3000)]
    pages = [(i, f"http://{'.'.join(part() for _ in range(rng.randint(1, 4)))}/{part()}{part()}") for i in range(400)]
    table, df = urls.rule_table(spark, rules), spark.createDataFrame(pages, "page_id long, url string")
    wanted = {i: plain_verdict(u, rules) for i, u in pages}
    for most in (urls.MOST_MAPPED, 10):
        assert {r[0]: tuple(r)[1:] for r in urls.url_verdicts(df, table, most).collect()} == wanted


def test_collisions_are_told_apart_by_the_strings(tmp_path):
    """Three strings stored under one digest, and a probe of that digest that is none of them."""
    stored = urls.SortedDigests.arrays(np.array([7, 5, 5, 5, -9]), ["seven", "a", "b", "c", "minus"], [[1], [2], [3, 4], [], [5]])
    path = tmp_path / "index"
    path.write_bytes(urls.packed([stored, stored]))
    first, second = urls.mapped(str(path))
    assert isinstance(first.keys.base, np.memmap) or isinstance(first.keys, np.memmap)
    at = second.find([b"b", b"d", b"a", b"minus", b"zero", b"c"], np.array([5, 5, 5, -9, 0, 5]))
    assert [second.string(i) if i >= 0 else None for i in at] == [b"b", None, b"a", b"minus", None, b"c"]
    assert second.numbers(at[0]).tolist() == [3, 4] and second.numbers(at[5]).tolist() == []
