"""Operators that SQL can't express against plain versions, written from their description alone."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docstrata.llm import exact_dedup, language, media, quality, secrets

LANGUAGES = ["de", "en", "und"]
EVIDENCE = "doc_id long, text_score array<double>, declared string, suffix string, host string, domain string"


def plain_fusion(rows):
    """(language, probability) by row: products of probabilities, a row's own vote left out."""
    votes = [max(range(3), key=lambda k: (r[1][k], -k)) for r in rows]
    total = [votes.count(k) for k in range(3)]
    prior = [(t + 1) / (sum(total) + 3) for t in total]
    prior[2] = min(prior[2], language.UNKNOWN_PRIOR)
    prior = [p / sum(prior) for p in prior]
    out = []
    for i, (_, text, declared, suffix, host, domain) in enumerate(rows):
        def others(test, i=i):
            return [sum(votes[j] == k for j, r in enumerate(rows) if j != i and test(r)) for k in range(3)]

        p = prior
        if domain is not None:
            n = others(lambda r: r[5] == domain)
            p = [(n[k] + 50 * prior[k]) / (sum(n) + 50) for k in range(3)]
            if host is not None:
                n = others(lambda r: r[5] == domain and r[4] == host)
                p = [(n[k] + 10 * p[k]) / (sum(n) + 10) for k in range(3)]
        score = [text[k] + math.log(max(p[k], 1e-9)) for k in range(3)]
        for at, value in ((2, declared), (3, suffix)):
            if value is not None:
                values = len({r[at] for r in rows if r[at] is not None})
                n = others(lambda r: r[at] == value)
                score = [score[k] + math.log((n[k] + 1) / (total[k] + values)) for k in range(3)]
        top = max(range(3), key=lambda k: (score[k], -k))
        out.append((LANGUAGES[top], 1 / sum(math.exp(s - score[top]) for s in score)))
    return out


def test_fusion(spark):
    rng = random.Random(4)
    pick = lambda *values: rng.choice([*values, None])
    rows = [(i, [rng.uniform(-6, 0) for _ in range(3)], pick("de", "en", "fr"), pick("de", "com"), pick("a.x", "b.x", "c.y"), pick("x", "y")) for i in range(60)]
    got = {r["doc_id"]: (r["language"], r["probability"]) for r in language.fuse(spark.createDataFrame(rows, EVIDENCE), LANGUAGES, []).collect()}
    for row, (name, p) in zip(rows, plain_fusion(rows), strict=True):
        assert got[row[0]][0] == name and abs(got[row[0]][1] - p) < 1e-9


def test_the_weight_of_a_trigram_is_measured():
    rng = np.random.default_rng(0)
    sure = rng.normal(0, 1, (400, 3))
    declared = np.array([rng.choice(3, p=np.exp(s) / np.exp(s).sum()) for s in sure])
    assert 1 / 16 <= language.best_weight(8 * sure, declared) <= 1 / 4
    apart = np.eye(3)[declared] * 50
    assert language.best_weight(apart, declared) == 1.0 and language.best_weight(np.zeros((0, 3)), np.zeros(0)) == 1.0


def test_languages_of_texts_that_declare_none(spark, small, duck):
    """A fifth of the documents without lang and source: only their text is evidence."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    apart = F.col("doc_id") % 5 == 0
    hidden = docs.withColumn("lang", F.when(~apart, F.col("lang"))).withColumn("source", F.when(~apart, F.col("source")))
    got = {r["doc_id"]: r["language"] for r in language.identify(language.from_documents(hidden)).collect()}
    truth = duck.sql("SELECT doc_id, lang FROM documents WHERE doc_id % 5 = 0 AND length(text) > 40").fetchall()
    assert len(truth) > 20 and np.mean([got[i] == lang for i, lang in truth]) > 0.9


def test_languages_of_pages(spark, small):
    from docstrata.llm.queries import queries

    pages = {r["page_id"]: r["url"].split("/")[3] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in queries()["op3_language_id"](spark, small).filter("page_id is not null").collect()}
    assert set(got) == set(pages) and np.mean([got[i]["language"] == lang and got[i]["kept"] for i, lang in pages.items()]) > 0.95


# -- quality ------------------------------------------------------------------------------


def test_log_count_ratios():
    rows, y = [np.array([1, 5]), np.array([1]), np.array([5, 7])], np.array([1, 0, 1])
    got, size = quality.log_count_ratios(rows, y), 1 << quality.FEATURE_BITS
    for f in (1, 5, 7, 9):
        has = [1 + sum(f in r for r, label in zip(rows, y) if label == k) for k in (0, 1)]
        mass = [size + sum(len(r) for r, label in zip(rows, y) if label == k) for k in (0, 1)]
        assert abs(got[f] - math.log((has[1] / mass[1]) / (has[0] / mass[0]))) < 1e-9


def test_dual_coordinate_descent_reaches_the_optimum():
    """Against projected gradient ascent on the whole dual."""
    rng = np.random.default_rng(2)
    rows = [np.sort(rng.choice(30, 6, replace=False)) for _ in range(25)]
    values = [rng.normal(0, 1, 6) for _ in rows]
    y, cost = rng.integers(0, 2, 25), rng.uniform(0.3, 1.5, 25)
    w = quality.dual_coordinate_descent(rows, values, y, cost, epochs=3000)
    x = np.zeros((25, 31))
    for i, (r, v) in enumerate(zip(rows, values)):
        x[i, r], x[i, 30] = v, 1
    x *= np.where(y > 0, 1, -1)[:, None]
    alpha = np.zeros(25)
    for _ in range(40_000):
        alpha = np.clip(alpha + 0.01 * (1 - x @ (x.T @ alpha)), 0, cost)
    plain = x.T @ alpha
    objective = lambda v: 0.5 * v @ v + (cost * np.maximum(0, 1 - x @ v)).sum()
    mine = np.append(w[:30], w[-1])
    assert objective(mine) <= objective(plain) * 1.002 + 1e-6 and np.abs(mine - plain).max() < 0.05


def test_long_texts_teach_whole_and_the_fit_is_bounded_by_rows(spark, monkeypatch):
    """A text has the same features in the fit and in scoring; the bound leaves out whole rows, in the order of their hashes."""
    text = " ".join(f"word{i}" for i in range(20_000))
    docs = [(i, text if i == 3 else f"short text number {i}") for i in range(40)]
    rows = {r["id"]: r["features"] for r in quality._vectors(spark.createDataFrame([(i, i % 2, t) for i, t in docs], "id long, label int, text string")).collect()}
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    assert rows[3] == quality.ngrams(data, np.array([0, len(data)]))[1].tolist() and len(rows[3]) > 30_000
    seen = []
    monkeypatch.setattr(quality, "Model", lambda vectors, y: seen.append([v.tolist() for v in vectors]))
    table, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id long, quality int")
    order = [r["doc_id"] for r in table.filter(~quality.held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id")).collect()]
    for most in (16_000_000, 100):
        monkeypatch.setattr(quality, "FIT_FEATURES", most)
        quality.fit(table, labels)
        wanted, total = [], 0
        for i in order:
            total += len(rows[i])
            wanted += [rows[i]] if total <= most else []
        assert seen[-1] == wanted and wanted
    assert len(seen[0]) == len(order) > len(seen[1])


# -- secrets ------------------------------------------------------------------------------


def plain_spans(text):
    """Windows of 20 with an entropy counted anew, at the thresholds of their units; unions of those that meet."""
    covered = []
    for m in secrets._CANDIDATE.finditer(text):
        found = m.group()
        if secrets.character_class(found) is None or secrets.ALLOWED[2].fullmatch(found):
            continue
        thresholds = secrets.window_thresholds(found, text, m.start())
        for i in range(len(found) - 19):
            window = found[i : i + 20]
            entropy = -sum(c / 20 * math.log2(c / 20) for c in Counter(window).values())
            if entropy >= thresholds[i] - 1e-12 and sum(c in "0123456789" for c in window) >= 2:
                covered.append((m.start() + i, m.start() + i + 20))
    out = []
    for a, b in covered:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def test_entropy_spans(spark, small):
    rng = random.Random(12)
    alphabets = ["0123456789abcdef", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ab01", "=/_-a1"]
    texts = [" ".join("".join(rng.choice(rng.choice(alphabets) if rng.random() < 0.1 else alphabets[k % 6]) for _ in range(rng.randrange(5, 90))) for _ in range(6)) for k in range(600)]
    texts += ["", "x" * 5000 + "q8Zx0p2LmN4vB7tY1cR5wE9uK3sD6fG", "sha256: " + "3fa94c7e1b0d8265" * 4]
    texts += [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect() if r["text"]]
    found = [secrets.random_spans(t) for t in texts]
    assert found == [plain_spans(t) for t in texts] and sum(map(len, found)) > 100


# -- media, snapshots ---------------------------------------------------------------------


def test_features_of_samples():
    for data in (bytes(64), bytes(range(256)), b"ab\x00\xff" * 16, bytes([127, 128] * 32)):
        x = [b - 128 for b in data]
        zero = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
        assert media.feature_of(data) == f"mean={sum(x) / len(x):.4f};rms={math.sqrt(sum(v * v for v in x) / len(x)):.4f};zero={zero}"


@pytest.fixture
def batches():
    return [
        [(1, "a  b"), (2, "c"), (3, None), (3, ""), (None, "d")],
        [(10, "a b"), (11, "e"), (12, "e"), (13, "")],
        [(20, "e"), (21, "d"), (22, "f"), (22, "f"), (None, "g"), (23, "a\tb")],
    ]


def test_batches_against_stored_snapshots(spark, tmp_path, batches):
    import re

    first = {}
    paths = []
    for k, rows in enumerate(batches):
        store = str(tmp_path / f"snapshot{k}")
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("own"))
        got = exact_dedup.dedup_batch(df, paths, store).collect()
        before = dict(first)
        groups = {}
        for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
            groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
        for text, ids in groups.items():
            first.setdefault(text, [ids[0], 0])
        assert len(got) == len(rows) and sum(r["kept"] for r in got) == sum(t not in before for t in groups)
        wanted = Counter((i, first[t][0], t in before) for t, ids in groups.items() for i in ids)
        assert Counter((r["doc_id"], r["keep_id"], r["known"]) for r in got) == wanted
        paths.append(store)
    filters = spark.read.parquet(f"{paths[0]}/filters")
    assert filters.count() == 1 and exact_dedup.dedup_batch(df.limit(0), paths).count() == 0


def test_many_shards_and_more_incoming_than_held(spark):
    held = spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    incoming = spark.range(2500, 40_000).select(F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    got = exact_dedup.screen(incoming, exact_dedup.build_filters(held, 7), 7)
    assert got.join(held, "digest", "left_semi").count() == 2500 and got.count() < 2500 + 37_500 * 0.02


# -- the language model -------------------------------------------------------------------

ROWS = "doc_id long, text string, declared string, suffix string, host string, domain string"


def as_rows(spark, texts):
    """(text, declared) as evidence without anything else."""
    return spark.createDataFrame([(i, t, d, None, None, None) for i, (t, d) in enumerate(texts)], ROWS)


def plain_grams(text):
    data = bytearray((text or "").encode())
    for i, b in enumerate(data):
        if 65 <= b <= 90:
            data[i] = b + 32
    for i in range(1, len(data)):
        if data[i - 1] == 0xC3 and 0x80 <= data[i] <= 0x9E:
            data[i] += 32
    return [(((data[i] | data[i + 1] << 8 | data[i + 2] << 16) * 2654435761) % 2**32) >> 16 for i in range(len(data) - 2)]


def test_table_and_scores_equal_a_plain_version(spark, small, duck, monkeypatch):
    """The table is that of the texts drawn, each once, and a text's score is the sum over its trigrams."""
    monkeypatch.setattr(language, "WEIGHTS", [0.25])
    docs = duck.sql("SELECT text, lang FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL").fetchall()
    rows = as_rows(spark, docs)
    languages, table = language.fit(rows, 10**9)
    found = language.classes(rows.groupBy("declared").agg(F.countDistinct("text").alias("n"), F.lit(0).alias("least")))
    drawn = {(r["declared"], r["text"]): r["apart"] for r in language.drawn_texts(rows, found, 10**9).collect()}
    assert set(drawn) == {(d, t) for t, d in docs if len(t.encode()) > 2}  # all, as there is room
    counts = {d: Counter() for d in languages[:-1]}
    least = {}
    place = {r["text"]: r["p"] for r in rows.select("text", language._place().alias("p")).collect()}
    for d, t in drawn:
        least[d] = min(place[t], least.get(d, 1 << 30))
    for d, t in drawn:
        if not (place[t] % 5 == 0 and place[t] > least[d]):
            counts[d].update(plain_grams(t))
    wanted = []
    for d in languages[:-1]:
        more = 0.5 * sum(counts[d].values()) / 65536 / 100 + 1e-3
        whole = sum(counts[d].values()) + 65536 * more
        wanted.append({g: 0.25 * math.log((counts[d][g] + more) / whole) for g in range(65536)})
    scored = {r["doc_id"]: r["text_score"] for r in language.score_texts(rows.select("doc_id", "text"), table).collect()}
    for i in random.Random(1).sample(range(len(docs)), 40):
        grams = plain_grams(docs[i][0])
        plain = [sum(w[g] for g in grams) for w in wanted] + [-0.25 * math.log(65536) * len(grams)]
        assert np.allclose(scored[i], plain, rtol=1e-4, atol=1e-2)


def test_copies_of_one_text_are_drawn_once(spark):
    texts = [("the same notice on every page of the site", "en")] * 30_000 + [(f"some words number {i} of their own", "en") for i in range(300)] + [("der gleiche Hinweis steht hier", "de")] * 5
    rows = as_rows(spark, texts)
    found = language.classes(rows.groupBy("declared").agg(F.countDistinct("text").alias("n"), F.min(language._place()).alias("least")))
    drawn = language.drawn_texts(rows, found, 10_000).collect()
    assert Counter((r["declared"], r["text"]) for r in drawn) == Counter({(d, t) for t, d in texts})


def test_thousands_of_declared_languages(spark):
    """Typing errors in the column get no models of their own, and rare languages stay known."""
    english = ["the and of with that which from have been were", "there would about their could other after first"]
    texts = [(f"{english[i % 2]} {english[(i + 1) % 2][: i % 40]} {i}", "en") for i in range(400)]
    texts += [(f"{english[0]} {i}", f"en{i:04d}") for i in range(5000)]
    texts += [(f"ñande mba'e porã oĩ ko árape ha'e {i}", "gn") for i in range(3)]
    rows = as_rows(spark, texts)
    languages, table = language.fit(rows)
    assert len(languages) == language.MOST_MODELS + 2 == len(table) and languages[-2:] == [language.SHARED, "und"] and "en" in languages
    got = {r["doc_id"]: r for r in language.identify(rows).collect()}
    assert len(got) == len(texts) and language.SHARED not in {r["language"] for r in got.values()}
    assert sum(got[i]["kept"] for i in range(400)) > 0.95 * 400  # the wrong declarations stand on the same English
    assert all(got[5400 + i]["language"] == "gn" and got[5400 + i]["kept"] for i in range(3))
    assert sum(r["kept"] for r in got.values()) > 0.97 * len(got)
