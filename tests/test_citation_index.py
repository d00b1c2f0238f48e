"""The phrase index against one plain alternation, at any number of phrases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docstrata.operators import citation_index, references

TITLES = "item_id long, title string"


def plain_citations(text, titles):
    """One alternation of all long citations, longest first, behind the guard; the first id as text counts."""
    keys = {}
    for item, title in titles:
        found = re.match(r"(?i)((?:ley organica|ley foral|ley|real decreto|decreto)\s+[\d/]+,\s+de\s+\d+\s+de\s+[a-z]+)", (title or "").translate(citation_index._FOLD))
        if found:
            key = re.sub(r"\s+", " ", found[1].lower()).strip()
            keys[key] = min(keys.get(key, str(item)), str(item))
    if not keys:
        return []
    parts = [r"\s+".join(map(re.escape, k.split(" "))) for k in sorted(keys, key=lambda k: (-len(k), k))]
    low = text.translate(citation_index._FOLD).replace("İ", "i").lower()  # its small letter is two
    return [(m.start(), text[m.start() : m.end()], int(keys[re.sub(r"\s+", " ", m[0])])) for m in re.finditer(f"(?<!decreto )(?:{'|'.join(parts)})", low)]


def found_citations(spark, texts, titles):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = references.watched_citations(docs, spark.createDataFrame(titles, TITLES)).select("doc_id", "start", "citation", "item_id").collect()
    return sorted(tuple(r) for r in got)


def check(spark, texts, titles):
    wanted = sorted((i, *c) for i, t in enumerate(texts) for c in plain_citations(t or "", titles))
    assert found_citations(spark, texts, titles) == wanted
    return wanted


TEXTS = [
    "Se modifica la Ley 2/2021, de 7 de junio, de igualdad. (LEY 2/2021,\n de\t7  de Junio) y «ley 2/2021, de 7 de junio».",
    "del Decreto ley 4/2023, de 19 de diciembre; decreto  ley 4/2023, de 19 de diciembre; decreto-ley 4/2023, de 19 de diciembre",
    "la Ley 2/2021, de 29 de diciembre, de medidas; Ley 2/2021 de 7 de junio; ley 2 /2021, de 7 de junio",
    "xLey Orgánica 3/2007, de 22 de marzoy; Léy orgánica 3/2007, de 22 de março; real decreto 1/1999, de 1 de enero",
    "Ley 1/2, de 3 de enero2 y ley 1/2, de 3 de ener",
    "", None, "ley", "😀 ley 2/2021, de 7 de junio 😀 ley 2/2021, de 7 de juniode",
    "İley 2/2021, de 7 de junio Ñ ñ",
]
WATCHED = [(1, "Ley 2/2021, de 7 de junio, de igualdad"), (2, "LEY 4/2023, de 19 de diciembre"), (3, "Ley Orgánica 3/2007, de 22 de marzo, para"), (4, "Real Decreto 1/1999, de 1 de enero"), (5, "Decreto 1/1999, de 1 de enero"), (6, "Ley 1/2, de 3 de ener"), (7, "Ley 1/2, de 3 de enero"), (8, "Ley 2/2016 de Identidad"), (9, None), (10, "Ley 2/2021, de 7 de  junio (otra vez)")]


@pytest.mark.parametrize("most", [citation_index.MOST_PHRASES, 0])
def test_citations_equal_one_alternation(spark, most, monkeypatch):
    monkeypatch.setattr(citation_index, "MOST_PHRASES", most)
    wanted = check(spark, TEXTS, WATCHED)
    assert len(wanted) > 10 and {w[3] for w in wanted} >= {1, 2, 3, 4, 7}


ODD = [
    "ley 1/2, de 3 de eneroley 1/2, de 3 de eneroreal decreto 1/1999, de 1 de eneroleyley 1/2, de 3 de eneroleyes",
    "decreto real decreto 1/1999, de 1 de enero; decreto decreto 1/1999, de 1 de enero; decreto\u00a0ley 1/2, de 3 de enero; decreto\n\x1cley 1/2, de 3 de enero",
    "REAL \u2003 DECRETO\x1c1/1999,\x85de\u3000 1 DE Éñero, real\nReal Decreto 1/1999, de 1 de enero 😀 Lèy 1/2, de 3 de enero, léy\v1/2, de 3\u200ade enero",
    "rEal decreto 1/1999, de 1 de enero, 😀ley or\u0301ganica 1/2, de 3 de enero, ley forál 7/7, de 7 de mar\u212aO ley 7/7, de 7 de mar",
]
ODD_WATCHED = [(1, "Ley 1/2, de 3 de enero"), (2, "Ley 1/2, de 3 de eneroley"), (12, "Ley 1/2, de 3 de enero"), (3, "Decreto 1/1999, de 1 de enero"), (5, "Ley foral 7/7, de 7 de marko"), (6, "Ley foral 7/7, de 7 de m")]


@pytest.mark.parametrize("real", [[], [(4, "Real Decreto 1/1999, de 1 de enero")]])
@pytest.mark.parametrize("most", [citation_index.MOST_PHRASES, 0])
def test_citations_in_odd_places(spark, most, real, monkeypatch):
    """Where one begins within another, blanks and letters beyond ASCII, a decree within a royal one."""
    monkeypatch.setattr(citation_index, "MOST_PHRASES", most)
    assert len(check(spark, ODD, ODD_WATCHED + real)) >= 10


@pytest.mark.parametrize("most", [citation_index.MOST_PHRASES, 0])
def test_citations_are_found_without_python(spark, most, monkeypatch):
    """Every title went through Python four times, and each line that met one compiled a pattern for it."""
    monkeypatch.setattr(citation_index, "MOST_PHRASES", most)
    docs = spark.createDataFrame([(1, TEXTS[0])], "doc_id long, text string")
    plan = references.watched_citations(docs, spark.createDataFrame(WATCHED, TITLES))._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and plan.count("regexp_extract_all") == 1


def test_thousands_of_titles(spark, monkeypatch):
    rng = random.Random(6)
    months = "enero febrero marzo abril mayo junio julio".split()
    titles = [(i, f"{rng.choice(('Ley', 'Decreto', 'Ley Foral'))} {rng.randint(1, 400)}/{rng.randint(1990, 2020)}, de {rng.randint(1, 28)} de {rng.choice(months)}, de algo") for i in range(5000)]
    texts = []
    for _ in range(60):
        words = []
        for _ in range(40):
            cited = rng.choice(titles)[1].rsplit(",", 1)[0]
            words.append(rng.choice((cited.upper(), cited.replace(" ", "\n "), cited[:-1], f"({cited})", "de", "ley", "2/2000,", "mayo")))
        texts.append(rng.choice((" ", ", ")).join(words))
    wanted = check(spark, texts, titles)
    assert len(wanted) > 500
    monkeypatch.setattr(citation_index, "MOST_PHRASES", 100)
    assert found_citations(spark, texts, titles) == wanted


@pytest.mark.parametrize("most", [citation_index.MOST_PHRASES, 2])
def test_rows_are_judged_by_themselves(spark, most, monkeypatch):
    """Null and repeated ids: each row has its own citations."""
    monkeypatch.setattr(citation_index, "MOST_PHRASES", most)
    passage = "a watched passage of several words in a row"
    docs = spark.createDataFrame([(None, f"x {passage}"), (1, f"{passage}!"), (1, "nothing"), (1, "nothing"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, passage), (7, passage), (8, "words in a"), (9, "several words in another row"), (None, "watched")], "item_id long, text string")
    got = sorted(((r["doc_id"], r["touched"]) for r in references.with_touched(docs, items).collect()), key=repr)
    assert got == sorted([(None, ["7", "8"]), (1, ["7", "8"]), (1, []), (1, []), (2, [])], key=repr)


def test_a_batch_of_slices(spark, monkeypatch):
    monkeypatch.setattr(citation_index, "SLICE_BYTES", 64)
    phrases = citation_index.Phrases([citation_index.Phrase("p", "one two three", False)])
    texts = ["one two three " * k for k in range(12)] + ["", "two", "one two", "three one", "two three"]
    rows = [row for row, *_ in citation_index.hits(texts, phrases.sizes, phrases.candidates)]
    assert [rows.count(i) for i in range(len(texts))] == [*range(12), 0, 0, 0, 0, 0]


def test_verbs_stop_at_marks(spark):
    from pyspark.sql import functions as F

    verb = lambda before: spark.createDataFrame([(before,)], "b string").select(references.governing_verb(F.col("b")).alias("v")).first()["v"]
    assert verb("It amends as follows: the ") == "CITES" and verb('It amends "the ') == "CITES" and verb("It amends «the» ") == "CITES"
    assert verb("It amends the second part of the ") == "AMENDS"


def test_texts_are_searched_once_and_in_slices(spark, monkeypatch):
    """A filter on what is found named the search a second time; a batch's texts were all held as strings at once."""
    docs = spark.createDataFrame([(1, "a one two three b"), (2, None)], "doc_id int, text string")
    entries = spark.createDataFrame([(7, "one two three")], "item_id int, text string")
    touched = references.with_touched(docs, entries).filter(F.size("touched") > 0).select("doc_id", F.explode("touched").alias("item_id"))
    plan = touched._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1
    assert [(r["doc_id"], r["item_id"]) for r in touched.collect()] == [(1, "7")]
    monkeypatch.setattr(citation_index, "SLICE_BYTES", 64)
    column = citation_index.pa.array(["x" * 40, None, "y" * 40, "", "z" * 200, "é"])
    parts = list(citation_index._parts(column, False))
    assert sum(parts, []) == ["x" * 40, "", "y" * 40, "", "z" * 200, "é"] and len(parts) > 2 and list(citation_index._parts(column[:0], False)) == []


def test_screen_grows_with_its_phrases(spark, monkeypatch):
    """With 1 MB for any number of them most runs of a text met some phrase by chance."""
    keyed = spark.range(1000).select(F.xxhash64("id").alias("hash"), F.lit(2).alias("size"))
    hashes = [r["hash"] for r in keyed.collect()]
    for n, size in ((1000, 1 << 20), (1_000_000, 1 << 23), (10**9, 1 << 24)):
        bits = citation_index._screen(keyed, n)
        low = [h & (len(bits) * 8 - 1) for h in hashes]
        assert len(bits) == size and all(bits[x >> 3] >> (x & 7) & 1 for x in low)
        assert sum(int(b).bit_count() for b in bits[bits > 0]) == len(set(low))
