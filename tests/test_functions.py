import datetime
import hashlib
import hmac
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from docstrata.functions import dates, geometry, identifiers, text


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


def plain_normalise(s):
    s = "".join(c for c in unicodedata.normalize("NFD", s.lower()) if unicodedata.category(c) != "Mn" or c == "̃")
    return " ".join(re.sub("[^0-9a-zñ]+", " ", unicodedata.normalize("NFC", s)).split())


@pytest.mark.parametrize("s", ["Año ÁÉÍ çÇ", "n̂ño", "año", "ãõ São João", "Straße ÜBER", "  a--b  ", "", "Ĺőŕém ǖ", "téĺé"])
def test_normalise(spark, s):
    assert one(spark, s, text.normalise) == plain_normalise(s)


def test_normalise_null(spark):
    assert one(spark, None, text.normalise) is None


def test_terms_are_whole_words(spark):
    assert one(spark, "el gato los gatos", lambda c: text.terms_present(c, ["gato", "ga", "los"])) == ["gato", "los"]


def test_cut_with_flag(spark):
    assert tuple(one(spark, "abc def", lambda c: text.cut_with_flag(c, 4))) == ("abc […]", True)
    assert tuple(one(spark, "abc", lambda c: text.cut_with_flag(c, 4))) == ("abc", False)


def test_citation_functions(spark):
    assert one(spark, "Ley Orgánica 4/2020, de 3 de mayo, de algo", text.long_citation) == "Ley Organica 4/2020, de 3 de mayo"
    assert one(spark, "Orden 7/2021, de algo", text.citable) is True
    assert one(spark, "Sin número, 7/2021", text.citable) is False
    assert one(spark, " Modifica   LA  Año ", text.verb_key) == "MODIFICA LA ANO"


def test_json_and_marks(spark):
    assert one(spark, 'so: {"a": {"b": 1}} ok', text.outer_json) == '{"a": {"b": 1}}'
    assert one(spark, "none", text.outer_json) is None
    assert "<<<" not in one(spark, "a <<< b", text.delimited)[4:]


def test_sniffing(spark):
    for content, kind in ((b"%PDF-1.4", "pdf"), (b" <!DOCTYPE html>", "html"), (b"<html>", "html"), (b"<?xml?>", "xml"), (b"text", "other"), (b"", "other")):
        assert one(spark, content, text.sniffed_format, "binary") == kind


def test_decoding_replaces(spark):
    assert one(spark, b"a\xffb", text.decoded, "binary") == "a�b"
    assert one(spark, b"\xe1", lambda c: text.decoded(c, "ISO-8859-1"), "binary") == "á"


@pytest.mark.parametrize(
    ("s", "day"),
    [("20240109", (2024, 1, 9)), ("20241345", None), ("2024-02-30", None), ("2024-02-29", (2024, 2, 29)), ("9 de enero de 2024", (2024, 1, 9)), ("1 de Setiembre de 2023", (2023, 9, 1)), ("31 de abril de 2024", None), ("", None), (None, None), ("20240109\n", None)],
)
def test_dates(spark, s, day):
    assert one(spark, s, dates.any_date) == (datetime.date(*day) if day else None)


def test_day_range(spark):
    row = spark.sql("SELECT date'2024-02-27' a, date'2024-03-01' b").select(F.size(dates.day_range(F.col("a"), F.col("b"))).alias("n"), F.size(dates.day_range(F.col("b"), F.col("a"))).alias("m")).first()
    assert tuple(row) == (4, 0)


def test_identifiers(spark):
    assert one(spark, "LAW-A-2020-12", lambda c: identifiers.valid_identifier(c, "watched")) is True
    assert one(spark, "LAW-A-2020-12\n", lambda c: identifiers.valid_identifier(c, "watched")) is False
    assert one(spark, None, lambda c: identifiers.valid_identifier(c, "watched")) is False
    digest = hashlib.sha256(b"x").hexdigest()
    assert one(spark, digest, lambda c: identifiers.storage_path(c, ".xml")) == f"{digest[:2]}/{digest[2:4]}/{digest}.xml"
    assert one(spark, "../etc", lambda c: identifiers.storage_path(c, ".xml")) is None
    with pytest.raises(ValueError):
        identifiers.storage_path(F.col("x"), ".exe")


def test_keyed_hash(spark):
    want = hmac.new(b"k", b"a@b.org", hashlib.sha256).hexdigest()
    assert one(spark, " A@B.org ", lambda c: identifiers.keyed_hash(c, "k")) == want
    with pytest.raises(ValueError):
        identifiers.keyed_hash(F.col("x"), "")


def test_geometry(spark):
    square = [{"x": 0.0, "y": 0.0}, {"x": 2.0, "y": 0.0}, {"x": 2.0, "y": 2.0}, {"x": 0.0, "y": 2.0}]
    kind = "array<struct<x:double,y:double>>"
    assert one(spark, square, geometry.ring_area, kind) == 4.0
    line = [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.01}, {"x": 2.0, "y": 0.0}, {"x": 3.0, "y": 5.0}]
    assert [p["x"] for p in one(spark, line, lambda c: geometry.simplified(c, 0.1), kind)] == [0.0, 2.0, 3.0]
    deltas = [{"x": 1, "y": 1}, {"x": 2, "y": -1}]
    points = one(spark, deltas, lambda c: geometry.decoded_deltas(c, (0.5, 2.0), (10.0, 0.0)), "array<struct<x:bigint,y:bigint>>")
    assert [(p["x"], p["y"]) for p in points] == [(10.5, 2.0), (11.5, 0.0)]
    middle = spark.range(1).select(geometry.albers(F.lit(-3.0), F.lit(40.0)).alias("p")).first()["p"]
    assert abs(middle["x"]) < 1e-12 and abs(middle["y"]) < 1e-12


def test_stitched_rings(spark):
    point = "struct<x:double,y:double>"
    p = lambda *xs: [{"x": float(x), "y": 0.0} for x in xs]
    df = spark.createDataFrame([([p(0, 1, 2), p(4, 3, 2)], [0, -2])], f"arcs array<array<{point}>>, o array<int>")
    ring = df.select(geometry.stitched(F.col("arcs"), F.col("o")).alias("r")).first()["r"]
    assert [q["x"] for q in ring] == [0.0, 1.0, 2.0, 3.0, 4.0]


def test_tokens_differ(spark):
    tokens = [r["t"] for r in spark.range(3).select(identifiers.opaque_token().alias("t")).collect()]
    assert len(set(tokens)) == 3 and all(len(t) == 64 for t in tokens)
