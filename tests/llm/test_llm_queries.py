"""The registered queries against SQL or brute force over a small standard table."""

import hashlib
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from comparing import duck_rows, spark_rows

from docstrata.llm import queries

QUERIES, SQL = queries.queries(), queries.oracle_sql()


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(name, spark, duck, small):
    names, found = spark_rows(QUERIES[name](spark, small))
    wanted_names, wanted = duck_rows(duck, SQL[name])
    assert names == wanted_names and len(found) == len(wanted)
    for a, b in zip(found, wanted, strict=True):
        assert a == b or all(x == y or abs(x - y) < 1e-6 for x, y in zip(a, b, strict=True))


def test_every_operator_has_one_query():
    numbers = Counter(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op"))
    assert numbers == Counter(range(1, 14)) and "pipeline" in QUERIES


def check_packing(rows, texts, capacity=2048):
    from tokenizers import Tokenizer

    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["row_key"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    total = 0
    for pieces in by_doc.values():
        text = texts[pieces[0]["doc_id"]] or ""
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
        total += at
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity
    return total, len(by_sequence)


def test_packing(spark, small, texts):
    rows = QUERIES["op1_pack"](spark, small).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    total, sequences = check_packing(rows, texts)
    assert sequences <= -(-total // 2048) * 1.02 + 2  # little padding


def test_language(spark, small, duck):
    lang = dict(duck.sql("SELECT doc_id, lang FROM documents").fetchall())
    rows = QUERIES["op3_language_id"](spark, small).collect()
    docs = [r for r in rows if r["doc_id"] is not None]
    assert len(docs) == len(lang) and len(rows) - len(docs) == duck.sql("SELECT count(*) FROM pages").fetchall()[0][0]
    assert np.mean([r["text_language"] == lang[r["doc_id"]] for r in docs]) > 0.95
    assert np.mean([r["language"] == lang[r["doc_id"]] and r["kept"] for r in docs]) > 0.98


def test_simhash(spark, small, texts):
    rows = QUERIES["op6_simhash"](spark, small).collect()
    prints = {i: brute.fingerprint(t) for i, t in texts.items()}
    roots = brute.components(prints.values())
    least = {}
    for i, p in prints.items():
        least[roots[p]] = min(i, least.get(roots[p], i))
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{p:016x}", least[roots[p]]) for i, p in prints.items()}


def test_quality(spark, small, duck):
    rows = {r["doc_id"]: r for r in QUERIES["op7_quality"](spark, small).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for i, r in rows.items())
    held = [(rows[i]["score"], q) for i, q in duck.sql("SELECT doc_id, quality FROM labels WHERE quality IS NOT NULL").fetchall() if i in rows and rows[i]["held_out"]]
    good, bad = ([s for s, q in held if q == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.9


def test_media(spark, small, texts):
    rows = QUERIES["op9_media"](spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(payload) + 44)


def test_substring(spark, small, texts):
    found = sorted(tuple(r) for r in QUERIES["op10_substring_dedup"](spark, small).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    wanted = sorted(brute.substring(sorted(texts.items())))
    assert found == wanted and sum(w[2] for w in wanted) > 0


def test_pipeline(spark, small, duck):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    identified = corpus_pipeline.language_id(spark, docs, small)
    assert identified.columns == docs.columns
    rows = [tuple(r) for r in identified.collect()]
    assert len(rows) >= 0.98 * docs.count()

    exact = [tuple(r) for r in corpus_pipeline.exact_dedup(spark, spark.createDataFrame(rows, docs.schema), small).collect()]
    first = {}
    for r in sorted(rows):
        first.setdefault(brute.re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), r)
    assert sorted(exact) == sorted(first.values())

    near = [tuple(r) for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(exact, docs.schema), small).collect()]
    order, kept = sorted(exact), {}
    for r, root in zip(order, brute.similar_components([r[1] for r in order]), strict=True):
        kept.setdefault(root, r)
    assert set(kept.values()) <= set(near) and len(near) <= 1.03 * len(kept)  # clean documents stay; few copies do

    mixed = [tuple(r) for r in corpus_pipeline.mixing(spark, spark.createDataFrame(near, docs.schema), small).collect()]
    words, sizes = defaultdict(int), defaultdict(int)
    for r in mixed:
        words[r[3]] += len(brute.WORD.findall(r[1]))
    for r in near:
        sizes[r[3]] += len(brute.WORD.findall(r[1]))
    assert abs(sum(words.values()) - 1.5 * sum(sizes.values())) <= len(sizes)
    assert all(words[s] <= 2 * sizes[s] for s in sizes)
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    open_sources = [words[s] / weights[s] for s in sizes if words[s] < 2 * sizes[s] - 1]
    assert not open_sources or max(open_sources) - min(open_sources) <= 1.01

    packed = corpus_pipeline.packing(spark, spark.createDataFrame(mixed, docs.schema), small).collect()
    assert Counter(r["doc_id"] for r in packed if r["start"] == 0) == Counter(r[0] for r in mixed)
    assert sum(r["length"] for r in packed) == sum(r["doc_tokens"] for r in packed if r["start"] == 0)


def test_run_applies_all_stages(spark, small):
    assert QUERIES["pipeline"](spark, small).count() > 0


def test_run_on_edge_tables(spark, edge, none, tmp_path):
    """Nulls, repeated rows, long texts and clashing columns; and a table without rows."""
    import corpus_pipeline

    for name, df in (("edge", edge), ("none", none)):
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
        rows = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert bool(rows) == (name == "edge")
        assert sum(r["length"] for r in rows) == sum(r["doc_tokens"] for r in rows if r["start"] == 0)


def test_the_contracts_ask_for_whole_documents(spark, small, texts):
    """Every query of documents returns every document."""
    for name in ("op4_exact_dedup", "op5_mix", "op7_quality", "op8_secrets"):
        assert {r["doc_id"] for r in QUERIES[name](spark, small).select("doc_id").collect()} == set(texts)
