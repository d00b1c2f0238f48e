"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

from docstrata.llm import chat, common, exact_dedup, language, media, mixing, near_copies, packing, quality, secrets, simhash, substring


def order(row):
    return (row[0] is None, row[0] or 0)


def test_packing(edge, none, edge_rows):
    rows = packing.pack(edge).collect()
    starts = [r for r in rows if r["start"] == 0]
    assert Counter(r["doc_id"] for r in starts) == Counter(r[0] for r in edge_rows)
    assert sum(r["length"] for r in rows) == sum(r["doc_tokens"] for r in starts)
    assert {r["doc_tokens"] for r in starts if r["doc_id"] in (3, 4)} == {1}
    assert packing.pack(none).count() == 0


def contract_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_those_of_the_tokenizers_file():
    encode, plain = packing._encoder(*packing.public_vocabulary()), contract_tokenizer()
    rng = random.Random(11)
    parts = ["<|endoftext|>", "<|endoftext|", "|>", " ", "  ", "\n", "\u00a0", "\u3000", "\x85", "\x1c", "'s", "'LL", "12", "½", "٣", "é", "e\u0301", "漢字", "😀", "\u200d", "a", "Word", "_", "==", "\x00", "\ufeff", "x" * 70]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(3000)]
    texts += [f"a {c}b{c}{c} 1{c}" for c in map(chr, [*range(0xD800), *range(0xE000, 0x11000, 1), *range(0x1D400, 0x1D800), *range(0x1F300, 0x1FB00)])]
    for text in texts:
        assert encode(text) == plain.encode(text, add_special_tokens=False).ids, text
    assert encode("a <|endoftext|> b").count(50256) == 1


def test_packed_ids(edge, spark):
    import numpy as np

    odd = [(100, "a <|endoftext|> b", None, None, 1), (101, "<|endoftext|><|endoftext|>", None, None, 1), (102, "<|endoftext|> " * 3000, None, None, 1)]
    df = edge.select("doc_id", "text").union(spark.createDataFrame([r[:2] for r in odd], "doc_id long, text string"))
    pieces = {}
    for r in packing.pack(df).collect():
        pieces.setdefault(r["row_key"], []).append(r)
    found, plain = Counter(), contract_tokenizer()
    for rows in pieces.values():
        rows.sort(key=lambda r: r["start"])
        found[rows[0]["doc_id"], tuple((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows)] += 1
    wanted = Counter()
    for r in df.collect():
        ids = np.array([*plain.encode(r["text"] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        cut = [ids[a : a + 2048] for a in range(0, len(ids), 2048)]
        wanted[r["doc_id"], tuple((2048 * i, len(c), zlib.crc32(c.tobytes()), len(ids)) for i, c in enumerate(cut))] += 1
    assert found == wanted


def test_the_linear_program_reaches_its_bound():
    import numpy as np

    for seed in range(4):
        demand = np.random.default_rng(seed).integers(0, 50, 64) * np.random.default_rng(seed + 9).integers(1, 2000)
        columns, uses = packing.solve(demand, 64)
        covered = columns @ uses
        assert (covered >= demand - 1e-6).all() and (columns.T @ np.arange(1, 65) <= 64).all()
        assert uses.sum() <= max((demand * np.arange(1, 65)).sum() / 64, demand[32:].sum()) * 1.05 + 1


@pytest.mark.parametrize("lengths", [[2048] * 5, [1] * 3000, [1025] * 7, [2047, 1] * 10, [5], list(range(1, 300))])
def test_patterns_cover_the_demand(lengths):
    import numpy as np

    demand = np.bincount([-(-n // 8) for n in lengths], minlength=257)[1:]
    left, sequences = demand.copy(), 0
    for pattern, times in packing.patterns_for(demand, 256):
        assert sum(s * k for s, k in pattern.items()) <= 256 and times > 0
        for s, k in pattern.items():
            left[s - 1] -= k * times
        sequences += times
    assert not left.any()
    assert sequences <= -(-int((demand * np.arange(1, 257)).sum()) // 256) * 1.05 + 2 or max(lengths) > 1024


def test_chat(spark):
    turns = [(1, 0, "user", "a"), (1, 1, "bot", "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "bot", "b"), (3, 2, "user", None), (4, 0, "user", "a"), (4, 1, "bot", "b"), (4, 2, "user", None), (4, 2, "user", None),
             (None, 0, None, "<|x|>"), (None, None, "user", "last"), (5, 0, "user", ""), (6, 0, "user", None)] + [(7, t, "user", str(t)) for t in range(600)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("name", F.lit("own")).withColumn("place", F.lit(0))
    got = {(r["conv_id"], r["part"]): r for r in chat.collapse_and_render(df).collect()}
    assert set(got) == {(3, 0), (None, 0), (5, 0), (6, 0), (7, 0), (7, 1), (7, 2)}
    assert got[3, 0]["copies"] == 2 and got[3, 0]["n_turns"] == 3
    assert got[3, 0]["rendered"] == "<|user|>\na<|end|>\n<|bot|>\nb<|end|>\n<|user|>\n<|end|>\n"
    assert got[None, 0]["rendered"] == "<|unknown|>\n< |x|><|end|>\n<|user|>\nlast<|end|>\n"
    assert "".join(got[7, p]["rendered"] for p in range(3)) == "".join(f"<|user|>\n{t}<|end|>\n" for t in range(600))
    assert chat.collapse_and_render(df.limit(0)).count() == 0


def test_language(spark, edge, none):
    rows = language.identify(language.from_documents(edge)).collect()
    assert len(rows) == 14 and all(0 <= r["probability"] <= 1 for r in rows)
    assert language.identify(language.from_documents(none)).count() == 0
    kept = language.keep_identified(edge)
    assert kept.columns == edge.columns and kept.count() <= 14
    assert language.keep_identified(none).count() == 0


def test_foreign_texts_are_rejected(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    odd = spark.createDataFrame([(10**6, "Это русский текст, которого здесь никто не ждал " * 3, None, None, 1)], docs.schema)
    assert language.keep_identified(docs.union(odd)).filter(F.col("doc_id") == 10**6).count() == 0


def test_evidence_outweighs_a_short_text(spark):
    rows = [(i, "the and of the with and the that", "en", "h1", "en") for i in range(30)] + [(100 + i, "der und das die nicht von mit", "de", "h2", "de") for i in range(30)] + [(500, "x", "de", "h2", None), (501, "x", None, "h2", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, declared string, host string, suffix string").withColumn("page_id", F.lit(None).cast("long")).withColumn("domain", F.lit("d"))
    got = {r["doc_id"]: r["language"] for r in language.identify(df).collect()}
    assert got[500] == "de" and got[501] == "de"


def declaring(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, declared string")
    return df.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("page_id", "long"), ("suffix", "string"), ("host", "string"), ("domain", "string"))))


def test_every_declared_language_is_known(spark):
    rng = random.Random(3)
    words = {f"x{i:02}": ["".join(chr(0x4E00 + 40 * i + rng.randrange(40)) for _ in range(4)) for _ in range(30)] for i in range(66)}
    rows = [(1000 * k + i, " ".join(rng.choice(w) for _ in range(12)), name) for k, (name, w) in enumerate(words.items()) for i in range(7 if k < 60 else 3)]
    got = language.identify(declaring(spark, rows)).collect()
    assert len(got) == len(rows) and all(r["language"] == r["declared"] == r["text_language"] and r["kept"] for r in got)


def test_rare_languages_are_fitted_too(spark):
    english = "the cat sat on the mat and looked at the other cats for a long while "
    rare = "ñandu kuéra oikove ka'aguy mbytépe ha ohendu guyra purahéi "
    rows = [(i, english + f"{i} {i * 7}", "en") for i in range(3000)] + [(5000 + i, rare, "gn") for i in range(3)] + [(6000 + i, " ", "aa") for i in range(5)] + [(7000, "Это русский текст, которого никто не ждал " * 3, None), (7001, rare * 2, None)]
    fitted, table = language.fit(declaring(spark, rows), 100)
    assert fitted == ["aa", "en", "gn", "und"] and len(set(table[2].tolist())) > 2
    got = {r["doc_id"]: r for r in language.identify(declaring(spark, rows), 100).collect()}
    assert all(got[i]["language"] == "gn" for i in (5000, 5001, 5002, 7001))
    assert got[7000]["text_language"] == got[7000]["language"] == "und" and not got[7000]["kept"]
    assert all(got[6000 + i]["language"] == "aa" for i in range(5))


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda text: F.lit("one bucket for all")])
def test_exact_dedup(edge, none, edge_rows, digest):
    rows = exact_dedup.exact_dedup(edge, exact_dedup.halves(edge), digest).collect()
    groups = {}
    for r in sorted(edge_rows, key=order):
        groups.setdefault(normal(r[1]), []).append(r[0])
    assert len(rows) == len(edge_rows) and sum(r["kept"] for r in rows) == len(groups)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in rows) == Counter((i, ids[0], len(ids)) for ids in groups.values() for i in ids)
    kept = exact_dedup.keep_first(edge, digest)
    assert kept.columns == edge.columns and Counter((r["doc_id"], normal(r["text"])) for r in kept.collect()) == Counter((ids[0], t) for t, ids in groups.items())
    assert exact_dedup.exact_dedup(none, exact_dedup.halves(none)).count() == 0


def test_fuse_filters_have_no_false_negatives():
    import numpy as np

    for n in (0, 1, 2, 10, 1000, 50_000):
        keys = np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)
        seed, segment, segments, table = exact_dedup.build_filter(keys)
        assert not n or exact_dedup.might_hold(keys, seed, segment, segments, table).all()
    others = np.random.default_rng(99).integers(0, 2**63, 20_000).astype(np.uint64)
    assert exact_dedup.might_hold(others, seed, segment, segments, table).mean() < 0.01


def test_mixing(spark, edge, none, edge_rows):
    sized = edge.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size"), "source", "lang", F.lit(7).alias("target"))
    rows = mixing.mix(sized).collect()
    assert len(rows) == len(edge_rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) < 1 for s in sizes) and abs(sum(target.values()) - 1.5 * sum(sizes.values())) < 1e-6
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(sized).collect()))
    out = mixing.mix_documents(edge)
    assert out.columns == edge.columns and out.count() > 0
    assert mixing.mix_documents(none).count() == 0 and mixing.mix(sized.limit(0)).count() == 0


def test_a_hot_source_is_split(spark):
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit(3).cast("long").alias("size"), F.when(F.col("id") < 25_000, "hot").otherwise(F.col("id").cast("string")).alias("source"))
    got = mixing.mix(df).filter("source = 'hot'").agg(F.sum("taken").alias("t"), F.first("target").alias("target")).first()
    assert abs(got["t"] - got["target"]) < 1


def test_simhash(edge, none, edge_rows):
    rows = simhash.near_groups(edge).collect()
    prints = [brute.fingerprint(r[1]) for r in edge_rows]
    roots, least = brute.components(prints), {}
    for r, p in sorted(zip(edge_rows, prints, strict=True), key=lambda x: order(x[0])):
        least.setdefault(roots[p], r[0])
    assert Counter((r["doc_id"], r["w0"] % 2**64, r["component_id"]) for r in rows) == Counter((r[0], p, least[roots[p]]) for r, p in zip(edge_rows, prints, strict=True))
    assert simhash.near_groups(none).count() == 0


def test_keep_one(edge, none, edge_rows):
    kept = near_copies.keep_one(edge)
    exact = brute.similar_components([r[1] for r in edge_rows])
    assert kept.columns == edge.columns and kept.count() == len(set(exact))
    assert near_copies.keep_one(none).count() == 0


def connected_prints(spark, values, scheme=simhash.FOUR_BITS):
    signed = [(i, v - 2**64 if v >= 2**63 else v) for i, v in enumerate(values)]
    return {r["id"]: r["root"] for r in simhash.connected(spark.createDataFrame(signed, "id long, w0 long"), scheme).collect()}


def test_all_links_are_found(spark):
    rng = random.Random(3)
    values = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        values |= {base} | {base ^ sum(1 << b for b in rng.sample(range(64), k)) for k in range(1, 7)}
    for _ in range(5):  # paths whose steps are links
        at = rng.getrandbits(64)
        for _ in range(30):
            values.add(at)
            at ^= sum(1 << b for b in rng.sample(range(64), 4))
    values = sorted(values)
    roots, wanted = connected_prints(spark, values), brute.components(values)
    groups = {}
    for i, v in enumerate(values):
        groups.setdefault(wanted[v], set()).add(i)
    found = {}
    for i, root in roots.items():
        found.setdefault(root, set()).add(i)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, groups.values()))


def test_a_dense_group_gives_one_link_for_each_print(spark):
    base = 0x0123456789ABCDEF
    values = [base] + [base ^ (1 << i) for i in range(64)] + [base ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)]
    assert len(values) == 2081
    fps = spark.createDataFrame([(i, v - 2**64 if v >= 2**63 else v) for i, v in enumerate(values)], "id long, w0 long")
    assert simhash.nearest_groups(fps.withColumn("root", F.col("id")), simhash.FOUR_BITS).count() == 2081
    assert simhash.links_to_first(fps, simhash.FOUR_BITS).count() < 64 * 2081
    assert len(set(connected_prints(spark, values).values())) == 1


def test_many_rows_of_a_small_table_are_never_broadcast(spark, tmp_path):
    """Of a stored table Spark sees the compressed size: 128 variants for each of its rows were broadcast, and copies for each salt."""
    names = [*near_copies._PRINT, *near_copies._CARRIED]
    spark.range(200).select("id", F.col("id").alias("root"), *(F.xxhash64("id", F.lit(c)).alias(c) for c in names)).write.parquet(str(tmp_path / "fps"))
    fps, scheme = spark.read.parquet(str(tmp_path / "fps")), near_copies.PROPOSED
    links = fps.select(F.col("id").alias("u"), F.col("root").alias("v"))
    joins = [
        simhash.links_to_first(fps, scheme, None, near_copies._CARRIED), simhash.cross_pairs(fps, scheme, None, near_copies._CARRIED),
        common.salted_join(links, fps.select(F.col("id").alias("u"), "root"), "u", "v"),
    ]
    for df in joins:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    near = near_copies.with_partners(fps)._jdf.queryExecution().executedPlan().toString()
    assert near.count("Generate") and "SortMergeJoin [variant" in near


def test_segments_cover_the_bits():
    for scheme in (simhash.FOUR_BITS, near_copies.PROPOSED):
        bits = [b for first, n in scheme.cuts() for b in range(first, first + n)]
        assert bits == list(range(64 * scheme.words)) and len(scheme.cuts()) == scheme.segments


def pairs_at(common, n, length, rng):
    """Texts of ``length`` words of which two share ``common`` of their shingles of five words, by a changed end."""
    words, shingles = [f"w{i}" for i in range(5000)], length - 4
    changed = round(shingles * (1 - common) / (1 + common))
    rows, values = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(length)]
        other = text[: length - changed] + [rng.choice(words) for _ in range(changed)]
        values.append(brute.jaccard(brute.shingle_set(" ".join(text)), brute.shingle_set(" ".join(other))))
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(other))]
    return rows, values


@pytest.mark.parametrize(("common", "least"), [(0.805, 0.9), (0.85, 0.95), (0.9, 0.97)])
def test_texts_of_similarity_0_8_are_linked(spark, common, least):
    """Just above the threshold nine of ten pairs are found, further up nearly all."""
    rows, values = pairs_at(common, 600, 300, random.Random(17))
    assert all(0.8 <= v < common + 0.01 for v in values)
    roots = {r["doc_id"]: r["root"] for r in near_copies.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(roots[2 * i] == roots[2 * i + 1] for i in range(600)) >= least * 600
    assert len(set(roots.values())) >= 600


@pytest.mark.parametrize("common", [0.79, 0.7, 0.66])
def test_less_similar_texts_stay(spark, common):
    rows, values = pairs_at(common, 200, 300, random.Random(18))
    assert all(v < 0.8 for v in values)
    assert near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).count() == 400


def test_groups_are_those_of_the_exact_links(spark, small, duck):
    """No group reaches beyond exact links of 0.8, and most of those links are in one group."""
    texts = dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())
    family = {10_000 + i: t for i, t in enumerate(brute.family(random.Random(2), 120))}
    rows = [*texts.items(), *family.items()]
    exact = dict(zip((i for i, _ in rows), brute.similar_components([t for _, t in rows]), strict=True))
    found = {r["doc_id"]: r["root"] for r in near_copies.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    classes = {}
    for i, root in found.items():
        classes.setdefault(root, set()).add(exact[i])
    assert all(len(c) == 1 for c in classes.values())
    assert len(set(exact.values())) <= len(classes) <= 1.05 * len(set(exact.values()))


def test_components_of_a_long_path(spark):
    from docstrata.llm.components import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (300, 301), (301, 300)], "u long, v long")
    roots = {r["node"]: r["root"] for r in components(edges).collect()}
    assert all(roots[i] == 0 for i in range(1, 201)) and roots[301] == 300
    assert components(edges.limit(0)).count() == 0


def test_quality(spark, edge, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (6, 0), (7, 1), (8, None), (None, 1)], "doc_id long, quality int")
    rows = quality.score(edge, quality.fit(edge, labels)).collect()
    assert len(rows) == 14 and all(0 <= r["score"] <= 1 for r in rows)
    unfit = quality.fit(none, labels)
    assert quality.score(edge, unfit).count() == 14 and quality.score(none, unfit).count() == 0


def brute_spans(text):
    base = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        base += [(m.start(), 0, f"assign:{m.start()}:{m.end()}")] * (len(m[2]) >= 12)
    base += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    base += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return [s for *_, s in sorted(base)]


def test_secrets(spark, edge, none, edge_rows, small):
    for df in (edge, spark.read.parquet(f"{small}/documents.parquet")):
        texts = Counter((r["doc_id"], hashlib.sha256(",".join(brute_spans(r["text"] or "")).encode()).hexdigest()) for r in df.collect())
        assert Counter((r["doc_id"], r["base_sha256"]) for r in secrets.find_secrets(df).collect()) == texts
    assert secrets.find_secrets(none).count() == 0
    masked = secrets.mask_secrets(edge)
    assert masked.columns == edge.columns and "hunter2" not in masked.filter("doc_id = 9").first()["text"]


@pytest.mark.parametrize(
    ("text", "found"),
    [("key q8Zx0p2LmN4vB7tY1cR5wE9uK3sD6fG end", True), ("repeats itself aB3aB3aB3aB3aB3aB3aB3aB3", False), ("id 123e4567-e89b-12d3-a456-426614174000", False), ("sha256: q8Zx0p2LmN4vB7tY1cR5wE9uK3sD6fG", False), ("EXAMPLEaB3kd93kdLKD93kdkslaDKD93", False), ("aVeryLongCamelCaseIdentifierName", False), ("abcdefghijklmnopqrstuvwxyz0123456789AB", False), ("1111111111111111111111111", False)],
)
def test_entropy_and_allow_list(text, found):
    assert bool(secrets.random_spans(text)) is found


@pytest.mark.parametrize("before", ["", "AUTH=", "SessionId=", "AUTH_", "SessionId-", "Build2=x/", "sample-repo/", "docs/example/v2/", "====================", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa="])
def test_a_name_in_front_hides_no_key(before):
    rng = random.Random(7)
    for _ in range(200):
        key = "".join(rng.choice("0123456789ABCDEF") for _ in range(32))
        alone, named = secrets.random_spans(key), secrets.random_spans(before + key)
        windows = {a + i for a, b in alone for i in range(b - a)}
        assert windows <= {a + i - len(before) for a, b in named for i in range(b - a)}


@pytest.mark.parametrize("text", ["SHA256=3FA94C7E1B0D8265AF3C9E7D41B6802F", "id=123e4567-e89b-12d3-a456-426614174000", "x/123e4567-e89b-12d3-a456-426614174000", 'integrity="sha512-q8Zx0p2LmN4vB7tY/1cR5wE9uK3sD6fGq8Zx0p2L/mN4vB7tY1cR5wE9uK3sD6fG=="', "key=EXAMPLE3FA94C7E1B0D8265AF3C9E7D41B6802F", "MyProject/some_plain_names/of_folders"])
def test_allowed_pieces_stay_allowed(text):
    assert not secrets.random_spans(text)


def test_incremental_entropy():
    import math

    text = "aB3kd93kdLKD93kdkslaDKD93ksla0DKEaaaaaaaaaaaaaaaaaaaaaaaaa"
    plain = [-sum(c / 20 * math.log2(c / 20) for c in Counter(text[i : i + 20]).values()) for i in range(len(text) - 19)]
    assert all(abs(a - b) < 1e-9 for a, b in zip(secrets.window_entropies(text), plain, strict=True))


def test_media(edge, none, edge_rows):
    rows = media.media_columns(edge).collect()
    payloads = {r[0]: media.payload_of((r[1] or "").encode()) for r in edge_rows if r[0] not in (None, 2)}
    assert len(rows) == len(edge_rows)
    for r in rows:
        if r["doc_id"] in payloads:
            p = payloads[r["doc_id"]]
            assert (r["payload_sha256"], r["tail_crc32"], r["media_sha256"]) == (hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), hashlib.sha256(media.wav(p)).hexdigest())
    assert media.media_columns(none).count() == 0


def test_texts_of_one_payload_are_one_medium(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a\x00"), (3, "a")], "doc_id long, text string")
    rows = media.media_columns(df).collect()
    assert len({r["media_sha256"] for r in rows}) == 1 and sorted(r["n_bytes"] for r in rows) == [1, 1, 2]


def test_shared_chunks_are_stored_once(spark, tmp_path):
    import random

    random.seed(1)
    common = "".join(random.choice("abcdefgh ") for _ in range(60_000))
    df = spark.createDataFrame([(i, f"{i} head {i * 7919} " + common + f" tail {i}") for i in range(6)], "doc_id long, text string")
    store = str(tmp_path / "store")
    rows = media.media_columns(df, store).collect()
    assert all(r["payload_sha256"] == hashlib.sha256(media.payload_of(t.encode())).hexdigest() for r in rows for i, t in [(x["doc_id"], x["text"]) for x in df.collect()] if i == r["doc_id"])
    stored = spark.read.parquet(store).select(F.sum(F.aggregate("own", F.lit(0), lambda s, c: s + F.octet_length(c))).alias("n")).first()["n"]
    assert stored < 2.5 * len(common)


def test_gear_hash_is_rolling():
    import numpy as np

    data = np.random.default_rng(0).integers(0, 256, 500).astype(np.uint8)
    gear, h, plain = media._gear(), 0, []
    for b in data:
        h = ((h << 1) + int(gear[b])) & 0xFFFFFFFF
        plain.append(h)
    assert media.gear_hashes(data).tolist() == plain
    chunks = media.chunks_of(bytes(100_000) + data.tobytes())
    assert b"".join(chunks) == bytes(100_000) + data.tobytes() and max(map(len, chunks)) <= media.MOST


def test_substring(edge, none, edge_rows):
    def key(row):
        return (*order(row),)

    found = substring.substring_dedup(edge, full=True)
    rows = found.collect()
    assert len(rows) == len(edge_rows) and found.columns == ["doc_id", "key", "n_words", "n_removed", "kept_sha256", "kept_text"]
    # Rows that share an id are ordered by text key; here no window is shared between such texts.
    wanted = brute.substring([(r[0], r[1]) for r in sorted(edge_rows, key=key)])
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows) == Counter(wanted)
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in rows if r["kept_text"] is not None)
    assert substring.substring_dedup(none).count() == 0


def test_substring_by_chance(spark):
    import random

    random.seed(5)
    base = [random.choice("abcd") for _ in range(400)]
    rows = [(i, " ".join(random.choice("abcd") if random.random() < 0.04 else w for w in base[random.randrange(300) :])) for i in range(25)] + [(30, " ".join("a" * 1 for _ in range(90)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(tuple(r) for r in substring.substring_dedup(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert found == sorted(brute.substring(rows))


def test_substring_tells_words_apart_that_fool_polynomial_hashes(spark):
    """Thue-Morse words and windows made of them have equal polynomial hashes modulo 2**64."""
    a, b = "ab"
    for _ in range(10):
        a, b = a + b, b + a
    rest = [f"w{i}" for i in range(19)]
    rows = [(1, " ".join([a, *rest])), (2, " ".join([b, *rest])), (3, " ".join([a, *rest, "end"]))]
    u, v = ["p"], ["q"]
    for _ in range(4):
        u, v = u + v, v + u
    rows += [(4, " ".join([*u, *rest[:4]])), (5, " ".join([*v, *rest[:4]])), (6, " ".join([*u, *rest[:4], *v, *rest[:4]]))]
    found = sorted(tuple(r) for r in substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert found == sorted(brute.substring(rows)) and [r[2] for r in found] == [0, 0, 20, 0, 0, 40]


def test_repeated_windows_are_named_by_their_words(spark):
    """Whatever windows the hashes throw together, the digests of their words tell them apart."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = [(i, " ".join(base[rng.randrange(40) :] + [f"own{i}"] * 3)) for i in range(12)] + [(50, "x " * 45)]
    texts = spark.createDataFrame([(i, i, i, t) for i, t in rows], "doc long, doc_id long, key long, text string")
    held, given = substring.sliced(texts), dict(rows)
    packed = {r["slice"]: substring.window_hashes([given[i].encode() for i in r["doc"]], 20)[1].astype("<u4").tobytes() for r in held.collect()}
    all_places = spark.createDataFrame([(k, [bytes(v)]) for k, v in packed.items()], "slice long, places array<binary>")
    assert {(r["doc"], r["text"]) for r in substring.unsliced(held).collect()} == set(rows)
    found = substring.window_digests(held.join(all_places, "slice"), 20).collect()
    words = {i: t.split() for i, t in rows}
    wanted = {(i, s): tuple(w[s : s + 20]) for i, w in words.items() for s in range(len(w) - 19)}
    digests = {}
    for r in found:
        digests.setdefault(wanted.pop((r["doc"], r["start"])), set()).add((r["d1"], r["d2"]))
    assert not wanted and all(len(d) == 1 for d in digests.values()) and len(set.union(*digests.values())) == len(digests)


def test_windows_are_counted_in_buckets(spark):
    """Many buckets, salts and slices give what one bucket gives."""
    rng = random.Random(21)
    rows = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(15, 400)))) for i in range(40)] + [(90, "the same passage " * 30), (91, "the same passage " * 31)]
    texts = spark.createDataFrame([(i, i, i, t) for i, t in rows], "doc long, doc_id long, key long, text string")
    held = substring.sliced(texts.coalesce(3))
    counts = Counter(tuple(t.split()[s : s + 20]) for _, t in rows for s in range(len(t.split()) - 19))
    wanted = {(i, s) for i, t in rows for s in range(len(t.split()) - 19) if counts[tuple(t.split()[s : s + 20])] > 1}
    for buckets in (1, 7, 100_000):
        repeated = substring.counted(held, 20, buckets).withColumn("salts", F.lit(3))
        listed = substring.places_of(held, repeated, 20, buckets).groupBy("slice").agg(F.collect_list("places").alias("places"))
        got = [(r["doc"], r["start"]) for r in substring.window_digests(held.join(listed, "slice"), 20).collect()]
        assert len(got) == len(set(got)) and set(got) == wanted


def test_long_texts_take_little_memory_at_once():
    from docstrata.llm.common import slices

    import numpy as np

    sizes = [10, 3 << 20, 5, 1 << 19, 1 << 19, 1 << 19]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    parts = list(slices(offsets))
    assert [p[0] for p in parts] == [0] + [p[1] for p in parts[:-1]] and parts[-1][1] == len(sizes)
