"""URL filter: rules as a sorted array of digests, memory-mapped by the tasks.

A rule is a host and a path prefix. Rules and their hosts become two arrays of 64-bit XXH64 keys
in ascending order, with the full strings beside them, in one file that Spark ships to every
executor; the Python workers of an executor map the same file. A batch of URLs is probed with
one vectorised binary search for all host suffixes and one for all rule candidates, and each
hit is confirmed with the stored string, since digests may collide.

The file has a bound. More rules than that are never gathered: the probes then meet the rules
in joins on the digest, with the same confirmation, and give the same rows.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.llm.common import checkpointed, salted_join, shared_file

SEED = 42
#: A mapped file holds at most so many rules, and about so many bytes of them.
MOST_MAPPED, MOST_BYTES = 1_000_000, 1 << 26
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: The method's verdict on a URL that no rule fits.
DEFAULT = "allow"

#: Rules of the registered query (verdict, host and path).
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, _ADDRESS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty for null and without ``://``."""
    return F.coalesce(F.regexp_extract(url, _ADDRESS, 2), F.lit(""))


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """(host, path, verdict) of rules written as one string, which is cut at its first slash."""
    rows = [(r.partition("/")[0], "".join(r.partition("/")[1:]), verdict) for verdict, r in rules]
    return spark.createDataFrame(rows, "host string, path string, verdict string")


def _entries(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(digest, text, verdict, host_size) of each rule, and (digest, text, sizes) of each host with its rules' path lengths."""
    clean = rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").filter("host is not null and host != ''")
    each = clean.groupBy("host", "path").agg(F.when(F.max(F.col("verdict") == "block"), F.lit("block")).otherwise(F.lit("allow")).alias("verdict"))
    text = F.concat("host", "path")
    by_rule = each.select(F.xxhash64(text).alias("digest"), text.alias("text"), "verdict", F.length("host").alias("host_size"))
    by_host = each.groupBy("host").agg(F.collect_set(F.length("path")).alias("sizes")).select(F.xxhash64("host").alias("digest"), F.col("host").alias("text"), "sizes")
    return by_rule, by_host


# -- the mapped file ----------------------------------------------------------------------


class SortedDigests:
    """Strings by their digests, ascending; every string has a few numbers with it."""

    def __init__(self, keys: np.ndarray, starts: np.ndarray, text: np.ndarray, firsts: np.ndarray, numbers: np.ndarray):
        self.keys, self.starts, self.text, self.firsts, self.values = keys, starts, text, firsts, numbers

    @staticmethod
    def arrays(digests: np.ndarray, texts: list[str], numbers: list[list[int]]) -> list[np.ndarray]:
        """What is stored, in ascending order of the digests."""
        order = np.argsort(digests, kind="stable")
        raw = [texts[i].encode() for i in order]
        rows = [numbers[i] for i in order]
        ends = lambda sizes: np.concatenate([[0], np.cumsum(np.array(sizes, dtype=np.int64))]).astype(np.int64)
        return [
            digests[order].astype(np.int64),
            ends([len(r) for r in raw]),
            np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint8),
            ends([len(r) for r in rows]),
            np.array([x for r in rows for x in r], dtype=np.int64),
        ]

    def string(self, at: int) -> bytes:
        return self.text[self.starts[at] : self.starts[at + 1]].tobytes()

    def numbers(self, at: int) -> np.ndarray:
        return self.values[self.firsts[at] : self.firsts[at + 1]]

    def find(self, probes: list[bytes], digests: np.ndarray | None = None) -> np.ndarray:
        """Where each probe is stored, or -1: one binary search for all, then equal keys are compared as strings."""
        import xxhash

        if digests is None:
            digests = np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in probes), np.uint64, len(probes)).view(np.int64)
        at, found = np.searchsorted(self.keys, digests), np.full(len(probes), -1, dtype=np.int64)
        left = np.arange(len(probes))
        while len(left):
            left = left[at[left] < len(self.keys)]
            left = left[self.keys[at[left]] == digests[left]]
            same = np.array([self.string(at[i]) == probes[i] for i in left], dtype=bool)
            found[left[same]] = at[left[same]]
            left = left[~same]
            at[left] += 1  # a colliding key stands next to it
        return found


def packed(tables: list[list[np.ndarray]]) -> bytes:
    """The arrays of some tables as one file: their number and sizes, then each, aligned to eight bytes."""
    flat = [a for t in tables for a in t]
    out = io.BytesIO(np.array([len(flat), *(a.nbytes for a in flat)], dtype=np.int64).tobytes())
    out.seek(0, io.SEEK_END)
    for a in flat:
        out.write(a.tobytes())
        out.write(bytes(-a.nbytes % 8))
    return out.getvalue()


def mapped(path: str) -> list[SortedDigests]:
    """The tables of a file; their pages are read when they are touched, and shared by the processes of a machine."""
    whole = np.memmap(path, dtype=np.uint8, mode="r")
    n = int(whole[:8].view(np.int64)[0])
    sizes = whole[8 : 8 + 8 * n].view(np.int64)
    at, arrays = 8 + 8 * n, []
    for i, size in enumerate(sizes.tolist()):
        arrays.append(whole[at : at + size] if i % 5 == 2 else whole[at : at + size].view(np.int64))
        at += size + -size % 8
    return [SortedDigests(*arrays[i : i + 5]) for i in range(0, n, 5)]


def _suffixes(host: str, most: int) -> list[str]:
    """The host and its parent domains, if no longer than the longest host of a rule."""
    starts, at = [0], host.find(".")
    while at >= 0:
        starts.append(at + 1)
        at = host.find(".", at + 1)
    return [host[i:] for i in starts if i < len(host) and len(host) - i <= most]


def judge(hosts: list[str], paths: list[str], by_rule: SortedDigests, by_host: SortedDigests, most: int) -> list[tuple[str | None, str]]:
    """(rule or None, verdict) of each URL."""
    names = {h: i for i, h in enumerate(dict.fromkeys(hosts))}
    probes = [(i, s) for h, i in names.items() for s in _suffixes(h, most)]
    found = by_host.find([s.encode("utf-8", "surrogateescape") for _, s in probes])
    fitting: list[list[tuple[str, np.ndarray]]] = [[] for _ in names]
    for (i, s), at in zip(probes, found, strict=True):
        if at >= 0:
            fitting[i].append((s, by_host.numbers(at)))
    tried, owner = [], []
    for row, (host, path) in enumerate(zip(hosts, paths, strict=True)):
        for suffix, sizes in fitting[names[host]]:
            for size in sizes[sizes <= len(path)].tolist():
                tried.append((size + len(suffix), len(suffix), suffix + path[:size]))
                owner.append(row)
    at = by_rule.find([t[2].encode("utf-8", "surrogateescape") for t in tried])
    best: dict[int, tuple[int, int, str, int]] = {}
    for row, (size, host_size, rule), hit in zip(owner, tried, at.tolist(), strict=True):
        if hit >= 0 and (row not in best or (size, host_size) > best[row][:2]):
            best[row] = (size, host_size, rule, hit)
    verdicts = {row: (rule, "block" if by_rule.numbers(hit)[1] else "allow") for row, (_, _, rule, hit) in best.items()}
    return [verdicts.get(row, (None, DEFAULT)) for row in range(len(hosts))]


def _by_mapped_file(rows: DataFrame, by_rule: DataFrame, by_host: DataFrame) -> DataFrame:
    spark = rows.sparkSession
    r, h = by_rule.toArrow(), by_host.toArrow()  # of a checked number and size
    most = max(map(len, h["text"].to_pylist()), default=0)
    rules = SortedDigests.arrays(r["digest"].to_numpy(), r["text"].to_pylist(), [[n, int(v == "block")] for n, v in zip(r["host_size"].to_pylist(), r["verdict"].to_pylist(), strict=True)])
    hosts = SortedDigests.arrays(h["digest"].to_numpy(), h["text"].to_pylist(), h["sizes"].to_pylist())
    data = packed([rules, hosts])
    name = f"url-rules-{hashlib.sha256(data).hexdigest()[:32]}"
    spark.sparkContext.addFile(shared_file(spark, name, data))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rule, by_host = mapped(SparkFiles.get(name))
        for batch in batches:
            host, path = ([x.decode("utf-8", "surrogateescape") for x in batch[c].cast(pa.binary()).to_pylist()] for c in ("host", "path"))
            out = judge(host, path, by_rule, by_host, most)
            rule = pa.array([None if x is None else x.encode("utf-8", "surrogateescape") for x, _ in out], pa.binary()).cast(pa.string(), safe=False)
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["host"], batch["path"], rule, pa.array([v for _, v in out], pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return rows.mapInArrow(run, "page_id bigint, host string, path string, rule string, verdict string")


# -- more rules than a file may hold ------------------------------------------------------


def _by_joins(rows: DataFrame, by_rule: DataFrame, by_host: DataFrame) -> DataFrame:
    """The same by joins: distinct hosts find their rules' hosts, then each URL its rules; hot keys are salted."""
    longest = F.broadcast(by_host.agg(F.max(F.size(F.split("text", r"\."))).alias("labels")))  # one row
    kept = checkpointed(rows.withColumn("row_id", F.monotonically_increasing_id()))
    labels = F.split("host", r"\.")
    deepest = F.greatest(F.lit(1), F.size(labels) - F.coalesce("labels", F.lit(0)) + 1)
    names = kept.select("host").distinct().crossJoin(longest)
    suffixes = names.select("host", F.explode(F.transform(F.sequence(deepest, F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("suffix"))
    probed = suffixes.withColumn("digest", F.xxhash64("suffix"))
    met = probed.join(by_host, "digest").filter("suffix = text").select("host", "suffix", "sizes")
    tried = salted_join(kept, met, "host", "row_id").select("row_id", "suffix", "path", F.explode(F.filter("sizes", lambda n: n <= F.length("path"))).alias("size"))
    full = tried.select("row_id", F.concat("suffix", F.substring("path", F.lit(1), F.col("size"))).alias("rule"), F.length("suffix").alias("host_size")).withColumn("digest", F.xxhash64("rule"))
    hit = salted_join(full, by_rule.drop("host_size"), "digest", "row_id").filter("rule = text")
    best = hit.groupBy("row_id").agg(F.max(F.struct(F.length("rule").alias("n"), "host_size", "rule", "verdict")).alias("best"))
    return kept.join(best, "row_id", "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(DEFAULT)).alias("verdict"))


def url_verdicts(pages: DataFrame, rules: DataFrame, most: int = MOST_MAPPED) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages`` (page_id, url), by ``rules`` (host, path, verdict).

    A rule fits its host and all subdomains of it where the path starts with its own; the
    longest rule wins, of equally long ones that with the longer host. Without a rule the
    rule is null and the verdict "allow". A rule that is repeated with both verdicts blocks; one
    without host fits nothing, and a null path fits every path. A null URL, and one without
    ``://``, has an empty host and path. Repeated rows stay repeated, null ids stay null, very
    long URLs are read whole, an empty table gives an empty result and no rules "allow"
    everywhere; further columns are ignored.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    by_rule, by_host = _entries(rules)
    by_rule = checkpointed(by_rule)
    n, size = by_rule.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if n <= most and size <= MOST_BYTES:
        return _by_mapped_file(rows, by_rule, by_host)
    return _by_joins(rows, by_rule, by_host)


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_verdicts(pages, rule_table(spark, RULES))


_RULE_ROWS = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '{''.join(r.partition('/')[1:])}')" for v, r in RULES)
OP13_SQL = rf"""
WITH cut AS (
  SELECT row_number() OVER () AS row_id, page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS mark FROM pages
), parts AS (
  SELECT row_id, page_id, CASE WHEN mark > 0 THEN regexp_extract(substr(url, mark + 3), '^[^/?#]*') ELSE '' END AS raw,
         CASE WHEN mark > 0 THEN substr(url, mark + 3) ELSE '' END AS rest FROM cut
), named AS (
  SELECT row_id, page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM parts
), rules(verdict, rule, rule_host, rule_path) AS (VALUES {_RULE_ROWS}
), fitting AS (
  SELECT row_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM named JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY row_id
)
SELECT page_id, host, path, rule, coalesce(verdict, '{DEFAULT}') AS verdict FROM named LEFT JOIN fitting USING (row_id)
"""
