"""Secret scanning: fixed patterns, and sliding-window entropy of candidate strings.

Patterns name the secrets that can be told by their form. The others are found by entropy:
over each candidate string a window moves one character at a time, and its Shannon entropy
is kept up to date from the counts of the character that enters and the one that leaves.
What counts as high depends on the character class of the narrowest unit that holds the
window: a token of the candidate, or else the candidate, so that a name in front of a key
does not change the key's class. An allow-list suppresses pieces that are known to be harmless.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.llm.common import checkpointed

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "entropy")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of [0-9a-f]+ that are long enough
LEAST_VALUE, LEAST_ACCESS = 12, 18

#: Characters of the moving window, and so the length of the shortest candidate.
WINDOW = 20
_CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{WINDOW},}}")
#: Units of a candidate that have a class of their own if a window fits in: tokens, and runs of hex digits.
_UNITS = (re.compile(rf"[^=/_-]{{{WINDOW},}}"), re.compile(rf"[0-9a-f]{{{WINDOW},}}|[0-9A-F]{{{WINDOW},}}"))
#: What the allow-list is asked about one by one: pieces by their form, values (a digest may hold '/') by what is before them.
_PIECE, _VALUE = re.compile(r"[^=/]+"), re.compile(r"[^=]+")
#: Bits per character above which a window of a class looks random (log2(20) = 4.32 at most).
THRESHOLDS = {"hex": 3.0, "lower": 3.45, "upper": 3.45, "mixed": 3.7}
#: Digits that a window needs: words and identifiers have few.
LEAST_DIGITS = 2

#: What is harmless by its form: UUIDs, words of placeholders, paths of plain words.
ALLOWED = (
    re.compile(r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"),
    re.compile(r"(?i).*(?:example|sample|dummy|placeholder|changeme|redacted)"),
    re.compile(r"(?i)/?(?:[a-z]+[/_-])*[a-z]+[/_-]?\d{0,4}"),
)
#: What is harmless by the words before it: names of digests and revisions.
ALLOWED_BEFORE = re.compile(r"(?i)(?:sha-?(?:1|256|384|512)|md5|commit|revision|checksum|integrity)[\"'\s:=-]*\Z")

_SHARE = [0.0, *(c * math.log2(c) for c in range(1, WINDOW + 1))]


def window_entropies(text: str) -> Iterator[float]:
    """Shannon entropy in bits of each window, from incremental counts.

    With counts c of a window of n characters it is log2(n) - sum(c * log2(c)) / n, so one
    step changes two terms of the sum.
    """
    counts: dict[str, int] = {}
    total = 0.0
    for i, new in enumerate(text):
        c = counts.get(new, 0)
        counts[new] = c + 1
        total += _SHARE[c + 1] - _SHARE[c] if c < WINDOW else 0.0
        if i >= WINDOW - 1:
            yield math.log2(WINDOW) - total / WINDOW
            old = text[i - WINDOW + 1]
            c = counts[old]
            counts[old] = c - 1
            total += _SHARE[c - 1] - _SHARE[c]


def character_class(text: str) -> str | None:
    """The narrowest class of a candidate; None for letters alone."""
    if not re.search(r"[0-9]", text):
        return None
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text):
        return "hex" if re.search(r"[a-fA-F]", text) else None
    low, high = re.search(r"[a-z]", text), re.search(r"[A-Z]", text)
    return "mixed" if low and high else "lower" if low else "upper" if high else None


def _ordered(text: str) -> bool:
    """Mostly steps to the next or the same character, as in abcdef or 000000."""
    return sum(0 <= ord(b) - ord(a) <= 1 for a, b in zip(text, text[1:])) * 2 > len(text)


def _threshold(text: str) -> float:
    """The entropy that a window of this unit must reach; infinite if none can be random."""
    kind = character_class(text)
    return math.inf if kind is None or _ordered(text) else THRESHOLDS[kind]


def _harmless(found: str, text: str, at: int) -> Iterator[tuple[int, int]]:
    """Pieces of a candidate that are UUIDs, hold a placeholder's word, or are named digests."""
    for p in _PIECE.finditer(found):
        if ALLOWED[0].fullmatch(p.group()) or ALLOWED[1].match(p.group()):
            yield p.span()
    for v in _VALUE.finditer(found):
        if ALLOWED_BEFORE.search(text, max(0, at + v.start() - 24), at + v.start()):
            yield v.span()


def window_thresholds(found: str, text: str, at: int) -> list[float]:
    """The threshold of each window of the candidate ``found``, which starts at ``at`` in ``text``.

    A window that touches a harmless piece has an infinite one; the others of the candidate keep theirs.
    """
    n = len(found) - WINDOW + 1
    out = [_threshold(found)] * n
    for unit in _UNITS:
        for u in unit.finditer(found):
            own, first, last = _threshold(u.group()), u.start(), u.end() - WINDOW + 1
            out[first:last] = [min(own, x) for x in out[first:last]]
    for start, end in _harmless(found, text, at):
        first, last = max(0, start - WINDOW + 1), min(n, end)
        out[first:last] = [math.inf] * (last - first)
    return out


def random_spans(text: str) -> list[tuple[int, int]]:
    """Unions of overlapping high-entropy windows, in code points, without allowed pieces."""
    out: list[tuple[int, int]] = []
    for m in _CANDIDATE.finditer(text):
        found = m.group()
        if character_class(found) is None or ALLOWED[2].fullmatch(found):
            continue
        thresholds = window_thresholds(found, text, m.start())
        if min(thresholds) == math.inf:
            continue
        digits = sum(c.isdigit() for c in found[:WINDOW])
        for i, entropy in enumerate(window_entropies(found)):
            if i:
                digits += found[i + WINDOW - 1].isdigit() - found[i - 1].isdigit()
            if entropy >= thresholds[i] and digits >= LEAST_DIGITS:
                start = m.start() + i
                if out and start <= out[-1][1]:
                    out[-1] = (out[-1][0], start + WINDOW)
                else:
                    out.append((start, start + WINDOW))
    return out


def pattern_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns: leftmost and non-overlapping per kind."""
    spans = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_VALUE]
    spans += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    spans += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return spans


def _listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


def scan(text: str) -> tuple[int, int, int, str, str, list[tuple[int, int, str]]]:
    """(n_assign, n_access, n_hex, base_sha256, spans as text, spans)."""
    base = pattern_spans(text)
    added = [(a, b, "entropy") for a, b in random_spans(text) if not any(s <= a and b <= e for s, e, _ in base)]
    counts = [sum(kind == k for _, _, kind in base) for k in KINDS[:3]]
    return *counts, hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(base + added), base + added


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of each row (doc_id, text).

    Null text is empty; a text without secrets has no spans and the hash of the empty string.
    Spans count code points, end exclusive. Texts of any length are read whole. Repeated rows
    give repeated results, an empty table gives an empty one, and further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(t.as_py() or "")[:5] for t in batch["text"]]
            assign, access, hexes, digest, spans = zip(*found, strict=True) if found else ((), (), (), (), ())
            columns = [batch["doc_id"], *(pa.array(c, pa.int64()) for c in (assign, access, hexes)), pa.array(digest, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = narrow.mapInArrow(run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
    return checkpointed(found)  # in batches of bounded bytes


def mask_secrets(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every span of their text replaced by ``mask``; overlapping spans by one.

    A null text stays null; long texts are read whole, repeated rows stay repeated, and an empty
    table stays empty.
    """
    text_at = docs.columns.index("text")

    def masked(text: str) -> str:
        out, at = [], 0
        for start, end, _ in sorted(scan(text)[5]):
            if start >= at:
                out += [text[at:start], mask]
            at = max(at, end)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([None if t.as_py() is None else masked(t.as_py()) for t in batch.column(text_at)], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == text_at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
