"""An index of many phrases, found in every text in one pass.

Texts are cut into tokens (runs of letters and digits, and single other characters). Of a phrase
the inner tokens must stand in a text as they are, as only its first and last one can be
attached to more; the hash of a run of them is the phrase's key. A text's token runs are
hashed with one prefix sum for each of four run lengths and meet the keys by equality; what
meets is verified. No text is searched once for each phrase.

As many phrases as fit a bound go to the tasks as one sorted array of keys, and nothing is
shuffled. With more, a bitmap of fixed size tells which runs may be keys, and those are joined
with the table of phrases. Both give the same rows.

Long citations need no index of tokens, as one pattern finds what may be one: `find_citations`
joins them by what stands before the month, in DataFrame functions only.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import pairwise
from string import ascii_lowercase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from docstrata.functions.text import FOLD_FROM, FOLD_TO

#: Lengths of the runs of inner tokens that are hashed; a phrase takes the longest that it has.
RUNS = (8, 4, 2, 1)
#: Phrases, and bytes of them, that are sent to the tasks.
MOST_PHRASES, MOST_BYTES = 100_000, 1 << 24
#: Phrases without an inner token, which are sought one by one.
MOST_SHORT = 10_000
#: Bits of the bitmap for more of them (2 to this power: 1 MB, and 16 MB at most, 64 bits a phrase between), and of one of its pages.
SCREEN_BITS, MOST_BITS, PAGE_BITS = 23, 27, 15
#: Texts are hashed in slices of about so many bytes.
SLICE_BYTES = 1 << 20
#: What makes a citation that follows it another document's.
GUARD = "decreto "
FOUND = "array<struct<start:int,finish:int,item:string>>"
_TOKEN_BASE, _RUN_BASE = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
#: Blanks beyond ASCII are spaces to a loose phrase.
_BLANKS = "\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
_FOLD = str.maketrans(FOLD_FROM + _BLANKS, FOLD_TO + " " * len(_BLANKS))
_POWERS: dict[int, np.ndarray] = {}


#: Every blank of a loose phrase as ranges, and the letters that `plain` makes a given one (the Kelvin sign's small letter is k).
_SPACE = "[ \t-\r\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_LETTERS = {c: c + c.upper() + "".join(x for x, y in zip(FOLD_FROM, FOLD_TO, strict=True) if y.lower() == c) + "\u212a" * (c == "k") for c in ascii_lowercase}
_LETTER = f"[a-zA-Z{FOLD_FROM}\u212a]"


def _loosely(phrase: str) -> str:
    """A pattern of whatever `plain` makes the phrase, with any blanks for each of its own."""
    return "".join(f"{_SPACE}+" if c == " " else f"[{_LETTERS[c]}]" for c in phrase)


#: A long citation up to its month.
_HEAD = (
    f"(?:{_loosely('ley')}(?:{_loosely(' organica')}|{_loosely(' foral')})?|(?:{_loosely('real ')})?{_loosely('decreto')})"
    f"{_SPACE}+[0-9/]+,{_loosely(' de ')}[0-9]+{_loosely(' de ')}"
)
#: The first letter of one and, ahead of it, all of it with the letters of its month: another one may begin within either.
_CITED = f"(?=[{_LETTERS['l']}{_LETTERS['r']}{_LETTERS['d']}])(?=({_HEAD}{_LETTER}+))(?<!{_loosely(GUARD.strip())}[ {_BLANKS}])."


# -- tokens and keys ----------------------------------------------------------------------


def plain(text: str, loose: bool) -> str:
    """The text as it is searched: ``loose`` without accents and in lower case, character for character."""
    if not loose:
        return text
    folded = text.translate(_FOLD)
    low = folded.lower()
    return low if len(low) == len(folded) else "".join(c.lower() if len(c.lower()) == 1 else c for c in folded)


def _powers(base: int, n: int) -> np.ndarray:
    if len(_POWERS.get(base, ())) < n:
        out = np.full(max(n, SLICE_BYTES + 1), np.uint64(base))
        out[0] = 1
        _POWERS[base] = np.multiply.accumulate(out)
    return _POWERS[base][:n]


def _hashes(values: np.ndarray, begins: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of each range of values, wherever it stands: prefix sums of value times power, moved to 0 by the inverse."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _powers(base, len(values)), out=total[1:])
        x = (total[ends] - total[begins]) * _powers(pow(base, -1, 1 << 64), len(values) + 1)[begins]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(begins, ends, hashes, first token of each text) of the UTF-8 texts that lie one behind the other."""
    word = ((data >= 48) & (data <= 57)) | ((data >= 65) & (data <= 90)) | ((data >= 97) & (data <= 122)) | (data == 95) | (data >= 128)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    joined = np.zeros(len(data) + 1, dtype=bool)  # a word goes on over this border
    joined[1:-1] = word[1:] & word[:-1] if len(data) else False
    joined[offsets] = False
    begins = np.flatnonzero(~blank & ~joined[:-1])
    ends = np.flatnonzero(~blank & ~joined[1:]) + 1
    return begins, ends, _hashes(data, begins, ends, _TOKEN_BASE), np.searchsorted(begins, offsets)


def _runs(hashes: np.ndarray, size: int) -> np.ndarray:
    at = np.arange(max(0, len(hashes) - size + 1))
    return _hashes(hashes, at, at + size, _RUN_BASE)


def key_of(phrase: str) -> tuple[int, int, int]:
    """(run length, hash, characters before the second token) of a phrase as `plain` gives it; length 0 if it has no inner token."""
    raw = np.frombuffer(phrase.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    begins, ends, hashes, _ = tokens(raw, np.array([0, len(raw)]))
    size = next((r for r in RUNS if r <= len(begins) - 2), 0)
    return size, int(_runs(hashes, size)[1].view(np.int64)) if size else 0, len(raw[: ends[0]].tobytes().decode("utf-8", "replace")) if size else 0


class Phrase:
    """A phrase, and where it fits a text."""

    def __init__(self, item: str, text: str, loose: bool):
        self.item, self.loose = item, loose
        self.text = re.sub(r"\s+", " ", plain(text, True)).strip() if loose else text
        self.size, self.hash, self.first = key_of(self.text)

    @cached_property
    def pattern(self) -> re.Pattern[str]:
        """Of a loose phrase, once it meets a text: most phrases meet none in a task."""
        return re.compile(r"\s+".join(map(re.escape, self.text.split(" "))))

    def fits(self, text: str, start: int) -> tuple[int, int] | None:
        """Where it ends if it begins there; None otherwise, and behind the guard."""
        if start < 0:
            return None
        if not self.loose:
            return (start, start + len(self.text)) if text.startswith(self.text, start) else None
        found = self.pattern.match(text, start)
        return found.span() if found and text[max(0, start - len(GUARD)) : start] != GUARD else None

    def anywhere(self, text: str) -> Iterator[tuple[int, int]]:
        """Every place of a phrase that has no key."""
        at = [m.start() for m in re.finditer(f"(?={self.pattern.pattern})", text)] if self.loose else [m.start() for m in re.finditer(f"(?={re.escape(self.text)})", text)]
        return (span for span in (self.fits(text, i) for i in at) if span)


class Phrases:
    """Phrases by their keys, as sorted arrays."""

    def __init__(self, phrases: Iterable[Phrase]):
        keyed: dict[int, dict[int, list[Phrase]]] = {}
        self.short: list[Phrase] = []
        for p in phrases:
            if p.size:
                keyed.setdefault(p.size, {}).setdefault(p.hash, []).append(p)
            else:
                self.short.append(p)
        self.sizes = {size: (np.array(sorted(by), dtype=np.int64), [by[h] for h in sorted(by)]) for size, by in keyed.items()}

    def candidates(self, size: int, runs: np.ndarray) -> Iterator[tuple[int, list[Phrase]]]:
        keys, lists = self.sizes[size]
        at = np.minimum(np.searchsorted(keys, runs), len(keys) - 1)
        for i in np.flatnonzero(keys[at] == runs).tolist():
            yield i, lists[at[i]]


def _slices(texts: list[str]) -> Iterator[tuple[int, list[bytes]]]:
    """The texts as bytes, some at a time, with the number of the first."""
    first, part, size = 0, [], 0
    for i, t in enumerate(texts):
        raw = t.encode("utf-8", "surrogatepass")
        if part and size + len(raw) > SLICE_BYTES:
            yield first, part
            first, part, size = i, [], 0
        part.append(raw)
        size += len(raw)
    if part:
        yield first, part


def hits(texts: list[str], sizes: Iterable[int], meet) -> Iterator[tuple[int, int, object]]:
    """(text, character where the first token ends, what met) of every run that ``meet(size, runs)`` gives (place, what) for."""
    for first, part in _slices(texts):
        data, offsets = np.frombuffer(b"".join(part), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in part])]).astype(np.int64)
        begins, ends, hashes, heads = tokens(data, offsets)
        for size in sizes:
            for i, what in meet(size, _runs(hashes, size).view(np.int64)):
                at = int(np.searchsorted(heads, i, side="right")) - 1
                while heads[at + 1] <= i:
                    at += 1
                if i - 1 >= heads[at] and i + size < heads[at + 1]:  # a token before it, and one behind
                    yield first + at, len(part[at][: ends[i - 1] - offsets[at]].decode("utf-8", "surrogatepass")), what


def _settled(spans: set[tuple[int, int, str]], apart: bool) -> list[dict]:
    """In order of their place; ``apart``: the leftmost and of those the longest, without overlaps."""
    out, end = [], 0
    for start, finish, item in sorted(spans, key=lambda s: (s[0], -s[1], s[2])):
        if not apart or start >= end:
            out.append({"start": start, "finish": finish, "item": item})
            end = finish
    return out


# -- over tables --------------------------------------------------------------------------


def _texts(column: pa.Array) -> list[str | None]:
    return [None if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def _parts(column: pa.Array, loose: bool) -> Iterator[list[str]]:
    """The texts of a batch as they are searched, about ``SLICE_BYTES`` at a time: no more of them are held as strings."""
    raw = column.cast(pa.binary())
    part = np.cumsum(pc.fill_null(pc.binary_length(raw), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // SLICE_BYTES
    for a, b in pairwise([0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(raw)]):
        if b > a:
            yield [plain(t or "", loose) for t in _texts(raw.slice(a, b - a))]


def _joined(parts: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def _kind() -> pa.DataType:
    return pa.list_(pa.struct([("start", pa.int32()), ("finish", pa.int32()), ("item", pa.string())]))


def _finder(spark: SparkSession, phrases: Phrases, loose: bool, apart: bool):
    held = spark.sparkContext.broadcast(phrases)  # bounded, and read once by each worker, not by each task

    def spans_of(texts: list[str]) -> pa.Array:
        spans: dict[int, set[tuple[int, int, str]]] = {}
        known = held.value
        for row, first_end, met in hits(texts, known.sizes, known.candidates):
            for p in met:
                if span := p.fits(texts[row], first_end - p.first):
                    spans.setdefault(row, set()).add((*span, p.item))
        for p in known.short:
            for row, text in enumerate(texts):
                for span in p.anywhere(text):
                    spans.setdefault(row, set()).add((*span, p.item))
        return pa.array([_settled(spans[row], apart) if row in spans else [] for row in range(len(texts))], _kind())

    @arrow_udf(FOUND)
    def find(column: pa.Array) -> pa.Array:
        return _joined([spans_of(texts) for texts in _parts(column, loose)], _kind())

    return find.asNondeterministic()  # a filter on what is found must not search all texts a second time


def _keyed(entries: DataFrame, loose: bool) -> DataFrame:
    """(item, phrase, size, hash) of the entries (item_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            phrases = [Phrase(i, t, loose) for i, t in zip(batch["item"].to_pylist(), _texts(batch["phrase"]), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["item"], batch["phrase"], pa.array([p.size for p in phrases], pa.int32()), pa.array([p.hash for p in phrases], pa.int64())], names=["item", "phrase", "size", "hash"])

    some = entries.filter(F.col("item_id").isNotNull() & (F.trim("text") if loose else F.col("text")).__ne__("")).select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("phrase")).distinct()
    return some.mapInArrow(run, "item string, phrase string, size int, hash bigint")


def _screen(keyed: DataFrame, n: int) -> np.ndarray:
    """Of each value of the low bits of a hash, whether a phrase has it, as bits: 1 to 16 MB, however many phrases there are."""
    bits = min(MOST_BITS, max(SCREEN_BITS, (n * 64 - 1).bit_length()))
    bit, page = F.col("hash").bitwiseAND(F.lit((1 << bits) - 1)), F.lit((1 << PAGE_BITS) - 1)
    pages = keyed.filter("size > 0").groupBy(F.shiftright(bit, PAGE_BITS).alias("page")).agg(F.bitmap_construct_agg(bit.bitwiseAND(page)).alias("bits")).collect()
    out = np.zeros(1 << bits >> 3, dtype=np.uint8)
    for r in pages:
        out[r["page"] << PAGE_BITS >> 3 : (r["page"] + 1) << PAGE_BITS >> 3] = np.frombuffer(r["bits"], np.uint8)
    return out


def _by_join(docs: DataFrame, keyed: DataFrame, n: int, loose: bool, apart: bool, all_rows: bool) -> DataFrame:
    screen = docs.sparkSession.sparkContext.broadcast(_screen(keyed, n))  # of a bounded size
    sizes = [r["size"] for r in keyed.select("size").distinct().collect()]  # at most five
    runs = [s for s in sizes if s]
    short = [Phrase(r["item"], r["phrase"], loose) for r in keyed.filter("size = 0").limit(MOST_SHORT + 1).collect()] if 0 in sizes else []
    if len(short) > MOST_SHORT:
        raise ValueError("too many phrases of fewer than three tokens")

    kind = pa.list_(pa.struct([("size", pa.int32()), ("hash", pa.int64()), ("at", pa.int32())]))

    def candidates_of(texts: list[str]) -> pa.Array:
        bits = screen.value
        out: list[list[dict]] = [[] for _ in texts]

        def meet(size: int, found: np.ndarray) -> Iterator[tuple[int, dict]]:
            low = found & (len(bits) * 8 - 1)
            for i in np.flatnonzero(bits[low >> 3] >> (low & 7).astype(np.uint8) & 1).tolist():
                yield i, {"size": size, "hash": int(found[i])}

        for row, at, what in hits(texts, runs, meet):
            out[row].append({**what, "at": at})
        return pa.array(out, kind)

    @arrow_udf("array<struct<size:int,hash:bigint,at:int>>")
    def candidates(column: pa.Array) -> pa.Array:
        return _joined([candidates_of(texts) for texts in _parts(column, loose)], kind)

    @arrow_udf(FOUND)
    def verify(column: pa.Array, met: pa.Array) -> pa.Array:
        out = []
        for text, candidates in zip(_texts(column), met.to_pylist(), strict=True):
            text, spans = plain(text or "", loose), set()
            for c in candidates or ():
                p = Phrase(c["item"], c["phrase"], loose)
                if span := p.fits(text, c["at"] - p.first):
                    spans.add((*span, p.item))
            for p in short:
                spans.update((*span, p.item) for span in p.anywhere(text))
            out.append(_settled(spans, apart))
        return pa.array(out, _kind())

    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row_id"), candidates.asNondeterministic()(F.col("text").cast("string")).alias("candidates"))
    each = rows.select("doc", "row_id", F.explode("candidates").alias("c")).select("doc", "row_id", "c.*")
    met = each.join(keyed.filter("size > 0"), ["size", "hash"]).select("doc", "row_id", F.struct("item", "phrase", "at").alias("m"))
    whole = rows.select("doc", "row_id", F.lit(None).cast(met.schema["m"].dataType).alias("m"))
    some = met.union(whole) if short else met
    gathered = some.groupBy("row_id").agg(F.first("doc").alias("doc"), F.collect_list("m").alias("met"))  # of one document
    told = gathered.select("doc.*", verify(F.col("doc.text").cast("string"), F.col("met")).alias("found"))
    if short or not all_rows:
        return told.filter(F.size("found") > 0) if not all_rows else told
    lone = rows.join(met.select("row_id").distinct(), "row_id", "left_anti").select("doc.*", F.array().cast(FOUND).alias("found"))
    return told.union(lone)


def find_phrases(docs: DataFrame, entries: DataFrame, loose: bool = False, apart: bool = False, most: int | None = None, all_rows: bool = True) -> DataFrame:
    """``docs`` with ``found``: start, finish (code points) and item of every phrase of ``entries`` (item_id, text) in ``text``.

    A phrase is found as it is; ``loose``: whatever the case and the accents of its vowels, with
    any blanks between its parts, and not behind "decreto" and one space. ``apart``: of overlapping
    ones the leftmost and of those the longest. Null ids and null or empty (``loose``: blank) phrases
    are not sought, a phrase with several ids is found for each (``apart``: the first as text), null
    texts hold none and repeated rows stay repeated. Any number of phrases gives the same result.
    Without ``all_rows`` only rows that hold a phrase are given; the others are never shuffled then.
    """
    keyed = _keyed(entries, loose)
    n, size = keyed.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("phrase")), F.lit(0))).first()
    if n <= (MOST_PHRASES if most is None else most) and size <= MOST_BYTES:
        phrases = Phrases(Phrase(r["item"], r["phrase"], loose) for r in keyed.collect())
        found = docs.withColumn("found", _finder(docs.sparkSession, phrases, loose, apart)(F.col("text").cast("string")))
        return found if all_rows else found.filter(F.size("found") > 0)
    return _by_join(docs, keyed, n, loose, apart, all_rows)


def _split_key(key: str) -> tuple[Column, Column, Column]:
    """hash, head and month of a long citation as `citation_key` gives it; the head ends with a blank."""
    filled = lambda c: F.coalesce(c, F.lit(""))  # noqa: E731  else the joins' checks for nulls would work the keys out once more
    month = filled(F.substring_index(key, " ", -1))
    head = filled(F.substring(key, F.lit(1), F.length(key) - F.length(month)))
    return F.xxhash64(head).alias("hash"), head.alias("head"), month.alias("month")


def _screened(met: DataFrame, keyed: DataFrame, n: int) -> DataFrame:
    """``met`` without most rows whose hash no phrase of ``keyed`` has: pages of a bitmap of 1 to 16 MB are broadcast."""
    bits = min(MOST_BITS, max(SCREEN_BITS, (n * 64 - 1).bit_length()))
    bit, within = F.col("hash").bitwiseAND(F.lit((1 << bits) - 1)), F.lit((1 << PAGE_BITS) - 1)
    pages = keyed.groupBy(F.shiftright(bit, PAGE_BITS).alias("page")).agg(F.bitmap_construct_agg(bit.bitwiseAND(within)).alias("bits"))
    placed = met.withColumn("page", F.shiftright(bit, PAGE_BITS)).join(F.broadcast(pages), "page")  # a fixed number of pages
    place = bit.bitwiseAND(within)
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return placed.filter(byte.bitwiseAND(F.element_at(F.array(*(F.lit(1 << i) for i in range(8))), (place % 8).cast("int") + 1)) != 0).select(*met.columns)


def _spans(text: Column, met: Column) -> Column:
    """The found of a text from what it ``met`` (nth, size, item): offsets by the lengths of what lies between the first letters."""
    between = F.transform(F.array(F.split(text, _CITED, -1)), lambda pieces: F.transform(pieces, F.length))  # split once
    start = lambda lengths, m: F.aggregate(F.slice(lengths, F.lit(1), m["nth"] + 1), m["nth"], lambda s, x: s + x)
    spans = F.transform(between, lambda lengths: F.transform(met, lambda m: F.struct(start(lengths, m).alias("start"), (-m["size"]).alias("back"), m["item"].alias("item"))))
    found = lambda s: F.array(F.struct(s["start"].alias("start"), (s["start"] - s["back"]).alias("finish"), s["item"].alias("item")))
    begun = F.struct(F.lit(0).alias("end"), F.array().cast(FOUND).alias("out"))
    step = lambda a, s: F.when(s["start"] >= a["end"], F.struct((s["start"] - s["back"]).alias("end"), F.concat(a["out"], found(s)).alias("out"))).otherwise(a)
    return F.aggregate(F.array_sort(F.element_at(spans, 1)), begun, step, lambda a: a["out"])


def find_citations(docs: DataFrame, entries: DataFrame) -> DataFrame:
    """What `find_phrases` gives for ``entries`` (item_id, text) that are long citations as `citation_key` gives them: loose, apart and without rows that hold none.

    A pattern finds every place where such a citation may stand, up to its month. The heads meet those of
    the entries by equality, and the text's month must begin with the entry's. The entries are
    broadcast up to ``MOST_PHRASES``; with more, a bitmap leaves out most heads that no entry has before anything
    is shuffled.
    """
    some = entries.filter(F.col("item_id").isNotNull() & (F.trim("text") != "")).select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("phrase"))
    keyed = some.select("item", *_split_key("phrase")).groupBy("hash", "head", "month").agg(F.min("item").alias("item"))
    n = keyed.count()
    single = F.regexp_replace("raw", f"{_SPACE}+", " ")
    folded = F.when(F.length("raw") == F.octet_length("raw"), single).otherwise(F.translate(single, FOLD_FROM + "\u212a", FOLD_TO + "k"))  # ASCII as it is
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row_id"), F.regexp_extract_all(F.col("text").cast("string"), F.lit(_CITED), F.lit(1)).alias("raw"))
    each = rows.select("doc", "row_id", F.posexplode("raw").alias("nth", "raw"))
    keys = each.select("doc", "row_id", "nth", F.length("raw").alias("size"), F.lower(folded).alias("key"))
    asked = keys.select("doc", "row_id", "nth", "size", *_split_key("key"))
    if n <= MOST_PHRASES:
        held = F.broadcast(keyed)
    else:
        asked, held = _screened(asked, keyed, n), keyed.hint("merge")  # the size of a stored table says little of its rows
    a, b = asked.alias("a"), held.alias("b")
    met = a.join(b, (F.col("a.hash") == F.col("b.hash")) & (F.col("a.head") == F.col("b.head")) & F.startswith("a.month", "b.month"))
    told = met.groupBy("row_id").agg(F.first("doc").alias("doc"), F.collect_list(F.struct("nth", (F.col("size") - F.length("a.month") + F.length("b.month")).alias("size"), "item")).alias("met"))  # of one document
    return told.select("doc.*", _spans(F.col("doc.text").cast("string"), F.col("met")).alias("found"))


def items_of(found: Column) -> Column:
    """The different items of a ``found``, in order."""
    return F.array_sort(F.array_distinct(F.transform(found, lambda f: f["item"])))
