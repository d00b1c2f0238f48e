"""Text functions as column expressions: they stay inside Spark's generated code."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that `normalise` strips of their accents: Latin-1 supplement to Latin extended B.
_LETTERS = range(0xC0, 0x250)
_TILDE = "\u0303"


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """(from, to): small letters without their marks; a tilde stays, as ñ is a letter of its own."""
    source, target = [], []
    for code in _LETTERS:
        letter = chr(code)
        bare = "".join(c for c in unicodedata.normalize("NFD", letter) if unicodedata.category(c) != "Mn" or c == _TILDE)
        bare = unicodedata.normalize("NFC", bare)
        if len(bare) == 1 and bare != letter:
            source.append(letter)
            target.append(bare)
    return "".join(source), "".join(target)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it.

    Branches of a condition are not known to share what they compute; an array's element is.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


#: ASCII characters that are neither small letters nor digits, but the space.
_SEPARATORS = "".join(chr(c) for c in range(128) if not chr(c).isdigit() and not "a" <= chr(c) <= "z" and chr(c) != " ")


def normalise(text: Column) -> Column:
    """Lower case without accents, but ñ; every run of other characters is one space.

    Plain replacements do most of the work, and the one pattern is a single range, as both
    are many times faster than a class of several: ñ stands as ~ meanwhile, which no text
    holds once its separators are spaces.
    """
    plain = bound(F.lower(text), lambda low: F.when(low.rlike("[^\\x00-\\x7F]"), _without_accents(low)).otherwise(low))
    spaced = F.translate(plain, _SEPARATORS + "ñ", " " * len(_SEPARATORS) + "~")
    known = F.regexp_replace(spaced, "[^ -~]+", " ")
    for run in ("    ", "  ", "  "):
        known = F.replace(known, F.lit(run), F.lit(" "))
    known = bound(known, lambda t: F.when(F.contains(t, F.lit("  ")), F.regexp_replace(t, " +", " ")).otherwise(t))
    return F.translate(F.trim(known), "~", "ñ")


def _without_accents(low: Column) -> Column:
    composed = F.regexp_replace(low, "n" + _TILDE, "ñ")
    composed = F.regexp_replace(composed, f"[aeiouvy]{_TILDE}", " ")  # ã, õ and the like are no letters here
    plain = F.regexp_replace(composed, r"[\u0300-\u0302\u0304-\u036F]", "")
    return F.translate(plain, *_accent_table())


def contains_term(normalised: Column, term: Column) -> Column:
    """Whether a normalised text holds a normalised term as whole words."""
    padded = F.concat(F.lit(" "), normalised, F.lit(" "))
    return F.contains(padded, F.concat(F.lit(" "), term, F.lit(" ")))


def terms_present(normalised: Column, terms: list[str]) -> Column:
    """The terms that occur, in the order of the lexicon; presence, not counts."""
    padded = F.concat(F.lit(" "), normalised, F.lit(" "))
    return bound(padded, lambda p: F.array_compact(F.array(*(F.when(F.contains(p, F.lit(f" {t} ")), F.lit(t)) for t in terms))))


def only_context(found: Column, context: list[str]) -> Column:
    """Whether there are terms, and all of them are context terms."""
    return (F.size(found) > 0) & (F.size(F.array_except(found, F.array(*(F.lit(t) for t in context)))) == 0)


#: Letters and their bare forms, one for one, so that offsets hold. Fixed values.
FOLD_FROM, FOLD_TO = "áéíóúüñÁÉÍÓÚÜÑ", "aeiouunAEIOUUN"


def fold(text: Column) -> Column:
    """Accents off without changing length or case; ñ becomes n."""
    return F.translate(text, FOLD_FROM, FOLD_TO)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def citation_key(text: Column) -> Column:
    """Key of a citation: folded, lower case, single spaces."""
    return collapse(F.lower(fold(text)))


def verb_key(verb: Column) -> Column:
    """Key of a relation verb: upper case, folded, single spaces."""
    return collapse(fold(F.upper(verb)))


def long_citation(title: Column) -> Column:
    """The citation at the start of a title, such as ``ley 4/2020, de 3 de mayo``; null without one."""
    pattern = r"(?i)^((?:ley organica|ley foral|ley|real decreto|decreto)\s+[\d/]+,\s+de\s+\d+\s+de\s+[a-z]+)"
    return F.nullif(F.regexp_extract(fold(title), pattern, 1), F.lit(""))


def citable(title: Column) -> Column:
    """Whether a number such as 4/2020 stands before the first comma, within 60 characters."""
    return F.coalesce(title.rlike(r"^[^,]{0,60}?\b\d{1,4}/\d{4}\b"), F.lit(False))


def cut_with_flag(text: Column, most: int) -> Column:
    """Struct (text, cut): the first ``most`` characters, marked where some are missing."""
    long = F.length(text) > most
    shown = F.when(long, F.concat(F.rtrim(F.substring(text, 1, most)), F.lit(" […]"))).otherwise(text)
    return F.struct(shown.alias("text"), F.coalesce(long, F.lit(False)).alias("cut"))


def around(text: Column, start: Column, end: Column, margin: int) -> Column:
    """The passage from start to end (0-based) with a margin on both sides, trimmed."""
    first = F.greatest(F.lit(0), start - margin)
    return F.trim(F.substring(text, (first + 1).cast("int"), (end + margin - first).cast("int")))


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, r"<[^>]*>", " ")


#: Entities of markup, and what they stand for. Fixed values; &amp; comes last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def unescape(text: Column) -> Column:
    for entity, character in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    return text


def precept_numbers(text: Column) -> Column:
    """Arabic numbers of up to four digits and Roman ones, as they stand."""
    return F.regexp_extract_all(text, F.lit(r"\b(?:\d{1,4}|[IVXLC]{1,7})\b"), F.lit(0))


def outer_json(text: Column) -> Column:
    """From the first { to the last }; null without them."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def delimited(text: Column, open_mark: str = "<<<", close_mark: str = ">>>") -> Column:
    """Text between marks, with the marks inside it broken up."""
    inner = F.replace(F.replace(text, F.lit(open_mark), F.lit(" ".join(open_mark))), F.lit(close_mark), F.lit(" ".join(close_mark)))
    return F.concat(F.lit(open_mark + "\n"), inner, F.lit("\n" + close_mark))


def short_hash(digest: Column) -> Column:
    """First eight and last six characters."""
    return F.concat(F.substring(digest, 1, 8), F.lit("…"), F.right(digest, F.lit(6)))


def decoded(content: Column, charset: str = "UTF-8") -> Column:
    """Bytes as text; what can't be decoded becomes U+FFFD."""
    return F.decode(content, charset) if charset.upper() != "UTF-8" else F.make_valid_utf8(content.cast("string"))


def sniffed_format(content: Column) -> Column:
    """pdf, html, xml or other, by the first bytes; blanks may precede the markup."""
    start = F.lower(F.ltrim(F.make_valid_utf8(F.substring(content, 1, 256).cast("string")), F.lit(" \t\r\n\ufeff")))
    return (
        F.when(F.substring(content, 1, 5).cast("string") == "%PDF-", "pdf")
        .when(start.startswith("<!doctype html") | start.startswith("<html"), "html")
        .when(start.startswith("<"), "xml")
        .otherwise("other")
    )
