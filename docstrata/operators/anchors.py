"""Anchoring of quotations: where in a text a quoted passage stands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_anchor(text: Column, quote: Column) -> Column:
    """Struct (start, finish, fragment) of the first exact occurrence, or null."""
    at = F.call_function("instr", text, quote)
    found = F.struct((at - 1).alias("start"), (at - 1 + F.length(quote)).alias("finish"), quote.alias("fragment"))
    return F.when((at > 0) & (F.length(quote) > 0), found)


def collapsed_anchor(text: Column, quote: Column) -> Column:
    """The same for a quote whose blanks differ from the text's.

    Word by word: the quote's words joined by any blanks are looked for, and code points are
    counted in what stands before the match, so the offsets are those of the text itself.
    """
    words = F.filter(F.split(F.trim(quote), r"\s+"), lambda w: w != "")
    literal = F.transform(words, lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    pattern = F.array_join(literal, "\\s+")
    piece = F.call_function("regexp_substr", text, pattern)
    start = F.call_function("instr", text, piece) - 1
    found = F.struct(start.alias("start"), (start + F.length(piece)).alias("finish"), piece.alias("fragment"))
    return F.when((F.size(words) > 0) & piece.isNotNull(), found)


def anchored(text: Column, quote: Column, offset: Column | None = None) -> Column:
    """Exactly if possible, else with blanks collapsed; ``offset`` shifts the result."""
    found = F.coalesce(exact_anchor(text, quote), collapsed_anchor(text, quote))
    if offset is None:
        return found
    return F.when(found.isNotNull(), F.struct((found["start"] + offset).alias("start"), (found["finish"] + offset).alias("finish"), found["fragment"].alias("fragment")))
