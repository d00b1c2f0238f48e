"""Identifiers, addresses and digests."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whole-text patterns by kind of identifier. Fixed values.
PATTERNS = {
    "watched": r"^[A-Z]{2,6}-[A-Za-z]-\d{4}-\d{1,7}\z",
    "state": r"^[A-Z]{3}-[A-Z]-\d{4}-\d{1,7}\z",
    "control": r"^\d{6,10}\z",
    "dated": r"^[A-Z]{3,5}-\d{8}(?:-\d{1,4})?\z",
    "order": r"^\d{1,5}\z",
    "sha256": r"^[0-9a-f]{64}\z",
}
#: File endings that an archive accepts. Fixed values.
ENDINGS = (".xml", ".html", ".json", ".pdf", ".txt")


def valid_identifier(text: Column, kind: str) -> Column:
    """Whether the whole text is such an identifier; false for null."""
    return F.coalesce(text.rlike(PATTERNS[kind]), F.lit(False))


def composed(prefix: str, date: Column, number: Column, width: int = 4) -> Column:
    """PREFIX-yyyyMMdd-000n."""
    return F.concat(F.lit(prefix + "-"), F.date_format(date, "yyyyMMdd"), F.lit("-"), F.lpad(number.cast("string"), width, "0"))


def storage_path(digest: Column, ending: str) -> Column:
    """Where content with this SHA-256 lies: ab/cd/<digest><ending>."""
    if ending not in ENDINGS:
        raise ValueError(f"{ending} is not accepted: {', '.join(ENDINGS)}")
    path = F.concat(F.substring(digest, 1, 2), F.lit("/"), F.substring(digest, 3, 2), F.lit("/"), digest, F.lit(ending))
    return F.when(valid_identifier(digest, "sha256"), path)


def alternate_url(url: Column, ending: str = ".xml", other: str = ".pdf") -> Column:
    """The address with another ending; null if it has not the first."""
    return F.when(F.endswith(url, F.lit(ending)), F.concat(F.substring(url, F.lit(1), F.length(url) - len(ending)), F.lit(other)))


def keyed_hash(address: Column, key: str) -> Column:
    """HMAC-SHA256 of an address in lower case; refuses an empty key. Arrow batches, as Spark has no HMAC."""
    if not key:
        raise ValueError("a key is needed")
    secret = key.encode()

    @F.pandas_udf("string")
    def digest(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else hmac.new(secret, v.strip().lower().encode(), hashlib.sha256).hexdigest())

    return digest(address)


def opaque_token() -> Column:
    """A random token; not deterministic."""
    return F.replace(F.concat(F.uuid(), F.uuid()), F.lit("-"), F.lit(""))
