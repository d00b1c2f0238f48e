"""Dates as they are printed; whatever is not a date is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docstrata.functions.text import collapse, fold

#: Month names, in order. Fixed values; setiembre is another form of septiembre.
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")


def compact_date(text: Column) -> Column:
    """yyyyMMdd."""
    return F.when(text.rlike(r"^\d{8}\z"), F.try_to_date(text, "yyyyMMdd"))


def iso_date(text: Column) -> Column:
    """yyyy-MM-dd."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}\z"), F.try_to_date(text, "yyyy-MM-dd"))


def long_date(text: Column) -> Column:
    """Such as ``9 de enero de 2024``."""
    clean = F.replace(F.lower(fold(collapse(text))), F.lit("setiembre"), F.lit("septiembre"))
    part = lambda i: F.regexp_extract(clean, r"^(\d{1,2}) de ([a-z]+) de (\d{4})$", i)
    month = F.array_position(F.array(*(F.lit(m) for m in MONTHS)), part(2))
    written = F.concat(part(3), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(part(1), 2, "0"))
    return F.when(month > 0, F.try_to_date(written, "yyyy-MM-dd"))


def any_date(text: Column) -> Column:
    return F.coalesce(compact_date(text), iso_date(text), long_date(text))


def long_form(date: Column) -> Column:
    """The way back: 2024-01-09 as ``9 de enero de 2024``."""
    months = F.array(*(F.lit(m) for m in MONTHS))
    return F.concat(F.dayofmonth(date).cast("string"), F.lit(" de "), F.element_at(months, F.month(date)), F.lit(" de "), F.year(date).cast("string"))


def day_range(first: Column, last: Column) -> Column:
    """Every day from first to last; no days if they are the wrong way round."""
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<date>"))
