"""Daily summaries that are pages: one walk in document order, with what holds and what is used up."""

from __future__ import annotations

import datetime
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

#: Items of one day's page, characters of a title.
MOST_ITEMS, MOST_TITLE = 300, 2000
#: What the page's elements look like, and the name of a document's file.
PARTS = {
    "section": r"<h3[^>]*>(.*?)</h3>",
    "organ": r'<h5[^>]*class="encabezado6"[^>]*>(.*?)</h5>',
    "title": r"<p>([^<]{10,}?)</p>",
    "link": r"BOCYL-D-(\d{8}-\d+)\.pdf",
}
IDENTIFIER = "BOCYL-D-"
#: Rows that are handed back together, whole pages; a page's own batch costs more than its walk.
MOST_ROWS = 10_000
_PART = re.compile("|".join(PARTS.values()), re.DOTALL | re.IGNORECASE)
_KINDS = (None, *PARTS)
_TAG = re.compile(r"<[^>]+>")

ROWS = "day date, place int, identifier string, title string, section string, organ string, state string"
ARROW = pa.schema([("day", pa.date32()), ("place", pa.int32()), *((n, pa.string()) for n in ("identifier", "title", "section", "organ", "state"))])


def plain(markup: str) -> str:
    """Markup as one line of text."""
    shown = _TAG.sub(" ", markup) if "<" in markup else markup
    return " ".join((html.unescape(shown) if "&" in shown else shown).split())


@dataclass
class Page:
    """What a walk over one page holds: headings until the next of their kind, a title until an item takes it."""

    day: str
    section: str | None = None
    organ: str | None = None
    title: str | None = None
    items: dict[str, tuple[str, str | None, str | None]] = field(default_factory=dict)
    untitled: dict[str, tuple[str | None, str | None]] = field(default_factory=dict)

    def part(self, kind: str, value: str) -> None:
        if kind != "link":
            setattr(self, kind, plain(value) or None)
        elif value.startswith(self.day):
            self.item(IDENTIFIER + value)

    def item(self, identifier: str) -> None:
        if identifier in self.items:
            return
        if self.title is None:
            self.untitled.setdefault(identifier, (self.section, self.organ))
            return
        self.items[identifier] = (self.title[:MOST_TITLE], self.section, self.organ)
        self.title = None

    def rows(self) -> Iterator[tuple[str | None, str | None, str | None, str | None, str]]:
        if len(self.items) > MOST_ITEMS:
            yield None, None, None, None, "too many"
            return
        for identifier, (title, section, organ) in self.items.items():
            yield identifier, title, section, organ, "good"
        for identifier, (section, organ) in self.untitled.items():
            if identifier not in self.items:
                yield identifier, None, section, organ, "untitled"


def page_rows(day: datetime.date | None, content: str | None) -> list[tuple]:
    """The rows of one page: place and the fields of an item."""
    if day is None or content is None:
        return []
    page = Page(f"{day.day:02d}{day.month:02d}{day.year:04d}-")
    for found in _PART.finditer(content):
        kind, value = _KINDS[found.lastindex], found[found.lastindex]
        if kind != "link" or value.startswith(page.day):  # most links repeat or are of other days
            page.part(kind, value)
    return [(day, i, *row) for i, row in enumerate(page.rows())]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)


def page_items(raw: DataFrame) -> DataFrame:
    """(day, place, identifier, title, section, organ, state) of summary pages (day, content).

    Links name documents by their day; those of other days are not items. Of an identifier that
    repeats, the first with a title counts. Headings hold for all items after them, a title for
    the next item alone. ``state`` is good, untitled (an item that no title was left for), or
    "too many" in place of all items of a page with over ``MOST_ITEMS``: nothing is cut silently.
    A page without items of its day, or a null day or content, gives no rows. Nothing is shuffled.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for day, content in zip(batch.column("day").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows += page_rows(day, content)
                if len(rows) >= MOST_ROWS:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    return raw.select("day", "content").mapInArrow(scan, ROWS)
