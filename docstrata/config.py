"""Configuration as data: lexicon, watchlist, relation verbs, clause patterns, versions.

Everything here is small and checked to be: it is folded into expressions as literals.
"""

from __future__ import annotations

from dataclasses import dataclass, field

#: Entries that may be folded into an expression at most; larger sets are joined as tables.
MOST_LITERALS = 2_000


@dataclass(frozen=True)
class Lexicon:
    """Terms of the lexical axis, normalised. Direct terms decide; context terms only accompany."""

    direct: tuple[str, ...]
    context: tuple[str, ...]
    version: str

    def __post_init__(self) -> None:
        terms = [*self.direct, *self.context]
        if not self.direct or len(set(terms)) != len(terms) or len(terms) > MOST_LITERALS:
            raise ValueError("a lexicon has direct terms, no repeated ones, and a bounded number")

    @property
    def terms(self) -> tuple[str, ...]:
        return (*self.direct, *self.context)


@dataclass(frozen=True)
class Watched:
    """One entry of the watchlist: what is cited, and how specific it is."""

    identifier: str
    title: str
    scope: str = ""
    specific: bool = True
    in_force: bool = True
    kind: str | None = None


@dataclass(frozen=True)
class ClausePattern:
    """A construction that must share its sentence with a companion."""

    name: str
    construction: str
    companion: str


@dataclass(frozen=True)
class Versions:
    """Bumping one puts exactly the rows that it makes stale back into the queues."""

    lexicon: str = "2026.1"
    watchlist: str = "2026.1"
    text: str = "2026.1"
    rules: str = "2026.1"


#: Words that stand in for a vocabulary over the synthetic documents.
LEXICON = Lexicon(
    direct=("para", "los", "por", "dans", "elle", "pour", "nicht", "fur", "und"),
    context=("the", "with", "que"),
    version="2026.1",
)

#: How often a direct term must be found for a text to be relevant without a citation.
MANY_DIRECT = 8

#: Inflected forms of relation verbs and what they mean; the first that fits counts.
VERB_FORMS = (
    ("is repealed", "REPEALS"),
    ("are repealed", "REPEALS"),
    ("repeals", "REPEALS"),
    ("is replaced", "REPLACES"),
    ("replaces", "REPLACES"),
    ("is amended", "AMENDS"),
    ("are amended", "AMENDS"),
    ("amends", "AMENDS"),
    ("is suppressed", "SUPPRESSES"),
    ("suppresses", "SUPPRESSES"),
    ("is added", "ADDS"),
    ("adds", "ADDS"),
    ("licensed under", "LICENSES"),
    ("released under", "LICENSES"),
)
CITES = "CITES"
MODIFYING = ("REPEALS", "REPLACES", "AMENDS", "SUPPRESSES", "ADDS")

LICENSE = ClausePattern("license", r"\b(?:released|licensed)\s+under\b", r"\bversion\s+\d|\bMIT\b|\bApache\b")
SECRET = ClausePattern("secret", r"\b(?:password|token|secret)\s*[:=]", r"\d")
CODE = ClausePattern("shouted", r"!!", r"[A-Z]{3,}")


@dataclass(frozen=True)
class Settings:
    """Bounds of the services, in one place."""

    page: int = 20
    most_page: int = 100
    batch: int = 500
    shown_characters: int = 700
    model_characters: int = 4_000
    feed_entries: int = 50
    versions: Versions = field(default_factory=Versions)


SETTINGS = Settings()
