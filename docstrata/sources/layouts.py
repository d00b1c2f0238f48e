"""Texts of XML bodies in the layouts of six sources, by one event-driven walk.

No tree is built: a walk keeps the path of open elements and what each layout would take, within
bounds of bytes, depth and elements. A document type, an entity or an external reference
refuses the body, as does what is not well-formed.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of what is parsed at all.
MOST_BYTES, MOST_DEPTH, MOST_ELEMENTS = 20 * 1024 * 1024, 100, 500_000
#: The namespace and the names of the layouts' elements.
AKN = "http://docs.oasis-open.org/legaldocml/ns/akn/3.0"
PATHS = {
    "text": ("texto",),
    "act": (f"{AKN} act", f"{AKN} body"),
    "register": ("registro", "texto"),
    "content": ("contenido", "texto"),
}
ATTRIBUTE = (f"{AKN} content", "period")
SIBLINGS = ("DOCUMENTO", "BOPVOrden")
METADATA = frozenset({"BOPVSeccion", "BOPVSubseccion", "BOPVOrganismo", "BOPVOrden", "BOPVTitulo"})


class Refused(Exception):
    """Why a body is not read: size, depth, elements, declaration or malformed."""


class Walk:
    """One pass over a body: the first element of each path, escaped attributes, siblings, and everything."""

    def __init__(self) -> None:
        self.path: list[str] = []
        self.elements = 0
        self.taken: dict[str, list[str] | None] = dict.fromkeys(PATHS)
        self.open: str | None = None  # the layout whose element is being read
        self.attributes: list[str] = []
        self.siblings: list[str] = []
        self.numbered = False
        self.everything: list[str] = []

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        self.path.append(tag)
        self.elements += 1
        if len(self.path) > MOST_DEPTH:
            raise Refused("depth")
        if self.elements > MOST_ELEMENTS:
            raise Refused("elements")
        if tag == ATTRIBUTE[0] and attributes.get(ATTRIBUTE[1]):
            self.attributes.append(attributes[ATTRIBUTE[1]])
        self.numbered |= tuple(self.path) == SIBLINGS
        if self.open is None:
            below = tuple(self.path[1:])
            for layout, wanted in PATHS.items():
                if below == wanted and self.taken[layout] is None:
                    self.taken[layout], self.open = [], layout

    def end(self, tag: str) -> None:
        if self.open and len(self.path) == 1 + len(PATHS[self.open]):
            self.open = None
        self.path.pop()

    def data(self, text: str) -> None:
        if part := text.strip():
            self.everything.append(part)
            if self.open:
                self.taken[self.open].append(part)
            if len(self.path) > 1 and self.path[0] == SIBLINGS[0] and self.path[1] not in METADATA:
                self.siblings.append(part)

    def refuse(self, *_: object) -> None:
        raise Refused("declaration")

    def result(self) -> tuple[str, str]:
        """(layout, text): escaped markup in attributes, the first of the paths that is there, siblings, or everything."""
        if self.attributes:
            shown = re.sub(r"<[^>]*>", " ", html.unescape(html.unescape(" ".join(self.attributes))))
            if text := re.sub(r"\s+", " ", shown).strip():
                return "attribute", text
        for layout, parts in self.taken.items():
            if parts is not None:
                return layout, " ".join(parts)
        if self.numbered and self.siblings:
            return "siblings", " ".join(self.siblings)
        return "everything", " ".join(self.everything)


def walked(content: bytes) -> tuple[str, str]:
    """(layout, text) of one body; `Refused` otherwise."""
    if len(content) > MOST_BYTES:
        raise Refused("size")
    walk, parser = Walk(), expat.ParserCreate(namespace_separator=" ")
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = walk.start, walk.end, walk.data
    parser.StartDoctypeDeclHandler = parser.EntityDeclHandler = parser.ExternalEntityRefHandler = walk.refuse
    try:
        parser.Parse(content.lstrip(), True)
    except expat.ExpatError as e:
        raise Refused("malformed") from e
    return walk.result()


def layout_texts(raw: DataFrame) -> DataFrame:
    """(key, layout, text, refused) of (key, content), text or bytes.

    The layout is ``attribute`` (escaped markup in attributes of an act's contents), ``text``,
    ``act``, ``register``, ``content`` (paths below the root), ``siblings`` (all that is not
    metadata) or ``everything``. The first that is there counts, also if its element is
    empty. A body that is not read has only the reason in ``refused``; null content has nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[str | None, str | None, str | None]] = []
            for content in batch["content"]:
                try:
                    found.append((None, None, None) if content.as_py() is None else (*walked(content.as_py()), None))
                except Refused as why:
                    found.append((None, None, str(why)))
            yield pa.RecordBatch.from_arrays([batch["key"], *(pa.array([f[i] for f in found], pa.string()) for i in range(3))], names=["key", "layout", "text", "refused"])

    kind = dict(raw.dtypes)["key"]
    return raw.select("key", F.col("content").cast("binary").alias("content")).mapInArrow(run, f"key {kind}, layout string, text string, refused string")
