"""Fields out of HTML, in Arrow batches.

Void elements hold nothing, an end tag closes the nearest open element of its name together with
everything inside it, and an end tag without a partner is ignored. Script and style text is not
part of the text of an element. Cards and details are read in one pass over the tags; links and
headings come from a small tree.

The pass takes tags in plain spelling by one expression each, which is several times as fast as the
parser. A document with anything else (comments, bare signs, unquoted values) goes to the parser.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from html import parser, unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from listweave.schemas import CARD, DETAIL, HEADINGS, LINK

# The code of this module travels with the tasks, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Elements that have no content.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
UNREAD = frozenset(["script", "style", "template"])

# A tag in plain spelling with the text behind it, which void elements without attributes may part,
# and the attributes of such a tag.
BLANK = r"[ \t\n\r\f]"
PLAIN_VOID = re.compile(rf"<(?i:{'|'.join(sorted(VOID))}){BLANK}*/?>")
PLAIN_TAG = re.compile(
    rf'''<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:{BLANK}+[a-zA-Z][-a-zA-Z0-9_]*(?:="[^"<>]*")?)*)'''
    rf'''{BLANK}*(/?)>([^<]*(?:{PLAIN_VOID.pattern}[^<]*)*)'''
)
PLAIN_ATTR = re.compile(r'''([a-zA-Z][-a-zA-Z0-9_]*)(?:="([^"]*)")?''')
# Elements whose text the parser takes as it stands, and what ends that text or looks like it.
RAW = frozenset(["script", "style"])
RAW_END = re.compile(r"<!|</?\s*(?:script|style)[^>]*>?", re.IGNORECASE)
# Elements that only some versions of the parser take so.
SOMETIMES_RAW = frozenset(
    "iframe noembed noframes noscript plaintext textarea title xmp".split()
)
unescape_value = getattr(parser, "_unescape_attrvalue", unescape)


class Element:
    __slots__ = ("name", "attrs", "children")

    def __init__(self, name: str, attrs: dict[str, str]) -> None:
        self.name = name
        self.attrs = attrs
        self.children: list[Element | str] = []

    def below(self) -> Iterator["Element"]:
        """Descendants in document order."""
        pending = [iter(self.children)]
        while pending:
            child = next(pending[-1], None)
            if child is None:
                pending.pop()
            elif isinstance(child, Element):
                yield child
                pending.append(iter(child.children))

    def first(self, name: str = "", classes: tuple[str, ...] = (), attr: str = ""):
        """First descendant with the name, one of the classes and the attribute."""
        return next(self.every(name, classes, attr), None)

    def every(self, name: str = "", classes: tuple[str, ...] = (), attr: str = ""):
        for element in self.below():
            if name and element.name != name:
                continue
            if attr and attr not in element.attrs:
                continue
            if classes and not set(classes) & set(element.attrs.get("class", "").split()):
                continue
            yield element

    def text(self, between: str = "") -> str:
        """Text nodes, each stripped, blank ones dropped."""
        parts: list[str] = []
        pending = [iter(self.children)]
        while pending:
            child = next(pending[-1], None)
            if child is None:
                pending.pop()
            elif isinstance(child, str):
                if child.strip():
                    parts.append(child.strip())
            elif child.name not in UNREAD:
                pending.append(iter(child.children))
        return between.join(parts)


class _TreeBuilder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open = [Element("", {})]
        self.pieces: list[str] = []

    def _flush(self) -> None:
        if self.pieces:
            self.open[-1].children.append("".join(self.pieces))
            self.pieces = []

    def handle_starttag(self, tag, attrs):
        if self.pieces:
            self._flush()
        named: dict[str, str] = {}
        for key, value in attrs:
            named[key] = value or ""
        element = Element(tag, named)
        self.open[-1].children.append(element)
        if tag not in VOID:
            self.open.append(element)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._flush()
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].name == tag:
                del self.open[depth:]
                return

    def handle_data(self, data):
        self.pieces.append(data)

    def handle_comment(self, data):
        self._flush()


def tree(html: str | None) -> Element:
    builder = _TreeBuilder()
    builder.feed(html or "")
    builder.close()
    builder._flush()
    return builder.open[0]


def _text_of(element: Element | None, between: str = "") -> str:
    return "" if element is None else element.text(between)


def _attr_of(element: Element | None, name: str) -> str:
    return "" if element is None else element.attrs.get(name, "")


# Attribute and class names that mark the fields of a card.
CARD_KEY = "data-entity-urn"
CARD_TITLE = ("base-search-card__title",)
CARD_COMPANY = ("base-search-card__subtitle",)
CARD_LOCATION = ("job-search-card__location",)
CARD_LINK = ("base-card__full-link",)

# Class names that mark the fields of a detail page.
DETAIL_TEXT = ("show-more-less-html__markup",)
CRITERION = ("description__job-criteria-item",)
CRITERION_CLASSES = frozenset(CRITERION)
CRITERION_HEADER = ("description__job-criteria-subheader",)
CRITERION_VALUE = (
    "description__job-criteria-text--criteria",
    "description__job-criteria-text",
)
APPLICANTS = (
    "num-applicants__caption",
    "num-applicants__caption--reached-applicant-limit",
)
WORKPLACE = (
    "workplace-type",
    "jobs-unified-top-card__workplace-type",
)


class _Captured:
    """Text of an element that is read while it is open."""

    __slots__ = ("depth", "hidden", "parts", "between")

    def __init__(self, depth: int, hidden: int, between: str) -> None:
        self.depth = depth
        self.hidden = hidden
        self.parts: list[str] = []
        self.between = between

    def text(self) -> str:
        return self.between.join(self.parts)


class _Scope:
    """An open element and the fields that are still to be found inside it."""

    __slots__ = ("depth", "wanted", "found")

    def __init__(self, depth: int, wanted: dict) -> None:
        self.depth = depth
        self.wanted = dict(wanted)
        self.found: dict[str, str | _Captured] = {}

    def value(self, name: str) -> str | None:
        value = self.found.get(name)
        return value.text() if isinstance(value, _Captured) else value


class _Reader(HTMLParser):
    """Fields of a document in one pass over its tags, with the closing rules of :func:`tree`.

    A wanted field is (tag or "", class names or (), attribute or None for the text, text between
    pieces); the first element that fits gives it.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.hidden = 0
        self.reading: list[_Captured] = []
        self.scopes: list[_Scope] = []
        self.pieces: list[str] = []

    def opened(self, depth: int, tag: str, attrs: dict[str, str], names) -> None:
        """What a new element means; its own scopes are added after the scopes it is in."""
        raise NotImplementedError

    def look(self, scope: _Scope, depth: int, tag: str, attrs: dict, names) -> None:
        for field, (wanted_tag, classes, attr, between) in [*scope.wanted.items()]:
            if wanted_tag and wanted_tag != tag or classes and not any(c in names for c in classes):
                continue
            del scope.wanted[field]
            if attr is not None:
                scope.found[field] = attrs.get(attr, "")
            else:
                captured = _Captured(depth, self.hidden + (tag in UNREAD), between)
                scope.found[field] = captured
                if tag not in VOID:
                    self.reading.append(captured)

    def _flush(self) -> None:
        if self.pieces:
            piece = "".join(self.pieces).strip() if self.reading else ""
            self.pieces.clear()
            if piece:
                for captured in self.reading:
                    if captured.hidden == self.hidden:
                        captured.parts.append(piece)

    def handle_starttag(self, tag, attrs):
        if self.pieces:
            self._flush()
        named = {key: value or "" for key, value in attrs} if attrs else {}
        depth = len(self.open) + 1
        self.opened(depth, tag, named, set(named["class"].split()) if "class" in named else ())
        if tag not in VOID:
            self.open.append(tag)
            self.hidden += tag in UNREAD
        elif self.scopes and self.scopes[-1].depth >= depth:
            self.scopes = [s for s in self.scopes if s.depth < depth]

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.pieces:
            self._flush()
        if tag not in self.open:
            return
        for depth in range(len(self.open), 0, -1):
            name = self.open.pop()
            if name in UNREAD:
                self.hidden -= 1
            if name == tag:
                # Depths grow along both lists.
                if self.reading and self.reading[-1].depth >= depth:
                    self.reading = [c for c in self.reading if c.depth < depth]
                if self.scopes and self.scopes[-1].depth >= depth:
                    self.scopes = [s for s in self.scopes if s.depth < depth]
                return

    def handle_data(self, data):
        self.pieces.append(data)

    def handle_comment(self, data):
        self._flush()

    def _read_plain(self, html: str) -> bool:
        """Whether all tags are in plain spelling; if so, they have been handled."""
        at = html.find("<")
        size = len(html)
        # Nothing is open before the first tag, so nothing reads the text before it.
        while 0 <= at < size:
            found = PLAIN_TAG.match(html, at)
            if found is None:
                return False
            ends, tag, attrs, closed, text = found.groups()
            tag = tag.lower()
            at = found.end()
            if ends:
                if attrs or closed:
                    return False
                self.handle_endtag(tag)
            elif attrs or tag not in VOID:
                if tag in SOMETIMES_RAW or closed and tag in RAW:
                    return False
                named = [(k.lower(), v) for k, v in PLAIN_ATTR.findall(attrs)] if attrs else []
                if "&" in attrs:
                    named = [(k, unescape_value(v)) for k, v in named]
                if closed:
                    self.handle_startendtag(tag, named)
                else:
                    self.handle_starttag(tag, named)
                    if tag in RAW:
                        end = RAW_END.search(html, found.start(5))
                        if end is None or end[0].lower() != f"</{tag}>":
                            return False
                        self.handle_data(html[found.start(5) : end.start()])
                        at = end.start()
                        continue
            # No field is looked for in a void element without attributes; it only parts texts.
            if text and self.reading:
                for piece in PLAIN_VOID.split(text) if "<" in text else (text,):
                    self.pieces.append(unescape(piece) if "&" in piece else piece)
                    self._flush()
        return True

    def read(self, html: str | None):
        if not self._read_plain(html or ""):
            self.__init__()
            self.feed(html)
            self.close()
            self._flush()
        return self


CARD_FIELDS = {
    "title": ("h3", CARD_TITLE, None, ""),
    "company": ("h4", CARD_COMPANY, None, ""),
    "location": ("", CARD_LOCATION, None, ""),
    "publish_time": ("time", (), "datetime", ""),
    "url": ("a", CARD_LINK, "href", ""),
}
DETAIL_FIELDS = {
    "description": ("", DETAIL_TEXT, None, "\n"),
    "applicant_count": ("", APPLICANTS, None, ""),
    "workplace_badge": ("", WORKPLACE, None, ""),
}
# What an element has at least one of if a field of a card is to be found in it.
CARD_CLASSES = frozenset(c for _, classes, _, _ in CARD_FIELDS.values() for c in classes)
CARD_TAGS = frozenset(tag for tag, classes, _, _ in CARD_FIELDS.values() if not classes)
CRITERION_FIELDS = {
    "header": ("", CRITERION_HEADER, None, ""),
    "value": ("", CRITERION_VALUE, None, ""),
}


class _CardReader(_Reader):
    """List items in order, each with the card in its first box that names a key."""

    def __init__(self) -> None:
        super().__init__()
        self.items: list[list[_Scope]] = []
        self.waiting: list[tuple[int, list[_Scope]]] = []

    def opened(self, depth, tag, attrs, names):
        if tag in CARD_TAGS or not CARD_CLASSES.isdisjoint(names):
            for scope in self.scopes:
                if scope.wanted:
                    self.look(scope, depth, tag, attrs, names)
        if tag == "div" and CARD_KEY in attrs:
            box = None
            for inside, item in self.waiting:
                if inside < depth and not item:
                    if box is None:
                        box = _Scope(depth, CARD_FIELDS)
                        box.found["job_id"] = attrs[CARD_KEY].rpartition(":")[2]
                        self.scopes.append(box)
                    item.append(box)
        if tag == "li":
            item: list[_Scope] = []
            self.items.append(item)
            self.waiting.append((depth, item))

    def handle_endtag(self, tag):
        super().handle_endtag(tag)
        if self.waiting and self.waiting[-1][0] > len(self.open):
            self.waiting = [(d, i) for d, i in self.waiting if d <= len(self.open)]


class _DetailReader(_Reader):
    def __init__(self) -> None:
        super().__init__()
        self.page = _Scope(0, DETAIL_FIELDS)
        self.scopes.append(self.page)
        self.criteria: list[_Scope] = []

    def opened(self, depth, tag, attrs, names):
        if not names:
            return
        for scope in self.scopes:
            if scope.wanted:
                self.look(scope, depth, tag, attrs, names)
        if not CRITERION_CLASSES.isdisjoint(names):
            item = _Scope(depth, CRITERION_FIELDS)
            self.criteria.append(item)
            self.scopes.append(item)


def _cards(html: str | None) -> list[dict]:
    boxes = (item[0] for item in _CardReader().read(html).items if item)
    return [
        {name: box.value(name) or "" for name in ("job_id", *CARD_FIELDS)}
        for box in boxes
        if box.found["job_id"]
    ]


def _detail(html: str | None) -> dict:
    """Criteria by header in lower case; a repeated header keeps its last value."""
    reader = _DetailReader().read(html)
    pairs = [(item.value("header"), item.value("value")) for item in reader.criteria]
    return {
        "description": reader.page.value("description") or "",
        "criteria": {h.lower(): v for h, v in pairs if h is not None and v is not None},
        "applicant_count": reader.page.value("applicant_count") or "",
        "workplace_badge": reader.page.value("workplace_badge"),
    }


def _links(html: str | None) -> list[dict]:
    return [
        {"href": _attr_of(link, "href"), "label": link.text()}
        for item in tree(html).every("li")
        for link in item.children
        if isinstance(link, Element) and link.name == "a"
    ]


def _headings(html: str | None) -> dict:
    page = tree(html)
    return {"title": _text_of(page.first("title")), "headline": _text_of(page.first("h1"))}


def _per_array(read: Callable[[str | None], list[dict]], element: StructType):
    @F.pandas_udf(ArrayType(element))
    def rows(documents: pd.Series) -> pd.Series:
        return documents.map(read)

    return rows


def _per_struct(read: Callable[[str | None], dict], schema: StructType):
    @F.pandas_udf(schema)
    def record(documents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read(d) for d in documents], columns=schema.names)

    return record


# Not evaluated twice by a filter that explode would push below it.
search_cards = _per_array(_cards, CARD).asNondeterministic()
list_links = _per_array(_links, LINK)
detail_fields = _per_struct(_detail, DETAIL)
page_headings = _per_struct(_headings, HEADINGS)
