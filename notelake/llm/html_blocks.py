"""Flat text blocks of an HTML page, and what is known of each without rendering it."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

# Elements by what they do to the text around them.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr map area".split()
)
SPACING = frozenset("br input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Whose content is no text, up to the end of the page where it is not closed.
RAW = frozenset("script style textarea xmp iframe noembed noframes".split())
#: Whose content is no text if it is closed.
DROPPED = frozenset("title noscript template svg math object select button canvas audio video datalist".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Open elements that a start tag closes.
CLOSES = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
}

# Names in tags, roles, classes and ids, by region.
MAIN_TAGS = frozenset("article main".split())
MAIN_ROLES = frozenset("main article".split())
MAIN_NAMES = frozenset("article content contents post posts entry story main body text maincontent articlebody".split())
HEADER_NAMES = frozenset("header head masthead hero".split())
FORM_TAGS = frozenset("form fieldset dialog".split())
FORM_NAMES = frozenset("form".split())
BOILER_TAGS = frozenset("nav footer aside menu".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert alertdialog dialog toolbar".split())
BOILER_NAMES = frozenset(
    "ad ads adv advert advertisement advertising adsense adslot sponsor sponsored promo promotion promoted banner banners billboard "
    "nav navbar navigation navi menu menus submenu breadcrumb breadcrumbs crumbs topbar toolbar skip pager pagination paging "
    "footer foot footnav copyright legal imprint disclaimer sidebar side rail aside widget widgets related recommended recommendations "
    "more popular trending teaser teasers cookie cookies consent gdpr notice notices notification alert privacy popup modal overlay lightbox "
    "comment comments commentlist reply replies respond responses discussion disqus feedback share sharing social follow "
    "subscribe subscription newsletter signup signin login register search searchbox tags tagcloud meta byline bio author rating paywall "
    "hidden hide invisible print".split()
)
#: Names beside which a region's name only says what the element holds.
AROUND = frozenset("has with no without wrapper wrap layout container page site enabled".split())
#: Headings that end an article.
AFTERWARDS = re.compile(
    r"(?i)\W*(?:\d+\s+)?(?:reader\s+|user\s+|latest\s+|all\s+)?(?:comments?|responses?|replies|discussion|related|read more|more from|"
    r"share this|leave a (?:comment|reply)|kommentare?|commentaires?|comentarios?)\b"
)

_TAG = re.compile(
    r"<!--(?:-?>|(?s:.*?)(?:--!?>|\Z))"
    r"|<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)"
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)|([^\s=/\"'>]+)")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

#: ``article`` and ``main`` end a header or form around them, only ``main`` ends other boilerplate.
NONE, MAIN, HEADER, FORM, BOILER = range(5)


@dataclass
class Block:
    """A run of text without a block boundary; ``at`` is where it begins in the page."""

    text: str
    at: int
    words: int
    linked: int
    region: int
    afterwards: bool

    @property
    def link_density(self) -> float:
        return self.linked / self.words if self.words else 0.0


def _region(name: str, attributes: str) -> int:
    """What an element's own tag, role, class and id say."""
    named, role, hidden = [], "", False
    if attributes.strip("/ \t\r\n\f"):
        for key, value, alone in _ATTRIBUTE.findall(attributes):
            key, value = (key or alone).lower(), value.strip("\"'")
            if key in ("class", "id"):
                named += [_NAME.findall(one) for one in value.split()]
            elif key == "role":
                role = value.strip().lower()
            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
                hidden = True
            elif key == "style" and re.search(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden", value):
                hidden = True
    if hidden or name in BOILER_TAGS or role in BOILER_ROLES:
        return BOILER
    # An article's classes also name its topics: there only a class of one word counts.
    names = [frozenset(x.lower() for x in one) for one in named if len(one) == 1 or name not in MAIN_TAGS]
    names = [one for one in names if not one & AROUND]
    if any(one & BOILER_NAMES for one in names):
        return BOILER
    if name == "header" or any(one & HEADER_NAMES for one in names):
        return HEADER
    if name in FORM_TAGS or any(one & FORM_NAMES for one in names):
        return FORM
    if name in MAIN_TAGS or role in MAIN_ROLES or any(one & MAIN_NAMES for one in names):
        return MAIN
    return NONE


@dataclass
class _Open:
    """The open elements, the region that holds inside the last one, and if it lies in a main region."""

    names: list[str] = field(default_factory=list)
    states: list[tuple[int, bool]] = field(default_factory=list)
    count: Counter = field(default_factory=Counter)

    def state(self) -> tuple[int, bool]:
        return self.states[-1] if self.states else (NONE, False)

    def start(self, name: str, attributes: str) -> None:
        region, in_main = self.state()
        own = NONE if name in ("html", "body") else _region(name, attributes)
        if (name == "main" and own == MAIN) or (name in HEADINGS and region == HEADER and in_main):
            region, in_main = MAIN, True  # a title in the article's own header belongs to it
        elif region != BOILER and own != NONE:
            region, in_main = own, in_main or own == MAIN
        self.names.append(name)
        self.states.append((region, in_main))
        self.count[name] += 1

    def pop(self) -> str:
        self.states.pop()
        name = self.names.pop()
        self.count[name] -= 1
        return name

    def end(self, name: str) -> None:
        if self.count[name]:
            while self.pop() != name:
                pass

    def close(self, names: frozenset[str]) -> None:
        while self.names and self.names[-1] in names:
            self.pop()


_PARAGRAPH = frozenset(["p"]) | HEADINGS


def blocks(page: str) -> Iterator[Block]:
    """The text blocks of a page in order; script, style, forms' controls and comments are no text."""
    open_, parts, at = _Open(), [], 0
    linked = 0
    link = heading = False
    ended = None  # depth at which a heading said that the article is over
    position = 0

    def flush() -> Iterator[Block]:
        nonlocal parts, linked, ended
        text = " ".join("".join(parts).split())
        if text:
            region, _ = open_.state()
            size = len(text.split())
            if ended is not None and len(open_.names) < ended:
                ended = None
            if heading and AFTERWARDS.match(text):
                ended = len(open_.names) - 1
            yield Block(text, at, size, min(linked, size), region, ended is not None)
        parts, linked = [], 0

    def add(text: str) -> None:
        nonlocal at, linked
        if not text:
            return
        if not parts:
            at = position
        text = unescape(text) if "&" in text else text
        if link:
            linked += len(text.split())
        parts.append(text)

    length = len(page)
    while position < length:
        tag = _TAG.search(page, position)
        if tag is None:
            add(page[position:])
            break
        if tag.start() > position:
            add(page[position : tag.start()])
        position = tag.end()
        name = tag["name"]
        if name is None:
            continue
        name, is_end = name.lower(), bool(tag["end"])
        if name in INLINE:
            if name == "a":
                link = not is_end
            continue
        if name in SPACING:
            parts.append(" ")
            continue
        if name in RAW or name in DROPPED:
            if is_end or tag[0].endswith("/>"):
                continue
            close = re.compile(rf"(?i)</{re.escape(name)}(?=[\s/>])[^>]*>?").search(page, position)
            if close:
                position = close.end()
            elif name in RAW:
                position = length
            parts.append(" ")
            continue
        yield from flush()
        if is_end:
            if name in HEADINGS:
                heading = False
            if name not in _PARAGRAPH or open_.count[name]:
                open_.end(name)
            if name not in _PARAGRAPH:
                link = False
            continue
        open_.close(_PARAGRAPH)
        heading = name in HEADINGS
        if name in VOID:
            continue
        open_.close(CLOSES.get(name, frozenset()))
        open_.start(name, tag["attributes"])
    yield from flush()
