"""A forgiving HTML reader: one page becomes element arrays and text pieces with block breaks."""

from __future__ import annotations

import re
from html import unescape

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Contents are characters, not markup.
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes".split())
#: Elements that begin a new block of text and end with one.
BLOCK = frozenset("""address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre search section select summary
table tbody td tfoot th thead title tr ul video audio""".split())
#: A start tag of the value closes an open element of the key, unless a scope boundary lies between.
CLOSES = {
    "p": BLOCK - frozenset("br caption tbody td tfoot th thead tr option optgroup button legend video audio".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"]),
    "tr": frozenset(["tr", "tbody", "tfoot", "thead"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot", "thead"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot", "thead"]),
    "head": frozenset(["body"])}
_SCOPE = {"p": frozenset(["button", "table", "td", "th", "caption"]), "li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]),
          "option": frozenset(["select"]), "tr": frozenset(["table"]), "td": frozenset(["table"]), "th": frozenset(["table"]), "head": frozenset()}
_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]+|=\s*"[^"]*"|=\s*'[^']*'|["'=])*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_SPACES = re.compile(r"[\x20\x09-\x0D]+")


class Page:
    """Elements in document order (0 is the root) and the text pieces below them."""

    def __init__(self, html: str):
        self.tag: list[str] = ["#root"]
        self.parent: list[int] = [-1]
        self.attrs: list[str] = [""]
        #: (element, block number, text) with character references decoded.
        self.texts: list[tuple[int, int, str]] = []
        self._stack = [0]
        #: Per tag, where its open elements are in the stack.
        self._open_at: dict[str, list[int]] = {}
        self._block = 0
        self._read(html)

    def _open(self, tag: str, attrs: str) -> None:
        self.tag.append(tag)
        self.parent.append(self._stack[-1])
        self.attrs.append(attrs)
        if tag not in VOID:
            self._open_at.setdefault(tag, []).append(len(self._stack))
            self._stack.append(len(self.tag) - 1)

    def _last(self, tag: str) -> int:
        """The place of the innermost open element of a tag in the stack, 0 without any."""
        at = self._open_at.get(tag)
        return at[-1] if at else 0

    def _close(self, place: int) -> None:
        """Close the elements from a place of the stack on; each is closed once, so reading stays linear."""
        while len(self._stack) > place:
            self._open_at[self.tag[self._stack.pop()]].pop()

    def _close_implied(self, tag: str) -> None:
        for name, by in CLOSES.items():
            if tag in by:
                place = self._last(name)
                if place and all(self._last(other) < place for other in _SCOPE[name]):
                    self._close(place)

    def _text(self, text: str) -> None:
        if text:
            self.texts.append((self._stack[-1], self._block, unescape(text) if "&" in text else text))

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            lt = html.find("<", at)
            if lt < 0:
                self._text(html[at:])
                return
            m = _TOKEN.match(html, lt)
            if m is None:                       # a lone "<" is text
                self._text(html[at:lt + 1])
                at = lt + 1
                continue
            if lt > at:
                self._text(html[at:lt])
            at = m.end()
            name = m[2]
            if name is None:
                continue
            tag = name.lower()
            if tag in BLOCK:
                self._block += 1
            if m[1]:
                if self._last(tag):
                    self._close(self._last(tag))
                continue
            self._close_implied(tag)
            self._open(tag, m[3])
            if tag in RAW:
                end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>", re.I).search(html, at)
                stop = end.start() if end else n
                if tag in ("title", "textarea"):
                    self._text(html[at:stop])
                self._close(len(self._stack) - 1)
                at = end.end() if end else n

    def attribute(self, element: int, *names: str) -> str:
        """The values of some attributes of an element, joined by spaces."""
        raw = self.attrs[element]
        if not raw or raw.isspace():
            return ""
        return " ".join(a or b or c for key, a, b, c in _ATTRIBUTE.findall(raw) if key.lower() in names)


def blocks(pieces: list[tuple[int, str]]) -> str:
    """(block number, text) pieces as lines: white space inside a block is one space, empty blocks go."""
    out: list[str] = []
    held: list[str] = []
    last = None
    for number, text in [*pieces, (None, "")]:
        if number != last:
            line = _SPACES.sub(" ", "".join(held)).strip(" ")
            if line:
                out.append(line)
            held, last = [], number
        held.append(text)
    return "\n".join(out)
