"""HTML to leaf blocks: runs of text between block boundaries, with their open ancestors.

Work and memory are in proportion to the page, however deep or broken its
markup is: open elements are counted by tag, the elements that a tag may close
are kept in stacks of their own, and a block knows only its innermost element.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

#: Fixed values of HTML: elements that don't end a run of text, that have no end tag, whose content isn't markup, and whose text isn't shown.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "template")
HIDDEN = frozenset(("head", "object", "svg", "math", "canvas", "audio", "video", "select", "datalist"))
#: Start tags that close an open paragraph, and items that close one of their own kind up to their list or table.
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSES_OWN = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    rf"|<({'|'.join(RAW)})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_NAMING = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


#: By tag: the kind of element whose nearest open one it may close; and of each kind, the tags that are closed and those that bound the search.
_KIND = {tag: own for tag, (own, _) in CLOSES_OWN.items()}
_KINDS = {frozenset(own): (frozenset(own), frozenset(bound)) for own, bound in CLOSES_OWN.values()}
_MARKED: dict[str, list[frozenset[str]]] = {}
for _kind, (_own, _bound) in _KINDS.items():
    for _tag in _own | _bound:
        _MARKED.setdefault(_tag, []).append(_kind)


@dataclass
class Block:
    """A run of text, the number of its innermost element (-1 if it has none), its block tag, and the share of it that is linked."""

    text: str
    element: int
    tag: str
    link_share: float


@dataclass
class Page:
    """The blocks of a page, and of each element its parent (-1 for none) and the names it adds to those of its ancestors."""

    blocks: list[Block] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    names: list[tuple[str, ...]] = field(default_factory=list)

    def names_above(self, element: int) -> list[str]:
        """The names that an element and its ancestors give to what stands inside."""
        out: list[str] = []
        while element >= 0:
            out += self.names[element]
            element = self.parents[element]
        return out

    def sums_above(self, weight: Callable[[str, float], float]) -> list[float]:
        """Of each element, the weights of names_above added up."""
        out: list[float] = []
        for parent, names in zip(self.parents, self.names, strict=True):  # parents come first
            out.append((out[parent] if parent >= 0 else 0.0) + sum(weight(x, 0.0) for x in names))
        return out


def element_names(tag: str, attributes: str) -> tuple[str, ...]:
    """'t:tag' and 'c:word' for each word in the class, id, role, property and label."""
    if "=" not in attributes:
        return (f"t:{tag}",)
    found = [x for m in _NAMING.finditer(attributes) for x in _PART.findall(m[1] or m[2] or m[3] or "")]
    return (f"t:{tag}", *dict.fromkeys(f"c:{x.lower()}" for x in found))


class _Open:
    """The open elements of a page: (tag, element, block tag around, place of a paragraph that a block start closes or -1)."""

    def __init__(self, page: Page):
        self.page = page
        self.stack: list[tuple[str, int, str, int]] = []
        self.tags: Counter[str] = Counter()
        self.names: set[str] = set()
        self.marks: dict[frozenset[str], list[int]] = {kind: [] for kind in _KINDS}
        self.hidden = 0

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        page, above = self.page, self.stack[-1] if self.stack else ("", -1, "", -1)
        page.parents.append(above[1])
        known = self.names
        new = tuple([x for x in names if x not in known])
        known.update(new)
        page.names.append(new)
        inline = tag in INLINE
        self.stack.append((tag, len(page.names) - 1, above[2] if inline else tag, len(self.stack) if tag == "p" else above[3] if inline else -1))
        self.tags[tag] += 1
        self.hidden += tag in HIDDEN
        if tag in _MARKED:
            for kind in _MARKED[tag]:
                self.marks[kind].append(len(self.stack) - 1)

    def pop_to(self, size: int) -> None:
        for tag, element, _, _ in self.stack[size:]:
            self.tags[tag] -= 1
            self.hidden -= tag in HIDDEN
            self.names.difference_update(self.page.names[element])
            if tag in _MARKED:
                for kind in _MARKED[tag]:
                    self.marks[kind].pop()
        del self.stack[size:]

    def pop_tag(self, tag: str) -> None:
        """Close the innermost element of the tag, and all in it, if one is open."""
        if self.tags[tag]:
            k = len(self.stack) - 1
            while self.stack[k][0] != tag:
                k -= 1
            self.pop_to(k)

    def make_room(self, tag: str) -> None:
        """Close what a start tag closes."""
        if tag in CLOSES_P:
            if self.stack and self.stack[-1][3] >= 0:
                self.pop_to(self.stack[-1][3])
        elif tag in _KIND:
            own, _ = _KINDS[frozenset(_KIND[tag])]
            marks = self.marks[own]
            while marks and self.stack[marks[-1]][0] in own:
                self.pop_to(marks[-1])
                if tag != "tr":
                    break
        if tag == "body":
            self.pop_tag("head")


def parse(source: str) -> Page:
    """All leaf blocks of ``source`` in page order. Hidden and raw text gives none."""
    page = Page()
    inside = _Open(page)
    pieces: list[str] = []
    linked = 0
    begun: tuple[int, str] | None = None

    def flush() -> None:
        nonlocal pieces, linked, begun
        if begun is not None:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                page.blocks.append(Block(text, begun[0], begun[1], min(1.0, linked / max(1, len(text)))))
        pieces, linked, begun = [], 0, None

    def add(piece: str) -> None:
        nonlocal begun, linked
        if inside.hidden or not piece:
            return
        pieces.append(piece)
        if inside.tags["a"]:
            linked += len(piece)
        if begun is None and not piece.isspace():
            begun = inside.stack[-1][1:3] if inside.stack else (-1, "")

    at = 0
    for m in _TOKEN.finditer(source):
        add(source[at : m.start()])
        at = m.end()
        name = m[3] or m[6]
        if name is None:
            if m[1]:
                flush()
            continue
        tag, closing = name.lower(), bool(m[2] or m[5])
        if tag not in INLINE:
            flush()
        if closing:
            inside.pop_tag(tag)
            continue
        inside.make_room(tag)
        if tag not in VOID:
            inside.push(tag, element_names(tag, m[4] or m[7] or ""))
    add(source[at:])
    flush()
    return page


_LENGTHS = (3, 8, 20, 50)


def block_features(block: Block) -> list[str]:
    """Features of a block's own tag and text."""
    words = block.text.count(" ") + 1
    size = sum(words > x for x in _LENGTHS)
    link = 0 if block.link_share == 0 else 1 if block.link_share < 0.5 else 2
    end = block.text[-1] in ".!?\"'”…;:"
    out = ["bias", f"b:{block.tag}", f"size:{size}", f"link:{link}", f"end:{end}", f"size:{size},link:{link},end:{end}"]
    if words <= _LENGTHS[2] and block.text.lower().removeprefix("copyright").lstrip().startswith("©"):
        out.append("copyright")  # a short line that begins with the sign, not a text that has it somewhere
    if 10 * sum(map(str.isdigit, block.text)) > len(block.text):
        out.append("digits")
    return out
