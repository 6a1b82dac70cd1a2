"""HTML to leaf blocks: text, the path of tags above it, and how much of it is links.

The labeller never sees what these elements hold: script, template and noscript (scripts and what replaces
them), style, head and title (styles and markup), svg, canvas, audio, video, object and iframe (markup of drawings and
embedded things, with what replaces them), button, select, textarea and datalist (forms), and elements with the
attribute ``hidden`` or the style ``display:none``, which hold menus, notices and adverts that a script may show. They
are dropped here with all their text, by rule, also where they are inside an article.

A page is read once from front to back, whatever is wrong with it: an open comment, tag or quote at the end
takes the rest, tags are matched by counts of what is open, and blocks share their paths.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

# Element names of the HTML standard, by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template svg iframe object textarea select button title canvas audio video datalist head".split())
RAW = frozenset("script style textarea title iframe noscript".split())
#: Elements that say how text looks, not where it stands: they are no part of a path.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img input".split())
#: Elements before which an open paragraph ends.
ENDS_P = frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr li listing main menu nav ol p plaintext pre search section summary table ul xmp".split()
)
#: Elements that end a block; text before and after any other one runs on.
BLOCK = ENDS_P | frozenset("html body head title caption colgroup col thead tbody tfoot tr td th optgroup option legend base link meta".split())
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("tr", "td", "th", "thead"), "tfoot": ("tr", "td", "th", "tbody"),
}
SCOPES = frozenset("ul ol table dl article section div main aside nav header footer body form td".split())
HEADINGS = frozenset("h1 h2 h3".split())

_TAG = re.compile(r"[a-zA-Z][^\s/>\x00]*")
#: The next attribute, or the end of the tag. A quote opens a value only behind its equals sign.
_ATTRIBUTE = re.compile(r"[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)(\"?)|'([^']*)('?)|([^\s>\"'][^\s>]*))?)?)")
_NAMED = frozenset("class id role itemprop aria-label".split())
_COMMENT_END = re.compile(r"--!?>")
_CLOSE = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}
_NAME = re.compile(r"[a-z]+")
_UNSHOWN = re.compile(r"display\s*:\s*none", re.I)
_CAMEL = re.compile(r"([a-z])([A-Z])")

#: Places that names are hashed to.
PLACES = 96


class Path(NamedTuple):
    """What the labeller reads of the tags, and of the names of classes, ids and roles, from the root down."""

    places: int  # a bit for each place that a name falls on
    length: int
    last: str
    heading: bool


ROOT = Path(0, 0, "", False)


class Block(NamedTuple):
    path: Path
    text: str
    link: float  # share of the text within links


@lru_cache(maxsize=1 << 14)
def _bits(name: str) -> int:
    """Each name in two places: names that meet in one differ in the other."""
    return 1 << zlib.crc32(f"1{name}".encode()) % PLACES | 1 << zlib.crc32(f"2{name}".encode()) % PLACES


def extended(path: Path, names: list[str]) -> Path:
    bits = path.places
    for x in names:
        bits |= _bits(x)
    return Path(bits, path.length + len(names), names[-1], path.heading or not HEADINGS.isdisjoint(names))


def _attributes(page: str, at: int) -> tuple[list[str], bool, bool, int]:
    """(names, hidden, self-closing, place behind the tag) from the place behind a tag's name; -1 if the tag never ends."""
    names: list[str] = []
    hidden = False
    while True:
        m = _ATTRIBUTE.match(page, at)
        if not m:
            return names, hidden, False, -1
        if m[1]:
            return names, hidden, page[m.end() - 2] == "/", m.end()
        if m[4] == "" or m[6] == "":  # a quote that is never closed
            return names, hidden, False, -1
        at = m.end()
        key, value = m[2].lower(), m[3] or m[5] or m[7] or ""
        if key in _NAMED:
            names += ["." + x for x in _NAME.findall(_CAMEL.sub(r"\1 \2", value).lower())]
        elif key == "hidden" or key == "style" and _UNSHOWN.search(value):
            hidden = True


class _Reader:
    def __init__(self) -> None:
        self.out: list[Block] = []
        self.stack: list[tuple[str, Path, bool]] = []  # tag, its path, whether it is unseen
        self.open: Counter[str] = Counter()
        self.unseen = 0
        self.parts: list[tuple[str, bool]] = []

    def say(self, text: str) -> None:
        if not self.unseen:
            self.parts.append((text, self.open["a"] > 0))

    def flush(self) -> None:
        """A block ends, unless what goes on isn't seen."""
        if self.unseen or not self.parts:
            return
        text = " ".join("".join(p for p, _ in self.parts).split())
        if text:
            inside = sum(len(p) for p, a in self.parts if a)
            path = self.stack[-1][1] if self.stack else ROOT
            self.out.append(Block(path, text, inside / max(1, sum(len(p) for p, _ in self.parts))))
        self.parts = []

    def push(self, tag: str, names: list[str], hid: bool) -> None:
        above = self.stack[-1][1] if self.stack else ROOT
        self.stack.append((tag, above if tag in INLINE else extended(above, [tag, *names]), hid))
        self.open[tag] += 1
        self.unseen += hid

    def pop(self, to: int) -> None:
        for tag, _, hid in self.stack[to:]:
            self.open[tag] -= 1
            self.unseen -= hid
        del self.stack[to:]

    def opens(self, tags) -> bool:
        return any(self.open[t] for t in tags)

    def start(self, tag: str) -> None:
        """Close what a start tag closes; nothing above an element that isn't seen."""
        if tag in ENDS_P and self.opens(("svg",)) and not self.opens(("foreignobject",)):  # a drawing that was never closed
            self.pop(next(i for i, s in enumerate(self.stack) if s[0] == "svg"))
        if tag in ("body", "article", "main") and self.open["head"]:  # a head that was never closed
            self.pop(next(i for i, s in enumerate(self.stack) if s[0] == "head"))
        if tag in BLOCK:
            self.flush()
        elif tag in ("br", "img", "input"):
            self.say(" ")
        if tag in ENDS_P and self.open["p"]:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == "p":
                    self.pop(i)
                    break
                if self.stack[i][0] in SCOPES or self.stack[i][2]:
                    break
        if tag in CLOSES and self.opens(CLOSES[tag]):
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][2] or self.stack[i][0] in SCOPES - {"td"}:
                    break
                if self.stack[i][0] in CLOSES[tag]:
                    self.pop(i)
                    if not self.opens(CLOSES[tag]):
                        break

    def end(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        if tag == "br":
            self.say(" ")
        if not self.open[tag]:
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self.pop(i)
                return
            if tag in INLINE and self.stack[i][0] not in INLINE or tag == "p" and (self.stack[i][0] in SCOPES or self.stack[i][2]):
                return


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order: runs of text between block-level tags, decoded, with white space as one space."""
    if not page:
        return []
    r = _Reader()
    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            lt = end
        after = page[lt + 1 : lt + 3]
        while lt < end and not (after[:1].isascii() and after[:1].isalpha() or after[:1] in ("!", "?", "/") and after):  # a mark, no markup
            lt = page.find("<", lt + 1)
            lt = end if lt < 0 else lt
            after = page[lt + 1 : lt + 3]
        if lt > at and not r.unseen:
            text = page[at:lt]
            r.say(html.unescape(text) if "&" in text else text)
        if lt == end:
            break
        if page.startswith("<!--", lt):
            if page.startswith(("<!-->", "<!--->"), lt):
                at = page.index(">", lt) + 1
                continue
            m = _COMMENT_END.search(page, lt + 4)
            at = m.end() if m else end
            continue
        closing = after[0] == "/"
        m = _TAG.match(page, lt + 1 + closing)
        if not m:  # a declaration, or something of that kind
            at = page.find(">", lt) + 1 or end
            continue
        tag = m[0].lower()
        names, hidden, closed, at = _attributes(page, m.end())
        if at < 0:
            break
        if closing:
            r.end(tag)
            continue
        r.start(tag)
        if tag in VOID or closed and (tag in UNSEEN or r.open["svg"]):
            continue
        if tag in RAW:
            m = _CLOSE[tag].search(page, at)
            at = m.end() if m else end
            continue
        r.push(tag, names, hidden or tag in UNSEEN)
    r.unseen = 0
    r.flush()
    return r.out
