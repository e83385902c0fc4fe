"""Text blocks of HTML pages: the leaves of the tree of block elements, with their ancestors.

A tolerant tokenizer keeps a stack of open elements: void elements don't open, an end tag closes the nearest open element of
its name, and paragraphs, list items and table parts close where the HTML standard lets their end tag be left out. Text of
scripts, styles and the like is skipped. A block is the text between two block boundaries, inline markup aside.

Every character is read a fixed number of times and elements know only their parent, so any page takes linear time and space.
A tag, comment or declaration that the page's end cuts off is no text, as in the standard.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right

# Fixed sets of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template svg math iframe object canvas audio video select textarea title head datalist".split())
#: Elements that leave a head without its end tag open; any other start tag, and text, ends it.
IN_HEAD = frozenset("head title meta link base basefont bgsound style script noscript noframes template".split())
RAW = frozenset("script style textarea title iframe".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
SECTIONS = frozenset("article aside blockquote dialog fieldset figure footer form header main menu nav section table".split())
CLOSES_P = BLOCKS - frozenset("body html button caption label legend option optgroup tbody td tfoot th thead tr li dd dt".split())
#: Start tag -> open elements that it ends, up to the nearest of the fences.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}
#: Quotes count after an equals sign; one that never closes is a character like others.
TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*"|'[^']*')?|["'])*+)>""")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PARTS = re.compile(r"[a-z]+")


class Element:
    """A block element: its tag, the words of its class, id and role, the block element around it, the two innermost
    sectioning tags, whether it lies in an article or main element, whether nothing around has a name or is sectioning,
    and a place for scores."""

    __slots__ = ("tag", "names", "above", "sections", "in_main", "plain", "marks")

    def __init__(self, tag: str, names: tuple, above: Element | None):
        self.tag, self.names, self.above, self.marks = tag, names, above, None
        outer = above.sections if above is not None else ("", "")
        self.sections = (tag, outer[0]) if tag in SECTIONS else outer
        self.in_main = tag in ("article", "main") or (above is not None and above.in_main)
        self.plain = not names and tag not in SECTIONS and (above is None or above.plain)


class Block:
    __slots__ = ("text", "element", "link_chars")

    def __init__(self, text: str, element: Element | None, link_chars: int):
        self.text, self.element, self.link_chars = text, element, link_chars

    @property
    def path(self) -> tuple:
        """(tag, names) of the elements around, from the root down."""
        out, e = [], self.element
        while e is not None:
            out.append((e.tag, e.names))
            e = e.above
        return tuple(reversed(out))


def _markup_end(page: str, at: int) -> int:
    """The end of the comment, declaration or odd end tag that starts at ``at``; -1 if the page ends before."""
    closing = "-->" if page.startswith("<!--", at) else ">"
    end = page.find(closing, at + 2)
    return end + len(closing) if end >= 0 else -1


class _Tree:
    """Open elements and the blocks so far."""

    def __init__(self):
        self.stack: list[str] = []
        self.open: dict[str, list[int]] = {}  # places of each tag in the stack
        self.above: list[tuple[int, Element]] = []  # place and element of open blocks
        self.out: list[Block] = []
        self.parts: list[str] = []
        self.skip = self.links = self.link_chars = 0

    def flush(self):
        text = " ".join("".join(self.parts).split()) if self.parts else ""
        if text:
            self.out.append(Block(text, self.above[-1][1] if self.above else None, self.link_chars))
        self.parts.clear()
        self.link_chars = 0

    def push(self, tag: str, names: tuple):
        if tag in BLOCKS:
            self.flush()
            self.above.append((len(self.stack), Element(tag, names, self.above[-1][1] if self.above else None)))
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append(tag)
        self.skip += tag in SKIPPED
        self.links += tag == "a"

    def pop(self, k: int):
        """Close the elements from place k on."""
        if self.above and self.above[-1][0] >= k:
            self.flush()
        while self.above and self.above[-1][0] >= k:
            self.above.pop()
        while len(self.stack) > k:
            tag = self.stack.pop()
            self.open[tag].pop()
            self.skip -= tag in SKIPPED
            self.links -= tag == "a"

    def last(self, tag: str) -> int:
        """Place of the innermost open element of that tag, or -1."""
        places = self.open.get(tag)
        return places[-1] if places else -1

    def end_head(self):
        """An open head without its end tag, unless something in it is open."""
        if self.stack and self.stack[-1] == "head":
            self.pop(len(self.stack) - 1)

    def add(self, text: str):
        if not text:
            return
        if self.skip and not text.isspace():
            self.end_head()
        if not self.skip:
            plain = html.unescape(text) if "&" in text else text
            self.parts.append(plain)
            if self.links:
                self.link_chars += len(plain)

    def start(self, tag: str, attrs: str):
        if tag not in IN_HEAD:
            self.end_head()
        if tag in VOID:
            if tag in BLOCKS:
                self.flush()
            elif tag == "br":
                self.add(" ")
            return
        if tag in CLOSES_P and self.above and self.above[-1][1].tag == "p":
            self.pop(self.above[-1][0])
        if tag == "body" and self.last("head") >= 0:
            self.pop(self.open["head"][0])
        if tag in IMPLIED:
            ended, fences = IMPLIED[tag]
            fence = max(map(self.last, fences))
            inside = [places[i] for t in ended if (places := self.open.get(t)) and (i := bisect_right(places, fence)) < len(places)]
            if inside:
                self.pop(min(inside))
        names = tuple(sorted({w for m in NAMES.finditer(attrs) for w in PARTS.findall((m[1] or m[2] or m[3] or "").lower())})) if "=" in attrs else ()
        if tag in SKIPPED and tag not in BLOCKS and attrs.rstrip().endswith("/"):
            return
        self.push(tag, names)


def blocks(page: str) -> list[Block]:
    """All blocks with text, in page order."""
    tree, at, look = _Tree(), 0, 0
    while (lt := page.find("<", look)) >= 0:
        kind = page[lt + 1 : lt + 3]
        letter = kind[1:] if kind.startswith("/") else kind[:1]
        if letter.isascii() and letter.isalpha():
            token = TAG.match(page, lt)
            end = token.end() if token else -1
        elif kind[:1] in ("!", "?", "/") and kind:
            token, end = None, _markup_end(page, lt)
        else:  # a character
            look = lt + 1
            continue
        tree.add(page[at:lt])
        if end < 0:
            at = len(page)
            break
        at = look = end
        if token is None:
            continue
        tag = token[2].lower()
        if token[1]:
            if tree.last(tag) >= 0:
                tree.pop(tree.last(tag))
            continue
        tree.start(tag, token[3])
        if tag in RAW:
            close = RAW_END[tag].search(page, at)
            at = look = close.start() if close else len(page)
    tree.add(page[at:])
    tree.flush()
    return tree.out
