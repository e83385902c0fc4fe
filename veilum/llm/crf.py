"""Main text of pages: a linear-chain conditional random field over blocks, decoded by Viterbi.

Each block of a page is content or not. A block's features are its ancestors' tags and class words, its own and its parent's
tag, and properties of its text (length, links, punctuation, telling words, place in the page), and whether the page has an article or main element; neighbouring blocks are tied
by transition weights. The weights are trained by maximum likelihood (forward and backward sums, Adam with an L2 prior) on
labelled pages of many layouts, which ``labelled_pages`` composes from a seed; pages with given labels can be added.
"""

from __future__ import annotations

import html
import random
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilum.llm._words import text_slices
from veilum.llm.blocks import Block, Element, blocks

PAGES, SEED, EPOCHS, RATE, PRIOR = 1200, 5, 80, 0.1, 0.05
#: Words that tell about a block wherever they stand in it (fixed lists, several languages).
HINTS = {
    "legal": "copyright ©, all rights reserved, terms of use, privacy, impressum, imprint, mentions légales, aviso legal, datenschutz",
    "consent": "cookie, cookies, consent, accept all, javascript, akzeptieren, accepter, aceptar",
    "call": "subscribe, sign up, sign in, log in, login, newsletter, register, advertisement, sponsored, anzeige, publicité, publicidad, buy now, share this, follow us, read more, click here",
    "reply": "reply, replies, comments, commented, antworten, répondre, responder",
}
HINT_WORDS = {k: tuple(w.strip() for w in v.split(",")) for k, v in HINTS.items()}
END = frozenset(".!?…:;\"'”»)。")


def element_features(element: Element) -> list[str]:
    """Features of one element for all text inside it. html and body say nothing."""
    own = [] if element.tag in ("html", "body") else ["in=" + element.tag]
    return own + ["named=" + w for w in element.names]


def leaf_features(element: Element | None) -> list[str]:
    """Features of the two innermost elements around a block."""
    if element is None:
        return ["leaf=none"]
    return ["leaf=" + element.tag, "parent=" + (element.above.tag if element.above else "none"), "within=" + "<".join(element.sections)]


def path_features(element: Element | None) -> list[str]:
    """All features of the elements around a block, each once."""
    found, e = dict.fromkeys(leaf_features(element)), element
    while e is not None:
        found.update(dict.fromkeys(element_features(e)))
        e = e.above
    return list(found)


def text_features(text: str, link_chars: int) -> list[str]:
    n = text.count(" ") + 1
    links = link_chars / max(1, len(text))
    out = [
        f"words={min(7, n.bit_length())}",
        f"links={0 if links == 0 else 1 if links < 0.3 else 2 if links < 0.8 else 3}",
        "ends" if text[-1] in END else "open",
        f"stops={min(3, text.count('. ') + text.count(', '))}",
    ]
    if n < 40:
        lower = text.lower()
        out += ["hint=" + k for k, words in HINT_WORDS.items() if any(w in lower for w in words)]
    if "|" in text or "·" in text or "»" in text:
        out.append("divided")
    return out


def place_features(place: int, count: int) -> list[str]:
    return [f"place={5 * place // max(1, count)}"] + ["first"] * (place == 0) + ["last"] * (place == count - 1)


def page_kind(found: Sequence[Block]) -> str:
    """Whether the page has an article or main element, or no sectioning and no names at all."""
    if any(b.element is not None and b.element.in_main for b in found):
        return "main"
    return "plain" if all(b.element is None or b.element.plain for b in found) else "other"


def kind_features(block: Block, kind: str) -> list[str]:
    return ["page=" + kind + ("+" if block.element is not None and block.element.in_main else "")]


def features(block: Block, place: int, count: int, kind: str) -> list[str]:
    return [*path_features(block.element), *text_features(block.text, block.link_chars), *place_features(place, count), *kind_features(block, kind)]


@dataclass
class Model:
    weights: dict[str, tuple[float, float]]
    moves: list[list[float]]
    start: tuple[float, float]
    texts: dict = field(default_factory=dict)  # scores of short texts that were seen before
    places: dict = field(default_factory=dict)

    def _sum(self, names) -> tuple[float, float]:
        pairs = [p for n in names if (p := self.weights.get(n))]
        return sum(p[0] for p in pairs), sum(p[1] for p in pairs)

    def _around(self, element: Element) -> tuple[frozenset, float, float]:
        """Known features of an element and those around it, and their scores; each element is scored once."""
        chain, e = [], element
        while e is not None and e.marks is None:
            chain.append(e)
            e = e.above
        seen, a, b = e.marks if e is not None else (frozenset(), 0.0, 0.0)
        for e in reversed(chain):
            new = [n for n in dict.fromkeys(element_features(e)) if n in self.weights and n not in seen]
            if new:
                x, y = self._sum(new)
                seen, a, b = seen.union(new), a + x, b + y
            e.marks = (seen, a, b)
        return element.marks

    def scores(self, block: Block, place: int, count: int, kind: str) -> tuple[float, float]:
        key = (block.text, block.link_chars) if len(block.text) < 48 else None
        own = self.texts.get(key)
        if own is None:
            own = self._sum(text_features(block.text, block.link_chars))
            if key is not None:
                if len(self.texts) > 10_000:
                    self.texts.clear()
                self.texts[key] = own
        key = (5 * place // max(1, count), place == 0, place == count - 1)
        at = self.places.get(key)
        if at is None:
            at = self.places[key] = self._sum(place_features(place, count))
        e = block.element
        key = (kind, e is not None and e.in_main)
        page = self.places.get(key)
        if page is None:
            page = self.places[key] = self._sum(kind_features(block, kind))
        key = (e.tag, e.above and e.above.tag, e.sections) if e is not None else None
        leaf = self.places.get(key)
        if leaf is None:
            leaf = self.places[key] = self._sum(leaf_features(e))
        _, a, b = self._around(e) if e is not None else (None, 0.0, 0.0)
        return own[0] + at[0] + leaf[0] + page[0] + a, own[1] + at[1] + leaf[1] + page[1] + b

    def decode(self, found: Sequence[Block]) -> list[bool]:
        """Viterbi: the most likely labels together; ties are no content."""
        if not found:
            return []
        (t00, t01), (t10, t11) = self.moves
        back, a, b, kind = [], 0.0, 0.0, page_kind(found)
        for i, block in enumerate(found):
            x, y = self.scores(block, i, len(found), kind)
            if i == 0:
                a, b = self.start[0] + x, self.start[1] + y
                continue
            from_a, from_b = b + t10 > a + t00, b + t11 > a + t01
            a, b, _ = (b + t10 if from_a else a + t00) + x, (b + t11 if from_b else a + t01) + y, back.append((from_a, from_b))
        label = b > a
        out = [label]
        for from_a, from_b in reversed(back):
            label = from_b if label else from_a
            out.append(label)
        return out[::-1]

    def extract(self, page: str | None) -> str:
        """The content blocks, one to a line."""
        found = blocks(page or "")
        return "\n".join(b.text for b, keep in zip(found, self.decode(found), strict=True) if keep)


def train(pages: Sequence[tuple[Sequence[Block], Sequence[bool]]], epochs: int = EPOCHS, rate: float = RATE, prior: float = PRIOR) -> Model:
    """Maximum likelihood over all pages at once; features seen on fewer than three blocks are left out."""
    pages = [p for p in pages if p[0]]
    counts: dict[str, int] = {}
    listed = []
    for found, labels in pages:
        rows, kind = [], page_kind(found)
        for i, block in enumerate(found):
            names = features(block, i, len(found), kind)
            rows.append(names)
            for name in names:
                counts[name] = counts.get(name, 0) + 1
        listed.append((rows, labels))
    index = {name: i for i, name in enumerate(sorted(n for n, c in counts.items() if c >= 3))}
    n, longest = len(listed), max(len(rows) for rows, _ in listed)
    unit, feature, gold, mask = [], [], np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for p, (rows, labels) in enumerate(listed):
        mask[p, : len(rows)] = True
        gold[p, : len(rows)] = labels
        for i, names in enumerate(rows):
            known = [index[x] for x in names if x in index]
            unit += [p * longest + i] * len(known)
            feature += known
    unit, feature = np.array(unit), np.array(feature)
    sizes = mask.sum(1)
    one_hot = np.stack([gold == 0, gold == 1], axis=2) * mask[:, :, None]
    pairs = mask[:, 1:]
    moves_seen = np.array([[((gold[:, :-1] == i) & (gold[:, 1:] == j) & pairs).sum() for j in range(2)] for i in range(2)], float)
    w, t, s = np.zeros((len(index), 2)), np.zeros((2, 2)), np.zeros(2)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, t, s)]
    for epoch in range(1, epochs + 1):
        emit = np.zeros((n * longest, 2))
        for k in range(2):
            emit[:, k] = np.bincount(unit, w[feature, k], n * longest)
        emit = emit.reshape(n, longest, 2)
        forward, backward = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        forward[:, 0] = emit[:, 0] + s
        for i in range(1, longest):
            step = np.logaddexp(forward[:, i - 1, 0, None] + t[0], forward[:, i - 1, 1, None] + t[1]) + emit[:, i]
            forward[:, i] = np.where(mask[:, i, None], step, forward[:, i - 1])
        for i in range(longest - 2, -1, -1):
            ahead = backward[:, i + 1] + emit[:, i + 1]
            step = np.logaddexp(ahead[:, 0, None] + t[:, 0], ahead[:, 1, None] + t[:, 1])
            backward[:, i] = np.where(mask[:, i + 1, None], step, 0.0)
        total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        share = np.exp(forward + backward - total[:, None, None]) * mask[:, :, None]
        joint = forward[:, :-1, :, None] + t + (emit + backward)[:, 1:, None, :] - total[:, None, None, None]
        moves = (np.exp(np.where(pairs[:, :, None, None], joint, -np.inf))).sum((0, 1))
        wrong = (one_hot - share).reshape(-1, 2)
        slopes = [
            np.stack([np.bincount(feature, wrong[unit, k], len(index)) for k in range(2)], axis=1) - prior * w,
            moves_seen - moves - prior * t,
            wrong.reshape(n, longest, 2)[:, 0].sum(0) - prior * s,
        ]
        for x, slope, m in zip((w, t, s), slopes, moments, strict=True):
            m[0] = 0.9 * m[0] + 0.1 * slope
            m[1] = 0.999 * m[1] + 0.001 * slope**2
            x += rate * (m[0] / (1 - 0.9**epoch)) / (np.sqrt(m[1] / (1 - 0.999**epoch)) + 1e-8)
    assert sizes.min() > 0
    return Model({name: (float(w[i, 0]), float(w[i, 1])) for name, i in index.items()}, t.tolist(), (float(s[0]), float(s[1])))


class Composer:
    """Composes one page, keeping the label of each text it puts in."""

    def __init__(self, rng: random.Random):
        self.rng, self.labels, self.bare = rng, [], False
        self.syllables = rng.choice(["an er on th re st ing ed", "ci ón que ar os la mente", "schen ung ver ä keit ge", "eau té ion lle ou ré"]).split()

    def words(self, n: int) -> list[str]:
        return ["".join(self.rng.choice(self.syllables) for _ in range(self.rng.randint(1, 4))) for _ in range(n)]

    def sentence(self, low: int = 5, high: int = 22) -> str:
        words = self.words(self.rng.randint(low, high))
        words = [w + "," if self.rng.random() < 0.08 else w for w in words]
        return " ".join(words).capitalize() + self.rng.choice([".", ".", ".", "!", "?"])

    def prose(self) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.randint(1, 7)))

    def put(self, text: str, content: bool) -> str:
        self.labels.append((" ".join(text.split()), content))
        return html.escape(text, quote=self.rng.random() < 0.5)

    def name(self, *choices: str) -> str:
        word = self.rng.choice(choices)
        extra = self.rng.choice(["", "", " clearfix", " col", "-wrapper", "-box"])
        return self.rng.choice([f' class="{word}{extra}"', f' id="{word}"', f" class='{word}'"])

    def menu(self, tag: str) -> str:
        items = "".join(f'<li><a href="/{i}">{self.put(" ".join(self.words(self.rng.randint(1, 3))), False)}</a></li>' for i in range(self.rng.randint(3, 9)))
        return f"<{tag}{self.name('menu', 'nav', 'navbar', 'navigation', 'links') if tag != 'nav' or self.rng.random() < 0.4 else ''}><ul>{items}</ul></{tag}>"

    def page_header(self) -> str:
        tag = self.rng.choice(["header", "div"])
        site = self.put(" ".join(self.words(2)), False)
        tagline = f"<p>{self.put(self.sentence(3, 8), False)}</p>" if self.rng.random() < 0.5 else ""
        inner = self.rng.choice([f"<h1>{site}</h1>", f'<a href="/">{site}</a>', f"<div>{site}</div>"]) + tagline
        return f"<{tag}{self.name('header', 'masthead', 'top', 'banner', 'site') if tag == 'div' or self.rng.random() < 0.3 else ''}>{inner}</{tag}>"

    def aside(self) -> str:
        tag = self.rng.choice(["aside", "div", "section"])
        inner = f"<h{(n := self.rng.randint(2, 4))}>{self.put(' '.join(self.words(2)), False)}</h{n}>"
        for _ in range(self.rng.randint(1, 4)):
            inner += self.rng.choice([lambda: f'<p>{self.put(self.sentence(), False)}</p>', lambda: f'<ul><li><a href="#">{self.put(" ".join(self.words(4)), False)}</a></ul>'])()
        return f"<{tag}{self.name('sidebar', 'side', 'related', 'widget', 'recommended', 'trending', 'popular') if tag != 'aside' or self.rng.random() < 0.3 else ''}>{inner}</{tag}>"

    def advert(self) -> str:
        text = self.put(self.sentence(4, 14) if self.rng.random() < 0.7 else self.rng.choice(["Advertisement", "Sponsored", "Anzeige", "Publicité"]), False)
        return f"<div{self.name('ad', 'ads', 'advert', 'banner', 'sponsor', 'promo', 'advertisement', 'sponsored')}>{self.rng.choice(['', '<p>'])}{text}</div>"

    def notice(self) -> str:
        text = self.put(self.rng.choice(["We use cookies. ", "This site needs cookies and javascript. ", ""]) + self.sentence(5, 12), False)
        button = f"<button>{self.put(self.rng.choice(['OK', 'Accept all', 'Akzeptieren']), False)}</button>" if self.rng.random() < 0.5 else ""
        return f"<div{self.name('cookie', 'cookies', 'notice', 'consent', 'gdpr', 'alert', 'popup', 'modal', 'overlay', 'notification')}><p>{text}</p>{button}</div>"

    def form(self) -> str:
        text = self.put(self.rng.choice(["Subscribe to our newsletter", "Log in", "Search", "E-Mail"]) + self.rng.choice(["", " " + self.sentence(3, 7)]), False)
        return f'<form action="/f"{self.name("newsletter", "login", "search", "subscribe") if self.rng.random() < 0.5 else ""}><label>{text}</label><input name="q"><button>{self.put("Go", False)}</button></form>'

    def comments(self) -> str:
        tag = self.rng.choice(["section", "div", "ol", "aside"])
        item = "li" if tag == "ol" else self.rng.choice(["div", "article", "p"])
        head = self.rng.choice(["Comments", "Kommentare", "Replies", "3 comments", "Discussion", " ".join(self.words(self.rng.randint(1, 3)))])
        inner = f"<h{(n := self.rng.randint(2, 4))}>{self.put(head, False)}</h{n}>" if tag != "ol" and self.rng.random() < 0.8 else ""
        for _ in range(self.rng.randint(1, 5)):
            body = self.prose() if self.rng.random() < 0.5 else self.sentence()
            one = self.put(body, False) if item == "p" else f"<b>{self.put(' '.join(self.words(2)), False)}</b>"
            if item != "p":
                one = self.rng.choice(["<p>", "<div><p>"]).join(["", ""]) + f"<h4>{one}</h4><p>{self.put(body, False)}</p>"
            inner += f"<{item}{self.name('comment', 'reply') if self.rng.random() < 0.7 else ''}>{one}</{item}>"
        return f"<{tag}{self.name('comments', 'comment-list', 'discussion', 'replies', 'responses')}>{inner}</{tag}>"

    def footer(self) -> str:
        tag = self.rng.choice(["footer", "div", "footer"])
        if self.rng.random() < 0.15:  # no element of its own
            text = self.put(self.rng.choice(["© 2001 ", "Copyright 1998 ", "Copyright "]) + " ".join(self.words(2)) + self.rng.choice(["", ", all rights reserved.", ". Impressum"]), False)
            return f"{self.rng.choice(['', '<hr>'])}<p>{text}</p>"
        text = self.put(self.rng.choice(["© 2020 ", "Copyright ", ""]) + " ".join(self.words(2)) + self.rng.choice([" · ", " | ", ". "]) + self.sentence(2, 8), False)
        return f"<{tag}{self.name('footer', 'bottom', 'legal', 'copyright') if tag == 'div' or self.rng.random() < 0.2 else ''}>{self.rng.choice(['', '<p>'])}{text}</{tag}>"

    def linked(self, words: list[str], content: bool) -> str:
        """Words of which a few in the middle are a link."""
        k = self.rng.randint(0, len(words) - 1)
        n = self.rng.randint(1, 3)
        self.labels.append((" ".join(words), content))
        parts = [" ".join(words[:k]), f'<a href="/{n}">{" ".join(words[k : k + n])}</a>', " ".join(words[k + n :])]
        return " ".join(p for p in parts if p)

    def paragraph(self) -> str:
        rng = self.rng
        text = self.prose() if rng.random() < 0.8 else " ".join(self.words(rng.randint(1, 6)))
        if not self.bare and rng.random() < 0.12:  # what stands in menus and footers elsewhere
            text = rng.choice(["All rights reserved.", "Copyright " + text, " | ".join(self.words(rng.randint(2, 7))) + " |", "Sign up. " + text, "Read more: " + text])
        if rng.random() < 0.2:
            return self.linked(text.split(), True)
        return f"{rng.choice(['', '', '', '<b>', '<i>', '<span>'])}{self.put(text, True)}{rng.choice(['', '', '<br>'])}"

    def items(self, tag: str, low: int, high: int) -> str:
        """A list in the article; some items hold a link."""
        item = lambda: self.linked(self.words(self.rng.randint(2, 9)), True) if self.rng.random() < 0.2 else self.put(self.sentence(low, high) if self.rng.random() < 0.5 else " ".join(self.words(self.rng.randint(1, high))), True)
        return f"<{tag}>" + "".join(f"<li>{item()}{self.rng.choice(['</li>', ''])}" for _ in range(self.rng.randint(1, 7))) + f"</{tag}>"

    def grid(self) -> str:
        rows = "".join(f"<tr>{''.join(f'<td>{self.put(self.sentence(1, 4) if k else chr(32).join(self.words(2)), True)}' for k in range(self.rng.randint(1, 4)))}" for _ in range(self.rng.randint(1, 5)))
        return f"<table>{rows}</table>"

    def piece(self) -> str:
        """Something an article holds, seldom an advert, a sidebar or a form."""
        rng, kind = self.rng, self.rng.random()
        if rng.random() < 0.06:
            return self.advert()
        if kind < 0.62:
            return f"<p>{self.paragraph()}{rng.choice(['</p>', '</p>', ''])}"
        if kind < 0.66:
            return f"<div>{self.paragraph()}</div>"
        if kind < 0.75:
            return f"<h{(n := rng.randint(2, 4))}>{self.put(' '.join(self.words(rng.randint(1, 6))), True)}</h{n}>"
        if kind < 0.84:
            return self.items(rng.choice(["ul", "ol"]), 2, 9)
        if kind < 0.87:
            return f"<blockquote>{rng.choice(['', '<p>'])}{self.put(self.sentence(), True)}</blockquote>"
        if kind < 0.89:
            return self.grid()
        if kind < 0.91:
            return f"<pre>{self.put(' '.join(self.words(6)), True)}</pre>"
        if kind < 0.93:
            return f"<figure><img src='x'><figcaption>{self.put(self.sentence(3, 9), True)}</figcaption></figure>"
        if kind < 0.945:
            return "<dl>" + "".join(f"<dt>{self.put(' '.join(self.words(2)), True)}<dd>{self.put(self.sentence(2, 9), True)}" for _ in range(3)) + "</dl>"
        return rng.choice([self.advert, self.aside, self.form, self.share])()

    def share(self) -> str:
        links = "".join(f"<li><a href='#'>{self.put(self.words(1)[0], False)}</a></li>" for _ in range(self.rng.randint(2, 4)))
        return f"<ul{self.name('share', 'social', 'tags', 'pagination', 'breadcrumb', 'breadcrumbs', 'meta')}>{links}</ul>"

    def trail(self) -> str:
        """Links on one line, in an element without a name."""
        words = [" ".join(self.words(self.rng.randint(1, 2))) for _ in range(self.rng.randint(2, 6))]
        if self.rng.random() < 0.25:
            self.labels += [(w, False) for w in words]
            return "<table><tr>" + "".join(f'<td><a href="/{k}">{w}</a>' for k, w in enumerate(words)) + "</table>"
        sep = self.rng.choice([" | ", " · ", " » ", " "])
        self.labels.append((" ".join(sep.join(words).split()), False))
        tag = self.rng.choice(["p", "div"])
        return f"<{tag}>" + sep.join(f'<a href="/{k}">{w}</a>' for k, w in enumerate(words)) + f"</{tag}>"

    def story(self, bare: bool) -> str:
        """What an article holds: of many lengths, from one word to many pieces; some are lists or tables alone."""
        rng = self.rng
        title = " ".join(self.words(rng.randint(1, 10))).capitalize()
        if not bare and rng.random() < 0.08:
            title = rng.choice(["All rights reserved.", " | ".join(self.words(rng.randint(2, 7))) + " |"])
        kind = rng.random()
        if kind < 0.12:
            text = " ".join(self.words(rng.randint(1, 3))) if rng.random() < 0.6 else self.sentence()
            return "".join(f"<p>{self.put(text, True)}</p>" for _ in range(rng.choice([1, 1, 2])))
        if kind < 0.24:
            head = f"<h{(n := rng.randint(1, 3))}>{self.put(title, True)}</h{n}>" if rng.random() < 0.8 else ""
            return head + (self.items(rng.choice(["ol", "ul"]), 1, 6) if rng.random() < 0.7 else self.grid())
        if kind < 0.27:
            return self.put(self.prose(), True)
        head = f"<h1>{self.put(title, True)}</h1>" if rng.random() < 0.85 else ""
        if head and not bare and rng.random() < 0.15:
            head = f"<header>{head}{f'<p>{self.put(self.sentence(), True)}</p>' if rng.random() < 0.5 else ''}</header>"
        inner = "".join(self.piece() for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6, 9, 14])))
        if not bare and rng.random() < 0.08:
            inner += f"<footer>{self.trail() if rng.random() < 0.5 else self.share()}</footer>"
        return head + inner

    def article(self) -> str:
        """The story in an element of its own or in nested ones, or bare."""
        rng = self.rng
        self.bare = rng.random() < 0.2
        inner = self.story(self.bare)
        if self.bare:
            return inner
        if rng.random() < 0.1:
            inner += self.comments()
        if rng.random() < 0.15:
            n = rng.randint(1, 3)
            return "<div>" * n + inner + "</div>" * n
        names = self.name("content", "article", "post", "entry", "story", "main", "text", "body", "prose", "markdown", "page") if rng.random() < 0.75 else ""
        if rng.random() < 0.2:
            inner = f"<div{names}>{inner}</div>"
            names = ""
        tag = rng.choice(["article", "article", "main", "div", "section"])
        return f"<{tag}{names if tag != 'article' or rng.random() < 0.3 else ''}>{inner}</{tag}>"

    def wrapped(self, parts: list[str], chance: float) -> list[str]:
        if self.rng.random() >= chance:
            return parts
        tag = self.rng.choice(["div", "div", "div", "main", "section"])
        return [f"<{tag}{self.name('page', 'site', 'wrapper', 'container', 'content', 'main', 'layout', 'app', 'row', 'columns', 'outer', 'body')}>", *parts, f"</{tag}>"]

    def page(self) -> str:
        rng = self.rng
        maybe = lambda chance, make: [make()] if rng.random() < chance else []
        if rng.random() < 0.02:  # nothing but text
            return self.put(self.prose(), True)
        if rng.random() < 0.12:  # nothing but the article
            return f"<html><body>{''.join(self.wrapped([self.article()], 0.2))}</body></html>"
        top = maybe(0.35, self.notice) + maybe(0.5, self.page_header) + maybe(0.75, lambda: self.menu(rng.choice(["nav", "div", "nav"]))) + maybe(0.1, self.trail)
        middle = maybe(0.4, self.advert) + maybe(0.15, self.form) + maybe(0.15, self.aside) + maybe(0.1, self.share) + [self.article()]
        middle += maybe(0.25, self.comments) + maybe(0.3, self.aside) + maybe(0.2, self.form) + maybe(0.25, self.advert)
        end = maybe(0.12, self.notice) + maybe(0.08, self.trail) + maybe(0.85, self.footer)
        parts = self.wrapped([*top, *self.wrapped(middle, 0.35), *end], 0.3)
        return f"<!DOCTYPE html><html><head><title>{self.words(1)[0]}</title><style>p{{}}</style></head><body>{''.join(parts)}</body></html>"


def labelled_pages(n: int = PAGES, seed: int = SEED) -> list[tuple[list[Block], list[bool]]]:
    """Composed pages as blocks and labels."""
    out = []
    for k in range(n):
        composer = Composer(random.Random(seed * 1_000_003 + k))
        found = blocks(composer.page())
        if [b.text for b in found] != [t for t, _ in composer.labels]:
            raise ValueError("a composed page's blocks differ from what was put in")
        out.append((found, [label for _, label in composer.labels]))
    return out


@lru_cache(maxsize=4)
def trained(n: int = PAGES, seed: int = SEED) -> Model:
    return train(labelled_pages(n, seed))


def _extract(model: Model):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "html"):
            texts = pa.array([model.extract(h) for h in batch.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), texts], ["page_id", "url", "text"])

    return rows


def main_texts(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text for every row of ``pages``; a null html has the empty text, repeated rows are alike."""
    rows = pages.select(F.col("page_id").cast("long"), "url", "html")
    return rows.mapInArrow(_extract(model or trained()), "page_id long, url string, text string")


def op5(pages: DataFrame) -> DataFrame:
    return main_texts(pages).withColumn("n_chars", F.length("text").cast("long"))
