"""Occurrences of many names in a text, in one pass: the worker side of dictionary scans.

The JVM has no search for thousands of names at once, so texts go to Python in Arrow batches. An Aho-Corasick automaton over
the names' folded first words finds where a name may begin, in time that doesn't depend on their number. Names that share a
first word are told apart by the word that follows, names that share a context look for it once at each place, and what is
left is matched by the name's own pattern.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex

from veilum.functions import patterns as P

HIT = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("type", pa.string()), ("value", pa.string()), ("place", pa.int32())])
_WORD = regex.compile(f"[{P.W}]+")
_GAP = regex.compile(P.NAME_GAP)
_WORD_CHAR = regex.compile(f"[{P.W}]")


def _simple(c: str) -> str:
    """The one character that c and its other cases fold to."""
    for turned in (c.upper(), c.upper().lower()):
        c = turned if len(turned) == 1 else c
    return c


@lru_cache(maxsize=1)
def _unlike_lower() -> dict[int, str]:
    """Characters whose simple folding is not what lower() makes of them, or whose lower case depends on what follows."""
    out = {k: f for k in range(128, 0x2FFFF) if not 0xD800 <= k < 0xE000 and (f := _simple(chr(k))) != chr(k).lower()}
    return out | {ord(c): s for c, s in zip("İıΣς", "iiσσ", strict=True)}


def fold(text: str) -> str:
    """Equal for texts that match without regard to case; every character stays one."""
    return text.lower() if text.isascii() else text.translate(_unlike_lower()).lower()


class Name:
    """One variant of an entry. ``body``: its pattern from the first character on."""

    __slots__ = ("place", "type", "words", "open_end", "context", "body", "_compiled", "ended")

    def __init__(self, place: int, type: str, words: list[str], open_end: bool, context: str | None, body: str):
        self.place, self.type, self.words, self.open_end, self.context, self.body = place, type, words, open_end, context, body
        self._compiled, self.ended = None, -1

    @property
    def pattern(self):
        if self._compiled is None:
            self._compiled = regex.compile(self.body)
        return self._compiled

    def second(self) -> str | None:
        """The folded word run that must follow the first word and a gap; None where that isn't certain."""
        if len(self.words) < 2 or (self.open_end and len(self.words) == 2):
            return None
        run = _WORD.match(self.words[1])
        return fold(run[0]) if run else None


class Scanner:
    def __init__(self, names: Iterable[Name]):
        self.first: dict[str, dict[str | None, list[Name]]] = {}
        self.contexts: dict[str, regex.Pattern] = {}
        for name in names:
            self.first.setdefault(fold(name.words[0]), {}).setdefault(name.second(), []).append(name)
            if name.context and name.context not in self.contexts:
                self.contexts[name.context] = regex.compile(f"(?ri)(?:{name.context})")
        self.names = [n for groups in self.first.values() for listed in groups.values() for n in listed]
        self.automaton = ahocorasick.Automaton()
        for word in self.first:
            self.automaton.add_word(word, word)
        if self.first:
            self.automaton.make_automaton()

    def hits(self, text: str | None) -> list[tuple[int, int, str, str, int]]:
        """(start, end, type, value, place) of every entry's matches from left to right, none of one entry overlapping."""
        if not text or not self.first:
            return []
        folded, out, met = fold(text), [], []
        at = sorted((end - len(word) + 1, word) for end, word in self.automaton.iter(folded))
        told: dict[tuple[str, int], int] = {}  # where the context that ends at a place begins
        for start, word in at:
            if start and _WORD_CHAR.match(text, start - 1):
                continue
            groups = self.first[word]
            listed = groups.get(None, ())
            if len(groups) > (None in groups):
                gap = _GAP.match(text, start + len(word))
                run = gap and _WORD.match(folded, gap.end())
                listed = [*listed, *groups.get(run[0], ())] if run else listed
            for name in listed:
                begin = start
                if name.context:
                    begin = self._context(text, name.context, start, told)
                    if begin is None:
                        continue
                if begin < name.ended:
                    continue
                found = name.pattern.match(text, start)
                if found and found.end(1) > start:
                    name.ended = found.end()
                    met.append(name)
                    out.append((start, found.end(1), name.type, found[1], name.place))
        for name in met:
            name.ended = -1
        return list(dict.fromkeys(out))

    def _context(self, text: str, context: str, start: int, told: dict) -> int | None:
        key = (context, start)
        if key not in told:
            found = self.contexts[context].match(text, 0, start)
            told[key] = found.start() if found else None
        return told[key]


_scanners: dict[int, Scanner] = {}


def arrow_hits(texts: pa.Array, names: list[tuple], key: int) -> pa.Array:
    """array<HIT> of each text. ``key`` tells dictionaries apart, so that a worker builds one automaton for all its tasks."""
    scanner = _scanners.get(key)
    if scanner is None:
        if len(_scanners) >= 4:
            _scanners.clear()
        scanner = _scanners[key] = Scanner(Name(*n) for n in names)
    found = [scanner.hits(t) for t in texts.to_pylist()]
    flat = [h for hits in found for h in hits]
    columns = [pa.array([h[k] for h in flat], field.type) for k, field in enumerate(HIT)]
    offsets = np.concatenate([[0], np.cumsum([len(h) for h in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, fields=list(HIT)))


def body_of(words: list[str], stem: bool, case_sensitive: bool) -> str:
    """A name's pattern from its first character, the name being group 1."""
    core = P.NAME_GAP.join(re.escape(w) for w in words) + rf"(?:[{P.S}]+{_legal()}(?![a-z0-9]))?"
    if stem:
        core += rf"[{P.W}\-]*"
    core = f"(?-i:{core})" if case_sensitive else core
    # An apostrophe and a letter behind a name is an elided article, unless the letter is a genitive s.
    return rf"(?i)({core})(?![{P.W}])(?!['’](?![sS](?![{P.W}]))[{P.W}])"


def _legal() -> str:
    return P.LEGAL_FORM.replace(r"\s", f"[{P.S}]")
