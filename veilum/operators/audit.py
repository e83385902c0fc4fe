"""Findings, verdicts and near misses."""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilum.functions import patterns as P
from veilum.functions.offsets import let, line_of, masked
from veilum.operators.dictionary import fold_name

CHECK_CAP, AUDIT_CAP = 20, 50
#: Every word of a text counts (the reference stops at the 400th).
WORD_LIMIT = None
VOCABULARY_LIMIT, CUTOFF, MIN_KEY = 200, 0.86, 5
NEAR = "kind string, type string, line int, similarity double, token_masked string, token string, entity string"
_NEAR = pa.schema([(f, {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}[t]) for f, t in (c.split() for c in NEAR.split(", "))])
#: Rows that are Python objects at a time; how many words, and how long ones, a task remembers with what they mean; about how many
#: characters of a text are words at a time.
SLICE_ROWS, CACHED_WORDS, CACHED_LENGTH, BLOCK = 64, 1 << 16, 64, 1 << 20
_WORD, _SPACE = regex.compile(P.NEAR_WORD), regex.compile(r"\s")


def findings(text: Column, spans: Column, cap: int = CHECK_CAP) -> Column:
    """struct(total, truncated, findings of type and line)."""
    listed = lambda s: F.transform(F.slice(s["s"], 1, cap), lambda x: F.struct(x["type"].alias("type"), line_of(s["t"], x["start"]).alias("line")))
    use = lambda s: F.struct(F.size(s["s"]).alias("total"), (F.size(s["s"]) > cap).alias("truncated"), listed(s).alias("findings"))
    return let(F.struct(text.alias("t"), spans.alias("s")), use)


def types_of(spans: Column) -> Column:
    """map<type, spans>."""
    types = F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["type"])))
    return F.map_from_entries(F.transform(types, lambda t: F.struct(t, F.size(F.filter(spans, lambda s: s["type"] == t)))))


def placeholders_present(text: Column) -> Column:
    return F.regexp_count(text, F.lit(P.PLACEHOLDER))


def verdict(n_found: Column, n_near: Column, scannable: Column | None = None) -> Column:
    """sensitive if anything was found or the text couldn't be read, else suspicious with near misses, else clean."""
    sensitive = n_found > 0 if scannable is None else (n_found > 0) | ~scannable
    return F.when(sensitive, "sensitive").when(n_near > 0, "suspicious").otherwise("clean")


def free_words(text: str, starts: list[int], ends: list[int]) -> Iterator[tuple[int, int, str]]:
    """The words that no span covers: start, end, value. Spans are in order and don't overlap."""
    k = 0
    for word in _WORD.finditer(text):
        start, end = word.span()
        while k < len(ends) and ends[k] <= start:
            k += 1
        if k == len(ends) or starts[k] >= end:
            yield start, end, word[0]


def word_blocks(text: str) -> Iterator[list[str]]:
    """All words of a text, a block at a time. No word holds white space, so blocks end there."""
    at = 0
    while at < len(text):
        space = _SPACE.search(text, at + BLOCK)
        end = space.start() if space else len(text)
        yield _WORD.findall(text, at, end)
        at = end


class _Known(dict):
    """Remembers what words mean, up to a number of them, then begins anew."""

    def __init__(self, about: Callable):
        super().__init__()
        self.about = about

    def __missing__(self, word: str):
        meaning = self.about(word)
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = meaning
        return meaning


def near_misses(docs: DataFrame, names: list[tuple[str, str]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Words of ``docs`` (columns key, text, spans) that almost spell a name: one row for each.

    ``names``: (type, surface) in dictionary order. Two or three neighbouring words of a line, or one word, that fold to a
    name's key are variants; else a word whose key is like a name's (Ratcliff and Obershelp's ratio, ties to the larger key)
    is near. The names are broadcast with the function. Words are found in Python, a few rows at a time; all words of a text
    are first looked up without their places, which most texts without a name don't need.
    """
    vocabulary: dict[str, tuple[str, str]] = {}
    for kind, surface in names:
        folded = fold_name(surface)
        if len(folded) >= MIN_KEY:
            vocabulary.setdefault(folded, (kind, surface))
    known = list(vocabulary)[:VOCABULARY_LIMIT]
    begins = {k[:i] for k in vocabulary for i in range(len(k) + 1)}
    # By the length of a value: the keys that may be like it, and how many of a key's letters it may lack for the ratio to be reached.
    like: dict[int, list[tuple[str, frozenset[str], int]]] = {}
    for k in known:
        for n in range(1, 2 * len(k)):
            spare = [j for j in range(max(0, len(k) - n), len(k)) if 2.0 * (len(k) - j) / (n + len(k)) >= CUTOFF]
            if spare:
                like.setdefault(n, []).append((k, frozenset(k), spare[-1]))

    def about(value: str) -> tuple[str, bool, tuple | None]:
        """What a word folds to, whether it is or may begin a name, and the name that it spells or is like: kind, key, similarity."""
        folded = fold_name(value)
        meant = None
        if len(value) >= MIN_KEY and folded in vocabulary:
            meant = "variant", folded, 1.0
        elif (
            len(value) >= MIN_KEY
            and (may := [k for k, letters, spare in like.get(len(folded), ()) if len(letters.difference(folded)) <= spare])
            and (close := difflib.get_close_matches(folded, may, n=1, cutoff=CUTOFF))
        ):
            meant = "near", close[0], round(difflib.SequenceMatcher(None, folded, close[0]).ratio(), 3)
        return folded, meant is not None or folded in begins, meant

    # Words hold no white space, so what neighbours fold to together is what each folds to, joined.
    def may_hit(text: str, about: _Known) -> bool:
        """Whether words of a text, on one line or not, spell a name or are like one."""
        told: list[tuple] = []
        for words in word_blocks(text):
            told = [*told[-2:], *map(about.__getitem__, words)]
            for i in [i for i, t in enumerate(told) if t[1]]:
                if told[i][2] or any("".join(t[0] for t in told[i : i + size]) in vocabulary for size in (2, 3)):
                    return True
        return False

    def of(text: str, words: Iterator[tuple[int, int, str]], about: _Known) -> list[dict]:
        runs: dict[str, dict] = {}
        single: dict[str, dict] = {}
        line, counted = 1, 0

        def hit(at, label, kind, name, similarity):
            nonlocal line, counted
            line, counted = line + text.count("\n", counted, at), at
            kind_of, entity = vocabulary[name]
            return {"kind": kind, "type": kind_of, "line": line, "similarity": similarity, "token_masked": label[:1] + "•" * (len(label) - 1), "token": label, "entity": entity}

        window: list = []  # three words, of which the first is looked at
        for word in chain(words, (None, None)):
            window.append(word and (*word, *about[word[2]]))
            if len(window) < 3:
                continue
            start, end, value, folded, stirs, meant = window[0]
            if stirs:
                joined, last = folded, end
                for following in window[1:]:
                    if not following or "\n" in text[last : following[0]]:
                        break
                    joined, last = joined + following[3], following[1]
                    if joined in vocabulary and joined not in runs:
                        runs[joined] = hit(start, text[start:last], "variant", joined, 1.0)
                if meant and folded not in single:
                    single[folded] = hit(start, value, *meant)
            window.pop(0)
        return sorted([*runs.values(), *(h for k, h in single.items() if k not in runs)], key=lambda h: (-h["similarity"], h["token_masked"]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meanings = _Known(about)
        for batch in batches if vocabulary else ():
            for first in range(0, batch.num_rows, SLICE_ROWS):  # a whole batch as Python objects is many times its size
                part = batch.slice(first, SLICE_ROWS)
                # Words on both sides of spans are neighbours, so texts with spans are always read with places.
                told = ((i, t, s or [], e or []) for i, (t, s, e) in enumerate(zip(*(part.column(c).to_pylist() for c in (1, 2, 3)), strict=True)) if t)
                found = [(i, hit) for i, t, s, e in told if s or may_hit(t, meanings) for hit in of(t, free_words(t, s, e), meanings)]
                if found:
                    keys = part.column(0).take(pa.array([i for i, _ in found]))
                    yield pa.RecordBatch.from_arrays([keys, *(pa.array([hit[f.name] for _, hit in found], f.type) for f in _NEAR)], [key, *_NEAR.names])

    covered = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))
    return covered.mapInArrow(rows, f"{key} {docs.schema[key].dataType.simpleString()}, {NEAR}")


def shown(report: DataFrame, reveal: bool = False) -> DataFrame:
    """Without ``reveal``, a report has no values."""
    return report if reveal else report.drop("token", "entity", "value", "original")


def mask(value: Column) -> Column:
    return masked(value)
