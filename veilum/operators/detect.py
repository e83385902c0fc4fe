"""Detection: candidates of all rules and of the dictionary, overlaps resolved, as one expression over a text."""

from __future__ import annotations

from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilum.functions import patterns as P
from veilum.functions.offsets import each, empty, kept_in_order, let, matches
from veilum.functions.rules import ANY_DIGIT, DICTIONARY_PRIORITY, chosen
from veilum.functions.validators import is_safe

#: Field order is the order of precedence: earlier start, longer, smaller priority, smaller place in its list.
CANDIDATE = "struct<start:int,shorter:int,priority:int,place:int,end:int,type:string,value:string>"
FOUND = "struct<start:int,end:int,type:string,value:string>"
HIT = "struct<start:int,end:int,type:string,value:string,place:int>"


def _candidate(span: Column, kind: Column, priority: int, place: Column) -> Column:
    return F.struct(
        span["start"].alias("start"),
        (span["start"] - span["end"]).alias("shorter"),
        F.lit(priority).alias("priority"),
        place.alias("place"),
        span["end"].alias("end"),
        kind.alias("type"),
        span["value"].alias("value"),
    )


def candidates(text: Column, hits: Column | None = None, families=None, heuristics: bool = True) -> Column:
    """array<CANDIDATE>, sorted; placeholders and what touches them, and safe values, are left out.

    ``hits``: array<HIT> from a dictionary scan.
    """
    taken = F.when(text.contains("["), matches(text, P.PLACEHOLDER)).otherwise(empty())

    def listed(about):
        def of(rule, priority):
            return F.transform(rule.spans(text, about["digit"]), lambda s, i: _candidate(s, F.lit(rule.type), priority, i))

        lists = [of(rule, priority) for priority, rule in chosen(families, heuristics)]
        if hits is not None:
            lists.append(F.transform(F.coalesce(hits, empty(HIT)), lambda h: _candidate(h, h["type"], DICTIONARY_PRIORITY, h["place"])))
        clear = lambda c: ~F.exists(about["taken"], lambda p: (c["start"] < p["end"]) & (p["start"] < c["end"])) & (c["end"] > c["start"]) & ~is_safe(c["value"])
        return F.sort_array(F.filter(F.concat(empty(CANDIDATE), *lists), clear))

    return let(F.struct(text.rlike(ANY_DIGIT).alias("digit"), taken.alias("taken")), listed)


def resolved(found: Column) -> Column:
    """Greedy sweep over sorted candidates: each that starts at or after the end of the last taken one is taken."""

    def take(end, c):
        span = F.struct(c["start"].alias("start"), c["end"].alias("end"), c["type"].alias("type"), c["value"].alias("value"))
        return c["start"] >= end, c["end"], span

    return kept_in_order(found, F.lit(0), take, FOUND)


def detect(text: Column, hits: Column | None = None, families=None, heuristics: bool = True) -> Column:
    """array<FOUND>: the sensitive spans of a text, in order, without overlaps; null for a null text."""
    return F.when(text.isNotNull(), resolved(candidates(text, hits, families, heuristics)))


@lru_cache(maxsize=64)
def _built(gateway: int, text: str, hits: str | None, families: frozenset | None, heuristics: bool) -> Column:
    return detect(F.col(text), F.col(hits) if hits else None, families, heuristics)


def spans_of(text: str, hits: str | None = None, families=None, heuristics: bool = True) -> Column:
    """``detect`` over columns by name. The expression is large, and building it once is enough."""
    return _built(id(SparkContext._gateway), text, hits, None if families is None else frozenset(families), heuristics)


def with_spans(docs: DataFrame, text: str = "text", hits: str | None = None, families=None, heuristics: bool = True) -> DataFrame:
    """``docs`` with a column spans."""
    return docs.withColumn("spans", spans_of(text, hits, families, heuristics))


def exploded(docs: DataFrame, *keep: str) -> DataFrame:
    """A row for each span: the columns kept, then start, end, type, value."""
    return each(docs, keep, "spans", "span").select(*keep, "span.start", "span.end", "span.type", "span.value")
