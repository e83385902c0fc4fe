"""Matches of a pattern with code-point offsets, as Spark expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,value:string>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def empty(kind: str = SPAN) -> Column:
    return F.array().cast(f"array<{kind}>")


BLOCK = 256


def running(sizes: Column) -> Column:
    """array<int>: the sum of all elements before each one.

    An array grows by copying, so sums go by blocks: first over the blocks, then inside each; n elements cost about
    n * BLOCK copies and not n * n.
    """

    def add(state, x):
        return F.struct((state["at"] + x).alias("at"), F.array_append(state["out"], state["at"]).alias("out"))

    def sums(values, first):
        return F.aggregate(values, F.struct(first.alias("at"), F.array().cast("array<int>").alias("out")), add)["out"]

    def blocked(a):
        count = F.ceil(F.size(a) / BLOCK).cast("int")
        part = lambda i: F.slice(a, i * BLOCK + 1, F.lit(BLOCK))
        totals = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.aggregate(part(i), F.lit(0), lambda t, x: t + x))
        inside = lambda starts: F.flatten(F.transform(starts, lambda first, i: sums(part(i), first)))
        return F.when(F.size(a) <= BLOCK, sums(a, F.lit(0))).otherwise(let(sums(totals, F.lit(0)), inside))

    return let(sizes, blocked)


def kept_in_order(items: Column, state: Column, take: Callable, kind: str) -> Column:
    """array<kind>: a fold over items that keeps some. ``take(state, item)`` gives (whether, next state, what is kept).

    A fold copies its state at every step, so it runs over blocks, and inside each over its items: n items that are all kept
    cost about n * BLOCK + n * n / BLOCK copies.
    """

    def block(first, part):
        def step(s, item):
            whether, after, out = take(s["state"], item)
            return F.when(~whether, s).otherwise(F.struct(after.alias("state"), F.array_append(s["out"], out).alias("out")))

        return F.aggregate(part, F.struct(first.alias("state"), empty(kind).alias("out")), step)

    def folded(a):
        count = F.ceil(F.size(a) / BLOCK).cast("int")
        start = F.struct(state.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("done"))
        add = lambda s, r: F.struct(r["state"].alias("state"), F.array_append(s["done"], r["out"]).alias("done"))
        step = lambda s, i: let(block(s["state"], F.slice(a, i * BLOCK + 1, F.lit(BLOCK))), lambda r: add(s, r))
        whole = F.aggregate(F.sequence(F.lit(0), count - 1), start, step, lambda s: F.flatten(s["done"]))
        return F.when(F.size(a) <= BLOCK, block(state, a)["out"]).otherwise(whole)

    return let(items, folded)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<SPAN> of all non-overlapping matches from left to right; starts at 0, end exclusive.

    With ``group`` 1 the span is that of the group, which must end where the match ends. A text without a match costs one
    search; null gives null. Lengths of the texts between matches and of the matches add up to the offsets.
    """

    def located(t):
        found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        values = F.regexp_extract_all(t, F.lit(pattern), F.lit(group)) if group else found
        parts = F.struct(F.split(t, pattern, -1).alias("gaps"), found.alias("found"), values.alias("values"))

        def spans(p):
            sizes = F.transform(p["found"], lambda m, i: F.length(F.get(p["gaps"], i)) + F.length(m))

            def span(starts):
                def one(m, i):
                    end = F.get(starts, i) + F.length(F.get(p["gaps"], i)) + F.length(m)
                    value = F.get(p["values"], i)
                    return F.struct((end - F.length(value)).alias("start"), end.alias("end"), value.alias("value"))

                return F.transform(p["found"], one)

            return let(running(sizes), span)

        return let(parts, spans)

    return F.when(text.isNull(), F.lit(None)).when(text.rlike(pattern), let(text, located)).otherwise(empty())


def each(df: DataFrame, keep: Sequence[str | Column], array: Column | str, name: str) -> DataFrame:
    """A row for each element of an array: the columns kept and the element.

    For a plain explode the optimizer adds a filter on the array's size below it, which computes a long expression again;
    the outer form has none, and the rows of empty arrays go by their null element.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def line_of(text: Column, start: Column) -> Column:
    """1-based line of a 0-based offset; only line feeds count."""
    head = F.substring(text, F.lit(1), start)
    return F.length(head) - F.length(F.translate(head, "\n", "")) + 1


def masked(value: Column) -> Column:
    """First character, then a bullet for each other one."""
    return F.concat(F.substring(value, 1, 1), F.repeat(F.lit("•"), F.greatest(F.length(value) - 1, F.lit(0))))


def starts_of(text: Column, literal: Column, limit: int = 0) -> Column:
    """array<int>: offsets of non-overlapping occurrences of a literal, the first ``limit`` of them if given."""

    def located(s):
        quoted = F.concat(F.lit("\\Q"), F.replace(s["v"], F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
        pieces = F.split(s["t"], quoted, limit + 1 if limit else -1)
        sizes = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.length(p) + F.length(s["v"]))
        return let(running(sizes), lambda starts: F.transform(starts, lambda a, i: a + F.get(sizes, i) - F.length(s["v"])))

    none = F.array().cast("array<int>")
    return F.when(text.contains(literal) & (F.length(literal) > 0), let(F.struct(text.alias("t"), literal.alias("v")), located)).otherwise(none)
