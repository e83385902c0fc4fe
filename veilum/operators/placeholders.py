"""Typed, numbered placeholders: numbering, redaction and the reversible map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilum.functions import patterns as P
from veilum.functions.offsets import each, empty, let

ENTRY = "struct<placeholder:string,type:string,original:string>"


def _suffix(tag: Column | str | None) -> Column:
    tag = F.lit(tag) if tag is None or isinstance(tag, str) else tag
    return F.coalesce(F.concat(F.lit("-"), F.when(F.length(tag) > 0, tag)), F.lit(""))


def reserved(text: Column) -> Column:
    """Placeholders that the text holds already."""
    return F.when(text.contains("["), F.array_distinct(F.regexp_extract_all(text, F.lit(P.PLACEHOLDER), F.lit(0)))).otherwise(F.array().cast("array<string>"))


def entries(text: Column, spans: Column, tag: Column | str | None = None) -> Column:
    """array<ENTRY>: one for each distinct (type, value), by type in order of its first appearance, then in order of first
    appearance. Numbers count up for each type and skip placeholders that the text holds.
    """

    def numbered(s):
        token = lambda kind, n: F.concat(F.lit("["), kind, F.lit("-"), n.cast("string"), s["tail"], F.lit("]"))

        def of(kind):
            def listed(values):
                numbers = F.sequence(F.lit(1), F.size(values) + F.size(s["held"]))
                free = F.when(F.size(s["held"]) > 0, F.filter(numbers, lambda n: ~F.array_contains(s["held"], token(kind, n)))).otherwise(numbers)
                entry = lambda ns: F.transform(values, lambda v, i: F.struct(token(kind, F.get(ns, i)).alias("placeholder"), kind.alias("type"), v["value"].alias("original")))
                return let(free, entry)

            return let(F.filter(s["keys"], lambda k: k["type"] == kind), listed)

        return F.flatten(F.transform(F.array_distinct(F.transform(s["keys"], lambda k: k["type"])), of))

    keys = F.array_distinct(F.transform(spans, lambda s: F.struct(s["type"].alias("type"), s["value"].alias("value"))))
    return F.when(F.size(spans) > 0, let(F.struct(keys.alias("keys"), reserved(text).alias("held"), _suffix(tag).alias("tail")), numbered)).otherwise(empty(ENTRY))


def redact(text: Column, spans: Column, listed: Column) -> Column:
    """The text with each span replaced by its entry's placeholder."""

    def built(s):
        token = lambda x: F.get(F.filter(s["listed"], lambda e: (e["type"] == x["type"]) & (e["original"] == x["value"])), F.lit(0))["placeholder"]
        begin = lambda i: F.when(i > 0, F.get(s["spans"], i - 1)["end"]).otherwise(0)
        parts = F.transform(s["spans"], lambda x, i: F.concat(F.substring(s["text"], begin(i) + 1, x["start"] - begin(i)), token(x)))
        last = F.element_at(s["spans"], -1)["end"]
        return F.concat(F.array_join(parts, ""), F.substring(s["text"], last + 1, F.length(s["text"])))

    return F.when(F.size(spans) > 0, let(F.struct(text.alias("text"), spans.alias("spans"), listed.alias("listed")), built)).otherwise(text)


def anonymize(docs: DataFrame, text: str = "text", tag: str | None = None) -> DataFrame:
    """``docs`` (with a column spans) plus entries and redacted."""
    out = docs.withColumn("entries", entries(F.col(text), F.col("spans"), tag))
    return out.withColumn("redacted", redact(F.col(text), F.col("spans"), F.col("entries")))


def counts(listed: Column) -> Column:
    """map<type, number of distinct values>."""
    types = F.array_sort(F.array_distinct(F.transform(listed, lambda e: e["type"])))
    pair = lambda t: F.struct(t, F.size(F.filter(listed, lambda e: e["type"] == t)))
    return F.map_from_entries(F.transform(types, pair))


def map_entries(docs: DataFrame, *keep: str) -> DataFrame:
    """The map as a long table: the columns kept, placeholder, type, original."""
    return each(docs, keep, "entries", "e").select(*keep, "e.placeholder", "e.type", "e.original")


def number_spans(spans: DataFrame, *doc: str) -> DataFrame:
    """Numbers for a long table of spans (``doc`` columns, start, type, value): rank by first appearance in document and
    type. For documents whose spans outgrow one row; windows hold the values of one document and type."""
    firsts = spans.groupBy(*doc, "type", "value").agg(F.min("start").alias("first"))
    return firsts.withColumn("number", F.row_number().over(Window.partitionBy(*doc, "type").orderBy("first")))


def tag_of(listed: Column) -> Column:
    """The tag of the first placeholder that has one."""
    tags = F.transform(listed, lambda e: F.regexp_extract(e["placeholder"], r"^\[[A-Z][A-Z0-9_]*-[0-9]+-([0-9a-f]{4,8})\]$", 1))
    return F.get(F.filter(tags, lambda t: F.length(t) > 0), F.lit(0))


WIDEST = 8


def new_tags(run_ids: DataFrame, taken: DataFrame, seed: int = 0, width: int = 6, tries: int = 64) -> DataFrame:
    """run_id -> tag: hex tags that no earlier run holds (``taken``: column tag) and no two runs share; one for every run.

    Each run draws ``tries`` tags from its hash; draws that are taken go by an anti-join, and of runs that draw the same tag
    the smallest id keeps it. Runs that get none draw again among tags of 8 digits, the most that a placeholder may have;
    where those run out too, a RuntimeError.
    """
    out = _drawn_tags(run_ids, taken, seed, width, tries)
    for round_ in range(1, 4):
        left = run_ids.select("run_id").distinct().join(out, "run_id", "left_anti")
        if not left.limit(1).count():
            return out
        out = out.unionByName(_drawn_tags(left, taken.select("tag").unionByName(out.select("tag")), seed + round_, WIDEST, tries))
    raise RuntimeError("no free tags are left")


def _drawn_tags(run_ids: DataFrame, taken: DataFrame, seed: int, width: int, tries: int) -> DataFrame:
    draws = run_ids.select("run_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(tries)), lambda n: F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("run_id").cast("string"), n.cast("string")), 256), 1, width))).alias("draw", "tag"))
    free = draws.join(taken.select("tag").distinct(), "tag", "left_anti")
    owned = free.groupBy("tag").agg(F.min(F.struct("draw", "run_id")).alias("o")).select("tag", "o.run_id", "o.draw")
    return owned.groupBy("run_id").agg(F.min_by("tag", "draw").alias("tag"))
