"""Restoring originals, with a verdict computed from the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilum.functions import patterns as P
from veilum.functions.offsets import each, let


def restorable(listed: Column) -> Column:
    """Entries that have an original."""
    return F.filter(listed, lambda e: e["original"].isNotNull())


def _count(text: Column, token: Column) -> Column:
    return ((F.length(text) - F.length(F.replace(text, token, F.lit("")))) / F.length(token)).cast("int")


def xml_protect(value: Column) -> Column:
    out = value
    for char, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot"), ("'", "apos")):
        out = F.replace(out, F.lit(char), F.lit(f"&{name};"))
    return out


def put_originals(text: Column, listed: Column, protect=None) -> Column:
    """struct(text, replaced): longest placeholder first, each replaced everywhere; ``protect`` maps the originals."""
    order = F.transform(F.sort_array(F.transform(restorable(listed), lambda e: F.struct((-F.length(e["placeholder"])).alias("n"), e["placeholder"].alias("p"), e["original"].alias("o")))), lambda e: e)
    start = F.struct(text.alias("text"), F.lit(0).alias("replaced"))

    def step(s, e):
        value = protect(e["o"]) if protect else e["o"]
        return F.struct(F.replace(s["text"], e["p"], value).alias("text"), (s["replaced"] + _count(s["text"], e["p"])).alias("replaced"))

    return F.aggregate(order, start, step)


def remaining(text: Column, listed: Column) -> Column:
    """Occurrences of known placeholders."""
    return F.aggregate(F.transform(listed, lambda e: _count(text, e["placeholder"])), F.lit(0), lambda a, x: a + x)


def unknown(text: Column, listed: Column) -> Column:
    """Placeholder-shaped tokens that the map doesn't have."""
    found = F.regexp_extract_all(text, F.lit(P.PLACEHOLDER), F.lit(0))
    return F.size(F.filter(found, lambda t: ~F.exists(listed, lambda e: e["placeholder"] == t)))


def restored(docs: DataFrame, text: str = "redacted", listed: str = "entries") -> DataFrame:
    """``docs`` plus restored, replaced, remaining, unknown, complete (nothing left or unknown, something replaced)."""
    out = docs.withColumn("__v_back", let(F.struct(F.col(text).alias("t"), F.col(listed).alias("e")), lambda s: put_originals(s["t"], s["e"])))
    out = out.withColumn("restored", F.col("__v_back.text")).withColumn("replaced", F.col("__v_back.replaced")).drop("__v_back")
    out = out.withColumn("remaining", remaining(F.col("restored"), F.col(listed))).withColumn("unknown", unknown(F.col("restored"), F.col(listed)))
    return out.withColumn("complete", (F.col("remaining") == 0) & (F.col("unknown") == 0) & (F.col("replaced") > 0))


def token_counts(docs: DataFrame, *keep: str, text: str = "redacted", listed: str = "entries") -> DataFrame:
    """``keep``, placeholder, tokens (how often it stands in the text), original (null where unknown).

    The join of a text's placeholders with its entries as one aggregation, so that what made them runs once.
    """
    token = lambda p, o, n: F.struct(p.alias("placeholder"), o.cast("string").alias("original"), n.alias("n"))
    seen = F.transform(F.regexp_extract_all(text, F.lit(P.PLACEHOLDER), F.lit(0)), lambda p: token(p, F.lit(None), F.lit(1)))
    known = F.transform(restorable(F.col(listed)), lambda e: token(e["placeholder"], e["original"], F.lit(0)))
    rows = each(docs, keep, F.concat(seen, known), "x").select(*keep, "x.*")
    return rows.groupBy(*keep, "placeholder").agg(F.sum("n").alias("tokens"), F.max("original").alias("original")).where("tokens > 0")


def restore_from_table(tokens: DataFrame, entries: DataFrame) -> DataFrame:
    """``tokens``: map_id, placeholder, ...; ``entries``: the long map. Adds type and original (null where unknown)."""
    return tokens.join(entries.select("map_id", "placeholder", "type", "original"), ["map_id", "placeholder"], "left")
