"""Measures of the detection itself: recall on labelled texts, false positives on clean ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilum.functions import patterns as P
from veilum.functions.offsets import starts_of


def occurrences(corpus: DataFrame, column: str, key: str = "name") -> DataFrame:
    """key, value, type, start, end of every place of the declared values (``column``: array<struct<value,type>>)."""
    declared = corpus.select(key, "text", F.explode(column).alias("d")).select(key, "text", "d.value", "d.type")
    return declared.select(key, "value", "type", F.explode(starts_of(F.col("text"), F.col("value"))).alias("start")).withColumn("end", F.col("start") + F.length("value"))


def _containing(places: DataFrame, spans: DataFrame, key: str, how: str) -> DataFrame:
    s = spans.select(F.col(key).alias("s_key"), F.col("start").alias("s_start"), F.col("end").alias("s_end"), F.col("type").alias("s_type"))
    inside = (F.col(key) == F.col("s_key")) & (F.col("s_start") <= F.col("start")) & (F.col("end") <= F.col("s_end"))
    return places.join(s, inside, how)


def leaks(places: DataFrame, spans: DataFrame, key: str = "name") -> DataFrame:
    """Declared values with places that no span contains: key, value, type, in_clear."""
    return _containing(places, spans, key, "left_anti").groupBy(key, "value", "type").agg(F.count("*").alias("in_clear"))


def recall(corpus: DataFrame, spans: DataFrame, key: str = "name") -> DataFrame:
    """type, declared, covered, typed, recall over must_find: covered if every place is, typed if a span has the type."""
    declared = corpus.select(key, F.explode("must_find").alias("d")).select(key, "d.value", "d.type")
    places = occurrences(corpus, "must_find", key)
    clear = leaks(places, spans, key).select(key, "value", "type").withColumn("leaks", F.lit(True))
    right = _containing(places, spans, key, "inner").where("type = s_type").select(key, "value", "type").distinct().withColumn("right", F.lit(True))
    joined = declared.join(clear, [key, "value", "type"], "left").join(right, [key, "value", "type"], "left")
    covered = F.col("leaks").isNull()
    out = joined.groupBy("type").agg(F.count("*").alias("declared"), F.count_if(covered).alias("covered"), F.count_if(covered & F.col("right").isNotNull()).alias("typed"))
    return out.withColumn("recall", F.round(F.col("covered") / F.col("declared"), 4))


def overlapping(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Interval join of two tables with key, start and end; the right one's columns get the prefix r_."""
    r = right.select(*[F.col(c).alias("r_" + c) for c in right.columns])
    return left.join(r, (F.col(key) == F.col("r_" + key)) & (F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end")), how)


def violations(corpus: DataFrame, spans: DataFrame, key: str = "name") -> DataFrame:
    """Spans that overlap a text that must stay (must_not: array<struct<value,type>>)."""
    return overlapping(occurrences(corpus, "must_not", key), spans, key)


def undeclared(places: DataFrame, spans: DataFrame, key: str = "name") -> DataFrame:
    """Spans that overlap no declared place that is covered."""
    covered = _containing(places, spans, key, "left_semi")
    return overlapping(spans, covered.select(key, "start", "end"), key, "left_anti")


def false_positives(spans: DataFrame, key: str) -> DataFrame:
    """type, matches, files over a corpus that should have none, most first."""
    return spans.groupBy("type").agg(F.count("*").alias("matches"), F.countDistinct(key).alias("files")).orderBy(F.desc("matches"), "type")


def covers(proposal: Column, value: Column) -> Column:
    """Whether replacing the proposal replaces the whole value."""
    return proposal.contains(value)


def names(proposal: Column, value: Column) -> Column:
    """Whether the proposal covers the value or is a part of it between word boundaries."""
    within = F.exists(starts_of(value, proposal), lambda at: ~F.substring(value, at, 1).rlike(f"[{P.W}]") & ~F.substring(value, at + F.length(proposal) + 1, 1).rlike(f"[{P.W}]"))
    return covers(proposal, value) | F.coalesce(within, F.lit(False))


def precision_recall(corpus: DataFrame, proposed: DataFrame, key: str = "name") -> DataFrame:
    """One row over labelled texts (must_find and known_miss: array<struct<value,...>>) and proposals (key, value, overlap):
    proposals, correct (naming a declared value), precision, must_find, covered, recall, already_found, known_miss, closed.

    Values that are declared, and proposals, of one text stay in its row: pairs are made inside it.
    """
    listed = proposed.groupBy(F.col(key).alias("__v_key")).agg(F.collect_list(F.struct("value", "overlap")).alias("p"))
    rows = corpus.join(listed, F.col(key) == F.col("__v_key"), "left").withColumn("p", F.coalesce("p", F.array().cast("array<struct<value:string,overlap:boolean>>")))
    count = lambda items, test: F.size(F.filter(items, test))
    by_proposal = lambda test: lambda p: F.exists("must_find", lambda m: test(p["value"], m["value"]))
    by_value = lambda test: lambda m: F.exists("p", lambda p: test(p["value"], m["value"]))
    per = rows.select(
        F.size("p").alias("proposals"), count("p", by_proposal(names)).alias("correct"), F.size("must_find").alias("must_find"), count("must_find", by_value(covers)).alias("covered"),
        count("p", lambda p: p["overlap"]).alias("already_found"), F.size("known_miss").alias("known_miss"), count("known_miss", by_value(names)).alias("closed"),
    )
    out = per.agg(*[F.sum(c).alias(c) for c in per.columns])
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 3))
    return out.withColumn("precision", share("correct", "proposals")).withColumn("recall", share("covered", "must_find"))


def summary(runs: DataFrame, *by: str) -> DataFrame:
    """Repeated measurements (``by``, seconds, and mb if there is one): best, median, mb_per_second of the best, runs."""
    out = runs.groupBy(*by).agg(F.min("seconds").alias("best"), F.percentile("seconds", F.lit(0.5)).alias("median"), F.count("*").alias("runs"), *([F.max("mb").alias("mb")] if "mb" in runs.columns else []))
    return out.withColumn("mb_per_second", F.when(F.col("best") > 0, F.round(F.col("mb") / F.col("best"), 2))) if "mb" in runs.columns else out
