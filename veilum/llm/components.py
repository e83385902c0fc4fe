"""Connected components of a table of links, by alternating large and small stars.

Each round is two aggregations with joins back; no neighbourhood is ever gathered in one place, and each round's links are
written to the shared folder, so the lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilum.llm._store import drop_folder, new_folder, written


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``links``: long columns u and v. Returns node, root (the smallest node of its component) for all nodes but roots.

    Repeated links, links of a node to itself and an empty table are fine; links with a null end are ignored.
    """
    spark = links.sparkSession
    folder = new_folder(spark, "links")
    now = written(links.where("u is not null and v is not null and u != v").select("u", "v"), "links", folder)
    state = _state(now)
    while state[0]:
        after_folder = new_folder(spark, "links")
        after = written(_small_star(_large_star(now)), "links", after_folder)
        drop_folder(spark, folder)
        before, state, now, folder = state, _state(after), after, after_folder
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
