"""A folder at a time: what would be done, the redacted copies with their maps, or verdicts only.

Files are listed by their metadata, those out of scope are named with the reason, and only the rest are opened. Texts and
containers are redacted by the expressions that single texts take; each file has a tag of its own. A file that can't be read as
text or container is skipped where copies are made, and counts as sensitive where verdicts are asked for.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilum.operators import audit, mapstore, placeholders, reports
from veilum.plans.api import Engine
from veilum.sources import containers, files



def check_scope(root: str, out: str | None, private: Sequence[str]) -> None:
    """Refuse a folder that is no folder or in a private one, and an output folder that is the folder or above it."""
    plain = files._plain_path(root)
    if plain.startswith("/") and not os.path.isdir(plain):
        raise ValueError(f"{root} is no folder")
    above = lambda a, b: (os.path.realpath(files._plain_path(b)) + "/").startswith(os.path.realpath(files._plain_path(a)).rstrip("/") + "/")
    if any(above(p, root) for p in private):
        raise ValueError(f"{root} is in a private folder")
    if out is not None and above(out, root):
        raise ValueError(f"the output folder {out} is the folder itself or above it")


def _files(spark: SparkSession, engine: Engine, root: str, out: str | None, private: Sequence[str], max_bytes: int) -> tuple[DataFrame, DataFrame]:
    """The listing without files of the output folder, and path, kind, content of those to be opened."""
    listed = files.listing(spark, root, max_bytes, private=private)
    if out is not None:
        listed = listed.where(~F.regexp_replace("path", "^file:/+", "/").startswith(os.path.realpath(files._plain_path(out)) + "/"))
    chosen = [r.path for r in listed.where("skipped is null").select("path").toLocalIterator()]
    opened = files.contents(spark, chosen).withColumn("kind", files.kind(F.col("content")))
    return listed, opened


def verdicts(spark: SparkSession, engine: Engine, root: str, private: Sequence[str] = (), max_bytes: int = files.MAX_BYTES) -> DataFrame:
    """path, relative, skipped, unscannable, total, counts of every file; nothing is written. What can't be scanned is
    sensitive: its total is 1."""
    check_scope(root, None, private)
    listed, opened = _files(spark, engine, root, None, private, max_bytes)
    packs = opened.where("kind = 'container'")
    inside = containers.container_text(containers.read_parts(packs))
    texts = opened.where("kind = 'text'").select("path", files.text_of(F.col("content")).alias(engine.text)).unionByName(inside.select("path", F.col("text").alias(engine.text)))
    found = engine.detect(texts).select("path", F.size("spans").alias("total"), audit.types_of(F.col("spans")).alias("counts"))
    joined = listed.select("path", "relative", "skipped").join(found, "path", "left")
    unread = F.col("skipped").isNull() & F.col("total").isNull()
    total = F.when(F.col("skipped").isNull(), F.coalesce("total", F.lit(1)))
    return joined.select("path", "relative", "skipped", unread.alias("unscannable"), total.alias("total"), "counts")


def redactions(spark: SparkSession, engine: Engine, root: str, out: str | None = None, private: Sequence[str] = (), taken: DataFrame | None = None, max_bytes: int = files.MAX_BYTES, seed: int = 0) -> DataFrame:
    """A row for every file: its new content and entries, or why it is skipped. Nothing is written.

    ``taken``: tags in use (column tag).
    """
    check_scope(root, out, private)
    listed, opened = _files(spark, engine, root, out, private, max_bytes)
    taken = spark.createDataFrame([], "tag string") if taken is None else taken
    tags = placeholders.new_tags(opened.select(F.col("path").alias("run_id")), taken, seed).select(F.col("run_id").alias("__v_run"), "tag")
    opened = opened.join(tags, F.col("path") == F.col("__v_run")).drop("__v_run")
    texts = engine.detect(opened.where("kind = 'text'").select("path", "tag", files.text_of(F.col("content")).alias(engine.text)))
    listed_entries = texts.withColumn("entries", placeholders.entries(F.col(engine.text), F.col("spans"), F.col("tag")))
    plain = listed_entries.select("path", "entries", placeholders.redact(F.col(engine.text), F.col("spans"), F.col("entries")).cast("binary").alias("content"), F.lit(None).cast("string").alias("why"))
    packs = opened.where("kind = 'container'")
    parts = containers.read_parts(packs).join(packs.select(F.col("path").alias("__v_path"), "tag"), F.col("path") == F.col("__v_path")).drop("__v_path")
    done = containers.redact_parts(parts, F.col("tag"), engine.families, engine.entries)
    whole = done.groupBy("path").agg(F.first("entries").alias("entries"), F.max("refused").alias("why"))
    packed = whole.join(containers.packed(done, packs), "path", "left").select("path", "entries", "content", "why")
    made = plain.unionByName(packed)
    joined = listed.select("path", "relative", "skipped").join(made, "path", "left")
    why = F.coalesce("skipped", "why", F.when(F.col("content").isNull(), "neither text nor a container"))
    rows = joined.withColumn("skipped", why).withColumn("entries", F.when(F.col("skipped").isNull(), F.col("entries")))
    read = F.col("skipped").isNull()
    return rows.select("path", "relative", "skipped", F.lit(False).alias("unscannable"), F.when(read, F.size("entries")).alias("total"), F.when(read, placeholders.counts(F.col("entries"))).alias("counts"), "entries", F.when(read, F.col("content")).alias("content"))


def planned(rows: DataFrame, out: str | None = None) -> DataFrame:
    """``rows`` with output: where the copy goes, beside the file or at the same place under ``out``; null for skipped ones."""
    name = files.output_name(F.col("relative"))
    full = F.concat(F.lit(out.rstrip("/") + "/"), name) if out is not None else files.output_name(F.col("path"))
    return rows.withColumn("output", F.when(F.col("skipped").isNull(), full))


def write(rows: DataFrame, root: str, maps: str, out: str | None = None) -> DataFrame:
    """Write the copies of ``redactions`` and their maps (to the store ``maps``); returns name, bytes of each copy.

    Run it on a materialized table: rows are read once for the copies and once for the maps.
    """
    good = rows.where("skipped is null")
    changed = good.where("total > 0").select(
        F.sha2("path", 256).substr(1, 16).alias("map_id"), placeholders.tag_of(F.col("entries")).alias("tag"), F.col("path").alias("source"), files.output_name(F.col("relative")).alias("output"), F.current_timestamp().alias("created"), "entries", "counts"
    )
    mapstore.write_maps(changed, maps)
    return files.write_files(good.select(files.output_name(F.col("relative")).alias("name"), "content"), out if out is not None else root)


def totals(rows: DataFrame) -> DataFrame:
    """scanned, changed, placeholders, skipped, sensitive: of ``verdicts`` or ``redactions``."""
    placed = F.size("entries") if "entries" in rows.columns else F.lit(0)
    return files.batch_totals(rows.select("skipped", F.col("total").alias("n_spans"), F.greatest(placed, F.lit(0)).alias("n_placeholders")))


def report(rows: DataFrame, root: str, dry_run: bool = False, check: bool = False, out: str | None = None) -> str:
    """The run as JSON: a file for each read one, the skipped ones with their reasons, totals. Values aren't in it.

    The report lists every file, as its reader asked for; it is made row by row.
    """
    import json

    shown = planned(rows, None if check else out).select("path", "skipped", "unscannable", "total", "counts", F.lit(None).cast("string").alias("output") if check else F.col("output"))
    listed, skipped = [], []
    for r in shown.orderBy("path").toLocalIterator():
        if r.skipped is not None:
            skipped.append({"file": r.path, "reason": r.skipped})
        else:
            listed.append({"file": r.path, "total": r.total, "counts": r.counts or {}, "redacted": r.output} | ({"unscannable": True} if r.unscannable else {}))
    sums = totals(rows).first()
    return json.dumps({"schema": reports.SCHEMA, "tool": "batch", "dry_run": dry_run, "check": check, "root": root, "files": listed, "skipped": skipped, "totals": {k: sums[k] for k in ("scanned", "changed", "placeholders", "skipped")}}, ensure_ascii=False)
