"""Reports as JSON and Markdown texts, without values unless asked for, and checks of what is stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilum.functions.offsets import let

#: Version of the machine-readable reports.
SCHEMA = "veilum/1"


def envelope(tool: str, *fields: Column) -> Column:
    """A report as JSON: its schema and tool, then the fields."""
    return F.to_json(F.struct(F.lit(SCHEMA).alias("schema"), F.lit(tool).alias("tool"), *fields))


def check_json(found: Column) -> Column:
    """``found``: struct(total, truncated, findings) of ``audit.findings``."""
    return envelope("check", (found["total"] > 0).alias("sensitive"), found["total"].alias("total"), found["truncated"].alias("truncated"), found["findings"].alias("findings"))


def audit_json(row: dict[str, Column], reveal: bool = False) -> Column:
    """A residual-risk report of ``Engine.audit``'s columns; values of near misses only if revealed."""
    near = F.col("near") if reveal else F.transform("near", lambda n: F.struct(*[n[k].alias(k) for k in ("kind", "type", "line", "similarity", "token_masked")]))
    listed = F.size("findings") < F.col("total")
    return envelope("audit", *[c.alias(k) for k, c in row.items()], "verdict", "total", "types", "findings", F.when(listed, True).alias("findings_truncated"), near.alias("near_miss"), F.lit(reveal).alias("revealed"), F.col("placeholders").alias("placeholders_present"))


def dry_run_json(file: Column, output: Column, n_entries: Column, counts: Column) -> Column:
    """What a run would write and replace."""
    return envelope("dry-run", F.lit(True).alias("dry_run"), file.alias("file"), (n_entries > 0).alias("sensitive"), output.alias("would_write"), n_entries.alias("entries"), counts.alias("counts"))


def markdown(name: Column, counts: Column) -> Column:
    """What was replaced, by type in alphabetical order: ``counts`` is map<type, distinct values>."""

    def listed(c):
        keys = F.array_sort(F.map_keys(c))
        total = F.aggregate(F.map_values(c), F.lit(0), lambda a, x: a + x)
        rows = F.transform(keys, lambda k: F.concat(F.lit("| "), k, F.lit(" | "), F.element_at(c, k).cast("string"), F.lit(" |")))
        return F.concat(F.lit("# "), name, F.lit("\n\nValues replaced: "), total.cast("string"), F.when(F.size(keys) > 0, F.concat(F.lit("\n\n| Type | Values |\n|---|---|\n"), F.array_join(rows, "\n"))).otherwise(""), F.lit("\n"))

    return let(counts, listed)


def coverage(length: Column, windows: Column, overlap: int) -> Column:
    """struct(chars, analyzed_chars, truncated, chunks, chunk_overlap): how far into a text the windows reach."""
    end = F.aggregate(windows, F.lit(0), lambda a, w: F.greatest(a, w["end"]))
    many = F.when(F.size(windows) > 1, F.lit(overlap)).otherwise(0)
    return F.struct(length.alias("chars"), end.alias("analyzed_chars"), (end < length).alias("truncated"), F.size(windows).alias("chunks"), many.alias("chunk_overlap"))


def manifest(files: DataFrame) -> DataFrame:
    """path, sha256, bytes of files (path, content): what a backup is checked against."""
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("bytes"))


def manifest_check(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """path, state over a full outer join of two tables (path, sha256): same, changed, missing (in files), extra."""
    m, f = manifest.select("path", F.col("sha256").alias("m")), files.select("path", F.col("sha256").alias("f"))
    state = F.when(F.col("f").isNull(), "missing").when(F.col("m").isNull(), "extra").when(F.col("m") == F.col("f"), "same").otherwise("changed")
    return m.join(f, "path", "full_outer").select("path", state.alias("state"))


def orphans(folders: DataFrame, alive: DataFrame, now: Column, max_age_seconds: int = 3600) -> DataFrame:
    """Work folders (path, owner, modified) whose owner isn't alive, or that have none and are old."""
    ownerless = folders.where(F.col("owner").isNull() & (F.col("modified") < now - F.expr(f"INTERVAL {int(max_age_seconds)} SECONDS")))
    return folders.where("owner IS NOT NULL").join(alive.select("owner"), "owner", "left_anti").select(folders.columns).unionByName(ownerless)


def is_loopback(url: Column) -> Column:
    """Whether a URL's host is this machine: the only endpoints that a model may have."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@]*)(?::[0-9]+)?(?:[/?#]|$)", 1))
    return F.coalesce(url.rlike("^(?i:https?)://") & ((host == "localhost") | host.rlike(r"^127(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}$") | (host == "[::1]")), F.lit(False))


def is_map_id(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^[\p{L}\p{N}_\-]+$"), F.lit(False))


def collisions(runs: DataFrame, n: int, width: int = 6) -> DataFrame:
    """``runs``: seed. Whether n tags drawn from a seed's hash hold an equal pair: seed, drawn, distinct, collided."""
    tag = F.substring(F.sha2(F.concat_ws("|", F.col("seed").cast("string"), F.col("i").cast("string")), 256), 1, width)
    drawn = runs.select("seed", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("i")).select("seed", tag.alias("tag"))
    out = drawn.groupBy("seed").agg(F.count("*").alias("drawn"), F.countDistinct("tag").alias("distinct"))
    return out.withColumn("collided", F.col("distinct") < F.col("drawn"))


def provenance(restored: DataFrame, maps: DataFrame) -> DataFrame:
    """Restored documents (map_id, ...) with their map's source, created and counts."""
    return restored.join(maps.select("map_id", "source", "created", "counts"), "map_id", "left")


def reveal(entries: DataFrame, map_id: str, confirm: bool = False) -> DataFrame:
    """The entries of one map with their originals; only if confirmed."""
    if not confirm:
        raise PermissionError("originals are shown only with confirm=True")
    return entries.where(F.col("map_id") == map_id)
