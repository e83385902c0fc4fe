"""The store of maps: two tables, one row for each map and one for each entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilum.functions.offsets import each

MAPS = "map_id string, tag string, version string, source string, output string, created timestamp, counts map<string,int>"
ENTRIES = "map_id string, placeholder string, type string, original string"
JSON = "tag string, version string, id string, source string, output string, created string, counts map<string,int>, entries map<string,struct<type:string,original:string>>"
LIST_CAP = 100


def basename(path: Column) -> Column:
    """Last part of a path of either kind of slash."""
    return F.element_at(F.split(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/+$", ""), "/"), -1)


def write_maps(docs: DataFrame, root: str, version: str = "1") -> None:
    """Append the maps of redacted documents (map_id, tag, source, output, created, entries, counts)."""
    docs.select("map_id", "tag", F.lit(version).alias("version"), "source", "output", "created", "counts").write.mode("append").parquet(f"{root}/maps")
    each(docs, ["map_id"], "entries", "e").select("map_id", "e.*").write.mode("append").parquet(f"{root}/map_entries")


def read_maps(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(MAPS).parquet(f"{root}/maps"), spark.read.schema(ENTRIES).parquet(f"{root}/map_entries")


def exists(spark: SparkSession, root: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/maps")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def parsed(raw: DataFrame, column: str = "json") -> DataFrame:
    """Maps from JSON texts: ``raw`` plus map (null where the text is no map) and valid. Every entry needs a type."""
    out = raw.withColumn("map", F.from_json(column, JSON, {"mode": "PERMISSIVE"}))
    typed = F.forall(F.map_values("map.entries"), lambda e: e.isNotNull() & e["type"].isNotNull())
    return out.withColumn("valid", F.coalesce(F.col("map.entries").isNotNull() & typed, F.lit(False)))


def listing(maps: DataFrame, cap: int = LIST_CAP) -> DataFrame:
    """The newest maps without their values, with the number of all."""
    total = maps.count()
    cut = maps.orderBy(F.desc("created"), "map_id").limit(cap)
    return cut.select("map_id", "tag", basename(F.col("source")).alias("source"), "created", F.aggregate(F.map_values("counts"), F.lit(0), lambda a, x: a + x).alias("entries")).withColumn("total", F.lit(total)).withColumn("truncated", F.lit(total > cap))


def existing_tags(maps: DataFrame) -> DataFrame:
    return maps.where("tag is not null").select("tag").distinct()


def prunable(files: DataFrame, now: Column, days: int) -> DataFrame:
    """``files`` (path, modified, bytes) older than so many days."""
    if days < 1:
        raise ValueError("at least one day")
    return files.where(F.col("modified") < now - F.expr(f"INTERVAL {int(days)} DAYS"))


def purge(spark: SparkSession, root: str, expected: int) -> int:
    """Delete all maps if there are as many as expected; returns the number."""
    maps, _ = read_maps(spark, root)
    n = maps.count()
    if n != expected:
        raise ValueError(f"{n} maps, not {expected}")
    path = spark._jvm.org.apache.hadoop.fs.Path
    for name in ("maps", "map_entries"):
        p = path(f"{root}/{name}")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return n


def birthday(n: Column, width: int = 6) -> Column:
    """Chance that n random hex tags of a width hold an equal pair."""
    return 1 - F.exp(-n * (n - 1) / F.lit(2.0 * 16**width))


def fingerprint(files: DataFrame) -> DataFrame:
    """sha256 over (path, content) in order of path, each with its length before it: one row, column fingerprint.

    Contents are hashed where they are; the paths and hashes of all files, about 150 bytes each, meet in one row, as the
    value is defined over all of them in order. It is for the files of a folder, not for the rows of a large table.
    """
    part = F.concat(F.length("path").cast("string"), F.lit(":"), F.col("path"), F.octet_length("content").cast("string"), F.lit(":"), F.sha2("content", 256))
    return files.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", part.alias("part")))), lambda x: x["part"]), ""), 256).alias("fingerprint"))
