"""Written tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no folder and runs on one machine, as in tests.
LOCAL_ROOT = "/tmp/checkpoints/veilum"
#: A table of ids is broadcast up to so many rows (of 16 bytes or so), and joined by a shuffle beyond.
BROADCAST_ROWS = 1_000_000


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; without one, an error on a cluster."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return LOCAL_ROOT


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and lost executors lose nothing.

    Results are read lazily, so the folder stays until the application ends; a folder that the caller names stays after it.
    """
    spark = df.sparkSession
    path = folder or new_folder(spark, label)
    df.write.parquet(path)
    if folder is None:
        drop_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def few_tasks(spark: SparkSession, share: int = 16) -> int:
    """Tasks for a table that is small beside the corpus: one for so many shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // share)


def drop_at_end(spark: SparkSession, folder: str, missing: bool = False) -> None:
    """Delete a folder when the driver's file system is closed. ``missing``: make it first, as only what exists can be named."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if missing:
        store.mkdirs(path)
    store.deleteOnExit(path)


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder through Hadoop's file system, wherever it is."""
    jvm, path = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread_join(ids: DataFrame, n: int) -> DataFrame:
    """``ids``, of ``n`` rows, as the small side of a join: broadcast if there are at most BROADCAST_ROWS."""
    return F.broadcast(ids) if n <= BROADCAST_ROWS else ids


def bounded_sample(df: DataFrame, key: str, limit: int) -> DataFrame:
    """At most ``limit`` rows, those whose ``key`` has the smallest hash; about 0.9 ``limit`` of a larger table.

    Rows are left out by their hash before anything is sorted, so no task sends more than its share.
    """
    place = F.pmod(F.xxhash64(key), F.lit(1 << 40))
    n = df.count()
    if n > limit:
        df = df.where(place < int((1 << 40) * 0.9 * limit / n))
    return df.orderBy(place, *df.columns).limit(limit)
