"""Files: kinds by their first bytes, folder scans with scope filters, whole texts."""

from __future__ import annotations

import os
import re
import secrets
import time
import uuid
from collections.abc import Iterator, Sequence
from typing import IO
from urllib.parse import unquote

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

HEAD, WINDOW, MAX_BYTES, LARGE = 8192, 1032, 12 * 1024 * 1024, 16 * 1024 * 1024

# Signatures of images and of containers (hex), at the start of a file or within its first bytes.
IMAGES = ("89504E470D0A1A0A", "FFD8FF", "474946383761", "474946383961")
CONTAINERS = ("504B0304", "504B0506", "D0CF11E0A1B11AE1", "1F8B", "52617221", "377ABCAF271C", "4F676753", "4D5A", "7F454C46")
INSIDE = ("504B0304", "504B0708")
OWN_OUTPUT = r"(?i)\.(?:redacted|deanon)\.[^.]*$|\.map\.json$"


def _starts(content: Column, signatures) -> Column:
    out = F.lit(False)
    for s in signatures:
        out = out | (F.substring(content, 1, len(s) // 2) == F.unhex(F.lit(s)))
    return out


def is_image(content: Column) -> Column:
    webp = _starts(content, ["52494646"]) & (F.substring(content, 9, 4) == F.unhex(F.lit("57454250")))
    bmp = _starts(content, ["424D"]) & (F.substring(content, 7, 4) == F.unhex(F.lit("00000000")))
    return _starts(content, IMAGES) | webp | bmp


def kind(content: Column) -> Column:
    """image, container, binary, or text."""
    head = F.substring(content, 1, HEAD)
    digits = F.hex(F.substring(content, 1, WINDOW))
    # Whole bytes only: an even number of digits stands before the signature.
    inside = digits.rlike("^(?:..)*?(?:" + "|".join(INSIDE) + ")")
    pdf = digits.rlike("^(?:..)*?255044462D3[0-9]2E3[0-9]")
    found = F.when(is_image(head), "image").when(_starts(head, CONTAINERS) | inside | pdf, "container")
    return found.when(F.hex(head).rlike("^(?:..)*?00"), "binary").otherwise("text")


def text_of(content: Column) -> Column:
    """UTF-8 with replacement characters for what isn't."""
    return F.make_valid_utf8(content.cast("string"))


def _plain_path(path: str) -> str:
    """The path of a file: URI on this machine's file systems; other URIs as they are."""
    return re.sub("^file:/+", "/", path)


def _target_of(paths: pd.Series) -> pd.Series:
    """Where links lead; stores other than file systems have none."""
    return paths.map(lambda p: os.path.realpath(unquote(q)) if (q := _plain_path(p)).startswith("/") else p)


def listing(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES, allow=None, private: Sequence[str] = ()) -> DataFrame:
    """All files under a folder, by their metadata alone: path, name, relative, bytes, skipped (why a file isn't to be read).

    Skipped are links that lead out of the folder or into a ``private`` one (the map store, say), files in a private folder,
    own outputs, files over ``max_bytes`` and, if ``allow`` (a function of name and path columns) is given, what it allows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    root = os.path.realpath(_plain_path(path)) if _plain_path(path).startswith("/") else path.rstrip("/")
    inside = lambda column, folder: (column == folder) | column.startswith(folder.rstrip("/") + "/")
    listed = files.select("path", name.alias("name"), F.col("length").alias("bytes"), "modificationTime", pandas_udf(_target_of, "string")("path").alias("target"))
    skipped = F.when(F.col("name").rlike(OWN_OUTPUT), "own output").when(F.col("bytes") > max_bytes, "too large")
    if _plain_path(path).startswith("/"):
        skipped = F.when(~inside(F.col("target"), root), "link out of the folder").otherwise(skipped)
    for folder in private:
        skipped = F.when(inside(F.col("target"), os.path.realpath(_plain_path(folder))), "private").otherwise(skipped)
    if allow is not None:
        skipped = F.coalesce(skipped, F.when(allow(F.col("name"), F.col("path")), "allowed"))
    relative = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + re.escape(_plain_path(path).rstrip("/")) + "/", "")
    return listed.select("path", "name", relative.alias("relative"), "bytes", "modificationTime", skipped.alias("skipped"))


def _unglobbed(path: str) -> str:
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def contents(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """path, content of these files and no others. (Spark's reader keeps the list of its files on the driver anyway.)"""
    if not paths:
        return spark.createDataFrame([], "path string, content binary")
    return spark.read.format("binaryFile").load([_unglobbed(p) for p in paths]).select("path", "content")


def _head(spark: SparkSession, path: str) -> bytearray:
    """The first bytes of a file, by way of the JVM, which reaches every store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).open(at)
    try:
        return bytearray(stream.readNBytes(HEAD))
    finally:
        stream.close()


def scan(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES, allow=None, private: Sequence[str] = ()) -> DataFrame:
    """``listing`` with kind and text (of text files): metadata first, then only the files that aren't skipped are opened.

    Spark reads a file as one value. Of files over LARGE bytes the driver reads the head first, and only texts are read whole.
    """
    listed = listing(spark, path, max_bytes, allow, private)
    chosen = {r.path: r.bytes for r in listed.where("skipped is null").select("path", "bytes").toLocalIterator()}
    large = [(p, _head(spark, p)) for p, size in chosen.items() if size > LARGE]
    told = {r.path: r.kind for r in spark.createDataFrame(large, "path string, content binary").select("path", kind(F.col("content")).alias("kind")).collect()} if large else {}
    read = contents(spark, [p for p in chosen if told.get(p, "text") == "text"]).select(F.col("path").alias("__v_path"), kind(F.col("content")).alias("kind"), "content")
    read = read.select("__v_path", "kind", F.when(F.col("kind") == "text", text_of(F.col("content"))).alias("text"))
    if rest := [(p, k, None) for p, k in told.items() if k != "text"]:
        read = read.unionByName(spark.createDataFrame(rest, "__v_path string, kind string, text string"))
    return listed.join(read, F.col("path") == F.col("__v_path"), "left").drop("__v_path")


def from_stream(spark: SparkSession, stream: IO[bytes], name: str = "-") -> DataFrame:
    """One row path, text: what a stream such as standard input holds."""
    return spark.createDataFrame([(name, bytearray(stream.read()))], "path string, content binary").select("path", text_of(F.col("content")).alias("text"))


def to_stream(texts: DataFrame, stream: IO[str], column: str = "redacted") -> int:
    """Write a column's texts to a stream such as standard output, row by row; each ends with a line feed."""
    n = 0
    for row in texts.select(column).toLocalIterator():
        if row[0] is not None:
            stream.write(row[0] if row[0].endswith("\n") else row[0] + "\n")
            n += 1
    return n


def write_files(made: DataFrame, folder: str, name: str = "name") -> DataFrame:
    """Write ``made`` (name, content: binary) as files under a folder, readable by their owner; returns name, bytes.

    Names may hold folders, which are made. A file is written under another name and moved, so that a lost task leaves no
    half of it.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(re.sub("^(?:file:/+|/)", "file:///", folder))
        for batch in batches:
            for target, content in zip(batch[name], batch["content"], strict=True):
                parent = f"{root}/{target}".rpartition("/")[0]
                store.create_dir(parent, recursive=True)
                draft = f"{parent}/.{uuid.uuid4().hex}"
                with store.open_output_stream(draft) as out:
                    out.write(content)
                if store.type_name == "local":
                    os.chmod(draft, 0o600)
                store.move(draft, f"{root}/{target}")
            yield pd.DataFrame({"name": batch[name], "bytes": [len(c) for c in batch["content"]]})

    return made.select(name, "content").mapInPandas(rows, "name string, bytes long")


def publish(folder: str, name: str, content: bytes, ttl_seconds: int = 3600, now: float | None = None) -> str:
    """Put a file where its reader can fetch it for a while; returns token/name. What is older than ``ttl_seconds`` goes."""
    now = time.time() if now is None else now
    store, root = fs.FileSystem.from_uri(re.sub("^(?:file:/+|/)", "file:///", folder))
    store.create_dir(root, recursive=True)
    for info in store.get_file_info(fs.FileSelector(root)):
        if info.mtime is not None and now - info.mtime.timestamp() > ttl_seconds:
            store.delete_dir(info.path) if info.type == fs.FileType.Directory else store.delete_file(info.path)
    token = secrets.token_hex(8)
    store.create_dir(f"{root}/{token}")
    with store.open_output_stream(f"{root}/{token}/{name.rpartition('/')[2]}") as out:
        out.write(content)
    return f"{token}/{name.rpartition('/')[2]}"


def output_name(path: Column, word: str = "redacted") -> Column:
    """x.ext -> x.redacted.ext; a name without an ending gets the word at its end."""
    return F.when(path.rlike(r"\.[^./]*$"), F.regexp_replace(path, r"(\.[^./]*)$", rf".{word}$1")).otherwise(F.concat(path, F.lit("." + word)))


def batch_totals(files: DataFrame) -> DataFrame:
    """One row over scanned files (skipped, n_spans, n_placeholders): scanned, changed, placeholders, skipped, sensitive."""
    read = F.col("skipped").isNull()
    return files.agg(
        F.count_if(read).alias("scanned"),
        F.count_if(read & (F.col("n_spans") > 0)).alias("changed"),
        F.coalesce(F.sum(F.when(read, F.col("n_placeholders"))), F.lit(0)).alias("placeholders"),
        F.count_if(~read).alias("skipped"),
        F.coalesce(F.bool_or(read & (F.col("n_spans") > 0)), F.lit(False)).alias("sensitive"),
    )


def spread(df: DataFrame, least_bytes: int = 1 << 20) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, where it is worth a shuffle.

    A large table has more partitions than cores and is left as it is, and so is a tiny one.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if not least_bytes <= size < cores * (128 << 20) or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores)
