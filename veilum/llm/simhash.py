"""Near-duplicates by SimHash fingerprints that differ in at most ``radius`` bits.

Distinct fingerprints are dealt into buckets so that any two within the radius share one: of ``blocks`` blocks of the 64
bits, ``blocks - radius`` are equal, so there is a bucket for each choice of so many blocks. Within a bucket they are compared
bit-sliced: 64 planes hold one bit of many fingerprints each, and for many queries at a time the planes' differences go into
carry-save counters of two bits with a sticky overflow; a tile is left as soon as every counter has overflowed. A bucket
sends only a spanning forest of its links, and components come from star contraction.

Fingerprints of a bucket larger than CELL are dealt out by more blocks; a bucket that is still larger with the most blocks is
cut into a grid of cells that are compared by themselves: nothing is dropped, and no task holds more than about two sides
of a cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from veilum.llm._store import spread_join, written
from veilum.llm._words import text_slices
from veilum.llm.components import components

RADIUS = 3
SEED = 42
SHINGLE = 3
#: Fingerprints on one side of a cell, and in a tile of the comparison.
CELL = 8192
QUERIES, TILE = 256, 2048
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, width: int = SHINGLE, seed: int = SEED) -> int:
    """Majority of each bit over the shingles' XXH64; 0 without words."""
    words = text.lower().split()  # of bytes: A-Z, and white space U+0009 to U+000D and U+0020
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All columns, and __v_fp."""
    for batch in text_slices(batches):
        found = np.fromiter((fingerprint(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()), np.uint64, batch.num_rows)
        yield batch.append_column("__v_fp", pa.array(found.view(np.int64)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` with __v_fp (signed) of every row; null and blank texts have fingerprint 0."""
    return docs.mapInArrow(_fingerprints, StructType([*docs.schema.fields, StructField("__v_fp", LongType())]))


def within(queries: np.ndarray, tile: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Boolean matrix: which pairs of 64-bit values differ in at most ``radius`` bits, bit-sliced.

    Two counter bits overflow at four differences, so the radius is 1 or 3.
    """
    if radius not in (1, 3):
        raise ValueError("the radius is 1 or 3")
    padded = np.zeros(-(-len(tile) // 64) * 64, np.uint64)
    padded[: len(tile)] = tile
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")  # a row for each value
    planes = np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)  # a row for each bit
    ones = np.zeros((len(queries), planes.shape[1]), np.uint64)
    twos, over = np.zeros_like(ones), np.zeros_like(ones)
    for j in range(64):
        own = np.where((queries >> np.uint64(j)) & np.uint64(1), FULL, np.uint64(0))[:, None]
        differ = planes[j][None, :] ^ own
        carry = ones & differ
        ones ^= differ
        if radius == 1:
            over |= carry
        else:
            over |= twos & carry
            twos ^= carry
        if j % 4 == 3 and (over == FULL).all():
            return np.zeros((len(queries), len(tile)), bool)
    return np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little")[:, : len(tile)].astype(bool)


def _joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each an index of the smallest member) after linking a[i] with b[i]."""
    while True:
        x, y = labels[a], labels[b]
        open_ = x != y
        if not open_.any():
            return labels
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        parents = np.arange(len(labels))
        np.minimum.at(parents, np.maximum(x, y), np.minimum(x, y))
        while (parents[parents] != parents).any():
            parents = parents[parents]
        labels = parents[labels]


def forest(values: np.ndarray, cells: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links between values of equal (sorted) cells within the radius: for each component of a cell, a star."""
    labels, n, start = np.arange(len(values)), len(values), 0
    last = np.searchsorted(cells, cells, side="right")  # end of each one's cell
    while start < n:
        stop = min(start + QUERIES, n)
        for left in range(start, int(last[stop - 1]), TILE):
            right = min(left + TILE, int(last[stop - 1]))
            a, b = np.nonzero(within(values[start:stop], values[left:right], radius))
            a, b = a + start, b + left
            same = (a < b) & (cells[a] == cells[b])
            labels = _joined(labels, a[same], b[same])
        start = stop
    child = np.flatnonzero(labels != np.arange(n))
    return values[child], values[labels[child]]


def _links(radius: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of cell; the last cell of a batch waits for the next."""
        cells, values = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def linked(cells, values):
            u, v = forest(values.view(np.uint64), cells, radius)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cells = np.concatenate([cells, batch.column("cell").to_numpy(zero_copy_only=False)])
            values = np.concatenate([values, batch.column("fp").to_numpy(zero_copy_only=False)])
            done = int(np.searchsorted(cells, cells[-1], side="left"))
            if done:
                yield linked(cells[:done], values[:done])
                cells, values = cells[done:], values[done:]
        if len(cells):
            yield linked(cells, values)

    return rows


def bucket_choice(n: int, radius: int = RADIUS) -> int:
    """Number of blocks: the fewest with which buckets hold CELL / 2 of ``n`` spread fingerprints or fewer on average."""
    for blocks in range(radius + 1, most_blocks(radius) + 1):
        if n / 2 ** (64 * (blocks - radius) // blocks) <= CELL / 2:
            break
    return blocks


def most_blocks(radius: int = RADIUS) -> int:
    return 2 * radius + 1


def bucket_keys(fp: Column, blocks: int, radius: int = RADIUS) -> Column:
    """array<long>: for each choice of blocks, the bits that must agree, hashed with the choice's number."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(F.lit(number), fp.bitwiseAND(F.lit(signed).cast("long"))))
    return F.array(*keys)


def _bucketed(values: DataFrame, blocks: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """fp, key of every bucket, and the keys and sizes of buckets larger than CELL."""
    rows = values.select("fp", F.explode(bucket_keys(F.col("fp"), blocks, radius)).alias("key"))
    return rows, rows.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > CELL)


def similar_links(values: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``values``: distinct longs in column fp. Links u, v whose components are those of all pairs within the radius.

    Fingerprints of buckets larger than CELL are dealt out anew by more blocks, as two that share such a bucket are both
    among them; what is still larger with the most blocks is cut into a grid.
    """
    spark, out = values.sparkSession, None
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = bucket_choice(values.count(), radius)
    while True:
        rows, large = _bucketed(values, blocks, radius)
        large = written(large, "large-buckets")
        more = blocks < most_blocks(radius) and large.limit(1).count() > 0
        if more:
            cells = rows.join(large.select("key"), "key", "left_anti").select("fp", F.col("key").alias("cell"))
        else:
            cut = rows.join(large.select("key", F.ceil(F.col("size") / CELL).cast("int").alias("sides")), "key", "left")
            side = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("sides")).cast("int")
            other = F.explode(F.when(F.col("sides").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("sides") - 1)))
            spread = cut.select("fp", "key", F.coalesce(side, F.lit(0)).alias("side"), other.alias("other"))
            cells = spread.select("fp", F.xxhash64("key", F.least("side", "other"), F.greatest("side", "other")).alias("cell"))
        links = cells.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(_links(radius), "u long, v long")
        out = links if out is None else out.unionByName(links)
        if not more:
            return out
        values = written(rows.join(large.select("key"), "key", "left_semi").select("fp").distinct(), "dense")
        blocks += 1


def _rooted(prints: DataFrame, radius: int) -> DataFrame:
    """Distinct fp, first (smallest doc_id), root (the same fp for all of a component)."""
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(written(similar_links(nodes.select("fp"), radius), "similar"))
    return nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id for every row of ``docs``.

    component_id is the smallest doc_id that chains of links reach, itself included. Null and blank texts have fingerprint
    0 and link like others; repeated rows get equal results; a null doc_id counts only if its component has no other; an
    empty table gives no rows; other columns are ignored.
    """
    prints = written(fingerprints(docs.select(F.col("doc_id").cast("long"), "text")).select("doc_id", F.col("__v_fp").alias("fp")), "fingerprints")
    rooted = _rooted(prints, radius)
    firsts = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(firsts, "root").select(F.col("fp").alias("__v_fp"), "component_id")
    return prints.join(named, F.col("fp") == F.col("__v_fp")).drop("__v_fp")


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of ``docs`` of each component, with all its columns: that of the smallest doc_id, of the smallest fingerprint
    among rows that share it; rows alike in both count as copies and one of them stays. A null doc_id is larger than others.

    Only ids and fingerprints are shuffled: the rows that go are marked by their (doc_id, fingerprint), a table that is
    broadcast if small.
    """
    rows = written(fingerprints(docs), "fingerprinted")
    keys = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__v_fp").alias("fp")).groupBy("doc_id", "fp").agg(F.count("*").alias("n"))
    keys = written(keys, "fingerprints")
    placed = keys.join(_rooted(keys, radius).select(F.col("fp").alias("own"), "root"), F.col("fp") == F.col("own"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")
    leads = placed.groupBy("root").agg(F.min(rank).alias("lead"))
    judged = written(placed.join(leads, "root").select(F.col("doc_id").alias("__v_doc"), F.col("fp").alias("__v_own"), "n", (rank == F.col("lead")).alias("leads")), "judged")
    gone, crowded = judged.where("not leads"), judged.where("leads and n > 1")
    n_gone, n_crowded = judged.agg(F.count_if(~F.col("leads")), F.count_if(F.col("leads") & (F.col("n") > 1))).first()
    same = F.col("doc_id").eqNullSafe(F.col("__v_doc")) & (F.col("__v_fp") == F.col("__v_own"))
    kept = rows.join(spread_join(gone.select("__v_doc", "__v_own"), n_gone), same, "left_anti")
    if n_crowded:
        twins = spread_join(crowded.select("__v_doc", "__v_own"), n_crowded)
        kept = kept.join(twins, same, "left_anti").unionByName(kept.join(twins, same, "left_semi").dropDuplicates(["doc_id", "__v_fp"]))
    return kept.select(*docs.columns)


def op10(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
