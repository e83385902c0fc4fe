"""Benchmark decontamination: which test items stand in which documents.

An item stands in a document if the document holds at least ``threshold`` of the item's distinct five-word shingles. Items are
partitioned by size (powers of two of their number of shingles), and each partition has one MinHash sketch length: the k
smallest hashes of an item under one permutation. A document that misses at most a share of 1 - threshold of n shingles holds
at least k - floor((1 - threshold) n) of the k sketched ones, so documents, however long, are searched for sketches only,
and no item within the threshold is missed. Candidates are verified with the shingles themselves.

The sketches go to every task, in blocks of at most BLOCK_SHINGLES shingles of items; a larger benchmark takes more passes over
the documents. Documents are never shuffled.

Words are runs of letters and digits of the lower-cased text; a text of one to four words is its own only shingle; null and
blank texts have none, hold nothing and stand nowhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilum.llm._words import mixed, rolling, split_words, text_slices, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
BLOCK_SHINGLES = 1_000_000
PAIRS = "doc_id long, item_id long, n_shingles long, n_shared long, containment double"


def plain_words(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.utf8_lower(texts), pattern=r"[^\p{L}\p{N}]+", replacement=" ")


def shingle_hashes(texts: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of plain texts, and the row of each."""
    words, offsets = split_words(texts)
    hashes, counts = word_hashes(words), np.diff(offsets)
    sizes = np.maximum(counts - width + 1, 0)
    rows = np.repeat(np.arange(len(counts)), sizes)
    places = offsets[rows] + np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    runs = rolling(hashes, width)
    found, owner = [mixed(runs[places]) if len(runs) else np.zeros(0, np.uint64)], [rows]
    for n in range(1, width):  # short texts: one shingle, told apart by its length
        short = np.flatnonzero(counts == n)
        if len(short):
            found.append(mixed(rolling(hashes, n)[offsets[short]] + np.uint64(n)))
            owner.append(short)
    return np.concatenate(found), np.concatenate(owner)


def shingles(plain: str, width: int = SHINGLE) -> set[str]:
    words = plain.split()
    if len(words) < width:
        return {f"{len(words)}: " + " ".join(words)} if words else set()
    return {" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


def missable(n: int, threshold: float) -> int:
    """The most of n shingles that a document within the threshold can miss."""
    return next(m for m in range(n, -1, -1) if n - m >= threshold * n)


@dataclass
class Block:
    """Sketches of some items: sorted hashes, the item of each, and each item's least number of hits."""

    hashes: np.ndarray
    items: np.ndarray
    least: np.ndarray
    ids: list
    shingles: list[set[str]]
    table: np.ndarray


def sketch(items: list[tuple[int, str]], threshold: float = THRESHOLD) -> Block:
    plain = plain_words(pa.array([t for _, t in items], pa.string()))
    found, owner = shingle_hashes(plain)
    order = np.lexsort([found, owner])
    found, owner = found[order], owner[order]
    new = np.append(True, (found[1:] != found[:-1]) | (owner[1:] != owner[:-1]))[: len(found)]
    found, owner = found[new], owner[new]
    ends = np.searchsorted(owner, np.arange(len(items) + 1))
    hashes, places, least = [], [], []
    for i in range(len(items)):
        own = found[ends[i] : ends[i + 1]]
        n = len(own)
        largest = (1 << n.bit_length()) - 1  # of this size partition
        k = min(n, 2 * missable(largest, threshold) + 1)
        hashes.append(own[:k])
        places.append(np.full(k, i))
        least.append(max(1, k - missable(n, threshold)))
    flat, at = np.concatenate(hashes), np.concatenate(places)
    order = np.argsort(flat, kind="stable")
    bits = max(16, int(len(flat) * 16).bit_length())
    table = np.zeros(1 << bits, bool)
    table[(flat & np.uint64(len(table) - 1)).astype(np.int64)] = True
    return Block(flat[order], at[order], np.array(least), [i for i, _ in items], [shingles(t or "") for t in plain.to_pylist()], table)


def matches(texts: pa.Array, block: Block, threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    """(row, item's place in the block, shared shingles) of all pairs within the threshold."""
    if not len(block.hashes):
        return []
    plain = plain_words(texts)
    found, owner = shingle_hashes(plain)
    if not len(found):
        return []
    maybe = np.flatnonzero(block.table[(found & np.uint64(len(block.table) - 1)).astype(np.int64)])
    if not len(maybe):
        return []
    found, owner = found[maybe], owner[maybe]
    left, right = np.searchsorted(block.hashes, found, "left"), np.searchsorted(block.hashes, found, "right")
    reps = right - left
    at = np.repeat(left, reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
    if not len(at):
        return []
    hits = np.unique(np.stack([np.repeat(owner, reps), block.items[at], at]), axis=1)[:2]  # a hash of a row counts once
    pairs, counts = np.unique(hits, axis=1, return_counts=True)
    out, row, own = [], -1, set()
    for r, i in pairs[:, counts >= block.least[pairs[1]]].T.tolist():
        if r != row:
            row, own = r, shingles(plain[r].as_py())
        shared = len(block.shingles[i] & own)
        if shared >= threshold * len(block.shingles[i]):
            out.append((r, i, shared))
    return out


def blocks(benchmark: DataFrame, threshold: float = THRESHOLD, limit: int = BLOCK_SHINGLES) -> Iterator[Block]:
    """Items with a text, read one partition at a time; a block ends with the item that fills it."""
    items, size = [], 0
    for row in benchmark.where("text is not null").select("item_id", "text").toLocalIterator():
        items.append((row.item_id, row.text))
        size += len(row.text) // 2 + 1  # no text has more words
        if size >= limit:
            yield sketch(items, threshold)
            items, size = [], 0
    if items:
        yield sketch(items, threshold)


def _pairs(shared, threshold: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(**shared.value)
        for batch in text_slices(batches):
            out = [(batch.column("doc_id")[r].as_py(), block.ids[i], len(block.shingles[i]), n, n / len(block.shingles[i])) for r, i, n in matches(batch.column("text"), block, threshold)]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kinds[k]) for k in range(5)], ["doc_id", "item_id", "n_shingles", "n_shared", "containment"])

    return rows


def _clean(shared, threshold: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(**shared.value)
        for batch in text_slices(batches):
            stays = np.ones(batch.num_rows, bool)
            stays[[r for r, _, _ in matches(batch.column("text"), block, threshold)]] = False
            yield batch.filter(pa.array(stays))

    return rows


def op4(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contaminated(docs, benchmark)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, limit: int = BLOCK_SHINGLES) -> DataFrame:
    """A row for each row of ``docs`` and row of ``benchmark`` that stands in it: doc_id, item_id, n_shingles (of the item),
    n_shared, containment. Repeated rows on either side are pairs of their own; ids may be null."""
    sc, out = docs.sparkSession.sparkContext, None
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    for block in blocks(benchmark.select(F.col("item_id").cast("long"), "text"), threshold, limit):
        pairs = texts.mapInArrow(_pairs(sc.broadcast(vars(block)), threshold), PAIRS)
        out = pairs if out is None else out.unionByName(pairs)
    return docs.sparkSession.createDataFrame([], PAIRS) if out is None else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, limit: int = BLOCK_SHINGLES) -> DataFrame:
    """The rows of ``docs`` in which no item stands, with all their columns."""
    sc, out = docs.sparkSession.sparkContext, docs
    for block in blocks(benchmark.select(F.col("item_id").cast("long"), "text"), threshold, limit):
        out = out.mapInArrow(_clean(sc.broadcast(vars(block)), threshold), docs.schema)
    return out


#: All pairs through equal shingles.
OP4_SQL = r"""
WITH t AS (SELECT 'd' AS side, doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents
           UNION ALL SELECT 'b', item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') FROM benchmark),
s AS (SELECT DISTINCT side, id, shingle FROM (
        SELECT side, id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) AS shingle FROM t WHERE len(w) >= 5
        UNION ALL SELECT side, id, len(w) || ': ' || array_to_string(w, ' ') FROM t WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT id, count(*) AS n_shingles FROM s WHERE side = 'b' GROUP BY id),
p AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared FROM s d JOIN s b ON d.shingle = b.shingle AND d.side = 'd' AND b.side = 'b' GROUP BY ALL)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared::DOUBLE / n_shingles AS containment
FROM p JOIN n ON p.item_id = n.id WHERE n_shared >= 0.8::DOUBLE * n_shingles
"""
