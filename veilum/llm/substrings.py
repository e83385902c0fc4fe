"""Removal of repeated passages by compaction of a de Bruijn graph of words.

Edges are runs of ``window`` words (token k-mers). An edge is repeated if its words also start at an earlier source
coordinate (document, place). As in published disk-based compaction, edges are dealt out by their minimizer, the smallest hash
of the shorter runs inside, and neighbours that share it travel together (a super-k-mer), so equal edges meet and the graph
takes a few bytes an edge. Repeated edges whose neighbours and whose sources' neighbours follow each other make one
nonbranching path: stretches are found where edges meet, and Spark glues them at their coordinates into whole spans.

Source coordinates then verify every span: a join fetches a 128-bit digest of the words at its source, and the document cuts
the span only if its own words there have the same digest. Edges themselves are told apart by their minimizer (or, for hot
minimizers, by a second hash of the run) and 64 bits of the run, so spans that fail are not to be expected.

Skew: all runs of ``seed_words`` words of all documents are counted by the slice, and those that may hold more than a small
share of the corpus (``HOT_SHARE``) are never used as minimizers where another run is at hand; edges that have no other go out
one by one by a hash of the whole edge. An edge that a slice has seen before is sent as part of a finished span, so a passage
with a thousand copies sends one edge a slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilum.llm._store import few_tasks, written
from veilum.llm._words import mixed, rolling, runs_of, split_words, text_slices, word_hashes

WINDOW = 20
SEED_WORDS = 5
#: A run of seed_words words is hot if it makes up one in so many of all, or in 4 for each shuffle partition.
HOT_SHARE = 8192
#: Runs counted at once in a task; edges of one bucket on average; edges of one super-k-mer at most.
COUNT_AT_ONCE, BUCKET_EDGES, ROW_EDGES = 2_000_000, 400_000, 4096
#: Buckets for each shuffle partition at least, so that partitions are of one size; text bytes handled at once.
BUCKETS_A_TASK, SLICE = 16, 2 << 20

KEY = "doc_id long, twin long"
SPANS = f"{KEY}, start int, size int, source_doc long, source_twin long, source_start int"
#: One row: the super-k-mers of one slice and bucket, each column packed, or the spans that a slice knows itself.
GRAPH = "bucket long, routes binary, docs binary, twins binary, starts binary, sizes binary, tails binary, known binary"
PACKED = {"routes": np.uint64, "docs": np.int64, "twins": np.int64, "starts": np.int32, "sizes": np.int16, "tails": np.uint64}
KNOWN = np.dtype([("doc_id", "<i8"), ("twin", "<i8"), ("start", "<i4"), ("size", "<i4"), ("source_doc", "<i8"), ("source_twin", "<i8"), ("source_start", "<i4")])
NO_ID = -(1 << 63)
TOP = np.uint64(1 << 63)


def _minima(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours."""
    size, level = 1, x
    while size * 2 <= width:
        level = np.minimum(level[: len(level) - size], level[size:])
        size *= 2
    n = len(x) - width + 1
    return np.minimum(level[:n], level[width - size : width - size + n])


def _seeds(hashes: np.ndarray, seed_words: int) -> np.ndarray:
    """63-bit hashes of all runs of ``seed_words`` words."""
    return mixed(rolling(hashes, seed_words)) >> np.uint64(1)


def _count_seeds(seed_words: int, share: int):
    """Rows (seed, n) of runs that may be hot, and one (-1, n) with the number of all runs.

    A run that makes up more than one in ``share`` of all does so in at least one of the stretches counted here.
    """

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        seeds = np.concatenate(held)
        found, n = np.unique(seeds, return_counts=True)
        some = n >= max(2, len(seeds) / share)
        return pa.RecordBatch.from_arrays([pa.array(np.append(found[some].view(np.int64), -1)), pa.array(np.append(n[some], len(seeds)))], ["seed", "n"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in text_slices(batches, limit=SLICE):
            words, offsets = split_words(batch.column("text"))
            _, _, at = runs_of(offsets, seed_words)
            if len(at):
                held.append(_seeds(word_hashes(words), seed_words)[at])
                size += len(at)
            if size >= COUNT_AT_ONCE:
                yield counted(held)
                held, size = [], 0
        if held:
            yield counted(held)

    return rows


def _edges(texts: pa.Array, window: int, seed_words: int, hot: np.ndarray):
    """Of each edge of these texts: row number, place, route, and the run's own 64 bits. Routes of the highest bit: own."""
    words, offsets = split_words(texts)
    row, place, at = runs_of(offsets, window)
    if not len(row):
        none = np.zeros(0, np.uint64)
        return row, place, none, none
    hashes = word_hashes(words)
    seeds = _seeds(hashes, seed_words)
    if len(hot):
        near = np.minimum(np.searchsorted(hot, seeds), len(hot) - 1)
        seeds = np.where(hot[near] == seeds, seeds | TOP, seeds)
    route = _minima(seeds, window - seed_words + 1)[at]
    alone = route >= TOP
    if alone.any():
        other = mixed(rolling(mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)), window, 0xD1342543DE82EF95))
        route = np.where(alone, other[at] | TOP, route)
    return row, place, route, mixed(rolling(hashes, window))[at]


def _runs(starts_new: np.ndarray, longest: int) -> np.ndarray:
    """Indices where runs begin, given where they must, when none may be longer than ``longest``."""
    begins = np.flatnonzero(starts_new)
    sizes = np.diff(np.append(begins, len(starts_new)))
    parts = -(-sizes // longest)
    first = np.repeat(begins, parts)
    return first + (np.arange(len(first)) - np.repeat(np.cumsum(parts) - parts, parts)) * longest


def _first_of(route: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """For each edge the index of the first equal one."""
    order = np.lexsort([tail, route])  # stable
    new = np.ones(len(order), bool)
    new[1:] = (route[order][1:] != route[order][:-1]) | (tail[order][1:] != tail[order][:-1])
    firsts = np.empty(len(order), np.int64)
    firsts[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    return firsts


def _paths(doc, twin, place, row, route, first):
    """Starts, sizes and kind of stretches of edges: True for paths that occur earlier, False for super-k-mers."""
    again = (place != place[first]) | (doc != doc[first]) | (twin != twin[first])
    follows = (row[1:] == row[:-1]) & (again[1:] == again[:-1]) & (place[1:] == place[:-1] + 1)
    source = first[1:], first[:-1]
    on_path = (doc[source[0]] == doc[source[1]]) & (twin[source[0]] == twin[source[1]]) & (place[source[0]] == place[source[1]] + 1)
    follows &= np.where(again[1:], on_path, route[1:] == route[:-1])
    begin = _runs(np.append(True, ~follows)[: len(doc)], ROW_EDGES)
    return begin, np.diff(np.append(begin, len(doc))), again[begin]


def _packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A binary value for each stretch between ``cuts`` of an array."""
    offsets = (cuts * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(column: pa.Array, kind) -> np.ndarray:
    """The values of a packed column one after another."""
    _, offsets, data = column.buffers()
    cuts = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4)
    return np.frombuffer(data, np.uint8)[cuts[0] : cuts[-1]].view(np.uint8).copy().view(kind) if data is not None and cuts[-1] > cuts[0] else np.zeros(0, kind)


def _spans_batch(doc, twin, place, first, begin, sizes) -> np.ndarray:
    out = np.zeros(len(begin), KNOWN)
    source = first[begin]
    out["doc_id"], out["twin"], out["start"], out["size"] = doc[begin], twin[begin], place[begin], sizes
    out["source_doc"], out["source_twin"], out["source_start"] = doc[source], twin[source], place[source]
    return out


def _as_batch(spans: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(spans[name])) for name in KNOWN.names], list(KNOWN.names))


def _graph(window: int, seed_words: int, hot: np.ndarray, buckets: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=SLICE):
            docs, twins = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "twin"))
            order = np.lexsort([twins, docs])  # within a slice too, the smaller doc_id is earlier
            row, place, route, tail = _edges(batch.column("text").take(pa.array(order)), window, seed_words, hot)
            if not len(row):
                continue
            doc, twin = docs[order][row], twins[order][row]
            first = _first_of(route, tail)
            begin, sizes, known = _paths(doc, twin, place, row, route, first)
            spans = _spans_batch(doc, twin, place, first, begin[known], sizes[known])
            begin, sizes = begin[~known], sizes[~known]
            bucket = (mixed(route[begin]) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            begin, sizes, bucket = begin[by], sizes[by], bucket[by]
            new = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
            cuts, ends = np.append(new, len(bucket)), np.concatenate([[0], np.cumsum(sizes)])
            edges = np.repeat(begin - ends[:-1], sizes) + np.arange(ends[-1])
            columns = {"routes": route[begin], "docs": doc[begin], "twins": twin[begin], "starts": place[begin], "sizes": sizes, "tails": tail[edges]}
            arrays = [_packed(x.astype(PACKED[c], copy=False), ends[cuts] if c == "tails" else cuts) for c, x in columns.items()]
            empty = pa.array([b""] * len(new), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(bucket[new]), *arrays, empty], [*_names(GRAPH)])
            if len(spans):
                where = int(mixed(np.array([docs[0]], np.int64).view(np.uint64))[0] % np.uint64(buckets))
                yield pa.RecordBatch.from_arrays([pa.array([where]), *[pa.array([b""], pa.binary())] * 6, pa.array([spans.tobytes()], pa.binary())], [*_names(GRAPH)])

    return rows


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def _met(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """All super-k-mers of one bucket -> the paths that occur earlier."""
    table = pa.Table.from_batches(batches).combine_chunks()
    routes, docs, twins, starts, sizes, tails = (np.concatenate([_unpacked(c, kind) for c in table.column(name).chunks]) for name, kind in PACKED.items())
    order = np.lexsort([starts, twins, docs])
    at, n = (np.cumsum(sizes) - sizes)[order], sizes[order]
    row = np.repeat(np.arange(len(order)), n)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    doc, twin, place, route = docs[order][row], twins[order][row], starts[order][row] + inside, routes[order][row]
    first = _first_of(route, tails[at[row] + inside])
    # Neighbouring super-k-mers of a bucket may be one path; hot edges, each a super-k-mer, often are.
    new_doc = np.append(False, (doc[1:] != doc[:-1]) | (twin[1:] != twin[:-1]))
    begin, size, known = _paths(doc, twin, place, np.cumsum(new_doc), route, first)
    return _as_batch(_spans_batch(doc, twin, place, first, begin[known], size[known]))


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of bucket -> spans that occur earlier. Holds one bucket."""
    held, last = [], None
    for batch in batches:
        known = _unpacked(batch.column("known"), KNOWN)
        if len(known):
            yield _as_batch(known)
        bucket = batch.column("bucket").to_numpy()
        cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b and held and bucket[a] != last:
                yield _met(held)
                held = []
            if a < b:
                held.append(batch.slice(a, b - a))
                last = bucket[a]
    if held:
        yield _met(held)


def _glued(spans: DataFrame) -> DataFrame:
    """Spans that follow each other in their document and at their source become one."""
    along = Window.partitionBy("doc_id", "twin").orderBy("start")
    before = lambda c: F.lag(c).over(along)
    follows = (before(F.col("start") + F.col("size")) == F.col("start")) & (before("source_doc") == F.col("source_doc")) & (before("source_twin") == F.col("source_twin")) & (before(F.col("source_start") + F.col("size")) == F.col("source_start"))
    marked = spans.withColumn("new", F.when(follows, 0).otherwise(1)).withColumn("path", F.sum("new").over(along))
    whole = marked.groupBy("doc_id", "twin", "path").agg(
        F.min("start").alias("start"), F.sum("size").cast("int").alias("size"), F.min("source_doc").alias("source_doc"), F.min("source_twin").alias("source_twin"), F.min("source_start").alias("source_start")
    )
    return whole.select(*_names(SPANS))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id (NO_ID for null), twin, text. twin tells the texts of a null or repeated id apart, and is 0 where no id is either."""
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    alike = ids.where("n > 1 or doc_id is null").limit(1).count()
    twin = F.xxhash64("text") if alike else F.lit(0).cast("long")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID).cast("long")).alias("doc_id"), twin.alias("twin"), "text")


def _hot_seeds(texts: DataFrame, seed_words: int, share: int) -> tuple[np.ndarray, int]:
    """Sorted hashes of hot runs, at most ``share`` of them, and the number of all runs."""
    counts = texts.select("text").mapInArrow(_count_seeds(seed_words, share), "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
    counts = written(counts.coalesce(few_tasks(texts.sparkSession)), "seed-counts")
    total = counts.where("seed = -1").first()
    if total is None:
        return np.zeros(0, np.uint64), 0
    hot = counts.where((F.col("seed") >= 0) & (F.col("n") >= max(2, total.n / share))).select("seed").collect()
    return np.sort(np.array([r.seed for r in hot], np.int64).view(np.uint64)), total.n


def _spans_of(texts: DataFrame, window: int, seed_words: int) -> DataFrame:
    spark = texts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot, total = _hot_seeds(texts, seed_words, max(HOT_SHARE, 4 * parts))
    buckets = max(BUCKETS_A_TASK * parts, total // BUCKET_EDGES)
    graph = texts.mapInArrow(_graph(window, seed_words, hot, buckets), GRAPH)
    met = graph.repartitionById(parts, F.pmod("bucket", F.lit(parts)).cast("int")).sortWithinPartitions("bucket").mapInArrow(_resolve, SPANS)
    return written(_glued(met).coalesce(few_tasks(spark, 4)), "spans")


def repeated_spans(docs: DataFrame, window: int = WINDOW, seed_words: int = SEED_WORDS) -> DataFrame:
    """Spans of edges that also start earlier: doc_id, twin, start (word number), size (edges; it covers size + window - 1
    words), and an earlier place of the same words (source_doc, source_twin, source_start). Neighbouring spans may be split.
    A written table.

    A null doc_id is earliest of all (NO_ID here). Rows that share a doc_id are documents of their own, in order of a hash of
    their text (twin); rows alike in both are one document. Null texts and texts of fewer than ``window`` words have no edges.
    """
    return _spans_of(_keyed(docs), window, seed_words)


class _Spelled:
    """Flat words of some texts, with digests of stretches of them."""

    def __init__(self, texts: pa.Array):
        self.words, self.offsets = split_words(texts)
        _, cuts, data = self.words.buffers()
        self.cuts = np.frombuffer(cuts, np.int32, len(self.words) + 1, self.words.offset * 4) if len(self.words) else np.zeros(1, np.int32)
        self.data = memoryview(data) if data is not None else memoryview(b"")
        self.lengths = memoryview(np.diff(self.cuts).astype("<i4")).cast("B")

    def digest(self, a: int, b: int) -> bytes:
        """128 bits of the words a to b (exclusive): of their bytes and their lengths."""
        h = xxhash.xxh3_128(self.data[int(self.cuts[a]) : int(self.cuts[b])])
        h.update(self.lengths[4 * a : 4 * b])
        return h.digest()

    def places(self, lists: pa.ListArray, window: int):
        """Row, start, size, first and last word (exclusive) of all spans in a list column; those beyond a text are left out."""
        rows = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        flat = lists.flatten()
        start, size = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "size"))
        a = self.offsets[rows] + start
        b = a + size + window - 1
        return rows, start, size, a, b, b <= self.offsets[rows + 1], flat


def _source_digests(window: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=SLICE):
            spelled = _Spelled(batch.column("text"))
            row, start, size, a, b, inside, _ = spelled.places(batch.column("wants"), window)
            row, start, size = row[inside], start[inside], size[inside]
            digests = [spelled.digest(x, y) for x, y in zip(a[inside].tolist(), b[inside].tolist(), strict=True)]
            keys = [batch.column(c).take(pa.array(row)) for c in ("doc_id", "twin")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(digests, pa.binary())], ["doc_id", "twin", "start", "size", "digest"])

    return rows


def _cut(window: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=SLICE):
            spelled = _Spelled(batch.column("text"))
            offsets, n = spelled.offsets, len(spelled.words)
            _, _, _, a, b, inside, flat = spelled.places(batch.column("spans"), window)
            told = flat.field("digest").to_pylist()
            right = np.array([ok and spelled.digest(x, y) == d for ok, x, y, d in zip(inside.tolist(), a.tolist(), b.tolist(), told, strict=True)], bool)
            gone = np.zeros(n + 1, np.int64)
            np.add.at(gone, a[right], 1)
            np.add.at(gone, b[right], -1)
            stays = np.cumsum(gone)[:n] <= 0
            ends = np.concatenate([[0], np.cumsum(stays)])[offsets]
            left = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), spelled.words.filter(pa.array(stays)))
            counts = np.diff(offsets)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), pa.array(counts - np.diff(ends)), pc.binary_join(left, " ")], ["doc_id", "n_words", "n_removed", "kept"])

    return rows


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed_words: int = SEED_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space): one row per row of ``docs``.

    A null text has no words and keeps the empty text. Rows that share a doc_id, or have none, are judged each by its own
    text; equal rows are one document and get equal results. An empty table gives none. Other columns are ignored.
    """
    texts = _keyed(docs)
    spans = _spans_of(texts, window, seed_words)
    sources = spans.select(F.col("source_doc").alias("doc_id"), F.col("source_twin").alias("twin"), F.col("source_start").alias("start"), "size").distinct()
    wanted = sources.groupBy("doc_id", "twin").agg(F.collect_list(F.struct("start", "size")).alias("wants"))
    digests = texts.join(wanted, ["doc_id", "twin"]).mapInArrow(_source_digests(window), f"{KEY}, start int, size int, digest binary")
    told = spans.join(digests.select(F.col("doc_id").alias("source_doc"), F.col("twin").alias("source_twin"), F.col("start").alias("source_start"), "size", "digest"), ["source_doc", "source_twin", "source_start", "size"])
    cuts = told.groupBy("doc_id", "twin").agg(F.collect_set(F.struct("start", "size", "digest")).alias("spans"))
    kept = texts.join(cuts, ["doc_id", "twin"], "left").mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept string")
    out = kept.withColumn("doc_id", F.expr("nullif(doc_id, bigint('-9223372036854775808'))"))
    return out.coalesce(few_tasks(docs.sparkSession, 4))  # texts left are small beside the graph: fewer, larger files


def op7(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: Every window of 20 words, its first coordinate, and the words that later ones cover.
OP7_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS words FROM documents),
e AS (SELECT doc_id, unnest(range(1, len(words) - 18)) AS start, words FROM w WHERE len(words) >= 20),
k AS (SELECT doc_id, start, md5(array_to_string(words[start : start + 19], ' ')) AS edge FROM e),
r AS (SELECT doc_id, start, row_number() OVER (PARTITION BY edge ORDER BY doc_id, start) AS nth FROM k),
c AS (SELECT DISTINCT doc_id, start + unnest(range(20)) AS place FROM r WHERE nth > 1),
g AS (SELECT doc_id, list(place) AS gone FROM c GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_filter(list_transform(range(1, len(words) + 1), lambda i: CASE WHEN gone IS NULL OR NOT list_contains(gone, i) THEN words[i] END), lambda x: x IS NOT NULL), ' ')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)
"""
