"""Quality classifier: random Fourier features, ridge scores, isotonic calibration.

Document statistics (bounded ratios and logarithms, standardized on the training rows) go through ``features`` random
cosines, whose inner products approximate a Gaussian kernel. Each partition sums its part of the normal equations; the sums
of at most PARTS partitions are added up and solved for ridge scores. Isotonic regression on training rows kept aside turns
scores into probabilities, and linear interpolation between its steps keeps them strictly ordered where it can.

Training takes labels whose crc32(doc_id) mod 5 is not 0, at most MAX_ROWS of them, those of smallest hash. Statistics are
computed from whole texts of all rows, once, and written.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilum.llm._store import bounded_sample, written
from veilum.llm._words import mixed, rolling, split_words, text_slices, word_codes

FOLDS = 5
MAX_ROWS, PARTS = 200_000, 16
RANDOM_FEATURES, WIDTH, RIDGE, SEED = 256, 0.35, 1e-3, 8
THRESHOLD = 0.3
BINS = 4096
STATS = (
    "log_words", "log_lines", "chars_per_word", "symbol_share", "digit_share", "upper_share", "bang_share", "stop_share",
    "distinct_share", "top_share", "repeat2_share", "repeat3_share", "repeat_line_share", "long_share",
)
_CLASS = np.zeros((6, 256), bool)
for _row, _chars in enumerate((b"#*$%&|<>@^~=_{}[]\\/+", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"!", b".,;:?", b"\n")):
    _CLASS[_row, list(_chars)] = True


def _per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between offsets."""
    out, full = np.zeros(len(offsets) - 1), np.flatnonzero(np.diff(offsets))
    if len(full):  # stretches without any are left out, as reduceat takes one value at least
        out[full] = np.add.reduceat(values, offsets[full], dtype=np.int64)
    return out


def _repeats(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of n texts: distinct hashes, hashes that stand twice or more (all of them counted), the most frequent's count.

    Row and hash are sorted as one 64-bit key.
    """
    keys = mixed(mixed(hashes) ^ mixed(rows.astype(np.uint64) + np.uint64(1 << 62)))  # rows as numbers that no hash is made of
    order = np.argsort(keys)
    k = keys[order]
    begin = np.flatnonzero(np.append(True, k[1:] != k[:-1])[: len(k)])
    counts, owner = np.diff(np.append(begin, len(k))), rows[order[begin]]
    most = np.zeros(n)
    np.maximum.at(most, owner, counts)
    return np.bincount(owner, minlength=n).astype(float), np.bincount(owner, np.where(counts > 1, counts, 0), n), most


def text_statistics(texts: pa.Array) -> np.ndarray:
    """A row of STATS for each text; null and blank texts have zeros."""
    n = len(texts)
    texts = texts.fill_null("")
    words, offsets = split_words(texts)
    codes, distinct = word_codes(words)
    counts = np.diff(offsets).astype(float)
    rows = np.repeat(np.arange(n), np.diff(offsets))
    raw = texts.cast(pa.binary())
    _, cuts, data = raw.buffers()
    cuts = np.frombuffer(cuts, np.int32, n + 1, raw.offset * 4).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    data, cuts = data[cuts[0] : cuts[-1]], cuts - cuts[0]
    symbols, digits, upper, bangs, stops, breaks = (_per_text(_CLASS[k][data], cuts) for k in range(6))
    chars = _per_text((data & 0xC0) != 0x80, cuts)
    sizes = pa.compute.utf8_length(distinct).to_numpy(zero_copy_only=False)[codes] if len(codes) else np.zeros(0, int)
    word_chars = _per_text(sizes, offsets)
    long_words = _per_text(sizes > 24, offsets)
    keys = mixed(codes.astype(np.uint64) + np.uint64(1))
    kinds, _, most = _repeats(keys, rows, n)
    shares = []
    for width in (2, 3):
        spans = np.maximum(np.diff(offsets) - width + 1, 0)
        owner = np.repeat(np.arange(n), spans)
        at = offsets[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(spans) - spans, spans)
        runs = rolling(keys, width)
        _, again, _ = _repeats(runs[at] if len(runs) else keys[:0], owner, n)
        shares.append(again / np.maximum(spans, 1))
    lines = pa.compute.split_pattern(texts, "\n")
    flat, owner = lines.flatten(), np.repeat(np.arange(n), np.diff(lines.offsets.to_numpy()))
    full = pa.compute.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    line_codes, _ = word_codes(flat.filter(pa.array(full)))
    kinds_of_line, _, _ = _repeats(line_codes.astype(np.uint64), owner[full], n)
    n_lines = np.bincount(owner[full], minlength=n).astype(float)
    w, c = np.maximum(counts, 1), np.maximum(chars, 1)
    columns = [
        np.log1p(counts), np.log1p(n_lines), word_chars / w, symbols / c, digits / c, upper / c, bangs / c, stops / w,
        kinds / w, most / w, shares[0], shares[1], 1 - kinds_of_line / np.maximum(n_lines, 1), long_words / w,
    ]
    out = np.stack(columns, axis=1)
    out[counts == 0] = 0.0
    return out


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        table = text_statistics(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(table[:, k]) for k in range(len(STATS)))], ["doc_id", *STATS])


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and STATS (doubles) of every row."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_statistics, "doc_id long, " + ", ".join(f"{s} double" for s in STATS))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod FOLDS; 0 for a null id, so such rows are never trained on."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(0).cast("long"))


@dataclass
class Model:
    means: np.ndarray
    scales: np.ndarray
    weights: np.ndarray
    steps_x: np.ndarray
    steps_y: np.ndarray
    seed: int = SEED
    width: float = WIDTH

    def random_features(self, table: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        d = len(self.means)
        turn, phase = rng.normal(0.0, self.width, (d, RANDOM_FEATURES)), rng.uniform(0, 2 * np.pi, RANDOM_FEATURES)
        x = np.clip((table - self.means) / self.scales, -8.0, 8.0)
        return np.concatenate([np.sqrt(2.0 / RANDOM_FEATURES) * np.cos(x @ turn + phase), np.ones((len(table), 1))], axis=1)

    def raw(self, table: np.ndarray) -> np.ndarray:
        return self.random_features(table) @ self.weights

    def score(self, table: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.ones(len(table))
        return np.clip(np.interp(self.raw(table), self.steps_x, self.steps_y), 0.0, 1.0)


def _table(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(s).to_numpy(zero_copy_only=False) for s in STATS], axis=1)


def _normal_equations(model: Model):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = RANDOM_FEATURES + 1
        gram, side = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            x = model.random_features(_table(batch))
            gram += x.T @ x
            side += x.T @ batch.column("quality").to_numpy(zero_copy_only=False).astype(float)
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()], pa.binary()), pa.array([side.tobytes()], pa.binary())], ["gram", "side"])

    return sums


def _raw_scores(model: Model):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(_table(batch))), batch.column("quality").cast(pa.float64())], ["raw", "quality"])

    return rows


def isotonic(x: np.ndarray, total: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over sorted x with sums and counts: each pool's mean place and value."""
    pools: list[list[float]] = []
    for place, t, c in zip(x.tolist(), total.tolist(), count.tolist(), strict=True):
        pools.append([place * c, t, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def chosen_labels(labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """__v_doc, quality: the labels to learn from, at most ``max_rows``, none of fold 0. A written table, small by that bound."""
    marked = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").alias("__v_doc"), F.col("quality").cast("double").alias("quality"))
    return written(bounded_sample(marked.where(fold(F.col("__v_doc")) != 0), "__v_doc", max_rows), "labels")


def fit(stats: DataFrame, chosen: DataFrame) -> Model:
    """Fit on the statistics of ``chosen_labels``: ridge on folds 1 to 3, calibration on fold 4 (on all where either has no rows).

    Without labelled rows every score is 1.
    """
    rows = stats.join(F.broadcast(chosen), F.col("doc_id") == F.col("__v_doc")).select("doc_id", "quality", *STATS)
    rows = written(rows.repartition(PARTS, "doc_id"), "training")
    moments = rows.agg(F.count("*"), *[F.mean(s) for s in STATS], *[F.stddev_pop(s) for s in STATS]).first()
    none = np.zeros(0)
    if not moments[0]:
        return Model(none, none, none, none, none)
    d = len(STATS)
    means, spread = np.array(moments[1 : d + 1], float), np.array(moments[d + 1 :], float)
    model = Model(means, np.where(spread > 1e-9, spread, 1.0), none, none, none)
    size = RANDOM_FEATURES + 1
    held = fold(F.col("doc_id")) == FOLDS - 1
    parts = [rows.where(~held), rows.where(held)]
    if not all(p.limit(1).count() for p in parts):
        parts = [rows, rows]
    sums = parts[0].mapInArrow(_normal_equations(model), "gram binary, side binary").collect()
    gram = sum(np.frombuffer(bytes(s.gram)).reshape(size, size) for s in sums)
    side = sum(np.frombuffer(bytes(s.side)) for s in sums)
    model.weights = np.linalg.solve(gram + RIDGE * np.eye(size), side)
    scored = parts[1].mapInArrow(_raw_scores(model), "raw double, quality double")
    binned = scored.groupBy(F.floor(F.least(F.greatest(F.col("raw"), F.lit(-1.0)), F.lit(2.0)) * BINS).alias("bin")).agg(F.mean("raw"), F.sum("quality"), F.count("*")).orderBy("bin").collect()
    x, total, count = (np.array([b[k] for b in binned], float) for k in (1, 2, 3))
    model.steps_x, model.steps_y = isotonic(x, total, count)
    return model


def _scores(model: Model):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_table(batch)))], ["doc_id", "score"])

    return rows


def scores(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; repeated rows score alike, null texts as blank ones."""
    stats = written(statistics(docs), "statistics")
    scored = stats.mapInArrow(_scores(fit(stats, chosen_labels(labels, max_rows))), "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _passing(model: Model):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            yield batch.filter(pa.array(model.score(text_statistics(batch.column("text"))) >= THRESHOLD))

    return rows


def accepted(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of ``docs`` that the classifier predicts as 1, with all their columns; it is the one that ``scores`` fits.

    Only the chosen labelled rows' statistics are computed for the fit, their ids being broadcast; the filter then runs where
    the rows are, without a join. Null and blank texts are scored like others, repeated rows alike; an empty table stays empty.
    """
    chosen = chosen_labels(labels, max_rows)
    stats = statistics(docs.join(F.broadcast(chosen.select("__v_doc").distinct()), F.col("doc_id") == F.col("__v_doc"), "left_semi"))
    return docs.mapInArrow(_passing(fit(written(stats, "statistics"), chosen)), docs.schema)


def op8(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scores(docs, labels)
