"""Quality rules: fixed base rules, then a decision list learned from labelled statistics, all as Spark expressions.

Learning is sequential covering: a rule is grown by the threshold test with the most FOIL gain, pruned on rows kept aside, and
taken if it still finds low quality there; the rows it covers are removed and the next rule is grown. The list becomes one
ordered conditional expression. It is learned from at most MAX_ROWS labels, those of smallest hash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilum.llm._store import bounded_sample, written

BLANKS = " \t\n\x0b\f\r"
WORD_CHAR = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
UPPER = "A-Z"
MAX_ROWS = 20_000
MAX_RULES, MAX_TESTS, MIN_COVER, MIN_PRECISION = 16, 4, 5, 0.7
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_bangs", "n_lines")


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _count_of(text: Column, chars: str) -> Column:
    """Characters of a class, as it stands between brackets in a pattern."""
    return F.regexp_count(text, F.lit(f"[{chars}]"))


def _repeated(words: Column) -> Column:
    """Words in windows of three that stand twice or more.

    Window hashes are sorted with their places in the low bits; neighbours of equal hash are compared word by word. Texts
    whose window hashes all differ, most texts, are done before the sort.
    """

    def windows(n):
        hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
        return F.when(n < 3, F.lit(0)).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(marked(h, F.length(F.bin(n.cast("long")))))))

    def marked(hashes, bits):
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        keys = F.sort_array(F.transform(hashes, lambda h, i: F.call_function("shiftleft", h, bits).bitwiseOR(i.cast("long"))))

        def twice(s):
            def equal(x, y):
                same = F.call_function("shiftrightunsigned", x, bits) == F.call_function("shiftrightunsigned", y, bits)
                place = lambda k: k.bitwiseAND(mask).cast("int")
                alike = [F.get(words, place(x) + d) == F.get(words, place(y) + d) for d in range(3)]
                return F.coalesce(same & alike[0] & alike[1] & alike[2], F.lit(False))

            found = F.filter(s, lambda x, j: equal(x, F.get(s, j - 1)) | equal(x, F.get(s, j + 1)))
            places = F.sort_array(F.transform(found, lambda x: x.bitwiseAND(mask).cast("int")))
            start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("end"))
            add = lambda a, p: F.struct((a["total"] + p + 3 - F.greatest(p, a["end"])).alias("total"), (p + 3).alias("end"))
            return F.aggregate(places, start, add)["total"]

        return let(keys, twice)

    return let(F.size(words), windows)


def statistics(text: Column) -> Column:
    """struct of STATS (long); a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))

    def of(t):
        lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD_CHAR))
        trimmed = F.btrim(t, F.lit(BLANKS))
        words = F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+", -1))
        dups = lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))
        word_part = let(words, lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), _repeated(w).alias("rep")))
        parts = F.struct(let(lines, dups).alias("lines"), word_part.alias("words"))

        def named(p):
            values = {
                "n_words": p["words"]["n"],
                "word_chars": p["words"]["chars"],
                "n_symbols": _count_of(t, SYMBOLS),
                "n_dup_lines": p["lines"]["dup"],
                "n_repeat_words": p["words"]["rep"],
                "n_upper": _count_of(t, UPPER),
                "n_bangs": F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit(""))),
                "n_lines": p["lines"]["n"],
            }
            return F.struct(*[values[k].cast("long").alias(k) for k in STATS])

        return let(parts, named)

    return let(text, of)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


#: What rules test, as functions of the statistics (Columns or numpy arrays).
FEATURES = {
    "words": lambda s: s["n_words"] * 1.0,
    "chars_per_word": lambda s: s["word_chars"] / (s["n_words"] + 1.0),
    "symbols_per_word": lambda s: s["n_symbols"] / (s["n_words"] + 1.0),
    "dup_line_share": lambda s: s["n_dup_lines"] / (s["n_lines"] + 1.0),
    "repeat_share": lambda s: s["n_repeat_words"] / (s["n_words"] + 1.0),
    "upper_share": lambda s: s["n_upper"] / (s["word_chars"] + 1.0),
    "bangs_per_word": lambda s: s["n_bangs"] / (s["n_words"] + 1.0),
}


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool  # value >= limit, else value <= limit
    limit: float

    def holds(self, values):
        x = values[self.feature]
        return x >= self.limit if self.above else x <= self.limit


def _gain(p: np.ndarray, n: np.ndarray, p0: int, n0: int) -> np.ndarray:
    """FOIL gain of tests that leave p low and n good rows of p0 and n0."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * (np.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))), 0.0)


def _best(values: dict, low: np.ndarray) -> tuple[float, Test | None]:
    """The test with the most gain; limits are midpoints of neighbouring values."""
    p0, n0, best = int(low.sum()), int((~low).sum()), (0.0, None)
    for name, x in values.items():
        order = np.argsort(x, kind="stable")
        xs, ys = x[order], low[order]
        cuts = np.flatnonzero(xs[1:] > xs[:-1]) + 1
        if not len(cuts):
            continue
        limits = (xs[cuts] + xs[cuts - 1]) / 2
        p, n = np.cumsum(ys)[cuts - 1], np.cumsum(~ys)[cuts - 1]
        for above, gains in ((False, _gain(p, n, p0, n0)), (True, _gain(p0 - p, n0 - n, p0, n0))):
            k = int(np.argmax(gains))
            if gains[k] > best[0] + 1e-12:
                best = (float(gains[k]), Test(name, above, float(limits[k])))
    return best


def _covered(rule: list[Test], values: dict, n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for test in rule:
        out &= test.holds(values)
    return out


def learn(values: dict[str, np.ndarray], low: np.ndarray) -> list[list[Test]]:
    """Rules for low quality, in order. Every third row is kept aside for pruning. No rows of a class: no rules."""
    rules, aside = [], np.arange(len(low)) % 3 == 2
    left = np.ones(len(low), bool)
    while len(rules) < MAX_RULES:
        grow, prune = left & ~aside, left & aside
        if not (low & grow).any() or not (~low & grow).any():
            break
        rule, inside = [], grow.copy()
        while len(rule) < MAX_TESTS and (low & inside).any() and (~low & inside).any():
            _, test = _best({k: v[inside] for k, v in values.items()}, low[inside])
            if test is None:
                break
            rule.append(test)
            inside &= test.holds(values)
        worth = []
        for k in range(1, len(rule) + 1):
            hit = _covered(rule[:k], values, len(low)) & prune
            p, n = int((hit & low).sum()), int((hit & ~low).sum())
            worth.append(((p - n) / (p + n) if p + n else -1.0, p + n, k))
        if not worth:
            break
        value, cover, k = max(worth, key=lambda w: (w[0], -w[2]))
        if cover < MIN_COVER or (value + 1) / 2 < MIN_PRECISION:
            break
        rules.append(rule[:k])
        left &= ~_covered(rule[:k], values, len(low))
    return rules


def verdict(rules: list[list[Test]], row: dict[str, Column]) -> Column:
    """False where a rule holds, the first that does deciding; else true."""
    values = {name: f(row) for name, f in FEATURES.items()}
    out = None
    for rule in rules:
        test = F.lit(True)
        for t in rule:
            test = test & t.holds(values)
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def learn_from(stats: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> list[list[Test]]:
    """``stats``: doc_id and STATS. ``labels``: doc_id, quality. Rows without a label or an id don't count."""
    marked = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").alias("__v_doc"), "quality")
    chosen = F.broadcast(bounded_sample(marked, "__v_doc", max_rows))
    rows = stats.join(chosen, F.col("doc_id") == F.col("__v_doc")).select("doc_id", "quality", *STATS)
    rows = bounded_sample(rows, "doc_id", max_rows).collect()  # a repeated id has a row for each of its texts
    table = {name: np.array([r[name] for r in rows], float) for name in STATS}
    return learn({name: f(table) for name, f in FEATURES.items()}, np.array([r.quality == 0 for r in rows], bool))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, STATS, base_failed and kept for every row of ``docs``.

    Null and blank texts have all statistics 0 and fail the base rules; repeated rows are judged alike. Without usable
    labels only the base rules decide.
    """
    stats = written(docs.select("doc_id", statistics(F.col("text")).alias("__v_stats")).select("doc_id", "__v_stats.*"), "statistics")
    rules = learn_from(stats, labels)
    failed = base_failed()
    kept = F.when(failed, False).otherwise(verdict(rules, {name: F.col(name) for name in STATS}))
    return stats.select("doc_id", *STATS, failed.alias("base_failed"), kept.alias("kept"))


def op6(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judged(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
