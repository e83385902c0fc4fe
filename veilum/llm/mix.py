"""Mixing sources to target weights by systematic sampling.

Each source gets a target number of words. Within a source every document has the same expected number of copies
(target / source size); documents stand in order of size, the expected copies are prefix-summed, one offset is added, and a
copy is taken for each integer that a document's stretch crosses. As sizes rise along the order, the words taken differ
from the target by less than about one largest document of that source.

Positions come from a table sorted by (source, size, doc_id), which range partitioning spreads evenly however large one
source is; per-partition counts turn row numbers into positions, so no window gathers a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilum.llm._store import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_REPEATS = 2.0
SEED = 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _numbered(df: DataFrame, order: list[Column], label: str) -> DataFrame:
    """``df`` with __v_rank, its row's 0-based position in ``order`` over the whole table, without a single-task window.

    The sorted rows are written with ids that hold partition and row number; the driver gets one count per partition.
    """
    ids = written(df.orderBy(*order).withColumn("__v_id", F.monotonically_increasing_id()), label)
    part = F.shiftrightunsigned("__v_id", 33).cast("int")
    counts = {r[0]: r[1] for r in ids.groupBy(part.alias("p")).agg(F.count("*")).collect()}
    starts, total = [], 0
    for p in range(max(counts, default=0) + 1):
        starts.append(total)
        total += counts.get(p, 0)
    start = F.element_at(F.lit([str(s) for s in starts]), part + 1).cast("long")
    return ids.withColumn("__v_rank", start + F.col("__v_id").bitwiseAND((1 << 33) - 1)).drop("__v_id")


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """Columns source, source_size and others -> plus target and __v_rank (place in code-point order, null last).

    Targets are min(level * weight, max_repeats * size) with the level at which they add up to share * all words: what
    resharing the excess by weight, again and again, ends with. Each round reads two sums.
    """
    places = _numbered(sources, [F.col("source").asc_nulls_last()], "mix-sources")
    weight = F.element_at(F.lit(list(weights)), (F.col("__v_rank") % len(weights)).cast("int") + 1)
    table = places.withColumn("__v_weight", weight).withColumn("__v_cap", max_repeats * F.col("source_size"))
    total, weight_sum = table.agg(F.sum("source_size"), F.sum("__v_weight")).first()
    goal = share * (total or 0)
    level, full = (goal / weight_sum if weight_sum else 0.0), -1
    while True:
        capped = F.col("__v_cap") <= level * F.col("__v_weight")
        n, caps, open_weight = table.agg(F.count_if(capped), F.sum(F.when(capped, F.col("__v_cap"))), F.sum(F.when(~capped, F.col("__v_weight")))).first()
        if n == full or not open_weight:
            break
        full, level = n, (goal - (caps or 0.0)) / open_weight
    return table.withColumn("target", F.least("__v_cap", level * F.col("__v_weight"))).drop("__v_weight", "__v_cap")


def _drawn(rows: DataFrame, ties: list[Column], label: str, weights, share: float, max_repeats: float, seed: int) -> DataFrame:
    """``rows`` (with source and __v_size), in order of source, size and ``ties``, with __v_source_size, __v_target and __v_copies."""
    ranked = _numbered(rows, [F.col("source").asc_nulls_last(), F.col("__v_size"), *ties], label)
    sources = ranked.groupBy("source").agg(F.sum("__v_size").alias("source_size"), F.min("__v_rank").alias("first"))
    hexed = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("source"), F.lit("")))), 1, 8)
    offset = F.conv(hexed, 16, 10).cast("double") / float(1 << 32)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    named = {"source": F.col("source"), "source_size": F.col("source_size"), "target": F.col("target"), "offset": offset, "rate": rate, "first": F.col("first")}
    plan = source_targets(sources, weights, share, max_repeats).select(*[c.alias(f"__v_{k}") for k, c in named.items()])
    crossed = lambda i: F.floor(F.col("__v_offset") + i.cast("double") * F.col("__v_rate"))
    place = F.col("__v_rank") - F.col("__v_first")
    joined = ranked.join(plan, F.col("source").eqNullSafe(F.col("__v_source")))
    return joined.withColumn("__v_copies", (crossed(place + 1) - crossed(place)).cast("long")).drop("__v_rank", "__v_source", "__v_offset", "__v_rate", "__v_first")


def copies(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_repeats: float = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies: one row per row of ``docs``.

    Null and blank texts have size 0 (copies of them add no words); a null source is a source of its own; repeated rows
    are separate documents; an empty table gives no rows. Columns beyond doc_id, text and source are ignored.
    """
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("__v_size")), "mix-sizes")
    drawn = _drawn(sized, [F.col("doc_id")], "mix-order", weights, share, max_repeats, seed)
    return drawn.select("doc_id", "source", *[F.col(f"__v_{c}").alias(c) for c in ("size", "source_size", "target", "copies")])


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_repeats: float = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """The mixed corpus: each row as often as it was drawn, with ``copy`` counting from 1; an input column copy is replaced.

    Rows are drawn as by ``copies``, each for itself, repeated ones and those without an id too: they are sorted with their
    texts, which so travel once, and emitted from the sorted table.
    """
    sized = docs.withColumn("__v_size", word_count(F.col("text")))
    drawn = _drawn(sized, [F.col("doc_id"), F.xxhash64("text")], "mix-rows", weights, share, max_repeats, seed).where("__v_copies > 0")
    return drawn.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "__v_copies"))).drop("__v_size", "__v_source_size", "__v_target", "__v_copies")


def op1(docs: DataFrame) -> DataFrame:
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


#: The same draw in SQL: positions by window functions, the level from the sources in order of cap / weight.
OP1_SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][(k % 3 + 1)::INT] AS weight, {MAX_REPEATS}::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER before, 0.0) AS caps, (SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER before, 0.0) AS open,
             {SHARE}::DOUBLE * (SELECT sum(source_size) FROM s) AS goal
      FROM w WINDOW before AS (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT (goal - caps) / open AS level FROM o WHERE cap > (goal - caps) / open * weight ORDER BY cap / weight, k LIMIT 1),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM l), 0.0) * weight) AS target,
             ('0x' || substr(md5('{SEED}:' || coalesce(source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM w),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) - 1 AS i FROM d),
c AS (SELECT p.doc_id, p.size, t.source_size, t.target, t.u, p.i, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS r
      FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(u + (i + 1)::DOUBLE * r) - floor(u + i::DOUBLE * r))::BIGINT * size)::BIGINT AS taken FROM c
"""
