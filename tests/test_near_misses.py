"""Near misses over whole batches of documents."""

from pathlib import Path

import psutil
from pyspark.sql import functions as F

from veilum.operators import audit


def _workers() -> list[Path]:
    """/proc folders of Spark's Python workers."""
    return [Path(f"/proc/{p.pid}") for p in psutil.Process().children(recursive=True) if "pyspark.daemon" in p.cmdline()]


def _peak_mb(worker: Path) -> int:
    return max((int(x.split()[1]) >> 10 for x in (worker / "status").read_text().splitlines() if x.startswith("VmHWM")), default=0)


def test_a_batch_of_documents_is_never_a_batch_of_python_objects(spark):
    """One Arrow batch of 10 000 documents of 400 words once took over 1 GB of a worker."""
    text = F.concat(F.repeat(F.lit("word "), 398), F.lit("blen ding"))
    docs = spark.range(0, 10_000, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"), F.array().cast("array<struct<start:int,end:int,type:string,value:string>>").alias("spans"))
    for worker in _workers():
        (worker / "clear_refs").write_text("5")  # the peak begins anew
    found = audit.near_misses(docs, [("N", "blending")]).groupBy("kind", "token", "line").count().collect()
    assert [tuple(r) for r in found] == [("variant", "blen ding", 1, 10_000)]
    assert max(_peak_mb(w) for w in _workers()) < 500


def test_words_behind_and_between_covered_ones(spark):
    text = "x@y.com blen ding\nthan\nther a@b.org " + "w " * 398 + "blending"
    spans = [(0, 7, "EMAIL", "x@y.com"), (28, 35, "EMAIL", "a@b.org")]
    docs = spark.createDataFrame([(1, text, spans), (2, text, None), (3, None, None)], "doc_id long, text string, spans array<struct<start:int,end:int,type:string,value:string>>")
    rows = audit.near_misses(docs, [("N", "blending"), ("N", "thanther")]).collect()
    assert sorted((r.doc_id, r.kind, r.token, r.line) for r in rows) == [(1, "variant", "blen ding", 1), (2, "variant", "blen ding", 1)]


_DOCS = "doc_id long, text string, spans array<struct<start:int,end:int,type:string,value:string>>"


def test_all_words_of_a_text_count(spark):
    """Only the first 400 words were once looked at."""
    many = "word\n" * 30_000
    mail = [(len(many), len(many) + 7, "EMAIL", "x@y.com")]
    texts = [(1, many + "blending", None), (2, many + "Blen ding", None), (3, many + "blen\nding", None), (4, many + "blendingg", None), (5, many + "x@y.com blen ding", mail), (6, many, None)]
    rows = audit.near_misses(spark.createDataFrame(texts, _DOCS), [("N", "blending")]).collect()
    assert sorted((r.doc_id, r.kind, r.token, r.line) for r in rows) == [
        (1, "variant", "blending", 30_001), (2, "variant", "Blen ding", 30_001), (4, "near", "blendingg", 30_001), (5, "variant", "blen ding", 30_001),
    ]


def test_names_across_the_blocks_of_a_long_text(spark):
    texts = [(k, "w" * (audit.BLOCK - k) + " b-len d in-g " + "w" * audit.BLOCK + " thanther", None) for k in range(1, 16)]
    rows = audit.near_misses(spark.createDataFrame(texts, _DOCS), [("N", "blending"), ("N", "thanther")]).collect()
    assert sorted((r.doc_id, r.kind, r.token) for r in rows) == sorted((k, "variant", token) for k in range(1, 16) for token in ("b-len d in-g", "thanther"))


def test_words_in_blocks_are_all_words():
    text = "ab  c\nd-e 1 f' g²h ’i " * 9
    whole = [w[2] for w in audit.free_words(text, [], [])]
    for size in range(1, 30):
        old, audit.BLOCK = audit.BLOCK, size
        try:
            assert [w for words in audit.word_blocks(text) for w in words] == whole
        finally:
            audit.BLOCK = old
