"""Very long values, repeated rows and rows without an id, for the operators whose other tests have none."""

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from veilum.llm import crf, decontam, quality, rules, simhash, urls, warc

DOCS = "doc_id long, text string"
LONG = " ".join(f"w{k * 7919 % 100_003}" for k in range(300_000))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, LONG), (1, LONG), (None, LONG), (2, "short one"), (3, "x" * 1_500_000)], DOCS)


def _labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def test_decontaminate(spark, docs):
    words = LONG.split()
    items = [(1, " ".join(words[200_000:200_030])), (1, " ".join(words[200_000:200_030])), (None, " ".join(words[5:25])), (3, "not in there at all, this one")]
    found = decontam.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.item_id), r.n_shared, r.n_shingles) for r in found) == sorted([("1", "1", 26, 26)] * 4 + [("1", "None", 16, 16)] * 2 + [("None", "1", 26, 26)] * 2 + [("None", "None", 16, 16)])
    assert sorted(r.doc_id for r in decontam.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).collect()) == [2, 3]


def test_quality_rules(spark, docs):
    got = rules.op6(docs, _labels(spark)).collect()
    assert len(got) == 5
    for r in got:
        text = {1: LONG, None: LONG, 2: "short one", 3: "x" * 1_500_000}[r.doc_id]
        words = text.split()
        seen = {}
        for k in range(len(words) - 2):
            seen.setdefault(tuple(words[k : k + 3]), []).append(k)
        cover = {k + j for places in seen.values() if len(places) > 1 for k in places for j in range(3)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), len(cover))


def test_quality_scores(spark, docs):
    labels = [(k, int(k % 2), 0) for k in (1, 2, 3)]
    rows = quality.op8(docs, _labels(spark, labels)).collect()
    assert len(rows) == 5 and len({r.score for r in rows if r.doc_id in (1, None)}) == 1 and all(0 <= r.score <= 1 for r in rows)


def test_simhash(spark, docs):
    rows = simhash.op10(docs).collect()
    assert len(rows) == 5 and {r.component_id for r in rows if r.doc_id in (1, None)} == {1}


def test_warc(spark):
    html = "<p>" + "ä" * 2_000_000
    rows = [(1, "u", html), (2, "v", html), (2, "v", html), (None, "w", html), (3, "x" * 100_000, "<p>")]
    got = warc.op9(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    digest = base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
    assert sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in got if r.payload_digest == digest) == [("1", 4_000_003, "response", None), ("2", 4_000_003, "revisit", 1), ("2", 4_000_003, "revisit", 1), ("None", 4_000_003, "response", None)]
    assert len(got) == 5


def test_urls(spark):
    rows = [(1, "http://a.example.com/en/" + "x/" * 500_000), (1, "http://a.example.com/en/" + "x/" * 500_000), (None, "http://" + "a." * 2_000 + "spam-farm.example.org/"), (2, "y" * 1_000_000)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string")).select("page_id", F.length("host").alias("h"), F.length("path").alias("p"), "rule", "verdict").collect()
    assert len(got) == 4
    by = {(r.page_id, r.h): (r.p, r.rule, r.verdict) for r in got}
    assert by == {(1, 13): (1_000_004, "example.com/en/", "block"), (None, 4_021): (1, None, "block"), (2, 0): (0, None, "allow")}


def test_main_text(spark):
    page = "<article><h1>T</h1>" + "<p>Words of a paragraph, again and again.</p>" * 20_000 + "</article>"
    rows = crf.op5(spark.createDataFrame([(1, "u", page), (1, "u", page), (None, None, None)], "page_id long, url string, html string")).collect()
    assert [r.n_chars for r in rows] == [1 + 20_000 * 39, 1 + 20_000 * 39, 0] and rows[0].text == rows[1].text
