import hashlib
import math
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veilum.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs)
    return out


def test_each_stage_acts_on_what_it_was_given(spark, stages):
    docs, good, apart, clean, plain, mixed = stages
    assert all(d.columns == docs.columns for d in stages[:-1])
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in stages]
    assert ids[5] <= ids[4] == ids[3] < ids[2] < ids[1] < ids[0]
    table = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    by_label = {r.quality: r.n for r in table("labels").where(F.col("doc_id").isin(list(ids[0] - ids[1]))).groupBy("quality").agg(F.count("*").alias("n")).collect()}
    assert by_label.get(0, 0) > 3 * by_label.get(1, 0)
    leads = {r.doc_id for r in queries.simhash.near_duplicates(good).where("doc_id = component_id").collect()}
    assert ids[2] == leads
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    runs = lambda t: {tuple(w[i : i + 5]) for w in [words(t)] for i in range(len(w) - 4)}
    items = [runs(r.text) for r in table("benchmark").collect()]
    for r in apart.collect():
        own = runs(r.text)
        assert (r.doc_id in ids[3]) == all(len(own & i) < 0.8 * len(i) for i in items)
    assert plain.where(F.col("text").rlike(r"@mail\d")).count() == clean.where(F.col("text").rlike(r"@mail\d")).count()
    before, after = ({r.doc_id: r for r in d.collect()} for d in (clean, plain))
    changed = [i for i in before if before[i].text != after[i].text]
    assert changed and all(after[i].n_chars == len(after[i].text) for i in changed)


def test_mixed_words_are_near_the_targets(spark, stages):
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    before = stages[4].agg(F.sum(words)).first()[0]
    after = stages[5].agg(F.sum(words)).first()[0]
    assert abs(after - 1.5 * before) < 0.1 * before and stages[5].columns[-1] == "copy"


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages[5].count()


def _scores(spark, docs, labels):
    return {r.doc_id: r.score for r in queries.quality.op8(docs, labels).collect()}


def test_the_first_stage_keeps_what_the_scores_say(spark, stages):
    """Scores themselves are held against a plain version in test_text_operators."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = _scores(spark, stages[0], labels)
    assert {r.doc_id for r in stages[1].select("doc_id").collect()} == {i for i, s in scores.items() if s >= 0.3}


def test_private_data_is_replaced_by_the_plain_pseudonyms(spark, stages):
    from tests.llm.test_mix_urls_pii import _plain_pseudonym

    found = {k: re.compile(p) for k, p in queries.pii.PATTERNS.items() if k in ("EMAIL", "IP")}
    after = {r.doc_id: r.text for r in stages[4].collect()}
    checked = 0
    for r in stages[3].collect():
        for kind, pattern in found.items():
            for m in pattern.finditer(r.text or ""):
                if kind == "EMAIL" or all(int(x) <= 255 for x in m[0].split(".")):
                    assert _plain_pseudonym(kind, m[0]) in after[r.doc_id]
                    checked += 1
    assert checked > 5


def test_mixing_draws_as_a_plain_version_does(spark, stages):
    rows = [(r.doc_id, r.source, len(re.findall(queries.mix.WORD, r.text or ""))) for r in stages[4].collect()]
    size = {}
    for _, s, n in rows:
        size[s] = size.get(s, 0) + n
    order = sorted(size)
    weight = {s: queries.mix.WEIGHTS[k % 3] for k, s in enumerate(order)}
    goal, capped = 1.5 * sum(size.values()), set()
    while True:
        level = (goal - sum(2 * size[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and level * weight[s] >= 2 * size[s]}
        if not over:
            break
        capped |= over
    want = {}
    for s in order:
        rate = (2 * size[s] if s in capped else level * weight[s]) / size[s]
        offset = int(hashlib.md5(f"{queries.mix.SEED}:{s}".encode()).hexdigest()[:8], 16) / 2**32
        for place, (n, i) in enumerate(sorted((n, i) for i, t, n in rows if t == s)):
            want[i] = math.floor(offset + (place + 1) * rate) - math.floor(offset + place * rate)
    got = {r.doc_id: r.n for r in stages[5].groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == {i: n for i, n in want.items() if n}


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in every column, blanks, repeated rows, a long text, extra columns whose names the operators use."""
    text = " ".join(f"word{k} and then some more of it" for k in range(40))
    rows = [
        (1, text, "en", "a", len(text)), (1, text, "en", "a", len(text)), (None, text + " end", None, None, None), (None, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t", "en", None, 3), (4, None, None, "b", None),
        (5, "mail me at a.b@mail1.example.com " + text[::-1], "de", "b", 9), (6, "x " * 200_000, "en", "b", 1), (7, "tiny", "en", "a", 4),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, copy string, private_kinds string, fp int, n int, root string, quality int, spans string"
    docs = spark.createDataFrame([(*r, "c", "p", 1, 2, "r", 3, "s") for r in rows], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (7, 0, 0), (None, 1, 0), (5, None, 0), (5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "some benchmark item that stands nowhere at all in here"), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema == docs.schema and out.count() <= 10
        kept = [r for r in out.collect()]
        assert all(r.private_kinds == "p" and r.copy == "c" and r.root == "r" and r.spans == "s" for r in kept)
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
    apart = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0) for r in apart if r.text and r.text.strip()) in ([1, 5, 6, 7], [0, 1, 5, 6, 7]) and sum(not (r.text or "").strip() for r in apart) == 1
    private = {r.doc_id: r for r in corpus_pipeline.replace_private(spark, docs, str(tmp_path)).collect()}
    assert private[5].n_chars == len(private[5].text) and "a.b@mail1" not in private[5].text and private[6].n_chars == 1
    mixed = corpus_pipeline.run(spark, str(tmp_path))
    assert mixed.columns == docs.columns and mixed.count() > 0
    assert corpus_pipeline.mix_sources(spark, docs.limit(0), str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for table in os.listdir(SF):
        con.execute(f"CREATE VIEW {table.split('.')[0]} AS SELECT * FROM '{SF}/{table}'")
    df = queries.QUERIES[name](spark, SF)
    result = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    want = sorted(repr([plain(r[columns.index(c)]) for c in df.columns]) for r in result.fetchall())
    assert sorted(repr([plain(v) for v in r]) for r in df.collect()) == want


def test_every_operator_has_one_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 11))
