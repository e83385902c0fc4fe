import random

from pyspark.sql import functions as F

from veilum.operators import audit, detect, placeholders, restore
from veilum.plans.api import Engine, register_functions

TEXTS = [
    "Da info@acme.it a INFO@acme.it, poi info@acme.it e 10.1.2.3",
    "[EMAIL-1] e a@acme.it b@acme.it [EMAIL-3]",
    "niente",
    "",
    None,
    "[CITTÀ-1] x@y.it\nIBAN IT60X0542811101000000123456",
]


def _done(spark, tag=None, texts=TEXTS):
    return placeholders.anonymize(detect.with_spans(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")), tag=tag)


def test_numbers_and_reserved_tokens(spark):
    rows = {r.doc_id: r for r in _done(spark).collect()}
    assert rows[0].redacted == "Da [EMAIL-1] a [EMAIL-2], poi [EMAIL-1] e [IP-1]"
    assert rows[1].redacted == "[EMAIL-1] e [EMAIL-2] [EMAIL-4] [EMAIL-3]"
    assert rows[2].redacted == "niente" and rows[3].redacted == "" and rows[4].redacted is None
    tagged = {r.doc_id: r.redacted for r in _done(spark, "ab12").collect()}
    assert tagged[1] == "[EMAIL-1] e [EMAIL-1-ab12] [EMAIL-2-ab12] [EMAIL-3]"


def test_round_trip_and_verdicts(spark):
    back = {r.doc_id: r for r in restore.restored(_done(spark, "ab12cd")).collect()}
    assert all(back[i].restored == t for i, t in enumerate(TEXTS))
    assert [back[i].complete for i in (0, 1, 2, 5)] == [True, False, False, True]
    assert back[0].replaced == 4 and back[1].unknown == 2


def test_random_texts_round_trip_and_are_clean_after(spark):
    rng = random.Random(11)
    bits = ["a@b.it", "10.2.3.4", "www.x.it/y", "é", "\n", "[ -1]", "IT60X0542811101000000123456", "token=abcdefgh99", "[EMAIL-1]", "db.acme.it"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    back = restore.restored(_done(spark, "00ff00", texts)).withColumn("again", detect.spans_of("redacted")).collect()
    assert all(r.restored == r.text for r in back)
    assert all(not r.again for r in back)


def test_longest_placeholder_first(spark):
    listed = F.array(*[F.struct(F.lit(f"[A-{n}").alias("placeholder"), F.lit("A").alias("type"), F.lit(v).alias("original")) for n, v in ((1, "one"), (10, "ten"), (2, None))])
    row = spark.range(1).select(restore.put_originals(F.lit("[A-10 [A-1 [A-2"), listed).alias("r")).first().r
    assert (row.text, row.replaced) == ("ten one [A-2", 2)


def test_counts_tags_and_long_numbers(spark):
    done = _done(spark, "ab12cd")
    assert done.where("doc_id = 0").select(placeholders.counts(F.col("entries")).alias("c")).first().c == {"EMAIL": 2, "IP": 1}
    assert done.where("doc_id = 0").select(placeholders.tag_of(F.col("entries")).alias("t")).first().t == "ab12cd"
    long = placeholders.number_spans(detect.exploded(done, "doc_id"), "doc_id")
    assert {(r.doc_id, r.type, r.value, r.number) for r in long.where("doc_id = 0").collect()} == {(0, "EMAIL", "info@acme.it", 1), (0, "EMAIL", "INFO@acme.it", 2), (0, "IP", "10.1.2.3", 1)}


def test_new_tags_are_free_and_unique(spark):
    runs = spark.range(2000).withColumnRenamed("id", "run_id")
    taken = spark.createDataFrame([(f"{i:02x}",) for i in range(128)], "tag string")
    tags = [r.tag for r in placeholders.new_tags(spark.range(20).withColumnRenamed("id", "run_id"), taken, width=2).collect()]
    assert len(tags) == len(set(tags)) == 20 and all(int(t, 16) >= 128 for t in tags)
    assert placeholders.new_tags(runs, taken).select("tag").distinct().count() == 2000


def test_audit_and_check(spark):
    engine = Engine()
    d = spark.createDataFrame([(1, "a@acme.it\nb\n10.1.2.3 [EMAIL-1]"), (2, "clean")], "doc_id int, text string")
    checked = {r.doc_id: r for r in engine.check(d).collect()}
    assert checked[1].sensitive and [(f.type, f.line) for f in checked[1].findings] == [("EMAIL", 1), ("IP", 3)] and not checked[2].sensitive
    audited = {r.doc_id: r for r in engine.audit(d).collect()}
    assert (audited[1].verdict, audited[1].placeholders, audited[2].verdict) == ("sensitive", 1, "clean")
    capped = d.where("doc_id = 1").withColumn("spans", detect.spans_of("text")).select(audit.findings(F.col("text"), F.col("spans"), 1).alias("f")).first().f
    assert capped.truncated and len(capped.findings) == 1 and capped.total == 2


def test_sql_names(spark):
    Engine().register(spark.createDataFrame([(1, "a@acme.it")], "doc_id int, text string"), "t_")
    register_functions(spark)
    assert spark.sql("SELECT mask_value(value) AS m, type FROM t_spans").first() == ("a••••••••", "EMAIL")
    assert spark.sql("SELECT redacted, is_placeholder(redacted) AS p FROM t_redacted").first() == ("[EMAIL-1]", True)
    assert spark.sql("SELECT base_name('C:\\\\a\\\\b/') AS b, xml_protect('<&') AS x, line_of('a\\nb', 2) AS l").first() == ("b", "&lt;&amp;", 2)
