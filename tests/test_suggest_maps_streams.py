import datetime
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from veilum.operators import detect, dictionary, mapstore, markup, placeholders, quality, reports, suggest
from veilum.plans.api import Engine
from veilum.sources import files
from veilum.streaming import streams


def test_windows_cover_and_overlap(spark):
    rng = random.Random(9)
    for _ in range(200):
        text = "".join(rng.choice("abc  \n") for _ in range(rng.randint(0, 400)))
        size = rng.randint(2, 90)
        overlap = rng.randint(0, size - 1)
        w = suggest.windows_of(text, size, overlap)
        assert w[0][0] == 0 and w[-1][1] == len(text)
        assert all(b[0] <= a[1] - overlap and b[0] > a[0] for a, b in zip(w, w[1:], strict=False))
    assert suggest.windows_of("x" * 50, 0, 0, 20) == [(0, 20)]
    with pytest.raises(ValueError):
        suggest.windows_of("x", 5, 5)
    rows = spark.createDataFrame([("a b " * 50,), (None,), ("",)], "t string").select(suggest.windows(F.col("t"), 30, 5).alias("w")).collect()
    assert rows[0].w[-1].end == 200 and [tuple(x) for x in rows[1].w] == [(0, 0)]


@pytest.mark.parametrize("answer, values", [
    ('{"candidates":[{"value":"Mario","type":"person"}]}', [("Mario", "PERSON")]),
    ('Here:\n```json\n["Mario", "ab", "Mario"]\n```', [("Mario", "ALTRO")]),
    ('text [ {"value": "X 1 2"} ] more', [("X 1 2", "ALTRO")]),
    ("no json", []), ('{"candidates": 5}', []), ('[{"value": 7}, null]', []),
])
def test_answers(answer, values):
    assert [(x["value"], x["type"]) for x in suggest.named_in(answer)] == values


def test_proposals(spark):
    text = "Mario meets Anna and a@acme.it; Mario leaves [EMAIL-1]"
    d = detect.with_spans(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    named = [("Mario", "P", "r"), ("Mario", "P", "r"), ("acme.it", "H", ""), ("Nobody", "P", ""), ("[EMAIL-1]", "E", ""), ("an", "P", "")]
    rows = suggest.proposals(d.crossJoin(spark.createDataFrame(named, "value string, type string, reason string"))).collect()
    assert [(r.value, len(r.places), r.overlap) for r in rows] == [("Mario", 2, False), ("acme.it", 1, True)]
    asked = suggest.ask(spark.createDataFrame([("x",)], "piece string")).first().named
    assert asked == []


def test_fixed_windows(spark):
    rows = spark.createDataFrame([(0,), (10,), (11,), (25,)], "n int").select("n", suggest.fixed_windows(F.col("n"), 10, 2).alias("w")).collect()
    assert [[(x.start, x.end) for x in r.w] for r in rows] == [[(0, 0)], [(0, 10)], [(0, 10), (8, 11)], [(0, 10), (8, 18), (16, 25)]]


def test_recall_measures(spark):
    schema = "name int, text string, must_find array<struct<value:string,type:string>>, must_not array<struct<value:string,type:string>>"
    corpus = spark.createDataFrame([(1, "Mario a@acme.it Mario", [("a@acme.it", "EMAIL"), ("Mario", "NAME")], [("acme", "")])], schema)
    spans = detect.exploded(detect.with_spans(corpus), "name")
    assert {(r.type, r.declared, r.covered, r.typed, r.recall) for r in quality.recall(corpus, spans).collect()} == {("EMAIL", 1, 1, 1, 1.0), ("NAME", 1, 0, 0, 0.0)}
    places = quality.occurrences(corpus, "must_find")
    assert [(r.value, r.in_clear) for r in quality.leaks(places, spans).collect()] == [("Mario", 2)]
    assert quality.violations(corpus, spans).count() == 1 and quality.undeclared(places, spans).count() == 0


def test_map_store(spark, tmp_path):
    d = placeholders.anonymize(detect.with_spans(spark.createDataFrame([(str(i), f"u{i}@acme.it 10.0.0.{i}") for i in range(1, 5)], "map_id string, text string")), tag="ab12cd")
    rows = d.withColumn("tag", F.lit("ab12cd")).withColumn("source", F.concat(F.lit("/x/"), "map_id")).withColumn("output", F.lit(None).cast("string")).withColumn("created", F.expr("timestamp'2026-01-01' + make_interval(0, 0, 0, cast(map_id as int))")).withColumn("counts", placeholders.counts(F.col("entries")))
    mapstore.write_maps(rows, str(tmp_path))
    maps, entries = mapstore.read_maps(spark, str(tmp_path))
    assert entries.count() == 8 and mapstore.existing_tags(maps).collect()[0].tag == "ab12cd"
    listed = mapstore.listing(maps, 2).collect()
    assert [(r.map_id, r.source, r.entries, r.total, r.truncated) for r in listed] == [("4", "4", 2, 4, True), ("3", "3", 2, 4, True)]
    with pytest.raises(ValueError):
        mapstore.purge(spark, str(tmp_path), 3)
    assert mapstore.purge(spark, str(tmp_path), 4) == 4 and not (tmp_path / "maps").exists()
    with pytest.raises(ValueError):
        mapstore.prunable(maps, F.current_timestamp(), 0)


def test_redacted_stream(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a.txt").write_text("mail a@acme.it")
    out = streams.redacted_stream(streams.text_files(spark, str(source)), tag="ab12")
    write = out.select("path", "redacted").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
    write.start(str(target)).awaitTermination()
    (source / "b.txt").write_text("clean")
    write.start(str(target)).awaitTermination()
    assert sorted(r.redacted for r in spark.read.parquet(str(target)).collect()) == ["clean", "mail [EMAIL-1-ab12]"]


def test_rate_limit(spark, tmp_path):
    source, start = tmp_path / "in", datetime.datetime(2026, 1, 1)
    rows = [("k", start + datetime.timedelta(seconds=s)) for s in (0, 0, 0, 0, 1, 60)] + [("other", start)]
    spark.createDataFrame(rows, "key string, at timestamp").coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema("key string, at timestamp").parquet(str(source))
    query = streams.rate_limited(stream, per_minute=12, burst=3).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = [r.allowed for r in spark.sql("SELECT * FROM limited WHERE key = 'k' ORDER BY at, allowed DESC").collect()]
    assert got == [True, True, True, False, False, True] and spark.sql("SELECT allowed FROM limited WHERE key = 'other'").first().allowed


def test_windowed_counts_are_lazy(spark):
    d = detect.with_spans(spark.createDataFrame([(datetime.datetime(2026, 1, 1, h), "a@acme.it") for h in (1, 1, 3)], "ts timestamp, text string"))
    assert sorted(r["count"] for r in streams.counts_by_type(d).collect()) == [1, 2]


def test_frames_and_deltas(spark):
    lines = [json.dumps({"id": "1", "method": "tools/call", "params": {"name": "anonymize", "text": "a@acme.it"}}), "{", "[]", " ", json.dumps({"id": "2", "method": "x"}), "y" * 100]
    frames = streams.frames(spark.createDataFrame([(x,) for x in lines], "value string"), limit=90)
    assert [r.error for r in frames.collect()] == [None, -32700, -32600, -32601, -32600]
    assert [tuple(r) for r in streams.answers(frames).collect()] == [("1", "anonymize", "sensitive", 1, "[EMAIL-1]")]


def test_reports_and_stored_things(spark, tmp_path):
    from veilum.operators import dictionary, reports

    (tmp_path / "good.txt").write_text("A|Contoso\nB|contoso ltd\n")
    (tmp_path / "bad.txt").write_text("@typo\n")
    assert {r.name: r.entries for r in dictionary.catalogs(spark, str(tmp_path)).collect()} == {"bad": -1, "good": 2}
    assert dictionary.globs_in("# x\n\n*.md \n/pub/*\n") == ["*.md", "/pub/*"]
    target = tmp_path / "mine.txt"
    assert dictionary.save(str(target), "A|Alpha\n", {"other": "B|Beta\n"}) == [] and target.read_text() == "A|Alpha\n" and target.stat().st_mode & 0o777 == 0o600
    for text in ("B|beta\n", "A|Gamma\nB|gamma\n", "@typo\n"):
        with pytest.raises(dictionary.DictionaryError):
            dictionary.save(str(target), text, {"other": "B|Beta\n"})
    assert target.read_text() == "A|Alpha\n"
    assert [e.surface for e in dictionary.resolve([str(target)], ["/no/file"])] == ["Alpha"] and dictionary.resolve([], ["/no/file"]) == []
    with pytest.raises(FileNotFoundError):
        dictionary.resolve(["/no/file"])
    entries = spark.createDataFrame([("m", "[A-1]", "A", "x")], mapstore.ENTRIES)
    with pytest.raises(PermissionError):
        reports.reveal(entries, "m")
    assert reports.reveal(entries, "m", confirm=True).first().original == "x"


def test_written_files(spark, tmp_path):
    made = spark.createDataFrame([("a.docx", bytearray(b"one")), ("x/b.docx", bytearray(b""))], "name string, content binary")
    assert sorted(map(tuple, files.write_files(made, str(tmp_path / "out")).collect())) == [("a.docx", 3), ("x/b.docx", 0)]
    assert (tmp_path / "out" / "a.docx").read_bytes() == b"one" and sorted(p.name for p in (tmp_path / "out").rglob("*")) == ["a.docx", "b.docx", "x"]


def test_every_run_gets_a_tag_of_its_own(spark):
    runs, taken = spark.range(300).select(F.col("id").alias("run_id")), spark.createDataFrame([("aa",), ("0b",)], "tag string")
    rows = placeholders.new_tags(runs, taken, width=2).collect()
    assert len(rows) == 300 and len({r.tag for r in rows}) == 300 and {len(r.tag) for r in rows} == {2, 8} and not {"aa", "0b"} & {r.tag for r in rows}


def test_long_folds_take_linear_time(spark):
    xml = "<d>" + "<p>x</p>" * 30_000 + "</d>"
    d = spark.createDataFrame([(xml,)], "x string").select(F.size(markup.segments(F.col("x"))).alias("s"), F.size(markup.runs(F.sequence(F.lit(0), F.lit(200_000), F.lit(2)))).alias("r"))
    began = time.time()
    assert tuple(d.first()) == (60_003, 100_001) and time.time() - began < 30


def test_events_propose_nothing_before_the_end():
    text = "Mario meets Anna. " * 3 + "[EMAIL-1] tail"
    answers = iter([['{"candidates": ["Mar', 'io", "Ghost", "[EMAIL-1]"]}'], '["Anna", "Mario"]', ""])
    got = list(suggest.events(text, [(0, 5)], lambda piece: next(answers), size=30, overlap=6))
    assert [e["event"] for e in got] == ["start", "delta", "delta", "delta", "done"] and got[0]["chunks"] == 3 and got[0]["chars"] == len(text)
    found = got[-1]["report"]["candidates"]
    assert [(c["value"], c["count"], c["overlap"]) for c in found] == [("Mario", 3, True), ("Anna", 3, False)]
    assert json.loads(suggest.sse(got[1])[6:]) == got[1] and suggest.sse(got[1]).endswith("}\n\n")

    def failing(piece):
        yield "half an ans"
        raise ConnectionError("gone")

    assert [e["event"] for e in suggest.events("abc", [], failing)] == ["start", "delta", "error"]


def test_advice_and_approval(spark):
    found = dictionary.conflicts_of(spark, {"a": "A|Contoso\nB|contoso\n", "b": "C|Lone\n"})
    asked = json.loads(suggest.question(found))
    assert asked == [{"surface": "Contoso", "candidates": ["A (line 1)", "B (line 2)"]}]
    told = suggest.advise(found, lambda q: '{"advice": [{"surface": "Contoso", "keep": "b", "reason": "r"}, {"surface": "Contoso", "keep": "Z"}, {"surface": "No", "keep": "A"}, 5]}')
    assert [tuple(r) for r in told.collect()] == [("Contoso", "B", "r")]
    none = dictionary.conflicts_of(spark, {"a": "A|One\n"})
    assert suggest.question(none) is None and suggest.advise(none, lambda q: pytest.fail("asked")).collect() == []
    text, taken, refused = dictionary.approve(spark, "mine", "A|Contoso\n\n", [("b", "CONTOSO"), ("c", "Fabrikam"), ("d", "a|b"), ("e", "Elsewhere"), ("f", "Dup"), ("g", "dup")], {"other": "X|elsewhere\n"})
    assert (text, taken, refused) == ("A|Contoso\nC|Fabrikam\n", ["Fabrikam"], ["CONTOSO", "a|b", "Elsewhere", "Dup", "dup"])
    assert dictionary.approve(spark, "mine", "A|x\n", [])[0] == "A|x\n"


def test_names_given_in_several_ways():
    assert dictionary.as_list(None) == [] and dictionary.as_list(" a, ,b ") == ["a", "b"] and dictionary.as_list(["x ", 5, ""]) == ["x", "5"]
    with pytest.raises(ValueError):
        dictionary.as_list(5)


def test_precision_recall_and_summary(spark):
    schema = "name string, must_find array<struct<value:string,type:string>>, known_miss array<struct<value:string,why:string>>"
    corpus = spark.createDataFrame([("a", [("Mario Rossi", "P"), ("Acme", "A")], [("il capo", "x")]), ("b", [], []), ("c", [("Zed", "P")], [])], schema)
    proposed = spark.createDataFrame([("a", "Rossi", True), ("a", "ario", False), ("a", "the Acme group", False), ("a", "capo", False), ("b", "noise", False)], "name string, value string, overlap boolean")
    row = quality.precision_recall(corpus, proposed).first().asDict()
    assert row == {"proposals": 5, "correct": 2, "must_find": 3, "covered": 1, "already_found": 1, "known_miss": 1, "closed": 1, "precision": 0.4, "recall": 0.333}
    runs = spark.createDataFrame([("x", 2.0, 10.0), ("x", 4.0, 10.0), ("x", 3.0, 10.0)], "name string, seconds double, mb double")
    assert quality.summary(runs, "name").first().asDict() == {"name": "x", "best": 2.0, "median": 3.0, "runs": 3, "mb": 10.0, "mb_per_second": 5.0}


def test_reports_as_json(spark):
    engine = Engine(dictionary.parse("C|Contoso")[0])
    d = spark.createDataFrame([(1, "Con Toso wrote to a@acme.it [EMAIL-1]"), (2, "clean"), (3, "Con Toso only")], "doc_id int, text string")
    rows = {r.doc_id: json.loads(r.j) for r in engine.audit(d).select("doc_id", reports.audit_json({"doc_id": F.col("doc_id")}).alias("j")).collect()}
    assert rows[1]["verdict"] == "sensitive" and rows[1]["types"] == {"EMAIL": 1} and rows[1]["placeholders_present"] == 1 and rows[1]["findings"] == [{"type": "EMAIL", "line": 1}]
    assert "Toso" not in json.dumps(rows[1]) and rows[3]["verdict"] == "suspicious" and rows[3]["near_miss"][0]["kind"] == "variant" and rows[2]["verdict"] == "clean"
    shown = engine.audit(d, reveal=True).where("doc_id = 3").select(reports.audit_json({}, reveal=True).alias("j")).first().j
    assert json.loads(shown)["near_miss"][0]["token"] == "Con Toso"
    dry = engine.anonymize(d).select(reports.dry_run_json(F.lit("a.txt"), F.lit("a.redacted.txt"), F.size("entries"), placeholders.counts(F.col("entries"))).alias("j")).first().j
    assert json.loads(dry) == {"schema": "veilum/1", "tool": "dry-run", "dry_run": True, "file": "a.txt", "sensitive": True, "would_write": "a.redacted.txt", "entries": 1, "counts": {"EMAIL": 1}}


def test_a_stream_is_scanned_for_a_dictionary(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Acme and a@acme.it")
    out = streams.redacted_stream(streams.text_files(spark, str(tmp_path / "in")), entries=dictionary.parse("C|Acme")[0])
    run = out.select("redacted").writeStream.format("memory").queryName("dictionary_stream").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert [r.redacted for r in spark.table("dictionary_stream").collect()] == ["[C-1] and [EMAIL-1]"]
