import io
import json
import os
import re
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from veilum.operators import dictionary, mapstore, placeholders
from veilum.plans import batch
from veilum.plans.api import Engine
from veilum.sources import containers, files


def _docx(*parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts:
            z.writestr(name, data)
    return out.getvalue()


DOCX = _docx(("word/document.xml", "<w:document><w:body><w:p><w:t>Acme and info@acme.it</w:t></w:p></w:body></w:document>"))


@pytest.fixture
def engine():
    return Engine(dictionary.parse("AZIENDA|Acme")[0], key="path")


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "docs"
    (root / "sub").mkdir(parents=True)
    (root / "note.txt").write_text("Cliente Acme, mail mario@acme.it")
    (root / "sub" / "note.txt").write_text("nothing here")
    (root / "sub" / "brackets [1].txt").write_text("Acme")
    (root / "a.docx").write_bytes(DOCX)
    (root / "broken.docx").write_bytes(b"PK\x03\x04" + b"\x07" * 64)
    (root / "pic.png").write_bytes(b"\x89PNG\r\n\x1a\n\x00")
    (root / "old.redacted.txt").write_text("x@acme.it")
    (root / "big.txt").write_text("y" * 9000)
    store = tmp_path / "store"
    store.mkdir()
    (store / "m.txt").write_text("secret@acme.it")
    (tmp_path / "out.txt").write_text("other@acme.it")
    (root / "link.txt").symlink_to(tmp_path / "out.txt")
    (root / "store.txt").symlink_to(store / "m.txt")
    (root / "within.txt").symlink_to(root / "note.txt")
    return root


def _named(rows):
    return {r.relative: r for r in rows.collect()}


def test_scope_is_told_from_metadata(spark, folder, tmp_path):
    listed = files.listing(spark, str(folder), 8000, private=[str(tmp_path / "store")])
    assert "content" not in re.search("ReadSchema: [^\n]*", listed._jdf.queryExecution().executedPlan().toString())[0]
    why = {r.name: r.skipped for r in listed.collect() if r.skipped}
    assert why == {"old.redacted.txt": "own output", "big.txt": "too large", "link.txt": "link out of the folder", "store.txt": "private"}
    rows = {r.name: r for r in files.scan(spark, str(folder), 8000, lambda name, path: dictionary.allowed(name, path, ["pic.*"]), [str(tmp_path / "store")]).collect()}
    assert rows["pic.png"].skipped == "allowed" and rows["pic.png"].kind is None and rows["link.txt"].text is None
    assert rows["brackets [1].txt"].text == "Acme" and rows["within.txt"].text.startswith("Cliente") and rows["a.docx"].kind == "container"


def test_verdicts_fail_closed(spark, folder, engine, tmp_path):
    rows = _named(batch.verdicts(spark, engine, str(folder), [str(tmp_path / "store")], 8000))
    assert {k: (r.total, r.unscannable) for k, r in rows.items() if r.skipped is None} == {
        "note.txt": (2, False), "within.txt": (2, False), "sub/note.txt": (0, False), "sub/brackets [1].txt": (1, False), "a.docx": (2, False), "broken.docx": (1, True), "pic.png": (1, True),
    }
    assert rows["note.txt"].counts == {"AZIENDA": 1, "EMAIL": 1} and rows["big.txt"].skipped == "too large"
    only = tmp_path / "only"
    only.mkdir()
    (only / "x.docx").write_bytes(b"PK\x03\x04" + b"\x07" * 64)
    assert batch.totals(batch.verdicts(spark, engine, str(only))).first().sensitive


def test_copies_keep_their_places_and_sources_stay(spark, folder, engine, tmp_path):
    out, maps = tmp_path / "made", tmp_path / "maps"
    before = {p: p.read_bytes() for p in folder.rglob("*") if p.is_file()}
    rows = batch.redactions(spark, engine, str(folder), str(out), [str(tmp_path / "store")], max_bytes=8000).cache()
    plan = json.loads(batch.report(rows, str(folder), dry_run=True, out=str(out)))
    assert not out.exists() and plan["totals"] == {"scanned": 5, "changed": 4, "placeholders": 7, "skipped": 6}
    assert "mario@acme.it" not in json.dumps(plan) and {os.path.basename(x["file"]) for x in plan["skipped"]} >= {"link.txt", "store.txt", "pic.png", "broken.docx"}
    assert {x["redacted"] for x in plan["files"]} == {f"{out}/{n}" for n in ("note.redacted.txt", "within.redacted.txt", "sub/note.redacted.txt", "sub/brackets [1].redacted.txt", "a.redacted.docx")}
    written = batch.write(rows, str(folder), str(maps), str(out)).collect()
    assert len(written) == 5 and {p: p.read_bytes() for p in folder.rglob("*") if p.is_file()} == before
    text = (out / "note.redacted.txt").read_text()
    tag = placeholders.tag_of(F.col("entries"))
    tags = {r.relative: r.tag for r in rows.select("relative", tag.alias("tag")).collect() if r.tag}
    assert text == f"Cliente [AZIENDA-1-{tags['note.txt']}], mail [EMAIL-1-{tags['note.txt']}]" and len(set(tags.values())) == 4
    assert (out / "sub" / "note.redacted.txt").read_text() == "nothing here" and oct((out / "note.redacted.txt").stat().st_mode)[-3:] == "600"
    with zipfile.ZipFile(out / "a.redacted.docx") as z:
        assert f"[AZIENDA-1-{tags['a.docx']}] and [EMAIL-1-{tags['a.docx']}]" in z.read("word/document.xml").decode()
    kept, entries = mapstore.read_maps(spark, str(maps))
    assert kept.count() == 4 and entries.count() == 7


def test_copies_beside_their_sources_are_not_taken_up_again(spark, folder, engine, tmp_path):
    rows = batch.redactions(spark, engine, str(folder), None, [str(tmp_path / "store")], max_bytes=8000).cache()
    batch.write(rows, str(folder), str(tmp_path / "maps")).collect()
    again = _named(files.listing(spark, str(folder), 8000))
    assert again["note.redacted.txt"].skipped == "own output" and again["a.redacted.docx"].skipped == "own output"


def test_refused_scopes(spark, folder, engine, tmp_path):
    for root, out, private in ((folder / "note.txt", None, []), (folder, folder, []), (folder, tmp_path, []), (tmp_path / "store", None, [str(tmp_path)])):
        with pytest.raises(ValueError):
            batch.check_scope(str(root), out and str(out), private)
    assert batch.check_scope(str(folder), str(folder / "made"), []) is None


def test_streams_in_and_out(spark, engine):
    d = files.from_stream(spark, io.BytesIO("Acme \xff è qui".encode("latin-1")))
    out = io.StringIO()
    assert files.to_stream(engine.anonymize(d), out) == 1 and out.getvalue() == "[AZIENDA-1] � � qui\n"


def test_published_files_go_after_a_while(tmp_path):
    first = files.publish(str(tmp_path), "dir/a b.txt", b"one")
    assert (tmp_path / first).read_bytes() == b"one" and first.endswith("/a b.txt")
    second = files.publish(str(tmp_path), "c.txt", b"two")
    assert (tmp_path / first).exists() and (tmp_path / second).exists()
    files.publish(str(tmp_path), "d.txt", b"three", now=time.time() + 4000)
    assert not (tmp_path / first).exists() and not (tmp_path / second).exists() and len(list(tmp_path.iterdir())) == 1


def test_artifacts_share_one_map(spark, engine):
    d = spark.createDataFrame([("a.docx", bytearray(DOCX)), ("b.docx", bytearray(b"PK\x03\x04 no"))], "path string, content binary")
    row = containers.artifacts(d, "ab12", None, engine.entries).collect()
    assert [r.path for r in row] == ["a.docx"] and row[0].text.strip() == "[AZIENDA-1-ab12] and [EMAIL-1-ab12]"
    with zipfile.ZipFile(io.BytesIO(bytes(row[0].content))) as z:
        assert "[EMAIL-1-ab12]" in z.read("word/document.xml").decode()
    assert {e.placeholder: e.original for e in row[0].entries} == {"[AZIENDA-1-ab12]": "Acme", "[EMAIL-1-ab12]": "info@acme.it"}


def test_restored_containers_are_judged_by_what_was_made(spark):
    body = "<w:document><w:p><w:t>[EMAIL-</w:t><w:t>1] and [IP-1]</w:t></w:p></w:document>"
    odd = _docx(("word/document.xml", body.replace("[IP-1]", "[IP-7]")))
    split = _docx(("word/document.xml", "<w:document><w:p><w:t>[EMAIL-</w:t></w:p><w:p><w:t>1] and [IP-1]</w:t></w:p></w:document>"))
    none = _docx(("word/document.xml", "<w:t>plain</w:t>"))
    rows = [("good", _docx(("word/document.xml", body))), ("odd", odd), ("split", split), ("none", none), ("broken", b"PK\x03\x04 no")]
    d = spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")
    listed = [("[EMAIL-1]", "EMAIL", "a&b@c.it"), ("[IP-1]", "IP", "10.0.0.9")]
    maps = spark.createDataFrame([(p, listed) for p, _ in rows], f"path string, entries array<{placeholders.ENTRY}>")
    made, told = containers.restored_containers(d, maps)
    got = {r.path: (r.replaced, r.repaired, r.remaining, r.unknown, r.complete) for r in told.collect()}
    assert got["good"] == (1, 1, 0, 0, True) and got["odd"] == (0, 1, 0, 1, False) and got["none"][4] is False and not got["broken"][4]
    assert got["split"][2] == 1 and got["split"][4] is False
    with zipfile.ZipFile(io.BytesIO(bytes(made.where("path = 'good'").first().content))) as z:
        assert "a&amp;b@c.it</w:t><w:t> and 10.0.0.9" in z.read("word/document.xml").decode()


def test_the_engine_runs_a_folder(spark, folder, engine, tmp_path):
    store, out, maps = str(tmp_path / "store"), tmp_path / "made", str(tmp_path / "maps")
    told = json.loads(engine.folder(spark, str(folder), private=[store], check=True))
    assert told["check"] and told["totals"]["scanned"] == 8 and all(x["redacted"] is None for x in told["files"])
    assert sorted(os.path.basename(x["file"]) for x in told["files"] if x.get("unscannable")) == ["broken.docx", "pic.png"]
    dry = json.loads(engine.folder(spark, str(folder), out=str(out), private=[store], dry_run=True))
    assert dry["dry_run"] and not out.exists()
    with pytest.raises(ValueError):
        engine.folder(spark, str(folder), out=str(out))
    done = json.loads(engine.folder(spark, str(folder), maps, str(out), [store]))
    assert done["totals"] == dry["totals"] and (out / "sub" / "brackets [1].redacted.txt").exists() and mapstore.read_maps(spark, maps)[0].count() == done["totals"]["changed"]
