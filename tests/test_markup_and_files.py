import io
import zipfile

import pytest
from pyspark.sql import functions as F

from veilum.operators import markup, placeholders
from veilum.sources import containers, files, pdf

VIEWS = {
    '<a><b x="1>2">Hi</b><!-- > --><c>Yo</c></a> z': ("HiYo z", "  Hi   Yo   z"),
    "<p>a<![CDATA[x<b>]]>c</p><": ("ax<b>c<", " a x<b> c <"),
    "a < b and <unfinished": ("a < b and <unfinished", "a < b and <unfinished"),
    "<!DOCTYPE d [<!ENTITY e \"x>y\">]><d>t</d>": ("t", "  t "),
    "<?xml version='1.0'?>x<!-- open": ("x<!-- open", " x<!-- open"),
    "": ("", ""),
}


def test_views_and_walker_agree(spark):
    d = spark.createDataFrame([(x,) for x in VIEWS], "x string")
    for r in d.select("x", markup.visible(F.col("x")).alias("v"), markup.masked_view(F.col("x")).alias("m")).collect():
        assert (r.v, r.m) == VIEWS[r.x]
        assert containers.view_of(r.x) == r.m


def test_large_comment_and_tag(spark):
    long = "<!-- " + "x " * 300_000 + "--><t a='" + "y>" * 300_000 + "'>z"
    assert spark.createDataFrame([(long,)], "x string").select(markup.visible(F.col("x")).alias("v")).first().v == "z"


def test_segments_and_paths(spark):
    xml = "<d><p>ab</p><q>cd<r/><s>ef</s></q></d>"
    row = spark.createDataFrame([(xml,)], "x string").select(markup.segments(F.col("x"), " ").alias("s")).first().s
    texts = [(xml[s.sstart : s.sstart + s.size], "/".join(e.name for e in s.path)) for s in row if s.size]
    assert texts == [("ab", "d/p"), ("cd", "d/q"), ("ef", "d/q/s")]
    walked = [(xml[a:b], "/".join(n for n, _ in path)) for a, b, path in containers.pieces(xml) if b > a]
    assert walked == texts
    assert all(containers.view_of(xml)[s.vstart : s.vstart + s.size] == xml[s.sstart : s.sstart + s.size] for s in row)


def test_runs(spark):
    got = spark.range(1).select(markup.runs(F.expr("array(1,2,3,7,9,10)")).alias("r"), markup.runs(F.expr("cast(array() as array<int>)")).alias("e")).first()
    assert [tuple(x) for x in got.r] == [(1, 3), (7, 7), (9, 10)] and got.e == []


def _zip(parts, compress=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts:
            z.writestr(name, data, compress_type=compress if name != "mimetype" else zipfile.ZIP_STORED)
    return out.getvalue()


def _doc(body):
    return f"<w:document><w:body>{body}</w:body></w:document>"


SPLIT = _zip([
    ("mimetype", "x"),
    ("word/document.xml", _doc("<w:p><w:r><w:t>Mail info@</w:t></w:r><w:r><w:t xml:space='preserve'>acme.it</w:t></w:r></w:p><w:p><w:t>tel +39 333 1234567</w:t></w:p>")),
    ("word/header1.xml", "<w:hdr><w:p><w:t>info@acme.it e IT60X0542811101000000123456 &amp; [EMAIL-1]</w:t></w:p></w:hdr>"),
    ("img.png", b"\x89PNG\x00\x01"),
    ("wide.txt", "host db01.acme.it nel testo".encode("utf-16-le")),
])


def test_container_redaction_and_restore(spark):
    original = spark.createDataFrame([("a.docx", bytearray(SPLIT))], "path string, content binary")
    parts = containers.read_parts(original)
    done = containers.redact_parts(parts).cache()
    assert [r.refused for r in done.select("refused").distinct().collect()] == [None]
    content = containers.packed(done, original).first().content
    with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
        assert [i.filename for i in z.infolist()] == ["mimetype", "word/document.xml", "word/header1.xml", "img.png", "wide.txt"]
        assert z.getinfo("mimetype").compress_type == zipfile.ZIP_STORED
        header, wide = z.read("word/header1.xml").decode(), z.read("wide.txt").decode("utf-16-le")
        body = z.read("word/document.xml").decode()
    assert "acme" not in body + header + wide and "[IBAN-1]" in header and "[HOST-2]" in wide and "info@</w:t>" in body and "[TEL-1]" in body
    entries = done.select("entries").first().entries
    assert {e.original.strip() for e in entries} >= {"+39 333 1234567", "IT60X0542811101000000123456", "db01.acme.it"}
    redone = containers.read_parts(spark.createDataFrame([("a.docx", content)], "path string, content binary"))
    back = containers.restored_parts(redone, done.select("path", "entries").limit(1))
    with zipfile.ZipFile(io.BytesIO(bytes(containers.packed(back, spark.createDataFrame([("a.docx", content)], "path string, content binary")).first().content))) as z:
        assert "db01.acme.it" in z.read("wide.txt").decode("utf-16-le") and "IT60X0542811101000000123456" in z.read("word/header1.xml").decode()


def test_split_placeholder_is_put_together(spark):
    xml = _doc("<w:p><w:r><w:t>[EMAIL-</w:t></w:r><w:r><w:t>1] x</w:t></w:r></w:p><w:p><w:t>[EMAIL-</w:t></w:p><w:p><w:t>1]</w:t></w:p>")
    parts = spark.createDataFrame([("a", 0, "d.xml", "utf-8", xml, xml, None, None)], containers.PARTS)
    maps = spark.createDataFrame([("a", [("[EMAIL-1]", "EMAIL", "a<b@c.it")])], f"path string, entries array<{placeholders.ENTRY}>")
    row = containers.restored_parts(parts, maps).first()
    assert row.repaired == 1 and "a&lt;b@c.it" in row.new_text and row.new_text.count("[EMAIL-") == 1


def test_refused_containers(spark):
    bomb, binary_text = _zip([("a.xml", "0" * 5_000_000)]), _zip([("a.txt", b"\x00\xff\x00\x01\x02" * 10)])
    crossing = _zip([("d.xml", _doc("<w:p><w:t>Via Roma</w:t></w:p><w:p><w:t>12</w:t></w:p>"))])
    rows = [("bomb", bytearray(bomb)), ("nozip", bytearray(b"PK\x03\x04 no")), ("text", bytearray(binary_text))]
    parts = containers.read_parts(spark.createDataFrame(rows, "path string, content binary"))
    refused = {r.path: r.refused for r in parts.collect()}
    assert all(refused.values()) and len(refused) == 3
    crossed = containers.redact_parts(containers.read_parts(spark.createDataFrame([("c", bytearray(crossing))], "path string, content binary")))
    assert "w:p" in crossed.first().refused


def test_decode():
    text = "testo con accenti àèì abbastanza lungo"
    assert containers.decode(text.encode()) == (text, "utf-8")
    for codec in ("utf-16-le", "utf-16-be", "utf-32-le", "utf-32-be"):
        assert containers.decode(text.encode(codec)) == (text, codec)
    assert containers.decode(b"\x00\x01\x02" * 20) == (None, None) and containers.decode(b"\xff\xfea\x00") == ("﻿a", "utf-16-le")


def test_folder_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("mail a@acme.it")
    (tmp_path / "sub" / "b.md").write_bytes(b"bad \xff byte")
    (tmp_path / "c.redacted.txt").write_text("x")
    (tmp_path / "d.zip").write_bytes(SPLIT)
    (tmp_path / "big.txt").write_text("x" * 5000)
    rows = {r.name: r for r in files.scan(spark, str(tmp_path), max_bytes=4000).collect()}
    assert rows["a.txt"].kind == "text" and rows["b.md"].text == "bad � byte"
    assert rows["c.redacted.txt"].skipped == "own output" and rows["big.txt"].skipped == "too large" and rows["d.zip"].kind == "container"


def test_pdf():
    data = pdf.pdf("riga (uno) \\ due\n\n" + "parola " * 40 + "\n" + "x" * 200 + "\n€ 漢")
    assert data == pdf.pdf("riga (uno) \\ due\n\n" + "parola " * 40 + "\n" + "x" * 200 + "\n€ 漢")
    assert data.startswith(b"%PDF-1.4") and data.endswith(b"%%EOF\n") and b"(riga \\(uno\\) \\\\ due) Tj" in data and b"?" in data
    assert all(len(x) <= pdf.COLUMNS for x in pdf.wrapped("x" * 500 + " y"))
    at = int(data.rsplit(b"startxref\n", 1)[1].split()[0])
    assert data[at : at + 4] == b"xref"
    assert pdf.pdf("a\n" * 200).count(b"/Type /Page ") == 4


@pytest.mark.parametrize("sizes, refused", [([("a", 10, 5)], False), ([("a", 65 << 20, 60 << 20)], True), ([("a", 5000, 10)], True), ([("a", 4000, 1)], False)])
def test_guard(sizes, refused):
    assert bool(containers.guard(sizes)) == refused
