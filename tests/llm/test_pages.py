import base64
import hashlib
import html
import os
import random
import re
import time
import tracemalloc

import pyarrow.parquet as pq
import pytest

from veilum.llm import crf, warc
from veilum.llm._store import new_folder
from veilum.llm.blocks import blocks

PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize("page, texts", [
    ("<p>a<p>b <b>c</b>\n d<br>e", ["a", "b c d e"]),
    ("<ul><li>x<li>y<ul><li>z</ul></ul>t", ["x", "y", "z", "t"]),
    ("<table><tr><td>1<td>2<tr><th>3</table>", ["1", "2", "3"]),
    ("<script>if (a<b) '</p>'</script><style>p{}</style><p>&lt;b&gt; &amp;amp; &eacute;&#233;&#x41;</p>", ["<b> &amp; ééA"]),
    ("<!-- <p>no</p> --><title>no</title><body>yes", ["yes"]),
    ("a < b <p title='x>y'>c</p><", ["a < b", "c", "<"]),
    ("<div>one<div>two</div>three</div>", ["one", "two", "three"]),
    ("<p>open <b>bold<p>next", ["open bold", "next"]),
    ("", []), ("   ", []), ("<script>never closed", []),
])
def test_blocks(page, texts):
    assert [b.text for b in blocks(page)] == texts


@pytest.mark.parametrize("page, texts", [
    ("<html><head><title>x</title><p>Article <b>one</b><p>two", ["Article one", "two"]),
    ("<html><head><meta charset=u><link href=a><base href=b><style>p{}</style><script>1</script> <div>a</div>b", ["a", "b"]),
    ("<head><title>x</title>Text <i>at</i> once", ["Text at once"]), ("<head><title>x</title><br>a", ["a"]),
    ("<head><noscript><link href=a></noscript><template><p>no</p></template><title>x</title><h1>a</h1>", ["a"]),
    ("<head><title>x</title></head><body><p>a", ["a"]), ("<head><title>x</title><body><p>a", ["a"]),
])
def test_an_open_head_ends_at_the_first_other_element(page, texts):
    assert [b.text for b in blocks(page)] == texts


def test_blocks_know_their_ancestors():
    found = blocks('<body><div id="Main-Box" class="post x1"><h1>t</h1><a href="#">link</a> text</div></body>')
    assert [(b.path[-1][0], b.link_chars) for b in found] == [("h1", 0), ("div", 4)]
    assert found[0].path[1] == ("div", ("box", "main", "post", "x"))


MB = 1 << 20
HOSTILE = {
    "open tags": "<a " * (MB // 3), "declarations": "<!x " * (MB // 4), "deep": "<div>x" * (MB // 6), "quotes": '<a "' * (MB // 4), "quoted ends": "<a '>'" * (MB // 6),
    "unknown ends": "<div>" * (MB // 10) + "</x>" * (MB // 8), "comments": "<!--" * (MB // 4), "unquoted": '<a b="' * (MB // 6), "names": "".join(f"<div class=a{k}>x" for k in range(MB // 20)),
    "inline": "<div>" + "<b>" * (MB // 6) + "<div></div>" * (MB // 22), "items": "<div><li>x" * (MB // 10),
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_take_linear_time_and_space(name):
    model = crf.trained()
    tracemalloc.start()
    began = time.process_time()
    found = blocks(HOSTILE[name])
    model.decode(found)
    took, peak = time.process_time() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert took < 12 and peak < 200 << 20  # seconds with memory tracing, which takes most of them
    began = time.process_time()
    model.extract(HOSTILE[name])
    assert time.process_time() - began < 4


def test_crf_on_held_out_pages():
    model, wrong, total = crf.trained(), 0, 0
    for found, labels in crf.labelled_pages(200, seed=77):
        guess = model.decode(found)
        wrong += sum(a != b for a, b in zip(guess, labels, strict=True))
        total += len(labels)
    assert wrong <= 0.01 * total and total > 2000


#: Layouts written by hand; the composer was widened until they came out whole.
WRITTEN = [
    ("<body><p>One here. Two sentences, there.</p><p>Three. And another one.</p></body>","One here. Two sentences, there.\nThree. And another one."),
("<article><p>Ok</p></article>","Ok"),
("<main><h2>Steps</h2><ol><li>Mix flour</li><li>Bake it</li></ol></main>","Steps\nMix flour\nBake it"),
("<html><body>Just text here.</body></html>","Just text here."),
("plain text without any markup","plain text without any markup"),
('<body class="home"><div id="page" class="site"><header id="masthead" class="site-header"><h1 class="site-title"><a href="/">My Blog</a></h1><nav id="site-navigation" class="main-navigation"><ul><li><a href="/">Home</a></li><li><a href="/about">About</a></li></ul></nav></header><div id="content" class="site-content"><div id="primary" class="content-area"><main id="main" class="site-main"><article id="post-1" class="post hentry"><header class="entry-header"><h1 class="entry-title">A day at sea</h1></header><div class="entry-content"><p>We left the harbour at dawn.</p><ul><li>Rope</li><li>Bread</li></ul><p>Nothing <a href="/x">happened</a> for hours, and then it did.</p></div></article><div id="comments" class="comments-area"><h2>2 thoughts</h2><ol class="comment-list"><li class="comment"><p>Lovely story, thanks for it.</p></li></ol></div></main></div><aside id="secondary" class="widget-area"><section class="widget"><h2>Recent posts</h2><ul><li><a href="/1">Old post</a></li></ul></section></aside></div><footer id="colophon" class="site-footer"><div class="site-info">Proudly made here</div></footer></div></body>',"A day at sea\nWe left the harbour at dawn.\nRope\nBread\nNothing happened for hours, and then it did."),
('<body><table><tr><td><a href="/">Home</a></td><td><a href="/b">Books</a></td></tr></table><h1>The old page</h1><p>Written by hand in a long gone year.<p>It has two paragraphs.<hr><p>Copyright 1998 the author, all rights reserved.</body>',"The old page\nWritten by hand in a long gone year.\nIt has two paragraphs."),
('<body><div class="wrapper"><div class="topbar"><a href="/login">Log in</a></div><div class="docs-sidebar"><ul><li><a href="#a">Install</a></li><li><a href="#b">Usage</a></li></ul></div><div class="docs-content markdown"><h1>Install</h1><p>Run the following command.</p><pre>make install</pre><h2>Usage</h2><p>Call it with a file.</p><table><tr><th>Flag</th><th>Meaning</th></tr><tr><td>-v</td><td>verbose</td></tr></table></div></div><div class="cookie-banner"><p>We use cookies to improve things.</p><button>OK</button></div></body>',"Install\nRun the following command.\nmake install\nUsage\nCall it with a file.\nFlag\nMeaning\n-v\nverbose"),
('<body><section><h1>News</h1><p>Short item.</p></section><footer><p>Imprint</p></footer></body>',"News\nShort item."),
('<body><nav><a href="/">Start</a></nav><div><div><p>A paragraph in plain divisions, with no name at all.</p><p>And a second one.</p></div></div></body>',"A paragraph in plain divisions, with no name at all.\nAnd a second one."),
('<article><h1>T</h1><p>Body text of it.</p><div class="advertisement">Buy a car today!</div><p>More of the text.</p><form action="/s"><label>Subscribe</label><button>Go</button></form></article>',"T\nBody text of it.\nMore of the text."),
('<body><div class="container"><div class="row"><div class="col-md-8"><h1>Headline of the day</h1><p class="lead">A lead paragraph says what happened.</p><p>Details follow, at some length, with numbers and names.</p></div><div class="col-md-4 sidebar"><h3>Related</h3><p>Another story that you may like.</p></div></div></div></body>',"Headline of the day\nA lead paragraph says what happened.\nDetails follow, at some length, with numbers and names."),
('<body><p>Hi</p></body>',"Hi"),('<body><ul><li>milk</li><li>eggs</li></ul></body>',"milk\neggs"),
('<body><h1>Only a title</h1></body>',"Only a title"),
('<body><dl><dt>Term</dt><dd>Its meaning.</dd></dl></body>',"Term\nIts meaning."),
('<body><article><table><tr><td>Name</td><td>Size</td></tr><tr><td>a</td><td>1</td></tr></table></article></body>',"Name\nSize\na\n1"),
('<body><header><h1>Site</h1></header><main><p>Yes.</p></main><footer>Bye</footer></body>',"Yes."),
]


@pytest.mark.parametrize("page, text", WRITTEN)
def test_written_pages(page, text):
    assert crf.trained().extract(page) == text


#: Written after the composer was done, and not used to change it.
FRESH = [
    ('<body><div id="header"><img src=a><div id="logo">The Daily Crow</div></div><div id="menu"><a href=1>News</a><a href=2>Sport</a></div><div id="story"><h2>Crows learn to count</h2><p class="byline">By a reporter</p><p>Scientists have shown that crows can count to four.</p><p>The birds were trained with treats.</p></div><div id="footer">The Daily Crow 2011</div></body>',"Crows learn to count\nBy a reporter\nScientists have shown that crows can count to four.\nThe birds were trained with treats."),
    ('<html><body><main><article><h1>Soup</h1><h2>Ingredients</h2><ul><li>1 onion</li><li>2 carrots</li></ul><h2>Method</h2><ol><li>Chop everything.</li><li>Boil for an hour.</li></ol></article></main><aside><h2>More recipes</h2><ul><li><a href=x>Bread</a></li></ul></aside><footer><p>Contact us</p></footer></body></html>',"Soup\nIngredients\n1 onion\n2 carrots\nMethod\nChop everything.\nBoil for an hour."),
    ('<body><div class="question"><h1>How do I reverse a list?</h1><p>I have a list and want it backwards.</p><pre>x = [1, 2]</pre></div><div class="answers"><h2>2 Answers</h2><div class="answer"><p>Use reversed.</p></div></div></body>',"How do I reverse a list?\nI have a list and want it backwards.\nx = [1, 2]"),
    ('<body><center><font size=6>Welcome to my page</font></center><p>This page is about trains.<p>I like them.<p><a href=a.html>Back</a></body>',"Welcome to my page\nThis page is about trains.\nI like them."),
    ('<body><nav class="breadcrumb"><a href=/>Home</a> &gt; <a href=/g>Guides</a></nav><section class="main-section"><h1>Guide to knots</h1><p>A knot holds a rope.</p><blockquote>Tie it twice.</blockquote><table><tr><td>Bowline</td><td>loop</td></tr></table></section><div class="newsletter-signup"><p>Get our newsletter every week.</p><form><input><button>Subscribe</button></form></div></body>',"Guide to knots\nA knot holds a rope.\nTie it twice.\nBowline\nloop"),
    ('<body><div><h1>Title</h1><div>First paragraph in a division, long enough to be one.</div><div>Second paragraph in a division.</div></div></body>',"Title\nFirst paragraph in a division, long enough to be one.\nSecond paragraph in a division."),
    ('<body><header role="banner"><a href="/">Site</a></header><div role="main"><h1>Notice of change</h1><p>The office moves on Monday.</p></div><div role="contentinfo">Privacy | Terms</div></body>',"Notice of change\nThe office moves on Monday."),
    ('<body><article><header><h1>T</h1><time>1 May</time></header><p>Body.</p><footer>Filed under: cats</footer></article><div id="disqus_thread"><p>Nice post!</p></div></body>',"T\n1 May\nBody."),
    ('<body><div class="modal">Please accept our cookies</div><div class="wiki"><h1>Lemur</h1><p>A lemur is a <a href=p>primate</a> of <a href=m>Madagascar</a>.</p><h2>Habitat</h2><p>Forests.</p><ul><li><a href=a>Ring-tailed lemur</a> lives in the south</li></ul></div></body>',"Lemur\nA lemur is a primate of Madagascar.\nHabitat\nForests.\nRing-tailed lemur lives in the south"),
    ('<body><h1>Minutes</h1><p>Present: A, B.</p><h2>Item 1</h2><p>Agreed.</p><hr><address>Written by C</address></body>',"Minutes\nPresent: A, B.\nItem 1\nAgreed."),
]


def test_fresh_pages():
    texts = [(crf.trained().extract(page).split("\n"), text.split("\n")) for page, text in FRESH]
    assert sum(got == want for got, want in texts) >= 7 and sum(len(set(got) ^ set(want)) for got, want in texts) <= 4


def test_pages_of_the_tables_come_out_as_their_article():
    """Brute force: in these tables an article element holds the text, in headings and paragraphs without elements to leave out."""
    path = "/root/testdata/sf0.01/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    for page in (r["html"] or "" for r in pq.read_table(path).to_pylist()):
        inner = re.search(r"<article>(.*)</article>", page, re.S)
        assert inner and not re.search(r"<(?!/?(?:h1|p|b|br|i)\b)[a-z]", inner[1])
        lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if part.startswith("<br") else "", re.sub(r"<br>", " ", part))).split()) for part in re.split(r"</?(?:h1|p)>", inner[1])]
        assert crf.trained().extract(page) == "\n".join(x for x in lines if x)


def test_viterbi_is_the_best_path():
    model, rng = crf.trained(), random.Random(1)
    for found, _ in crf.labelled_pages(60, seed=5):
        found = found[: rng.randint(1, 9)]
        if not found:
            continue
        scores = [model.scores(b, i, len(found), crf.page_kind(found)) for i, b in enumerate(found)]

        def worth(path, scores=scores):
            return model.start[path[0]] + sum(s[p] for s, p in zip(scores, path, strict=True)) + sum(model.moves[a][b] for a, b in zip(path, path[1:], strict=False))

        best = max(range(1 << len(found)), key=lambda k: worth([k >> i & 1 for i in range(len(found))]))
        guess = [int(x) for x in model.decode(found)]
        assert worth(guess) == pytest.approx(worth([best >> i & 1 for i in range(len(found))]))


def test_main_texts(spark):
    page = "<html><body><nav><ul><li><a href='/'>Home</a></ul></nav><div class='ad'>Buy now this thing.</div><article><h1>Title &amp; more</h1><p>First  paragraph,\nwith words. And a second sentence.<p>Second one has words, too.</article><section class='comments'><p>I liked it.</p></section><footer>&copy; us</footer>"
    rows = [(1, "u", page), (2, None, None), (3, "v", ""), (1, "u", page), (None, "w", page)]
    got = crf.op5(spark.createDataFrame([(*r, 1) for r in rows], PAGES + ", text int")).collect()
    text = "Title & more\nFirst paragraph, with words. And a second sentence.\nSecond one has words, too."
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, text, len(text)), (1, text, len(text)), (1, text, len(text)), (2, "", 0), (3, "", 0)]
    assert crf.op5(spark.createDataFrame([], PAGES)).collect() == []


def _digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_warc_round_trip(spark):
    rng = random.Random(3)
    rows = [(i, f"http://h/{i}?a=\r\nX: y", rng.choice(["<p>same</p>", "ü" * i, f"\r\n\r\nWARC/1.1 {i}", "x" * 50_000 + str(i % 3)])) for i in range(80)]
    rows += [(90, None, None), (91, "u", ""), (92, "u", "<p>same</p>"), (None, "n", "<p>same</p>"), (92, "u", "<p>same</p>")]
    d = spark.createDataFrame([(*r, 1) for r in rows], PAGES + ", digest int").repartition(3)
    folder = new_folder(spark, "warc")
    index = warc.write_archives(d, folder)
    got = warc.read_records(index, folder).collect()
    first = {}
    for i, _, h in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(h or "", i)
    assert len(got) == len(rows)
    bodies = {i: h or "" for i, _, h in rows}
    for r in got:
        body = bodies[r.page_id]
        assert r.payload_bytes == len(body.encode()) and r.payload_digest == _digest(body)
        leads = r.page_id is None or first[body] == r.page_id
        assert (r.record_type, r.refers_to) == (("response", None) if leads else ("revisit", first[body]))
        assert r.payload == (bytearray(body.encode()) if leads else None)
    some = warc.read_records(index.where("page_id in (5, 70)"), folder)
    assert sorted(r.page_id for r in some.collect()) == [5, 70]
    assert warc.read_records(index.limit(0), folder).collect() == []


def test_warc_small_payloads_are_not_revisits(spark):
    d = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "yy"), (4, "d", "yy")], PAGES)
    folder = new_folder(spark, "warc")
    rows = warc.read_records(warc.write_archives(d, folder, min_revisit_bytes=2), folder).collect()
    assert {r.page_id: r.refers_to for r in rows} == {1: None, 2: None, 3: None, 4: 3}
    assert warc.op9(spark.createDataFrame([], PAGES)).collect() == []


def test_damaged_records_are_refused():
    raw = warc.record(1, "u", b"payload", _digest("payload"), None)
    assert warc.parse(raw)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"payload\r\n\r\n", b"paXload\r\n\r\n"))
    with pytest.raises(ValueError):
        warc.parse(raw[:-6])
