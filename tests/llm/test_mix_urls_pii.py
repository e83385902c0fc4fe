import datetime
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from veilum.llm import mix, pii, urls

DOCS = "doc_id long, text string, source string"


def _docs(seed=1, n=400):
    rng = random.Random(seed)
    source = lambda: rng.choice(["a"] * 6 + ["b", "c", "é", "", None])
    rows = [(i, rng.choice([None, "", " \t", "w " * rng.randint(1, 60), "long " * rng.randint(100, 400)]), source()) for i in range(n)]
    return rows + [rows[3], rows[3]]


def _targets(rows):
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(re.findall(mix.WORD, t or ""))
    order = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in size)
    weight = {s: mix.WEIGHTS[k % 3] for k, s in enumerate(order)}
    goal, capped = mix.SHARE * sum(size.values()), set()
    while True:  # reshare the excess until no target is above its cap
        level = (goal - sum(2 * size[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and level * weight[s] >= 2 * size[s]}
        if not over:
            return size, {s: 2 * size[s] if s in capped else level * weight[s] for s in order}
        capped |= over


def test_mix_targets_and_draws(spark):
    rows = _docs()
    size, target = _targets(rows)
    d = spark.createDataFrame(rows, DOCS).repartition(7)
    got = mix.op1(d).withColumn("source_", F.lit(1)).collect()
    again = mix.op1(d.repartition(2)).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(tuple(r) for r in again)
    by_id = {i: (t, s) for i, t, s in rows}
    taken = dict.fromkeys(size, 0)
    assert len(got) == len(rows)
    for r in got:
        text, source = by_id[r.doc_id]
        assert r.size == len(re.findall(mix.WORD, text or "")) and r.source_size == size[source]
        assert r.target == pytest.approx(target[source]) and 0 <= r.taken <= 2 * r.size
        taken[source] += r.taken
    for s in size:
        assert abs(taken[s] - target[s]) <= 400


def test_mix_emits_copies_and_keeps_columns(spark):
    rows = [(i, "a b " * (i + 1), "s") for i in range(10)]
    d = spark.createDataFrame([(*r, "x", 5) for r in rows], DOCS + ", copies string, size int")
    out = mix.mix(d)
    assert out.columns == ["doc_id", "text", "source", "copies", "size", "copy"]
    counted = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    drawn = {r.doc_id: r.copies for r in mix.copies(d).collect() if r.copies}
    assert counted == drawn


def test_mix_draws_each_row_for_itself(spark):
    rows = [(7, "one two three four five six seven eight nine ten", "s")] * 200 + [(8, "a " * 7, "s"), (None, "x y", None), (None, "x y z", None), (None, "x y", None), (None, None, None), (7, "other text of it", "s")]
    d = spark.createDataFrame([(*r, 3, "t") for r in rows], DOCS + ", copy int, target string").repartition(5)
    out = mix.mix(d)
    assert out.columns == [*d.columns[:3], "target", "copy"] or out.columns == d.columns
    emitted = {r.source: r.n for r in out.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(mix.WORD))).alias("n")).collect()}
    taken = {r.source: r.n for r in mix.copies(d).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("n")).collect()}
    assert emitted == taken and abs(emitted["s"] - mix.copies(d).where("source = 's'").first().target) <= 10
    assert mix.mix(d.limit(0)).collect() == []


def test_mix_empty(spark):
    assert mix.op1(spark.createDataFrame([], DOCS)).collect() == []
    only_null = mix.op1(spark.createDataFrame([(1, None, None)], DOCS)).collect()
    assert [tuple(r) for r in only_null] == [(1, 0, 0, 0.0, 0)]


URLS = [
    None, "", "no scheme", "://", "http://", "http://A.example.COM/x", "http://www.example.com/en/1", "http://example.com/en", "http://b.example.com/en/?q", "x://t.net/es/",
    "x://t.net?/es/", "x://net/fr/#", "http://spam-farm.example.org/a", "http://www.SPAM-farm.example.org?x", "http://notspam-farm.example.org/", "http://u@spam-farm.example.org/", "a://b://c/d", "http://com/", "http://xcom/",
    "http://x.com", "http://é.com/ß?ü",
]


def _judge(url, rules=urls.RULES, listed=urls.LISTED):
    host = path = ""
    if url and "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
        host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            return host, path, rule, verdict
    return host, path, None, "block" if any(host == h or host.endswith("." + h) for h in listed) else "allow"


def test_urls(spark):
    d = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(0, None, "y")], "page_id long, url string, host string")
    got = urls.judge(d).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == _judge(URLS[r.page_id]), URLS[r.page_id]
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_cascade_is_exact_for_many_keys(spark):
    rng = random.Random(4)
    keys = [f"h{rng.randrange(10**9)}.example" for _ in range(30_000)]
    listed, universe = spark.createDataFrame([(k,) for k in keys[:6_000] + [None]], "key string"), spark.createDataFrame([(k,) for k in keys[1_000:] + [None]], "key string")
    levels = urls.build_cascade(listed, universe)
    assert len(levels) > 2 and sum(len(x.bitmap) for x in levels) < 40_000
    wanted = set(keys[:6_000])
    rows = universe.where("key is not null").select("key", urls.in_cascade(F.col("key"), levels).alias("hit")).collect()
    assert all(r.hit == (r.key in wanted) for r in rows)
    assert urls.build_cascade(listed.limit(0), universe) == []
    with pytest.raises(urls.TooLargeError):
        urls.build_cascade(listed, universe, limit=100)


def test_lists_beyond_the_filter_give_the_same_verdicts(spark):
    d = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(99, "http://x.spam-farm.example.org/" + "long/" * 20_000)], "page_id long, url string")
    rows = {r.page_id: r for r in urls.judge(d, limit=10).collect()}
    assert len(rows) == len(URLS) + 1 and all((r.host, r.path, r.rule, r.verdict) == _judge(URLS[i]) for i, r in rows.items() if i < 99)
    assert rows[99].verdict == "block" and urls.judge(d).where("page_id = 99").first().verdict == "block"


def test_url_plan_has_no_join(spark):
    d = spark.createDataFrame([(1, "http://a.example.com/")], "page_id long, url string")
    plan = urls.judge(d)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan


def _feistel(a, b, u, v, kind, key=pii.KEY):
    for i in range(pii.ROUNDS):
        draw = lambda half: int(hashlib.sha256(f"{key}|{kind}|{i}|{half}".encode()).hexdigest()[:15], 16)  # noqa: B023, E731
        if i % 2 == 0:
            a = (a + draw(b) % u) % u
        else:
            b = (b + draw(a) % v) % v
    return a, b


def _digits(d, kind):
    n, left = len(d), -(-len(d) // 2)
    a, b = _feistel(int(d[:left]), int(d[left:]), 10**left, 10 ** (n - left), kind)
    return f"{a:0{left}d}{b:0{n - left}d}"


def _luhn(d):
    total = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1]))
    return total % 10 == 0


PRIVATE = [
    (1, "card 4111 1111 1111 1111 and 4111-1111-1111-1112"), (2, "card 4111 1111 1111 1111, again"), (3, "rhokk.73@mail2.example.com"), (4, "82.43.185.109. 300.1.1.1 1.2.3"),
    (5, "+1 (784) 555-9263"), (6, "IT60X0542811101000000123456 DE89 3704 0044 0532 0130 00"), (7, "2024-02-29 2024-02-30 31/12/1999 12/25/1984 01.02.2003 1799-01-01"), (8, "123-45-6789 000-12-3456"),
    (9, 'token = "8824c3a463b8b0d68516db48c461547d5799bf8b" password=36fdea71d793cf922e'), (10, None), (11, ""), (12, "plain words 12 345"), (13, "x" * 200_000 + " a@b.it"), (14, "é 4012888888881881 ü"),
]


def test_pseudonyms(spark):
    d = spark.createDataFrame([(*r, "k") for r in PRIVATE + PRIVATE[:1]], "doc_id long, text string, kinds string")
    out = pii.pseudonymize(d)
    rows = {r.doc_id: r for r in out.collect()}
    assert out.columns == ["doc_id", "text", "kinds", "private_kinds"] and out.count() == len(PRIVATE) + 1
    kinds = {i: rows[i].private_kinds for i, _ in PRIVATE}
    assert kinds == {1: ["CARD"], 2: ["CARD"], 3: ["EMAIL"], 4: ["IP"], 5: ["PHONE"], 6: ["IBAN", "IBAN"], 7: ["DATE"] * 4, 8: ["SSN"], 9: ["SECRET"] * 2, 10: [], 11: [], 12: [], 13: ["EMAIL"], 14: ["CARD"]}
    card = re.search("[0-9]{4}( [0-9]{4}){3}", rows[1].text)[0]
    assert card in rows[2].text and card.replace(" ", "")[:-1] == _digits("411111111111111", "CARD") and _luhn(card.replace(" ", ""))
    assert "4111-1111-1111-1112" in rows[1].text and "2024-02-30" in rows[7].text and "000-12-3456" in rows[8].text
    a, b = _feistel(82 * 256 + 43, 185 * 256 + 109, 65536, 65536, "IP")
    assert rows[4].text.startswith(f"{a // 256}.{a % 256}.{b // 256}.{b % 256}.")
    assert re.fullmatch(r"[a-z]{5}\.[0-9]{2}@mail2\.example\.com", rows[3].text) and re.fullmatch(r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", rows[5].text)
    for iban in (rows[6].text[:27], rows[6].text[28:].replace(" ", "")):
        assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    for (i, t) in PRIVATE:
        assert t is None or i == 4 or len(rows[i].text) == len(t)  # octets have one to three digits
    back = {r.doc_id: r.text for r in pii.pseudonymize(out.drop("private_kinds"), direction=-1).collect()}
    assert all(back[i] == t for i, t in PRIVATE)
    other = {r.doc_id: r.text for r in pii.pseudonymize(d, key="other").collect()}
    assert other[1] != rows[1].text


def _text_permuted(value, kind, key=pii.KEY):
    hexed = re.fullmatch("[0-9a-f]{8,}", value) is not None

    def turned(part, other, i):
        out = []
        sha = lambda *of: hashlib.sha256("|".join(map(str, (key, kind, *of))).encode()).hexdigest()
        stream = [sha(n, i, other) for n in range(2)]
        stream += [sha(n, *stream[:2]) for n in range(2, -(-len(part) // 32))]
        for k, c in enumerate(part):
            digest = stream[k // 32]
            amount = int(digest[k % 32 * 2 : k % 32 * 2 + 2], 16)
            letters = next((x for x in ([pii.HEX] if hexed else [pii.DIGITS, pii.LOWER, pii.UPPER]) if c in x), None)
            out.append(letters[(letters.index(c) + amount) % len(letters)] if letters else c)
        return "".join(out)

    left = -(-len(value) // 2)
    a, b = value[:left], value[left:]
    for i in range(pii.ROUNDS):
        a, b = (turned(a, b, i), b) if i % 2 == 0 else (a, turned(b, a, i))
    return a + b


def _refilled(value, digits):
    digits = iter(digits)
    return "".join(next(digits) if c in pii.DIGITS else c for c in value)


def _plain_pseudonym(kind, m):
    """The pseudonym of one value, computed without Spark."""
    digits = re.sub("[^0-9]", "", m)
    if kind == "EMAIL":
        name, _, host = m.partition("@")
        return _text_permuted(name, kind) + "@" + host
    if kind == "SECRET":
        head, value = re.fullmatch(f"({pii.SECRET_HEAD.replace('(?i:', '(?i:')})({pii.SECRET_VALUE})", m).groups()
        return head + _text_permuted(value, kind)
    if kind == "IBAN":
        plain = m.replace(" ", "")
        body = _refilled(plain[4:], _digits(re.sub("[^0-9]", "", plain[4:]), kind))
        check = 98 - int("".join(str(int(c, 36)) for c in body + plain[:2] + "00")) % 97
        return _refilled(m, f"{check:02d}" + re.sub("[^0-9]", "", body))
    if kind == "IP":
        p = [int(x) for x in m.split(".")]
        a, b = _feistel(p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536, kind)
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    if kind == "DATE":
        first, sep = datetime.date(1800, 1, 1), re.search("[^0-9]", m)[0]
        move = lambda n: (lambda s: s[0] * pii.DAY_V + s[1])(_feistel(n // pii.DAY_V, n % pii.DAY_V, pii.DAY_U, pii.DAY_V, kind))
        parts = [int(x) for x in re.split("[^0-9]", m)]
        if len(m.split(sep)[0]) == 4:
            new = first + datetime.timedelta(move((datetime.date(*parts) - first).days))
            return new.strftime(f"%Y{sep}%m{sep}%d")
        if parts[1] <= 12:
            new = first + datetime.timedelta(move((datetime.date(parts[2], parts[1], parts[0]) - first).days))
            return new.strftime(f"%d{sep}%m{sep}%Y")
        n = move((datetime.date(parts[2], parts[0], parts[1]) - first).days)
        while (first + datetime.timedelta(n)).day <= 12:
            n = move(n)
        return (first + datetime.timedelta(n)).strftime(f"%m{sep}%d{sep}%Y")
    if kind == "SSN":
        while True:
            digits = _digits(digits, kind)
            new = f"{digits[:3]}-{digits[3:5]}-{digits[5:]}"
            if not re.search("^(000|666|9)|^...-00|0000$", new):
                return new
    if kind == "PHONE":
        head = (re.match(r"\+[0-9]{1,3}(?=[ .(\-])", m) or [""])[0]
        rest = m[len(head) :]
        return head + _refilled(rest, _digits(re.sub("[^0-9]", "", rest), kind))
    body = _digits(digits[:-1], kind)
    return _refilled(m, body + next(c for c in pii.DIGITS if _luhn(body + c)))


VALUES = [
    ("EMAIL", "rhokk.73@mail2.example.com"), ("EMAIL", "A_b+c@x.org"), ("SECRET", "password=36fdea71d793cf922e"), ("SECRET", "token: Abc_def-123"), ("SECRET", "secret=" + "aZ9" * 60), ("IBAN", "IT60X0542811101000000123456"),
    ("IBAN", "DE89 3704 0044 0532 0130 00"), ("IP", "82.43.185.109"), ("IP", "10.0.0.1"), ("DATE", "2024-02-29"), ("DATE", "1999/12/31"), ("DATE", "01.02.2003"), ("DATE", "12/25/1984"), ("DATE", "07-30-2001"),
    ("CARD", "4111 1111 1111 1111"), ("CARD", "4012888888881881"), ("CARD", "3782-822463-10005"), ("SSN", "123-45-6789"), ("SSN", "321-10-0001"), ("PHONE", "+1 (784) 555-9263"), ("PHONE", "+39 333 1234567"), ("PHONE", "020-7946-0958"),
]


def test_every_kind_against_a_plain_version(spark):
    d = spark.createDataFrame([(k, f"see {m} there") for k, (_, m) in enumerate(VALUES)], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.pseudonymize(d).collect()}
    for k, (kind, m) in enumerate(VALUES):
        assert rows[k].private_kinds == [kind], m
        assert rows[k].text == f"see {_plain_pseudonym(kind, m)} there", m


def test_a_clashing_column_is_replaced_and_long_secrets_go_whole(spark):
    value = "correcthorsebattery" * 5300
    d = spark.createDataFrame([(1, f"password={value} end", "mine"), (1, None, None), (None, "token=" + "q" * 900, "x")], "doc_id long, text string, private_kinds string")
    out = pii.pseudonymize(d)
    rows = out.collect()
    assert out.columns == ["doc_id", "text", "private_kinds"] and [r.private_kinds for r in rows] == [["SECRET"], [], ["SECRET"]]
    assert rows[0].text == f"password={_text_permuted(value, 'SECRET')} end" and rows[2].text == "token=" + _text_permuted("q" * 900, "SECRET")


def test_permutations_are_one_to_one(spark):
    d = spark.createDataFrame([(f"2001-{m:02d}-{k:02d}",) for m in range(1, 13) for k in range(1, 29)], "text string")
    dates = [r.text for r in pii.pseudonymize(d).collect()]
    assert len(set(dates)) == 336 and all("1800" <= x[:4] <= "2199" for x in dates)
    ssns = [r.text for r in pii.pseudonymize(spark.createDataFrame([(f"{100 + i}-45-6789",) for i in range(200)], "text string")).collect()]
    assert len(set(ssns)) == 200 and not any(re.match("000|666|9", s) for s in ssns)


def test_pii_is_native_and_handles_an_empty_table(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert pii.op3(d).collect() == [] and "Python" not in pii.op3(d)._jdf.queryExecution().executedPlan().toString()


def test_secrets_of_letters_in_texts_without_digits(spark):
    d = spark.createDataFrame([(1, "password: correcthorsebattery"), (2, "token=correcthorsebattery, room 12"), (3, "plain: words = here")], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.pseudonymize(d).collect()}
    new = re.fullmatch("password: ([a-z]{19})", rows[1].text)[1]
    assert new != "correcthorsebattery" and rows[2].text == f"token={new}, room 12" and rows[3].text == "plain: words = here"
    assert [rows[i].private_kinds for i in (1, 2, 3)] == [["SECRET"], ["SECRET"], []]


OVERRUN = [
    (1, "4111 1111 1111 1111 12/27", ["CARD"]), (2, "4111-1111-1111-1111 123", ["CARD"]), (3, "4111 1111 1111 1111 2026 and 4111 1111 1111 1111", ["CARD"] * 2), (4, "BE68539007547034 EUR", ["IBAN"]),
    (5, "BE68 5390 0754 7034 2026 EUR", ["IBAN"]), (6, "ES9121000418450200051332 OK", ["IBAN"]), (7, "é 4111 1111 1111 1111 4012 8888 8888 1881 12/27/2026 x", ["CARD", "CARD", "DATE"]),
    (8, "4111 1111 1111 1111 123-45-6789 x", ["CARD", "SSN"]), (9, "AB12 BE68 5390 0754 7034 PWD: abcdefghij", ["IBAN", "SECRET"]), (10, "4111-1111-1111-1112 12 x", []),
    (11, "4111 1111 1111 1111 " * 700, ["CARD"] * 700),
]


def test_cards_and_ibans_before_short_words(spark):
    d = spark.createDataFrame([r[:2] for r in OVERRUN], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.pseudonymize(d).collect()}
    assert {i: rows[i].private_kinds for i, _, _ in OVERRUN} == {i: k for i, _, k in OVERRUN}
    card = rows[3].text[-19:]
    assert card != "4111 1111 1111 1111" and rows[1].text == f"{card} 12/27" and rows[2].text == card.replace(" ", "-") + " 123" and rows[3].text == f"{card} 2026 and {card}"
    assert rows[7].text.startswith(f"é {card} ") and rows[7].text.endswith(" x") and rows[11].text == f"{card} " * 700 and rows[10].text == OVERRUN[9][1]
    iban = rows[4].text[:16]
    assert iban != "BE68539007547034" and rows[4].text == f"{iban} EUR" and rows[5].text.replace(" ", "") == f"{iban}2026EUR" and rows[6].text.endswith(" OK")
    assert all(len(rows[i].text) == len(t) for i, t, _ in OVERRUN)


def test_secrets_are_taken_to_their_end(spark):
    rng = random.Random(6)
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(1200))
    jwt = f"eyJhbGciOiJIUzI1NiJ9.{long[:90]}.{long[90:133]}"
    values = [long, jwt, "QUJD+RA/x==", "z" * 1200, long * 10, "correct.horse=battery"]
    texts = [f"x token={v}. Then" for v in values] + [f'secret: "{jwt}", y']
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = pii.pseudonymize(d)
    rows = [r for r in out.orderBy("doc_id").collect()]
    news = [r.text[8:-6] for r in rows[:-1]]
    for old, new, r in zip(values, news, rows, strict=False):
        assert r.private_kinds == ["SECRET"] and r.text == f"x token={new}. Then" and len(old) == len(new)
        assert all(a.isupper() == b.isupper() and a.islower() == b.islower() and a.isdigit() == b.isdigit() and (a.isalnum() or a == b) for a, b in zip(old, new, strict=True))
        for i in range(0, len(old) - 20, 20):  # no piece is left, up to the end
            assert old[i : i + 20] == "." * 20 or old[i : i + 20] != new[i : i + 20]
        assert old[-8:] != new[-8:]
    assert rows[-1].text == f'secret: "{news[1]}", y' and len({news[3][i : i + 64] for i in range(0, 600, 64)}) == 10
    assert [r.text for r in pii.pseudonymize(out.drop("private_kinds"), direction=-1).orderBy("doc_id").collect()] == texts
