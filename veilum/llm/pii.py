"""Format-preserving pseudonyms for personal data, in Spark expressions only.

One pattern finds candidates from left to right; a candidate is replaced only if its kind's check holds (Luhn digit, IBAN
remainder, octets, calendar date, number of digits). A card or IBAN that fails is tried without its last words, longest first,
and the text behind what was replaced is read again; inside a candidate that fails altogether, phones alone are not looked
for. Numbers and dates go through an alternating Feistel network over
Z_u x Z_v whose rounds add a keyed hash of one half to the other, so each kind's values are permuted among themselves: the
format stays, check digits stay right, and equal values get equal pseudonyms in every document. E-mail names and assigned
secrets go through the same network over character classes. The key turns the pseudonyms back (``direction=-1``).

A text without ASCII digits, @, : and = holds none of these and is passed on unread.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilum.functions.offsets import kept_in_order, running

KEY = "veilum-demo-key"
ROUNDS = 10
MAX_WALK = 64
#: A full cycle of the calendar: 400 years from 1800 on have 146097 = 773 * 189 days.
FIRST_DAY, DAY_U, DAY_V = "1800-01-01", 773, 189

_LEFT, _RIGHT = r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"
SECRET_HEAD = _LEFT + r"(?i:password|passwd|pwd|token|secret|api[_\-]?key|access[_\-]?key)[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?"
#: Of any length; full stops at the end belong to the sentence.
SECRET_VALUE = r"[A-Za-z0-9_+/\-][A-Za-z0-9._+/=\-]{6,}[A-Za-z0-9_+/=\-]"
#: Candidates in order of precedence at one place (fixed patterns).
PATTERNS = {
    "EMAIL": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "SECRET": SECRET_HEAD + SECRET_VALUE,
    "IBAN": _LEFT + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _RIGHT,
    "IP": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])",
    "DATE": _LEFT + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}-[0-9]{2}-[0-9]{4})" + _RIGHT,
    "CARD": _LEFT + r"(?:[0-9]{13,19}|[0-9]{4}(?:[ \-][0-9]{4}){2,3}(?:[ \-][0-9]{1,4})?|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{4,5})" + _RIGHT,
    "SSN": _LEFT + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _RIGHT,
    "PHONE": r"(?<![A-Za-z0-9+])(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{2,4}\)[ .\-]?|[0-9]{2,4}[ .\-])[0-9]{3,4}[ .\-][0-9]{3,4}" + _RIGHT + r"|(?<![A-Za-z0-9+])\+[0-9]{1,3}(?:[ .\-]?[0-9]{2,4}){2,5}" + _RIGHT,
}
KINDS = tuple(PATTERNS)
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Group 1 is the candidate at each place where one starts, also inside another one; only secrets are passed over whole.
START = rf"(?=({ANY}))(?:{PATTERNS['SECRET']}|.)"
LOWER, UPPER, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _draw(key: str, kind: str, step: Column, half: Column) -> Column:
    """60 keyed bits."""
    hashed = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), step.cast("string"), half.cast("string")), 256)
    return F.conv(F.substring(hashed, 1, 15), 16, 10).cast("long")


def _steps(direction: int) -> Column:
    steps = range(ROUNDS) if direction > 0 else range(ROUNDS - 1, -1, -1)
    return F.array(*[F.lit(i) for i in steps])


def feistel(a: Column, b: Column, u: Column, v: Column, kind: str, key: str, direction: int) -> Column:
    """struct(a, b): a keyed permutation of Z_u x Z_v, u and v up to 10^15."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def step(s, i):
        even = F.pmod(s["a"] + direction * (_draw(key, kind, i, s["b"]) % u), u)
        odd = F.pmod(s["b"] + direction * (_draw(key, kind, i, s["a"]) % v), v)
        return F.struct(F.when(i % 2 == 0, even).otherwise(s["a"]).alias("a"), F.when(i % 2 == 1, odd).otherwise(s["b"]).alias("b"))

    return F.aggregate(_steps(direction), start, step)


def permute_digits(digits: Column, kind: str, key: str, direction: int) -> Column:
    """2 to 30 digits -> as many digits."""

    def halves(d):
        n = F.length(d)
        left = F.ceil(n / 2).cast("int")
        u, v = F.pow(F.lit(10.0), left).cast("long"), F.pow(F.lit(10.0), n - left).cast("long")
        out = feistel(F.substring(d, F.lit(1), left), F.substring(d, left + 1, n), u, v, kind, key, direction)
        return let(out, lambda s: F.concat(F.lpad(s["a"].cast("string"), left, "0"), F.lpad(s["b"].cast("string"), n - left, "0")))

    return let(digits, halves)


def permute_text(value: Column, kind: str, key: str, direction: int) -> Column:
    """Letters stay letters of their case, digits digits; values of lower-case hex digits stay so; the rest stays."""
    alphabets = (DIGITS, LOWER, UPPER)

    def turned(part, other, i, hexed):
        hashed = lambda n, *of: F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), n.cast("string"), *of), 256)
        first = F.array(*[hashed(F.lit(n), i.cast("string"), other) for n in range(2)])
        more = lambda s: F.transform(F.sequence(F.lit(2), F.ceil(F.length(part) / 32).cast("int") - 1), lambda n: hashed(n, s[0], s[1]))

        def one(stream):  # a hash gives the amounts of 32 characters
            def char(c, at):
                amount = F.conv(F.substring(F.get(stream, F.floor(at / 32).cast("int")), (at % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
                out = None
                for letters, wanted in ((HEX, hexed), *((x, ~hexed) for x in alphabets)):
                    place = F.call_function("locate", c, F.lit(letters))
                    new = F.substring(F.lit(letters), F.pmod(place - 1 + direction * amount, F.lit(len(letters))) + 1, F.lit(1))
                    test = wanted & (place > 0)
                    out = F.when(test, new) if out is None else out.when(test, new)
                return out.otherwise(c)

            return F.array_join(F.transform(F.split(part, ""), char), "")

        return F.when(F.length(part) == 0, part).otherwise(let(let(first, lambda s: F.when(F.length(part) > 64, F.concat(s, more(s))).otherwise(s)), one))

    def halves(v):
        n = F.length(v)
        left = F.ceil(n / 2).cast("int")
        hexed = v.rlike("^[0-9a-f]{8,}$")
        start = F.struct(F.substring(v, F.lit(1), left).alias("a"), F.substring(v, left + 1, n).alias("b"))

        def step(s, i):
            return F.struct(
                F.when(i % 2 == 0, turned(s["a"], s["b"], i, hexed)).otherwise(s["a"]).alias("a"),
                F.when(i % 2 == 1, turned(s["b"], s["a"], i, hexed)).otherwise(s["b"]).alias("b"),
            )

        return let(F.aggregate(_steps(direction), start, step), lambda s: F.concat(s["a"], s["b"]))

    return let(value, halves)


def walked(value: Column, step: Callable[[Column], Column], good: Callable[[Column], Column]) -> Column:
    """Cycle walking: ``step`` until ``good``. (The chance of not getting there is below 10^-9 for the kinds here.)"""
    once = let(step(value), lambda x: F.struct(x.alias("x"), good(x).alias("ok")))
    again = lambda s, _: F.when(s["ok"], s).otherwise(let(step(s["x"]), lambda x: F.struct(x.alias("x"), good(x).alias("ok"))))
    return F.aggregate(F.array_repeat(F.lit(0), MAX_WALK), once, again)["x"]


def only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def refill(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced, in turn, by ``digits``."""
    return let(
        digits,
        lambda d: F.array_join(
            F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(d, F.length(only_digits(F.substring(value, F.lit(1), i))) + 1, F.lit(1))).otherwise(c)), ""
        ),
    )


def _luhn(digits: Column) -> Column:
    """Weighted sum with the last digit doubled: of a number without its check digit."""
    n = F.length(digits)

    def add(total, i):
        d = F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def check_digit(digits: Column) -> Column:
    return F.pmod(10 - _luhn(digits) % 10, F.lit(10)).cast("string")


def _iban_left(value: Column) -> Column:
    """value read as a number, letters as 10 to 35, modulo 97."""

    def add(left, c):
        n = F.call_function("locate", c, F.lit(DIGITS + UPPER)) - 1
        return (left * F.when(n > 9, 100).otherwise(10) + n) % 97

    return F.aggregate(F.split(value, ""), F.lit(0), add)


def _date(value: Column) -> Column:
    """The date, or null. Year first, else day first, else (where that is no date) month first."""
    y = F.when(value.rlike("^[0-9]{4}"), F.concat_ws("-", F.substring(value, 1, 4), F.substring(value, 6, 2), F.substring(value, 9, 2)))
    d = F.concat_ws("-", F.substring(value, 7, 4), F.substring(value, 4, 2), F.substring(value, 1, 2))
    m = F.concat_ws("-", F.substring(value, 7, 4), F.substring(value, 1, 2), F.substring(value, 4, 2))
    found = F.coalesce(y.try_cast("date"), F.when(y.isNull(), d).try_cast("date"), F.when(y.isNull(), m).try_cast("date"))
    return F.when(F.year(found).between(1800, 2199), found)


def kind_of(m: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """The first of ``kinds`` whose whole pattern and check the candidate meets, or null."""
    digits = only_digits(m)
    full = lambda kind: m.rlike(f"^(?:{PATTERNS[kind]})$")
    count = F.length(digits)
    checks = {
        "EMAIL": F.lit(True),
        "SECRET": F.lit(True),
        "IBAN": let(F.regexp_replace(m, " ", ""), lambda v: F.length(v).between(15, 34) & (_iban_left(F.concat(F.substring(v, F.lit(5), F.length(v)), F.substring(v, 1, 4))) == 1)),
        "IP": F.forall(F.split(m, r"\."), lambda p: p.cast("int") <= 255),
        "DATE": _date(m).isNotNull(),
        "CARD": count.between(13, 19) & let(digits, lambda d: check_digit(F.substring(d, F.lit(1), F.length(d) - 1)) == F.substring(d, F.length(d), F.lit(1))),
        "SSN": valid_ssn(m),
        "PHONE": count.between(9, 15),
    }
    out = None
    for kind in kinds:
        test = full(kind) & checks[kind]
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out


def judged(m: Column) -> Column:
    """struct(value, kind): a candidate with its kind, else its longest card or IBAN that ends before a space or hyphen.

    Patterns of both take the next short word along. Where nothing holds, the candidate with a null kind.
    """
    whole = lambda k: F.struct(m.alias("value"), k.alias("kind"))
    ends = F.filter(F.transform(F.split(m, ""), lambda c, i: F.when(c.isin(" ", "-"), i)), lambda i: i >= 13)
    shorter = F.transform(F.reverse(ends), lambda n: let(F.substring(m, F.lit(1), n), lambda v: F.struct(v.alias("value"), kind_of(v, ("IBAN", "CARD")).alias("kind"))))
    best = let(F.filter(shorter, lambda s: s["kind"].isNotNull()), lambda found: F.coalesce(F.get(found, F.lit(0)), whole(F.lit(None).cast("string"))))
    return let(kind_of(m), lambda k: F.when(k.isNull() & (F.length(m) > 13), best).otherwise(whole(k)))


def valid_ssn(v: Column) -> Column:
    return ~v.rlike("^(000|666|9)|^...-00|0000$")


def pseudonym(m: Column, kind: Column, key: str = KEY, direction: int = 1) -> Column:
    def email(v):
        name = F.substring_index(v, "@", 1)
        return F.concat(permute_text(name, "EMAIL", key, direction), F.substring(v, F.length(name) + 1, F.length(v)))

    def secret(v):
        return let(F.regexp_extract(v, f"^(?:{SECRET_HEAD})({SECRET_VALUE})$", 1), lambda s: F.concat(F.substring(v, F.lit(1), F.length(v) - F.length(s)), permute_text(s, "SECRET", key, direction)))

    def iban(v):
        def rebuilt(plain):
            country, bban = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
            new = F.when(F.length(only_digits(bban)) >= 2, refill(bban, permute_digits(only_digits(bban), "IBAN", key, direction))).otherwise(bban)
            return let(new, lambda b: F.concat(F.lpad((98 - _iban_left(F.concat(b, country, F.lit("00")))).cast("string"), F.lit(2), "0"), only_digits(b)))

        return refill(v, let(F.regexp_replace(v, " ", ""), rebuilt))

    def ip(v):
        p = F.split(v, r"\.")
        part = lambda i: p[i].cast("int")
        out = feistel(part(0) * 256 + part(1), part(2) * 256 + part(3), F.lit(65536), F.lit(65536), "IP", key, direction)
        return let(out, lambda s: F.concat_ws(".", *[x.cast("string") for x in (F.floor(s["a"] / 256), s["a"] % 256, F.floor(s["b"] / 256), s["b"] % 256)]))

    def date(v):
        first = F.lit(FIRST_DAY).cast("date")
        move = lambda n: let(feistel(F.floor(n / DAY_V), n % DAY_V, F.lit(DAY_U), F.lit(DAY_V), "DATE", key, direction), lambda s: s["a"] * DAY_V + s["b"])
        day_first = let(F.concat_ws("-", F.substring(v, 7, 4), F.substring(v, 4, 2), F.substring(v, 1, 2)), lambda s: s.try_cast("date").isNotNull())
        start = F.date_diff(_date(v), first).cast("long")
        at = lambda n: F.date_add(first, n.cast("int"))
        shown = lambda n, pattern: F.date_format(at(n), pattern)
        sep = F.regexp_extract(v, "[^0-9]", 0)
        joined = lambda n, a, b, c: F.concat_ws("", shown(n, a), sep, shown(n, b), sep, shown(n, c))
        us = let(walked(start, move, lambda n: F.dayofmonth(at(n)) > 12), lambda n: joined(n, "MM", "dd", "yyyy"))
        return F.when(v.rlike("^[0-9]{4}"), let(move(start), lambda n: joined(n, "yyyy", "MM", "dd"))).when(day_first, let(move(start), lambda n: joined(n, "dd", "MM", "yyyy"))).otherwise(us)

    def ssn(v):
        plain = lambda d: F.concat_ws("-", F.substring(d, 1, 3), F.substring(d, 4, 2), F.substring(d, 6, 4))
        return plain(walked(only_digits(v), lambda d: permute_digits(d, "SSN", key, direction), lambda d: valid_ssn(plain(d))))

    def phone(v):
        head = F.regexp_extract(v, r"^\+[0-9]{1,3}(?=[ .(\-])", 0)
        rest = F.substring(v, F.length(head) + 1, F.length(v))
        return F.concat(head, let(rest, lambda r: refill(r, permute_digits(only_digits(r), "PHONE", key, direction))))

    def card(v):
        body = let(only_digits(v), lambda d: permute_digits(F.substring(d, F.lit(1), F.length(d) - 1), "CARD", key, direction))
        return refill(v, let(body, lambda b: F.concat(b, check_digit(b))))

    out = F.when(kind.isNull(), m)
    for name, f in {"EMAIL": email, "SECRET": secret, "IBAN": iban, "IP": ip, "DATE": date, "SSN": ssn, "PHONE": phone, "CARD": card}.items():
        out = out.when(kind == name, f(m))
    return out


def scrub(text: Column, key: str = KEY, direction: int = 1) -> Column:
    """struct(text, kinds): the text with pseudonyms, and the kind of each replaced value in order; null for null."""
    kinds = F.array().cast("array<string>")

    def rebuilt(x):
        parts = F.struct(F.split(x, START, -1).alias("gaps"), F.transform(F.regexp_extract_all(x, F.lit(START), F.lit(1)), lambda m: F.struct(m.alias("m"), judged(m).alias("best"))).alias("found"))
        return F.when(x.rlike(ANY), let(parts, resolved)).otherwise(F.struct(x.alias("text"), kinds.alias("kinds")))

    def resolved(p):
        step = lambda c: F.when(c["best"]["kind"] == "SECRET", F.length(c["m"])).otherwise(1)
        sizes = F.transform(p["found"], lambda c, i: F.length(F.get(p["gaps"], i)) + step(c))

        def placed(starts):
            place = lambda c, i: F.struct((F.get(starts, i) + F.length(F.get(p["gaps"], i))).alias("start"), F.length(c["best"]["value"]).alias("size"), c["best"]["kind"].alias("kind"))
            return F.transform(p["found"], place)

        def take(s, c):
            free, end = c["start"] >= s["end"], c["start"] + c["size"]
            ok = free & c["kind"].isNotNull() & ((c["kind"] != "PHONE") | (c["start"] >= s["failed"]))
            ok = F.coalesce(ok, F.lit(False))
            after = F.struct(F.when(ok, end).otherwise(s["end"]).alias("end"), F.when(free & c["kind"].isNull(), F.greatest(s["failed"], end)).otherwise(s["failed"]).alias("failed"))
            return F.lit(True), after, F.struct(ok.alias("ok"), (after["end"] - c["start"]).alias("gone"))

        def joined(taken):
            def one(c, i):
                ok, gone = F.get(taken, i)["ok"], F.get(taken, i)["gone"]
                left = F.concat(F.substring(c["m"], F.lit(1), step(c)), F.get(p["gaps"], i + 1))
                left = F.when(gone > 0, F.substring(left, gone + 1, F.length(left))).otherwise(left)
                return F.when(ok, F.concat(pseudonym(c["best"]["value"], c["best"]["kind"], key, direction), left)).otherwise(left)

            text = F.concat(F.get(p["gaps"], F.lit(0)), F.array_join(F.transform(p["found"], one), ""))
            shown = F.transform(p["found"], lambda c, i: F.when(F.get(taken, i)["ok"], c["best"]["kind"]))
            return F.struct(text.alias("text"), F.filter(shown, lambda k: k.isNotNull()).alias("kinds"))

        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("failed"))
        return let(kept_in_order(let(running(sizes), placed), start, take, "struct<ok:boolean,gone:int>"), joined)

    # Searches for single bytes, which unlike a pattern make no copy of the text.
    some = reduce(Column.__or__, [text.contains(c) for c in DIGITS + "@:="])
    return F.when(some, let(text, rebuilt)).otherwise(F.struct(text.alias("text"), kinds.alias("kinds")))


def pseudonymize(docs: DataFrame, key: str = KEY, direction: int = 1) -> DataFrame:
    """``docs`` with text replaced and a column private_kinds (array) added; every row and other column stays.

    Null texts stay null with no kinds; blank texts and texts without personal data stay as they are; repeated rows get
    equal results.
    """
    return docs.withColumn("__v_scrub", scrub(F.col("text"), key, direction)).withColumn("text", F.col("__v_scrub.text")).withColumn("private_kinds", F.col("__v_scrub.kinds")).drop("__v_scrub")


def op3(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_private and one count for each kind."""
    out = pseudonymize(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("private_kinds", lambda k: k == kind)).alias(f"n_{kind.lower()}")
    return out.select("doc_id", "text", F.size("private_kinds").alias("n_private"), *[count(k) for k in KINDS])
