"""Checks that a matched value must pass, as Spark expressions over the value."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilum.functions import patterns as P
from veilum.functions.offsets import let

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def place_in(alphabet: str, char: Column) -> Column:
    """0-based place of a character, -1 if it isn't there."""
    return F.call_function("locate", char, F.lit(alphabet)) - 1


def chars(value: Column) -> Column:
    return F.split(value, "")


def valid_ipv4(value: Column) -> Column:
    return value.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$")


def valid_ipv6(value: Column) -> Column:
    """Eight groups, or fewer with one :: in their place."""
    groups = F.size(F.filter(F.split(value, ":"), lambda g: F.length(g) > 0))
    doubles = F.regexp_count(value, F.lit("::"))
    shape = value.rlike(r"^[0-9A-Fa-f:]+$") & ~value.rlike(r"[0-9A-Fa-f]{5}|:::|^:[^:]|[^:]:$")
    return shape & (((doubles == 0) & (groups == 8)) | ((doubles == 1) & (groups <= 7)))


def valid_ip(value: Column) -> Column:
    return valid_ipv4(value) | valid_ipv6(value)


def ipv4_number(value: Column) -> Column:
    """The address as a number; null where it isn't one."""
    parts = F.split(value, r"\.")
    number = sum((F.get(parts, F.lit(i)).try_cast("long") * F.lit(256 ** (3 - i)) for i in range(1, 4)), F.get(parts, F.lit(0)).try_cast("long") * F.lit(256**3))
    return F.when(valid_ipv4(value), number)


_NETS = "array({})".format(", ".join(f"struct({int(n.network_address)}L AS lo, {int(n.broadcast_address)}L AS hi)" for n in map(ipaddress.ip_network, P.SAFE_NETS)))


def in_safe_net(value: Column) -> Column:
    inside = lambda number: F.exists(F.expr(_NETS), lambda n: number.between(n["lo"], n["hi"]))
    loopback = valid_ipv6(value) & (F.regexp_replace(value, "[0:]", "") == "1") & value.rlike("(?:^|:)0{0,3}1$")
    return F.coalesce(let(ipv4_number(value), inside), F.lit(False)) | loopback


def _known(v: Column) -> Column:
    out = (F.length(v) == 0) | v.isin(*P.SAFE_EXACT)
    for suffix in P.SAFE_SUFFIXES:
        out = out | v.endswith(suffix)
    return out | in_safe_net(v)


def _host_in(v: Column) -> Column:
    """The host of a URL without its scheme, user, port and leading www."""
    host = F.substring_index(F.substring_index(F.substring_index(F.regexp_replace(v, r"^[a-z][a-z0-9+.\-]*://", ""), "/", 1), "@", -1), ":", 1)
    return F.trim(F.regexp_replace(host, r"^(?:www\.)+", ""))


def is_safe(value: Column) -> Column:
    """Public names, documentation domains and networks; a URL or an e-mail address by its host."""

    def at(v):
        name = F.when(v.contains("://") | v.startswith("www."), _host_in(v)).when(v.contains("@"), F.trim(F.substring_index(v, "@", -1))).otherwise(v)
        return F.exists(F.array(v, name), _known)

    return let(F.lower(F.trim(value)), at)


def valid_host(value: Column) -> Column:
    last = F.lower(F.element_at(F.split(value, r"\."), -1))
    tlds = [t for t in P.HOST_TLDS if t not in P.FILE_ENDINGS]
    return value.contains(".") & last.isin(*tlds)


def valid_phone(value: Column) -> Column:
    return F.length(F.regexp_replace(value, rf"[^{P.D}]", "")).between(9, 15)


def valid_tax_code(value: Column) -> Column:
    """The 16th character is the check character of the first fifteen, letters in digit places read as digits first."""

    def checked(v):
        digit = lambda i: F.translate(F.substring(v, i, 1), P.CF_LETTERS, P.CF_DIGITS)
        plain = F.concat(F.substring(v, 1, 6), digit(7), digit(8), F.substring(v, 9, 1), digit(10), digit(11), F.substring(v, 12, 1), digit(13), digit(14), digit(15))
        odd = F.array(*[F.lit(P.CF_ODD[c]) for c in _LETTERS])
        place = lambda c: place_in(_LETTERS, c)
        even = lambda c: F.when(place(c) > 9, place(c) - 10).otherwise(place(c))
        worth = F.transform(chars(plain), lambda c, i: F.when(i % 2 == 0, F.get(odd, place(c))).otherwise(even(c)))
        total = F.aggregate(worth, F.lit(0), lambda a, x: a + x)
        return F.substring(F.lit(_LETTERS[10:]), total % 26 + 1, F.lit(1)) == F.substring(v, 16, 1)

    return let(F.upper(F.trim(value)), lambda v: v.rlike(f"^{P.CF_FORMAT}$") & checked(v))


def valid_vat(value: Column) -> Column:
    """Eleven digits; the last makes the Luhn-like sum of the others a multiple of ten."""

    def checked(v):
        worth = F.transform(chars(F.substring(v, 1, 10)), lambda c, i: let(c.cast("int") * (i % 2 + 1), lambda d: F.when(d > 9, d - 9).otherwise(d)))
        total = F.aggregate(worth, F.lit(0), lambda a, x: a + x)
        return F.pmod(10 - total % 10, F.lit(10)) == F.substring(v, 11, 1).cast("int")

    return let(F.regexp_replace(value, rf"[^{P.D}]", ""), lambda v: v.rlike("^[0-9]{11}$") & checked(v))


def valid_iban(value: Column) -> Column:
    """Country and check digits moved to the end, letters read as 10 to 35: the number leaves 1 modulo 97."""

    def left(v):
        moved = F.concat(F.substring(v, F.lit(5), F.length(v)), F.substring(v, 1, 4))
        add = lambda a, c: let(place_in(_LETTERS, c), lambda n: (a * F.when(n > 9, 100).otherwise(10) + n) % 97)
        return F.aggregate(chars(moved), F.lit(0), add)

    return let(F.upper(F.regexp_replace(value, rf"[{P.S}\-]", "")), lambda v: v.rlike(f"^{P.IBAN_FORMAT}$") & (left(v) == 1))


def valid_plate(value: Column) -> Column:
    return F.upper(F.trim(value)).rlike(f"^{P.PLATE_FORMAT}$")


def valid_secret(value: Column) -> Column:
    """Not a placeholder, a variable or a row of filler characters."""

    def real(v):
        out = ~v.isin(*P.DUMMY_SECRETS) & ~v.rlike(P.DUMMY_PREFIX) & ~v.rlike(P.BLANK_SECRET)
        for start in P.VARIABLE_STARTS:
            out = out & ~v.startswith(start)
        return out

    return let(F.trim(F.lower(value)), real)


def valid_address(value: Column) -> Column:
    """One word of the street's name is capitalized after its last apostrophe; or the last word ends with an apostrophe,
    is capitalized before it and isn't an elided article."""
    upper = r"^[\p{Lu}\p{Lt}]"

    def named(street):
        words = F.filter(F.split(street, rf"[{P.S}]+"), lambda w: F.length(w) > 0)

        def checked(w):
            capital = F.exists(w, lambda x: F.element_at(F.split(x, "['’]", -1), -1).rlike(upper))
            last = F.element_at(w, -1)
            cut = F.element_at(F.split(F.regexp_replace(last, "['’]+$", ""), "['’]", -1), -1)
            return capital | (last.rlike("['’]$") & cut.rlike(upper) & ~F.lower(cut).isin(*P.ELIDED))

        return F.when(F.size(words) > 0, let(words, checked)).otherwise(False)

    return let(F.regexp_extract(F.trim(value), P.ADDRESS.replace("(?iu)", "(?iu)^", 1) + "$", 1), lambda s: (F.length(s) > 0) & named(s))
