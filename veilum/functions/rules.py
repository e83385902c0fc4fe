"""The detection rules in order of precedence."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilum.functions import patterns as P
from veilum.functions import validators as V
from veilum.functions.offsets import empty, let, matches

ANY_DIGIT = rf"[{P.D}]"
FAMILIES = ("identity", "network", "legal")
#: The first nine characters of a tax code in either case, without the slow flags for that; ſ and K fold to s and k.
TAX_CODE_START = r"(?<![A-Za-z0-9])[A-Za-zſ\u212a]{6}[0-9LMNPQRSTUVlmnpqrstuvſ]{2}[A-Za-zſ\u212a]"
DICTIONARY_PRIORITY, HEURISTIC_PRIORITY = 500, 1000


@dataclass(frozen=True)
class Rule:
    name: str
    type: str
    pattern: str
    hint: str = ""  # a cheap pattern that every text with a match has
    holds: tuple[str, ...] = ()  # every text with a match holds one of these
    digits: bool = False  # every match has a digit
    group: int = 0
    check: Callable[[Column], Column] | None = None
    trim: str = ""
    shrink: str = ""  # "labels" or "words": drop trailing parts until the check holds
    family: str = "identity"

    def spans(self, text: Column, has_digit: Column | None = None) -> Column:
        """array<SPAN> of accepted values. A rejected match is not searched again.

        The cheap tests come first; a caller with many rules can pass whether the text has a digit.
        """
        tests = []
        if self.digits:
            tests.append(text.rlike(ANY_DIGIT) if has_digit is None else has_digit)
        if self.holds:
            tests.append(reduce(Column.__or__, [text.contains(x) for x in self.holds]))
        if self.hint:
            tests.append(text.rlike(self.hint))
        found = F.when(reduce(Column.__and__, tests), matches(text, self.pattern, self.group)).otherwise(empty())
        if not (self.trim or self.check or self.shrink):
            return found

        def accepted(value):
            if self.check is None:
                return value
            if not self.shrink:
                return F.when(self.check(value), value)
            gap = r"\." if self.shrink == "labels" else " "
            parts = F.split(F.rtrim(value) if self.shrink == "words" else value, gap, -1)
            joined = lambda p, k: F.rtrim(F.array_join(F.slice(p, 1, k), "." if self.shrink == "labels" else " "))
            shorter = lambda p: F.when(F.size(p) > 1, F.get(F.filter(F.transform(F.sequence(F.size(p) - 1, F.lit(1), F.lit(-1)), lambda k: joined(p, k)), self.check), F.lit(0)))
            return F.when(self.check(value), value).otherwise(let(parts, shorter))

        def kept(span):
            value = F.rtrim(span["value"], F.lit(self.trim)) if self.trim else span["value"]
            out = let(value, accepted) if self.check else value
            return let(out, lambda v: F.struct(span["start"].alias("start"), (span["start"] + F.length(v)).alias("end"), v.alias("value")))

        return F.filter(F.transform(found, kept), lambda s: s["value"].isNotNull() & (s["end"] > s["start"]))


RULES = (
    Rule("url", "URL", P.URL, r"://|(?iu)www\.", holds=("://", "w.", "W."), trim=P.URL_TRIM),
    Rule("email", "EMAIL", P.EMAIL, holds=("@",)),
    Rule("key_jwt", "KEY", P.JWT, holds=("eyJ",)),
    Rule("key_sk", "KEY", P.KEY_SK, holds=("sk-",)),
    Rule("key_aws", "KEY", P.KEY_AWS, holds=("AKIA",)),
    Rule("key_gh", "KEY", P.KEY_GH, holds=("ghp_",)),
    Rule("key_gh_pat", "KEY", P.KEY_GH_PAT, holds=("github_pat_",)),
    Rule("key_slack", "KEY", P.KEY_SLACK, holds=("xox",)),
    Rule("key_bearer", "KEY", P.BEARER, "[Bb][Ee][Aa][Rr][Ee][Rr]", group=1, check=V.valid_secret),
    Rule("key_assigned", "KEY", P.ASSIGNED, holds=(":", "="), group=1, check=V.valid_secret),
    Rule("tax_code", "CODICEFISCALE", P.CODICE_FISCALE, TAX_CODE_START, check=V.valid_tax_code, family="legal"),
    Rule("vat", "PARTITAIVA", P.PARTITA_IVA, rf"[{P.D}]{{11}}", digits=True, group=1, check=V.valid_vat, family="legal"),
    Rule("iban", "IBAN", P.IBAN, rf"(?iu)IT[{P.S}]?[{P.D}]{{2}}", digits=True, check=V.valid_iban, shrink="words", family="legal"),
    Rule("plate", "TARGA", P.PLATE, rf"[A-Z]{{2}}[{P.S}]?[{P.D}]{{3}}", digits=True, check=V.valid_plate, family="legal"),
    Rule("address", "INDIRIZZO", P.ADDRESS, rf"(?iu)(?<![{P.W}]){P.STREET_WORDS}[{P.S}]", digits=True, check=V.valid_address, family="legal"),
)
HEURISTICS = (
    Rule("ipv4", "IP", P.IPV4, rf"[{P.D}]\.[{P.D}]", digits=True, check=V.valid_ipv4, family="network"),
    Rule("ipv6", "IP", P.IPV6, "[0-9A-Fa-f:]:[0-9A-Fa-f]{0,4}:|::", holds=(":",), check=V.valid_ipv6, family="network"),
    Rule("phone", "TEL", P.PHONE, rf"\+[{P.D}]|0039|3[{P.D}]{{2}}", digits=True, check=V.valid_phone, family="network"),
    Rule("host", "HOST", P.HOST, r"[A-Za-z0-9]\.[A-Za-z]", check=V.valid_host, shrink="labels", family="network"),
)
BY_NAME = {r.name: r for r in (*RULES, *HEURISTICS)}


def chosen(families=None, heuristics: bool = True) -> list[tuple[int, Rule]]:
    """(priority, rule) of the rules of these families (None: all)."""
    if families is not None and (unknown := set(families) - set(FAMILIES)):
        raise ValueError(f"unknown families {sorted(unknown)}")
    listed = [*enumerate(RULES)] + ([(HEURISTIC_PRIORITY + i, r) for i, r in enumerate(HEURISTICS)] if heuristics else [])
    return [(k, r) for k, r in listed if families is None or r.family in families]
