"""Text views of markup, with the source offsets and element paths of their segments.

Views without offsets are single replacements; views with segments fold over the tokens of a document. A comment or tag that
never ends is text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilum.functions import patterns as P
from veilum.functions.offsets import kept_in_order, let, matches

#: Possessive, so that a document of one unfinished tag takes linear time.
_QUOTED = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
_DECLARED = r"""(?:[^>"'\[\]]++|"[^"]*+"|'[^']*+'|\[(?:[^\]"']|"[^"]*+"|'[^']*+')*+\])*+"""
#: Comments, processing instructions, declarations and tags. CDATA sections, whose bodies are text, are cut out before.
MARKUP = rf"(?s)<!--(?:(?!-->).)*+-->|<\?(?:(?!\?>).)*+\?>|<!(?!--){_DECLARED}>|<(?![!?]){_QUOTED}>"
_CDATA = r"(?s)<!\[CDATA\[((?:(?!\]\]>).)*+)\]\]>"
ELEMENT = "struct<name:string,id:int>"
SEGMENT = f"struct<vstart:int,sstart:int,size:int,path:array<{ELEMENT}>>"


def _sections(xml: Column, other, section) -> Column:
    """CDATA sections and what stands between them, each its own way."""

    def split(x):
        bodies = F.regexp_extract_all(x, F.lit(_CDATA), F.lit(1))
        gaps = F.split(x, _CDATA, -1)
        return let(bodies, lambda b: F.array_join(F.transform(gaps, lambda g, i: F.concat(other(g), F.when(i < F.size(b), section(F.get(b, i))).otherwise(""))), ""))

    return F.when(xml.contains("<![CDATA["), let(xml, split)).otherwise(other(xml))


def visible(xml: Column) -> Column:
    """What a reader sees: all markup taken out."""
    return _sections(xml, lambda g: F.regexp_replace(g, MARKUP, ""), lambda b: b)


def masked_view(xml: Column) -> Column:
    """A space for each piece of markup; the delimiters of a CDATA section are one each."""
    return _sections(xml, lambda g: F.regexp_replace(g, MARKUP, " "), lambda b: F.concat(F.lit(" "), b, F.lit(" ")))


def tokens(xml: Column) -> Column:
    """array<SPAN> of the markup (documents without CDATA sections)."""
    return matches(xml, MARKUP)


def _tag(token: Column) -> Column:
    """struct(name, closing, empty) of a tag; a null name for comments, instructions and declarations."""
    inner = F.trim(F.substring(token, F.lit(2), F.length(token) - 2))
    closing = inner.startswith("/")
    body = F.trim(F.when(closing, F.substring(inner, F.lit(2), F.length(inner))).otherwise(inner))
    name = F.trim(F.substring_index(F.trim(F.regexp_replace(body, "/+$", "")), " ", 1))
    element = ~inner.rlike(r"^[?!]") & (F.length(name) > 0)
    return F.struct(F.when(element, name).alias("name"), closing.alias("closing"), body.endswith("/").alias("empty"))


def segments(xml: Column, separator: str = "") -> Column:
    """array<SEGMENT>: each text between two pieces of markup, with its start in the view and in the source, its length, and
    the open elements, numbered in order of opening."""

    def folded(x):
        path = F.array().cast(f"array<{ELEMENT}>")
        start = F.struct(F.lit(0).alias("v"), F.lit(0).alias("s"), F.lit(0).alias("opened"), path.alias("path"))

        def segment(state, end):
            size = end - state["s"]
            return F.struct(state["v"].alias("vstart"), state["s"].alias("sstart"), size.alias("size"), state["path"].alias("path"))

        def after(state, token):
            def moved(tag):
                names = F.transform(state["path"], lambda e: e["name"])
                back = F.array_position(F.reverse(names), tag["name"]).cast("int")
                closed = F.when(back > 0, F.slice(state["path"], 1, F.size(state["path"]) - back)).otherwise(state["path"])
                opens = tag["name"].isNotNull() & ~tag["closing"] & ~tag["empty"]
                number = state["opened"] + F.when(opens, 1).otherwise(0)
                pushed = F.array_append(state["path"], F.struct(tag["name"].alias("name"), number.alias("id")))
                path_after = F.when(opens, pushed).when(tag["name"].isNotNull() & tag["closing"], closed).otherwise(state["path"])
                return F.struct(
                    (state["v"] + token["start"] - state["s"] + len(separator)).alias("v"),
                    token["end"].alias("s"),
                    number.alias("opened"),
                    path_after.alias("path"),
                )

            return let(_tag(token["value"]), moved)

        end = F.struct(F.length(x).alias("start"), F.length(x).alias("end"), F.lit("<!>").alias("value"))
        step = lambda state, token: (F.lit(True), after(state, token), segment(state, token["start"]))
        return kept_in_order(F.array_append(tokens(x), end), start, step, SEGMENT)

    return let(xml, folded)


def path_at(parts: Column, offset: Column, column: str = "sstart") -> Column:
    """The path of the last segment that starts at or before an offset (the first, if none does)."""
    at = F.filter(parts, lambda s: s[column] <= offset)
    return F.when(F.size(at) > 0, F.element_at(at, -1)["path"]).otherwise(F.get(parts, F.lit(0))["path"])


def containers(path: Column) -> Column:
    """The elements that separate texts."""
    return F.filter(path, lambda e: ~e["name"].isin(*P.INLINE_ELEMENTS))


def boundary_offenders(left: Column, right: Column) -> Column:
    """Names of the containers that only one of two paths has; none where both are in the same."""
    mine, theirs = containers(left), containers(right)
    names = lambda a: F.transform(a, lambda e: e["name"])
    differ = F.array_union(names(F.array_except(mine, theirs)), names(F.array_except(theirs, mine)))
    return F.when(mine == theirs, F.array().cast("array<string>")).otherwise(F.array_sort(F.when(F.size(differ) > 0, differ).otherwise(F.array_union(names(mine), names(theirs)))))


def runs(offsets: Column) -> Column:
    """array<struct<start,end>>: runs of consecutive numbers in a sorted array without repeats, ends included."""

    def zipped(a):
        at = lambda i: F.get(a, i)
        starts = F.filter(a, lambda n, i: F.coalesce(at(i - 1) != n - 1, F.lit(True)))
        ends = F.filter(a, lambda n, i: F.coalesce(at(i + 1) != n + 1, F.lit(True)))
        return F.zip_with(starts, ends, lambda x, y: F.struct(x.alias("start"), y.alias("end")))

    return let(offsets, zipped)
