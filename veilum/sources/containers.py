"""ZIP containers (office documents): parts with guards and decoding, redaction part by part, and the written container.

Unpacking, edits inside markup and packing are Arrow functions over one container or part at a time; detection and numbering
are the same expressions as for texts. A container is refused as a whole, never half processed.
"""

from __future__ import annotations

import codecs
import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from veilum.functions import patterns as P
from veilum.functions.offsets import empty
from veilum.operators import detect, dictionary, placeholders
from veilum.operators.restore import put_originals, remaining, unknown, xml_protect

MAX_PART, MAX_TOTAL, MAX_RATIO, RATIO_FLOOR = 64 << 20, 256 << 20, 200, 4096
PARTS = "path string, part_no int, name string, codec string, text string, view string, content binary, refused string"
TEXT_ENDINGS = tuple(".xml .rels .vml .rdf .txt .html .xhtml .svg .csv .json .eml".split())
_INLINE = frozenset(P.INLINE_ELEMENTS)
_TOKEN = re.compile(
    r"""<!--.*?-->|<!\[CDATA\[(?=(?P<body>.*?)\]\]>)|<\?.*?\?>|<!(?!--|\[CDATA\[)(?:[^>"'\[\]]|"[^"]*"|'[^']*'|\[(?:[^\]"']|"[^"]*"|'[^']*')*+\])*+>|<(?![!?])(?:[^>"']|"[^"]*"|'[^']*')*+>""",
    re.S,
)


def guard(sizes: list[tuple[str, int, int]], max_total: int = MAX_TOTAL) -> str | None:
    """Why a container with these parts (name, size, packed size) is refused, or None."""
    total = 0
    for name, size, packed in sizes:
        total += size
        if size > MAX_PART:
            return f"part {name} is larger than {MAX_PART} bytes"
        if packed and size > max(RATIO_FLOOR, MAX_RATIO * packed):
            return f"part {name} expands more than {MAX_RATIO} times"
        if total > max_total:
            return f"the parts are larger than {max_total} bytes"
    return None


def decode(data: bytes) -> tuple[str | None, str | None]:
    """(text, codec) of a part, or nulls for binary data. Wide encodings without a mark are told by their zero bytes."""
    for mark, codec in ((codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF32_BE, "utf-32-be"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if data.startswith(mark):
            try:
                return data.decode(codec), codec
            except UnicodeDecodeError:
                return None, None
    if 0 not in data[:8192]:
        try:
            return data.decode("utf-8"), "utf-8"
        except UnicodeDecodeError:
            return None, None
    head = data[:4096]
    if len(head) >= 16:
        for codec, width, zeros in (("utf-16-le", 2, (1,)), ("utf-16-be", 2, (0,)), ("utf-32-le", 4, (1, 2, 3)), ("utf-32-be", 4, (0, 1, 2))):
            columns = [head[i::width] for i in range(width)]
            blank = b"".join(columns[i] for i in zeros)
            rest = b"".join(columns[i] for i in range(width) if i not in zeros)
            if blank and rest and blank.count(0) >= 0.9 * len(blank) and len(rest) - rest.count(0) >= 0.8 * len(rest):
                try:
                    text = data.decode(codec)
                except UnicodeDecodeError:
                    continue
                if "\0" not in text:
                    return text, codec
    return None, None


def pieces(xml: str) -> list[tuple[int, int, tuple]]:
    """(start, end, path of open elements) of each text between markup; elements are numbered in order of opening."""
    out, stack, opened, at, cursor, close = [], [], 0, 0, 0, None
    while True:
        token = _TOKEN.search(xml, cursor) if close is None else None
        start, end = (close, close + 3) if close is not None else token.span() if token else (len(xml), len(xml))
        out.append((at, start, tuple(stack)))
        if token is None and close is None:
            return out
        at = cursor = end
        if close is not None:
            close = None
            continue
        if token["body"] is not None:
            close = end + len(token["body"])
            continue
        inner = xml[start + 1 : end - 1].strip()
        if not inner or inner[0] in "?!":
            continue
        body = inner.lstrip("/").strip() if inner[0] == "/" else inner
        name = body.rstrip("/").strip().split(" ")[0]
        if inner[0] == "/":
            if any(n == name for n, _ in stack):
                while stack.pop()[0] != name:
                    pass
        elif not body.endswith("/"):
            opened += 1
            stack.append((name, opened))


def view_of(xml: str) -> str:
    """The texts between markup, a space for each piece of markup."""
    return " ".join(xml[a:b] for a, b, _ in pieces(xml))


def fragments(xml: str, spans: list[tuple[int, int]]) -> list[dict]:
    """For each span of the view: its source ranges, its text in the source, and the containers it would cross."""
    parts, starts, at = pieces(xml), [], 0
    for a, b, _ in parts:
        starts.append(at)
        at += b - a + 1
    out = []
    for start, end in spans:
        ranges, paths = [], []
        for (a, b, path), v in zip(parts, starts, strict=True):
            lo, hi = max(start, v), min(end, v + b - a)
            if lo < hi:
                ranges.append((a + lo - v, a + hi - v))
                paths.append(tuple(e for e in path if e[0] not in _INLINE))
        crossed = sorted({n for p in paths[1:] for n, _ in set(p) ^ set(paths[0])}) or (["order"] if any(p != paths[0] for p in paths[1:]) else [])
        out.append({"ranges": [{"start": a, "end": b} for a, b in ranges], "value": "".join(xml[a:b] for a, b in ranges), "crossed": crossed})
    return out


def edited(xml: str, edits: list[tuple[list[tuple[int, int]], str]]) -> str:
    """The first range of each edit replaced by its text, its other ranges emptied."""
    changes = [(a, b, text if k == 0 else "") for ranges, text in edits for k, (a, b) in enumerate(ranges)]
    for a, b, text in sorted(changes, reverse=True):
        xml = xml[:a] + text + xml[b:]
    return xml


def read_parts(files: DataFrame, max_total: int = MAX_TOTAL) -> DataFrame:
    """``files``: path, content. A row for each part: PARTS. A refused container has one row with the reason."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                out = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        infos = z.infolist()
                        refused = guard([(i.filename, i.file_size, i.compress_size) for i in infos], max_total)
                        for n, info in enumerate(infos if not refused else []):
                            data = z.read(info)
                            text, codec = decode(data)
                            if text is None and (info.filename == "[Content_Types].xml" or info.filename.lower().endswith(TEXT_ENDINGS)):
                                refused = f"part {info.filename} is named as text and can't be decoded"
                                break
                            out.append((path, n, info.filename, codec, text, None if text is None else view_of(text), data, None))
                except (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError, EOFError) as error:
                    refused = f"not a readable container: {type(error).__name__}"
                if refused:
                    out = [(path, 0, None, None, None, None, None, refused)]
                yield pd.DataFrame(out, columns=[c.split()[0] for c in PARTS.split(", ")])

    return files.select("path", "content").mapInPandas(rows, PARTS)


def container_text(parts: DataFrame) -> DataFrame:
    """path, text: the views of all text parts in order, one to a line; refused containers are left out."""
    ordered = F.array_sort(F.collect_list(F.when(F.col("view").isNotNull(), F.struct("part_no", "view"))))
    texts = parts.where("refused is null").groupBy("path").agg(ordered.alias("v"))
    return texts.select("path", F.array_join(F.transform("v", lambda x: x["view"]), "\n").alias("text"))


def _added(df: DataFrame, name: str, kind: str, compute, *inputs: str) -> DataFrame:
    """``df`` with a column computed in Python from others. A map over rows, as a UDF's arguments can't hold lambdas."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = [compute(*row) for row in zip(*(batch[c] for c in inputs), strict=True)]
            yield batch.assign(**{name: pd.Series(values, index=batch.index, dtype=object)})

    return df.mapInPandas(rows, T.StructType([*df.schema.fields, T.StructField(name, T._parse_datatype_string(kind))]))


def _fragments_of(text, spans):
    return [] if text is None or spans is None else fragments(text, [(s["start"], s["end"]) for s in spans])


def _edited_text(text, edits):
    return text if text is None or edits is None else edited(text, [([(r["start"], r["end"]) for r in e["ranges"]], e["token"]) for e in edits])


def redact_parts(parts: DataFrame, tag: Column | str | None = None, families=None, entries: list | None = None) -> DataFrame:
    """Parts with new_text, and for each container entries (one numbering over all parts), leftovers and refused.

    A container is refused if a value crosses containers of text, and if anything is still found in the new views.
    ``entries``: a dictionary, scanned in the views as well.
    """
    found = detect.with_spans(dictionary.with_hits(parts, entries, "view"), "view", "hits", families).drop("hits") if entries else detect.with_spans(parts, "view", families=families)
    found = found.withColumn("spans", F.coalesce("spans", empty(detect.FOUND)))
    kind = "array<struct<ranges:array<struct<start:int,end:int>>,value:string,crossed:array<string>>>"
    cut = _added(found, "__v_f", kind, _fragments_of, "text", "spans")
    cut = cut.withColumn("cut", F.arrays_zip("spans", F.col("__v_f").alias("f"))).drop("__v_f")
    cut = cut.withColumn("cut", F.transform("cut", lambda c: F.struct(c["spans"]["start"].alias("start"), c["spans"]["type"].alias("type"), c["f"]["value"].alias("value"), c["f"]["ranges"].alias("ranges"), c["f"]["crossed"].alias("crossed"))))
    values = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part_no", "cut"))), lambda p: p["cut"]))
    whole = cut.groupBy("path").agg(
        F.array_join(F.collect_list("view"), "\n").alias("__v_all"),
        F.first(tag if isinstance(tag, Column) else F.lit(tag)).cast("string").alias("__v_tag"),
        F.transform(values, lambda c: F.struct(c["start"].alias("start"), c["type"].alias("type"), c["value"].alias("value"))).alias("__v_values"),
        F.array_sort(F.array_distinct(F.flatten(F.flatten(F.collect_list(F.transform("cut", lambda c: c["crossed"])))))).alias("crossed"),
    )
    numbered = whole.withColumn("entries", placeholders.entries(F.col("__v_all"), F.col("__v_values"), F.col("__v_tag"))).select(F.col("path").alias("__v_path"), "entries", "crossed")
    joined = cut.join(numbered, F.col("path") == F.col("__v_path")).drop("__v_path")
    token = lambda c, listed: F.get(F.filter(listed, lambda e: (e["type"] == c["type"]) & (e["original"] == c["value"])), F.lit(0))["placeholder"]
    edits = F.transform("cut", lambda c: F.struct(c["ranges"].alias("ranges"), token(c, F.col("entries")).alias("token")))
    done = _added(joined.withColumn("__v_edits", edits), "new_text", "string", _edited_text, "text", "__v_edits")
    done = _added(done.drop("__v_edits"), "__v_view", "string", lambda t: None if t is None else view_of(t), "new_text")
    if entries:
        done = dictionary.with_hits(done, entries, "__v_view")
    left = F.size(detect.spans_of("__v_view", "hits" if entries else None, families))
    done = done.withColumn("leftovers", F.when(F.col("__v_view").isNotNull(), left).otherwise(0)).drop("hits")
    crossing = F.when(F.size("crossed") > 0, F.concat(F.lit("a value crosses "), F.array_join("crossed", ", ")))
    return done.withColumn("refused", F.coalesce("refused", crossing, F.when(F.col("leftovers") > 0, F.lit("values are left in the output")))).drop("__v_view", "spans", "cut", "crossed")


def packed(parts: DataFrame, original: DataFrame) -> DataFrame:
    """path, content of each container none of whose parts is refused: the original's order and compression, new texts."""
    texts = parts.groupBy("path").agg(F.max("refused").alias("refused"), F.collect_list(F.when(F.col("new_text").isNotNull() & (F.col("new_text") != F.col("text")), F.struct("part_no", "new_text", "codec"))).alias("changes"))
    joined = original.select("path", "content").join(texts.where("refused is null").drop("refused"), "path")

    @pandas_udf("binary")
    def pack(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for contents, changes in batches:
            out = []
            for content, changed in zip(contents, changes, strict=True):
                new, target = {c["part_no"]: c["new_text"].encode(c["codec"]) for c in changed}, io.BytesIO()
                with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(target, "w") as w:
                    for n, info in enumerate(z.infolist()):
                        w.writestr(info, new.get(n, z.read(info)), compress_type=info.compress_type)
                out.append(target.getvalue())
            yield pd.Series(out)

    return joined.select("path", pack("content", "changes").alias("content"))


def restored_parts(parts: DataFrame, maps: DataFrame) -> DataFrame:
    """``parts`` joined with ``maps`` (path, entries): new_text with originals escaped for markup, replaced, split tokens
    put together where they stand in one container of text."""

    def repair(text, listed):
        known = sorted((e for e in listed if e["original"] is not None), key=lambda e: -len(e["placeholder"])) if text is not None and listed is not None else []
        if not known:
            return {"text": text, "repaired": 0}
        spread = "".join(text[a:b] for a, b, _ in pieces(text))
        original, edits = {e["placeholder"]: e["original"] for e in known}, []
        for m in re.finditer("|".join(re.escape(e["placeholder"]) for e in known), spread):
            found = _plain_fragments(text, m.start(), m.end())
            if len(found["ranges"]) > 1 and not found["crossed"]:
                edits.append((found["ranges"], _escape(original[m[0]])))
        return {"text": edited(text, edits), "repaired": len(edits)}

    joined = parts.join(maps.select("path", "entries"), "path", "left")
    back = joined.withColumn("__v_back", put_originals(F.col("text"), F.col("entries"), xml_protect))
    back = back.withColumn("__v_text", F.col("__v_back.text")).withColumn("replaced", F.col("__v_back.replaced")).drop("__v_back")
    fixed = _added(back, "__v_fixed", "struct<text:string,repaired:int>", repair, "__v_text", "entries")
    return fixed.withColumn("new_text", F.col("__v_fixed.text")).withColumn("repaired", F.col("__v_fixed.repaired")).drop("__v_text", "__v_fixed")


def _escape(value: str) -> str:
    for char, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot"), ("'", "apos")):
        value = value.replace(char, f"&{name};")
    return value


def _plain_fragments(xml: str, start: int, end: int) -> dict:
    """Source ranges of a span of the concatenated texts, and whether they cross containers."""
    ranges, paths, at = [], [], 0
    for a, b, path in pieces(xml):
        lo, hi = max(start, at), min(end, at + b - a)
        if lo < hi:
            ranges.append((a + lo - at, a + hi - at))
            paths.append(tuple(e for e in path if e[0] not in _INLINE))
        at += b - a
    return {"ranges": ranges, "crossed": any(p != paths[0] for p in paths[1:])}


def artifacts(files: DataFrame, tag: str | None = None, families=None, entries: list | None = None) -> DataFrame:
    """path, content, text, entries of each container that can be redacted: one redaction, from whose result the text is
    taken, so that both have the same placeholders and one map."""
    parts = redact_parts(read_parts(files), tag, families, entries)
    made = packed(parts, files)
    texts = container_text(read_parts(made))
    maps = parts.groupBy("path").agg(F.first("entries").alias("entries"))
    return made.join(texts, "path").join(maps, "path")


def restored_containers(files: DataFrame, maps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``files`` (path, content) with the originals of ``maps`` (path, entries) put back, and a verdict for each.

    The verdict comes from what was made, read again: path, replaced, repaired, remaining, remaining_parts, unknown,
    unreadable_parts, complete (nothing left, unknown or unreadable, and something replaced).
    """
    parts = restored_parts(read_parts(files), maps)
    made = packed(parts, files)
    counts = parts.groupBy("path").agg(F.sum("replaced").cast("int").alias("replaced"), F.sum("repaired").cast("int").alias("repaired"), F.max("refused").alias("unreadable"))
    again = read_parts(made).join(maps.select("path", "entries"), "path", "left").withColumn("entries", F.coalesce("entries", empty(placeholders.ENTRY)))
    seen = again.withColumn("seen", visible_of("text")).withColumn("left", remaining(F.col("seen"), F.col("entries"))).withColumn("odd", unknown(F.col("seen"), F.col("entries")))
    told = seen.groupBy("path").agg(
        F.coalesce(F.sum("left"), F.lit(0)).cast("int").alias("remaining"), F.array_sort(F.collect_list(F.when(F.col("left") > 0, F.col("name")))).alias("remaining_parts"), F.coalesce(F.sum("odd"), F.lit(0)).cast("int").alias("unknown")
    )
    out = counts.join(told, "path", "left")
    whole = F.col("unreadable").isNull() & (F.col("remaining") == 0) & (F.col("unknown") == 0) & (F.col("replaced") + F.col("repaired") > 0)
    return made, out.withColumn("complete", F.coalesce(whole, F.lit(False)))


def visible_of(column: str):
    """The texts between markup, nothing between them: as a reader sees a part."""

    @pandas_udf("string")
    def seen(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else "".join(t[a:b] for a, b, _ in pieces(t)))

    return seen(F.col(column))
