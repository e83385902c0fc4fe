"""Text-only PDF files, the same bytes for the same text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

# A4, margins, type size and line length.
WIDTH, HEIGHT, MARGIN, LEADING, SIZE, COLUMNS = 595, 842, 48, 14, 10, 92


def wrapped(text: str) -> list[str]:
    """Lines of at most COLUMNS characters: broken at spaces, runs of which stay except where a line begins; longer words
    are cut."""
    out = []
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        line = line.lstrip(" ")
        while len(line) > COLUMNS:
            space = line.rfind(" ", 1, COLUMNS + 1)
            if space > 0:
                out.append(line[:space])
                line = line[space + 1 :].lstrip(" ")
            else:
                out.append(line[:COLUMNS])
                line = line[COLUMNS:]
        out.append(line)
    return out


def _literal(line: str) -> bytes:
    data = line.encode("cp1252", "replace")
    for char in (b"\\", b"(", b")"):
        data = data.replace(char, b"\\" + char)
    return b"(" + data + b") Tj"


class _File:
    """A PDF file in the making: numbered objects, their places, the table of places."""

    def __init__(self):
        self.objects: list[bytes] = []

    def add(self, body: bytes = b"") -> int:
        self.objects.append(body)
        return len(self.objects)

    def fill(self, number: int, body: str) -> None:
        self.objects[number - 1] = body.encode()

    def add_stream(self, data: bytes) -> int:
        return self.add(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(data), data))

    def written(self, root: int) -> bytes:
        out, places = bytearray(b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n"), [b"0000000000 65535 f \n"]
        for number, body in enumerate(self.objects, start=1):
            places.append(b"%010d 00000 n \n" % len(out))
            out += b"%d 0 obj\n%s\nendobj\n" % (number, body)
        tail = b"xref\n0 %d\n%strailer\n<< /Size %d /Root %d 0 R >>\nstartxref\n%d\n%%%%EOF\n"
        return bytes(out) + tail % (len(places), b"".join(places), len(places), root, len(out))


def _shown(lines: list[str]) -> bytes:
    """The drawing of one page: a text object that starts at the top left and goes down line by line."""
    setup = f"BT\n/F1 {SIZE} Tf\n{LEADING} TL\n1 0 0 1 {MARGIN} {HEIGHT - MARGIN - SIZE} Tm\n".encode()
    return setup + b"".join(_literal(x) + b" T*\n" for x in lines) + b"ET"


def pdf(text: str) -> bytes:
    """A PDF 1.4 file in Helvetica and WinAnsi; characters outside it become question marks."""
    lines, rows = wrapped(text), (HEIGHT - 2 * MARGIN) // LEADING
    file = _File()
    font = file.add(b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>")
    tree, kids = file.add(), []
    for at in range(0, len(lines), rows):
        drawing = file.add_stream(_shown(lines[at : at + rows]))
        page = f"<< /Type /Page /Parent {tree} 0 R /MediaBox [0 0 {WIDTH} {HEIGHT}] /Contents {drawing} 0 R /Resources << /Font << /F1 {font} 0 R >> >> >>"
        kids.append(f"{file.add(page.encode())} 0 R")
    file.fill(tree, f"<< /Type /Pages /Count {len(kids)} /Kids [{' '.join(kids)}] >>")
    return file.written(file.add(f"<< /Type /Catalog /Pages {tree} 0 R >>".encode()))


def as_pdf(text: Column) -> Column:
    @pandas_udf("binary")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else pdf(t))

    return made(text)
