"""WARC archives with an index: written once, read back by byte ranges.

Writing comes in three steps. Digests of all payloads are grouped, which names for each payload the page that keeps it. Each
task then writes one archive of gzip members, one for each record, and returns its index rows: file, offset, length, URL and
digest. The index is a written table, and only a task that ended well has rows there; what a lost executor left behind is never
looked at. Reading takes any selection of index rows, sorts them by file and offset, merges neighbouring ranges into single
reads of at most MAX_READ bytes, and checks every payload against its digest.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilum.llm._store import drop_at_end, new_folder, written

MIN_REVISIT_BYTES = 0
DATE = "2000-01-01T00:00:00Z"
LEVEL = 1
MAX_GAP, MAX_READ = 64 << 10, 8 << 20
INDEX = "page_id long, url string, digest string, file string, offset long, length long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
_ID = "urn:veilum:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder, and the folder's path there. Hadoop's names of a store are read as pyarrow's."""
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", re.sub("^(?:file:/+|/)", "file:///", folder)))


def _line(text: str) -> str:
    """A header value: control characters percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, date: str = DATE) -> bytes:
    """One record, uncompressed. ``first``: the page it revisits, or None for a response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + payload if first is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <{_ID}{'none' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if first is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_ID}{first}>"]
    return "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's fields; ValueError if it is cut short or its payload doesn't have its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = body.partition(b"\r\n\r\n")
    number = lambda name: None if (x := fields[name][len(_ID) + 1 : -1]) == "none" else int(x)
    out = {"page_id": number("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "record_type": fields["WARC-Type"], "refers_to": None, "payload": None}
    out["payload_bytes"] = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if out["record_type"] == "revisit":
        out["refers_to"] = number("WARC-Refers-To")
    elif len(payload) != out["payload_bytes"] or base32(hashlib.sha1(payload).digest()) != out["payload_digest"]:
        raise ValueError("a payload differs from its digest")
    else:
        out["payload"] = payload
    return out


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _archive(folder: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = stream = None
        name, at = f"{uuid.uuid4().hex}.warc.gz", 0  # another attempt writes another file
        try:
            for batch in batches:
                if stream is None:
                    store, path = open_store(folder)
                    store.create_dir(path, recursive=True)
                    stream = store.open_output_stream(f"{path}/{name}", compression=None, buffer_size=1 << 20)
                out = {k: [] for k in ("digest", "offset", "length")}
                columns = [batch.column(c) for c in ("page_id", "url", "digest", "refers_to")]
                html = batch.column("html").cast(pa.binary())
                for page_id, url, digest, first, payload in zip(*(c.to_pylist() for c in columns), html.to_pylist(), strict=True):
                    digest = base32(bytes.fromhex(digest))
                    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    data = packer.compress(record(page_id, url, payload or b"", digest, first)) + packer.flush()
                    stream.write(data)
                    out["digest"].append(digest)
                    out["offset"].append(at)
                    out["length"].append(len(data))
                    at += len(data)
                yield pa.RecordBatch.from_arrays(
                    [columns[0], columns[1], pa.array(out["digest"], pa.string()), pa.array([name] * batch.num_rows, pa.string()), pa.array(out["offset"], pa.int64()), pa.array(out["length"], pa.int64())],
                    ["page_id", "url", "digest", "file", "offset", "length"],
                )
        finally:
            if stream is not None:
                stream.close()

    return rows


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write all rows of ``pages`` (page_id, url, html) under ``folder``; returns the index, a written table.

    Of records with equal payloads of at least ``min_revisit_bytes`` bytes, that with the smallest page_id is a response (all
    of them, if the row is repeated) and the others revisit it; shorter ones are responses, and so are rows without a
    page_id. A null html is an empty payload, a null url is left out of the record.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    keyed = rows.where(F.octet_length("html") >= min_revisit_bytes).select("page_id", "digest")
    shared = keyed.groupBy(F.col("digest").alias("__v_digest")).agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = keyed.join(shared, F.col("digest") == F.col("__v_digest")).where("page_id != refers_to").select(F.col("page_id").alias("__v_page"), "__v_digest", "refers_to").distinct()
    again = written(again, "revisits")
    records = rows.join(again, (F.col("page_id") == F.col("__v_page")) & (F.col("digest") == F.col("__v_digest")), "left").select("page_id", "url", "html", "digest", "refers_to")
    return written(records.mapInArrow(_archive(f"{folder}/archive"), INDEX), "index", f"{folder}/index")


def _read(folder: str, with_payload: bool):
    def fetch(store, path: str, group: list[tuple[str, int, int]]) -> list[dict]:
        with store.open_input_file(f"{path}/{group[0][0]}") as source:
            start = group[0][1]
            data = source.read_at(group[-1][1] + group[-1][2] - start, start)
        return [parse(zlib.decompress(data[o - start : o - start + n], 31)) for _, o, n in group]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        names = [x.split()[0] for x in RECORD.split(", ")] + ["payload"] * with_payload
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            ranges = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))
            i = 0
            while i < len(ranges):
                j = i + 1
                while j < len(ranges) and ranges[j][0] == ranges[i][0] and ranges[j][1] - ranges[j - 1][1] - ranges[j - 1][2] <= MAX_GAP and ranges[j][1] + ranges[j][2] - ranges[i][1] <= MAX_READ:
                    j += 1
                found = fetch(store, path, ranges[i:j])
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], kinds[k]) for k, c in enumerate(names)], names)
                i = j

    return rows


def read_records(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of the selected index rows: page_id, url, payload_bytes, payload_digest, record_type, refers_to, and
    payload (binary; null for revisits). payload_bytes and payload_digest are those of the full payload."""
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = index.select("file", "offset", "length").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    return ranges.mapInArrow(_read(f"{folder}/archive", with_payload), RECORD + ", payload binary" * with_payload)


def op9(pages: DataFrame) -> DataFrame:
    folder = new_folder(pages.sparkSession, "warc")
    drop_at_end(pages.sparkSession, folder, missing=True)
    found = read_records(write_archives(pages, folder), folder, with_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: sha1 in base32: five bytes at a time give eight letters.
OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p),
b AS (SELECT *, list_transform(range(0, 4), lambda i: ('0x' || substr(h, (i * 10 + 1)::INT, 10))::BIGINT) AS fives FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((fives[(j // 8 + 1)::INT] >> (35 - 5 * (j % 8))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b
"""
