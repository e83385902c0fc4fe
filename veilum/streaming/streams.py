"""The same detection on streams, request frames, answer deltas and a rate limit with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veilum.operators import audit, detect, dictionary, placeholders

MAX_FRAME = 16 << 20
REQUEST = "jsonrpc string, id string, method string, params map<string,string>"


def redacted_stream(docs: DataFrame, text: str = "text", tag: str | None = None, families=None, entries: list | None = None) -> DataFrame:
    """A stream (or table) of documents with spans, entries and redacted: no state, so the batch expressions as they are.

    ``entries``: a dictionary, scanned in the row as well.
    """
    if not entries:
        return placeholders.anonymize(detect.with_spans(docs, text, families=families), text, tag)
    found = detect.with_spans(dictionary.with_hits(docs, entries, text), text, "hits", families).drop("hits")
    return placeholders.anonymize(found, text, tag)


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """New files of a folder as rows path, text."""
    return spark.readStream.format("text").option("wholetext", "true").load(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def frames(lines: DataFrame, limit: int = MAX_FRAME) -> DataFrame:
    """``lines`` (value, one frame to a line): request, and error (a JSON-RPC code) where there is none. Blank lines go."""
    request = F.from_json("value", REQUEST, {"mode": "PERMISSIVE"})
    shape = F.trim("value")
    # A value that isn't an object is well-formed JSON but no request.
    parses = F.try_parse_json("value").isNotNull()
    error = (
        F.when(F.octet_length("value") > limit, -32600)
        .when(~parses, -32700)
        .when(~shape.startswith("{"), -32600)
        .when(~request["method"].isin("initialize", "ping", "tools/list", "tools/call") & ~request["method"].startswith("notifications/"), -32601)
    )
    return lines.where(F.length(shape) > 0).withColumn("error", error).withColumn("request", F.when(F.col("error").isNull(), request))


def answers(requests: DataFrame) -> DataFrame:
    """Answers to tool calls of ``frames``, whose size bounds the texts: id, tool, verdict, n_found, redacted."""
    calls = requests.where("error is null and request.method = 'tools/call'").select(
        F.col("request.id").alias("id"), F.col("request.params")["name"].alias("tool"), F.col("request.params")["text"].alias("text")
    )
    found = redacted_stream(calls)
    n = F.size("spans")
    return found.select("id", "tool", audit.verdict(n, F.lit(0)).alias("verdict"), n.alias("n_found"), F.when(F.col("tool") == "anonymize", F.col("redacted")).alias("redacted"))


def delta(line: Column) -> Column:
    """The piece of an answer that a server-sent line carries; empty for other lines, null for a line that isn't JSON."""
    data = F.trim(F.regexp_extract(F.trim(line), r"(?s)^data:(.*)$", 1))
    body = F.from_json(data, "choices array<struct<delta:struct<content:string,reasoning_content:string>>>")
    piece = F.get(body["choices"], F.lit(0))["delta"]
    text = F.coalesce(F.when(F.length(piece["content"]) > 0, piece["content"]), piece["reasoning_content"], F.lit(""))
    return F.when((data == "") | (data == "[DONE]"), "").when(F.try_parse_json(data).isNotNull(), text)


def rate_limited(events: DataFrame, per_minute: int, burst: int | None = None) -> DataFrame:
    """A stream of events (key, at) with allowed: a token bucket for each key, refilled by event time.

    The state is two numbers a key. Events of a batch are taken in order of time. One bucket for a whole service, as of a
    server of one process, is the same with one key for all events.
    """
    size, rate = float(burst if burst is not None else max(3, per_minute // 4)), per_minute / 60.0

    def bucket(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, stamp = state.get if state.exists else (size, None)
        rows = pd.concat(list(batches)).sort_values("at")
        allowed = []
        for at in rows["at"]:
            now = at.timestamp()
            tokens = min(size, tokens + max(0.0, now - (now if stamp is None else stamp)) * rate)
            stamp = now
            allowed.append(rate <= 0 or tokens >= 1.0)
            tokens -= 1.0 if allowed[-1] and rate > 0 else 0.0
        state.update((tokens, stamp))
        yield pd.DataFrame({"key": key[0], "at": rows["at"], "allowed": allowed})

    return events.select("key", "at").groupBy("key").applyInPandasWithState(
        bucket, "key string, at timestamp, allowed boolean", "tokens double, stamp double", "append", GroupStateTimeout.NoTimeout
    )


def counts_by_type(docs: DataFrame, at: str = "ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Spans of each type in windows of event time, over a stream with a time column and spans."""
    spans = docs.withWatermark(at, late).select(at, F.explode("spans").alias("s"))
    return spans.groupBy(F.window(at, window), F.col("s.type").alias("type")).count()
