"""Pieces of DuckDB SQL that the oracles share."""

from __future__ import annotations

from veilum.functions import patterns as P

WORD = r"[^\p{L}\p{N}_"
EMAIL = P.EMAIL
#: RE2 has no look-around: what must stand around a value is matched too, and the value is group 1.
IPV4 = r"(?:^|[^\p{L}\p{N}_.])((?:[0-9]{1,3}\.){3}[0-9]{1,3})(?:$|[^\p{L}\p{N}_.]|\.(?:$|[^\p{L}\p{N}_]))"
HOST = rf"(?:^|[^\p{{L}}\p{{N}}_.\-])((?:{P.LABEL}\.)+[A-Za-z]{{2,63}})(?:$|[^\p{{L}}\p{{N}}_.\-]|\.(?:$|[^\p{{L}}\p{{N}}_]))"
ASSIGNED = (
    r"(?:^|[^A-Za-z0-9])(?:[A-Za-z0-9]+[_-])?(?i:api[_-]?key|apikey|secret|client[_-]?secret|password|passwd|pwd|token|access[_-]?token|refresh[_-]?token)"
    r"\s*[:=]\s*[\"']?([A-Za-z0-9._\-+/=]{8,})"
)
URL = r"(?i)(?:(?:https?|ftp|sftp)://|www\.)[^\s<>\"'()\[\]{}]+"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def located(name: str, table: str, key: str, text: str, pattern: str, group: int = 0) -> str:
    """CTEs: ``name`` has key, t, start, "end", value of each match."""
    rx = quote(pattern)
    at = "length(m0) - length(value)" if group and pattern is ASSIGNED else "strpos(m0, value) - 1"
    return f"""
{name}_m AS (SELECT {key}, {text} AS t, regexp_extract_all({text}, {rx}, 0) AS f, regexp_extract_all({text}, {rx}, {group}) AS v, string_split_regex({text}, {rx}) AS g FROM {table}),
{name}_k AS (SELECT {key}, t, f, v, g, unnest(range(1, len(f) + 1)) AS k FROM {name}_m),
{name}_s AS (SELECT {key}, t, f[k] AS m0, v[k] AS value, coalesce(list_sum(list_transform(g[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(f[1:k - 1], lambda x: length(x))), 0) AS s FROM {name}_k),
{name} AS (SELECT {key}, t, (s + {at})::INT AS start, (s + {at} + length(value))::INT AS "end", value FROM {name}_s)"""


def in_list(values) -> str:
    return "(" + ", ".join(quote(v) for v in values) + ")"


OCTETS = "list_sum(list_transform(string_split(value, '.'), lambda o: CASE WHEN o::INT <= 255 AND o::INT::VARCHAR = o THEN 0 ELSE 1 END)) = 0"
ADDRESS = "list_reduce(list_transform(string_split(value, '.'), lambda o: o::BIGINT), lambda a, b: a * 256 + b)"


def _safe_net() -> str:
    import ipaddress

    nets = [ipaddress.ip_network(n) for n in P.SAFE_NETS]
    return " OR ".join(f"{ADDRESS} BETWEEN {int(n.network_address)} AND {int(n.broadcast_address)}" for n in nets)


TLDS = in_list(t for t in P.HOST_TLDS if t not in P.FILE_ENDINGS)
SAFE_NAME = f"(lower(value) IN {in_list(P.SAFE_EXACT)} OR " + " OR ".join(f"ends_with(lower(value), '{s}')" for s in P.SAFE_SUFFIXES) + ")"


def spans(table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """CTEs ending in spans (key, t, start, "end", type, value): the rules that have matches in the driver's texts."""
    return f"""
{located('e', table, key, text, EMAIL)},
{located('k', table, key, text, ASSIGNED, 1)},
{located('i', table, key, text, IPV4, 1)},
{located('h', table, key, text, HOST, 1)},
strong AS (
  SELECT {key}, t, start, "end", 'EMAIL' AS type, value FROM e
    WHERE lower(regexp_extract(value, '[^@]*$')) NOT IN {in_list(P.SAFE_EXACT)}
  UNION ALL SELECT {key}, t, start, "end", 'KEY', value FROM k
    WHERE lower(value) NOT IN {in_list(P.DUMMY_SECRETS)} AND NOT regexp_matches(lower(value), {quote(P.DUMMY_PREFIX)}) AND substr(t, "end" + 1, 1) <> '('
  UNION ALL SELECT {key}, t, start, "end", 'IP', value FROM i WHERE {OCTETS} AND NOT ({_safe_net()})),
spans AS (
  SELECT * FROM strong
  UNION ALL SELECT {key}, t, start, "end", 'HOST', value FROM h WHERE lower(regexp_extract(value, '[^.]*$')) IN {TLDS} AND NOT {SAFE_NAME}
    AND NOT EXISTS (SELECT 1 FROM strong s WHERE s.{key} = h.{key} AND s.start < h."end" AND h.start < s."end"))"""


def numbered(table: str = "documents", key: str = "doc_id", text: str = "text", tag: str = "") -> str:
    """CTEs ending in numbered (key, type, value, n, placeholder)."""
    tail = f"-{tag}" if tag else ""
    return f"""{spans(table, key, text)},
firsts AS (SELECT {key}, type, value, min(start) AS first FROM spans GROUP BY ALL),
numbered AS (SELECT {key}, type, value, n, '[' || type || '-' || n || '{tail}]' AS placeholder
  FROM (SELECT *, row_number() OVER (PARTITION BY {key}, type ORDER BY first) AS n FROM firsts))"""


def redacted(table: str = "documents", key: str = "doc_id", text: str = "text", tag: str = "") -> str:
    """CTEs ending in redacted (key, t, redacted) of texts with spans."""
    return f"""{numbered(table, key, text, tag)},
pieces AS (SELECT s.{key}, s.t, s.start, s."end", substr(s.t, before + 1, s.start - before) || n.placeholder AS piece
  FROM (SELECT *, coalesce(lag("end") OVER (PARTITION BY {key} ORDER BY start), 0) AS before FROM spans) s JOIN numbered n USING ({key}, type, value)),
redacted AS (SELECT {key}, any_value(t) AS t, string_agg(piece, '' ORDER BY start) || substr(any_value(t), max("end") + 1) AS redacted FROM pieces GROUP BY {key})"""


def values(rows, columns: str) -> str:
    """A VALUES table; None is null, booleans and numbers are as they are."""

    def one(x):
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).lower()
        if isinstance(x, (int, float)):
            return str(x)
        return quote(x)

    return "(VALUES " + ", ".join("(" + ", ".join(one(x) for x in row) + ")" for row in rows) + f") AS v({columns})"
