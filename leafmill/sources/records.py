"""Records: JSON text to rows, one for every scalar and every empty container.

No JSON function of Spark keeps a number as it was written (0.010 becomes 0.01), so the parser is Python's, with hooks
that keep every literal, in Arrow batches.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.constants import MAX_DEPTH, PATH_TYPE

_PATH = pa.list_(pa.struct([("key", pa.string()), ("index", pa.int64())]))
_SCHEMA = pa.schema([("record_id", pa.string()), ("position", pa.int32()), ("path", _PATH), ("json_kind", pa.string()), ("literal", pa.string()), ("reason", pa.string())])


class Rejected(Exception):
    """Holds a reason code."""


class _Number(str):
    pass


def _object(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise Rejected("duplicate-key")
    return out


def _constant(_: str):
    raise Rejected("non-finite-number")


_DECODER = json.JSONDecoder(parse_int=_Number, parse_float=_Number, parse_constant=_constant, object_pairs_hook=_object)


def parse(text: str):
    """A JSON document with numbers as written. Raises Rejected with a reason code."""
    try:
        return _DECODER.decode(text)
    except Rejected:
        raise
    except RecursionError:
        raise Rejected("json-syntax") from None
    except ValueError:
        raise Rejected("json-syntax") from None


_ESCAPES = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"} | {chr(c): f"\\u{c:04x}" for c in range(32) if chr(c) not in "\b\f\n\r\t"}


_SPECIAL = re.compile('["\\\\\x00-\x1f\ud800-\udfff]').search


def quoted(s: str) -> str:
    if not _SPECIAL(s):
        return f'"{s}"'
    if any("\ud800" <= c <= "\udfff" for c in s):
        raise Rejected("unpaired-surrogate")
    return '"' + "".join(_ESCAPES.get(c, c) for c in s) + '"'


def write(node, indent: int = 0, depth: int = 0) -> str:
    """JSON text of a parsed document; numbers as they were written, members in their order."""
    if isinstance(node, (dict, list)) and node:
        gap, last = (("\n" + " " * (indent * (depth + 1)), "\n" + " " * (indent * depth)) if indent else ("", ""))
        if isinstance(node, dict):
            items = [f"{quoted(k)}:{' ' if indent else ''}{write(v, indent, depth + 1)}" for k, v in node.items()]
        else:
            items = [write(v, indent, depth + 1) for v in node]
        body = gap + f",{gap}".join(items) + last
        return f"{{{body}}}" if isinstance(node, dict) else f"[{body}]"
    k = kind(node)
    return {"null": "null", "array": "[]", "object": "{}"}.get(k) or (str(node).lower() if k == "boolean" else str(node) if k == "number" else quoted(node))


def decoded(data: bytes | str) -> str:
    """Strict UTF-8."""
    try:
        return data if isinstance(data, str) else data.decode()
    except UnicodeDecodeError:
        raise Rejected("json-syntax") from None


def rewritten(records: DataFrame, indent: int = 0) -> DataFrame:
    """records (record_id, record_json) as ``write`` writes them again: record_id, record_json, reason."""
    schema = pa.schema([("record_id", pa.string()), ("record_json", pa.string()), ("reason", pa.string())])

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for record_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    if text is None:
                        raise Rejected("json-syntax")
                    out.append((record_id, write(parse(decoded(text)), indent), None))
                except Rejected as e:
                    out.append((record_id, None, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    return records.select(F.col("record_id").cast("string").alias("record_id"), "record_json").mapInArrow(run, "record_id string, record_json string, reason string")


def kind(node) -> str:
    return "number" if isinstance(node, _Number) else "string" if isinstance(node, str) else "boolean" if isinstance(node, bool) else "null" if node is None else "array" if isinstance(node, list) else "object"


def segments(path) -> list[dict]:
    """A path of keys (text) and indices (whole numbers) as Arrow has it."""
    return [{"key": s, "index": None} if isinstance(s, str) else {"key": None, "index": s} for s in path]


_SURROGATE = re.compile("[\ud800-\udfff]").search


def walk(node, path: tuple = ()):
    """(path, kind, literal) depth first, paths of keys and indices; an empty root is one leaf at the empty path."""
    stack = [(node, path)]
    while stack:
        node, path = stack.pop()
        if len(path) > MAX_DEPTH:
            raise Rejected("json-syntax")
        if isinstance(node, dict) and node:
            stack += [(v, (*path, k)) for k, v in reversed(node.items())]
        elif isinstance(node, list) and node:
            stack += [(v, (*path, i)) for i, v in reversed(list(enumerate(node)))]
        else:
            k = kind(node)
            literal = None if k in ("null", "array", "object") else str(node).lower() if k == "boolean" else str(node)
            for s in (literal, *path):
                if isinstance(s, str) and _SURROGATE(s):
                    raise Rejected("unpaired-surrogate")
            yield path, k, literal


def flatten(records: DataFrame) -> DataFrame:
    """records: record_id, record_json (text, or bytes in strict UTF-8). Rows: record_id, position, path, json_kind, literal,
    reason. A record that isn't strict JSON, or null, has one row with a reason and no path."""

    def run(batches):
        for batch in batches:
            rows: dict[str, list] = {n: [] for n in _SCHEMA.names}
            for record_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    if text is None:
                        raise Rejected("json-syntax")
                    found = [(record_id, i, segments(p), k, v, None) for i, (p, k, v) in enumerate(walk(parse(decoded(text))))]
                except Rejected as e:
                    found = [(record_id, 0, None, None, None, str(e))]
                for row in found:
                    for n, v in zip(_SCHEMA.names, row, strict=True):
                        rows[n].append(v)
            yield pa.RecordBatch.from_pydict(rows, _SCHEMA)

    return records.select(F.col("record_id").cast("string").alias("record_id"), "record_json").mapInArrow(run, f"record_id string, position int, path {PATH_TYPE}, json_kind string, literal string, reason string")
