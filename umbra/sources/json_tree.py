"""Strict JSON with a byte span and a path for every node: duplicate keys, lone surrogates, trailing bytes and excess are errors."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of a body, nesting, nodes, bytes of a string and of a number.
LIMITS = {"body": 32 << 20, "depth": 128, "nodes": 100_000, "string": 4 << 20, "number": 128}
_STRING = re.compile(rb'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"')
_NUMBER = re.compile(rb"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_SPACE = re.compile(rb"[ \t\n\r]*")
_WORDS = {b"true": ("bool", "true"), b"false": ("bool", "false"), b"null": ("null", None)}


class JsonError(ValueError):
    pass


def _string(data: bytes, at: int) -> tuple[str, int]:
    m = _STRING.match(data, at)
    if not m or m.end() - at > LIMITS["string"]:
        raise JsonError(f"bad string at {at}")
    value = json.loads(m[0].decode("utf-8"))
    try:
        value.encode()
    except UnicodeEncodeError as e:
        raise JsonError(f"lone surrogate at {at}") from e
    return value, m.end()


def nodes(text: str) -> Iterator[tuple[str, int, int, int, str, str | None]]:
    """(path, depth, start, end, type, value) of every node, containers after their children."""
    data = text.encode()
    if len(data) > LIMITS["body"]:
        raise JsonError("body too long")
    skip = lambda i: _SPACE.match(data, i).end()
    at, count = skip(0), 0
    stack: list[list] = []  # path, start, kind, keys or index, waiting for a value
    path = "$"
    while True:
        count += 1
        if count > LIMITS["nodes"] or len(stack) > LIMITS["depth"]:
            raise JsonError("too many nodes or too deep")
        c = data[at : at + 1]
        if c in (b"{", b"["):
            stack.append([path, at, c, set() if c == b"{" else 0])
            at = skip(at + 1)
            if data[at : at + 1] != (b"}" if c == b"{" else b"]"):
                path, at = _enter(data, stack[-1], at, skip)
                continue
        elif c == b'"':
            value, end = _string(data, at)
            yield path, len(stack), at, end, "string", value
            at = end
        elif word := next((w for w in _WORDS if data.startswith(w, at)), None):
            yield path, len(stack), at, at + len(word), *_WORDS[word]
            at += len(word)
        elif (m := _NUMBER.match(data, at)) and m[0] and len(m[0]) <= LIMITS["number"]:
            yield path, len(stack), at, m.end(), "number", m[0].decode()
            at = m.end()
        else:
            raise JsonError(f"unexpected byte at {at}")
        while True:
            at = skip(at)
            if not stack:
                if at != len(data):
                    raise JsonError("trailing bytes")
                return
            top = stack[-1]
            if data[at : at + 1] == b",":
                path, at = _enter(data, top, skip(at + 1), skip)
                break
            if data[at : at + 1] != (b"}" if top[2] == b"{" else b"]"):
                raise JsonError(f"expected an end at {at}")
            at += 1
            stack.pop()
            yield top[0], len(stack), top[1], at, "object" if top[2] == b"{" else "array", None


def _enter(data: bytes, top: list, at: int, skip) -> tuple[str, int]:
    if top[2] == b"[":
        top[3] += 1
        return f"{top[0]}[{top[3] - 1}]", at
    if data[at : at + 1] != b'"':
        raise JsonError(f"expected a key at {at}")
    key, end = _string(data, at)
    if key in top[3]:
        raise JsonError(f"duplicate key at {at}")
    top[3].add(key)
    at = skip(end)
    if data[at : at + 1] != b":":
        raise JsonError(f"expected a colon at {at}")
    return f"{top[0]}.{key}", skip(at + 1)


def json_nodes(rows: DataFrame, key: str, column: str) -> DataFrame:
    """One row a node; a body that breaks a rule gives one row with its error."""
    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, path string, depth int, start int, `end` int, json_type string, value string, error string"

    def run(batches):
        for batch in batches:
            at, out = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if text is None:
                    continue
                try:
                    found = [(*n, None) for n in nodes(text)]
                except JsonError as e:
                    found = [(None, None, None, None, None, None, str(e))]
                out += found
                at += [i] * len(found)
            if out:
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names=[key, "path", "depth", "start", "end", "json_type", "value", "error"])

    return rows.select(key, column).mapInArrow(run, schema)
