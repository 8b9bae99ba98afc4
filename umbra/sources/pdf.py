"""Text of PDF files that carry text: content streams are inflated and their show operators read, line by line.

Only what needs no font program is read: literal and hexadecimal strings in simple encodings. A page without any is
reported as a picture, to be recognized elsewhere.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame

_OBJECT = re.compile(rb"(\d+) (\d+) obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", re.S)
_SHOWN = re.compile(rb"\((?:[^\\()]|\\.)*\)|<[0-9A-Fa-f\s]*>|\[|\]|-?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|.)", re.S)
#: Escapes of literal strings.
_NAMED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _string(raw: bytes) -> str:
    if raw[:1] == b"<":
        digits = re.sub(rb"\s", b"", raw[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("latin-1")
    return _ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _NAMED.get(m[1], m[1]), raw[1:-1]).decode("latin-1")


def shown_text(content: bytes) -> str:
    """Text of one content stream: strings as shown, a new line at each move to another line, a blank at wide gaps."""
    out: list[str] = []
    held: list = []
    for m in _SHOWN.finditer(content):
        token = m[0]
        if token[:1] in b"(<":
            held.append(_string(token))
        elif token in (b"Tj", b"TJ", b"'", b'"'):
            if token in (b"'", b'"'):
                out.append("\n")
            out += [x if isinstance(x, str) else " " if x < -200 else "" for x in held if isinstance(x, str) or token == b"TJ"]
            held = []
        elif re.fullmatch(rb"-?\d*\.?\d+", token):
            held.append(float(token))
        elif token not in (b"[", b"]"):
            if token in (b"Td", b"TD") and len(held) > 1 and held[-1] != 0 or token in (b"T*", b"ET"):
                out.append("\n")
            held = []
    return "\n".join(x.strip() for x in "".join(out).split("\n") if x.strip())


def pages(data: bytes) -> list[str]:
    """Text of each page in order, empty for one without any."""
    objects = {int(n): body for n, _, body in _OBJECT.findall(data)}

    def stream(n: int) -> bytes:
        m = _STREAM.search(objects.get(n, b""))
        if not m:
            return b""
        return zlib.decompress(m[2]) if b"FlateDecode" in m[1] else m[2]

    kids = {n: [int(k) for k in re.findall(rb"(\d+) \d+ R", m[1])] for n, body in objects.items() if (m := re.search(rb"/Kids\s*\[(.*?)\]", body, re.S))}
    leaves = [n for n, body in objects.items() if re.search(rb"/Type\s*/Page\b", body)]
    roots = [n for n in kids if not any(n in k for k in kids.values())]
    order: list[int] = []
    stack = list(reversed(roots))
    while stack:
        n = stack.pop()
        if n in kids:
            stack += reversed(kids[n])
        elif n in leaves:
            order.append(n)
    out = []
    for n in order or sorted(leaves):
        m = re.search(rb"/Contents\s*(\[.*?\]|\d+ \d+ R)", objects[n], re.S)
        refs = [int(k) for k in re.findall(rb"(\d+) \d+ R", m[1])] if m else []
        out.append("\n".join(t for t in (shown_text(stream(r)) for r in refs) if t))
    return out


def extract(files: DataFrame) -> DataFrame:
    """path, page, text and payload (vector or raster) of the PDF files among binary files (path, content)."""

    def run(batches):
        for batch in batches:
            out = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out += [(path, i, text or None, "vector" if text else "raster") for i, text in enumerate(pages(data), 1)] if data[:4] == b"%PDF" else []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["path", "page", "text", "payload"])

    return files.select("path", "content").mapInArrow(run, "path string, page int, text string, payload string")
