"""Text functions: detection view, word edges, markers, keyed hashes, canonical class names."""

from __future__ import annotations

import json
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

_IGNORED = set(range(0x200B, 0x2010)) | set(range(0x202A, 0x202F)) | set(range(0x2060, 0x2070)) | set(range(0xFE00, 0xFE10)) | {0xAD, 0x34F, 0x61C, 0x180E, 0xFEFF}


_VIEWS: dict[str, str] = {}


def _view(c: str) -> str:
    """What a character becomes in the detection view; remembered, as texts repeat few characters."""
    if c not in _VIEWS:
        code = ord(c)
        if code in _IGNORED:
            new = ""
        elif 0xFF01 <= code <= 0xFF5E:
            new = chr(code - 0xFEE0)
        elif unicodedata.category(c) == "Zs":
            new = " "
        elif code == 0x2011:
            new = "-"
        else:
            new = unicodedata.normalize("NFC", c)
        _VIEWS[c] = new
    return _VIEWS[c]


def normalize(text: str) -> tuple[str, list[tuple[int, int]] | None]:
    """Detection view of ``text`` and, for each of its UTF-8 bytes, the raw byte range it stands for (None if nothing changed)."""
    if text.isascii() or all(_view(c) == c for c in set(text)):
        return text, None
    out: list[str] = []
    spans: list[tuple[int, int]] = []
    at = 0
    for c in text:
        n, new = len(c.encode()), _view(c)
        out.append(new)
        size = len(new.encode())
        spans += [(at + i, at + i + 1) for i in range(n)] if new == c else [(at, at + n)] * size
        at += n
    view = "".join(out)
    return (text, None) if view == text else (view, spans)


def raw_range(spans: list[tuple[int, int]] | None, start: int, end: int) -> tuple[int, int] | None:
    """Raw byte range of the view's bytes [start, end); None if empty or outside."""
    if start >= end:
        return None
    if spans is None:
        return start, end
    return (spans[start][0], spans[end - 1][1]) if end <= len(spans) else None


def is_inside_word(text: str, at: int) -> bool:
    return 0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum()


def expand_to_word_edges(text: str, start: int, end: int) -> tuple[int, int]:
    while is_inside_word(text, start):
        start -= 1
    while is_inside_word(text, end):
        end += 1
    return start, end


_JOINED_AFTER, _JOINED_BEFORE = re.compile(r"[-'’][^\W\d_]{2,}(?!\d)"), re.compile(r"(?<![^\W_])[^\W\d_]+[-'’]$")


def extend_over_name_joiners(text: str, start: int, end: int) -> tuple[int, int]:
    """Over name parts joined by hyphen or apostrophe: two letters at least behind (no possessive), one before."""
    while m := _JOINED_AFTER.match(text, end):
        end = m.end()
    while m := _JOINED_BEFORE.search(text, max(0, start - 64), start):
        start = m.start()
    return start, end


def boundary_view(text: str) -> str:
    """Detection view with a blank wherever characters were dropped."""
    view, spans = normalize(text)
    if spans is None:
        return view
    out, at, end = [], 0, 0
    for c in view:
        if at and spans[at][0] > end:
            out.append(" ")
        out.append(c)
        at += len(c.encode())
        end = spans[at - 1][1]
    return "".join(out)


def fold(text: str) -> tuple[str, list[int]]:
    """Lower case, runs of white space as one blank, and for each character the place in the text it stands for."""
    out, at, blank = [], [], False
    for i, c in enumerate(text):
        if c.isspace():
            if not blank:
                out.append(" ")
                at.append(i)
            blank = True
            continue
        blank = False
        low = c.lower()
        out.append(low)
        at += [i] * len(low)
    return "".join(out), at


def word_spellings(word: str) -> list[str]:
    """A word as written, with capitals after each joint, and in capitals unless its own capitals are a brand's."""
    brand = any(a.islower() and b.isupper() for a, b in zip(word, word[1:], strict=False))
    title = re.sub(r"[^\W\d_]+", lambda m: m[0][0].upper() + m[0][1:].lower(), word)
    return list(dict.fromkeys([word, title, *([] if brand else [word.upper()])]))


def json_spelling(raw: str) -> str:
    """``json_escaped`` if the bytes, read inside a JSON string, spell another value; else ``plain``."""
    if "\\" not in raw:
        return "plain"
    try:
        return "json_escaped" if json.loads(f'"{raw}"') != raw else "plain"
    except ValueError:
        return "plain"


def opaque_identifier(key: str, namespace: str, value: Column) -> Column:
    """A keyed name for a value that nobody without the key can tell or forge: half a hash of the value, and half a hash
    of that half."""
    first = F.substring(hmac_sha256(key, F.concat(F.lit(f"{namespace}|0|"), value)), 1, 32)
    return F.concat(first, F.substring(hmac_sha256(key, F.concat(F.lit(f"{namespace}|1|"), first)), 1, 32))


def custom_class(name: str) -> str:
    """Canonical class of a custom name: lower snake case."""
    return "custom:" + re.sub("_+", "_", re.sub("[^a-z0-9]+", "_", name.strip().lower())).strip("_")


def class_label(c: Column) -> Column:
    """Class in token form: ``Email``, ``Custom:iban``."""
    return F.when(c.startswith("custom:"), F.concat(F.lit("Custom:"), F.substr(c, F.lit(8)))).otherwise(F.initcap(c))


def redaction_marker(c: Column) -> Column:
    """One-way marker of a class: lower case, colons kept, everything else that is no letter or digit a hyphen."""
    return F.concat(F.lit("[REDACTED:"), F.lower(F.regexp_replace(c, "[^A-Za-z0-9:]", "-")), F.lit("]"))


def is_redaction_marker(c: Column) -> Column:
    """Exactly one class marker (the bare ``[REDACTED]`` of a redact rule names no class and is none)."""
    return c.rlike(r"^\[REDACTED:[a-z0-9:-]+\]$")


def generalization(c: Column) -> Column:
    return F.concat(F.lit("["), F.upper(F.regexp_replace(c, "^custom:", "")), F.lit("]"))


def hmac_sha256(key: str, message: Column) -> Column:
    """Keyed hash of a string column, in hex, from Spark's own functions (keys up to one block)."""
    raw = key.encode()
    if len(raw) > 64:
        raise ValueError("key longer than a block")
    pad = lambda x: F.lit(bytes(b ^ x for b in raw.ljust(64, b"\0")))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def collapse_ascii_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[ \t\n\r\f]+", " "))


def normalized(c: Column) -> Column:
    """Detection view without spans, natively: ignorable characters, full-width ASCII, spaces, hyphen."""
    wide = "".join(chr(i) for i in range(0xFF01, 0xFF5F))
    thin = "".join(chr(i - 0xFEE0) for i in range(0xFF01, 0xFF5F))
    out = F.translate(c, wide + "‑", thin + "-")
    out = F.regexp_replace(out, "[   -   　]", " ")
    return F.regexp_replace(out, "[­͏؜᠎​-‏‪-‮⁠-⁯︀-️﻿]", "")


def repair_ocr(c: Column) -> Column:
    """No spaces around ``@`` and around the dots of a domain."""
    return F.regexp_replace(F.regexp_replace(c, r"([A-Za-z0-9._%+-]) ?@ ?([A-Za-z0-9])", "$1@$2"), r"(@[A-Za-z0-9-]+) ?\. ?([A-Za-z])", "$1.$2")
