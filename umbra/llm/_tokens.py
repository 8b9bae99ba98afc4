"""Exact token counts and ids of a tokenizers file, with the merging done by tiktoken's byte-pair core.

The core merges by rank, as the library does, several times as fast, and needs no memory of words. It gets the text
only where both are sure to see the same pieces; whatever holds a character beyond that goes through the library:

* ``Counter``: byte-level files. Whole stretches of text go to the core with the library's own pattern; stretches
  with rare characters, on whose kind two versions of Unicode may differ, go to the library.
* ``WordIds``: files that lower-case, drop white space and end words with a mark. The text's bytes are cut into
  pre-tokens by array, and a zero byte after each stands for the mark.

Long texts are cut where the pre-tokenization always cuts, so a piece of work has a bounded size whatever the text;
only a single run without any such place (letters without spaces, say) is one piece whatever its length.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa

#: Bytes (or characters) of text that are encoded together.
BATCH_BYTES = 2 << 20
_LOADED: dict[str, object] = {}
_COUNTERS: dict[str, "Counter"] = {}
_WORDS: dict[str, "WordIds"] = {}
#: A place before a space that follows something else, or between a letter and a digit, always ends a byte-level piece.
_SAFE = re.compile(r"(?<=[^\s])(?= )|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
#: Characters on whose kind (letter, number, space, other) versions of Unicode agree.
_RARE = re.compile("[^\x00-ɏΑ-ΡΣ-ωА-я‐-‧‰-⁞€一-龥ぁ-ゖァ-ヺ가-힣]")


def load(path: str):
    if path not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _LOADED[path] = tokenizer
    return _LOADED[path]


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones stand for themselves, the
    others, in order, are the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _merges(model: dict) -> list[tuple[str, str]]:
    return [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]


# counts of byte-level files -----------------------------------------------------------------------------------


class Counter:
    """Token counts for a byte-level tokenizer without normalizer or added prefix space."""

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            body = json.load(f)
        byte, model = _byte_of(), body["model"]
        raw = lambda s: bytes(byte[c] for c in s)
        ranks = {bytes([b]): b for b in range(256)}
        for k, (a, b) in enumerate(_merges(model)):
            ranks.setdefault(raw(a + b), 256 + k)
        self.special = {t["content"] for t in body["added_tokens"]}
        first = 256 + len(model["merges"])
        # fixed value: the pattern of byte-level pre-tokenization
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        core = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={t: first + i for i, t in enumerate(sorted(self.special))})
        self.core = core._core_bpe
        known = {raw(s): i for s, i in model["vocab"].items() if s not in self.special}
        ids = {t["content"]: t["id"] for t in body["added_tokens"]}
        self.id_of = np.zeros(first + len(ids), np.int32)
        for b, rank in ranks.items():
            self.id_of[rank] = known.get(b, 0)
        self.id_of[first:] = [ids[t] for t in sorted(self.special)]
        self.bytes_of = {i: b for b, i in known.items()} | {i: t.encode() for t, i in ids.items()}

    def _size(self, part: str) -> int:
        return len(np.frombuffer(self.core.encode_to_tiktoken_buffer(part, self.special), np.uint32))

    def count(self, text: str) -> int:
        return sum(len(load(self.path).encode(p, add_special_tokens=False).ids) if _RARE.search(p) else self._size(p) for p in safe_parts(text))

    def ids(self, text: str) -> list[int]:
        out: list[int] = []
        for p in safe_parts(text):
            out += load(self.path).encode(p, add_special_tokens=False).ids if _RARE.search(p) else self.id_of[np.frombuffer(self.core.encode_to_tiktoken_buffer(p, self.special), np.uint32)].tolist()
        return out

    def text(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode()


def safe_parts(text: str, most: int = BATCH_BYTES):
    """Parts of about ``most`` characters, cut at safe places; short stretches of rare characters stand alone."""
    at = 0
    while at < len(text):
        cut = _SAFE.search(text, at + most) if len(text) - at > most else None
        end = cut.start() if cut else len(text)
        rare = _RARE.search(text, at, end)
        if not rare:
            yield text[at:end]
        while rare:  # the word that holds it, and what stands before
            a = max(text.rfind(" ", at, rare.start()), at)
            while a > at and text[a - 1].isspace():
                a -= 1
            if a > at and not _SAFE.match(text, a):
                a = at
            b = _SAFE.search(text, rare.end(), end)
            b = b.start() if b else end
            if a > at:
                yield text[at:a]
            yield text[a:b]
            at = b
            rare = _RARE.search(text, at, end)
            if not rare and at < end:
                yield text[at:end]
        at = end


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def count_tokens(path: str, texts: list[str]) -> np.ndarray:
    """Token counts of whole texts."""
    count = counter(path).count
    return np.fromiter(map(count, texts), np.int64, len(texts))


# ids of files that keep words apart ---------------------------------------------------------------------------

_SPACE, _LETTER, _DIGIT, _OTHER, _HARD = range(5)


def _kinds() -> np.ndarray:
    kind = np.full(256, _HARD, np.uint8)
    kind[33:127] = _OTHER
    kind[[*range(65, 91), *range(97, 123)]] = _LETTER
    kind[48:58] = _DIGIT
    kind[[32, *range(9, 14)]] = _SPACE
    return kind


_KIND = _kinds()
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


class WordIds:
    """Ids for a tokenizer that lower-cases and keeps letters, single digits and other signs apart.

    Words of ASCII and Latin-1 letters are cut here; a word with any other character, or with the opening of a
    special token, goes to the library by itself, as words never share a token.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            body = json.load(f)
        byte, model = _byte_of(), body["model"]
        end = model["end_of_word_suffix"]

        def raw(s: str) -> bytes:
            return bytes(byte[c] for c in s.removesuffix(end)) + b"\0" * s.endswith(end)

        # the first merge of any word puts the mark on its last byte
        ranks = {bytes([b]): b for b in range(256)} | {bytes([b, 0]): 256 + b for b in range(256)}
        for k, (a, b) in enumerate(_merges(model)):
            ranks.setdefault(raw(a + b), 512 + k)
        self.id_of = np.zeros(512 + len(model["merges"]), np.uint32)
        self.ends = np.zeros(len(self.id_of), bool)
        special = {t["content"] for t in body["added_tokens"]}
        known = {raw(s): i for s, i in model["vocab"].items() if s not in special}
        for word, rank in ranks.items():
            self.id_of[rank] = known.get(word, 0)
            self.ends[rank] = rank >= 256 and word[-1] == 0
        self.stand_in = ranks[b"\1\0"]
        self.core = tiktoken.Encoding("own", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})._core_bpe

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts that lie between the offsets of some UTF-8 bytes, and each text's number of ids."""
        marks = set(offsets[1:-1].tolist())
        bounds = np.array(sorted(marks.union(*(_spaces(data, a, b) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) if b - a > BATCH_BYTES), (int(offsets[0]), int(offsets[-1])))), np.int64)
        flat, sizes = [], np.zeros(len(bounds), np.int64)
        i = 0
        while i < len(bounds) - 1:  # stretches of whole parts, about BATCH_BYTES each
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + BATCH_BYTES, side="right")) - 1)
            ids, n = self._encode(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
            flat.append(ids)
            sizes[i:j] = n
            i = j
        before = np.concatenate([[0], np.cumsum(sizes)])
        at = before[np.searchsorted(bounds, offsets)]
        return np.concatenate(flat) if flat else np.zeros(0, np.uint32), np.diff(at)

    def _encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(bounds) - 1, np.int64)
        kind, low = _KIND[data], _LOWER[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        if len(lead):  # Latin-1 letters: two bytes, but for the signs of multiplication and division
            tail = data[lead + 1]
            lead, tail = (x[(tail != 0x97) & (tail != 0xB7)] for x in (lead, tail))
            kind[lead] = kind[lead + 1] = _LETTER
            low[lead + 1] += 32 * ((tail >= 0x80) & (tail < 0x9F)).astype(np.uint8)
        angle = np.flatnonzero(data[:-1] == 60)
        kind[angle[data[angle + 1] == 124]] = _HARD
        first = np.zeros(n + 1, bool)  # of a text
        first[bounds] = True
        word = kind != _SPACE
        hard: list[bytes] = []
        if (kind == _HARD).any():
            opens = word & (first[:n] | ~np.concatenate([[False], word[:-1]]))
            starts = np.flatnonzero(opens)
            of = np.cumsum(opens) - 1
            bad = np.unique(of[kind == _HARD])
            shut = np.flatnonzero(word & (first[1:] | ~np.concatenate([word[1:], [False]])))
            for a, b in zip(starts[bad].tolist(), (shut[bad] + 1).tolist(), strict=True):
                hard.append(data[a:b].tobytes())
                word[a + 1 : b] = False
                kind[a:b], low[a] = _HARD, 1
        at = np.flatnonzero(word)
        k, l, new = kind[at], low[at], first[at]  # noqa: E741
        # runs are broken by spaces, which are left out here, and by texts
        gap = np.ones(len(at), bool)
        gap[:-1] = (at[1:] - at[:-1] > 1) | new[1:]
        end = gap.copy()
        end[:-1] |= (k[1:] != k[:-1]) | (k[1:] == _DIGIT) | (k[1:] == _HARD)
        quote = np.flatnonzero(l[:-1] == 39)
        if len(quote):  # 's 't 'm 'd 're 've 'll, where the quote opens a run of signs
            quote = quote[((quote == 0) | end[quote - 1]) & ~gap[quote]]
            after = l[quote + 1]
            two = quote[np.isin(after, (115, 116, 109, 100))]
            more = quote[(quote + 2 < len(l)) & np.isin(after, (114, 118, 108))]
            second, third = l[more + 1], l[np.minimum(more + 2, len(l) - 1)]
            more = more[~gap[more + 1] & (((second != 108) & (third == 101)) | ((second == 108) & (third == 108)))]
            end[two], end[two + 1] = False, True
            end[more], end[more + 1], end[more + 2] = False, False, True
        place = np.arange(len(at)) + np.cumsum(end) - end
        marked = np.zeros(len(at) + int(end.sum()), np.uint8)
        marked[place] = l
        ranks = np.frombuffer(self.core.encode_to_tiktoken_buffer(marked.tobytes().decode(), set()), np.uint32)
        ids, sizes = self.id_of[ranks], None
        if hard:
            holes = np.flatnonzero(ranks == self.stand_in)
            found = [np.array(e.ids, np.uint32) for e in load(self.path).encode_batch([h.decode() for h in hard], add_special_tokens=False)]
            sizes = np.ones(len(ranks), np.int64)
            sizes[holes] = [len(f) for f in found]
            ids = np.repeat(ids, sizes)
            to = (np.cumsum(sizes) - sizes)[holes]
            for a, f in zip(to.tolist(), found, strict=True):
                ids[a : a + len(f)] = f
        # ids up to each text's last pre-token
        closed = np.flatnonzero(self.ends[ranks]) + 1
        upto = np.concatenate([[0], closed if sizes is None else np.cumsum(sizes)[closed - 1]])
        pre_tokens = np.concatenate([[0], np.cumsum(end)])[np.searchsorted(at, bounds)]
        return ids, np.diff(upto[pre_tokens])


def _spaces(data: np.ndarray, a: int, b: int) -> list[int]:
    """Places of spaces, about BATCH_BYTES apart, at which the long text in [a, b) is cut."""
    out, at = [], a + BATCH_BYTES
    while at < b:
        step = 1 << 16
        while at < b and not (free := np.flatnonzero(data[at : min(b, at + step)] == 32)).size:
            at += step
        if at >= b:
            break
        out.append(at + int(free[0]))
        at = out[-1] + BATCH_BYTES
    return out


def word_ids(path: str) -> WordIds:
    if path not in _WORDS:
        _WORDS[path] = WordIds(path)
    return _WORDS[path]


# batches ------------------------------------------------------------------------------------------------------


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column without nulls, without a copy."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, body = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)), at


def by_bytes(offsets: np.ndarray, most: int = BATCH_BYTES) -> list[tuple[int, int]]:
    """Consecutive ranges of texts with about ``most`` bytes each, one text at least."""
    ranges, i, last = [], 0, len(offsets) - 1
    while i < last:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        ranges.append((i, j))
        i = j
    return ranges
