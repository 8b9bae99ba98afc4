"""The engine does each piece of work once, and skips only what can't match."""

import unicodedata

from umbra.functions import text as tx
from umbra.operators import engine
from umbra.operators.rules import CORE, admitted


def test_a_rule_scans_a_document_once(monkeypatch):
    scanned = []
    once = engine.scan_rule
    monkeypatch.setattr(engine, "scan_rule", lambda rule, *more: scanned.append(rule.id) or once(rule, *more))
    engine.protect("mail a@b.example, card 4111 1111 1111 1111", ("de-DE", "en-US", "global"))
    assert len(scanned) == len(set(scanned)) and set(scanned) >= {r.id for r in admitted(CORE, ())}


def test_prose_without_digits_is_searched_by_few_rules():
    text = "she told the ground staff that gentlemen born in tinsel town hold taxes, ids and passes. " * 5
    low = text.lower()
    tried = [r.id for r in CORE if engine.possible(r, text, low, False)]
    assert not tried, tried


def test_view_and_offsets():
    for text in ("plain é ü 漢字", "a​b ｘ é", "‑Ω가", ""):
        view, spans = tx.normalize(text)
        want = "".join("" if c == "​" else "-" if c == "‑" else unicodedata.normalize("NFC", chr(ord(c) - 0xFEE0) if 0xFF01 <= ord(c) <= 0xFF5E else " " if unicodedata.category(c) == "Zs" else c) for c in text)
        assert view == want and (spans is None) == (view == text)
        assert engine._byte_offsets(view, set(range(len(view) + 1))) == {i: len(view[:i].encode()) for i in range(len(view) + 1)}
