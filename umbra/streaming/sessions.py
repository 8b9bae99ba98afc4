"""Session-keyed protection of streams: values keep their tokens while a session lives.

State is (class, raw) to token by session, dropped when a session has been idle for the timeout in processing
time. Spark has no least-recently-used cap for state; the idle timeout bounds it instead.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from umbra.operators import engine

OUT = "session_id string, seq long, clean_text string, new_tokens int"
STATE = "classes array<string>, raws array<string>, tokens array<string>"


def token(session: str, cls: str, ordinal: int, key: str = "umbra") -> str:
    label = "Custom:" + cls[7:] if cls.startswith("custom:") else cls.capitalize()
    return f"<{hashlib.sha256(f'{key}|{session}'.encode()).hexdigest()[:8]}:{label}_{ordinal}>"


def clean_one(session: str, text: str, known: dict[tuple[str, str], str]) -> tuple[str, int]:
    """Clean text and the number of new tokens; ``known`` grows."""
    primary, recovered, cells, _, _ = engine.protect(text, session=[(c, r) for c, r in known if not c.startswith("custom:family:")])
    data, out, at, new = text.encode(), [], 0, 0
    counts: dict[str, int] = {}
    for c, _ in known:
        counts[c] = counts.get(c, 0) + 1
    spans = {}
    for c in (*primary, *recovered, *cells):
        raw = data[c.start : c.end].decode(errors="replace")
        if (c.cls, raw) not in known:
            counts[c.cls] = counts.get(c.cls, 0) + 1
            known[c.cls, raw] = token(session, c.cls, counts[c.cls])
            new += 1
        spans[c.start, c.end] = known[c.cls, raw]
    for (a, b), t in sorted(spans.items()):
        out += [data[at:a], t.encode()]
        at = b
    return b"".join([*out, data[at:]]).decode(errors="replace"), new


def clean_stream(frames: DataFrame, idle_ms: int = 600_000) -> DataFrame:
    """session_id, seq, clean_text and new_tokens of frames (session_id, seq, text)."""

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        kept = state.get if state.exists else ([], [], [])
        known = {(c, r): t for c, r, t in zip(*kept, strict=True)}
        rows = pd.concat(list(frames)).sort_values("seq")
        out = [(key[0], int(r.seq), *clean_one(key[0], r.text or "", known)) for r in rows.itertuples()]
        state.update(([c for c, _ in known], [r for _, r in known], list(known.values())))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["session_id", "seq", "clean_text", "new_tokens"])

    return frames.select("session_id", "seq", "text").groupBy("session_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
