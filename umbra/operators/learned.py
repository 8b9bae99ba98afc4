"""Learned detectors as plug-ins: windows over pieces, labels to spans, scores to verdicts. No model is bundled; a plug-in
is a function from texts to scored pieces, and everything around it is here."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from umbra.functions import text as tx
from umbra.operators.engine import Candidate

#: Pieces in a window and shared by two, for recognizers and for nets; least scores.
CHUNK, CHUNK_OVERLAP, WINDOW, WINDOW_OVERLAP = 480, 30, 512, 64
NER_THRESHOLD, BIRTH_MARGIN = 0.3, 0.65


def window_plan(docs: DataFrame, size: int = WINDOW, overlap: int = WINDOW_OVERLAP) -> DataFrame:
    """doc_id, window, first, last: windows that cover a document's n pieces; none for no pieces."""
    step = size - overlap
    count = F.when(F.col("n") <= size, 1).otherwise(F.ceil((F.col("n") - overlap) / step)).cast("int")
    rows = docs.where("n > 0").select("doc_id", "n", F.explode(F.sequence(F.lit(0), count - 1)).alias("window"))
    return rows.select("doc_id", "window", (F.col("window") * step).alias("first"), F.least(F.col("window") * step + size, F.col("n")).alias("last"))


def most_central(scored: DataFrame) -> DataFrame:
    """Of rows (doc_id, window, first, last, piece, ...) one for each piece: that of the window in which it stands
    furthest from an edge, the earliest of equals."""
    edge = F.least(F.col("piece") - F.col("first"), F.col("last") - 1 - F.col("piece"))
    w = Window.partitionBy("doc_id", "piece").orderBy(edge.desc(), "window")
    return scored.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def label_spans(pieces: DataFrame, classes: dict[str, str], threshold: float = NER_THRESHOLD) -> DataFrame:
    """doc_id, start, end, class, score of the entities that B- and I- labels of pieces (doc_id, piece, start, end, label,
    score) spell: an I- of the same kind goes on, anything else starts anew; the least score counts, and those below the
    threshold go. Empty pieces add nothing."""
    w = Window.partitionBy("doc_id").orderBy("piece")
    kind = F.when(F.col("label") != "O", F.substr("label", F.lit(3)))
    rows = pieces.withColumn("kind", kind).withColumn("last", F.lag("kind").over(w))
    goes_on = F.col("label").startswith("I-") & F.col("kind").eqNullSafe(F.col("last")) & F.col("kind").isNotNull()
    rows = rows.withColumn("entity", F.sum((~goes_on).cast("int")).over(w))
    known = F.create_map(*(F.lit(x) for pair in classes.items() for x in pair))
    full = F.col("start") < F.col("end")
    spans = rows.where("kind IS NOT NULL").groupBy("doc_id", "entity", "kind").agg(F.min(F.when(full, F.col("start"))).alias("start"), F.max(F.when(full, F.col("end"))).alias("end"), F.min(F.when(full, F.col("score"))).alias("score"))
    spans = spans.withColumn("class", F.try_element_at(known, F.col("kind"))).where("class IS NOT NULL AND start IS NOT NULL")
    return spans.where(F.col("score") >= threshold).select("doc_id", "start", "end", "class", "score")


def snapped(text: str, spans: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """Spans of words grown to whole words, and names over their joints, but not into another span."""
    out = []
    for i, (a, b, cls, score) in enumerate(spans):
        if cls in ("name", "location", "organization"):
            x, y = tx.expand_to_word_edges(text, a, b)
            if cls == "name":
                x, y = tx.extend_over_name_joiners(text, x, y)
            rest = [s for j, s in enumerate(spans) if j != i]
            a, b = max([x, *(s[1] for s in rest if s[1] <= a)]), min([y, *(s[0] for s in rest if s[0] >= b)])
        out.append((a, b, cls, score))
    return out


def recognizer(name: str, model: Callable[[str], list[tuple[int, int, str, float]]], threshold: float = NER_THRESHOLD) -> Callable:
    """A model (text to start, end, class and score, in characters) as a recognizer of the engine: spans of one class that
    overlap are one, and all are learned evidence."""

    def find(text: str, live: list[Candidate]) -> list[Candidate]:
        merged: list[list] = []
        for a, b, cls, score in sorted(snapped(text, [s for s in model(text) if s[3] >= threshold])):
            if merged and merged[-1][2] == cls and merged[-1][1] > a:
                merged[-1][1], merged[-1][3] = max(merged[-1][1], b), max(merged[-1][3], score)
            else:
                merged.append([a, b, cls, score])
        return [Candidate(a, b, cls, name, score, 60, evidence="learned") for a, b, cls, score in merged]

    return find


_PROPOSED = re.compile(r"\b(?:(?:19|20)[0-9]{2}[-/.](?:0?[1-9]|1[0-2])[-/.](?:0?[1-9]|[12][0-9]|3[01])|(?:0?[1-9]|[12][0-9]|3[01])[-./](?:0?[1-9]|1[0-2])[-./](?:19|20)?[0-9]{2})\b")
_BUSINESS = re.compile(r"(?i)\b(?:account\s+opened|invoice|due|shipped|version|log(?:ged)?|rechnung|facture)\b")


def birth_judge(model: Callable[[str, int, int], tuple[float, float, float]], threshold: float = 0.5) -> Callable:
    """Dates that no other candidate holds, where a model's score for a birth date reaches the threshold and is ahead of
    those for a date and for an event by the margin. Dates in business sentences are not asked about."""

    def find(text: str, live: list[Candidate]) -> list[Candidate]:
        out = []
        for m in _PROPOSED.finditer(text):
            a, b = m.span()
            start, end = text.rfind(".", 0, a) + 1, text.find(". ", b)
            if any(c.start < b and a < c.end for c in live) or _BUSINESS.search(text, start, end if end >= 0 else len(text)):
                continue
            birth, date, event = model(text, a, b)
            if birth >= threshold and birth - max(date, event) >= BIRTH_MARGIN:
                out.append(Candidate(a, b, "custom:birth_date", "dob.judge", birth, 60, evidence="learned"))
        return out

    return find
