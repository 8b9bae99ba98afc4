"""Documents from OCR words: reading order, tables, pages, bundle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.functions.text import repair_ocr
from umbra.operators.cut import cut


#: Least width of a gap between columns, as a part of the page and in pixels, and slack when words' extents join.
GAP_PART, GAP_LEAST, GAP_SLACK = 6, 48, 24


def column_split(words: Mapping[str, Sequence]) -> float | None:
    """The middle of the widest gap between the words' joined extents, if it is wide enough for two columns."""
    spans = sorted((x, x + w) for x, w, t in zip(words["x"], words["w"], words["text"], strict=True) if t and w > 0)
    if len(spans) < 4:
        return None
    right, best, at = spans[0][1], 0, None
    for a, b in spans[1:]:
        if a > right + GAP_SLACK and a - right > best:
            best, at = a - right, right + (a - right) // 2
        right = max(right, b)
    return at if at is not None and best >= max((right - spans[0][0]) // GAP_PART, GAP_LEAST) else None


def _lines(words: list[tuple]) -> list[str]:
    """Lines by distance from their first word; gaps wider than three characters, aligned over lines, make table cells.
    words: (x, y, w, h, text) in order of y and x."""
    lines: list[list] = []
    for word in words:
        if lines and abs(word[1] - y) <= max(word[3], h):
            lines[-1].append(word)
        else:
            lines.append([word])
            y, h = word[1], word[3]
    out: list[list[str]] = []
    for line in lines:
        line.sort(key=itemgetter(0))
        x, _, w, _, text = line[0]
        cells, part, right, gap = [], [text], x + w, 3 * w / max(1, len(text))
        for x, _, w, _, text in line[1:]:
            if x - right > gap:
                cells.append(" ".join(part))
                part = [text]
            else:
                part.append(text)
            right, gap = x + w, 3 * w / max(1, len(text))
        out.append([*cells, " ".join(part)])
    text, sizes = [], [0, *map(len, out), 0]
    for i, cells in enumerate(out):
        n = len(cells)
        grid = n > 1 and (sizes[i] == n or sizes[i + 2] == n)
        text.append("| " + " | ".join(cells) + " |" if grid else " ".join(cells))
    return text


def _page(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, text: np.ndarray) -> str:
    words = {"x": x.tolist(), "w": w.tolist(), "text": text.tolist()}
    at = column_split(words)
    order = np.lexsort((x, y))
    rows = list(zip(*(v[order].tolist() for v in (x, y, w, h, text)), strict=True))
    left = [r for r in rows if at is not None and r[0] < at]
    right = [r for r in rows if at is not None and r[0] >= at]
    return "\n".join(line for part in ((left, right) if right else (rows,)) for line in _lines(part))


def pages_of(words: DataFrame) -> DataFrame:
    """doc_id, page and words, the page's words as one array; a page's words are bounded by the page."""
    return words.groupBy("doc_id", "page").agg(F.collect_list(F.struct("x", "y", "w", "h", "text", F.col("conf").cast("double").alias("conf"))).alias("words"))


def read_pages(pages: DataFrame) -> DataFrame:
    """doc_id, page, text, words, conf of pages with their words (x, y, w, h, text, conf) as an array."""

    def run(batches):
        for batch in batches:
            listed = batch.column("words")
            flat, ends = listed.flatten(), np.cumsum([0, *(n or 0 for n in pc.list_value_length(listed).to_pylist())])
            x, y, w, h, text, conf = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("x", "y", "w", "h", "text", "conf"))
            real = flat.field("text").is_valid().to_numpy(zero_copy_only=False)
            texts, counts, means = [], [], []
            for a, b in zip(ends, ends[1:], strict=False):
                m = np.flatnonzero(real[a:b]) + a
                c = conf[m].astype(float)
                c = c[~np.isnan(c)]
                texts.append(_page(x[m], y[m], w[m], h[m], text[m]) if len(m) else "")
                counts.append(len(m))
                means.append(0.0 if not len(m) else float(c.mean()) if len(c) else None)
            columns = [batch.column("doc_id").cast(pa.int64()), batch.column("page").cast(pa.int32()), pa.array(texts, pa.string()), pa.array(counts, pa.int32()), pa.array(means, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "page", "text", "words", "conf"])

    return pages.select("doc_id", "page", "words").mapInArrow(run, "doc_id long, page int, text string, words int, conf double")


def reading_order(words: DataFrame) -> DataFrame:
    """doc_id, page, text, words, conf of words, one a row (doc_id, page, x, y, w, h, text, conf)."""
    return read_pages(pages_of(words))


def merge_pages(pages: DataFrame) -> DataFrame:
    """One text a document, pages apart by a blank line, and the mean confidence weighted by words."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n\n")
    conf = F.when(F.sum("words") > 0, F.sum(F.col("conf") * F.col("words")) / F.sum("words"))
    return pages.groupBy("doc_id").agg(repair_ocr(text).alias("text"), F.count("*").alias("pages"), conf.alias("confidence"))


def clean_documents(words: DataFrame, kind: str = "png", low_confidence: float = 0.6, **detect) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clean markdown, report, manifest) of documents' words: reading order, repairs, protection in a session of its own,
    a heading, and counts by class, pages, mean confidence and whether that is low."""
    from umbra.operators import protect

    merged = cut(merge_pages(reading_order(words)))
    docs = merged.select("doc_id", F.concat(F.lit("document-"), F.col("doc_id").cast("string")).alias("session_id"), F.lit(0).cast("long").alias("seq"), "text")
    clean = cut(protect.protect(docs, **detect)[0])
    shown = clean.select("doc_id", F.concat(F.lit(f"# Document ({kind})\n\n"), "clean_text").alias("clean_md"), F.size("manifest").alias("tokens"))
    counts = clean.select("doc_id", F.explode("manifest").alias("m")).groupBy("doc_id", "m.class").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("class", "n")))).alias("counts"))
    report = shown.join(merged.select("doc_id", "pages", "confidence"), "doc_id").join(counts, "doc_id", "left")
    report = report.select("doc_id", F.lit(kind).alias("kind"), "pages", "confidence", (F.col("confidence") < low_confidence).alias("low_confidence"), F.length("clean_md").alias("characters"), "tokens", "counts")
    return shown.select("doc_id", "clean_md"), report, clean.select("doc_id", "manifest")


def counts_by_class(clean: DataFrame) -> DataFrame:
    return clean.select(F.explode("manifest").alias("m")).groupBy("m.class").agg(F.count("*").alias("n"))


def write_bundle(clean: DataFrame, agent: str, owner: str) -> None:
    """Clean text and report for the agent, the manifest for the owner: two places that must not contain each other."""
    a, o = agent.rstrip("/") + "/", owner.rstrip("/") + "/"
    if a.startswith(o) or o.startswith(a):
        raise ValueError("agent and owner folders must be apart")
    clean.select("doc_id", "clean_text").write.parquet(a + "clean")
    counts_by_class(clean).write.json(a + "report")
    clean.select("doc_id", "manifest").write.parquet(o + "manifest")
