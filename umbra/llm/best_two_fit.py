"""Best-fit packing with two-for-one exchanges.

Only lengths decide where a piece can go, and there are at most ``size`` of them, so bins are planned on the counts
by length: a bin is filled greedily, longest fitting piece first; then its smallest piece may give way to two
unpacked ones that fill the widened gap more tightly; the same bin is then repeated for as long as counts last.
Each plan line uses up some length, so the plan's size depends on the number of lengths, never on that of pieces.
Pieces take their places by their rank among those of equal length; ranks come from counts by (length, bucket) and
a window inside buckets, so a length that a third of the pieces share is ranked in many tasks.

Null text: empty, one piece with the end id alone. Very long texts are encoded in parts, cut at spaces, and packed
in pieces of ``size``. Repeated ids and rows: each row is packed; rows that agree in id and text are interchangeable.
Null ids are packed like others. Further columns are ignored, whatever their names. Empty table: empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm import _tokens
from umbra.llm._common import checkpointed, gathered, sized, slices

SIZE, END_ID = 4096, 1
#: Pieces of one length that one task ranks, about.
BUCKET_ROWS = 100_000
#: Bytes of a small table, dealt over many partitions, that one task encodes.
ENCODED = 8_000_000


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every document's token sequence, cut at ``size``."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches):
        for batch in slices(batches, 1):
            data, offsets = _tokens.utf8(batch.column(1))
            for a, b in _tokens.by_bytes(offsets):
                flat, sizes = _tokens.word_ids(tokenizer).encode(data, offsets[a : b + 1])
                rows, at = [], 0
                for i, n in enumerate(sizes.tolist()):
                    ids = np.append(flat[at : at + n], np.uint32(end)).astype("<u4")
                    at += n
                    for k in range(0, n + 1, size):
                        part = ids[k : k + size]
                        rows.append((a + i, k // size, k, len(part), zlib.crc32(part.tobytes()), *([part.tolist()] if with_ids else [])))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0])), *(pa.array(c, k) for c, k in zip(columns[1:], (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=False))], names=names)

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def plan_bins(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, list[int]]]:
    """(how often, lengths of one bin) lines that use every piece exactly once; counts: pieces by length."""
    left = np.zeros(size + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    lines: list[tuple[int, list[int]]] = []
    while (has := np.flatnonzero(left)).size:
        used: dict[int, int] = {}
        gap = size
        while gap and (i := int(np.searchsorted(has, gap, side="right"))):  # fill greedily
            n = int(has[i - 1])
            take = min(gap // n, int(left[n]))
            used[n] = take
            gap -= take * n
            has = has[: i - 1]
        if gap and len(used):
            small = min(used)
            spare = left.copy()
            for n, c in used.items():
                spare[n] -= c
            found, room = None, gap + small
            free = np.flatnonzero(spare[: room + 1])
            # the second of each pair: the largest that fits beside the first
            second = np.searchsorted(free, room - free, side="right") - 1
            ok = second >= 0
            both = np.where(ok, free + free[np.maximum(second, 0)], 0)
            both[(second == np.arange(free.size)) & (spare[free] < 2)] = 0
            if free.size and (best := int(both.argmax())) >= 0 and both[best] > small:
                found = (int(free[best]), int(free[second[best]]))
            if found:
                used[small] -= 1
                for n in found:
                    used[n] = used.get(n, 0) + 1
        used = {n: c for n, c in used.items() if c}
        times = min(int(left[n]) // c for n, c in used.items())
        for n, c in used.items():
            left[n] -= times * c
        lines.append((times, [n for n in sorted(used, reverse=True) for _ in range(used[n])]))
    return lines


def _places(lines: list[tuple[int, list[int]]]) -> dict[int, list[tuple[int, int, int, np.ndarray]]]:
    """By length: (first rank, first sequence, pieces a bin, their offsets), in order of ranks."""
    at: dict[int, int] = {}
    places: dict[int, list] = {}
    sequence = 0
    for times, bin_ in lines:
        offsets = np.concatenate([[0], np.cumsum(bin_)[:-1]])
        for n in set(bin_):
            own = offsets[np.array(bin_) == n]
            places.setdefault(n, []).append((at.get(n, 0), sequence, len(own), own))
            at[n] = at.get(n, 0) + times * len(own)
        sequence += times
    return places


def pack(parts: DataFrame, size: int = SIZE) -> DataFrame:
    """``parts`` (checkpointed, with length 1 to ``size``) with sequence_id and offset."""
    counts = {r[0]: r[1] for r in parts.groupBy("length").count().collect()}  # at most ``size`` rows
    buckets = {n: max(1, -(-c // BUCKET_ROWS)) for n, c in counts.items()}
    most = max(buckets.values(), default=1)
    places = _places(plan_bins(counts, size))
    order = ["doc_id", "piece", "start", "ids_crc32"]
    bucketed = parts.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(max(16, most))).cast("int"))
    inside = bucketed.withColumn("__r", F.expr(f"row_number() OVER (PARTITION BY length, __b ORDER BY {', '.join(order)}) - 1"))
    before = bucketed.groupBy("length", "__b").count()
    before = before.select("length", "__b", F.expr("sum(count) OVER (PARTITION BY length ORDER BY __b) - count").alias("__before"))
    ranked = inside.join(before, ["length", "__b"]).withColumn("__rank", F.col("__r") + F.col("__before")).drop("__b", "__r", "__before")
    names = [c for c in ranked.columns if c != "__rank"]
    schema = ", ".join([*(f"`{c}` {ranked.schema[c].dataType.simpleString()}" for c in names), "sequence_id long", "offset long"])

    def run(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("__rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length).tolist():
                of = np.flatnonzero(length == n)
                line = np.searchsorted([p[0] for p in places[n]], rank[of], side="right") - 1
                for k in np.unique(line).tolist():
                    first, base, each, offsets = places[n][k]
                    mine = of[line == k]
                    bin_, slot = np.divmod(rank[mine] - first, each)
                    sequence[mine], offset[mine] = base + bin_, offsets[slot]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return sized(ranked.mapInArrow(run, schema), sum(counts.values()))


def pack_documents(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    return pack(checkpointed(gathered(pieces(docs, tokenizer, size), docs, docs.count(), ENCODED)), size)
