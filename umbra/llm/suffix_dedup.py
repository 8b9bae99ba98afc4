"""Removal of repeated byte strings, with suffix arrays built by grouping.

Every byte covered by a ``LENGTH``-byte string that also starts earlier (a smaller id, or the same document further
left) goes; strings are judged on the input. One suffix array over all texts can't be built in parts, so anchors
deal the work out, and the grouping construction orders what they leave:

1. In every window of LENGTH bytes the K-byte string with the smallest hash is an anchor, so equal windows have equal
   anchors at equal places. An anchor's context is all that windows around it can hold.
2. Anchors meet by hash. Within a map task, and then within a hash, equal contexts (equal by two 64-bit hashes) are
   all covered but for the first: copies, however many, shrink to one row a task before any shuffle. Anchors that a
   bounded sample shows to be frequent are dealt by their context instead. What is left are the first rows of
   different contexts of one anchor: where copies begin, end or differ.
3. Those contexts are fetched and cut into 16-byte blocks, counted from the anchor. Blocks become symbols, and a
   suffix array over the symbols (``gsaca``) brings stretches of five equal blocks together; a window of 100 bytes
   holds five whole blocks at least. Their windows are then compared byte by byte, and every window but the first of
   its kind is covered. An anchor with more than ``CROWD`` contexts is never gathered: its windows become rows, the
   first of each kind is an aggregate, and the others are joined with it.

Null text: empty. Null ids come before all others. Rows that repeat an id with different texts are documents of their
own, in the order of a hash of their texts; rows that repeat id and text are one document, and all get its result.
Texts under 100 bytes keep everything; very long ones are hashed in segments. Further columns are ignored, whatever
their names. Empty table: empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm._common import checkpointed, code_key, gathered, sized_broadcast, slices, written
from umbra.llm._hashing import mix
from umbra.llm.gsaca import shared_prefixes, suffix_array

LENGTH, K, BLOCK = 100, 32, 16
W, REACH = LENGTH - K + 1, LENGTH - K
#: Bytes hashed at a time; anchors held in a map task before they are passed on; symbols sorted at a time.
SEGMENT, HELD, SORTED = 1 << 19, 1 << 18, 20_000
#: Contexts of one anchor that a task may gather: about 11 MB of them.
CROWD = 65_536
#: Members of clusters whose windows are compared at a time.
MEMBERS = 8192
#: Texts in the sample that shows which anchors are frequent, and contexts there that make one so. It only decides
#: where rows go.
SAMPLE_ROWS, FREQUENT = 2000, 16
_rng = np.random.default_rng(46)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_UP, _DOWN = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(SEGMENT + 4 * LENGTH, np.uint64(x))])) for x in (_BASE, pow(_BASE, -1, 1 << 64)))


def _sums(b: np.ndarray) -> np.ndarray:
    return np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[b] * _UP[: len(b)])])


def _slide(h: np.ndarray, w: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every w neighbours."""
    size, m = 1, h
    while 2 * size <= w:
        m = pick(m[:-size], m[size:])
        size *= 2
    n = len(h) - w + 1
    return pick(m[:n], m[w - size : w - size + n])


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, context hash, position, context end) of the anchors of one text."""
    n, found = len(data), []
    for a in range(0, n - LENGTH + 1, SEGMENT):
        z = min(a + SEGMENT, n - LENGTH + 1)  # windows that start in [a, z)
        lo, hi = max(0, a - REACH), min(n, z - 1 + LENGTH + REACH)
        sums = _sums(np.frombuffer(data, np.uint8, hi - lo, lo))
        first, last = a - lo, z - 1 + LENGTH - lo  # their bytes
        kh = mix((sums[first + K : last + 1] - sums[first : last + 1 - K]) * _DOWN[first : last + 1 - K])
        least = _slide(kh, W, np.minimum)
        # a position is an anchor if some window around it has its hash as the least
        zero = np.zeros(W - 1, np.uint64)
        p = np.flatnonzero(_slide(np.concatenate([zero, least, zero]), W, np.maximum) == kh)
        at = p + a
        left, right = np.maximum(at - REACH, 0), np.minimum(at + K + REACH, n)
        c = mix((sums[right - lo] - sums[left - lo]) * _DOWN[left - lo] + (at - left).astype(np.uint64) * np.uint64(0x51ED270B) + (right - at).astype(np.uint64) * np.uint64(0x2545F491))
        found.append((kh[p], c, at, right))
    if not found:
        return tuple(np.zeros(0, np.uint64 if i < 2 else np.int64) for i in range(4))
    if len(found) == 1:
        return found[0]
    h, c, at, right = (np.concatenate(x) for x in zip(*found, strict=True))
    _, one = np.unique(at, return_index=True)
    return h[one], c[one], at[one], right[one]


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray, v: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Unions of [start, end) by doc (and v): doc, start, end, v; touching spans join."""
    v = np.zeros(len(doc), np.int64) if v is None else v
    order = np.lexsort((start, v, doc))
    doc, start, end, v = doc[order], start[order], end[order], v[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (v[1:] != v[:-1])])
    # ends grow within a document; a step a document keeps them apart
    step = np.cumsum(new) * (int(end.max()) + 1)
    top = np.maximum.accumulate(end + step)
    new[1:] |= (start + step)[1:] > top[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], (top - step)[last], v[first]


_ROWS = "h long, c long, doc long, v long, at long"


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _batch(names: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_signed(c) for c in columns], names=names.split())


def _map(batches):
    """Anchors, equal ones with equal contexts once a task (the first), as (hash, context hash, doc, v, position and
    length of what follows packed). The others' spans follow as (any hash, start, doc, v, -1 - end)."""
    held: list[tuple] = []
    size = 0

    def flush():
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        held.clear()
        order = np.lexsort((columns[4], columns[3], columns[2], columns[1], columns[0]))
        for i in range(6):
            columns[i] = columns[i][order]
        del order
        again = np.ones(len(columns[0]), bool)
        again[0] = False
        for x in columns[:2]:
            again[1:] &= x[1:] == x[:-1]
        twin = again.copy()  # of a repeated row
        for x in columns[2:5]:
            twin[1:] &= x[1:] == x[:-1]
        if twin.any():
            columns, again = [x[~twin] for x in columns], again[~twin]
        h, c, doc, v, at, right = columns
        keep = ~again
        yield _batch("h c doc v at", h[keep], c[keep], doc[keep], v[keep], at[keep] * 256 + (right - at)[keep])
        if again.any():
            d, a, b, w = _merged(doc[again], np.maximum(at[again] - REACH, 0), right[again], v[again])
            yield _batch("h c doc v at", mix(d.view(np.uint64) + w.view(np.uint64)), a, d, w, -1 - b)

    for batch in slices(batches, 2):
        for doc, v, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            h, c, at, right = anchors(text.encode())
            if len(h):
                held.append((h, c, np.full(len(h), doc, np.int64), np.full(len(h), v, np.int64), at, right))
                size += len(h)
                if size >= HELD:
                    yield from flush()
                    size = 0
    if held:
        yield from flush()


_FOUND = "doc long, v long, start long, `end` long, h long"


def _meeting(frequent: np.ndarray):
    """Rows sorted by hash, context, doc, v and position: spans of rows after the first of a context (h null), and the
    first rows of contexts whose hash has several (start is the anchor, end the context's); those of the ``frequent``
    ones, whose contexts are spread over tasks, always have."""

    def meet(batches):
        last: tuple | None = None  # hash, context, and the row that is held back while its hash has one context only

        def out(doc, v, start, end, h, null):
            return pa.RecordBatch.from_arrays([*(pa.array(x) for x in (doc, v, start, end)), pa.array(h, mask=np.full(len(h), null))], names=["doc", "v", "start", "end", "h"])

        for batch in batches:
            h, c, doc, v, at = (batch.column(i).to_numpy() for i in range(5))
            span = at < 0
            if span.any():
                yield out(doc[span], v[span], c[span], -1 - at[span], h[span], True)
                h, c, doc, v, at = (x[~span] for x in (h, c, doc, v, at))
            if not len(h):
                continue
            if last is not None:
                h, c, doc, v, at = (np.concatenate([[x], y]) for x, y in zip(last[:5], (h, c, doc, v, at), strict=True))
            new_h = np.concatenate([[True], h[1:] != h[:-1]])
            new_c = new_h | np.concatenate([[True], c[1:] != c[:-1]])
            pos, end = at >> 8, (at >> 8) + (at & 255)
            again = ~new_c
            again[1:] &= (doc[1:] != doc[:-1]) | (v[1:] != v[:-1]) | (at[1:] != at[:-1])  # repeated rows don't repeat
            if again.any():
                yield out(doc[again], v[again], np.maximum(pos - REACH, 0)[again], end[again], h[again], True)
            firsts = np.flatnonzero(new_c)
            several = ~new_h[firsts] | np.isin(h[firsts], frequent)
            several[:-1] |= h[firsts[1:]] == h[firsts[:-1]]
            told = last is not None and last[5]  # the carried row has been passed on, or stands for one that has
            if told:
                several[0] = False
                same = firsts[1:][h[firsts[1:]] == h[0]]
                several[np.searchsorted(firsts, same)] = True
            pick = firsts[several]
            if len(pick):
                yield out(doc[pick], v[pick], pos[pick], end[pick], h[pick], False)
            f = firsts[-1]
            last = (h[f], c[f], doc[f], v[f], at[f], bool(several[-1]) or (told and h[f] == h[0]))

    return meet


def _blocks(group: np.ndarray, left: np.ndarray, bodies: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(symbols, context and block number of each): stretches of at least five blocks that other contexts of the
    same anchor have at the same place, each ended by a symbol of its own kind (0)."""
    need = (LENGTH - BLOCK + 1) // BLOCK
    span = -(-REACH // BLOCK) * BLOCK
    width = 2 * span + -(-K // BLOCK) * BLOCK
    grid = np.zeros((len(bodies), width), np.uint8)
    whole = np.zeros((len(bodies), width // BLOCK), bool)
    for i, (body, n) in enumerate(zip(bodies, left.tolist(), strict=True)):
        a = span - n
        grid[i, a : a + len(body)] = np.frombuffer(body, np.uint8)
        whole[i, -(-a // BLOCK) : (a + len(body)) // BLOCK] = True
    words = grid.view(np.uint64).reshape(len(bodies), width // BLOCK, BLOCK // 8)
    place = np.arange(width // BLOCK, dtype=np.uint64)[None, :]
    named = mix(mix(words[:, :, 0]) + words[:, :, 1] * np.uint64(_BASE) + mix(group.astype(np.uint64)[:, None] * np.uint64(64) + place))
    _, inverse, count = np.unique(named, return_inverse=True, return_counts=True)
    inverse = inverse.reshape(named.shape)
    common = whole & (count[inverse] > 1)
    runs = common.copy()
    for k in range(1, need):  # a block counts if a stretch of ``need`` holds it
        runs[:, : common.shape[1] - k] &= common[:, k:]
        runs[:, common.shape[1] - k :] = False
    keep = runs.copy()
    for k in range(1, need):
        keep[:, k:] |= runs[:, : common.shape[1] - k]
    symbols: list[int] = []
    context, number = [], []
    rows, columns = np.nonzero(keep)
    previous = (-1, -1)
    for i, j, s in zip(rows.tolist(), columns.tolist(), inverse[rows, columns].tolist(), strict=True):
        if (i, j - 1) != previous and symbols:
            symbols.append(0)
            context.append(-1)
            number.append(-1)
        symbols.append(s + 1)
        context.append(i)
        number.append(j)
        previous = (i, j)
    return symbols, np.array(context, np.int64), np.array(number, np.int64)


def _later(joined: np.ndarray, where: np.ndarray, keys: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    """Windows that are not the first of their bytes among those with their key. Keys find them, bytes decide."""
    order = np.lexsort((ctx, keys))
    k = keys[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    again = np.flatnonzero(~new)
    later, first = order[again], order[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))[again]]
    same = np.ones(len(later), bool)
    for i in range(0, len(later), 1 << 13):
        a, b = (joined[where[x[i : i + (1 << 13)], None] + np.arange(LENGTH)] for x in (later, first))
        same[i : i + (1 << 13)] = (a == b).all(axis=1)
    for key in set(keys[later[~same]].tolist()):  # different bytes with one hash: told apart by themselves
        seen: set[bytes] = set()
        for w in order[k == key].tolist():
            body = joined[where[w] : where[w] + LENGTH].tobytes()
            same[later == w] = body in seen
            seen.add(body)
    return later[same]


def covered(group: np.ndarray, left: np.ndarray, bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, start, end) of the windows that occur earlier in another context of the same group (anchor), with
    starts and ends from the context's own start.

    Contexts come in order of document and position within a group; left: bytes before the anchor.
    """
    nothing = (np.zeros(0, np.int64),) * 3
    need = (LENGTH - BLOCK + 1) // BLOCK
    span = -(-REACH // BLOCK) * BLOCK
    symbols, context, number = _blocks(group, left, bodies)
    if not symbols:
        return nothing
    order = np.array(suffix_array(symbols), np.int64)
    lcp = np.array(shared_prefixes(symbols, order.tolist()), np.int64)
    # suffixes that share ``need`` blocks stand together; separators end a stretch
    text = np.array(symbols, np.int64)
    together = lcp >= need
    ends = np.flatnonzero(text == 0)
    stretch = np.append(ends, len(text))[np.searchsorted(ends, np.arange(len(text)))] - np.arange(len(text))
    together &= (stretch[order] >= need) & np.concatenate([[False], stretch[order[:-1]] >= need])
    member = together | np.append(together[1:], False)
    at = order[member]
    cluster = np.cumsum(~together)[member]
    if not len(at):
        return nothing
    size = np.array([len(b) for b in bodies], np.int64)
    joined = np.frombuffer(b"".join(bodies), np.uint8)
    base = np.cumsum(size) - size
    # clusters are told apart by themselves, some thousand members at a time
    new = np.flatnonzero(np.concatenate([[True], cluster[1:] != cluster[:-1]]))
    cuts = [0]
    for c in new[1:].tolist():
        if c - cuts[-1] >= MEMBERS:
            cuts.append(c)
    found = []
    for i, j in zip(cuts, [*cuts[1:], len(at)], strict=True):
        ctx, a = _again(joined, base, size, left, context[at[i:j]], number[at[i:j]] * BLOCK - span, cluster[i:j])
        if len(ctx):
            found.append(_merged(ctx, a, a + LENGTH)[:3])
    if not found:
        return nothing
    return _merged(*(np.concatenate(x) for x in zip(*found, strict=True)))[:3]


def _again(joined: np.ndarray, base: np.ndarray, size: np.ndarray, left: np.ndarray, context: np.ndarray, first: np.ndarray, cluster: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, start in it) of the windows that repeat one of their cluster: those whose first whole block is the
    cluster's first, which start up to BLOCK - 1 bytes before it (``first``, counted from the anchor)."""
    ctx = np.repeat(context, BLOCK)
    start = np.repeat(first, BLOCK) - np.tile(np.arange(BLOCK), len(context))
    ok = (start >= -left[ctx]) & (start + LENGTH <= size[ctx] - left[ctx]) & (start <= 0) & (start >= -REACH)
    ctx, start, kind = ctx[ok], start[ok], np.repeat(cluster, BLOCK)[ok]
    where = base[ctx] + left[ctx] + start
    keys = np.zeros(len(ctx), np.uint64)
    for a in range(0, len(joined), SEGMENT):  # sums of one segment at a time, as powers are bounded
        mine = np.flatnonzero((where >= a) & (where < a + SEGMENT))
        if len(mine):
            sums = _sums(joined[a : a + SEGMENT + LENGTH])
            w = where[mine] - a
            keys[mine] = (sums[w + LENGTH] - sums[w]) * _DOWN[w]
    keys = mix(mix(keys) + mix(kind.astype(np.uint64) * np.uint64(256) + (start + 128).astype(np.uint64)))
    later = _later(joined, where, keys, ctx)
    return ctx[later], start[later] + left[ctx[later]]


_CONTEXT = "h long, doc long, v long, pos long, n_left long, body binary"


def _resolve(batches):
    """Contexts sorted by hash, doc, v and position; whole hashes are gathered until there is enough to sort."""
    held: list[tuple] = []

    def flush(rows):
        h, doc, v, pos, left, bodies = zip(*rows, strict=True)
        left = np.array(left, np.int64)
        of, a, b = covered(np.array(h, np.int64).view(np.uint64), left, list(bodies))
        if len(of):
            shift = np.array(pos, np.int64)[of] - left[of]
            yield _batch("doc v start end", np.array(doc, np.int64)[of], np.array(v, np.int64)[of], a + shift, b + shift)

    most = SORTED // 8
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if held and row[:4] == held[-1][:4]:
                continue  # of a repeated row
            if len(held) >= most and row[0] != held[-1][0]:
                yield from flush(held)
                held = []
            held.append(row)
    if held:
        yield from flush(held)


def _windows(batches):
    """All windows around the anchors of contexts: (anchor and place, hash of the bytes, doc, v, start)."""
    for batch in batches:
        for h, doc, v, pos, left, body in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            n = len(body) - LENGTH + 1
            if n > 0:
                sums = _sums(np.frombuffer(body, np.uint8))
                first = np.arange(n)
                kind = mix(np.uint64(h % (1 << 64)) + mix((first - left + 128).astype(np.uint64)))
                yield _batch("kind bytes doc v start", kind, mix((sums[LENGTH:] - sums[:n]) * _DOWN[:n]), np.full(n, doc), np.full(n, v), pos - left + first)


def _crowded(contexts: DataFrame) -> DataFrame:
    """doc, v, start, end of windows that occur earlier in another context of their anchor, for anchors of any size."""
    rows = contexts.mapInArrow(_windows, "kind long, bytes long, doc long, v long, start long")
    firsts = rows.groupBy("kind", "bytes").agg(F.min(F.struct("doc", "v", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    salted = firsts.select("kind", "bytes", "first", F.explode(F.expr("sequence(0, 15)")).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc", "v", "start"), F.lit(16)).cast("int"))
    later = rows.join(salted, ["kind", "bytes", "salt"]).where("struct(doc, v, start) > first")
    return later.select("doc", "v", "start", (F.col("start") + LENGTH).alias("end"))


def _contexts(batches):
    for batch in slices(batches, 2):
        out = []
        for doc, v, text, edges in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            data = text.encode()
            out += [(e["h"], doc, v, e["start"], min(e["start"], REACH), data[max(e["start"] - REACH, 0) : e["end"]]) for e in edges]
        if out:
            kinds = (*[pa.int64()] * 5, pa.binary())
            names = [x.split()[0] for x in _CONTEXT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def _cut(batches):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"]
    for batch in slices(batches, 1):
        out = []
        for doc, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            data, merged = text.encode(), []
            for s in sorted((s["start"], min(s["end"], len(data))) for s in spans or ()):
                if s[0] >= s[1]:
                    continue
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            digest, at = hashlib.sha256(), 0
            for a, b in merged:
                digest.update(data[at:a])
                at = b
            digest.update(data[at:])
            out.append((doc, len(data), sum(b - a for a, b in merged), len(merged), digest.hexdigest(), merged))
        if out:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def _frequent(thin: DataFrame, rows: int) -> list[int]:
    """Anchors with many contexts in a bounded sample of the texts."""
    few = thin.sample(min(1.0, SAMPLE_ROWS / max(1, rows)), seed=1).select("doc", "v", "text").mapInArrow(_map, _ROWS)
    often = few.where("at >= 0").groupBy("h").agg(F.count_distinct("c").alias("n")).where(F.col("n") >= FREQUENT)
    return [r["h"] for r in often.select("h").collect()]  # bounded by the sample


def repeated_spans(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, n_bytes, n_removed, n_spans, kept_sha256 and removed (byte spans) of every row."""
    spark = docs.sparkSession
    thin = docs.select(F.col(key).cast("long").alias("doc_id"), code_key(key).alias("doc"), F.coalesce(text, F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    # an id with different texts names several documents, told apart by v
    count = docs.count()
    several = thin.groupBy("doc").agg(F.min("hash").alias("a"), F.max("hash").alias("b")).where("a <> b").select("doc", F.lit(True).alias("several"))
    several = checkpointed(gathered(several, docs, count))
    if several.limit(1).count():
        thin = thin.join(several, "doc", "left").withColumn("v", F.when(F.col("several"), F.col("hash")).otherwise(F.lit(0)))
    else:
        thin = thin.withColumn("v", F.lit(0))
    thin = thin.select("doc_id", "doc", F.col("v").cast("long").alias("v"), "text")
    frequent = np.array(_frequent(thin, count), np.int64)
    rows = thin.select("doc", "v", "text").mapInArrow(_map, _ROWS)
    if len(frequent):
        often = F.col("h").isin(frequent.tolist()) if len(frequent) <= 1000 else F.array_contains(F.lit(frequent.tolist()), F.col("h"))
        rows = rows.withColumn("by", F.when(often, F.col("c")).otherwise(F.lit(0))).repartition("h", "by").drop("by")
    else:
        rows = rows.repartition("h")
    found = rows.sortWithinPartitions("h", "c", "doc", "v", "at").mapInArrow(_meeting(frequent), _FOUND)
    found = written(gathered(found, docs, count))
    # the texts are dealt out once for both joins
    dealt = thin.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc", "v")
    edges = found.where("h IS NOT NULL")
    crowds = checkpointed(gathered(edges.groupBy("h").count().where(F.col("count") > CROWD).select("h"), docs, count))

    def contexts(of: DataFrame) -> DataFrame:
        listed = of.groupBy("doc", "v").agg(F.collect_list(F.struct("h", "start", "end")).alias("edges"))
        # all of the dealt columns, so that both joins read one shuffle
        return dealt.join(listed, ["doc", "v"]).select("doc", "v", "text", "edges", "doc_id").mapInArrow(_contexts, _CONTEXT)

    spans = [found.where("h IS NULL").select("doc", "v", "start", "end")]
    few = edges
    if crowds.limit(1).count():
        crowds = sized_broadcast(crowds, 100_000)
        few = edges.join(crowds, "h", "left_anti")
        spans.append(_crowded(written(contexts(edges.join(crowds, "h", "left_semi")))))
    near = contexts(few).repartition("h").sortWithinPartitions("h", "doc", "v", "pos")
    spans.append(near.mapInArrow(_resolve, "doc long, v long, start long, `end` long"))
    every = spans[0]
    for more in spans[1:]:
        every = every.union(more)
    listed = every.groupBy("doc", "v").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    out = dealt.join(listed, ["doc", "v"], "left").select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<array<bigint>>")
    return gathered(out, docs, count).withColumnRenamed("doc_id", key)
