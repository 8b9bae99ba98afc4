"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's set holds its distinct 5-word shingles. Equal sets form a class at once (by a 128-bit digest of the
set), and only one document of a class goes on. Its sketch is the k smallest hashes. Sets that hold the same values
meet in inverted lists: a list is keyed by the ``ROWS`` values of the full set that come first in the list's own order
of values, so that a passage in many documents doesn't put them all in one list. Keys are not taken from the sketches:
those of unequally large sets are less alike than the sets. A list holds both sets of a pair if the first values of
their union are in both, C(shared, ROWS) / C(union, ROWS), whatever the sizes of the two; all ``LISTS`` miss a pair at
the threshold with a probability of at most 2e-9 (6e-11 for large sets). Small sets meet exactly: with a union of at
most 13, two sets are similar enough only if one is the other and one value more. So sets of up to ``SMALL`` values have
no lists; they are looked up by hash among the sets one larger, each without every value in turn. Sets of fewer than 6
can't be 0.85 similar without being equal.

Inside a list nothing is paired with everything: each list has a centre, its smallest id, and members are
paired with it. Union sketches estimate the pairs' similarity (k smallest of both, those in both), pairs that are
plainly below are dropped (five standard errors), and full sets confirm the rest: first the best pair of every class,
then the other pairs between components, as pairs inside one need no confirming. In the end everything that shares a
list with one centre makes a bundle, and bundles that still hold several components are compared exactly: parts of at
most ``CHUNK_ROWS`` sets and about ``CHUNK_VALUES`` values meet pairwise, and a product of 0/1 matrices counts the
intersections of all their sets. Only links leave a task, so no pair of the lists is left out and none becomes a row.

Components come from min-label propagation over links with pointer jumping. Nulls: null text is an empty set,
linked with nothing; rows without an id keep their n_shingles, with a null component and kept true. Repeated rows
and ties: one row for each row; equal sets share the smallest id. Empty table: empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm import _hashing
from umbra.llm._common import release, row_count, settled, sized, slices, written

PERCENT, K, ROWS, LISTS = 85, 64, 5, 40
#: The largest set whose partners all differ from it by one value: 11 of 12 is above the threshold, 11 of 13 below.
SMALL = 11
#: Sets and values in a part of a bundle.
CHUNK_ROWS, CHUNK_VALUES = 512, 1 << 19
#: Tasks among which the members of one large bundle are dealt when they meet its figures.
SALTS = 16
#: Values of a set that are ordered at once.
SLICE = 1 << 12
_ORDERS = _hashing.mix(np.arange(1, LISTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def list_keys(values: np.ndarray) -> np.ndarray:
    """The LISTS keys of a set of ROWS values or more."""
    first = np.zeros((LISTS, 0), np.uint64)
    for at in range(0, len(values), SLICE):
        mixed = _hashing.mix(values[None, at : at + SLICE] ^ _ORDERS[:, None])
        first = np.concatenate([first, np.partition(mixed, ROWS - 1, axis=1)[:, :ROWS] if mixed.shape[1] > ROWS else mixed], axis=1)
    first = np.sort(first, axis=1)[:, :ROWS]
    with np.errstate(over="ignore"):
        key = np.zeros(LISTS, np.uint64)
        for i in range(ROWS):
            key = _hashing.mix(key * np.uint64(31) + first[:, i])
    return key.view(np.int64)


def small_keys(values: np.ndarray) -> tuple[int | None, list[int]]:
    """Hash of a set of 6 to SMALL values (else None), and of a set of 7 to SMALL + 1 without each of its values."""
    if not 6 <= len(values) <= SMALL + 1:
        return None, []
    mixed = _hashing.mix(values)
    with np.errstate(over="ignore"):
        whole = mixed.sum(dtype=np.uint64)
        less = (whole - mixed).view(np.int64).tolist() if len(values) > 6 else []
    return (int(whole.astype(np.int64)) if len(values) <= SMALL else None), less


def sketch_rows(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, set_id (null if empty), sketch, lids (keys of its lists; none up to SMALL shingles), whole and
    less (``small_keys``)."""

    def run(batches):
        for batch in slices(batches, 1):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sets = [_hashing.shingles(w) for w in _hashing.many_word_hashes(texts)]
            ids = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            lids = [list_keys(s).tolist() if len(s) > SMALL else [] for s in sets]
            small = [small_keys(s) for s in sets]
            columns = [batch.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary()), pa.array([s[:K].tobytes() for s in sets], pa.binary())]
            columns += [pa.array(lids, pa.list_(pa.int64())), pa.array([w for w, _ in small], pa.int64()), pa.array([x for _, x in small], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "set_id", "sketch", "lids", "whole", "less"])

    return docs.select(key, text).mapInArrow(run, "doc_id long, n_shingles long, set_id binary, sketch binary, lids array<long>, whole long, less array<long>")


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(values of both, size) of the union's sketch."""
    both = np.intersect1d(a, b, assume_unique=True)
    k = min(len(a), len(b)) if max(len(a), len(b)) >= K else K
    union = np.union1d(a, b)[:k]
    return int(np.isin(both, union, assume_unique=True).sum()), len(union)


def _plausible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b, est (per mille) of the pairs that sizes and union sketches don't rule out."""
    one = lambda x: classes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    sized = pairs.join(one("a"), "a").join(one("b"), "b").where(f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)")

    def run(batches):
        for batch in slices(batches, 2):
            a, b = ([np.frombuffer(s, np.uint64) for s in batch.column(c).to_pylist()] for c in ("s_a", "s_b"))
            est = [estimate(x, y) for x, y in zip(a, b, strict=True)]
            share = np.array([h / n for h, n in est])
            floor = np.array([PERCENT / 100 - 5 * np.sqrt(0.1275 / n) if n >= K else PERCENT / 100 - 1e-9 for _, n in est])
            ok = pa.array(share >= floor)
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array((share * 1000).astype(np.int64))], names=["a", "b", "est"])
            yield out.filter(ok)

    return sized.select("a", "b", "s_a", "s_b").mapInArrow(run, "a long, b long, est long")


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    one = lambda x: sets.select(F.col("id").alias(x), F.col("shingles").alias(f"f_{x}"))

    def run(batches):
        for batch in slices(batches, 1):
            ok = []
            for x, y in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    rows = pairs.select("a", "b").join(one("a"), "a").join(one("b"), "b").select("a", "f_a", "b", "f_b")
    return rows.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """id, comp (smallest id reachable over links a-b) of every linked node; links is checkpointed."""
    n = 2 * row_count(links)
    few = lambda df: sized(df, n)
    both = few(links.select("a", "b").union(links.select("b", "a")))
    labels = settled(few(both.groupBy(F.col("a").alias("id")).agg(F.min(F.least("a", "b")).alias("comp"))))
    while True:
        seen = few(both.join(labels.select(F.col("id").alias("b"), "comp"), "b")).groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("seen"))
        near = few(labels.join(few(seen), "id").select("id", F.col("comp").alias("old"), F.least("comp", "seen").alias("near")))
        jump = labels.select(F.col("id").alias("near"), F.col("comp").alias("far"))
        labels = settled(few(near.join(jump, "near").select("id", "old", F.least("near", "far").alias("comp"))))
        if labels.where("comp <> old").isEmpty():
            return labels.select("id", "comp")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    rows = settled(sketch_rows(docs, text, key))
    # a class of equal sets carries its smallest id; an id with several sets is one document, linked through all of them
    found = rows.where("set_id IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("doc"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n"), *(F.first(c).alias(c) for c in ("lids", "whole", "less")))
    classes = settled(found.withColumnRenamed("doc", "id"))
    lists = classes.select(F.explode("lids").alias("lid"), "id")
    # the smallest id of a list: lists of one large group mostly share it, so its members have few centres
    heads = lists.groupBy("lid").agg(F.count("*").alias("size"), F.min("id").alias("head")).where("size > 1").select("lid", "head")
    paired = lists.join(heads, "lid").where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"))
    # a small set is the centre of those with one value more; all of these link with it
    owners = classes.where("whole IS NOT NULL").select(F.col("whole").alias("lid"), F.col("id").alias("a"), (F.col("n") + 1).alias("n"))
    larger = classes.select(F.explode("less").alias("lid"), F.col("id").alias("b"), "n")
    pairs = settled(paired.union(larger.join(owners, ["lid", "n"]).where("a <> b").select("a", "b")).distinct())
    thin = classes.select("id", "n", "sketch")
    links = docs.sparkSession.createDataFrame([], "a long, b long")
    labels = None
    pairs = sized(pairs, row_count(pairs))
    todo = settled(_plausible(pairs, thin))
    if not todo.isEmpty():
        rows_todo = row_count(todo)
        todo = sized(todo, rows_todo)
        sets = written(_sets(docs, text, key, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), classes))
        # for every class its best pair; the same pair is often best for both
        ends = todo.select("a", "b", "est", F.explode(F.array("a", "b")).alias("end"))
        best = settled(ends.groupBy("end").agg(F.max(F.struct("est", "a", "b")).alias("p")).select("p.a", "p.b").distinct())
        for confirmed in (
            lambda: _confirm(best, sets),
            lambda: _confirm(settled(_apart(todo.join(best, ["a", "b"], "left_anti"), labels, rows_todo)), sets),
            lambda: _cross_links(_contested(pairs, labels, thin), sets),
        ):
            more = settled(confirmed())
            if labels is None or not more.isEmpty():
                links = settled(links.union(sized(more, row_count(more))))
                labels = components(links)
    final = classes.select("set_id", "id", F.col("id").alias("comp"))
    if labels is not None:
        final = final.drop("comp").join(labels, "id", "left").select("set_id", "id", F.coalesce("comp", "id").alias("comp"))
    final = final.select("set_id", "comp")
    out = rows.select("doc_id", "n_shingles", "set_id").join(final, "set_id", "left")
    comp = F.coalesce("comp", "doc_id")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), comp).alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))


def _apart(pairs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """The pairs whose ends are not in one component yet."""
    of = lambda x: labels.select(F.col("id").alias(x), F.col("comp").alias(f"c_{x}"))
    out = sized(pairs.join(of("a"), "a", "left"), rows).join(of("b"), "b", "left")
    return out.where("coalesce(c_a, a) <> coalesce(c_b, b)").select("a", "b")


def _contested(pairs: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """head, id, comp, main, chunks of the members of bundles that hold several components. A bundle is what shares a
    list with its centre, so members of one list are always together in one; ``chunks``: into how many parts it goes."""
    members = pairs.select(F.col("a").alias("head"), F.col("b").alias("id"))
    members = members.union(members.select("head", F.col("head").alias("id")).distinct())
    placed = members.join(labels, "id", "left").select("head", "id", F.coalesce("comp", "id").alias("comp")).join(classes.select("id", "n"), "id")
    sums = placed.groupBy("head", "comp").agg(F.count("*").alias("rows"), F.sum("n").alias("values"))
    bundles = sums.groupBy("head").agg(F.sum("rows").alias("rows"), F.sum("values").alias("values"), F.max(F.struct("rows", "comp")).alias("m"), F.count("*").alias("comps")).where("comps > 1")
    parts = F.ceil(F.greatest(F.col("rows") / CHUNK_ROWS, F.col("values") / CHUNK_VALUES)).cast("int")
    salted = bundles.select("head", F.col("m.comp").alias("main"), parts.alias("chunks"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = placed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, ["head", "salt"]).select("head", "id", "comp", "main", "chunks").distinct()


def compare(ids: np.ndarray, comps: np.ndarray, side: np.ndarray, sets: list[np.ndarray], main: int) -> list[tuple[int, int]]:
    """Links between components among some sets, by exact intersections: for each set one link to each component.

    ``side`` is 0 or 1: with both present only pairs of different sides count. Values found in one set only can't be
    shared; the others are the columns of a 0/1 matrix, and its product with itself holds all intersections."""
    sizes = np.array([len(s) for s in sets], np.int64)
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(code, minlength=len(values)) > 1
    column = np.cumsum(often) - 1
    row = np.repeat(np.arange(len(sets)), sizes)[often[code]]
    code = column[code[often[code]]]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    kind = np.float32 if sizes.max() < 1 << 24 else np.float64  # counts stay exact
    both = np.zeros((len(sets), len(sets)), kind)
    for low in range(0, int(often.sum()), 2048):
        i, j = np.searchsorted(code, [low, low + 2048])
        block = np.zeros((len(sets), 2048), kind)
        block[row[i:j], code[i:j] - low] = 1
        both += block @ block.T
    shared = both.astype(np.int64)
    linked = 100 * shared >= PERCENT * (sizes[:, None] + sizes[None, :] - shared)
    linked &= comps[:, None] != comps[None, :]
    if side.min() != side.max():
        linked &= side[:, None] != side[None, :]
    out = []
    for x in np.flatnonzero(linked.any(axis=1) & (comps != main)):
        y = np.flatnonzero(linked[x])
        out += [(int(ids[x]), int(ids[z])) for z in y[np.unique(comps[y], return_index=True)[1]]]
    return out


def _cross_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between the components of each bundle. A bundle's parts meet pairwise, in tasks of at most two parts; no
    pair becomes a row."""
    part = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    split = members.withColumn("part", part).withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
    split = split.withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other"))
    # parts without anything outside the main component have nothing to ask of each other
    asks = split.where("comp <> main").select("head", "low", "high").distinct()
    rows = split.join(asks, ["head", "low", "high"]).join(sets, "id").select("head", "low", "high", "id", "comp", "main", (F.col("part") == F.col("high")).cast("int").alias("side"), "shingles")

    def run(table: pa.Table) -> pa.Table:
        ids, comps, side = (table.column(c).to_numpy() for c in ("id", "comp", "side"))
        sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        found = compare(ids, comps, side, sets, table.column("main")[0].as_py())
        release()
        return pa.table({"a": pa.array([min(p) for p in found], pa.int64()), "b": pa.array([max(p) for p in found], pa.int64())})

    return rows.groupBy("head", "low", "high").applyInArrow(run, "a long, b long").distinct()


def _sets(docs: DataFrame, text: str, key: str, needed: DataFrame, classes: DataFrame) -> DataFrame:
    """id and full set of the needed classes, from the texts of their representatives."""

    def run(batches):
        for batch in slices(batches, 1):
            sets = [_hashing.shingles(w) for w in _hashing.many_word_hashes([t or "" for t in batch.column(1).to_pylist()])]
            ids = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "set_id", "shingles"])

    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).join(needed, "id", "left_semi")
    sets = texts.mapInArrow(run, "id long, set_id binary, shingles binary")
    return sets.join(classes.select("id", "set_id"), ["id", "set_id"], "left_semi").dropDuplicates(["id", "set_id"]).select("id", "shingles")


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose document stands for its component; of rows that repeat it, one."""
    kept = settled(near_duplicates(docs, text, key).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__k")).distinct())
    # join and choice among repeated ids share one shuffle; rows without an id all stay
    ids = docs.where(F.col(key).isNotNull()).join(kept, F.col(key) == F.col("__k"), "left_semi").dropDuplicates([key])
    return ids.unionByName(docs.where(F.col(key).isNull()))
