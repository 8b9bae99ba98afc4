"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Centroids and codebooks are fitted on a sample of at most ``FIT_ROWS`` rows (those with the smallest hashed ids);
every row is indexed. A query probes the lists whose centroids have the largest inner product with it and scores codes
by asymmetric distance tables (centroid part plus a table look-up for each subspace). The best ``RERANK`` of a block are
rescored exactly, in double precision, on the original vectors; the last of the best ``k`` of these is a bound, and every
row of the block that could reach it (its score plus the query's length times the length of what its code leaves out) is
rescored as well. So a probed list loses nothing, also where codes can't tell rows apart, as in a tight cluster. How many
lists are probed is measured, not guessed: up to ``CHECKED`` of the queries are held against all rows, and as many lists
are probed as hold ``AIM`` of their nearest. In 64 random dimensions that is most lists; where vectors cluster it is few.

A list is cut into blocks of about ``BLOCK_ROWS`` vectors and, if many queries probe it, those into parts as well, so a list that
holds a third of all rows (or one vector repeated) spreads over tasks. Ties go to the smaller id at every step.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id. Vectors
of different lengths have no inner product: each length is indexed and searched by itself. Rows that repeat an id
count once (the longest vector, then the first in order). Fewer candidates than ``k``: all of them. Further columns
are ignored, whatever their names. Empty table: empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm._common import checkpointed

FIT_ROWS, RERANK, BLOCK_ROWS, QUERY_PART = 20_000, 256, 4096, 2048
MAX_LISTS, CHECKED, AIM = 4096, 256, 0.97
SUBSPACES, CODES = 16, 256


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part."""
    e = F.col("embedding")
    rows = vectors.where(F.col("vec_id").isNotNull() & e.isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding"))
    rows = rows.where(F.expr("forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')) AND exists(embedding, x -> x <> 0)"))
    first = rows.groupBy("vec_id").agg(F.min(F.struct((-F.size("embedding")).alias("d"), "embedding")).alias("v"))
    return first.select("vec_id", "v.embedding")


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
        if (n == 0).any():  # an empty cell takes a row of the fullest
            c[n == 0] = x[rng.choice(np.flatnonzero(own == n.argmax()), int((n == 0).sum()))]
    return c


class Index:
    """Coarse centroids and codebooks; both are bounded by parameters, not by the table."""

    def __init__(self, sample: np.ndarray, n_rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        sample = np.asarray(sample, np.float64)
        self.lists = max(1, min(MAX_LISTS, int(np.sqrt(n_rows) / 2), len(sample)))
        self.coarse = _kmeans(sample, self.lists, 12, rng)
        self.probes = self.lists
        residual = sample - self.coarse[self.assign(sample)]
        self.cuts = [a for a in np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1])) if len(a)]
        self.books = [_kmeans(residual[:, a], min(CODES, len(sample)), 8, rng) for a in self.cuts]

    def assign(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.coarse.T - 0.5 * (self.coarse**2).sum(1)).argmax(1)

    def encode(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        r = x - self.coarse[own]
        return np.stack([(r[:, a] @ b.T - 0.5 * (b * b).sum(1)).argmax(1) for a, b in zip(self.cuts, self.books, strict=True)], 1).astype(np.uint8)

    def left_out(self, x: np.ndarray, own: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Length of the difference between each vector and what its list and code say."""
        r = x - self.coarse[own]
        for s, (a, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            r[:, a] -= b[codes[:, s]]
        return np.sqrt((r * r).sum(1))

    def probe(self, q: np.ndarray) -> np.ndarray:
        return np.argsort(-(q @ self.coarse.T), axis=1, kind="stable")[:, : self.probes]

    def scores(self, q: np.ndarray, own: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric: exact queries against coded vectors of one list."""
        out = np.repeat((q @ self.coarse[own])[:, None], len(codes), 1)
        for s, (a, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            out += (q[:, a] @ b.T)[:, codes[:, s]]
        return out


def exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products whose last bits depend on the two vectors alone, not on their place in a block."""
    return np.ascontiguousarray(v * q).sum(axis=1)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in column])


def fit(rows: DataFrame, n: int) -> Index:
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("embedding").toPandas()  # bounded
    return Index(_matrix(sample["embedding"]), n)


def measured(index: Index, filed: DataFrame, asked: DataFrame, k: int) -> int:
    """Lists to probe, so that the nearest of some queries among all rows lie in them with a share of ``AIM``."""
    some = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CHECKED).toPandas()  # bounded
    if not len(some):
        return index.lists
    qid, qx = some["vec_id"].to_numpy(), _matrix(some["embedding"])
    place = np.argsort(index.probe(qx), axis=1)  # of each list in each query's order

    def best(frames):
        s, own = np.full((len(qid), 0), -np.inf), np.zeros((len(qid), 0), np.int64)
        for pdf in frames:
            if not len(pdf):
                continue
            more = qx @ _matrix(pdf["embedding"]).T
            more[qid[:, None] == pdf["vec_id"].to_numpy()] = -np.inf
            s = np.concatenate([s, more], axis=1)
            own = np.concatenate([own, np.broadcast_to(pdf["list"].to_numpy(np.int64), more.shape)], axis=1)
            if s.shape[1] > k:
                near = np.argpartition(-s, k - 1, axis=1)[:, :k]
                s, own = np.take_along_axis(s, near, 1), np.take_along_axis(own, near, 1)
        at = np.repeat(np.arange(len(qid)), s.shape[1])
        real = np.isfinite(s.ravel())
        yield pd.DataFrame({"query": at[real].astype(np.int32), "place": place[at, own.ravel()][real].astype(np.int32), "score": s.ravel()[real]})

    near = filed.select("list", "vec_id", "embedding").mapInPandas(best, "query int, place int, score double")
    near = near.withColumn("__r", F.expr("row_number() OVER (PARTITION BY query ORDER BY score DESC, place)")).where(f"__r <= {k}")
    held = sorted(r[0] for r in near.select("place").collect())  # at most k a query
    return held[int(np.ceil(AIM * len(held))) - 1] + 1 if held else index.lists


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row (vec_id, embedding) its ``k`` nearest others."""
    rows = checkpointed(usable(vectors))
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for d, n in sorted(tuple(r) for r in rows.groupBy(F.size("embedding")).count().collect()):  # one row a length
        out = out.unionByName(_search(rows.where(F.size("embedding") == d), queries, n, k))
    return out


def _search(rows: DataFrame, queries: DataFrame, n: int, k: int) -> DataFrame:
    spark = rows.sparkSession
    out = "query_id long, vec_id long, score double"
    index = fit(rows, n)
    asked = rows.join(queries.select("vec_id").distinct(), "vec_id", "left_semi")

    def put(frames):
        for pdf in frames:
            x = _matrix(pdf["embedding"])
            own = index.assign(x)
            codes = index.encode(x, own)
            yield pd.DataFrame({"list": own.astype(np.int32), "vec_id": pdf["vec_id"], "embedding": pdf["embedding"], "codes": [c.tobytes() for c in codes], "left_out": index.left_out(x, own, codes)})

    def ask(frames):
        for pdf in frames:
            lists = index.probe(_matrix(pdf["embedding"]))
            yield pdf.loc[pdf.index.repeat(lists.shape[1])].assign(list=lists.ravel().astype(np.int32))

    filed = checkpointed(rows.mapInPandas(put, "list int, vec_id long, embedding array<double>, codes binary, left_out double"))
    index.probes = measured(index, filed, asked, k)
    probing = asked.mapInPandas(ask, "vec_id long, embedding array<double>, list int")
    sizes = filed.groupBy("list").count().collect()  # at most MAX_LISTS rows
    wanted = {r[0]: r[1] for r in probing.groupBy("list").count().collect()}
    blocks = {r[0]: -(-r[1] // BLOCK_ROWS) for r in sizes}
    parts = {n: -(-wanted.get(n, 0) // QUERY_PART) for n in blocks}
    grid = spark.createDataFrame([(n, blocks[n], max(1, parts[n])) for n in blocks], "list int, blocks int, parts int")
    place = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    v = filed.join(grid, "list").select("list", place("blocks").alias("block"), F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), "vec_id", "embedding", "codes", "left_out")
    q = probing.join(grid, "list").select("list", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), place("parts").alias("part"), "vec_id", "embedding")

    def near(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        v = v.sort_values("vec_id")
        ids, x = v["vec_id"].to_numpy(), _matrix(v["embedding"])
        codes = np.frombuffer(b"".join(v["codes"]), np.uint8).reshape(len(v), -1)
        qid, qx = q["vec_id"].to_numpy(), _matrix(q["embedding"])
        left_out, longest = v["left_out"].to_numpy(), float(np.sqrt((x * x).sum(1)).max())
        first, found = max(RERANK, k), []
        for i in range(0, len(q), 256):
            qs, names = qx[i : i + 256], qid[i : i + 256]
            rough = index.scores(qs, int(v["list"].iloc[0]), codes)
            rough[names[:, None] == ids] = -np.inf
            length = np.sqrt((qs * qs).sum(1))
            least = np.full(len(qs), -np.inf)
            if len(ids) > first + 1:
                top = np.argpartition(-rough, first - 1, axis=1)[:, :first]
                for j in range(len(qs)):
                    least[j] = np.partition(exact(qs[j], x[top[j]]), first - k)[first - k]
            least -= 1e-9 * length * longest  # what rounding may take
            may = (rough + length[:, None] * left_out >= least[:, None]) & (rough > -np.inf)
            some = np.flatnonzero(may.any(axis=0))
            may = may[:, some] & (qs @ x[some].T >= least[:, None])
            for j in range(len(qs)):
                pick = some[may[j]]
                s = exact(qs[j], x[pick])
                best = np.lexsort((ids[pick], -s))[:k]
                found.append((np.full(len(best), names[j]), ids[pick][best], s[best]))
        return pd.DataFrame({n: np.concatenate([f[c] for f in found]) for c, n in enumerate(("query_id", "vec_id", "score"))})

    by = ["list", "block", "part"]
    hits = q.groupBy(*by).cogroup(v.groupBy(*by)).applyInPandas(near, out)
    ranked = hits.withColumn("rank", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)").cast("int")).where(f"rank <= {k}")
    return ranked.select("query_id", "rank", "vec_id", "score")
