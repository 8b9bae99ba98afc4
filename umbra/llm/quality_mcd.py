"""Quality rules: base rules and robust multivariate outliers, with DataFrame functions only.

Each document gets a vector of four transformed statistics: log of the mean word length, and square roots of the
shares of symbols among characters, of repeated lines among lines with words, and of words inside repeated 3-word
windows. Every (lang, source) group gets a minimum-covariance-determinant estimate by concentration steps from two
starts (medians with median deviations; means with covariances), the start with the smaller determinant wins, and
a reweighting step follows. Documents whose squared Mahalanobis distance passes ``CUTOFF`` are rejected.

Distances are binned, and the h nearest rows are those up to the bin in which the h-th falls, so one aggregation by
(group, bin) a step is all a concentration step takes: rows are counted before the shuffle, whatever the group's
size. Statistics are whole numbers (ten-thousandths) and their sums exact, so results don't hang on the order of
tasks. Groups with fewer than ``MIN_GROUP`` rows are judged by an estimate over all rows of their language, or, if
those are fewer, over all rows of the table; only if that is smaller, too, the base rules decide alone. The
diagonals are widened by ``FLOOR``: a statistic that hardly varies in a group must still differ by 4.3 floors before it alone rejects. Where a statistic is 0 in a group that is 0.74 per cent of
symbols, 18.5 per cent of repeated lines, or 18.5 per cent of words in repeated windows.

Nulls: null text has no words and fails the base rules; null lang and source are groups of their own. Null ids,
repeated rows and further columns are kept as they come. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm._common import WORD_GAP, checkpointed, sized_broadcast, written

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MIN_GROUP = 50, 50
#: Standard deviations, in units of the statistics, added to each estimated one: about what one symbol, one repeated line
#: or one repeated window makes in a document of ordinary length.
FLOOR = (0.02, 0.02, 0.10, 0.10)
#: Share of rows in the h-subset, and what makes its covariance consistent for four normal statistics.
H_SHARE, H_FACTOR = 0.75, 1.4866
#: chi-square quantiles with 4 degrees of freedom: 0.975 for reweighting, 0.999 for rejection.
REWEIGHT, CUTOFF = 11.143, 18.467
SALTS, MAX_BROADCAST = 16, 20_000
_UNIT, _BINS, _D = 10_000, 16, range(4)
_X = [f"__x{i}" for i in _D]


def base_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (__n_lines) and base_failed."""
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("__w", F.array_remove(F.split(body, WORD_GAP), ""))
    out = out.withColumn("__l", F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    # windows by 64-bit hashes; __d: those found twice. Few of them are looked up, many are sorted with their places
    out = out.withColumn("__h", F.expr("if(size(__w) < 3, array(), transform(sequence(0, size(__w) - 3), i -> xxhash64(__w[i], __w[i + 1], __w[i + 2])))"))
    out = out.withColumn("__s", F.expr("CASE WHEN size(array_distinct(__h)) < size(__h) THEN sort_array(__h) END"))
    out = out.withColumn("__d", F.expr("array_distinct(array_compact(zip_with(slice(__s, 1, greatest(size(__s) - 1, 0)), slice(__s, 2, greatest(size(__s), 0)), (a, b) -> if(a = b, a, null))))"))
    out = out.withColumn("__p", F.expr("CASE WHEN size(__d) > 24 THEN sort_array(transform(__h, (x, i) -> struct(x AS x, i AS i))) END"))
    out = out.withColumn(
        "__q",
        F.expr("""CASE WHEN size(__d) > 24 THEN sort_array(array_distinct(flatten(zip_with(slice(__p, 1, size(__p) - 1), slice(__p, 2, size(__p)), (a, b) -> if(a.x = b.x, array(a.i, b.i), array())))))
            WHEN size(__d) > 0 THEN array_compact(transform(__h, (x, i) -> if(array_contains(__d, x), i, null))) END"""),
    )
    covered = F.expr("if(size(__q) > 0, aggregate(zip_with(slice(__q, 1, size(__q) - 1), slice(__q, 2, size(__q)), (a, b) -> least(3, b - a)), 3L, (s, x) -> s + x), 0L)")
    out = out.select(
        *docs.columns,
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("__q").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"),
        F.size("__l").cast("long").alias("__n_lines"),
    )
    return out.withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words"))


def _vectors(stats: DataFrame, key: str) -> DataFrame:
    whole = lambda e: F.expr(f"cast(round({_UNIT} * ({e})) AS long)")
    return stats.select(
        "*",
        F.to_json(F.struct(F.col("lang").cast("string").alias("l"), F.col("source").cast("string").alias("s"))).alias("__own"),
        F.concat(F.lit("lang "), F.to_json(F.struct(F.col("lang").cast("string").alias("l")))).alias("__lang"),
        F.pmod(F.xxhash64(key, "n_words", "word_chars"), F.lit(SALTS)).cast("int").alias("__salt"),
        whole("ln(try_divide(word_chars, n_words))").alias("__x0"),
        whole("sqrt(try_divide(n_symbols, word_chars))").alias("__x1"),
        whole("sqrt(try_divide(n_dup_lines, __n_lines))").alias("__x2"),
        whole("sqrt(try_divide(n_repeat_words, n_words))").alias("__x3"),
    )


def _salted(params: DataFrame) -> DataFrame:
    return params.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))


def _moments(where: Column | None = None) -> list[Column]:
    pick = lambda e: e if where is None else F.when(where, e)
    exact = lambda e: F.sum(pick(e.cast("decimal(20,0)")))
    return [F.count(pick(F.lit(1))).alias("__n"), *(exact(F.col(_X[i])).alias(f"__s{i}") for i in _D), *(exact(F.col(_X[i]) * F.col(_X[j])).alias(f"__s{i}{j}") for i in _D for j in range(i + 1))]


def _estimate(moments: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """Means, Cholesky factors of the covariances and the log of their determinants, from sums."""
    n = F.col("__n").cast("double")
    s = lambda x: F.col(f"__s{x}").cast("double")
    out = moments.where("__n > 0").select(*keys, *((s(i) / n / _UNIT).alias(f"__m{i}") for i in _D), *(((s(f"{i}{j}") / n - s(i) / n * (s(j) / n)) / _UNIT**2 * factor + (FLOOR[i] ** 2 if i == j else 0)).alias(f"__c{i}{j}") for i in _D for j in range(i + 1)))
    return _cholesky(out, keys)


def _cholesky(out: DataFrame, keys: list[str]) -> DataFrame:
    at = lambda a, i, j: F.col(f"__{a}{i}{j}")
    for i in _D:
        for j in range(i + 1):
            rest = at("c", i, j)
            for k in range(j):
                rest = rest - at("l", i, k) * at("l", j, k)
            out = out.withColumn(f"__l{i}{j}", F.sqrt(F.greatest(rest, F.lit(FLOOR[i] ** 2))) if i == j else rest / at("l", j, j))
    return out.select(*keys, *(f"__m{i}" for i in _D), *(f"__l{i}{j}" for i in _D for j in range(i + 1)), sum((F.log(at("l", i, i)) for i in _D), F.lit(0.0)).alias("__det"))


def _distance() -> Column:
    ys: list[Column] = []
    for i in _D:
        y = F.col(_X[i]) / _UNIT - F.col(f"__m{i}")
        for j in range(i):
            y = y - F.col(f"__l{i}{j}") * ys[j]
        ys.append(y / F.col(f"__l{i}{i}"))
    return sum((y * y for y in ys), F.lit(0.0))


def _concentrate(rows: DataFrame, params: DataFrame, keys: list[str]) -> DataFrame:
    """One C-step: new estimates from the h rows nearest to the given ones."""
    bins = F.least(F.floor(F.log1p(F.col("__d")) * _BINS), F.lit(1000)).cast("int")
    binned = rows.join(_salted(params), [*keys[:1], "__salt"]).withColumn("__d", _distance()).withColumn("__bin", bins).groupBy(*keys, "__bin").agg(*_moments())
    of = ", ".join(keys)
    upto = F.expr(f"sum(__n) OVER (PARTITION BY {of} ORDER BY __bin) - __n").alias("__below")
    total = F.expr(f"sum(__n) OVER (PARTITION BY {of})").alias("__all")
    near = binned.select("*", upto, total).where(F.col("__below") < F.ceil(F.lit(H_SHARE) * F.col("__all")))
    sums = [c for c in binned.columns if c not in (*keys, "__bin")]
    return _estimate(near.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums)), keys, H_FACTOR)


def _median(rows: DataFrame, values: list[str], names: list[str]) -> DataFrame:
    """By __g, the exact medians of whole-number columns, through counts by value."""
    counts = rows.select("__g", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.expr(v).alias("v")) for i, v in enumerate(values)))).alias("e")).groupBy("__g", "e.i", "e.v").count()
    below = counts.select("*", F.expr("sum(count) OVER (PARTITION BY __g, i ORDER BY v)").alias("upto"), F.expr("sum(count) OVER (PARTITION BY __g, i)").alias("all"))
    found = below.where("2 * upto >= all").groupBy("__g", "i").agg(F.min("v").alias("v"))
    return found.groupBy("__g").agg(*(F.max(F.when(F.col("i") == i, F.col("v"))).alias(n) for i, n in enumerate(names)))


def estimates(stats: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(groups, estimates): __own to the group __g it is judged by, and estimates by __g; both are small."""
    rows = checkpointed(_vectors(stats.where("NOT base_failed"), key).select("__own", "__lang", "__salt", *_X))
    sizes = rows.groupBy("__own", "__lang").count()
    pooled = sizes.groupBy("__lang").agg(F.sum("count").alias("pool"))
    own, everything = F.col("count") >= MIN_GROUP, F.lit("all")
    places = checkpointed(sizes.join(pooled, "__lang").select("__own", "__lang", F.when(own, F.col("__own")).when(F.col("pool") >= MIN_GROUP, F.col("__lang")).otherwise(everything).alias("__g")))
    groups = places.select("__own", "__g")
    # the rows of a group count in its own estimate, and in those of its language and of the table if small groups need them
    counts = places.select("__own", F.explode(F.array_distinct(F.array("__g", "__lang", everything))).alias("__g")).join(groups.select("__g").distinct(), "__g", "left_semi")
    rows = checkpointed(rows.join(_salted(checkpointed(counts)), ["__own", "__salt"]).select("__g", "__salt", *_X))
    at_middle = _median(rows, _X, [f"__m{i}" for i in _D])
    spread = _median(rows.join(_salted(at_middle), ["__g", "__salt"]), [f"abs({_X[i]} - __m{i})" for i in _D], [f"__mad{i}" for i in _D])
    start = at_middle.join(spread, "__g").select("__g", F.lit(0).alias("__start"), *((F.col(f"__m{i}") / _UNIT).alias(f"__m{i}") for i in _D), *((F.pow(1.4826 * F.col(f"__mad{i}") / _UNIT, 2) + FLOOR[i] ** 2 if i == j else F.lit(0.0)).alias(f"__c{i}{j}") for i in _D for j in range(i + 1)))
    keys = ["__g", "__start"]
    classic = _estimate(rows.groupBy("__g").agg(*_moments()).withColumn("__start", F.lit(1)), keys, 1.0)
    params = checkpointed(_cholesky(start, keys).unionByName(classic))
    for _ in range(3):
        params = _concentrate(rows, params, keys)
    params = checkpointed(params)
    best = F.expr("row_number() OVER (PARTITION BY __g ORDER BY __det, __start)")
    params = params.withColumn("__best", best).where("__best = 1").drop("__best", "__start")
    params = checkpointed(_concentrate(rows, params, ["__g"]))
    weighted = rows.join(_salted(params), ["__g", "__salt"]).withColumn("__d", _distance())
    final = _estimate(weighted.groupBy("__g").agg(*_moments(F.col("__d") <= REWEIGHT)), ["__g"], 1.0)
    enough = rows.groupBy("__g").count().where(F.col("count") >= MIN_GROUP).select("__g")
    return groups, checkpointed(final.join(enough, "__g"))


def quality_verdicts(stats: DataFrame, groups: DataFrame, params: DataFrame, key: str = "doc_id") -> DataFrame:
    """``stats`` with distance (squared, null without an estimate) and kept."""
    known = sized_broadcast(checkpointed(_salted(groups.join(params, "__g").drop("__g"))), MAX_BROADCAST)
    out = _vectors(stats, key).join(known, ["__own", "__salt"], "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    return out.select(*stats.columns, "distance", (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF)).alias("kept"))


def quality(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Statistics and verdict of every row; ``docs`` needs key, text, lang and source."""
    stats = checkpointed(base_statistics(docs.select(key, text, "lang", "source"), text).drop(text))
    return quality_verdicts(stats, *estimates(stats, key), key)


def keep_good(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that pass. Statistics are written beside the rows: they cost more than a copy does. Rows
    travel as one column, so that theirs may have any names."""
    rows = docs.select(*dict.fromkeys([key, text, "lang", "source"]), F.struct(*docs.columns).alias("__row"))
    stats = written(base_statistics(rows, text).drop(text))
    return quality_verdicts(stats, *estimates(stats, key), key).where("kept").select("__row.*")
