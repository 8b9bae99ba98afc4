"""Scoring analytics by byte intervals. Three zero-denominator rules are kept apart, as they mean different things."""

from __future__ import annotations

from math import exp, expm1, inf, lgamma, log, log1p

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbra.operators import spans as sp


def ratio(n: Column, d: Column) -> Column:
    """1 for any zero denominator (per-corpus evaluation)."""
    return F.when(d == 0, 1.0).otherwise(n / d)


def safe_ratio(n: Column, d: Column) -> Column:
    """1 for 0/0, 0 for n/0 (benchmark accumulator)."""
    return F.when(d != 0, n / d).when(n == 0, 1.0).otherwise(0.0)


def byte_micro_f2(tp: Column, fn: Column, fp: Column) -> Column:
    """0 for a zero denominator."""
    d = 5 * tp + 4 * fn + fp
    return F.when(d == 0, 0.0).otherwise(5 * tp / d)


def byte_scores(gold: DataFrame, predicted: DataFrame, keys: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """By key: gold_bytes, predicted_bytes, tp_bytes, leaked_bytes, fp_bytes."""
    size = lambda d, n: sp.merge(d, keys).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias(n))
    out = size(gold, "gold_bytes").join(size(predicted, "predicted_bytes"), keys, "full").join(sp.intersection_length(gold, predicted, keys).withColumnRenamed("both", "tp_bytes"), keys, "left").na.fill(0)
    return out.withColumn("leaked_bytes", F.col("gold_bytes") - F.col("tp_bytes")).withColumn("fp_bytes", F.col("predicted_bytes") - F.col("tp_bytes"))


def totals(scores: DataFrame) -> DataFrame:
    sums = scores.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("gold_bytes", "predicted_bytes", "tp_bytes", "leaked_bytes", "fp_bytes")), F.count(F.when(F.col("leaked_bytes") == 0, 1)).alias("zero_leak_docs"), F.count("*").alias("docs"))
    p, r = ratio(F.col("tp_bytes"), F.col("predicted_bytes")), ratio(F.col("tp_bytes"), F.col("gold_bytes"))
    f1 = F.when((F.col("gold_bytes") == 0) & (F.col("predicted_bytes") == 0), 1.0).when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))
    return sums.withColumns({"precision": p, "recall": r, "f1": f1, "f2": byte_micro_f2(F.col("tp_bytes"), F.col("leaked_bytes"), F.col("fp_bytes"))})


def per_class(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """By class of gold: gold_bytes, covered_bytes, leaked_bytes, entities, fully_covered. An interval that stands under
    several classes counts in each; what is covered of it is a matter of its place alone. Empty intervals are no entities."""
    real = gold.where("start < end")
    one = real.select("doc_id", F.col("start").alias("gs"), F.col("end").alias("ge")).distinct()
    inside = sp.merge(predicted.where("start < end"), ["doc_id"]).join(one, "doc_id").where("start < ge AND gs < end")
    covered = inside.groupBy("doc_id", "gs", "ge").agg(F.sum(F.least("end", "ge") - F.greatest("start", "gs")).alias("covered"))
    at = [F.col("g.doc_id") == F.col("c.doc_id"), F.col("g.start") == F.col("c.gs"), F.col("g.end") == F.col("c.ge")]
    all_ = real.alias("g").join(covered.alias("c"), at, "left").select("g.class", (F.col("g.end") - F.col("g.start")).alias("size"), F.coalesce("covered", F.lit(0)).alias("covered"))
    return all_.groupBy("class").agg(F.sum("size").alias("gold_bytes"), F.sum("covered").alias("covered_bytes"), F.sum(F.col("size") - F.col("covered")).alias("leaked_bytes"), F.count("*").alias("entities"), F.count(F.when(F.col("covered") == F.col("size"), 1)).alias("fully_covered"))


def leak_diff(gold: DataFrame, base: DataFrame, candidate: DataFrame, keys: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """Bytes newly exposed and newly protected by the candidate run."""
    size = lambda d, n: d.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias(n))
    left_base, left_new = sp.subtract(gold, base, keys), sp.subtract(gold, candidate, keys)
    return size(sp.subtract(left_new, left_base, keys), "newly_exposed").join(size(sp.subtract(left_base, left_new, keys), "newly_protected"), keys, "full").na.fill(0)


def leak_causes(gold: DataFrame, winners: DataFrame, losers: DataFrame, vetoed: DataFrame) -> DataFrame:
    """Each gold span's first matching cause, in a fixed order: covered, vetoed, lost, partial, never_proposed."""
    one = lambda d, n: d.select("doc_id", F.col("start").alias(f"s_{n}"), F.col("end").alias(f"e_{n}"))
    out = gold
    for d, n in ((winners, "w"), (vetoed, "v"), (losers, "l")):
        hit = gold.join(one(d, n), "doc_id").where(f"s_{n} < end AND start < e_{n}").groupBy("doc_id", "start", "end").agg(F.max((F.col(f"s_{n}") <= F.col("start")) & (F.col("end") <= F.col(f"e_{n}"))).alias(n))
        out = out.join(hit, ["doc_id", "start", "end"], "left")
    cause = F.when(F.col("w"), "covered").when(F.col("v").isNotNull(), "vetoed").when(F.col("l").isNotNull(), "lost").when(F.col("w").isNotNull(), "partial").otherwise("never_proposed")
    return out.withColumn("cause", cause).drop("w", "v", "l")


def stratified_sample(rows: DataFrame, strata: list[str], key: str, n: int, seed: str) -> DataFrame:
    """``n`` rows: largest remainders by stratum size, inside a stratum by hash of seed and key.

    A stratum's first rows come from its buckets of hashes: counts by bucket say which ones are taken whole and in
    which one the last row lies, so only that bucket is sorted, whatever the stratum's size."""
    hashed = rows.withColumn("__h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)).withColumn("__b", F.substring("__h", 1, 3))
    buckets = hashed.groupBy(*strata, "__b").agg(F.count("*").alias("__n"))
    sizes = buckets.groupBy(*strata).agg(F.sum("__n").alias("size"))
    shares = sizes.withColumn("total", F.expr("sum(size) OVER ()"))  # one row a stratum
    exact = F.col("size") * n
    shares = shares.withColumn("floor", F.floor(exact / F.col("total"))).withColumn("rest", exact % F.col("total"))
    spare = F.lit(n) - F.expr("sum(floor) OVER ()")
    order = ", ".join(f"cast({s} as string)" for s in strata)
    shares = shares.withColumn("take", F.col("floor") + F.when(F.expr(f"row_number() OVER (ORDER BY rest DESC, {order})") <= spare, 1).otherwise(0))
    same = lambda a, b, more=(): [F.col(f"{a}.{s}").eqNullSafe(F.col(f"{b}.{s}")) for s in (*strata, *more)]
    upto = buckets.withColumn("__before", F.expr(f"sum(__n) OVER (PARTITION BY {', '.join(strata)} ORDER BY __b) - __n"))
    wanted = upto.alias("u").join(shares.alias("s"), same("u", "s")).where("__before < take").select("u.*", (F.col("take") - F.col("__before")).alias("__left"))
    near = hashed.alias("h").join(wanted.alias("w"), same("h", "w", ["__b"])).select("h.*", "w.__n", "w.__left")
    rank = F.expr(f"row_number() OVER (PARTITION BY {', '.join(strata)}, __b ORDER BY __h, {key})")
    return near.withColumn("__r", rank).where("__r <= __left").drop("__h", "__b", "__n", "__left", "__r")


def timing(rows: DataFrame, value: str) -> DataFrame:
    q = lambda p: F.expr(f"percentile({value}, {p})")
    return rows.agg(F.avg(value).alias("mean"), q(0.5).alias("median"), q(0.95).alias("p95"), q(0.99).alias("p99"), F.max(value).alias("max"))


def gold_gap_credit(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Predicted spans outside gold that repeat a labelled value of the document with the same class, once a byte."""
    outside = predicted.join(gold.select("doc_id", F.col("start").alias("gs"), F.col("end").alias("ge")), "doc_id", "left")
    free = outside.groupBy("doc_id", "start", "end", "class", "value").agg(F.max(F.coalesce((F.col("start") < F.col("ge")) & (F.col("gs") < F.col("end")), F.lit(False))).alias("hit")).where("NOT hit").drop("hit")
    return free.join(gold.select("doc_id", "class", "value").distinct(), ["doc_id", "class", "value"], "left_semi").dropDuplicates(["doc_id", "start", "end"])


def _beta_cdf(x: float, a: float, b: float) -> float:
    """Regularized incomplete beta function, by its continued fraction evaluated from the far end."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_cdf(1 - x, b, a)
    value = 0.0
    for m in range(400, 0, -1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        value = even / (1 + odd / (1 + value))
    first = -(a + b) * x / (a + 1)
    return exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x)) / a / (1 + first / (1 + value))


def clopper_pearson_upper(failures: int, n: int, confidence: float = 0.95) -> float:
    """Upper bound of a rate: the beta distribution's quantile, found by secants that keep the root between them."""
    if n == 0 or failures >= n:
        return 1.0
    if failures == 0:
        return -expm1(log1p(-confidence) / n)
    miss = lambda p: _beta_cdf(p, failures + 1, n - failures) - confidence
    a, b = failures / n, 1.0
    fa, fb = miss(a), 1 - confidence
    while b - a > 1e-15 * b:
        p = b - fb * (b - a) / (fb - fa)
        p = p if a < p < b else (a + b) / 2
        f = miss(p)
        if abs(f) < 1e-15:
            return p
        if f < 0:
            a, fa, fb = p, f, fb / 2
        else:
            b, fb, fa = p, f, fa / 2
    return b


def design_effect(sizes: list[int], hits: list[int]) -> float:
    """Variance of a rate over clusters against that of as many single draws, both with the small-sample correction: 1
    for clusters of one, infinite for a single cluster, 1 where all or none are hit."""
    n, m = sum(sizes), len(sizes)
    if sum(hits) in (0, n):
        return 1.0
    if m < 2:
        return inf
    p = sum(hits) / n
    spread = sum((h - p * s) ** 2 for s, h in zip(sizes, hits, strict=True))
    return spread * m * (n - 1) / ((m - 1) * n**2 * p * (1 - p))


def design_effects(entries: DataFrame) -> DataFrame:
    """design_effect of entries (document_id, failed), by sums of documents' sums: one shuffle, one row."""
    by = entries.groupBy("document_id").agg(F.count("*").alias("s"), F.sum(F.col("failed").cast("int")).alias("h"))
    t = by.agg(*(F.sum(e).cast("double").alias(n) for e, n in ((F.col("s"), "n"), (F.col("h"), "k"), (F.col("h") * F.col("h"), "hh"), (F.col("h") * F.col("s"), "hs"), (F.col("s") * F.col("s"), "ss"))), F.count("*").alias("m"))
    p = F.col("k") / F.col("n")
    spread = F.col("hh") - 2 * p * F.col("hs") + p * p * F.col("ss")
    effect = spread * F.col("m") * (F.col("n") - 1) / ((F.col("m") - 1) * F.col("n") * F.col("n") * p * (1 - p))
    return t.select(F.col("m").alias("documents"), F.when(p.isin(0.0, 1.0), 1.0).when(F.col("m") < 2, float("inf")).otherwise(effect).alias("design_effect"))


# contract scoring ---------------------------------------------------------------------------------------------


def contract_view(gold: DataFrame, excluded: DataFrame, predicted: DataFrame, neutral: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(gold, ignored, predictions that count): bytes that only labels out of the contract cover, or predictions of
    neutral classes, are outside of the score; a prediction that lies in them altogether is, too."""
    cols = ["doc_id", "start", "end"]
    whole = sp.merge(gold.select(*cols), ["doc_id"])
    out = sp.subtract(excluded.select(*cols).union(predicted.where(F.col("class").isin(neutral)).select(*cols)), whole, ["doc_id"])
    inside = (F.col("p.doc_id") == F.col("i.doc_id")) & (F.col("i.start") <= F.col("p.start")) & (F.col("p.end") <= F.col("i.end"))
    return whole, out, predicted.alias("p").join(out.alias("i"), inside, "left_anti")


def gold_gap_credits(texts: DataFrame, gold: DataFrame, predicted: DataFrame, blocked: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id, start, end, label, class, gold_start, gold_end: bytes of predictions outside of gold that spell, trimmed
    and at word edges, a labelled value of their document with a class that fits the label (``pairs``: class, label).
    The first such gold value counts, and where predictions overlap each byte is credited to the earliest."""
    value = lambda: F.decode(F.substr(F.encode("text", "UTF-8"), F.col("start") + 1, F.col("end") - F.col("start")), "UTF-8")
    held = gold.join(texts, "doc_id").select("doc_id", value().alias("value"), "label", F.col("start").alias("gold_start"), F.col("end").alias("gold_end"))
    cond = (F.col("p.doc_id") == F.col("b.doc_id")) & (F.col("b.start") < F.col("p.end")) & (F.col("p.start") < F.col("b.end"))
    free = predicted.alias("p").join(blocked.alias("b"), cond, "left_anti").join(texts, "doc_id").withColumn("value", value())
    strip = "[\\s.,;:!?\"'()]"
    left = F.octet_length("value") - F.octet_length(F.regexp_replace("value", f"^{strip}+", ""))
    right = F.octet_length("value") - F.octet_length(F.regexp_replace("value", f"{strip}+$", ""))
    trimmed = free.withColumn("s", F.col("start") + left).withColumn("e", F.col("end") - right).where("s < e")
    trimmed = trimmed.withColumn("value", F.regexp_replace("value", f"^{strip}+|{strip}+$", ""))
    body = F.encode("text", "UTF-8")
    before = F.decode(F.substr(body, F.lit(1), F.col("s")), "UTF-8")
    after = F.decode(F.substr(body, F.col("e") + 1, F.lit(4)), "UTF-8")
    edges = trimmed.where(~before.rlike("[\\p{L}\\p{N}\\p{M}]$") & ~after.rlike("^[\\p{L}\\p{N}\\p{M}]"))
    fits = edges.join(held, ["doc_id", "value"]).join(pairs, ["class", "label"])
    one = fits.groupBy("doc_id", "s", "e", "class").agg(F.min(F.struct("gold_start", "gold_end", "label")).alias("g"))
    # earlier claims reach up to a running maximum; what lies beyond it is fresh
    w = Window.partitionBy("doc_id").orderBy("s", "e", "g.gold_start", "g.gold_end", "g.label", "class")
    fresh = one.withColumn("start", F.greatest(F.col("s"), F.coalesce(F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))).where("start < e")
    return fresh.select("doc_id", "start", F.col("e").alias("end"), "g.label", "class", "g.gold_start", "g.gold_end")


def entity_metrics(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: entities (all, fully covered, overlapped, exact) and predicted spans (all, those that overlap gold), with
    their rates by ``safe_ratio``."""
    keys = ["doc_id", "start", "end"]
    g, p = gold.select(*keys, "label").distinct(), predicted.select(*keys, "class").distinct()
    near = lambda a, b: (F.col(f"{a}.doc_id") == F.col(f"{b}.doc_id")) & (F.col(f"{a}.start") < F.col(f"{b}.end")) & (F.col(f"{b}.start") < F.col(f"{a}.end"))
    merged = sp.merge(p, ["doc_id"])
    hit = g.alias("g").join(merged.alias("m"), near("g", "m")).groupBy("g.doc_id", "g.start", "g.end", "g.label").agg(F.max((F.col("m.start") <= F.col("g.start")) & (F.col("g.end") <= F.col("m.end"))).alias("whole"))
    exact = g.join(p.select(*keys).distinct(), keys, "left_semi").agg(F.count("*").alias("exact"))
    spans = p.alias("g").join(sp.merge(g, ["doc_id"]).alias("m"), near("g", "m"), "left_semi").agg(F.count("*").alias("spans_overlapped"))
    out = g.agg(F.count("*").alias("entities")).join(hit.agg(F.count("*").alias("overlapped"), F.count(F.when(F.col("whole"), 1)).alias("fully_covered"))).join(exact).join(p.agg(F.count("*").alias("spans"))).join(spans)  # rows of one
    rates = {"full_coverage_recall": ("fully_covered", "entities"), "overlap_recall": ("overlapped", "entities"), "exact_recall": ("exact", "entities"), "overlap_precision": ("spans_overlapped", "spans")}
    return out.withColumns({n: safe_ratio(F.col(a), F.col(b)) for n, (a, b) in rates.items()})


def validity_buckets(gold: DataFrame, covered: DataFrame) -> DataFrame:
    """By label and bucket (validator_passed_gold, validator_failed_gold): entities, bytes and covered bytes of the gold
    whose label has a validator (``passed`` is not null). covered: disjoint spans."""
    near = (F.col("g.doc_id") == F.col("c.doc_id")) & (F.col("g.start") < F.col("c.end")) & (F.col("c.start") < F.col("g.end"))
    size = F.when(F.col("c.start").isNull(), 0).otherwise(F.least("g.end", "c.end") - F.greatest("g.start", "c.start"))
    each = gold.where("passed IS NOT NULL").alias("g").join(sp.merge(covered, ["doc_id"]).alias("c"), near, "left").groupBy("g.doc_id", "g.start", "g.end", "g.label", "g.passed").agg(F.sum(size).alias("covered"))
    return each.groupBy("label", F.when(F.col("passed"), "validator_passed_gold").otherwise("validator_failed_gold").alias("bucket")).agg(F.count("*").alias("entities"), F.sum(F.col("end") - F.col("start")).alias("bytes"), F.sum("covered").alias("covered_bytes"))


#: Refusals by kind.
UNTRANSFORMABLE, POSSIBLY_SENSITIVE = "untransformable_", "possibly_sensitive_refused"


def outcome_counters(docs: DataFrame, gold: DataFrame, ignored: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row of counters. docs: doc_id, n_bytes and refused (a code, or null); gold and ignored: merged spans;
    predicted: spans that count, with class. Family classes are ambiguous values."""
    size = lambda d, n: d.groupBy("doc_id").agg(F.sum(F.col("end") - F.col("start")).alias(n))
    base = docs.join(size(gold, "gold"), "doc_id", "left").join(size(ignored, "out"), "doc_id", "left").na.fill(0, ["gold", "out"]).withColumn("plain", F.col("n_bytes") - F.col("gold") - F.col("out"))
    shown = predicted.join(docs.where("refused IS NULL").select("doc_id"), "doc_id", "left_semi").distinct()
    shut = gold.select("doc_id", "start", "end").union(ignored.select("doc_id", "start", "end"))
    keyed = shown.withColumn("key", F.concat_ws(":", "doc_id", "start", "end", "class"))
    inside = shut.alias("s").join(keyed.alias("k"), (F.col("s.doc_id") == F.col("k.doc_id")) & (F.col("s.start") < F.col("k.end")) & (F.col("k.start") < F.col("s.end"))).select("k.key", F.greatest("s.start", "k.start").alias("start"), F.least("s.end", "k.end").alias("end"))
    held = sp.merge(inside, ["key"]).groupBy("key").agg(F.sum(F.col("end") - F.col("start")).alias("held"))
    touch = gold.alias("s").join(keyed.alias("k"), (F.col("s.doc_id") == F.col("k.doc_id")) & (F.col("s.start") < F.col("k.end")) & (F.col("k.start") < F.col("s.end"))).select("k.key").distinct().withColumn("touches", F.lit(True))
    each = keyed.join(held, "key", "left").join(touch, "key", "left").withColumn("wrong", F.col("end") - F.col("start") > F.coalesce("held", F.lit(0))).withColumn("ambiguous", F.col("class").startswith("custom:family:"))
    lost = size(sp.subtract(shown, shut, ["doc_id"]), "lost")
    by_doc = each.groupBy("doc_id").agg(F.max(F.col("wrong")).alias("any"), F.max(F.col("wrong") & ~F.col("ambiguous")).alias("sure"))
    kind = F.when(F.col("refused").startswith(UNTRANSFORMABLE), "untransformable").when(F.col("refused") == POSSIBLY_SENSITIVE, "possibly_sensitive").otherwise("fail_closed")
    count = lambda c: F.count(F.when(c, 1))
    d = base.join(by_doc, "doc_id", "left").join(lost, "doc_id", "left").na.fill(0, ["lost"])
    refused = F.col("refused").isNotNull()
    docs_row = d.agg(
        F.count("*").alias("attempted_documents"), count(refused).alias("blocked_documents"), *(count(refused & (kind == k)).alias(f"blocked_{k}") for k in ("untransformable", "possibly_sensitive", "fail_closed")),
        count(refused & (F.col("gold") == 0)).alias("fp_refusal_documents"), count(F.col("any")).alias("fp_documents"), count(F.col("any") & ~F.col("sure")).alias("fp_documents_ambiguous_only"),
        F.sum("plain").alias("non_pii_bytes"), F.sum("lost").alias("lost_to_false_positive_bytes"), F.sum(F.when(refused, F.col("plain")).otherwise(0)).alias("lost_to_refusal_bytes"),
    )
    values = each.agg(*(count((F.col("ambiguous") == amb) & cond).alias(f"{name}_{n}") for amb, name in ((False, "confirmed"), (True, "possibly_sensitive")) for n, cond in (("values", F.lit(True)), ("gold_values", F.col("touches")), ("false_positive_values", F.col("wrong")))))
    return docs_row.join(values).withColumn("retained_non_pii_bytes", F.col("non_pii_bytes") - F.col("lost_to_false_positive_bytes") - F.col("lost_to_refusal_bytes"))  # rows of one


#: Causes of a leak by letter.
LEDGER = {"d": "partial span", "b": "vetoed", "g": "other", "c": "lost in resolution", "e": "repeat not swept", "f": "junk-shaped gold", "a": "no candidate"}
DIGIT_LABELS = ("phone", "credit_card", "iban", "ssn", "passport", "national_id")


def leak_ledger(gold: DataFrame, trace: DataFrame, detected: DataFrame, vetoed: DataFrame, resolved: DataFrame, gated: DataFrame) -> DataFrame:
    """Leaked gold spans (doc_id, start, end, label, value) with the first cause that fits: d partly covered, b vetoed, g
    its best candidate won but was not emitted, c it lost to a winner, b it was dropped before or gated by locale, e a
    copy of the value is protected, f junk-shaped, a nothing. The other tables: doc_id, start, end, class, recognizer_id;
    trace also value."""
    keys = ["doc_id", "start", "end", "label", "value"]
    near = lambda t: (F.col("g.doc_id") == F.col(f"{t}.doc_id")) & (F.col("g.start") < F.col(f"{t}.end")) & (F.col(f"{t}.start") < F.col("g.end"))
    g = gold.select(*keys).distinct()
    share = F.least("g.end", "t.end") - F.greatest("g.start", "t.start")
    covered = g.alias("g").join(sp.merge(trace, ["doc_id"]).alias("t"), near("t")).groupBy(*(f"g.{k}" for k in keys)).agg(F.sum(share).alias("covered"))
    out = g.join(covered, keys, "left").na.fill(0, ["covered"]).where(F.col("covered") < F.col("end") - F.col("start"))

    def best(d, n):
        """The candidate that overlaps most, then the shortest, then the last by rule and place."""
        rank = F.struct(share.alias("o"), (F.col("t.start") - F.col("t.end")).alias("l"), F.col("t.recognizer_id").alias("r"), F.col("t.start").alias("s"), F.col("t.end").alias("e"))
        return g.alias("g").join(d.alias("t"), near("t")).groupBy(*(f"g.{k}" for k in keys)).agg(F.max(rank).alias(n))

    out = out.join(best(vetoed, "veto"), keys, "left").join(best(detected, "seen"), keys, "left").join(best(gated, "gate"), keys, "left")
    won = resolved.select("doc_id", F.col("start").alias("ws"), F.col("end").alias("we"), F.col("recognizer_id").alias("wr")).distinct()
    met = out.where("seen IS NOT NULL").join(won, "doc_id").where("ws < seen.e AND seen.s < we").groupBy(*keys).agg(F.max((F.col("ws") == F.col("seen.s")) & (F.col("we") == F.col("seen.e")) & (F.col("wr") == F.col("seen.r"))).alias("itself"))
    copies = trace.select("doc_id", "value", F.col("start").alias("at")).distinct()
    again = out.join(copies, ["doc_id", "value"]).where("at <> start").select(*keys).distinct().withColumn("again", F.lit(True))
    letters, digits = F.length(F.regexp_replace("value", r"[^\p{L}\p{N}]", "")), F.col("value").rlike(r"\p{Nd}")
    junk = (letters == 0) | (F.col("label").isin(*DIGIT_LABELS) & (~digits | (letters <= 4)))
    out = out.join(met, keys, "left").join(again, keys, "left")
    step = F.when(F.col("covered") > 0, "d").when(F.col("veto").isNotNull(), "b").when(F.col("itself"), "g").when(F.col("itself").isNotNull(), "c").when(F.col("seen").isNotNull(), "b").when(F.col("gate").isNotNull(), "b").when(F.col("again"), "e").when(junk, "f").otherwise("a")
    return out.select(*keys, "covered", step.alias("cause"))


def release_gate(base: DataFrame, new: DataFrame, keys: list[str], metric: str, tolerance: float) -> DataFrame:
    """Scorecards side by side, with verdict: a metric may not fall by more than the tolerance, nor vanish."""
    a, b = base.select(*keys, F.col(metric).alias("base")), new.select(*keys, F.col(metric).alias("candidate"))
    worse = F.col("candidate").isNull() | (F.col("candidate") < F.col("base") - tolerance)
    return a.join(b, keys, "full").withColumn("verdict", F.when(F.col("base").isNull(), "new").when(worse, "fail").otherwise("pass"))
