"""Mixing sources to target weights by hierarchical budgets, with DataFrame functions only.

The tree is domain > language > source. A budget of tokens goes down it in proportion to weights; a child can take
at most what its leaves hold times ``max_epochs``. What a child can't take goes to its siblings, by their weights,
and only what all of them can't take has, in the cap of their parent, gone to the parent's siblings already: caps
are added up the tree first. A level is filled in closed form: with children sorted by cap / weight, the full ones
are those whose ratio lies below the water level, and two running sums find it.

A leaf with a budget beyond its supply gives whole epochs, each in its own seeded order, and of the last one the
prefix of documents that starts within the rest. The prefix is found by buckets of the seeded order: tokens are
summed by (leaf, bucket) before anything is ordered, and only the bucket in which the budget ends is sorted, so a
leaf with a third of all rows spreads over many tasks.

Nulls: null text has no tokens, and rows without tokens are kept once (they cost nothing); null lang and source are
leaves of their own; null ids are ordered by their text. Repeated rows and ties in the seeded order are drawn alike.
Tokens are words by white space, so a very long text is one row that may pass its leaf's budget by its own length.
Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm._common import WORD_GAP, checkpointed

#: Hex digits of the seeded order that make a bucket.
BUCKET_DIGITS = 3
#: Weights by level; whatever isn't named has ``default``.
WEIGHTS = {"domain": {"web": 2, "curated": 3}, "lang": {"en": 4}, "source": {}, "default": 1}
SHARE, MAX_EPOCHS, SEED = 0.9, 3, "mix-1"
#: Domain by source ("" is the null source); whatever isn't named has ``default``.
DOMAINS = {"src0": "web", "src1": "web", "": "web", "default": "curated"}


def domain_of(source: Column, domains: dict[str, str] = DOMAINS) -> Column:
    """The tree's top level."""
    out = F.lit(domains.get("default", "default"))
    for name, domain in domains.items():
        if name != "default":
            out = F.when(F.coalesce(source, F.lit("")) == name, domain).otherwise(out)
    return out


def n_tokens(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")).cast("long")


def _weight(level: str, name: Column, weights: dict) -> Column:
    out = F.lit(int(weights.get("default", 1)))
    for k, v in weights.get(level, {}).items():
        out = F.when(name == k, int(v)).otherwise(out)
    return out.cast("long")


def _fill(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """budget of each child, from __have (the parent's), __cap and __weight."""
    by = ", ".join(parent) if parent else "1"
    order = f"PARTITION BY {by} ORDER BY __cap / __weight, {name} NULLS FIRST"
    out = children.withColumn("__caps", F.expr(f"sum(__cap) OVER ({order} ROWS UNBOUNDED PRECEDING) - __cap"))
    out = out.withColumn("__rest", F.expr(f"sum(__weight) OVER (PARTITION BY {by}) - sum(__weight) OVER ({order} ROWS UNBOUNDED PRECEDING) + __weight"))
    out = out.withColumn("__full", F.expr("cast(__cap AS double) * __rest <= cast(__have - __caps AS double) * __weight"))
    out = out.withColumn("__used", F.expr(f"sum(if(__full, __cap, 0)) OVER (PARTITION BY {by})")).withColumn("__open", F.expr(f"sum(if(__full, 0, __weight)) OVER (PARTITION BY {by})"))
    budget = F.expr("if(__full, __cap, cast(floor(cast(__have - __used AS double) * __weight / __open) AS bigint))")
    return out.withColumn("budget", budget).drop("__caps", "__rest", "__full", "__used", "__open", "__have")


def budgets(leaves: DataFrame, total: Column, weights: dict, max_epochs: int) -> DataFrame:
    """domain, lang, source, supply, budget of each leaf; leaves: one row each, with supply in tokens."""
    leaf = leaves.select("domain", "lang", "source", "supply", (F.col("supply") * max_epochs).alias("__cap"))
    lang = leaf.groupBy("domain", "lang").agg(F.sum("__cap").alias("__cap"))
    domain = lang.groupBy("domain").agg(F.sum("__cap").alias("__cap"))
    domain = domain.withColumn("__have", total)
    top = _fill(domain.withColumn("__weight", _weight("domain", F.col("domain"), weights)), [], "domain").select("domain", F.col("budget").alias("__have"))
    mid = lang.join(top, "domain").withColumn("__weight", _weight("lang", F.col("lang"), weights))
    mid = _fill(mid, ["domain"], "lang").select("domain", "lang", F.col("budget").alias("__have"))
    same = (F.col("a.domain") == F.col("b.domain")) & F.col("a.lang").eqNullSafe(F.col("b.lang"))
    low = leaf.alias("a").join(mid.alias("b"), same).select("a.*", "b.__have").withColumn("__weight", _weight("source", F.col("source"), weights))
    return _fill(low, ["domain", "lang"], "source").select("domain", "lang", "source", "supply", "budget")


def mix(docs: DataFrame, total: int | None = None, share: float = SHARE, weights: dict = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, thin: bool = False, domains: dict[str, str] = DOMAINS) -> DataFrame:
    """``docs`` (only doc_id, lang and source if ``thin``) with n_tokens and epoch (from 0), once for each time a row is
    drawn; columns of ``docs`` with these two names are replaced.

    total: tokens wanted, else ``share`` of all.
    """
    columns = ["doc_id", "lang", "source"] if thin else [c for c in docs.columns if c not in ("n_tokens", "epoch")]
    counted = docs.select(*(F.col(c).alias(f"o_{i}") for i, c in enumerate(columns)), domain_of(F.col("source"), domains).alias("domain"), F.col("lang").alias("lang"), F.col("source").alias("source"), n_tokens(F.col("text")).alias("n_tokens"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.md5(F.coalesce("text", F.lit(""))))).alias("__id"))
    slim = checkpointed(counted.select("domain", "lang", "source", "n_tokens", "__id"))
    leaves = checkpointed(slim.groupBy("domain", "lang", "source").agg(F.sum("n_tokens").alias("supply")))
    everything = leaves.agg(F.sum("supply")).first()[0] or 0
    plan = budgets(leaves, F.lit(int(share * everything) if total is None else total).cast("long"), weights, max_epochs)
    plan = checkpointed(plan.withColumn("epochs", F.when(F.col("supply") > 0, F.floor(F.col("budget") / F.col("supply"))).otherwise(0)).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("supply")))
    on = ["domain", "__lang", "__source"]
    key = lambda d: d.withColumns({"__lang": F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")), "__source": F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))})
    plan = key(plan).drop("lang", "source")
    # sums by leaf and bucket of the last epoch's order; the plan's epoch number seeds it
    placed = key(slim).join(plan, on).withColumn("__h", F.md5(F.concat_ws(":", F.lit(seed), "epochs", "__id"))).withColumn("__b", F.substring("__h", 1, BUCKET_DIGITS))
    sums = placed.groupBy(*on, "__b", "rest").agg(F.sum("n_tokens").alias("sum"))
    sums = sums.withColumn("before", F.expr(f"sum(sum) OVER (PARTITION BY {', '.join(on)} ORDER BY __b ROWS UNBOUNDED PRECEDING) - sum"))
    # the bucket in which the rest ends: those before it are drawn whole, those after it not at all
    last = sums.where("before < rest AND before + sum >= rest").groupBy(*on).agg(F.max(F.struct("__b", "before")).alias("e")).select(*on, F.col("e.__b").alias("__end"), F.col("e.before").alias("__before"))
    edge = placed.join(last, on).where("__b = __end")
    upto = F.expr(f"sum(n_tokens) OVER (PARTITION BY {', '.join(on)} ORDER BY __h, __id)") - F.col("n_tokens") + F.col("__before")
    cut = edge.withColumn("__upto", upto).where("__upto < rest").groupBy(*on).agg(F.max("__h").alias("__cut"))
    plan = checkpointed(plan.join(cut, on, "left").select(*on, "epochs", "rest", "__cut"))
    drawn = key(counted).join(plan, on).withColumn("__h", F.md5(F.concat_ws(":", F.lit(seed), "epochs", "__id")))
    times = F.when(F.col("n_tokens") == 0, 1).otherwise(F.col("epochs") + F.when(F.coalesce(F.col("__h") <= F.col("__cut"), F.lit(False)), 1).otherwise(0)).cast("int")
    out = drawn.withColumn("__times", times).where("__times > 0").withColumn("epoch", F.explode(F.expr("sequence(0, __times - 1)")))
    return out.select(*(F.col(f"o_{i}").alias(c) for i, c in enumerate(columns)), "n_tokens", "epoch")
