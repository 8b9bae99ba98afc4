"""The native plan: six ASCII rules, validators, resolution, tokens and splicing without leaving Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.functions import text as tx
from umbra.functions import validators as va
from umbra.operators import protect as pr
from umbra.operators import spans as sp
from umbra.operators.cut import cut

#: rule: (class, rule priority, pattern); plain enough for any engine's regular expressions.
RULES = {
    "email.global": ("email", 90, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    "ip.v4": ("custom:ip_address", 80, r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"),
    "card.structural": ("custom:credit_card", 80, r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}"),
    "phone.national.us": ("custom:phone", 85, r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}"),
    "iban.structural": ("custom:iban", 80, r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}"),
    "url.anchored": ("custom:url", 85, r"https?://[A-Za-z0-9./_~%?=&#-]+"),
    "security_token.code": ("custom:security_token", 100, r'(?:token|secret|password|api_key) = "[0-9a-f]{16,64}"'),
}


#: A literal that every match of a rule holds.
NEEDS = {"email.global": "@", "phone.national.us": "+1 (", "url.anchored": "://", "security_token.code": ' = "'}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan in fewer partitions than there are cores is dealt out to them, as matching costs far more than moving a
    small table; a large table has more partitions than that, and nothing moves."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(2 * cores)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.coalesce("source", F.lit("")).alias("session_id"), F.col("doc_id").alias("seq"), "text")


def _valid(rule: str, value: Column) -> Column:
    return {"email.global": va.is_email, "ip.v4": va.is_public_ipv4, "card.structural": va.is_luhn, "phone.national.us": va.is_us_phone, "iban.structural": va.is_iban}.get(rule, lambda c: F.lit(True))(value)


def candidates(docs: DataFrame, rules: dict = RULES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One scan for all rules: key, session_id, seq, rule, class, priority, start, end, value, valid."""
    def matches(rule, cls, priority, pattern):
        return F.transform(sp.match_spans(F.col(text), pattern, NEEDS.get(rule, "") if RULES.get(rule) == (cls, priority, pattern) else ""), lambda m: F.struct(F.lit(rule).alias("rule"), F.lit(cls).alias("class"), F.lit(priority).alias("priority"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))

    arrays = [matches(r, *spec) for r, spec in rules.items()]
    more = [c for c in ("session_id", "seq") if c in docs.columns]
    out = docs.where(F.col(text).isNotNull()).select(key, *more, F.explode(F.concat(*arrays)).alias("m")).select(key, *more, "m.*")
    valid = F.lit(True)
    for r in rules:
        valid = F.when(F.col("rule") == r, _valid(r, F.col("value"))).otherwise(valid)
    return out.withColumn("valid", valid)


def class_rank(c: Column) -> Column:
    return F.when(c == "email", 90).when(c == "name", 80).when(c == "organization", 70).when(c == "location", 60).otherwise(50)


def resolved(found: DataFrame) -> DataFrame:
    """Valid candidates that no better overlapping one beats: class, rule priority, length, rule id. The texts are matched
    once, though both sides of the comparison read what was found."""
    good = sp.islands(cut(found.where("valid")), ["doc_id"])
    rank = F.struct((-class_rank(F.col("class"))).alias("c"), (-F.col("priority")).alias("p"), (F.col("start") - F.col("end")).alias("l"), "rule")
    good = good.withColumn("rank", rank)
    a, b = good.alias("a"), good.select("doc_id", "island", "start", "end", "rank").alias("b")
    beaten = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.island") == F.col("b.island")) & (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end")) & (F.col("b.rank") < F.col("a.rank"))
    return a.join(b, beaten, "left_anti").drop("island", "rank")


def tokens(won: DataFrame) -> DataFrame:
    return pr.allocate(won.select("session_id", "class", F.col("value").alias("raw"), F.lit("").alias("family"), "seq", F.lit(0).alias("phase"), "start"))


def edits(won: DataFrame, policy: list, default: str = "tokenize") -> DataFrame:
    allotted = tokens(won)
    rows = won.withColumnRenamed("value", "raw").withColumn("family", F.lit("")).withColumn("action", pr.action_column(policy, default)).join(allotted, ["session_id", "family", "class", "raw"])
    return rows.withColumn("replacement", pr.replacement(F.col("action"), F.col("token"), F.col("class"), pr.session_prefix(F.col("session_id")), F.col("ordinal"), F.col("raw")))


def clean(docs: DataFrame, policy: list = (), default: str = "tokenize") -> tuple[DataFrame, DataFrame]:
    """(documents with clean_text and manifest, edits)."""
    changed = cut(edits(cut(resolved(candidates(docs))), list(policy), default))
    return pr.splice(docs, changed.where("action <> 'preserve'")), changed


__all__ = ["RULES", "spread", "candidates", "class_rank", "clean", "documents", "edits", "resolved", "table", "tokens", "tx"]
