"""Spans as columns: all matches with byte offsets, and interval algebra by window functions.

Intervals are half-open. Every operator works inside one key (a document); what is sorted in a task is one key's
intervals, never the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def match_spans(text: Column, pattern: str, needs: str = "") -> Column:
    """array<struct<start, end, char_start, value>> of the matches of a pattern that never matches empty.

    ``needs`` is a literal that every match holds: texts without it aren't searched. Gaps and matches alternate, so offsets are running lengths; ``start`` and ``end`` count UTF-8 bytes.
    """
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))
    empty = F.struct(F.lit(0).alias("at"), F.lit(0).alias("chars"), F.expr("cast(array() as array<struct<start:int,`end`:int,char_start:int,value:string>>)").alias("found"))

    def step(s, x):
        start, chars = s["at"] + F.octet_length(x["gap"]), s["chars"] + F.length(x["gap"])
        end = start + F.coalesce(F.octet_length(x["value"]), F.lit(0))
        one = F.array(F.struct(start.alias("start"), end.alias("end"), chars.alias("char_start"), x["value"].alias("value")))
        return F.struct(end.alias("at"), (chars + F.coalesce(F.length(x["value"]), F.lit(0))).alias("chars"), F.when(x["value"].isNull(), s["found"]).otherwise(F.concat(s["found"], one)).alias("found"))

    return F.when((text.contains(needs) & text.rlike(pattern)) if needs else text.rlike(pattern), F.aggregate(pairs, empty, step, lambda s: s["found"])).otherwise(empty["found"])


def islands(df: DataFrame, keys: list[str], touching: bool = False) -> DataFrame:
    """``df`` with island: the number, from 1, of the group of overlapping (or touching) intervals within the keys."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = before.isNull() | ((F.col("start") > before) if touching else (F.col("start") >= before))
    return df.withColumn("__new", new.cast("int")).withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def merge(df: DataFrame, keys: list[str]) -> DataFrame:
    """Unions of overlapping or touching intervals."""
    return islands(df.select(*keys, "start", "end"), keys, touching=True).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def subtract(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The parts of ``left`` that no interval of ``right`` covers, merged."""
    side = lambda d, n: d.select(*keys, "start", "end", F.lit(n).alias("__side"))
    both = merge(side(left, "l").unionByName(side(right, "r")), [*keys, "__side"])
    edges = both.select(*keys, "__side", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))).alias("e"))
    points = edges.groupBy(*keys, F.col("e.at").alias("at")).agg(*(F.sum(F.when(F.col("__side") == n, F.col("e.d")).otherwise(0)).alias(n) for n in ("l", "r")))
    w = Window.partitionBy(*keys).orderBy("at")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    swept = points.select(*keys, F.col("at").alias("start"), F.lead("at").over(w).alias("end"), F.sum("l").over(run).alias("in_l"), F.sum("r").over(run).alias("in_r"))
    return merge(swept.where("in_l > 0 AND in_r = 0 AND end IS NOT NULL"), keys)


def intersection_length(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Bytes in both, by key: what is in left less what is left of it."""
    size = lambda d, n: merge(d, keys).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias(n))
    kept = subtract(left, right, keys).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("rest"))
    return size(left, "total").join(kept, keys, "left").select(*keys, (F.col("total") - F.coalesce("rest", F.lit(0))).alias("both"))


def overlap_pairs(df: DataFrame, keys: list[str], id_column: str) -> DataFrame:
    """Pairs inside one island with their kind: exact, containment or partial; islands keep the join small."""
    placed = islands(df, keys)
    a, b = placed.alias("a"), placed.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, "island"]]
    cond = F.col("a.start") < F.col("b.end")
    cond = cond & (F.col("b.start") < F.col("a.end")) & (F.col(f"a.{id_column}") < F.col(f"b.{id_column}"))
    for c in on:
        cond = cond & c
    inside = (F.col("a.start") <= F.col("b.start")) & (F.col("b.end") <= F.col("a.end")) | (F.col("b.start") <= F.col("a.start")) & (F.col("a.end") <= F.col("b.end"))
    kind = F.when((F.col("a.start") == F.col("b.start")) & (F.col("a.end") == F.col("b.end")), "exact").when(inside, "containment").otherwise("partial")
    return a.join(b, cond).select(*(F.col(f"a.{k}").alias(k) for k in keys), F.col(f"a.{id_column}").alias("a_id"), F.col(f"b.{id_column}").alias("b_id"), kind.alias("kind"))
