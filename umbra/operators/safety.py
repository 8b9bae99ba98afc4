"""Safety net: a second detector over clean text, its difference against the manifest, and what is done about it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.functions.text import redaction_marker


def scan_view(clean: DataFrame, neutral: bool = True) -> DataFrame:
    """Clean texts with their own tokens overwritten at equal length, so that offsets stay: ``[PII]`` and blanks, or a
    stand-in for the session prefix that depends on the token's shape alone."""

    def step(s, m):
        size = m["clean_end"] - m["clean_start"]
        token = F.substring(s, m["clean_start"] + 1, size)
        shape = F.regexp_replace(F.decode(token, "UTF-8"), "[0-9a-f]{8}", "")
        stable = F.encode(F.concat(F.lit("<"), F.substring(F.sha2(shape, 256), 1, 8), F.substr(F.decode(token, "UTF-8"), F.lit(10))), "UTF-8")
        new = F.encode(F.rpad(F.lit("[PII]"), size, " "), "UTF-8") if neutral else F.when(F.length(stable) == size, stable).otherwise(token)
        return F.overlay(s, new, m["clean_start"] + 1, size)

    seen = F.aggregate("manifest", F.encode("clean_text", "UTF-8"), step)
    return clean.select("doc_id", F.decode(seen, "UTF-8").alias("text"))


def manifest_diff(suspects: DataFrame, spans: DataFrame) -> DataFrame:
    """``suspects`` (doc_id, start, end, class) with kind (none, uncovered, partial_bleed or class_mismatch) and first gap.

    spans: doc_id, start, end, class of emitted tokens, disjoint. One join on doc_id; the sweep runs inside the row.
    """
    listed = spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "class"))).alias("__spans"))
    joined = suspects.join(listed, "doc_id", "left")
    over = F.filter(F.coalesce("__spans", F.expr("cast(array() as array<struct<start:int,`end`:int,class:string>>)")), lambda x: (x["start"] < F.col("end")) & (x["end"] > F.col("start")))
    out = joined.withColumn("__over", over)
    reach = F.aggregate("__over", F.col("start").cast("int"), lambda at, x: F.when(x["start"] <= at, F.greatest(at, x["end"].cast("int"))).otherwise(at))
    out = out.withColumn("__at", reach)
    nxt = F.coalesce(F.array_min(F.transform(F.filter("__over", lambda x: x["start"] > F.col("__at")), lambda x: x["start"])), F.col("end"))
    kind = F.when(F.size("__over") == 0, "uncovered").when(F.col("__at") < F.col("end"), "partial_bleed").when(~F.exists("__over", lambda x: x["class"] == F.col("class")), "class_mismatch").otherwise("none")
    gap = F.col("kind").isin("uncovered", "partial_bleed")
    out = out.withColumn("kind", kind).withColumn("gap_start", F.when(gap, F.col("__at"))).withColumn("gap_end", F.when(gap, F.least(nxt, F.col("end"))))
    return out.select(*suspects.columns, "kind", "gap_start", "gap_end")


def leak_stats(diff: DataFrame) -> DataFrame:
    return diff.groupBy("kind").agg(F.count("*").alias("n"))


def gates(docs: DataFrame, text: str = "text", manifest: str | None = None) -> DataFrame:
    """``docs`` with skip: texts that are mostly digits (six at least, and twice as many as letters) or have no capital but
    at the start of a sentence need no model, nor do, with a manifest, texts with tokens and neither ``@`` nor many digits."""
    digits, letters = F.regexp_count(text, F.lit("[0-9]")), F.regexp_count(text, F.lit(r"\p{L}"))
    numeric = (digits >= 6) & (digits > 2 * letters)
    skip = numeric | ~F.col(text).rlike(r"[^\s.!?]\s*\p{Lu}")
    if manifest:
        skip = skip | (F.size(manifest) > 0) & ~F.col(text).contains("@") & ~numeric
    return docs.withColumn("skip", F.coalesce(skip, F.lit(True)))


def enforce(clean: DataFrame, diff: DataFrame, mode: str = "redact") -> DataFrame:
    """``clean`` (doc_id, session_id, clean_text) after the net: status and final_text.

    strict refuses a document with leaks, tolerant only warns, redact writes class markers over uncovered bytes, and
    resolve needs the nets, to scan again: see ``nets.enforce``.
    """
    from umbra.operators.protect import splice

    if mode not in ("strict", "tolerant", "redact"):
        raise ValueError(f"unknown mode {mode}")
    leaks = diff.where("kind IN ('uncovered', 'partial_bleed')")
    count = leaks.groupBy("doc_id").agg(F.count("*").alias("n_leaks"))
    out = clean.join(count, "doc_id", "left").withColumn("n_leaks", F.coalesce("n_leaks", F.lit(0)))
    if mode in ("strict", "tolerant"):
        bad = F.col("n_leaks") > 0
        shown = F.col("clean_text") if mode == "tolerant" else F.when(~bad, F.col("clean_text"))
        return out.withColumn("status", F.when(bad, "warned" if mode == "tolerant" else "refused").otherwise("ok")).withColumn("final_text", shown)
    edits = leaks.select("doc_id", F.col("gap_start").alias("start"), F.col("gap_end").alias("end"), "class").dropDuplicates(["doc_id", "start"]).withColumn("replacement", redaction_marker(F.col("class")))
    done = splice(clean.select("doc_id", F.col("clean_text").alias("text")), edits).select("doc_id", F.col("clean_text").alias("final_text"))
    return out.join(done, "doc_id").withColumn("status", F.when(F.col("n_leaks") > 0, mode).otherwise("ok"))


def coverage_proof(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rule-found spans not under a token: must be empty."""
    cond = (F.col("f.doc_id") == F.col("m.doc_id")) & (F.col("m.start") <= F.col("f.start")) & (F.col("f.end") <= F.col("m.end"))
    return found.alias("f").join(manifest.alias("m"), cond, "left_anti")
