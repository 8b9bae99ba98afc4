"""Sources: texts, labelled corpora, frames, policies, contexts, binary documents; all paths go through Spark's readers."""

from __future__ import annotations

import json
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABELLED = "text string, spans array<struct<start:int,`end`:int,label:string>>"
FRAME = "version int, op string, session_id string, text string, context string"
POLICY_VERSION = "0.1."
ACTIONS = {"tokenize", "redact", "format_preserve", "generalize", "preserve"}


def texts(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: path and text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def labelled(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with gold spans; a span out of order, overlapping or out of the text is an error."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    strange = F.size(F.array_except(F.json_object_keys("value"), F.array(F.lit("text"), F.lit("spans")))) != 0
    body = F.from_json("value", LABELLED, {"mode": "FAILFAST"})
    rows = lines.withColumn("value", F.when(F.coalesce(strange, F.lit(True)), F.raise_error(F.lit("unknown fields or no object"))).otherwise(F.col("value"))).select(body.alias("r")).select("r.*")
    size = F.octet_length("text")
    edge = lambda at: F.octet_length(F.decode(F.substr(F.encode("text", "UTF-8"), F.lit(1), at), "UTF-8")) == at
    bad = F.exists("spans", lambda s: (s["start"] < 0) | (s["start"] >= s["end"]) | (s["end"] > size) | ~edge(s["start"]) | ~edge(s["end"]))
    bad = bad | F.exists(F.sequence(F.lit(1), F.greatest(F.size("spans") - 1, F.lit(1))), lambda i: F.coalesce(F.try_element_at("spans", i + 1)["start"] < F.try_element_at("spans", i)["end"], F.lit(False)))
    return rows.withColumn("spans", F.when(bad, F.raise_error(F.lit("spans must be sorted, disjoint, inside the text and on characters"))).otherwise(F.col("spans")))


def frames(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Frames of the session protocol from JSON lines; a byte budget a trigger stands for back-pressure."""
    reader = spark.readStream.option("maxBytesPerTrigger", "64m") if streaming else spark.read
    return reader.schema(FRAME).json(path)


def policy(text: str) -> dict:
    """A closed, versioned TOML policy: version, default, rules with class or column, and action."""
    body = tomllib.loads(text)
    if extra := set(body) - {"version", "default", "rules", "locales", "dictionaries", "ner_threshold", "recognizers"}:
        raise ValueError(f"unknown policy fields {sorted(extra)}")
    if not str(body.get("version", "")).startswith(POLICY_VERSION):
        raise ValueError("unsupported policy version")
    rules = []
    for r in body.get("rules", []):
        if set(r) - {"class", "column", "action"} or r.get("action") not in ACTIONS or ("class" in r) == ("column" in r):
            raise ValueError(f"bad rule {r}")
        rules.append(("class", r["class"], r["action"]) if "class" in r else ("column", r["column"], r["action"]))
    patterns, dictionaries = recognizers(body.get("recognizers", []))
    return {"recognizers": patterns, "recognizer_dictionaries": dictionaries, "rules": rules, "default": body.get("default", "tokenize"), "locales": tuple(body.get("locales", ())), "dictionaries": body.get("dictionaries", {}), "ner_threshold": body.get("ner_threshold", 0.3)}


def recognizers(specs: list[dict]) -> tuple[tuple, dict[str, tuple[str, list[str], bool]]]:
    """(rules, dictionaries) of a policy's own recognizers: kind regex with a pattern that matches no token of ours, or
    kind dictionary with terms (or terms_from_context, a name that the request fills)."""
    from umbra.functions.text import custom_class
    from umbra.operators.rules import CORE, Rule, check_shadow

    rules, dictionaries, families = [], {}, {r.family for r in CORE}
    for raw in specs:
        spec = dict(raw)
        kind, name, cls = spec.pop("kind", None), spec.pop("name", None), spec.pop("class", "")
        cls = cls if cls in ("email", "name", "location", "organization") or cls.startswith("custom:") else custom_class(cls)
        if not name or spec.get("family") in families - {None}:
            raise ValueError(f"recognizer without a name, or in a reserved family: {raw}")
        if kind == "regex":
            rule = Rule(name, cls, **{k: tuple(v) if isinstance(v, list) else v for k, v in spec.items()})
            check_shadow(rule)
            rules.append(rule)
        elif kind == "dictionary" and not set(spec) - {"terms", "terms_from_context", "case_sensitive"} and ("terms" in spec) != ("terms_from_context" in spec) and spec.get("terms", True):
            dictionaries[spec.get("terms_from_context", name)] = (cls, list(spec.get("terms", [])), bool(spec.get("case_sensitive", True)))
        else:
            raise ValueError(f"bad recognizer {raw}")
    return tuple(rules), dictionaries


def context(text: str) -> dict[str, tuple[str, list[str], bool]]:
    """Request dictionaries: name to (class, terms, case sensitive); the last of two entries with a name wins."""
    body = json.loads(text)
    return {d["name"]: (d.get("class", "custom:" + d["name"]), [t for t in d["terms"] if t], bool(d.get("case_sensitive", True))) for d in body.get("dictionaries", [])}


def merge_contexts(*bundles: dict) -> dict:
    return {k: v for b in bundles for k, v in b.items()}


def binaries(spark: SparkSession, path: str) -> DataFrame:
    """Documents by content: kind is png, jpeg, pdf or null."""
    rows = spark.read.format("binaryFile").load(path)
    head = F.hex(F.substring("content", 1, 8))
    return rows.select("path", "length", "content", F.when(head == "89504E470D0A1A0A", "png").when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("25504446"), "pdf").alias("kind"))


def ocr_words(spark: SparkSession, path: str) -> DataFrame:
    """Words of an OCR engine's TSV: page, x, y, w, h, text, conf. Recognition itself runs elsewhere."""
    rows = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    return rows.where("conf >= 0").select(*(F.col(a).cast("int").alias(b) for a, b in (("page_num", "page"), ("left", "x"), ("top", "y"), ("width", "w"), ("height", "h"))), "text", (F.col("conf") / 100).cast("double").alias("conf"))
