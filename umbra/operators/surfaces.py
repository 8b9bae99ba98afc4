"""Request and response bodies of language-model services: the texts in them are protected or restored, the rest of the
body must hold nothing to protect, and its bytes stay as they are."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from umbra.operators import protect as pr
from umbra.operators.cut import cut
from umbra.sources.json_tree import JsonError, nodes

#: Where the services' bodies carry texts, as paths.
SURFACES = {
    "openai": (r"\$\.messages\[\d+\]\.content", r"\$\.messages\[\d+\]\.content\[\d+\]\.text", r"\$\.input", r"\$\.instructions"),
    "anthropic": (r"\$\.system", r"\$\.system\[\d+\]\.text", r"\$\.messages\[\d+\]\.content", r"\$\.messages\[\d+\]\.content\[\d+\]\.text"),
    "gemini": (r"\$\.systemInstruction\.parts\[\d+\]\.text", r"\$\.contents\[\d+\]\.parts\[\d+\]\.text"),
}
#: Control strings that are not scanned.
CONTROLS = (r"\$\.model", r"\$\.messages\[\d+\]\.role", r"\$\.contents\[\d+\]\.role", r".*\.type")
_LEAF = "body_id long, path string, start int, `end` int, value string, surface boolean"


def string_leaves(bodies: DataFrame, surfaces: dict[str, tuple[str, ...]] = SURFACES) -> DataFrame:
    """body_id, path, start, end, value and surface of the string leaves of bodies (body_id, provider, body), but for
    controls; a body that is no strict JSON gives one row with a null path."""
    paths = {name: re.compile("|".join(f"(?:{p})" for p in ps)) for name, ps in surfaces.items()}
    controls = re.compile("|".join(f"(?:{p})" for p in CONTROLS))
    names = [x.split()[0].strip("`") for x in _LEAF.split(", ")]
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_())

    def run(batches):
        for batch in batches:
            out = []
            for body, provider, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    found = [(body, p, a, b, v, bool(paths[provider].fullmatch(p))) for p, _, a, b, kind, v in nodes(text or "") if kind == "string" and not controls.fullmatch(p)]
                except JsonError:
                    found = [(body, None, None, None, None, None)]
                out += found
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return bodies.select(F.col("body_id").cast("long"), "provider", "body").mapInArrow(run, _LEAF)


def _respelled(bodies: DataFrame, edits: DataFrame) -> DataFrame:
    """Bodies with string literals (body_id, start, end, text) written anew."""
    put = edits.select(F.col("body_id").alias("doc_id"), "start", "end", F.lit("").alias("class"), F.substring(F.to_json(F.array("text")), 2, 2**31 - 1).alias("r"))
    put = put.withColumn("replacement", F.expr("substring(r, 1, length(r) - 1)")).drop("r")
    return pr.splice(bodies.select(F.col("body_id").alias("doc_id"), F.col("body").alias("text")), put).select(F.col("doc_id").alias("body_id"), F.col("clean_text").alias("body"))


def protect_requests(bodies: DataFrame, **detect) -> tuple[DataFrame, DataFrame]:
    """(body_id, body, status, reason; tokens) of request bodies (body_id, session_id, seq, provider, body): texts on the
    provider's surfaces are protected; a body is refused if it is no strict JSON (malformed), or if anything is found in a
    string outside of the surfaces (unsurfaced, with its path)."""
    leaves = cut(string_leaves(bodies))
    bad = leaves.where("path IS NULL").select("body_id", F.lit("malformed").alias("reason"))
    numbered = leaves.where("path IS NOT NULL").join(bodies.select("body_id", "session_id", "seq"), "body_id")
    keyed = numbered.withColumn("doc_id", F.xxhash64("body_id", "path"))
    texts = keyed.where("surface").select("doc_id", "session_id", "seq", F.col("value").alias("text"), "body_id", "start", "end")
    clean, tokens, _ = pr.protect(texts, **detect)
    clean = cut(clean)
    outside = keyed.where("NOT surface").select("doc_id", F.col("value").alias("text"), "body_id", "path")
    hit = pr.candidates(outside, **detect).where("stage IN ('primary', 'recovered')").select("doc_id").distinct()
    stray = outside.join(hit, "doc_id", "left_semi").groupBy("body_id").agg(F.concat(F.lit("unsurfaced:"), F.min("path")).alias("reason"))
    done = _respelled(bodies, clean.select("body_id", "start", "end", F.col("clean_text").alias("text")))
    refused = bad.union(stray)
    out = done.join(refused, "body_id", "left")
    return out.select("body_id", F.when(F.col("reason").isNull(), F.col("body")).alias("body"), F.when(F.col("reason").isNull(), "ok").otherwise("refused").alias("status"), "reason"), tokens


def restore_lines(bodies: DataFrame, tokens: DataFrame) -> DataFrame:
    """body_id, body, status of newline-delimited JSON bodies (body_id, session_id, body): tokens in the strings of each line
    are restored and written as JSON again; a line that is no strict JSON or holds an unknown token refuses the body."""
    lines = bodies.select("body_id", "session_id", F.posexplode(F.split("body", "\n", -1)).alias("line", "text"))
    full = lines.where(F.trim("text") != "").withColumn("line_id", F.xxhash64("body_id", "line"))
    leaves = string_leaves(full.select(F.col("line_id").alias("body_id"), F.lit("any").alias("provider"), F.col("text").alias("body")), {"any": (".*",)})
    broken = leaves.where("path IS NULL").select(F.col("body_id").alias("line_id"))
    strings = leaves.where("path IS NOT NULL").join(full.select(F.col("line_id").alias("body_id"), "session_id"), "body_id").withColumn("doc_id", F.xxhash64("body_id", "path"))
    back = cut(pr.restore(strings.withColumn("clean_text", F.col("value")), tokens, strict=True))
    refused = back.where("decision = 'refused'").select(F.col("body_id").alias("line_id"))
    done = _respelled(full.select(F.col("line_id").alias("body_id"), F.col("text").alias("body")), back.where("decision <> 'refused'").select("body_id", "start", "end", F.col("restored").alias("text"))).select(F.col("body_id").alias("line_id"), F.col("body").alias("done"))
    shut = full.join(broken.union(refused).distinct(), "line_id", "left_semi").select("body_id").distinct().withColumn("shut", F.lit(True))
    whole = lines.join(full.select("body_id", "line", "line_id"), ["body_id", "line"], "left").join(done, "line_id", "left")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", F.coalesce("done", "text").alias("t")))), lambda x: x["t"]), "\n")
    out = whole.groupBy("body_id").agg(text.alias("body")).join(shut, "body_id", "left")
    return out.select("body_id", F.when(F.col("shut").isNull(), F.col("body")).alias("body"), F.when(F.col("shut").isNull(), "ok").otherwise("refused").alias("status"))


def session_leases(calls: DataFrame, ttl: int, key: str) -> DataFrame:
    """``calls`` (call_id, principal, session, at, epoch) with namespace (keyed, one for each principal and session),
    generation (anew when a session was idle for ``ttl``) and status: granted, or conflict if the caller expects another
    generation."""
    from umbra.functions.text import hmac_sha256

    w = Window.partitionBy("principal", "session").orderBy("at", "call_id")
    gap = F.col("at") - F.lag("at").over(w) >= ttl
    rows = calls.withColumn("__new", F.coalesce(gap, F.lit(False)).cast("int"))
    generation = F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long") + 1
    rows = rows.withColumn("generation", generation).withColumn("namespace", F.substring(hmac_sha256(key, F.concat_ws("|", "principal", "session")), 1, 16))
    return rows.withColumn("status", F.when(F.col("epoch").isNotNull() & (F.col("epoch") != F.col("generation")), "conflict").otherwise("granted")).drop("__new")


def retained_events(events: DataFrame, now: int, epoch: int, ttl: int, max_events: int, max_bytes: int) -> DataFrame:
    """``events`` (emission_id, logical_id, sequence, epoch, at, n_bytes, body) with status: stale_epoch, duplicate (the same
    emission again), conflict (another body under its id, or a sequence that doesn't grow in its logical event), oversize,
    expired, evicted (beyond the newest that fit by number and bytes), or kept."""
    one = Window.partitionBy("emission_id").orderBy("at", "sequence", "body")
    chain = Window.partitionBy("logical_id").orderBy("at", "emission_id")
    rows = events.withColumn("status", F.when(F.col("epoch") != epoch, "stale_epoch"))
    first = rows.where("status IS NULL").withColumn("__n", F.row_number().over(one)).withColumn("__body", F.first("body").over(one))
    first = first.withColumn("status", F.when((F.col("__n") > 1) & (F.col("body") == F.col("__body")), "duplicate").when(F.col("__n") > 1, "conflict").when(F.col("n_bytes") > max_bytes, "oversize").when(F.col("at") + ttl <= now, "expired"))
    live = first.where("status IS NULL").withColumn("__top", F.max("sequence").over(chain.rowsBetween(Window.unboundedPreceding, -1)))
    live = live.withColumn("status", F.when(F.col("sequence") <= F.col("__top"), "conflict"))
    newest = Window.orderBy(F.desc("at"), F.desc("emission_id"))  # what one store keeps: bounded by max_events
    good = live.where("status IS NULL").orderBy(F.desc("at"), F.desc("emission_id")).limit(max_events)
    fits = good.withColumn("__sum", F.sum("n_bytes").over(newest.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("__sum") <= max_bytes).select("emission_id").withColumn("__kept", F.lit(True))
    live = live.join(fits, "emission_id", "left").withColumn("status", F.coalesce("status", F.when(F.col("__kept"), "kept"), F.lit("evicted")))
    cols = [*events.columns, "status"]
    return rows.where("status IS NOT NULL").select(*cols).union(first.where("status IS NOT NULL").select(*cols)).union(live.select(*cols))

