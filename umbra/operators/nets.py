"""Safety nets: second detectors over clean text, and what is done about what they find.

A net has a name, locales and a function from texts to (start, end, class, score) lists in characters. Findings are
compared with the manifest; bytes that no token covers are exposed. Modes: observe modes (strict refuses, tolerant
warns), redact (a one-way marker), and resolve (a token; after that the text is scanned again, and what is still found is
resolved once more or handed to the fallback). A suspect of a word class whose edge cuts a word is never acted on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.functions import text as tx
from umbra.operators import protect as pr
from umbra.operators import safety
from umbra.operators.cut import cut

WORD_CLASSES = ("name", "location", "organization")


@dataclass(frozen=True)
class Net:
    name: str
    find: Callable[[list[str]], list[list[tuple[int, int, str, float]]]]
    locales: tuple[str, ...] = ("global",)

    def covers(self, chain: tuple[str, ...]) -> bool:
        return "global" in self.locales or any(c == x or c.startswith(x + "-") for c in chain for x in self.locales)


def pattern_net(name: str, patterns: dict[str, str], locales: tuple[str, ...] = ("global",)) -> Net:
    """A net that needs no model: patterns by class."""
    import re

    def find(texts):
        return [[(*m.span(), cls, 1.0) for cls, p in patterns.items() for m in re.finditer(p, t)] for t in texts]

    return Net(name, find, locales)


_FOUND = "doc_id long, net string, start int, `end` int, class string, score double, inside boolean"


def run_nets(views: DataFrame, nets: list[Net], chain: tuple[str, ...] = ("global",)) -> tuple[DataFrame, list[tuple[str, str]]]:
    """(suspects in bytes of the views (doc_id, text), telemetry): a net without the locale is skipped and named.
    ``inside`` says that an edge cuts a word."""
    ready = [n for n in nets if n.covers(chain)]
    names = [x.split()[0].strip("`") for x in _FOUND.split(", ")]
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.bool_())

    def run(batches):
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            out = []
            for net in ready:
                for doc, text, found in zip(docs, texts, net.find(texts), strict=True):
                    for a, b, cls, score in found:
                        start = len(text[:a].encode())
                        out.append((doc, net.name, start, start + len(text[a:b].encode()), cls, score, tx.is_inside_word(text, a) or tx.is_inside_word(text, b)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return views.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _FOUND), [(n.name, "locale_skipped") for n in nets if n not in ready]


def _spans(clean: DataFrame) -> DataFrame:
    return clean.select("doc_id", F.explode("manifest").alias("m")).select("doc_id", F.col("m.clean_start").alias("start"), F.col("m.clean_end").alias("end"), "m.class")


def report(clean: DataFrame, nets: list[Net], chain: tuple[str, ...] = ("global",)) -> DataFrame:
    """Suspects with kind, first gap, and act: uncovered bytes that a stage may act on."""
    found, _ = run_nets(safety.scan_view(clean), nets, chain)
    diff = safety.manifest_diff(found, _spans(clean))
    sub_word = F.col("inside") & F.col("class").isin(*WORD_CLASSES)
    return diff.withColumn("act", F.col("kind").isin("uncovered", "partial_bleed") & ~sub_word).withColumn("sub_word", sub_word)


def _shifted(clean: DataFrame, edits: DataFrame) -> DataFrame:
    """``clean`` after edits (doc_id, start, end, class, replacement, token) of its text, with tokens in the manifest."""
    kind = "array<struct<start:int,`end`:int,class:string,replacement:string,token:boolean>>"
    listed = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "class", "replacement", "token"))).alias("__e"))
    rows = clean.join(listed, "doc_id", "left").withColumn("__e", F.coalesce("__e", F.expr(f"cast(array() as {kind})")))
    done = pr.splice(clean.select("doc_id", F.col("clean_text").alias("text")), edits.select("doc_id", "start", "end", "class", "replacement")).select("doc_id", F.col("clean_text").alias("__text"))
    grown = "aggregate(filter(__e, e -> e.end <= {at}), 0, (s, e) -> s + octet_length(e.replacement) - (e.end - e.start))"
    lost = "aggregate(filter(manifest, m -> m.clean_end <= {at}), 0, (s, m) -> s + (m.raw_end - m.raw_start) - (m.clean_end - m.clean_start))"
    old = F.expr(f"transform(manifest, o -> named_struct('clean_start', o.clean_start + {grown.format(at='o.clean_start')}, 'clean_end', o.clean_end + {grown.format(at='o.clean_start')}, 'raw_start', o.raw_start, 'raw_end', o.raw_end, 'class', o.class))")
    new = F.expr(f"transform(filter(__e, n -> n.token), n -> named_struct('clean_start', n.start + {grown.format(at='n.start')}, 'clean_end', n.start + {grown.format(at='n.start')} + octet_length(n.replacement), 'raw_start', n.start + {lost.format(at='n.start')}, 'raw_end', n.end + {lost.format(at='n.start')}, 'class', n.class))")
    rows = rows.withColumn("manifest", F.array_sort(F.concat(old, new)))
    return rows.join(done, "doc_id").withColumn("clean_text", F.coalesce("__text", "clean_text")).drop("__text", "__e")


def _gaps(found: DataFrame, clean: DataFrame) -> DataFrame:
    """doc_id, session_id, seq, start, end, class, raw of the gaps to act on; of those that overlap the first, longest."""
    from pyspark.sql import Window

    gaps = found.where("act").select("doc_id", F.col("gap_start").cast("int").alias("start"), F.col("gap_end").cast("int").alias("end"), "class").distinct()
    w = Window.partitionBy("doc_id").orderBy("start", F.desc("end"), "class")
    first = gaps.withColumn("__b", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))).where("__b IS NULL OR start >= __b").drop("__b")
    raw = F.decode(F.substr(F.encode("clean_text", "UTF-8"), F.col("start") + 1, F.col("end") - F.col("start")), "UTF-8")
    return first.join(clean.select("doc_id", "session_id", "seq", "clean_text"), "doc_id").withColumn("raw", raw).drop("clean_text")


def resolve_round(clean: DataFrame, tokens: DataFrame, nets: list[Net], chain: tuple[str, ...] = ("global",)) -> tuple[DataFrame, DataFrame]:
    """(clean, tokens) after every exposed finding has become a token of the session."""
    gaps = cut(_gaps(report(clean, nets, chain), clean))
    all_tokens = pr.allocate(gaps.select("session_id", "class", "raw", F.lit("safety_net").alias("family"), "seq", F.lit(9).alias("phase"), "start"), tokens)
    edits = gaps.withColumn("family", F.lit("safety_net")).join(all_tokens, ["session_id", "family", "class", "raw"])
    return _shifted(clean, edits.select("doc_id", "start", "end", "class", F.col("token").alias("replacement"), F.lit(True).alias("token"))), all_tokens


def enforce(clean: DataFrame, tokens: DataFrame, nets: list[Net], mode: str = "resolve", fallback: str = "redact", chain: tuple[str, ...] = ("global",), structured: bool = False) -> tuple[DataFrame, DataFrame]:
    """(clean with status, tokens). status: ok, warned, refused, redacted or resolved; a refused document has no text.

    resolve makes tokens, scans again, and makes tokens once more; what is found then goes to the fallback: redact writes
    markers, strict refuses (also for a finding that cuts a word). Whatever the mode of acting, a last scan must find
    nothing to act on (terminal admission), or the document is refused."""
    if mode not in ("strict", "tolerant", "redact", "resolve") or fallback not in ("redact", "strict"):
        raise ValueError(f"unknown mode {mode}/{fallback}")
    if structured and mode in ("redact", "resolve"):
        raise ValueError("structured input is only observed")
    clean, tokens = cut(clean), cut(tokens)
    mark = lambda rows, name, cond: rows.join(report(rows, nets, chain).where(cond).select("doc_id").distinct().withColumn(name, F.lit(True)), "doc_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    first = cut(mark(clean, "__hit", F.col("act")))
    if mode in ("strict", "tolerant"):
        word = "warned" if mode == "tolerant" else "refused"
        out = first.withColumn("status", F.when(F.col("__hit"), word).otherwise("ok"))
        return out.withColumn("clean_text", F.when(F.col("status") != "refused", F.col("clean_text"))).drop("__hit"), tokens
    now = first
    if mode == "resolve":
        for _ in range(2 if fallback == "redact" else 1):
            now, tokens = (cut(x) for x in resolve_round(now, tokens, nets, chain))
    if mode == "redact" or fallback == "redact":
        gaps = _gaps(report(now, nets, chain), now)
        now = _shifted(now, gaps.select("doc_id", "start", "end", "class", tx.redaction_marker(F.col("class")).alias("replacement"), F.lit(False).alias("token")))
        now = cut(now)
    left = F.col("act") | F.col("sub_word") if fallback == "strict" and mode == "resolve" else F.col("act")
    out = mark(now, "__left", left & F.col("kind").isin("uncovered", "partial_bleed"))
    out = out.withColumn("status", F.when(F.col("__left"), "refused").when(F.col("__hit"), "redacted" if mode == "redact" else "resolved").otherwise("ok"))
    return out.withColumn("clean_text", F.when(~F.col("__left"), F.col("clean_text"))).drop("__hit", "__left"), tokens


def leak_rows(found: DataFrame, created_at: int) -> DataFrame:
    """Rows of the safety-net log from a report: labels and lengths, never bytes."""
    from umbra.operators import audit

    rows = found.select(F.col("net").alias("safety_net_id"), F.col("class").alias("raw_label"), F.col("class").alias("mapped_class"), F.col("kind").alias("leak_kind"), (F.col("end") - F.col("start")).cast("long").alias("span_len"), F.lit("text").alias("document_kind"), "score", F.lit(created_at).alias("created_at"))
    return audit.project(rows, audit.SAFETY_NET_LOG)


# boundary -----------------------------------------------------------------------------------------------------


def boundary(docs: DataFrame, nets: list[Net], chain: tuple[str, ...] = ("en-US", "global")) -> DataFrame:
    """doc_id, status, text of documents on their way out: protected, findings of the nets resolved, and admitted only if
    nothing is left; else refused, with a reason and without text."""
    clean, tokens, _ = pr.protect(docs, chain=chain)
    out, _ = enforce(clean, tokens, nets, "resolve", "strict", chain)
    return out.select("doc_id", F.when(F.col("status") == "refused", "refused").otherwise("admitted").alias("status"), F.when(F.col("status") == "refused", "residual_suspect").alias("reason"), F.col("clean_text").alias("text"))


def would_mutate(docs: DataFrame, deterministic: bool = True, extra: tuple = (), **detect) -> DataFrame:
    """doc_id, would_mutate: whether a control string would change; ``deterministic`` asks the rules alone."""
    found = pr.candidates(docs, extra=() if deterministic else extra, **detect).where("stage IN ('primary', 'recovered', 'residual')")
    return docs.select("doc_id").join(found.select("doc_id").distinct().withColumn("hit", F.lit(True)), "doc_id", "left").select("doc_id", F.coalesce("hit", F.lit(False)).alias("would_mutate"))


def rule_sources(found: DataFrame) -> DataFrame:
    """Values that rules alone have found, from which copies may be swept: no learned evidence, no failed check."""
    return found.where("stage IN ('primary', 'recovered') AND evidence = 'rule' AND validator_fail_reason IS NULL AND NOT class LIKE 'custom:family:%'").select("doc_id", "class", F.col("value").alias("raw")).distinct()


def outcomes(found: DataFrame) -> DataFrame:
    """doc_id, start, end, class, outcome, reason of what was found: protected, possibly sensitive (a family's token:
    which identifier it is stays open), not sensitive (a validator's veto), or untransformable (no bytes to replace)."""
    family = F.col("class").startswith("custom:family:")
    out = F.when(F.col("stage") == "vetoed", "non_sensitive").when(F.col("start") >= F.col("end"), "confirmed_untransformable").when(family, "possibly_sensitive").otherwise("protected")
    why = F.when(out == "non_sensitive", F.coalesce("validator_fail_reason", F.lit("guard"))).when(out == "possibly_sensitive", F.when(F.col("decided_by") == "no_anchor", "missing_anchor").otherwise("precedence_tie")).when(out == "confirmed_untransformable", "empty_span")
    return found.where("stage <> 'loser'").select("doc_id", "start", "end", "class", out.alias("outcome"), why.alias("reason"))
