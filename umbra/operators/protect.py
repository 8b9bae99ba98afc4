"""Protection as DataFrames: candidates, policy actions, token allocation, splicing and restoring.

Documents are independent but for token ordinals, which need one shuffle by session. Spans are UTF-8 bytes;
texts are spliced by an ordered aggregate inside the row.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbra.functions import text as tx
from umbra.operators import engine
from umbra.operators.cut import cut
from umbra.operators.rules import CORE

RANK = {"preserve": 0, "format_preserve": 1, "generalize": 2, "tokenize": 3, "redact": 4}
FAKE_DOMAIN = "fake.invalid"
TOKEN = r"<[0-9a-f]{8}:(?:Email|Name|Location|Organization|Custom:(?:family:)?[a-z0-9_-]+)_[0-9]+>"
FAKE = r"email[0-9]+\.[0-9a-f]{8}@fake\.invalid|[0-9a-f]{8}:(?:name|location|organization|custom:[a-z0-9_-]+)_[0-9]+"
BARE = r"\b(?:email|name|location|organization)_[0-9]+\b"
CANDIDATES = "doc_id long, stage string, start int, `end` int, class string, recognizer_id string, score double, priority int, canonical_form string, evidence string, collision_family string, validator_fail_reason string, decided_by string, merged_sources array<string>, scan_reason string, value string"


def candidates(docs: DataFrame, chain: tuple[str, ...] = ("en-US", "global"), rules=CORE, dictionaries=None, extra: tuple[Callable, ...] = (), protective=None) -> DataFrame:
    """Everything the engine finds, one row a span: stage is primary, recovered, residual, loser or vetoed."""
    names = [x.split()[0].strip("`") for x in CANDIDATES.split(", ")]
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.int32(), *[pa.string()] * 5, pa.list_(pa.string()), pa.string(), pa.string())
    guard = protective or (lambda cls: True)

    def run(batches):
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                primary, recovered, cells, losers, vetoed = engine.protect(text, chain, rules, dictionaries, extra, protective=guard)
                data = text.encode()
                for stage, rows in (("primary", primary), ("recovered", recovered), ("residual", cells), ("loser", [c for c, _ in losers]), ("vetoed", vetoed)):
                    for i, c in enumerate(rows):
                        out.append((doc, stage, c.start, c.end, c.cls, c.rule, c.score, c.priority, c.canonical, c.evidence, c.family, c.reason or ("regex_guard_rejected" if c.rejected else None), losers[i][1] if stage == "loser" else c.decided_by, list(c.merged), c.scan, data[c.start : c.end].decode(errors="replace")))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(col, k) for col, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, CANDIDATES)


def action_column(rules: list[tuple[str, str | None, str]], default: str = "tokenize", cls: str = "class", field_name: str | None = None) -> Column:
    """First match wins: rules are (kind, name, action) with kind class, column or default."""
    for a in [default, *(r[2] for r in rules)]:
        if a not in RANK:
            raise ValueError(f"unknown action {a}")
    out = F.lit(default)
    for kind, name, action in reversed(rules):
        cond = F.col(cls) == name if kind == "class" else F.col(field_name) == name if kind == "column" and field_name else F.lit(kind == "default")
        out = F.when(cond, action).otherwise(out)
    return out


def family_action(members: list[str], actions: dict[str, str], default: str) -> str:
    """Without a rule of its own a family takes the strictest action of its members and the default."""
    return max([default, *(actions.get(m, default) for m in members)], key=RANK.__getitem__)


def session_prefix(session: Column, key: str = "umbra") -> Column:
    """Eight hex digits by session, the same in every run."""
    return F.substring(F.sha2(F.concat(F.lit(key + "|"), session), 256), 1, 8)


#: Documents in a row whose first sights one task ranks.
RANK_SPAN = 4096


def allocate(found: DataFrame, known: DataFrame | None = None, aliases: dict[str, str] | None = None) -> DataFrame:
    """Tokens of the distinct (session_id, family, class, raw), numbered by class in order of first sight.

    found: session_id, class, raw, family, and the order columns seq, phase and start. known: tokens of earlier
    batches, whose values keep their tokens; ordinals go on after the largest. aliases: names that private classes have in
    tokens. Ranks are counted inside stretches of seq and counts of the stretches before are added, so a session that
    holds a third of all values spreads over many tasks.
    """
    keys = ["session_id", "family", "class", "raw"]
    first = found.withColumn("family", F.coalesce("family", F.lit(""))).groupBy(*keys).agg(F.min(F.struct("seq", "phase", "start")).alias("at"))
    base = F.lit(0)
    if known is not None:
        first = first.join(known.select(*keys), keys, "left_anti")
        tops = known.groupBy("session_id", "class").agg(F.max("ordinal").alias("top"))
        first = first.join(tops, ["session_id", "class"], "left")
        base = F.coalesce("top", F.lit(0))
    group = ["session_id", "class", "__s"]
    first = first.withColumn("__s", F.coalesce(F.floor(F.col("at.seq") / RANK_SPAN), F.lit(-1)).cast("long"))
    before = first.groupBy(*group).agg(F.count("*").alias("__n"))
    before = before.select(*group, (F.sum("__n").over(Window.partitionBy("session_id", "class").orderBy("__s")) - F.col("__n")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*group).orderBy("at", "family", "raw"))
    new = first.withColumn("__r", inside).join(before, group).withColumn("ordinal", (F.col("__r") + F.col("__before") + base).cast("int"))
    shown = F.col("class")
    for private, public in (aliases or {}).items():
        shown = F.when(F.col("class") == private, public).otherwise(shown)
    new = new.withColumn("token", F.concat(F.lit("<"), session_prefix(F.col("session_id")), F.lit(":"), tx.class_label(shown), F.lit("_"), F.col("ordinal").cast("string"), F.lit(">")))
    new = new.select(*keys, "ordinal", "token")
    return new if known is None else known.select(*keys, "ordinal", "token").unionByName(new)


def lineage(found: DataFrame) -> DataFrame:
    """doc_id, start, end, class of emitted spans with recognizer_id, role and tier of everything that took part: the
    winner, rules merged into it (same_span_merge), and losers that overlap it (defeated, by which rung); settlement says
    by what step the span was settled."""
    won = found.where("stage IN ('primary', 'recovered', 'residual')")
    step = F.when(F.col("stage") == "residual", "residual").when(F.col("decided_by") == "sweep", "sweep").when(F.col("decided_by") == "precedence_tie", "collision_tie").when(F.col("decided_by") == "no_anchor", "anchor_fallback").when(F.col("stage") == "recovered", "recovery").otherwise("resolve")
    won = won.select("doc_id", "start", "end", "class", "recognizer_id", "merged_sources", step.alias("settlement"))
    cols = ["doc_id", "start", "end", "class", "settlement"]
    lead = won.select(*cols, "recognizer_id", F.lit("winner").alias("role"), F.lit(None).cast("string").alias("tier"))
    merged = won.select(*cols, "recognizer_id", F.explode("merged_sources").alias("m")).where("m <> recognizer_id").select(*cols, F.col("m").alias("recognizer_id"), F.lit("same_span_merge").alias("role"), F.lit(None).cast("string").alias("tier"))
    lost = found.where("stage = 'loser' AND decided_by <> 'merged'").select("doc_id", F.col("start").alias("s"), F.col("end").alias("e"), F.col("recognizer_id").alias("r"), F.col("decided_by").alias("tier")).distinct()
    beaten = won.join(lost, "doc_id").where("s < end AND start < e").select(*cols, F.col("r").alias("recognizer_id"), F.lit("defeated").alias("role"), "tier")
    return lead.union(merged).union(beaten)


def session_values(found: DataFrame, docs: DataFrame) -> DataFrame:
    """session_id, class, raw and seq of first sight of the values that rules have found in a session's documents."""
    sure = found.where("stage IN ('primary', 'recovered') AND evidence = 'rule' AND NOT class LIKE 'custom:family:%'")
    return sure.join(docs.select("doc_id", "session_id", "seq"), "doc_id").groupBy("session_id", "class", F.col("value").alias("raw")).agg(F.min("seq").alias("first"))


#: Documents of a session that one task scans.
SCAN_DOCS = 1000


def _by_session(docs: DataFrame, values: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run`` over parts of each session's documents together with all the session's values: documents are dealt into
    parts, values go to each part, so a large session spreads over tasks and no pair of text and value becomes a row."""
    docs, values = cut(docs), cut(values)
    sizes = cut(docs.groupBy("session_id").agg(F.ceil(F.count("*") / SCAN_DOCS).cast("int").alias("__parts")))
    d = docs.join(sizes, "session_id").withColumn("__part", F.pmod(F.xxhash64("doc_id"), F.col("__parts")).cast("int")).drop("__parts")
    own = sizes.select(F.col("session_id").alias("__vs"), F.col("__parts").alias("__vn"))
    v = values.withColumnRenamed("session_id", "__vs").join(own, "__vs").withColumn("__vp", F.explode(F.expr("sequence(0, __vn - 1)"))).drop("__vn")
    return d.groupBy("session_id", "__part").cogroup(v.groupBy("__vs", "__vp")).applyInArrow(run, schema)


def session_copies(docs: DataFrame, values: DataFrame) -> DataFrame:
    """doc_id, class, raw, copies: how often (without overlaps) each value of a session stands in its documents' texts."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        import ahocorasick

        out = []
        if left.num_rows and right.num_rows:
            automaton, cls = ahocorasick.Automaton(), dict(zip(right.column("raw").to_pylist(), right.column("class").to_pylist(), strict=True))
            for raw in cls:
                automaton.add_word(raw, raw)
            automaton.make_automaton()
            for doc, text in zip(left.column("doc_id").to_pylist(), left.column("text").to_pylist(), strict=True):
                seen: dict[str, list[int]] = {}
                for end, raw in automaton.iter(text or ""):
                    n = seen.setdefault(raw, [0, -1])
                    if end - len(raw) >= n[1]:
                        n[0], n[1] = n[0] + 1, end
                out += [(doc, cls[raw], raw, n) for raw, (n, _) in seen.items()]
        columns = zip(*out, strict=True) if out else [[], [], [], []]
        return pa.table([pa.array(list(c), k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int32()), strict=True)], names=["doc_id", "class", "raw", "copies"])

    return _by_session(docs.select("session_id", F.col("doc_id").cast("long"), "text"), values.select("session_id", "class", "raw"), run, "doc_id long, class string, raw string, copies int")


def session_sweep(docs: DataFrame, found: DataFrame, values: DataFrame) -> DataFrame:
    """Candidates (stage recovered, rule sweep) for copies of values that earlier documents of the session have shown, in
    bytes that nothing found covers. values: as ``session_values`` gives them, or a session's tokens with first null."""
    held = found.where("stage IN ('primary', 'recovered', 'residual')").groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("held"))
    rows = docs.select("session_id", F.col("doc_id").cast("long"), "seq", "text").join(held, "doc_id", "left")
    names = [x.split()[0].strip("`") for x in CANDIDATES.split(", ")]
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.int32(), *[pa.string()] * 5, pa.list_(pa.string()), pa.string(), pa.string())

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            known = sorted(zip(right.column("class").to_pylist(), right.column("raw").to_pylist(), right.column("first").to_pylist(), strict=True), key=str)
            first = {raw: at for _, raw, at in known}
            for doc, seq, text, spans in zip(*(left.column(c).to_pylist() for c in ("doc_id", "seq", "text", "held")), strict=True):
                if not text:
                    continue
                data = text.encode()
                earlier = [(cls, raw) for cls, raw, at in known if at is None or at < seq]
                here = {data[s["start"] : s["end"]].decode(errors="replace") for s in spans or ()}
                for c in engine.sweep(text, [], [v for v in earlier if v[1] not in here or first[v[1]] is None or first[v[1]] < seq]):
                    a = len(text[: c.start].encode())
                    b = a + len(text[c.start : c.end].encode())
                    if not any(s["start"] < b and a < s["end"] for s in spans or ()):
                        out.append((doc, "recovered", a, b, c.cls, "sweep", c.score, c.priority, None, "rule", None, None, "sweep", [], None, text[c.start : c.end]))
        columns = zip(*out, strict=True) if out else [[]] * len(names)
        return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return _by_session(rows, values.select("session_id", "class", "raw", "first"), run, CANDIDATES)


def fake(cls: Column, prefix: Column, ordinal: Column) -> Column:
    n = ordinal.cast("string")
    return F.when(cls == "email", F.concat(F.lit("email"), n, F.lit("."), prefix, F.lit("@" + FAKE_DOMAIN))).otherwise(F.concat(prefix, F.lit(":"), cls, F.lit("_"), n))


def replacement(action: Column, token: Column, cls: Column, prefix: Column, ordinal: Column, raw: Column) -> Column:
    return F.when(action == "tokenize", token).when(action == "redact", "[REDACTED]").when(action == "generalize", tx.generalization(cls)).when(action == "format_preserve", fake(cls, prefix, ordinal)).otherwise(raw)


def splice(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """``docs`` with clean_text and manifest (array of clean and raw spans); edits: doc_id, start, end, class, replacement, disjoint, in bytes."""
    listed = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "class", "replacement"))).alias("edits"))
    joined = docs.join(listed, "doc_id", "left").withColumn("__b", F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    empty = F.struct(F.lit(0).alias("at"), F.expr("cast('' as binary)").alias("out"), F.expr("cast(array() as array<struct<clean_start:int,clean_end:int,raw_start:int,raw_end:int,class:string>>)").alias("manifest"))

    def step(s, e):
        out = F.concat(s["out"], F.substring(F.col("__b"), s["at"] + 1, e["start"] - s["at"]))
        new = F.concat(out, F.encode(e["replacement"], "UTF-8"))
        row = F.struct(F.length(out).alias("clean_start"), F.length(new).alias("clean_end"), e["start"].alias("raw_start"), e["end"].alias("raw_end"), e["class"].alias("class"))
        return F.struct(e["end"].alias("at"), new.alias("out"), F.concat(s["manifest"], F.array(row)).alias("manifest"))

    done = F.aggregate(F.coalesce("edits", F.expr("cast(array() as array<struct<start:int,`end`:int,class:string,replacement:string>>)")), empty, step)
    out = joined.withColumn("__d", done)
    tail = F.substring(F.col("__b"), F.col("__d.at") + 1, F.length("__b"))
    return out.select(*docs.columns, F.when(F.col("text").isNotNull(), F.decode(F.concat(F.col("__d.out"), tail), "UTF-8")).alias("clean_text"), F.col("__d.manifest").alias("manifest"))


def protect(docs: DataFrame, policy: list[tuple[str, str | None, str]] = (), default: str = "tokenize", known: DataFrame | None = None, found: DataFrame | None = None, sweep: bool = False, aliases: dict[str, str] | None = None, **detect) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clean documents, tokens, edits) of documents with doc_id, session_id, seq and text.

    sweep: also protect copies of values that rules have found in earlier documents of the session, or that ``known``
    tokens stand for."""
    rules = list(policy)
    found = cut(candidates(docs, **detect)) if found is None else found
    if sweep:
        values = session_values(found, docs)
        if known is not None:
            older = known.where("family = ''").select("session_id", "class", "raw", F.lit(None).cast("long").alias("first"))
            values = older.unionByName(values.join(older, ["session_id", "class", "raw"], "left_anti"))
        found = cut(found.unionByName(session_sweep(docs, found, values)))
    phases = F.when(F.col("stage") == "primary", 0).when(F.col("stage") == "recovered", 1).otherwise(2)
    live = found.where("stage IN ('primary', 'recovered', 'residual')").withColumn("phase", phases).withColumn("action", action_column(rules, default))
    live = live.join(docs.select("doc_id", "session_id", "seq"), "doc_id").select("doc_id", "session_id", "seq", "phase", "start", "end", "class", F.when(F.col("class").startswith("custom:family:"), F.col("class")).otherwise("").alias("family"), F.col("value").alias("raw"), "action")
    tokens = allocate(live.where("action IN ('tokenize', 'format_preserve')"), known, aliases)
    edits = live.join(tokens, ["session_id", "family", "class", "raw"], "left")
    edits = edits.withColumn("replacement", replacement(F.col("action"), F.col("token"), F.col("class"), session_prefix(F.col("session_id")), F.col("ordinal"), F.col("raw")))
    return splice(docs, edits.where("action <> 'preserve'")), tokens, edits


def restore(docs: DataFrame, tokens: DataFrame, strict: bool = False, text: str = "clean_text") -> DataFrame:
    """``docs`` with restored, n_tokens, unknown_tokens, bypass_count, trap_count and decision.

    Tokens in the text are joined with the session's tokens; unknown ones stay. A strict restore refuses texts with
    unknown or malformed tokens: decision is refused and restored is null.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    hits = docs.select("doc_id", "session_id", F.explode(F.array_distinct(F.regexp_extract_all(body, F.lit(f"({TOKEN})"), F.lit(1)))).alias("token"))
    known = hits.join(tokens.select("session_id", "token", "raw"), ["session_id", "token"], "left")
    listed = known.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("raw").isNotNull(), F.struct("token", "raw")))).alias("__map"), F.collect_list(F.when(F.col("raw").isNull(), F.col("token"))).alias("__unknown"))
    gaps, found = F.split(body, TOKEN, -1), F.regexp_extract_all(body, F.lit(f"({TOKEN})"), F.lit(1))
    put = F.transform(found, lambda t: F.coalesce(F.try_element_at(F.col("__map"), t), t))
    woven = F.array_join(F.flatten(F.zip_with(gaps, put, lambda g, p: F.array(g, F.coalesce(p, F.lit(""))))), "")
    out = docs.join(listed, "doc_id", "left").withColumn("__text", F.when(F.col(text).isNotNull(), F.when(F.col("__map").isNull(), body).otherwise(woven)))
    unknown = F.coalesce(F.size("__unknown"), F.lit(0))
    unknown = F.when(F.col("__unknown").isNull(), 0).otherwise(F.size("__unknown"))
    trap = F.regexp_count(body, F.lit(r"<[0-9a-f]{1,8}:[A-Za-z:_-]*")) - F.regexp_count(body, F.lit(TOKEN))
    out = out.select(*docs.columns, "__text", F.size(found).alias("n_tokens"), unknown.alias("unknown_tokens"), F.regexp_count(body, F.lit(BARE)).alias("bypass_count"), trap.alias("trap_count"))
    bad = (F.col("unknown_tokens") > 0) | (F.col("trap_count") > 0)
    decision = F.when(bad, "refused" if strict else "partial").otherwise("restored")
    return out.withColumn("decision", decision).withColumn("restored", F.when(F.lit(strict) & bad, F.lit(None)).otherwise(F.col("__text"))).drop("__text")


def spellings(tokens: DataFrame) -> DataFrame:
    """``tokens`` with spelling: json_escaped if the raw bytes, read inside a JSON string, spell another value."""
    inner = F.from_json(F.concat(F.lit('["'), "raw", F.lit('"]')), "array<string>", {"mode": "PERMISSIVE"})
    value = F.when(F.col("raw").contains("\\"), F.get(inner, F.lit(0)))
    return tokens.withColumn("spelling", F.when(value.isNotNull() & (value != F.col("raw")), "json_escaped").otherwise("plain"))


def decoded(tokens: DataFrame) -> DataFrame:
    """``tokens`` whose escaped values are written as what they spell, for destinations that are no JSON."""
    value = F.get(F.from_json(F.concat(F.lit('["'), "raw", F.lit('"]')), "array<string>"), F.lit(0))
    return spellings(tokens).withColumn("raw", F.when(F.col("spelling") == "json_escaped", value).otherwise(F.col("raw"))).drop("spelling")


def provenance(docs: DataFrame, tokens: DataFrame, text: str = "clean_text") -> DataFrame:
    """doc_id and ranges (bytes of the restored text that come from the session's values, touching ones joined)."""
    body = F.coalesce(F.col(text), F.lit(""))
    hits = docs.select("doc_id", "session_id", F.explode(F.array_distinct(F.regexp_extract_all(body, F.lit(f"({TOKEN})"), F.lit(1)))).alias("token"))
    known = hits.join(tokens.select("session_id", "token", "raw"), ["session_id", "token"]).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("token", "raw"))).alias("__map"))
    parts = F.zip_with(F.split(body, TOKEN, -1), F.regexp_extract_all(body, F.lit(f"({TOKEN})"), F.lit(1)), lambda g, t: F.struct(g.alias("g"), t.alias("t")))
    empty = F.expr("named_struct('at', 0, 'out', cast(array() as array<struct<start:int,`end`:int>>))")

    def step(s, p):
        raw = F.try_element_at("__map", p["t"])
        a = s["at"] + F.octet_length(p["g"])
        b = a + F.coalesce(F.octet_length(raw), F.octet_length(p["t"]), F.lit(0))
        last = F.try_element_at(s["out"], F.lit(-1))
        joined = F.concat(F.slice(s["out"], F.lit(1), F.greatest(F.size(s["out"]) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), b.alias("end"))))
        out = F.when(raw.isNull() | (a == b), s["out"]).when(last["end"] == a, joined).otherwise(F.concat(s["out"], F.array(F.struct(a.alias("start"), b.alias("end")))))
        return F.struct(b.alias("at"), out.alias("out"))

    return docs.join(known, "doc_id", "left").select("doc_id", F.aggregate(parts, empty, step)["out"].alias("ranges"))


#: Bits of the phases that a restore went through.
PHASES = {"located": 1, "restored": 2, "classified": 4, "refused": 8}


def telemetry(restored: DataFrame, policy: str) -> DataFrame:
    """doc_id, policy, decision, counts and phase_mask of ``restore``'s rows; no value."""
    mask = F.lit(PHASES["located"] | PHASES["classified"]) + F.when(F.col("decision") == "refused", PHASES["refused"]).otherwise(PHASES["restored"])
    return restored.select("doc_id", F.lit(policy).alias("restore_policy"), F.col("decision").alias("restore_decision"), F.col("unknown_tokens").cast("long").alias("restore_unknown_token_count"), F.col("bypass_count").cast("long").alias("restore_manifest_bypass_count"), F.col("trap_count").cast("long").alias("restore_trap_shape_count"), mask.cast("long").alias("restore_phase_mask"))


def rule_hits(texts: DataFrame, rules=CORE) -> DataFrame:
    """case_id, rule, start, end, class, value, verdict of the matches that the rule named in each row (case_id, rule, text)
    has in its text: live, recorded (its check failed, and it goes on as learned evidence), vetoed or guarded."""
    by = {r.id: r for r in rules}
    names = ["case_id", "rule", "start", "end", "class", "value", "verdict"]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())

    def run(batches):
        for batch in batches:
            out = []
            for case, rule, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                view, spans = tx.normalize(text)
                anchored = [a for a in engine.ANCHORED if a.id == rule]
                found = engine.scan_anchored(view, anchored, ("de-DE", "en-US", "global")) if anchored else engine.scan_rule(by[rule], view)
                for c in found:
                    a, b = tx.raw_range(spans, len(view[: c.start].encode()), len(view[: c.end].encode()))
                    verdict = "guarded" if c.rejected else "recorded" if c.scan == "recorded" else "vetoed" if c.reason else "live"
                    out.append((case, rule, a, b, c.cls, text.encode()[a:b].decode(), verdict))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return texts.select("case_id", "rule", "text").mapInArrow(run, "case_id long, rule string, start long, `end` long, class string, value string, verdict string")


def verdicts(values: DataFrame) -> DataFrame:
    """validator, value, ok, canonical of rows (validator, value) by the Python validators."""
    from umbra.functions.validators import VALIDATORS

    def run(batches):
        for batch in batches:
            got = [VALIDATORS[v](x) for v, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([bool(g[0]) for g in got]), pa.array([g[1] for g in got], pa.string())], names=["validator", "value", "ok", "canonical"])

    return values.select("validator", "value").mapInArrow(run, "validator string, value string, ok boolean, canonical string")


def arbitrate(pools: DataFrame, chain: tuple[str, ...] = ("en-US", "global"), protective: Callable = lambda cls: True) -> DataFrame:
    """case_id, stage, start, end, class, rule, decided_by: the resolver over given pools of candidates, one a case. pools:
    case_id, text, start, end, class, rule, score, priority, canonical, evidence, family, variant, precedence, anchors."""
    fields = ["start", "end", "class", "rule", "score", "priority", "canonical", "evidence", "family", "variant", "precedence", "anchors"]
    rows = pools.groupBy("case_id").agg(F.first("text").alias("text"), F.sort_array(F.collect_list(F.struct(*fields))).alias("pool"))

    def run(batches):
        for batch in batches:
            out = []
            for case, text, pool in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                live = [engine.Candidate(p["start"], p["end"], p["class"], p["rule"], p["score"], p["priority"], p["canonical"], p["evidence"], p["family"], p["variant"], p["precedence"] or 0, tuple(p["anchors"] or ())) for p in pool]
                primary, recovered, losers = engine.plan(text or "", engine.Pool(live), chain)
                cells = engine.residual_cells([*primary, *recovered], losers, protective)
                for stage, found in (("primary", primary), ("recovered", recovered), ("residual", cells), ("loser", [engine.replace(c, decided_by=r) for c, r in losers])):
                    out += [(case, stage, c.start, c.end, c.cls, c.rule, c.decided_by) for c in found]
            if out:
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["case_id", "stage", "start", "end", "class", "rule", "decided_by"])

    return rows.mapInArrow(run, "case_id long, stage string, start long, `end` long, class string, rule string, decided_by string")


def dlp_events(replies: DataFrame, tokens: DataFrame, **detect) -> DataFrame:
    """Values in replies that the session's tokens don't hold: doc_id, class and a hash, never the value."""
    found = candidates(replies.select("doc_id", F.col("restored").alias("text")), **detect).where("stage IN ('primary', 'recovered')")
    new = found.join(replies.select("doc_id", "session_id"), "doc_id").withColumnRenamed("value", "raw").join(tokens.select("session_id", "class", "raw").distinct(), ["session_id", "class", "raw"], "left_anti")
    return new.select("doc_id", "class", F.sha2("raw", 256).alias("value_sha256"))


def snapshot(tokens: DataFrame, key: str, issued_at: int) -> DataFrame:
    """Signed export of a token table: one payload a session, keyed MAC instead of a signature (no signing library here)."""
    rows = tokens.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("class", "family", "raw", "token", "ordinal"))).alias("entries"))
    body = rows.select("session_id", F.to_json(F.struct(F.lit(1).alias("version"), F.lit(issued_at).alias("issued_at"), "session_id", "entries")).alias("payload"))
    return body.withColumn("mac", tx.hmac_sha256(key, F.col("payload")))


def load_snapshot(rows: DataFrame, key: str, now: int, ttl: int, skew: int = 60) -> DataFrame:
    """Tokens of valid payloads; a wrong MAC, an expired one or one from the future is an error."""
    entry = "array<struct<class:string,family:string,raw:string,token:string,ordinal:int>>"
    body = rows.withColumn("j", F.from_json("payload", f"version int, issued_at long, session_id string, entries {entry}"))
    fault = F.when(F.col("mac") != tx.hmac_sha256(key, F.col("payload")), "bad signature").when(F.col("j.version") != 1, "bad version").when(F.col("j.issued_at") + ttl < now, "expired").when(F.col("j.issued_at") > now + skew, "from the future")
    checked = body.select(F.when(fault.isNull(), F.col("j")).otherwise(F.raise_error(fault)).alias("j"))
    return checked.select("j.session_id", F.explode("j.entries").alias("e")).select("session_id", "e.family", "e.class", "e.raw", "e.ordinal", "e.token")
