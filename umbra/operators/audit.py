"""Audit tables: metadata only. Queries project a fixed list of columns, and missing ones are null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Column: (type, default for tables that lack it).
REDACTION_LOG = {
    **{c: ("string", None) for c in "source recognizer_id recognizer_version_id class action field_name document_kind".split()},
    "conflict_loser": ("boolean", False), "decided_by": ("string", "none"), "created_at": ("long", None), "session_id": ("string", None),
    "snapshot_scheme": ("string", "none"), "snapshot_alg": ("string", "none"), "snapshot_key_version": ("long", None),
    **{c: ("string", None) for c in "validator_fail_reason labelled_value_scan_reason ambiguity_record collision_family collision_variant fallback_triggered backend_silently_dropped provenance_stage provenance_model_id provenance_model_version provenance_artifact_sha256 provenance_tokenizer_sha256 provenance_locale_resolved provenance_locale_match_kind provenance_canonical_class provenance_native_class".split()},
    "provenance_confidence": ("double", None), "provenance_merged_from": ("string", None), "restore_policy": ("string", None), "restore_decision": ("string", None),
    **{c: ("long", None) for c in "restore_unknown_token_count restore_manifest_bypass_count restore_fresh_pii_count restore_phase_mask restore_trap_shape_count".split()},
    "outcome": ("string", None), "outcome_reason": ("string", None), "field_path_depth": ("long", None), "field_evidence": ("string", None),
}
SAFETY_NET_LOG = {"id": ("long", None)} | {c: ("long" if c in ("span_len", "created_at") else "double" if c == "score" else "string", None) for c in "safety_net_id raw_label mapped_class leak_kind span_len document_kind field_path score created_at session_id pipeline_class safety_net_replay_hash backend_id backend_version decoding_params_hash telemetry_kind".split()}


def project(df: DataFrame, columns: dict = REDACTION_LOG) -> DataFrame:
    """Exactly the listed columns; an old table's missing ones are null or their default."""
    have = set(df.columns)
    return df.select(*((F.col(c) if c in have else F.lit(default)).cast(kind).alias(c) for c, (kind, default) in columns.items()))


def query(df: DataFrame, columns: dict = REDACTION_LOG, since: int | None = None, until: int | None = None, has_ambiguity: bool | None = None, ambiguity_reason: str | None = None, restore_events_only: bool = False, **equal) -> DataFrame:
    """AND of the given predicates over the projection; one on a missing column matches nothing."""
    if extra := set(equal) - set(columns):
        raise ValueError(f"unknown columns {sorted(extra)}")
    have, rows = set(df.columns), project(df, columns)
    preds = [(F.col(c) if c in have else F.lit(None).cast(columns[c][0])) == v for c, v in equal.items() if v is not None]
    if since is not None:
        preds.append(F.col("created_at") >= since)
    if until is not None:
        preds.append(F.col("created_at") <= until)
    if has_ambiguity is not None:
        preds.append(F.col("ambiguity_record").isNotNull() if has_ambiguity else F.col("ambiguity_record").isNull())
    if ambiguity_reason is not None:
        preds.append(F.get_json_object("ambiguity_record", "$.reason") == ambiguity_reason)
    if restore_events_only:
        preds.append(F.col("restore_decision").isNotNull())
    return rows.where(reduce(lambda a, b: a & b, preds)) if preds else rows


def from_candidates(found: DataFrame, created_at: int, source: str = "engine") -> DataFrame:
    """Log rows of winners, losers and vetoed candidates; values never enter."""
    action = F.when(F.col("stage").isin("primary", "recovered", "residual"), "tokenize").otherwise("none")
    ambiguity = F.when(F.col("decided_by").isin("precedence_tie", "no_anchor"), F.to_json(F.struct(F.col("decided_by").alias("reason"))))
    base = found.select(F.lit(source).alias("source"), "recognizer_id", "class", action.alias("action"), F.lit("text").alias("document_kind"), (F.col("stage") == "loser").alias("conflict_loser"), "decided_by", F.lit(created_at).alias("created_at"), "validator_fail_reason", F.col("scan_reason").alias("labelled_value_scan_reason"), ambiguity.alias("ambiguity_record"), "collision_family", F.array_join("merged_sources", "+").alias("provenance_merged_from"))
    return project(base)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def export(rows: DataFrame, path: str, kind: str) -> None:
    if kind == "csv":
        rows.write.csv(path, header=True)
    elif kind == "json":
        rows.write.json(path)
    else:
        raise ValueError(f"unknown format {kind}")


def purge(df: DataFrame, before: int) -> tuple[DataFrame, DataFrame]:
    """(kept rows, count of those that go)."""
    old = F.col("created_at") < before
    return df.where(~F.coalesce(old, F.lit(False))), df.agg(F.count(F.when(old, 1)).alias("purged"))
