"""Entity index: keyed fingerprints of canonical values as postings, with policy checks before a search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbra.functions.text import class_label, collapse_ascii_whitespace, hmac_sha256
from umbra.operators.protect import splice


def domain_alias(cls: Column, fingerprint: Column) -> Column:
    """Owner-side name of an entity in stored snippets: class and fingerprint in letters. Never shown to an agent."""
    return F.concat(F.lit("<"), class_label(cls), F.lit("_"), F.translate(fingerprint, "0123456789abcdef", "ABCDEFGHIJKLMNOP"), F.lit(">"))


def fragment_placeholder(cls: Column) -> Column:
    """Stands for protected bytes that are no entity: class alone, nothing to search for."""
    return F.concat(F.lit("[fragment:"), cls, F.lit("]"))


ALIAS = r"<(?:Email|Name|Location|Organization|Custom:[a-z0-9_:-]+)_[A-P]+>"


def fingerprints(entities: DataFrame, key: str, domain: str) -> DataFrame:
    """``entities`` (class, value) with domain_id, fingerprint_hex and alias."""
    canonical = F.lower(collapse_ascii_whitespace(F.col("value")))
    out = entities.withColumn("domain_id", F.lit(domain)).withColumn("fingerprint_hex", hmac_sha256(key, F.concat_ws("|", F.lit(domain), "class", canonical)))
    return out.withColumn("alias", domain_alias(F.col("class"), F.col("fingerprint_hex")))


def postings(entities: DataFrame, key: str, domain: str) -> DataFrame:
    """Distinct (domain_id, class, fingerprint_hex, doc_id, alias); markers are no entities."""
    real = entities.where(~F.col("value").rlike(r"^\[REDACTED"))
    return fingerprints(real, key, domain).select("domain_id", "class", "fingerprint_hex", "doc_id", "alias").distinct()


def ingest(docs: DataFrame, edits: DataFrame, key: str, domain: str) -> tuple[DataFrame, DataFrame]:
    """(snippets, entities) of protected documents. edits: doc_id, start, end (of the raw text), class, raw, origin (whole
    or residual_fragment) and replacement. Whole entities become aliases, fragments placeholders, markers stay."""
    marked = F.col("replacement").rlike(r"^\[REDACTED")
    named = fingerprints(edits.withColumn("value", F.col("raw")), key, domain)
    put = F.when(marked, F.col("replacement")).when(F.col("origin") == "residual_fragment", fragment_placeholder(F.col("class"))).otherwise(F.col("alias"))
    snippets = splice(docs, named.select("doc_id", "start", "end", "class", put.alias("replacement"))).select("doc_id", F.col("clean_text").alias("snippet"))
    entities = named.where(~marked & (F.col("origin") == "whole")).select("domain_id", "doc_id", "class", "raw", "fingerprint_hex", "alias").distinct()
    return snippets, entities


def seal(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of an index as encrypted payloads (authenticated, with random nonces): one column, ``payload``."""
    return rows.select(F.base64(F.aes_encrypt(F.to_json(F.struct(*columns)), F.lit(key.encode().ljust(32, b"0")[:32]), F.lit("GCM"))).alias("payload"))


def unseal(rows: DataFrame, key: str, schema: str) -> DataFrame:
    """Rows of sealed payloads; a wrong key or a changed payload is an error."""
    plain = F.decode(F.aes_decrypt(F.unbase64("payload"), F.lit(key.encode().ljust(32, b"0")[:32]), F.lit("GCM")), "UTF-8")
    return rows.select(F.from_json(plain, schema).alias("r")).select("r.*")


def authorize_search(requests: DataFrame, domains: DataFrame, rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """``requests`` with rule_id, max_results and deny_reason, the first in a fixed order of checks.

    requests: request_id, principal, tenant, workspace, own_tenant, own_workspace, session_id, bound_to, domain_id, tool,
    action, roles, purpose, token. domains: domain_id, tenant (d_tenant), snippets, allowed_roles, allowed_classes,
    allowed_tools. rules: rule_id, position, domain_id, tool, action, role, class, purpose, scope_domain, max_results; null
    matches anything. tokens: session_id, token, class, raw. Domains and rules are a policy file's, bounded tables.
    """
    r = requests.join(domains.withColumn("__known", F.lit(True)), "domain_id", "left").join(tokens.select("session_id", "token", "class", "raw"), ["session_id", "token"], "left")
    fields = ["tool", "action", "class", "purpose"]
    rule = rules.select("domain_id", "rule_id", "position", "max_results", "role", "scope_domain", *(F.col(f).alias(f"r_{f}") for f in fields))
    cond = (F.col("q.domain_id") == F.col("u.domain_id")) & (F.col("u.role").isNull() | F.array_contains("q.roles", F.col("u.role")))
    for f in fields:
        cond = cond & (F.col(f"u.r_{f}").isNull() | (F.col(f"u.r_{f}") == F.col(f"q.{f}")))
    inside = F.col("u.scope_domain").isNull() | (F.col("u.scope_domain") == F.col("q.domain_id"))
    hits = r.alias("q").join(rule.alias("u"), cond).groupBy("q.request_id").agg(F.min(F.when(inside, F.struct("u.position", "u.rule_id", "u.max_results"))).alias("m"), F.max(~inside).alias("crossed"))
    out = r.join(hits, "request_id", "left")
    steps = (
        ("tenant_or_workspace_mismatch", ~(F.col("tenant").eqNullSafe(F.col("own_tenant")) & F.col("workspace").eqNullSafe(F.col("own_workspace")))),
        ("session_principal_mismatch", ~F.col("bound_to").eqNullSafe(F.col("principal"))),
        ("domain_not_found", F.col("__known").isNull()),
        ("tenant_or_workspace_mismatch", ~F.col("d_tenant").eqNullSafe(F.col("tenant"))),
        ("snippets_disabled", ~F.col("snippets")),
        ("principal_not_allowed", ~F.arrays_overlap("roles", "allowed_roles")),
        ("no_matching_allow_rule", ~F.array_contains("allowed_tools", F.col("tool"))),
        ("unknown_token", F.col("class").isNull()),
        ("class_not_allowed", ~F.array_contains("allowed_classes", F.col("class"))),
        ("cross_domain_denied", F.col("m").isNull() & F.coalesce("crossed", F.lit(False))),
        ("no_matching_allow_rule", F.col("m").isNull()),
    )
    deny = F.coalesce(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in steps))
    out = out.withColumn("deny_reason", deny)
    granted = lambda c: F.when(F.col("deny_reason").isNull(), F.col(c))
    return out.select(*requests.columns, granted("m.rule_id").alias("rule_id"), granted("m.max_results").alias("max_results"), "deny_reason")


def validate_handles(uses: DataFrame) -> DataFrame:
    """``uses`` of search handles (use_id, at, requested_ref, entity_ref, entity_domain, target_domain, expires_at, nonce)
    with deny_reason: another entity, another domain, too late, or a nonce that an earlier valid use has consumed."""
    early = F.when(F.col("requested_ref") != F.col("entity_ref"), "entity_ref_mismatch").when(F.col("entity_domain") != F.col("target_domain"), "handle_domain_mismatch").when(F.col("at") > F.col("expires_at"), "expired_handle")
    out = uses.withColumn("__early", early)
    first = out.where("__early IS NULL").groupBy("nonce").agg(F.min(F.struct("at", "use_id")).alias("__first"))
    replay = F.when(F.struct("at", "use_id") > F.col("__first"), "replayed_handle")
    return out.join(first, "nonce", "left").withColumn("deny_reason", F.coalesce("__early", replay)).select(*uses.columns, "deny_reason")


def project_filters(filters: DataFrame, allowed: list[str], key: str, key_id: str, domain: str) -> DataFrame:
    """``filters`` (request_id, field, class, value) with projected, a keyed fingerprint in place of the value; a field
    that the handle doesn't list denies it."""
    named = fingerprints(filters, key, domain)
    ok = F.col("field").isin(allowed)
    return named.select("request_id", "field", F.when(ok, F.concat(F.lit(f"projected:{key_id}:"), "fingerprint_hex")).alias("projected"), F.when(~ok, "no_matching_allow_rule").alias("deny_reason"))


def translate_hits(hits: DataFrame, entities: DataFrame, tokens: DataFrame) -> DataFrame:
    """doc_id, snippet, status of ``hits`` (request_id, session_id, doc_id, snippet): aliases become tokens of the session;
    a hit that still holds an alias or a raw value of its entities outside of the tokens is refused, without snippet.

    entities: doc_id, class, raw, alias; tokens: session_id, class, raw, token."""
    known = hits.select("request_id", "session_id", "doc_id").join(entities, "doc_id").join(tokens.select("session_id", "class", "raw", "token"), ["session_id", "class", "raw"], "left")
    by = known.groupBy("request_id", "doc_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("token").isNotNull(), F.struct("alias", "token")))).alias("names"), F.collect_set("raw").alias("raws"))
    rows = hits.join(by, ["request_id", "doc_id"], "left")
    gaps, found = F.split("snippet", ALIAS, -1), F.regexp_extract_all("snippet", F.lit(f"({ALIAS})"), F.lit(1))
    put = F.transform(found, lambda a: F.try_element_at("names", a))
    shown = F.array_join(F.flatten(F.zip_with(gaps, put, lambda g, p: F.array(g, F.coalesce(p, F.lit(""))))), "")
    rows = rows.withColumn("__gaps", gaps)
    said = F.exists(F.coalesce("raws", F.array().cast("array<string>")), lambda r: F.array_join("__gaps", "\0").contains(r))
    leak = F.exists(put, lambda p: p.isNull()) | said
    return rows.select("request_id", "doc_id", F.when(~leak, shown).alias("snippet"), F.when(leak, "translator_failed").otherwise("ok").alias("status"))


def search(requests: DataFrame, index: DataFrame, cap: int = 100) -> DataFrame:
    """request_id with matching documents by doc_id, at most as many as the request's own max_results (of the rule that
    granted it), else ``cap``: a feature of the search."""
    own = F.coalesce("max_results", F.lit(cap)) if "max_results" in requests.columns else F.lit(cap)
    hits = requests.withColumn("__cap", own).join(index, ["domain_id", "fingerprint_hex"]).select("request_id", "doc_id", "alias", "__cap").distinct()
    w = Window.partitionBy("request_id").orderBy("doc_id", "alias")
    return hits.withColumn("rank", F.row_number().over(w)).where("rank <= __cap").drop("__cap")


def authorize(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """``requests`` with rule_id of the first matching rule and deny_reason; null fields of a rule match anything.

    rules are a policy file's, a bounded table.
    """
    fields = ["tenant", "workspace", "tool", "action", "class", "purpose"]
    r = rules.select(F.col("rule_id"), F.col("position"), "max_results", "role", *(F.col(f).alias(f"r_{f}") for f in fields))
    cond = F.col("role").isNull() | F.array_contains("roles", F.col("role"))
    for f in fields:
        cond = cond & (F.col(f"r_{f}").isNull() | (F.col(f"r_{f}") == F.col(f)))
    hit = requests.join(r, cond, "left").groupBy("request_id").agg(F.min(F.when(F.col("rule_id").isNotNull(), F.struct("position", "rule_id", "max_results"))).alias("m"))
    out = requests.join(hit, "request_id").withColumn("rule_id", F.col("m.rule_id")).withColumn("max_results", F.col("m.max_results")).drop("m")
    return out.withColumn("deny_reason", F.when(F.col("tenant").isNull(), "no_tenant").when(F.size("roles") < 1, "no_role").when(F.col("rule_id").isNull(), "no_rule"))


def rate_limited(requests: DataFrame, cap: int, seconds: int) -> DataFrame:
    """``requests`` (principal, domain_id, at, entity_hash) with denied: distinct entities by time bucket beyond ``cap``; repeats are free."""
    bucket = F.floor(F.col("at") / seconds)
    keys = ["principal", "domain_id", "bucket"]
    rows = requests.withColumn("bucket", bucket)
    firsts = rows.groupBy(*keys, "entity_hash").agg(F.min(F.struct("at", "request_id")).alias("first"))
    firsts = firsts.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("first"))).drop("first")
    return rows.join(firsts, [*keys, "entity_hash"]).withColumn("denied", F.col("nth") > cap).drop("nth")
