"""Record context: what a caller declares about a request's record, and where its values stand in the text."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.functions import text as tx
from umbra.functions.validators import iban_mod97
from umbra.operators.engine import Candidate, scan_dictionary
from umbra.sources.json_tree import JsonError, nodes

MAX_DEPTH, MAX_FIELDS, MAX_VALUE = 8, 256, 4096
#: Classes by a key's letters and digits.
KEY_CLASSES = {
    "email": "email emailaddress mail courriel emailadres correioeletronico",
    "custom:phone": "phone phonenumber tel telephone telefon mobile handy telefono telefoon telemovel celular",
    "name": "name fullname firstname givenname vorname lastname surname nachname nom prenom achternaam voornaam nome sobrenome",
    "custom:iban": "iban",
    "custom:birth_date": "dob dateofbirth birthdate geburtsdatum datedenaissance geboortedatum datadenascimento",
    "custom:postal_code": "zip postcode plz codepostal cep",
    "location": "address street strasse city stadt adresse rue ville adres straat plaats endereco rua cidade",
}
_CLASS_OF = {key: cls for cls, keys in KEY_CLASSES.items() for key in keys.split()}
_KEY = re.compile("[A-Za-z0-9_-]+")
#: Words after which a single name stands.
GREETINGS = ("Hi", "Hello", "Dear", "Hallo", "Bonjour", "Olá")


def record_class(key: str) -> str | None:
    """The class that a key names; a value never decides."""
    return _CLASS_OF.get("".join(c for c in key if c.isascii() and c.isalnum()).lower())


def safe_value(value: str, cls: str) -> bool:
    """Long enough to be looked for: a valid IBAN, four digits without letters, or three letters."""
    letters, digits = sum(map(str.isalpha, value)), sum(map(str.isnumeric, value))
    return cls == "custom:iban" and bool(iban_mod97(value)[0]) or (digits >= 4 if not letters else letters >= 3)


def record_leaves(text: str) -> list[tuple[str, str]]:
    """(path, value) of a record: nested objects of named strings; anything else is an error."""
    found, bad = [], 0
    for path, depth, _, _, kind, value in nodes(text):
        if kind == "object" or not depth:
            bad += kind != "object"
        elif kind != "string" or not value.strip() or depth > MAX_DEPTH or len(value.encode()) > MAX_VALUE:
            bad += 1
        else:
            found.append((path[2:].replace(".", "/"), value))
    if bad or not found or len(found) > MAX_FIELDS or not all(_KEY.fullmatch(k) for p, _ in found for k in p.split("/")):
        raise JsonError("a record holds named strings only")
    return found


_FIELDS = "path string, value string, class string, status string"


def record_fields(records: DataFrame, key: str = "record_id", column: str = "record", mapping: dict[str, str] | None = None) -> DataFrame:
    """key, path, value (single blanks), class and status of each leaf: ok, unmapped (neither mapped nor a known key),
    unsafe (too short to look for); a record that breaks the form gives one row ``invalid``."""
    names = [key, "path", "value", "class", "status"]

    def run(batches):
        for batch in batches:
            at, out = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                try:
                    leaves = record_leaves(text or "")
                except JsonError:
                    at.append(i)
                    out.append((None, None, None, "invalid"))
                    continue
                for path, value in leaves:
                    cls = (mapping or {}).get(path) or record_class(path.rsplit("/", 1)[-1])
                    at.append(i)
                    out.append((path, " ".join(value.split()), cls, "unmapped" if cls is None else "ok" if safe_value(value, cls) else "unsafe"))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(c, pa.string()) for c in zip(*out, strict=True))], names=names)

    return records.select(key, column).mapInArrow(run, f"`{key}` {records.schema[key].dataType.simpleString()}, {_FIELDS}")


def occurrences(text: str, value: str) -> list[tuple[int, int]]:
    """Places of a value that cut no word."""
    out, at = [], text.find(value)
    while value and at >= 0:
        end = at + len(value)
        if not tx.is_inside_word(text, at) and not tx.is_inside_word(text, end):
            out.append((at, end))
        at = text.find(value, end)
    return out


def field_spans(docs: DataFrame, fields: DataFrame) -> DataFrame:
    """doc_id, start, end, path, json_type, evidence: scalar leaves of documents that are one strict JSON object or array
    (validated_parse; a string's inside), and copies of the caller's values (caller_declared). fields: doc_id, path, value."""
    listed = fields.groupBy("doc_id").agg(F.collect_list(F.struct("path", "value")).alias("fields"))
    rows = docs.join(listed, "doc_id", "left").select(F.col("doc_id").cast("long"), "text", "fields")

    def run(batches):
        for batch in batches:
            out = []
            for doc, text, declared in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                text = text or ""
                if text.lstrip()[:1] in ("{", "["):
                    try:
                        for path, _, a, b, kind, _ in nodes(text):
                            a, b = (a + 1, b - 1) if kind == "string" else (a, b)
                            if kind not in ("object", "array") and a < b:
                                out.append((doc, a, b, path, kind, "validated_parse"))
                    except JsonError:
                        out = [o for o in out if o[0] != doc or o[5] != "validated_parse"]
                for f in declared or ():
                    for a, b in occurrences(text, f["value"]):
                        start = len(text[:a].encode())
                        out.append((doc, start, start + len(text[a:b].encode()), f["path"], "string", "caller_declared"))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "start", "end", "path", "json_type", "evidence"])

    return rows.mapInArrow(run, "doc_id long, start long, `end` long, path string, json_type string, evidence string")


def match_kind(found: str, term: str) -> str:
    """How a record's value is spelled in the text."""
    if found == term:
        return "exact"
    if " ".join(found.split()) == term:
        return "whitespace"
    return "case" if found.casefold() == term.casefold() else "whitespace_case"


def record_matches(text: str, name: str, term: str, cls: str) -> list[tuple[Candidate, str]]:
    """Copies of a record's value, any case and blanks, with their kind of match."""
    folded, at = tx.fold(text)
    out = []
    for c in scan_dictionary(name, [tx.fold(term)[0]], cls, folded):
        a, b = at[c.start], at[c.end - 1] + 1
        out.append((Candidate(a, b, cls, f"record.{name}", 0.95, 96, text[a:b]), match_kind(text[a:b], term)))
    return out


_NEAR = re.compile(r"[\s,'’-]{0,16}")


def corroborated(text: str, span: tuple[int, int], own: str, others: list[str]) -> bool:
    """Whether a single, common name counts: it keeps its capital, and another field of the record stands beside it, or
    a full name that holds it is in the text while it follows a greeting."""
    a, b = span
    if text[a] != own[:1]:
        return False
    for other in others:
        if len(other.split()) > 1:
            said = re.search(r"([^\W\d_]+)[^\w]*$", text[:a])
            if own.casefold() in other.casefold().split() and occurrences(text.casefold(), other.casefold()) and said and said[1] in GREETINGS:
                return True
        elif any(_NEAR.fullmatch(text, y, a) if y <= a else b <= x and _NEAR.fullmatch(text, b, x) for x, y in occurrences(text, other)):
            return True
    return False


def record_names(docs: DataFrame, names: DataFrame, common: list[str]) -> DataFrame:
    """doc_id, start, end, path, kind: names (doc_id, path, value) of each document's record, where single ones that are
    common words only count beside other parts of the record."""
    listed = names.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("path", "value"))).alias("names"))
    rows = docs.join(listed, "doc_id").select(F.col("doc_id").cast("long"), "text", "names")
    plain = {c.casefold() for c in common}

    def run(batches):
        for batch in batches:
            out = []
            for doc, text, own in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for n in own:
                    value, others = n["value"], [x["value"] for x in own if x["path"] != n["path"]]
                    for c, kind in record_matches(text or "", n["path"], value, "name"):
                        if " " not in value and value.casefold() in plain:
                            if not corroborated(text, (c.start, c.end), value, others):
                                continue
                            kind = "corroborated_single"
                        start = len(text[: c.start].encode())
                        out.append((doc, start, start + len(text[c.start : c.end].encode()), n["path"], kind))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "start", "end", "path", "kind"])

    return rows.mapInArrow(run, "doc_id long, start long, `end` long, path string, kind string")


def record_guesses(arguments: DataFrame, records: DataFrame) -> DataFrame:
    """call_id, record_id, how: calls whose arguments (call_id, position, text) spell a record's private value, in one of
    them (alone), in all of them joined (joined), or over two in a row (paired); case and signs don't matter."""
    flat = lambda c: F.lower(F.regexp_replace(c, r"[\s'\"._,-]", ""))
    values = records.select("record_id", flat(F.col("value")).alias("k")).where(F.length("k") >= 4).distinct()
    parts = arguments.select("call_id", "position", flat(F.col("text")).alias("k"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("position", "k"))), lambda x: x["k"])
    calls = parts.groupBy("call_id").agg(listed.alias("ks"))
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("ks") - 2, F.lit(0))), lambda i: F.concat(F.get("ks", i), F.coalesce(F.get("ks", i + 1), F.lit(""))))
    said = calls.select("call_id", F.explode(F.concat(F.transform("ks", lambda k: F.struct(F.lit("alone").alias("how"), k.alias("k"))), F.when(F.size("ks") > 1, F.transform(pairs, lambda k: F.struct(F.lit("paired").alias("how"), k.alias("k")))).otherwise(F.expr("cast(array() as array<struct<how:string,k:string>>)")), F.when(F.size("ks") > 2, F.array(F.struct(F.lit("joined").alias("how"), F.array_join("ks", "").alias("k")))).otherwise(F.expr("cast(array() as array<struct<how:string,k:string>>)")))).alias("s")).select("call_id", "s.how", "s.k")
    first = F.min(F.when(F.col("how") == "alone", 0).when(F.col("how") == "paired", 1).otherwise(2))
    return said.join(values, "k").groupBy("call_id", "record_id").agg(F.element_at(F.array(*(F.lit(x) for x in ("alone", "paired", "joined"))), first + 1).alias("how"))
