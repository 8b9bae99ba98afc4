import itertools
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from umbra.functions import text as tx
from umbra.functions import validators as va
from umbra.operators import engine
from umbra.operators.engine import Candidate
from umbra.operators.rules import CORE, check_families, check_shadow, load_rules


def test_validators():
    ok = {"luhn": "4111 1111 1111 1111", "iban_mod97": "DE89 3704 0044 0532 0130 00", "ipv4_parse": "10.0.0.255", "ipv6_parse": "fe80::1", "eth_eip55": "0x5aAeb6053F3E94C9b9A09f33669435E7Ef1BeAed", "cpf_mod11": "529.982.247-25", "cnpj_mod11": "11.222.333/0001-81", "bsn_mod11": "111222333", "uk_nhs_mod11": "943 476 5919", "de_steuer_id_mod1110": "86095742719", "fr_nir_mod97": "2 55 08 14 168 025 38", "e164_phone_national_us": "+1 (743) 555-3824", "e164_phone_national_de": "030 1234567", "email_rfc": "a@b.example", "aadhaar_verhoeff": "2363"}
    ok["aadhaar_verhoeff"] = next(f"23456789012{d}"[:11] + str(d) for d in range(10) if va.aadhaar_verhoeff("23456789012" + str(d))[0])
    for name, value in ok.items():
        assert va.VALIDATORS[name](value)[0], name
    for name, value in {"luhn": "4111111111111112", "iban_mod97": "DE89370400440532013001", "ipv4_parse_non_documentation": "192.0.2.1", "ipv6_parse_non_documentation": "2001:db8::1", "eth_eip55": "0x5aAeb6053F3E94C9b9A09f33669435E7Ef1BeAeD", "bsn_mod11": "111111111", "luhn_zero": "0000000000000000"}.items():
        assert not va.VALIDATORS[name.split("_zero")[0]](value)[0], name
    assert va.keccak256(b"").hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"


def test_normalize_keeps_raw_ranges():
    view, spans = tx.normalize("ａ​b é")
    assert view == "ab é"
    assert tx.raw_range(spans, 0, 1) == (0, 3) and tx.raw_range(spans, 1, 2) == (6, 7) and tx.raw_range(spans, 2, 2) is None
    assert tx.normalize("plain") == ("plain", None)


def test_rule_pack():
    check_families(CORE)
    for r in CORE:
        check_shadow(r)
    assert load_rules('[[rules]]\nid = "x"\ncls = "custom:x"\npattern = "X[0-9]+"\n')[0].id == "x"
    for bad in ('[[rules]]\nid = "x"\ncls = "c"\npattern = "a"\nboost = 1\n', '[[rules]]\nid = "x"\ncls = "c"\npattern = "a"\nvalidator = "nope"\n', '[[rules]]\nid = "x"\ncls = "c"\npattern = "<[0-9a-f]{8}:.*"\n'):
        try:
            load_rules(bad)
        except (ValueError, TypeError):
            continue
        raise AssertionError(bad)


def test_detection_of_each_family():
    text = "From: Ada Lovelace <ada@example.invalid>\ncard 4111 1111 1111 1111, ip 10.1.2.3, IBAN DE89370400440532013000\ncall +1 (743) 555-3824 born 1990-02-03, aged 42, api_key = \"abcdef123456\" https://x.example/a"
    primary, *_ = engine.protect(text)
    got = {c.cls for c in primary}
    assert {"email", "name", "custom:credit_card", "custom:ip_address", "custom:iban", "custom:phone", "custom:birth_date", "custom:age", "custom:security_token", "custom:url"} <= got
    spans = [(c.start, c.end) for c in primary]
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


CLASSES = ["email", "name", "organization", "location", "custom:iban"]
spec = st.lists(st.tuples(st.integers(0, 40), st.integers(1, 12), st.integers(0, 4), st.sampled_from([0.3, 0.5, 0.9]), st.integers(1, 5)), max_size=10)


@settings(max_examples=150, deadline=None)
@given(spec, st.randoms())
def test_resolver_invariants(rows, rnd):
    pool = [Candidate(s, s + n, CLASSES[r], f"rec{r}", sc, p, "x" if r % 2 == 0 else None) for s, n, r, sc, p in rows]
    kept, _ = engine.resolve(pool)
    assert all(a.end <= b.start for a, b in itertools.pairwise(kept))
    edges = {c.start for c in pool} | {c.end for c in pool}
    assert all(c.start in edges and c.end in edges for c in kept)
    mixed = list(pool)
    rnd.shuffle(mixed)
    key = lambda cs: sorted((c.start, c.end, c.cls) for c in cs)
    assert key(engine.resolve(mixed)[0]) == key(kept)


def test_sweep_and_residual():
    text = "Dear Ada Lovelace, hi. Later Lovelace wrote. Lovelaces not."
    primary, recovered, *_ = engine.protect(text)
    found = [text[c.start : c.end] for c in (*primary, *recovered)]
    assert found.count("Lovelace") == 1 and "Ada Lovelace" in found
    a, b = Candidate(0, 10, "custom:x", "a"), Candidate(5, 8, "name", "b")
    cells = engine.residual_cells([b], [(a, "score")], lambda c: True)
    assert [(c.start, c.end) for c in cells] == [(0, 5), (8, 10)]


def test_tokens_restore(spark):
    from umbra.operators import protect as pr

    random.seed(1)
    docs = spark.createDataFrame([(1, "s", 1, "mail a.b@x.example and ä 10.1.2.3"), (2, "s", 2, "a.b@x.example again, name_12"), (3, "s", 3, None), (4, "t", 1, "")], "doc_id long, session_id string, seq long, text string")
    clean, tokens, _ = pr.protect(docs)
    back = {r["doc_id"]: r for r in pr.restore(clean, tokens, strict=True).collect()}
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == {k: r["restored"] for k, r in back.items()}
    assert back[2]["bypass_count"] == 1
    assert tokens.where("class = 'email'").count() == 1
    later, more, _ = pr.protect(spark.createDataFrame([(5, "s", 5, "c@y.example")], docs.schema), known=tokens)
    assert {r["ordinal"] for r in more.where("class = 'email'").collect()} == {1, 2}
    snap = pr.snapshot(tokens, "k", 1000)
    assert pr.load_snapshot(snap, "k", 1010, 100).count() == tokens.count()
