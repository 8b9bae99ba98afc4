"""Operators without SQL against plain versions of what they say they do."""

import hashlib
import itertools
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from umbra.llm import _hashing, bottomk, ivfpq, license_patience, mixing, quality_mcd, secret_novelty

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def word(rnd, low=3, high=8):
    return "".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(low, high)))


# mixing -------------------------------------------------------------------------------------------------------


def filled(total, caps, weights):
    """Shares of a total: whoever can't take its share is full, the others share what is left, again and again."""
    left, full = total, {}
    open_ = set(caps)
    while open_:
        share = {c: left * weights[c] / sum(weights[x] for x in open_) for c in open_}
        short = {c for c in open_ if caps[c] <= share[c]}
        if not short:
            return full | {c: math.floor(share[c]) for c in open_}
        for c in short:
            full[c], left = caps[c], left - caps[c]
        open_ -= short
    return full


def mixed(rows, share, weights, epochs, seed, domains=mixing.DOMAINS):
    """Counter of (doc_id, epoch) drawn."""
    size = lambda t: len((t or "").split())
    weight = lambda level, name: weights.get(level, {}).get(name, weights["default"])
    leaves: dict = {}
    for i, t, lang, source in rows:
        leaves.setdefault((domains.get(source or "", domains["default"]), lang, source), []).append((i, size(t), str(i)))
    supply = {k: sum(n for _, n, _ in v) for k, v in leaves.items()}
    cap = {k: epochs * n for k, n in supply.items()}
    total = int(share * sum(supply.values()))
    group = lambda keys, depth: {p: sum(cap[k] for k in cap if k[:depth] == p) for p in {k[:depth] for k in keys}}
    tops = filled(total, group(cap, 1), {p: weight("domain", p[0]) for p in group(cap, 1)})
    out: Counter = Counter()
    for top, have in tops.items():
        langs = group([k for k in cap if k[:1] == top], 2)
        for lang, budget in filled(have, langs, {p: weight("lang", p[1]) for p in langs}).items():
            own = {k: cap[k] for k in cap if k[:2] == lang}
            for leaf, tokens in filled(budget, own, {k: weight("source", k[2]) for k in own}).items():
                whole = tokens // supply[leaf] if supply[leaf] else 0
                rest = tokens - whole * supply[leaf]
                order = sorted(leaves[leaf], key=lambda d: (hashlib.md5(f"{seed}:{whole}:{d[2]}".encode()).hexdigest(), d[2]))  # noqa: B023
                at = 0
                for i, n, _ in order:
                    times = 1 if n == 0 else whole + (at < rest)
                    at += n
                    out.update((i, e) for e in range(times))
    return out


@pytest.mark.parametrize("share,weights,epochs", [(0.9, mixing.WEIGHTS, 3), (1.7, {"domain": {"web": 1, "curated": 8}, "lang": {"fr": 5}, "source": {"src3": 3}, "default": 1}, 2)])
def test_mixing_against_plain_budgets(spark, share, weights, epochs):
    rnd = random.Random(3)
    rows = [(i, " ".join(word(rnd) for _ in range(rnd.choice([0, 3, 30, 200]))) if i % 17 else None, rnd.choice(["en", "fr", None]), rnd.choice(["src0", "src1", "src2", "src3", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"n_tokens": F.lit("clash"), "epoch": F.lit("clash"), "domain": F.lit("clash")})
    got = Counter((r["doc_id"], r["epoch"]) for r in mixing.mix(df, None, share, weights, epochs, "s").collect())
    assert got == mixed(rows, share, weights, epochs, "s")
    assert mixing.mix(df, None, share, weights, epochs, "s").columns == ["doc_id", "text", "lang", "source", "domain", "n_tokens", "epoch"]


# quality ------------------------------------------------------------------------------------------------------


def robust_distances(x):
    """Squared distances of whole-number vectors to their minimum-covariance-determinant estimate."""
    u, floor = 10_000, np.array(quality_mcd.FLOOR)
    estimate = lambda rows, factor: (rows.mean(0) / u, (rows.T @ rows / len(rows) - np.outer(rows.mean(0), rows.mean(0))) / u**2 * factor + np.diag(floor**2))
    lower = lambda v: np.sort(v, axis=0)[(len(v) + 1) // 2 - 1]

    def chol(c):
        out = np.zeros((4, 4))
        for i in range(4):
            for j in range(i + 1):
                rest = c[i, j] - out[i, :j] @ out[j, :j]
                out[i, j] = math.sqrt(max(rest, floor[i] ** 2)) if i == j else rest / out[j, j]
        return out

    def distance(mean, factor):
        y = np.linalg.solve(factor, (x / u - mean).T)
        return (y * y).sum(0)

    def step(mean, factor):
        bins = np.minimum(np.floor(np.log1p(distance(mean, factor)) * 16), 1000)
        below = np.array([(bins < b).sum() for b in bins])
        m, c = estimate(x[below < math.ceil(0.75 * len(x))], quality_mcd.H_FACTOR)
        return m, chol(c)

    middle = lower(x)
    mad = lower(np.abs(x - middle))
    starts = [(middle / u, chol(np.diag((1.4826 * mad / u) ** 2 + floor**2)))]
    m, c = estimate(x, 1.0)
    starts.append((m, chol(c)))
    ends = []
    for s in starts:
        for _ in range(3):
            s = step(*s)
        ends.append((np.log(np.diag(s[1])).sum(), s))
    s = step(*min(ends, key=lambda e: e[0])[1])
    m, c = estimate(x[distance(*s) <= quality_mcd.REWEIGHT], 1.0)
    return distance(m, chol(c))


def test_quality_distances_against_numpy(spark):
    rnd = random.Random(8)
    text = lambda i: "\n".join(" ".join(word(rnd, 2, 6 + i % 5) + ("#" * (i % 7 == 0)) for _ in range(12)) + (" the same end of it" if i % 3 == 0 else "") for _ in range(6 + i % 9))
    rows = [(i, text(i), "en", "s", 0) for i in range(240)]
    df = spark.createDataFrame(rows, DOCS).withColumns({"n_words": F.lit("clash"), "kept": F.lit("clash"), "__w": F.lit(1), "distance": F.lit("x")})
    got = {r["doc_id"]: r for r in quality_mcd.quality(df).collect()}
    stats = {r["doc_id"]: r for r in quality_mcd.base_statistics(df.select("doc_id", "text", "lang", "source")).collect()}
    good = [i for i in got if not got[i]["base_failed"]]
    half_up = lambda v: math.floor(v * 10_000 + 0.5)
    vector = lambda r: [half_up(math.log(r["word_chars"] / r["n_words"])), half_up(math.sqrt(r["n_symbols"] / r["word_chars"])), half_up(math.sqrt(r["n_dup_lines"] / r["__n_lines"])), half_up(math.sqrt(r["n_repeat_words"] / r["n_words"]))]
    want = robust_distances(np.array([vector(stats[i]) for i in good], float))
    assert len(good) > 150
    assert np.allclose([got[i]["distance"] for i in good], want, rtol=1e-6)
    kept = {i for i, d in zip(good, want, strict=True) if d <= quality_mcd.CUTOFF}
    assert {i for i in got if got[i]["kept"]} == kept and 0 < len(kept)
    out = quality_mcd.keep_good(df)
    assert out.columns == df.columns and {r["doc_id"] for r in out.collect()} == kept and {r["n_words"] for r in out.collect()} == {"clash"}


# secrets ------------------------------------------------------------------------------------------------------

RUN = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
VALUE = RUN - {"-"} | set(".=-")


def plain_spans(text):
    """Base spans by hand, leftmost first, one kind after another."""
    out = []
    low = "".join(c.lower() if c.isascii() else c for c in text)
    at = 0
    while at < len(text):
        end = None
        for key in ("password", "passwd", "secret", "token", "apikey", "api_key"):
            if low.startswith(key, at):
                i = at + len(key)
                i += text[i : i + 1] in ("'", '"') and i < len(text)
                while text[i : i + 1] == " ":
                    i += 1
                if text[i : i + 1] in (":", "=") and i < len(text):
                    i += 1
                    while text[i : i + 1] == " ":
                        i += 1
                    i += text[i : i + 1] in ("'", '"') and i < len(text)
                    j = i
                    while j < len(text) and text[j] in VALUE:
                        j += 1
                    if j > i:
                        end = j
                        if j - i >= 8:
                            out.append((at, 0, j))
                        break
        at = end or at + 1
    for kind, starts, signs, least in ((1, "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 16), (2, "", set("0123456789abcdef"), 32)):
        at = 0
        while at < len(text):
            if text.startswith(starts, at) and (starts or text[at] in signs):
                j = at + len(starts)
                while j < len(text) and text[j] in signs:
                    j += 1
                if j > at + len(starts):
                    if j - at >= least:
                        out.append((at, kind, j))
                    at = j
                    continue
            at += 1
    return sorted(out)


def plain_novel(text, known):
    """Runs that stand alone between spaces, in sensitive contexts, by the compressor's own sizes."""
    out, at = [], 0
    while at < len(text):
        if text[at] not in RUN:
            at += 1
            continue
        end = at
        while end < len(text) and text[end] in RUN:
            end += 1
        if end - at >= 20:
            before, after = text[max(0, at - 160) : at], text[end : end + 160]
            around = (before + "\n" + after).lower()
            if any(w in around for w in ("password", "passwd", "secret", "token", "apikey", "api_key", "credential", "private", "bearer", "auth", "access")):
                primer = zstandard.ZstdCompressionDict(f"{secret_novelty.IDENTIFIERS}\n{known}\n{after}\n".encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                size = lambda b: len(zstandard.ZstdCompressor(level=3, dict_data=primer, write_content_size=False, write_checksum=False, write_dict_id=False).compress(b.encode()))  # noqa: B023, E731
                if max(0, size(before + text[at:end]) - size(before)) / (end - at) >= 0.42:
                    out.append((at, 3, end))
        at = end
    return out


def test_secrets_against_plain_scans(spark):
    rnd = random.Random(12)
    noise = lambda n: "".join(rnd.choices(sorted(RUN - set("+/=_-")), k=n))
    pieces = [lambda: word(rnd), lambda: "PassWord = '" + noise(rnd.randint(4, 30)) + "'", lambda: "api_key:" + noise(9), lambda: 'token": "' + noise(12), lambda: "secret=", lambda: "AKIA" + noise(16).upper(), lambda: "".join(rnd.choices("0123456789abcdef", k=rnd.randint(28, 40))), lambda: noise(rnd.randint(18, 44)), lambda: "é", lambda: "bearer", lambda: "my_service_account_name_value", lambda: "company_wide_prefix", lambda: "authorization"]
    texts = [" ".join(rnd.choice(pieces)() for _ in range(rnd.randint(1, 40))) for _ in range(250)] + ["", "token token: abcdefgh" + "x" * 30]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, None)], "doc_id long, text string").withColumn("spans", F.lit("clash"))
    known = secret_novelty.dictionary(df)
    assert "company_wide_prefix" in known.split() and not any(len(w) >= 20 for w in known.split())
    assert not any(w in known.split() for t in texts for w in t.split() if len(w) >= 18 and w.isalnum())
    got = {r["doc_id"]: r for r in secret_novelty.scan_secrets(df, redact=True).collect()}
    for i, t in enumerate(texts):
        base, novel = plain_spans(t), plain_novel(t, known)
        spell = lambda spans: ",".join(f"{('assign', 'access', 'hex', 'novel')[k]}:{a}:{b}" for a, k, b in spans)
        assert got[i]["spans"] == spell(sorted(base + novel)), t
        assert got[i]["base_sha256"] == hashlib.sha256(spell(base).encode()).hexdigest()
        assert [got[i][c] for c in ("n_assign", "n_access", "n_hex", "n_novel")] == [sum(k == x for _, k, _ in base + novel) for x in range(4)]
        hidden = [c for c in t]
        for a, _, b in base + novel:
            hidden[a:b] = [None] * (b - a)
        runs = ["".join(g) for k, g in itertools.groupby(hidden, key=lambda c: c is None) if not k] if False else [c for c in hidden if c is not None]
        assert "".join(runs) == "".join(part for part in __import__("re").split(r"\[(?:assign|access|hex|novel) removed\]", got[i]["redacted"]))
    assert sum(r["n_novel"] for r in got.values()) > 20


# licenses -----------------------------------------------------------------------------------------------------


def longest(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_licenses_against_whole_alignments():
    """Edited notices in long texts that also hold the notice's words elsewhere."""
    rnd = random.Random(21)
    names = [n for n, t in license_patience._TEMPLATE_WORDS.items()]
    for _ in range(250):
        name = rnd.choice(names)
        template = license_patience._TEMPLATE_WORDS[name]
        notice = list(template)
        for at in rnd.sample(range(len(notice)), int(rnd.choice([0, 0.05, 0.1]) * len(notice))):
            notice[at] = rnd.choice(["", "zz" + word(rnd), notice[at] + " " + word(rnd)])
        noise = lambda n: [rnd.choice([word(rnd), rnd.choice(template)]) if rnd.random() < 0.2 else word(rnd) for _ in range(n)]  # noqa: B023, E731
        said = " ".join(notice).split()
        text = " ".join(noise(rnd.choice([0, 40, 400])) + said + noise(rnd.choice([0, 40, 400])))
        found = {x[0]: x for x in license_patience.find_licenses(text)}
        least = license_patience.MIN_COVERAGE * len(template)
        assert longest(said, template) >= least
        assert name in found and found[name][1] >= least, (name, text)
    for text in (" ".join(word(rnd) for _ in range(300)), "permission granted license copyright software " * 30):
        assert not license_patience.find_licenses(text)


def test_notice_whose_words_stand_elsewhere():
    mit = license_patience.TEMPLATES["mit"]
    for w in ("above", "sublicense", "merge", "noninfringement"):
        for text in (f"{w} " + "x y z " * 90 + mit, mit + " x y z" * 90 + f" {w}", f"{w} x " * 9 + mit + f" {w}" * 5):
            assert [x[0] for x in license_patience.find_licenses(text)].count("mit") == 1, w


# hashes, vectors ----------------------------------------------------------------------------------------------


def test_arranged_words_do_not_collide():
    even, odd = "a", "b"
    for _ in range(11):
        even, odd = even + odd, odd + even
    hashes = _hashing.word_hashes(f"{even} {odd} {even[::-1]} {'ab' * 1024} {'ba' * 1024}")
    assert len(set(hashes.tolist())) == len({even, odd, even[::-1], "ab" * 1024, "ba" * 1024})
    rnd = random.Random(4)
    texts = [" ".join(word(rnd, 1, 3) for _ in range(rnd.randint(0, 30))) for _ in range(200)] + ["", "  ", "É é É", "A a"]
    together = _hashing.many_word_hashes(texts)
    of: dict = {}
    for t, h in zip(texts, together, strict=True):
        assert h.tolist() == _hashing.word_hashes(t).tolist()
        for w, x in zip("".join(c.lower() if c.isascii() else c for c in t).split(), h.tolist(), strict=True):
            assert of.setdefault(w, x) == x
    assert len(set(of.values())) == len(of)


def test_vectors_of_several_lengths_and_repeated_ids(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8 if i % 3 else 5).tolist()) for i in range(90)] + [(4, [9.0] * 5), (200, [1.0]), (201, []), (202, [0.0, None, 1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"score": F.lit("x"), "rank": F.lit("x"), "list": F.lit(0)})
    got: dict = {}
    for r in ivfpq.search(df, df.where("vec_id % 20 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    best = {}
    for i, v in rows:
        if v and None not in v and (i not in best or len(v) > len(best[i])):
            best[i] = np.array(v)
    for q in range(0, 90, 20):
        near = sorted(((-float((v * best[q]).sum()), i) for i, v in best.items() if i != q and len(v) == len(best[q])))[:20]
        assert [i for _, i, _ in sorted(got[q])] == [i for _, i in near]
    assert 200 not in got


# the pipeline -------------------------------------------------------------------------------------------------


def components(texts):
    """Smallest position reachable, by comparing every pair of sets."""
    sets = []
    for t in texts:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    top = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            x, y = sorted((top[a], top[b]))
            top = [x if v == y else v for v in top]
    return top


def test_pipeline_against_plain_stages(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(31)
    noise = lambda n: "".join(rnd.choices(sorted(RUN - set("+/=_-")), k=n))
    say = lambda n: " ".join(word(rnd) for _ in range(n))
    texts = [say(rnd.randint(60, 160)) for _ in range(120)]
    texts += [texts[i] for i in range(10)] + [texts[20 + i] + " " + say(2) for i in range(10)] + [say(80) + f" password = '{noise(24)}' " + say(5) for _ in range(8)]
    texts += [None, "", "few words", " ".join(w + "##$$" for w in say(80).split()), "again and again " * 40, say(6000)]
    rows = [(i, t, rnd.choice(["en", "en", "de", None]), rnd.choice(["src0", "src3", None]), None if i == 3 else len(t or "")) for i, t in enumerate(texts)] + [(None, say(90), "en", "src0", 1), (7, texts[7], "en", "src0", 2)]
    folder = f"{tmp_path}/t"
    spark.createDataFrame(rows, DOCS).withColumns({"kept": F.lit("clash"), "n_words": F.lit(1), "epoch": F.lit(2)}).repartition(3).write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{name}")
        seen[name] = (docs.collect(), spark.read.parquet(f"{tmp_path}/{name}").collect())
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "best-fit packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "")
    before, after = seen["quality rules"]
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    assert set(range(148, 153)) <= gone and len(gone) < 15 and sum(r["doc_id"] == 7 for r in after) in (0, 2)
    before, after = seen["minhash near-dedup"]
    ids = [r for r in sorted(before, key=key) if r["doc_id"] is not None]
    keep = {ids[c]["doc_id"] for c in components([r["text"] for r in ids])} | {None}
    assert sorted(r["doc_id"] or -1 for r in after) == sorted(k or -1 for k in keep) or sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in after) == sorted((k is None, k or 0) for k in keep)
    before, after = seen["secret scans"]
    known = secret_novelty.dictionary(spark.read.parquet(f"{tmp_path}/minhash near-dedup"))
    want = sorted((key(r)[:2], secret_novelty.redacted(r["text"], sorted(plain_spans(r["text"]) + plain_novel(r["text"], known)))) for r in before)
    assert sorted((key(r)[:2], r["text"]) for r in after) == want
    assert all(r["n_chars"] in (None, len(r["text"])) for r in after) and not any("password = '" in r["text"] for r in after)
    before, after = seen["source mixing"]
    want = Counter(i for i, _ in mixed([(r["doc_id"], r["text"], r["lang"], r["source"]) for r in before if r["doc_id"] is not None], 1.0, mixing.WEIGHTS, 3, mixing.SEED).elements())
    assert abs(len(after) - 0.9 * sum(want.values())) < 0.2 * sum(want.values())
    exact = mixing.mix(spark.read.parquet(f"{tmp_path}/secret scans"))
    assert Counter(r["doc_id"] for r in after) == Counter(r["doc_id"] for r in exact.collect())
    before, after = seen["best-fit packing"]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = Counter()
    for r in after:
        sizes[r["doc_id"]] += r["length"]
    want = Counter()
    for r in before:
        want[r["doc_id"]] += len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1
    assert sizes == want
    bins: dict = {}
    for r in after:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 4096
    assert len(bins) <= -(-sum(sizes.values()) // 4096) + 1
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).drop("sequence_id", "offset").collect()), key=repr) == sorted((tuple(r)[:5] for r in after), key=repr)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_bundles_of_unequal_sizes():
    sets = [np.arange(n, dtype=np.uint64) for n in (100, 90, 86, 84, 50)]
    found = bottomk.compare(np.arange(5), np.arange(5), np.zeros(5, np.int64), sets, -1)
    assert {tuple(sorted(p)) for p in found} == {(0, 1), (0, 2), (1, 2), (1, 3), (2, 3)}
