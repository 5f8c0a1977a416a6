"""Spans, secrets, personal data, url filters and fingerprints against plain Python on small rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import boost, fingerprint, pii, secretscan, urlfilter

DOC = "doc_id long, text string"


def sha(spans, names):
    return hashlib.sha256(",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(spans)).encode()).hexdigest()


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def secrets_of(t):
    t, out = t or "", []
    word = "|".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    out += [(m.start(), 0, m.end()) for m in re.finditer(rf"""(?:{word})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]


def private_of(t):
    t = t or ""
    n = lambda m: sum(c.isdigit() for c in m[0])
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= n(m) <= 19 and luhn(m[0])]
    return out + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= n(m) <= 15]


ODD = [
    None, "", " ", "password=token=abcdefgh", "secret: token: abcdef", "x AKIA" + "A" * 30 + " é😀 " + "f" * 30, "cafe" * 8 + "x" + "beef" * 9, "api_key : 'abc123' API-KEY=zzzzzzzz", "a" * 40_000 + "@" + "b" * 20 + ".c",
    "a@b.c_d@e.f x@y 1.2.3.4.5.6.7.8 999.1.1.1 007.0.0.255", "+1 (2) 33-44 55.66 7", "4269-4132-4522-6465 4111 1111 1111 1111 " + "1" * 9000, "😀 joe@ex.com, call (988) 555-2485 or +19885552485", "x@y.z" * 500, "TOKEN:\n=abcdefg",
]


def noise(seed):
    r = random.Random(seed)
    parts = ["a@b.co", "+1 (555) 555-0100", "4111111111111111", "10.0.0.1", "token=", "AKIA", "0123456789abcdef" * 2, " ", ".", "-", "@", "é", "😀", "12", "x", "password", ":", "\n"]
    return ["".join(r.choice(parts) for _ in range(r.randrange(30))) for _ in range(120)]


def test_secrets_match_plain_search(spark):
    texts = ODD + noise(1)
    got = secretscan.scan(spark.createDataFrame(list(enumerate(texts)), DOC)).collect()
    for r in got:
        spans = secrets_of(texts[r.doc_id])
        assert r.base_sha256 == sha(spans, secretscan.KINDS), texts[r.doc_id][:80]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[1] == k for s in spans) for k in range(3)]


def entropy(text, window):
    best = 0.0
    for i in range(max(1, len(text) - window + 1)):
        w = text[i : i + window]
        best = max(best, -sum(w.count(c) / len(w) * np.log2(w.count(c) / len(w)) for c in set(w)))
    return best


def test_incremental_entropy_equals_that_of_every_window(spark):
    r = random.Random(2)
    texts = ["".join(r.choice("abcdefABC0123+/") for _ in range(n)) for n in (1, 5, 20, 21, 60, 300)]
    got = spark.createDataFrame(list(enumerate(texts)), DOC).select("text", secretscan.most_entropy(F.col("text")).alias("e")).collect()
    for x in got:
        assert x.e == pytest.approx(entropy(x.text, secretscan.WINDOW), abs=1e-9)


def test_random_strings_are_secrets_and_allowed_ones_are_not(spark):
    texts = ["see 9aF3kLmQ2xZ8vB1nR7tY4wE6 here", "123e4567-e89b-12d3-a456-426614174000", "Donaudampfschifffahrtsgesellschaft", "https://example.com/some/long/path/x1", "2026-01-02-2026-01-03-2026", "some_snake_case_name_of_words", "zzzzzzzzzzzzzzzzzzzzzzzz1A"]
    got = {r.doc_id: r.spans for r in secretscan.scan(spark.createDataFrame(list(enumerate(texts)), DOC)).collect()}
    assert got == {0: "entropy:4:28", **{i: "" for i in range(1, 7)}}


def test_private_data_matches_plain_search(spark):
    texts = ODD + noise(3)
    got = pii.report(pii.detect(spark.createDataFrame(list(enumerate(texts)), DOC))).collect()
    for r in got:
        spans = private_of(texts[r.doc_id])
        assert r.base_sha256 == sha(spans, pii.KINDS), texts[r.doc_id][:80]
        assert {f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans} <= set(r.spans.split(",")) | {""}


def test_redaction_keeps_all_else_and_columns(spark):
    rows = [(1, "mail a@b.co now", "base", 15), (2, None, "spans", 0), (3, "clean 12 text", "row", 13)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string, n_chars long")
    got = pii.redact(docs)
    assert got.columns == docs.columns
    assert {r.doc_id: (r.text, r.base, r.n_chars) for r in got.collect()} == {1: ("mail <EMAIL> now", "base", 16), 2: (None, "spans", 0), 3: ("clean 12 text", "row", 13)}


def corpus_with_private_data(n):
    """Texts of made-up words, a base span of each kind in every fifth, and numbers that are none in others."""
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdeilnorstu") for _ in range(r.randrange(2, 9)))
    words = lambda k: " ".join(word() for _ in range(k))

    def card():
        head = "".join(r.choice("0123456789") for _ in range(15))
        return next(head + c for c in "0123456789" if luhn(head + c))

    datum = [lambda: f"{word()}.{r.randrange(99)}@{word()}.example.com", lambda: ".".join(str(r.randrange(1, 250)) for _ in range(4)), card, lambda: f"+1 ({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)}"]
    odd = [lambda: f"{r.randrange(300, 999)}.{r.randrange(9)}.{r.randrange(9)}", lambda: "".join(r.choice("0123456789") for _ in range(r.randrange(20, 30))), lambda: f"{r.randrange(1000, 9999)} {r.randrange(1000, 9999)}"]
    return [f"{words(9)} {(datum[i % 4] if i % 5 else odd[i % 3])()} {words(9)}" for i in range(n)]


def test_trees_add_what_the_base_patterns_miss(spark):
    models = pii.fit(spark.createDataFrame(list(enumerate(corpus_with_private_data(1500))), DOC))
    assert all(m.trees and least != float("inf") for m, least in models)
    hidden = ["joan.7 (at) mail3 (dot) example (dot) com", "10[.]20[.]30[.]40", "4111.1111.1111.1111", "(743) 555-3824"]
    texts = [f"nor sel dua {x} in to line" for x in hidden] + ["dine @ noon tin", "see 3.1.4 on that", "run 1 2 3 4", "12345678901234567890123456"]
    docs = spark.createDataFrame(list(enumerate(texts)), DOC)
    got = {r.doc_id: (r.n_email + r.n_ip + r.n_card + r.n_phone, r.spans) for r in pii.report(pii.detect(docs, models)).collect()}
    want = {i: (0, f"{pii.KINDS[i]}:12:{12 + len(x)}") for i, x in enumerate(hidden)} | {i: (0, "") for i in range(4, 8)}
    assert got == want


@pytest.mark.parametrize("operator", [secretscan.scan, lambda d: pii.report(pii.detect(d)), fingerprint.fingerprints])
def test_empty_tables_give_empty_results(spark, operator):
    assert operator(spark.createDataFrame([], DOC)).count() == 0


def test_trees_learn_and_columns_score_as_they_do(spark):
    r = np.random.default_rng(0)
    x = r.random((400, 2))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = boost.fit(("a", "b"), x, y)
    assert ((m.margin(x) > 0) == (y > 0)).mean() > 0.95
    rows = spark.createDataFrame(x[:50].tolist(), "a double, b double")
    got = [v[0] for v in rows.select(m.column({"a": F.col("a"), "b": F.col("b")})).collect()]
    assert got == pytest.approx(m.margin(x[:50]).tolist())
    assert boost.fit(("a",), np.zeros((0, 1)), np.zeros(0)).trees == []


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if c.isascii() else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule_of(host, path):
    fits = [(r, v) for r, v in urlfilter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return max(fits, key=lambda x: len(x[0])) if fits else (None, None)


def test_urls_by_rule_then_by_trees(spark):
    urls = [None, "", "nothing", "http://A.Example.COM/en/x?y=1#z", "https://www.example.com/en/", "http://x.net/es/1", "http://net/fr/", "http://evilnet/fr/", "http://example.com", "http://example.com?x=/en/", "a://b://c/d", "http://É.com/", "http://h.org/en/1?a=1&b=2"] * 3
    got = urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path = host_path(urls[r.page_id])
        rule, verdict = rule_of(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_unlabelled_urls_alone_are_allowed(spark):
    assert [r.verdict for r in urlfilter.judge(spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")).collect()] == ["allow"]


def test_fingerprints_follow_the_next_document(spark):
    r = random.Random(4)
    texts = [" ".join(r.choice("abcdefgh") * r.randrange(1, 4) for _ in range(r.randrange(80))) for _ in range(40)] + [None, "", "é😀x", "one"]
    ids = r.sample(range(-500, 500), len(texts))
    rows = sorted(zip(ids, texts, strict=True))
    got = {x.doc_id: x for x in fingerprint.fingerprints(spark.createDataFrame(rows, DOC).repartition(5)).collect()}
    for i, (d, t) in enumerate(rows):
        t, n = t or "", rows[(i + 1) % len(rows)][1] or ""
        cut = len(t) // 2
        assert got[d].n_chars == len(t)
        assert got[d].edited_sha256 == hashlib.sha256((t[: len(t) - cut] + n[:cut]).encode()).hexdigest()
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1


def test_steps_of_the_order_meet(spark):
    rows = [(5, "e"), (1, "a"), (1, None), (None, "z"), (9, "q"), (7, ""), (5, "f")]
    got = fingerprint.with_next(spark.createDataFrame(rows, DOC), ["text"], per_step=2).collect()
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    want = {(a, b[1]) for a, b in zip(order, order[1:] + order[:1], strict=True)}
    assert {((r.doc_id, r.text), r.next.text) for r in got} == want


def test_sketch_estimates_containment(spark):
    r = random.Random(5)
    long = [f"w{r.randrange(10**6)}" for _ in range(4000)]
    part = long[:2000]
    rows = spark.createDataFrame([(" ".join(long), " ".join(part))], "a string, b string").select(fingerprint.sketch(F.col("a")).alias("a"), fingerprint.sketch(F.col("b")).alias("b"))
    x = rows.select(fingerprint.contained(F.col("b"), F.col("a")).alias("b_in_a"), fingerprint.contained(F.col("a"), F.col("b")).alias("a_in_b")).first()
    assert x.b_in_a > 0.98 and x.a_in_b == pytest.approx(0.5, abs=0.08)


@pytest.mark.parametrize("unit", ["ab.", "a@", "1-", "a_", "1.", "+1", "token=abcdef ", "A1b2"])
def test_long_runs_are_scanned(spark, unit):
    """Runs of a megabyte end; shorter ones, which plain search can take, equal it."""
    never = [(boost.Boosted(pii.FEATURES, -1.0), float("inf"))] * 4
    texts = [unit * (n // len(unit)) for n in (3_000, 1_000_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), DOC)
    secrets, private = ({r.doc_id: r.base_sha256 for r in found.collect()} for found in (secretscan.scan(docs), pii.report(pii.detect(docs, never))))
    assert secrets[0] == sha(secrets_of(texts[0]), secretscan.KINDS) and private[0] == sha(private_of(texts[0]), pii.KINDS)
    assert set(secrets) == set(private) == {0, 1}


def test_sketches_of_parts_add_up(spark):
    r = random.Random(6)
    a, b = ([f"w{r.randrange(50)}" for _ in range(n)] for n in (7, 200))
    rows = spark.createDataFrame([(" ".join(a), " ".join(b), " ".join(a + b))], "a string, b string, ab string").select(*[fingerprint.sketch(F.col(c)).alias(c) for c in ("a", "b", "ab")])
    x = rows.first()
    assert set(x.a) | set(x.b) <= set(x.ab) and len(x.ab) <= len(set(x.a) | set(x.b)) + 4
