"""Fill-in-middle, token counts and spelling variants against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgraph.llm import fim, tokencount, variants

DOC = "doc_id long, text string"
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def plain_fim(doc_id, text):
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    d = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(d[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(tokens)
    a, b = sorted(x % (n + 1) for x in h[:2])
    pre, mid, suf = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_fim_equals_a_plain_version_and_texts_come_back(spark):
    r = random.Random(1)
    signs = ["abc", "Z", " ", "\n", "é", "😀", "<", "P", ">", "<P", "S>", "<M>", "1", "́", "ÿ"]
    texts = ["".join(r.choice(signs) for _ in range(r.randrange(40))) for _ in range(400)] + [None, "", "x", "<", "a" * 300_000, "é. " * 100_000, "same", "same"]
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOC).withColumn("fim", F.lit("clash")).withColumn("n", F.lit("kept"))
    got = Counter((x.doc_id, x.text, x.n, x.fim.n, x.fim.form, x.fim.prefix_chars, x.fim.middle_chars, x.fim.output, x.fim.output_sha256, x.fim.restored_sha256) for x in fim.transformed(docs).collect())
    want = Counter()
    for i, t in rows:
        n, form, a, m, output = plain_fim(i, t)
        want[(i, t, "kept", n, form, a, m, output, sha(output), sha(t or ""))] += 1
    assert got == want
    assert {x[4] for x in want} == {"plain", "spm", "psm"}
    assert fim.transformed(docs.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab<PSM>é\n", max_size=30), st.integers(0, 10_000))
def test_forms_are_undone(text, doc_id):
    _, form, _, _, output = fim.cut(text, doc_id, 1)
    assert fim.restored(output, form) == text


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


WORDY = tokencount.Tokenizer(public_tokenizers.path("word_bpe_49k.json"), parted=True)


@pytest.fixture(scope="module")
def parts():
    return tokencount.Parts(tokencount.encoder(".json", open(WORDY.path, "rb").read()))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \t\n\x0b\x0c\r\x1c\x1f\x85\xa0 '<|>endoftxWÍ̇̊Σς1.é한ᄒ"), st.characters(codec="utf-8")), max_size=60))
def test_parts_have_the_tokens_of_the_whole(whole, parts, text):
    spaced = re.sub(r"[\x20\x09-\x0D]+", " ", text).strip(" ")
    assert whole(text) == whole(spaced) == sum(map(parts.__getitem__, tokencount.words_of(text)))


TEXTS = [
    None, "", " ", "\t\n", "Hello  world", "hello world", " Hello\n\tworld ", "a <|endoftext|> b", "a<|ENDOFTEXT|>b <|startoftext|><|endoftext|>", "don't I'LL WE'VE", "W̊ x", "한국어 텍스트", "x" * 5_000, "lorem " * 20_000,
    "\xa0nbsp em\x85nel\x1cfs", "Hello world", "same", "same", "1234567890", "😀😀",
]


def test_token_counts_are_those_of_whole_texts(spark, tmp_path, whole):
    rows = [(i if i != 3 else None, t) for i, t in enumerate(TEXTS * 3)]
    docs = spark.createDataFrame(rows, DOC).repartition(5).withColumn("n_tokens", F.lit("clash")).withColumn("digest", F.lit("kept"))
    got = tokencount.counted(docs, WORDY, str(tmp_path / "cache"))
    want = Counter((i, t, len((t or "").encode()), whole(t), whole(t) > 2048, "kept") for i, t in rows)
    assert Counter((x.doc_id, x.text, x.n_bytes, x.n_tokens, x.over_limit, x.digest) for x in got.collect()) == want
    assert tokencount.counted(docs.limit(0), WORDY, str(tmp_path / "cache")).count() == 0


def cached(spark, folder):
    return spark.read.parquet(str(folder)).count()


def test_only_distinct_misses_are_encoded_and_appended(spark, tmp_path, monkeypatch):
    cache = tmp_path / "cache"
    first = spark.createDataFrame([(i, f"text number {i % 7}") for i in range(300)], DOC).repartition(6)
    tokencount.counted(first, WORDY, str(cache)).collect()
    assert cached(spark, cache) == 7
    second = spark.createDataFrame([(i, f"text  number\n{i % 9}") for i in range(90)], DOC).repartition(3)
    asked = []
    real = tokencount.encoded
    monkeypatch.setattr(tokencount, "encoded", lambda m, t: asked.append(m.select("digest").distinct().count()) or real(m, t))
    got = tokencount.counted(second, WORDY, str(cache)).collect()
    assert asked == [2] and cached(spark, cache) == 9 and all(x.n_tokens for x in got)
    tokencount.counted(second, WORDY, str(cache)).collect()
    assert asked == [2]  # all are known
    other = tokencount.Tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    tokencount.counted(second, other, str(cache)).collect()
    assert asked == [2, 9] and len(list(cache.iterdir())) == 2  # another version counts anew


def test_a_count_in_the_cache_is_taken_as_it_is(spark, tmp_path):
    cache = str(tmp_path / "cache")
    docs = spark.createDataFrame([(1, "one"), (2, "two words")], DOC)
    digest = lambda t: hashlib.sha256(t.encode()).digest()
    planted = spark.createDataFrame([(bytearray(digest("one")), 77), (bytearray(digest("one")), 77)], tokencount.COLUMNS)  # appended twice
    planted.write.parquet(f"{cache}/version={WORDY.version()}")
    assert {x.doc_id: x.n_tokens for x in tokencount.counted(docs, WORDY, cache).collect()} == {1: 77, 2: 2}


def test_sentencepiece_counts(spark, tmp_path):
    from sentencepiece import SentencePieceProcessor

    t = tokencount.Tokenizer(public_tokenizers.path("piece_bpe_32k.model"))
    pieces = SentencePieceProcessor(model_file=t.path)
    texts = ["", "a  b", "Grüße aus Köln", "😀", None, "x\ny"]
    got = {x.doc_id: x.n_tokens for x in tokencount.counted(spark.createDataFrame(list(enumerate(texts)), DOC), t, str(tmp_path / "c")).collect()}
    assert got == {i: len(pieces.encode(x or "")) for i, x in enumerate(texts)}
    with pytest.raises(ValueError):
        tokencount.Tokenizer("vocabulary.txt").version()


def near(a, b):
    """At distance one, by its definition."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def vocabulary_of(seed, letters, shortest, longest, size):
    r = random.Random(seed)
    words = {"".join(r.choice(letters) for _ in range(r.randint(shortest, longest))) for _ in range(size)}
    for w in sorted(words)[: size // 2]:  # and some of their neighbours
        i = r.randrange(len(w))
        words.add(w[:i] + r.choice(letters) + w[i:])
        words.add(w[:i] + r.choice(letters) + w[i + 1 :])
    return sorted(words)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abc", max_size=7), unique=True, max_size=40))
def test_trie_pairs_are_all_at_distance_one(words):
    words = sorted(words)
    got = list(variants.Trie(words).pairs())
    assert len(got) == len(set(got)) and all(j < i for i, j in got)
    assert {(i, j) for i, j in got} == {(i, j) for i in range(len(words)) for j in range(i) if near(words[i], words[j])}


@pytest.mark.parametrize(("most", "letters", "shortest"), [(4_000, "ab", 1), (5, "ab", 1), (3, "abcé", 7), (20, "aéÿ", 3)])
def test_pairs_of_split_cells_equal_all_pairs(spark, most, letters, shortest):
    words = vocabulary_of(most, letters, shortest, shortest + 3, 120)
    got = [(x.word, x.near) for x in variants.pairs(spark.createDataFrame([(w,) for w in words], "word string"), most).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(a, b) for a in words for b in words if near(a, b)}


def test_words_with_a_common_beginning_are_split_until_they_are_few(spark):
    """Half of the words share their first ten letters, and half their last ten."""
    r = random.Random(4)
    tails = {"".join(r.choice("abcdef") for _ in range(6)) for _ in range(150)}
    words = sorted({"q" * 10 + t for t in tails} | {t + "z" * 10 for t in tails})
    got = {(x.word, x.near) for x in variants.pairs(spark.createDataFrame([(w,) for w in words], "word string"), 10).collect()}
    assert got == {(a, b) for a in words for b in words if near(a, b)}


def plain_words(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def test_forms_and_roots_equal_a_plain_version(spark):
    r = random.Random(5)
    base = vocabulary_of(6, "aeiorstÉé", 7, 9, 60)
    rows = []
    for i in range(500):
        words = r.choices(base, weights=[1 / (1 + k % 40) ** 2 for k in range(len(base))], k=25)
        rows.append((i, r.choice([" ", "-", ", "]).join(w.upper() if r.random() < 0.1 else w for w in words)))
    chain = "abcdefgh"
    rows += [(None, f"{chain} " * 300), (1000, "abcdefghi " * 25), (1001, "abcdefghij abcdefghij"), (1002, None), (1003, ""), (1004, "x" * 100_000), (1004, "x" * 100_000), (1005, "short")]
    n = plain_words(rows)
    docs = spark.createDataFrame(rows, DOC).withColumn("word", F.lit("clash"))
    got = {x.word: x for x in variants.grouped(variants.vocabulary(docs)).collect()}
    assert {w: x.n for w, x in got.items()} == n
    by_length = {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    form = {}
    for w, x in got.items():
        close = [o for k in (-1, 0, 1) for o in by_length.get(len(w) + k, ()) if near(w, o)]
        assert x.n_near == len(close)
        best = min(close, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
        assert (x.form, x.form_n) == (form[w], n[best] if form[w] else None)
    for w, x in got.items():
        at = w
        while form[at]:
            at = form[at]
        assert x.root == at
    assert any(form.values()) and variants.grouped(variants.vocabulary(docs.limit(0))).count() == 0


def test_roots_of_long_chains(spark):
    words = [("word" + "x" * k, 12**k) for k in range(3, 12)]
    got = {x.word: x.root for x in variants.grouped(spark.createDataFrame(words, "word string, n long")).collect()}
    assert set(got.values()) == {words[-1][0]} and len(got) == len(words)
