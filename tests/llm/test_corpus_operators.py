"""Mixing, language, toxicity, dedup, decontamination and the pipeline against plain versions and planted cases."""

import hashlib
import pathlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillgraph.llm import components, decontam, langid, mixing, neardup, substring, toxicity
from quillgraph.llm.common import shared_folder

DOC = "doc_id long, text string"


def test_mix_meets_targets_with_whole_copies(spark):
    r = random.Random(1)
    rows = [(i, " ".join("x" for _ in range(r.choice([0, 1, 5, 40, 300, 900]))), r.choice(["b", "a", "c", None, "a", "a", "a"])) for i in range(600)]
    rows += [(601, None, "d"), (602, "same words", "a"), (602, "same words", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size, taken, target = Counter(), Counter(), {}
    for x in got:
        assert 0 <= x.copies <= 2 and x.taken == x.copies * x.size
        size[x.source] += x.size
        taken[x.source] += x.taken
        target[x.source] = x.target
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    free = [s for s in size if target[s] < 2 * size[s] - 1e-6]
    assert len({round(target[s] / weight[s], 6) for s in free}) <= 1
    assert all(target[s] <= 2 * size[s] + 1e-6 for s in size)
    for s in size:
        assert abs(taken[s] - target[s]) <= 0.02 * max(target[s], 100)
    again = mixing.mix(docs.repartition(3)).collect()
    assert Counter((x.doc_id, x.copies) for x in again) == Counter((x.doc_id, x.copies) for x in got)
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_steps_of_a_large_source_give_the_same_cut(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (i % 17), "s" if i % 3 else "t") for i in range(900)], "doc_id long, text string, source string")
    want = Counter()
    for per_step in (10_000, 50):
        monkeypatch.setattr(mixing, "PER_STEP", per_step)
        got = mixing.mix(docs).collect()
        sums = defaultdict(int)
        for x in got:
            sums[x.source] += x.taken
        want[tuple(sorted(sums.items()))] += 1
        for x in got:
            assert 0 <= x.target - sums[x.source] < 17
    assert sum(want.values()) == 2


def test_known_words_come_before_their_letters():
    m = langid.build({"en": {"the": 50, "house": 5}, "de": {"das": 50, "haus": 5}})
    lang = lambda t: langid.Scorer(m).judge([t])[0][0]
    assert [lang(t) for t in ("the house", "das Haus", "housing", "hauses", None, "", "123 !?")] == ["en", "de", "en", "de", "und", "und", "und"]
    assert langid.Scorer(langid.build({})).judge(["the"])[0] == ["und"]


def test_language_is_learned_from_text_alone(spark):
    r = random.Random(2)
    vocab = {"aa": ["lorem", "ipsum", "dolor"], "bb": ["quux", "zyzzy", "plugh"]}
    rows = [(i, " ".join(r.choice(vocab[k]) for _ in range(20)), k if i % 9 else None) for i in range(120) for k in [("aa", "bb")[i % 2]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = langid.predict(docs, langid.fit(docs.where("lang is not null"))).collect()
    assert all(x.lang_pred == ("aa", "bb")[x.doc_id % 2] and 0 <= x.score <= 1 for x in got)


def test_toxic_words_decide_and_long_texts_count_by_length(spark):
    r = random.Random(3)
    plain = [f"word{i}" for i in range(60)]

    def text(bad):
        w = [r.choice(plain) for _ in range(r.randrange(30, 200))]
        for _ in range(len(w) // 15 if bad else 0):
            w.insert(r.randrange(len(w)), r.choice(["vile", "scum"]))
        return " ".join(w)

    rows = [(i, text(i % 3 == 0)) for i in range(600)]
    docs = spark.createDataFrame([*rows, (9001, None), (9002, ""), (9003, "..."), (9004, "vile scum " * 40)], DOC)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert np.mean([got[i].predicted == (i % 3 == 0) for i in range(400, 600)]) > 0.95
    assert [got[i].predicted for i in (9001, 9002, 9003, 9004)] == [0, 0, 0, 1]
    assert all(0 <= x.score <= 1 for x in got.values())
    one_class = toxicity.fit(docs, labels.where("toxic = 0"))
    assert {x.predicted for x in toxicity.score(docs, one_class).collect()} == {0}


def removed(texts, n=35):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for w in words:
        gone = {k for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for k in range(i, i + n)}
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out)


def test_left_neighbours_are_counted_exactly(spark, monkeypatch):
    """A word with more left neighbours than any number of buckets that a sketch would have, in several flushes."""
    monkeypatch.setattr(toxicity, "PAIRS", 1_000, raising=False)
    texts = [" ".join(f"l{i * 50 + k} often" for k in range(50)) for i in range(200)] * 2 + ["rare often", "a rare", "b rare", None, "often"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    words = toxicity.Words({"often": 1, "rare": 2})
    want = [set(), set(), set()]
    for t in texts:
        for a, b in zip((t or "").split(), (t or "").split()[1:], strict=False):
            want[words[b]].add(a)
    assert toxicity.shared_backoff(docs, words).tolist() == [len(x) for x in want]


@pytest.mark.parametrize("frequent", [2000, 3])
def test_repeated_windows_are_removed_exactly(spark, monkeypatch, frequent):
    monkeypatch.setattr(substring, "FREQUENT", frequent)
    r = random.Random(4)
    base = [r.choice(["w%d" % i for i in range(6)]) for _ in range(400)]
    texts = [" ".join(base[r.randrange(200) :][: r.randrange(200)]) for _ in range(60)]
    texts += ["a " * 100, "b " * 35, "b " * 36, "c " * 34 + "d", None, "", "\u00a0 x", " ".join(base), " ".join(base)]
    docs = spark.createDataFrame([(i % 50, t) for i, t in enumerate(texts)], DOC).withColumn("n_words", F.lit(1)).repartition(6)
    got = substring.dedup(docs).select("n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got)) == removed(texts)
    assert substring.dedup(spark.createDataFrame([], DOC)).count() == 0


def near_groups(rows, size=2, least=80):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= least * len(a | sets[j]):
                root[top(i)] = top(j)
    first = {}
    for i, (d, _) in enumerate(rows):
        first[top(i)] = min(first.get(top(i), d), d)
    return sorted((d, len(sets[i]), first[top(i)], first[top(i)] == d) for i, (d, _) in enumerate(rows))


def near_rows(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    rows = []
    for copies in (3, 10, 40, 90, 25, 60):
        base = [r.choice(vocab) for _ in range(r.choice([8, 30, 60, 200]))]
        rows.append(base)
        for _ in range(copies):
            c = list(base)
            for _ in range(r.randrange(len(c) // 8 + 2)):
                c[r.randrange(len(c))] = r.choice(vocab)
            rows.append(c)
    rows += [[r.choice(vocab[:20]) for _ in range(r.randrange(9))] for _ in range(150)]
    r.shuffle(rows)
    return [*((i, " ".join(x)) for i, x in enumerate(rows)), (9001, None), (9002, ""), (9003, "Same Words here"), (9004, "same words HERE")]


@pytest.mark.parametrize(("seed", "size"), [(5, 2), (6, 5)])
def test_near_duplicates_equal_all_pairs(spark, seed, size):
    rows = near_rows(seed)
    docs = spark.createDataFrame(rows, DOC).withColumn("n", F.lit("clash")).repartition(5)
    assert sorted(map(tuple, neardup.groups(docs, size=size).collect())) == near_groups(rows, size)


def test_near_duplicates_without_ids_and_with_one_id(spark):
    words = [f"w{i}" for i in range(60)]
    near = " ".join([*words[:59], "other"])
    rows = [(5, " ".join(words)), (None, near), (None, "x y z"), (None, "x y z"), (7, "p q r"), (7, "s t u")]
    got = sorted(map(str, (tuple(r) for r in neardup.groups(spark.createDataFrame(rows, DOC)).collect())))
    assert got == sorted(map(str, [(5, 59, 5, True), (None, 59, 5, False), (None, 2, None, True), (None, 2, None, True), (7, 2, 7, True), (7, 2, 7, True)]))
    left = neardup.one_of_each(spark.createDataFrame([*rows, (7, "p q r")], DOC).withColumn("n", F.lit("clash")), size=2)
    assert left.columns == ["doc_id", "text", "n"]
    assert sorted(map(str, (tuple(r)[:2] for r in left.collect()))) == sorted(map(str, [(5, " ".join(words)), (None, "x y z"), (7, "p q r"), (7, "s t u")]))


def test_pairs_of_a_group_grow_with_its_size_alone(spark, monkeypatch):
    """2,500 copies of one text, each with two words of 60 replaced: all in one component, by some pairs each."""
    r = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(2_500):
        c = list(base)
        for _ in range(2):
            c[r.randrange(60)] = f"u{r.randrange(10**6)}"
        rows.append((i, " ".join(c)))
    looked_at = []
    plain = neardup.Linker.may_link
    monkeypatch.setattr(neardup.Linker, "may_link", lambda self, pairs: looked_at.append(pairs.count()) or plain(self, pairs))
    got = neardup.groups(spark.createDataFrame(rows, DOC)).collect()
    assert sum(looked_at) < 20 * len(rows)
    sample = {x.doc_id: x.component_id for x in got}
    sets = [{tuple(t.split()[i : i + 2]) for i in range(59)} for _, t in rows[:200]]
    for i in range(200):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                assert sample[i] == sample[j]


def test_few_pairs_of_unlike_sets_that_share_frequent_shingles(spark, monkeypatch):
    """200 texts of 12 words, no two of them alike, and five near copies of each of two: 22,000 pairs, of which few are looked at."""
    r = random.Random(12)
    rows = [[f"w{r.randrange(12)}" for _ in range(60)] for _ in range(200)]
    rows += [[*rows[k][:i], "other", *rows[k][i + 1 :]] for k in (0, 1) for i in range(7, 57, 10)]
    rows = [(i, " ".join(x)) for i, x in enumerate(rows)]
    left = []
    plain = neardup.Linker.few_by_few
    monkeypatch.setattr(neardup.Linker, "few_by_few", lambda self, pairs, *rest: left.append(pairs.count()) or plain(self, pairs, *rest))
    assert sorted(map(tuple, neardup.groups(spark.createDataFrame(rows, DOC)).collect())) == near_groups(rows)
    assert len(left) == 1 and left[0] < 100


def test_parity_vectors_differ_in_no_more_bits_than_sets_in_elements():
    r = np.random.default_rng(3)
    for n in (1, 5, 60, 700, 30_000):
        s = np.unique(r.integers(0, 1 << 64, n, np.uint64))
        for gone in (0, 1, n // 9, n // 2):
            t = np.unique(np.concatenate([s[gone:], r.integers(0, 1 << 64, gone, np.uint64)]))
            x, y = neardup.parity(s), neardup.parity(t)
            found, words = neardup.apart_by_parity(x, y), neardup.FOLD // 64
            assert len(np.setxor1d(s, t)) >= found >= np.bitwise_count(neardup.folded(x, words) ^ neardup.folded(y, words)).sum()
            assert (gone == 0) == (found == 0)


def test_values_are_counted_where_they_meet_and_frequent_ones_before(spark):
    posts = spark.range(40_000).select("id", F.expr("if(id % 3 = 0, 7, if(id % 3 = 1, id div 30, -id))").alias("value"))
    want = posts.join(posts.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "value")
    got = neardup.spread(posts)
    assert sorted(map(tuple, got.select("id", "value", "df").collect())) == sorted(map(tuple, want.select("id", "value", "df").collect()))


def test_near_duplicates_leave_their_result_alone_on_disk(spark):
    there = lambda: {p.name for p in pathlib.Path(shared_folder(spark).removeprefix("file:")).glob("settled-*")}
    before = there()
    rows = near_rows(8)
    found = neardup.groups(spark.createDataFrame(rows, DOC))
    assert len(there() - before) == 1
    assert sorted(map(tuple, found.collect())) == near_groups(rows)


def test_near_duplicates_of_nothing(spark):
    assert neardup.groups(spark.createDataFrame([], DOC)).count() == 0
    assert [tuple(r) for r in neardup.groups(spark.createDataFrame([(7, None)], DOC)).collect()] == [(7, 0, 7, True)]


@pytest.mark.parametrize("few", [0, 10**6])
def test_components_of_paths_stars_and_pairs(spark, few):
    edges = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 130)] + [(200, 201), (201, 200), (5, 5)]
    got = {r.v: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long"), few).collect()}
    assert got == {**{i: 0 for i in range(21)}, **{i: 100 for i in range(100, 130)}, 200: 200, 201: 200}


def test_benchmark_passages_are_found_and_others_are_not(spark):
    r = random.Random(6)
    common = ["the", "of", "and", "to", "in"]
    word = lambda: r.choice(common) if r.random() < 0.4 else f"v{r.randrange(4000)}"
    items = [(i, " ".join(word() for _ in range(r.randrange(16, 60)))) for i in range(30)]
    items += [(98, None), (99, ""), (97, "v1 v2 v3")]
    rows = []
    for i in range(120):
        w = [word() for _ in range(r.randrange(60, 200))]
        if i % 4 == 0:
            passage = items[i // 4][1].upper().split()
            if i % 8 == 0:
                passage = [f"u{k}" if r.random() < 0.12 else x for k, x in enumerate(passage)]
            w[30:30] = [f"{x}," for x in passage]
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame([*rows, (500, None), (501, ""), (502, "say V1, v2 v3!"), (503, "v1 v3 v2")], DOC).withColumn("hits", F.lit(0))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: [h.item_id for h in x.hits] for x in decontam.find(docs, bench).collect()}
    want = {i: [i // 4] if i % 4 == 0 else [] for i in range(120)} | {500: [], 501: [], 502: [97], 503: []}
    missed = [i for i in want if not set(want[i]) <= set(got[i])]
    assert len(missed) <= 3 and not [i for i in missed if i % 8] and not [i for i in want if set(got[i]) - set(want[i])]
    assert {len(x.hits) for x in decontam.find(docs, bench.limit(0)).collect()} == {0}


def lcs(a, b):
    t = [0] * (len(b) + 1)
    for x in a:
        p = 0
        for j, y in enumerate(b):
            p, t[j + 1] = t[j + 1], p + 1 if x == y else max(t[j + 1], t[j])
    return t[-1]


def test_subsequence_by_bits_equals_the_table():
    r = random.Random(7)
    for _ in range(60):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(70))] for _ in range(2))
        assert decontam.common(a, b) == lcs(a, b)


def test_candidate_search_recalls_what_all_comparisons_find(spark, sf):
    """Of the passages that every document really has, word for word, the index gives all to the check."""
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    items = {r.item_id: " ".join(decontam.tokens(r.text)) for r in bench.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items.items() if t and f" {t} " in f" {' '.join(decontam.tokens(r.text))} "}
    got = {(r.doc_id, h.item_id) for r in decontam.find(docs, bench).collect() for h in r.hits}
    assert len(want & got) >= 0.9 * len(want)


def edited(r, words, every):
    """words with one of every so many replaced."""
    return [f"u{r.randrange(10**6)}" if k % every == every - 1 else w for k, w in enumerate(words)]


def test_leaks_are_found_where_passages_outnumber_the_space(spark, monkeypatch):
    """Verbatim copies, and copies with a word in six replaced, of which no eight words stand in a row."""
    monkeypatch.setattr(decontam, "RANK", 24)
    r = random.Random(16)
    common = ["the", "of", "and", "to", "in"]
    word = lambda: r.choice(common) if r.random() < 0.4 else f"v{r.randrange(4000)}"
    items = [(i, [word() for _ in range(r.choice([23, 31, 46, 64]))]) for i in range(400)]
    rows = []
    for i in range(0, 400, 4):
        w = [word() for _ in range(150)]
        w[61:61] = items[i][1] if i % 8 else edited(r, items[i][1], 6)
        rows.append((i, " ".join(w)))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {x.doc_id: [h.item_id for h in x.hits] for x in decontam.find(spark.createDataFrame(rows, DOC), bench).collect()}
    assert [i for i in got if i % 8 and i not in got[i]] == []
    assert len([i for i in got if i not in got[i]]) <= 5 and not [i for i in got if set(got[i]) - {i}]


def test_leaks_are_found_whatever_the_number_of_documents(spark, monkeypatch):
    """Edited copies of 23 to 31 words among words that no item has; document frequencies as of 3,000,000 documents."""
    r = random.Random(17)
    items = [(i, [f"v{r.randrange(300)}" for _ in range(r.randrange(23, 32))]) for i in range(40)]
    rows = []
    for i, passage in items:
        w = [f"x{r.randrange(10**6)}" for _ in range(150)]
        w[61:61] = edited(r, passage, 6)
        rows.append((i, " ".join(w)))
    plain = decontam.document_frequencies
    monkeypatch.setattr(decontam, "document_frequencies", lambda docs, words: (plain(docs, words)[0] * 75_000, 3_000_000))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {x.doc_id: [h.item_id for h in x.hits] for x in decontam.find(spark.createDataFrame(rows, DOC), bench).collect()}
    assert got == {i: [i] for i, _ in items}


def test_language_models_count_every_document(spark):
    rows = spark.range(6000).select(F.expr("concat('word', chr(97 + id % 7), chr(97 + id % 11), ' the')").alias("text"), F.expr("if(id % 2 = 0, 'en', 'de')").alias("lang"), F.col("id").alias("doc_id"))
    counts = {"en": Counter(), "de": Counter()}
    for x in rows.collect():
        counts[x.lang].update(x.text.split())
    got, want = langid.fit(rows), langid.build(counts)
    assert got.words == want.words and np.allclose(got.scores, want.scores)


def test_near_duplicates_pass_few_rows_at_once_to_python(spark, monkeypatch):
    plain = neardup.sketching

    def checked(size):
        run = plain(size)

        def few(b):
            assert b.num_rows <= 1000
            return b

        return lambda batches: run(map(few, batches))

    monkeypatch.setattr(neardup, "sketching", checked)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("concat('w', id, ' x y')").alias("text")).coalesce(1)
    assert neardup.groups(docs).where("kept").count() == 3000 and spark.conf.get(key) == before


def test_space_is_of_the_whole_benchmark_and_words_are_split_as_by_the_pattern(spark, sf):
    """Whatever the ids of documents, as no sample of these is drawn by them."""
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").limit(300)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    x, y = (decontam.build(docs.withColumn("doc_id", F.col("doc_id") + k), bench).units for k in (0, 7))
    assert np.abs(x @ x.T - y @ y.T).max() < 1e-3
    for t in ("".join(map(chr, range(1, 256))) * 2, "\u00c9T\u00c9 \u00b5_1 \u00aa\u00b2\u00bd\u00a0x\x1cy\x85z", "\u0130 \u03a3\u03a3 Stra\u00dfe\u2019s", *[r.text for r in docs.limit(200).collect() if r.text]):
        assert decontam.tokens(t) == decontam.WORDS.findall(t.lower())


def test_pipeline_stages_keep_clean_documents(spark, tmp_path, sf):
    r = random.Random(8)
    bench = {x.item_id: x.text for x in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    clean = [(i, " ".join(f"word{r.randrange(5000)}" for _ in range(80)), "en", "s1", 1) for i in range(40)]
    rows = clean + [(100, clean[0][1], "en", "s2", 1), (101, clean[1][1] + " more", "en", None, 1), (102, clean[2][1][:100] + " " + bench[0] + " end", "en", "s1", 1), (103, "write to a.b@example.com " + clean[3][1][::-1], "en", "s1", 1), (104, "123 456", None, "s1", 1), (105, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = steps[name] = spark.read.parquet(str(tmp_path / name))
    ids = {n: {x.doc_id for x in d.collect()} for n, d in steps.items()}
    assert ids["language"] == {*range(40), 100, 101, 102, 103}
    assert ids["near_duplicates"] == {*range(40), 102, 103}
    assert ids["benchmark_free"] == ids["private"] == ids["mixed"] == {*range(40), 103}
    texts = {x.doc_id: x.text for x in steps["private"].collect()}
    assert texts[103].startswith("write to <EMAIL> ") and all(texts[i] == clean[i][1] for i in range(40))
    assert all(d.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] for d in steps.values())
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, steps["language"].limit(0), sf).count() == 0, name


def test_run_mixes_what_the_stages_keep(spark, sf):
    assert set(corpus_pipeline.run(spark, sf).columns) >= {"doc_id", "text", "lang", "source", "size", "copies", "taken"}


def test_texts_searched_together_are_found_as_alone_and_the_space_is_that_of_the_svd(spark, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").limit(12)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    index = decontam.build(docs, bench)
    items = [" ".join(r.text.split()[:60]) for r in bench.collect()]
    texts = [None, "", "one two", *[r.text for r in docs.orderBy("doc_id").limit(40).collect()], *items, "lead in " * 30 + items[0] + " way out" * 30]
    together = list(index.search_all(texts))
    assert together == [index.search(t) for t in texts] and sum(map(bool, together)) > 5

    words = {w: i + 1 for i, w in enumerate(sorted({w for t in items for w in decontam.tokens(t)}))}
    idf, rank = np.ones(len(words) + 1), 3
    rows = np.zeros((len(items), len(idf)))
    for row, t in zip(rows, items, strict=True):
        for at, x in decontam.rows_of([t], words, idf):
            np.add.at(row, at, x)
    # three directions that stand out, so that one pass finds them
    weights = [30.0, 20.0, 10.0] + [0.01] * (len(items) - 3)
    matrix = spark.createDataFrame(list(zip(items, weights, strict=True)), "text string, weight double")
    got = decontam.basis(spark, matrix, words, idf, rank)
    want = np.linalg.svd(rows * np.array(weights)[:, None])[2][:rank]
    assert np.abs(np.sum(got.T * want, axis=1)) == pytest.approx(np.ones(rank), abs=1e-3)
