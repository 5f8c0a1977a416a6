"""The stored index against row-by-row cover density, chunk-level search, and closures of deep trees."""

import random

from pyspark.sql import functions as F

from quillgraph.functions import fts
from quillgraph.operators import lexical as lx
from quillgraph.operators import predicates

BLOCK = "page_id long, block_index int, text string"
WORDS = "the database databases tuning tuned of Tuning's planner plans rows row scanning and it's naïve 42 x".split()


def made_blocks(seed, n):
    r = random.Random(seed)
    return [(i // 3, i % 3, r.choice([" ", ", ", "\n"]).join(r.choice(WORDS) for _ in range(r.randrange(25)))) for i in range(n)] + [(900, 0, None), (901, 0, ""), (902, 0, "the of and")]


def test_index_and_densities_equal_those_of_whole_texts(spark, tmp_path):
    rows = made_blocks(1, 300)
    folder = str(tmp_path / "index")
    lx.store(spark.createDataFrame(rows, BLOCK).repartition(3), folder)
    held = {}
    for p, b, t in rows:
        for w, i in fts.lexemes(t):
            held.setdefault((w, p, b), []).append(i)
    assert {(x.lexeme, x.page_id, x.block_index): x.places for x in spark.read.schema(lx.POSTINGS).parquet(folder).collect()} == held
    for q in ("tuned databases", "the plan of rows scanning", "row", "of the", "", "absent row", "databases database", "tune plan row scan"):
        lexemes = lx.query_lexemes(q)
        got = {(x.page_id, x.block_index): x.density for x in lx.matched(lx.lookup(spark, folder, lexemes), lexemes).collect()}
        want = {(p, b): round(d, 9) for p, b, t in rows if (d := fts.cover_density(t, lexemes)) is not None}
        assert got == want and bool(want) == (q not in ("of the", "", "absent row")), q


def test_lookup_reads_the_buckets_of_its_lexemes_alone(spark, tmp_path):
    folder = str(tmp_path / "index")
    lx.store(spark.createDataFrame(made_blocks(2, 90), BLOCK), folder)
    found = lx.lookup(spark, folder, ["row"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "PushedFilters: [" in plan and "lexeme" in plan.split("PushedFilters: [")[1]


PAGE = "page_id long, ws string, title string, archived boolean"


def unit(angle):
    import math

    return [math.cos(angle), math.sin(angle)]


def setting(spark):
    pages = spark.createDataFrame([(1, "w", "source", False), (2, "w", "two chunks", False), (3, "w", "shares", False), (4, "w", "gone", True), (5, "v", "foreign", False), (6, "w", "far", False), (7, "w", "no vector", False)], PAGE)
    chunks = spark.createDataFrame([(1, 0, "none"), (1, 1, "s"), (2, 0, "b"), (2, 1, "a"), (3, 0, "a"), (4, 0, "a"), (5, 0, "a"), (6, 0, "z"), (7, 0, "none")], "page_id long, chunk_index int, hash string")
    vectors = spark.createDataFrame([("s", unit(0.0)), ("a", unit(0.1)), ("b", unit(0.4)), ("z", unit(2.5))], "hash string, embedding array<double>")
    texts = spark.createDataFrame([(h, f"text {h}") for h in ("s", "a", "b", "z", "none")], "hash string, text string")
    return pages, chunks, vectors, texts


def test_related_pages_by_their_nearest_chunk(spark):
    pages, chunks, vectors, texts = setting(spark)
    got = lx.related(pages, chunks, vectors, texts, 1).collect()
    assert [(r.page_id, r.snippet) for r in got] == [(2, "text a"), (3, "text a")]  # its first chunk with a vector; a page once
    assert [r.page_id for r in lx.related(pages, chunks, vectors, texts, 1, limit=1).collect()] == [2]
    assert lx.related(pages, chunks, vectors, texts, 7).count() == 0 and lx.related(pages, chunks, vectors, texts, 99).count() == 0


def test_many_chunks_of_one_page_leave_room_for_others(spark):
    pages = spark.createDataFrame([(i, "w", f"t{i}", False) for i in range(1, 4)], PAGE)
    chunks = spark.createDataFrame([(1, 0, "s")] + [(2, i, f"near{i}") for i in range(4)] + [(3, 0, "other")], "page_id long, chunk_index int, hash string")
    vectors = spark.createDataFrame([("s", unit(0.0))] + [(f"near{i}", unit(0.01 * (i + 1))) for i in range(4)] + [("other", unit(0.2))], "hash string, embedding array<double>")
    got = lx.related(pages, chunks, vectors, vectors.select("hash", F.col("hash").alias("text")), 1, limit=2).collect()
    assert [(r.page_id, r.snippet) for r in got] == [(2, "near0"), (3, "other")]


def test_both_arms_fuse_and_carry_the_best_snippet(spark, tmp_path):
    pages, chunks, vectors, texts = setting(spark)
    blocks = spark.createDataFrame([(2, 0, "slow query"), (2, 1, "query by query, slow"), (3, 0, "unrelated"), (4, 0, "slow query"), (6, 0, "a slow and winding query"), (1, 0, "query")], BLOCK)
    lx.store(blocks, str(tmp_path / "i"))
    lexemes = lx.query_lexemes("the slow queries")
    found = lx.lookup(spark, str(tmp_path / "i"), lexemes)
    got = lx.hybrid(pages, blocks, found, lexemes, vectors, chunks, texts, unit(0.05), None, 0.45).collect()
    top = {r.page_id: (r.snippet, r.lexical, r.score) for r in got}
    assert top[2] == ("slow query", True, round(1 / 61 + 1 / 62 + 1 / 62, 6))
    assert top[6][:2] == ("a slow and winding query", True) and top[3][:2] == ("text a", False) and top[1][:2] == ("text s", False) and 4 not in top
    only = lx.hybrid(pages, blocks, found, lexemes, vectors, chunks, texts, unit(0.05), spark.createDataFrame([(6,)], "page_id long"), 0.45).collect()
    assert [r.page_id for r in only] == [6]
    assert lx.hybrid(pages, blocks, lx.lookup(spark, str(tmp_path / "i"), []), [], vectors, chunks, texts, unit(-1.5), None, 0.1).count() == 0  # nothing is near, and no word


TREE = "page_id long, parent_id long, archived boolean"
ACL = "page_id long, access string"


def test_a_deep_chain_loses_no_page_and_takes_few_rounds(spark, monkeypatch):
    rounds = []
    real = predicates.written
    monkeypatch.setattr(predicates, "written", lambda df: rounds.append(1) or real(df))
    tree = spark.createDataFrame([(i, i - 1 if i else None, i == 900) for i in range(1000)], TREE)
    got = {r.page_id: r.access for r in predicates.readable(tree, spark.createDataFrame([(500, "none"), (700, "write")], ACL)).collect()}
    assert got == {i: "read" if i < 500 else "write" for i in range(1000) if i < 500 or i >= 700} and len(rounds) <= 7
    assert sorted(r.page_id for r in predicates.subtree(tree, 300).collect()) == list(range(300, 900))
    assert predicates.subtree(tree, 900).count() == 0 and predicates.subtree(tree, 12345).count() == 0


def test_closures_of_random_trees_equal_a_walk(spark):
    r = random.Random(3)
    parent = {i: r.choice([None, *range(max(0, i - 4), i)]) if i else None for i in range(150)} | {200: 201, 201: 200, 202: 200, 203: 999, 204: 204}
    acl = {i: r.choice(["none", "read", "write"]) for i in r.sample(range(150), 40)} | {202: "write"}

    def access(i):
        seen = set()
        while True:
            if i in acl:
                return acl[i]
            if i in seen or i not in parent:
                return None
            seen.add(i)
            if parent[i] is None:
                return "read"
            i = parent[i]

    tree = spark.createDataFrame([(i, p, False) for i, p in parent.items()], TREE)
    got = {x.page_id: x.access for x in predicates.readable(tree, spark.createDataFrame(list(acl.items()), ACL)).collect()}
    assert got == {i: a for i in parent if (a := access(i)) not in (None, "none")}
    assert predicates.readable(tree.limit(0), spark.createDataFrame([], ACL)).count() == 0


def test_index_is_built_without_a_shuffle(spark):
    plan = lx.postings(spark.createDataFrame(made_blocks(3, 30), BLOCK))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan and "Join" not in plan


def test_stems_stay_after_more_words_than_a_task_keeps(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(lx, "ROWS", 2)
    monkeypatch.setattr(lx, "WORDS", 1)
    b = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array([0, 0, 0, 0], pa.int32()), pa.array([["plans", "the", "plan"], None, [], ["the", "rows", "plan", "row"]], pa.list_(pa.string()))], ["page_id", "block_index", "words"])
    got = [r for out in lx.placed(iter([b])) for r in out.to_pylist()]
    assert sorted((r["lexeme"], r["page_id"], r["places"]) for r in got) == [("plan", 1, [1, 3]), ("plan", 4, [3]), ("row", 4, [2, 4])]


def test_postings_of_some_lexemes_are_those_of_the_index(spark, tmp_path):
    blocks = spark.createDataFrame(made_blocks(2, 90), BLOCK)
    lx.store(blocks, str(tmp_path / "i"))
    rows = lambda df: sorted((r.lexeme, r.page_id, r.block_index, tuple(r.places)) for r in df.collect())
    assert rows(lx.postings(blocks, ["row", "nothing"])) == rows(lx.lookup(spark, str(tmp_path / "i"), ["row", "nothing"])) != []


def test_local_answer_joins_all_texts_once(spark, sf, monkeypatch):
    from quillgraph import catalogue

    calls, plain = [], catalogue.t.pages
    monkeypatch.setattr(catalogue.t, "pages", lambda *a: calls.append(a) or plain(*a))
    assert catalogue.local_answer(spark, sf).count() == 1 and len(calls) == 1
