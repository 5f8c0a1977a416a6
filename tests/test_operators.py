import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import collections as co
from quillgraph.operators import communities as cm
from quillgraph.operators import graph as gr
from quillgraph.operators import ingest, queues, search
from quillgraph.operators.predicates import readable, subtree
from quillgraph.streaming import log

PAGE = "page_id long, ws string, parent_id long, title string, text string, hash string, archived boolean, updated_at long"


def page(i, ws="w", parent=None, text="", archived=False):
    return (i, ws, parent, f"t{i}", text, f"h{text}", archived, i)


def ids(df, col="page_id"):
    return sorted(r[col] for r in df.collect())


def test_nearest_override_wins_on_the_way_down(spark):
    tree = spark.createDataFrame([page(1), page(2, parent=1), page(3, parent=2), page(4, parent=3), page(5, parent=1)], PAGE)
    denied = spark.createDataFrame([(2, "none")], "page_id long, access string")
    assert ids(readable(tree, denied)) == [1, 5]
    granted = spark.createDataFrame([(2, "none"), (3, "read")], "page_id long, access string")
    assert ids(readable(tree, granted)) == [1, 3, 4, 5]


def test_shared_subtree_goes_down_only_and_stops_at_archived_pages(spark):
    tree = spark.createDataFrame([page(1), page(2, parent=1), page(3, parent=2, archived=True), page(4, parent=3), page(5)], PAGE)
    assert ids(subtree(tree, 2)) == [2]
    assert ids(subtree(tree, 1)) == [1, 2]


def test_shared_chunk_of_an_archived_page_leaves_the_other_tenants_edges(spark):
    p = spark.createDataFrame([page(1, "a", text="Ann Bob", archived=True), page(2, "b", text="Ann Bob")], PAGE)
    e = gr.edges(p)
    assert [r.ws for r in gr.dead_edges(e, p).collect()] == ["a"]
    assert [r.ws for r in gr.clusterable(e, p).collect()] == ["b"]


def test_one_tenants_marker_does_not_empty_the_others_queue(spark):
    p = spark.createDataFrame([page(1, "a", text="x"), page(2, "b", text="x")], PAGE)
    done = p.where("ws = 'a'").select("hash", "ws")
    assert [r.ws for r in queues.pending_extraction(p, done).collect()] == ["b"]
    assert tuple(queues.extraction_progress(p, done).first()) == (1, 2)


def test_pairs_count_both_directions_once(spark):
    e = spark.createDataFrame([("w", a, b, h, 1.0) for a, b, h in [("x", "y", "1"), ("y", "x", "2"), ("x", "y", "3"), ("y", "z", "1"), ("z", "y", "2")]], "ws string, source string, target string, hash string, weight double")
    assert {(r.a, r.b): r.weight for r in gr.pair_weights(e).collect()} == {("x", "y"): 3.0, ("y", "z"): 2.0}
    assert {r.name: r.neighbour for r in gr.strongest_neighbour(gr.neighbour_weights(e)).collect()} == {"x": "y", "y": "x", "z": "y"}


def paths(edges, seeds):
    """All paths of two hops at most; the best score of each chunk."""
    both = [(a, b, h, w) for a, b, h, w in edges] + [(b, a, h, w) for a, b, h, w in edges]
    start = {}
    for a, b, h, _ in edges:
        if h in seeds:
            for x in (a, b):
                start[x] = min(start.get(x, 99), seeds[h])
    best = {h: (1 / (60 + r), 0) for h, r in seeds.items()}
    level = [(x, r, 1.0) for x, r in start.items()]
    for hop in (1, 2):
        new = []
        for x, r, width in level:
            for a, b, h, w in both:
                if a == x:
                    k = min(width, w)
                    new.append((b, r, k))
                    best[h] = max(best.get(h, (0, 0)), (1 / (60 + r) * 0.5**hop * k, -hop))
        level = new
    return {h: round(s, 9) for h, (s, _) in best.items()}


@pytest.mark.parametrize("seed", range(3))
def test_walk_equals_all_paths(spark, seed):
    r = random.Random(seed)
    edges = [(f"n{r.randrange(8)}", f"n{r.randrange(8)}", f"h{r.randrange(12)}", r.choice([0.1, 0.6, 1.0, 2.0])) for _ in range(16)]
    seeds = {"h0": 1, "h1": 3}
    e = spark.createDataFrame([("w", *x) for x in edges], "ws string, source string, target string, hash string, weight double")
    s = spark.createDataFrame([("w", h, k) for h, k in seeds.items()], "ws string, hash string, rank int")
    assert {x.hash: round(x.score, 9) for x in gr.walk(e, s).collect()} == paths(edges, seeds)


def test_walk_has_no_nested_loop(spark):
    e = spark.createDataFrame([("w", "a", "b", "h", 1.0)], "ws string, source string, target string, hash string, weight double")
    plan = gr.walk(e, e.select("ws", "hash", F.lit(1).alias("rank")))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_graph_hits_keep_a_third_of_the_slots(spark):
    hits = spark.createDataFrame([(i, "h", 0 if i < 10 else 1, 1.0 / (i + 1)) for i in range(14)], "page_id long, hash string, hops int, score double")
    assert ids(gr.with_reserved_slots(hits, 6)) == [0, 1, 2, 3, 10, 11]
    assert ids(gr.with_reserved_slots(hits.limit(3), 6)) == [0, 1, 2]


def test_lexical_match_outranks_and_blocks_add_up(spark):
    lex = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "page_id long, rank int")
    vec = spark.createDataFrame([(3, 1), (2, 2)], "page_id long, rank int")
    got = search.fused(lex, vec).collect()
    assert [r.page_id for r in got] == [1, 2, 3] and got[0].score == round(1 / 61 + 1 / 62, 6)


ROWS = [(1, "Ship auth", "done", 5.0, ["backend", "security"]), (2, "Table view", "doing", 3.0, ["backend"]), (3, "Write docs", "todo", 1.0, ["docs"]), (4, "No status", None, 10.0, [])]
KINDS = {"title": "text", "status": "select", "points": "number", "tags": "multi_select"}


@pytest.mark.parametrize(
    ("f", "want"),
    [
        (("status", "eq", "done"), [1]), (("status", "neq", "done"), [2, 3, 4]), (("points", "gt", 2), [1, 2, 4]), (("points", "lt", 2), [3]), (("tags", "contains", ["security"]), [1]), (("tags", "contains", "backend"), [1, 2]),
        (("title", "contains", "DOCS"), [3]), (("status", "is_empty"), [4]), (("status", "is_not_empty"), [1, 2, 3]), (("points", "gt", 9), [4]),
    ],
)
def test_view_filters(spark, f, want):
    rows = spark.createDataFrame(ROWS, "page_id long, title string, status string, points double, tags array<string>")
    assert ids(co.view(rows, KINDS, [co.Filter(*f)])) == want


def test_unknown_properties_and_operations_are_errors(spark):
    for f in (co.Filter("nope", "eq", 1), co.Filter("points", "like", 1)):
        with pytest.raises(co.ViewError):
            co.predicate(f, KINDS)


def test_sorts_put_unset_last_both_ways(spark):
    rows = spark.createDataFrame(ROWS, "page_id long, title string, status string, points double, tags array<string>")
    assert [r.page_id for r in co.view(rows, KINDS, sorts=[("status", False)]).collect()] == [2, 1, 3, 4]
    assert [r.page_id for r in co.view(rows, KINDS, sorts=[("status", True)]).collect()] == [3, 1, 2, 4]


def test_board_keeps_declared_order_empty_groups_and_stale_values(spark):
    rows = spark.createDataFrame([("done",), ("gone",), (None,)], "status string")
    got = [(r.value, r.n) for r in co.board(rows, "status", ["todo", "done"]).orderBy("place").collect()]
    assert got == [("todo", 0), ("done", 1), ("gone", 1), (None, 1)]
    assert [(r.value, r.n) for r in co.board(rows.limit(1), "status", ["done"]).orderBy("place").collect()] == [("done", 1), (None, 0)]


def test_rollup_rules_for_empty_relations_and_values(spark):
    parents = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    rows = spark.createDataFrame([(1, 1.0, 1), (1, 5.0, 2), (1, 3.0, 3), (2, None, 1)], "k long, v double, at int")
    got = {r.k: tuple(r)[1:] for r in co.rollup(parents, rows, "k", "v", ["at"]).collect()}
    assert got[1] == (3, 9.0, 1.0, 5.0, 3.0) and got[2] == (1, 0.0, None, None, None) and got[3] == (0, None, None, None, None)


@pytest.mark.parametrize(("kind", "value", "want"), [("number", "1.5", True), ("number", "true", False), ("checkbox", "true", True), ("date", '"2026-01-02"', True), ("date", '"soon"', False), ("multi_select", '["a"]', True), ("multi_select", '"a"', False), ("text", "null", True)])
def test_values_are_validated_by_kind(kind, value, want):
    assert co.validated(kind, value) is want


def test_only_selects_and_relations_become_edges(spark):
    rows = spark.createDataFrame([("P", "My Status", "select", ["done"]), ("P", "Tags", "multi_select", ["a", "b"]), ("P", "Due", "date", ["2026"])], "title string, property string, kind string, values array<string>")
    assert sorted((r.target, r.relation) for r in co.property_edges(rows).collect()) == [("a", "tags"), ("b", "tags"), ("done", "my_status")]


def partition_of(n, edges):
    got = cm.louvain(n, edges)
    return sorted(sorted(i for i in range(n) if got[i] == c) for c in set(got))


def test_tied_cliques_stay_apart():
    four = [(a, b, 1.0) for s in (0, 4) for a in range(s, s + 4) for b in range(a + 1, s + 4)]
    assert partition_of(9, [*four, (0, 8, 1.0), (4, 8, 1.0)]) == [[0, 1, 2, 3, 8], [4, 5, 6, 7]]


@pytest.mark.parametrize(("n", "edges", "want"), [(0, [], []), (5, [], [[0], [1], [2], [3], [4]]), (2, [(0, 1, 1.0)], [[0, 1]])])
def test_degenerate_graphs(n, edges, want):
    assert partition_of(n, edges) == want


def test_order_of_edges_does_not_change_the_partition():
    r = random.Random(1)
    edges = [(a, b, 1.0) for a in range(20) for b in range(a) if r.random() < (0.7 if a // 5 == b // 5 else 0.05)]
    want = cm.louvain(20, sorted(edges))
    for _ in range(5):
        r.shuffle(edges)
        assert cm.louvain(20, edges) == want


def test_partition_by_workspace_has_the_modularity_it_claims(spark):
    pairs = spark.createDataFrame([("w", a, b, 1.0) for a, b in ["ab", "bc", "ac", "de", "ef", "df", "cd"]], "ws string, a string, b string, weight double")
    members = cm.partition(pairs)
    assert len({r.community for r in members.collect()}) == 2
    assert cm.modularity(pairs, members).first()["q"] == pytest.approx(6 / 7 - 2 * (7 / 14) ** 2, abs=1e-6)


def test_surviving_communities_keep_their_summaries(spark):
    old = spark.createDataFrame([("w", "same", "text"), ("w", "gone", "text")], "ws string, member_hash string, summary string")
    new = spark.createDataFrame([("w", "same"), ("w", "new")], "ws string, member_hash string")
    assert {r.member_hash: r.summary for r in cm.swapped(old, new).collect()} == {"same": "text", "new": None}


def test_reassignment_is_sequential():
    near = {"a": [("b", 2.0)], "b": [("c", 5.0), ("a", 1.0)]}
    assert cm.reassigned(["a", "b"], near, {"a": 0, "b": 1, "c": 2}) == {"a": 1, "b": 2, "c": 2}
    assert cm.reassigned(["b", "a"], near, {"a": 0, "b": 1, "c": 2}) == {"a": 2, "b": 2, "c": 2}


def test_chunks_merge_forward_split_long_and_keep_the_end():
    assert len(ingest.chunks_of(["Title", "word " * 100])) == 1
    assert len(ingest.chunks_of(["word " * 100, "short tail"])) == 2
    long = ingest.chunks_of([" ".join("word " * 400 + "end." for _ in range(3))])
    assert len(long) > 1 and all(ingest.tokens_in(c) <= 533 for c in long)
    assert all(ingest.tokens_in(c) <= 512 for c in ingest.chunks_of(["漢" * 3000]))
    assert ingest.chunks_of(["", "  "]) == []


def test_html_blocks_join_inline_text_and_skip_scripts(spark):
    html = "<html><head><title>x</title></head><body><h1>A <b>bold</b> title</h1><ul><li>one</li><li>two</li></ul><script>no</script><p></p></body></html>"
    got = ingest.html_blocks(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).orderBy("block_index").collect()
    assert [(r.kind, r.text) for r in got] == [("h1", "A bold title"), ("ul", "one\ntwo")]


def test_a_failing_text_is_left_pending(spark):
    class Picky(ingest.HashEmbedder):
        def embed(self, texts):
            if "poison" in texts:
                raise ValueError
            return super().embed(texts)

    chunks = spark.createDataFrame([("1", "fine"), ("2", "poison")], "hash string, text string")
    assert [r.hash for r in ingest.embedded(chunks, Picky()).collect()] == ["1"]


def test_compaction_keeps_the_last_update_as_snapshot(spark):
    rows = log.numbered(spark.createDataFrame([(1, f"u{i}", i) for i in range(5)] + [(2, "v", 0)], "page_id long, update string, at int"), ["at"])
    got = sorted((r.page_id, r.seq, r.update) for r in log.compacted(rows, 3).collect())
    assert got == [(1, 0, "u4"), (2, 1, "v")]


def test_stream_of_updates_adds_up_to_the_batch(spark, tmp_path):
    rows = spark.createDataFrame([(f"w{i % 3}",) for i in range(30)], "ws string")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    log.churn(log.read(spark, str(tmp_path / "in"), rows.schema), str(tmp_path / "out"), str(tmp_path / "check"))
    assert {r.ws: r.changed for r in log.churn_total(spark, str(tmp_path / "out")).collect()} == {"w0": 10, "w1": 10, "w2": 10}


# The friendships of Zachary's karate club, by the lower member.
KARATE = {
    0: (1, 2, 3, 4, 5, 6, 7, 8, 10, 11, 12, 13, 17, 19, 21, 31), 1: (2, 3, 7, 13, 17, 19, 21, 30), 2: (3, 7, 8, 9, 13, 27, 28, 32), 3: (7, 12, 13), 4: (6, 10), 5: (6, 10, 16), 6: (16,), 8: (30, 32, 33), 9: (33,), 13: (33,),
    14: (32, 33), 15: (32, 33), 18: (32, 33), 19: (33,), 20: (32, 33), 22: (32, 33), 23: (25, 27, 29, 32, 33), 24: (25, 27, 31), 25: (31,), 26: (29, 33), 27: (33,), 28: (31, 33), 29: (32, 33), 30: (32, 33), 31: (32, 33), 32: (33,),
}


def test_karate_club_has_four_communities_of_known_modularity(spark):
    edges = [(a, b, 1.0) for a, others in KARATE.items() for b in others]
    assert len(edges) == 78
    got = cm.louvain(34, edges)
    assert len(set(got)) == 4
    pairs = spark.createDataFrame([("w", str(a), str(b), w) for a, b, w in edges], "ws string, a string, b string, weight double")
    members = spark.createDataFrame([("w", str(i), c) for i, c in enumerate(got)], "ws string, name string, community int")
    assert cm.modularity(pairs, members).first()["q"] == pytest.approx(0.4188, abs=0.002)


def test_summary_progress_counts_all_but_pending_summaries(spark):
    from quillgraph.operators import communities

    c = spark.createDataFrame([("a", i, f"h{i}", 0 if i == 5 else 3) for i in range(6)], "ws string, community int, member_hash string, n_members int")
    s = spark.createDataFrame([("a", 0, "h0", "m"), ("a", 1, "old", "m"), ("a", 2, "h2", "other"), ("b", 3, "h3", "m"), ("a", 5, "h5", "m")], "ws string, community int, member_hash string, model string")
    assert communities.summary_progress(c, s, "m").collect() == [(1, 5)]
    assert communities.pending_summaries(c, s, "m").count() == 4


def test_seeds_are_all_chunks_of_the_pages_found(spark):
    from quillgraph.operators import graph

    hits = spark.createDataFrame([(7, 0.2, False), (4, 0.5, False), (9, 0.2, True)], "page_id long, score double, lexical boolean")
    pages = spark.createDataFrame([(4, "w", "a"), (4, "w", "b"), (7, "w", "c"), (9, "v", "d"), (1, "w", "e")], "page_id long, ws string, hash string")
    assert {tuple(r) for r in graph.seeds_from_pages(hits, pages).collect()} == {("w", "a", 1), ("w", "b", 1), ("v", "d", 2), ("w", "c", 3)}


def test_clusterable_edges_of_pages_are_those_of_their_live_ones_and_take_one_shuffle(spark):
    rows = [(1, "w", "Ann Bob Ann Bob Cy", "h1", False), (2, "w", "Ann Bob Ann Bob Cy", "h1", True), (3, "w", "Dee Eve", "h2", True), (4, None, "Fay Gus", "h3", False), (5, "v", "Dee Eve", "h2", False), (6, "w", None, None, False), (7, "v", "Dee, Eve", "h4", False)]
    p = spark.createDataFrame(rows, "page_id long, ws string, text string, hash string, archived boolean")
    got = gr.clusterable_of(p)
    assert sorted(got.collect()) == sorted(gr.clusterable(gr.edges(p), p).collect())
    assert sorted((r.ws, r.source, r.target) for r in got.collect()) == [("v", "dee", "eve"), ("v", "dee", "eve"), ("w", "ann", "bob"), ("w", "bob", "ann"), ("w", "bob", "cy")]
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_partition_by_workspace_is_louvain_of_its_names_in_order(spark):
    r = random.Random(3)
    pairs = sorted({(ws, *sorted(r.sample("äabcdefghijklmnopéz𝒳", 2))) for ws in "vw" for _ in range(40)})
    got = cm.partition(spark.createDataFrame([(ws, a, b, 1.0) for ws, a, b in pairs], "ws string, a string, b string, weight double").repartition(3)).collect()
    for ws in "vw":
        mine = [(a, b) for w, a, b in pairs if w == ws]
        names = sorted({x for p in mine for x in p})
        want = cm.louvain(len(names), [(names.index(a), names.index(b), 1.0) for a, b in mine])
        assert {r.name: r.community for r in got if r.ws == ws} == dict(zip(names, want, strict=True))


def test_louvain_takes_equal_ends_and_loops_together():
    edges = [(0, 1, 1.0), (1, 0, 1.0), (2, 2, 3.0), (2, 3, 1.0), (1, 2, 0.5)]
    assert cm.louvain(4, edges) == cm.louvain(4, [(0, 1, 2.0), (1, 2, 0.5), (2, 2, 3.0), (2, 3, 1.0)])
    assert cm.louvain_of(2, *(np.array(x) for x in ([0], [1], [1.0]))).tolist() == [0, 0]
