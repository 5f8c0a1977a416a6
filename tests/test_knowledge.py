import pytest
from pyspark.sql import functions as F

from quillgraph.functions import fts
from quillgraph.operators import accounts as ac
from quillgraph.operators import knowledge as kn

PAGE = "page_id long, ws string, parent_id long, title string, text string, hash string, archived boolean"
def now():
    return F.lit("2026-01-01").cast("timestamp")


@pytest.mark.parametrize(
    ("word", "want"),
    [
        ("caresses", "caress"), ("flies", "fli"), ("running", "run"), ("hopping", "hop"), ("hoping", "hope"), ("relational", "relat"), ("conditional", "condit"), ("generously", "generous"), ("agreed", "agre"), ("feed", "feed"),
        ("consistency", "consist"), ("skies", "sky"), ("abilities", "abil"), ("happily", "happili"), ("ties", "tie"), ("cries", "cri"), ("by", "by"),
    ],
)
def test_stems(word, want):
    assert fts.stem(word) == want


def test_all_lexemes_have_to_match_and_closer_ones_rank_higher(spark):
    rows = spark.createDataFrame([(1, "Tuning a database"), (2, "database of many kinds needing tunes"), (3, "databases only"), (4, None)], "page_id long, text string")
    got = {r.page_id: r.d for r in rows.select("page_id", fts.rank(F.col("text"), "tuned databases").alias("d")).collect()}
    assert got[1] > got[2] > 0 and got[3] is None and got[4] is None
    assert all(r[0] is None for r in rows.select(fts.rank(F.col("text"), "of the")).collect())


def test_a_description_is_never_taken_away_and_the_last_type_stays(spark):
    schema = "ws string, name string, entity_type string, description string"
    known = spark.createDataFrame([("w", "kerala", "PLACE", "a state"), ("w", "bob", "CONCEPT", None)], schema)
    found = spark.createDataFrame([("w", "Kerala.", None, None, 1), ("w", "Bob", "PERSON", "x", 2), ("w", "bob", None, None, 3), ("w", "123", None, None, 4), ("w", "New", None, None, 5)], schema + ", seq int")
    got = {r.name: (r.entity_type, r.description) for r in kn.resolved(known, found).collect()}
    assert got == {"kerala": ("PLACE", "a state"), "bob": ("PERSON", "x"), "new": ("CONCEPT", None)}


def test_extracting_again_replaces_the_chunks_own_edges_alone(spark):
    schema = "ws string, source string, target string, relation string, hash string, model string, weight double"
    old = spark.createDataFrame([("w", "a", "b", "r", "h1", "m", 1.0), ("w", "a", "b", "r", "h2", "m", 1.0), ("v", "a", "b", "r", "h1", "m", 1.0)], schema)
    new = spark.createDataFrame([("w", "a", "c", "r", "h1", "m", 0.2, 1), ("w", "a", "c", "r", "h1", "m", 0.7, 2)], schema + ", seq int")
    got = sorted((r.ws, r.target, r.hash, r.weight) for r in kn.replaced_edges(old, new, new).collect())
    assert got == [("v", "b", "h1", 1.0), ("w", "b", "h2", 1.0), ("w", "c", "h1", 0.7)]


def test_weights_are_numbers_from_0_to_1(spark):
    rows = spark.createDataFrame([(float("nan"),), (-1.0,), (0.5,), (9.0,), (None,)], "w double")
    assert [r[0] for r in rows.select(kn.clean_weight(F.col("w"))).collect()] == [0, 0, 0.5, 1, 0]


class Refuses(kn.Answerer):
    def answer(self, *_):
        raise AssertionError("asked without evidence")


def test_no_evidence_asks_no_provider(spark):
    hits = spark.createDataFrame([], "page_id long, hash string, hops int, score double")
    pages = spark.createDataFrame([], PAGE)
    assert kn.local_answer(hits, pages, spark.createDataFrame([], "ws string, name string"), "why?", Refuses()).text == 'Nothing on file bears on "why?".'
    summaries = spark.createDataFrame([(1, 5, None)], "community int, n_members int, summary string")
    got = kn.global_answer(summaries, "why?", Refuses())
    assert got.skipped == 1 and not got.citations


def test_answers_cite_their_passages(spark):
    hits = spark.createDataFrame([(1, "h", 0, 0.5), (2, "g", 2, 0.1)], "page_id long, hash string, hops int, score double")
    pages = spark.createDataFrame([(1, "w", None, "One", "some text", "h", False), (2, "w", None, "Two", "more", "g", False)], PAGE)
    got = kn.local_answer(hits, pages, spark.createDataFrame([("w", "ann")], "ws string, name string"), "who", kn.StubAnswerer())
    assert got.text == 'On "who" (about ann), 2 passages: One [found directly by search] "some text"; Two [2 hops from a subject of the question] "more".'


def test_themes_go_by_distance_if_known_and_by_size_else(spark):
    rows = spark.createDataFrame([(1, 12, "big theme", 0.9), (2, 2, "small theme", 0.1)], "community int, n_members int, summary string, distance double")
    assert [r.community for r in kn.themes(rows, "of", 1).collect()] == [2]
    assert [r.community for r in kn.themes(rows.drop("distance"), "of", 1).collect()] == [1]


def test_summaries_of_another_text_are_embedded_again(spark):
    s = spark.createDataFrame([("w", 1, "a"), ("w", 2, "b"), ("w", 3, "c")], "ws string, community int, summary string")
    done = s.where("community < 3").select("ws", "community", F.md5(F.lit("a")).alias("summary_hash"))
    assert sorted(r.community for r in kn.pending_summary_embeddings(s, done).collect()) == [2, 3]


def test_expired_tokens_and_other_scopes_are_refused(spark):
    tokens = spark.createDataFrame([("t", ["pages:read"], None), ("old", ["pages:read"], "2025-01-01")], "token_hash string, scopes array<string>, expires_at string").withColumn("expires_at", F.col("expires_at").cast("timestamp"))
    calls = spark.createDataFrame([("t", "/pages/1", "GET"), ("t", "/pages/1", "POST"), ("t", "/search", "GET"), ("old", "/pages", "GET")], "token_hash string, path string, method string")
    assert [(r.path, r.method) for r in ac.allowed(calls, tokens, now()).collect()] == [("/pages/1", "GET")]


def test_shares_go_down_only_and_expire(spark):
    pages = spark.createDataFrame([(1, "w", None, "top", "", "", False), (2, "w", 1, "mid", "", "", False), (3, "w", 2, "low", "", "", False)], PAGE)
    blocks = spark.createDataFrame([(2, 0, "text")], "page_id long, block_index int, text string")
    links = spark.createDataFrame([("one", 2, False, None), ("all", 2, True, None), ("late", 2, True, "2020-01-01")], "token_hash string, page_id long, include_descendants boolean, expires_at string").withColumn("expires_at", F.col("expires_at").cast("timestamp"))
    got = {k: [(r.page_id, r.text) for r in ac.read_shared(pages, blocks, links, k, now()).collect()] for k in ("one", "all", "late", "none")}
    assert got == {"one": [(2, "text")], "all": [(2, "text"), (3, None)], "late": [], "none": []}


def test_resolving_a_thread_resolves_its_replies(spark):
    c = spark.createDataFrame([(1, None, False), (2, 1, False), (3, None, False)], "comment_id long, parent_id long, resolved boolean")
    assert {r.comment_id: r.resolved for r in ac.resolved_thread(c, 1).collect()} == {1: True, 2: True, 3: False}


def test_anchor_is_lost_with_its_quote(spark):
    c = spark.createDataFrame([(1, 7, 0, "two"), (2, 7, 0, "gone")], "comment_id long, page_id long, block_index int, quote string")
    b = spark.createDataFrame([(7, 0, "one two")], "page_id long, block_index int, text string")
    assert {r.comment_id: r.at for r in ac.anchored(c, b).collect()} == {1: 4, 2: None}


def test_template_comes_back_filled_in(spark):
    b = spark.createDataFrame([(1, 1, "p", "bye {{who}}"), (1, 0, "h1", "hi {{who}} {{x}}"), (2, 0, "p", "no")], "page_id long, block_index int, kind string, text string")
    got = ac.instantiated(ac.saved_template(b, 1, "For {{who}}"), {"who": "Ann"}).collect()
    assert [(r.title, r.kind, r.text) for r in got] == [("For Ann", "h1", "hi Ann {{x}}"), ("For Ann", "p", "bye Ann")]


def test_links_need_live_ends_in_one_workspace(spark):
    pages = spark.createDataFrame([(1, "w", None, "", "", "", False), (2, "w", None, "", "", "", False), (3, "v", None, "", "", "", False), (4, "w", None, "", "", "", True)], PAGE)
    links = spark.createDataFrame([(1, 2, 1), (1, 3, 2), (1, 4, 3)], "from_page long, to_page long, created_at int")
    assert [(r.from_page, r.to_page) for r in ac.linked(links, pages).collect()] == [(1, 2)]


def test_a_changed_page_names_the_rollups_one_step_back(spark):
    links = spark.createDataFrame([("p", 1, 9), ("q", 2, 9), ("p", 3, 8)], "property_id string, from_page long, to_page long")
    rollups = spark.createDataFrame([("sum", '{"via": "p"}')], "rollup string, config string")
    assert [(r.rollup, r.page) for r in ac.rollup_dependents(links, rollups, 9).collect()] == [("sum", 1)]


def test_provider_names_are_checked():
    from quillgraph.operators import workers as wk

    assert wk.provider("stub") == wk.Provider("stub") and wk.provider("ollama:m:7b") == wk.Provider("ollama", "m:7b")
    for bad in ("", "ollama", "ollama:", "other:m", "stub:x"):
        with pytest.raises(wk.ProviderError):
            wk.provider(bad)


def test_a_shared_chunk_is_extracted_once_and_given_to_each_tenant(spark):
    from quillgraph.operators import workers as wk

    pages = spark.createDataFrame([(1, "a", None, "", "Ann (Bob)", "h", False), (2, "b", None, "", "Ann (Bob)", "h", False), (3, "c", None, "", "Ann (Bob)", "h", True), (4, "a", None, "", "poison", "p", False)], PAGE)
    done = spark.createDataFrame([], "hash string, ws string")

    class Picky(wk.StubExtractor):
        def extract(self, text):
            if text == "poison":
                raise ValueError
            return super().extract(text)

    got = wk.extracted(pages, done, Picky())
    assert sorted((r.hash, r.failed) for r in got.collect()) == [("h", False), ("p", True)]
    out = wk.fanned_out(got, pages).collect()
    assert sorted(r.ws for r in out) == ["a", "b"] and out[0].names == ["Ann"]


def test_draining_ends_when_nothing_moves_or_nothing_is_left():
    from quillgraph.operators import workers as wk

    steps = iter([5, 0, 3, 0, 0, 0, 9])
    assert wk.drain(lambda: next(steps)) == 8
    steps = iter([5, None])
    assert wk.drain(lambda: next(steps)) == 5


def test_full_run_keeps_what_is_known_of_surviving_communities(spark):
    from quillgraph.operators import workers as wk

    pages = spark.createDataFrame([(1, "w", None, "", "Ann Bob Cid Ann", "1", False), (2, "w", None, "", "Dan Eve Fay Dan", "2", False)], PAGE)
    members, named = wk.full_run(pages)
    assert sorted((r.name, r.community) for r in members.collect()) == [("ann", 0), ("bob", 0), ("cid", 0), ("dan", 1), ("eve", 1), ("fay", 1)]
    known = named.where("community = 0").withColumn("summary", F.lit("text"))
    assert sorted((r.community, r.summary) for r in wk.full_run(pages, known)[1].collect()) == [(0, "text"), (1, None)]


def test_plugins_see_their_host(spark):
    from quillgraph.operators import workers as wk

    wk.Plugins(spark, "w", {"sep": "-"}).register("tagged", lambda host, x: f"{host['ws']}{host['settings']['sep']}{x}", "string")
    assert spark.sql("SELECT tagged('a') AS x").first()["x"] == "w-a"


def test_plugins_fail_and_hang_for_their_row_alone(spark):
    from quillgraph.operators import workers as wk

    def moody(host, x):
        if x == 1:
            raise ValueError
        while x == 2:
            pass
        return x * 10

    wk.Plugins(spark, "w").register("moody", moody, "long", seconds=0.3)
    assert [r.y for r in spark.sql("SELECT id, moody(id) AS y FROM range(5)").orderBy("id").collect()] == [0, None, None, 30, 40]


def test_a_rate_limit_leaves_the_rest_for_later(spark):
    from quillgraph.operators import workers as wk

    class Limited(wk.StubExtractor):
        def __init__(self):
            self.asked = 0

        def extract(self, text):
            self.asked += 1
            if self.asked > 3:
                raise wk.RateLimited
            if self.asked == 2:
                raise ValueError
            return super().extract(text)

    pages = spark.createDataFrame([(i, "w", None, "", f"Ann Bob{i}", f"h{i}", False) for i in range(20)], PAGE)
    got = wk.extracted(pages, spark.createDataFrame([], "hash string, ws string"), Limited()).coalesce(1).collect()
    assert len(got) == 3 and sum(r.failed for r in got) == 1


def test_backfilling_goes_through_all_stages(spark):
    from quillgraph.operators import ingest, summaries
    from quillgraph.operators import workers as wk

    pages = spark.createDataFrame([(1, "w", None, "", "Ann Bob Cid Ann", "1", False), (2, "w", None, "", "Dan Eve Fay Dan", "2", False), (3, "w", None, "", "Gus Hal", "3", True)], PAGE)
    out = wk.backfilled(pages, ingest.HashEmbedder(), summaries.StubSummariser())
    n = {k: v.count() for k, v in out.items()}
    assert n["page_chunks"] == n["chunks"] == n["embeddings"] == 2 and n["edges"] == 6 and n["communities"] == 2
    assert tuple(out["reaped"].first()) == (1, 2) and n["summary_embeddings"] == 2
    assert {r.summary for r in out["summaries"].collect()} == {"3 entities: ann, bob, cid", "3 entities: dan, eve, fay"}
